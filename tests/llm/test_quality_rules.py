"""The robust estimates of the quality rules against a plain search on planted vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import common, quality_rules as Q

RNG = np.random.default_rng(17)
MIX = RNG.normal(0, 0.4, (Q.P, Q.P)) + np.eye(Q.P)


def _group(n: int, bad: int, at: float) -> np.ndarray:
    good = RNG.normal(0, 0.8, (n, Q.P)) @ MIX + 2.0
    return np.concatenate([good, np.full((bad, Q.P), at) + RNG.normal(0, 0.3, (bad, Q.P))])


#: (language, source): vectors; outliers stand last. One group is of two rows, one of equal rows.
GROUPS = {("en", "a"): (_group(400, 90, 9.0), 90), ("en", "b"): (_group(120, 20, -7.0), 20), ("en", "c"): (_group(2, 0, 0), 0), ("de", "a"): (_group(30, 5, 11.0), 5), ("de", "b"): (np.full((9, Q.P), 2.0), 0)}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, k, lang, *np.round(v * Q.SCALE).astype(int).tolist()) for (lang, source), (x, _) in GROUPS.items() for k in [f"{lang}/{source}"] for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "i int, key string, lang string, " + ", ".join(f"x{i} long" for i in range(Q.P)))
    return common.written(df.repartition(3), "rows")


def scatter(x, w, t, u):
    """Centre and scatter of weighted rows with the fixed rows, and the floors."""
    n = w.sum() + Q.TARGET
    m = (w @ x + Q.TARGET * t) / n
    c = ((x * w[:, None]).T @ x + Q.TARGET * (np.outer(t, t) + np.diag(u**2))) / n - np.outer(m, m)
    c[np.diag_indices(Q.P)] = np.maximum(np.diag(c), np.array(Q.FLOORS) ** 2)
    return m, c


def plain(x, t, u):
    """The least determinant over many random starts, each with exact steps to the end."""
    h, best = Q.H * len(x), None
    rng = np.random.default_rng(4)
    for trial in range(40):
        w = np.ones(len(x)) if not trial else np.isin(np.arange(len(x)), rng.choice(len(x), min(len(x), Q.P + 2), False)).astype(float)
        last = np.inf
        while True:
            m, c = scatter(x, w, t, u)
            det = np.linalg.slogdet(c)[1]
            if w.sum() > h - 1e-9 and det > last - 1e-9:
                break
            last = det if w.sum() <= h + 1e-9 else np.inf
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            order, w = np.argsort(d, kind="stable"), np.zeros(len(x))
            w[order] = np.clip(h - np.arange(len(x)), 0, 1)
        if best is None or det < best[0]:
            best = det, m, c
    return best


def test_outliers_as_by_a_plain_search(rows):
    near = {(r.key, r.i): (r.d2 * Q.H_CHI2 / max(r.d2_h, Q.H_CHI2), r.logdet) for r in rows.join(Q.estimates(rows.drop("i")), "key").withColumn("d2", Q.distance()).collect()}
    assert len(near) == sum(len(x) for x, _ in GROUPS.values())
    by_lang = {r.key: r for r in Q.middles(rows.select(F.col("lang").alias("key"), *(f"x{i}" for i in range(Q.P)))).collect()}
    for (lang, source), (x, bad) in GROUPS.items():
        r = by_lang[lang]
        t, u = np.array([r[f"t{i}"] for i in range(Q.P)]), np.array([r[f"u{i}"] for i in range(Q.P)])
        det, m, c = plain(x, t, u)
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        d *= Q.H_CHI2 / max(np.sort(d)[int(np.ceil(Q.H * len(x))) - 1], Q.H_CHI2)
        mine = np.array([near[f"{lang}/{source}", i][0] for i in range(len(x))])
        assert near[f"{lang}/{source}", 0][1] == pytest.approx(det, abs=0.35)
        clear = (d > 1.3 * Q.CUTOFF) | (d < Q.CUTOFF / 1.3)
        assert ((mine > Q.CUTOFF) == (d > Q.CUTOFF))[clear].all()
        assert (mine[len(x) - bad :] > Q.CUTOFF).all() and (mine[: len(x) - bad] > Q.CUTOFF).mean() < 0.03


@pytest.mark.parametrize("few", [True, False])
def test_steps_do_not_raise_the_determinant(rows, few):
    """Also where the estimates are joined by salt instead of broadcast."""
    x = rows.drop("i")
    lang = Q.middles(x.select(F.col("lang").alias("key"), *(f"x{i}" for i in range(Q.P)))).withColumnRenamed("key", "lang")
    targets = common.written(x.select("key", "lang").distinct().join(lang, "lang").select("key", *Q.MIDDLE), "targets")
    model, before = common.written(Q._as_model(Q.middles(x), 1), "model"), {}
    for _ in range(5):
        found = common.written(Q.estimate(Q.subset(x, model, few), targets, few), "model")
        now = {r.key: r.logdet for r in found.collect()}
        assert all(now[k] <= v + 0.02 for k, v in before.items())  # within a bucket distances are not told apart
        before, model = now, found.drop("logdet")
