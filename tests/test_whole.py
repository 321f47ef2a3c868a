"""Protein queries on whole texts against brute force: texts longer than any sample, motifs far in."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import coding as C
from strandloom.plans import catalog

RNG = np.random.default_rng(3)
#: Above STRETCH residues; no residues; a motif (GAAUUC, as E then F) only behind residue 12; other letters.
LONG = "".join(RNG.choice(list("ACDEFGHIKLMNPQRSTVWY é.\nbz"), 60_000))
TEXTS = [None, "", "bjo uxz 12", "Mf", "m" * 40 + "ef" * 3, "Met ß ﬁ é Leu!", "M" * 30 + "w k", LONG]
TABLE: dict = {}
for _c, _a, _f in catalog.CODONS:
    TABLE.setdefault(_a, {})[_c] = _f
COST = {a: {c: -math.log(f / max(cs.values())) for c, f in cs.items()} for a, cs in TABLE.items()}
BEST = {a: min(cs, key=lambda c: (cs[c], c)) for a, cs in COST.items()}


def whole(text):
    return "".join(c for c in (text or "") if c.isascii() and c.isalpha()).upper().translate(dict.fromkeys(map(ord, "BJOUXZ")))


@pytest.fixture(scope="module")
def d(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def seqs():
    assert len(whole(LONG)) > C.STRETCH
    return {i: s for i, t in enumerate(TEXTS) if (s := whole(t))}


def got(spark, d, name):
    return {r.protein_id: r for r in catalog.QUERIES[f"{name}"](spark, d).collect()}


def test_sources(spark, d):
    assert {i: r.seq or "" for i, r in got(spark, d, "protein_source").items()} == {i: whole(t) for i, t in enumerate(TEXTS)}


def test_sequences(spark, d, seqs):
    cds, first, cost = got(spark, d, "max_cai_cds"), got(spark, d, "cai_score"), got(spark, d, "min_codon_cost")
    assert set(cds) == set(first) == set(cost) == set(seqs)
    most = max(v for cs in COST.values() for v in cs.values())
    free = set()
    for i, s in seqs.items():
        assert cds[i].cds == "".join(BEST[a] for a in s)
        least = math.fsum(COST[a][BEST[a]] for a in s)
        assert cds[i].penalty == pytest.approx(least, abs=2e-6) and cost[i].cost == pytest.approx(least, abs=2e-6)
        assert cost[i].tie_break == pytest.approx(min(1e-4, 0.004 / (len(s) * most)), abs=2e-12)
        penalty = math.fsum(COST[a][min(TABLE[a])] for a in s)
        assert first[i].protein == s
        assert first[i].penalty == pytest.approx(penalty, rel=1e-9, abs=2e-6) and first[i].cai == pytest.approx(math.exp(-penalty / len(s)), abs=2e-9)
        if not any(m.replace("T", "U") in cds[i].cds for m in catalog.MOTIFS):
            free.add(i)
    assert 0 < len(free) < len(seqs)
    assert set(got(spark, d, "motif_scan")) == free


def test_lattices(spark, d, seqs):
    nodes, edges = {}, {}
    for r in catalog.QUERIES["lattice_nodes"](spark, d).collect():
        nodes.setdefault(r.protein_id, []).append((r.node, r.pos, r.prefix))
    for r in catalog.QUERIES["lattice_edges"](spark, d).collect():
        edges.setdefault(r.protein_id, []).append((r.src_pos, r.src, r.dst, r.nuc, r.weight))
    shape = got(spark, d, "lattice_shape")
    assert set(nodes) == set(edges) == set(shape) == set(seqs)
    for i, s in seqs.items():
        want = [(3 * p + k, x) for p, a in enumerate(s) for k, x in sorted({(k, c[:k]) for c in TABLE[a] for k in range(3)})] + [(3 * len(s), "")]
        assert sorted(nodes[i]) == [(n, *x) for n, x in enumerate(want)]
        at = np.bincount([p for p, _ in want])
        assert (shape[i].nodes, shape[i].widest) == (len(want), at.max())
        steps = {a: {(k, c[:k], c[: k + 1] if k < 2 else "", c[k], round(COST[a][c], 9) if k == 2 else 0.0) for c in TABLE[a] for k in range(3)} for a in set(s)}
        assert sorted(x[:4] for x in edges[i]) == sorted((3 * p + k, *x) for p, a in enumerate(s) for k, *x in (t[:4] for t in steps[a]))
        assert math.fsum(x[4] for x in edges[i]) == pytest.approx(math.fsum(t[4] for a in s for t in steps[a]), rel=1e-6)


def test_codons_of_a_long_sequence(spark):
    x = "ACGUUA" * 40_000  # a substring from the start for each codon would take minutes
    (r,) = spark.createDataFrame([(x,)], "x string").select(S.codons(F.col("x")).alias("c")).collect()
    assert r.c == ["ACG", "UUA"] * 40_000


def test_enumeration(spark, d, seqs):
    """Whole proteins by sums; short ones also spelled out."""
    rows = got(spark, d, "cds_enumeration")
    assert set(rows) == set(seqs)
    for i, s in seqs.items():
        assert rows[i].log10_n == pytest.approx(math.fsum(math.log10(len(TABLE[a])) for a in s), rel=1e-9, abs=2e-6)
        assert rows[i].first_cds == "".join(min(TABLE[a]) for a in s)
        assert rows[i].least == pytest.approx(math.fsum(min(COST[a].values()) for a in s), rel=1e-9, abs=2e-6)
        assert rows[i].most == pytest.approx(math.fsum(max(COST[a].values()) for a in s), rel=1e-9, abs=2e-6)
    short = spark.createDataFrame([("a", "M"), ("b", "MF"), ("c", "MFL"), ("d", "RSLW"), ("e", "")], "protein_id string, seq string")
    w = C.weights(catalog._table(spark))
    found: dict = {}
    for r in C.enumerated(short, w, 4).collect():
        found.setdefault(r.protein_id, {})[r.cds] = r.penalty
    sums = {r.protein_id: r for r in C.spellings(short, w).collect()}
    assert set(found) == set(sums) == set("abcd") and len(found["c"]) == 12
    for i, s in (("a", "M"), ("b", "MF"), ("c", "MFL"), ("d", "RSLW")):
        want = {"".join(c): sum(COST[a][x] for a, x in zip(s, c, strict=True)) for c in itertools.product(*(TABLE[a] for a in s))}
        assert found[i] == pytest.approx(want)
        assert (round(10 ** sums[i].log10_n), sums[i].first_cds) == (len(want), min(want))
        assert (sums[i].least, sums[i].most) == pytest.approx((min(want.values()), max(want.values())))
    with pytest.raises(Exception, match="too long to enumerate"):
        C.enumerated(short, w, 3).collect()
