"""Summaries of run records: paired ratios, quantiles, regressions, envelopes, bootstraps."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S


#: Accuracy of the sketch that brackets a quantile: it is off by one rank in SKETCH at most.
SKETCH = 10_000


def same_keys(df: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df joined with what is known of its groups; null keys are equal to one another. Spark
    broadcasts groups where it knows them to be small, and else splits a group of many rows."""
    named = groups.select(*(F.col(b).alias(f"_key{i}") for i, b in enumerate(by)), *(c for c in groups.columns if c not in by))
    on = [df[b].eqNullSafe(named[f"_key{i}"]) for i, b in enumerate(by)]
    return df.join(named, on, how).drop(*(f"_key{i}" for i in range(len(by))))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, share, q: exact quantiles by group with linear interpolation at (n - 1) * share.

    A sketch of fixed size gives for each group and share two values around it. A second pass
    counts what lies below and above (before the shuffle) and groups only the values between, so
    no group's values are ever held together, whatever its size."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    near = [min(1.0, max(0.0, s + d * 2 / SKETCH)) for s in shares for d in (-1, 1)]
    told = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", near, SKETCH).alias("_near"))
    ends = F.array(*(F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("at"), F.col("_near")[2 * i].alias("lo"), F.col("_near")[2 * i + 1].alias("hi")) for i, s in enumerate(shares)))
    wanted = told.select(*by, F.explode(ends).alias("w")).select(*by, "w.*")
    keys = [F.col(f"r.{b}").eqNullSafe(F.col(f"w.{b}")) for b in by]
    zone = F.when(F.col("_v") < F.col("lo"), 0).when(F.col("_v") > F.col("hi"), 2).otherwise(1)
    met = rows.alias("r").join(wanted.alias("w"), keys).select(*(F.col(f"r.{b}").alias(b) for b in by), "share", "at", "_v", zone.alias("_zone"))
    # of the values below only the greatest can be a rank's value, of those above only the least
    cells = met.groupBy(*by, "share", "at", "_zone", F.when(F.col("_zone") == 1, F.col("_v")).alias("_in")).agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    upto = cells.withColumn("_upto", F.sum("_c").over(W.partitionBy(*by, "share").orderBy("_zone", "_in")))
    own = F.when(F.col("_zone") == 0, F.col("_high")).otherwise(F.col("_low"))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, own))
    low, high = F.floor("at"), F.ceil("at")
    out = upto.groupBy(*by, "share").agg(at(low).alias("_a"), at(high).alias("_b"), F.max(F.col("at") - low).alias("_part"))
    return out.select(*by, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("q"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, least, quartiles and greatest by group, with linear interpolation."""
    q = quantiles(df, by, value, [0.25, 0.5, 0.75])
    pick = lambda s: F.max(F.when(F.col("share") == s, F.col("q")))
    quarters = q.groupBy(*by).agg(pick(0.25).alias("q25"), pick(0.5).alias("median"), pick(0.75).alias("q75"))
    ends = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    keys = [F.col(f"a.{b}").eqNullSafe(F.col(f"b.{b}")) for b in by]
    return ends.alias("a").join(quarters.alias("b"), keys, "left").select(*(F.col(f"a.{b}").alias(b) for b in by), "n", "least", "q25", "median", "q75", "greatest")


def arm_medians(df: DataFrame, block: list[str], arm: str, arms: list[str], value: str) -> DataFrame:
    """Median of value for each block as one column per arm; only blocks that have all arms."""
    q = quantiles(df.where(F.col(arm).isin(arms)), [*block, arm], value, [0.5])
    out = q.groupBy(*block).agg(*(F.max(F.when(F.col(arm) == a, F.col("q"))).alias(a) for a in arms))
    return out.dropna(subset=arms)


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.log(x)))


def moments(df: DataFrame, by: list[str], x: dict[str, Column], y: Column, weight: Column | None = None) -> DataFrame:
    """Weighted moment sums of named regressors x and of y by group: n, w, w_x, w_x_x.., rows
    with a null left out. Values are taken from the group's means, so squares do not cancel."""
    names = [*x, "y"]
    rows = df.select(*by, *(c.cast("double").alias(n) for n, c in x.items()), y.cast("double").alias("y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w")).dropna(subset=[*names, "w"])
    means = rows.groupBy(*by).agg(*(F.try_divide(F.sum(F.col("w") * F.col(n)), F.sum("w")).alias(f"mean_{n}") for n in names))
    keys = [F.col(f"r.{b}").eqNullSafe(F.col(f"m.{b}")) for b in by]
    both = rows.alias("r").join(means.alias("m"), keys)
    centred = both.select(*(F.col(f"r.{b}").alias(b) for b in by), "w", *(f"mean_{n}" for n in names), *((F.col(n) - F.col(f"mean_{n}")).alias(n) for n in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return centred.groupBy(*by).agg(F.count("*").alias("n"), F.sum("w").alias("w"), *(F.max(f"mean_{n}").alias(f"mean_{n}") for n in names), *(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs))


def ols(df: DataFrame, by: list[str], x: Column, y: Column, weight: Column | None = None) -> DataFrame:
    """n, slope, intercept, r2, sse, rmse by (weighted) least squares."""
    m = moments(df, by, {"x": x}, y, weight)
    slope = F.try_divide("x_y", "x_x")
    sse = F.greatest(F.col("y_y") - slope * F.col("x_y"), F.lit(0.0))
    r2 = F.try_divide(F.col("x_y") ** 2, F.col("x_x") * F.col("y_y"))
    return m.select(*by, "n", slope.alias("slope"), (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"), r2.alias("r2"), sse.alias("sse"), F.sqrt(F.try_divide(sse, "w")).alias("rmse"))


def hinge(df: DataFrame, by: list[str], x: Column, y: Column, knot: float, weight: Column | None = None) -> DataFrame:
    """n, intercept, slope, bend, sse of a continuous line whose slope changes by bend at a knot;
    null where the normal equations have no single solution."""
    m = moments(df, by, {"x": x, "h": F.greatest(x - F.lit(knot), F.lit(0.0))}, y, weight)
    c = F.col
    det = c("x_x") * c("h_h") - c("x_h") ** 2
    safe = F.when(F.abs(det) > 1e-12 * c("x_x") * c("h_h"), det)
    slope, bend = (c("x_y") * c("h_h") - c("h_y") * c("x_h")) / safe, (c("h_y") * c("x_x") - c("x_y") * c("x_h")) / safe
    return m.select(*by, "n", (c("mean_y") - slope * c("mean_x") - bend * c("mean_h")).alias("intercept"), slope.alias("slope"), bend.alias("bend"), F.greatest(c("y_y") - slope * c("x_y") - bend * c("h_y"), F.lit(0.0)).alias("sse"))


def solved(matrix: Column, n: int, eps: float = 1e-12) -> Column:
    """The solution of n linear equations as an array: matrix is an array of n rows of n + 1 numbers,
    the last the right side. Elimination with the largest pivot of each column (the first of equal
    ones), in array functions; null where a pivot is below eps times the matrix's largest number."""
    at = lambda m, k, i: F.get(F.get(m, k), i)

    def step(a: Column, i: Column) -> Column:
        pivot = F.array_max(F.transform(F.sequence(i, F.lit(n - 1)), lambda j: F.struct(F.abs(at(a["m"], j, i)).alias("size"), (-j).alias("j"))))
        return S.once(F.struct(pivot.alias("p"), a["m"].alias("m"), a["least"].alias("least")), lambda b: swapped(b, i))

    def swapped(b: Column, i: Column) -> Column:
        m, j = b["m"], -b["p"]["j"]
        rows = F.transform(m, lambda r, k: F.when(k == i, F.get(m, j)).when(k == j, F.get(m, i)).otherwise(r))
        return S.once(rows, lambda r: S.once(F.transform(F.get(r, i), lambda x: F.try_divide(x, at(r, i, i))), lambda unit: cleared(r, unit, i, b)))

    def cleared(rows: Column, unit: Column, i: Column, b: Column) -> Column:
        out = F.transform(rows, lambda r, k: F.when(k == i, unit).otherwise(F.zip_with(r, unit, lambda u, v: u - F.get(r, i) * v)))
        return F.struct(F.when(b["p"]["size"] > b["least"], out).alias("m"), b["least"].alias("least"))

    largest = F.array_max(F.transform(F.flatten(matrix), F.abs))
    start = F.struct(matrix.alias("m"), (eps * largest).alias("least"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, lambda a, i: F.when(a["m"].isNotNull(), step(a, i)).otherwise(a))
    return F.transform(done["m"], lambda r: F.element_at(r, -1))


def knots(df: DataFrame, by: list[str], x: Column, y: Column, at: list[float], weight: Column | None = None) -> DataFrame:
    """n, intercept, slope, bends (an array), sse of a continuous line whose slope changes at each
    of some places; null where the normal equations have no single solution."""
    names = ["x", *(f"h{i}" for i in range(len(at)))]
    m = moments(df, by, {"x": x} | {f"h{i}": F.greatest(x - F.lit(k), F.lit(0.0)) for i, k in enumerate(at)}, y, weight)
    cell = lambda a, b: F.col(f"{a}_{b}" if f"{a}_{b}" in m.columns else f"{b}_{a}")
    # each regressor is scaled to size one, so that a pivot's size means something
    size = {a: F.sqrt(F.when(F.col(f"{a}_{a}") > 0, F.col(f"{a}_{a}"))) for a in names}
    rows = F.array(*(F.array(*(cell(a, b) / (size[a] * size[b]) for b in names), cell(a, "y") / size[a]) for a in names))
    whole = F.forall(F.flatten(rows), lambda v: v.isNotNull())
    out = m.withColumn("_b", F.when(whole, solved(rows, len(names))))
    slopes = [F.get("_b", F.lit(i)) / size[a] for i, a in enumerate(names)]
    intercept = F.col("mean_y") - sum((s * F.col(f"mean_{a}") for s, a in zip(slopes, names, strict=True)), F.lit(0.0))
    sse = F.col("y_y") - sum((s * cell(a, "y") for s, a in zip(slopes, names, strict=True)), F.lit(0.0))
    return out.select(*by, "n", intercept.alias("intercept"), slopes[0].alias("slope"), F.when(F.col("_b").isNotNull(), F.array(*slopes[1:])).alias("bends"), F.greatest(sse, F.lit(0.0)).alias("sse"))


def calibrated_weights(df: DataFrame, stratum: str, cluster: str) -> DataFrame:
    """One over the cluster's size, rescaled so that a stratum's weights sum to its size. Sizes
    are counted by cluster first; only these counts are joined back to the rows."""
    sizes = df.groupBy(stratum, cluster).agg(F.count("*").alias("_n"))
    whole = sizes.groupBy(stratum).agg(F.sum("_n").alias("_all"), F.count("*").alias("_clusters"))
    per = sizes.alias("a").join(whole.alias("b"), F.col(f"a.{stratum}").eqNullSafe(F.col(f"b.{stratum}"))).select(F.col(f"a.{stratum}").alias("_s"), F.col(f"a.{cluster}").alias("_c"), (F.col("_all") / (F.col("_n") * F.col("_clusters"))).alias("weight"))
    return df.join(per, df[stratum].eqNullSafe(per["_s"]) & df[cluster].eqNullSafe(per["_c"])).drop("_s", "_c")


def overlaps(df: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """Rows that begin before an earlier row of the group has ended."""
    w = W.partitionBy(*by).orderBy(start, stop).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("busy_until", F.max(stop).over(w)).where(F.col(start) < F.col("busy_until"))


#: Rows of a group whose pairs are looked at one by one.
FEW = 16


def inversions(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, inverted, pairs: of a group's pairs with different x, how many have their y in the
    opposite order. Groups of one row have no pairs and are left out. In groups of at most FEW rows
    each row meets those before it; larger ones are counted without making pairs."""
    rows = df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null")
    w = W.partitionBy(*by).orderBy("_x")
    met = rows.withColumns({"_n": F.count("*").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "_before": F.collect_list(F.struct("_x", "_y")).over(w.rowsBetween(-FEW, -1))})
    less = F.filter("_before", lambda b: b["_x"] < F.col("_x"))
    each = met.where(F.col("_n") <= FEW).select(*by, F.size(less).alias("_p"), F.size(F.filter(less, lambda b: b["_y"] > F.col("_y"))).alias("_i"))
    few = each.groupBy(*by).agg(F.sum("_i").alias("inverted"), F.sum("_p").alias("pairs")).where("pairs > 0")
    many = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).drop("_n")
    return few.unionByName(_many_inversions(same_keys(rows, many, by), by))


def _many_inversions(rows: DataFrame, by: list[str]) -> DataFrame:
    """inversions of rows by, _x, _y. No pairs are made: with y as a rank, an inverted pair agrees on the rank's
    leading bits up to the one where the earlier row has 1 and the later one 0, so running counts
    for each bit find all of them."""
    ranked = rows.withColumn("_r", F.dense_rank().over(W.partitionBy(*by).orderBy("_y")) - 1)
    bits = F.floor(F.log2(F.max("_r").over(W.partitionBy(*by)) + F.lit(0.5)))
    each = ranked.withColumn("_bits", F.greatest(bits, F.lit(0)).cast("int")).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.col("_bits"))))
    above = lambda bits: F.floor(F.col("_r") / F.pow(F.lit(2), bits))
    prefix, one = above(F.col("_bit") + 1), above(F.col("_bit")) % 2
    w = W.partitionBy(*by, "_bit", "_prefix").orderBy("_x", "_r").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = each.withColumn("_prefix", prefix).withColumn("_one", one.cast("int")).withColumn("_before", F.sum("_one").over(w))
    inverted = met.where("_one = 0").groupBy(*by).agg(F.sum("_before").cast("long").alias("inverted"))
    ties = rows.groupBy(*by, "_x").agg(F.count("*").alias("_c")).groupBy(*by).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * (F.col("_c") - 1) / 2).cast("long").alias("_ties"))
    pairs = ties.withColumn("pairs", (F.col("_n") * (F.col("_n") - 1) / 2).cast("long") - F.col("_ties")).where("pairs > 0")
    keys = [F.col(f"p.{b}").eqNullSafe(F.col(f"i.{b}")) for b in by]
    return pairs.alias("p").join(inverted.alias("i"), keys, "left").select(*(F.col(f"p.{b}").alias(b) for b in by), F.coalesce("inverted", F.lit(0).cast("long")).alias("inverted"), "pairs")


def draw(*key: Column) -> Column:
    """A number from 0 to 2**32 - 1 by the MD5 of a key: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 8), 16, 10).cast("long")


#: Fixed: cumulative probabilities of a Poisson count of mean one.
POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)


#: Fixed by MD5: what is added in each of its 64 steps, and by how much it turns.
_ADDED = np.floor(np.abs(np.sin(np.arange(1.0, 65.0))) * 2**32).astype(np.uint32)
_TURNED = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
#: The greatest digests that do not yet pass POISSON's probabilities.
_LEAST = np.floor(np.array(POISSON) * 2**32).astype(np.uint32)
#: Rows whose digests are worked out at once, so that they stay in a core's cache.
_CHUNK = 1 << 14


def _digests(words: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of messages of one block; words: 16 of 32 bits each, a row a word."""
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, high = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 32:  # one of two words by the bits of a third
            by, one, other, g = (b, c, d, i) if i < 16 else (d, b, c, (5 * i + 1) % 16)
            np.bitwise_xor(one, other, out=f)
            f &= by
            f ^= other
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        f += words[g]
        f += _ADDED[i]
        turn = _TURNED[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=high)
        f >>= np.uint32(32 - turn)
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(0x67452301)
    return a.byteswap()


def drawn_weights(keys: list[str | None], draws: int, seed: int) -> np.ndarray:
    """The Poisson weights of rows with some keys, a row a key and a column a draw from 1 on: what
    draw() and POISSON say, for a batch at once. A digest takes one block of 64 bytes; longer
    keys are hashed one by one."""
    out = np.empty((len(keys), draws), np.uint8)
    for at in range(0, len(keys), _CHUNK):
        texts = [b"" if k is None else b":" + k.encode() for k in keys[at : at + _CHUNK]]
        sizes = np.array([len(t) for t in texts])
        width = max(1, min(55, sizes.max()))
        bytes_ = np.array([t[:width] for t in texts], f"S{width}").view(np.uint8).reshape(len(texts), width)
        number, block, before = np.arange(len(texts)), None, 0
        for n in range(1, draws + 1):
            prefix = f"{seed}:{n}".encode()
            if len(prefix) != before:
                before = len(prefix)
                fits = sizes + before <= 55
                block = np.zeros((len(texts), 64), np.uint8)
                block[:, before : before + width] = bytes_[:, : 64 - before]
                ends = np.where(fits, sizes + before, 0)
                block[number, ends] = 0x80
                block[:, 56:] = (8 * ends).astype("<u8").view(np.uint8).reshape(-1, 8)
            block[:, :before] = np.frombuffer(prefix, np.uint8)
            found = _digests(np.ascontiguousarray(block.view("<u4").T))
            for i in np.flatnonzero(~fits):
                found[i] = int.from_bytes(hashlib.md5(prefix + texts[i]).digest()[:4])
            out[at : at + len(texts), n - 1] = sum((found > c).view(np.uint8) for c in _LEAST)
    return out


def drawn_sums(rows: DataFrame, by: list[str], key: str, values: list[str], draws: int, seed: int) -> DataFrame:
    """by, draw, values: sums of the values by group under each draw's Poisson weights; draw 0 is the
    data as they are. A batch of rows is summed under all draws before anything leaves its task."""
    kinds = [f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w = drawn_weights(batch["_key"].to_pylist(), draws, seed)
            w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
            v = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in values])
            group = batch.select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(w), np.int64)
            _, first = np.unique(group, return_index=True)
            sums = np.concatenate([w[group == g].T @ v[group == g] for g in range(len(first))])
            keys = batch.select(by).take(pa.array(np.repeat(first, draws + 1)))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.tile(np.arange(draws + 1, dtype=np.int32), len(first))), *(pa.array(x) for x in sums.T)], [*by, "draw", *values])

    given = rows.select(*by, F.col(key).cast("string").alias("_key"), *(F.col(v).cast("double").alias(v) for v in values))
    parts = given.mapInArrow(run, ", ".join([*kinds, "draw int", *(f"`{v}` double" for v in values)]))
    return parts.groupBy(*by, "draw").agg(*(F.sum(v).alias(v) for v in values))


def bootstrap(df: DataFrame, by: list[str], key: str, value: str, draws: int, seed: int = 7) -> DataFrame:
    """by, low, high: bootstrap interval of the mean by Poisson weights. Each row, told by its
    key, has in each draw a weight of its own, so draws are sums that need no shuffle of rows."""
    u = draw(F.lit(str(seed)), F.col("draw").cast("string"), F.col(key).cast("string")) / F.lit(float(1 << 32))
    weight = sum((F.when(u > c, 1).otherwise(0) for c in POISSON), F.lit(0))
    rows = df.select(*by, key, value).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    means = rows.withColumn("_w", weight).groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def paired_bootstrap(blocks: DataFrame, rank: str, ratios: list[str], draws: int, seed: int = 7) -> DataFrame:
    """ratio, estimate, low, high: geometric means of paired ratios over blocks, and intervals
    from draws of as many blocks with replacement; a draw takes the same blocks for all ratios.
    rank numbers the blocks from 1 without gaps (ordered.in_order does, in many tasks). Picks are
    counted by draw and block before they meet the blocks."""
    named = blocks.select(F.col(rank).alias("_i"), *(F.log(r).alias(r) for r in ratios))
    n = blocks.agg(F.count("*").alias("_n"))
    # each block gives one pick to each draw, so picks are made where the blocks are
    picks = named.select(F.col("_i").alias("_k")).crossJoin(F.broadcast(n)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))  # one row
    picks = picks.select("draw", (draw(F.lit(str(seed)), F.col("draw").cast("string"), F.col("_k").cast("string")) % F.col("_n") + 1).alias("_i")).groupBy("draw", "_i").agg(F.count("*").alias("_c"))
    wide = lambda df: F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v")) for r in ratios)))
    means = picks.join(named, "_i").groupBy("draw").agg(*(F.exp(F.try_divide(F.sum(F.col("_c") * F.col(r)), F.sum(F.when(F.col(r).isNotNull(), F.col("_c"))))).alias(r) for r in ratios))
    ends = means.select(wide(means).alias("r")).select("r.*").groupBy("ratio").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
    whole = named.agg(*(F.exp(F.avg(r)).alias(r) for r in ratios))
    return whole.select(wide(whole).alias("r")).select("r.ratio", F.col("r.v").alias("estimate")).join(ends, "ratio")


def cluster_bootstrap(df: DataFrame, stratum: str, cluster: str, value: str, draws: int, seed: int = 7) -> DataFrame:
    """stratum, low, high: interval of the mean when whole clusters are drawn within each stratum.
    Only sums by cluster are drawn."""
    sums = df.groupBy(stratum, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    numbered = sums.withColumn("_i", F.row_number().over(W.partitionBy(stratum).orderBy(cluster)))
    sizes = numbered.groupBy(stratum).agg(F.max("_i").alias("_n"))
    picks = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    i = draw(F.lit(str(seed)), F.col(stratum).cast("string"), F.col("draw").cast("string"), F.col("_k").cast("string")) % F.col("_n") + 1
    means = picks.withColumn("_i", i).join(numbered, [stratum, "_i"]).groupBy(stratum, "draw").agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("m"))
    return means.groupBy(stratum).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


SCHEMES = ("within", "cluster", "equal_cluster", "calibrated_equal_cluster")


def slope_bootstrap(df: DataFrame, stratum: str, cluster: str, key: str, x: Column, arms: dict[str, Column], draws: int, seed: int = 7) -> DataFrame:
    """scheme, arm, estimate, low, high, lost: least-squares slopes of each arm's y on x and 95 %
    intervals under four ways of drawing; a draw takes the same rows for all arms.

    within draws rows in each stratum; cluster draws whole clusters; both are rescaled to the
    strata's sizes. equal_cluster gives each cluster the weight of one row, and
    calibrated_equal_cluster rescales that to the strata's sizes as well. Draws are Poisson weights
    by the hash of the row's key or of the cluster, so neither is numbered and nothing is gathered:
    rows are only ever summed, by stratum for within, and once by stratum and cluster for the
    others. A draw in which a rescaled stratum has no weight has no slope and counts as lost. Rows
    with a null in x or an arm are left out."""
    names = list(arms)
    given = df.select(F.col(stratum).alias("h"), F.col(cluster).alias("c"), F.col(key).cast("string").alias("k"), x.cast("double").alias("x"), *(y.cast("double").alias(f"y{i}") for i, y in enumerate(arms.values()))).dropna(subset=["x", *(f"y{i}" for i in range(len(names)))])
    # slopes do not change when all values are moved: from their means squares do not cancel
    middle = given.agg(*(F.avg(c).alias(f"m_{c}") for c in ("x", *(f"y{i}" for i in range(len(names))))))
    moved = given.crossJoin(F.broadcast(middle))  # one row
    u = F.col("x") - F.col("m_x")
    vector = {"s": F.lit(1.0), "sx": u, "sxx": u * u}
    for i in range(len(names)):
        v = F.col(f"y{i}") - F.col(f"m_y{i}")
        vector |= {f"sy{i}": v, f"sxy{i}": u * v}
    rows = moved.select("h", "c", "k", *(v.alias(n) for n, v in vector.items()))
    sizes = rows.groupBy("h").agg(F.count("*").cast("double").alias("target"))
    names_of = list(vector)
    within = drawn_sums(rows, ["h"], "k", names_of, draws, seed)
    cells = rows.groupBy("h", "c").agg(*(F.sum(n).alias(n) for n in names_of))
    whole = cells.groupBy("c").agg(F.sum("s").alias("_all"))
    cells = same_keys(cells, whole, ["c"])
    plain = drawn_sums(cells, ["h"], "c", names_of, draws, seed)
    equal = drawn_sums(cells.select("h", "c", *((F.col(n) / F.col("_all")).alias(n) for n in names_of)), ["h"], "c", names_of, draws, seed)
    parts = []
    for scheme, part, rescaled in zip(SCHEMES, (within, plain, equal, equal), (True, True, False, True), strict=True):
        scale = F.col("target") / F.when(F.col("s") > 0, F.col("s")) if rescaled else F.lit(1.0)
        met = same_keys(part, sizes, ["h"]).withColumn("_f", scale)
        parts.append(met.groupBy("draw").agg(F.bool_or(F.col("_f").isNull()).alias("_lost"), *(F.sum(F.col("_f") * F.col(n)).alias(n) for n in vector)).withColumn("scheme", F.lit(scheme)))
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    slope = lambda i: F.try_divide(F.col(f"sxy{i}") - F.col("sx") * F.col(f"sy{i}") / F.col("s"), F.col("sxx") - F.col("sx") ** 2 / F.col("s"))
    wide = F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), F.when(~F.col("_lost") & (F.col("s") > 0), slope(i)).alias("v")) for i, n in enumerate(names))))
    long = total.select("scheme", "draw", wide.alias("a")).select("scheme", "draw", "a.*")
    drawn_v = F.when(F.col("draw") > 0, F.col("v"))
    return long.groupBy("scheme", "arm").agg(F.max(F.when(F.col("draw") == 0, F.col("v"))).alias("estimate"), F.percentile(drawn_v, 0.025).alias("low"), F.percentile(drawn_v, 0.975).alias("high"), F.count_if((F.col("draw") > 0) & F.col("v").isNull()).alias("lost"))


def baseline_ratios(records: DataFrame, arm: str, key: list[str], value: str, baseline: str) -> DataFrame:
    """arm, n, median, least, greatest of value / the baseline's value of the same key, for each
    arm and key that the baseline has too. One record of each arm and key; a ratio to zero counts
    as none. The baseline's rows are joined as they are, so a hot key is split like any join's."""
    base = records.where(F.col(arm) == baseline).select(*key, F.col(value).alias("_base"))
    met = same_keys(records.select(*key, arm, value), base, key).withColumn("ratio", F.try_divide(value, "_base"))
    return describe(met, [arm], "ratio").select(arm, "n", "median", "least", "greatest")


def median_bootstrap(df: DataFrame, by: list[str], key: str, values: list[str], draws: int, seed: int = 7, least: int = 3) -> DataFrame:
    """by, value, low, high, draws: 95 % intervals of each value's median by group, from draws with
    Poisson weights; a row, told by its key, has the same weight for all values. Groups with fewer
    than `least` values have no interval (and no draws), nor do draws without any row count.

    Medians of draws lie near the median of the data: a sketch gives two values around it for each
    group and value. Rows outside are only summed, a batch under all draws at once; those between
    are grouped by draw. A draw whose median turns out to lie outside (rows that share few keys)
    is done again from all rows, repeated by their weights."""
    long = F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("_x")) for v in values)))
    rows = df.select(*by, F.col(key).cast("string").alias("_k"), long.alias("_l")).select(*by, "_k", "_l.*").where("_x is not null")
    group = [*by, "value"]
    reach = [0.5, *(4.0**-i for i in range(1, 6))]  # of a rank's share, to either side
    shares = [x for r in reach for x in (0.5 - r, 0.5 + r)]
    told = rows.groupBy(*group).agg(F.count("*").alias("_c"), F.percentile_approx("_x", shares, SKETCH).alias("_near")).where(F.col("_c") >= least)
    # the share's deviation is 1 / (2 sqrt(n)); ten of these, and what the sketch is off by
    level = sum((F.when(r >= 5 / F.sqrt("_c") + 2 / SKETCH, 1).otherwise(0) for r in reach[1:]), F.lit(0))
    ends = told.withColumn("_i", level).select(*group, F.get("_near", 2 * F.col("_i")).alias("_lo"), F.get("_near", 2 * F.col("_i") + 1).alias("_hi"))
    given = same_keys(rows, ends, group)
    kinds = {b: given.schema[b].dataType.simpleString() for b in group}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key_of = batch["_k"].dictionary_encode()
            w = drawn_weights(key_of.dictionary.to_pylist() + [None], draws, seed)[key_of.indices.fill_null(len(key_of.dictionary)).to_numpy()]
            x = batch["_x"].to_numpy()
            zone = np.where(x < batch["_lo"].to_numpy(), 0, np.where(x > batch["_hi"].to_numpy(), 2, 1))
            # rows outside become one row for their group and side, at the value next to the middle
            cell = pd.DataFrame({i: batch[b].to_pandas() for i, b in enumerate(group)}).groupby(list(range(len(group))), dropna=False, sort=False).ngroup().to_numpy() * 2 + zone // 2
            out = np.flatnonzero(zone != 1)
            out = out[np.lexsort((np.where(zone[out] == 0, -x[out], x[out]), cell[out]))]
            starts = np.flatnonzero(np.diff(cell[out], prepend=-1))
            first, sums = out[starts], np.add.reduceat(w[out].astype(np.int64), starts) if len(out) else np.zeros((0, draws), np.int64)
            inside = np.flatnonzero(zone == 1)
            at, n = np.concatenate([first, inside]), np.concatenate([sums, w[inside]])
            for m in (slice(k, k + _CHUNK) for k in range(0, len(at), _CHUNK)):
                i, d = np.nonzero(n[m])
                row = at[m][i]
                keys = batch.select(group).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array((d + 1).astype(np.int32)), pa.array(zone[row].astype(np.int32)), pa.array(x[row]), pa.array(n[m][i, d].astype(np.int64))], [*group, "draw", "_zone", "_x", "_n"])

    parts = given.mapInArrow(run, ", ".join([*(f"`{b}` {t}" for b, t in kinds.items()), "draw int, _zone int, _x double, _n long"]))
    each = [*group, "draw"]
    cells = parts.groupBy(*each, "_zone", F.when(F.col("_zone") == 1, F.col("_x")).alias("_in")).agg(F.sum("_n").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    w_all, w_upto = W.partitionBy(*each), W.partitionBy(*each).orderBy("_zone", "_in")
    upto = cells.withColumns({"_upto": F.sum("_c").over(w_upto), "_at": 0.5 * (F.sum("_c").over(w_all) - 1)})
    low, high = F.floor("_at"), F.ceil("_at")
    own = F.when(F.col("_zone") == 0, F.col("_high")).otherwise(F.col("_low"))
    pick = lambda rank: F.min_by(own, F.when(F.col("_upto") > rank, F.col("_upto")))
    # of those below only the last is known, of those above only the first
    far = ((F.col("_zone") == 0) & (low < F.col("_upto") - 1)) | ((F.col("_zone") == 2) & (high > F.col("_upto") - F.col("_c")))
    medians = upto.groupBy(*each).agg(((pick(low) + pick(high)) / 2).alias("q"), F.bool_or(far).alias("_far")).persist()
    missed = medians.where("_far").select(*each)
    found = medians.where("not _far").select(*each, "q")
    if not missed.isEmpty():
        u = draw(F.lit(str(seed)), F.col("draw").cast("string"), F.col("_k")) / F.lit(float(1 << 32))
        weight = sum((F.when(u > c, 1).otherwise(0) for c in POISSON), F.lit(0))
        copies = same_keys(rows, missed, group).withColumn("_w", weight).where("_w > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_w"))))
        found = found.unionByName(quantiles(copies, each, "_x", [0.5]).select(*each, "q"))
    return found.groupBy(*group).agg(F.percentile("q", 0.025).alias("low"), F.percentile("q", 0.975).alias("high"), F.count("*").alias("draws"))


def case_summaries(pairs: DataFrame, by: list[str], key: str, ratios: dict[str, tuple[str, str]], deltas: dict[str, tuple[str, str]], ranges: list[str], draws: int, seed: int = 7) -> DataFrame:
    """One wide row for each group of paired records; pairs has one row for each pair, told by key.

    ratios: name to the columns (ours, theirs) of a speedup theirs / ours: median of both columns
    and median, q1, q3, min, max, ci95_low and ci95_high of the ratio. deltas: name to (ours,
    theirs): median and max of both, median, min and max of theirs - ours. ranges: min and max of a
    column. A ratio of values that are not finite and above zero is null and leaves the summary;
    invalid counts such pairs."""
    good = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c)
    fine = {n: F.when(good(a) & good(b), F.col(b) / F.col(a)) for n, (a, b) in ratios.items()}
    named = {f"{n}_ratio": r for n, r in fine.items()} | {f"{n}_delta": F.col(b) - F.col(a) for n, (a, b) in deltas.items()}
    rows = pairs.withColumns(named)
    columns = list(dict.fromkeys([c for two in (*ratios.values(), *deltas.values()) for c in two] + list(named)))
    # one exact quantile of all columns: each is a group of its own
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("value"), F.col(c).cast("double").alias("_x")) for c in columns)))
    q = quantiles(rows.select(*by, long.alias("_l")).select(*by, "_l.*"), [*by, "value"], "_x", [0.25, 0.5, 0.75])
    pick = lambda c, s, name: F.max(F.when((F.col("value") == c) & (F.col("share") == s), F.col("q"))).alias(name)
    wide = []
    for n, (a, b) in ratios.items():
        wide += [pick(a, 0.5, f"{a}_median"), pick(b, 0.5, f"{b}_median"), pick(f"{n}_ratio", 0.5, f"{n}_median"), pick(f"{n}_ratio", 0.25, f"{n}_q1"), pick(f"{n}_ratio", 0.75, f"{n}_q3")]
    for n, (a, b) in deltas.items():
        wide += [pick(a, 0.5, f"{a}_median"), pick(b, 0.5, f"{b}_median"), pick(f"{n}_delta", 0.5, f"{n}_median")]
    ends = lambda c, n: [F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max")]
    told = [F.count("*").alias("pairs")]
    for n, (a, b) in ratios.items():
        told += [*ends(f"{n}_ratio", n), F.count_if(F.col(f"{n}_ratio").isNull()).alias(f"{n}_invalid")]
    for n, (a, b) in deltas.items():
        told += [F.max(a).alias(f"{a}_max"), F.max(b).alias(f"{b}_max"), *ends(f"{n}_delta", n)]
    for c in ranges:
        told += ends(c, c)
    ci = median_bootstrap(rows, by, key, [f"{n}_ratio" for n in ratios], draws, seed)
    bound = lambda n, end: F.max(F.when(F.col("value") == f"{n}_ratio", F.col(end))).alias(f"{n}_ci95_{end}")
    intervals = ci.groupBy(*by).agg(*(bound(n, end) for n in ratios for end in ("low", "high")))
    out = same_keys(rows.groupBy(*by).agg(*told), q.groupBy(*by).agg(*wide), by, "left")
    return same_keys(out, intervals, by, "left").withColumns({"bootstrap_replicates": F.lit(draws), "bootstrap_seed": F.lit(seed)})
