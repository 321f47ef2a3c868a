"""Quality rules: base limits, then robust multivariate outliers for each language and source.

Each document has a vector of five transformed statistics. For each (language, source), whatever
its size, the minimum covariance determinant estimate of centre and scatter is found by
concentration steps: take the share H of rows with the smallest Mahalanobis distances, estimate
again, repeat. Two starts (all rows; coordinate-wise medians and quartile ranges) make two steps
each; the one with the smaller determinant goes on until no group's determinant falls any more.
A document whose distance from its own group's estimate exceeds CUTOFF is rejected. DataFrame
functions only.

The estimate is regularised, as few rows determine no scatter: each group's subset is joined by
TARGET = P + 1 fixed rows' worth of moments, the least number that can span a scatter of P
dimensions. They have the medians and quartile ranges of the group's language. A group of eight
rows so leans on its language for half, one of a thousand for less than a hundredth; there is no
size at which the rule changes. The fixed rows are in every subset, so steps still cannot raise
the determinant.

A step makes one pass: rows are summed by (group, start, distance bucket), which Spark aggregates
before the shuffle; the subset is the buckets up to the share H, with the last one in part, so
that its weight is H exactly. No group is ever gathered: estimates are counted and broadcast up to
common.BROADCAST_BYTES, and beyond that joined by (group, salt). Statistics are fixed-point
integers, so sums do not depend on the order of rows and are exact to 10**12 rows a group.

Defined cases: null text has no words and fails the base rules, as does empty text; null and
empty language or source are one group each; a group of one or of equal rows is at distance
zero-ish from its language's middle only; ties and repeated rows each count; rows that share a
doc_id, or have none, are judged each by its own text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WINDOW = 5
#: Share of a group that the estimate rests on, and the chi-square quantile of five degrees there.
H, H_CHI2 = 0.75, 6.6257
#: Chi-square of five degrees is above this for one row in 10,000.
CUTOFF = 25.74
#: A step that lowers the log determinant by less than LEAST_GAIN ends a group's search.
STEPS, LEAST_GAIN, SCALE, SALTS = 20, 1e-3, 200, 16
#: Statistics, and the least standard deviation of each that is taken as meant. Each statistic
#: alone can pass the cutoff: the greatest values are ln 11 of dup_lines and ln 5 of repeats (the
#: base rule ends at a fifth of the words); the others have no such bound.
FEATURES = ("word_length", "symbols", "capitals", "dup_lines", "repeats")
FLOORS = (0.15, 0.35, 0.35, 0.45, 0.3)
P = len(FEATURES)
TARGET = P + 1


def _mark() -> Column:
    """Tells rows that share a doc_id, or have none, apart."""
    return F.xxhash64("text", "lang", "source")


def statistics(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang, source and _mark (a hash of the row) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_capitals, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = lambda drop: F.length(F.translate(text, drop, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(common.BLANKS))) > 0)
    one = docs.select(
        "doc_id", "lang", "source", _mark().alias("_mark"),
        common.words_of(F.col("text")).alias("_w"),
        length(common.BLANKS).cast("long").alias("word_chars"),
        (F.length(text) - length("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.length(text) - length("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        lines.alias("_lines"),
    )
    grams = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW))))
    two = one.select(
        "doc_id", "lang", "source", "_mark", "word_chars", "n_symbols", "n_capitals",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= WINDOW, grams).otherwise(F.array().cast("array<long>")).alias("_grams"),
    )
    pairs = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = two.withColumn("_pairs", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), pairs)).drop("_grams")
    same = lambda x, at: F.coalesce(F.get("_pairs", at)["h"] == x["h"], F.lit(False))
    twice = F.filter("_pairs", lambda x, i: same(x, i - 1) | same(x, i + 1))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
    covered = F.aggregate(at, begin, lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum")), lambda a: a["sum"])
    return three.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_pairs")


def _vector() -> list[Column]:
    share = lambda a, b, times: F.log1p(times * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    raw = [
        F.log(F.greatest(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(0.1))),
        share("n_symbols", "word_chars", 100),
        share("n_capitals", "word_chars", 100),
        share("n_dup_lines", "n_lines", 10),
        share("n_repeat_words", "n_words", 20),
    ]
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _row_moments() -> list[Column]:
    return [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]


MODEL = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]
MIDDLE = [f"t{i}" for i in range(P)] + [f"u{i}" for i in range(P)]


def _few(table: DataFrame) -> bool:
    """Whether twice the rows of a written table can be broadcast."""
    return table.count() * 16 * len(table.columns) <= common.BROADCAST_BYTES


def estimate(sums: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """Centre m0.., lower factor l00.. of the scatter, and its log determinant, from a subset's
    moments (n, s0.., s00..) and the fixed rows of its group (targets: key, t0.., u0..)."""
    n = F.col("n") + TARGET
    out = sums.join(F.broadcast(targets) if few else targets, "key")
    mean = {i: (F.col(f"s{i}") / SCALE + TARGET * F.col(f"t{i}")) / n for i in range(P)}
    own = lambda i, j: F.col(f"t{i}") * F.col(f"t{j}") + (F.col(f"u{i}") ** 2 if i == j else 0)
    square = {(i, j): (F.col(f"s{i}{j}") / SCALE**2 + TARGET * own(i, j)) / n for i in range(P) for j in range(i + 1)}
    out = out.select("*", *(m.alias(f"m{i}") for i, m in mean.items()), *(c.alias(f"c{i}{j}") for (i, j), c in square.items()))
    for j in range(P):
        below = sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        var = F.greatest(F.col(f"c{j}{j}") - F.col(f"m{j}") ** 2, F.lit(FLOORS[j] ** 2))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(var - below, F.lit(FLOORS[j] ** 2 / 4))))
        for i in range(j + 1, P):
            below = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") - below) / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))).select("key", "start", *MODEL, "logdet")


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        y.append((F.col(f"x{i}") / SCALE - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


BUCKETS = 40.0


def _near(rows: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """rows with the estimates of their groups and the distance d2. Where the estimates are too
    many to broadcast, a hot group's rows are dealt by salt over several tasks."""
    if few:
        near = rows.join(F.broadcast(model), "key")
    else:
        salted = model.withColumn("_salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
        near = rows.withColumn("_salt", F.pmod(F.xxhash64(*(f"x{i}" for i in range(P)), F.rand(7)), F.lit(SALTS)).cast("int")).join(salted, ["key", "_salt"])
    return near.withColumn("d2", distance())


def subset(rows: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """For each (key, start) of model: moments of the share H of its group that is nearest (n,
    s0.., s00..), and the distance d2_h at that share."""
    by = _near(rows, model, few).groupBy("key", "start", F.floor(F.log1p("d2") * BUCKETS).alias("bucket")).agg(*_row_moments())
    w = W.partitionBy("key", "start")
    run = by.withColumn("_before", F.sum("n").over(w.orderBy("bucket")) - F.col("n")).withColumn("_all", F.sum("n").over(w))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (H * F.col("_all") - F.col("_before")) / F.col("n")))
    inner = run.withColumn("_part", part).where("_part > 0")
    names = ["n"] + [f"s{i}" for i in range(P)] + [f"s{i}{j}" for i in range(P) for j in range(i + 1)]
    return inner.groupBy("key", "start").agg(*(F.sum(F.col("_part") * F.col(c)).alias(c) for c in names), F.expm1(F.max(F.col("bucket") + F.col("_part")) / BUCKETS).alias("d2_h"))


def middles(rows: DataFrame) -> DataFrame:
    """key, coordinate-wise medians t0.. and standard deviations u0.. from quartile ranges."""
    wide = 4
    long = rows.select("key", F.posexplode(F.array(*(F.col(f"x{i}") for i in range(P)))).alias("f", "x"))
    by = long.groupBy("key", "f", F.floor(F.col("x") / wide).alias("b")).agg(F.count("*").alias("n"))
    w = W.partitionBy("key", "f")
    run = by.withColumn("_upto", F.sum("n").over(w.orderBy("b"))).withColumn("_all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), (F.col("b") + 0.5) * wide / SCALE))
    mid = run.groupBy("key", "f").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    pick = lambda c, i: F.max(F.when(F.col("f") == i, F.col(c)))
    return mid.groupBy("key").agg(*(pick("m", i).alias(f"t{i}") for i in range(P)), *(F.greatest(pick("s", i), F.lit(FLOORS[i])).alias(f"u{i}") for i in range(P)))


def _as_model(middle: DataFrame, start: int) -> DataFrame:
    cells = [F.col(f"t{i}").alias(f"m{i}") for i in range(P)] + [(F.col(f"u{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)]
    return middle.select("key", F.lit(start).alias("start"), *cells)


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of every group of rows (key, lang, x0..): key, MODEL, logdet, d2_h."""
    groups = rows.select("key", "lang").distinct()
    by_lang = common.written(middles(rows.select(F.col("lang").alias("key"), *(f"x{i}" for i in range(P)))), "languages")
    targets = common.written(common.keyed(groups, by_lang.withColumnRenamed("key", "lang"), "lang", "inner", 120).select("key", *MIDDLE), "targets")
    few = _few(targets)
    every = rows.groupBy("key").agg(*_row_moments()).withColumn("start", F.lit(0))
    moving = common.written(estimate(every, targets, few).drop("logdet").unionByName(_as_model(middles(rows), 1)), "starts")
    best = None
    for step in range(1, STEPS + 1):
        new = estimate(subset(rows, moving, few), targets, few).withColumn("step", F.lit(step))
        both = new if best is None else new.unionByName(best)
        reached = F.struct(F.col("logdet") + F.when(F.col("step") == step, LEAST_GAIN).otherwise(0.0), "step")
        one = both.groupBy("key", "start").agg(F.min_by(F.struct("step", "logdet", *MODEL), reached).alias("b")).select("key", "start", "b.*")
        if step == 2:  # the better start goes on
            one = one.groupBy("key").agg(F.min_by(F.struct("start", "step", "logdet", *MODEL), F.struct(F.round("logdet", 6), "start")).alias("b")).select("key", "b.*")
        best = common.written(one, "step")
        moving = best.where(F.col("step") == step).select("key", "start", *MODEL)
        if moving.isEmpty():
            break
    reach = subset(rows, best.select("key", "start", *MODEL), few).select("key", "d2_h")
    return common.written(best.join(reach, "key").select("key", *MODEL, "logdet", "d2_h"), "estimates")


COUNTED = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the statistics, base_failed, distance, kept."""
    return _judged(docs).drop("_mark")


def _judged(docs: DataFrame) -> DataFrame:
    stats = statistics(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    rows = common.written(stats.select(*COUNTED, "_mark", failed.alias("base_failed"), *_vector(), F.to_json(F.array(lang, source)).alias("key"), lang.alias("lang")), "statistics")
    own = estimates(rows.where("not base_failed").select("key", "lang", *(f"x{i}" for i in range(P))))
    scaled = distance() * H_CHI2 / F.greatest(F.col("d2_h"), F.lit(H_CHI2))
    judged = common.keyed(rows, own, "key", "left", 250).withColumn("distance", scaled)
    return judged.select(*COUNTED, "_mark", "base_failed", "distance", (~F.col("base_failed") & ~F.coalesce(F.col("distance") > CUTOFF, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    bad = _judged(docs).where("not kept").select(F.col("doc_id").alias("_bad"), F.col("_mark").alias("_own")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", _mark().alias("_mark"))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & (F.col("_mark") == F.col("_own")), "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))
