"""Co-training of two logistic classifiers, one on text content and one on page metadata.

The text view is which tokens a text has of those that tell good and bad labelled rows apart (by a
chi-square of TELLING or more), among words and binned shares of symbols, capitals, repeated words
and repeated lines; the metadata view is language, source, their pair and the binned length, hashed
to META_BINS. A document is bad if its quality is 0 or
it is toxic. Rows with a label start both classifiers. In each round each classifier scores all
rows without a label, and the ones that it is sure of (by its calibrated probability) go with
its verdict to the other one, which is fitted again. Views are calibrated on a fold of the
labelled rows that is never fitted on, and their calibrated log odds are added to score all
documents.

The labelled rows that are fitted on, and whose tokens make the text view, are a sample of about
FIT, chosen by a hash of doc_id from all labels. Everything else covers all rows: every document's
vectors are written once, every row without a label is in the pool of each round, and all that a
view is sure of is fitted on, in tasks of FIT_ROWS rows. Words are looked at one
by one with an absolute-value penalty, so a single telling word counts as much in a long text as
in a short one, and words that tell nothing count nothing.

Defined cases: null text is empty; null language or source is the empty one; a label row counts
as bad if its toxic is over 0 or its quality is 0 or less; without a quality it counts only if
toxic; a document with several labels is bad if any says so; label rows without a doc_id are left
out; repeated rows are scored each; without fitted labels of both kinds the score is 0.5; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TELLING, LEAST, META_BINS = 7.88, 3, 1 << 12
FIT, FIT_ROWS = 1 << 14, 1 << 13
ROUNDS, SURE, FOLDS, STEPS = 2, 0.98, 5, 40
PENALTY = {"text": 2e-4, "meta": 2e-3}
VIEWS = ("text", "meta")


def _bin(name: str, x: Column, most: int) -> Column:
    """A token that no word can be: name and x cut to whole numbers up to most."""
    return F.concat(F.lit(f"\t{name} "), F.least(F.floor(x), F.lit(most)).cast("string"))


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, with what each view looks at: _text, _meta (arrays of distinct tokens)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    count = lambda drop: F.length(F.col("_t")) - F.length(F.translate(F.col("_t"), drop, ""))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(common.BLANKS))) > 0)
    one = docs.select(*keep, text.alias("_t"), lang.alias("_l"), source.alias("_s"), common.words_of(F.lower(text)).alias("_w"))
    two = one.select("*", lines.alias("_lines"), F.array_distinct("_w").alias("_d"), F.greatest(F.length("_t"), F.lit(1)).alias("_n"))
    size = F.floor(F.log2(F.size("_w") + F.lit(1)))
    share = lambda part, whole: 20 * (1 - F.size(part) / F.greatest(F.size(whole), F.lit(1)))
    shapes = [
        _bin("symbols", F.log2(1 + 400 * count("#*$%&|<>!") / F.col("_n")), 10), _bin("capitals", F.log2(1 + 400 * count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / F.col("_n")), 10),
        _bin("letters", F.col("_n") / F.greatest(F.size("_w"), F.lit(1)), 20), _bin("lines", share(F.array_distinct("_lines"), "_lines"), 20),
        F.concat(_bin("repeats", share("_d", "_w"), 20), F.lit(" "), size.cast("string")), _bin("words", F.size("_w"), 12),
    ]
    meta = [F.concat(F.lit("l "), "_l"), F.concat(F.lit("s "), "_s"), F.to_json(F.array("_l", "_s")), F.concat(F.lit("n "), F.floor(F.log2("_n")).cast("string"))]
    return two.select(*keep, F.concat("_d", F.array(*shapes)).alias("_text"), F.array(*meta).alias("_meta"))


def vocabulary(seeds: DataFrame) -> list[str]:
    """The tokens that tell y, best first: by chi-square over rows with and without them. seeds
    has about FIT rows, so their tokens are bounded at any size of the input."""
    n, good = seeds.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    seen = seeds.select("y", F.explode("_text").alias("t")).groupBy("t").agg(F.count("*").alias("c"), F.sum("y").alias("g")).where(F.col("c") >= LEAST)
    expected = F.col("c") * (good / max(1, n))
    score = (F.col("g") - expected) ** 2 / F.greatest(expected * (1 - good / max(1, n)) * (1 - F.col("c") / (n + 1)), F.lit(1e-9))
    return [r.t for r in seen.withColumn("s", score).where(F.col("s") >= TELLING).orderBy(F.desc("s"), "t").select("t").collect()]


def features(rows: DataFrame, words: list[str], *keep: str) -> DataFrame:
    """keep, with the vectors of both views of rows with tokens: text, meta."""
    text = CountVectorizerModel.from_vocabulary(words or ["\t"], inputCol="_text", outputCol="text", binary=True)
    return HashingTF(numFeatures=META_BINS, binary=True, inputCol="_meta", outputCol="meta").transform(text.transform(rows)).select(*keep, *VIEWS)


def verdicts(labels: DataFrame) -> DataFrame:
    """doc_id, y: 1 good, 0 bad."""
    y = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 0).when(F.col("quality") > 0, 1)
    return labels.select("doc_id", y.alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))


def _some(df: DataFrame, of: int, about: int, salt: int) -> DataFrame:
    """About that many of df's rows (of: how many it has), by a hash of doc_id."""
    grain = 1 << 30
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(grain)) < int(grain * min(1.0, about / max(1, of))))


def _fitted(rows: DataFrame, view: str) -> LogisticRegressionModel | None:
    """A model of the view's vectors, or None without rows of both kinds."""
    kinds = [r["count"] for r in rows.groupBy("y").count().collect()]  # 0 and 1
    if len(kinds) < 2:
        return None
    fit = LogisticRegression(featuresCol=view, labelCol="y", maxIter=40, regParam=PENALTY[view], elasticNetParam=1.0, standardization=False, tol=1e-4)
    return fit.fit(rows.select(view, F.col("y").cast("double").alias("y")).coalesce(max(4, sum(kinds) // FIT_ROWS)))


def _odds(rows: DataFrame, models: dict) -> DataFrame:
    """rows with the log odds of good by each view, as odds_text and odds_meta."""
    for view in VIEWS:
        if models[view] is None:
            rows = rows.withColumn(f"odds_{view}", F.lit(0.0))
            continue
        model = models[view].copy()
        model.setFeaturesCol(view).setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
        rows = model.transform(rows).withColumn(f"odds_{view}", F.get(vector_to_array("_raw"), F.lit(1))).drop("_raw")
    return rows


def _calibrated(held: DataFrame, view: str) -> tuple[float, float]:
    """Slope and intercept for a view's log odds, by logistic regression on binned odds of rows
    that it was not fitted on (at most 401 bins reach the driver)."""
    z = F.round(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col(f"odds_{view}"))) * 2)
    bins = held.groupBy(z.alias("z")).agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    z, good, n = (np.array([float(r[k]) for r in bins]) for k in ("z", "good", "n"))
    w, c = 1.0, 0.0
    if len(z) and 0 < good.sum() < n.sum():
        z = z / 2
        for _ in range(STEPS):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(w * z + c, -30, 30)))
            g, h = good - n * p, n * p * (1 - p) + 1e-9
            m = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
            d = np.linalg.solve(m, np.array([(g * z).sum() - 1e-2 * (w - 1), g.sum()]))
            w, c = max(0.0, w + float(np.clip(d[0], -1, 1))), c + float(np.clip(d[1], -5, 5))
    return w, c


def _sure(scored: DataFrame, view: str, fit: tuple[float, float]) -> DataFrame:
    """The rows that the view is sure of, with its verdict y."""
    p = 1 / (1 + F.exp(-(F.col(f"odds_{view}") * fit[0] + fit[1])))
    return scored.withColumn("y", F.when(p >= SURE, 1).when(p <= 1 - SURE, 0)).where("y is not null")


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_score, meta_score, score (probability of good), kept."""
    docs = docs.select("doc_id", "text", "lang", "source")
    y = common.written(verdicts(labels), "verdicts")
    seeds = common.written(_some(y, y.count(), FIT, 1), "seeds")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")
    told = common.written(tokens(docs.join(F.broadcast(seeds), "doc_id"), "doc_id", "y").select("y", fold, "_text", "_meta"), "tokens")
    words = vocabulary(told.where("fold != 0"))
    seeds = common.written(features(told, words, "y", "fold"), "fit")
    every = common.written(features(tokens(docs, "doc_id"), words, "doc_id"), "vectors")
    pool = common.keyed(every, y.select("doc_id"), "doc_id", "left_anti")

    own, held = seeds.where("fold != 0").select("y", *VIEWS), seeds.where("fold = 0")
    models = {view: _fitted(own, view) for view in VIEWS}
    fits = {view: _calibrated(_odds(held, models), view) for view in VIEWS}
    for _ in range(rounds):
        scored = _odds(pool, models)
        told = {view: _sure(scored, other, fits[other]).select("y", view) for view, other in zip(VIEWS, reversed(VIEWS), strict=True) if models[other] is not None}
        models = {view: _fitted(own.select("y", view).unionByName(told[view]) if view in told else own, view) for view in VIEWS}
        fits = {view: _calibrated(_odds(held, models), view) for view in VIEWS}
    good, n = own.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    both = all(models.values())
    prior = math.log((good + 1) / (n - good + 1)) if both else 0.0

    scored = _odds(every, models)
    a, b = (F.col(f"odds_{v}") * fits[v][0] + fits[v][1] for v in VIEWS)
    p = lambda z: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    score = p(a + b - F.lit(prior)) if both else F.lit(0.5)
    return scored.select("doc_id", p(a).alias("text_score"), p(b).alias("meta_score"), score.alias("score"), (score >= 0.5).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
