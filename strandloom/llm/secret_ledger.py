"""Secret scans over content-addressed blobs, with a ledger of what was scanned.

A version of a file is addressed by the SHA-256 of its text. The ledger is two Parquet folders:
the (blob, rule, rule version) pairs that were scanned, and the findings (where they are, never
what they say). A scan takes all versions, finds the blobs for which some current rule version
is not in the ledger, reads one copy of each, applies only the missing rules, appends, and joins
findings back to every path. DataFrame functions only.

Spans are code points, end exclusive, leftmost and non-overlapping for each rule. Their places are
running sums of the lengths of matches and of what lies between, taken block by block, so a text
of many findings takes time in proportion. Findings are appended before the pairs that vouch for
them: a scan that dies between leaves findings that the next one finds again, and reading takes
each once; so it does when two scans append at once.

Defined cases: null text is the empty text and has no findings; copies, repeated rows and paths
share one ledger row per rule; a null path is a path like any other, and versions that share a
path are each their own; an empty table gives an empty result; columns other than path and text
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """kind: the name in results; order: place among kinds at the same start; gate: a cheap
    pattern that every text with a match has; group, least: the group that needs so many characters."""

    kind: str
    version: int
    order: int
    pattern: str
    gate: str
    group: int = 0
    least: int = 1


#: Fixed patterns of the base kinds. A run that is too short holds no longer run inside, so
#: the least length of access and hex stands in the pattern; that of assign does not, because
#: a failing match hides what it covers.
BASE = (
    Rule("assign", 1, 1, r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 1, 12),
    Rule("access", 1, 2, r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, 3, r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
)
#: What the method adds.
MORE = (
    # to the END line, or where there is none over the lines of base64 that follow
    Rule("private_key", 2, 4, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?s:.{0,20000}?)-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:\s{1,3}[A-Za-z0-9+/=]{16,76}+(?![A-Za-z0-9+/=])){0,400}+)", r"PRIVATE KEY-----"),
    Rule("jwt", 1, 5, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("repo_token", 1, 6, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE + MORE
PAIR = "blob binary, kind string, version int"
FINDING = f"{PAIR}, ord int, start long, stop long"
SPAN = "array<struct<start:long,ord:int,kind:string,stop:long>>"


def _found(text: Column, rule: Rule) -> Column:
    """Array of (start, stop) of the rule in text, in order."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    sizes = F.transform(whole, lambda x: F.length(x).cast("long"))
    steps = F.zip_with(F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long")), sizes, lambda gap, n: gap + F.coalesce(n, F.lit(0)))
    cells = F.arrays_zip(common.sums_before(steps).alias("from"), steps.alias("step"), sizes.alias("n"), part.alias("part"))
    ok = F.filter(cells, lambda x: F.coalesce(F.length(x["part"]) >= rule.least, F.lit(False)))
    spans = F.transform(ok, lambda x: F.struct((x["from"] + x["step"] - x["n"]).alias("start"), (x["from"] + x["step"]).alias("stop")))
    return F.when(text.rlike(rule.gate), spans).otherwise(F.array().cast("array<struct<start:long,stop:long>>"))


def _row(rule: Rule):
    """Of a span the ledger's fields."""
    return lambda s: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.order).alias("ord"), s["start"].alias("start"), s["stop"].alias("stop"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder; none is an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger (a folder that need not exist) up to date with versions (path, text) and
    return one row per version: path, blob, spans (SPAN, of all rules, by start and kind's order)."""
    spark = versions.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    addressed = versions.select("path", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    named = common.written(addressed.select("path", "blob"), "versions")
    current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    bit = F.coalesce(*(F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(1 << i)) for i, r in enumerate(rules)), F.lit(0))
    done = _read(spark, f"{ledger}/scanned", PAIR).groupBy("blob").agg(F.bit_or(bit).alias("done"))
    every = (1 << len(rules)) - 1
    missing = F.lit(every) - F.coalesce("done", F.lit(0))
    blobs = named.groupBy("blob").agg(F.min("path").alias("path"))
    unseen = blobs.join(done, "blob", "left").select("blob", "path", missing.alias("missing")).where("missing > 0")
    unseen = common.written(unseen, "unseen")
    same = unseen.select(F.col("blob").alias("_blob"), F.col("path").alias("_path"), "missing")
    few = unseen.count() * 80 <= common.BROADCAST_BYTES
    todo = addressed.join(F.broadcast(same) if few else same, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")))
    if _repeats(named):  # rows that repeat path and text: one of them
        todo = todo.dropDuplicates(["blob"])
    hits = []
    for i, r in enumerate(rules):
        need = F.col("missing").bitwiseAND(1 << i) > 0
        hits.append(F.transform(F.when(need, _found(F.col("text"), r)).otherwise(F.array().cast("array<struct<start:long,stop:long>>")), _row(r)))
    todo.select("blob", F.explode(F.concat(*hits)).alias("f")).select("blob", "f.*").write.mode("append").parquet(f"{ledger}/findings")
    pairs = F.filter(F.array(*(F.when(F.col("missing").bitwiseAND(1 << i) > 0, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))) for i, r in enumerate(rules))), lambda p: p.isNotNull())
    unseen.select("blob", F.explode(pairs).alias("p")).select("blob", "p.*").write.mode("append").parquet(f"{ledger}/scanned")

    found = _read(spark, f"{ledger}/findings", FINDING).join(F.broadcast(current), ["kind", "version"])
    found = common.written(found.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "ord", "kind", "stop"))).alias("spans")), "found")
    return common.keyed(named, found, "blob", "left", 400).select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _repeats(named: DataFrame) -> bool:
    """Whether a path and blob occur together more than once."""
    return not named.groupBy("path", "blob").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def joined(spans: Column) -> Column:
    """kind:start:end of spans, by start and kind's order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans over one ledger: the base rules first; then all, when only the added rules are
    unseen."""
    versions, ledger = common.documents(spark, sf_dir, "doc_id", "text").withColumnRenamed("doc_id", "path"), common.scratch(spark, "ledger")
    scan(versions, ledger, BASE)
    found = scan(versions, ledger)
    base = F.filter("spans", lambda s: s["ord"] <= len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every finding's text replaced by [kind] (overlapping ones by the first one's);
    other columns stay. n_chars, where there is one, counts the new text."""
    spark = docs.sparkSession
    found = scan(docs.select(F.col("doc_id").alias("path"), "text"), common.scratch(spark, "ledger"), rules)
    # one window for each blob with findings: where spans run into one another, they are one
    hits = found.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    each = hits.select("blob", F.explode("spans").alias("s")).select("blob", "s.*")
    w = W.partitionBy("blob").orderBy("start", "ord", "stop")
    fresh = F.coalesce(F.col("start") >= F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    runs = each.withColumn("fresh", fresh).withColumn("run", F.count_if("fresh").over(w))
    one = runs.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(F.when(F.col("fresh"), F.col("kind"))).alias("kind"))
    apart = common.written(one.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("_spans")), "redacted")

    text, spans = F.col("text"), F.col("_spans")
    named = docs.withColumn("_blob", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    out = common.keyed(named, apart.withColumnRenamed("blob", "_blob"), "_blob", "left", 400)
    rest = F.struct((F.element_at(spans, -1)["stop"]).alias("start"), F.length(text).cast("long").alias("stop"))
    stops = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    between = F.concat(F.zip_with(F.slice(stops, 1, F.size(spans)), spans, lambda a, s: F.struct(a.alias("start"), s["start"].alias("stop"))), F.array(rest))
    marks = F.concat(F.transform(spans, lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))), F.array(F.lit("")))
    clean = F.array_join(F.zip_with(common.cut_out(text, between), marks, lambda t, m: F.concat(t, m)), "")
    out = out.withColumn("_clean", F.when(spans.isNull(), text).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(spans.isNull(), F.col("n_chars")).otherwise(F.length("_clean").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col("_clean").alias("text") if c == "text" else c for c in docs.columns))
