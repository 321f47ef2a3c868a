"""Source divergence audit: how each (language, source) group's terms differ from the language's
other sources, by DuckDB over shards of terms.

Tasks count the terms of the rows they read, so that a term crosses the network once per task and
source, however often it occurs. Rows are dealt into shards by the hash of language and term.
In each shard DuckDB sums counts and keeps terms found in enough documents of the language; Spark
adds up the groups' totals from that. A second pass over the kept terms, dealt likewise, has
DuckDB work out in each shard the partial sums of every pair of sources and each group's leading
terms; Spark merges sums and rankings.

A pair's sum runs over all kept terms, but a source lacks most: with z the value of a count of
0, f(a, b) = f(z, z) + [f(a, z) - f(z, z)] + [f(z, b) - f(z, z)] + rest, where the rest is not 0 only
for terms that both have. So shards handle pairs of sources of one term (at most as many as
the result has pairs), and the brackets come from how many terms of a group have which count.

A shard has about ROWS rows at any size of the corpus, no term's rows exceed sources times tasks
before the first pass and sources after it, and DuckDB may use MEMORY and spills beyond. Groups
are broadcast up to common.BROADCAST_BYTES and joined by shuffle beyond.

Defined cases: null text, language and source are ''; rows that repeat a doc_id are documents of
their own; a group without terms is compared as well; a language without kept terms has the value
0 for each pair of its sources; a language with one source has no pairs; equal values are ordered
by item; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Fixed: the least documents of a kept term, the unit of shares, the last rank of terms.
LEAST_DOCS, UNIT, LAST_RANK = 3, 1_000_000_000, 200
#: Rows of a shard, entries a task counts before it hands them on, DuckDB's memory, tasks in which
#: a group's leading terms are ranked before they meet.
ROWS, ENTRIES, MEMORY, HEAPS = 1 << 18, 1 << 18, "256MB", 16
#: A-Z lower-cased; other bytes that no term holds become blanks. Bytes above 127 belong to terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

_COUNTED = "lang string, source string, term string, n long, docs long"
_KEPT = "lang string, source string, term string, n long, first int"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return (text or "").encode().translate(_TABLE).split()


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: counts of what a task has read, several rows a term at most;
    the term '' stands for the group itself."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        found: dict = defaultdict(lambda: (Counter(), Counter()))

        def out():
            for (lang, source), (n, docs) in found.items():
                keys = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([source] * len(keys)), pa.array([k.decode() for k in keys]), pa.array(n.values(), pa.int64()), pa.array([docs[k] for k in keys], pa.int64())], schema=schema)
            found.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = found[lang or "", source or ""]
                before = len(n)
                own = terms(text)
                n[b""] = docs[b""] = 0
                n.update(own)
                docs.update(set(own))
                size += len(n) - before
                if size > ENTRIES:
                    yield from out()
                    size = 0
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, _COUNTED)


def _sharded(rows: DataFrame, shards: int, schema: str, *statements: str) -> DataFrame:
    """What DuckDB makes of each shard of rows (a table named shard) by language and term."""

    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def rest():
            yield first
            yield from batches

        limits = {"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False}
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config=limits | {"temp_directory": spill}) as con:
            con.register("rows_in", pa.RecordBatchReader.from_batches(first.schema, rest()))
            con.execute("CREATE TABLE shard AS FROM rows_in")
            for statement in statements[:-1]:
                con.execute(statement)
            yield from con.sql(statements[-1]).to_arrow_reader(1 << 16)

    return rows.repartition(shards, "lang", "term").mapInArrow(run, schema)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A written table of lang, source, term, n of terms in at least least_docs documents of the
    language; first is 1 in one row of each term. Term '' stands for the group itself."""
    counted = common.written(_counted(docs), "terms")
    shards = common.tasks_for(docs.sparkSession, counted.count(), ROWS)
    kept = _sharded(
        counted, shards, _KEPT,
        "CREATE TABLE sums AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM shard GROUP BY ALL",
        f"""SELECT lang, source, term, n, (term <> '' AND row_number() OVER (PARTITION BY lang, term) = 1)::INT AS first
            FROM (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS all_docs FROM sums) WHERE term = '' OR all_docs >= {int(least_docs)}""",
    )
    return common.written(kept, "kept")


def totals(kept: DataFrame) -> DataFrame:
    """A written table of groups: lang, source, total (N), and the language's all_total and v (V)."""
    group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    whole = W.partitionBy("lang")
    return common.written(group.select("lang", "source", "total", F.sum("total").over(whole).alias("all_total"), F.sum("firsts").over(whole).alias("v")), "groups")


def _p(n: str, total: str) -> str:
    """DuckDB's SQL of the smoothed share of a count, in units of UNIT: at most UNIT + 1."""
    return f"(1 + ({UNIT}::HUGEINT * ({n} + 1)) // ({total} + v))::BIGINT"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


#: For each pair of a term's sources what both having it adds; for each group and count the number
#: of its terms; and the leading terms of each group against its language.
_SHARD = (
    f"CREATE TABLE p AS SELECT *, {_p('n', 'total')} AS p, {_p('0', 'total')} AS z FROM shard",
    f"CREATE TABLE pairs AS SELECT a.lang, a.source, b.source AS item, sum({_f('a.p', 'b.p')} - {_f('a.p', 'b.z')} - {_f('a.z', 'b.p')} + {_f('a.z', 'b.z')})::DECIMAL(38, 0) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL",
    f"CREATE TABLE lead AS SELECT lang, source, term AS item, {_f('p', 'q')} AS value FROM (SELECT *, {_p('sum(n) OVER (PARTITION BY lang, term)', 'all_total')} AS q FROM p) WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {{last}}",
    """SELECT 'both' AS part, lang, source, item, value, 0::BIGINT AS n FROM pairs
       UNION ALL SELECT 'term', lang, source, item, value::DECIMAL(38, 0), 0 FROM lead
       UNION ALL SELECT 'count', lang, source, NULL, count(*)::DECIMAL(38, 0), n FROM p GROUP BY lang, source, n""",
)
_PARTS = "part string, lang string, source string, item string, value decimal(38,0), n long"


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, last_rank: int = LAST_RANK) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text)."""
    kept = kept_terms(docs, least_docs)
    groups = totals(kept)
    rows = common.keyed(kept.where("term != ''").select("lang", "source", "term", "n"), groups, ["lang", "source"], "inner", 128)
    shards = common.tasks_for(docs.sparkSession, kept.count(), ROWS)
    parts = common.written(_sharded(rows, shards, _PARTS, *(s.replace("{last}", str(int(last_rank))) for s in _SHARD)), "shards")

    share = lambda n, total: F.expr(f"1 + CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0)) div ({total} + v)")
    f = lambda p, q: F.expr(f"CAST(({p} - {q}) * ({p} - {q}) div {q} AS DECIMAL(38, 0))")
    mine = groups.select("lang", "source", "v", F.when(F.col("v") > 0, share("0", "total")).alias("z"))  # no shares where no term is kept
    other = mine.select("lang", F.col("source").alias("item"), F.col("z").alias("item_z"))
    met = lambda df, groups: common.keyed(df, groups, "lang", "inner", 128).where("source != item")
    sums = ["lang", "source", "item", "value"]

    base = met(mine, other).withColumn("value", F.coalesce(F.col("v") * f("z", "item_z"), F.lit(0).cast("decimal(38,0)")))
    counts = parts.where("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("many"))
    levels = common.keyed(counts, groups, ["lang", "source"], "inner", 128).select("lang", "source", share("n", "total").alias("p"), share("0", "total").alias("z"), "many")
    lacks = met(levels, other).withColumn("value", F.col("many") * (f("p", "item_z") - f("z", "item_z")))
    lacked = met(levels.select("lang", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("z").alias("item_z"), "many"), mine)
    lacked = lacked.withColumn("value", F.col("many") * (f("z", "item_p") - f("z", "item_z")))
    pair = base.select(*sums).unionAll(lacks.select(*sums)).unionAll(lacked.select(*sums)).unionAll(parts.where("part = 'both'").select(*sums))
    pair = pair.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    rank = lambda *by: F.row_number().over(W.partitionBy("lang", "source", *by).orderBy(F.desc("value"), "item"))
    # a group's leading terms of all shards meet in several tasks first, whose leaders meet in one
    lead = parts.where("part = 'term'").withColumn("heap", F.pmod(F.xxhash64("item"), F.lit(HEAPS))).withColumn("rank", rank("heap")).where(F.col("rank") <= last_rank)
    lead = lead.withColumn("rank", rank()).where(F.col("rank") <= last_rank)
    out = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return pair.withColumn("rank", rank()).select(*out).unionAll(lead.select(*out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir, "lang", "source", "text"))


SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
occurrence AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM occurrence GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM occurrence SEMI JOIN kept USING (lang, term) GROUP BY ALL),
whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
share AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + ({UNIT} * (coalesce(n, 0) + 1)) // (total + v) AS p
          FROM totals JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN counts USING (lang, source, term)),
q AS (SELECT lang, term, 1 + ({UNIT} * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM whole JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
          FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
lead AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM share JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM lead QUALIFY rank <= {LAST_RANK})
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
