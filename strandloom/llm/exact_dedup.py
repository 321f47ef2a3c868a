"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step keeps only rows whose key so far occurs twice or more; the full text is hashed for
those survivors alone (or for all, where the caller wants the digests). Rows are joined on
lengths and hashes, never on doc_id. Lengths and prefixes are counted by one aggregation on both
together, which Spark sums up before the shuffle, so rows of one length never meet in a task.
Keys of survivors are broadcast up to common.BROADCAST_BYTES and otherwise joined by shuffle,
where AQE splits a hot key.

Defined cases: null text counts as empty; empty texts are equal to one another; every input row
has one output row, also where rows repeat a doc_id with other or equal texts; of equal texts
each row with the largest doc_id is marked kept, and keep_one leaves one of them; a null doc_id
is less than all others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PREFIX_CHARS = 128
_KEY = ["_size", "_prefix"]


def _keys(prefix_chars: int) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.octet_length(text).alias("_size"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix")]


def _prefixes(docs: DataFrame, prefix_chars: int) -> DataFrame:
    """_size, _prefix that occur twice or more, among the lengths that do."""
    counts = common.written(docs.select(*_keys(prefix_chars)).groupBy(*_KEY).agg(F.count("*").alias("n")), "lengths")
    lengths = common.written(counts.groupBy("_size").agg(F.sum("n").alias("n")).where("n > 1").select("_size"), "lengths")
    return common.written(common.keyed(counts, lengths, "_size", "left_semi").where("n > 1").select(*_KEY), "prefixes")


def _groups(hashed: DataFrame) -> DataFrame:
    """_size, _hash, keep_id, group_size, and how many rows have keep_id, of equal texts."""
    by = hashed.where("_hash is not null").groupBy("_size", "_hash", "doc_id").agg(F.count("*").alias("n"))
    last = F.max(F.struct("doc_id", "n"))
    return by.groupBy("_size", "_hash").agg(last.alias("last"), F.sum("n").alias("group_size")).where("group_size > 1").select("_size", "_hash", F.col("last.doc_id").alias("keep_id"), "group_size", F.col("last.n").alias("_again"))


def _hashed(docs: DataFrame, prefixes: DataFrame, digest: Column, *more: str) -> DataFrame:
    """docs with the digest of those whose length and prefix occur twice or more (else null)."""
    mark = common.keyed(docs, prefixes.withColumn("_twice", F.lit(True)), _KEY, "left", 24)
    return mark.select("doc_id", "_size", F.when(F.col("_twice"), digest).alias("_hash"), *more)


def _marked(hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """hashed with keep_id, group_size and kept."""
    out = common.keyed(hashed, groups, ["_size", "_hash"], "left", 80)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    return out.withColumn("keep_id", keep).withColumn("group_size", size).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def refine(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept; with digests: text_sha256 of every
    text, which then serves as the full hash too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    prefixes = _prefixes(docs, prefix_chars)
    rows = docs.select("doc_id", *_keys(prefix_chars), (F.sha2(text, 256) if digests else text).alias("_full"))
    if digests:
        rows = common.written(rows, "digests")
        hashed = _hashed(rows, prefixes, F.col("_full"), "_full")
    else:
        hashed = common.written(_hashed(rows, prefixes, F.unhex(F.sha2("_full", 256))), "hashed")
    out = _marked(hashed, common.written(_groups(hashed), "groups"))
    return out.select("doc_id", "keep_id", "group_size", "kept", *([F.col("_full").alias("text_sha256")] if digests else []))


def keep_one(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row of docs for each distinct text, with its columns."""
    names = docs.columns
    prefixes = _prefixes(docs, prefix_chars)
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    twice = common.keyed(docs.select("doc_id", "text", *_keys(prefix_chars)), prefixes, _KEY, "left_semi", 24)
    groups = common.written(_groups(twice.select("doc_id", "_size", digest.alias("_hash"))), "groups")
    row = docs.select(F.struct(*names).alias("_row"), "doc_id", *_keys(prefix_chars))
    again = F.unhex(F.sha2(F.coalesce(F.col("_row.text"), F.lit("")), 256))
    kept = _marked(_hashed(row, prefixes, again, "_row"), groups).where("kept")
    if groups.where("_again > 1").isEmpty():
        return kept.select("_row.*")
    once = kept.where("coalesce(_again, 1) = 1")
    return once.unionByName(kept.where("_again > 1").dropDuplicates(["_size", "_hash"])).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine(common.documents(spark, sf_dir, "doc_id", "text"), digests=True)


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
