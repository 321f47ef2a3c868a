"""What several training-data operators share: scratch tables and word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: words are runs of characters other than these.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share.

    Where the setting is absent, a temporary folder is set as checkpoint folder if driver and
    executors are one process (tests); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("strandloom.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("strandloom.scratch", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame, path: str) -> None:
    """Replaces a written table that nothing reads any more by an empty one: its space is freed."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


#: Entries that array helpers handle together: arrays are built block by block, as appending one by
#: one to a long array copies it each time, and cutting far into a text reads it from its start.
_AT_ONCE = 64


def _blocks(x: Column) -> Column:
    """The array x as an array of arrays of _AT_ONCE entries."""
    n = F.ceil(F.size(x) / _AT_ONCE).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: F.slice(x, b * _AT_ONCE + 1, F.lit(_AT_ONCE)))).otherwise(F.array())


def _sums_before(x: Column) -> Column:
    """at: the sum of x; sums: for each entry of a short array the sum of those before it."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("sums"))
    return F.aggregate(x, start, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["sums"], F.array(a["at"])).alias("sums")))


def sums_before(x: Column) -> Column:
    """For each entry of an array of longs the sum of those before it."""
    inner = F.transform(_blocks(x), _sums_before)
    return F.flatten(F.zip_with(inner, _sums_before(F.transform(inner, lambda r: r["at"]))["sums"], lambda r, at: F.transform(r["sums"], lambda s: s + at)))


def cut_out(text: Column, spans: Column) -> Column:
    """The parts of text at an array of spans (start, stop: code points from 0), which must be in
    order and apart from one another."""

    def block(part: Column) -> Column:
        first, last = F.get(part, F.lit(0))["start"], F.element_at(part, -1)["stop"]
        near = F.substring(text, (first + 1).cast("int"), (last - first).cast("int"))
        return F.get(F.transform(F.array(near), lambda t: F.transform(part, lambda s: F.substring(t, (s["start"] - first + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), F.lit(0))

    return F.flatten(F.transform(_blocks(spans), block))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def words_of(text: Column) -> Column:
    """Array of the words of text; null or blank text: an empty array."""
    body = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(body) > 0, F.split(body, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


class WordHashes(dict):
    """64-bit hashes of words as bytes, kept for words seen lately (bounded)."""

    def __init__(self, seed: int, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def tasks_for(spark: SparkSession, rows_or_bytes: int, each: int) -> int:
    """Partitions of about `each` units, at least as many as the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows_or_bytes) // each))


#: Most bytes of keys that are broadcast; larger sets of keys are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def keyed(df: DataFrame, keys: DataFrame, on: str | list[str], how: str, row_bytes: int = 16) -> DataFrame:
    """df joined with a written table of keys, which is counted first: broadcast when its rows
    take at most BROADCAST_BYTES, else joined by shuffle."""
    small = keys.count() * row_bytes <= BROADCAST_BYTES
    return df.join(F.broadcast(keys) if small else keys, on, how)
