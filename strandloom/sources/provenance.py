"""Provenance: files as bytes with their hashes, held against manifests on two levels.

An index lists manifests with their hashes, a manifest lists files with theirs. What is found is
told per entry; nothing stops at the first fault. Paths are taken relative to a root, segment by
segment, and one that leaves the root is never looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def contained(path: Column) -> Column:
    """A relative path without . and .. segments; null where it is absolute, empty, or leaves its root."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("at"))
    up = lambda a: F.struct((a["ok"] & (F.size(a["at"]) > 0)).alias("ok"), F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"))
    down = lambda a, s: F.struct(a["ok"].alias("ok"), F.concat(a["at"], F.array(s)).alias("at"))
    walked = F.aggregate(parts, start, lambda a, s: F.when(s == "..", up(a)).otherwise(down(a, s)))
    return F.when(~path.startswith("/") & walked["ok"] & (F.size(walked["at"]) > 0), F.array_join(walked["at"], "/"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), bytes and sha256 of every file below root. A file is hashed in one row.
    Spark's readers pass over files without bytes and names that begin with _ or a dot."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit("/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/")
    at = F.instr(F.col("path"), base) + F.length(base)
    name = F.url_decode(F.regexp_replace(F.substring("path", at, F.length("path")), r"\+", "%2B"))
    return read.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifests(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """manifest, path, sha256 of the entries of manifests (JSON lines of path and sha256) below root."""
    read = spark.read.schema("path string, sha256 string").json([f"{root.rstrip('/')}/{n}" for n in names], mode="FAILFAST")
    by = F.coalesce(*(F.when(F.input_file_name().endswith("/" + n), n) for n in names))
    return read.select(by.alias("manifest"), "path", "sha256")


def verified(entries: DataFrame, found: DataFrame) -> DataFrame:
    """path, status, listed, sha256: one row per listed path and per file.

    entries: path, sha256; found: path, sha256. The status is escapes (a path that leaves the
    root), disputed (listed with several hashes), missing (no file), empty (listed with the hash of
    no bytes, and no file that has any), drift (another hash), unlisted (a file that no entry
    names) or ok. listed counts a path's entries."""
    safe = contained(F.col("path"))
    listed = entries.select(F.coalesce(safe, F.col("path")).alias("path"), safe.isNull().alias("out"), F.lower("sha256").alias("want"))
    by = listed.groupBy("path").agg(F.max("out").alias("out"), F.count("*").alias("listed"), F.min("want").alias("want"), F.count_distinct(F.coalesce("want", F.lit(""))).alias("kinds"))
    both = by.join(found.select("path", F.col("sha256").alias("has"), F.lit(True).alias("there")), "path", "full")
    status = (
        F.when(F.col("listed").isNull(), "unlisted").when(F.col("out"), "escapes").when(F.col("kinds") > 1, "disputed")
        .when(F.col("there").isNull() & (F.col("want") == F.sha2(F.lit(""), 256)), "empty").when(F.col("there").isNull(), "missing").when(~F.col("has").eqNullSafe(F.col("want")), "drift").otherwise("ok")
    )
    return both.select("path", status.alias("status"), F.coalesce("listed", F.lit(0).cast("long")).alias("listed"), F.col("has").alias("sha256"))


def two_levels(index: DataFrame, entries: DataFrame, found: DataFrame) -> DataFrame:
    """manifest, path, status: the index (path, sha256 of manifests) against the files first, then
    the entries of manifests. Entries of a manifest that is not ok itself, or that the index does
    not list, are untrusted. Rows of manifests have a null manifest. Files that neither lists are
    unlisted."""
    first = verified(index, found).where("listed > 0")
    trusted = first.where("status = 'ok'").select(F.col("path").alias("manifest"))
    sound = entries.join(trusted, "manifest", "left_semi")
    second = verified(sound, found.join(index.select(contained(F.col("path")).alias("path")).where("path is not null"), "path", "left_anti"))
    named = sound.select("manifest", F.coalesce(contained(F.col("path")), F.col("path")).alias("path")).groupBy("path").agg(F.min("manifest").alias("manifest"))
    told = second.join(named, "path", "left").select("manifest", "path", "status")
    other = entries.join(trusted, "manifest", "left_anti").select("manifest", "path", F.lit("untrusted").alias("status"))
    claimed = other.select("path").distinct()  # a file that only an untrusted manifest names is not called unlisted
    told = told.join(claimed.withColumn("_claimed", F.lit(True)), "path", "left").where("not (status = 'unlisted' and coalesce(_claimed, false))").select("manifest", "path", "status")
    return first.select(F.lit(None).cast("string").alias("manifest"), "path", "status").unionAll(told).unionAll(other)
