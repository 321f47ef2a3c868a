"""A sink of runs that may be killed: identical configuration or failure, results committed last.

Below a run's path:
  config         one JSON row with the configuration and its fingerprint, written first, never again
  data/unit=N    the rows of one unit; a unit without an entry may be half written
  done/unit=N    one JSON row with the unit's rows and a sum of their hashes: its commit

Rows are dealt into units by the hash of a key. Each unit is one distributed job, and its entry is
written after its rows were read back and counted; one JSON file either is there or is not. A
repeated run passes over units with an entry and overwrites the others, so a killed and repeated
run leaves what one run would have left. Two runs at a time on one path are not served.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "unit int, rows long, hashes string"


def fingerprint(config: dict) -> tuple[str, str]:
    """The configuration as JSON with sorted keys, and its SHA-256; NaN and infinities are errors."""
    text = json.dumps(config, sort_keys=True, allow_nan=False)
    return text, hashlib.sha256(text.encode()).hexdigest()


def _there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What read gives, or None where the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _row(spark: SparkSession, path: str, schema: str, values: tuple) -> None:
    spark.createDataFrame([values], schema).coalesce(1).write.mode("overwrite").json(path)


def preserved(spark: SparkSession, path: str, config: dict) -> bool:
    """Whether the run at path was begun with this configuration before; begins it where there is
    none, and fails where another one is there, naming the keys that differ."""
    text, digest = fingerprint(config)
    # a configuration that was being written when the run was killed has no row
    old = _there(lambda: spark.read.schema("config string, sha256 string").json(f"{path}/config", mode="FAILFAST"))
    kept = old.head() if old is not None else None
    if kept is None:
        _row(spark, f"{path}/config", "config string, sha256 string", (text, digest))
        return False
    if kept.sha256 != digest:
        was, now = json.loads(kept.config), json.loads(text)
        none = object()
        differ = sorted(k for k in {*was, *now} if was.get(k, none) != now.get(k, none))
        raise ValueError(f"run at {path} has another configuration: {', '.join(differ)} differ; use a new path")
    return True


def unit_of(key: str, units: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(units)).cast("int")


def _hashes(columns: list[str]) -> Column:
    # maps cannot be hashed as they are; their JSON can
    return F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)")), F.lit(0)).cast("string")


def _units(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """Rows of some units with their number; at least one, as every unit has a schema."""
    paths = [f"{path}/data/unit={n}" for n in numbers]
    return spark.read.option("basePath", f"{path}/data").parquet(*paths)


def _done(spark: SparkSession, path: str) -> DataFrame | None:
    return _there(lambda: spark.read.schema(_ENTRY).json(f"{path}/done/*/*.json", mode="FAILFAST"))


def resumed(source: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, config: dict, key: str, units: int = 1) -> DataFrame:
    """The result of work on source, unit by unit, stored below path; a repeated call works on
    units that are not committed yet and fails where the configuration is not the same.

    work gets the source's rows of a unit (all rows of a key are in one) and gives the same columns
    for each. The number of units and the key belong to the configuration, as do whatever work and
    source depend on: that is the caller's to name. units bounds the driver's loop, and the entries
    it reads: it is a parameter and does not grow with the rows."""
    spark = source.sparkSession
    begun = preserved(spark, path, config | {"_key": key, "_units": units})
    entries = _done(spark, path) if begun else None
    finished = {r.unit for r in entries.collect()} if entries is not None else set()
    for n in (n for n in range(units) if n not in finished):
        at = f"{path}/data/unit={n}"
        rows = work(source.where(unit_of(key, units) == n))
        if "unit" in rows.columns:
            raise ValueError("unit is the name of the stored units' column")
        rows.write.mode("overwrite").parquet(at)
        got = spark.read.parquet(at)
        told = got.agg(F.count("*").alias("n"), _hashes(got.columns).alias("h")).head()
        _row(spark, f"{path}/done/unit={n}", _ENTRY, (n, told.n, told.h))
    return result(spark, path)


def result(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a run of which every unit is committed; fails on any other."""
    kept = _there(lambda: spark.read.schema("config string, sha256 string").json(f"{path}/config", mode="FAILFAST"))
    first = kept.head() if kept is not None else None
    if first is None:
        raise ValueError(f"no run at {path}")
    units = json.loads(first.config)["_units"]
    entries = _done(spark, path)
    finished = {r.unit for r in entries.collect()} if entries is not None else set()
    if missing := units - len(finished):
        raise ValueError(f"run at {path} is not complete: {missing} of {units} units are open")
    return _units(spark, path, sorted(finished)).drop("unit")


def unit_faults(spark: SparkSession, path: str) -> DataFrame:
    """unit, listed, found, same: committed units whose rows are not those that were committed."""
    entries = _done(spark, path)
    if entries is None:
        return spark.createDataFrame([], "unit int, listed long, found long, same boolean")
    numbers = [r.unit for r in entries.collect()]
    data = _units(spark, path, numbers)
    columns = [c for c in data.columns if c != "unit"]
    now = data.groupBy("unit").agg(F.count("*").alias("n"), _hashes(columns).alias("h"))
    met = entries.join(now, "unit", "left").select("unit", F.col("rows").alias("listed"), F.coalesce("n", F.lit(0).cast("long")).alias("found"), (F.coalesce("h", F.lit("0")) == F.col("hashes")).alias("same"))
    return met.where("listed != found or not same")
