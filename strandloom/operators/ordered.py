"""What follows what in one global order, without one task that has all rows.

Places are whole numbers. Rows are dealt into ranges of places, windows run within ranges, and
what a range needs from those before it is carried over from a table with one row per range. That
table is ordered the same way, level by level, until one range holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .analytics import draw, same_keys

#: Places of a range.
WIDTH = 1 << 16


def _carried(ranges: DataFrame, width: int) -> DataFrame:
    """range, before (the rows in earlier ranges) and last_before (the last row of the range before)
    of a table of range, n, last; one row per range."""
    width = max(2, width)  # of one range each the levels would never end
    if ranges.count() <= width:
        w = W.partitionBy(F.lit(0)).orderBy("range")  # at most width rows
        before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
        return ranges.select("range", before.alias("before"), F.lag("last").over(w).alias("last_before"))
    upper = F.expr(f"range div {width}")
    w = W.partitionBy("upper").orderBy("range")
    inner = ranges.withColumn("upper", upper).select("range", "upper", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("b"), F.lag("last").over(w).alias("l"))
    whole = ranges.groupBy(upper.alias("range")).agg(F.sum("n").alias("n"), F.max_by("last", "range").alias("last"))
    outer = _carried(whole, width).withColumnRenamed("range", "upper")
    return inner.join(outer, "upper").select("range", (F.col("b") + F.col("before")).alias("before"), F.coalesce("l", "last_before").alias("last_before"))


def in_order(df: DataFrame, place: str, *ties: str, width: int = WIDTH) -> DataFrame:
    """df with rank (from 1, by place and then the columns of ties) and previous (the row before as
    a struct, null for the first). Rows of one place meet in one task; a null place has no order
    and is left out."""
    names = df.columns
    rows = df.where(F.col(place).isNotNull()).withColumn("_range", F.expr(f"floor({place} / {width})"))
    w = W.partitionBy("_range").orderBy(place, *ties)
    local = rows.withColumns({"_at": F.row_number().over(w).cast("long"), "_lag": F.lag(F.struct(*names)).over(w)})
    last = F.max_by(F.struct(*names), F.struct(place, *ties))
    ranges = rows.groupBy(F.col("_range").alias("range")).agg(F.count("*").alias("n"), last.alias("last"))
    met = local.join(_carried(ranges, width).withColumnRenamed("range", "_range"), "_range")
    return met.select(*names, (F.col("before") + F.col("_at")).alias("rank"), F.coalesce("_lag", "last_before").alias("previous"))


def islands(df: DataFrame, place: str, key: str, width: int = WIDTH) -> DataFrame:
    """key, first, last, n of each run of rows with one key that follow one another by place: a run
    ends where the key changes. Places are unique."""
    rows = in_order(df.select(place, key), place, width=width)
    start = F.col("previous").isNull() | ~F.col(key).eqNullSafe(F.col(f"previous.{key}"))
    heads = rows.where(start).select(F.col("rank").alias("at"), key, F.col(place).alias("first"), F.col(f"previous.{place}").alias("_end"))
    # a run ends at the place before the next run's start: starts are put in order once more
    ordered = in_order(heads, "at", width=width)
    ends = ordered.select((F.col("rank") - 1).alias("rank"), F.col("_end").alias("last"), F.col("at").alias("next")).where("rank > 0")
    tail = rows.agg(F.max(place).alias("last_place"), F.count("*").alias("many"))  # one row
    out = ordered.join(ends, "rank", "left").crossJoin(F.broadcast(tail))
    return out.select(key, "first", F.coalesce("last", "last_place").alias("last"), (F.coalesce("next", F.col("many") + 1) - F.col("at")).alias("n"))


def pair_faults(records: DataFrame, block: str, arm: str, place: str, equal: list[str], value: str, arms: tuple[str, str], *, seed: int, absolute: float, relative: float, width: int = WIDTH) -> DataFrame:
    """block and a boolean for each rule of paired records: arms (one record of each), adjacent (no
    record of another block between, in the order of all records), order (the arm that the seeded
    draw of the block puts first comes first), equal (the same values in some columns), close (values
    apart by no more than the absolute, or relative to the larger, tolerance). ok: all of them."""
    runs = islands(records, place, block, width).groupBy(block).agg(F.count("*").alias("_runs"))
    n = lambda a: F.count_if(F.col(arm) == a)
    of = lambda a: F.max(F.when(F.col(arm) == a, F.col(value)))
    by = records.groupBy(block).agg(
        ((n(arms[0]) == 1) & (n(arms[1]) == 1) & (F.count("*") == 2)).alias("arms"),
        F.min_by(arm, place).alias("_first"),
        *(F.count_distinct(F.struct(c)).alias(f"_n{i}") for i, c in enumerate(equal)),
        of(arms[0]).cast("double").alias("_a"), of(arms[1]).cast("double").alias("_b"),
    )
    first = F.when(draw(F.lit(str(seed)), F.col(block).cast("string")) % 2 == 0, arms[0]).otherwise(arms[1])
    allowed = F.greatest(F.lit(absolute), relative * F.greatest(F.abs("_a"), F.abs("_b")))
    same = F.forall(F.array(*(F.col(f"_n{i}") for i in range(len(equal)))), lambda k: k == 1) if equal else F.lit(True)
    met = same_keys(by, runs, [block])
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = {"arms": no(F.col("arms")), "adjacent": F.col("_runs") == 1, "order": no(F.col("_first") == first), "equal": same, "close": no(F.abs(F.col("_a") - F.col("_b")) <= allowed)}
    ok = rules["arms"] & rules["adjacent"] & rules["order"] & rules["equal"] & rules["close"]
    return met.select(block, *(r.alias(k) for k, r in rules.items()), ok.alias("ok"))


def planned_order(tasks: DataFrame, key: str, seed: int, width: int = WIDTH) -> DataFrame:
    """tasks with place: their order in a shuffle that the seed fixes (from 1)."""
    drawn = tasks.withColumn("_draw", draw(F.lit(str(seed)), F.col(key).cast("string")))
    # draws are spread over 2^32 numbers: ranges of about width rows
    step = max(1, int((1 << 32) * width / max(1, tasks.count())))
    return in_order(drawn, "_draw", key, width=step).withColumnRenamed("rank", "place").drop("_draw", "previous")


def plan_faults(plan: DataFrame, seen: DataFrame, key: str, place: str) -> DataFrame:
    """key, status, planned, recorded: tasks of the plan or the records that do not agree, both ways:
    missing (recorded less often than planned), extra (more often), misplaced (as often, at other
    places). Counts and places are compared by aggregation; a row's place is hashed into a sum."""
    mark = lambda df, sign: df.select(key, F.lit(sign).alias("_s"), F.xxhash64(key, F.col(place).cast("long")).cast("decimal(38,0)").alias("_h"))
    both = mark(plan, 1).unionAll(mark(seen, -1)).groupBy(key).agg(F.count_if(F.col("_s") == 1).alias("planned"), F.count_if(F.col("_s") == -1).alias("recorded"), F.sum(F.col("_s") * F.col("_h")).alias("_d"))
    status: Column = F.when(F.col("recorded") < F.col("planned"), "missing").when(F.col("recorded") > F.col("planned"), "extra").when(F.col("_d") != 0, "misplaced")
    return both.select(key, status.alias("status"), "planned", "recorded").where("status is not null")
