"""Run records: typed parsers, and checks that give each rule its own boolean column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import readers as R


def number(x: Column) -> tuple[Column, Column]:
    """A token as a whole number, or where it has a point or an exponent as a double."""
    real = x.rlike("[.eE]")
    return F.when(~real, x.try_cast("long")), F.when(real, x.try_cast("double"))


def strict_tokens(x: Column) -> Column:
    """Whether every token of a line is key=value and no key is given twice."""
    tokens = F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != "")
    keys = F.transform(tokens, lambda t: F.substring_index(t, "=", 1))
    return F.forall(tokens, lambda t: t.rlike("^[^=]+=")) & (F.size(F.array_distinct(keys)) == F.size(keys))


def labelled(x: Column) -> Column:
    """Map of the `label: value` lines of a text; null where a label is given twice."""
    lines = F.filter(F.split(x, "\n"), lambda t: t.contains(": "))
    pairs = F.transform(lines, lambda t: F.struct(F.btrim(F.substring_index(t, ": ", 1), F.lit(" \t\r")), F.btrim(F.substring(t, F.instr(t, ": ") + 2, F.length(t)), F.lit(" \t\r"))))
    labels = F.transform(pairs, lambda p: p["col1"])
    return F.when(F.size(F.array_distinct(labels)) == F.size(labels), F.map_from_entries(pairs))


#: Fixed: what a design's output holds: a header, the sequence, the structure, and a summary line.
DESIGN = (("sequence", r"(?m)^([ACGU]+)$"), ("structure", r"(?m)^([.()]+)$"), ("mfe", r"mfe=(-?\d+\.\d+)"), ("cai", r"cai=(\d+\.\d+)"))


def design(text: Column) -> list[Column]:
    """The fields of a design's output; null where a field does not occur exactly once."""
    once = lambda p: F.when(F.regexp_count(text, F.lit(p)) == 1, F.regexp_extract(text, p, 1))
    sequence, structure, mfe, cai = (once(p) for _, p in DESIGN)
    return [sequence.alias("sequence"), structure.alias("structure"), mfe.try_cast("double").alias("mfe"), cai.try_cast("double").alias("cai")]


def design_text(header: Column, sequence: Column, structure: Column, mfe: Column, cai: Column) -> Column:
    """The output that design() reads."""
    return F.concat_ws("\n", header, sequence, structure, F.concat(F.lit("mfe="), F.format_string("%.2f", mfe), F.lit(" cai="), F.format_string("%.3f", cai)))


#: Fixed: the line of each tool that tells the energy; of several, the last one counts.
TOOLS = {"alpha": r"energy: (-?\d+\.\d+)", "beta": r"mfe = (-?\d+\.\d+)", "gamma": r"score\((-?\d+\.\d+)\)"}


def tool_energy(tool: Column, text: Column) -> Column:
    return F.coalesce(*(F.when(tool == t, R.last_match(text, p)) for t, p in TOOLS.items())).try_cast("double")


def trade_off(x: Column) -> Column:
    """A trade-off: a finite number of zero or more, up to a hundredth of the greatest double."""
    v = F.when(F.trim(x) == x, x.try_cast("double"))
    return F.when(~F.isnan(v) & (v >= 0) & (v <= 1.7976931348623157e306), v)


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with a boolean for each rule (null counts as broken), and ok for all of them."""
    out = df.withColumns({name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()})
    return out.withColumn("ok", reduce(lambda a, b: a & b, (F.col(n) for n in rules), F.lit(True)))


def demanded(df: DataFrame, ok: Column, what: str) -> DataFrame:
    """df, whose use fails where a row is not ok."""
    first = df.columns[0]
    guarded = F.when(F.coalesce(ok, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col(first).cast("string"), F.lit("null")))))
    return df.withColumn(first, guarded)


def counter_deltas(before: Column, after: Column) -> Column:
    """after - before of two maps of counters, for keys of both; null where one fell."""
    both = F.map_zip_with(F.map_filter(after, lambda k, _: F.map_contains_key(before, k)), before, lambda _, a, b: a - b)
    delta = F.map_filter(both, lambda _, v: v.isNotNull())
    return F.when(F.forall(F.map_values(delta), lambda v: v >= 0), delta)


def one_value(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """For each group and column: how many values it has, and whether that is one at most."""
    counts = df.groupBy(*by).agg(*(F.count_distinct(c).alias(c) for c in columns))
    return counts.withColumn("ok", reduce(lambda a, b: a & b, (F.col(c) <= 1 for c in columns)))


def partition_faults(df: DataFrame, head: str, member: str) -> DataFrame:
    """member, n, heads: members that are listed more than once, or heads that are not members
    of themselves, of a clustering (head, member)."""
    own = df.groupBy(member).agg(F.count("*").alias("n"), F.max((F.col(head) == F.col(member)).cast("int")).alias("_self"))
    heads = df.select(F.col(head).alias(member)).distinct().withColumn("_head", F.lit(1))
    return own.join(heads, member, "full").select(member, F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.coalesce("_head", F.lit(0)) == 1).alias("heads"), "_self").where("n != 1 or (heads and coalesce(_self, 0) = 0)").drop("_self")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows with all columns, in the order in which columns first come up; nested values as
    JSON text."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    nested = [f.name for f in out.schema if f.dataType.typeName() in ("struct", "array", "map")]
    return out.withColumns({c: F.to_json(c) for c in nested})


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and of b that the other does not have as often, with how often more: by counts,
    so equal rows need not be kept apart."""
    columns = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_n").alias("more")).where("more != 0")


def sorted_json(**columns: Column) -> Column:
    """A JSON object with keys in order, nulls written out; null where a number in it is not
    finite, as JSON has no such numbers. Numbers and strings only."""

    def field(name: str, value: Column) -> Column:
        # one field of one object at a time: to_json does the escaping, and leaves a null out
        one = F.to_json(F.struct(value.alias(name)))
        return F.when(value.isNull(), f'"{name}":null').otherwise(F.substring(one, F.lit(2), F.length(one) - 2))

    text = F.concat(F.lit("{"), F.concat_ws(",", *(field(k, columns[k]) for k in sorted(columns))), F.lit("}"))
    odd = reduce(lambda a, b: a | b, (F.coalesce(v.try_cast("double").isin(float("nan"), float("inf"), float("-inf")), F.lit(False)) & ~F.typeof(v).isin("string") for v in columns.values()))
    return F.when(~odd, text)


def chain_faults(records: DataFrame, metadata: DataFrame, plans: DataFrame, varying: list[str]) -> DataFrame:
    """fault, name, chains, n of what keeps chains of records from being put together; no row where
    nothing does.

    records: chain, label. metadata: chain, key, value. plans: chain, planned. count: a chain with
    another number of records than planned (name is the chain, n its records). differs: a key but
    those of varying that has several values, or that some chain lacks (n values, null included).
    repeated: a label that several records have (n of them)."""
    chains = plans.agg(F.count_distinct("chain").alias("_all"))
    counts = plans.groupBy("chain").agg(F.sum("planned").alias("planned")).join(records.groupBy("chain").agg(F.count("*").alias("_n")), "chain", "full")
    wrong = counts.where(~F.coalesce("_n", F.lit(0).cast("long")).eqNullSafe(F.col("planned"))).select(F.lit("count").alias("fault"), F.col("chain").cast("string").alias("name"), F.lit(1).cast("long").alias("chains"), F.coalesce("_n", F.lit(0).cast("long")).alias("n"))
    keys = metadata.where(~F.col("key").isin(varying)) if varying else metadata
    # a chain without the key counts as one more value
    values = keys.groupBy("key").agg(F.count_distinct(F.struct("value")).alias("_v"), F.count_distinct("chain").alias("chains")).crossJoin(F.broadcast(chains))  # one row
    lacking = (F.col("chains") < F.col("_all")).cast("long")
    differs = values.where(F.col("_v") + lacking > 1).select(F.lit("differs").alias("fault"), F.col("key").alias("name"), "chains", (F.col("_v") + lacking).alias("n"))
    repeated = records.groupBy("label").agg(F.count_distinct("chain").alias("chains"), F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("fault"), F.col("label").cast("string").alias("name"), "chains", "n")
    return wrong.unionAll(differs).unionAll(repeated)
