"""Strict tables: every row is typed and held against rules; rows that break any are set aside
with the reasons, beside the typed rows that do not.

A rule of a row is a boolean column. Rules across rows are keys that may not repeat, columns that
must agree within a key, and numbers that must run from a first one without a gap; they are
checked by aggregation on the key, so no group is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROKEN = "_broken"


@dataclass
class Rules:
    """row: name and column that must be true (null: broken); unique: name and key; agree: name, key
    and columns with one value each; runs: name, number and its first value."""

    row: dict[str, Column] = field(default_factory=dict)
    unique: dict[str, list[str]] = field(default_factory=dict)
    agree: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    runs: dict[str, tuple[str, int]] = field(default_factory=dict)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of CSV files (gzip by suffix) with BROKEN: the text of a row of another width or with
    a value of another type, else null. Columns must be those of the schema in their order: another
    header is an error."""
    wanted = StructType.fromDDL(schema)
    heads = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).groupBy(F.input_file_name().alias("f")).agg(F.first("value").alias("h"))
    for r in heads.select("h").distinct().collect():  # one row for each header that occurs
        if (names := [c.strip('"') for c in r.h.lstrip("﻿").split(",")]) != wanted.names:
            missing, extra = [n for n in wanted.names if n not in names], [n for n in names if n not in wanted.names]
            raise ValueError(f"header of {path}: missing {missing}, unexpected {extra}" if missing or extra else f"header of {path}: columns in another order, or twice")
    return spark.read.schema(StructType.fromDDL(f"{schema}, {BROKEN} string")).option("columnNameOfCorruptRecord", BROKEN).csv(path, header=True, mode="PERMISSIVE", multiLine=True)


def parsed(lines: DataFrame, value: Column, schema: str) -> DataFrame:
    """lines with the fields of CSV text in value, and BROKEN as in read."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    return lines.withColumn("_row", F.from_csv(value, f"{schema}, {BROKEN} string", options)).select(*lines.columns, "_row.*")


def judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows with reasons: an array of the names of the rules that a row breaks, in their order;
    ["malformed"] alone for a row that could not be typed."""
    typed = F.col(BROKEN).isNull() if BROKEN in rows.columns else F.lit(True)
    out, names = rows, []
    sound = rows.where(typed)

    def marked(out: DataFrame, keys: list[str], bad: DataFrame, name: str) -> DataFrame:
        other = bad.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.lit(True).alias(f"_bad {name}"))
        return out.join(other, [out[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)], "left").drop(*(f"_k{i}" for i in range(len(keys))))

    for name, key in rules.unique.items():
        out = marked(out, key, sound.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), name)
        names.append(name)
    for name, (key, columns) in rules.agree.items():
        several = sound.groupBy(*key).agg(*(F.count_distinct(F.struct(c)).alias(f"_n{i}") for i, c in enumerate(columns)))
        out = marked(out, key, several.where(" or ".join(f"_n{i} > 1" for i in range(len(columns)))), name)
        names.append(name)
    for name, (number, first) in rules.runs.items():
        # within distinct numbers, all but the first must have one just before them
        seen = sound.select(number).where(F.col(number).isNotNull()).distinct()
        before = seen.select((F.col(number) + 1).alias(number), F.lit(True).alias("_after"))
        gap = seen.join(before, number, "left").where(F.col("_after").isNull() & (F.col(number) != first))
        out = marked(out, [number], gap, name)
        names.append(name)
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.row.items()] + [F.when(F.col(f"`_bad {n}`"), F.lit(n)) for n in names]
    reasons = F.when(typed, F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")).otherwise(F.array(F.lit("malformed")))
    return out.withColumn("reasons", reasons).drop(*(f"_bad {n}" for n in names))


def sorted_out(rows: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The rows that break no rule, typed; and the others with their reasons and BROKEN."""
    all_rows = judged(rows, rules)
    return all_rows.where("size(reasons) = 0").drop("reasons", BROKEN), all_rows.where("size(reasons) > 0")


#: Fixed: columns of a table of paired runs, in order, with the type of each.
RUN_COLUMNS = """
run_started_utc timestamp, schedule_version string, schedule_seed long, schedule_index long, block_id string, block_position int, repeat int, mode string,
pair_status string, pair_error string, objective_abs_diff double, objective_allowed_diff double, accession string, description string, input_order int, input_path string,
input_file_sha256 string, sequence_sha256 string, protein_aa int, rna_nt int, lattice_nodes long, lambda double, threads_requested int, threads_effective int,
objective_units double, solve_seconds double, external_wall_seconds double, host_load1_before double, host_load5_before double, host_load15_before double, host_load1_after double, host_load5_after double,
host_load15_after double, time_elapsed_seconds double, time_user_seconds double, time_system_seconds double, time_cpu_percent double, max_rss_kib long, harness_path string, harness_sha256 string,
codon_table_path string, codon_table_sha256 string, gnu_time_path string, gnu_time_sha256 string, command_prefix_json string, command_prefix_executable string, command_prefix_sha256 string, command_json string,
working_directory string, omp_env_json string, environment_overrides_json string, objective_abs_tolerance double, objective_rel_tolerance double, timeout_seconds double, collector_sha256 string, host string,
platform string, python_version string, returncode int, status string, error string, harness_stdout string, harness_stderr string, gnu_time_output string
"""


def run_rules() -> Rules:
    """The rules of a table of paired runs."""
    c = F.col
    hashed = lambda *names: F.forall(F.array(*names), lambda h: h.rlike("^[0-9a-f]{64}$"))
    ok = c("status") == "ok"
    measured = ["objective_units", "solve_seconds", "external_wall_seconds", "lattice_nodes", "max_rss_kib", "threads_effective"]
    blank = lambda n: F.coalesce(c(n), F.lit("")) == ""
    row = {
        "arm": c("mode").isin("sparse", "dense"),
        "state": c("status").isin("ok", "failed", "timeout", "invalid_output") & c("pair_status").isin("ok", "failed", "incomplete"),
        "exit": F.when(ok, c("returncode") == 0).when(c("status") == "failed", c("returncode") != 0).otherwise(F.lit(True)),
        "error": F.when(ok, blank("error")).otherwise(~blank("error")),
        "pair_error": F.when(c("pair_status") == "ok", blank("pair_error")).otherwise(~blank("pair_error")),
        "measured": F.when(ok, F.forall(F.array(*(c(m).cast("double") for m in measured)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).otherwise(F.lit(True)),
        "hashes": hashed("input_file_sha256", "sequence_sha256", "harness_sha256", "codon_table_sha256", "gnu_time_sha256", "collector_sha256"),
        "lengths": (c("protein_aa") > 0) & (c("rna_nt") == 3 * c("protein_aa")),
        "threads": (c("threads_requested") > 0) & F.when(ok, c("threads_effective") == c("threads_requested")).otherwise(F.lit(True)),
        "trade_off": (c("lambda") >= 0) & ~F.isnan("lambda") & (c("lambda") < float("inf")),
        "times": F.when(ok, (c("solve_seconds") >= 0) & (c("solve_seconds") <= c("external_wall_seconds")) & (c("external_wall_seconds") <= c("timeout_seconds"))).otherwise(F.lit(True)),
        "places": (c("block_position").isin(1, 2)) & (c("repeat") >= 1) & (c("input_order") >= 0) & (c("schedule_index") >= 1),
        "difference": F.when(c("pair_status") == "ok", c("objective_abs_diff") <= c("objective_allowed_diff")).otherwise(F.lit(True)),
        "command": F.get_json_object("command_json", "$[0]").isNotNull(),
    }
    return Rules(
        row,
        unique={"index_twice": ["schedule_index"], "arm_twice": ["block_id", "mode"]},
        agree={"input_changes": (["accession"], ["input_path", "input_file_sha256", "sequence_sha256", "protein_aa", "rna_nt", "input_order"]), "block_changes": (["block_id"], ["accession", "lambda", "threads_requested", "repeat"]), "order_shared": (["input_order"], ["accession"])},
        runs={"index_gap": ("schedule_index", 1), "order_gap": ("input_order", 0)},
    )
