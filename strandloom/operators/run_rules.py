"""Whole rules of run records: a boolean for each rule, true where it does not apply, and the names
of those that are broken. A rule that meets a null it needs is broken."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import sequence as S
from ..sources import readers
from . import analytics as A
from . import records as R

#: Fixed: keys of a diagnostics line in their order, and its unit.
DIAGNOSTICS = ("dp_cost", "realized_cost", "objective_delta", "codon_penalty", "cai")
UNIT = "centikcal_mol"
#: Fixed: keys of a harness's line; those that a profiled run has besides.
HARNESS = ("mode", "lambda", "threads_requested", "threads_effective", "protein_aa", "rna_nt", "lattice_nodes", "objective_units", "solve_seconds", "profiled")
TIMERS = ("construction_seconds", "closed_seconds", "multiloop_seconds", "external_seconds")
PROFILE = (*TIMERS, "split_visits", "split_eligible")
#: Fixed: the lines of a design's output.
SEQUENCE = r"(?m)^mRNA sequence:\s+([ACGU]+)$"
STRUCTURE = r"(?m)^mRNA structure:\s+([.()]+)$"
ENERGY = r"(?m)^mRNA folding free energy: (-?\d+\.\d{2}) kcal/mol; mRNA CAI: (\d+\.\d{3})$"

_BLANK = " \t\r\n"


@F.pandas_udf(StringType())
def _line(*values: pd.Series) -> pd.Series:
    """Lines of batches of values; finite doubles in 17 significant digits read back the same."""
    shape = "diagnostics " + " ".join(f"{k}=%.17g" for k in DIAGNOSTICS) + f" cost_unit={UNIT}"
    rows = np.column_stack([v.to_numpy(np.float64, na_value=np.nan) for v in values])
    fine = np.isfinite(rows).all(axis=1)
    return pd.Series([shape % tuple(r) if ok else None for r, ok in zip(rows.tolist(), fine.tolist(), strict=True)], dtype=object)


def diagnostics_line(dp_cost: Column, realized_cost: Column, codon_penalty: Column, cai: Column) -> Column:
    """The line of diagnostics; null where a value is null or not finite. Spark's own formats start
    from a number's shortest digits, so the line is written in Python, a batch at a time."""
    values = (dp_cost, realized_cost, realized_cost - dp_cost, codon_penalty, cai)
    return _line(*(v.cast("double") for v in values))


def diagnostics(line: Column) -> Column:
    """The five values of a diagnostics line as a struct; null where it is not one line of just
    these keys with finite values and the unit."""
    keys = sorted((*DIAGNOSTICS, "cost_unit"))
    rest = F.substring(line, F.lit(len("diagnostics ")), F.length(line))
    # sorted, the tokens stand in the order of their keys, as none of these begins with another
    tokens = F.sort_array(F.filter(F.split(F.trim(rest), r"\s+"), lambda t: t != ""))
    shape = line.startswith("diagnostics ") & ~F.rtrim(line, F.lit(_BLANK)).contains("\n")

    def read(t: Column) -> Column:
        same = F.size(t) == len(keys)
        for i, k in enumerate(keys):
            same = same & F.get(t, F.lit(i)).startswith(f"{k}=")
        value = {k: F.substring(F.get(t, F.lit(i)), len(k) + 2, 1 << 30) for i, k in enumerate(keys)}
        values = F.struct(*(value[k].try_cast("double").alias(k) for k in DIAGNOSTICS))
        return F.when(same & (value["cost_unit"] == UNIT), S.once(values, finite))

    def finite(v: Column) -> Column:
        fine = F.lit(True)
        for k in DIAGNOSTICS:
            fine = fine & v[k].isNotNull() & (F.abs(v[k]) < float("inf"))
        return F.when(fine, v)

    return F.when(shape, S.once(tokens, read))


def _told(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    out = R.checked(df, rules)
    return out.withColumn("broken", F.filter(F.array(*(F.when(~F.col(n), n) for n in rules)), lambda n: n.isNotNull()))


def _once(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(F.regexp_count(text, F.lit(pattern)) == 1, F.regexp_extract(text, pattern, group))


def status_rules(records: DataFrame) -> DataFrame:
    """Records with the rules of their status.

    Columns read: status, phase, mode, exit_code, reported_exit (by the timing tool), wall_seconds,
    process_seconds, rss_gib, cap_seconds, started and finalized (times; finalized null: none),
    stdout, stderr, trade_off, threads, aa_length.

    known: ok, failed, timeout or invalid_output. in_time: no run but a pilot before the protocol
    was finalized. exit: zero for ok (by both reports) and invalid_output, another one for failed and timeout. process: an ok
    run has memory and time, the latter within the observer's. timeout: the cap was reached (but for
    a second). transcript, task, timers: an ok run's harness line (any mode but cli) has just its
    keys, the task's values, and times within the process and the call. diagnostics, design,
    printed: an ok cli run's line agrees with itself; one sequence, structure and energy of the
    task's length; energy and CAI as printed agree with the line."""
    c = F.col
    ok, cli = c("status") == "ok", c("mode") == "cli"
    harness, own = ok & ~cli, ok & cli
    rows = records.withColumns({"_m": F.when(harness & R.strict_tokens(c("stdout")), readers.key_values(c("stdout"))), "_d": F.when(own, diagnostics(c("stderr")))})
    rows = rows.withColumns({"_sequence": F.when(own, _once(c("stdout"), SEQUENCE)), "_structure": F.when(own, _once(c("stdout"), STRUCTURE)), "_energy": F.when(own, _once(c("stdout"), ENERGY).try_cast("double")), "_cai": F.when(own, _once(c("stdout"), ENERGY, 2).try_cast("double"))})
    m = lambda k: c("_m")[k].try_cast("double")
    d = lambda k: c("_d")[k]
    n, profiled = 3 * c("aa_length"), c("phase") == "profile"
    keys = lambda *more: F.array(*(F.lit(k) for k in sorted((*HARNESS, *more))))
    found = F.array_sort(F.map_keys("_m"))
    task = {"lambda": c("trade_off"), "threads_requested": c("threads"), "threads_effective": c("threads"), "protein_aa": c("aa_length"), "rna_nt": n, "profiled": profiled.cast("int")}
    same = c("_m")["mode"] == c("mode")
    for k, v in task.items():
        same = same & (m(k) == v)
    solve = m("solve_seconds")
    timers = sum((m(k) for k in TIMERS), F.lit(0.0))
    whole = lambda k: c("_m")[k].rlike(r"^\d+$")
    profile = F.forall(F.array(*(m(k) for k in TIMERS)), lambda v: (v >= 0) & (v < float("inf"))) & (timers <= solve + 1e-6) & whole("split_visits") & whole("split_eligible") & (m("split_eligible") <= m("split_visits"))
    applies = lambda when, rule: F.when(when, rule).otherwise(True)
    rules = {
        "known": c("status").isin("ok", "failed", "timeout", "invalid_output"),
        "in_time": applies(c("finalized").isNotNull() & ~c("phase").eqNullSafe("pilot"), c("started") >= c("finalized")),
        "exit": F.when(ok, (c("exit_code") == 0) & (c("reported_exit") == 0)).when(c("status") == "invalid_output", c("exit_code") == 0).when(c("status").isin("failed", "timeout"), c("exit_code") != 0).otherwise(True),
        "process": applies(ok, (c("rss_gib") > 0) & (c("process_seconds") <= c("wall_seconds") + 0.03)),
        "timeout": applies(c("status") == "timeout", c("wall_seconds") >= c("cap_seconds") - 1),
        "transcript": applies(harness, (c("stderr") == "") & (F.size(F.split(F.btrim(c("stdout"), F.lit(_BLANK)), "\n")) == 1) & R.strict_tokens(c("stdout")) & (found == F.when(profiled, keys(*PROFILE)).otherwise(keys()))),
        "task": applies(harness, same & (m("lattice_nodes") >= n + 1) & (F.abs(m("objective_units")) < float("inf"))),
        "timers": applies(harness, (solve > 0) & (solve <= c("process_seconds") + 0.03) & applies(profiled, profile)),
        "diagnostics": applies(own, (F.abs(d("objective_delta")) <= 1e-4) & (F.abs(d("realized_cost") - d("dp_cost") - d("objective_delta")) <= 1e-7) & (d("cai") > 0) & (d("cai") <= 1) & (d("codon_penalty") >= 0) & (F.abs(d("codon_penalty") + c("aa_length") * F.log(d("cai"))) <= 1e-7)),
        "design": applies(own, (F.length("_sequence") == n) & (F.length("_structure") == n) & S.balanced(c("_structure"))),
        "printed": applies(own, (F.abs(c("_energy") * 100 + 100 * c("trade_off") * d("codon_penalty") - d("realized_cost")) <= 0.501) & (F.abs(c("_cai") - d("cai")) <= 0.000501)),
    }
    return _told(rows, rules).drop("_m", "_d", "_sequence", "_structure", "_energy", "_cai")


def close(a: Column, b: Column, relative: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))


def measurement_rules(records: DataFrame, products: DataFrame, panel: DataFrame, threads: int = 8) -> DataFrame:
    """Records (objective, accession, status, error, codon_table_sha256, trade_off, threads,
    aa_length, rna_nt, candidates, direct, candidates_over_n2, candidates_over_direct,
    storage_bytes, lattice_nodes, capacity) with their rules. products: objective,
    codon_table_sha256, trade_off; panel: accession, aa_length; one row of each key.

    planned: product and panel entry are there. clean: ok, without an error. same: the product's
    table and trade-off, and the threads of all. dimensions: three nucleotides a residue, as the
    panel's length has it. counts: 0 < candidates <= direct. ratios: both recorded ones come out
    of the counts again. storage: 24 bytes a node and 16 a place of capacity."""
    c = F.col
    p = products.select("objective", F.col("codon_table_sha256").alias("_sha"), F.col("trade_off").alias("_t"), F.lit(True).alias("_product"))
    e = panel.select("accession", F.col("aa_length").alias("_aa"), F.lit(True).alias("_entry"))
    rows = records.join(p, "objective", "left").join(e, "accession", "left")
    n = c("rna_nt").cast("double")
    near = lambda a, b: close(a, b, 5e-9, 5e-12)
    rules = {
        "planned": c("_product") & c("_entry"),
        "clean": (c("status") == "ok") & (F.coalesce("error", F.lit("")) == ""),
        "same": (c("codon_table_sha256") == c("_sha")) & (c("trade_off") == c("_t")) & (c("threads") == threads),
        "dimensions": (c("rna_nt") == 3 * c("aa_length")) & (c("rna_nt") == 3 * c("_aa")),
        "counts": (c("candidates") > 0) & (c("candidates") <= c("direct")),
        "ratios": near(F.try_divide(c("candidates"), n * n), c("candidates_over_n2")) & near(F.try_divide("candidates", "direct"), c("candidates_over_direct")),
        "storage": c("storage_bytes") == 24 * c("lattice_nodes") + 16 * c("capacity"),
    }
    return _told(rows, rules).drop("_sha", "_t", "_product", "_aa", "_entry")


def membership(records: DataFrame, planned: DataFrame, group: str, key: str) -> DataFrame:
    """group, planned, recorded (keys), repeated, missing, extra, ok: whether the records of each
    group have just the planned keys, each once. Rows are counted before they meet."""
    a = records.groupBy(group, key).agg(F.count("*").alias("_n"))
    both = a.withColumn("_p", F.lit(0)).unionByName(planned.select(group, key).distinct().withColumns({"_n": F.lit(0).cast("long"), "_p": F.lit(1)}))
    by = both.groupBy(group, key).agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    n = lambda on: F.count_if(on)
    c = F.col
    out = by.groupBy(group).agg(n(c("_p") > 0).alias("planned"), n(c("_n") > 0).alias("recorded"), n(c("_n") > 1).alias("repeated"), n((c("_p") > 0) & (c("_n") == 0)).alias("missing"), n((c("_p") == 0) & (c("_n") > 0)).alias("extra"))
    return out.withColumn("ok", (c("repeated") == 0) & (c("missing") == 0) & (c("extra") == 0))


def entry_rules(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Tool results (label, tool, accession, trade_off, repetition, aa_length, input_sha256) with
    the rules that bind them to the panel's entries (accession, aa_length, input_sha256): approved
    (the entry is there), length, input, named (the label is accession.lambdaX.tool.repN), single (no other
    result has the label)."""
    c = F.col
    e = entries.select("accession", F.col("aa_length").alias("_aa"), F.col("input_sha256").alias("_sha"), F.lit(True).alias("_entry"))
    many = results.groupBy("label").agg(F.count("*").alias("_n"))
    rows = A.same_keys(results.join(e, "accession", "left"), many, ["label"])
    # a trade-off is written without a point where it is whole
    number = F.when(c("trade_off") == F.floor("trade_off"), c("trade_off").cast("long").cast("string")).otherwise(c("trade_off").cast("string"))
    label = F.concat(c("accession").cast("string"), F.lit(".lambda"), number, F.lit("."), c("tool"), F.lit(".rep"), c("repetition").cast("string"))
    rules = {"approved": c("_entry"), "length": c("aa_length") == c("_aa"), "input": c("input_sha256") == c("_sha"), "named": c("label") == label, "single": c("_n") == 1}
    return _told(rows, rules).drop("_aa", "_sha", "_entry", "_n")


def select_panel(panel: DataFrame, shortest: int, longest: int, accessions: list[str] | None = None) -> DataFrame:
    """Entries (accession, aa_length) of a length from shortest to longest and, where given, of some
    accessions. Counted first: an accession that the panel lacks, or no entry at all, is an error."""
    named = panel.where(F.col("accession").isin(accessions)) if accessions else panel
    chosen = named.where(F.col("aa_length").between(shortest, longest))
    if accessions:
        known = {r.accession for r in named.select("accession").distinct().collect()}  # as many as were given
        if absent := sorted(set(accessions) - known):
            raise ValueError(f"not in the panel: {', '.join(absent)}")
    if chosen.isEmpty():
        raise ValueError("no entry of the panel is selected")
    return chosen


def matched_cases(runs: DataFrame, case: str, tools: tuple[str, str], repetitions: int = 5) -> DataFrame:
    """case, eligible, ours, theirs, ratio: cases whose two tools may be compared, with median times.

    runs: case, tool, repetition, status, valid, admissible, seconds, energy. Eligible: each tool
    has just the repetitions from 1 on, once each; all are ok, valid and admissible with time above
    zero; and all energies are the same in hundredths. ours and theirs are the medians of the first
    and the second tool, ratio is theirs / ours; null where not eligible."""
    c = F.col
    good = (c("status") == "ok") & c("valid") & c("admissible") & (c("seconds") > 0) & c("energy").isNotNull()
    rows = runs.where(c("tool").isin(*tools)).withColumn("_e", F.round(c("energy") * 100).cast("long"))
    sound = F.bool_and(F.coalesce(good, F.lit(False)))
    # where a case is eligible each repetition has one row, so that its greatest time is its time:
    # nothing is collected and no sketch is kept for a case
    own = lambda t: [F.max(F.when((c("tool") == t) & (c("repetition") == r), c("seconds"))).alias(f"_{t}_{r}") for r in range(1, repetitions + 1)]
    by = rows.groupBy(case).agg(sound.alias("_sound"), (F.min("_e") == F.max("_e")).alias("_same"), *(F.count_if(c("tool") == t).alias(f"_{t}_n") for t in tools), *(x for t in tools for x in own(t)))
    times = lambda t: [c(f"_{t}_{r}") for r in range(1, repetitions + 1)]
    full = lambda t: (c(f"_{t}_n") == repetitions) & F.forall(F.array(*times(t)), lambda x: x.isNotNull())
    met = by.select(case, (full(tools[0]) & full(tools[1]) & c("_sound") & F.coalesce("_same", F.lit(False))).alias("eligible"), *(F.array_sort(F.array(*times(t))).alias(f"_{t}") for t in tools))
    low, high = (repetitions - 1) // 2, repetitions // 2
    a, b = (F.when(c("eligible"), (F.get(f"_{t}", F.lit(low)) + F.get(f"_{t}", F.lit(high))) / 2) for t in tools)
    return met.select(case, "eligible", a.alias("ours"), b.alias("theirs"), F.try_divide(b, a).alias("ratio"))
