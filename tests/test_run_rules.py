"""Rules of run records, each broken once."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandloom.operators import analytics as A
from strandloom.operators import coding as C
from strandloom.operators import records as R
from strandloom.operators import run_rules as Q

RECORD = "id string, status string, phase string, mode string, exit_code int, reported_exit int, wall_seconds double, process_seconds double, rss_gib double, cap_seconds double, started timestamp, finalized timestamp, stdout string, stderr string, trade_off double, threads int, aa_length int"
PENALTY = -4 * math.log(0.5)
REALIZED = -120 + 100 * 0.5 * PENALTY
LINE = f"diagnostics dp_cost={REALIZED:.17g} realized_cost={REALIZED:.17g} objective_delta=0 codon_penalty={PENALTY:.17g} cai=0.5 cost_unit=centikcal_mol\n"
DESIGN = "Threads: 2\nmRNA sequence:  AUGGCUGCUUGA\nmRNA structure: (((....)))..\nmRNA folding free energy: -1.20 kcal/mol; mRNA CAI: 0.500\n"
HARNESS = "mode=sparse lambda=0.5 threads_requested=2 threads_effective=2 protein_aa=4 rna_nt=12 lattice_nodes=40 objective_units=-7.5 solve_seconds=1.5 profiled=0"
PROFILED = HARNESS.replace("profiled=0", "profiled=1") + " construction_seconds=0.5 closed_seconds=0.5 multiloop_seconds=0.25 external_seconds=0.25 split_visits=10 split_eligible=4"

BASE = {"status": "ok", "phase": "main", "mode": "cli", "exit_code": 0, "reported_exit": 0, "wall_seconds": 2.0, "process_seconds": 2.02, "rss_gib": 0.5, "cap_seconds": 60.0, "started": datetime(2026, 1, 2), "finalized": datetime(2026, 1, 1), "stdout": DESIGN, "stderr": LINE, "trade_off": 0.5, "threads": 2, "aa_length": 4}
RUN = BASE | {"mode": "sparse", "stdout": HARNESS, "stderr": ""}
LOST = RUN | {"stdout": None, "stderr": None, "rss_gib": None, "process_seconds": None}
CASES = {
    "cli": (BASE, []), "harness": (RUN, []), "profile": (RUN | {"phase": "profile", "stdout": PROFILED}, []),
    "failed": (LOST | {"status": "failed", "exit_code": 1}, []), "timeout": (LOST | {"status": "timeout", "exit_code": -9, "wall_seconds": 59.5}, []), "invalid": (LOST | {"status": "invalid_output"}, []),
    "pilot": (BASE | {"phase": "pilot", "started": datetime(2025, 1, 1)}, []), "open protocol": (BASE | {"finalized": None}, []),
    "null status": (LOST | {"status": None}, ["known"]), "other status": (LOST | {"status": "done", "exit_code": 1}, ["known"]),
    "early": (BASE | {"started": datetime(2025, 12, 31)}, ["in_time"]), "null start": (BASE | {"started": None}, ["in_time"]),
    "ok, code": (BASE | {"exit_code": 3}, ["exit"]), "ok, reported": (BASE | {"reported_exit": None}, ["exit"]), "failed, zero": (LOST | {"status": "failed"}, ["exit"]), "invalid, code": (LOST | {"status": "invalid_output", "exit_code": 2}, ["exit"]),
    "no memory": (BASE | {"rss_gib": None}, ["process"]), "longer than observed": (BASE | {"process_seconds": 2.04}, ["process"]),
    "short timeout": (LOST | {"status": "timeout", "exit_code": 1, "wall_seconds": 58.9}, ["timeout"]),
    "two lines": (RUN | {"stdout": HARNESS.replace(" lambda", "\nlambda")}, ["transcript"]), "noise": (RUN | {"stderr": "warning"}, ["transcript"]), "more keys": (RUN | {"stdout": HARNESS + " more=1"}, ["transcript"]),
    "key twice": (RUN | {"stdout": HARNESS + " lambda=0.5"}, ["transcript", "task", "timers"]), "profiled without timers": (RUN | {"phase": "profile", "stdout": HARNESS.replace("profiled=0", "profiled=1")}, ["transcript", "timers"]),
    "threads": (RUN | {"threads": 4}, ["task"]), "few nodes": (RUN | {"stdout": HARNESS.replace("nodes=40", "nodes=12")}, ["task"]), "no objective": (RUN | {"stdout": HARNESS.replace("-7.5", "nan")}, ["task"]),
    "no solve": (RUN | {"stdout": HARNESS.replace("=1.5", "=0")}, ["timers"]), "long solve": (RUN | {"stdout": HARNESS.replace("=1.5", "=2.06")}, ["timers"]),
    "timers over": (RUN | {"phase": "profile", "stdout": PROFILED.replace("closed_seconds=0.5", "closed_seconds=0.51")}, ["timers"]), "visits": (RUN | {"phase": "profile", "stdout": PROFILED.replace("visits=10", "visits=3")}, ["timers"]),
    "unit": (BASE | {"stderr": LINE.replace("centikcal_mol", "kcal")}, ["diagnostics", "printed"]), "two diagnostics": (BASE | {"stderr": LINE + LINE}, ["diagnostics", "printed"]), "wrong penalty": (BASE | {"aa_length": 4, "stderr": LINE.replace("cai=0.5", "cai=0.5001")}, ["diagnostics"]),
    "delta": (BASE | {"stderr": LINE.replace("objective_delta=0", "objective_delta=0.001")}, ["diagnostics"]), "infinite": (BASE | {"stderr": LINE.replace("cai=0.5", "cai=inf")}, ["diagnostics", "printed"]),
    "unbalanced": (BASE | {"stdout": DESIGN.replace("(((", "((.")}, ["design"]), "length": (BASE | {"stdout": DESIGN.replace("AUGG", "AUG")}, ["design"]), "sequence twice": (BASE | {"stdout": DESIGN + DESIGN.split("\n")[1] + "\n"}, ["design"]),
    "energy": (BASE | {"stdout": DESIGN.replace("-1.20", "-1.21")}, ["printed"]), "cai": (BASE | {"stdout": DESIGN.replace("0.500", "0.501")}, ["printed"]), "cai far": (BASE | {"stdout": DESIGN.replace("0.500", "0.502")}, ["printed"]), "empty": (BASE | {"stdout": "", "stderr": ""}, ["diagnostics", "design", "printed"]),
}


def test_status_rules_each_broken_once(spark):
    rows = spark.createDataFrame([{"id": k, **r} for k, (r, _) in CASES.items()], RECORD)
    got = {r.id: r for r in Q.status_rules(rows).collect()}
    assert {k: got[k].broken for k in CASES} == {k: want for k, (_, want) in CASES.items()}
    assert all(got[k].ok == (not want) for k, (_, want) in CASES.items())
    assert Q.status_rules(rows.limit(0)).count() == 0


def test_diagnostics_lines_read_back_exactly(spark):
    values = [0.1, 1 / 3, -0.0, 1e300, 5e-324, 123456789.123456789, 2.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None, float("nan"), float("inf")])], "i int, v double")
    line = Q.diagnostics_line(F.col("v"), F.lit(0.5), F.lit(0.25), F.lit(1.0))
    got = rows.select("i", line.alias("line")).select("i", "line", Q.diagnostics(F.col("line")).alias("d")).orderBy("i").collect()
    for v, r in zip(values, got, strict=False):
        assert r.line == f"diagnostics dp_cost={v:.17g} realized_cost={0.5:.17g} objective_delta={0.5 - v:.17g} codon_penalty=0.25 cai=1 cost_unit=centikcal_mol"
        assert (r.d.dp_cost, r.d.objective_delta) == (v, 0.5 - v)
    assert [(r.line, r.d) for r in got[len(values) :]] == [(None, None)] * 3


MEASURED = "id string, objective string, accession string, status string, error string, codon_table_sha256 string, trade_off double, threads int, aa_length int, rna_nt int, candidates long, direct long, candidates_over_n2 double, candidates_over_direct double, storage_bytes long, lattice_nodes long, capacity long"


def test_measurement_rules_each_broken_once(spark):
    base = {"objective": "human", "accession": "P1", "status": "ok", "error": None, "codon_table_sha256": "aa", "trade_off": 4.0, "threads": 8, "aa_length": 5, "rna_nt": 15, "candidates": 60, "direct": 90, "candidates_over_n2": 60 / 225, "candidates_over_direct": 0.6666666667, "storage_bytes": 24 * 40 + 16 * 64, "lattice_nodes": 40, "capacity": 64}
    cases = {
        "fine": ({}, []), "rounded": ({"candidates_over_direct": 0.666666669}, []), "empty error": ({"error": ""}, []),
        "objective": ({"objective": "yeast"}, ["planned", "same"]), "accession": ({"accession": None}, ["planned", "dimensions"]), "status": ({"status": "failed"}, ["clean"]), "error": ({"error": "x"}, ["clean"]),
        "table": ({"codon_table_sha256": "bb"}, ["same"]), "threads": ({"threads": 4}, ["same"]), "length": ({"aa_length": 6, "rna_nt": 18, "candidates_over_n2": 60 / 324}, ["dimensions"]), "counts": ({"candidates": 91, "candidates_over_n2": 91 / 225, "candidates_over_direct": 91 / 90}, ["counts"]),
        "none": ({"candidates": 0, "candidates_over_n2": 0.0, "candidates_over_direct": 0.0}, ["counts"]), "ratio": ({"candidates_over_direct": 0.66667}, ["ratios"]), "no direct": ({"direct": 0}, ["counts", "ratios"]), "storage": ({"storage_bytes": 1}, ["storage"]), "null": ({"candidates": None}, ["counts", "ratios"]),
    }
    rows = spark.createDataFrame([{"id": k, **base, **change} for k, (change, _) in cases.items()], MEASURED)
    products = spark.createDataFrame([("human", "aa", 4.0)], "objective string, codon_table_sha256 string, trade_off double")
    panel = spark.createDataFrame([("P1", 5), ("P2", 7)], "accession string, aa_length int")
    assert {r.id: r.broken for r in Q.measurement_rules(rows, products, panel).collect()} == {k: want for k, (_, want) in cases.items()}


def test_membership(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 3), ("d", 1)], "g string, k int")
    planned = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)], "g string, k int")
    got = {tuple(r) for r in Q.membership(seen, planned, "g", "k").collect()}
    assert got == {("a", 2, 2, 0, 0, 0, True), ("b", 2, 2, 1, 1, 1, False), ("c", 1, 0, 0, 1, 0, False), ("d", 0, 1, 0, 0, 1, False)}


def test_entries_and_panel(spark):
    entries = spark.createDataFrame([("P1", 5, "aa"), ("P2", 70, "bb")], "accession string, aa_length int, input_sha256 string")
    rows = [("P1.lambda0.t.rep1", "t", "P1", 0.0, 1, 5, "aa"), ("P1.lambda0.5.t.rep1", "t", "P1", 0.5, 1, 6, "aa"), ("P2.lambda0.t.rep2", "t", "P2", 0.0, 2, 70, "xx"), ("P9.lambda0.t.rep1", "t", "P9", 0.0, 1, 5, "aa"), ("P1.lambda0.t.rep3", "t", "P1", 0.0, 2, 5, "aa"), ("P1.lambda4.t.rep1", "t", "P1", 4.0, 1, 5, "aa"), ("P1.lambda4.t.rep1", "t", "P1", 4.0, 1, 5, "aa"), (None, "t", "P1", 4.0, 1, 5, "aa")]
    results = spark.createDataFrame(rows, "label string, tool string, accession string, trade_off double, repetition int, aa_length int, input_sha256 string")
    got = sorted((str(r.label), r.broken) for r in Q.entry_rules(results, entries).collect())
    assert got == [("None", ["named"]), ("P1.lambda0.5.t.rep1", ["length"]), ("P1.lambda0.t.rep1", []), ("P1.lambda0.t.rep3", ["named"]), ("P1.lambda4.t.rep1", ["single"]), ("P1.lambda4.t.rep1", ["single"]), ("P2.lambda0.t.rep2", ["input"]), ("P9.lambda0.t.rep1", ["approved", "length", "input"])]
    assert [r.accession for r in Q.select_panel(entries, 5, 69).collect()] == ["P1"]
    assert [r.accession for r in Q.select_panel(entries, 1, 99, ["P2"]).collect()] == ["P2"]
    with pytest.raises(ValueError, match="P7"):
        Q.select_panel(entries, 1, 99, ["P2", "P7"])
    with pytest.raises(ValueError, match="no entry"):
        Q.select_panel(entries, 6, 69)


def test_matched_cases(spark):
    def runs(case, change=lambda tool, rep, r: r, reps=5):
        return [(case, *change(tool, rep, [tool, rep, "ok", True, True, rep * (1.0 if tool == "ours" else 2.0), -1.2])) for tool in ("ours", "theirs") for rep in range(1, reps + 1)]

    def with_(i, value, tool="theirs", rep=2):
        return lambda t, n, r: [value if (t, n, j) == (tool, rep, i) else x for j, x in enumerate(r)]

    rows = runs("fine") + runs("four", reps=4) + runs("six", reps=6) + runs("failed", with_(2, "failed")) + runs("invalid", with_(3, None)) + runs("capped", with_(4, False)) + runs("no time", with_(5, 0.0)) + runs("energy", with_(6, -1.21)) + runs("near", with_(6, -1.2000001)) + runs("twice", with_(1, 3)) + runs("none", with_(6, None)) + [("one", "ours", 1, "ok", True, True, 1.0, 1.0)]
    got = {r.case: r for r in Q.matched_cases(spark.createDataFrame(rows, "case string, tool string, repetition int, status string, valid boolean, admissible boolean, seconds double, energy double"), "case", ("ours", "theirs")).collect()}
    assert {k for k, r in got.items() if r.eligible} == {"fine", "near"}
    assert len(got) == 12 and tuple(got["fine"])[1:] == (True, 3.0, 6.0, 2.0) and got["four"].ratio is None


def test_sorted_json_has_no_nan(spark):
    rows = spark.createDataFrame([(1, 0.5, 'a"b'), (2, float("nan"), "x"), (3, float("-inf"), None), (4, None, "NaN"), (5, 1.0, None)], "i int, v double, s string")
    got = {r.i: r.j for r in rows.select("i", R.sorted_json(v=F.col("v"), s=F.col("s"), i=F.col("i")).alias("j")).collect()}
    assert got == {1: '{"i":1,"s":"a\\"b","v":0.5}', 2: None, 3: None, 4: '{"i":4,"s":"NaN","v":null}', 5: '{"i":5,"s":null,"v":1.0}'}


def test_chain_faults(spark):
    records = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "x"), ("c", "w")], "chain string, label string")
    metadata = spark.createDataFrame([("a", "host", "h"), ("b", "host", "h"), ("c", "host", "h"), ("a", "cpu", "0"), ("b", "cpu", "1"), ("c", "cpu", "2"), ("a", "seed", "1"), ("b", "seed", "2"), ("c", "seed", "1"), ("a", "pin", "p"), ("b", "pin", "p"), ("a", "none", None), ("b", "none", None), ("c", "none", None)], "chain string, key string, value string")
    plans = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1), ("d", 4)], "chain string, planned long")
    got = {tuple(r) for r in R.chain_faults(records, metadata.union(spark.createDataFrame([("d", k, v) for k, v in (("host", "h"), ("seed", "1"), ("pin", "p"), ("none", None))], metadata.schema)), plans, ["cpu"]).collect()}
    assert got == {("count", "b", 1, 2), ("count", "d", 1, 0), ("differs", "seed", 4, 2), ("differs", "pin", 3, 2), ("repeated", "x", 2, 2)}


def test_precision_pairs_and_baselines(spark):
    table = spark.createDataFrame([("t", "GCU", "A", 0.5), ("t", "GCC", "A", 0.25), ("t", "AUG", "M", 1.0)], "table_id string, codon string, aa string, freq double")
    rows = [("p", 4.0, "full", "AUGGCU", -1.0, -1.0, 8), ("p", 4.0, "r2", "AUGGCC", -1.5, -1.5, 6), ("q", 4.0, "full", "AUG", -1.0, -1.0, 0), ("q", 4.0, "r2", "AUG", -1.0, -1.0, 3), ("r", 4.0, "full", "AUG", 0.0, 0.0, 1), ("s", 0.0, "full", "GCU", -1.0, -1.0, 2), ("s", 0.0, "r2", "AAA", -1.0, -1.0, 2)]
    designs = spark.createDataFrame(rows, "protein_id string, trade_off double, table string, rna string, mfe double, objective double, candidates long")
    got = {r.protein_id: tuple(r)[2:] for r in C.precision_pairs(designs, C.weights(table), ["protein_id"], "full", "r2").collect()}
    assert got["p"] == (False, -0.5, pytest.approx(-0.5 + 4 * math.log(2)), 0.75) and got["q"] == (True, 0.0, 0.0, None)
    assert set(got) == {"p", "q", "s"}
    runs = spark.createDataFrame([("h", 1, 2.0), ("h", 2, 4.0), ("h", 3, 0.0), ("h", None, 5.0), ("y", 1, 3.0), ("y", 2, 2.0), ("y", 3, 9.0), ("y", 4, 9.0), ("y", None, 10.0)], "host string, k int, z double")
    assert {tuple(r) for r in A.baseline_ratios(runs, "host", ["k"], "z", "h").collect()} == {("h", 3, 1.0, 1.0, 1.0), ("y", 3, 1.5, 0.5, 2.0)}
