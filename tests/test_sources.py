"""Provenance by bytes and strict tables, with planted faults."""

import csv
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandloom.sources import provenance, sinks, strict

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_contained(spark):
    given = {"a/b": "a/b", "./a//b/": "a/b", "a/../b": "b", "../a": None, "a/../../b": None, "/a": None, "": None, "..": None, "a/..": None, "a/./c": "a/c", None: None}
    rows = spark.createDataFrame([(p,) for p in given], "p string").select("p", provenance.contained(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in rows} == given


def test_two_levels_of_hashes(spark, tmp_path):
    root = tmp_path / "root"
    texts = {"inputs/a b.fasta": ">a\nMF", "inputs/c+d.fasta": ">c\nMM", "runs/x/stdout.txt": "ok", "runs/y/stdout.txt": "y", "runs/z.txt": "stray", "bad/kept.txt": "kept"}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "runs/none.txt").write_text("")
    (tmp_path / "secret.txt").write_text("outside")
    entry = lambda p, h: json.dumps({"path": p, "sha256": h})
    good = [
        entry("inputs/a b.fasta", sha(">a\nMF")), entry("./inputs/../inputs/c+d.fasta", sha(">c\nMM").upper()), entry("runs/x/stdout.txt", sha("other")), entry("runs/gone.txt", sha("gone")), entry("runs/none.txt", sha("")),
        entry("../secret.txt", sha("outside")), entry("runs/y/stdout.txt", sha("y")), entry("runs/y/stdout.txt", sha("1")),
    ]
    (root / "good.jsonl").write_text("\n".join(good))
    (root / "drifted.jsonl").write_text(entry("bad/kept.txt", sha("kept")))
    index = spark.createDataFrame([("good.jsonl", sha("\n".join(good))), ("drifted.jsonl", sha("before")), ("absent.jsonl", sha("what was"))], "path string, sha256 string")
    found = provenance.files(spark, str(root))
    assert {(r.path, r.bytes, r.sha256) for r in found.collect()} >= {(n, len(t), sha(t)) for n, t in texts.items()}
    got = provenance.two_levels(index, provenance.manifests(spark, str(root), ["good.jsonl", "drifted.jsonl"]), found).collect()
    assert {(r.manifest, r.path, r.status) for r in got} == {
        (None, "good.jsonl", "ok"), (None, "drifted.jsonl", "drift"), (None, "absent.jsonl", "missing"),
        ("good.jsonl", "inputs/a b.fasta", "ok"), ("good.jsonl", "inputs/c+d.fasta", "ok"), ("good.jsonl", "runs/x/stdout.txt", "drift"), ("good.jsonl", "runs/gone.txt", "missing"), ("good.jsonl", "runs/none.txt", "empty"),
        ("good.jsonl", "../secret.txt", "escapes"), ("good.jsonl", "runs/y/stdout.txt", "disputed"), (None, "runs/z.txt", "unlisted"), ("drifted.jsonl", "bad/kept.txt", "untrusted"),
    }
    assert len(got) == 12


NAMES = [x.split()[0] for x in strict.RUN_COLUMNS.split(",")]
H = "0" * 64


def run(index, block, mode, **other):
    """A row of a right table: two arms in each block, two blocks to an input."""
    accession = f"P{block // 2}"
    row = dict.fromkeys(NAMES, "1") | dict(
        run_started_utc="2026-01-01T00:00:00Z", schedule_version="v1", schedule_index=index, block_id=f"b{block}", block_position=1 + index % 2, repeat=1 + block % 2, mode=mode, pair_status="ok", pair_error="", objective_abs_diff=0, objective_allowed_diff=0.1,
        accession=accession, description='a "quoted", text\nof two lines', input_order=block // 2, input_path=f"{accession}.fa", input_file_sha256=H, sequence_sha256=H, protein_aa=5, rna_nt=15, **{"lambda": 0.5}, threads_requested=4, threads_effective=4, solve_seconds=1.5,
        external_wall_seconds=2, timeout_seconds=10, harness_sha256=H, codon_table_sha256=H, gnu_time_sha256=H, collector_sha256=H, command_json='["time", "x"]', returncode=0, status="ok", error="")
    return row | other


def table():
    return [run(2 * b + k + 1, b, mode) for b in range(4) for k, mode in enumerate(("sparse", "dense"))]


FAULTS = {
    "arm": {"mode": "other"}, "state": {"pair_status": "fine", "pair_error": "x"}, "exit": {"returncode": 3}, "error": {"error": "what"}, "pair_error": {"pair_error": "what"}, "measured": {"max_rss_kib": ""}, "hashes": {"harness_sha256": "0" * 63},
    "lengths": {"lattice_nodes": 2}, "threads": {"threads_effective": 3}, "trade_off": {"lambda": "NaN"}, "times": {"solve_seconds": 3}, "places": {"block_position": 3}, "difference": {"objective_abs_diff": 0.2}, "command": {"command_json": "[]"},
    "index_twice": {"schedule_index": 2}, "arm_twice": {"mode": "dense"}, "input_changes": {"input_path": "other.fa"}, "block_changes": {"repeat": 7}, "order_shared": {"input_order": 0, "accession": "P9"}, "index_gap": {"schedule_index": 40}, "order_gap": {"input_order": 7},
    "malformed": {"protein_aa": "five"},
}


def put(path, rows, names=NAMES):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_MINIMAL, escapechar="\\", doublequote=False)
        out.writerow(names)
        out.writerows([[r[n] for n in names] for r in rows])
    return str(path)


def test_right_table(spark, tmp_path):
    rows = strict.read(spark, put(tmp_path / "runs.csv", table()), strict.RUN_COLUMNS)
    good, bad = strict.sorted_out(rows, strict.run_rules())
    assert bad.count() == 0 and good.count() == 8 and good.columns == NAMES
    assert {r.description for r in good.collect()} == {'a "quoted", text\nof two lines'}
    empty = strict.read(spark, put(tmp_path / "none.csv", []), strict.RUN_COLUMNS)
    assert [x.count() for x in strict.sorted_out(empty, strict.run_rules())] == [0, 0]


@pytest.mark.parametrize("some", [list(FAULTS)[i : i + 11] for i in range(0, len(FAULTS), 11)], ids=["first", "rest"])
def test_each_rule_broken_once(spark, tmp_path, some):
    for name in some:
        rows = table()
        rows[4] = rows[4] | FAULTS[name]  # of an input and block that come later
        if name == "lengths":
            for r in rows[4:]:
                r["rna_nt"] = 16
        good, bad = strict.sorted_out(strict.read(spark, put(tmp_path / f"{name}.csv", rows), strict.RUN_COLUMNS), strict.run_rules())
        reasons = [r.reasons for r in bad.select("reasons").collect()]
        assert any(name in r for r in reasons), (name, reasons)
        assert good.count() + len(reasons) == 8 and good.count() >= 2
        if name == "malformed":
            assert reasons == [["malformed"]] and "five" in bad.first()[strict.BROKEN]


def test_header_must_be_exact(spark, tmp_path):
    for k, names in enumerate((NAMES[1:], [*NAMES, "more"], [NAMES[1], NAMES[0], *NAMES[2:]])):
        path = put(tmp_path / f"{k}.csv", [r | {"more": 1} for r in table()], names)
        with pytest.raises(ValueError, match="header"):
            strict.read(spark, path, strict.RUN_COLUMNS)


class Killed(Exception):
    pass


def _doubled(rows):
    return rows.select("k", (F.col("v") * 2).alias("twice"), F.create_map(F.lit("a"), "v").alias("m"))


@pytest.mark.parametrize("at", ["config", "rows", "entry"])
def test_killed_and_repeated_run_leaves_one_result(spark, tmp_path, monkeypatch, at):
    rows = spark.range(100).selectExpr("id % 17 AS k", "id AS v")
    want = sorted((i % 17, 2 * i) for i in range(100))
    path, seen = f"file://{tmp_path}/run", []

    def work(part):
        seen.append({r.k for r in part.collect()})
        if at == "rows" and len(seen) == 2:
            raise Killed
        return _doubled(part)

    written, kept = [], sinks._row

    def row(spark_, where, *rest):
        written.append(where)
        if (at == "config" and len(written) == 1) or (at == "entry" and len(written) == 3):
            raise Killed
        kept(spark_, where, *rest)

    monkeypatch.setattr(sinks, "_row", row)
    with pytest.raises(Killed):
        sinks.resumed(rows, work, path, {"seed": 1}, "k", units=3)
    with pytest.raises(ValueError, match="no run|not complete"):
        sinks.result(spark, path)
    before = len(seen)
    got = sinks.resumed(rows, work, path, {"seed": 1}, "k", units=3)
    assert sorted((r.k, r.twice) for r in got.collect()) == want
    assert len(seen) - before == {"config": 3, "rows": 2, "entry": 2}[at]  # committed units are not worked on again
    again = len(seen)
    assert sorted((r.k, r.twice) for r in sinks.resumed(rows, work, path, {"seed": 1}, "k", units=3).collect()) == want
    assert len(seen) == again
    assert sinks.unit_faults(spark, path).count() == 0


def test_resume_fails_on_another_configuration(spark, tmp_path):
    rows = spark.range(5).selectExpr("id AS k", "id AS v")
    path = f"file://{tmp_path}/run"
    sinks.resumed(rows, _doubled, path, {"seed": 1, "lambda": 0.5}, "k", units=2)
    with pytest.raises(ValueError, match="lambda, more differ"):
        sinks.resumed(rows, _doubled, path, {"more": None, "seed": 1, "lambda": 4}, "k", units=2)
    with pytest.raises(ValueError, match="_units differ"):
        sinks.resumed(rows, _doubled, path, {"seed": 1, "lambda": 0.5}, "k", units=3)
    with pytest.raises(ValueError):
        sinks.fingerprint({"x": float("nan")})
    assert sinks.result(spark, path).count() == 5


def test_units_changed_after_their_commit_are_told(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    empty = spark.createDataFrame([], "k long, v long")
    assert sinks.resumed(empty, _doubled, f"{path}-empty", {}, "k", units=2).count() == 0
    assert sinks.unit_faults(spark, f"{path}-empty").count() == 0
    sinks.resumed(spark.range(40).selectExpr("id AS k", "id AS v"), _doubled, path, {}, "k", units=2)
    one = spark.read.parquet(f"{path}/data/unit=1")
    held = one.count()
    spark.createDataFrame(one.withColumn("twice", F.col("twice") + F.when(F.col("k") == one.agg(F.min("k")).head()[0], 1).otherwise(0)).collect(), one.schema).write.mode("overwrite").parquet(f"{path}/data/unit=1")
    assert [(r.unit, r.listed, r.found, r.same) for r in sinks.unit_faults(spark, path).collect()] == [(1, held, held, False)]
