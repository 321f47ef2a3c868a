"""Plans whose cost must grow no faster than the input: what they shuffle, hold and make."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import analytics as A
from strandloom.operators import coding as C
from strandloom.operators import motif_free as M
from strandloom.operators import run_rules as Q
from strandloom.operators import structures as T
from strandloom.plans import catalog

RNG = np.random.default_rng(3)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("found", [C.base_pairs, T.loops, T.flanks])
def test_structures_are_read_where_their_rows_are(spark, found):
    df = spark.createDataFrame([(1, "((..)(.))"), (2, None), (3, ""), (4, "."), (5, "()")], "id long, structure string")
    assert not {"Exchange", "Window", "Generate"} & set(plan(found(df)).replace("(", " ").split())
    assert {r.id for r in found(df).collect()} == ({1} if found is T.flanks else {1, 5})


def test_long_structures_come_in_several_batches(spark):
    n = 2 * C.AT_ONCE + 5
    df = spark.createDataFrame([(1, "(" + "()" * n + ")"), (2, "((" + "." * n + "))"), (3, "(")], "id long, structure string")
    got = T.flanks(df.where("id < 3")).groupBy("id").agg(F.count("*").alias("n"), F.max("place").alias("p"), F.sum("before").alias("b"), F.max("after").alias("a")).collect()
    assert {tuple(r) for r in got} == {(1, n, n, 0, 0), (2, 1, 1, 0, 0)}
    assert {(r.id, r.i, r.j) for r in C.base_pairs(df.where("id > 1")).collect()} == {(2, 0, n + 3), (2, 1, n + 2), (3, 0, None)}
    assert {r.id for r in C.base_pairs(df, only_balanced=True).collect()} == {1, 2}


def weight(seed, n, key):
    u = int(hashlib.md5(f"{seed}:{n}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u > c for c in A.POISSON)


def test_weights_of_a_batch_are_those_of_single_keys():
    keys = ["", "é", *("x" * n for n in range(45, 60)), "y" * 200, *map(str, range(50))]
    assert A.drawn_weights(keys, 12, 7).tolist() == [[weight(7, n, k) for n in range(1, 13)] for k in keys]
    none = int(hashlib.md5(b"7:3").hexdigest()[:8], 16) / 2**32
    assert A.drawn_weights([None], 3, 7)[0, 2] == sum(none > c for c in A.POISSON)


def test_slopes_make_no_row_for_each_draw(spark):
    df = spark.createDataFrame([("a", i % 4, i, float(i), float(i * i)) for i in range(40)], "h string, c int, k int, x double, y double")
    made = plan(A.slope_bootstrap(df, "h", "c", "k", F.col("x"), {"y": F.col("y")}, 20))
    assert made.count("MapInArrow") >= 3 and "explode(sequence" not in made


@pytest.mark.parametrize("keys", [4000, 3])
def test_medians_of_draws_near_the_middle_or_far_from_it(spark, keys):
    """With few keys a draw takes whole parts of the values, and its median may be anywhere."""
    x = np.sort(RNG.normal(size=4000))
    rows = [("g", str(i * keys // 4000), float(v)) for i, v in enumerate(x)] + [(None, "7", 1.0), (None, "8", 2.0), (None, "9", 5.0)]
    df = spark.createDataFrame(rows, "g string, k string, x double").repartition(3)
    got = {r.g: r for r in A.median_bootstrap(df, ["g"], "k", ["x"], 25).collect()}
    for g in ("g", None):
        of = [(k, v) for h, k, v in rows if h == g]
        drawn = [np.repeat([v for _, v in of], [weight(7, n, k) for k, _ in of]) for n in range(1, 26)]
        medians = [np.median(d) for d in drawn if len(d)]
        assert got[g].draws == len(medians)
        assert np.allclose([got[g].low, got[g].high], np.quantile(medians, [0.025, 0.975]))


def test_lattices_join_nothing_and_precision_pairs_shuffle_no_sequences(spark):
    proteins = spark.createDataFrame([(1, "MFL*"), (2, ""), (3, None), (4, "M?F"), (5, "éM")], "protein_id long, seq string")
    table = spark.createDataFrame([("t", *c) for c in catalog.CODONS], "table_id string, codon string, aa string, freq double")
    edges = C.lattice_edges(proteins, C.weights(table))
    assert "Join" not in plan(edges)
    assert {(r.protein_id, r.src_pos) for r in edges.where("src = ''").collect()} == {(1, 0), (1, 3), (1, 6), (1, 9), (4, 0), (4, 6), (5, 3)}
    nodes = C.lattice_nodes(proteins, table)
    assert "Generate explode" in plan(nodes)  # a row of Arrow is a residue, not a node
    ends = {r.protein_id: (r.pos, r.node) for r in nodes.groupBy("protein_id").agg(F.max("pos").alias("pos"), F.max("node").alias("node"), F.count("*").alias("n")).collect()}
    assert {i: e[0] for i, e in ends.items()} == {1: 12, 4: 9, 5: 6}
    both = C.best_designs(proteins, {"a": C.weights(table), "b": C.weights(table)})
    assert "Exchange" not in plan(both) and {r.protein_id: r.cds_a == r.cds_b for r in both.collect()} == {1: True, 4: True, 5: True}


def test_small_groups_inversions_and_cases_keep_neither_bits_nor_sketches(spark):
    rows = [(g, int(RNG.integers(0, 6)), float(RNG.integers(0, 6))) for g, n in ((1, 2), (2, A.FEW), (3, A.FEW + 1), (None, 5), (4, 1), (5, 90)) for _ in range(n)]
    found = A.inversions(spark.createDataFrame(rows, "g int, x int, y double"), ["g"], "x", "y")
    assert "collect_list" in plan(found)
    want = {}
    for g in {r[0] for r in rows}:
        of = [r[1:] for r in rows if r[0] == g]
        pairs = [(a, b) for a in of for b in of if a[0] < b[0]]
        if pairs:
            want[g] = sum(a[1] > b[1] for a, b in pairs), len(pairs)
    assert {r.g: (r.inverted, r.pairs) for r in found.collect()} == want
    runs = spark.createDataFrame([("a", t, r, "ok", True, True, s, -1.0) for t, k in (("o", 1.0), ("t", 3.0)) for r, s in ((1, k), (2, 4 * k))], "case string, tool string, repetition int, status string, valid boolean, admissible boolean, seconds double, energy double")
    cases = Q.matched_cases(runs, "case", ("o", "t"), repetitions=2)
    assert "percentile" not in plan(cases) and plan(cases).count("Exchange") == 1
    assert [tuple(r) for r in cases.collect()] == [("a", True, 2.5, 7.5, 3.0)]


def test_lines_of_diagnostics_are_written_in_one_batch_and_read_in_any_order(spark):
    df = spark.createDataFrame([(0.1, 2.0), (None, 2.0), (float("inf"), 2.0)], "a double, b double")
    line = Q.diagnostics_line(F.col("a"), F.col("b"), F.col("b"), F.col("b"))
    assert plan(df.select(line)).count("_line(") and [r[0] is None for r in df.select(line).collect()] == [False, True, True]
    good = "diagnostics cai=1 cost_unit=centikcal_mol  dp_cost=2 objective_delta=3 realized_cost=4 codon_penalty=5"
    bad = [good.replace("cai=1", "cai=x"), good.replace("cai=1", "cai=1 cai=1"), good.replace("cai=1 ", ""), good + " more=1", good + " word", good + "\nx", good.replace("=3", "=NaN"), good.replace("centi", ""), None]
    got = [r.d for r in spark.createDataFrame([(x,) for x in [good, *bad]], "x string").select(Q.diagnostics(F.col("x")).alias("d")).collect()]
    assert tuple(got[0]) == (2.0, 4.0, 3.0, 5.0, 1.0) and got[1:] == [None] * len(bad)


def automaton(motifs):
    states = {m[:i] for m in motifs for i in range(len(m))}
    read = {(s, n): s + n for s in states for n in "ACGU" if not any((s + n).endswith(m) for m in motifs)}
    return {k: max((t for t in states if r.endswith(t)), key=len) for k, r in read.items()}


def codon_costs():
    out: dict = {}
    for codon, aa, freq in catalog.CODONS:
        out.setdefault(aa, []).append((codon, round(1 - freq, 1)))
    return out


@pytest.mark.parametrize("few", [1, M.FEW])
@pytest.mark.parametrize("motifs", [["UCUUCU", "AGCAGC", "GAAUUC"], ["A"], ["UC", "GAA", "CCG"], ["ACAC", "GUU", "CG", "UUUUUU"], ["AUG", "UCU"]])
def test_chunks_are_as_whole_walks(monkeypatch, motifs, few):
    """Also where a set of states is told by no pair of residues, where none is left, and for odd letters."""
    monkeypatch.setattr(M, "FEW", few)
    monkeypatch.setattr(M, "STEP", 7)
    product, costs = M.Product(codon_costs(), automaton(motifs)), {a: dict(x) for a, x in codon_costs().items()}
    seqs = ["".join(RNG.choice([*letters], n)) for letters in ("ACDEFGHIKLMNPQRSTVWY*", "SLARNIF", "SSSSX") for n in (*range(1, 40), 500)] + ["X", "é", "S\U0001f600A"]
    seqs.sort(key=len, reverse=True)
    zero = np.zeros(len(seqs), np.int64)
    want_cost, state, end, want_nodes, want_edges, _ = product.ways([("", s) for s in seqs], zero, zero - 1, zero)
    cost, nodes, edges, cds = product.whole(seqs)
    assert nodes.tolist() == (want_nodes + (end != 1)).tolist() and edges.tolist() == want_edges.tolist()
    np.testing.assert_allclose(cost, want_cost)
    for s, v, x in zip(seqs, cost, cds, strict=True):
        assert (x is None) == np.isinf(v)
        if x is not None:
            assert not any(m in x for m in motifs) and sum(costs[a][x[3 * i : 3 * i + 3]] for i, a in enumerate(s)) == pytest.approx(v)


def test_a_chunk_is_walked_once_however_often_it_occurs(monkeypatch):
    product, walked = M.Product(codon_costs(), automaton(["UCUUCU", "AGCAGC", "GAAUUC"])), []
    step = M.Product._step
    monkeypatch.setattr(M.Product, "_step", lambda self, v, pair, back: (walked.append(len(v)), step(self, v, pair, back))[1])
    words = "".join(RNG.choice([*"ACDEFGHIKLMNPQRSTVWY"], 3000))
    product.whole([words])
    once, steps = sum(walked), len(walked)
    walked.clear()
    product.whole([words * 20] * 5)
    assert once < 1500 and sum(walked) < once + 100 and len(walked) < steps + 20


def test_least_costs_alone_spell_nothing(spark):
    """As costs of sequences, of short proteins and of ones in segments; no pieces are put together."""
    w, sets = C.weights(catalog._table(spark)), spark.createDataFrame([("s", m) for m in catalog.MOTIFS], "motifset_id string, motif string")
    df = spark.createDataFrame([(i, "".join(RNG.choice([*"SLARNIFEX"[: 9 - (i > 2)]], n))) for i, n in enumerate((3, 50, 200, 400, 401))] + [(7, ""), (8, None)], "protein_id long, seq string")
    alone, spelled = (M.motif_product(df, w, sets, 5, spell=x) for x in (False, True))
    assert "collect_list" in plan(spelled) and "collect_list" not in plan(alone)
    a, b = ({r.protein_id: r for r in x.collect()} for x in (alone, spelled))
    assert a.keys() == b.keys() == set(range(5)) and all(r.cds is None for r in a.values()) and any(r.cds for r in b.values())
    assert all((a[i].nodes, a[i].edges, a[i].feasible, a[i].cost) == (b[i].nodes, b[i].edges, b[i].feasible, b[i].cost) for i in a)


TABLE = {a: sorted(c for c, b, _ in catalog.CODONS if b == a) for _, a, _ in catalog.CODONS}


def written(df, path) -> float:
    """Bytes a row of df as one file."""
    df.coalesce(1).write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / df.count()


@pytest.fixture(scope="module")
def many(spark):
    rows = [(i, "".join(RNG.choice(list("ACDEFGHIKLMNPQRSTVWY"), 600 + i % 50))) for i in range(200)]
    return spark.createDataFrame(rows, "protein_id long, seq string").coalesce(1)


def split_up(spark, monkeypatch):
    """Proteins with lists, blocks and stretches of a few residues each."""
    for name, size in (("STRETCH", 7), ("TOGETHER", 40), ("LISTED", 3), ("BLOCK", 8)):
        monkeypatch.setattr(C, name, size)
    seqs = ["", None, "M", "?", "?" * 60, "LRS*" * 9, "é\x00ML\U0001f600W", *("".join(RNG.choice(list("AC*LRSMW?"), n)) for n in (6, 7, 8, 30, 55, 90))]
    rows = [(f"p{i}", s) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "protein_id string, seq string").coalesce(1), {i: s for i, s in rows if s}


def test_edges_of_any_lists_are_whole_and_take_few_bytes(spark, many, monkeypatch, tmp_path):
    table = spark.createDataFrame([("t", *c) for c in catalog.CODONS], "table_id string, codon string, aa string, freq double")
    weighted = C.weights(table)
    assert written(C.lattice_edges(many, weighted), tmp_path / "edges") < 1.2
    proteins, seqs = split_up(spark, monkeypatch)
    cost = {r.codon: r.neg_log_w for r in weighted.collect()}
    steps = lambda a: {(k, c[:k], c[: k + 1] if k < 2 else "", c[k], cost[c] if k == 2 else 0.0) for c in TABLE.get(a, ()) for k in range(3)}
    want = [(i, 3 * r + k, *x) for i, s in seqs.items() for r, a in enumerate(s) for k, *x in steps(a)]
    assert sorted(tuple(e) for e in C.lattice_edges(proteins, weighted).collect()) == sorted(want)


def test_nodes_of_any_blocks_are_whole_and_take_few_bytes(spark, many, monkeypatch, tmp_path):
    table = spark.createDataFrame([("t", *c) for c in catalog.CODONS], "table_id string, codon string, aa string, freq double")
    assert written(C.lattice_nodes(many, table), tmp_path / "nodes") < 2
    proteins, seqs = split_up(spark, monkeypatch)
    want = []
    for i, s in seqs.items():
        nodes = [(3 * r + k, x) for r, a in enumerate(s) for k, x in sorted({(k, c[:k]) for c in TABLE.get(a, ()) for k in range(3)})]
        want += [(i, *x, n) for n, x in enumerate([*nodes, (3 * len(s), "")])]
    assert sorted(tuple(r) for r in C.lattice_nodes(proteins, table).collect()) == sorted(want)
