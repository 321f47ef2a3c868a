"""Analytics, lattices with motifs, structures, parsers and readers against brute force."""

import gzip
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import analytics as A
from strandloom.operators import coding as C
from strandloom.operators import frontier as X
from strandloom.operators import motif_free as M
from strandloom.operators import ordered as O
from strandloom.operators import records as R
from strandloom.operators import structures as T
from strandloom.plans import campaign, catalog
from strandloom.sources import readers

RNG = np.random.default_rng(12)


def test_quantiles_of_ties_nulls_and_large_groups(spark):
    groups = {"many": RNG.lognormal(0, 4, 30_000), "ties": RNG.integers(0, 3, 5000).astype(float), "ten": RNG.normal(size=10), "two": np.array([1.0, 2.0]), "one": np.array([5.0]), None: RNG.normal(size=501)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.k, r.share): r.q for r in A.quantiles(df, ["k"], "v", shares).collect()}
    assert got.keys() == {(k, s) for k in groups for s in shares}
    for (k, s), q in got.items():
        assert q == pytest.approx(np.quantile(groups[k], s), rel=1e-12, abs=1e-12)
    d = {r.k: r for r in A.describe(df, ["k"], "v").collect()}
    assert d["none"].n == 0 and d["none"].median is None and d["many"].n == 30_000


@pytest.mark.parametrize("n", [3, 40, 400])
def test_inversions(spark, n):
    rows = [(g, int(RNG.integers(0, n // 2 + 2)), float(RNG.integers(0, n // 3 + 2))) for g in "ab" for _ in range(n)] + [("c", 1, 1.0), ("a", None, 1.0)]
    want = {}
    for g in "ab":
        own = [(x, y) for k, x, y in rows if k == g and x is not None]
        pairs = [(p, q) for p in own for q in own if p[0] < q[0]]
        if pairs:
            want[g] = sum(p[1] > q[1] for p, q in pairs), len(pairs)
    got = A.inversions(spark.createDataFrame(rows, "g string, x int, y double"), ["g"], "x", "y").collect()
    assert {r.g: (r.inverted, r.pairs) for r in got} == want


def test_weights_and_fits(spark):
    rows = [("s1", "c1", 1), ("s1", "c1", 2), ("s1", "c2", 3), (None, "c1", 4), (None, None, 5), (None, None, 6)]
    got = {r.i: r.weight for r in A.calibrated_weights(spark.createDataFrame(rows, "s string, c string, i int"), "s", "c").collect()}
    assert got == pytest.approx({1: 0.75, 2: 0.75, 3: 1.5, 4: 1.5, 5: 0.75, 6: 0.75})
    x, w = RNG.normal(1e4, 2, 200), RNG.integers(1, 5, 200).astype(float)
    y = 3 + 0.5 * x + 2 * np.maximum(x - 1e4, 0) + RNG.normal(0, 0.1, 200)
    df = spark.createDataFrame([("a", *map(float, v)) for v in zip(x, y, w, strict=True)] + [("a", None, 1.0, 1.0), ("flat", 1.0, 2.0, 1.0), ("flat", 1.0, 3.0, 1.0)], "g string, x double, y double, w double")
    line = {r.g: r for r in A.ols(df, ["g"], F.col("x"), F.col("y"), F.col("w")).collect()}
    slope, icept = np.polyfit(x, y, 1, w=np.sqrt(w))
    assert (line["a"].n, line["a"].slope, line["a"].intercept) == (200, pytest.approx(slope, rel=1e-6), pytest.approx(icept, rel=1e-5)) and line["flat"].slope is None
    assert line["a"].rmse == pytest.approx(math.sqrt((w * (y - icept - slope * x) ** 2).sum() / w.sum()), rel=1e-6)
    bent = {r.g: r for r in A.hinge(df, ["g"], F.col("x"), F.col("y"), 1e4, F.col("w")).collect()}
    m = np.stack([np.ones(200), x, np.maximum(x - 1e4, 0)], 1) * np.sqrt(w)[:, None]
    assert [bent["a"][k] for k in ("intercept", "slope", "bend")] == pytest.approx(np.linalg.lstsq(m, y * np.sqrt(w), rcond=None)[0], rel=1e-5) and bent["flat"].slope is None


def test_trade_offs(spark):
    points = [(float(c), float(10 / c + RNG.normal(0, 0.3))) for c in range(1, 12)]
    df = spark.createDataFrame([("a", *p) for p in points], "g string, c double, e double")
    got = {r.c: r for r in X.support(df, df, ["g"], "c", "e", search_end=50.0).collect()}
    assert len(got) == len(points)
    for t in np.linspace(0, 12, 601):
        best = min(points, key=lambda p: p[1] + t * p[0])
        r = got[best[0]]
        assert r.supported and r.low - 1e-6 <= t and (r.unbounded or t <= r.high + 1e-6)
    for c, e in points:
        if not got[c].supported:
            assert got[c].low is got[c].high is got[c].representative is None and not got[c].unbounded
            assert all(min(p[1] + t * p[0] for p in points) < e + t * c for t in np.linspace(0, 40, 2000))
        else:
            t = got[c].representative
            assert e + t * c <= min(p[1] + t * p[0] for p in points) + 1e-6
    assert got[1.0].unbounded and got[1.0].representative == 50.0


def test_trade_offs_of_given_targets(spark):
    """On a line between two points, above it, below it, and as costly as a point."""
    lines = spark.createDataFrame([("a", c, e) for c, e in ((0.0, 4.0), (1.0, 2.0), (3.0, 0.0), (2.0, 3.0), (None, 0.0))], "g string, c double, e double")
    targets = spark.createDataFrame([("a", 2.0, 1.0), ("a", 2.0, 1.1), ("a", 2.0, 0.5), ("a", 1.0, 2.0 + 1e-9), ("a", 1.0, 2.1), ("b", 5.0, 5.0), (None, 1.0, 1.0), ("a", None, 1.0)], "g string, c double, e double")
    got = {(r.g, r.c, r.e): r for r in X.support(targets, lines, ["g"], "c", "e").collect()}
    assert len(got) == 7
    on, above, below, near, worse = (got["a", c, e] for c, e in ((2.0, 1.0), (2.0, 1.1), (2.0, 0.5), (1.0, 2.0 + 1e-9), (1.0, 2.1)))
    assert on.supported and on.low == on.high == on.representative == 1.0
    assert not above.supported and not worse.supported and near.supported
    assert below.supported and (below.low, below.high) == (0.5, 1.5)
    assert got["b", 5.0, 5.0].unbounded and got["b", 5.0, 5.0].representative == 1.0 and got[None, 1.0, 1.0].unbounded


@pytest.mark.parametrize("eps", [(0.0, 0.0), (0.5, 0.0), (0.3, 2.0), (5.0, 50.0)])
def test_frontiers_with_tolerances(spark, monkeypatch, eps):
    """One group holds most rows, dealt over many tasks that hold few at a time."""
    monkeypatch.setattr(X, "HELD", 40)
    rows = [(("hot" if i % 10 else None if i % 3 else "cold"), float(x), float(y)) for i, (x, y) in enumerate(zip(RNG.integers(0, 60, 1500) / 4, RNG.integers(0, 90, 1500), strict=True))]
    df = spark.createDataFrame([*rows, *rows[:30], ("hot", None, 0.0), ("hot", 0.0, None)], "g string, x double, y double").repartition(7)
    want = set()
    for g in {g for g, _, _ in rows}:
        p = {(x, y) for h, x, y in rows if h == g}
        want |= {(g, *a) for a in p if not any(b[0] <= a[0] + eps[0] and b[1] <= a[1] + eps[1] and (b[0] < a[0] - eps[0] or b[1] < a[1] - eps[1]) for b in p)}
    got = [tuple(r) for r in X.pareto(df, ["g"], "x", "y", *eps).collect()]
    assert len(got) == len(want) and set(got) == want
    assert X.pareto(df.limit(0), ["g"], "x", "y", *eps).collect() == []


def test_motif_products_by_all_sequences(spark):
    w = C.weights(catalog._table(spark))
    cost: dict = {}
    for r in w.collect():
        cost.setdefault(r.aa, {})[r.codon] = r.neg_log_w
    proteins = {1: "MF", 2: "SSL", 3: "EF", 4: "M", 5: "", 6: None, 7: "RSLE", 8: "EFX"}
    df = spark.createDataFrame(list(proteins.items()), "protein_id long, seq string")
    for motifs in (["GAATTC"], ["AUG", "UCU"], ["A"], ["UCUUCU", "AGCAGC"], ["GGGGGGG", "agc"]):
        rna = [m.upper().replace("T", "U") for m in motifs]
        got = {r.protein_id: r for r in M.motif_product(df, w, spark.createDataFrame([("s", m) for m in motifs], "motifset_id string, motif string")).collect()}
        assert got.keys() == {1, 2, 3, 4, 7, 8}
        for i, r in got.items():
            every = {"".join(c): sum(cost[a][x] for a, x in zip(proteins[i], c, strict=True)) for c in itertools.product(*(cost.get(a, {}) for a in proteins[i]))}
            free = {s: v for s, v in every.items() if not any(m in s for m in rna)}
            assert r.feasible == bool(free) and (r.cost == pytest.approx(min(free.values())) and free[r.cds] == pytest.approx(r.cost) if free else r.cost is r.cds is None)
            # nodes and edges: what the free prefixes reach, walked letter by letter
            steps = {(t.state, t.nuc): t.next_state for t in C.motif_transitions(spark.createDataFrame([("s", m) for m in motifs], "motifset_id string, motif string")).collect()} if i == 2 else None
            if steps is not None:
                layer, nodes, edges = {("", "")}, 0, 0
                for at in range(3 * len(proteins[i])):
                    aa, k = proteins[i][at // 3], at % 3
                    met = {((p, s), c[k], (c[: k + 1] if k < 2 else "", t)) for p, s in layer for c in cost[aa] if c.startswith(p) and (t := steps.get((s, c[k]))) is not None}
                    nodes, edges, layer = nodes + len(layer), edges + len(met), {q for _, _, q in met}
                assert (r.nodes, r.edges) == (nodes + bool(layer), edges)


def test_motif_product_in_segments(spark):
    """Long proteins in segments are as when walked in one piece, and as a plain walk over states."""
    w = C.weights(catalog._table(spark))
    codons: dict = {}
    for r in w.collect():
        codons.setdefault(r.aa, []).append((r.codon, r.neg_log_w))
    proteins = {i: "".join(RNG.choice([*"ACDEFGHIKLMNPQRSTVWY"], n)) for i, n in enumerate((1, 5, 6, 7, 40, 41, 300, 2000))}
    proteins |= {20: "RSLE" * 30 + "X" + "M" * 9, 21: "EF" * 20}
    df = spark.createDataFrame(list(proteins.items()), "protein_id long, seq string")
    for motifs in (["UCUUCU", "AGCAGC", "GAATTC"], ["GAATTC", "GAGUUC", "GAAUUU", "GAGUUU"]):
        sets = spark.createDataFrame([("s", m) for m in motifs], "motifset_id string, motif string")
        whole, cut = ({r.protein_id: r for r in M.motif_product(df, w, sets, n).collect()} for n in (1 << 12, 5))
        steps = {(r.state, r.nuc): r.next_state for r in C.motif_transitions(sets).collect()}
        assert whole.keys() == cut.keys() == proteins.keys()
        for i, seq in proteins.items():
            best = {"": 0.0}
            for aa in seq:
                after: dict = {}
                for s, v in best.items():
                    for c, x in codons.get(aa, ()):
                        t = s
                        for n in c:
                            t = steps.get((t, n)) if t is not None else None
                        if t is not None:
                            after[t] = min(after.get(t, math.inf), v + x)
                best = after
            for r in (whole[i], cut[i]):
                assert (r.nodes, r.edges, r.feasible) == (whole[i].nodes, whole[i].edges, bool(best))
                if best:
                    assert r.cost == pytest.approx(min(best.values())) and not any(m.replace("T", "U") in r.cds for m in motifs)
                    spelled = [r.cds[k : k + 3] for k in range(0, len(r.cds), 3)]
                    assert len(spelled) == len(seq) and sum(dict(codons[a])[c] for a, c in zip(seq, spelled, strict=True)) == pytest.approx(r.cost)
                else:
                    assert r.cost is r.cds is None


def test_lattice_spells_the_language(spark):
    """Paths of the lattice's edges are the enumerated sequences, each once."""
    w = C.weights(catalog._table(spark))
    one = spark.createDataFrame([(1, "MFLR")], "protein_id long, seq string")
    edges: dict = {}
    for e in C.lattice_edges(one, w).collect():
        edges.setdefault((e.src_pos, e.src), []).append((e.dst, e.nuc, e.weight))
    paths = [("", "", 0.0)]
    for at in range(12):
        paths = [(d, s + n, c + x) for p, s, c in paths for d, n, x in edges[at, p]]
    spelled = {r.cds: r.penalty for r in C.enumerated(one, w, 4).collect()}
    assert len(paths) == len(spelled) == 72 and {s: pytest.approx(c) for _, s, c in paths} == spelled


def test_unknown_residues_and_codons(spark):
    w = C.weights(catalog._table(spark))
    df = spark.createDataFrame([(1, "MFL"), (2, "MXFB"), (3, ""), (4, None)], "protein_id long, seq string")
    odd = C.unknown_residues(df, catalog._table(spark))
    assert {tuple(r) for r in odd.collect()} == {(1, 0, None), (2, 2, "X"), (3, 0, None)}
    with pytest.raises(Exception, match="unknown residue: 2"):
        R.demanded(odd, F.col("unknown") == 0, "unknown residue").collect()
    cds = C.codon_penalty(spark.createDataFrame([(1, "AUGUUU"), (2, "AUGXXX"), (3, "AU"), (4, ""), (5, None)], "protein_id long, cds string"), w)
    got = {r.protein_id: r.penalty for r in cds.collect()}
    assert got[2] == math.inf and got[3] is got[5] is None and got[4] == 0 and 0 < got[1] < 9
    with pytest.raises(Exception, match="codon: 2"):
        R.demanded(cds.where("protein_id < 3"), F.col("penalty") < float("inf"), "codon").collect()


def test_random_loops(spark):
    def build(n):
        out = ""
        while len(out) < n:
            out += "." * RNG.integers(0, 4) + (f"({build(n // 2 - 2)})" if n > 8 and RNG.random() < 0.7 else "")
            n -= 1
        return out

    texts = {i: build(40) for i in range(30)} | {90: "", 91: "...", 92: None}
    want = {}
    for i, t in texts.items():
        stack: list = []
        for k, c in enumerate(t or ""):
            if c == "(":
                stack.append([k, 0, 0])
            elif c == ")":
                at, branches, unpaired = stack.pop()
                want[i, at, k] = branches, unpaired
                if stack:
                    stack[-1][1] += 1
            elif stack:
                stack[-1][2] += 1
    got = T.loops(spark.createDataFrame(list(texts.items()), "id long, structure string"))
    assert {(r.id, r.i, r.j): (r.branches, r.unpaired) for r in got.collect()} == want


def test_readers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    two = put("two.fa", ">a one\nMF\nl\n\n>b\nAC D\n")
    assert [(r.header, r.seq) for r in readers.fasta(spark, two).orderBy("header").collect()] == [(">a one", "MFL"), (">b", "ACD")]
    with pytest.raises(Exception, match="no single protein"):
        readers.fasta(spark, two, single=True).collect()
    assert [(r.header, r.seq) for r in readers.fasta(spark, put("raw.txt", "mfl\nA\n"), single=True).collect()] == [(">designed", "MFLA")]
    for bad in (">a\n>b\nMF\n", "MF\n>a\nMF\n", ">a\n"):
        with pytest.raises(Exception, match="no single protein"):
            readers.fasta(spark, put("bad.fa", bad)).collect()
    got = readers.codon_table(spark, put("t.csv", "﻿# usage\naug , M,1\nAUGG,M,1\nuuu,F\n GCT,Alanine, 0.5,x\nGCA,,0.5\n\n")).collect()
    assert {(r.codon, r.aa, r.freq) for r in got} == {("AUG", "M", 1.0), ("GCU", "A", 0.5)}
    for bad in ("AUG,M,nan", "AUG,M,inf", "AUG,M,-0.1", "AUG,M,1x"):
        with pytest.raises(Exception, match="bad frequency"):
            readers.codon_table(spark, put("bad.csv", bad)).collect()
    with pytest.raises(ValueError, match="no codons"):
        readers.codon_table(spark, put("none.csv", "# nothing\n"))
    code = catalog._table(spark).select("codon", "aa")
    lines = [f"{c},{a},{f}" for c, a, f in catalog.CODONS]
    assert readers.strict_codon_table(spark, put("whole.csv", "\n".join(lines)), code).count() == 64
    for bad in (lines[1:], [*lines, lines[0]], ["UUU,L,1", *lines[1:]], ["UUU,F,0", *lines[1:]]):
        with pytest.raises(ValueError, match="no whole code"):
            readers.strict_codon_table(spark, put("part.csv", "\n".join(bad)), code)
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("a,b\n1,x\n2,\n")
    assert [tuple(r) for r in readers.strict_csv(spark, f"file://{tmp_path}/x.csv.gz", "a int, b string").collect()] == [(1, "x"), (2, None)]
    for bad in ("b,a\n1,x\n", "a,b\nx,y\n"):
        with pytest.raises(Exception):  # noqa: B017
            readers.strict_csv(spark, put("y.csv", bad), "a int, b string").collect()
    assert {tuple(r) for r in readers.clusters(spark, put("c.tsv", "p\tp\np\tq\n")).collect()} == {("p", "p"), ("p", "q")}
    assert readers.records(spark, put("d.jsonl", '{"id": 1, "x": {"a": 2}}\n{"id": 2}\n'), "id int, x struct<a:int>").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        readers.records(spark, put("e.jsonl", '{"id": 1\n'), "id int").collect()


def test_campaign_queries_are_registered():
    assert campaign.query is catalog.query and "hinge_fit" in catalog.QUERIES and "hinge_fit" in catalog.SQL


def test_solving_linear_equations(spark):
    for n in (1, 2, 3, 5):
        systems = {i: RNG.normal(0, 1, (n, n + 1)).round(3) for i in range(20)}
        systems[20] = np.array([[0.0] * n + [1.0]] * n)  # singular
        systems[21] = np.vstack([systems[0][: n - 1], systems[0][: n - 1].sum(0)]) if n > 1 else systems[20]
        systems[22] = np.hstack([np.fliplr(np.eye(n)), np.ones((n, 1))])  # zeros on the diagonal: rows must be swapped
        df = spark.createDataFrame([(i, m.tolist()) for i, m in systems.items()] + [(23, None)], "i int, m array<array<double>>")
        got = {r.i: r.x for r in df.select("i", A.solved(F.col("m"), n).alias("x")).collect()}
        assert got[20] is got[21] is got[23] is None
        for i, m in systems.items():
            if i not in (20, 21):
                assert got[i] == pytest.approx(np.linalg.solve(m[:, :n], m[:, n]).tolist(), rel=1e-6, abs=1e-9)


def test_lines_with_knots(spark):
    x = np.linspace(0, 10, 80)
    y = 1 + 2 * x + 3 * np.maximum(x - 3, 0) - 4 * np.maximum(x - 7, 0) + RNG.normal(0, 0.1, 80)
    rows = [("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("flat", 1.0, float(k)) for k in range(5)] + [("low", k / 10, float(k)) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in A.knots(df, ["g"], F.col("x"), F.col("y"), [3.0, 7.0]).collect()}
    m = np.stack([np.ones(80), x, np.maximum(x - 3, 0), np.maximum(x - 7, 0)], 1)
    want, sse, *_ = np.linalg.lstsq(m, y, rcond=None)
    assert [got["a"].intercept, got["a"].slope, *got["a"].bends] == pytest.approx(want.tolist(), rel=1e-6) and got["a"].sse == pytest.approx(sse[0], rel=1e-5)
    assert got["flat"].bends is got["low"].bends is got["low"].slope is None and got["low"].n == 9


def test_slope_schemes(spark):
    """Estimates against weighted least squares; draws of one cluster in each of two strata can lose one."""
    rows = [(f"h{i % 2}", f"c{i % 7}", str(i), float(x), float(2 * x + e), float(3 * x - e)) for i, (x, e) in enumerate(zip(RNG.normal(0, 1, 300), RNG.normal(0, 0.2, 300), strict=True))]
    df = spark.createDataFrame([*rows, ("h0", "c0", "x", None, 1.0, 1.0)], "h string, c string, k string, x double, y double, z double")
    arms = {"y": F.col("y"), "z": F.col("z")}
    got = {(r.scheme, r.arm): r for r in A.slope_bootstrap(df, "h", "c", "k", F.col("x"), arms, 60).collect()}
    assert {s for s, _ in got} == set(A.SCHEMES) and len(got) == 8
    size = {c: sum(r[1] == c for r in rows) for c in {r[1] for r in rows}}
    for (scheme, arm), r in got.items():
        w = np.array([1.0 if "equal" not in scheme else 1 / size[c] for _, c, *_ in rows])
        if scheme == "calibrated_equal_cluster":
            for h in ("h0", "h1"):
                mine = np.array([a[0] == h for a in rows])
                w[mine] *= mine.sum() / w[mine].sum()
        x, y = np.array([a[3] for a in rows]), np.array([a[4 if arm == "y" else 5] for a in rows])
        assert r.estimate == pytest.approx(np.polyfit(x, y, 1, w=np.sqrt(w))[0]) and r.low <= r.estimate <= r.high and r.high - r.low < 0.3 and r.lost == 0
    lone = spark.createDataFrame([(f"h{i % 2}", f"c{i % 2}", str(i), float(i), float(i * i), 1.0) for i in range(20)], "h string, c string, k string, x double, y double, z double")
    lost = {(r.scheme, r.arm): r.lost for r in A.slope_bootstrap(lone, "h", "c", "k", F.col("x"), arms, 60).collect()}
    assert lost["cluster", "y"] == lost["calibrated_equal_cluster", "z"] > 10 and lost["within", "y"] == 0


@pytest.mark.parametrize("width", [5, 1 << 16])
def test_order_and_islands(spark, width):
    """Ranges of few places, so that what is carried over takes several levels; gaps and negative places."""
    places = sorted(RNG.choice(np.arange(-40, 120), 60, replace=False).tolist())
    keys = RNG.choice(["a", "b", None], 60).tolist()
    df = spark.createDataFrame([*zip(places, keys, strict=True), (None, "a")], "p long, k string").repartition(3)
    got = sorted(O.in_order(df, "p", width=width).collect(), key=lambda r: r.rank)
    assert [(r.p, r.k, r.rank) for r in got] == [(p, k, i + 1) for i, (p, k) in enumerate(zip(places, keys, strict=True))]
    assert [r.previous and r.previous.p for r in got] == [None, *places[:-1]]
    want = [(k, run[0][0], run[-1][0], len(run)) for k, g in itertools.groupby(zip(places, keys, strict=True), lambda x: x[1]) for run in [list(g)]]
    assert sorted(((r.k, r["first"], r["last"], r.n) for r in O.islands(df.where("p is not null"), "p", "k", width).collect()), key=lambda x: x[1]) == want


def test_pairs_each_rule_broken_once(spark):
    rows, broken = [], {1: "arms", 2: "adjacent", 3: "order", 4: "equal", 5: "close", 6: None}
    first = {b: int(__import__("hashlib").md5(f"5:{b}".encode()).hexdigest()[:8], 16) % 2 for b in broken}
    at = 0
    for b in broken:
        arms = ["sparse", "dense"] if first[b] == 0 else ["dense", "sparse"]
        if b == 3:
            arms.reverse()
        for k, arm in enumerate(arms):
            at += 1
            rows.append([at, b, "dense" if b == 1 and arm == "sparse" else arm, "x" if b != 4 or k else "y", 1.0 if b != 5 or k else 9.0])
            if b == 2 and not k:
                at += 1
                rows.append([at, 7, "sparse", "x", 1.0])
    df = spark.createDataFrame(rows, "p long, b long, arm string, e string, v double")
    got = {r.b: r for r in O.pair_faults(df, "b", "arm", "p", ["e"], "v", ("sparse", "dense"), seed=5, absolute=0.1, relative=0.0, width=4).collect()}
    for b, rule in broken.items():
        bad = {k for k in ("arms", "adjacent", "order", "equal", "close") if not got[b][k]}
        assert (rule in bad if rule else not bad) and got[b].ok == (not bad)
        assert bad <= ({"arms", "order", "close"} if b == 1 else {rule})


def test_plan_faults(spark):
    tasks = spark.createDataFrame([(k,) for k in range(200)], "k long")
    plan = O.planned_order(tasks, "k", 3, width=16)
    places = {r.k: r.place for r in plan.collect()}
    assert sorted(places.values()) == list(range(1, 201)) and list(places.values()) != sorted(places.values())
    seen = [(k, p) for k, p in places.items() if k not in (5, 6)] + [(9, places[9]), (777, 1)]
    seen = [(k, {10: places[11], 11: places[10]}.get(k, p)) for k, p in seen]
    got = {r.k: (r.status, r.planned, r.recorded) for r in O.plan_faults(plan, spark.createDataFrame(seen, "k long, place long"), "k", "place").collect()}
    assert got == {5: ("missing", 1, 0), 6: ("missing", 1, 0), 9: ("extra", 1, 2), 777: ("extra", 0, 1), 10: ("misplaced", 1, 1), 11: ("misplaced", 1, 1)}


def test_loop_flanks(spark):
    """Branches and gaps of random structures, against a stack."""
    texts = {1: "((..((...))..(....).))", 2: "(...)(....)", 3: "....", 4: "", 5: "(" * 40 + "..." + ")" * 40}
    for k in range(6, 30):
        out, depth = "", 0
        while len(out) < 120:
            c = RNG.choice([*"(()..)"])
            depth += {"(": 1, ")": -1}.get(c, 0) if c != ")" or depth else 0
            out += c if c != ")" or depth or out.count("(") > out.count(")") else "."
        texts[k] = out + ")" * (out.count("(") - out.count(")"))
    want = set()
    for t, x in texts.items():
        stack, pair, children = [], {}, {}
        for i, c in enumerate(x):
            if c == "(":
                children.setdefault(stack[-1] if stack else None, []).append(i)
                stack.append(i)
            elif c == ")":
                pair[stack.pop()] = i
        for p, bs in children.items():
            for k, i in enumerate(bs if p is not None else []):
                want.add((t, p, k + 1, i, pair[i], i - (pair[bs[k - 1]] if k else p) - 1, pair[p] - pair[i] - 1 if k == len(bs) - 1 else None))
    got = [tuple(r) for r in T.flanks(spark.createDataFrame(list(texts.items()), "id long, structure string")).collect()]
    assert len(got) == len(want) and set(got) == want
    lines = {1: "One two\n\n(three) Four5é", 2: "", 3: "\n", 4: "[x] {Y}"}
    made = {r.id: r.s for r in spark.createDataFrame(list(lines.items()), "id long, t string").select("id", S.brackets(F.col("t")).alias("s")).collect()}
    assert made == {1: "((.(...)).(...))(.(.....)..(.(....))..)", 2: "()", 3: "()()", 4: "(.(.)...(.(.)).)"}


def test_case_summaries_of_few_invalid_and_null_pairs(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", i, 1.0 + i, 2.0 + 3 * i, i, 10 - i) for i in range(9)] + [("a", 90, 0.0, 1.0, None, 5), ("a", 91, inf, 1.0, 5, 5), ("a", 92, nan, 1.0, 5, 5), ("b", 1, 2.0, 4.0, 1, 1), ("b", 2, 4.0, 2.0, 1, 2), (None, 1, 2.0, 6.0, 1, 4), ("none", 1, None, 1.0, None, None)]
    pairs = spark.createDataFrame(rows, "g string, id int, ours double, theirs double, low int, high int")
    got = {r.g: r for r in A.case_summaries(pairs, ["g"], "id", {"wall": ("ours", "theirs")}, {"rss": ("low", "high")}, ["id"], 30).collect()}
    ratios = np.array([(2.0 + 3 * i) / (1.0 + i) for i in range(9)])
    a = got["a"]
    assert (a.pairs, a.wall_invalid, a.id_min, a.id_max) == (12, 3, 0, 92)
    assert np.allclose([a.wall_min, a.wall_q1, a.wall_median, a.wall_q3, a.wall_max], np.quantile(ratios, [0, 0.25, 0.5, 0.75, 1]))
    u = [[int(hashlib.md5(f"7:{draw}:{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(9)] for draw in range(1, 31)]
    medians = [np.median(np.repeat(ratios, [sum(x > c for c in A.POISSON) for x in us])) for us in u]
    assert np.allclose([a.wall_ci95_low, a.wall_ci95_high], np.quantile(medians, [0.025, 0.975]))
    assert (got["b"].wall_median, got["b"].wall_ci95_low, got["b"].wall_ci95_high, got["b"].rss_max) == (1.25, None, None, 1)  # two pairs have no interval
    assert (got[None].wall_median, got[None].rss_median) == (3.0, 3.0)
    assert (got["none"].pairs, got["none"].wall_invalid, got["none"].wall_median, got["none"].rss_max) == (1, 1, None, None)
