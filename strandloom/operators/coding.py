"""Codon weights, coding sequences, lattices and motifs as DataFrame plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S


def weights(table: DataFrame) -> DataFrame:
    """Relative adaptiveness w = freq / greatest freq of the residue, at least FLOOR where it is
    zero, and -ln w. table: table_id, codon, aa, freq."""
    top = F.max("freq").over(W.partitionBy("table_id", "aa"))
    w = F.when(F.col("freq") > 0, F.col("freq") / top).otherwise(F.lit(S.FLOOR))
    return table.withColumn("w", w).withColumn("neg_log_w", -F.log("w"))


def best_codons(weighted: DataFrame) -> DataFrame:
    """The codon of least cost for each residue, the first by name where several are."""
    return weighted.groupBy("table_id", "aa").agg(F.min_by("codon", F.struct("neg_log_w", "codon")).alias("codon"), F.min("neg_log_w").alias("cost"))


def residues(proteins: DataFrame) -> DataFrame:
    """protein_id, pos, aa."""
    return proteins.select("protein_id", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "aa"))


def _id(df: DataFrame) -> str:
    return f"protein_id {df.schema['protein_id'].dataType.simpleString()}"


def _total(counts: dict[str, Column], of: dict[str, float]) -> Column:
    """Sum over counted residues of what of has for each."""
    return sum((counts[a] * F.lit(float(v)) for a, v in of.items()), F.lit(0.0))


def _figures(proteins: DataFrame, aas, use, wanted=lambda f: f["known"] > 0) -> DataFrame:
    """protein_id and the columns that use(seq, counts) gives by name, for proteins with a residue
    of aas (or else wanted by their figures). A row's sequence is worked out once and each letter
    counted once; the rows are chosen by a generator, below which no filter is pushed."""
    known = lambda n: sum(n.values(), F.lit(0)).cast("long")
    row = S.counted(F.col("seq"), aas, lambda s, n: F.struct(known(n).alias("known"), F.length(s).cast("long").alias("size"), *(v.alias(k) for k, v in use(s, n).items())))
    made = proteins.select("protein_id", F.explode(F.filter(F.array(row), lambda f: F.coalesce(wanted(f), F.lit(False)))).alias("f"))
    return made.select("protein_id", "f.*").drop("known", "size")


def best_cds(proteins: DataFrame, weighted: DataFrame) -> DataFrame:
    """protein_id, cds, penalty of the coding sequence of least codon cost. A row is spelled in
    one piece, whatever its length; the codon table has at most 64 rows."""
    return best_designs(proteins, {"": weighted}).select("protein_id", F.col("cds_").alias("cds"), F.col("penalty_").alias("penalty"))


def best_designs(proteins: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """best_cds under several tables of the same residues in one row: protein_id, and cds_ and penalty_
    followed by each table's name."""
    best = {t: best_codons(w).collect() for t, w in tables.items()}
    codon, cost = ({t: {r.aa: r[c] for r in rows} for t, rows in best.items()} for c in ("codon", "cost"))
    figures = lambda s, n: {k: v for t in tables for k, v in ((f"cds_{t}", S.spelled(s, codon[t])), (f"penalty_{t}", _total(n, cost[t])))}
    return _figures(proteins, codon[next(iter(tables))], figures)


def least_cost(proteins: DataFrame, weighted: DataFrame) -> DataFrame:
    """protein_id, cost, n: the least codon cost and the number of residues."""
    cost = {r.aa: r.cost for r in best_codons(weighted).collect()}
    return _figures(proteins, cost, lambda s, n: {"cost": _total(n, cost), "n": sum(n.values(), F.lit(0)).cast("long")})


def unknown_residues(proteins: DataFrame, table: DataFrame) -> DataFrame:
    """protein_id, unknown, first_unknown: how many residues of each protein have no codon in the
    table, and the first of them. Proteins with any are to be kept apart, or are an error:
    records.demanded(..., unknown == 0, "unknown residue")."""
    aas = "".join(f"\\{r.aa}" if r.aa == "*" else r.aa for r in table.select("aa").distinct().collect())  # at most 64
    found = lambda o: F.struct(F.length(o).cast("long").alias("unknown"), F.when(F.length(o) > 0, F.substring(o, 1, 1)).alias("first_unknown"))
    odd = S.once(F.regexp_replace("seq", f"[{aas}]", ""), found)
    return proteins.select("protein_id", F.explode(F.filter(F.array(odd), lambda f: f["unknown"].isNotNull())).alias("f")).select("protein_id", "f.*")


def penalty(cds: Column, weighted: DataFrame) -> Column:
    """Summed cost of a coding sequence's codons: infinite with an unknown codon. Each sequence's
    codons are counted, in a batch of sequences."""
    place = np.full(256, 4)
    place[[ord(c) for c in "ACGU"]] = range(4)
    cost = np.full(125, np.inf)
    for r in weighted.select("codon", "neg_log_w").collect():  # at most 64 rows
        cost[place[[ord(x) for x in r.codon]] @ [25, 5, 1]] = r.neg_log_w

    def total(text: str | None) -> float | None:
        if text is None:
            return None
        x = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
        x = place[x] if len(x) % 3 == 0 else x[:0]
        many = np.bincount(x[::3] * 25 + x[1::3] * 5 + x[2::3], minlength=125)
        return float(many[many > 0] @ cost[many > 0])

    @F.pandas_udf("double")
    def totals(texts: pd.Series) -> pd.Series:
        return pd.Series([total(t) for t in texts], dtype="float64")

    return totals(cds)


def codon_penalty(sequences: DataFrame, weighted: DataFrame) -> DataFrame:
    """protein_id, penalty of coding sequences (protein_id, cds): infinite with an unknown codon,
    null where the length is no multiple of three (an error in strict use: records.demanded)."""
    total = penalty(F.col("cds"), weighted)
    return sequences.select("protein_id", F.when(F.length("cds") % 3 == 0, total).alias("penalty"))


def precision_pairs(designs: DataFrame, weighted: DataFrame, by: list[str], full: str, rounded: str) -> DataFrame:
    """For each case (by, trade_off) designed with a full and a rounded codon table: same_sequence,
    mfe_difference (rounded - full), regret (what the rounded table's sequence loses of the full
    table's objective) and candidate_ratio (null where the full one has no candidates).

    designs: by, trade_off, table, rna, mfe, objective, candidates; one row of each table. Both
    come to a case in one aggregation; cases with one of them only are left out. weighted: the full
    table's weights. The regret is infinite where that table lacks a codon."""
    of = lambda t, c: F.max(F.when(F.col("table") == t, F.col(c))).alias(f"{c}_{t}")
    met = designs.where(F.col("table").isin(full, rounded)).groupBy(*by, "trade_off").agg(*(of(t, c) for t in (full, rounded) for c in _DESIGN))
    return compared(met, weighted, by, full, rounded)


_DESIGN = ("rna", "mfe", "objective", "candidates")


def compared(cases: DataFrame, weighted: DataFrame, by: list[str], full: str, rounded: str) -> DataFrame:
    """precision_pairs of cases that have both designs in one row: by, trade_off and each column of a
    design followed by _ and its table's name."""
    f, r = ({c: F.col(f"{c}_{t}") for c in _DESIGN} for t in (full, rounded))
    both = cases.where(f["rna"].isNotNull() & r["rna"].isNotNull())
    common = r["mfe"] + F.col("trade_off") * penalty(r["rna"], weighted)
    return both.select(
        *by, "trade_off", (f["rna"] == r["rna"]).alias("same_sequence"), (r["mfe"] - f["mfe"]).alias("mfe_difference"), (common - f["objective"]).alias("regret"), F.try_divide(r["candidates"], f["candidates"]).alias("candidate_ratio"),
    )


def fixed_path(sequences: DataFrame) -> DataFrame:
    """protein_id, pos, nuc, weight: the lattice of one given RNA: an edge of no weight from each
    place to the next."""
    return sequences.select("protein_id", F.posexplode(F.filter(F.split("rna", ""), lambda c: c != "")).alias("pos", "nuc")).withColumn("weight", F.lit(0.0))


def first_cds(proteins: DataFrame, table: DataFrame) -> DataFrame:
    """protein_id, cds: the first coding sequence of each protein by name."""
    codon = {r.aa: r.codon for r in table.groupBy("aa").agg(F.min("codon").alias("codon")).collect()}
    return _figures(proteins, codon, lambda s, n: {"cds": S.spelled(s, codon)})


def spellings(proteins: DataFrame, weighted: DataFrame) -> DataFrame:
    """protein_id, log10_n, first_cds, least, most over all coding sequences of each protein,
    without making them: their number is a product over residues (kept as its logarithm), the
    penalties' bounds are sums. A protein with a residue that has no codon has no sequence."""
    rows = weighted.groupBy("aa").agg(F.count("*").alias("n"), F.min("codon").alias("codon"), F.min("neg_log_w").alias("least"), F.max("neg_log_w").alias("most")).collect()
    of = lambda k: {r.aa: r[k] for r in rows}
    choices = {a: float(np.log10(k)) for a, k in of("n").items()}
    figures = lambda s, n: {"log10_n": _total(n, choices), "first_cds": S.spelled(s, of("codon")), "least": _total(n, of("least")), "most": _total(n, of("most"))}
    return _figures(proteins, choices, figures, lambda f: (f["size"] > 0) & (f["known"] == f["size"]))


def enumerated(proteins: DataFrame, weighted: DataFrame, longest: int) -> DataFrame:
    """protein_id, cds, penalty: every coding sequence, one row each. Their number is exponential
    in the length, so proteins of more than `longest` residues are an error; for those: spellings."""
    choices: dict[str, list] = {}
    for r in weighted.select("aa", "codon", "neg_log_w").collect():  # at most 64 rows
        choices.setdefault(r.aa, []).append(F.struct(F.lit(r.codon).alias("c"), F.lit(float(r.neg_log_w)).alias("w")))
    of = F.create_map(*(x for aa, cs in choices.items() for x in (F.lit(aa), F.array(*cs))))
    fits = F.when(F.length("seq") > longest, F.raise_error(F.lit("protein too long to enumerate"))).otherwise(F.col("seq"))
    rows = proteins.where(F.length("seq") > 0).select("protein_id", fits.alias("seq"), F.lit("").alias("cds"), F.lit(0.0).alias("penalty"))
    ended = F.array(F.struct(F.lit("").alias("c"), F.lit(0.0).alias("w")))
    for i in range(longest):
        step = F.explode(F.when(F.length("seq") <= i, ended).otherwise(of[F.substring("seq", i + 1, 1)]))
        rows = rows.withColumn("_s", step).select("protein_id", "seq", F.concat("cds", "_s.c").alias("cds"), (F.col("penalty") + F.col("_s.w")).alias("penalty"))
    return rows.select("protein_id", "cds", "penalty")


def cai(sequences: DataFrame, weighted: DataFrame) -> DataFrame:
    """protein_id, cai, penalty, protein of coding sequences (protein_id, cds), each read in one pass."""
    place = np.full(128, 4)
    place[[ord(c) for c in "ACGU"]] = range(4)
    log_w, cost, aa = np.full(125, np.log(S.FLOOR)), np.full(125, np.nan), np.full(125, ord("?"), np.uint8)
    for r in weighted.select("codon", "aa", "w", "neg_log_w").collect():  # at most 64 rows
        a, b, c = place[[ord(x) for x in r.codon]]
        k = a * 25 + b * 5 + c
        log_w[k], cost[k], aa[k] = np.log(r.w if r.w > 0 else S.FLOOR), r.neg_log_w, ord(r.aa)

    def run(batches):
        for batch in batches:
            keep, out = [], ([], [], [])
            for i, cds in enumerate(batch["cds"].to_pylist()):
                if not cds or len(cds) % 3:
                    continue
                x = place[np.frombuffer(cds.encode("ascii", "replace"), np.uint8)].reshape(-1, 3) @ np.array([25, 5, 1])
                known = cost[x][~np.isnan(cost[x])]
                keep.append(i)
                out[0].append(float(np.exp(log_w[x].mean())))
                out[1].append(float(known.sum()) if len(known) else None)
                out[2].append(aa[x].tobytes().decode())
            ids = batch["protein_id"].take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.float64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.string())], ["protein_id", "cai", "penalty", "protein"])

    return sequences.select("protein_id", "cds").mapInArrow(run, f"{_id(sequences)}, cai double, penalty double, protein string")


#: Residues of a stretch, residues that are laid out together, those of a list, node numbers of a block.
STRETCH, TOGETHER, LISTED, BLOCK = 1 << 14, 1 << 22, 1 << 8, 1 << 7


def _stretches(batches, width: np.ndarray, stretch: int, together: int):
    """Lists of (id as an array of one, place, residues, whether these are the protein's last, the sum
    of width before them) of at most `together` residues. The first stretches of proteins are kept apart
    from further ones, which come last if they fit: their high places are rare, and would cost the others
    their short codes in a file's dictionary."""
    lists, sizes = ([], []), [0, 0]
    for batch in batches:
        for i, seq in enumerate(batch["seq"].to_pylist()):
            x, before = np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8), 0
            for at in range(0, len(x), stretch):
                part, k = x[at : at + stretch], int(at > 0)
                if lists[k] and sizes[k] + len(part) > together:
                    yield lists[k][:]
                    lists[k].clear()
                    sizes[k] = 0
                lists[k].append((batch["protein_id"].slice(i, 1), at, part, at + stretch >= len(x), before))
                sizes[k] += len(part)
                before += int(width[part].sum())
    yield from filter(None, lists)


def _lists(starts: np.ndarray, columns: dict, values: dict):
    """Batches of rows with `columns` and a list `at` of structs of `values`; starts: where each row's
    list begins."""
    ends = np.append(starts[1:], len(next(iter(values.values()))))
    for i in range(0, len(starts), 64):
        a, b = starts[i], ends[min(i + 64, len(starts)) - 1]
        one = pa.StructArray.from_arrays([pa.array(v[a:b]) if isinstance(v, np.ndarray) else v.slice(a, b - a) for v in values.values()], list(values))
        offsets = pa.array(np.append(starts[i : i + 64], b) - a, pa.int32())
        yield pa.RecordBatch.from_arrays([*(c[i : i + 64] for c in columns.values()), pa.ListArray.from_arrays(offsets, one)], [*columns, "at"])


def _prefixes(table: DataFrame) -> dict[str, list[tuple[int, str]]]:
    """For each residue its nodes in order: k and the distinct codon prefixes of k letters."""
    codons: dict[str, set] = {}
    for r in table.select("aa", "codon").collect():  # at most 64 rows
        codons.setdefault(r.aa, set()).add(r.codon)
    return {a: sorted({(k, c[:k]) for c in cs for k in range(3)}) for a, cs in codons.items()}


def lattice_nodes(proteins: DataFrame, table: DataFrame) -> DataFrame:
    """protein_id, pos, prefix, node: the states of each protein's codon automaton, numbered by
    position, then prefix. A residue has one node per distinct codon prefix of 0, 1 and 2.

    There are several nodes for each letter read, and how many bytes a file in columns takes for them
    hangs on their order. Many proteins are given out side by side, a block of node numbers at a time,
    those with most nodes first: numbers and positions are then much the same again and again."""
    of = list(_prefixes(table).items())
    spans, code = [], {}  # what a letter's code stands for: its nodes from a to b; a block may end within them
    for c, nodes in enumerate([*(nodes for _, nodes in of), [(0, "")]]):
        for a, b in [(0, len(nodes)), *((0, j) for j in range(1, len(nodes))), *((j, len(nodes)) for j in range(1, len(nodes)))]:
            code[c, a, b] = len(spans)
            spans.append([(n, *nodes[n]) for n in range(a, b)])
    rank, end, block, sizes = np.full(256, len(of) + 1, np.uint8), len(of), BLOCK, (STRETCH, TOGETHER // 2)
    rank[[ord(a) for a, _ in of]] = range(len(of))
    width = np.array([*(len(nodes) for _, nodes in of), 1, 0])
    span = np.zeros((len(width), width.max() + 1, width.max() + 1), np.int32)
    span[tuple(np.array(list(code)).T)] = list(code.values())

    def run(batches):
        for held in _stretches(batches, width[rank], *sizes):
            cs, rs, firsts, lasts = [], [], [], []
            for _, at, x, last, before in held:
                c = rank[x]
                r = np.flatnonzero(c <= end).astype(np.int32)
                c, r = (np.append(c[r], np.uint8(end)), np.append(r, np.int32(len(x)))) if last else (c[r], r)
                ends = before + np.cumsum(width[c])
                cs.append(c)
                rs.append(r + np.int32(at))
                firsts.append(ends - width[c])
                lasts.append(ends[-1] if len(c) else before)
            order = np.argsort(-np.array(lasts), kind="stable")
            place = np.empty(len(held), np.int32)
            place[order] = range(len(held))
            p = np.repeat(place, [len(c) for c in cs])
            c, r, first = np.concatenate(cs), np.concatenate(rs), np.concatenate(firsts)
            most = np.minimum(width[c], block - first % block)  # nodes of a residue in its first block
            again = np.repeat(np.arange(len(c), dtype=np.int32), 1 + (most < width[c]))
            tail = np.append(False, again[1:] == again[:-1])
            c, r, first, p, most = c[again], r[again], first[again], p[again], most[again]
            key = (first // block + tail) * len(held) + p
            by = np.argsort(key, kind="stable")
            key, codes = key[by], np.where(tail, span[c, most, width[c]], span[c, 0, most])[by]
            starts = np.flatnonzero(np.append(key[:1] == key[:1], key[1:] != key[:-1]))
            ids = pa.concat_arrays([one for one, *_ in held]).take(pa.array(order[key[starts] % len(held)]))
            yield from _lists(starts, {"protein_id": ids}, {"r": r[by], "c": codes, "first": first[by]})

    rows = proteins.select("protein_id", "seq").mapInArrow(run, f"{_id(proteins)}, at array<struct<r int, c int, first long>>")
    node = lambda n, k, p: F.struct(F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k"), F.lit(p).alias("p"))
    made = by_letter({i: [node(*x) for x in nodes] for i, nodes in enumerate(spans)})
    placed = rows.select("protein_id", F.explode("at").alias("at")).select("protein_id", "at.r", "at.first", F.explode(F.get(made, F.col("at.c"))).alias("s"))
    return placed.select("protein_id", (F.col("r").cast("long") * 3 + F.col("s.k")).alias("pos"), F.col("s.p").alias("prefix"), (F.col("first") + F.col("s.n")).alias("node"))


def by_letter(of: dict[int, list[Column]]) -> Column:
    """A constant array with what a letter's code stands for at the code's place."""
    none = F.slice(F.array(*next(iter(of.values()))), 1, 0)
    return F.array(*(F.array(*of[c]) if c in of else none for c in range(max(of) + 1)))


def lattice_shape(proteins: DataFrame, table: DataFrame) -> DataFrame:
    """protein_id, nodes, widest: the number of nodes and the most at one position."""
    of = _prefixes(table)
    widest = {a: max(sum(k == i for k, _ in nodes) for i in range(3)) for a, nodes in of.items()}
    nodes = lambda n: sum((n[a].cast("long") * len(x) for a, x in of.items()), F.lit(1)).cast("long")
    most = lambda n: F.greatest(F.lit(1), F.lit(1), *(F.when(n[a] > 0, x).otherwise(1) for a, x in widest.items())).cast("long")
    return _figures(proteins, of, lambda s, n: {"nodes": nodes(n), "widest": most(n)}, lambda f: f["size"] > 0)


def _edges(weighted: DataFrame) -> DataFrame:
    """aa, k, src, dst, nuc, weight: the edges of each residue, at most 192 rows."""
    codon = weighted.select("aa", "codon", "neg_log_w", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return codon.select(
        "aa", "k",
        F.substring("codon", F.lit(1), F.col("k")).alias("src"),
        F.when(F.col("k") < 2, F.substring("codon", F.lit(1), F.col("k") + 1)).otherwise(F.lit("")).alias("dst"),
        F.substring("codon", F.col("k") + 1, F.lit(1)).alias("nuc"),
        F.when(F.col("k") == 2, F.col("neg_log_w")).otherwise(F.lit(0.0)).alias("weight"),
    ).groupBy("aa", "k", "src", "dst", "nuc").agg(F.min("weight").alias("weight"))


def lattice_edges(proteins: DataFrame, weighted: DataFrame) -> DataFrame:
    """protein_id, src_pos, src, dst, nuc, weight: each edge reads one nucleotide; the third
    carries the codon's cost. src and dst are prefixes, empty at a residue's boundary.

    There are several edges for each letter read, and how many bytes a file in columns takes for them
    hangs on their order. The residues of many proteins are listed by letter, then place, and each edge
    of a letter takes the same lists: all columns but protein_id then stay the same over many rows."""
    of: dict[str, list[Column]] = {}
    for e in sorted(_edges(weighted).collect()):  # at most 192 rows
        of.setdefault(e.aa, []).append(F.struct(F.lit(e.k).alias("k"), *(F.lit(e[c]).alias(c) for c in ("src", "dst", "nuc")), F.lit(float(e.weight)).alias("weight")))
    rank = np.full(256, len(of), np.uint8)
    rank[[ord(a) for a in of]] = range(len(of))
    none, listed, sizes = len(of), LISTED, (STRETCH, TOGETHER)

    def run(batches):
        for held in _stretches(batches, rank, *sizes):
            c = rank[np.concatenate([x for _, _, x, *_ in held])]
            r = np.concatenate([np.arange(at, at + len(x), dtype=np.int32) for _, at, x, *_ in held])
            p = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for _, _, x, *_ in held])
            by = np.argsort(c.astype(np.int64) << 32 | r, kind="stable")[: np.count_nonzero(c < none)]
            many = np.bincount(c[by], minlength=none)
            starts = np.concatenate([n + np.arange(0, m, listed) for n, m in zip(np.cumsum(many) - many, many, strict=True)])
            ids = pa.concat_arrays([one for one, *_ in held]).take(pa.array(p[by]))
            yield from _lists(starts, {"c": pa.array(c[by][starts].astype(np.int32))}, {"protein_id": ids, "r": r[by]})

    rows = proteins.select("protein_id", "seq").mapInArrow(run, f"c int, at array<struct<{_id(proteins)}, r int>>")
    made = by_letter(dict(enumerate(of.values())))
    edges = rows.select("at", F.explode(F.get(made, F.col("c"))).alias("e")).select("e.*", F.explode("at").alias("at"))
    return edges.select("at.protein_id", (F.col("at.r").cast("long") * 3 + F.col("k")).alias("src_pos"), "src", "dst", "nuc", "weight")


def lattice_edge_sums(proteins: DataFrame, weighted: DataFrame) -> DataFrame:
    """protein_id, src, nuc, n, places, weight: sums over lattice_edges. A residue's edges are the
    same wherever it stands, so residues are counted and their places added up by protein and
    letter (before the shuffle) and only those sums meet the edges."""
    by = residues(proteins).groupBy("protein_id", "aa").agg(F.count("*").alias("many"), F.sum("pos").alias("places"))
    edge = _edges(weighted).groupBy("aa", "src", "nuc").agg(F.count("*").alias("edges"), F.sum("k").alias("k"), F.sum("weight").alias("weight"))
    met = by.join(F.broadcast(edge), "aa").groupBy("protein_id", "src", "nuc")
    return met.agg(F.sum(F.col("many") * F.col("edges")).alias("n"), F.sum(F.col("places") * 3 * F.col("edges") + F.col("many") * F.col("k")).alias("places"), F.sum(F.col("many") * F.col("weight")).alias("weight"))


def motif_transitions(motifs: DataFrame) -> DataFrame:
    """motifset_id, state, nuc, next_state of the automaton that avoids the motifs of a set: states
    are proper prefixes of motifs, and a missing row is a forbidden step."""
    clean = motifs.select("motifset_id", F.translate(F.upper("motif"), "T", "U").alias("motif")).where("motif != ''").distinct()
    states = clean.select("motifset_id", F.explode(F.transform(F.sequence(F.lit(0), F.length("motif") - 1), lambda n: F.substring(F.col("motif"), F.lit(1), n))).alias("state")).distinct()
    steps = states.withColumn("nuc", F.explode(F.array(*(F.lit(n) for n in "ACGU")))).withColumn("read", F.concat("state", "nuc"))
    hits = steps.join(clean, "motifset_id").where(F.col("read").endswith(F.col("motif"))).select("motifset_id", "state", "nuc").distinct()
    goes = steps.join(hits, ["motifset_id", "state", "nuc"], "left_anti").join(states.withColumnRenamed("state", "to"), "motifset_id").where(F.col("read").endswith(F.col("to")))
    return goes.groupBy("motifset_id", "state", "nuc").agg(F.max_by("to", F.length("to")).alias("next_state"))


#: Rows of a structure that are given out at once.
AT_ONCE = 1 << 17


def partners(structure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Opening brackets of a dot-bracket string by level, then place: their places, their partners'
    (-1: none) and their levels. Within a level opening and closing alternate, so a partner is the
    next in the level."""
    x = np.frombuffer(structure.encode("latin-1", "replace"), np.uint8)
    at = np.flatnonzero(x != ord("."))
    opens = x[at] == ord("(")
    level = np.cumsum(np.where(opens, 1, -1)) + ~opens
    order = np.argsort(level, kind="stable")
    at, opens, level = at[order], opens[order], level[order]
    j = np.full(len(at), -1)
    j[:-1] = np.where(level[1:] == level[:-1], at[1:], -1)
    return at[opens], j[opens], level[opens]


def by_structure(structures: DataFrame, columns: dict[str, str], read, only_balanced: bool = False) -> DataFrame:
    """id and what read(i, j, level) of each structure's partners gives by column, an array each. A
    structure is worked out in the task that has its row, and nothing is shuffled; -1 stands for
    null. only_balanced leaves out strings that are not balanced."""
    types = {c: pa.from_numpy_dtype(np.dtype({"int": "int32", "long": "int64"}[t])) for c, t in columns.items()}

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for k, structure in enumerate(batch["structure"].to_pylist()):
                if structure and not (only_balanced and not _balanced(structure)):
                    got = read(*partners(structure))
                    held.append((np.full(len(got[0]), k), *got))
                    size += len(got[0])
                if size >= AT_ONCE or (size and k == batch.num_rows - 1):
                    of, *values = (np.concatenate(x) for x in zip(*held, strict=True))
                    for m in (slice(a, a + AT_ONCE) for a in range(0, size, AT_ONCE)):
                        arrays = [pa.array(v[m], t, mask=v[m] < 0) for v, t in zip(values, types.values(), strict=True)]
                        yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(of[m])), *arrays], ["id", *types])
                    held, size = [], 0

    kind = structures.schema["id"].dataType.simpleString()
    return structures.select("id", "structure").mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} {t}" for c, t in columns.items())]))


def _balanced(structure: str) -> bool:
    """functions.sequence.balanced of a string that is there already."""
    x = np.frombuffer(structure.encode("latin-1", "replace"), np.uint8)
    step = (x == ord("(")).astype(np.int64) - (x == ord(")"))
    depth = np.cumsum(step)
    return bool((step.astype(bool) | (x == ord("."))).all() and depth.min() >= 0 and depth[-1] == 0)


def base_pairs(structures: DataFrame, only_balanced: bool = False) -> DataFrame:
    """id, i, j (from 0) of the pairs of balanced dot-bracket strings (id, structure)."""
    return by_structure(structures, {"i": "int", "j": "int"}, lambda i, j, level: (i, j), only_balanced)
