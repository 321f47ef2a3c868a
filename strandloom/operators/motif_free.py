"""Coding sequences without forbidden motifs: a codon lattice times a motif automaton.

What a residue does to the automaton is a matrix of least costs between states, and matrices
compose associatively (the sum of costs, the minimum over the state between).

Most residues are read alike from every state that the residue before them can end in; there the
least cost so far and the rest of the way do not depend on each other. Proteins are cut at these
places into chunks of a few residues, of which each distinct one is worked out once: all advance
together, a residue at a time. A protein longer than WHOLE segments is cut into segments that tasks
work on by themselves: first the matrix of each segment, then per protein the states at the
segments' borders, then within each segment the way between its two states.

How many nodes and edges the product has depends on the set of states reachable at a residue's
start alone; those sets are few. Mostly a residue and the one before it tell the set, the others
follow from the set before; each segment maps a set at its start to one at its end.

A protein_id names one row. Null and empty proteins have no row in the result. A residue without
codons leaves no sequence. Of equally cheap sequences one is returned, the same at every run.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import coding

#: Residues of a segment, how many segments a protein may have to be walked in one piece, and how
#: many residues a task walks at once.
SEGMENT, WHOLE, AT_ONCE = 1 << 12, 16, 1 << 20
#: Chunks that take a step at once, so that what they read stays near; below FEW, states take it together.
STEP, FEW = 1 << 12, 1 << 8


class Product:
    """Least costs, cheapest codons and reachable sets for each residue, as arrays.

    A residue's codons end in few of the automaton's states, so states are numbered within the
    residue that has just been read, and a step's matrix depends on that residue and the next."""

    def __init__(self, codons: dict[str, list[tuple[str, float]]], steps: dict[tuple[str, str], str]):
        self.residues = sorted(codons)
        self.none, self.begin = len(codons), len(codons) + 1  # codes of a residue without codons, and of a protein's start
        self.code = np.full(256, self.none, np.uint8)
        self.code[[ord(a) for a in self.residues]] = range(len(codons))
        links = self._links(codons, steps)
        ends = [sorted({links[s, c] for s in {s for s, _ in links} for c, _ in codons[aa] if (s, c) in links}) for aa in self.residues]
        ends += [[], [""]]
        n = self.width = max(map(len, ends))
        self.spelled = sorted({c for x in codons.values() for c, _ in x}) or [""]
        self.cost = np.full((len(ends), len(ends) - 1, n, n), np.inf)
        self.codon = np.zeros(self.cost.shape, np.uint8)
        for before, states in enumerate(ends):
            for a, aa in enumerate(self.residues):
                for i, s in enumerate(states):
                    for c, w in sorted(codons[aa]):
                        if (s, c) in links and w < self.cost[before, a, i, j := ends[a].index(links[s, c])]:
                            self.cost[before, a, i, j], self.codon[before, a, i, j] = w, self.spelled.index(c)
        self._sets(codons, steps)
        self._chunks(ends)

    @staticmethod
    def _after(state: str, codon: str, steps: dict) -> str | None:
        at: str | None = state
        for nuc in codon:
            at = steps.get((at, nuc)) if at is not None else None
        return at

    def _links(self, codons: dict, steps: dict) -> dict[tuple[str, str], str]:
        """The state after each codon from each state that a residue can begin in."""
        new, found = [""], {}
        for s in new:
            for c in {c for x in codons.values() for c, _ in x}:
                if (t := self._after(s, c, steps)) is not None:
                    found[s, c] = t
                    if t not in new:
                        new.append(t)
        return found

    def _sets(self, codons: dict, steps: dict) -> None:
        """Sets of states reachable at a residue's start: what follows each, nodes and edges added."""
        sets, rows = {frozenset({""}): 0, frozenset(): 1}, []
        for now in (order := list(sets)):
            row = []
            for aa in [*self.residues, None]:
                nodes, edges, layer = 0, 0, {("", s) for s in now}
                for k in range(3):
                    nodes += len(layer)
                    met = {(p, s, c[k], c[: k + 1] if k < 2 else "", t) for p, s in layer for c, _ in codons.get(aa, ()) if c.startswith(p) and (t := steps.get((s, c[k]))) is not None}
                    edges, layer = edges + len(met), {(q, t) for _, _, _, q, t in met}
                then = frozenset(t for _, t in layer)
                if then not in sets:
                    sets[then] = len(sets)
                    order.append(then)
                row.append((sets[then], nodes, edges))
            rows.append(row)
        self.then, self.nodes, self.edges = (np.ascontiguousarray(x) for x in np.moveaxis(np.array(rows, np.int64), 2, 0))

    def _chunks(self, ends: list[list[str]]) -> None:
        """For each residue and the one before it (a pair): whether all states before it read it alike,
        and the set behind it where all sets before it that are not empty lead to the same (else -1)."""
        alike = [(t[:, : max(1, len(states))] == t[:, :1]).all((1, 2)) for states, *ts in zip(ends, self.cost, self.codon, strict=True) for t in ts]
        self.alike = np.logical_and(alike[::2], alike[1::2]).ravel()
        behind: list[set[int]] = [set() for _ in ends]
        behind[self.begin] = {0}
        new = [(0, self.begin)]
        for now, _ in new:
            for a, then in enumerate(self.then[now, : len(self.residues)].tolist()):
                if then != 1 and then not in behind[a]:
                    behind[a].add(then)
                    new.append((then, a))
        later = [[{int(self.then[s, a]) for s in sets} or {1} for a in range(self.none + 1)] for sets in behind]
        self.settled = np.array([[min(x) if len(x) == 1 else -1 for x in row] for row in later]).ravel()
        # by pair, or by set and residue
        self.from_state = [np.ascontiguousarray(self.cost[:, :, i].reshape(-1, self.width)) for i in range(self.width)]
        self.from_all, self.by_pair = self.cost.reshape(-1, self.width, self.width), self.codon.reshape(-1, self.width, self.width)

    def _step(self, v: np.ndarray, pair: np.ndarray, back: np.ndarray) -> None:
        """v, the least cost of each state, after one more residue; back: the first state each comes from."""
        if len(v) < FEW:
            every = v[:, :, None] + self.from_all[pair]
            back[:], v[:] = every.argmin(1), every.min(1)
            return
        for k in range(0, len(v), STEP):
            was, now, source, p = v[k : k + STEP].copy(), v[k : k + STEP], back[k : k + STEP], pair[k : k + STEP]
            now[:], source[:] = was[:, :1] + self.from_state[0][p], 0
            for i in range(1, self.width):
                other = was[:, i : i + 1] + self.from_state[i][p]
                less = other < now
                np.copyto(now, other, where=less)
                source[less] = i

    def _counts(self, x: np.ndarray, pair: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and edges of each protein. Behind the place where no state is left there are none."""
        behind = self.settled[pair]
        at = np.flatnonzero(behind < 0)
        at = at[behind[at - 1] >= 0]  # a protein's first residue is settled
        while len(at):
            behind[at] = self.then[behind[at - 1], x[at]]
            at = at[at + 1 < len(x)] + 1
            at = at[behind[at] < 0]
        now = np.roll(behind, 1)
        now[first] = 0
        now = now * (self.none + 1) + x
        nodes, edges = self.nodes.ravel()[now], self.edges.ravel()[now]
        empty = behind == 1
        last = np.minimum.reduceat(np.where(empty, np.arange(len(x)), len(x)), first)
        if empty.any():
            over = np.arange(len(x)) > np.repeat(last, sizes)
            nodes[over] = edges[over] = 0
        return np.add.reduceat(nodes, first) + (last == len(x)), np.add.reduceat(edges, first)  # all accepting nodes of the end are one

    def _distinct(self, x: np.ndarray, before: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One chunk of each sort, and for each chunk which of these it is like. Short chunks are told
        apart by their residues and the one before as digits of a number, long ones taken as they are."""
        base = self.begin + 2
        digits = int(62 // np.log2(base)) - 1
        short = np.flatnonzero(sizes <= digits)
        key, left = before[heads[short]].astype(np.int64) + 1, np.arange(len(short))
        for i in range(digits):
            left = left[sizes[short[left]] > i]
            key[left] = key[left] * base + x[heads[short[left]] + i] + 1
        _, some, like = np.unique(key, return_index=True, return_inverse=True)
        long = np.flatnonzero(sizes > digits)
        which = np.empty(len(heads), np.int64)
        which[short], which[long] = like, len(some) + np.arange(len(long))
        return np.concatenate([short[some], long]), which

    def whole(self, proteins: list[str], spell: bool = True) -> tuple[np.ndarray, ...]:
        """Of each protein (none is empty) the least cost (infinite: no sequence), nodes, edges, and
        its sequence."""
        sizes = np.array([len(p) for p in proteins])
        first = np.cumsum(sizes) - sizes
        x = self.code[np.frombuffer("".join(proteins).encode("latin-1", "replace"), np.uint8)]
        before = np.roll(x, 1)
        before[first] = self.begin
        pair = before.astype(np.int64) * (self.none + 1) + x
        nodes, edges = self._counts(x, pair, first, sizes)
        heads = np.flatnonzero(self.alike[pair])  # a protein's first residue is one
        long = np.diff(heads, append=len(x))
        some, which = self._distinct(x, before, heads, long)
        some = some[order := np.argsort(-long[some], kind="stable")]
        place = np.empty(len(some), np.int64)
        place[order] = np.arange(len(some))
        which = place[which]
        head, reach = heads[some], self._active(long[some])
        begun = np.cumsum(reach) - reach  # the i-th residues of all chunks come one after the other
        v, back = self.from_state[0][pair[head]], np.zeros((reach.sum(), self.width), np.uint8)
        for i, active in enumerate(reach[1:].tolist(), 1):
            self._step(v[:active], pair[head[:active] + i], back[begun[i] : begun[i] + active])
        end = v.argmin(1)
        each = v[np.arange(len(v)), end]
        cost = np.add.reduceat(each[which], np.searchsorted(heads, first))
        if not spell:
            return cost, nodes, edges, np.full(len(sizes), None, object)
        way = np.zeros(len(back), np.uint8)
        for i in range(len(reach) - 1, -1, -1):
            m, k = slice(0, reach[i]), slice(begun[i], begun[i] + reach[i])
            source = back[k][np.arange(reach[i]), end[m]]
            way[k] = self.by_pair[pair[head[m] + i], source, end[m]]
            end[m] = source
        at = begun[np.arange(len(x)) - np.repeat(heads, long)] + np.repeat(which, long)
        text = self._letters()[way[at]].tobytes().decode()
        spelled = [text[3 * a : 3 * (a + n)] if ok else None for a, n, ok in zip(first.tolist(), sizes.tolist(), np.isfinite(cost).tolist(), strict=True)]
        return cost, nodes, edges, np.array(spelled, object)

    def _letters(self) -> np.ndarray:
        return np.frombuffer("".join(self.spelled).encode() or b"   ", np.uint8).reshape(-1, 3)

    def coded(self, parts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Segments as a matrix of residues' codes, one a column, below the codes of the residues
        before them, and their lengths."""
        sizes = np.array([len(p) for _, p in parts])
        out = np.full((1 + sizes.max(), len(parts)), self.none, np.uint8)
        for i, (before, p) in enumerate(parts):
            out[0, i] = self.code[before.encode("latin-1", "replace")[0]] if before else self.begin
            out[1 : 1 + sizes[i], i] = self.code[np.frombuffer(p.encode("latin-1", "replace"), np.uint8)]
        return out, sizes

    def summaries(self, parts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment the matrix of least costs, and for each set at its start the one at its
        end, nodes and edges. Longer segments come first."""
        x, sizes = self.coded(parts)
        n, q = self.width, len(self.then)
        v = np.tile(np.where(np.eye(n, dtype=bool), 0.0, np.inf), (len(parts), 1, 1))
        at, nodes, edges = np.tile(np.arange(q), (len(parts), 1)), np.zeros((len(parts), q), np.int64), np.zeros((len(parts), q), np.int64)
        for i, active in enumerate(self._active(sizes)):
            before, a, m = x[i, :active], x[i + 1, :active], slice(0, active)
            v[m] = (v[m][:, :, :, None] + self.cost[before, a][:, None]).min(2)
            nodes[m] += self.nodes[at[m], a[:, None]]
            edges[m] += self.edges[at[m], a[:, None]]
            at[m] = self.then[at[m], a[:, None]]
        return v, at, nodes, edges

    @staticmethod
    def _active(sizes: np.ndarray) -> np.ndarray:
        """For each place, how many of segments of falling length reach it."""
        return np.searchsorted(-sizes, -np.arange(1, sizes.max() + 1), side="right")

    def ways(self, parts: list[tuple[str, str]], start: np.ndarray, stop: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each segment the least cost from its start state to its stop state (-1: any), the
        state it ends in (-1: none), the set at its end, nodes, edges, and its sequence."""
        x, sizes = self.coded(parts)
        count, n, reach = len(parts), self.width, self._active(sizes)
        v = np.full((count, n), np.inf)
        v[np.arange(count), start] = 0.0
        at, nodes, edges = begun.copy(), np.zeros(count, np.int64), np.zeros(count, np.int64)
        back = np.zeros((len(x) - 1, count, n), np.uint8)
        for i, active in enumerate(reach):
            before, a, m = x[i, :active], x[i + 1, :active], slice(0, active)
            every = v[m][:, :, None] + self.cost[before, a]
            back[i, m] = every.argmin(1)
            v[m] = every.min(1)
            nodes[m] += self.nodes[at[m], a]
            edges[m] += self.edges[at[m], a]
            at[m] = self.then[at[m], a]
        state = np.where(stop < 0, v.argmin(1), stop)
        cost = v[np.arange(count), state]
        end, state = state.copy(), np.where(np.isfinite(cost), state, -1)
        way = np.zeros((count, len(x) - 1), np.uint8)
        for i in range(len(x) - 2, -1, -1):
            m = np.arange(reach[i])
            before = back[i, m, end[m]]
            way[m, i] = self.codon[x[i, m], x[i + 1, m], before, end[m]]
            end[m] = before
        letters = self._letters()
        spelled = np.array([letters[way[k, : sizes[k]]].tobytes().decode() if state[k] >= 0 else None for k in range(count)], object)
        return cost, state, at, nodes, edges, spelled


def _groups(parts: list[tuple[str, str]]) -> Iterator[list[int]]:
    """Indices of segments by falling length, so many at once that AT_ONCE residues are walked."""
    order, at = sorted(range(len(parts)), key=lambda i: -len(parts[i][1])), 0
    while at < len(order):
        many = max(1, AT_ONCE // len(parts[order[at]][1]))
        yield order[at : at + many]
        at += many


def _runs(proteins: list[str]) -> Iterator[slice]:
    """Proteins in order, so many at once that AT_ONCE residues are walked."""
    at = np.cumsum([len(p) for p in proteins]) // AT_ONCE
    ends = [0, *(1 + np.flatnonzero(np.diff(at))).tolist(), len(proteins)]
    yield from (slice(a, b) for a, b in itertools.pairwise(ends) if a < b)


def _once(proteins: DataFrame) -> DataFrame:
    """protein_id, seq with seq worked out a single time: no filter is pushed below the generator."""
    return proteins.select(F.explode(F.array(F.struct("protein_id", "seq"))).alias("r")).select("r.*")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out anew, so that neither a long protein nor a long file stays in one task; by
    number, as tasks are long for their bytes: Spark would merge them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _segments(proteins: DataFrame, segment: int) -> DataFrame:
    """protein_id, k, before, part: proteins cut in order, with the residue before each part."""
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{segment}}}"), F.lit(0))
    rows = proteins.select("protein_id", F.explode(F.array(cut)).alias("p")).select("protein_id", F.size("p").alias("many"), F.posexplode(F.arrays_zip(F.col("p").alias("part"), F.concat(F.array(F.lit("")), "p").alias("last"))).alias("k", "s"))
    return _dealt(rows.where("k < many").select("protein_id", "k", F.substring("s.last", -1, 1).alias("before"), F.col("s.part").alias("part")), "protein_id", "k")


_RESULT = "nodes long, edges long, feasible boolean, cost double, cds string"


def motif_product(proteins: DataFrame, weighted: DataFrame, motifs: DataFrame, segment: int = SEGMENT, spell: bool = True) -> DataFrame:
    """protein_id, nodes, edges, feasible, cost, cds: the lattice of each protein with all coding
    sequences that hold none of the motifs (a set of a few short ones), the least cost of these
    and a sequence of that cost (null if there is none, or if none is to be spelled)."""
    codons: dict[str, list] = {}
    for r in weighted.select("aa", "codon", "neg_log_w").collect():  # at most 64 rows
        codons.setdefault(r.aa, []).append((r.codon, r.neg_log_w))
    steps = {(r.state, r.nuc): r.next_state for r in coding.motif_transitions(motifs).collect()}  # the letters of a motif set times four
    steps = steps or {("", n): "" for n in "ACGU"} if motifs.where("motif != ''").isEmpty() else steps
    kind = f"protein_id {proteins.schema['protein_id'].dataType.simpleString()}"
    rows = lambda batch, cols: pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def alone(batches):
        product = Product(codons, steps)
        for batch in batches:
            texts = batch["seq"].to_pylist()
            for run in _runs(texts):
                cost, nodes, edges, cds = product.whole(texts[run], spell)
                ok = np.isfinite(cost)
                yield rows(batch, {"protein_id": batch["protein_id"][run], "nodes": pa.array(nodes), "edges": pa.array(edges), "feasible": pa.array(ok), "cost": pa.array(cost, mask=~ok), "cds": pa.array(cds, pa.string())})

    def summed(batches):
        product = Product(codons, steps)
        for batch in batches:
            texts = list(zip(batch["before"].to_pylist(), batch["part"].to_pylist(), strict=True))
            for group in _groups(texts):
                v, at, nodes, edges = product.summaries([texts[i] for i in group])
                lists = {"costs": (v, pa.float64()), "ends": (at, pa.int64()), "nodes": (nodes, pa.int64()), "edges": (edges, pa.int64())}
                yield rows(batch, {c: batch[c].take(pa.array(group)) for c in ("protein_id", "k")} | {c: pa.array([y.ravel() for y in x], pa.list_(t)) for c, (x, t) in lists.items()})

    def bordered(table: pa.Table) -> pa.Table:
        """The states at the borders of one protein's segments: costs forwards, then back from the end."""
        table = table.sort_by("k")  # state 0 is the only one at a protein's start
        costs = [np.array(x) for x in table["costs"].to_pylist()]
        n = int(np.sqrt(len(costs[0])))
        v, begun, at, nodes, edges = [np.where(np.arange(n) == 0, 0.0, np.inf)], [], 0, 0, 0
        for m, ends, a, b in zip(costs, *(table[c].to_pylist() for c in ("ends", "nodes", "edges")), strict=True):
            v.append((v[-1][:, None] + m.reshape(n, n)).min(0))
            begun.append(at)
            nodes, edges, at = nodes + a[at], edges + b[at], ends[at]
        end = int(v[-1].argmin())
        cost = float(v[-1][end])
        ok, start, stop = bool(np.isfinite(cost)), [0] * len(costs), [0] * len(costs)
        for k in range(len(costs) - 1, -1, -1):
            stop[k] = end
            start[k] = end = int((v[k] + costs[k].reshape(n, n)[:, end]).argmin())
        more = {"start": start, "stop": stop, "begun": begun, "nodes": [nodes + (at != 1)] * len(costs), "edges": [edges] * len(costs), "feasible": [ok] * len(costs), "cost": [cost if ok else None] * len(costs)}
        types = (pa.int64(),) * 5 + (pa.bool_(), pa.float64())
        return pa.table({"protein_id": table["protein_id"], "k": table["k"]} | {c: pa.array(x, t) for (c, x), t in zip(more.items(), types, strict=True)})

    def spelled(batches):
        product = Product(codons, steps)
        for batch in batches:
            texts = list(zip(batch["before"].to_pylist(), batch["part"].to_pylist(), strict=True))
            ok = batch["feasible"].to_numpy(zero_copy_only=False)
            start, stop, begun = (batch[c].to_numpy() for c in ("start", "stop", "begun"))
            for group in _groups(texts):
                cds = product.ways([texts[i] for i in group], start[group], stop[group], begun[group])[-1]
                yield rows(batch, {c: batch[c].take(pa.array(group)) for c in ("protein_id", "k", "nodes", "edges", "feasible", "cost")} | {"cds": pa.array(np.where(ok[group], cds, None), pa.string())})

    short = F.length("seq") <= WHOLE * segment
    dealt = _once(_dealt(_once(proteins), "protein_id"))  # read twice, made and dealt out once
    one = dealt.where((F.length("seq") > 0) & short).mapInArrow(alone, f"{kind}, {_RESULT}")
    # as the join below asks for ids, so that both its sides share what is dealt out
    many = _segments(dealt.where(~short & F.col("protein_id").isNotNull()), segment)
    lists = "costs array<double>, ends array<long>, nodes array<long>, edges array<long>"
    borders = many.mapInArrow(summed, f"{kind}, k int, {lists}").groupBy("protein_id").applyInArrow(bordered, f"{kind}, k int, start long, stop long, begun long, nodes long, edges long, feasible boolean, cost double")
    if not spell:
        return one.unionByName(borders.where("k = 0").select("protein_id", "nodes", "edges", "feasible", "cost", F.lit(None).cast("string").alias("cds")))
    pieces = many.join(borders, ["protein_id", "k"]).mapInArrow(spelled, f"{kind}, k int, {_RESULT}")
    whole = pieces.groupBy("protein_id").agg(*(F.first(c).alias(c) for c in ("nodes", "edges", "feasible", "cost")), F.array_sort(F.collect_list(F.struct("k", "cds"))).alias("p"))
    cds = F.when(F.col("feasible"), F.array_join("p.cds", ""))
    return one.unionByName(whole.select("protein_id", "nodes", "edges", "feasible", "cost", cds.alias("cds")))
