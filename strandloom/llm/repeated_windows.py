"""Substring dedup: words covered by a 50-word window that also starts in an earlier document.

Windows are addressed by their anchor: the least hash among the ten-word shingles inside (the
first, where equal). Equal windows have equal anchors, and consecutive windows mostly share
one, so a document has one segment of windows for about every twenty words.

First pass: each partition counts its anchors in a count-min sketch (counts to 2), and the
partitions' sketches are merged by adding. The sketch never underestimates, so a window whose
anchor is estimated to occur once cannot be repeated. Second pass: only segments of anchors
estimated twice or more go on. Segments are grouped exactly by 128-bit hashes of all their
words; a copy of a segment from a smaller document covers it whole. Windows one by one are
grouped only for the first document of each variant of an anchor that has several.

A sketch has four cells for each segment in each of ROWS rows, as bits. Up to MOST_CELLS cells
are broadcast (that bounds them). Beyond, anchors are dealt by hash into ranges of RANGE_CELLS
cells, and all ranges are worked on by one job: partitions' sketches of a range are merged in
a task, and its bits are read by the tasks that then let the range's segments pass by, one after
another; a range with many segments (a hot anchor, say) is split over several tasks. So the
sketches together grow with the input, and what a task or the driver holds does not. Groups
are only ever aggregated, never gathered, but for the spans of one document.

Defined cases: null, empty and blank texts have no words; fewer words than a window: nothing is
removed; windows repeated inside one document alone stay; rows that share a doc_id are
judged as one document's text each; a row without a doc_id comes before and after no document, so
nothing of it is removed and it removes nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, ANCHOR, SEED = 50, 10, 23
ROWS, LEAST_CELLS, MOST_CELLS, SLICE = 2, 1 << 16, 1 << 28, 1 << 20
#: Cells of a range where several are needed, and most segments of one in a task.
RANGE_CELLS, RANGE_ROWS = 1 << 23, 1 << 22
_U = np.uint64
_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self, base: int):
        self.pairs = (base, pow(base, -1, 1 << 64))
        self.held = [np.ones(1, _U), np.ones(1, _U)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) < n:
            self.held = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * n, b, _U)]), dtype=_U) for b in self.pairs]
        return self.held[0][:n], self.held[1][:n]


class Windows:
    """Hashes over the words of one text at a time."""

    def __init__(self):
        self.words, self.powers = common.WordHashes(SEED), tuple(map(_Powers, _BASE))

    def sums(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for i, p in enumerate(self.powers):
            up, down = p.upto(len(w) + 1)
            x = w if i == 0 else common.mix(w ^ _U(0xA5A5A5A5A5A5A5A5))
            out.append((np.concatenate([np.zeros(1, _U), np.cumsum(x * up[:-1], dtype=_U)]), down))
        return out

    @staticmethod
    def spans(sums, start: np.ndarray, stop: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the words from start to stop."""
        return tuple(common.mix((s[stop] - s[start]) * down[start] + salt.astype(_U) * _U(0x9FB21C651E98DF25)) for s, down in sums)

    def segments(self, words: list[bytes]):
        """anchor, two hashes, first window and number of windows of each segment."""
        w = self.words.array(words)
        sums = self.sums(w)
        at = np.arange(len(w) - ANCHOR + 1)
        small = self.spans(sums[:1], at, at + ANCHOR, np.zeros(len(at), np.int64))[0]
        inner = WINDOW - ANCHOR + 1
        view = np.lib.stride_tricks.sliding_window_view(small, inner)
        least = np.concatenate([view[i : i + 65536].argmin(axis=1) for i in range(0, len(view), 65536)]) + np.arange(len(view))
        first = np.flatnonzero(np.diff(least, prepend=-1))
        n = np.diff(np.append(first, len(least)))
        place = least[first]
        h1, h2 = self.spans(sums, first, first + n + WINDOW - 1, (n << 8) + (place - first))
        return small[place], h1, h2, first, n

    def windows(self, words: list[bytes], starts: np.ndarray):
        sums = self.sums(self.words.array(words))
        return self.spans(sums, starts, starts + WINDOW, np.zeros(len(starts), np.int64))


def _batches(batches: Iterator[pa.RecordBatch], step: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, [t.split() for t in part["text"].cast(pa.binary()).to_pylist()]


SEGMENT = "anchor long, h1 long, h2 long, doc_id long, start long, n long"


def segment_table(docs: DataFrame) -> DataFrame:
    """anchor, h1, h2, doc_id, start, n of every segment."""

    def run(batches):
        tool = Windows()
        for part, texts in _batches(batches):
            out = [[], [], [], [], [], []]
            for doc, words in zip(part["doc_id"].to_pylist(), texts, strict=True):
                if len(words) >= WINDOW:
                    anchor, h1, h2, first, n = tool.segments(words)
                    for o, x in zip(out, (anchor.view(np.int64), h1.view(np.int64), h2.view(np.int64), np.full(len(n), doc), first, n), strict=True):
                        o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["anchor", "h1", "h2", "doc_id", "start", "n"])

    return docs.mapInArrow(run, SEGMENT)


def _cells(anchor: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (common.mix(anchor.view(_U) ^ _U(0x1234567 * (row + 1))) & _U(cells - 1)).astype(np.int64)


def sketch(anchors: DataFrame, cells: int) -> dict[tuple[int, int], np.ndarray]:
    """Bits of the cells whose merged count is two or more, by row and slice of the cells.

    Each partition sends its cells, sorted, with those it counted twice marked; one task merges
    a slice. The result has ROWS * cells bits at most, whatever the input's size."""

    def count(batches):
        per = [[] for _ in range(ROWS)]
        for batch in batches:
            a = batch["anchor"].to_numpy()
            for r in range(ROWS):
                per[r].append(_cells(a, r, cells))
        for r in range(ROWS):
            at, n = np.unique(np.concatenate(per[r]) if per[r] else np.zeros(0, np.int64), return_counts=True)
            edges = np.searchsorted(at, np.arange(0, cells + SLICE, SLICE))
            for s in range(max(1, cells // SLICE)):
                i, j = edges[s], edges[min(s + 1, len(edges) - 1)]
                if j > i:
                    packed = ((at[i:j] - s * SLICE) << 1 | (n[i:j] > 1)).astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([s], pa.int32()), pa.array([packed], pa.binary())], ["row", "slice", "cells"])

    def merge(batches):
        once: dict[tuple[int, int], np.ndarray] = {}
        twice: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r, s, p in zip(*(batch[c].to_pylist() for c in ("row", "slice", "cells")), strict=True):
                seen, more = once.setdefault((r, s), np.zeros(SLICE, bool)), twice.setdefault((r, s), np.zeros(SLICE, bool))
                x = np.frombuffer(p, "<u4")
                at = x >> 1
                more[at] |= seen[at] | (x & 1).astype(bool)
                seen[at] = True
        if once:
            keys = list(once)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([np.packbits(twice[k], bitorder="little").tobytes() for k in keys], pa.binary())], ["row", "slice", "bits"])

    parts = anchors.mapInArrow(count, "row int, slice int, cells binary").repartition("row", "slice")
    rows = parts.mapInArrow(merge, "row int, slice int, bits binary").collect()
    return {(r.row, r.slice): np.frombuffer(r.bits, np.uint8) for r in rows}


def repeated(segments: DataFrame, most_cells: int) -> DataFrame:
    """The rows of a written table of segments whose anchors are estimated to occur twice or more."""
    n = segments.count()
    cells = LEAST_CELLS
    while cells < 4 * n and cells < most_cells:
        cells *= 2
    if 4 * n <= most_cells:
        return common.written(_passed(segments, cells), "repeated")
    cells = min(RANGE_CELLS, most_cells)
    return common.written(_passed_by_range(segments, cells, -(-4 * n // cells), n), "repeated")


def range_sketches(segments: DataFrame, cells: int, ranges: int, tasks: int) -> DataFrame:
    """_range, row, bits of the cells whose merged count is two or more, for each range of anchors
    and row. Partitions count their segments' cells, and one task merges a range's."""

    def count(batches):
        keys = [[] for _ in range(ROWS)]
        for batch in batches:
            a, at = batch["anchor"].to_numpy(), batch["_range"].to_numpy().astype(np.int64)
            for r in range(ROWS):
                keys[r].append(at * cells + _cells(a, r, cells))
        for r in range(ROWS):
            key, n = np.unique(np.concatenate(keys[r]) if keys[r] else np.zeros(0, np.int64), return_counts=True)
            first = np.flatnonzero(np.diff(key // cells, prepend=-1))
            for i, j in pairwise([*first.tolist(), len(key)]):
                packed = ((key[i:j] % cells) << 1 | (n[i:j] > 1)).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([int(key[i]) // cells], pa.int32()), pa.array([r], pa.int32()), pa.array([packed], pa.binary())], ["_range", "row", "cells"])

    def merge(batches):
        now, seen, more = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())], ["_range", "row", "bits"])

        for batch in batches:
            for k, r, p in zip(*(batch[c].to_pylist() for c in ("_range", "row", "cells")), strict=True):
                if now != (k, r):
                    if now is not None:
                        yield out()
                    now, seen, more = (k, r), np.zeros(cells, bool), np.zeros(cells, bool)
                x = np.frombuffer(p, "<u4")
                at = x >> 1
                more[at] |= seen[at] | (x & 1).astype(bool)
                seen[at] = True
        if now is not None:
            yield out()

    parts = segments.select("anchor", "_range").mapInArrow(count, "_range int, row int, cells binary")
    return parts.repartition(tasks, "_range", "row").sortWithinPartitions("_range", "row").mapInArrow(merge, "_range int, row int, bits binary")


def _passed_by_range(segments: DataFrame, cells: int, ranges: int, n: int) -> DataFrame:
    """The segments that the sketches of their ranges let pass, in one job."""
    names = segments.columns
    tasks = common.tasks_for(segments.sparkSession, n, RANGE_ROWS)
    dealt = segments.withColumn("_range", F.pmod(F.xxhash64("anchor"), F.lit(ranges)).cast("int"))
    sketches = common.written(range_sketches(dealt, cells, ranges, tasks), "sketches")
    parts = common.written(dealt.groupBy("_range").agg(F.ceil(F.count("*") / RANGE_ROWS).cast("int").alias("_parts")), "parts")
    none = lambda *cs: [F.lit(None).cast("long").alias(c) for c in cs]
    bits = common.keyed(sketches, parts, "_range", "inner").select("_range", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "row", "bits", *none(*names))
    part = F.pmod(F.xxhash64("doc_id", "start", "h1"), F.col("_parts")).cast("int")
    rows = common.keyed(dealt, parts, "_range", "inner").select("_range", part.alias("_part"), F.lit(ROWS).alias("row"), F.lit(None).cast("binary").alias("bits"), *names)

    def run(batches):
        now, held = None, {}
        for batch in batches:
            key, row = batch["_range"].to_numpy(), batch["row"].to_numpy()
            first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            for i, j in pairwise([*first.tolist(), len(key)]):
                if key[i] != now:
                    now, held = key[i], {}
                part = batch.slice(i, j - i)
                if row[i] < ROWS:
                    held[int(row[i])] = np.frombuffer(part["bits"][0].as_buffer(), np.uint8)
                    continue
                a, ok = part["anchor"].to_numpy(), np.ones(j - i, bool)
                for r in range(ROWS):
                    at = _cells(a, r, cells)
                    ok &= (held[r][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                yield part.select(names).filter(pa.array(ok))

    # a range's bits come before its segments
    met = bits.unionByName(rows).repartition(tasks, "_range", "_part").sortWithinPartitions("_range", "_part", "row")
    return met.mapInArrow(run, SEGMENT)


def _passed(segments: DataFrame, cells: int) -> DataFrame:
    """The segments that a sketch of their anchors lets pass."""
    bits = segments.sparkSession.sparkContext.broadcast(sketch(segments.select("anchor"), cells))

    def run(batches):
        held = bits.value
        for batch in batches:
            a = batch["anchor"].to_numpy()
            ok = np.ones(len(a), bool)
            for r in range(ROWS):
                at = _cells(a, r, cells)
                part, low = at // SLICE, at % SLICE
                for s in np.unique(part).tolist():
                    mine = np.flatnonzero(part == s)
                    b = held.get((r, s))
                    x = low[mine]
                    ok[mine] &= (b[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool) if b is not None else False
            yield batch.filter(pa.array(ok))

    return segments.mapInArrow(run, SEGMENT)


def covered(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, spans (array of start, stop in words) of what is removed; only where there is some."""
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    segments = common.written(segment_table(docs), "segments")
    some = repeated(segments, most_cells)
    key = ["anchor", "h1", "h2"]
    variants = common.written(some.groupBy(*key).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("k")), "variants")
    several = variants.groupBy("anchor").agg(F.count("*").alias("v")).where("v > 1").select("anchor")
    several = common.written(several, "several")
    copies = variants.where("k > 1").select(*key, "first_doc")
    whole = some.join(copies, key).where("doc_id > first_doc").select("doc_id", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("stop"))
    # windows one by one: the first document of each variant, where an anchor has several
    mixed = common.written(variants.join(several, "anchor", "left_semi").select(*key, "first_doc"), "mixed")
    firsts = some.join(mixed, key).where("doc_id = first_doc").select("doc_id", "start", "n").distinct()
    wanted = common.written(firsts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("parts")), "wanted")

    def each(batches):
        tool = Windows()
        for part, texts in _batches(batches):
            out = [[], [], [], []]
            for doc, words, parts in zip(part["doc_id"].to_pylist(), texts, part["parts"].to_pylist(), strict=True):
                at = np.unique(np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in parts]))
                if len(words) < at[-1] + WINDOW:  # another row of this doc_id
                    at = at[at + WINDOW <= len(words)]
                if len(at):
                    h1, h2 = tool.windows(words, at)
                    for o, x in zip(out, (h1.view(np.int64), h2.view(np.int64), np.full(len(at), doc), at), strict=True):
                        o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["w1", "w2", "doc_id", "at"])

    single = common.keyed(docs, wanted, "doc_id", "inner", 64).select("doc_id", "text", "parts").mapInArrow(each, "w1 long, w2 long, doc_id long, at long")
    single = common.written(single, "windows")
    least = common.written(single.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").select("w1", "w2", "first_doc"), "least")
    ones = single.join(least, ["w1", "w2"]).where("doc_id > first_doc").select("doc_id", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("stop"))
    return whole.union(ones).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


COLUMNS = ["doc_id", "n_words", "n_removed", "kept"]


def remove(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, for every document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = common.written(covered(docs, most_cells), "spans")

    def run(batches):
        for part, texts in _batches(batches):
            given = part["spans"].to_pylist() if "spans" in part.schema.names else [None] * len(texts)
            n, gone, kept = [], [], []
            for words, parts in zip(texts, given, strict=True):
                if parts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for p in parts:
                        edge[min(p["start"], len(words))] += 1
                        edge[min(p["stop"], len(words))] -= 1
                    keep = np.cumsum(edge)[:-1] == 0
                    n.append(len(words))
                    gone.append(int(len(words) - keep.sum()))
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                else:
                    n.append(len(words))
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], COLUMNS)

    schema = "doc_id long, n_words long, n_removed long, kept string"
    ids = common.written(spans.select("doc_id"), "touched")
    alone = common.keyed(docs, ids, "doc_id", "left_anti").mapInArrow(run, schema)
    touched = common.keyed(docs, ids, "doc_id", "left_semi").join(spans, "doc_id").mapInArrow(run, schema)
    return alone.unionByName(touched)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(common.documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
