"""Hierarchical packing of documents into training sequences of several lengths.

A document longer than the largest context fills whole windows of it; what is left, and every
shorter document, is routed to the smallest tier (context size) that holds it. The tier with the
most waiting tokens is packed next. A sequence of a tier opens with a document of that tier; its
gap is filled from its own and shorter tiers, the longest that fits first, and at last by a part
of one. So each sequence is exactly its tier long, but for one at the end of each shard, which is
padded to the largest tier. Full sequences of a tier are dealt into step groups of equally many
tokens.

A shard is a partition of the input; documents stay where they are read, without a shuffle,
and a task holds at most WAITING pieces. Each token is in exactly one piece.

Defined cases: null text is empty and gives the end id alone; repeated rows are packed as often
as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenizing import word_bpe

TIERS = (256, 512, 1024, 2048)
END_ID = 1
WAITING, STEP_TOKENS = 512, 1 << 14
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])


class Packer:
    """Packs the pieces (doc, start, ids, doc's tokens) of one shard."""

    def __init__(self, shard: int, tiers: tuple[int, ...] = TIERS, step: int = STEP_TOKENS):
        self.shard, self.tiers, self.step = shard, tiers, step
        self.waiting = {t: deque() for t in tiers}
        self.tokens = dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []
        self.sequences, self.groups, self.filled = 0, 0, {}

    def add(self, doc: int, ids: bytes) -> None:
        n, top, at = len(ids) // 4, self.tiers[-1], 0
        while n - at >= top:
            self._emit(top, [(doc, at, ids[4 * at : 4 * (at + top)], n)])
            at += top
        if n > at:
            self._wait((doc, at, ids[4 * at :], n))
        while sum(map(len, self.waiting.values())) > WAITING:
            self._pack()

    def _wait(self, piece: tuple, front: bool = False) -> None:
        tier = next(t for t in self.tiers if 4 * t >= len(piece[2]))
        (self.waiting[tier].appendleft if front else self.waiting[tier].append)(piece)
        self.tokens[tier] += len(piece[2]) // 4

    def _take(self, tier: int) -> tuple:
        piece = self.waiting[tier].popleft()
        self.tokens[tier] -= len(piece[2]) // 4
        return piece

    def _pack(self) -> None:
        tier = max(self.tiers, key=lambda t: (self.tokens[t], t))
        pieces = [self._take(tier)]
        gap = tier - len(pieces[0][2]) // 4
        while gap and any(self.waiting.values()):
            fit = next((t for t in reversed(self.tiers) if self.waiting[t] and len(self.waiting[t][0][2]) <= 4 * gap), None)
            if fit is None:  # a part of the shortest that waits
                fit = next(t for t in self.tiers if self.waiting[t])
                doc, start, ids, n = self._take(fit)
                self._wait((doc, start + gap, ids[4 * gap :], n), front=True)
                pieces.append((doc, start, ids[: 4 * gap], n))
            else:
                pieces.append(self._take(fit))
            gap -= len(pieces[-1][2]) // 4
        self._emit(self.tiers[-1] if gap else tier, pieces)

    def _emit(self, tier: int, pieces: list[tuple]) -> None:
        group, used = self.filled.get(tier, (None, self.step))
        if used + tier > self.step:
            group, used = self.groups, 0
            self.groups += 1
        self.filled[tier] = group, used + tier
        at = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, n, self.shard << 32 | self.sequences, at, tier, self.shard << 32 | group))
            at += len(ids) // 4
        self.sequences += 1

    def finish(self) -> None:
        while any(self.waiting.values()):
            self._pack()

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else [[] for _ in ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece, with its token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, end = word_bpe(tokenizer), Packer(TaskContext.get().partitionId(), tiers), END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for doc, ids in zip(part["doc_id"].to_pylist(), bpe.encode(part["text"].to_pylist()), strict=True):
                    packer.add(doc, ids + end)
                yield packer.taken()
        packer.finish()
        yield packer.taken()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(common.documents(spark, sf_dir))
