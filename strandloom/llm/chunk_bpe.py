"""BPE encoding with content-defined chunks that are encoded once and reused.

A rolling hash over bytes cuts texts at places that depend on nearby content alone, so passages
shared by documents give equal chunks. A first pass addresses chunks by 128-bit hashes; those
that occur twice or more are encoded once, by the document that first has them, and their ids
are joined to all other documents that hold them. Other chunks are encoded in place.

Chunks are cut anywhere, so ids next to a cut can be wrong. Every cut is repaired: from the last
place before it to the first place after it where a space follows a character that is no white
space, the text is encoded again. The pre-tokenizer has no token over such a place, whatever
stands around it, so ids before and after agree with those of the whole text; a chunk without one
is encoded again with its neighbours. Decoding gives the text back.

Only hashes are shuffled for all documents. Documents that hold a shared chunk meet its ids by a
join on doc_id; sets of doc_ids are broadcast only up to common.BROADCAST_BYTES.

Defined cases: null text is empty and has no ids; a text with a special token's string
is one chunk; repeated rows are encoded like any document; an empty table gives
an empty result; other columns are ignored. Chunks are known by their content, so rows that
share a doc_id, with equal or other texts, are encoded each as its own; rows without a doc_id
are encoded in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenizing import ByteBPE, byte_bpe

MASK_BITS, LEAST = 10, 256
_GEAR = np.random.default_rng(20240601).integers(1, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes, mask_bits: int = MASK_BITS, least: int = LEAST) -> list[int]:
    """Starts of chunks, and the end. A cut stands where the hash of the last 16 bytes has
    mask_bits zero bits, on a character's first byte, at least `least` bytes on."""
    out = [0]
    if len(data) > 2 * least:
        b = np.frombuffer(data, np.uint8)
        h, factor = _GEAR[b], 0x9E3779B1
        for width in (1, 2, 4, 8):
            h = h.copy()
            h[width:] += h[:-width] * np.uint32(factor)
            factor = factor * factor & 0xFFFFFFFF
        found = np.flatnonzero((h[:-1] >> np.uint32(32 - mask_bits) == 0) & (b[1:] & 0xC0 != 0x80)) + 1
        for at in found.tolist():
            if at - out[-1] >= least and len(data) - at >= least:
                out.append(at)
    return [*out, len(data)]


def _safe(data: bytes, low: int, high: int, last: bool) -> int:
    """The last (or first) place from low to high where a space follows a character that is no
    white space; -1: none."""
    at = high if last else low
    while True:
        at = data.rfind(b" ", low, at) if last else data.find(b" ", at, high)
        if at < 0:
            return -1
        k = at - 1
        while k > low and data[k] & 0xC0 == 0x80:
            k -= 1
        if at > low and (0x21 <= data[k] <= 0x7E or data[k] >= 0xC0 and not data[k:at].decode().isspace()):
            return at
        if not last:
            at += 1


def _address(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _ids_of(bpe: ByteBPE, chunk: bytes, known: dict[bytes, np.ndarray]) -> np.ndarray:
    ids = known.get(_address(chunk)) if known else None
    return bpe.encode(chunk.decode()) if ids is None else ids


def encode(bpe: ByteBPE, text: str, known: dict[bytes, np.ndarray]) -> np.ndarray:
    """Ids of text; known: ids of some of its chunks, by address."""
    if not text:
        return np.zeros(0, np.uint32)
    data = text.encode()
    at = [0, len(data)] if bpe.has_special(text) else cuts(data)
    if len(at) == 2:
        return _ids_of(bpe, data, known)
    # what lies between repaired stretches, as (start, stop) in bytes, for each chunk
    inner: list[tuple[int, int, int]] = []
    begin = 0
    for i in range(len(at) - 1):
        low = begin if i == 0 else _safe(data, at[i], at[i + 1], last=False)
        high = at[i + 1] if i == len(at) - 2 else _safe(data, at[i], at[i + 1], last=True)
        if 0 <= low <= high and (i == 0 or low > at[i]):
            inner.append((i, low, high))
    out, done = [], 0
    for i, low, high in inner:
        if low > done:
            out.append(bpe.encode(data[done:low].decode()))
        ids = _ids_of(bpe, data[at[i] : at[i + 1]], known)
        ends = at[i] + np.cumsum(bpe.sizes[ids])
        a = 0 if low == at[i] else int(np.searchsorted(ends, low)) + 1
        b = int(np.searchsorted(ends, high)) + 1 if high > at[i] else 0
        if (a and ends[a - 1] != low) or (b and ends[b - 1] != high):  # no agreement: the stretch again
            out.append(bpe.encode(data[low:high].decode()))
        else:
            out.append(ids[a:b])
        done = high
    if done < len(data):
        out.append(bpe.encode(data[done:].decode()))
    return np.concatenate(out)


def _chunks(bpe: ByteBPE, text: str) -> tuple[bytes, list[int]]:
    data = text.encode()
    return data, [0, len(data)] if bpe.has_special(text) else cuts(data)


def chunk_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, chunk, address of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            ids, places, marks = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text:
                    data, at = _chunks(bpe, text)
                    for i in range(len(at) - 1):
                        ids.append(doc)
                        places.append(i)
                        marks.append(_address(data[at[i] : at[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(marks, pa.binary())], ["doc_id", "chunk", "address"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk int, address binary")


def encode_all(docs: DataFrame, tokenizer: str, finish, schema: str, arrow: pa.Schema) -> DataFrame:
    """finish(bpe, doc_ids, list of id arrays) -> columns, for every document."""
    docs = docs.select("doc_id", "text")
    chunks = common.written(chunk_table(docs, tokenizer), "chunks")
    first = F.min(F.struct("doc_id", "chunk"))
    shared = chunks.groupBy("address").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").select("address", "first.doc_id", "first.chunk")
    shared = common.written(shared, "shared")

    def encode_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            marks, ids = [], []
            for text, places in zip(batch["text"].to_pylist(), batch["places"].to_pylist(), strict=True):
                data, at = _chunks(bpe, text)
                for i in (k for k in places if k < len(at) - 1):
                    part = data[at[i] : at[i + 1]]
                    marks.append(_address(part))
                    ids.append(bpe.encode(part.decode()).astype("<u2" if len(bpe.bytes) <= 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(ids, pa.binary())], ["address", "ids"])

    makers = common.written(shared.groupBy("doc_id").agg(F.collect_list("chunk").alias("places")), "makers")
    once = common.keyed(docs, makers, "doc_id", "inner", 64)
    encoded = common.written(once.select("text", "places").mapInArrow(encode_once, "address binary, ids binary").dropDuplicates(["address"]), "encoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        kind = "<u2" if len(bpe.bytes) <= 1 << 16 else "<u4"
        for batch in batches:
            docs_, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            given = batch["given"].to_pylist() if "given" in batch.schema.names else [None] * len(docs_)
            out = []
            for text, parts in zip(texts, given, strict=True):
                known = {p["address"]: np.frombuffer(p["ids"], kind).astype(np.uint32) for p in parts or ()}
                out.append(encode(bpe, text or "", known))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(finish(bpe, docs_, out), arrow, strict=True)], schema=arrow)

    parts = chunks.join(encoded, "address").groupBy("doc_id").agg(F.collect_set(F.struct("address", "ids")).alias("given"))
    holders = common.written(chunks.join(encoded.select("address"), "address", "left_semi").select("doc_id").distinct(), "holders")
    alone = common.keyed(docs, holders, "doc_id", "left_anti").mapInArrow(run, schema)
    joined = common.keyed(docs, holders, "doc_id", "left_semi").join(parts, "doc_id").mapInArrow(run, schema)
    return alone.unionByName(joined)


def _digests(bpe: ByteBPE, docs: list, ids: list[np.ndarray]) -> list[list]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [docs, [len(x) for x in ids], [sha(x.astype("<u4").tobytes()) for x in ids], [sha(bpe.decode(x).encode()) for x in ids]]


def _ids(bpe: ByteBPE, docs: list, ids: list[np.ndarray]) -> list[list]:
    return [docs, [x.astype("<u4").tobytes() for x in ids]]


def encoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every document."""
    return encode_all(docs, tokenizer, _ids, "doc_id long, ids binary", pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return encode_all(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", arrow)
