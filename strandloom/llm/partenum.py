"""N-gram Jaccard join by PartEnum signatures: links at 0.8 or more, exactly, and components.

Sets whose Jaccard similarity is at least 4/5 have sizes within a ratio of 5/4 and differ in at
most (a + b) / 9 elements. Sizes are cut into bands; a set makes signatures for its own band
and the next larger one. For a band whose sets differ in at most k elements, the feature domain
is partitioned into k + 1 + E parts, of which each difference can touch one, so two similar
sets agree on at least E + 1 parts. A signature is the band, the part and the set's elements in
it. Signatures of empty parts say nothing and are left out while a set has at most E of them;
then at least one part that agrees is not empty. (This is the scheme with one-level
enumeration; E is chosen from the size so that few sets have more empty parts, and those do
emit them.)

Frequent shingles are removed before signatures are made, which only shrinks differences, so
documents that share a passage alone do not meet. Sets that this leaves with too many empty
parts make signatures from the whole set as well. Which shingles are frequent is estimated on
one document in 64; the choice affects cost, never the result.

Equal sets count once. Signatures travel packed by hash bucket and are grouped in each task
before the shuffle: a hot one sends one entry from each unit of a task. The number of buckets
follows the input, so that a bucket holds about BUCKET signatures at any size. Members of a signature
are compared with its most connected member first, and then across the components this leaves:
all pairs of a small group, and those members of a large one whose differences from the most
connected document of the center's component share an element early in a common order, which is
exact (see _Verifier.sharing). A comparison has an exact lower bound on the difference from
counts by hash range, then the exact intersection.

Defined cases: null, empty and blank texts have no shingles and are their own components;
repeated rows and equal texts share a set and so a component; rows that share a doc_id are one
document; rows without a doc_id have no component and stay; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import shingle_set

SEED = 11
#: Sample of documents for frequent shingles, the least count there, and the most kept.
SAMPLE, OFTEN, MOST_OFTEN = 64, 6, 1 << 21
#: Signatures that a task packs together, and about how many a bucket holds in all.
UNIT, BUCKET = 1 << 20, 1 << 22
_U = np.uint64


@functools.cache
def bands() -> list[int]:
    """Largest size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


@functools.cache
def parts_of(band: int) -> tuple[int, int]:
    """Parts of the band, and E."""
    hi = bands()
    k = 2 * hi[band] // 9
    least = hi[band - 2] + 1 if band >= 2 else 1
    best = None
    for n in range(k + 1, 3 * (k + 1) + 8, max(1, k // 64)):
        mean = n * math.exp(least * math.log1p(-1 / n)) if n > 1 else 0.0
        spare = n - k - 1
        if spare >= mean + 3.5 * math.sqrt(mean):
            return n, spare
        if best is None or spare - mean > best[0]:
            best = spare - mean, n, spare
    return best[1], best[2]


def _by_part(e: np.ndarray, band: int, space: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of the parts that are not empty, those parts, and the number of parts."""
    n, _ = parts_of(band)
    part = (e >> _U(32)) * _U(n) >> _U(32)
    first = np.flatnonzero(np.diff(part, prepend=_U(n))) if len(e) else np.zeros(0, np.int64)
    held = part[first]
    total = np.add.reduceat(common.mix(e ^ _U(0x5BF03635)), first) if len(e) else np.zeros(0, _U)
    return common.mix(total * _U(3) + held * _U(0x9E3779B97F4A7C15) + _U((band * 2 + space) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)), held, n


def signatures(e: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """All signatures of a set of hashes in ascending order."""
    own = int(np.searchsorted(bands(), len(e)))
    few = e
    if len(frequent):
        at = np.searchsorted(frequent, e)
        few = e[frequent[np.minimum(at, len(frequent) - 1)] != e]
    out = []
    for band in (own, own + 1):
        spare = parts_of(band)[1]
        some, held, n = _by_part(few, band, 0)
        out.append(some)
        if n - len(held) > spare:
            whole, held, n = _by_part(e, band, 1)
            out.append(whole)
            if n - len(held) > spare:
                empty = np.setdiff1d(np.arange(n, dtype=_U), held)
                out.append(common.mix(empty + _U((band * 1000003 + 77) * 0xA0761D6478BD642F & (1 << 64) - 1)))
    return np.unique(np.concatenate(out))


def counts(e: np.ndarray) -> bytes:
    """Elements by hash range, at most 255 each: 64 ranges, or more for a large set."""
    bits = 6
    while bits < 16 and len(e) > 8 << bits:
        bits += 2
    return np.minimum(np.bincount((e >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(n, -1).sum(1) - y.reshape(n, -1).sum(1)).sum())


def _texts(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist()


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that are frequent in the sample; at most MOST_OFTEN."""

    def run(batches):
        words = common.WordHashes(SEED)
        for _, texts in _texts(batches):
            e = np.concatenate([shingle_set(t, words) for t in texts] or [np.zeros(0, _U)])
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64))], ["h"])

    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long")
    often = few.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MOST_OFTEN)
    return np.sort(often.select("h").toArrow()["h"].to_numpy().view(_U))


def _described(docs: DataFrame, buckets: int, frequent) -> DataFrame:
    """kind 0: packed signatures of a bucket; 1: packed members known to share one; 2: documents."""

    def run(batches):
        words, often = common.WordHashes(SEED), frequent.value
        seen: set[tuple[int, int]] = set()
        ids: list[int] = []
        sigs: list[np.ndarray] = []
        held = 0

        def packed():
            sig = np.concatenate(sigs)
            own = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(s) for s in sigs])
            order = np.argsort(sig, kind="stable")
            sig, own = sig[order], own[order]
            new = np.diff(sig, prepend=~sig[:1]) != 0
            shared = np.append(~new[1:], False)
            doc = np.array(ids, np.int64)
            place = ((sig >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
            low = sig & _U((1 << 48) - 1)
            rows = []
            f_place, f_low, f_own, f_more = place[new], low[new], own[new], shared[new]
            some, begin = np.unique(f_place, return_index=True)
            wide = np.uint16 if len(ids) <= 1 << 16 else np.uint32
            for b, i, j in zip(some.tolist(), begin.tolist(), [*begin[1:].tolist(), len(f_place)], strict=True):
                use, at = np.unique(f_own[i:j], return_inverse=True)
                head = np.array([j - i, len(use), np.dtype(wide).itemsize], "<u4").tobytes()
                body = f_low[i:j].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                rows.append((b, 0, head + body + at.astype(wide).tobytes() + np.packbits(f_more[i:j]).tobytes() + doc[use].tobytes()))
            if (~new).any():
                key = _named(place[~new], low[~new])
                rows.append((int(sig[0] % _U(buckets)), 1, key.tobytes() + doc[own[~new]].tobytes()))
            return _rows(rows)

        for docs_, texts in _texts(batches):
            about = []
            for d, t in zip(docs_, texts, strict=True):
                e = shingle_set(t, words)
                x = e * _U(0x9E3779B97F4A7C15)
                key = (int(common.mix(e).sum(dtype=_U)), int(common.mix(x ^ _U(len(e))).sum(dtype=_U)))
                about.append((d, len(e), key, counts(e)))
                if len(e) and key not in seen:
                    seen.add(key)
                    s = signatures(e, often)
                    ids.append(d)
                    sigs.append(s)
                    held += len(s)
                    if held >= UNIT:
                        yield packed()
                        ids, sigs, held = [], [], 0
            yield _rows([(d % buckets, 2, np.array([d, n], "<i8").tobytes() + np.array(k, "<u8").tobytes() + c) for d, n, k, c in about])
        if ids:
            yield packed()

    return docs.mapInArrow(run, "bucket int, kind int, payload binary")


def _named(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64-bit names of signatures from their buckets and last 48 bits."""
    return common.mix(low ^ common.mix(bucket.astype(_U) + _U(0x632BE59BD9B4E019)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["bucket", "kind", "payload"])


TABLE = "sig long, doc_id long, n long, h1 long, h2 long, counts binary"
NAMES = ["sig", "doc_id", "n", "h1", "h2", "counts"]


def _grouped(batches):
    """Members of signatures that occur twice or more (sig set), and the documents (n set)."""
    held: dict[int, list[bytes]] = {}

    def members(sig, doc):
        none = pa.nulls(len(sig), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(doc), none, none, none, pa.nulls(len(sig), pa.binary())], NAMES)

    for batch in batches:
        rows = zip(batch["bucket"].to_pylist(), batch["kind"].to_pylist(), batch["payload"].to_pylist(), strict=True)
        known, about = [], []
        for b, kind, p in rows:
            (held.setdefault(b, []) if kind == 0 else known if kind == 1 else about).append(p)
        for p in known:
            n = len(p) // 16
            yield members(np.frombuffer(p, _U, n), np.frombuffer(p, np.int64, n, 8 * n))
        if about:
            num = np.frombuffer(b"".join(p[:32] for p in about), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(about), pa.int64()), *(pa.array(num[:, i].copy()) for i in range(4)), pa.array([p[32:] for p in about], pa.binary())], NAMES)
    for b in list(held):
        sig, doc, more = [], [], []
        for p in held.pop(b):
            n, m, wide = np.frombuffer(p, "<u4", 3).tolist()
            low = np.zeros((n, 8), np.uint8)
            low[:, :6] = np.frombuffer(p, np.uint8, 6 * n, 12).reshape(n, 6)
            at = 12 + 6 * n
            own = np.frombuffer(p, np.uint16 if wide == 2 else np.uint32, n, at)
            at += wide * n
            flags = np.frombuffer(p, np.uint8, -(-n // 8), at)
            sig.append(low.view(_U).ravel())
            more.append(np.unpackbits(flags, count=n).astype(bool))
            doc.append(np.frombuffer(p, np.int64, m, at + len(flags))[own])
        sig, doc, more = np.concatenate(sig), np.concatenate(doc), np.concatenate(more)
        order = np.argsort(sig, kind="stable")
        sig, doc, more = sig[order], doc[order], more[order]
        same = np.append(sig[1:] == sig[:-1], False) if len(sig) else np.zeros(0, bool)
        twice = same | np.roll(same, 1) | more
        if twice.any():
            yield members(_named(np.full(int(twice.sum()), b), sig[twice]), doc[twice])


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """v, c: the least vertex that links (a, b) connect with v, for every vertex of a link."""
    both = common.written(links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a")).distinct(), "edges")
    labels = common.written(both.groupBy("v").agg(F.least("v", F.min("u")).alias("c")), name)
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("m"))
        lower = labels.join(near, "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("further"))
        new = common.written(lower.join(jump, "c", "left").select("v", F.least("c", F.coalesce("further", "c")).alias("c"), "was"), name)
        if new.where("c < was").limit(1).count() == 0:
            return labels
        labels = new.select("v", "c")


#: Members of a signature up to which all pairs across its components are compared.
MANY = 8


class _Verifier:
    """Checks candidate pairs (a, b), each once; keeps the sets it has made."""

    def __init__(self, docs: DataFrame, about: DataFrame):
        self.docs, self.about, self.sets, self.tested, self.links = docs, about, None, None, None

    def check(self, pairs: DataFrame) -> None:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = common.written(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        d = self.about.select("doc_id", "n", "counts")
        wide = pairs.join(d.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca")), "a")
        wide = wide.join(d.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb")), "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")

        def near(batches):
            for batch in batches:
                na, nb, ca, cb = (batch[c].to_pylist() for c in ("na", "nb", "ca", "cb"))
                ok = [9 * least_difference(w, z) <= x + y for x, y, w, z in zip(na, nb, ca, cb, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        maybe = common.written(wide.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(near, "a long, b long"), "maybe")
        s = self.made(maybe.select(F.col("a").alias("doc_id")).union(maybe.select("b")))

        def similar(batches):
            for batch in batches:
                ok = []
                for x, y in zip(batch["ea"], batch["eb"], strict=True):
                    u, v = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    ok.append(100 * both >= 80 * (len(u) + len(v) - both))
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        full = maybe.join(s.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb")), "b").join(s.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea")), "a")
        found = self.few_rows(full.select("a", "b", "ea", "eb").mapInArrow(similar, "a long, b long"), "links")
        self.links = found if self.links is None else self.links.union(found)

    def few_rows(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table, made with small Arrow batches as its rows hold sets."""
        conf = self.docs.sparkSession.conf
        rows = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
        try:
            return common.written(df, name)
        finally:
            conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)

    def made(self, ids: DataFrame) -> DataFrame:
        """doc_id, elements: the sets of those documents, and of others made before."""
        ids = ids.distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("doc_id"), "doc_id", "left_anti")
        ids = common.written(ids, "wanted")

        def make(batches):
            words = common.WordHashes(SEED)
            for docs_, texts in _texts(batches):
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary())], ["doc_id", "elements"])

        sets = common.written(common.keyed(self.docs, ids, "doc_id", "left_semi").mapInArrow(make, "doc_id long, elements binary").dropDuplicates(["doc_id"]), "sets")
        self.sets = sets if self.sets is None else self.sets.union(sets)
        return self.sets

    def sharing(self, stars: DataFrame, frequent) -> DataFrame:
        """Pairs of members of a star (a: hub, rep, c: rep's component) that can still link.

        Let D(x) be x's difference from the hub. Two members differ in |D(x)| + |D(y)| -
        2 |D(x) & D(y)| elements, at most (|x| + |y|) / 9 of them if they link. Members that link with
        the hub are connected through it, so one of a pair does not: 9 |D(y)| > |y| + |a|. Hence
        2 |D(x) & D(y)| > |D(x)| + (|a| - |x|) / 9 >= 0. All differences are put in one order, rare ones
        first: those the hub lacks, then frequent ones of these, then the hub's own. The first
        element shared has all others after it, which bounds its place in both differences; only
        elements that early are emitted, and only pairs that meet in one are compared."""
        s = self.made(stars.select(F.col("rep").alias("doc_id")).union(stars.select("a")))
        full = stars.join(s.select(F.col("doc_id").alias("rep"), F.col("elements").alias("er")), "rep").join(s.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea")), "a")
        names = ["a", "d", "rep", "c", "n", "size", "rest", "linked", "early"]

        def differences(batches):
            often = frequent.value
            for batch in batches:
                rows: list[list[np.ndarray]] = [[] for _ in names]
                for a, rep, c, x, y in zip(*(batch[k].to_pylist() for k in ("a", "rep", "c")), batch["er"], batch["ea"], strict=True):
                    x, hub = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                    new, gone = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
                    known = np.isin(new, often, assume_unique=True) if len(often) else np.zeros(len(new), bool)
                    d = np.concatenate([new[~known], new[known], gone])
                    rest = len(d) - np.arange(len(d))
                    near, early = 9 * len(d) <= len(x) + len(hub), 9 * (2 * rest - len(d)) > len(hub) - len(x)
                    # a partner has at most 5/4 of the size, so together they differ in n / 4
                    use = early if near else np.arange(len(d)) <= len(x) // 4
                    for o, v in zip(rows, (a, d.view(np.int64), rep, c, len(x), len(d), rest, int(near), early), strict=True):
                        o.append(np.broadcast_to(v, len(d))[use].astype(np.int64))
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in rows], names)

        own = self.few_rows(full.select("a", "rep", "c", "er", "ea").mapInArrow(differences, ", ".join(f"{k} long" for k in names)), "differences")
        x = own.where("linked = 0").select("a", "d", *(F.col(k).alias(k + "_x") for k in names[2:]))
        y = own.where("early = 1").select("a", "d", *(F.col(k).alias(k + "_y") for k in names[2:]))
        most = F.expr("9 * (size_x + size_y) - n_x - n_y")
        met = x.join(y, ["a", "d"]).where("c_x != c_y and (linked_y = 1 or (early_x = 1 and rep_x < rep_y)) and 5 * least(n_x, n_y) >= 4 * greatest(n_x, n_y)")
        return met.where((18 * F.least("rest_x", "rest_y")) >= most).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))


def _nameless(docs: DataFrame) -> DataFrame:
    """doc_id, n, rep, c of rows without a doc_id: they are linked with nothing."""

    def run(batches):
        words = common.WordHashes(SEED)
        for _, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(shingle_set(t, words)) for t in texts], pa.int64())], ["n"])

    none = F.lit(None).cast("long")
    rows = docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "n long")
    return rows.select(none.alias("doc_id"), "n", none.alias("rep"), none.alias("c"))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, rep: the least doc_id with an equal set, c: component of rep), and
    the links between different sets (a, b)."""
    spark, nameless = docs.sparkSession, _nameless(docs)
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one signature for each ten bytes; buckets grow with the input, so none holds more than BUCKET
    buckets = common.tasks_for(spark, size // 10, BUCKET)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))
    table = common.written(_described(docs, buckets, frequent).repartition(buckets, "bucket").mapInArrow(_grouped, TABLE), "signatures")
    rows = table.where("n is not null").select("doc_id", "n", "h1", "h2", "counts")
    classes = common.written(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    every = common.written(rows.join(classes, ["h1", "h2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), "counts"), "classed")
    about = every.where("doc_id = rep").dropDuplicates(["doc_id"])
    own = table.where("sig is not null").select("sig", "doc_id").join(every.select("doc_id", "rep").distinct(), "doc_id").select("sig", "rep").distinct()
    own = common.written(own, "members")
    sizes = common.written(own.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
    members = common.written(own.join(sizes, "sig"), "members")
    score = common.written(members.groupBy("rep").agg(F.sum(F.least("k", F.lit(1000))).alias("score")), "scores")
    members = common.written(members.join(score, "rep").select("sig", "rep", "score"), "scored")

    check = _Verifier(docs, about)
    best = F.max(F.struct("score", -F.col("rep")))
    center = common.written(members.groupBy("sig").agg(best.alias("m")).select("sig", (-F.col("m.col2")).alias("a")), "centers")
    check.check(members.join(center, "sig").select("a", F.col("rep").alias("b")))
    labels = components(check.links)
    named = members.join(labels.select(F.col("v").alias("rep"), "c"), "rep", "left").select("sig", "rep", "score", F.coalesce("c", "rep").alias("c"))
    named = common.written(named, "named")
    hubs = common.written(named.groupBy("c").agg(best.alias("m")).select(F.col("c").alias("main"), (-F.col("m.col2")).alias("a")), "hubs")
    first = F.max(F.struct("score", -F.col("rep"), "c"))
    mixed = named.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"), first.alias("m")).where("lo < hi and k > 2")
    mixed = mixed.select("sig", (F.col("k") > MANY).alias("many"), F.col("m.c").alias("main"))
    left = common.written(named.join(common.written(mixed, "mixed"), "sig"), "left")
    few = left.where("not many").select("sig", "rep", "c")
    x, y = few.select("sig", F.col("rep").alias("a"), F.col("c").alias("ca")), few.select("sig", F.col("rep").alias("b"), F.col("c").alias("cb"))
    pairs = x.join(y, "sig").where("ca < cb").select("a", "b")
    stars = left.where("many").select("main", "rep", "c").distinct().join(hubs, "main").where("a != rep").select("a", "rep", "c")
    stars = common.written(stars, "stars")
    check.check(pairs.union(stars.select("a", "rep")).union(check.sharing(stars, frequent)))
    labels = components(check.links)
    out = every.join(labels.select(F.col("v").alias("rep"), "c"), "rep", "left").select("doc_id", "n", "rep", F.coalesce("c", "rep").alias("c"))
    return out.unionByName(nameless), check.links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = linked(common.documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the least of their component, with their columns."""
    out, _ = linked(docs)
    return docs.join(out.where("doc_id > c").select("doc_id").distinct(), "doc_id", "left_anti")
