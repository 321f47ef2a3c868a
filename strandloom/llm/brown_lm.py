"""Class-based n-grams: exchange clustering of words, smoothed class bigrams, perplexity.

P(word | history) = P(class | previous class) * P(word | class). Every word that occurs LEAST
times or more in training (up to HEAD words, the more frequent ones first; that bounds what is
broadcast) is moved between EXCHANGED classes. In a round one pass counts, for one share of
these words, the classes before and after each as a sparse table, and each word of the share
then takes the class that raises the likelihood of class bigrams most. Rounds go on until a
sweep over all shares raises the measured likelihood by less than TOLERANCE of its gain over
independent classes; moves that lower it are undone, and fewer words move at once from then on. Other words (seen once, or beyond HEAD)
belong to SUFFIX further classes by their last two characters. A last class is the end of a
text. Transitions and emissions have SMOOTH added; each class keeps room for one unseen word, so
probabilities sum to one.

All counts are over all training texts. Words are known by 64-bit hashes in sorted arrays of at
most HEAD entries; counts of other words meet their texts by a join on the word. Sparse counts
are merged in two levels, each adding what comes in to arrays of a fixed size, so no task holds
more than its blocks of words whatever the number of tasks before it.

Defined cases: null and empty texts have the end token alone; without training rows every token
is unseen; repeated rows count as often as they occur, and rows that share a doc_id are scored
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, HEAD = 2, 1 << 21
EXCHANGED, SUFFIX, SMOOTH = 48, 32, 0.5
CLASSES = EXCHANGED + SUFFIX + 1
END = CLASSES - 1
#: Sweeps at most, words of one round (one in SHARES), and the gain that ends the search.
SWEEPS, SHARES, TOLERANCE = 10, 3, 0.01
FLUSH, BLOCK = 200_000, 384
SIDES = 2 * CLASSES
assert BLOCK * SIDES < 1 << 16  # steps between keys of a block fit 16 bits


def word_hash(word: bytes) -> int:
    """As Spark's xxhash64 of the word, unsigned."""
    return xxhash.xxh64_intdigest(word, 42)


def _texts(batches, step: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, [t.lower().split() for t in part["text"].cast(pa.binary()).to_pylist()]


def vocabulary(train: DataFrame) -> DataFrame:
    """word, c: counts over the training texts."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for _, texts in _texts(batches):
            for words in texts:
                seen.update(words)
            if len(seen) >= FLUSH:
                yield out()
                seen.clear()
        yield out()

    return train.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(vocab: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and counts of the words that are exchanged, and their least count: LEAST,
    or the first power of two that at most `most` words reach."""
    logs = vocab.where(F.col("c") >= LEAST).groupBy(F.floor(F.log2("c")).cast("int").alias("e")).agg(F.count("*").alias("n")).collect()  # at most 64 rows
    least, n = LEAST, sum(r.n for r in logs)
    for r in sorted(logs, key=lambda r: r.e):
        if n <= most:
            break
        least, n = 2 ** (r.e + 1), n - r.n
    rows = vocab.where(F.col("c") >= least).select(F.xxhash64("word").alias("h"), "c").toArrow()  # at most `most` rows
    h, c = rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], least


class _Ids(dict):
    """A running number for each word; words keeps those not yet asked for."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.words.append(word)
        return k


def indexed(docs: DataFrame, head, least: int) -> DataFrame:
    """row, doc_id, held_out, ids (places in head, beyond them the class of another word; an end
    at either side), and those other words with how often they come up in the text. Where the
    head has all words but those seen once, other words of a training text are known to have
    been seen once and are not listed."""

    def run(batches):
        hashes, suffixes = head.value, {}
        n_head = len(hashes)
        end = np.array([n_head + SUFFIX], "<u4")
        numbers, known = _Ids(), np.zeros(0, "<u4")

        def ids_of(words: list[bytes]) -> np.ndarray:
            h = np.fromiter(map(word_hash, words), np.uint64, len(words))
            at = np.minimum(np.searchsorted(hashes, h), max(0, n_head - 1)).astype("<u4")
            held = hashes[at] == h if n_head else np.zeros(len(h), bool)
            for i in np.flatnonzero(~held).tolist():
                w = words[i]
                tail = w[-2:] if w[-2:].isascii() else w.decode()[-2:].encode()
                k = suffixes.get(tail)
                if k is None:
                    k = suffixes[tail] = n_head + zlib.crc32(tail) % SUFFIX
                at[i] = k
            return at

        for part, texts in _texts(batches):
            if len(numbers) >= 2 * FLUSH:
                numbers, known = _Ids(), np.zeros(0, "<u4")
            local = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in texts]
            if numbers.words:
                known = np.concatenate([known, ids_of(numbers.words)])
                numbers.words = []
            ids, rare, times = [], [], []
            listed = [least > LEAST or x for x in part["held_out"].to_pylist()]
            for words, at, told in zip(texts, local, listed, strict=True):
                seq = known[at]
                tail = Counter(words[i] for i in np.flatnonzero(seq >= n_head).tolist()) if told else {}
                ids.append(np.concatenate([end, seq, end]).tobytes())
                rare.append([w.decode() for w in tail])
                times.append(list(tail.values()))
            yield pa.RecordBatch.from_arrays([part["row"], part["doc_id"], part["held_out"], pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], ["row", "doc_id", "held_out", "ids", "rare", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return rows.mapInArrow(run, "row long, doc_id long, held_out boolean, ids binary, rare array<string>, times array<int>")


def _all_ids(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of all rows, one after another."""
    x = batch["ids"]
    ends = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset)
    return np.frombuffer(x.buffers()[2], "<u4", (int(ends[-1]) - int(ends[0])) // 4, int(ends[0]))


def _class_of_id(cls: np.ndarray) -> np.ndarray:
    """cls with the end's class."""
    return np.append(cls, np.uint8(END))


def _packed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys of a block with counts: steps and counts of 16 bits, large counts apart."""
    big = np.flatnonzero(n >= 1 << 16)
    head = np.array([len(key), len(big)], "<u4").tobytes()
    return head + np.diff(key, prepend=0).astype("<u2").tobytes() + np.minimum(n, (1 << 16) - 1).astype("<u2").tobytes() + big.astype("<u4").tobytes() + n[big].astype("<i8").tobytes()


def _unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    m, k = np.frombuffer(x, "<u4", 2).tolist()
    key, n = np.cumsum(np.frombuffer(x, "<u2", m, 8), dtype=np.int64), np.frombuffer(x, "<u2", m, 8 + 2 * m).astype(np.int64)
    n[np.frombuffer(x, "<u4", k, 8 + 4 * m)] = np.frombuffer(x, "<i8", k, 8 + 4 * m + 4 * k)
    return key, n


def neighbours(train: DataFrame, cls, share: int, shares: int) -> DataFrame:
    """Block -1: class bigram counts; block b: how often each class stands before and after words
    b * BLOCK... of the share; cls: broadcast classes of ids."""

    def count(batches):
        of = _class_of_id(cls.value)
        n_head = len(of) - SUFFIX - 1
        pairs, keys, held = np.zeros(CLASSES * CLASSES, np.int64), [], 0

        def out():
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            edge = np.searchsorted(key, np.arange(0, n_head + BLOCK, BLOCK, dtype=np.uint64) * np.uint64(SIDES))
            some = np.flatnonzero(np.diff(edge))
            parts = [_packed(key[edge[b] : edge[b + 1]].astype(np.int64) - int(b) * BLOCK * SIDES, n[edge[b] : edge[b + 1]]) for b in some.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(parts, pa.binary())], ["block", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            w = _all_ids(batch)
            c = of[w]
            pairs += np.bincount(c[:-1].astype(np.int64) * CLASSES + c[1:], minlength=CLASSES**2)
            pairs[END * CLASSES + END] -= batch.num_rows - 1  # from one text's end to the next's start
            at = np.flatnonzero((w < n_head) & (w % np.uint32(shares) == share))
            base = w[at] * np.uint32(SIDES)
            keys += [base + c[at - 1], base + np.uint32(CLASSES) + c[at + 1]]
            held += 2 * len(at)
            if held >= 1 << 22:
                yield out()
                keys, held = [], 0
        if held:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pairs.tobytes()], pa.binary())], ["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                if b not in total:
                    total[b] = np.zeros(CLASSES**2 if b < 0 else BLOCK * SIDES, np.int64)
                if b < 0:
                    total[b] += np.frombuffer(x, np.int64)
                else:
                    key, n = _unpacked(x)
                    total[b][key] += n
        for b in list(total):
            x = total.pop(b)
            key = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.tobytes() if b < 0 else _packed(key, x[key])], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    tasks = common.tasks_for(train.sparkSession, len(cls.value) // BLOCK, 64)
    parts = train.select("ids").mapInArrow(count, schema)
    if (n := parts.rdd.getNumPartitions()) > 1024:  # so many tasks' counts are first added up by groups
        parts = parts.withColumn("_part", F.spark_partition_id() % (n // 256)).repartition(tasks * (n // 256), "block", "_part").drop("_part").mapInArrow(add, schema)
    return parts.repartition(tasks, "block").mapInArrow(add, schema)


def _xlogx(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """Log-likelihood of the class bigrams over that of independent classes."""
    n = pairs.sum()
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum() + _xlogx(n))


class Gains:
    """What a word adds to the likelihood in each class, from the class bigram counts. That a
    move changes the counts between its neighbours' own classes is left out; rounds measure."""

    SMALL = 24

    def __init__(self, pairs: np.ndarray):
        k = EXCHANGED
        self.cells = np.concatenate([pairs[:, :k], pairs[:k].T]).astype(float)  # before k, after k
        self.size = pairs.sum(0)[:k].astype(float), pairs.sum(1)[:k].astype(float)
        n = np.arange(self.SMALL)[:, None, None]
        self.more = (_xlogx(self.cells + n) - _xlogx(self.cells)).astype(np.float32)
        self.less = (_xlogx(self.cells) - _xlogx(np.maximum(self.cells - n, 0))).astype(np.float32)

    def best(self, word: np.ndarray, side: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The best class of each word; word: ascending places in own, side: class before, or
        CLASSES and class after, n: how often; own: classes at present."""
        out = own.copy()
        first = np.flatnonzero(np.diff(word, prepend=-1))
        edges = [*first[::256].tolist(), len(word)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            w, s, m = word[a:b], side[a:b], n[a:b]
            mine = own[w]
            value = self.more[np.minimum(m, self.SMALL - 1), s]
            stay = self.less[np.minimum(m, self.SMALL - 1), s, mine]
            if len(big := np.flatnonzero(m >= self.SMALL)):
                c = self.cells[s[big]]
                value[big] = _xlogx(c + m[big, None]) - _xlogx(c)
                c = c[np.arange(len(big)), mine[big]]
                stay[big] = _xlogx(c) - _xlogx(np.maximum(c - m[big], 0))
            value[np.arange(len(w)), mine] = stay
            at = np.flatnonzero(np.diff(w, prepend=-1))
            gain = np.add.reduceat(value, at, dtype=float)
            ids = w[at]
            k, every = own[ids], np.arange(len(ids))
            for size, there in zip(self.size, (s < CLASSES, s >= CLASSES), strict=True):
                total = np.add.reduceat(np.where(there, m, 0), at).astype(float)
                loss = _xlogx(size + total[:, None]) - _xlogx(size)
                loss[every, k] = _xlogx(size[k]) - _xlogx(np.maximum(size[k] - total, 0))
                gain -= loss
            top = gain.argmax(1)
            out[ids] = np.where(gain[every, top] > gain[every, k] + 1e-3, top, k)
        return out


def moved(sums: DataFrame, cls: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The classes after every counted word took its best one."""
    spark = sums.sparkSession
    held = spark.sparkContext.broadcast((cls, pairs))

    def run(batches):
        of, p = held.value
        gains = Gains(p)
        for batch in batches:
            for b, x in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                key, n = _unpacked(x)
                own = of[b * BLOCK : min((b + 1) * BLOCK, len(of) - SUFFIX)].astype(np.int64)
                new = gains.best(key // SIDES, key % SIDES, n, own)
                at = np.flatnonzero(new != own)
                yield pa.RecordBatch.from_arrays([pa.array((b * BLOCK + at).astype(np.int32)), pa.array(new[at].astype(np.int32))], ["w", "k"])

    rows = sums.where("block >= 0").repartition(common.tasks_for(spark, len(cls) // BLOCK, 64), "block").mapInArrow(run, "w int, k int").toArrow()  # at most HEAD rows
    out = cls.copy()
    out[rows["w"].to_numpy()] = rows["k"].to_numpy()
    return out


def exchange(train: DataFrame, counts: np.ndarray, sweeps: int = SWEEPS, shares: int = SHARES) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the head's words (then of the suffix classes), class bigram counts, and the
    likelihood after each round. At first the most frequent words have a class each and all
    others the last one; the first round moves all words, the next ones a share each."""
    cls = np.concatenate([np.full(len(counts), EXCHANGED - 1), np.arange(EXCHANGED, EXCHANGED + SUFFIX)]).astype(np.uint8)
    top = np.argsort(-counts, kind="stable")[: EXCHANGED - 1]
    cls[top] = np.arange(len(top))
    best, trail, last = None, [], sweeps * shares + 1
    k, swept, begun = 0, 0.0, 0.0
    for turn in range(last + 1):
        handle = train.sparkSession.sparkContext.broadcast(cls)
        name = common.scratch(train.sparkSession, "neighbours")
        k = (k + 1) % shares
        neighbours(train, handle, k if turn else 0, shares if turn else 1).write.parquet(name)
        sums = train.sparkSession.read.schema("block int, counts binary").parquet(name)
        first = sums.where("block = -1").first()
        pairs = np.frombuffer(first.counts, np.int64).reshape(CLASSES, CLASSES) if first else np.zeros((CLASSES, CLASSES), np.int64)
        trail.append(likelihood(pairs))
        rose = best is None or trail[-1] >= best[0]
        if rose:
            best = trail[-1], cls, pairs
        else:  # undone; fewer words move at once from now on
            shares = min(64, 2 * shares)
        if turn == 1:
            begun = best[0]
        elif turn > 1:
            swept += 1 / shares
        end = turn == last
        if swept > 0.999:  # a sweep is over
            end |= best[0] - begun <= TOLERANCE * best[0]
            swept, begun = 0.0, best[0]
        # after an undone round the counts are of classes that are given up: they are counted anew
        cls = moved(sums, cls, pairs) if rose and not end else best[1]
        handle.unpersist()
        common.emptied(sums, name)
        if end:
            break
    return best[1], best[2], trail


@dataclass
class Model:
    """vocab: word, c; hashes, counts: of the head, sorted; cls: see exchange; pairs: class
    bigram counts; least: of the head's counts; tokens, kinds: of training, ends included."""

    vocab: DataFrame
    table: DataFrame
    hashes: np.ndarray
    counts: np.ndarray
    cls: np.ndarray
    pairs: np.ndarray
    least: int
    ends: int
    tokens: int
    kinds: int
    trail: list[float]


def fit(docs: DataFrame, held_out, most: int = HEAD) -> Model:
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    train = docs.where("not held_out")
    vocab = common.written(vocabulary(train), "vocabulary")
    ends = train.count()
    totals = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    hashes, counts, least = head_of(vocab, most)
    table = common.written(indexed(docs, docs.sparkSession.sparkContext.broadcast(hashes), least), "indexed")
    cls, pairs, trail = exchange(table.where("not held_out"), counts)
    return Model(vocab, table, hashes, counts, cls, pairs, least, ends, totals.n + ends, totals.v + (1 if ends else 0), trail)


def score(docs: DataFrame, held_out, most: int = HEAD) -> DataFrame:
    """One row per row of docs: the base figures and the model's log10 probability."""
    return scored(fit(docs, held_out, most))


def scored(model: Model) -> DataFrame:
    counts, cls, pairs, n_head, ends = model.counts, model.cls, model.pairs, len(model.counts), model.ends
    kind = F.lit(EXCHANGED) + F.pmod(F.crc32(F.encode(F.substring("word", -2, 2), "utf-8")), F.lit(SUFFIX)).cast("int")
    rare = {r.k: (r.n, r.v) for r in model.vocab.where(F.col("c") < model.least).groupBy(kind.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(tokens, cls[:n_head], counts)
    np.add.at(kinds, cls[:n_head], 1)
    for k, (n, v) in rare.items():
        tokens[k], kinds[k] = n, v
    room = np.log10(tokens + SMOOTH * (kinds + 1))
    trans = np.log10(pairs + SMOOTH) - np.log10(pairs.sum(1, keepdims=True) + SMOOTH * CLASSES)
    emit = np.concatenate([np.log10(counts + SMOOTH) - room[cls[:n_head]], -room[EXCHANGED : EXCHANGED + SUFFIX]])
    base = np.concatenate([np.log10(counts + 1.0), np.zeros(SUFFIX)])
    end_base, per_token = math.log10(ends + 1), math.log10(model.tokens + model.kinds + 1)
    held = model.table.sparkSession.sparkContext.broadcast((cls, trans, emit, base))
    once = model.least == LEAST  # other words of training texts were seen once

    def run(batches):
        of, step, word, single = held.value
        of = _class_of_id(of)
        for batch in batches:
            n, known, b, s = [], [], [], []
            for x, out in zip(batch["ids"], batch["held_out"].to_pylist(), strict=True):
                ids = np.frombuffer(x.as_buffer(), "<u4")
                c, ids = of[ids], ids[1:-1]
                rest = int((ids >= n_head).sum()) if once and not out else 0
                n.append(len(ids) + 1)
                known.append(int((ids < n_head).sum()) + rest + (ends > 0))
                b.append(float(single[ids].sum()) + rest * math.log10(2) + end_base - per_token * (len(ids) + 1))
                s.append(float(step[c[:-1], c[1:]].sum() + word[ids].sum()) + rest * math.log10(1 + SMOOTH))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["held_out"], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64())], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "part"])

    own = model.table.select("row", "doc_id", "held_out", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, part double")
    words = model.table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    met = words.join(model.vocab.where(F.col("c") < model.least), "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).cast("long").alias("k"), F.sum(F.col("n") * F.log10(c + 1)).alias("b"), F.sum(F.col("n") * F.log10(c + F.lit(SMOOTH))).alias("s"))
    zero = F.lit(0.0)
    return own.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("part") + F.coalesce("s", zero)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return score(common.documents(spark, sf_dir, "doc_id", "text"), held)
