"""The class-based model against a plain count over the same texts and classes."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import brown_lm as B

RNG = np.random.default_rng(31)
KINDS = [["".join(RNG.choice(list("abcdefghijkl"), 5)) for _ in range(60)] for _ in range(4)]


def sentence() -> str:
    """Words of four kinds in turn: what comes next tells the kind."""
    at = RNG.integers(4)
    return " ".join(KINDS[(at + i) % 4][min(59, RNG.geometric(0.05))] for i in range(RNG.integers(30, 90)))


TEXTS = [*(sentence() for _ in range(120)), None, "", "Only Once ünïque", "Zz\x1czz ZZ", " \t\n", "É é " * 40]
held_out = lambda: F.col("doc_id") % 7 == 2


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[1], "clash", 1), (0, TEXTS[0], "clash", 1), (0, TEXTS[0], "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, c long").repartition(3)


def tokens(t):
    return (t or "").encode().lower().split()


def train(docs):
    return [tokens(r.text) for r in docs.collect() if r.doc_id % 7 != 2]


def classes(model):
    at = {int(h): int(k) for h, k in zip(model.hashes, model.cls, strict=False)}
    return lambda w: at.get(B.word_hash(w), B.EXCHANGED + zlib.crc32(w.decode()[-2:].encode()) % B.SUFFIX)


def test_hashes_are_sparks(spark):
    words = ["", "a", "é" * 9, "x" * 100, "\U0001f600"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(r.h % (1 << 64) == B.word_hash(r.w.encode()) for r in got)


@pytest.mark.parametrize("most", [B.HEAD, 40])
def test_scores(docs, most):
    """Also where the head is bounded and most words are outside of it."""
    model = B.fit(docs, held_out(), most)
    own, of = train(docs), classes(model)
    c = Counter(w for t in own for w in t)
    assert len(model.counts) <= most and model.least == (2 if most > 40 else model.least)
    assert dict(zip(model.hashes.tolist(), model.counts.tolist(), strict=True)) == {B.word_hash(w): n for w, n in c.items() if n >= model.least}
    pairs = np.zeros((B.CLASSES, B.CLASSES))
    for t in own:
        k = [B.END, *map(of, t), B.END]
        for a, b in zip(k[:-1], k[1:], strict=True):
            pairs[a, b] += 1
    assert (pairs == model.pairs).all()
    n, v = Counter(), Counter(map(of, c))
    for w, m in c.items():
        n[of(w)] += m
    room = lambda k: n[k] + B.SMOOTH * (v[k] + 1)
    emit = lambda w: (c[w] + B.SMOOTH) / room(of(w)) if c[w] else B.SMOOTH / room(of(w))
    step = (pairs + B.SMOOTH) / (pairs.sum(1, keepdims=True) + B.SMOOTH * B.CLASSES)
    assert step.sum(1) == pytest.approx(1)
    for k in range(B.END):  # the words of a class and one unseen one
        assert sum(emit(w) for w in c if of(w) == k) + B.SMOOTH / room(k) == pytest.approx(1)
    total, kinds = sum(c.values()) + len(own), len(c) + 1
    got = B.scored(model).collect()
    assert len(got) == docs.count()
    want = Counter()
    for r in docs.collect():
        t = tokens(r.text)
        k = [B.END, *map(of, t), B.END]
        s = sum(math.log10(step[a, b]) for a, b in zip(k[:-1], k[1:], strict=True)) + sum(math.log10(emit(w)) for w in t)
        base = sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in t) + math.log10((len(own) + 1) / (total + kinds + 1))
        want[r.doc_id, r.doc_id % 7 == 2, len(t) + 1, sum(c[w] > 0 for w in t) + 1, total, round(base, 6), round(s, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_exchange_raises_the_likelihood(docs):
    model = B.fit(docs, held_out())
    trail = model.trail
    assert B.likelihood(model.pairs) == pytest.approx(max(trail))  # rounds that lower it are undone
    assert trail[0] < trail[1] <= max(trail), trail
    of = classes(model)
    groups = [Counter(of(w.encode()) for w in kind) for kind in KINDS]
    assert all(sum((a & b).values()) <= 6 for i, a in enumerate(groups) for b in groups[:i])  # kinds hardly share a class
    held = {r.doc_id: r for r in B.scored(model).collect() if r.held_out and r.n_tokens > 20}
    assert sum(r.score for r in held.values()) > 0.85 * sum(r.base_score for r in held.values())


def test_best_class_is_that_of_the_exact_change():
    """For single words without neighbours of their own class the left-out terms are none."""
    pairs = RNG.integers(50, 400, (B.CLASSES, B.CLASSES))
    for trial in range(20):
        own = int(RNG.integers(B.EXCHANGED))
        side = np.unique(RNG.choice([s for s in range(B.SIDES) if s % B.CLASSES not in (own, B.END)], 9))
        before = int((side < B.CLASSES).sum())
        n = RNG.integers(1, 40, len(side))
        left, right = n[side < B.CLASSES].sum(), n[side >= B.CLASSES].sum()
        if not before or before == len(side):
            continue
        n[0 if left < right else -1] += abs(left - right)

        def after(k, n=n, side=side, own=own):
            p = pairs.astype(float).copy()
            for s, m in zip(side, n, strict=True):
                i = int(s % B.CLASSES)
                for to, sign in ((own, -1), (k, 1)):
                    p[(i, to) if s < B.CLASSES else (to, i)] += sign * m
            return B.likelihood(p)

        exact = [after(k) for k in range(B.EXCHANGED)]
        got = int(B.Gains(pairs).best(np.zeros(len(side), int), side, n, np.array([own]))[0])
        assert exact[got] >= max(exact) - 0.5


def test_empty(docs):
    assert B.score(docs.limit(0), held_out()).count() == 0
    only_held = B.score(docs.where(held_out()), held_out()).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in only_held)
