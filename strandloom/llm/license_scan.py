"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is parsed into a tree of words, optional parts and replaceable regions (any words
within bounds, or one of several wordings) and compiled into a nondeterministic automaton over
words without empty steps. A stretch of a text is accepted if its mandatory wording is the
template's, word by word. Of a template's accepted stretches those that begin first are taken, the
longest of each, none overlapping another of the same template.

Every accepted stretch holds one of the template's anchors (wordings that no match can lack), and
has a greatest length, so the automaton walks only the words near an anchor; the rest of a text
is searched for anchors as bytes. Work is in proportion to the text, each row is worked on by
itself, nothing is shuffled, and a task holds one batch of texts.

Defined cases: null text is empty; an empty or blank text has no words, no places, no labels and
score 0; a null doc_id and repeated rows are rows like any other; an empty table gives an empty
result; other columns are ignored. Words of any script count, digits too.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES

#: Fixed: phrases whose every place counts, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: A-Z lower-cased; other bytes that no word holds become blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def parsed(markup: str) -> list:
    """A sequence of ("word", w), ("optional", sequence) and ("one of", sequences), by nesting."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_MARK.finditer(markup), None]:
        stack[-1] += [("word", w) for w in words(markup[at : m.start() if m else len(markup)])]
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            part = stack.pop()
            stack[-1].append(("optional", part))
        elif bounds := re.search(r'words="(\d+)-(\d+)"', m[2]):
            stack[-1].append(("any", (int(bounds[1]), int(bounds[2]))))
        elif wordings := re.search(r'match="([^"]*)"', m[2]):
            stack[-1].append(("one of", [[("word", w) for w in words(x)] for x in wordings[1].split("|")]))
        else:
            raise ValueError(f"a region needs words or match: {m[0]}")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


class Automaton:
    """A template as states and steps. on[s]: a word's next states; any[s]: those of every word."""

    def __init__(self, markup: str):
        self.on: list[dict[bytes, set[int]]] = []
        self.any: list[set[int]] = []
        self.free: list[set[int]] = []  # empty steps while building
        tree = parsed(markup)
        start = self._state()
        end = self._sequence(tree, start)
        closed = [self._closed(s) for s in range(len(self.free))]
        self.accepts = {s for s, c in enumerate(closed) if end in c}
        self.on = [{w: set().union(*(self.on[s].get(w, ()) for s in c)) for w in set().union(*(self.on[s].keys() for s in c))} for c in closed]
        self.any = [set().union(*(self.any[s] for s in c)) for c in closed]
        self.start, self.longest = start, self._longest(tree)
        self.anchor = max(self._runs(tree), key=lambda run: len(b" ".join(run)))
        if not self.anchor or start in self.accepts:
            raise ValueError("a template needs mandatory words")
        self.anchor_bytes = b" " + b" ".join(self.anchor) + b" "

    def _state(self) -> int:
        self.on.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.on) - 1

    def _sequence(self, tree: Sequence, at: int) -> int:
        for kind, x in tree:
            after = self._state()
            if kind == "word":
                self.on[at].setdefault(x, set()).add(after)
            elif kind == "optional":
                self.free[at].add(after)
                self.free[self._sequence(x, at)].add(after)
            elif kind == "one of":
                for wording in x:
                    self.free[self._sequence(wording, at)].add(after)
            else:
                for k in range(x[1]):
                    if k >= x[0]:
                        self.free[at].add(after)
                    one = self._state()
                    self.any[at].add(one)
                    at = one
                self.free[at].add(after)
            at = after
        return at

    def _closed(self, s: int) -> set[int]:
        out, new = {s}, [s]
        while new:
            more = self.free[new.pop()] - out
            out |= more
            new += more
        return out

    def _longest(self, tree: Sequence) -> int:
        size = {"word": lambda x: 1, "optional": self._longest, "one of": lambda x: max(map(self._longest, x)), "any": lambda x: x[1]}
        return sum(size[kind](x) for kind, x in tree)

    @staticmethod
    def _runs(tree: Sequence) -> list[list[bytes]]:
        """Runs of words that every match has: those at the top, apart from any other part."""
        runs: list[list[bytes]] = [[]]
        for kind, x in tree:
            if kind == "word":
                runs[-1].append(x)
            else:
                runs.append([])
        return runs

    def _near(self, line: bytes, n: int) -> Iterator[tuple[int, int]]:
        """Ranges of words, apart from one another, that hold every match: those near anchors."""
        low = high = -1
        for k in places(line, self.anchor_bytes):
            a, b = max(0, k - self.longest), min(n, k + len(self.anchor) + self.longest)
            if a > high:
                if high >= 0:
                    yield low, high
                low = a
            high = b
        if high >= 0:
            yield low, high

    def matches(self, line: bytes, tokens: Sequence[bytes]) -> Iterator[tuple[int, int]]:
        """Accepted stretches (start, stop) of the words, the first and longest, apart from one another."""
        for low, high in self._near(line, len(tokens)):
            at = low
            while at < high and (found := self._first(tokens, at, high)):
                yield found
                at = found[1]

    def _first(self, tokens: Sequence[bytes], low: int, high: int) -> tuple[int, int] | None:
        threads: dict[int, int] = {}  # state: where its stretch began, the first if there are several
        best: tuple[int, int] | None = None
        for i in range(low, high):
            word, after = tokens[i], {}
            if best is None:
                threads[self.start] = i  # no step leads to the start, so none is lost
            for s, began in threads.items():
                if best is not None and began > best[0]:
                    continue
                for t in (*self.on[s].get(word, ()), *self.any[s]):
                    if began < after.get(t, i + 1):
                        after[t] = began
            for t, began in after.items():
                if t in self.accepts and (best is None or began < best[0] or (began == best[0] and i + 1 > best[1])):
                    best = began, i + 1
            threads = after
            if best is not None and not any(began <= best[0] for began in threads.values()):
                break
        return best


def places(line: bytes, phrase: bytes) -> Iterator[int]:
    """The words at which a phrase stands; line and phrase: words between single blanks, one at
    each end too. Places may overlap."""
    at, word, seen = line.find(phrase), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        yield word
        at = line.find(phrase, at + 1)


@functools.cache
def _compiled(templates: tuple) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(markup)) for label, markup in templates]


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def _covered(spans: list[dict]) -> int:
    total = end = 0
    for s in sorted(spans, key=lambda s: s["start"]):
        total += max(0, s["stop"] - max(end, s["start"]))
        end = max(end, s["stop"])
    return total


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """doc_id, n_words, base and matches (arrays of label, start, stop in words: phrases' places and
    accepted stretches of templates) and covered, the words that lie in any of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    look = [(label, len(p.split()), f" {p} ".encode()) for p, label in phrases]

    def run(batches):
        automata = _compiled(templates)
        for batch in batches:
            n, base, found, covered = [], [], [], []
            for text in batch["text"].to_pylist():
                tokens = words(text)
                line = b" " + b" ".join(tokens) + b" "
                n.append(len(tokens))
                base.append([{"label": label, "start": k, "stop": k + size} for label, size, p in look for k in places(line, p)])
                found.append([{"label": label, "start": a, "stop": b} for label, x in automata if x.anchor_bytes in line for a, b in x.matches(line, tokens)])
                covered.append(_covered(base[-1] + found[-1]) if base[-1] or found[-1] else 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(base, _SPANS), pa.array(found, _SPANS), pa.array(covered, pa.int64())], ["doc_id", "n_words", "base", "matches", "covered"])

    spans = "array<struct<label: string, start: long, stop: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, base {spans}, matches {spans}, covered long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return scan(common.documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "matches.label")).alias("labels"),
        F.coalesce(F.try_divide("covered", "n_words"), F.lit(0.0)).alias("score"),
    )
