"""Token automata against a plain recursive matcher, whole licenses, and the query's contract."""

import re
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import license_scan
from strandloom.llm.license_texts import TEMPLATES
from tests.llm.test_queries import ROWS, TEXTS, lower, run, sf_dir  # noqa: F401

RNG = np.random.default_rng(3)


def ends(tree, words, at):
    """All ends of what the tree matches from at, by recursion."""
    now = {at}
    for kind, x in tree:
        if kind == "word":
            now = {i + 1 for i in now if i < len(words) and words[i] == x}
        elif kind == "any":
            now = {i + k for i in now for k in range(x[0], x[1] + 1) if i + k <= len(words)}
        elif kind == "optional":
            now |= {e for i in now for e in ends(x, words, i)}
        else:
            now = {e for i in now for wording in x for e in ends(wording, words, i)}
    return now


def plainly(tree, words):
    out, at = [], 0
    while at < len(words):
        stop = max(ends(tree, words, at) - {at}, default=None)
        if stop is not None:
            out.append((at, stop))
        at = stop or at + 1
    return out


@pytest.mark.parametrize("markup", [
    "a b", "<<beginOptional>>c<<endOptional>> a b <<beginOptional>>b<<beginOptional>>c<<endOptional>><<endOptional>>", 'a <<var;name="x";words="0-3">> b', '<<var;name="x";words="1-2">> a b <<var;name="y";words="2-3">> c',
    'a b <<var;name="x";match="c|a b|">> a', '<<beginOptional>>a <<var;name="x";words="0-2">> c<<endOptional>> b b', '<<var;name="x";words="0-4">> a <<var;name="x";words="0-4">>',
])
def test_automaton_against_recursion(markup):
    tree, automaton = license_scan.parsed(markup), license_scan.Automaton(markup)
    for n in [*range(9), *([12, 25, 60] * 60)]:
        words = [b"abc"[i : i + 1] for i in RNG.integers(0, 3, n)]
        line = b" " + b" ".join(words) + b" "
        assert list(automaton.matches(line, words)) == plainly(tree, words)


@pytest.mark.parametrize("markup", ["<<beginOptional>>a", "a<<endOptional>>", '<<var;name="x">> a', "<<beginOptional>>a<<endOptional>>", ""])
def test_faulty_templates_are_errors(markup):
    with pytest.raises(ValueError):
        license_scan.Automaton(markup)


def filled(tree, way):
    """A text of a template: all optional parts and many words (1), or none and few (0)."""
    out = []
    for kind, x in tree:
        out += [x] if kind == "word" else (filled(x, way) if way else []) if kind == "optional" else filled(x[-1 if way else 0], way) if kind == "one of" else [b"someone"] * x[way]
    return out


def test_every_template_and_a_changed_word(spark):
    rows, want = [], {}
    for label, markup in TEMPLATES:
        tree = license_scan.parsed(markup)
        for way in (0, 1):
            words = [w.decode() for w in filled(tree, way)]
            text = " ".join(w.upper() if i % 3 else w + ".\n\t" for i, w in enumerate(words))
            want[len(rows)] = (label, None)
            rows.append((len(rows), f"before it {text} after", "clash"))
            anchor = license_scan.Automaton(markup).anchor
            at = next(i for i in range(len(words)) if words[i : i + len(anchor)] == [a.decode() for a in anchor]) + len(anchor) // 2
            want[len(rows)] = (label, at + 2)  # one mandatory word is another
            rows.append((len(rows), "before it " + " ".join([*words[:at], "otherwise", *words[at + 1 :]]) + " after", "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string").repartition(3)
    for r in license_scan.scan(docs).collect():
        label, changed = want[r.doc_id]
        if changed is None:
            assert label in {m.label for m in r.matches}
        else:  # a notice at a text's head may still match, nothing over the changed word does
            assert not any(m.label == label and m.start <= changed < m.stop for m in r.matches)
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_query(spark, sf_dir):  # noqa: F811
    more = {
        100: "This work is licensed under the GNU General Public License, version 3.", 101: "x MIT license, mit LICENSE cc by cc by\ncc-by apache\x00license", 102: "Licensed under CC BY-NC 4.0.", 103: "mit licenses é mit license1",
        104: "Apache License " * 30_000, 105: "Released under the MIT License. " * 3_000, 106: "ÀMIT License",
    }
    path = sf_dir + "-licenses"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    added = spark.createDataFrame([(k, v) for k, v in more.items()], "doc_id long, text string")
    docs.unionByName(added, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    texts = dict(enumerate(TEXTS)) | more
    got = run(spark, path, 11)
    assert Counter(r.doc_id for r in got) == Counter([*(i for i, _ in ROWS), *more])
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r.doc_id] or ""))
        at = [(k, label) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[100].labels == "gpl,gpl-3.0" and by[100].score == 1 and by[102].labels == "cc-by,cc-by-nc-4.0" and by[105].labels == "mit" and by[105].score == 1
    assert by[104].labels == "apache" and by[0].labels == "" and by[0].score == 0
