"""Co-training on held-out labels, and what each view learns from the other one alone."""

import numpy as np
import pytest

from strandloom.llm import cotraining

RNG = np.random.default_rng(17)
COMMON = ["".join(RNG.choice([*"abcdefghij"], 5)) for _ in range(300)]
BAD, GOOD = [f"junk{i}" for i in range(12)], [f"fine{i}" for i in range(12)]


def text(bad, telling, n=60):
    return " ".join([*RNG.choice(COMMON, n), *RNG.choice(BAD if bad else GOOD, telling)])


@pytest.fixture(scope="module")
def table(spark):
    """Labelled rows of sources a and b, whose texts tell; rows without labels of sources c (bad) and
    d (good), whose texts tell, and of the same sources with texts that tell nothing."""
    rows, labels, truth = [], [], {}
    for i in range(2400):
        bad = i % 3 == 0
        if i < 900:
            rows.append((i, text(bad, 4), "en", RNG.choice(["a", "b"])))
            labels.append((i, int(not bad), 0) if i % 2 else (i, 1, int(bad)))
        else:
            rows.append((i, text(bad, 4 if i < 1800 else 0), "en", "c" if bad else "d"))
        truth[i] = bad
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_labels(table):
    docs, labels, truth = table
    got = {r.doc_id: r for r in cotraining.classify(docs, labels.where("doc_id % 4 != 1")).collect()}
    held = [i for i in truth if i < 900 and i % 4 == 1]
    assert np.mean([got[i].kept != truth[i] for i in held]) > 0.97
    bad, good = ([got[i].score for i in held if truth[i] == t] for t in (True, False))
    assert np.mean([b < g for b in bad for g in good]) > 0.99


def test_pseudo_labels_cross_views(table):
    """Sources c and d have no label: what the metadata view knows of them came from the text view."""
    docs, labels, truth = table
    before, after = ({r.doc_id: r for r in cotraining.classify(docs, labels, n).collect()} for n in (0, 2))
    mute = [i for i in truth if i >= 1800]
    mean = lambda got, t: np.mean([got[i].meta_score for i in mute if truth[i] == t])
    assert abs(mean(before, True) - mean(before, False)) < 0.02
    assert mean(after, False) - mean(after, True) > 0.3
    bad, good = ([after[i].score for i in mute if truth[i] == t] for t in (True, False))
    assert np.mean([b < g for b in bad for g in good]) > 0.9
    told = [i for i in truth if 900 <= i < 1800]
    assert np.mean([after[i].kept != truth[i] for i in told]) > 0.97


def test_constant_views_and_one_kind(spark):
    """Metadata that tells nothing, and labels of one kind only."""
    rows = [(i, text(i % 2, 5), None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = cotraining.classify(docs, labels).collect()
    assert np.mean([r.kept == (r.doc_id % 2 == 0) for r in got]) > 0.95
    assert {r.score for r in cotraining.classify(docs, labels.where("quality = 1")).collect()} == {0.5}
