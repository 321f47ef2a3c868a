"""Dot-bracket structures: whether they are valid, and the loops they close."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import coding as C


def validity(designs: DataFrame) -> DataFrame:
    """id and five booleans of designs (id, sequence, structure): same_length, alphabet, balanced,
    canonical (every pair), hairpins (at least three unpaired inside every innermost pair; the
    last two are false without balance). Null and empty strings: a structure without pairs."""
    rows = designs.select("id", F.coalesce("sequence", F.lit("")).alias("sequence"), F.coalesce("structure", F.lit("")).alias("structure"))
    balanced = S.balanced(F.col("structure"))
    pairs = C.base_pairs(rows.select("id", "structure"), only_balanced=True).join(rows.select("id", "sequence"), "id")
    five, three = (F.substring("sequence", F.col(x) + 1, F.lit(1)) for x in "ij")
    told = pairs.groupBy("id").agg(F.min(S.pair_score(five, three).isNotNull().cast("int")).alias("_c"), F.min((F.col("j") - F.col("i") > 3).cast("int")).alias("_h"))
    alphabet = F.col("sequence").rlike("^[ACGU]*$") & F.col("structure").rlike("^[.()]*$")
    out = rows.join(told, "id", "left")
    return out.select(
        "id",
        (F.length("sequence") == F.length("structure")).alias("same_length"),
        alphabet.alias("alphabet"),
        balanced.alias("balanced"),
        (balanced & (F.coalesce("_c", F.lit(1)) == 1)).alias("canonical"),
        (balanced & (F.coalesce("_h", F.lit(1)) == 1)).alias("hairpins"),
    )


def _parents(i: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each opening bracket (by level, then place) which of them is the nearest around it, -1 for
    none: the last one that opened a level further out."""
    size = int(i.max(initial=0)) + 1
    key = level * size + i
    parent = np.searchsorted(key, key - size) - 1
    return np.where((parent >= 0) & (level[parent] == level - 1), parent, -1)


def _loops(i: np.ndarray, j: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    parent = _parents(i, level)
    inner = parent >= 0
    branches = np.bincount(parent[inner], minlength=len(i))
    covered = np.bincount(parent[inner], (j - i + 1)[inner], minlength=len(i)).astype(np.int64)  # whole numbers below 2**53
    return i, j, branches, j - i - 1 - covered


def _flanks(i: np.ndarray, j: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    parent = _parents(i, level)
    inner = parent >= 0
    i, j, outer, end, parent = i[inner], j[inner], i[parent[inner]], j[parent[inner]], parent[inner]
    # branches of one loop stand together, in order
    first = np.ones(len(i), bool)
    first[1:] = parent[1:] != parent[:-1]
    last = np.append(first[1:], True)[: len(i)]
    number = np.arange(len(i))
    place = number - np.maximum.accumulate(np.where(first, number, 0)) + 1
    before = i - np.where(first, outer, np.roll(j, 1)) - 1
    return outer, place, i, j, before, np.where(last, end - j - 1, -1)


def loops(structures: DataFrame) -> DataFrame:
    """id, i, j, branches, unpaired: the loop that each pair of balanced structures (id, structure)
    closes. What is inside a pair and in none of its branches is unpaired."""
    return C.by_structure(structures, {"i": "int", "j": "int", "branches": "long", "unpaired": "long"}, _loops)


def flanks(structures: DataFrame) -> DataFrame:
    """id, parent, place, i, j, before, after: the branches of each loop of balanced structures in order
    (place from 1), with the unpaired bases between a branch and what stands before it in its loop,
    and for the last branch those up to the loop's end (else null). The loop is known by its pair's
    opening bracket."""
    return C.by_structure(structures, {"parent": "int", "place": "long", "i": "int", "j": "int", "before": "int", "after": "int"}, _flanks)


def loop_metrics(structures: DataFrame) -> DataFrame:
    """For each structure with pairs: the least hairpin, the greatest two-way loop, the number of
    loops of more branches and their unpaired bases."""
    x = loops(structures)
    hairpin, two, more = F.col("branches") == 0, F.col("branches") == 1, F.col("branches") > 1
    return x.groupBy("id").agg(
        F.min(F.when(hairpin, F.col("unpaired"))).alias("least_hairpin"),
        F.max(F.when(two, F.col("unpaired"))).alias("widest_two_way"),
        F.count_if(more).alias("multiloops"),
        F.coalesce(F.sum(F.when(more, F.col("unpaired"))), F.lit(0)).cast("long").alias("multiloop_unpaired"),
    )
