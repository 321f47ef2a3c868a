"""Scalar expressions over RNA, codons and dot-bracket strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the lowest relative adaptiveness that is taken as meant.
FLOOR = 1e-9
#: Fixed: canonical pairs (5' then 3' nucleotide), and the simple model's score of each.
PAIRS = (("C", "G", 1, -3), ("G", "C", 2, -3), ("G", "U", 3, -1), ("U", "G", 4, -1), ("A", "U", 5, -2), ("U", "A", 6, -2))


def rna(x: Column) -> Column:
    """Upper case, without white space, T as U; null where another letter is left or nothing."""
    y = F.translate(F.upper(F.regexp_replace(x, r"\s+", "")), "T", "U")
    return F.when(y.rlike("^[ACGU]+$"), y)


def codons(x: Column) -> Column:
    """The codons of x as an array; empty where the length is no multiple of three. One pass: a
    substring for each codon would read a long x from its start each time."""
    return F.when((F.length(x) > 0) & (F.length(x) % 3 == 0), F.regexp_extract_all(x, F.lit("(?s).{3}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def brackets(text: Column) -> Column:
    """The test tables' stand-in for a structure: each line of a text is a pair around its words, each
    run of letters a pair around as many unpaired bases (with a capital, one pair and base more),
    any other character an unpaired base. Balanced for every text."""
    x = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z\n]", "."), "([A-Z][A-Za-z]*)", "[.$1]")
    x = F.translate(F.regexp_replace(F.regexp_replace(x, "([A-Za-z]+)", "($1)"), "[A-Za-z]", "."), "[]", "()")
    return F.concat(F.lit("("), F.regexp_replace(x, "\n+", ")("), F.lit(")"))


def protein(text: Column) -> Column:
    """The test tables' stand-in for a protein: all letters of the whole text that name residues."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]|[BJOUXZbjouxz]", ""))


def once(value: Column, use) -> Column:
    """use(value) with value worked out a single time, however often use reads it: no step of the
    optimiser copies an expression into a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(x: Column, letters, use) -> Column:
    """use(x, counts) with x and the count of each of some letters in it worked out once a row."""
    letters = list(letters)
    counts = lambda s: F.struct(*(times(s, a).alias(f"n{i}") for i, a in enumerate(letters)))
    return once(x, lambda s: once(counts(s), lambda c: use(s, {a: c[f"n{i}"] for i, a in enumerate(letters)})))


def times(x: Column, letter: str) -> Column:
    """How often a letter occurs in x."""
    return F.length(x) - F.length(F.replace(x, F.lit(letter), F.lit("")))


def spelled(seq: Column, codon_of: dict[str, str]) -> Column:
    """The codons of the residues of seq, joined; residues that have none are left out."""
    out = F.lower(F.regexp_replace(seq, "[^" + "".join(f"\\{a}" if a == "*" else a for a in codon_of) + "]", ""))
    for aa, codon in codon_of.items():  # lower case is still to be read, upper case is written
        out = F.replace(out, F.lit(aa.lower()), F.lit(codon))
    return out


def pair_score(five: Column, three: Column) -> Column:
    """Score of a pair in the simple model; null where the two do not pair."""
    out = F.lit(None).cast("int")
    for a, b, _, score in PAIRS:
        out = F.when((five == a) & (three == b), score).otherwise(out)
    return out


def balanced(structure: Column) -> Column:
    """Whether only . ( ) occur and parentheses match."""
    step = lambda d, c: F.when(d < 0, d).when(c == "(", d + 1).when(c == ")", d - 1).otherwise(d)
    return structure.rlike("^[.()]*$") & (F.aggregate(F.split(structure, ""), F.lit(0), step) == 0)


def pair_type(five: Column, three: Column) -> Column:
    """1 to 6 of a canonical pair, 0 of another."""
    out = F.lit(0)
    for a, b, kind, _ in PAIRS:
        out = F.when((five == a) & (three == b), kind).otherwise(out)
    return out


def nucleotide_code(letter: Column) -> Column:
    """A, C, G, U: 1 to 4; 0 for any other letter."""
    return F.when(F.length(letter) == 1, F.instr(F.lit("ACGU"), letter)).otherwise(0)


def nucleotide(code: Column) -> Column:
    """The letter of a code; N for another."""
    return F.when(code.between(1, 4), F.substring(F.lit("ACGU"), code, F.lit(1))).otherwise("N")


def elapsed_seconds(x: Column) -> Column:
    """Seconds of m:ss.s or h:mm:ss.s; null where it is neither, or where seconds, or minutes after
    hours, are 60 or more."""
    part = lambda i: F.regexp_extract(x, r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$", i)
    hours, minutes, seconds = (part(i).try_cast("double") for i in (1, 2, 3))
    fits = (seconds < 60) & (hours.isNull() | (minutes < 60))
    return F.when(fits, F.coalesce(hours, F.lit(0.0)) * 3600 + minutes * 60 + seconds)
