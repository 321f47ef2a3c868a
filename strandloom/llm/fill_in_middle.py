"""Fill-in-middle transformation in Spark SQL functions alone.

A text is cut into units (a run of letters A-Z, a-z, or one other character). Two hash groups of
the document's id give two cuts between units; a third says whether the text is rearranged at
all, a fourth in which order:
    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle
A text that is empty or holds a sentinel stays plain, so reading back is exact: no sentinel's
end is its beginning, so where a sentinel is written no other can begin earlier across its border.

Every row is worked on by itself: no shuffle, no Python. The units of a text are one array in one
row, so the longest text bounds memory.

Defined cases: null text is empty and so plain; a null doc_id hashes as the empty id; repeated
rows and ids give a row each; an empty table gives an empty result; other columns stay as they
are where their names are not those that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed: sentinels, the units of a text, what the hashed string begins with, shares in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = "[A-Za-z]+|[^A-Za-z]"
SEED, REARRANGED, SPM = "1:", 90, 20


def hashes(key: Column, seed: str = SEED) -> Column:
    """Array of four unsigned integers: the first groups of eight hex digits of the key's sha256."""
    hexed = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*(F.lit(1 + 8 * i) for i in range(4))), lambda at: F.conv(F.substring(hexed, at, F.lit(8)), 16, 10).cast("long"))


def arrange(docs: DataFrame, seed: str = SEED, rearranged: int = REARRANGED, spm: int = SPM) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain) and output."""
    text = F.coalesce(F.col("text"), F.lit(""))
    body = F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)).alias("units"), hashes(F.col("doc_id"), seed).alias("h"))
    # bound once in a lambda, so that no later step of the optimiser works it out again
    both = docs.select(F.struct(*docs.columns).alias("row"), _once(body, lambda b: _arranged(b, rearranged, spm)).alias("made"))
    return both.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED), *(F.col("made")[c].alias(c) for c in ADDED))


ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _arranged(b: Column, rearranged: int, spm: int) -> Column:
    n = F.size(b["units"]).cast("long")
    plain = (n == 0) | b["text"].contains(PREFIX) | b["text"].contains(SUFFIX) | b["text"].contains(MIDDLE) | (b["h"][2] % 100 >= rearranged)
    form = F.when(plain, F.lit("plain")).when(b["h"][3] % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    first, second = F.least(b["h"][0] % (n + 1), b["h"][1] % (n + 1)).cast("int"), F.greatest(b["h"][0] % (n + 1), b["h"][1] % (n + 1)).cast("int")
    part = lambda at, size: F.array_join(F.slice(b["units"], at, size), "")
    parts = F.when(form != "plain", F.struct(part(F.lit(1), first).alias("p"), part(first + 1, second - first).alias("m"), part(second + 1, n.cast("int") - second).alias("s")))

    def made(x: Column) -> Column:
        psm, spm_ = ([F.lit(PREFIX), x["p"], F.lit(SUFFIX), x["s"], F.lit(MIDDLE), x["m"]], [F.lit(SUFFIX), x["s"], F.lit(PREFIX), x["p"], F.lit(MIDDLE), x["m"]])
        out = F.when(form == "plain", b["text"]).when(form == "spm", F.concat(*spm_)).otherwise(F.concat(*psm))
        return F.struct(n.alias("n"), form.alias("form"), F.length(x["p"]).cast("long").alias("prefix_chars"), F.length(x["m"]).cast("long").alias("middle_chars"), out.alias("output"))

    return _once(parts, made)


def restored(form: Column, output: Column) -> Column:
    """The text, from form and output alone: what stands between the first of each sentinel."""
    first, second = (F.when(form == "spm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((SUFFIX, PREFIX), (PREFIX, SUFFIX)))

    def joined(o: Column) -> Column:
        two, last = F.instr(o, second), F.instr(o, F.lit(MIDDLE))
        one = F.substring(o, F.length(first) + 1, two - F.length(first) - 1)
        other = F.substring(o, two + F.length(second), last - two - F.length(second))
        middle = F.substring(o, last + len(MIDDLE), F.length(o))
        return F.when(form == "spm", F.concat(other, middle, one)).otherwise(F.concat(one, middle, other))

    return F.when(form == "plain", output).otherwise(_once(output, joined))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arrange(common.documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x, regexp_extract_all(coalesce(text, ''), '{UNITS}') AS units FROM documents),
cut AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || substr(x, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= {REARRANGED} THEN 'plain'
              WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
