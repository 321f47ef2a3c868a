"""Sources as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """protein_id, header, seq: one row per record of FASTA or raw files; files may hold many, or
    where single is set one only (a second one is an error).

    A record without residues is an error, as are residues before a file's first header in a
    file that has one."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    body = F.regexp_replace("value", r"\r", "")
    named = F.when(F.ltrim(body).startswith(">"), F.filter(F.split(F.concat(F.lit("\n"), F.ltrim(body)), r"\n>", -1), lambda x: F.trim(x) != "")).otherwise(F.array(F.concat(F.lit("designed\n"), body)))
    rows = files.select("file", F.posexplode(named).alias("place", "record"))
    header = F.concat(F.lit(">"), F.substring_index("record", "\n", 1))
    rest = F.substring(F.col("record"), F.length(F.substring_index("record", "\n", 1)) + 1, F.length("record"))
    seq = F.upper(F.regexp_replace(rest, r"\s+", ""))
    bad = (seq == "") | seq.contains(">") | (F.col("place") > 0 if single else F.lit(False))
    return rows.select(F.concat_ws("#", "file", "place").alias("protein_id"), header.alias("header"), F.when(bad, F.raise_error(F.concat(F.lit("no single protein in "), "file"))).otherwise(seq).alias("seq"))


def codon_table(spark: SparkSession, path: str, table_id: str = "table") -> DataFrame:
    """table_id, codon, aa, freq from lines codon,aa,freq. Blank lines, comments and lines of
    another shape are skipped; a frequency that is no finite number of zero or more, or a file
    without any row, is an error."""
    line = F.trim(F.regexp_replace("value", "^\\x{FEFF}", ""))
    cells = F.split(line, ",", -1)
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(cells.alias("c")).where(F.size("c") >= 3)
    codon = F.translate(F.upper(F.trim(F.col("c")[0])), "T", "U")
    freq = F.trim(F.col("c")[2]).try_cast("double")
    bad = freq.isNull() | F.isnan(freq) | (freq < 0) | (freq == float("inf"))
    rows = rows.select(codon.alias("codon"), F.substring(F.trim(F.col("c")[1]), 1, 1).alias("aa"), F.when(bad, F.raise_error(F.concat(F.lit("bad frequency: "), F.col("c")[2]))).otherwise(freq).alias("freq"))
    out = rows.where((F.length("codon") == 3) & (F.col("aa") != "")).select(F.lit(table_id).alias("table_id"), "codon", "aa", "freq")
    if out.isEmpty():
        raise ValueError(f"no codons in {path}")
    return out


def strict_codon_table(spark: SparkSession, path: str, code: DataFrame, table_id: str = "table") -> DataFrame:
    """codon_table of a whole code (codon, aa): each of its codons once, with its residue and a
    frequency above zero; anything else is an error."""
    rows = codon_table(spark, path, table_id)
    right = rows.join(F.broadcast(code.select("codon", "aa").withColumn("_right", F.lit(1))), ["codon", "aa"], "left")
    n, sound, kinds = right.where("freq > 0").agg(F.count("*"), F.count("_right"), F.count_distinct("codon")).first()
    if not n == sound == kinds == rows.count() == code.count():
        raise ValueError(f"no whole code in {path}: {n} codons of {code.count()}, {kinds} distinct, {sound} with their residue")
    return rows


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV (gzip by suffix) with exactly the header of schema; a value of another type, or a row
    of another width, is an error."""
    return spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True, mode="FAILFAST")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """head, member of a clustering's tab-separated rows."""
    return spark.read.schema("head string, member string").csv(path, sep="\t", mode="FAILFAST")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines with a given schema; a broken line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def key_values(x: Column) -> Column:
    """Map of the key=value tokens of a line."""
    pairs = F.filter(F.split(F.trim(x), r"\s+"), lambda t: t.contains("="))
    return F.map_from_entries(F.transform(pairs, lambda t: F.struct(F.substring_index(t, "=", 1), F.substring(t, F.instr(t, "=") + 1, F.length(t)))))


def last_match(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match of pattern, or null."""
    return F.get(F.reverse(F.regexp_extract_all(x, F.lit(pattern), F.lit(group))), F.lit(0))
