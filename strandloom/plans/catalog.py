"""All queries of the engine by name, with SQL for those that SQL can express.

The test tables hold no proteins, codon usage or run records: proteins are derived from
document texts, the codon table is the standard genetic code with an artificial usage, and
run records are stood in for by events, orders and line items.

A protein is all letters of a whole text that name residues. lattice_nodes and lattice_edges have
millions of rows at the smallest scales and so no SQL; their sums by prefix have.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import analytics as A
from ..operators import coding as C
from ..operators import frontier as X
from ..operators import structures as T

FLAGSHIP = "max_cai_cds"
QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The standard genetic code, residues of codons in the order U, C, A, G.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = [("".join(c), CODE[i], (i * 7 % 10 + 1) / 10) for i, c in enumerate(product("UCAG", repeat=3))]
MOTIFS = ("UCUUCU", "AGCAGC", "GAATTC")

_VALUES = ", ".join(f"('{c}', '{a}', {f}::DOUBLE)" for c, a, f in CODONS)
_CTE = f"""
codon(codon, aa, freq) AS (VALUES {_VALUES}),
weight AS (SELECT codon, aa, freq, freq / max(freq) OVER (PARTITION BY aa) AS w, -ln(freq / max(freq) OVER (PARTITION BY aa)) AS neg_log_w FROM codon),
protein AS (SELECT doc_id AS protein_id, upper(regexp_replace(text, '[^A-Za-z]|[BJOUXZbjouxz]', '', 'g')) AS seq FROM documents),
residue AS (SELECT protein_id, unnest(range(0, length(seq))) AS pos, unnest(string_split(seq, '')) AS aa FROM protein WHERE length(seq) > 0),
best AS (SELECT aa, min(neg_log_w) AS cost, arg_min(codon, (neg_log_w, codon)) AS codon FROM weight GROUP BY aa)
"""


def _table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("standard", *c) for c in CODONS], "table_id string, codon string, aa string, freq double")


def _proteins(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("protein_id"), S.protein(F.col("text")).alias("seq"))


def _read(name: str):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {_CTE} {sql}" if "{raw}" not in sql else sql.replace("{raw}", "")
        return f

    return add


def protein_query(name: str, sql: str | None = None):
    """Registers f(spark, proteins) on the proteins of whole texts."""

    def add(f):
        query(name, sql)(lambda spark, d: f(spark, _proteins(spark, d)))
        return f

    return add


#: Fixed: how a text is read as RNA: each of its letters, whatever its case, as a nucleotide.
_LETTERS, _NUCLEOTIDES = "abcdefghijklmnopqrstuvwxyz", "ACGU" * 6 + "AC"


def _codons(spark: SparkSession, d: str) -> DataFrame:
    """lang and codon of every codon of the texts read as RNA, one row each."""
    rna = F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), _LETTERS, _NUCLEOTIDES)
    return _read("documents")(spark, d).select("lang", F.explode(F.regexp_extract_all(rna, F.lit(".{3}"), F.lit(0))).alias("codon"))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """table_id, codon, aa, freq: how often each codon occurs in a language's texts, 0 included."""
    counts = _codons(spark, d).groupBy(F.col("lang").alias("table_id"), "codon").agg(F.count("*").cast("double").alias("n"))
    every = counts.select("table_id").distinct().crossJoin(F.broadcast(_table(spark).select("codon", "aa")))  # 64 rows
    return every.join(counts, ["table_id", "codon"], "left").select("table_id", "codon", "aa", F.coalesce("n", F.lit(0.0)).alias("freq"))


_USAGE = f"""used AS (SELECT lang AS table_id, unnest(regexp_extract_all(translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{_NUCLEOTIDES}'), '.{{{{3}}}}')) AS codon FROM documents),
usage AS (SELECT table_id, codon.codon, aa, (SELECT count(*) FROM used u WHERE u.table_id = t.table_id AND u.codon = codon.codon)::DOUBLE AS freq FROM (SELECT DISTINCT table_id FROM used) t, codon),
relative AS (SELECT *, CASE WHEN freq > 0 THEN freq / max(freq) OVER (PARTITION BY table_id, aa) ELSE 1e-9 END AS w FROM usage)""".replace("{{", "{").replace("}}", "}")


@query("codon_weights", f", {_USAGE} SELECT table_id, codon, aa, freq, round(w, 9) AS w, round(-ln(w), 9) AS neg_log_w FROM relative")
def codon_weights(spark, d):
    """Relative adaptiveness of codons by the usage of each language's texts, read as RNA."""
    return C.weights(_usage(spark, d)).withColumns({c: F.round(c, 9) for c in ("w", "neg_log_w")})


@query("codon_best_per_aa", f", {_USAGE} SELECT table_id, aa, arg_min(codon, (-ln(w), codon)) AS codon, round(min(-ln(w)), 9) AS cost FROM relative GROUP BY table_id, aa")
def codon_best_per_aa(spark, d):
    """The codon of least cost for each residue by each language's usage; the first where several are."""
    return C.best_codons(C.weights(_usage(spark, d))).withColumn("cost", F.round("cost", 9))


@protein_query("protein_source", "SELECT protein_id, seq FROM protein")
def protein_source(spark, proteins):
    return proteins


@protein_query("max_cai_cds", """SELECT protein_id, string_agg(codon, '' ORDER BY pos) AS cds, round(sum(cost), 6) AS penalty FROM residue JOIN best USING (aa) GROUP BY protein_id""")
def max_cai_cds(spark, proteins):
    return C.best_cds(proteins, C.weights(_table(spark))).select("protein_id", "cds", F.round("penalty", 6).alias("penalty"))


_FIRST = "firsts AS (SELECT aa, min(codon) AS codon FROM codon GROUP BY aa)"


@protein_query("cai_score", f""", {_FIRST} SELECT protein_id, round(exp(avg(ln(w))), 9) AS cai, round(sum(neg_log_w), 6) AS penalty, string_agg(aa, '' ORDER BY pos) AS protein
FROM residue JOIN firsts USING (aa) JOIN weight USING (codon, aa) GROUP BY protein_id""")
def cai_score(spark, proteins):
    """CAI, penalty and translation of each protein's lexicographically first coding sequence."""
    cds = C.first_cds(proteins, _table(spark))
    return C.cai(cds, C.weights(_table(spark))).select("protein_id", F.round("cai", 9).alias("cai"), F.round("penalty", 6).alias("penalty"), "protein")


@protein_query("min_codon_cost", "SELECT protein_id, round(sum(cost), 6) AS cost, round(least(1e-4, 0.004 / (count(*) * (SELECT max(neg_log_w) FROM weight))), 12) AS tie_break FROM residue JOIN best USING (aa) GROUP BY protein_id")
def min_codon_cost(spark, proteins):
    """The least codon cost, and the trade-off small enough to break ties alone."""
    w = C.weights(_table(spark))
    most = w.agg(F.max("neg_log_w").alias("most"))
    rows = C.least_cost(proteins, w)
    return rows.crossJoin(F.broadcast(most)).select("protein_id", F.round("cost", 6).alias("cost"), F.round(F.least(F.lit(1e-4), 0.004 / (F.col("n") * F.col("most"))), 12).alias("tie_break"))


_NODES = """, cut AS (SELECT DISTINCT aa, k, substr(codon, 1, k::INT) AS prefix FROM codon, unnest([0, 1, 2]) AS t(k)),
nodes AS (SELECT protein_id, pos * 3 + k AS pos, prefix FROM residue JOIN cut USING (aa) UNION ALL SELECT protein_id, length(seq) * 3, '' FROM protein WHERE length(seq) > 0)"""


@protein_query("lattice_nodes")
def lattice_nodes(spark, proteins):
    return C.lattice_nodes(proteins, _table(spark))


@protein_query("lattice_node_sums", f"""{_NODES}, numbered AS (SELECT protein_id, pos, prefix, row_number() OVER (PARTITION BY protein_id ORDER BY pos, prefix) - 1 AS node FROM nodes)
SELECT protein_id, prefix, count(*) AS n, sum(pos)::BIGINT AS places, sum(node)::BIGINT AS numbers FROM numbered GROUP BY protein_id, prefix""")
def lattice_node_sums(spark, proteins):
    """Sums of the nodes' places and numbers for each protein and prefix."""
    return C.lattice_nodes(proteins, _table(spark)).groupBy("protein_id", "prefix").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.sum("node").alias("numbers"))


@protein_query("lattice_shape", f"{_NODES} SELECT protein_id, sum(width)::BIGINT AS nodes, max(width)::BIGINT AS widest FROM (SELECT protein_id, pos, count(*) AS width FROM nodes GROUP BY ALL) GROUP BY protein_id")
def lattice_shape(spark, proteins):
    return C.lattice_shape(proteins, _table(spark))


@protein_query("lattice_edges")
def lattice_edges(spark, proteins):
    # 64 weights are rounded, not every edge's
    e = C.lattice_edges(proteins, C.weights(_table(spark)).withColumn("neg_log_w", F.round("neg_log_w", 9)))
    return e.select("protein_id", F.col("src_pos").cast("long"), "src", "dst", "nuc", "weight")


@protein_query("lattice_edge_sums", """, step AS (SELECT DISTINCT aa, k, substr(codon, 1, k::INT) AS src, CASE WHEN k < 2 THEN substr(codon, 1, k::INT + 1) ELSE '' END AS dst, substr(codon, k::INT + 1, 1) AS nuc, CASE WHEN k = 2 THEN neg_log_w ELSE 0.0 END AS weight FROM weight, unnest([0, 1, 2]) AS t(k))
SELECT protein_id, src, nuc, count(*) AS n, sum(pos * 3 + k)::BIGINT AS places, round(sum(weight), 6) AS weight FROM residue JOIN step USING (aa) GROUP BY protein_id, src, nuc""")
def lattice_edge_sums(spark, proteins):
    """Sums of the edges' places and weights for each protein, prefix and nucleotide."""
    return C.lattice_edge_sums(proteins, C.weights(_table(spark))).withColumn("weight", F.round("weight", 6))


_MOTIFS = ", ".join(f"('{m.replace('T', 'U')}')" for m in MOTIFS)


@query("motif_transitions", f""", motif AS (SELECT DISTINCT p_type AS motifset_id, translate(lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{_NUCLEOTIDES}') AS motif FROM part),
state AS (SELECT DISTINCT motifset_id, substr(motif, 1, n::INT) AS state FROM motif, unnest(range(0, length(motif))) AS t(n)),
reads AS (SELECT motifset_id, state, nuc, state || nuc AS r FROM state, (VALUES ('A'), ('C'), ('G'), ('U')) AS n(nuc)),
ok AS (SELECT * FROM reads WHERE NOT EXISTS (SELECT 1 FROM motif WHERE motif.motifset_id = reads.motifset_id AND ends_with(reads.r, motif)))
SELECT ok.motifset_id, ok.state AS state, nuc, arg_max(s.state, length(s.state)) AS next_state FROM ok JOIN state s ON s.motifset_id = ok.motifset_id AND ends_with(ok.r, s.state) GROUP BY ok.motifset_id, ok.state, nuc""")
def motif_transitions(spark, d):
    """For each type of part the automaton that avoids its parts' names, read as RNA."""
    motif = F.translate(F.lower(F.regexp_replace("p_name", "[^A-Za-z]", "")), _LETTERS, _NUCLEOTIDES)
    return C.motif_transitions(_read("part")(spark, d).select(F.col("p_type").alias("motifset_id"), motif.alias("motif")))


@protein_query("motif_scan", "SELECT protein_id, string_agg(codon, '' ORDER BY pos) AS cds FROM residue JOIN best USING (aa) GROUP BY protein_id HAVING " + " AND ".join(f"NOT contains(string_agg(codon, '' ORDER BY pos), '{m.replace('T', 'U')}')" for m in MOTIFS))
def motif_scan(spark, proteins):
    """Best coding sequences that hold none of the motifs."""
    cds = C.best_cds(proteins, C.weights(_table(spark)))
    for m in MOTIFS:
        cds = cds.where(~F.col("cds").contains(m.replace("T", "U")))
    return cds.select("protein_id", "cds")


@protein_query("cds_enumeration", """, choice AS (SELECT aa, ln(count(*)) / ln(10) AS n, min(codon) AS codon, min(neg_log_w) AS least, max(neg_log_w) AS most FROM weight GROUP BY aa)
SELECT protein_id, round(sum(n), 6) AS log10_n, string_agg(codon, '' ORDER BY pos) AS first_cds, round(sum(least), 6) AS least, round(sum(most), 6) AS most FROM residue JOIN choice USING (aa) GROUP BY protein_id""")
def cds_enumeration(spark, proteins):
    """Figures of all coding sequences of each protein; their number as log10_n."""
    out = C.spellings(proteins, C.weights(_table(spark)))
    return out.select("protein_id", F.round("log10_n", 6).alias("log10_n"), "first_cds", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query("cds_language", """, name AS (SELECT r_regionkey AS protein_id, upper(regexp_replace(r_name, '[^A-Za-z]|[BJOUXZbjouxz]', '', 'g')) AS seq FROM region),
RECURSIVE_PART SELECT protein_id, cds, round(penalty, 6) AS penalty FROM spelled WHERE i = length(seq)""")
def cds_language(spark, d):
    """Every coding sequence of the regions' names, one row each."""
    names = _read("region")(spark, d).select(F.col("r_regionkey").alias("protein_id"), S.protein(F.col("r_name")).alias("seq"))
    return C.enumerated(names, C.weights(_table(spark)), 12).select("protein_id", "cds", F.round("penalty", 6).alias("penalty"))


SQL["cds_language"] = "WITH RECURSIVE " + SQL["cds_language"].removeprefix("WITH ").replace("RECURSIVE_PART", "spelled(protein_id, seq, i, cds, penalty) AS (SELECT protein_id, seq, 0, ''::VARCHAR, 0.0::DOUBLE FROM name UNION ALL SELECT protein_id, seq, i + 1, cds || codon, penalty + neg_log_w FROM spelled JOIN weight ON aa = substr(seq, i + 1, 1) WHERE i < length(seq))")


def _structures(spark: SparkSession, d: str) -> DataFrame:
    return _read("documents")(spark, d).where("text is not null").select(F.col("doc_id").alias("id"), S.brackets(F.col("text")).alias("structure"))


#: Structures of texts, their pairs with levels, and the branches of each pair's loop.
_LOOP_SQL = r"""s1 AS (SELECT doc_id AS id, regexp_replace(regexp_replace(text, '[^A-Za-z\n]', '.', 'g'), '([A-Z][A-Za-z]*)', '[.\1]', 'g') AS x FROM documents WHERE text IS NOT NULL),
s2 AS (SELECT id, translate(regexp_replace(regexp_replace(x, '([A-Za-z]+)', '(\1)', 'g'), '[A-Za-z]', '.', 'g'), '[]', '()') AS x FROM s1),
s AS (SELECT id, '(' || regexp_replace(x, '\n+', ')(', 'g') || ')' AS structure FROM s2),
chars AS (SELECT id, unnest(range(0, length(structure))) AS i, unnest(string_split(structure, '')) AS c FROM s),
level AS (SELECT id, i, c, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) + CASE WHEN c = ')' THEN 1 ELSE 0 END AS level FROM chars WHERE c <> '.'),
ends AS (SELECT id, i, c, level, lead(i) OVER (PARTITION BY id, level ORDER BY i) AS j FROM level),
pairs AS (SELECT id, i, j, level FROM ends WHERE c = '('),
met AS (SELECT id, level AS up, i, j, i AS own, j AS own_end FROM pairs UNION ALL SELECT id, level - 1, i, j, NULL, NULL FROM pairs),
branch AS (SELECT * FROM (SELECT id, i, j, own, max(own) OVER w AS parent, max(own_end) OVER w AS parent_end FROM met WHERE up > 0 WINDOW w AS (PARTITION BY id, up ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE own IS NULL),
flank AS (SELECT id, parent, row_number() OVER w AS place, i, j, i - coalesce(lag(j) OVER w, parent) - 1 AS before, CASE WHEN lead(i) OVER w IS NULL THEN parent_end - j - 1 END AS after FROM branch WINDOW w AS (PARTITION BY id, parent ORDER BY i))""".replace("\\\\", "\\")


@query("structure_pairs", f", {_LOOP_SQL} SELECT id, i::BIGINT AS i, j::BIGINT AS j FROM pairs")
def structure_pairs(spark, d):
    """Base pairs of the structures of whole texts."""
    return C.base_pairs(_structures(spark, d), only_balanced=True).select("id", F.col("i").cast("long"), F.col("j").cast("long"))


@query("loop_flanks", f", {_LOOP_SQL} SELECT id, parent::BIGINT AS parent, place::BIGINT AS place, i::BIGINT AS i, j::BIGINT AS j, before::BIGINT AS before, after::BIGINT AS after FROM flank")
def loop_flanks(spark, d):
    """The branches of every loop of the structures of whole texts, with the gaps around them."""
    out = T.flanks(_structures(spark, d))
    return out.select("id", *(F.col(c).cast("long").alias(c) for c in ("parent", "place", "i", "j", "before", "after")))


@query("quantile_describe", "{raw}SELECT event_type, count(value) AS n, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS greatest FROM events GROUP BY event_type")
def quantile_describe(spark, d):
    out = A.describe(_read("events")(spark, d), ["event_type"], "value")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("least", "q25", "median", "q75", "greatest")))


@query("status_completion", "{raw}SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders GROUP BY o_orderpriority")
def status_completion(spark, d):
    s = F.col("o_orderstatus")
    return _read("orders")(spark, d).groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("done"), F.count_if(s == "O").alias("open"), F.count_if(~s.isin("F", "O")).alias("other"))


@query("planned_vs_recorded", "{raw}SELECT o_orderkey, count(l_orderkey) AS recorded FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def planned_vs_recorded(spark, d):
    seen = _read("lineitem")(spark, d).where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return _read("orders")(spark, d).select("o_orderkey").join(seen, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("recorded"))


_ARMS = "SELECT l_suppkey, median(l_extendedprice) FILTER (l_returnflag = 'A') AS a, median(l_extendedprice) FILTER (l_returnflag = 'N') AS n, median(l_extendedprice) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey"


@query("paired_ratio_medians", f"{{raw}}SELECT l_suppkey, round(a / n, 9) AS a_over_n, round(r / n, 9) AS r_over_n FROM ({_ARMS}) WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL")
def paired_ratio_medians(spark, d):
    m = A.arm_medians(_read("lineitem")(spark, d), ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "l_extendedprice")
    return m.select("l_suppkey", F.round(F.col("A") / F.col("N"), 9).alias("a_over_n"), F.round(F.col("R") / F.col("N"), 9).alias("r_over_n"))


@query("geomean_of_medians", f"{{raw}}SELECT round(exp(avg(ln(a / n))), 9) AS ratio, count(*) AS blocks FROM ({_ARMS}) WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL")
def geomean_of_medians(spark, d):
    m = A.arm_medians(_read("lineitem")(spark, d), ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "l_extendedprice")
    return m.agg(F.round(A.geometric_mean(F.col("A") / F.col("N")), 9).alias("ratio"), F.count("*").alias("blocks"))


@query("ols_loglog", "{raw}SELECT l_returnflag, count(*) AS n, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def ols_loglog(spark, d):
    out = A.ols(_read("lineitem")(spark, d), ["l_returnflag"], F.log("l_quantity"), F.log("l_extendedprice"))
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")))


@query("stratum_calibrated_weights", "{raw}, w AS (SELECT c_custkey, c_mktsegment, 1.0::DOUBLE / count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS raw FROM customer) SELECT c_custkey, round(raw * count(*) OVER (PARTITION BY c_mktsegment) / sum(raw) OVER (PARTITION BY c_mktsegment), 6) AS weight FROM w".replace("{raw}, w", "{raw}WITH w"))
def stratum_calibrated_weights(spark, d):
    return A.calibrated_weights(_read("customer")(spark, d), "c_mktsegment", "c_nationkey").select("c_custkey", F.round("weight", 6).alias("weight"))


@query("pareto_frontier", "{raw}SELECT DISTINCT l_suppkey, l_quantity, l_extendedprice FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_suppkey = x.l_suppkey AND y.l_quantity <= x.l_quantity AND y.l_extendedprice <= x.l_extendedprice AND (y.l_quantity < x.l_quantity OR y.l_extendedprice < x.l_extendedprice))")
def pareto_frontier(spark, d):
    return X.pareto(_read("lineitem")(spark, d), ["l_suppkey"], "l_quantity", "l_extendedprice")


@query("overlap_check", "{raw}SELECT * FROM (SELECT user_id, event_id, ts, max(ts + INTERVAL 1 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM events) WHERE ts < busy_until".replace("SELECT *", "SELECT user_id, event_id"))
def overlap_check(spark, d):
    """Events that begin within an hour of an earlier one of the user."""
    rows = _read("events")(spark, d).select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("stop"))
    return A.overlaps(rows, ["user_id"], "ts", "stop").select("user_id", "event_id")


@query("inversion_count", "{raw}SELECT a.l_orderkey, count(*) FILTER (a.l_extendedprice > b.l_extendedprice) AS inverted, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity < b.l_quantity GROUP BY a.l_orderkey")
def inversion_count(spark, d):
    return A.inversions(_read("lineitem")(spark, d), ["l_orderkey"], "l_quantity", "l_extendedprice")


_POISSON = " + ".join(f"(u > {c})::INT" for c in A.POISSON)


@query("bootstrap_ci", f"{{raw}}WITH d AS (SELECT c_mktsegment, c_acctbal, draw, ('0x' || substr(md5('7:' || draw || ':' || c_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM customer, unnest(range(1, 101)) AS t(draw)), m AS (SELECT c_mktsegment, draw, sum(({_POISSON}) * c_acctbal) / sum({_POISSON}) AS m FROM d GROUP BY ALL) SELECT c_mktsegment, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY c_mktsegment")
def bootstrap_ci(spark, d):
    out = A.bootstrap(_read("customer")(spark, d), ["c_mktsegment"], "c_custkey", "c_acctbal", 100)
    return out.select("c_mktsegment", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
