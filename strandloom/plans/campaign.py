"""Queries over run records, parsers and checks; test tables stand in for records.

Inputs of parsers are texts put together from keys, so that DuckDB can tell what they hold.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import analytics as A
from ..operators import coding as C
from ..operators import frontier as X
from ..operators import motif_free as M
from ..operators import ordered as O
from ..operators import records as R
from ..operators import structures as T
from ..sources import readers
from .catalog import _LOOP_SQL, _USAGE, MOTIFS, SQL, _codons, _proteins, _read, _structures, _table, query

_nth = lambda key, *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _list(*values: str | None) -> str:
    """A DuckDB list of strings; escapes stand for their characters."""
    return "[" + ", ".join("NULL" if v is None else "E'" + v.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t") + "'" for v in values) + "]"


@query("nucleotide_codes", "{raw}SELECT doc_id, instr('ACGU', c)::INT AS code, CASE WHEN instr('ACGU', c) > 0 THEN c ELSE 'N' END AS letter, count(*) AS n FROM (SELECT doc_id, unnest(string_split(translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'acguTt', 'ACGUUU'), '')) AS c FROM documents WHERE regexp_matches(text, '[A-Za-z]')) GROUP BY ALL")
def nucleotide_codes(spark, d):
    """How often each code occurs among the letters of each text, read as RNA."""
    letters = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), "acguTt", "ACGUUU")
    one = _read("documents")(spark, d).select("doc_id", F.explode(F.filter(F.split(letters, ""), lambda c: c != "")).alias("c"))
    coded = one.select("doc_id", S.nucleotide_code(F.col("c")).cast("int").alias("code")).groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    return coded.select("doc_id", "code", S.nucleotide(F.col("code")).alias("letter"), "n")


_RAW = (" acgu\tT g", "ACGX", "", "gattaca", None, "   ")


@query("rna_normal_form", f"{{raw}}WITH r AS (SELECT o_orderkey, {_list(*_RAW)}[o_orderkey % 6 + 1] AS raw FROM orders), s AS (SELECT o_orderkey, translate(upper(regexp_replace(raw, '\\s+', '', 'g')), 'T', 'U') AS rna FROM r) SELECT o_orderkey, CASE WHEN regexp_full_match(rna, '[ACGU]+') THEN rna END AS rna FROM s")
def rna_normal_form(spark, d):
    return _read("orders")(spark, d).select("o_orderkey", S.rna(_nth("o_orderkey", *_RAW)).alias("rna"))


@query("pair_scores", f""", {_USAGE}, p(five, three, kind, score) AS (VALUES ('C', 'G', 1, -3), ('G', 'C', 2, -3), ('G', 'U', 3, -1), ('U', 'G', 4, -1), ('A', 'U', 5, -2), ('U', 'A', 6, -2)),
n AS (SELECT table_id AS lang, substr(codon, 1, 1) AS five, substr(codon, 3, 1) AS three, count(*) AS n FROM used GROUP BY ALL)
SELECT lang, n.five, n.three, coalesce(kind, 0) AS kind, score::DOUBLE AS score, n FROM n LEFT JOIN p USING (five, three)""")
def pair_scores(spark, d):
    """Kind and score of the pair of each codon's first and last nucleotide, and how often it occurs."""
    five, three = F.substring("codon", 1, 1), F.substring("codon", 3, 1)
    n = _codons(spark, d).groupBy("lang", five.alias("five"), three.alias("three")).agg(F.count("*").alias("n"))
    return n.select("lang", "five", "three", S.pair_type(F.col("five"), F.col("three")).alias("kind"), S.pair_score(F.col("five"), F.col("three")).cast("double").alias("score"), "n")


@query("elapsed_parse", "{raw}SELECT event_id, CASE event_id % 4 WHEN 0 THEN 7200.0 + event_id % 60 + 0.5 WHEN 1 THEN 180.0 + event_id % 60 + 0.25 END AS seconds FROM events")
def elapsed_parse(spark, d):
    """Durations as h:mm:ss.s, as m:ss.s, with minutes out of range, and as no duration."""
    s = F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    text = F.element_at(F.array(F.concat(F.lit("2:00:"), s, F.lit(".5")), F.concat(F.lit("3:"), s, F.lit(".25")), F.concat(F.lit("1:60:"), s), F.concat(s, F.lit(" s"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _read("events")(spark, d).select("event_id", S.elapsed_seconds(text).alias("seconds"))


@query("kv_parse", "{raw}SELECT l_orderkey, l_linenumber, l_orderkey * 3 AS count, l_linenumber + 0.5 AS rate, l_returnflag AS flag, l_orderkey % 7 <> 0 AND l_orderkey % 5 <> 0 AS strict FROM lineitem")
def kv_parse(spark, d):
    """Typed key=value tokens; strict where no token is stray and no key comes twice."""
    line = F.concat(F.lit("count="), (F.col("l_orderkey") * 3).cast("string"), F.lit(" rate="), F.col("l_linenumber").cast("string"), F.lit(".5e0  flag="), F.col("l_returnflag"), F.when(F.col("l_orderkey") % 7 == 0, " stray").otherwise(""), F.when(F.col("l_orderkey") % 5 == 0, " count=1").otherwise(""))
    rows = _read("lineitem")(spark, d).select("l_orderkey", "l_linenumber", line.alias("line"))
    found = lambda k: F.regexp_extract("line", rf"(?:^|\s){k}=(\S*)", 1)
    return rows.select("l_orderkey", "l_linenumber", R.number(found("count"))[0].alias("count"), R.number(found("rate"))[1].alias("rate"), found("flag").alias("flag"), R.strict_tokens(F.col("line")).alias("strict"))


@query("key_values", "{raw}SELECT o_orderkey, ['mode', 'threads', 'x'] AS keys, o_orderkey % 16 AS threads FROM orders".replace("['mode', 'threads', 'x'] AS keys", "'mode,threads,x' AS keys"))
def key_values(spark, d):
    line = F.concat(F.lit("mode=sparse threads="), (F.col("o_orderkey") % 16).cast("string"), F.lit(" x=a=b"))
    m = readers.key_values(line)
    return _read("orders")(spark, d).select("o_orderkey", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), m["threads"].cast("long").alias("threads"))


@query("time_records", "{raw}SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_id * 1024.0::DOUBLE END AS kib, CASE WHEN event_id % 11 > 0 THEN round(event_id / 1024.0, 9) END AS gib, CASE WHEN event_id % 11 > 0 THEN (event_id % 3)::DOUBLE END AS exit_status FROM events")
def time_records(spark, d):
    """Records of `label: value` lines; null where a label comes twice."""
    lines = [F.lit("Command being timed: x --a"), F.concat(F.lit("\tMaximum resident set size (kbytes): "), (F.col("event_id") * 1024).cast("string")), F.concat(F.lit("\tExit status: "), (F.col("event_id") % 3).cast("string")), F.when(F.col("event_id") % 11 == 0, F.lit("\tExit status: 0"))]
    m = R.labelled(F.concat_ws("\n", *lines))
    kib = m["Maximum resident set size (kbytes)"].cast("double")
    return _read("events")(spark, d).select("event_id", kib.alias("kib"), F.round(kib / (1 << 20), 9).alias("gib"), m["Exit status"].cast("double").alias("exit_status"))


@query("design_records", "{raw}SELECT o_orderkey, repeat('ACGU', 1 + (o_orderkey % 3)::INT) AS sequence, CASE WHEN o_orderkey % 6 > 0 THEN repeat('....', 1 + (o_orderkey % 3)::INT) END AS structure, round(-(o_orderkey % 1000) / 100.0, 2) AS mfe, round((o_orderkey % 1000) / 1000.0, 3) AS cai FROM orders")
def design_records(spark, d):
    """Designs written as text and read back; a field that comes twice is null."""
    k = F.col("o_orderkey")
    n = (1 + k % 3).cast("int")
    text = R.design_text(F.lit(">designed"), F.repeat(F.lit("ACGU"), n), F.repeat(F.lit("...."), n), -(k % 1000) / 100.0, (k % 1000) / 1000.0)
    rows = _read("orders")(spark, d).select("o_orderkey", F.concat_ws("\n", text, F.when(k % 6 == 0, F.lit("(...)"))).alias("text"))
    return rows.select("o_orderkey", *R.design(F.col("text")))


@query("tool_energies", "{raw}SELECT l_orderkey, l_linenumber, ['alpha', 'beta', 'gamma'][l_orderkey % 3 + 1] AS tool, CASE WHEN l_linenumber <> 5 THEN round(-l_linenumber - 0.25, 2) END AS energy FROM lineitem")
def tool_energies(spark, d):
    """Energies by each tool's own line; the last match counts."""
    tool, v = _nth("l_orderkey", "alpha", "beta", "gamma"), F.concat(F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".25"))
    lines = F.concat(F.lit("energy: -99.0\nmfe = -98.0 score(-97.5)\nenergy: "), v, F.lit("\nmfe = "), v, F.lit("\nscore("), v, F.lit(")"))
    text = F.when(F.col("l_linenumber") == 5, F.lit("failed")).otherwise(lines)
    return _read("lineitem")(spark, d).select("l_orderkey", "l_linenumber", tool.alias("tool"), R.tool_energy(tool, text).alias("energy"))


@query("unknown_residues", "{raw}WITH p AS (SELECT doc_id AS protein_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents WHERE text IS NOT NULL) SELECT protein_id, length(regexp_replace(seq, '[^BJOUXZ]', '', 'g')) AS unknown, nullif(regexp_extract(seq, '[BJOUXZ]'), '') AS first_unknown FROM p")
def unknown_residues(spark, d):
    """Residues without codons among all letters of each text."""
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return C.unknown_residues(_read("documents")(spark, d).select(F.col("doc_id").alias("protein_id"), seq.alias("seq")), _table(spark))


_CDS = ("AUGGCCUUU", "AUGNNN", "AUGG", "UGGUGGUGA", "")


@query("codon_penalty", f""", c AS (SELECT o_orderkey AS protein_id, {_list(*_CDS)}[o_orderkey % 5 + 1] AS cds FROM orders), w AS (SELECT list(struct_pack(codon, neg_log_w)) AS ws FROM weight), known(cds, penalty) AS (SELECT cds, sum(neg_log_w) FROM (SELECT DISTINCT cds FROM c WHERE length(cds) = 9), unnest([1, 4, 7]) AS t(i) JOIN weight ON codon = substr(cds, i, 3) GROUP BY cds)
SELECT protein_id, round(penalty, 9) AS penalty, cds = 'AUGNNN' AS unknown FROM (SELECT protein_id, c.cds, CASE WHEN c.cds = '' THEN 0.0 ELSE penalty END AS penalty FROM c LEFT JOIN known USING (cds))""")
def codon_penalty(spark, d):
    """Penalties of given sequences; with an unknown codon it is infinite, here told apart."""
    seqs = _read("orders")(spark, d).select(F.col("o_orderkey").alias("protein_id"), _nth("o_orderkey", *_CDS).alias("cds"))
    out = C.codon_penalty(seqs, C.weights(_table(spark)))
    endless = F.coalesce(F.col("penalty") == float("inf"), F.lit(False))
    return out.select("protein_id", F.when(~endless, F.round("penalty", 9)).alias("penalty"), endless.alias("unknown"))


#: sequence, structure, and whether lengths, alphabet, balance, pairs and hairpins are right.
_DESIGNS = (("GGGAAAACCC", "(((....)))", 1, 1, 1, 1, 1), ("GGGAACCC", "(((..)))", 1, 1, 1, 1, 0), ("GGAAAAGG", "((....))", 1, 1, 1, 0, 1), ("GGAAAACC", "((....)", 0, 1, 0, 0, 0), ("GXAAAACC", "(....)..", 1, 0, 1, 0, 1), ("ACGU", "....", 1, 1, 1, 1, 1), ("GAAAC", ")...(", 1, 1, 0, 0, 0))
_FLAGS = ("same_length", "alphabet", "balanced", "canonical", "hairpins")


@query("structure_validity", "{raw}WITH e(k, same_length, alphabet, balanced, canonical, hairpins) AS (VALUES " + ", ".join(f"({i}, {', '.join(str(bool(x)).lower() for x in v[2:])})" for i, v in enumerate(_DESIGNS)) + ") SELECT o_orderkey AS id, same_length, alphabet, balanced, canonical, hairpins FROM orders JOIN e ON k = o_orderkey % 7")
def structure_validity(spark, d):
    rows = _read("orders")(spark, d).select(F.col("o_orderkey").alias("id"), _nth("o_orderkey", *(x[0] for x in _DESIGNS)).alias("sequence"), _nth("o_orderkey", *(x[1] for x in _DESIGNS)).alias("structure"))
    return T.validity(rows).select("id", *_FLAGS)


@query("structure_metrics", f""", {_LOOP_SQL}, l AS (SELECT p.id, p.i, p.j, count(f.i) AS branches, CASE WHEN count(f.i) = 0 THEN p.j - p.i - 1 ELSE sum(f.before) + sum(coalesce(f.after, 0)) END AS unpaired FROM pairs p LEFT JOIN flank f ON f.id = p.id AND f.parent = p.i GROUP BY p.id, p.i, p.j)
SELECT id, (min(unpaired) FILTER (branches = 0))::BIGINT AS least_hairpin, (max(unpaired) FILTER (branches = 1))::DOUBLE AS widest_two_way, count(*) FILTER (branches > 1) AS multiloops, coalesce(sum(unpaired) FILTER (branches > 1), 0)::BIGINT AS multiloop_unpaired FROM l GROUP BY id""")
def structure_metrics(spark, d):
    """Loops of the structures of whole texts."""
    return T.loop_metrics(_structures(spark, d)).withColumn("widest_two_way", F.col("widest_two_way").cast("double"))


@query("fixed_path_lattice", f"{{raw}}SELECT o_orderkey AS protein_id, unnest(range(0, 4)) AS pos, unnest(['A', 'C', 'G', ['A', 'C', 'G', 'U'][o_orderkey % 4 + 1]]) AS nuc, 0.0::DOUBLE AS weight FROM orders")
def fixed_path_lattice(spark, d):
    rows = _read("orders")(spark, d).select(F.col("o_orderkey").alias("protein_id"), F.concat(F.lit("ACG"), _nth("o_orderkey", *"ACGU")).alias("rna"))
    return C.fixed_path(rows).select("protein_id", F.col("pos").cast("long").alias("pos"), "nuc", "weight")


def _product(spark, d, spell=True):
    motifs = spark.createDataFrame([("all", m) for m in MOTIFS], "motifset_id string, motif string")
    return M.motif_product(_proteins(spark, d), C.weights(_table(spark)), motifs, spell=spell)


@query("motif_product")
def motif_product(spark, d):
    """Shape and least cost of every whole protein's lattice without the motifs."""
    return _product(spark, d).withColumn("cost", F.round("cost", 6))


_RESIDUES = "upper(regexp_replace(p_name, '[^A-Za-z]|[BJOUXZbjouxz]', '', 'g'))"


@query("motif_free_names", f""", motif(motif) AS (VALUES {", ".join(f"('{m.replace('T', 'U')}')" for m in MOTIFS)}),
state AS (SELECT DISTINCT substr(motif, 1, n::INT) AS state FROM motif, unnest(range(0, length(motif))) AS t(n)),
reads AS (SELECT state, nuc, state || nuc AS r FROM state, (VALUES ('A'), ('C'), ('G'), ('U')) AS n(nuc)),
allowed AS (SELECT * FROM reads WHERE NOT EXISTS (SELECT 1 FROM motif WHERE ends_with(reads.r, motif))),
step AS (SELECT allowed.state AS state, nuc, arg_max(s.state, length(s.state)) AS later FROM allowed JOIN state s ON ends_with(allowed.r, s.state) GROUP BY allowed.state, nuc),
name AS (SELECT DISTINCT {_RESIDUES} AS seq FROM part WHERE length({_RESIDUES}) > 0),
walk(seq, i, k, p, s) AS (SELECT seq, 0, 0, '', '' FROM name UNION
  SELECT seq, CASE WHEN k = 2 THEN i + 1 ELSE i END, (k + 1) % 3, CASE WHEN k < 2 THEN substr(codon, 1, k + 1) ELSE '' END, later
  FROM walk JOIN codon ON aa = substr(seq, i + 1, 1) AND starts_with(codon, p) JOIN step ON state = s AND nuc = substr(codon, k + 1, 1) WHERE i < length(seq)),
edge AS (SELECT DISTINCT seq, i, k, p, s, nuc, CASE WHEN k < 2 THEN substr(codon, 1, k + 1) ELSE '' END AS q, later
  FROM walk JOIN codon ON aa = substr(seq, i + 1, 1) AND starts_with(codon, p) JOIN step ON state = s AND nuc = substr(codon, k + 1, 1) WHERE i < length(seq)),
path(seq, i, s, cost) AS (SELECT seq, 0, '', 0.0::DOUBLE FROM name UNION
  SELECT seq, i + 1, c.later, round(cost + neg_log_w, 9) FROM path JOIN weight ON aa = substr(seq, i + 1, 1)
  JOIN step a ON a.state = s AND a.nuc = substr(codon, 1, 1) JOIN step b ON b.state = a.later AND b.nuc = substr(codon, 2, 1) JOIN step c ON c.state = b.later AND c.nuc = substr(codon, 3, 1)),
least AS (SELECT seq, min(cost) AS cost FROM path WHERE i = length(seq) GROUP BY seq),
shape AS (SELECT seq, count(*) FILTER (i < length(seq)) + max((i = length(seq))::INT) AS nodes FROM walk GROUP BY seq),
edges AS (SELECT seq, count(*) AS edges FROM edge GROUP BY seq)
SELECT p_partkey, nodes::BIGINT AS nodes, coalesce(edges, 0) AS edges, cost IS NOT NULL AS feasible, round(cost, 6) AS cost, round(cost, 6) AS penalty, CASE WHEN cost IS NOT NULL THEN seq END AS protein, CASE WHEN cost IS NOT NULL THEN true END AS clean
FROM (SELECT p_partkey, {_RESIDUES} AS seq FROM part) JOIN shape USING (seq) LEFT JOIN edges USING (seq) LEFT JOIN least USING (seq)""")
def motif_free_names(spark, d):
    """The parts' names as proteins: shape and least cost without the motifs, and of the sequence
    found its penalty, what it translates to, and whether it has no motif."""
    parts = _read("part")(spark, d).select(F.col("p_partkey").alias("protein_id"), S.protein(F.col("p_name")).alias("seq"))
    weights = C.weights(_table(spark))
    found = M.motif_product(parts, weights, spark.createDataFrame([("all", m) for m in MOTIFS], "motifset_id string, motif string"))
    score = C.cai(found.where("feasible"), weights).select("protein_id", F.round("penalty", 6).alias("penalty"), "protein")
    clean = F.when(F.col("feasible"), ~F.greatest(*(F.col("cds").contains(m.replace("T", "U")) for m in MOTIFS)))
    return found.join(score, "protein_id", "left").select(F.col("protein_id").alias("p_partkey"), "nodes", "edges", "feasible", F.round("cost", 6).alias("cost"), "penalty", "protein", clean.alias("clean"))


SQL["motif_free_names"] = SQL["motif_free_names"].replace("WITH", "WITH RECURSIVE", 1)


@query("constraint_monotonicity")
def constraint_monotonicity(spark, d):
    """Least costs with and without the motifs forbidden; ok where the first is no less."""
    free = C.least_cost(_proteins(spark, d), C.weights(_table(spark))).select("protein_id", F.col("cost").alias("free"))
    both = _product(spark, d, spell=False).select("protein_id", "cost").join(free, "protein_id")
    return both.select("protein_id", F.round("free", 6).alias("free"), F.round("cost", 6).alias("cost"), (F.col("cost") >= F.col("free") - 1e-7).alias("ok"))


_X, _Y = "ln(l_quantity)", "ln(l_extendedprice)"


@query("weighted_ols", f"""{{raw}}WITH r AS (SELECT l_returnflag, {_X} AS x, {_Y} AS y, l_linenumber::DOUBLE AS w FROM lineitem), m AS (SELECT l_returnflag, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM r GROUP BY l_returnflag),
s AS (SELECT l_returnflag, count(*) AS n, sum(w) AS w, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (x - mx)) AS xx, sum(w * (x - mx) * (y - my)) AS xy, sum(w * (y - my) * (y - my)) AS yy FROM r JOIN m USING (l_returnflag) GROUP BY l_returnflag)
SELECT l_returnflag, n, round(xy / xx, 6) AS slope, round(my - xy / xx * mx, 6) AS intercept, round(xy * xy / (xx * yy), 6) AS r2, round(yy - xy * xy / xx, 4) AS sse, round(sqrt((yy - xy * xy / xx) / w), 6) AS rmse FROM s""")
def weighted_ols(spark, d):
    out = A.ols(_read("lineitem")(spark, d), ["l_returnflag"], F.log("l_quantity"), F.log("l_extendedprice"), F.col("l_linenumber"))
    return out.select("l_returnflag", "n", *(F.round(c, 4 if c == "sse" else 6).alias(c) for c in ("slope", "intercept", "r2", "sse", "rmse")))


@query("hinge_fit", f"""{{raw}}WITH r AS (SELECT l_returnflag, {_X} AS x, greatest({_X} - ln(25.0), 0.0) AS h, {_Y} AS y FROM lineitem), m AS (SELECT l_returnflag, avg(x) AS mx, avg(h) AS mh, avg(y) AS my FROM r GROUP BY l_returnflag),
s AS (SELECT l_returnflag, count(*) AS n, any_value(mx) AS mx, any_value(mh) AS mh, any_value(my) AS my, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (h - mh)) AS xh, sum((h - mh) * (h - mh)) AS hh, sum((x - mx) * (y - my)) AS xy, sum((h - mh) * (y - my)) AS hy, sum((y - my) * (y - my)) AS yy FROM r JOIN m USING (l_returnflag) GROUP BY l_returnflag),
b AS (SELECT *, (xy * hh - hy * xh) / (xx * hh - xh * xh) AS slope, (hy * xx - xy * xh) / (xx * hh - xh * xh) AS bend FROM s)
SELECT l_returnflag, n, round(my - slope * mx - bend * mh, 6) AS intercept, round(slope, 6) AS slope, round(bend, 6) AS bend, round(yy - slope * xy - bend * hy, 4) AS sse FROM b""")
def hinge_fit(spark, d):
    import math

    out = A.hinge(_read("lineitem")(spark, d), ["l_returnflag"], F.log("l_quantity"), F.log("l_extendedprice"), math.log(25.0))
    return out.select("l_returnflag", "n", *(F.round(c, 4 if c == "sse" else 6).alias(c) for c in ("intercept", "slope", "bend", "sse")))


@query("slope_by_family", "{raw}SELECT p_brand, count(*) AS n, round(regr_slope(ln(p_retailprice), ln(p_size)), 6) AS slope FROM part GROUP BY p_brand")
def slope_by_family(spark, d):
    return A.ols(_read("part")(spark, d), ["p_brand"], F.log("p_size"), F.log("p_retailprice")).select("p_brand", "n", F.round("slope", 6).alias("slope"))


_FRONT = "front AS (SELECT DISTINCT l_suppkey, l_quantity, l_extendedprice FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_suppkey = x.l_suppkey AND y.l_quantity <= x.l_quantity AND y.l_extendedprice <= x.l_extendedprice AND (y.l_quantity < x.l_quantity OR y.l_extendedprice < x.l_extendedprice)))"


@query("envelope_breakpoints", f"{{raw}}WITH {_FRONT} SELECT l_suppkey, l_quantity, l_extendedprice, round((l_extendedprice - lead(l_extendedprice) OVER w) / (lead(l_quantity) OVER w - l_quantity), 6) AS trade_off FROM front WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)")
def envelope_breakpoints(spark, d):
    front = X.skyline(_read("lineitem")(spark, d), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return X.breakpoints(front, ["l_suppkey"], "l_quantity", "l_extendedprice").withColumn("trade_off", F.round("trade_off", 6))


@query("trade_off_support", f"""{{raw}}WITH {_FRONT}, b AS (SELECT t.l_suppkey, t.l_quantity, t.l_extendedprice, o.l_quantity - t.l_quantity AS dc, t.l_extendedprice - o.l_extendedprice AS de FROM front t JOIN front o USING (l_suppkey)),
s AS (SELECT l_suppkey, l_quantity, l_extendedprice, greatest(0.0, max(de / dc) FILTER (dc > 0)) AS low, min(de / dc) FILTER (dc < 0) AS high FROM b GROUP BY ALL)
SELECT l_suppkey, l_quantity, l_extendedprice, round(coalesce(low, 0.0), 6) AS low, round(high, 6) AS high FROM s WHERE high IS NULL OR coalesce(low, 0.0) <= high""")
def trade_off_support(spark, d):
    """The trade-offs at which each frontier point is the best of its supplier's."""
    front = X.skyline(_read("lineitem")(spark, d), ["l_suppkey"], "l_quantity", "l_extendedprice")
    out = X.support(front, front, ["l_suppkey"], "l_quantity", "l_extendedprice", energy_eps=0.0, cost_eps=0.0, interval_eps=0.0).where("supported")
    return out.select("l_suppkey", "l_quantity", "l_extendedprice", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("trade_off_interval", f"""{{raw}}WITH {_FRONT}, point AS (SELECT DISTINCT l_suppkey, l_quantity, l_extendedprice FROM lineitem),
b AS (SELECT t.*, t.l_quantity - o.l_quantity AS dc, o.l_extendedprice - t.l_extendedprice AS de FROM point t JOIN front o USING (l_suppkey)),
e AS (SELECT l_suppkey, l_quantity, l_extendedprice, bool_or(dc = 0 AND -de > 1e-7) AS no, greatest(0.0, coalesce(max(de / dc) FILTER (dc < 0), 0.0)) AS low, min(de / dc) FILTER (dc > 0) AS high FROM b GROUP BY ALL),
i AS (SELECT *, 1e-9 * greatest(1.0, low, abs(coalesce(high, 0.0))) AS slack FROM e),
s AS (SELECT *, NOT no AND (high IS NULL OR (high >= -1e-7 AND low <= high + slack)) AS supported, high IS NOT NULL AND abs(greatest(0.0, high) - low) <= slack AS one, (low + greatest(0.0, high)) / 2 AS middle FROM i)
SELECT l_suppkey, l_quantity, l_extendedprice, supported, round(CASE WHEN NOT supported THEN NULL WHEN one THEN middle ELSE low END, 6) AS low, round(CASE WHEN NOT supported OR high IS NULL THEN NULL WHEN one THEN middle ELSE greatest(0.0, high) END, 6) AS high,
  supported AND high IS NULL AS unbounded, round(CASE WHEN NOT supported THEN NULL WHEN high IS NULL THEN greatest(low, 1000.0) ELSE middle END, 6) AS representative FROM s""")
def trade_off_interval(spark, d):
    """Every record as a target: whether any trade-off supports it among its supplier's, and which."""
    rows = _read("lineitem")(spark, d)
    out = X.support(rows, rows, ["l_suppkey"], "l_quantity", "l_extendedprice", search_end=1000.0)
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high", "representative")})


@query("epsilon_frontier", """{raw}WITH point AS (SELECT DISTINCT l_suppkey, l_quantity, l_extendedprice FROM lineitem), kept AS (SELECT * FROM point x WHERE NOT EXISTS (SELECT 1 FROM point y WHERE y.l_suppkey = x.l_suppkey
AND y.l_quantity <= x.l_quantity + 1.5 AND y.l_extendedprice <= x.l_extendedprice + 400 AND (y.l_quantity < x.l_quantity - 1.5 OR y.l_extendedprice < x.l_extendedprice - 400)))
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_quantity DESC) AS place FROM kept""")
def epsilon_frontier(spark, d):
    """What is left of each supplier's records within tolerances, in order of price."""
    kept = X.pareto(_read("lineitem")(spark, d), ["l_suppkey"], "l_quantity", "l_extendedprice", 1.5, 400.0)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_extendedprice", F.desc("l_quantity"))).cast("long"))


@query("unplanned_records", "{raw}SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def unplanned_records(spark, d):
    """Records of orders that are not in the plan (the finished orders)."""
    plan = _read("orders")(spark, d).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _read("lineitem")(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n")).join(plan, "l_orderkey", "left_anti")


@query("scaling_efficiency", "{raw}WITH t AS (SELECT l_suppkey, l_linenumber AS threads, sum(l_quantity) AS seconds FROM lineitem GROUP BY ALL) SELECT t.l_suppkey, t.threads, round(b.seconds / t.seconds, 9) AS speedup, round(b.seconds / t.seconds / t.threads, 9) AS efficiency FROM t JOIN t b ON b.l_suppkey = t.l_suppkey AND b.threads = 1")
def scaling_efficiency(spark, d):
    """Each thread count against the same case's single thread, from one pass over the cases."""
    t = _read("lineitem")(spark, d).groupBy("l_suppkey", F.col("l_linenumber").alias("threads")).agg(F.sum("l_quantity").alias("seconds"))
    base = F.max(F.when(F.col("threads") == 1, F.col("seconds"))).over(W.partitionBy("l_suppkey"))
    speedup = F.col("base") / F.col("seconds")
    return t.withColumn("base", base).where("base is not null").select("l_suppkey", "threads", F.round(speedup, 9).alias("speedup"), F.round(speedup / F.col("threads"), 9).alias("efficiency"))


@query("layout_pairs", "{raw}WITH p AS (SELECT l_orderkey, l_linestatus, max(l_quantity) FILTER (l_returnflag = 'A') AS packed, max(l_quantity) FILTER (l_returnflag = 'R') AS square FROM lineitem GROUP BY ALL) SELECT *, round(packed / square, 9) AS ratio FROM p WHERE packed IS NOT NULL AND square IS NOT NULL")
def layout_pairs(spark, d):
    arm = lambda a, n: F.max(F.when(F.col("l_returnflag") == a, F.col("l_quantity"))).alias(n)
    p = _read("lineitem")(spark, d).groupBy("l_orderkey", "l_linestatus").agg(arm("A", "packed"), arm("R", "square")).dropna(subset=["packed", "square"])
    return p.withColumn("ratio", F.round(F.col("packed") / F.col("square"), 9))


@query("matched_gate", "{raw}SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS ours, count(*) FILTER (l_returnflag = 'R') AS theirs, count(*) FILTER (l_returnflag = 'A') >= 5 AND count(*) FILTER (l_returnflag = 'R') >= 5 AND max(l_tax) <= 0.08 AND count(DISTINCT l_linestatus) = 1 AS passed FROM lineitem GROUP BY l_suppkey")
def matched_gate(spark, d):
    """Cases that may be compared: five runs of either side, all valid, one outcome."""
    arm = lambda a: F.count_if(F.col("l_returnflag") == a)
    g = _read("lineitem")(spark, d).groupBy("l_suppkey").agg(arm("A").alias("ours"), arm("R").alias("theirs"), F.bool_and(F.col("l_tax") <= 0.08).alias("_v"), F.count_distinct("l_linestatus").alias("_k"))
    return g.select("l_suppkey", "ours", "theirs", ((F.col("ours") >= 5) & (F.col("theirs") >= 5) & F.col("_v") & (F.col("_k") == 1)).alias("passed"))


@query("length_bands", "{raw}SELECT CASE WHEN length(text) < 100 THEN 0 WHEN length(text) < 400 THEN 100 WHEN length(text) < 1000 THEN 400 ELSE 1000 END AS band, count(*) AS n, arg_min(doc_id, (length(text), doc_id)) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY band")
def length_bands(spark, d):
    """Documents by band of length, and the first of each."""
    n = F.length("text")
    band = F.when(n < 100, 0).when(n < 400, 100).when(n < 1000, 400).otherwise(1000)
    return _read("documents")(spark, d).where("text is not null").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min_by("doc_id", F.struct(n.alias("n"), "doc_id")).alias("first_id"))


@query("union_export", "{raw}SELECT n_nationkey AS key, n_name AS name, '{{\"region\":' || n_regionkey || '}}' AS place, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_regionkey, r_name, NULL, 'region' FROM region".replace("{{", "{").replace("}}", "}"))
def union_export(spark, d):
    a = _read("nation")(spark, d).select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("place"))
    b = _read("region")(spark, d).select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("note"))
    return R.union_all([a, b])


@query("multiset_difference", "{raw}SELECT k, sum(n)::BIGINT AS more FROM (SELECT c_nationkey AS k, 1 AS n FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY k HAVING sum(n) <> 0")
def multiset_difference(spark, d):
    return R.multiset_difference(_read("customer")(spark, d).select(F.col("c_nationkey").alias("k")), _read("supplier")(spark, d).select(F.col("s_nationkey").alias("k")))


@query("panel_difference", "{raw}SELECT p_partkey, f AS flag, t AS place FROM part, unnest(['A', 'N', 'R']) AS a(f), unnest(range(1, 8)) AS b(t) EXCEPT SELECT l_partkey, l_returnflag, l_linenumber FROM lineitem")
def panel_difference(spark, d):
    """Planned cells (part, flag and place) without a record."""
    cell = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.lit(t).alias("place")) for f in "ANR" for t in range(1, 8))))
    planned = _read("part")(spark, d).select("p_partkey").distinct().select("p_partkey", cell.alias("c")).select("p_partkey", "c.*")
    seen = _read("lineitem")(spark, d).select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("place")).distinct()
    return planned.join(seen, ["p_partkey", "flag", "place"], "left_anti")


@query("record_checks", "{raw}WITH c AS (SELECT l_returnflag, l_quantity > 0 AND l_quantity <= 50 AS counts, abs(l_discount - round(l_discount, 2)) <= 1e-9 AS exact, l_extendedprice >= l_quantity AS priced, l_tax < 0.08 AS taxed FROM lineitem) SELECT l_returnflag, count(*) AS n, count(*) FILTER (NOT counts) AS counts, count(*) FILTER (NOT exact) AS exact, count(*) FILTER (NOT priced) AS priced, count(*) FILTER (NOT taxed) AS taxed, count(*) FILTER (counts AND exact AND priced AND taxed) AS ok FROM c GROUP BY l_returnflag")
def record_checks(spark, d):
    """How many records break each rule."""
    c = F.col
    rules = {"counts": (c("l_quantity") > 0) & (c("l_quantity") <= 50), "exact": F.abs(c("l_discount") - F.round("l_discount", 2)) <= 1e-9, "priced": c("l_extendedprice") >= c("l_quantity"), "taxed": c("l_tax") < 0.08}
    rows = R.checked(_read("lineitem")(spark, d), rules)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), *(F.count_if(~c(r)).alias(r) for r in rules), F.count_if("ok").alias("ok"))


@query("cluster_partition", "{raw}WITH a AS (SELECT c_custkey % 60 AS head, c_custkey % 130 AS member FROM customer), own AS (SELECT member, count(*) AS n, max((head = member)::INT) AS s FROM a GROUP BY member), h AS (SELECT DISTINCT head AS member FROM a) SELECT member, coalesce(n, 0) AS n, h.member IS NOT NULL AS heads FROM own FULL JOIN h USING (member) WHERE coalesce(n, 0) <> 1 OR (h.member IS NOT NULL AND coalesce(s, 0) = 0)")
def cluster_partition(spark, d):
    """Members that are listed twice, or heads that do not stand for themselves."""
    rows = _read("customer")(spark, d).select((F.col("c_custkey") % 60).alias("head"), (F.col("c_custkey") % 130).alias("member"))
    return R.partition_faults(rows, "head", "member")


@query("status_rules", "{raw}WITH r AS (SELECT o_orderstatus, (o_orderkey % 3)::INT AS code FROM orders) SELECT o_orderstatus, code, count(*) AS n, CASE o_orderstatus WHEN 'F' THEN code = 0 WHEN 'O' THEN code > 0 ELSE code = 2 END AS ok FROM r GROUP BY ALL")
def status_rules(spark, d):
    """Each status with the exit codes it goes with."""
    s, code = F.col("o_orderstatus"), F.col("code")
    ok = F.when(s == "F", code == 0).when(s == "O", code > 0).otherwise(code == 2)
    return _read("orders")(spark, d).select("o_orderstatus", (F.col("o_orderkey") % 3).cast("int").alias("code")).groupBy("o_orderstatus", "code").agg(F.count("*").alias("n")).withColumn("ok", ok)


@query("range_check", "{raw}SELECT l_partkey, round(max(l_tax) - min(l_tax), 9) AS spread FROM lineitem GROUP BY l_partkey HAVING round(max(l_tax) - min(l_tax), 9) > 0.05")
def range_check(spark, d):
    return _read("lineitem")(spark, d).groupBy("l_partkey").agg(F.round(F.max("l_tax") - F.min("l_tax"), 9).alias("spread")).where("spread > 0.05")


@query("cross_run_consistency", "{raw}SELECT l_orderkey, count(DISTINCT l_linestatus) AS l_linestatus, count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) <= 1 AND count(DISTINCT l_returnflag) <= 1 AS ok FROM lineitem GROUP BY l_orderkey")
def cross_run_consistency(spark, d):
    return R.one_value(_read("lineitem")(spark, d), ["l_orderkey"], "l_linestatus", "l_returnflag")


@query("pair_blocks", "{raw}WITH b AS (SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_linenumber) OVER w AS before, lag(l_shipdate) OVER w AS shipped FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey)) SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber - before <> 1) AS gaps, count(*) FILTER (l_shipdate < shipped) AS reversed FROM b GROUP BY l_orderkey")
def pair_blocks(spark, d):
    """Whether an order's records are adjacent and in order of time."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey")
    b = _read("lineitem")(spark, d).select("l_orderkey", "l_linenumber", "l_shipdate", F.lag("l_linenumber").over(w).alias("before"), F.lag("l_shipdate").over(w).alias("shipped"))
    return b.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") - F.col("before") != 1).alias("gaps"), F.count_if(F.col("l_shipdate") < F.col("shipped")).alias("reversed"))


@query("speedup_summary", "{raw}WITH r AS (SELECT l_linestatus, l_extendedprice / l_quantity AS x FROM lineitem) SELECT l_linestatus, count(x) AS n, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS greatest FROM r GROUP BY l_linestatus")
def speedup_summary(spark, d):
    rows = _read("lineitem")(spark, d).select("l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return A.describe(rows, ["l_linestatus"], "x").select("l_linestatus", "n", *(F.round(c, 6).alias(c) for c in ("least", "q25", "median", "q75", "greatest")))


@query("case_summary", "{raw}SELECT l_suppkey, count(*) AS runs, count(DISTINCT l_partkey) AS parts, round(min(l_quantity), 6) AS least, round(max(l_quantity), 6) AS greatest, round(avg(l_quantity), 6) AS mean, count(*) FILTER (l_returnflag = 'R') AS returned, round(avg(l_discount) FILTER (l_returnflag = 'R'), 9) AS discount, min(l_shipdate) AS first_run, max(l_shipdate) AS last_run FROM lineitem GROUP BY l_suppkey")
def case_summary(spark, d):
    r = F.col("l_returnflag") == "R"
    return _read("lineitem")(spark, d).groupBy("l_suppkey").agg(
        F.count("*").alias("runs"), F.count_distinct("l_partkey").alias("parts"), F.round(F.min("l_quantity"), 6).alias("least"), F.round(F.max("l_quantity"), 6).alias("greatest"), F.round(F.avg("l_quantity"), 6).alias("mean"),
        F.count_if(r).alias("returned"), F.round(F.avg(F.when(r, F.col("l_discount"))), 9).alias("discount"), F.min("l_shipdate").alias("first_run"), F.max("l_shipdate").alias("last_run"))


@query("outcomes", "{raw}WITH l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL), p AS (SELECT o_orderkey, o_orderpriority, unnest(range(1, 8)) AS place FROM orders) SELECT o_orderpriority, place::INT AS place, coalesce(flag, 'missing') AS outcome, count(*) AS n FROM p LEFT JOIN l ON o_orderkey = l_orderkey AND place = l_linenumber GROUP BY ALL")
def outcomes(spark, d):
    """Planned places of orders by outcome, those without a record included."""
    seen = _read("lineitem")(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("place")).agg(F.max("l_returnflag").alias("flag"))
    planned = _read("orders")(spark, d).select("o_orderkey", "o_orderpriority", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("place"))
    return planned.join(seen, ["o_orderkey", "place"], "left").groupBy("o_orderpriority", "place", F.coalesce("flag", F.lit("missing")).alias("outcome")).agg(F.count("*").alias("n"))


@query("counter_deltas", "{raw}SELECT event_id, CASE WHEN event_id % 5 > 0 THEN 3.0::DOUBLE * (event_id % 5) END AS busy, CASE WHEN event_id % 5 > 0 THEN round(3.0 * (event_id % 5) / (3.0 * (event_id % 5) + 7), 9) END AS used FROM events")
def counter_deltas(spark, d):
    """Busy share from counters before and after; null where a counter fell."""
    e, step = F.col("event_id"), F.col("event_id") % 5
    counters = lambda busy, idle: F.transform_values(F.str_to_map(F.concat(F.lit("busy="), busy.cast("string"), F.lit(" idle="), idle.cast("string")), F.lit(" "), F.lit("=")), lambda _, v: v.cast("long"))
    delta = R.counter_deltas(counters(e + 1, e), counters(F.when(step == 0, e).otherwise(e + 1 + 3 * step), e + 7))
    busy = delta["busy"]
    return _read("events")(spark, d).select("event_id", busy.cast("double").alias("busy"), F.round(busy / (busy + delta["idle"]), 9).alias("used"))


_LAMBDAS = ("0.5", "inf", "-1", "1e999", "abc", " 1", "4", "NaN", "0", "1e307")


@query("trade_off_parse", "{raw}SELECT o_orderkey, [0.5, NULL, NULL, NULL, NULL, NULL, 4.0, NULL, 0.0, NULL][o_orderkey % 10 + 1]::DOUBLE AS trade_off FROM orders")
def trade_off_parse(spark, d):
    return _read("orders")(spark, d).select("o_orderkey", R.trade_off(_nth("o_orderkey", *_LAMBDAS)).alias("trade_off"))


@query("centi_units", "{raw}SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_discount * 100.0, 0)::BIGINT AS discount, round_even((l_linenumber - 0.5) * 1.0, 0)::BIGINT AS half FROM lineitem")
def centi_units(spark, d):
    return _read("lineitem")(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_discount") * 100.0, 0).cast("long").alias("discount"), F.bround(F.col("l_linenumber") - F.lit(0.5), 0).cast("long").alias("half"))


@query("text_hashes", "{raw}SELECT sha256(coalesce(text, '')) AS text_sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def text_hashes(spark, d):
    """Identity of texts: whole texts hashed, and who has each."""
    return _read("documents")(spark, d).groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("region_json", "{raw}SELECT r_regionkey, '{\"key\":' || r_regionkey || ',\"name\":\"' || r_name || '\",\"nations\":[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']}' AS document FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def region_json(spark, d):
    """Documents with sorted keys and values."""
    n = _read("nation")(spark, d).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    return _read("region")(spark, d).join(n, "r_regionkey").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), "nations")).alias("document"))



@query("first_tasks", "{raw}SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20")
def first_tasks(spark, d):
    """The first tasks of the plan by priority and size (a top-k report)."""
    return _read("orders")(spark, d).select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("seeded_order", "{raw}SELECT o_orderkey, ('0x' || substr(md5('11:' || o_orderkey), 1, 8))::BIGINT AS place FROM orders")
def seeded_order(spark, d):
    """Places of a shuffle that a seed fixes."""
    return _read("orders")(spark, d).select("o_orderkey", A.draw(F.lit("11"), F.col("o_orderkey").cast("string")).alias("place"))


_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("paired_bootstrap", f"""{{raw}}WITH b AS (SELECT l_suppkey, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS a, sum(l_extendedprice) FILTER (l_returnflag = 'N') AS n, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey),
x AS (SELECT row_number() OVER (ORDER BY l_suppkey) AS i, ln(a / n) AS an, ln(r / n) AS rn FROM b WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL), c AS (SELECT count(*) AS n FROM x),
p AS (SELECT draw, {_DRAW.format("'7:' || draw || ':' || k")} % n + 1 AS i FROM c, unnest(range(1, 201)) AS d(draw), unnest(range(1, n + 1)) AS t(k)),
m AS (SELECT draw, exp(avg(an)) AS an, exp(avg(rn)) AS rn FROM p JOIN x USING (i) GROUP BY draw)
SELECT 'a_over_n' AS ratio, (SELECT round(exp(avg(an)), 6) FROM x) AS estimate, round(quantile_cont(an, 0.025), 6) AS low, round(quantile_cont(an, 0.975), 6) AS high FROM m UNION ALL SELECT 'r_over_n', (SELECT round(exp(avg(rn)), 6) FROM x), round(quantile_cont(rn, 0.025), 6), round(quantile_cont(rn, 0.975), 6) FROM m""")
def paired_bootstrap(spark, d):
    """Ratios of suppliers' sums; a draw takes the same suppliers for both."""
    arm = lambda a: F.sum(F.when(F.col("l_returnflag") == a, F.col("l_extendedprice")))
    b = _read("lineitem")(spark, d).groupBy("l_suppkey").agg(arm("A").alias("a"), arm("N").alias("n"), arm("R").alias("r")).dropna()
    blocks = b.select("l_suppkey", (F.col("a") / F.col("n")).alias("a_over_n"), (F.col("r") / F.col("n")).alias("r_over_n"))
    return A.paired_bootstrap(O.in_order(blocks, "l_suppkey"), "rank", ["a_over_n", "r_over_n"], 200).select("ratio", *(F.round(c, 6).alias(c) for c in ("estimate", "low", "high")))


@query("cluster_bootstrap", f"""{{raw}}WITH s AS (SELECT c_mktsegment, c_nationkey, sum(c_acctbal) AS s, count(c_acctbal) AS c, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS i FROM customer GROUP BY c_mktsegment, c_nationkey), z AS (SELECT c_mktsegment, max(i) AS n FROM s GROUP BY c_mktsegment),
p AS (SELECT c_mktsegment, draw, {_DRAW.format("'7:' || c_mktsegment || ':' || draw || ':' || k")} % n + 1 AS i FROM z, unnest(range(1, 201)) AS d(draw), unnest(range(1, n + 1)) AS t(k)),
m AS (SELECT c_mktsegment, draw, sum(s) / sum(c) AS m FROM p JOIN s USING (c_mktsegment, i) GROUP BY ALL) SELECT c_mktsegment, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY c_mktsegment""")
def cluster_bootstrap(spark, d):
    out = A.cluster_bootstrap(_read("customer")(spark, d), "c_mktsegment", "c_nationkey", "c_acctbal", 200)
    return out.select("c_mktsegment", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("grid_missing", "{raw}SELECT s_suppkey, t AS threads, f AS flag FROM supplier, unnest([1, 2, 3, 4]) AS a(t), unnest(['A', 'N', 'R']) AS b(f) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber = t AND l_returnflag = f AND l_quantity > 49)")
def grid_missing(spark, d):
    """Cells of the planned grid without a record (of more than 49 pieces)."""
    cell = F.explode(F.array(*(F.struct(F.lit(t).alias("threads"), F.lit(f).alias("flag")) for t in (1, 2, 3, 4) for f in "ANR")))
    grid = _read("supplier")(spark, d).select("s_suppkey", cell.alias("c")).select("s_suppkey", "c.*")
    seen = _read("lineitem")(spark, d).where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").alias("threads"), F.col("l_returnflag").alias("flag")).distinct()
    return grid.join(seen, ["s_suppkey", "threads", "flag"], "left_anti")


@query("paired_trade_offs", "{raw}WITH v AS (SELECT l_partkey, l_linenumber % 2 AS arm, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL) SELECT a.l_partkey, a.n AS n0, b.n AS n4, round(b.q / a.q, 9) AS ratio FROM v a JOIN v b ON a.l_partkey = b.l_partkey AND a.arm = 0 AND b.arm = 1")
def paired_trade_offs(spark, d):
    """Each case's two trade-offs side by side, from one pass; cases with both."""
    arm = lambda k, x: F.sum(F.when(F.col("l_linenumber") % 2 == k, x))
    v = _read("lineitem")(spark, d).groupBy("l_partkey").agg(arm(0, F.lit(1)).alias("n0"), arm(1, F.lit(1)).alias("n4"), arm(0, F.col("l_quantity")).alias("_a"), arm(1, F.col("l_quantity")).alias("_b"))
    return v.dropna().select("l_partkey", "n0", "n4", F.round(F.col("_b") / F.col("_a"), 9).alias("ratio"))


@query("stats_lines", "{raw}WITH s AS (SELECT l_suppkey, count(*) AS direct, count(*) FILTER (l_returnflag = 'R') AS kept, count(*) FILTER (l_linenumber > 6) AS rare FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, 'direct=' || direct || ' kept=' || kept || ' rare=' || rare AS line, round(coalesce(kept / nullif(direct, 0), 0.0), 9) AS kept_over_direct, round(coalesce(kept / nullif(rare, 0), 0.0), 9) AS kept_over_rare FROM s")
def stats_lines(spark, d):
    """Counters as a line, and two ratios that are zero where nothing is counted."""
    s = _read("lineitem")(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("direct"), F.count_if(F.col("l_returnflag") == "R").alias("kept"), F.count_if(F.col("l_linenumber") > 6).alias("rare"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)
    line = F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("direct", "kept", "rare")))
    return s.select("l_suppkey", line.alias("line"), ratio("kept", "direct").alias("kept_over_direct"), ratio("kept", "rare").alias("kept_over_rare"))


@query("panel_clusters", "{raw}SELECT c_custkey, n_name, r_name, n_name IS NOT NULL AND r_name IS NOT NULL AS placed FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def panel_clusters(spark, d):
    """Panel entries with their clusters; placed where both levels are known."""
    n = _read("nation")(spark, d).withColumnRenamed("n_nationkey", "c_nationkey")
    r = _read("region")(spark, d).withColumnRenamed("r_regionkey", "n_regionkey")
    out = _read("customer")(spark, d).join(n, "c_nationkey", "left").join(r, "n_regionkey", "left")
    return out.select("c_custkey", "n_name", "r_name", (F.col("n_name").isNotNull() & F.col("r_name").isNotNull()).alias("placed"))


@query("metric_summary", "{raw}SELECT event_type, count(value) AS n, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.999), 6) AS tail FROM events WHERE value > 0 GROUP BY event_type")
def metric_summary(spark, d):
    """Counts, distinct users, median and tail of valid values."""
    rows = _read("events")(spark, d).where("value > 0")
    q = A.quantiles(rows, ["event_type"], "value", [0.5, 0.999]).groupBy("event_type").agg(F.round(F.max(F.when(F.col("share") == 0.5, F.col("q"))), 6).alias("median"), F.round(F.max(F.when(F.col("share") == 0.999, F.col("q"))), 6).alias("tail"))
    return rows.groupBy("event_type").agg(F.count("value").alias("n"), F.count_distinct("user_id").alias("users")).join(q, "event_type")


_ROW_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_DRAWN = " + ".join(f"(u > {c})::INT" for c in A.POISSON)
_VECTOR = ("s", "sx", "sxx", "sy0", "sxy0", "sy4", "sxy4")
_UNIT = "CASE draw WHEN 0 THEN 1 ELSE ({drawn}) END".format(drawn=_DRAWN)


def _weighted(weight: str) -> str:
    return ", ".join(f"sum({weight} * {v}) AS {v}" for v in _VECTOR)


@query("slope_schemes", f"""{{raw}}WITH v AS (SELECT l_returnflag AS h, l_suppkey AS c, {_ROW_KEY} AS k, ln(l_quantity) AS x, ln(l_extendedprice) AS y0, ln(l_extendedprice * (1 - l_discount)) AS y4 FROM lineitem),
m AS (SELECT avg(x) AS mx, avg(y0) AS m0, avg(y4) AS m4 FROM v), r AS (SELECT h, c, k, 1.0::DOUBLE AS s, x - mx AS sx, (x - mx) * (x - mx) AS sxx, y0 - m0 AS sy0, (x - mx) * (y0 - m0) AS sxy0, y4 - m4 AS sy4, (x - mx) * (y4 - m4) AS sxy4 FROM v, m),
n AS (SELECT h, count(*) AS target FROM r GROUP BY h), d AS (SELECT unnest(range(0, 41)) AS draw),
cell AS (SELECT h, c, {_weighted('1.0')} FROM r GROUP BY h, c), size AS (SELECT c, sum(s) AS every FROM cell GROUP BY c),
rd AS (SELECT r.*, draw, ('0x' || substr(md5('7:' || draw || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM r, d),
cd AS (SELECT cell.*, every, draw, ('0x' || substr(md5('7:' || draw || ':' || c), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM cell JOIN size USING (c), d),
p AS (SELECT 'within' AS scheme, true AS scaled, h, draw, {_weighted(_UNIT)} FROM rd GROUP BY h, draw UNION ALL SELECT 'cluster', true, h, draw, {_weighted(_UNIT)} FROM cd GROUP BY h, draw
  UNION ALL SELECT 'equal_cluster', false, h, draw, {_weighted(_UNIT + " / every")} FROM cd GROUP BY h, draw UNION ALL SELECT 'calibrated_equal_cluster', true, h, draw, {_weighted(_UNIT + " / every")} FROM cd GROUP BY h, draw),
f AS (SELECT p.*, CASE WHEN NOT scaled THEN 1.0 WHEN s > 0 THEN target / s END AS f FROM p JOIN n USING (h)),
t AS (SELECT scheme, draw, bool_or(f IS NULL) AS lost, {_weighted('f')} FROM f GROUP BY scheme, draw),
b AS (SELECT scheme, draw, arm, CASE WHEN NOT lost AND s > 0 THEN CASE arm WHEN 'lambda0' THEN (sxy0 - sx * sy0 / s) ELSE (sxy4 - sx * sy4 / s) END / (sxx - sx * sx / s) END AS v FROM t, (VALUES ('lambda0'), ('lambda4')) AS a(arm))
SELECT scheme, arm, round(max(v) FILTER (draw = 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (draw > 0), 6) AS high, count(*) FILTER (draw > 0 AND v IS NULL) AS lost FROM b GROUP BY scheme, arm""")
def slope_schemes(spark, d):
    """Slopes of both arms, with intervals under four ways of drawing (returns as strata, suppliers as clusters)."""
    rows = _read("lineitem")(spark, d).withColumn("_key", F.expr(_ROW_KEY))
    arms = {"lambda0": F.log("l_extendedprice"), "lambda4": F.log(F.col("l_extendedprice") * (1 - F.col("l_discount")))}
    out = A.slope_bootstrap(rows, "l_returnflag", "l_suppkey", "_key", F.log("l_quantity"), arms, 40)
    return out.withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


_REGRESSORS = ("x", "p", "q")


def _minor(columns: str) -> str:
    """DuckDB's SQL of a 3 by 3 determinant; columns: regressors, y for the right side."""
    m = lambda a, b: f"{a}{b}" if b == "y" or _REGRESSORS.index(a) <= _REGRESSORS.index(b) else f"{b}{a}"
    a, b, c = columns
    return " + ".join(f"{m('x', i)} * ({m('p', j)} * {m('q', k)} - {m('p', k)} * {m('q', j)})" for i, j, k in ((a, b, c), (b, c, a), (c, a, b)))


@query("two_knot_fit", f"""{{raw}}WITH r AS (SELECT l_returnflag, {_X} AS x, greatest({_X} - ln(15.0), 0.0) AS p, greatest({_X} - ln(35.0), 0.0) AS q, {_Y} AS y FROM lineitem), m AS (SELECT l_returnflag, avg(x) AS mx, avg(p) AS mp, avg(q) AS mq, avg(y) AS my FROM r GROUP BY l_returnflag),
s AS (SELECT l_returnflag, count(*) AS n, any_value(mx) AS mx, any_value(mp) AS mp, any_value(mq) AS mq, any_value(my) AS my, {", ".join(f"sum(({a} - m{a}) * ({b} - m{b})) AS {a}{b}" for i, a in enumerate("xpqy") for b in "xpqy"[i:])} FROM r JOIN m USING (l_returnflag) GROUP BY l_returnflag),
b AS (SELECT *, ({_minor("ypq")}) / ({_minor("xpq")}) AS b0, ({_minor("xyq")}) / ({_minor("xpq")}) AS b1, ({_minor("xpy")}) / ({_minor("xpq")}) AS b2 FROM s)
SELECT l_returnflag, n, round(my - b0 * mx - b1 * mp - b2 * mq, 5) AS intercept, round(b0, 5) AS slope, round(b1, 5) AS first_bend, round(b2, 5) AS second_bend, round(yy - b0 * xy - b1 * py - b2 * qy, 3) AS sse FROM b""")
def two_knot_fit(spark, d):
    """A line whose slope changes twice, by elimination on the normal equations."""
    import math

    out = A.knots(_read("lineitem")(spark, d), ["l_returnflag"], F.log("l_quantity"), F.log("l_extendedprice"), [math.log(15.0), math.log(35.0)])
    bend = lambda i: F.round(F.get("bends", F.lit(i)), 5)
    return out.select("l_returnflag", "n", F.round("intercept", 5).alias("intercept"), F.round("slope", 5).alias("slope"), bend(0).alias("first_bend"), bend(1).alias("second_bend"), F.round("sse", 3).alias("sse"))


@query("record_islands", """{raw}WITH s AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS r, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM s GROUP BY event_type, r - k""")
def record_islands(spark, d):
    """Runs of records of one type in the order of all records."""
    return O.islands(_read("events")(spark, d), "event_id", "event_type")


@query("pair_faults", f"""{{raw}}WITH r AS (SELECT event_id, event_id // 2 AS block, CASE WHEN user_id % 2 = 0 THEN 'sparse' ELSE 'dense' END AS arm, event_type, value, lag(event_id // 2) OVER (ORDER BY event_id) AS before FROM events),
b AS (SELECT block, count(*) AS n, count(*) FILTER (arm = 'sparse') AS s, count(*) FILTER (arm = 'dense') AS e, count(*) FILTER (before IS DISTINCT FROM block) AS runs, arg_min(arm, event_id) AS first, count(DISTINCT event_type) AS types,
  max(value) FILTER (arm = 'sparse') AS a, max(value) FILTER (arm = 'dense') AS z FROM r GROUP BY block),
f AS (SELECT block, n = 2 AND s = 1 AND e = 1 AS arms, runs = 1 AS adjacent, first = CASE WHEN {_DRAW.format("'5:' || block")} % 2 = 0 THEN 'sparse' ELSE 'dense' END AS "order", types = 1 AS equal, coalesce(abs(a - z) <= greatest(0.5, 0.25 * greatest(abs(a), abs(z))), false) AS close FROM b)
SELECT *, arms AND adjacent AND "order" AND equal AND close AS ok FROM f""")
def pair_faults(spark, d):
    """Neighbouring events as pairs of arms: which rules of paired records each pair keeps."""
    e = _read("events")(spark, d)
    rows = e.select("event_id", F.expr("event_id div 2").alias("block"), F.when(F.col("user_id") % 2 == 0, "sparse").otherwise("dense").alias("arm"), "event_type", "value")
    return O.pair_faults(rows, "block", "arm", "event_id", ["event_type"], "value", ("sparse", "dense"), seed=5, absolute=0.5, relative=0.25)


@query("planned_grid", f"""{{raw}}WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_DRAW.format("'20260906:' || o_orderkey")}, o_orderkey) AS place FROM orders),
l AS (SELECT l_orderkey AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
p AS (SELECT o_orderkey, count(*) AS planned, max(place) AS place FROM t GROUP BY o_orderkey),
s AS (SELECT o_orderkey, CASE WHEN lines % 5 = 0 THEN 2 ELSE 1 END AS recorded, CASE WHEN lines % 5 = 1 THEN place + 1 ELSE place END AS place FROM t JOIN l USING (o_orderkey))
SELECT o_orderkey, CASE WHEN coalesce(recorded, 0) < planned THEN 'missing' WHEN recorded > planned THEN 'extra' ELSE 'misplaced' END AS status, planned, coalesce(recorded, 0)::BIGINT AS recorded
FROM p LEFT JOIN s USING (o_orderkey) WHERE coalesce(recorded, 0) <> planned OR s.place <> p.place""")
def planned_grid(spark, d):
    """Orders as planned tasks in a seeded order; those with lines count as recorded, by the number of
    lines twice or a place too late."""
    plan = O.planned_order(_read("orders")(spark, d).select("o_orderkey"), "o_orderkey", 20260906)
    lines = _read("lineitem")(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    seen = plan.join(lines, "o_orderkey").withColumn("again", F.explode(F.sequence(F.lit(1), F.when(F.col("lines") % 5 == 0, 2).otherwise(1))))
    seen = seen.withColumn("place", F.when(F.col("lines") % 5 == 1, F.col("place") + 1).otherwise(F.col("place")))
    return O.plan_faults(plan, seen, "o_orderkey", "place")


_ARMS_SQL = """a AS (SELECT l_orderkey, count(*) AS lines, max(l_extendedprice) FILTER (l_linenumber % 2 = 1) AS sparse_wall, max(l_extendedprice) FILTER (l_linenumber % 2 = 0) AS dense_wall,
max(l_quantity) FILTER (l_linenumber % 2 = 1) AS sparse_solve, max(l_quantity) FILTER (l_linenumber % 2 = 0) AS dense_solve, max(l_partkey) FILTER (l_linenumber % 2 = 1) AS sparse_rss, max(l_partkey) FILTER (l_linenumber % 2 = 0) AS dense_rss,
max(l_linenumber) AS threads, max(l_discount) AS load FROM lineitem GROUP BY l_orderkey), p AS (SELECT *, dense_wall / sparse_wall AS wall, dense_solve / sparse_solve AS solve, dense_rss - sparse_rss AS rss FROM a WHERE dense_wall IS NOT NULL AND sparse_wall IS NOT NULL)"""


def _speed_sql(name: str) -> str:
    q = lambda c, s: f"round(quantile_cont({c}::DOUBLE, {s}), 6)"
    return f"{q(f'sparse_{name}', 0.5)} AS sparse_{name}_median, {q(f'dense_{name}', 0.5)} AS dense_{name}_median, {q(name, 0.5)} AS {name}_median, {q(name, 0.25)} AS {name}_q1, {q(name, 0.75)} AS {name}_q3, round(min({name}), 6) AS {name}_min, round(max({name}), 6) AS {name}_max, 0::BIGINT AS {name}_invalid"


@query("paired_case_summaries", f"""{{raw}}WITH {_ARMS_SQL},
t AS (SELECT lines, count(*) AS pairs, {_speed_sql("wall")}, {_speed_sql("solve")}, quantile_cont(sparse_rss::DOUBLE, 0.5) AS sparse_rss_median, quantile_cont(dense_rss::DOUBLE, 0.5) AS dense_rss_median, max(sparse_rss) AS sparse_rss_max, max(dense_rss) AS dense_rss_max,
  quantile_cont(rss::DOUBLE, 0.5) AS rss_median, min(rss) AS rss_min, max(rss) AS rss_max, min(threads) AS threads_min, max(threads) AS threads_max, min(load) AS load_min, max(load) AS load_max FROM p GROUP BY lines),
u AS (SELECT lines, draw, wall, solve, {_DRAW.format("'7:' || draw || ':' || l_orderkey")} / 4294967296.0::DOUBLE AS u FROM p, unnest(range(1, 41)) AS d(draw)),
c AS (SELECT lines, draw, wall, solve, unnest(range(0, {_DRAWN})) AS copy FROM u WHERE lines IN (SELECT lines FROM t WHERE pairs >= 3)),
m AS (SELECT lines, draw, quantile_cont(wall, 0.5) AS wall, quantile_cont(solve, 0.5) AS solve FROM c GROUP BY lines, draw),
i AS (SELECT lines, round(quantile_cont(wall, 0.025), 6) AS wall_ci95_low, round(quantile_cont(wall, 0.975), 6) AS wall_ci95_high, round(quantile_cont(solve, 0.025), 6) AS solve_ci95_low, round(quantile_cont(solve, 0.975), 6) AS solve_ci95_high FROM m GROUP BY lines)
SELECT *, 40 AS bootstrap_replicates, 7 AS bootstrap_seed FROM t LEFT JOIN i USING (lines)""")
def paired_case_summaries(spark, d):
    """Orders as pairs of runs (odd and even lines), summarised by how many lines they have."""
    c = F.col
    arms = {"sparse": c("l_linenumber") % 2 == 1, "dense": c("l_linenumber") % 2 == 0}
    shown = {"wall": "l_extendedprice", "solve": "l_quantity", "rss": "l_partkey"}
    pairs = _read("lineitem")(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("lines"), *(F.max(F.when(on, c(x))).alias(f"{arm}_{n}") for arm, on in arms.items() for n, x in shown.items()), F.max("l_linenumber").alias("threads"), F.max("l_discount").alias("load"))
    both = pairs.where("sparse_wall is not null and dense_wall is not null")
    two = lambda n: (f"sparse_{n}", f"dense_{n}")
    out = A.case_summaries(both, ["lines"], "l_orderkey", {"wall": two("wall"), "solve": two("solve")}, {"rss": two("rss")}, ["threads", "load"], 40)
    exact = ("lines", "pairs", "threads", "load", "bootstrap")
    return out.withColumns({n: F.round(n, 6) for n in out.columns if not n.startswith(exact) and "rss" not in n and not n.endswith("invalid")})
