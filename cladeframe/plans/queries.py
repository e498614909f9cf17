"""One query an operator, over whole tables, and the SQL that gives the same rows.

Results are those of the operators; where a number is not exact in binary it is rounded
to 9 decimals on both sides. SQL texts begin with the table expressions of ``cohort``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe import genes
from cladeframe.functions import labels, sequences
from cladeframe.operators import alignment, distance, extraction, grouping, hits, profiles, selection
from cladeframe.plans import cohort as c

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
POSITIONS = (2, 3, 5, 6)
GROUPS = ["gt"]


def query(sql: str | None = None, uses: str = ""):
    """Registers a function by its name; ``uses`` is the table expressions its SQL begins with."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {uses.strip()}\n" if uses else "") + sql.strip()
        return f

    return register


def _counts(spark: SparkSession, d: str, by: list[str] | None = None) -> DataFrame:
    return profiles.position_counts(c.cohort(spark, d), by or GROUPS)


def _profile(spark: SparkSession, d: str, by: list[str] | None = None) -> DataFrame:
    return profiles.profile(_counts(spark, d, by))


# Profiles, consensus, entropy, grids


@query("SELECT gt, pos, aa, n, denom FROM counts", c.COHORT_SQL)
def agg_position_counts(spark, d):
    return _counts(spark, d)


@query("SELECT gt, pos, aa, n, denom, round(pct, 9) AS pct FROM profile", c.COHORT_SQL)
def agg_profile(spark, d):
    return _profile(spark, d).withColumn("pct", F.round("pct", 9))


@query("SELECT gt, max(denom) AS total FROM counts WHERE pos IN (2, 3, 5, 6) GROUP BY gt", c.COHORT_SQL)
def agg_gt_count(spark, d):
    return profiles.sequences_at(_counts(spark, d).filter(F.col("pos").isin(*POSITIONS)), GROUPS)


@query(
    """, sub AS (SELECT gt, subtype, pos, count(*) AS denom FROM residues WHERE aa <> 'X' GROUP BY gt, subtype, pos)
SELECT gt, subtype, max(denom) AS total FROM sub GROUP BY gt, subtype""",
    c.COHORT_SQL,
)
def agg_max_coverage(spark, d):
    return profiles.sequences_at(_counts(spark, d, ["gt", "subtype"]), ["gt", "subtype"])


@query(
    """, wanted AS (SELECT unnest([2, 3, 5, 6, 30]) AS pos), every AS (SELECT * FROM (SELECT DISTINCT gt FROM counts) CROSS JOIN wanted)
SELECT gt, min(coalesce(denom, 0)) AS low, max(coalesce(denom, 0)) AS high, CASE WHEN min(coalesce(denom, 0)) = max(coalesce(denom, 0)) THEN min(coalesce(denom, 0))::VARCHAR ELSE min(coalesce(denom, 0)) || '-' || max(coalesce(denom, 0)) END AS coverage
FROM every LEFT JOIN (SELECT DISTINCT gt, pos, denom FROM counts) USING (gt, pos) GROUP BY gt""",
    c.COHORT_SQL,
)
def agg_coverage_range(spark, d):
    return profiles.coverage_range(_counts(spark, d), GROUPS, (*POSITIONS, 30))


@query(
    """, best AS (SELECT gt, pos, aa FROM profile QUALIFY row_number() OVER (PARTITION BY gt, pos ORDER BY pct DESC, aa) = 1)
SELECT gt, string_agg(aa, '' ORDER BY pos) AS consensus FROM best GROUP BY gt""",
    c.COHORT_SQL,
)
def agg_consensus(spark, d):
    return profiles.consensus(_profile(spark, d), GROUPS)


@query(
    """, kept AS (SELECT gt, pos, n / sum(n) OVER (PARTITION BY gt, pos) AS p FROM counts WHERE aa NOT IN ('X', '*'))
SELECT gt, pos, round(CASE WHEN abs(sum(-p * log2(p))) < 1e-12 THEN 0.0 ELSE sum(-p * log2(p)) END, 9) AS entropy FROM kept GROUP BY gt, pos""",
    c.COHORT_SQL,
)
def agg_entropy(spark, d):
    return profiles.entropy(_counts(spark, d), GROUPS, None).withColumn("entropy", F.round("entropy", 9))


@query(
    """SELECT gt, pos, string_agg(aa, '' ORDER BY pct DESC, aa) AS aas FROM profile WHERE pct >= 4 AND aa <> '*' GROUP BY gt, pos""",
    c.COHORT_SQL,
)
def agg_aggregate_aas(spark, d):
    return profiles.aggregated_residues(profiles.frequent_mutations(_profile(spark, d), GROUPS, 4.0), GROUPS)


@query("SELECT gt, pos, aa, round(pct, 9) AS pct FROM profile WHERE pct >= 1 AND aa <> '*'", c.COHORT_SQL)
def flt_freq(spark, d):
    return profiles.frequent_mutations(_profile(spark, d), GROUPS, 1.0).withColumn("pct", F.round("pct", 9))


@query(
    """, sub AS (SELECT gt, subtype, pos, aa, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY gt, subtype, pos) AS pct FROM residues WHERE aa <> 'X' GROUP BY gt, subtype, pos, aa)
SELECT gt, subtype, pos, aa, round(pct, 9) AS pct FROM sub WHERE pct >= 10 AND aa IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y')""",
    c.COHORT_SQL,
)
def rp_mutations_csv(spark, d):
    return profiles.frequent_mutations(_profile(spark, d, ["gt", "subtype"]), ["gt", "subtype"]).withColumn("pct", F.round("pct", 9))


@query("SELECT gt, max(denom) AS total FROM counts GROUP BY gt HAVING max(denom) >= 10", c.COHORT_SQL)
def flt_min_group(spark, d):
    return profiles.sufficient(_counts(spark, d), GROUPS)


_FORMAT = "CASE WHEN pct >= 10 THEN round_even(pct, 0)::BIGINT::VARCHAR WHEN pct >= 1 THEN printf('%.1f', round_even(pct, 1)) ELSE printf('%.1f', round_even(pct * 10, 0) / 10) END"


@query(
    f"""SELECT gt, pos, string_agg(aa || {_FORMAT}, '' ORDER BY pct DESC, aa) AS cell FROM profile WHERE pct >= 1 AND aa <> '*' GROUP BY gt, pos""",
    c.COHORT_SQL,
)
def fn_format_freq(spark, d):
    return profiles.variant_cells(_profile(spark, d), GROUPS)


@query(
    f""", cells AS (SELECT gt, pos, string_agg(aa || {_FORMAT}, '' ORDER BY pct DESC, aa) AS cell FROM profile WHERE pct >= 1 AND aa <> '*' AND pos IN (2, 3, 5, 6) GROUP BY gt, pos),
head AS (SELECT gt, max(denom) AS total, min(denom) AS low FROM counts WHERE pos IN (2, 3, 5, 6) GROUP BY gt)
SELECT gt, 'GT' || gt || ' (' || total || ', ' || CASE WHEN low = total THEN total::VARCHAR ELSE low || '-' || total END || ')' AS label, total,
  coalesce(max(cell) FILTER (pos = 2), '') AS "P2", coalesce(max(cell) FILTER (pos = 3), '') AS "P3", coalesce(max(cell) FILTER (pos = 5), '') AS "P5", coalesce(max(cell) FILTER (pos = 6), '') AS "P6"
FROM head JOIN cells USING (gt) GROUP BY gt, total, low""",
    c.COHORT_SQL,
)
def rp_ras_grid(spark, d):
    counts = _counts(spark, d)
    return profiles.ras_grid(profiles.profile(counts), counts, GROUPS, POSITIONS)


_PRINTED = "CASE WHEN pct >= 10 THEN round_even(pct, 0) WHEN pct >= 1 THEN round_even(pct, 1) ELSE round_even(pct * 10, 0) / 10 END"


@query(
    f""", sub AS (SELECT gt, subtype, pos, aa, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY gt, subtype, pos) AS pct FROM residues WHERE aa <> 'X' GROUP BY gt, subtype, pos, aa),
top AS (SELECT gt, pos, aa, pct FROM profile WHERE aa <> '*' QUALIFY row_number() OVER (PARTITION BY gt, pos ORDER BY {_PRINTED} DESC, pct DESC, aa) = 1)
SELECT gt, 0 AS kind, '' AS subtype, pos, aa, round(pct, 9) AS pct FROM top UNION ALL
SELECT gt, 1, subtype, pos, s.aa, round(s.pct, 9) FROM sub s JOIN top t USING (gt, pos) WHERE s.aa <> t.aa AND s.aa IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y') AND {_PRINTED.replace('pct', 's.pct')} >= 1""",
    c.COHORT_SQL,
)
def rp_combined(spark, d):
    return profiles.combined(_profile(spark, d), _profile(spark, d, ["gt", "subtype"]), "gt", "subtype").withColumn("pct", F.round("pct", 9))


@query("SELECT gt, left(consensus, 3) AS first, right(consensus, 3) AS last FROM (SELECT gt, string_agg(aa, '' ORDER BY pos) AS consensus FROM (SELECT gt, pos, aa FROM profile QUALIFY row_number() OVER (PARTITION BY gt, pos ORDER BY pct DESC, aa) = 1) GROUP BY gt)", c.COHORT_SQL)
def prj_edges(spark, d):
    first, last = sequences.edges(F.col("consensus"))
    return profiles.consensus(_profile(spark, d), GROUPS).select("gt", first.alias("first"), last.alias("last"))


# Distances


@query(
    """, g AS (SELECT l_linestatus || l_returnflag AS g, l_linenumber AS pos, CAST(l_quantity AS BIGINT) % 5 AS call FROM lineitem),
k AS (SELECT g, pos, call, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT g, pos, sum(n) AS n, sum(n * (n - 1)) AS own FROM k GROUP BY ALL),
cross_ AS (SELECT x.g AS a, y.g AS b, sum(x.n * y.n) AS t FROM p x JOIN p y ON x.pos = y.pos AND x.g < y.g GROUP BY ALL),
same AS (SELECT x.g AS a, y.g AS b, sum(x.n * y.n) AS s FROM k x JOIN k y ON x.pos = y.pos AND x.call = y.call AND x.g < y.g GROUP BY ALL)
SELECT a, b, round((t - coalesce(s, 0)) / t::DOUBLE, 9) AS distance FROM cross_ LEFT JOIN same USING (a, b) UNION ALL
SELECT g, g, CASE WHEN sum(n * (n - 1)) > 0 THEN round((sum(n * (n - 1)) - sum(own)) / sum(n * (n - 1))::DOUBLE, 9) END FROM p GROUP BY g""".replace(", g AS", "WITH g AS", 1)
)
def agg_pair_distance(spark, d):
    rows = c.table(spark, d, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("g"), F.col("l_linenumber").alias("pos"), F.pmod(F.col("l_quantity").cast("long"), F.lit(5)).alias("call"))
    return distance.pair_distance(rows.groupBy("g", "pos", "call").agg(F.count("*").alias("n")), "g").withColumn("distance", F.round("distance", 9))


@query(
    """, best AS (SELECT gt, pos, aa FROM profile QUALIFY row_number() OVER (PARTITION BY gt, pos ORDER BY pct DESC, aa) = 1)
SELECT x.gt AS a, y.gt AS b, count(*) FILTER (x.aa <> y.aa) / 9.0::DOUBLE AS distance FROM best x JOIN best y USING (pos) WHERE x.gt < y.gt AND x.aa NOT IN ('-','X','?','*') AND y.aa NOT IN ('-','X','?','*') GROUP BY ALL""",
    c.COHORT_SQL,
)
def agg_window_distance(spark, d):
    best = _profile(spark, d).groupBy("gt", "pos").agg(F.min_by("aa", F.struct(-F.col("pct"), "aa")).alias("aa"))
    return distance.window_distance(best, "gt", 9)


@query(
    """, ref AS (SELECT pos, aa AS ref FROM (SELECT pos, aa, count(*) AS n FROM residues WHERE aa <> 'X' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, aa) = 1),
best AS (SELECT gt, pos, aa FROM profile QUALIFY row_number() OVER (PARTITION BY gt, pos ORDER BY pct DESC, aa) = 1)
SELECT gt, count(*) AS compared, count(*) FILTER (aa <> ref) AS differences, coalesce(string_agg(pos || ':' || ref || '>' || aa, ',' ORDER BY pos) FILTER (aa <> ref), '') AS changes, round(count(*) FILTER (aa <> ref) / count(*)::DOUBLE, 9) AS distance FROM best JOIN ref USING (pos) GROUP BY gt""",
    c.COHORT_SQL,
)
def agg_ref_distance(spark, d):
    best = _profile(spark, d).groupBy("gt", "pos").agg(F.min_by("aa", F.struct(-F.col("pct"), "aa")).alias("aa"))
    every = profiles.position_counts(c.cohort(spark, d), []).groupBy("pos").agg(F.min_by("aa", F.struct(-F.col("n"), "aa")).alias("ref"))
    return distance.reference_distance(best, every, GROUPS).withColumn("distance", F.round("distance", 9))


@query(
    """, p AS (SELECT gt, pos, aa, n FROM counts), c AS (SELECT gt, pos, sum(n) AS n FROM p GROUP BY ALL),
t AS (SELECT x.gt AS a, y.gt AS b, sum(x.n * y.n) AS t FROM c x JOIN c y ON x.pos = y.pos AND x.gt < y.gt GROUP BY ALL),
s AS (SELECT x.gt AS a, y.gt AS b, sum(x.n * y.n) AS s FROM p x JOIN p y ON x.pos = y.pos AND x.aa = y.aa AND x.gt < y.gt GROUP BY ALL),
m AS (SELECT a, b, round((t - s) / t::DOUBLE, 9) AS dist FROM t JOIN s USING (a, b))
SELECT a, max(dist) FILTER (b = 'O') AS "O", max(dist) FILTER (b = 'P') AS "P" FROM m GROUP BY a""",
    c.COHORT_SQL,
)
def rp_matrix(spark, d):
    counts = _counts(spark, d).withColumnRenamed("aa", "call")
    pairs = distance.pair_distance(counts, "gt").withColumn("distance", F.round("distance", 9))
    return distance.matrix(pairs, ["F", "O", "P"], upper=True)


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderpriority = '5-LOW' THEN 'low' END AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'Total', count(*) FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 50000 OR o_orderpriority = '5-LOW'"""
)
def flt_ordered_exclusion(spark, d):
    return distance.exclusions(c.table(spark, d, "orders"), [("pending", F.col("o_orderstatus") == "P"), ("small", F.col("o_totalprice") < 50000), ("low", F.col("o_orderpriority") == "5-LOW")])


# Hits


@query("SELECT query, target, length, mismatch, gaps, bitscore, sstart, send, ordinal, round(distance, 9) AS distance FROM per_target", c.HITS_SQL)
def top_hit_per_gt(spark, d):
    return hits.best_per_target(hits.with_distance(c.hits(spark, d)), "query", "target").withColumn("distance", F.round("distance", 9))


@query("SELECT query, target, ordinal FROM long_target QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, length DESC, bitscore DESC, target) = 1", c.HITS_SQL + ", long_target AS (SELECT * FROM hits WHERE length >= 200 QUALIFY row_number() OVER (PARTITION BY query, target ORDER BY distance, length DESC, bitscore DESC, ordinal) = 1)")
def top_gt(spark, d):
    return hits.best_target(hits.with_distance(c.hits(spark, d)), "query", "target", genes.MIN_OVERLAP_NT).select("query", "target", "ordinal")


@query(
    """, two AS (SELECT query, target, distance, row_number() OVER (PARTITION BY query ORDER BY distance, length DESC, bitscore DESC, target) AS k FROM per_target)
SELECT query, max(target) FILTER (k = 1) AS best, round(max(distance) FILTER (k = 1), 9) AS best_distance, coalesce(max(target) FILTER (k = 2), 0) AS second, round(max(distance) FILTER (k = 2), 9) AS second_distance FROM two WHERE k <= 2 GROUP BY query""",
    c.HITS_SQL,
)
def top_subtype_2(spark, d):
    out = hits.best_two_targets(hits.with_distance(c.hits(spark, d)), "query", "target")
    return out.withColumns({k: F.round(k, 9) for k in ("best_distance", "second_distance")} | {"second": F.coalesce("second", F.lit(0))})


@query("SELECT query, target, ordinal FROM hits WHERE length >= 80 QUALIFY row_number() OVER (PARTITION BY query ORDER BY bitscore DESC, length DESC, mismatch + gaps, ordinal) = 1", c.HITS_SQL)
def top_blastx(spark, d):
    return hits.best_protein(c.hits(spark, d), "query", genes.MIN_OVERLAP_AA).select("query", "target", "ordinal")


@query("SELECT query, target, ordinal FROM hits QUALIFY row_number() OVER (PARTITION BY query, target ORDER BY bitscore DESC, length DESC, ordinal) = 1", c.HITS_SQL)
def top_gene_score(spark, d):
    return hits.best(c.hits(spark, d), ["query", "target"], hits.by_bitscore()).select("query", "target", "ordinal")


@query("SELECT query, count(*) AS n, CAST(sum(length) AS BIGINT) AS nt FROM hits WHERE length >= 200 GROUP BY query", c.HITS_SQL)
def flt_min_overlap(spark, d):
    return c.hits(spark, d).filter(F.col("length") >= genes.MIN_OVERLAP_NT).groupBy("query").agg(F.count("*").alias("n"), F.sum("length").alias("nt"))


@query("SELECT query, " + ", ".join(f'round(max(distance) FILTER (target = {t}), 9) AS "GT{t}_Distance", coalesce(max(length) FILTER (target = {t}), 0) AS "GT{t}_AlignedNT"' for t in range(1, 9)) + " FROM per_target GROUP BY query", c.HITS_SQL)
def al_blastn_gt(spark, d):
    out = hits.wide_distances(hits.with_distance(c.hits(spark, d)), "query", "target", range(1, 9))
    return out.withColumns({f"GT{t}_Distance": F.round(f"GT{t}_Distance", 9) for t in range(1, 9)} | {f"GT{t}_AlignedNT": F.coalesce(f"GT{t}_AlignedNT", F.lit(0)) for t in range(1, 9)})


@query("SELECT query, ordinal, array_to_string(list_filter([24, 26, 28, 29, 30, 31, 32, 38, 58, 62, 92, 93], lambda p: sstart <= p * 3 AND send >= (p - 1) * 3 + 1), ',') AS covered FROM hits", c.HITS_SQL)
def jn_range_cover(spark, d):
    covered = hits.covered_positions(F.col("sstart"), F.col("send"), genes.GENES["NS5A"].positions)
    return c.hits(spark, d).select("query", "ordinal", F.array_join(covered.cast("array<string>"), ",").alias("covered"))


@query("SELECT query, array_to_string(list_sort(list(DISTINCT 'G' || target)), ',') AS genes FROM hits WHERE gaps / 100.0 <= 0.03 AND target IN (1, 2, 3) GROUP BY query", c.HITS_SQL)
def al_gene_presence(spark, d):
    own = c.hits(spark, d).select(F.col("query").alias("accession"), F.concat(F.lit("G"), F.col("target").cast("string")).alias("sseqid"), (F.col("gaps") / 100.0).alias("evalue"))
    found = hits.gene_sets([own.filter("sseqid < 'G2'"), own.filter("sseqid >= 'G2'")], limit=0.03, known=("G1", "G2", "G3"))
    return found.select(F.col("accession").alias("query"), F.array_join("genes", ",").alias("genes"))


@query("SELECT query, target AS chosen, gaps AS stops FROM hits QUALIFY row_number() OVER (PARTITION BY query ORDER BY gaps, bitscore DESC, mismatch DESC, length, sstart DESC, send, ordinal) = 1", c.HITS_SQL)
def top_lexicographic(spark, d):
    rows = c.hits(spark, d).select("query", F.col("target").alias("chosen"), F.col("gaps").alias("stops"), F.col("bitscore").alias("score"), F.col("mismatch").alias("matches"), F.col("length").alias("mismatches"), F.col("sstart").alias("informative"), F.col("send").alias("ignored"), "ordinal")
    return hits.lexicographic(rows, ["query"]).select("query", "chosen", "stops")


# Selection and joins


@query("SELECT o_orderkey FROM orders WHERE lower(trim(o_orderpriority)) <> '5-low'")
def flt_exclude(spark, d):
    return c.table(spark, d, "orders").filter(selection.not_excluded(F.col("o_orderpriority"), "5-low")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey > 0")
def flt_positive(spark, d):
    return c.table(spark, d, "customer").filter(selection.positive(["c_acctbal", "c_nationkey"])).select("c_custkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')")
def flt_blocklist(spark, d):
    part = c.table(spark, d, "part")
    blocked = spark.createDataFrame([("Brand#1",), ("Brand#2",)], "p_brand string")
    return part.join(F.broadcast(blocked), "p_brand", "left_anti").select("p_partkey", "p_brand")


_RULES = [("1", "source_isolate", "contains", "Week 1"), ("2", "source_isolate", "not_contains", "ERROR"), ("3", "source_isolate", "equals", "click-3 week 3"), ("4", "source_date", "year_before", "2025"), ("5", "accession", "in_accession_list", "view"), ("6", "source_isolate", "matches_regex", "Week [1-4]"), ("6", "source_isolate", "contains", "-")]


@query(
    """SELECT accession FROM features WHERE CASE ref_id WHEN '1' THEN contains(lower(source_isolate), 'week 1') WHEN '2' THEN NOT contains(lower(source_isolate), 'error') WHEN '3' THEN lower(trim(source_isolate)) = 'click-3 week 3'
 WHEN '4' THEN CAST(regexp_extract(source_date, '\\b((?:19|20)\\d{2})\\b', 1) AS INTEGER) < 2025 WHEN '5' THEN event_type = 'view' WHEN '6' THEN regexp_matches(source_isolate, '(?i)\\bweek [1-4]\\b') AND contains(source_isolate, '-') ELSE true END""",
    c.FEATURES_SQL,
)
def flt_rules(spark, d):
    rows = c.features(spark, d)
    rules = spark.createDataFrame(_RULES, "ref_id string, field string, op string, value string")
    lists = rows.filter("event_type = 'view'").select(F.lit("view").alias("list"), "accession")
    return selection.apply_rules(rows, rules, ["source_isolate", "source_date", "accession"], lists).select("accession")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def jn_meta_semi(spark, d):
    return c.table(spark, d, "documents").join(c.table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_meta_anti(spark, d):
    return c.table(spark, d, "documents").join(c.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'Present' ELSE 'Absent' END AS mark FROM customer")
def jn_refid_present(spark, d):
    customers = c.table(spark, d, "customer").select(F.col("c_custkey"))
    return selection.marked(customers, c.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS call, CASE WHEN quality = 1 THEN 'metadata' ELSE 'alignment' END AS source FROM documents LEFT JOIN labels USING (doc_id)")
def jn_assign_left(spark, d):
    calls = c.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(" ").alias("call"))
    return selection.assigned(c.table(spark, d, "documents").select("doc_id", "lang"), calls, "doc_id", "call", "lang").select("doc_id", "call", "source")


@query(
    """, calls AS (SELECT 'A' || (o_orderkey % 500) || CASE WHEN o_orderkey % 3 = 0 THEN '.1' ELSE '.2' END AS accession, o_orderpriority AS call, o_orderkey AS ordinal FROM orders),
exact AS (SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY accession ORDER BY ordinal) = 1),
short AS (SELECT split_part(accession, '.', 1) AS b, call FROM calls QUALIFY row_number() OVER (PARTITION BY split_part(accession, '.', 1) ORDER BY ordinal) = 1),
asked AS (SELECT 'A' || c_custkey || '.' || (1 + c_custkey % 4) AS accession FROM customer)
SELECT asked.accession, coalesce(exact.call, short.call) AS call FROM asked LEFT JOIN exact USING (accession) LEFT JOIN short ON b = split_part(asked.accession, '.', 1)""".replace(", calls AS", "WITH calls AS", 1)
)
def jn_version_fallback(spark, d):
    key = F.col("o_orderkey")
    calls = c.table(spark, d, "orders").select(F.concat(F.lit("A"), F.pmod(key, F.lit(500)).cast("string"), F.when(F.pmod(key, F.lit(3)) == 0, ".1").otherwise(".2")).alias("accession"), F.col("o_orderpriority").alias("call"), key.alias("ordinal"))
    cust = F.col("c_custkey")
    asked = c.table(spark, d, "customer").select(F.concat(F.lit("A"), cust.cast("string"), F.lit("."), (F.pmod(cust, F.lit(4)) + 1).cast("string")).alias("accession"))
    return selection.with_fallback(asked, calls, "call")


@query("SELECT k, coalesce(s, p) AS call, CASE WHEN s IS NOT NULL THEN 'priority' ELSE 'base' END AS source FROM (SELECT c_custkey AS k, c_mktsegment AS p FROM customer) FULL JOIN (SELECT s_suppkey * 20 AS k, s_name AS s FROM supplier) USING (k)")
def jn_priority_override(spark, d):
    base = c.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("call"))
    prio = c.table(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("k"), F.col("s_name").alias("call"))
    return selection.overridden(base, prio, "k", "call")


@query("SELECT count(*) AS shared, count(*) FILTER (l_returnflag = x) AS same, count(*) FILTER (l_returnflag <> x) AS different, round(100.0 * count(*) FILTER (l_returnflag = x) / count(*), 2) AS percent FROM (SELECT l_orderkey AS k, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'A' ELSE 'N' END AS x FROM orders) USING (k)")
def jn_compare(spark, d):
    one = c.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_returnflag").alias("v"))
    two = c.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("N").alias("v"))
    return selection.compared(one, two, "k", "v")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 0 THEN 'unassigned' ELSE 'assigned' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def rp_comet_prepare(spark, d):
    calls = c.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "Unassigned").otherwise("1a").alias("call"))
    return selection.three_way(c.table(spark, d, "documents").select("doc_id"), calls, "doc_id", "call")


@query("SELECT url, ref_id, n_name FROM (SELECT url, CAST(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([0-9]+)$', 1) AS VARCHAR) AS ref_id FROM pages) JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS ref_id, n_name FROM nation) USING (ref_id)")
def jn_refid_file(spark, d):
    files = c.table(spark, d, "pages").select("url", F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([0-9]+)$", 1).alias("ref_id"))
    studies = c.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("ref_id"), "n_name")
    return selection.with_files(studies, files, path="url").select("url", "ref_id", "n_name")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def jn_refid_file_first(spark, d):
    return selection.first_per(c.table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def rp_profile_accessions(spark, d):
    return selection.last_per(c.table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderstatus")


@query("SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def jn_refid_file_1to1(spark, d):
    files = c.table(spark, d, "nation").select(F.col("n_nationkey").alias("ref_id"), "n_name")
    studies = c.table(spark, d, "supplier").select(F.col("s_nationkey").alias("ref_id"), "s_name")
    return selection.with_files(studies, files, "one").select("s_name", "n_name")


# Set operations


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return c.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(c.table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return c.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(c.table(spark, d, "orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, d):
    return c.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(c.table(spark, d, "orders").select("o_custkey"))


@query("SELECT 'no order' AS reason, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'no balance', c_custkey FROM customer WHERE c_acctbal <= 0")
def set_union_reason(spark, d):
    customers = c.table(spark, d, "customer")
    idle = customers.join(c.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("no order").alias("reason"), F.col("c_custkey").alias("k"))
    return idle.unionByName(customers.filter("c_acctbal <= 0").select(F.lit("no balance").alias("reason"), F.col("c_custkey").alias("k")))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def set_dedup(spark, d):
    return c.table(spark, d, "customer").select("c_nationkey", "c_mktsegment").dropDuplicates()


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'not_found') AS status FROM documents LEFT JOIN labels USING (doc_id)")
def set_missing_rows(spark, d):
    return c.table(spark, d, "documents").select("doc_id").join(c.table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("not_found")).alias("status"))


# Grouped summaries


@query(
    """SELECT ref_id, CASE WHEN count(*) = 1 THEN '' ELSE mode END AS mode, group_key, count(*) AS row_count, coalesce(array_to_string(list_sort(list(DISTINCT source_clone) FILTER (source_clone <> '')), ' | '), '') AS source_clone_values, max(len(positions)) AS covered,
 arg_max(accession, struct_pack(n := len(positions), p := positions, a := accession)) AS selected FROM keyed GROUP BY ref_id, mode, group_key""",
    c.FEATURES_SQL,
)
def agg_group_summary(spark, d):
    keyed = grouping.group_keys(c.features(spark, d))
    return grouping.summaries(keyed, "ref_id", ["source_clone"], positions="positions").withColumn("covered", F.col("covered").cast("long"))


@query("SELECT accession, mode, group_key FROM keyed", c.FEATURES_SQL)
def agg_group_rows(spark, d):
    return grouping.group_keys(c.features(spark, d)).select("accession", "mode", "group_key")


@query(
    """SELECT ref_id, count(*) FILTER (covered > 0) AS groups_with_coverage, count(*) AS groups FROM (SELECT ref_id, mode, group_key, max(len(positions)) AS covered FROM keyed GROUP BY ALL) GROUP BY ref_id""",
    c.FEATURES_SQL,
)
def agg_refid_summary(spark, d):
    groups = grouping.summaries(grouping.group_keys(c.features(spark, d)), "ref_id", [], positions="positions")
    return grouping.covered_groups(groups, "ref_id")


@query("SELECT ref_id, arg_max(accession, struct_pack(n := len(positions), p := positions, a := accession)) AS selected FROM features GROUP BY ref_id", c.FEATURES_SQL)
def agg_best_coverage(spark, d):
    return c.features(spark, d).groupBy("ref_id").agg(F.max_by("accession", F.struct(F.size("positions"), "positions", "accession")).alias("selected"))


_SPEAKER = "regexp_replace(role || '_' || conv_id % 9 || CASE WHEN turn % 2 = 0 THEN '_clone' || turn ELSE '' END, '^(.+?)[-_ ]clone[-_ ]?[a-z0-9]+$', '\\1')"


@query(f"SELECT {_SPEAKER} AS person_id, count(*) AS accession_count, string_agg(conv_id || ':' || turn, ' | ' ORDER BY conv_id || ':' || turn) AS accessions, CASE WHEN bool_or(turn % 2 = 0) AND count(*) > 1 THEN 'yes' ELSE 'no' END AS likely_clones FROM conversations GROUP BY 1")
def agg_person(spark, d):
    rows = c.table(spark, d, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("accession"), F.concat("role", F.lit("_"), F.pmod("conv_id", F.lit(9)).cast("string"), F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(F.lit("_clone"), F.col("turn").cast("string"))).otherwise("")).alias("isolate"))
    return grouping.persons(rows, "isolate", "accession", labels.likely_clone([F.lit("")], F.col("isolate"), F.col("person_id")))


@query(
    """, long AS (SELECT 'patient_id' AS field, role AS v FROM conversations UNION ALL SELECT 'isolate', CAST(conv_id AS VARCHAR) FROM conversations UNION ALL SELECT 'strain', role || turn FROM conversations),
ids AS (SELECT field, v, count(*) AS n FROM long GROUP BY ALL)
SELECT field, CAST(CASE field WHEN 'patient_id' THEN 500 ELSE 100 END + count(*) + 10 * count(*) FILTER (n > 1) AS BIGINT) AS score, count(*) AS distinct_ids, count(*) FILTER (n > 1) AS repeated FROM ids GROUP BY field""".replace(", long AS", "WITH long AS", 1)
)
def agg_person_field(spark, d):
    rows = c.table(spark, d, "conversations").select(F.col("role").alias("patient_id"), F.col("conv_id").cast("string").alias("isolate"), F.concat("role", F.col("turn").cast("string")).alias("strain"))
    return grouping.person_field(rows, ["patient_id", "isolate", "strain"])


@query("SELECT coalesce(o_orderstatus, 'Total') AS gt, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def agg_gt_counts(spark, d):
    return c.table(spark, d, "orders").rollup(F.col("o_orderstatus").alias("gt")).agg(F.count("*").alias("n")).withColumn("gt", F.coalesce("gt", F.lit("Total")))


@query("SELECT count(DISTINCT o_custkey) AS before, count(DISTINCT o_custkey) FILTER (o_totalprice > 100000) AS after FROM orders")
def agg_distinct_sets(spark, d):
    return c.table(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("before"), F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.col("o_custkey"))).alias("after"))


@query("SELECT source, count(DISTINCT lang) AS n, string_agg(DISTINCT lang, ';' ORDER BY lang) AS accessions FROM documents GROUP BY source")
def agg_file_index(spark, d):
    return grouping.file_index(c.table(spark, d, "documents"), "source", "lang")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1 THEN 'yes' ELSE 'no' END AS \"primary\" FROM lineitem")
def agg_primary_flag(spark, d):
    rows = c.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return grouping.primary_flag(rows, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY event_type")
def agg_qc_summary(spark, d):
    return c.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))


# Scalar functions


@query("SELECT accession, CASE WHEN length(nt) % 3 = 0 THEN nt END AS nt3, reverse(translate(nt, 'ACGT', 'TGCA')) AS revcomp FROM cohort", c.COHORT_SQL)
def fn_revcomp(spark, d):
    return c.cohort(spark, d).select("accession", F.when(F.length("nt") % 3 == 0, F.col("nt")).alias("nt3"), sequences.reverse_complement(F.col("nt")).alias("revcomp"))


_CODONS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(genes.CODONS.items())) + "}"


@query(f"SELECT accession, array_to_string(list_transform(range(0, length(nt) // 3), lambda k: coalesce(({_CODONS})[substr(nt, CAST(k * 3 + 1 AS INTEGER), 3)], 'X')), '') AS aa FROM cohort", c.COHORT_SQL)
def fn_translate(spark, d):
    return c.cohort(spark, d).select("accession", sequences.translate(F.col("nt")).alias("aa"))


_AMBIGUOUS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(genes.iupac_codons().items()) if set(k) <= set("ACGTN")) + "}"


@query(f"SELECT accession, array_to_string(list_transform(range(0, length(nt) // 3), lambda k: coalesce(({_AMBIGUOUS})[substr(nt, CAST(k * 3 + 1 AS INTEGER), 3)], 'X')), '') AS aa FROM cohort", c.COHORT_SQL)
def fn_translate_iupac(spark, d):
    return c.cohort(spark, d).select("accession", sequences.translate_iupac(F.col("nt")).alias("aa"))


@query("SELECT accession, start, CAST((3 - (start - 1) % 3) % 3 AS INTEGER) AS shift, substr(nt, CAST((3 - (start - 1) % 3) % 3 + 1 AS INTEGER)) AS framed FROM cohort", c.COHORT_SQL)
def fn_frame(spark, d):
    shift = sequences.frame_shift(F.col("start"))
    return c.cohort(spark, d).select("accession", "start", shift.alias("shift"), F.substring("nt", shift + 1, F.length("nt")).alias("framed"))


@query("SELECT accession, start, substr(seq, CASE WHEN 4 - start + 1 BETWEEN 1 AND length(seq) THEN 4 - start + 1 END, 1) AS p4, CASE WHEN b IS NULL THEN NULL WHEN b IN ('A','C','G','T') THEN b ELSE '-' END AS base7 FROM (SELECT *, CASE WHEN 7 - (start - 1) * 3 BETWEEN 1 AND length(nt) THEN substr(nt, 7 - (start - 1) * 3, 1) END AS b FROM cohort)", c.COHORT_SQL)
def fn_project_na(spark, d):
    return c.cohort(spark, d).select("accession", "start", sequences.residue_at(F.col("seq"), F.col("start"), F.lit(4)).alias("p4"), sequences.base_at(F.col("nt"), F.col("start"), F.lit(7)).alias("base7"))


@query("SELECT accession, regexp_matches(nt, '^[ACGTRYSWKMBDHVNU-]+$') AS nt_ok, regexp_matches(seq, '^[ACGTRYSWKMBDHVNU-]+$') AS aa_ok FROM cohort", c.COHORT_SQL)
def fn_nucleotide_test(spark, d):
    return c.cohort(spark, d).select("accession", sequences.is_nucleotide(F.col("nt")).alias("nt_ok"), sequences.is_nucleotide(F.col("seq")).alias("aa_ok"))


@query("SELECT accession, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, CAST(i AS INTEGER), 1) IN ('-','X','*') OR substr(reverse(seq), CAST(i AS INTEGER), 1) IN ('-','X','*') THEN ' ' WHEN substr(seq, CAST(i AS INTEGER), 1) = substr(reverse(seq), CAST(i AS INTEGER), 1) THEN '|' ELSE '.' END), '') AS marks FROM cohort", c.COHORT_SQL)
def fn_marker(spark, d):
    return c.cohort(spark, d).select("accession", sequences.marker(F.col("seq"), F.reverse("seq")).alias("marks"))


@query(
    """, cols AS (SELECT accession, substr(seq, CAST(i AS INTEGER), 1) AS r, substr(reverse(seq), CAST(i AS INTEGER), 1) AS q FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM cohort))
SELECT accession, round(count(*) FILTER (r = q AND q NOT IN ('X','*','-') AND r <> '-') / nullif(count(*) FILTER (q NOT IN ('X','*','-') AND r <> '-'), 0)::DOUBLE, 9) AS identity FROM cols GROUP BY accession""",
    c.COHORT_SQL,
)
def fn_identity(spark, d):
    return c.cohort(spark, d).select("accession", F.round(sequences.identity(F.col("seq"), F.reverse("seq")), 9).alias("identity"))


@query(
    """, cols AS (SELECT accession, CAST(i AS INTEGER) AS i, substr(seq, CAST(i AS INTEGER), 1) AS q FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM cohort))
SELECT accession, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (q = '*'), '') AS stops, coalesce(string_agg(i || ':A', ',' ORDER BY i) FILTER (q = '-'), '') AS deleted FROM cols GROUP BY accession""",
    c.COHORT_SQL,
)
def fn_stop_positions(spark, d):
    ref = F.repeat(F.lit("A"), F.length("seq"))
    return c.cohort(spark, d).select("accession", F.array_join(sequences.stop_positions(ref, F.col("seq")), ",").alias("stops"), F.array_join(sequences.deletions(ref, F.col("seq")), ",").alias("deleted"))


@query("SELECT aa, pos, CAST(CASE WHEN aa = 'X' THEN -3 WHEN aa = '*' THEN -6 WHEN aa = 'A' THEN 3 ELSE -2 END AS INTEGER) AS score, count(*) AS n FROM residues GROUP BY ALL", c.COHORT_SQL)
def fn_aa_score(spark, d):
    rows = profiles.residues(c.cohort(spark, d), ["gt"])
    return rows.groupBy("aa", "pos", sequences.residue_score(F.lit("A"), F.col("aa")).alias("score")).agg(F.count("*").alias("n"))


@query("SELECT url, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, split_part(regexp_extract(url, '^https?://([^/]+)', 1), '.', 1) AS base, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')), ''), 'job') AS label FROM pages")
def fn_sanitize_label(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return c.table(spark, d, "pages").select("url", F.lower(host).alias("host"), labels.versionless(host).alias("base"), labels.sanitize(F.col("url")).alias("label"))


@query("SELECT doc_id, regexp_extract(text, '^(\\S+)', 1) AS accession FROM documents")
def fn_accession_from_header(spark, d):
    return c.table(spark, d, "documents").select("doc_id", labels.accession_of(F.col("text")).alias("accession"))


@query("SELECT accession, CAST(nullif(regexp_extract(source_date, '\\b((?:19|20)\\d{2})\\b', 1), '') AS INTEGER) AS year FROM features", c.FEATURES_SQL)
def fn_first_year(spark, d):
    return c.features(spark, d).select("accession", labels.first_year(F.col("source_date")).alias("year"))


@query("SELECT accession, regexp_matches(source_isolate, '(?i)\\bweek [1-3]\\b') AS early FROM features", c.FEATURES_SQL)
def fn_token_regex(spark, d):
    return c.features(spark, d).select("accession", labels.bounded_token(F.col("source_isolate"), "week [1-3]").alias("early"))


@query("SELECT doc_id, len(s) AS n_sentences, len(list_filter(s, lambda x: contains(lower(x), 'license'))) AS mentions FROM (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1\x01', 'g'), '\x01+', '\x01', 'g'), '\x01') AS s FROM documents)")
def fn_accession_mentions(spark, d):
    s = labels.sentences(F.col("text"))
    return c.table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size(F.filter("s", lambda x: F.contains(F.lower(x), F.lit("license")))).cast("long").alias("mentions"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents")
def fn_normalize_text(spark, d):
    return c.table(spark, d, "documents").select("doc_id", labels.normalize_text(F.col("text")).alias("plain"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 8 + 1 AS VARCHAR) WHEN 1 THEN CAST(event_id % 8 + 1 AS VARCHAR) WHEN 2 THEN CAST(event_id % 8 + 1 AS VARCHAR) ELSE '' END AS genotype,
CASE event_id % 4 WHEN 0 THEN (event_id % 8 + 1) || 'b' WHEN 1 THEN (event_id % 8 + 1) || 'a' WHEN 2 THEN (event_id % 8 + 1) || 'c' ELSE '' END AS subtype, CASE event_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'organism' WHEN 2 THEN 'note' ELSE '' END AS column_name FROM events"""
)
def fn_extract_gt_subtype(spark, d):
    gt = (F.pmod("event_id", F.lit(8)) + 1).cast("string")
    kind = F.pmod("event_id", F.lit(4))
    rows = c.table(spark, d, "events").select("event_id", F.when(kind == 0, F.concat(F.lit("Genotype: "), gt, F.lit("; subtype b"))).when(kind == 2, F.concat(gt, F.lit("C"))).otherwise("recombinant of genotype 2").alias("note"), F.when(kind == 1, F.concat(F.lit("isolate HCV-"), gt, F.lit("a x"))).otherwise("").alias("organism"))
    return rows.select("event_id", labels.first_genotype_subtype(["note", "organism"]).alias("x")).select("event_id", "x.*")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_block(spark, d):
    fenced = F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```\n"))
    return c.table(spark, d, "events").select("event_id", F.get_json_object(labels.json_block(fenced), "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 0.0 ELSE round_even(p_retailprice * power(10, 1 - floor(log10(p_retailprice))), 0) / power(10, 1 - floor(log10(p_retailprice))) END AS rounded FROM part")
def fn_round_sig(spark, d):
    return c.table(spark, d, "part").select("p_partkey", labels.round_significant(F.col("p_retailprice")).alias("rounded"))


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '#(\\d+)$', 1) AS BIGINT) AS total, c_nationkey || ',' || c_custkey % 7 AS list, CAST(c_nationkey + c_custkey % 7 AS BIGINT) AS s FROM customer")
def fn_position_list(spark, d):
    text = F.concat(F.col("c_nationkey").cast("string"), F.lit(","), F.pmod("c_custkey", F.lit(7)).cast("string"))
    listed = labels.positions(F.concat(text, F.lit(", ,")))
    return c.table(spark, d, "customer").select("c_custkey", labels.label_total(F.concat(F.lit("GT1 ("), F.regexp_extract("c_name", "#(\\d+)$", 1), F.lit(", 2-3)"))).alias("total"), F.array_join(listed.cast("array<string>"), ",").alias("list"), F.aggregate(listed, F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '_' || left(sha1(o_orderpriority), 8) AS job FROM orders")
def fn_job_id(spark, d):
    return c.table(spark, d, "orders").select("o_orderkey", labels.job_id(F.col("o_orderdate"), F.col("o_orderpriority")).alias("job"))


@query("SELECT p_partkey, split_part(p_brand, '#', 2) AS brand, p_type AS kind FROM part")
def fn_parse_headers(spark, d):
    header = F.concat(F.lit("brand="), F.substring_index("p_brand", "#", -1), F.lit("|kind="), "p_type")
    return c.table(spark, d, "part").select("p_partkey", labels.key_values(header).alias("m")).select("p_partkey", F.element_at("m", F.lit("brand")).alias("brand"), F.element_at("m", F.lit("kind")).alias("kind"))


@query(
    """SELECT accession, CASE WHEN seq = '' THEN 'NO_AA_SEQUENCE' WHEN length(seq) > 5 THEN 'FLAGGED' WHEN compared >= 0 AND pct >= 30 THEN 'HIGH_DIVERGENCE' ELSE 'PASS' END AS status, CAST(CASE WHEN length(seq) > 5 THEN 0 ELSE compared END AS INTEGER) AS compared FROM (
SELECT accession, seq, CASE WHEN compared > 0 THEN 100.0 * mutations / compared ELSE 0 END AS pct, compared FROM (
SELECT accession, seq, count(*) FILTER (position(q IN 'ACDEFGHIKLMNPQRSTVWY') > 0 AND r <> '') AS compared, count(*) FILTER (position(q IN 'ACDEFGHIKLMNPQRSTVWY') > 0 AND r <> '' AND q <> r) AS mutations FROM (
SELECT accession, seq, substr(seq, CAST(i AS INTEGER), 1) AS q, substr('ACDEFGHIKLMNPQRS', CAST(start + i - 1 AS INTEGER), 1) AS r FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM cohort)) GROUP BY accession, seq))""",
    c.COHORT_SQL,
)
def al_qc(spark, d):
    rows = c.cohort(spark, d)
    end = F.when(F.length("seq") > 5, F.col("start") + 99).otherwise(F.col("start") + F.length("seq") - 1)
    return rows.select("accession", alignment.quality(F.col("seq"), F.col("start"), end, F.lit("ACDEFGHIKLMNPQRS"), genes.GENES["NS5A"]).alias("q")).select("accession", "q.status", "q.compared")


# Alignment programs, held against brute force in the tests


@query()
def al_pairwise_global(spark, d):
    ref = F.lit("ACDEFGHIKL")
    return c.cohort(spark, d).select("accession", alignment.aligner()(F.col("seq"), ref).alias("al")).select("accession", "al.score", "al.query_start", "al.query_end", "al.ref_start", "al.ref_end")


@query()
def al_pairwise_local(spark, d):
    return c.cohort(spark, d).select("accession", alignment.aligner(alignment.LOCAL_NT, True)(F.col("nt"), F.lit("ACGTACGTACGTACGT")).alias("al")).select("accession", "al.*")


@query()
def al_extract_aa(spark, d):
    rows = c.cohort(spark, d).select("accession", alignment.aligner()(F.col("seq"), F.lit("ACDEFGHIKL")).alias("al"))
    return rows.select("accession", alignment.anchored(F.col("al.query"), F.col("al.ref"), F.col("al.ref_start")).alias("x")).select("accession", "x.*")


@query()
def al_gene_extract(spark, d):
    rows = extraction.spread(c.cohort(spark, d).select("accession", "nt"), "accession")
    found = rows.select("accession", extraction.extracted(F.col("nt"), F.lit("ATGGCTTGCGATGAATTC"), refine=True).alias("gene"))
    return found.select("accession", "gene.score", "gene.frame", "gene.aa", "gene.aligned_ref_nt", "gene.aligned_query_nt")


@query()
def al_frameshift_dp(spark, d):
    return c.cohort(spark, d).select("accession", alignment.frameshift_refined()(F.lit("ACD"), F.col("nt")).alias("f")).select("accession", "f.*")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("l_linenumber") * 10 + F.pmod("l_partkey", F.lit(17))).cast("int")
    length = (F.pmod("l_suppkey", F.lit(23)) + 1).cast("int")
    return c.table(spark, d, "lineitem").select("l_orderkey", start.alias("qstart"), (start + length).alias("qend"), F.col("l_quantity").cast("int").alias("nident"), F.col("l_extendedprice").alias("bitscore"), F.lit(120).alias("qlen"))


@query()
def al_tblastn_chain(spark, d):
    return alignment.hit_chains(_segments(spark, d), ["l_orderkey"])


@query()
def jn_gt_partition(spark, d):
    rows = c.cohort(spark, d).select("accession", "gt", F.col("nt").alias("seq"))
    refs = spark.createDataFrame([("F", 1, "a", "ACGTACGT"), ("F", 2, "b", "TTGACCAG"), ("O", 1, "c", "GGGCCCAA"), ("P", 1, "d", "ACACACAC")], "gt string, ref_ordinal int, ref_name string, ref_seq string")
    return alignment.best_reference(rows, refs, ["gt"], "accession", traced=False).select("accession", "ref_name", "score")
