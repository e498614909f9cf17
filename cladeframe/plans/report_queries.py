"""Queries of reports, updates, look-ups, sinks and scalar functions; registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeframe import workdir
from cladeframe.functions import labels, sequences
from cladeframe.operators import alignment, distance, profiles, reports
from cladeframe.plans import cohort as c
from cladeframe.plans.queries import _CODONS, _profile, _segments, query
from cladeframe.sources import files, workbooks

_text = lambda name: F.col(name).cast("string")

# Updates, look-ups and choices


@query("SELECT c_custkey AS k, coalesce(x, c_mktsegment) AS call, CASE WHEN x IS NULL THEN '' ELSE 'external' END AS source, x IS NOT NULL AS updated FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS x FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def jn_override_update(spark, d):
    rows = c.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("call"))
    calls = c.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", " ").otherwise(F.col("o_orderpriority")).alias("call"), F.col("o_orderkey").alias("ordinal"))
    return reports.updated(rows, calls, "k", "call")


@query("""SELECT 'A' || c_custkey || '.1' AS accession, external_subtype, subtype FROM customer
JOIN (SELECT o_custkey AS k, max_by(left(o_orderpriority, 1) || 'd', o_orderkey) AS subtype FROM orders WHERE left(o_orderpriority, 1) = '1' OR o_custkey % 9 IN (7, 8) GROUP BY 1) p ON p.k = c_custkey
JOIN (SELECT o_custkey AS k, max_by(lower(o_orderstatus), o_orderkey) AS external_subtype FROM orders GROUP BY 1) e ON e.k = c_custkey""")
def jn_priority_report(spark, d):
    orders = c.table(spark, d, "orders")
    named = lambda key, version: F.concat(F.lit("A"), _text(key), F.lit(version)).alias("accession")
    profile = c.table(spark, d, "customer").select(named("c_custkey", ".1"), F.col("c_custkey").alias("ordinal"))
    priority = orders.select(named("o_custkey", ".2"), F.pmod("o_custkey", F.lit(9)).cast("string").alias("genotype"), F.concat(F.substring("o_orderpriority", 1, 1), F.lit("D")).alias("subtype"), F.col("o_orderkey").alias("ordinal"))
    external = orders.select(named("o_custkey", ""), F.col("o_orderstatus").alias("subtype"), F.col("o_orderkey").alias("ordinal"))
    return reports.priority_report(profile, priority, external)


@query("SELECT l_orderkey, l_linenumber, l_discount * 10 AS score FROM lineitem WHERE l_discount * 10 < 0.8")
def flt_threshold_low(spark, d):
    return reports.low_scores(c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("score")))


@query("SELECT ref, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(ref, '[0-9]+') THEN CAST(ref AS BIGINT) ELSE 1000000000000 END, ref) AS rank FROM (SELECT CAST(n_nationkey AS VARCHAR) AS ref FROM nation UNION SELECT n_name FROM nation)")
def srt_refid(spark, d):
    nation = c.table(spark, d, "nation")
    refs = nation.select(_text("n_nationkey").alias("ref")).union(nation.select("n_name")).distinct()  # a row a study
    return reports.numbered(refs, reports.study_order(F.col("ref")), "rank")


@query("SELECT min(url) AS path FROM pages WHERE regexp_matches(url, '[0-9]')")
def lim_first_file(spark, d):
    return reports.first_path(c.table(spark, d, "pages").select(F.col("url").alias("path")), "[0-9]")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS value, CASE c_custkey % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'look-up' END AS source FROM customer")
def fn_reference_step(spark, d):
    when = lambda k, col: F.when(F.pmod("c_custkey", F.lit(3)) == k, F.col(col)).otherwise(" ")
    found = reports.first_source([("kept", when(0, "c_name")), ("look-up", when(1, "c_mktsegment")), ("other", F.lit(""))])
    return c.table(spark, d, "customer").select("c_custkey", found["value"].alias("value"), found["source"].alias("source"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS reference, CASE WHEN c_custkey % 2 = 0 THEN coalesce(CAST(m AS VARCHAR), '') ELSE 'own' END AS pubmed, CASE WHEN c_custkey % 2 = 0 AND m IS NOT NULL THEN 'look-up' ELSE '' END AS pmid_source, 'd' || m AS doi FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn_ref_enrich(spark, d):
    references = c.table(spark, d, "customer").select(_text("c_custkey").alias("reference"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, "").otherwise("own").alias("pubmed"))
    results = c.table(spark, d, "orders").select(_text("o_custkey").alias("reference"), _text("o_orderkey").alias("pmid"), F.concat(F.lit("d"), _text("o_orderkey")).alias("doi"), F.col("o_orderkey").alias("ordinal"))
    return reports.enriched(references, results)


@query("""SELECT 'P' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '.2' END AS accession, l_returnflag AS path, l_suppkey AS start_byte, CASE WHEN l_partkey IS NULL THEN '' WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'versionless' END AS found
FROM part LEFT JOIN (SELECT l_partkey, l_returnflag, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) = 1) ON l_partkey = p_partkey""")
def jn_offset_lookup(spark, d):
    ordinal = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")
    records = c.table(spark, d, "lineitem").select(F.concat(F.lit("P"), _text("l_partkey"), F.lit(".1")).alias("accession"), F.col("l_returnflag").alias("path"), ordinal.alias("ordinal"), F.col("l_suppkey").alias("start_byte"))
    asked = c.table(spark, d, "part").select(F.concat(F.lit("P"), _text("p_partkey"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, ".1").otherwise(".2")).alias("accession"))
    return reports.looked_up(asked, reports.indexed(records))


@query("SELECT accession FROM cohort WHERE accession IN (SELECT 'AC' || o_orderkey || '.1' FROM orders WHERE o_totalprice > 100000)", c.COHORT_SQL)
def jn_profile_semi(spark, d):
    listed = c.table(spark, d, "orders").filter("o_totalprice > 100000").select(F.concat(F.lit("AC"), _text("o_orderkey"), F.lit(".1")).alias("accession"))
    return c.cohort(spark, d).join(listed, "accession", "left_semi").select("accession")


# Counts and reports


def _tested(spark, d):
    return c.cohort(spark, d).select("accession", "gt", F.when(F.col("subtype") == "5", " ").otherwise(F.col("subtype")).alias("subtype"), F.when(F.col("gt") == "F", "pass").when(F.col("gt") == "O", "Refine").otherwise("Review").alias("status"))


@query("SELECT count(DISTINCT accession) FILTER (gt = 'F') AS included, count(DISTINCT accession) FILTER (gt = 'F' AND subtype <> '5') AS with_subtype, count(DISTINCT accession) FILTER (gt = 'F' AND subtype = '5') AS without_subtype, count(DISTINCT accession) FILTER (gt <> 'F') AS ignored FROM cohort", c.COHORT_SQL)
def rp_profile_counts(spark, d):
    return reports.profile_counts(_tested(spark, d))


@query("SELECT CASE gt WHEN 'O' THEN 'refine' ELSE 'review' END AS status, count(DISTINCT accession) AS n FROM cohort WHERE gt <> 'F' GROUP BY 1", c.COHORT_SQL)
def agg_failed_counts(spark, d):
    return reports.failed_counts(_tested(spark, d))


_MARK = "array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN substr(seq, CAST(i AS INTEGER), 1) IN ('-', 'X', '*') OR substr(q, CAST(i AS INTEGER), 1) IN ('-', 'X', '*') THEN ' ' WHEN substr(seq, CAST(i AS INTEGER), 1) = substr(q, CAST(i AS INTEGER), 1) THEN '|' ELSE '.' END), '')"
_SAID = "len(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, CAST(i AS INTEGER), 1) <> '-' AND substr(q, CAST(i AS INTEGER), 1) NOT IN ('-', 'X', '*')))"


@query(
    f""", aligned AS (SELECT accession AS label, gt, seq, translate(seq, 'ACD', 'C-D') AS q FROM cohort), marked AS (SELECT *, {_MARK} AS m, {_SAID} AS said FROM aligned),
scored AS (SELECT *, length(replace(replace(m, ' ', ''), '.', '')) AS same FROM marked)
SELECT label, 'gene=NS3 subtype_consensus=' || label || ' genotype=GT' || gt || chr(10) ||
  printf('score=%.3f identity=%d/%d (%.3f%%) reference_length=%d consensus_length=%d', length(seq)::DOUBLE, same, said, CASE WHEN said > 0 THEN same / said::DOUBLE ELSE 0 END * 100, length(replace(seq, '-', '')), length(replace(q, '-', ''))) || chr(10) ||
  array_to_string(list_transform(range(0, greatest(CAST(ceil(length(seq) / 4.0) AS BIGINT), 1)), lambda k: 'REF  ' || lpad(CAST(k * 4 + 1 AS VARCHAR), 5, ' ') || ' ' || substr(seq, CAST(k * 4 + 1 AS INTEGER), 4) || chr(10) || '           ' || substr(m, CAST(k * 4 + 1 AS INTEGER), 4) || chr(10) || 'CONS ' || lpad(CAST(k * 4 + 1 AS VARCHAR), 5, ' ') || ' ' || substr(q, CAST(k * 4 + 1 AS INTEGER), 4) || chr(10)), chr(10)) AS text
FROM scored""",
    c.COHORT_SQL,
)
def rp_consensus_alignment(spark, d):
    aligned = c.cohort(spark, d).select(F.col("accession").alias("label"), "gt", F.col("seq").alias("ref"), F.translate("seq", "ACD", "C-D").alias("query"), F.length("seq").alias("score"))
    return reports.consensus_report(aligned, "NS3", width=4)


@query("SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS nident, count(DISTINCT p) AS covered FROM (SELECT l_orderkey, s, e, unnest(range(s, e + 1)) AS p, unnest(list_concat([CAST(l_quantity AS BIGINT)], list_transform(range(s, e), lambda x: 0))) AS n FROM (SELECT l_orderkey, l_quantity, l_linenumber * 10 + l_partkey % 17 AS s, l_linenumber * 10 + l_partkey % 17 + l_suppkey % 23 + 1 AS e FROM lineitem)) GROUP BY 1")
def agg_chain_summary(spark, d):
    return alignment.chain_summary(_segments(spark, d), ["l_orderkey"]).select("l_orderkey", "nident", "covered")


@query("SELECT 'N' || c_nationkey AS paper, '# N' || c_nationkey || ' (' || count(*) || ')' || chr(10) || string_agg('- C' || c_custkey || ': ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY c_nationkey")
def snk_paper_hits(spark, d):
    rows = c.table(spark, d, "customer").select(F.concat(F.lit("N"), _text("c_nationkey")).alias("paper"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit("C"), _text("c_custkey")).alias("accession"), F.col("c_mktsegment").alias("sentence"))
    return reports.mention_report(rows)


# Sinks: what is written is read again


@query("SELECT count(*) AS rows, count(*) FILTER (l_quantity < 10) AS low FROM lineitem")
def snk_json_summary(spark, d):
    rows, seen = reports.counted(c.table(spark, d, "lineitem").select("l_quantity"), {"low": F.col("l_quantity") < 10})
    rows.write.parquet(workdir.new_path(spark, "counted"))
    line = spark.createDataFrame([(reports.summary_json(seen, gene="NS3"),)], "line string")
    return line.select(F.from_json("line", "rows long, low long").alias("x")).select("x.*")


@query("SELECT c_nationkey, c_name AS value FROM customer")
def snk_text_report(spark, d):
    path = workdir.new_path(spark, "report")
    files.write_report(c.table(spark, d, "customer").select("c_nationkey", F.col("c_name").alias("text")), path, by=["c_nationkey"])
    return spark.read.text(path).select("c_nationkey", "value")


@query("SELECT gt AS ref_id, accession, seq FROM cohort WHERE gt <> 'O'", c.COHORT_SQL)
def snk_rewrite(spark, d):
    path = workdir.new_path(spark, "rewritten")
    files.rewrite_fasta(c.cohort(spark, d).filter("gt <> 'O'").select(F.col("gt").alias("ref_id"), F.col("accession").alias("header"), "seq"), path, width=4)
    return files.read_fasta(spark, path).select(F.regexp_extract("path", "ref_id=([^/]*)", 1).alias("ref_id"), "accession", "seq")


@query("SELECT accession, seq FROM cohort", c.COHORT_SQL)
def snk_concat(spark, d):
    one, two = workdir.new_path(spark, "fasta"), workdir.new_path(spark, "fasta")
    files.write_fasta(c.cohort(spark, d).select(F.col("accession").alias("header"), "seq"), one, width=3)
    files.concatenated(spark, one, two, endings=None)
    return files.read_fasta(spark, two).select("accession", "seq")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS sheet, n_name FROM nation")
def snk_xlsx_tabs(spark, d):
    path = workdir.new_path(spark, "workbook") + ".xlsx"
    workbooks.write_tabs(c.table(spark, d, "nation").select("n_regionkey", "n_name"), "n_regionkey", path, order=["n_name"])
    return workbooks.read_workbook(spark, path).select("sheet", F.element_at("cells", F.lit("n_name")).alias("n_name"))


# Scalar functions


@query("SELECT accession, split_part(accession, '.', 1) AS short FROM cohort", c.COHORT_SQL)
def fn_versionless(spark, d):
    return c.cohort(spark, d).select("accession", labels.versionless(F.col("accession")).alias("short"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 BETWEEN 1 AND 8 THEN CAST(c_custkey % 10 AS VARCHAR) ELSE '' END AS gt FROM customer")
def fn_normalize_gt(spark, d):
    said = F.concat(F.lit(" "), F.pmod("c_custkey", F.lit(10)).cast("string"), F.lit("a"))
    return c.table(spark, d, "customer").select("c_custkey", labels.genotype(said).alias("gt"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 3 + 1 AS VARCHAR) || 'ab' ELSE '1b' END AS subtype FROM customer")
def fn_normalize_subtype(spark, d):
    said = F.when(F.pmod("c_custkey", F.lit(2)) == 0, " Ab").otherwise("1B ")
    return c.table(spark, d, "customer").select("c_custkey", labels.subtype(said, (F.pmod("c_custkey", F.lit(3)) + 1).cast("string")).alias("subtype"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey + 0.5::DOUBLE END AS number FROM customer")
def fn_parse_number(spark, d):
    said = F.concat(F.lit(" "), _text("c_custkey"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, "x").otherwise(".5 "))
    return c.table(spark, d, "customer").select("c_custkey", labels.number(said).alias("number"))


@query("SELECT c_custkey, contains(lower(c_mktsegment), 'build') AS found FROM customer")
def fn_contains_ci(spark, d):
    return c.table(spark, d, "customer").select("c_custkey", labels.contains_ci(F.col("c_mktsegment"), F.lit("bUILD")).alias("found"))


@query("SELECT accession, nt || 'TT' AS clean, nt || 'TNNT' AS masked FROM cohort", c.COHORT_SQL)
def fn_nt_normalize(spark, d):
    raw = F.concat(F.lower("nt"), F.lit("u -?T"))
    return c.cohort(spark, d).select("accession", sequences.normalize_nt(raw).alias("clean"), sequences.normalize_nt(raw, mask=True).alias("masked"))


@query(f"SELECT accession, '-' || array_to_string(list_transform(range(0, length(nt) // 3), lambda k: coalesce(({_CODONS})[substr(nt, CAST(k * 3 + 1 AS INTEGER), 3)], 'X')), '') AS aa FROM cohort", c.COHORT_SQL)
def fn_translate_gap(spark, d):
    return c.cohort(spark, d).select("accession", sequences.translate_gapped(F.concat(F.lit("---"), F.col("nt"))).alias("aa"))


@query(f"SELECT accession, array_to_string(list_transform(range(0, length(f) // 3), lambda k: coalesce(({_CODONS})[substr(f, CAST(k * 3 + 1 AS INTEGER), 3)], 'X')), '') AS aa, CAST((start - 1 + (3 - (start - 1) % 3) % 3) // 3 + 1 AS INTEGER) AS first FROM (SELECT accession, start, substr(nt, CAST((3 - (start - 1) % 3) % 3 + 1 AS INTEGER)) AS f FROM cohort)", c.COHORT_SQL)
def fn_aa_window(spark, d):
    return c.cohort(spark, d).select("accession", sequences.aa_window(F.col("nt"), F.col("start")).alias("aa"), sequences.aa_window_start(F.col("start")).alias("first"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'p' || c_custkey % 4 END AS pmid FROM customer")
def fn_first_pmid(spark, d):
    k = F.pmod("c_custkey", F.lit(4))
    refs = F.array(F.when(k == 0, "p0").otherwise(" "), F.when(k == 1, "p1"), F.when(k < 3, F.concat(F.lit("p"), k.cast("string"))).otherwise(""))
    return c.table(spark, d, "customer").select("c_custkey", labels.first_filled(refs).alias("pmid"))


@query("SELECT accession, effective FROM grouped", c.FEATURES_SQL)
def fn_effective_isolate(spark, d):
    return c.features(spark, d).select("accession", labels.effective_isolate(F.col("source_isolate"), F.col("structured_comment")).alias("effective"))


@query("SELECT c_custkey, CAST(c_custkey % 8 + 1 AS VARCHAR) AS gt, c_custkey AS total FROM customer")
def fn_total_from_label(spark, d):
    said = F.concat(F.lit("GT"), (F.pmod("c_custkey", F.lit(8)) + 1).cast("string"), F.lit("_a ("), _text("c_custkey"), F.lit(", 1-9)"))
    return c.table(spark, d, "customer").select("c_custkey", labels.label_genotype(said).alias("gt"), labels.label_total(said).alias("total"))


@query("SELECT accession, substr(nt, 1, 6) AS first, substr(nt, 7) AS rest FROM cohort", c.COHORT_SQL)
def al_split_ntd(spark, d):
    one, two = sequences.split_terminal(F.col("nt"), codons_first=2)
    return c.cohort(spark, d).select("accession", one.alias("first"), two.alias("rest"))


@query("SELECT accession, substr(nt, lo + 1, greatest(hi - lo, 0)) AS part FROM (SELECT accession, nt, CAST(greatest(0, start % 3 + 3 - 2) AS INTEGER) AS lo, CAST(least(length(nt), start % 3 + 9 + 2) AS INTEGER) AS hi FROM cohort)", c.COHORT_SQL)
def al_flank_slice(spark, d):
    return c.cohort(spark, d).select("accession", sequences.flank_slice(F.col("nt"), F.pmod("start", F.lit(3)), F.lit(2), F.lit(3), flank=2).alias("part"))


@query("SELECT gt, pos, aa, round(pct, 9) AS pct FROM profile WHERE pct >= 10 AND aa <> '*'", c.COHORT_SQL)
def flt_freq10(spark, d):
    return profiles.frequent_mutations(_profile(spark, d), ["gt"]).withColumn("pct", F.round("pct", 9))


@query("SELECT * FROM (SELECT n_regionkey AS a, max(d) FILTER (b = 1) AS \"1\", max(d) FILTER (b = 2) AS \"2\" FROM (SELECT x.r_regionkey AS n_regionkey, y.r_regionkey AS b, (y.r_regionkey - x.r_regionkey) / 10.0::DOUBLE AS d FROM region x JOIN region y ON x.r_regionkey < y.r_regionkey AND y.r_regionkey <= 2) GROUP BY 1)")
def srt_matrix_upper(spark, d):
    one = c.table(spark, d, "region").filter("r_regionkey <= 2")
    pairs = one.select(F.col("r_regionkey").alias("a")).join(one.select(F.col("r_regionkey").alias("b")), F.col("a") < F.col("b")).withColumn("distance", (F.col("b") - F.col("a")) / F.lit(10.0))
    return distance.matrix(pairs, [0, 1, 2], upper=True)
