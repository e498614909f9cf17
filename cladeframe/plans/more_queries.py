"""Queries of readers, writers, flags, marks and orders; registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe import genes, workdir
from cladeframe.functions import labels, sequences
from cladeframe.operators import grouping, selection
from cladeframe.plans import cohort as c
from cladeframe.plans.queries import query
from cladeframe.sources import files

# Readers and writers: what is written is read again


@query("SELECT CAST(gt AS VARCHAR) AS ref_id, accession, seq FROM cohort", c.COHORT_SQL)
def src_fasta(spark, d):
    path = workdir.new_path(spark, "fasta")
    rows = c.cohort(spark, d).select(F.concat_ws(" ", "accession", "gt", "subtype").alias("header"), "seq")
    files.write_fasta(rows, path, width=3)
    return files.read_fasta(spark, path).select(F.split("header", " ")[1].alias("ref_id"), "accession", "seq")


@query("SELECT accession, 1 AS n_files FROM cohort", c.COHORT_SQL)
def src_fasta_ids(spark, d):
    path = workdir.new_path(spark, "fasta")
    files.write_fasta(c.cohort(spark, d).select(F.col("accession").alias("header"), "seq"), path)
    return files.accession_files(files.read_fasta(spark, path, raw=True)).select("accession", F.size("files").alias("n_files"))


@query("SELECT 'Customer, \"' || c_custkey || '\"' AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer")
def src_csv(spark, d):
    path = workdir.new_path(spark, "csv")
    rows = c.table(spark, d, "customer").select(F.concat(F.lit(' Customer, "'), F.col("c_custkey").cast("string"), F.lit('" ')).alias("name"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    files.write_table(rows, path)
    return files.read_table(spark, path, ["name", "nation"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def snk_partitioned_csv(spark, d):
    path = workdir.new_path(spark, "csv")
    files.write_table(c.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, by=["c_mktsegment"])
    return spark.read.csv(path, header=True).select("c_custkey", "c_mktsegment")


@query("SELECT 'C' || c_custkey AS accession, 'C' || c_custkey || '.1' AS version, c_name || ' gene' AS definition, c_mktsegment AS isolate, 'nation ' || c_nationkey AS note, CASE c_custkey % 3 WHEN 0 THEN 'ACGT' WHEN 1 THEN 'GGTTAA' ELSE 'CC' END AS sequence, CAST(2 AS INTEGER) AS n_references FROM customer")
def src_genbank_parse(spark, d):
    path = workdir.new_path(spark, "genbank")
    key = F.col("c_custkey").cast("string")
    bases = F.when(F.pmod("c_custkey", F.lit(3)) == 0, "1 acgt").when(F.pmod("c_custkey", F.lit(3)) == 1, "1 ggt taa").otherwise("1 cc")
    text = F.concat(
        F.lit("LOCUS       C"), key, F.lit("\nDEFINITION  "), F.col("c_name"), F.lit("\n            gene\nACCESSION   C"), key, F.lit("\nVERSION     C"), key, F.lit(".1\nREFERENCE   1\n  AUTHORS   A,B.\nREFERENCE   2\n  TITLE     T\nFEATURES             Location/Qualifiers\n     source          1..4\n                     /isolate=\""),
        F.col("c_mktsegment"), F.lit("\"\n                     /note=\"nation "), F.col("c_nationkey").cast("string"), F.lit("\"\nORIGIN\n        "), bases, F.lit("\n//"),
    )
    c.table(spark, d, "customer").select(text.alias("value")).write.text(path)
    rows = files.parsed_genbank(files.read_genbank(spark, path))
    one = lambda k: F.element_at("qualifiers", F.lit(k))[0]
    return rows.select("accession", "version", "definition", one("isolate").alias("isolate"), one("note").alias("note"), "sequence", F.size("references").alias("n_references"))


# Flags and predicates


@query("SELECT accession FROM features WHERE NOT starts_with(lower(event_type), 'err')", c.FEATURES_SQL)
def flt_unassigned(spark, d):
    return c.features(spark, d).filter(~F.lower("event_type").startswith("err")).select("accession")


@query("SELECT accession FROM cohort WHERE substr(seq, 3 - start + 1, 1) IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y') AND length(seq) >= 3 - start + 1 AND length(seq) >= 4 - start + 1 AND substr(seq, 4 - start + 1, 1) IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y')", c.COHORT_SQL)
def flt_full_ras(spark, d):
    found = [F.coalesce(sequences.residue_at(F.col("seq"), F.col("start"), F.lit(p)).isin(*genes.VALID_AA), F.lit(False)) for p in (3, 4)]
    return c.cohort(spark, d).filter(F.forall(F.array(*found), lambda x: x)).select("accession")


@query("SELECT accession FROM cohort WHERE seq <> '' AND start IS NOT NULL", c.COHORT_SQL)
def flt_nonempty_profile(spark, d):
    return c.cohort(spark, d).filter("seq is not null and seq <> '' and start is not null").select("accession")


@query("SELECT event_id FROM events WHERE value < 8.0 AND lower(event_type) IN ('view', 'click')")
def flt_gene_present(spark, d):
    return c.table(spark, d, "events").filter((F.col("value") < 8.0) & F.lower(F.trim("event_type")).isin("view", "click")).select("event_id")


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'lang=en') OR contains(lower(url), '/en/')")
def flt_header_gene(spark, d):
    return c.table(spark, d, "pages").filter(labels.contains_ci(F.col("url"), F.lit("LANG=en")) | labels.contains_ci(F.col("url"), F.lit("/EN/"))).select("page_id")


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'yes' ELSE '' END AS \"F\", CASE WHEN bool_or(o_orderstatus = 'O') THEN 'yes' ELSE '' END AS \"O\" FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus IN ('F', 'O'))")
def prj_flag_columns(spark, d):
    found = c.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    flag = lambda k: F.when(F.array_contains("s", k), "yes").otherwise("").alias(k)
    return found.filter(F.arrays_overlap("s", F.array(F.lit("F"), F.lit("O")))).select("o_custkey", flag("F"), flag("O"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity >= 40 AND l_discount < 0.05 THEN 'accept' WHEN l_quantity >= 20 THEN 'refine' ELSE 'manual_review' END AS status FROM lineitem")
def prj_status(spark, d):
    status = F.when((F.col("l_quantity") >= 40) & (F.col("l_discount") < 0.05), "accept").when(F.col("l_quantity") >= 20, "refine").otherwise("manual_review")
    return c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"))


@query("SELECT count(*) FILTER (l_quantity >= 40) AS accept, count(*) FILTER (l_quantity < 40) AS refine FROM lineitem")
def agg_status_counts(spark, d):
    return c.table(spark, d, "lineitem").agg(F.count_if(F.col("l_quantity") >= 40).alias("accept"), F.count_if(F.col("l_quantity") < 40).alias("refine"))


@query("SELECT source_type AS event_type, list_sort(list(DISTINCT k)) AS ks FROM (SELECT event_type AS source_type, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS k FROM events) GROUP BY 1".replace("list_sort(list(DISTINCT k)) AS ks", "array_to_string(list_sort(list(DISTINCT k)), ' | ') AS ks"))
def fn_flatten(spark, d):
    k = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(7))
    rows = c.table(spark, d, "events").groupBy("event_type").agg(F.array_sort(F.collect_set(k)).cast("array<string>").alias("ks"))
    return rows.select("event_type", labels.flatten(F.col("ks")).alias("ks"))


# Joins and marks


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_orderpriority = '1-URGENT'")
def jn_acc_semi(spark, d):
    ruled = c.table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("ruled"))
    return c.table(spark, d, "orders").join(ruled, "o_custkey", "left").filter(F.col("ruled").isNull() | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def jn_acc_list(spark, d):
    listed = c.table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return c.table(spark, d, "part").join(listed, "p_partkey", "left_semi").select("p_partkey")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_label' WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_seq_match(spark, d):
    known = c.table(spark, d, "labels").select("doc_id", "toxic")
    rows = c.table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("toxic").isNull(), "no_label").when(F.col("toxic") == 1, "toxic").otherwise("").alias("reason"))


@query("SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn_edge_check(spark, d):
    rows = c.table(spark, d, "supplier").join(c.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(c.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return selection.present_or_fail(rows, "r_name", "reference").select("s_name", "n_name", "r_name")


@query("SELECT n.n_name, r.r_name, c.n AS customers FROM nation n JOIN region r ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey".replace("c.n AS customers", "coalesce(c.n, 0) AS customers"))
def jn_gt_subtype(spark, d):
    counted = c.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = c.table(spark, d, "nation").join(c.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(counted, "n_nationkey", "left")
    return rows.select("n_name", "r_name", F.coalesce("n", F.lit(0)).alias("customers"))


@query("SELECT accession, regexp_replace(source_clone, '_c[0-9]+$', '') || '' AS person FROM features WHERE source_clone <> ''".replace("'_c[0-9]+$'", "'(?i)^(.+?)[-_ ](cl|qs|clone)[-_ ]?[a-z0-9]+$'").replace(", '') ||", ", '\\1') ||"), c.FEATURES_SQL)
def fn_strip_clone_suffix(spark, d):
    return c.features(spark, d).filter("source_clone <> ''").select("accession", labels.without_clone_suffix(F.col("source_clone")).alias("person"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS prefix, regexp_extract(CAST(c_custkey AS VARCHAR) || '_x', '^(\\d+)', 1) AS digits FROM customer")
def fn_refid_from_name(spark, d):
    name = F.concat(F.col("c_custkey").cast("string"), F.lit("_x"))
    return c.table(spark, d, "customer").select("c_custkey", labels.ref_id(F.regexp_replace("c_name", "#", "_")).alias("prefix"), labels.ref_id(name, "digits").alias("digits"))


# Orders: a rank column makes the order part of the rows


@query("SELECT gt, subtype, row_number() OVER (ORDER BY coalesce(TRY_CAST(subtype AS INTEGER), 999), gt) AS rank FROM (SELECT DISTINCT gt, subtype FROM cohort)", c.COHORT_SQL)
def srt_gt_subtype(spark, d):
    from pyspark.sql import Window

    groups = c.cohort(spark, d).select("gt", "subtype").distinct()  # a row a group
    key = F.coalesce(F.col("subtype").try_cast("int"), F.lit(999))
    return groups.withColumn("rank", F.row_number().over(Window.orderBy(key, "gt")).cast("long"))


@query("SELECT gt, subtype, pos, aa, n FROM (SELECT gt, '' AS subtype, pos, aa, n FROM counts UNION ALL SELECT gt, subtype, pos, aa, count(*) FROM residues WHERE aa <> 'X' GROUP BY ALL)", c.COHORT_SQL)
def srt_multi(spark, d):
    from cladeframe.operators import profiles

    rows = c.cohort(spark, d)
    whole = profiles.position_counts(rows, ["gt"]).select("gt", F.lit("").alias("subtype"), "pos", "aa", "n")
    parts = profiles.position_counts(rows, ["gt", "subtype"]).select("gt", "subtype", "pos", "aa", "n")
    return whole.unionByName(parts).orderBy("gt", "subtype", "pos", F.desc("n"), "aa")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS accession_count, min('EV' || event_id) AS first FROM events GROUP BY event_type")
def rp_collect_genbank(spark, d):
    rows = c.features(spark, d)
    return grouping.primary_flag(rows, "event_type", ["accession"]).groupBy("event_type").agg(F.count("*").alias("accession_count"), F.min(F.when(F.col("primary") == "yes", F.col("accession"))).alias("first"))
