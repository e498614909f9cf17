"""Cohorts in the shape of profile inputs, built from the tables at hand.

``orders`` with their ``lineitem`` rows stand for sequences: an order is an accession,
its status a genotype, its priority a subtype, and its lines, in order, residues and
codons. ``lineitem`` rows stand for alignment hits, ``events`` for source features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESIDUES = "ACDEFGHIKLMNPQRSTVWYX*-B"
BASES = "ACGTN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, gt, subtype, start, seq, nt."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pick = lambda letters, k: F.substring(F.lit(letters), (F.pmod(k, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    aa = pick(RESIDUES, F.col("l_partkey") * F.col("l_partkey") + F.col("l_suppkey"))
    nt = F.concat(pick(BASES[:4], F.col("l_partkey")), pick(BASES[:4], F.col("l_suppkey")), pick(BASES, F.col("l_partkey") + F.col("l_suppkey")))
    own = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", aa.alias("aa"), nt.alias("nt"))))
    seqs = lines.groupBy("l_orderkey").agg(own.alias("x"))
    seqs = seqs.select("l_orderkey", F.array_join(F.transform("x", lambda v: v["aa"]), "").alias("seq"), F.array_join(F.transform("x", lambda v: v["nt"]), "").alias("nt"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    joined = orders.join(seqs, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.concat(F.lit("AC"), F.col("o_orderkey").cast("string"), F.lit(".1")).alias("accession"), F.col("o_orderstatus").alias("gt"), F.substring("o_orderpriority", 1, 1).alias("subtype"), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int").alias("start"), "seq", "nt")


COHORT_SQL = f"""
lines AS (
  SELECT l_orderkey, string_agg(substr('{RESIDUES}', CAST((l_partkey * l_partkey + l_suppkey) % {len(RESIDUES)} + 1 AS INTEGER), 1), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq,
    string_agg(substr('{BASES[:4]}', CAST(l_partkey % 4 + 1 AS INTEGER), 1) || substr('{BASES[:4]}', CAST(l_suppkey % 4 + 1 AS INTEGER), 1) || substr('{BASES}', CAST((l_partkey + l_suppkey) % 5 + 1 AS INTEGER), 1), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS nt
  FROM lineitem GROUP BY l_orderkey
), cohort AS (
  SELECT 'AC' || o_orderkey || '.1' AS accession, o_orderstatus AS gt, left(o_orderpriority, 1) AS subtype, CAST(o_orderkey % 3 + 1 AS INTEGER) AS start, seq, nt
  FROM orders JOIN lines ON l_orderkey = o_orderkey
), residues AS (
  SELECT accession, gt, subtype, CAST(start + k - 1 AS INTEGER) AS pos, substr(seq, CAST(k AS INTEGER), 1) AS aa
  FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS k FROM cohort)
), counts AS (
  SELECT gt, pos, aa, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY gt, pos) AS BIGINT) AS denom FROM residues WHERE aa <> 'X' GROUP BY gt, pos, aa
), profile AS (
  SELECT gt, pos, aa, n, denom, 100.0::DOUBLE * n / denom AS pct FROM counts WHERE aa IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y','*')
)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, target (1 to 8), length, mismatch, gaps, bitscore, sstart, send, ordinal."""
    lines = table(spark, sf_dir, "lineitem")
    length = F.pmod("l_partkey", F.lit(400)) + 60
    start = F.pmod("l_partkey", F.lit(500)) + 1
    return lines.select(
        F.col("l_orderkey").alias("query"), (F.pmod("l_suppkey", F.lit(8)) + 1).cast("int").alias("target"), length.alias("length"), F.col("l_quantity").cast("long").alias("mismatch"), F.col("l_linenumber").cast("long").alias("gaps"),
        F.col("l_extendedprice").alias("bitscore"), start.alias("sstart"), (start + length - 1).alias("send"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("ordinal"),
    )


HITS_SQL = """
hits AS (
  SELECT l_orderkey AS query, CAST(l_suppkey % 8 + 1 AS INTEGER) AS target, l_partkey % 400 + 60 AS length, CAST(l_quantity AS BIGINT) AS mismatch, CAST(l_linenumber AS BIGINT) AS gaps, l_extendedprice AS bitscore,
    l_partkey % 500 + 1 AS sstart, l_partkey % 500 + l_partkey % 400 + 60 AS send, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS ordinal,
    (CAST(l_quantity AS BIGINT) + l_linenumber) / (l_partkey % 400 + 60)::DOUBLE AS distance
  FROM lineitem
), per_target AS (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, target ORDER BY distance, length DESC, bitscore DESC, ordinal) = 1
)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, accession, source_clone, source_isolate, structured_comment, source_date, positions."""
    e = table(spark, sf_dir, "events")
    clone = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("P"), F.pmod("event_id", F.lit(7)).cast("string"), F.lit("_"), "event_type", F.lit("_c"), F.pmod("event_id", F.lit(5)).cast("string"))).otherwise("")
    isolate = F.when(F.pmod("event_id", F.lit(4)) != 1, F.concat("event_type", F.lit("-"), F.pmod("event_id", F.lit(11)).cast("string"), F.lit(" Week "), F.pmod("event_id", F.lit(9)).cast("string"))).otherwise("")
    comment = F.when(F.pmod("event_id", F.lit(10)) == 0, F.concat(F.lit("Study :: x\nPatient Code :: "), "event_type", F.lit(" \nEnd :: y"))).otherwise("")
    positions = F.filter(F.array(*(F.when(F.pmod(F.col("event_id"), F.lit(p)) == 0, F.lit(p)) for p in (24, 28, 30, 31))), lambda x: x.isNotNull())
    return e.select(F.col("user_id").cast("string").alias("ref_id"), F.concat(F.lit("EV"), F.col("event_id").cast("string")).alias("accession"), "event_type", "value", clone.alias("source_clone"), isolate.alias("source_isolate"), comment.alias("structured_comment"), F.date_format("ts", "dd-MMM-yyyy").alias("source_date"), positions.alias("positions"))


FEATURES_SQL = """
features AS (
  SELECT CAST(user_id AS VARCHAR) AS ref_id, 'EV' || event_id AS accession, event_type, value,
    CASE WHEN event_id % 3 = 0 THEN 'P' || event_id % 7 || '_' || event_type || '_c' || event_id % 5 ELSE '' END AS source_clone,
    CASE WHEN event_id % 4 <> 1 THEN event_type || '-' || event_id % 11 || ' Week ' || event_id % 9 ELSE '' END AS source_isolate,
    CASE WHEN event_id % 10 = 0 THEN event_type ELSE '' END AS patient_code, strftime(ts, '%d-%b-%Y') AS source_date,
    list_filter([24, 28, 30, 31], lambda p: event_id % p = 0) AS positions
  FROM events
), grouped AS (
  SELECT *, CASE WHEN source_clone <> '' THEN 'source_clone_prefix' ELSE 'source_isolate_multiple_timepoints' END AS mode,
    CASE WHEN patient_code <> '' AND contains(source_isolate, patient_code) THEN patient_code ELSE source_isolate END AS effective
  FROM features
), keyed AS (
  SELECT *, CASE WHEN source_clone <> '' THEN regexp_replace(source_clone, '_[^_]*$', '') WHEN effective <> '' THEN trim(regexp_replace(effective, '(?i)\\b(week|day)\\b.*$', ''), ' _-') ELSE '__ungrouped__' || accession END AS group_key FROM grouped
)"""
