"""Study rules, blocked studies and end signatures as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import sized
from cladeframe.sources import files

# Metadata rules by gene (study, field, operator, value).
RULES = {
    "NS3": (
        ("30", "source_isolate", "contains", "Day1"),
        ("85", "Accession", "in_accession_list", "85.csv"),
        ("142", "source_isolate", "contains", "baseline"),
        ("192", "source_isolate", "contains", "day 1"),
        ("346", "source_isolate", "contains", "baseline/D0"),
        ("499", "source_isolate", "contains", "HCC"),
        ("600", "source_isolate", "not_contains", "failure"),
        ("661", "source_isolation_source", "equals", "plasma"),
        ("884", "source_isolate", "contains", "Pre-TH"),
        ("943", "source_isolate", "contains", "Day 1"),
        ("1356", "source_isolate", "not_contains", "IC"),
        ("2008", "source_isolate", "not_contains", "chimpanzee"),
        ("2110", "source_isolate", "contains", "T0"),
        ("2116", "source_collection_date", "year_before", "2011"),
        ("2138", "source_isolate", "contains", "Week 0"),
        ("2150", "source_isolate", "contains", "b"),
        ("2168", "source_isolate", "contains", "pre"),
        ("2178", "source_isolation_source", "equals", "plasma"),
        ("2227", "Accession", "in_accession_list", "2227_Nguyen_(2015)_w_metadata_filtered.csv"),
    ),
    "NS5A": (
        ("17", "Accession", "in_accession_list", "17.csv"),
        ("29", "source_isolate", "contains", "SCRN"),
        ("50", "source_isolate", "contains", "week 0"),
        ("85", "Accession", "in_accession_list", "85.csv"),
        ("123", "source_isolate", "not_contains", "TF"),
        ("142", "source_isolate", "contains", "baseline"),
        ("165", "Accession", "in_accession_list", "165.csv"),
        ("192", "source_isolate", "contains", "day1"),
        ("288", "source_isolate", "contains", "pre"),
        ("346", "source_isolate", "contains", "baseline/D0"),
        ("535", "Accession", "in_accession_list", "535.csv"),
        ("600", "source_isolate", "not_contains", "failure"),
        ("661", "source_isolation_source", "equals", "plasma"),
    ),
    "NS5B": (
        ("17", "Accession", "in_accession_list", "17.csv"),
        ("30", "source_isolate", "contains", "day1"),
        ("192", "source_isolate", "contains", "day1"),
        ("346", "source_isolate", "contains", "baseline"),
        ("891", "source_isolate", "matches_regex", "Ha(0[1-9]|[1-8][0-9]|9[0-7])"),
        ("943", "source_isolate", "contains", "day 1"),
        ("1051", "source_isolate", "matches_regex", "([1-9]|[1-4][0-9]|5[01])a"),
    ),
}

# Studies of quasispecies, which are never selected.
BLOCKED = ("19", "31", "32", "34", "70", "81", "115", "262", "1044", "2043", "2071", "2129", "2139", "2175", "2195", "2212", "2216", "2225", "2324")

# Genotype, gene, first and last three residues.
SIGNATURES = (
    ("1", "NS3", "API", "VVT"),
    ("2", "NS3", "API", "VMT"),
    ("3", "NS3", "API", "VTT"),
    ("4", "NS3", "API", "VVT"),
    ("5", "NS3", "API", "VIT"),
    ("6", "NS3", "API", "VIT"),
    ("7", "NS3", "API", "VTT"),
    ("8", "NS3", "SPI", "VVT"),
    ("1", "NS5A_NTD", "SGS", "AEA"),
    ("2", "NS5A_NTD", "GGS", "AET"),
    ("3", "NS5A_NTD", "SDD", "AET"),
    ("4", "NS5A_NTD", "AES", "AES"),
    ("5", "NS5A_NTD", "DGT", "AET"),
    ("6", "NS5A_NTD", "ASS", "AET"),
    ("7", "NS5A_NTD", "AGS", "AET"),
    ("8", "NS5A_NTD", "GNS", "AES"),
    ("1", "NS5B", "SMS", "PNR"),
    ("2", "NS5B", "SMS", "PAR"),
    ("3", "NS5B", "SMS", "PAR"),
    ("4", "NS5B", "SMS", "PAR"),
    ("5", "NS5B", "SMS", "PAR"),
    ("6", "NS5B", "SMS", "PAR"),
    ("7", "NS5B", "SMS", "PAR"),
    ("8", "NS5B", "SMS", "PNR"),
)


def rules(spark: SparkSession, gene: str) -> DataFrame:
    """(ref_id, field, op, value); regular expressions are tokens that no letter or digit adjoins."""
    return spark.createDataFrame(list(RULES[gene]), "ref_id string, field string, op string, value string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, field, op, value) of a rule table (RefID, Field, Operator, Value); rows without a study or field are passed over."""
    known = files.read_table(spark, path, ["RefID", "Field", "Operator", "Value"])
    return known.select(F.col("RefID").alias("ref_id"), F.col("Field").alias("field"), F.lower("Operator").alias("op"), F.col("Value").alias("value")).filter("ref_id <> '' and field <> ''")


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SIGNATURES), "gt string, gene string, begin string, end string")


def signature_matches(seq: Column, begin: Column, end: Column) -> Column:
    """struct(matches, mismatches) of a sequence's ends with its genotype's."""
    n = (F.substring(seq, 1, 3) == begin).cast("int") + (F.right(seq, F.lit(3)) == end).cast("int")
    return F.struct(n.alias("matches"), (F.lit(2) - n).alias("mismatches"))


def summary(filter_rows: DataFrame, gene_rules: DataFrame, present: DataFrame, ref_id: str = "ref_id") -> DataFrame:
    """Studies to be checked, with their rules as text and whether they are selected now."""
    text = gene_rules.groupBy(F.col("ref_id").alias("__r")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "field", "op", "value"))), "; ").alias("filter_text"))
    known = present.select(F.col(ref_id).alias("__p")).distinct()
    out = filter_rows.join(sized.small(text), filter_rows[ref_id] == F.col("__r"), "left").join(known, filter_rows[ref_id] == F.col("__p"), "left")
    return out.withColumn("included", F.when(F.col("__p").isNotNull(), "Present").otherwise("Absent")).withColumn("filter_text", F.coalesce("filter_text", F.lit(""))).drop("__r", "__p")
