"""Summaries of metadata rows by clone, isolate and person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions import labels


def joined_set(c: Column) -> Column:
    """Sorted distinct non-blank values as one text."""
    return F.array_join(F.array_sort(F.collect_set(labels.or_null(c))), " | ")


def group_keys(rows: DataFrame, clone: str = "source_clone", isolate: str = "source_isolate", comment: str = "structured_comment", accession: str = "accession") -> DataFrame:
    """``mode`` and ``group_key``: by clone prefix, else by isolate without its time point, else the row by itself."""
    own = labels.isolate_key(labels.effective_isolate(F.col(isolate), F.col(comment)))
    has_clone = labels.blank_to_empty(F.col(clone)) != ""
    key = F.when(has_clone, labels.clone_key(labels.blank_to_empty(F.col(clone)))).when(own != "", own).otherwise(F.concat(F.lit("__ungrouped__"), labels.blank_to_empty(F.col(accession))))
    return rows.withColumn("mode", F.when(has_clone, "source_clone_prefix").otherwise("source_isolate_multiple_timepoints")).withColumn("group_key", key)


def summaries(rows: DataFrame, ref_id: str, lists: list[str], accession: str = "accession", positions: str | None = None) -> DataFrame:
    """A row a group: distinct values as text, and the accession that covers most positions."""
    aggs = [F.count("*").alias("row_count"), *(joined_set(F.col(c)).alias(f"{c}_values") for c in lists)]
    if positions:
        aggs.append(F.max_by(accession, F.struct(F.size(positions), F.col(positions), F.col(accession))).alias("selected"))
        aggs.append(F.max(F.size(positions)).alias("covered"))
    out = rows.groupBy(ref_id, "mode", "group_key").agg(*aggs)
    return out.withColumn("mode", F.when(F.col("row_count") == 1, "").otherwise(F.col("mode")))


def by_genotype(records: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``genotype`` and ``name``: a label's parts before and after its first ``_``; labels without one are dropped."""
    own = F.col(label)
    return records.filter(F.contains(own, F.lit("_"))).withColumn("genotype", F.substring_index(own, "_", 1)).withColumn("name", F.regexp_replace(own, "(?s)^[^_]*_", ""))


def covered_groups(groups: DataFrame, ref_id: str) -> DataFrame:
    return groups.groupBy(ref_id).agg(F.count_if(F.col("covered") > 0).alias("groups_with_coverage"), F.count("*").alias("groups"))


def person_field(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """(field, score, distinct_ids, repeated): the candidate column that most looks like a person's id comes first."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), labels.or_null(F.col(c)).alias("v")) for c in candidates))).alias("x")).select("x.*").filter("v is not null")
    ids = long.withColumn("id", labels.without_clone_suffix(F.col("v"))).groupBy("field", "id").agg(F.count("*").alias("n"))
    named = F.when(F.lower("field").rlike("patient|person|subject|individual|donor"), 5).otherwise(1)
    out = ids.groupBy("field").agg(F.count_if(F.col("id") != "").alias("distinct_ids"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.select("field", (named * 100 + F.col("distinct_ids") + F.col("repeated") * 10).alias("score"), "distinct_ids", "repeated").orderBy(F.desc("score"), F.desc("field"))


def persons(rows: DataFrame, field: str, accession: str, clone: Column) -> DataFrame:
    """A row a person: accessions, and whether some row of several is a likely clone."""
    own = rows.withColumn("person_id", labels.without_clone_suffix(labels.blank_to_empty(F.col(field)))).filter("person_id <> ''").withColumn("__clone", clone)
    out = own.groupBy("person_id").agg(F.count("*").alias("accession_count"), F.array_join(F.array_sort(F.collect_list(accession)), " | ").alias("accessions"), F.bool_or("__clone").alias("c"))
    return out.withColumn("likely_clones", F.when(F.col("c") & (F.col("accession_count") > 1), "yes").otherwise("no")).drop("c")


def primary_flag(rows: DataFrame, accession: str, order: list[str]) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(accession).orderBy(*order)) == 1
    return rows.withColumn("primary", F.when(first, "yes").otherwise("no"))


def file_index(rows: DataFrame, path: str, accession: str) -> DataFrame:
    return rows.groupBy(path).agg(F.count_distinct(accession).alias("n"), F.array_join(F.array_sort(F.collect_set(accession)), ";").alias("accessions"))


def qualifier_columns(rows: DataFrame, qualifiers: str, preferred: list[str], limit: int = 10_000) -> DataFrame:
    """A map of lists as ``source_<key>`` columns: preferred keys first, then the others sorted.

    Distinct keys become a header and so reach the driver; there may be ``limit`` of them.
    """
    found = [r["k"] for r in rows.select(F.explode(F.map_keys(qualifiers)).alias("k")).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} qualifier keys")
    keys = [k for k in preferred if k in found] + sorted(set(found) - set(preferred))
    return rows.select(*(c for c in rows.columns if c != qualifiers), *(labels.flatten(F.element_at(qualifiers, F.lit(k))).alias(f"source_{k}") for k in keys))
