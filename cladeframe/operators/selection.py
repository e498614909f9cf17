"""Study selection, rule filters, and joins between files, metadata and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.functions import labels
from cladeframe.operators import sized

RULES = ("contains", "not_contains", "equals", "year_before", "in_accession_list", "matches_regex")


def not_excluded(cell: Column, word: str = "exclude") -> Column:
    return F.lower(labels.blank_to_empty(cell)) != word


def positive(columns: list[str]) -> Column:
    """All columns hold numbers above 0."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(labels.number(F.col(c)), F.lit(0.0)) > 0)
    return out


def rule_holds(op: Column, cell: Column, value: Column, listed: Column) -> Column:
    low = F.lower(F.coalesce(cell, F.lit("")))
    token = F.regexp_like(F.coalesce(cell, F.lit("")), F.concat(F.lit("(?i)(?<![A-Za-z0-9])(?:"), value, F.lit(")(?![A-Za-z0-9])")))
    return F.coalesce(
        F.when(op == "contains", F.contains(low, F.lower(value)))
        .when(op == "not_contains", ~F.contains(low, F.lower(value)))
        .when(op == "equals", F.trim(low) == F.lower(value))
        .when(op == "year_before", labels.first_year(cell) < value.try_cast("int"))
        .when(op == "in_accession_list", listed)
        .when(op == "matches_regex", token),
        F.lit(False),
    )


def apply_rules(rows: DataFrame, rules: DataFrame, fields: list[str], lists: DataFrame | None = None, ref_id: str = "ref_id", accession: str = "accession") -> DataFrame:
    """Rows that meet every rule of their study; studies without rules are untouched.

    ``rules`` has (ref_id, field, op, value); ``lists`` has (list, accession).
    """
    known = F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string"))))
    own = rules.groupBy(F.col(ref_id).alias("__ref")).agg(F.collect_list(F.struct("field", "op", "value")).alias("__rules"))
    joined = rows.join(sized.small(own), rows[ref_id].cast("string") == F.col("__ref"), "left")
    if lists is not None:
        named = lists.groupBy(F.col("accession").alias("__acc")).agg(F.collect_set("list").alias("__lists"))
        joined = joined.join(named, joined[accession].cast("string") == F.col("__acc"), "left")
    else:
        joined = joined.withColumn("__lists", F.array().cast("array<string>"))
    listed = lambda r: F.coalesce(F.array_contains("__lists", r["value"]), F.lit(False))
    met = F.forall("__rules", lambda r: rule_holds(r["op"], F.element_at("__cells", r["field"]), r["value"], listed(r)))
    return joined.withColumn("__cells", known).filter(F.col("__rules").isNull() | met).select(*(rows[c] for c in rows.columns))


def first_per(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__k = 1").drop("__k")


def last_per(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return first_per(rows, by, [F.col(c).desc() for c in order])


def unique_or_fail(rows: DataFrame, by: list[str], what: str) -> DataFrame:
    """``rows``, which fail when read if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*by))
    message = F.concat(F.lit(f"{what} occurs more than once: "), F.concat_ws(", ", *by))
    return rows.withColumn("__n", n).filter(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)).drop("__n")


def present_or_fail(rows: DataFrame, column: str, what: str) -> DataFrame:
    return rows.filter(F.when(F.col(column).isNull(), F.raise_error(F.lit(f"no {what}")).cast("boolean")).otherwise(True))


def with_files(studies: DataFrame, files: DataFrame, mode: str = "all", ref_id: str = "ref_id", path: str = "path") -> DataFrame:
    """Studies with their files, whose names begin with the id: all, exactly one (else an error), or the first by path."""
    if mode == "one":
        files = unique_or_fail(files, [ref_id], "file of study")
    elif mode == "first":
        files = first_per(files, [ref_id], [F.col(path).asc()])
    return studies.join(files, ref_id)


def marked(rows: DataFrame, other: DataFrame, key: str, yes: str = "Present", no: str = "Absent", name: str = "mark") -> DataFrame:
    known = other.select(F.col(key).alias("__k")).distinct()
    return rows.join(known, rows[key] == F.col("__k"), "left").withColumn(name, F.when(F.col("__k").isNotNull(), yes).otherwise(no)).drop("__k")


def with_fallback(rows: DataFrame, calls: DataFrame, value: str, accession: str = "accession", order: str = "ordinal") -> DataFrame:
    """``value`` by exact accession, else by the accession without its version; of several calls the first."""
    exact = first_per(calls, [accession], [F.col(order)]).select(F.col(accession).alias("__a"), F.col(value).alias("__exact"))
    short = first_per(calls.withColumn("__b", labels.versionless(F.col(accession))), ["__b"], [F.col(order)]).select("__b", F.col(value).alias("__short"))
    out = rows.join(exact, rows[accession] == F.col("__a"), "left").join(short, labels.versionless(rows[accession]) == F.col("__b"), "left")
    return out.withColumn(value, F.coalesce("__exact", "__short")).drop("__a", "__b", "__exact", "__short")


def overridden(base: DataFrame, priority: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, source): priority values win; keys that only they have are added."""
    b = base.select(key, F.col(value).alias("__base"))
    p = priority.select(key, F.col(value).alias("__prio"))
    source = F.when(F.col("__prio").isNotNull(), "priority").otherwise("base")
    return b.join(p, key, "full_outer").select(key, F.coalesce("__prio", "__base").alias(value), source.alias("source"))


def assigned(rows: DataFrame, calls: DataFrame, key: str, value: str, alignment: str) -> DataFrame:
    """A non-blank call wins over the alignment's value; ``source`` says which it was."""
    c = calls.select(key, F.col(value).alias("__call"))
    call = labels.or_null(F.col("__call"))
    return rows.join(c, key, "left").withColumn("source", F.when(call.isNotNull(), "metadata").when(F.col(alignment).isNotNull(), "alignment").otherwise("")).withColumn(value, F.coalesce(call, F.col(alignment), F.lit(""))).drop("__call")


def three_way(rows: DataFrame, calls: DataFrame, key: str, value: str) -> DataFrame:
    """``status`` assigned, unassigned or missing, by external calls."""
    c = calls.select(key, F.col(value).alias("__v"))
    status = F.when(F.col("__v").isNull(), "missing").when(F.lower("__v").startswith("unassign"), "unassigned").otherwise("assigned")
    return rows.join(c, key, "left").withColumn("status", status).drop("__v")


def compared(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """(shared, same, different, percent) of two assignments."""
    both = one.select(key, F.col(value).alias("x")).join(two.select(key, F.col(value).alias("y")), key)
    same = F.count_if(F.col("x") == F.col("y"))
    return both.agg(F.count("*").alias("shared"), same.alias("same"), (F.count("*") - same).alias("different"), F.round(F.lit(100.0) * same / F.count("*"), 2).alias("percent"))
