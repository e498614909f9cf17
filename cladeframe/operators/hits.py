"""Choices among alignment hits: (query, target, length, mismatch, gaps, bitscore, ..., ordinal).

Every choice ends with an explicit last key, so ties fall as the first row in file
order. ``row_number() = 1`` is planned as a partial and a final group limit: each task
sends one row a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators import sized


def with_distance(hits: DataFrame) -> DataFrame:
    """(mismatch + gaps) / length; null for length 0."""
    return hits.withColumn("distance", F.when(F.col("length") > 0, (F.col("mismatch") + F.col("gaps")) / F.col("length")))


def best(hits: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def by_distance() -> list[Column]:
    return [F.col("distance").asc_nulls_last(), F.col("length").desc(), F.col("bitscore").desc(), F.col("ordinal").asc()]


def by_bitscore() -> list[Column]:
    return [F.col("bitscore").desc(), F.col("length").desc(), F.col("ordinal").asc()]


def best_per_target(hits: DataFrame, query: str, target: str) -> DataFrame:
    return best(hits, [query, target], by_distance()).drop("rank")


def best_target(hits: DataFrame, query: str, target: str, least_length: int = 0) -> DataFrame:
    """One hit a query, of each target's best; equal ones go to the lowest target."""
    own = best_per_target(hits.filter(F.col("length") >= least_length), query, target)
    return best(own, [query], [*by_distance()[:3], F.col(target).asc()]).drop("rank")


def best_two_targets(hits: DataFrame, query: str, target: str) -> DataFrame:
    """(query, best, best_distance, second, second_distance): the second is another target."""
    two = best(best_per_target(hits, query, target), [query], [*by_distance()[:3], F.col(target).asc()], 2)
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return two.groupBy(query).agg(pick(1, target).alias("best"), pick(1, "distance").alias("best_distance"), pick(2, target).alias("second"), pick(2, "distance").alias("second_distance"))


def best_protein(hits: DataFrame, query: str, least_length: int) -> DataFrame:
    order = [F.col("bitscore").desc(), F.col("length").desc(), (F.col("mismatch") + F.col("gaps")).asc(), F.col("ordinal").asc()]
    return best(hits.filter(F.col("length") >= least_length), [query], order).drop("rank")


def wide_distances(hits: DataFrame, query: str, target: str, targets: Sequence) -> DataFrame:
    """A row a query with GT<target>_Distance and GT<target>_AlignedNT.

    Hits are counted and dealt by query, at most about ``sized.TASK_ROWS`` a task; choice and
    row of a query are made where they are, so a task's sort doesn't grow with the table.
    """
    own = best_per_target(sized.by_key(hits, query), query, target)
    pick = lambda t, c: F.max(F.when(F.col(target) == t, F.col(c)))
    return own.groupBy(query).agg(*(pick(t, c).alias(f"GT{t}_{n}") for t in targets for c, n in (("distance", "Distance"), ("length", "AlignedNT"))))


def covered_positions(start: Column, end: Column, positions: Sequence[int]) -> Column:
    """Residue positions whose codon the aligned bases touch."""
    return F.filter(F.array(*(F.lit(p) for p in positions)), lambda p: (start <= p * 3) & (end >= (p - 1) * 3 + 1))


def lexicographic(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of candidate translations: fewer stops, higher score, more signature matches, fewer mismatches, more informative columns, fewer ignored; then the first."""
    key = F.struct("stops", (-F.col("score")).alias("s"), (-F.col("matches")).alias("m"), "mismatches", (-F.col("informative")).alias("i"), "ignored", "ordinal")
    return rows.groupBy(*by).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in by)), key).alias("c")).select(*by, "c.*")


def gene_sets(searches: list[DataFrame], subject: str = "sseqid", accession: str = "accession", limit: float = 1e-8, known: Sequence[str] = ("NS3", "NS5A", "NS5B")) -> DataFrame:
    """(accession, genes) that any search found."""
    rows = searches[0].select(accession, subject, "evalue")
    for s in searches[1:]:
        rows = rows.unionByName(s.select(accession, subject, "evalue"))
    return rows.filter((F.col("evalue") <= limit) & F.col(subject).isin(*known)).groupBy(accession).agg(F.array_sort(F.collect_set(subject)).alias("genes"))
