"""Position profiles, consensus, entropy and resistance grids over positioned sequences.

Input rows have ``accession``, grouping columns, ``start`` (position of the first
residue) and ``seq``. Sequences are exploded to positions once, counted with map-side
combining, and everything later works on the small count table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe import genes
from cladeframe.functions import labels, sequences


def residues(rows: DataFrame, keep: list[str], positions: Sequence[int] | None = None, seq: str = "seq", start: str = "start") -> DataFrame:
    """(keep..., pos, aa): all positions, or only those wanted, which are looked up and never exploded."""
    if positions is None:
        out = rows.select(*keep, start, F.posexplode(sequences.chars(F.upper(seq))).alias("k", "aa"))
        return out.select(*keep, (F.col(start) + F.col("k")).cast("int").alias("pos"), "aa")
    wanted = F.array(*(F.lit(p) for p in positions))
    out = rows.select(*keep, start, seq, F.explode(wanted).alias("pos"))
    return out.select(*keep, "pos", sequences.residue_at(F.upper(seq), F.col(start), F.col("pos")).alias("aa")).filter("aa is not null")


def position_counts(rows: DataFrame, by: list[str], positions: Sequence[int] | None = None, seq: str = "seq", start: str = "start") -> DataFrame:
    """(by..., pos, aa, n, denom): X says nothing; gaps and stops count in the denominator."""
    counts = residues(rows, by, positions, seq, start).filter("aa <> 'X'").groupBy(*by, "pos", "aa").agg(F.count("*").alias("n"))
    return counts.withColumn("denom", F.sum("n").over(Window.partitionBy(*by, "pos")))


def profile(counts: DataFrame) -> DataFrame:
    """Counts with ``pct``; symbols beyond the twenty residues and the stop are left out after the denominators."""
    return counts.filter(F.col("aa").isin(*genes.AA_ORDER)).withColumn("pct", F.lit(100.0) * F.col("n") / F.col("denom"))


def aa_rank(aa: Column) -> Column:
    return F.instr(F.lit(genes.AA_ORDER), aa)


def sequences_at(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., total): the largest denominator."""
    return counts.groupBy(*by).agg(F.max("denom").alias("total"))


def coverage_range(counts: DataFrame, by: list[str], positions: Sequence[int]) -> DataFrame:
    """(by..., low, high, coverage) of denominators over positions; an uncovered position has 0."""
    every = counts.select(*by).distinct().withColumn("pos", F.explode(F.array(*(F.lit(p) for p in positions))))
    denoms = counts.select(*by, "pos", "denom").distinct()
    out = every.join(denoms, [*by, "pos"], "left").groupBy(*by).agg(F.min(F.coalesce("denom", F.lit(0))).alias("low"), F.max(F.coalesce("denom", F.lit(0))).alias("high"))
    return out.withColumn("coverage", F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high")))


def consensus(prof: DataFrame, by: list[str], length: int | None = None) -> DataFrame:
    """(by..., consensus): the most frequent residue of each covered position, the smaller of equals; uncovered positions are skipped."""
    inside = prof.filter(F.col("pos").between(1, length)) if length else prof
    best = inside.groupBy(*by, "pos").agg(F.min_by("aa", F.struct(-F.col("pct"), "aa")).alias("aa"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "aa"))), lambda x: x["aa"]), "")
    return best.groupBy(*by).agg(F.regexp_replace(joined, "-", "").alias("consensus"))


def entropy(counts: DataFrame, by: list[str], round_digits: int | None = 2) -> DataFrame:
    """(by..., pos, entropy) in bits over residues other than X and stops."""
    kept = counts.filter(~F.col("aa").isin("X", "*"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by, "pos"))
    bits = kept.withColumn("p", share).groupBy(*by, "pos").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"))
    value = F.when(F.abs("h") < 1e-12, 0.0).otherwise(F.col("h"))
    return bits.select(*by, "pos", (labels.round_significant(value, round_digits) if round_digits else value).alias("entropy"))


def variant_cells(prof: DataFrame, by: list[str], least: float = 1.0) -> DataFrame:
    """(by..., pos, cell): 'A80K20', the frequent residues by falling share, without X and stops."""
    kept = prof.filter((F.col("pct") >= least) & ~F.col("aa").isin("X", "*"))
    order = F.struct((-F.col("pct")).alias("o"), F.col("aa"), labels.format_percent(F.col("pct")).alias("t"))
    return kept.groupBy(*by, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat(x["aa"], x["t"])), "").alias("cell"))


def ras_grid(prof: DataFrame, counts: DataFrame, by: list[str], positions: Sequence[int], least: float = 1.0) -> DataFrame:
    """A row a group: its label with total and coverage, and a cell a position."""
    cells = variant_cells(prof.filter(F.col("pos").isin(*positions)), by, least)
    wide = cells.groupBy(*by).pivot("pos", list(positions)).agg(F.first("cell"))
    named = wide.select(*by, *(F.coalesce(F.col(f"`{p}`"), F.lit("")).alias(f"P{p}") for p in positions))
    head = coverage_range(counts.filter(F.col("pos").isin(*positions)), by, positions).join(sequences_at(counts.filter(F.col("pos").isin(*positions)), by), by)
    label = F.concat(F.lit("GT"), F.concat_ws("_", *by), F.lit(" ("), F.col("total").cast("string"), F.lit(", "), F.col("coverage"), F.lit(")"))
    return head.select(*by, label.alias("label"), "total").join(named, by, "left")


def combined(gt_prof: DataFrame, sub_prof: DataFrame, gt: str, subtype: str, least: float = 1.0) -> DataFrame:
    """A genotype's most frequent residue by position, then its subtypes' others; shares are compared as they are printed."""
    printed = labels.format_percent(F.col("pct")).cast("double")
    first = Window.partitionBy(gt, "pos").orderBy(printed.desc(), F.col("pct").desc(), "aa")
    top = gt_prof.filter(~F.col("aa").isin("X", "*")).withColumn("k", F.row_number().over(first)).filter("k = 1").select(gt, "pos", "aa", "pct")
    rest = sub_prof.filter(~F.col("aa").isin("X", "*") & (printed >= least)).join(top.select(gt, "pos", F.col("aa").alias("top")), [gt, "pos"]).filter("aa <> top")
    return top.select(gt, F.lit(0).alias("kind"), F.lit("").alias(subtype), "pos", "aa", "pct").unionByName(rest.select(gt, F.lit(1).alias("kind"), subtype, "pos", "aa", "pct"))


def frequent_mutations(prof: DataFrame, by: list[str], least: float = 10.0) -> DataFrame:
    """Residues of at least so many per cent, without X and stops."""
    return prof.filter((F.col("pct") >= least) & ~F.col("aa").isin("X", "*")).select(*by, "pos", "aa", "pct")


def aggregated_residues(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., pos, aas): residues joined by falling share."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("pct")).alias("o"), F.col("aa"))))
    return rows.groupBy(*by, "pos").agg(F.array_join(F.transform(order, lambda x: x["aa"]), "").alias("aas"))


def sufficient(counts: DataFrame, by: list[str], least: int = genes.MIN_GROUP, exempt: Column | None = None) -> DataFrame:
    """Groups with enough sequences, or exempt."""
    total = sequences_at(counts, by)
    return total.filter((F.col("total") >= least) | (exempt if exempt is not None else F.lit(False)))
