"""Distances between groups of sequences from counts, never from pairs of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe import genes
from cladeframe.operators import alignment


def pair_distance(counts: DataFrame, group: str) -> DataFrame:
    """(a, b, distance) for a <= b: mean mismatch of all pairs of sequences, summed over positions and divided once.

    ``counts`` has (group, pos, call, n). Two groups differ at a position in nA nB minus
    the sum of cA cB pairs, a group with itself in C(n, 2) minus that of C(c, 2): the work
    is the number of groups squared times positions, whatever the number of sequences.
    Null where no pair has a position in common.
    """
    calls = counts.groupBy(group, "pos").agg(F.map_from_entries(F.collect_list(F.struct("call", "n"))).alias("m"), F.sum("n").alias("n"))
    one = calls.select(F.col(group).alias("a"), "pos", F.col("m").alias("ma"), F.col("n").alias("na"))
    two = calls.select(F.col(group).alias("b"), "pos", F.col("m").alias("mb"), F.col("n").alias("nb"))
    both = one.join(two, "pos").filter("a <= b")
    same = F.aggregate(F.map_entries("ma"), F.lit(0).cast("long"), lambda acc, x: acc + x["value"] * F.coalesce(F.element_at("mb", x["key"]), F.lit(0)))
    own = F.aggregate(F.map_values("ma"), F.lit(0).cast("long"), lambda acc, c: acc + c * (c - 1))
    itself = F.col("a") == F.col("b")
    total = F.when(itself, F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    equal = F.when(itself, own / 2).otherwise(same)
    out = both.groupBy("a", "b").agg(F.sum(total - equal).alias("d"), F.sum(total).alias("t"))
    return out.select("a", "b", F.when(F.col("t") > 0, F.col("d") / F.col("t")).alias("distance"))


def window_distance(residues: DataFrame, group: str, length: int) -> DataFrame:
    """(a, b, distance) for a < b: differences by the whole window's length; missing symbols of either side don't differ."""
    said = residues.filter(~F.upper("aa").isin("-", "X", "?", "*"))
    one = said.select(F.col(group).alias("a"), "pos", F.col("aa").alias("x"))
    two = said.select(F.col(group).alias("b"), "pos", F.col("aa").alias("y"))
    return one.join(two, "pos").filter("a < b").groupBy("a", "b").agg((F.count_if(F.col("x") != F.col("y")) / length).alias("distance"))


def reference_distance(residues: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """(by..., compared, differences, changes, distance) of consensus residues (by..., pos, aa) and reference (pos, ref)."""
    both = residues.join(reference, "pos")
    differs = F.col("aa") != F.col("ref")
    change = F.when(differs, F.struct("pos", F.concat(F.col("pos").cast("string"), F.lit(":"), "ref", F.lit(">"), "aa").alias("t")))
    out = both.groupBy(*by).agg(F.count("*").alias("compared"), F.count_if(differs).alias("differences"), F.array_join(F.transform(F.array_sort(F.collect_list(change)), lambda x: x["t"]), ",").alias("changes"))
    return out.withColumn("distance", F.col("differences") / F.col("compared"))


def aligned_reference_distance(consensus: DataFrame, references: DataFrame, positions: list[int], scores: alignment.Scores = alignment.GLOBAL_AA) -> DataFrame:
    """(subtype, reference, compared, differences, changes, distance, status) of consensus residues (subtype, pos, aa), one a position.

    ``references``: subtype, accession, seq (residues), ordinal; of several the first. The
    consensus, with X at places that have no residue, is aligned to its whole reference; columns
    of wanted reference positions where both hold a residue count. A subtype without a reference
    is ``reference_not_found``, one without such columns ``no_comparable_positions``; both have
    no distance. ``scores`` differ by gene (``reference_scores``).
    """
    known = references.groupBy("subtype").agg(F.min_by(F.struct(F.col("accession").alias("reference"), F.upper("seq").alias("ref")), F.struct("ordinal", "accession")).alias("r")).select("subtype", "r.*")
    said = consensus.filter("pos >= 1").groupBy("subtype").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", F.upper("aa").alias("aa"))))).alias("aas"))
    whole = F.array_join(F.transform(F.sequence(F.lit(1), F.length("ref")), lambda p: F.coalesce(F.element_at("aas", p), F.lit("X"))), "")
    n = int(consensus.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # alignment costs time, not bytes
    rows = said.join(known, "subtype", "left").withColumn("query", F.when(F.length("ref") > 0, whole)).repartition(n, "subtype")
    aligned = rows.withColumn("al", alignment.aligner(scores)(F.col("query"), F.col("ref")))
    # A query symbol a reference column: insertions fall away, gaps stay.
    on_ref = alignment.projected(F.col("al.query"), F.col("al.ref"), F.col("al.ref_start"), F.length("ref"))
    pair = lambda p: F.struct(p.alias("pos"), F.substring(F.col("ref"), p, F.lit(1)).alias("ref"), F.substring(F.col("on_ref"), p, F.lit(1)).alias("aa"))
    wanted = F.array(*(F.lit(p) for p in sorted(positions))).cast("array<int>")
    both = F.filter(F.transform(wanted, pair), lambda x: x["ref"].isin(*genes.VALID_AA) & x["aa"].isin(*genes.VALID_AA))
    differ = F.filter("pairs", lambda x: x["ref"] != x["aa"])
    change = F.transform("differ", lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), x["ref"], F.lit(">"), x["aa"]))
    found = aligned.withColumn("on_ref", F.when(F.length("query") > 0, on_ref)).withColumn("pairs", F.coalesce(both, F.array().cast("array<struct<pos:int,ref:string,aa:string>>"))).withColumn("differ", differ)
    compared = F.size("pairs")
    status = F.when(F.col("reference").isNull(), "reference_not_found").when(compared == 0, "no_comparable_positions").otherwise("ok")
    some = lambda c: F.when(F.col("reference").isNotNull(), c)
    return found.select(
        "subtype", "reference", some(compared).alias("compared"), some(F.size("differ")).alias("differences"), some(F.array_join(change, ";")).alias("changes"),
        F.when(compared > 0, F.size("differ") / compared).alias("distance"), status.alias("status"),
    )


def reference_scores(gene: str) -> alignment.Scores:
    """NS3 has scores of its own; the other genes count equal columns alone, so of their equal alignments this engine's first counts."""
    return alignment.GLOBAL_AA if gene == "NS3" else alignment.PLAIN


def matrix(pairs: DataFrame, labels: list[str], upper: bool = False) -> DataFrame:
    """Square matrix of (a, b, distance); ``upper`` keeps the triangle above the diagonal only."""
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance").filter("a <> b")
    rows = pairs.filter("a < b") if upper else pairs.unionByName(turned)
    wide = rows.groupBy("a").pivot("b", labels[1:] if upper else labels).agg(F.first("distance"))
    return wide if not upper else wide.filter(F.col("a") != labels[-1])


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason whose test holds; null for rows that are kept."""
    out = F.when(reasons[0][1], reasons[0][0])
    for name, test in reasons[1:]:
        out = out.when(test, name)
    return out


def exclusions(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n) with a row ``Total``."""
    told = rows.withColumn("reason", first_reason(reasons)).filter("reason is not null")
    return told.rollup("reason").agg(F.count("*").alias("n")).withColumn("reason", F.coalesce("reason", F.lit("Total")))
