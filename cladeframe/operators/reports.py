"""Reports, run summaries, updates by external calls, and what is looked up by accession or reference."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cladeframe import workdir
from cladeframe.functions import labels, sequences
from cladeframe.operators import selection

LOW_SCORE = 0.80  # alignments below are refined
NO_NUMBER = 10**12  # the place of studies whose id is no number

# Subtypes and genotypes whose alignment call goes before an external one.
PRIORITY_SUBTYPES = ("1d",)
PRIORITY_GENOTYPES = ("7", "8")

# Where a PubMed id comes from, in the order of the steps.
RECORD, SEARCHED, WEB = "genbank", "pubmed_esearch", "openai_web_search"


# Updates


def updated(rows: DataFrame, calls: DataFrame, key: str, value: str, source: str = "external") -> DataFrame:
    """``rows`` with ``value`` taken from the last non-blank call of the key; rows are never added.

    ``updated`` says whether there was a call; ``calls`` has (key, value, ordinal).
    """
    known = calls.filter(labels.or_null(F.col(value)).isNotNull() & labels.or_null(F.col(key)).isNotNull())
    last = known.groupBy(F.col(key).alias("__key")).agg(F.max_by(value, "ordinal").alias("__call"))
    out = rows.join(last, rows[key] == F.col("__key"), "left")
    has = F.col("__call").isNotNull()
    return out.withColumn(value, F.coalesce("__call", value)).withColumn("source", F.when(has, source).otherwise("")).withColumn("updated", has).drop("__key", "__call")


def goes_first(genotype: Column, subtype: Column) -> Column:
    """Whether an alignment's call goes before an external one."""
    gt, sub = F.lower(labels.blank_to_empty(genotype)), F.lower(labels.blank_to_empty(subtype))
    return sub.isin(*PRIORITY_SUBTYPES) | gt.isin(*PRIORITY_GENOTYPES) | F.substring(sub, 1, 1).isin(*PRIORITY_GENOTYPES)


def priority_report(profile: DataFrame, priority: DataFrame, external: DataFrame) -> DataFrame:
    """accession, external_subtype, subtype of the profile's accessions whose alignment call went first.

    All are joined by the accession without its version; ``profile`` and ``external``
    hold (accession, ordinal, ...), of several rows of one key the last counts.
    """
    key = labels.versionless(labels.blank_to_empty(F.col("accession")))
    low = F.lower(labels.blank_to_empty(F.col("subtype")))
    own = profile.withColumn("k", key).filter("k <> ''").groupBy("k").agg(F.max_by(labels.blank_to_empty(F.col("accession")), "ordinal").alias("accession"))
    first = priority.withColumn("k", key).filter((F.col("k") != "") & goes_first(F.col("genotype"), F.col("subtype"))).groupBy("k").agg(F.max_by(low, "ordinal").alias("subtype"))
    other = external.withColumn("k", key).groupBy("k").agg(F.max_by(low, "ordinal").alias("external_subtype"))
    return own.join(first, "k").join(other, "k", "left").select("accession", F.coalesce("external_subtype", F.lit("")).alias("external_subtype"), "subtype")


def low_scores(rows: DataFrame, score: str = "score", least: float = LOW_SCORE) -> DataFrame:
    return rows.filter(F.col(score) < least)


def refined(rows: DataFrame, better: DataFrame, key: str, score: str = "score", least: float = LOW_SCORE) -> DataFrame:
    """``rows`` whose low scores are replaced by those of ``better`` (key, score) where these are higher; ``refined`` marks them."""
    new = better.groupBy(F.col(key).alias("__key")).agg(F.max(score).alias("__new"))
    out = rows.join(new, rows[key] == F.col("__key"), "left")
    change = F.coalesce((F.col(score) < least) & (F.col("__new") > F.col(score)), F.lit(False))
    return out.withColumn("refined", change).withColumn(score, F.when(change, F.col("__new")).otherwise(F.col(score))).drop("__key", "__new")


# Orders and choices


def study_order(ref_id: Column) -> list[Column]:
    """Sort keys: studies by number, those whose id is no number last, then by the id itself."""
    number = F.when(ref_id.rlike("^[0-9]+$"), ref_id.cast("decimal(38,0)")).otherwise(F.lit(NO_NUMBER))
    return [number, ref_id]


def first_path(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """The one row of the smallest path that matches."""
    return files.filter(F.col(path).rlike(pattern)).orderBy(path).limit(1)


def first_source(named: Sequence[tuple[str, Column]]) -> Column:
    """struct(value, source): the first non-blank value and the name of where it was found; null where there is none."""
    out = F.lit(None).cast("struct<value:string,source:string>")
    for name, value in reversed(named):
        said = labels.or_null(value)
        out = F.when(said.isNotNull(), F.struct(said.alias("value"), F.lit(name).alias("source"))).otherwise(out)
    return out


def reference_steps(references: DataFrame, searched: DataFrame, crossref: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """References (accession, reference, pubmed, ...) after a chain of look-ups, the first PubMed id that is found wins.

    1. A reference's own ``pubmed`` stays. 2. Else a search's: ``searched`` (accession, reference,
    pmid, error, ordinal). 3. A DOI for every reference: ``crossref`` (accession, reference, doi,
    error, ordinal). 4. ``web`` (accession, reference, pmid, doi, ordinal), for accessions that
    still have a reference without an id: fills missing ids, and DOIs that step 3 has not. Of
    several results of one step the first counts, of ``web`` the last. Adds ``pmid_source``,
    ``crossref_doi``, ``web_doi`` and what each step said: ``kept``, ``search``, ``doi_search``,
    ``web_search``. A result with an error finds nothing. Null and blank ids are missing ones.
    """
    key = ["accession", "reference"]

    def one(rows: DataFrame, name: str, values: list[str], last: bool = False) -> DataFrame:
        pick = F.max_by if last else F.min_by
        said = F.struct(*(labels.or_null(F.col(v)).alias(v) for v in values))
        return rows.filter(labels.or_null(F.col("reference")).isNotNull()).groupBy(*key).agg(pick(said, "ordinal").alias(name))

    def outcome(error: Column, value: Column) -> Column:
        return F.when(error.isNotNull(), "error").when(value.isNotNull(), "matched").otherwise("no_match")

    own = labels.or_null(F.col("pubmed"))
    out = references.join(one(searched, "__s", ["pmid", "error"]), key, "left").join(one(crossref, "__c", ["doi", "error"]), key, "left")
    hit = F.when(F.col("__s.error").isNull(), F.col("__s.pmid"))
    source = F.when(own.isNotNull(), RECORD).when(hit.isNotNull(), SEARCHED)
    out = out.withColumns({
        "kept": F.when(own.isNotNull(), "kept_existing_pubmed").otherwise("missing_pubmed"), "search": F.when(own.isNull(), outcome(F.col("__s.error"), F.col("__s.pmid"))),
        "doi_search": outcome(F.col("__c.error"), F.col("__c.doi")), "crossref_doi": F.when(F.col("__c.error").isNull(), F.col("__c.doi")), "pmid_source": source, "pubmed": F.coalesce(own, hit),
    }).drop("__s", "__c")
    if web is None:
        return out.withColumn("web_doi", F.lit(None).cast("string")).withColumn("web_search", F.lit("skipped"))
    still = F.max(F.col("pubmed").isNull()).over(Window.partitionBy("accession"))
    out = out.withColumn("__open", still).join(one(web, "__w", ["pmid", "doi"], last=True), key, "left")
    told = F.when(F.col("__open"), F.col("__w"))
    filled = F.coalesce("pubmed", told["pmid"])
    return out.withColumns({
        "pmid_source": F.when(F.col("pubmed").isNull() & filled.isNotNull(), WEB).otherwise(F.col("pmid_source")), "web_doi": F.when(F.col("crossref_doi").isNull(), told["doi"]),
        "web_search": F.when(F.col("__open"), "completed").otherwise("skipped"), "pubmed": filled,
    }).drop("__open", "__w")


def boundaries(records: DataFrame, gene: str) -> DataFrame:
    """(gene, subtype, begin, end) of consensus records (header, seq) named ``<genotype>_<subtype>``: first and last three residues.

    Empty sequences are left out; a header without a ``_`` is an error when it is read.
    """
    subtype = F.when(F.contains("header", F.lit("_")), F.regexp_replace("header", "^[^_]*_", "")).otherwise(F.raise_error(F.concat(F.lit("no subtype in header: "), "header")))
    first, last = sequences.edges(F.col("seq"))
    return records.filter("seq <> ''").select(F.lit(gene).alias("gene"), subtype.alias("subtype"), first.alias("begin"), last.alias("end"))


def enriched(references: DataFrame, results: DataFrame, key: str = "reference") -> DataFrame:
    """References with what a look-up found: a missing ``pubmed`` and ``doi`` are filled, ``pmid_source`` says from where.

    ``results`` has (reference, pmid, doi, ordinal); of several the last counts.
    """
    found = results.filter(labels.or_null(F.col(key)).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct("pmid", "doi"), "ordinal").alias("__found"))
    out = references.join(found, references[key] == F.col("__key"), "left")
    fill = labels.or_null(F.col("pubmed")).isNull() & labels.or_null(F.col("__found.pmid")).isNotNull()
    return out.withColumn("pmid_source", F.when(fill, "look-up").otherwise("")).withColumn("pubmed", F.when(fill, F.col("__found.pmid")).otherwise(F.col("pubmed"))).withColumn("doi", F.col("__found.doi")).drop("__key", "__found")


def indexed(records: DataFrame, accession: str = "accession") -> DataFrame:
    """One record an accession: of the first file by path, then of the first place in it."""
    return selection.first_per(records, [accession], [F.col("path"), F.col("ordinal")])


def looked_up(asked: DataFrame, index: DataFrame, accession: str = "accession") -> DataFrame:
    """Asked accessions with their record, by the exact name, else without the version; ``found`` says which, blank for none."""
    exact = index.select(F.col(accession).alias("__a"), F.struct("path", "start_byte").alias("__exact"))
    short = selection.first_per(index.withColumn("__b", labels.versionless(F.col(accession))), ["__b"], [F.col("path"), F.col("ordinal")]).select("__b", F.struct("path", "start_byte").alias("__short"))
    out = asked.join(exact, asked[accession] == F.col("__a"), "left").join(short, labels.versionless(asked[accession]) == F.col("__b"), "left")
    found = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__short").isNotNull(), "versionless").otherwise("")
    at = F.coalesce("__exact", "__short")
    return out.select(*asked.columns, at["path"].alias("path"), at["start_byte"].alias("start_byte"), found.alias("found"))


# Counts


def profile_counts(rows: DataFrame, accession: str = "accession", subtype: str = "subtype", status: str = "status") -> DataFrame:
    """One row of distinct accessions: included, with and without a subtype, and those that failed the quality test."""
    own = labels.or_null(F.col(accession))
    passed = F.col(status) == "pass"
    included = F.when(passed, own)
    has = F.when(passed & labels.or_null(F.col(subtype)).isNotNull(), own)
    counted = rows.agg(F.count_distinct(included).alias("included"), F.count_distinct(has).alias("with_subtype"), F.count_distinct(F.when(~passed, own)).alias("ignored"))
    return counted.withColumn("without_subtype", F.col("included") - F.col("with_subtype"))


def failed_counts(rows: DataFrame, accession: str = "accession", status: str = "status") -> DataFrame:
    """(status, n): distinct accessions by status other than pass."""
    return rows.filter(F.col(status) != "pass").groupBy(F.lower(status).alias("status")).agg(F.count_distinct(labels.or_null(F.col(accession))).alias("n"))


def counted(rows: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows``, and an observation that holds the counters' row counts once they are written: no second pass."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(test).alias(name) for name, test in counters.items())), seen


def summary_json(seen: Observation, **more) -> str:
    """A run's counters, and what else is said of it, as one line of JSON."""
    return json.dumps({**{k: int(v) for k, v in seen.get.items()}, **more}, sort_keys=True)


# Texts


def alignment_blocks(ref: Column, query: Column, width: int = 80, names: tuple[str, str] = ("REF ", "CONS")) -> Column:
    """Blocks of so many columns: reference, marks and query, each with the place of its first column."""
    mark = sequences.marker(ref, query)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(ref) / width).cast("int") - 1, F.lit(0)))
    cut = lambda c, k: F.substring(c, k * width + 1, F.lit(width))
    line = lambda name, k, c: F.concat(F.lit(name + " "), F.lpad((k * width + 1).cast("string"), 5, " "), F.lit(" "), cut(c, k))
    block = lambda k: F.concat_ws("\n", line(names[0], k, ref), F.concat(F.lit(" " * 11), cut(mark, k)), line(names[1], k, query), F.lit(""))
    return F.when(F.length(ref) > 0, F.array_join(F.transform(starts, block), "\n")).otherwise(F.lit(""))


def consensus_report(aligned: DataFrame, gene: str, width: int = 80) -> DataFrame:
    """(label, text) of (label, gt, ref, query, score [, reference, number]): head, score and identity, and the alignment in blocks.

    With the reference's name and the running number of the report, the head has both.
    """
    ref, query = F.col("ref"), F.col("query")
    columns = F.zip_with(sequences.chars(ref), sequences.chars(query), lambda a, b: F.struct(a.alias("r"), b.alias("q")))
    said = F.size(F.filter(columns, lambda x: (x["r"] != "-") & ~x["q"].isin("-", "X", "*")))
    same = F.length(F.regexp_replace(sequences.marker(ref, query), "[^|]", ""))
    share = F.when(said > 0, same / said).otherwise(F.lit(0.0))
    size = lambda c: F.length(F.regexp_replace(c, "-", ""))
    head = F.concat(F.lit(f"gene={gene} subtype_consensus="), F.col("label"), F.lit(" genotype=GT"), F.col("gt"))
    if {"number", "reference"} <= set(aligned.columns):
        head = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), head, F.lit(" reference="), F.col("reference"))
    score = F.format_string("score=%.3f identity=%d/%d (%.3f%%) reference_length=%d consensus_length=%d", F.col("score").cast("double"), same, said, share * 100, size(ref), size(query))
    return aligned.select("label", F.concat_ws("\n", head, score, alignment_blocks(ref, query, width)).alias("text"))


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """``rows`` with their number, from 1, in a total order.

    Rows are sorted by ranges; a range's first number is the count of the rows before it, so no
    task ever holds more than its range. Only a count a task meets in one place.
    """
    sorted_rows = workdir.stored(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)  # the task that sorted the row; the lower bits are its place there
    counts = sorted_rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.join(F.broadcast(before), part == F.col("__part")).withColumn(name, F.col("__before") + place + 1).drop("__id", "__part", "__before")


def mention_report(hits: DataFrame) -> DataFrame:
    """(paper, text): a paper's accession mentions as lines, by sentence and accession, under a head with their number."""
    line = F.concat(F.lit("- "), F.col("accession"), F.lit(": "), F.col("sentence"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "accession", line.alias("t")))), lambda x: x["t"])
    return hits.groupBy("paper").agg(F.concat_ws("\n", F.concat(F.lit("# "), F.first("paper"), F.lit(" ("), F.count("*").cast("string"), F.lit(")")), F.array_join(lines, "\n")).alias("text"))
