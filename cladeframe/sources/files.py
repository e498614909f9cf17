"""FASTA, GenBank, CSV, JSON and path-list readers, and the writers that go with them.

All readers go through Spark's file sources, so any file system Spark reads works.
"""

from __future__ import annotations

import tomllib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe import workdir
from cladeframe.functions import labels, sequences
from cladeframe.operators import selection

# File name endings.
FASTA_ENDINGS = ("fa", "faa", "fasta", "fna", "fas", "ffn", "frn", "seq")
GENBANK_ENDINGS = ("gb", "gbk", "genbank", "seq", "gbff")


def _whole(spark: SparkSession, paths: str | Sequence[str], endings: Sequence[str] | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if endings:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(endings) + "}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    return reader.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def fasta_records(text: Column) -> Column:
    """array of records, each without its '>'; what stands before the first is dropped."""
    return F.slice(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^>"), 2, 1 << 30)


def read_fasta(spark: SparkSession, paths: str | Sequence[str], upper: bool = True, raw: bool = False, endings: Sequence[str] | None = None, rule: str = "prefix", filled: bool = False, unique: bool = False, containing: str | None = None) -> DataFrame:
    """ref_id, path, ordinal, header, accession, seq [, body]: white space within sequences is dropped.

    Conditions that are errors when the rows are read, without a second pass: ``filled``, a file without a
    record; ``unique``, an accession that occurs twice. ``containing``: only records whose
    header has the text in any case; a file without one is an error.
    """
    found = _whole(spark, paths, endings).select("path", fasta_records(F.col("value")).alias("records"))
    some = lambda records, what: F.when(F.size(records) == 0, F.raise_error(F.concat(F.lit(f"{what}: "), "path"))).otherwise(records)
    if filled or containing is not None:
        # Files without a byte give no row; the listing names them. Spark reads no file whose name begins with _ or a dot.
        for name, length, _ in workdir.listed(spark, [paths] if isinstance(paths, str) else list(paths)):
            if length == 0 and name.rsplit("/", 1)[-1][:1] not in ("_", ".") and (not endings or name.rsplit(".", 1)[-1] in endings):
                raise ValueError(f"no record in: {name}")
        found = found.withColumn("records", some(F.col("records"), "no record in"))
    if containing is not None:
        has = F.filter(F.transform("records", lambda x, k: F.struct(k.alias("ordinal"), x.alias("record"))), lambda x: labels.contains_ci(F.regexp_extract(x["record"], r"^([^\n]*)", 1), F.lit(containing)))
        rows = found.select("path", F.explode(some(has, f"no header contains {containing} in")).alias("x")).select("path", "x.*")
    else:
        rows = found.select("path", F.posexplode("records").alias("ordinal", "record"))
    body = F.regexp_replace("record", r"^[^\n]*\n?", "")
    seq = F.regexp_replace(body, r"\s", "")
    out = rows.select(
        labels.ref_id(base_name(F.col("path")), rule).alias("ref_id"), "path", "ordinal",
        F.trim(F.regexp_extract("record", r"^([^\n]*)", 1)).alias("header"), labels.accession_of(F.ltrim("record")).alias("accession"),
        (F.upper(seq) if upper else seq).alias("seq"), body.alias("body"),
    )
    out = out if raw else out.drop("body")
    return selection.unique_or_fail(out, ["accession"], "accession") if unique else out


def accession_files(records: DataFrame) -> DataFrame:
    """accession, first (its place among the files), ref_ids and files that hold it."""
    return records.groupBy("accession").agg(F.min(F.struct("path", "ordinal")).alias("first"), F.array_sort(F.collect_set("ref_id")).alias("ref_ids"), F.array_sort(F.collect_set("path")).alias("files"))


def write_fasta(rows: DataFrame, path: str, header: str = "header", seq: str = "seq", width: int = 70, order: Sequence[str] = ()) -> None:
    """Wrapped records; with an order the files follow it."""
    rows = rows.orderBy(*order) if order else rows
    rows.select(F.concat(F.lit(">"), header, F.lit("\n"), sequences.wrap(F.col(seq), width)).alias("value")).write.mode("overwrite").text(path)


def rewrite_fasta(kept: DataFrame, path: str, width: int = 70) -> None:
    """Kept records (header, seq) below a new folder, a file a study: a rewrite never touches what it reads."""
    kept.select("ref_id", F.concat(F.lit(">"), "header", F.lit("\n"), sequences.wrap(F.col("seq"), width)).alias("value")).repartition("ref_id").write.mode("errorifexists").partitionBy("ref_id").text(path)


def concatenated(spark: SparkSession, paths: str | Sequence[str], path: str, endings: Sequence[str] | None = FASTA_ENDINGS) -> None:
    """All FASTA files as one text below ``path``, in the order of their paths, each ended by a new line; whole records stay together."""
    whole = _whole(spark, paths, endings).select("path", F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n$", "").alias("value"))
    whole.orderBy("path").select("value").write.mode("errorifexists").text(path)


def write_report(texts: DataFrame, path: str, by: Sequence[str] = (), text: str = "text") -> None:
    """Texts as files; ``by``: a folder a value."""
    writer = texts.select(*by, F.col(text).alias("value")).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def read_table(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """All columns as trimmed text, blank for missing; a byte-order mark is dropped; missing required columns are an error."""
    df = spark.read.csv(paths, header=True, multiLine=True, escape='"', sep=sep, encoding="UTF-8")
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select(*(labels.blank_to_empty(F.col(f"`{c}`")).alias(c) for c in df.columns))


def write_table(rows: DataFrame, path: str, by: Sequence[str] = (), sep: str = ",") -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).csv(path, header=True, sep=sep, escape='"')


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


SUBTYPE_SCHEMA = "genotypeName string, accession string, sequence string, firstNA int, author string, year string"
GENOTYPE_SCHEMA = "name string, refSequence string, abstractGene string, strain string"


def read_subtype_references(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path, multiLine=True, schema=SUBTYPE_SCHEMA)
    sub = labels.genotype_name(F.col("genotypeName"))
    return df.select(labels.genotype(sub).alias("gt"), sub.alias("subtype"), "accession", sequences.normalize_nt(F.col("sequence")).alias("seq"), F.col("firstNA").alias("first_na")).filter("subtype <> ''")


def read_genotype_references(spark: SparkSession, path: str, gene: str) -> DataFrame:
    df = spark.read.json(path, multiLine=True, schema=GENOTYPE_SCHEMA)
    return df.select(labels.reference_name(F.col("name"), gene).alias("gt"), F.upper(F.trim("refSequence")).alias("seq")).filter("gt <> ''")


def exported_references(spark: SparkSession, path: str, genes: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """genotype, gene, header, seq of the JSON references of some genes, as FASTA records named ``genotype 1 | NS3``.

    One a genotype and gene, the first in the file; ``names`` renames genes in the header.
    References without a residue are passed over. ``place`` is the gene's place in ``genes``,
    so that (genotype, place) is their order.
    """
    df = spark.read.json(path, multiLine=True, schema=GENOTYPE_SCHEMA).withColumn("ordinal", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    own = F.trim(F.coalesce("abstractGene", F.lit("")))
    number = F.regexp_extract(F.trim(F.coalesce("strain", F.lit(""))), r"^HCV(\d+)$", 1)
    rows = df.select(own.alias("own"), number.cast("int").alias("genotype"), F.upper(F.trim("refSequence")).alias("seq"), "ordinal").filter(F.col("own").isin(*genes) & (number != "") & (F.col("seq") != ""))
    first = rows.groupBy("genotype", "own").agg(F.min_by("seq", "ordinal").alias("seq"))
    called = F.coalesce(*(F.when(F.col("own") == k, v) for k, v in (names or {}).items()), F.col("own"))
    return first.select("genotype", called.alias("gene"), F.array_position(F.array(*map(F.lit, genes)), F.col("own")).alias("place"), F.concat(F.lit("genotype "), F.col("genotype").cast("string"), F.lit(" | "), called).alias("header"), "seq")


def migrated(spark: SparkSession, moves: dict[str, str]) -> list[str]:
    """Tab-separated tables rewritten as CSV, old path to new; old ones go once the new ones are there.

    Cells are kept as they are, blanks and white space too. Paths that don't exist are passed over; returns the written ones.
    """
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    done = []
    for old, new in moves.items():
        at = jvm.Path(old)
        system = at.getFileSystem(conf)
        if not system.exists(at):
            continue
        kept = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
        rows = spark.read.options(**kept).csv(old, sep="\t", inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        rows.na.fill("").write.mode("errorifexists").csv(new, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        system.delete(at, True)
        done.append(new)
    return done


def read_genbank(spark: SparkSession, paths: str | Sequence[str], endings: Sequence[str] | None = None) -> DataFrame:
    """path, ordinal, start_byte, end_byte, record: records without their '//' line and with plain new lines; a last one without it counts too."""
    from cladeframe.sources import genbank

    return genbank.as_text(genbank.read_records(spark, paths, endings)).drop("raw")


def parsed_genbank(records: DataFrame) -> DataFrame:
    """Adds locus, definition, accession, version, organism, sequence, references, qualifiers and structured_comment."""
    r = F.col("record")

    def top(key: str) -> Column:
        body = F.regexp_extract(r, rf"(?m)^{key}[ \t]+(.*(?:\n[ \t]{{12}}.*)*)", 1)
        return F.trim(F.regexp_replace(body, r"\s*\n\s*", " "))

    feature = F.regexp_extract(r, r"(?m)^     source[ \t]+(.*(?:\n[ \t]{21}.*)*)", 1)
    quals = F.regexp_extract_all(F.concat(F.lit("\n"), feature), F.lit(r'\n\s*/(\w+)(?:=("(?:[^"]|"")*"|[^\n]*))?'), F.lit(1))
    values = F.regexp_extract_all(F.concat(F.lit("\n"), feature), F.lit(r'\n\s*/(\w+)(?:=("(?:[^"]|"")*"|[^\n]*))?'), F.lit(2))
    clean = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, r'^"|"$', ""), r"\s*\n\s*", " "))
    pairs = F.arrays_zip(quals.alias("k"), clean.alias("v"))
    keys = F.array_distinct(quals)
    blocks = F.slice(F.split(F.concat(F.lit("\n"), F.regexp_replace(r, r"(?s)\n(?:COMMENT|FEATURES|ORIGIN).*", "")), r"\nREFERENCE"), 2, 1 << 30)
    field = lambda b, k: F.trim(F.regexp_replace(F.regexp_extract(b, rf"(?m)^[ \t]+{k}[ \t]+(.*(?:\n[ \t]{{12}}.*)*)", 1), r"\s*\n\s*", " "))
    return (
        records.withColumn("locus", F.regexp_extract(r, r"(?m)^LOCUS[ \t]+(\S+)", 1)).withColumn("definition", top("DEFINITION")).withColumn("accession", F.regexp_extract(r, r"(?m)^ACCESSION[ \t]+(\S+)", 1)).withColumn("version", F.regexp_extract(r, r"(?m)^VERSION[ \t]+(\S+)", 1)).withColumn("organism", F.trim(F.regexp_extract(r, r"(?m)^  ORGANISM[ \t]+(.*)", 1)))
        .withColumn("sequence", F.upper(F.regexp_replace(F.regexp_extract(r, r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[\d\s/]", "")))
        .withColumn("references", F.transform(blocks, lambda b: F.struct(*(field(b, k).alias(k.lower()) for k in ("AUTHORS", "TITLE", "JOURNAL", "PUBMED")))))
        .withColumn("location", F.trim(F.regexp_extract(feature, r"^([^\n]*)", 1)))
        .withColumn("__pairs", pairs).withColumn("__keys", keys)
        .withColumn("qualifiers", F.map_from_arrays("__keys", F.transform("__keys", lambda k: F.transform(F.filter("__pairs", lambda p: p["k"] == k), lambda p: p["v"]))))
        .withColumn("structured_comment", labels.structured_comment(r)).drop("__pairs", "__keys")
    )


def raw_accessions(record: Column) -> Column:
    """All names of a record: accession tokens, version, and the version without its number."""
    tokens = F.filter(F.split(F.regexp_extract(record, r"(?m)^ACCESSION[ \t]+(.*)", 1), r"\s+"), lambda x: x != "")
    version = F.regexp_extract(record, r"(?m)^VERSION[ \t]+(\S+)", 1)
    return F.array_distinct(F.filter(F.concat(tokens, F.array(version, labels.versionless(version))), lambda x: x != ""))


def read_settings(text: str, section: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """TOML ``[common]``, overlaid by ``[section]``, overlaid by the environment's non-blank values."""
    data = tomllib.loads(text)
    out = {k: str(v) for name in ("common", section) for k, v in data.get(name, {}).items()}
    return out | {k: v for k, v in (environment or {}).items() if k in out and v}
