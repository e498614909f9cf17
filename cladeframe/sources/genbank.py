"""GenBank flat files by byte ranges: exact offsets, any number of tasks a file, bundles with indexes.

Files are read by Spark's text source, which parts a file into byte ranges and gives every
line to the range that it begins in. Tasks cut their lines into records at separator
lines; what a range holds before its first separator and after its last are fragments,
which are put together by file. Offsets come from the ranges' byte counts, so nothing is
read twice and no task needs a whole file.

A separator is a line of ``//`` alone, ended by any of \\n, \\r\\n or the file's end. A last
record without one counts if it isn't blank. Records are given as their exact bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe import workdir
from cladeframe.functions import labels
from cladeframe.operators import selection, sized
from cladeframe.sources import files

PIECE_BYTES = 128 << 20  # of a bundle's file
HEAD, WHOLE, TAIL, RANGE = 0, 1, 2, 3  # kinds of rows that tasks report
PIECES = "path string, block long, kind int, nth long, start long, size long, raw binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and fragments of byte ranges; lines come in order, one range after another. A range ends with a row of its size and separators."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    now: tuple[str, int] | None = None
    held: list[bytes] = []
    at = begun = separators = 0
    out: list[tuple] = []

    def ended() -> None:
        if now is not None:
            out.append((*now, TAIL if separators else HEAD, separators, begun, at - begun, b"\n".join(held) + b"\n" if held else b""))
            out.append((*now, RANGE, separators, 0, at, None))

    def told() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for path, block, line in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if now != (path, block):
                ended()
                now, held, at, begun, separators = (path, block), [], 0, 0, 0
            held.append(line)
            at += len(line) + 1
            if line.rstrip(b"\r") == b"//":
                out.append((path, block, WHOLE if separators or block == 0 else HEAD, separators, begun, at - begun, b"\n".join(held) + b"\n"))
                held, begun, separators = [], at, separators + 1
        yield told()
    ended()
    yield told()


def read_records(spark: SparkSession, paths: str | Sequence[str], endings: Sequence[str] | None = None) -> DataFrame:
    """path, ordinal (of the record in its file), start_byte, end_byte, raw (binary): records with their separator line."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if endings:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(endings) + "}")
    lines = reader.text([paths] if isinstance(paths, str) else list(paths))
    meta = F.col("_metadata")
    rows = lines.select(F.col("value").cast("binary").alias("line"), meta["file_path"].alias("path"), meta["file_block_start"].alias("block"))
    sizes = lines.select(meta["file_path"].alias("path"), meta["file_size"].alias("file_size")).distinct()
    pieces = workdir.stored(rows.mapInArrow(_cut, PIECES), "records")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.filter(F.col("kind") == RANGE).select(
        "path", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("nth").over(before), F.lit(0)).alias("records"),
    )
    placed = pieces.filter((F.col("kind") != RANGE) & (F.col("size") > 0)).join(ranges, ["path", "block"])
    placed = placed.select("path", "kind", (F.col("records") + F.col("nth")).alias("ordinal"), (F.col("base") + F.col("start")).alias("start_byte"), "size", "raw")
    whole = placed.filter(F.col("kind") == WHOLE).select("path", "ordinal", "start_byte", "size", "raw")
    # Fragments of one record have one number: that of the separators before them.
    joined = placed.filter(F.col("kind") != WHOLE).groupBy("path", "ordinal").agg(F.min("start_byte").alias("start_byte"), F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("start_byte", "raw"))).alias("parts"))
    parted = joined.select("path", "ordinal", "start_byte", "size", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["raw"])).alias("raw"))
    both = whole.unionByName(parted).join(sized.small(sizes), "path")
    # A file's last line may have no new line of its own.
    end = F.least(F.col("start_byte") + F.col("size"), F.col("file_size"))
    exact = both.select("path", "ordinal", "start_byte", end.alias("end_byte"), F.substring("raw", F.lit(1), (end - F.col("start_byte")).cast("int")).alias("raw"))
    return exact.filter(F.col("raw").cast("string").rlike(r"\S"))


def as_text(records: DataFrame) -> DataFrame:
    """Adds ``record``: the text with plain new lines and without its separator, as ``files.parsed_genbank`` takes it."""
    text = F.regexp_replace(F.col("raw").cast("string"), r"\r\n?", "\n")
    return records.withColumn("record", F.regexp_replace(text, r"(?:^|(?<=\n))//\n*$", ""))


def record_index(records: DataFrame) -> DataFrame:
    """name, path, ordinal, start_byte, end_byte of every name a record has; of several records the last in its file, of the last file, counts."""
    names = as_text(records).select(F.explode(files.raw_accessions(F.col("record"))).alias("name"), "path", "ordinal", "start_byte", "end_byte")
    place = F.struct("path", "ordinal")
    return names.groupBy("name").agg(F.max_by(F.struct("path", "ordinal", "start_byte", "end_byte"), place).alias("at")).select("name", "at.*")


def matching(records: DataFrame, wanted: DataFrame, accession: str = "accession") -> DataFrame:
    """The records of the wanted accessions (exact or without a version), one a name: the last one. Only names and places meet; a
    record's bytes move once, and only if it is wanted."""
    asked = wanted.select(F.col(accession).alias("asked")).filter("asked is not null").distinct()
    index = record_index(records)
    exact = asked.join(index, F.col("asked") == F.col("name"))
    short = asked.join(exact, "asked", "left_anti").join(index, labels.versionless(F.col("asked")) == F.col("name"))
    found = workdir.stored(exact.unionByName(short).drop("name"), "matching")
    return records.select("path", "ordinal", "raw").join(sized.small(found), ["path", "ordinal"])


def write_bundles(records: DataFrame, wanted: DataFrame, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The records that each study (study, accession) asks for, as text files below ``path/records``, and the index of where they are.

    A study's records stand in the order of their source; beyond ``piece_bytes`` a further
    file begins. Returns the index, written to ``path/index``: study, accession, found, piece,
    byte_start, byte_end (in the piece's file), source, source_start. The sources' own index
    is written to ``path/sources``: path, records, names.
    """
    spark = records.sparkSession
    held = workdir.stored(matching(records, wanted), "bundle")
    body = F.regexp_replace(F.col("raw").cast("string"), r"\n$", "")
    asks = wanted.select("study", "accession").filter("accession is not null").distinct()
    of_study = asks.join(held.select(F.col("asked").alias("accession"), "path", "ordinal", "start_byte", (F.octet_length(body) + 1).cast("long").alias("size")), "accession")
    each = of_study.groupBy("study", "path", "ordinal").agg(F.first("start_byte").alias("start_byte"), F.first("size").alias("size"))
    order = Window.partitionBy("study").orderBy("path", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    cut = each.withColumn("piece", F.floor(F.coalesce(F.sum("size").over(order), F.lit(0)) / piece_bytes).cast("int"))
    within = Window.partitionBy("study", "piece").orderBy("path", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    placed = workdir.stored(cut.withColumn("byte_end", F.sum("size").over(within)).withColumn("byte_start", F.col("byte_end") - F.col("size")), "placed")
    texts = placed.join(held.dropDuplicates(["path", "ordinal"]).select("path", "ordinal", body.alias("value")), ["path", "ordinal"])
    texts.repartition("study", "piece").sortWithinPartitions("study", "piece", "path", "ordinal").select("study", "piece", "value").write.partitionBy("study", "piece").text(f"{path}/records")
    told = of_study.select("study", "accession", "path", "ordinal").join(placed.drop("size"), ["study", "path", "ordinal"])
    index = asks.join(told, ["study", "accession"], "left").select("study", "accession", F.col("piece").isNotNull().alias("found"), "piece", "byte_start", "byte_end", F.col("path").alias("source"), F.col("start_byte").alias("source_start"))
    index.write.parquet(f"{path}/index")
    record_index(records).groupBy("path").agg(F.count_distinct("ordinal").alias("records"), F.array_sort(F.collect_set("name")).alias("names")).write.parquet(f"{path}/sources")
    return spark.read.parquet(f"{path}/index")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """study, accession, record of the found rows of a bundle's index, cut out of its files by their offsets."""
    index = spark.read.parquet(f"{path}/index").filter("found")
    whole = spark.read.text(f"{path}/records", wholetext=True).select(F.col("study").cast("string").alias("study"), "piece", F.col("value").cast("binary").alias("bytes"))
    # A file meets all its places in one row: joined a row a record, its bytes would be moved as often as it has records.
    places = index.groupBy("study", "piece").agg(F.collect_list(F.struct("accession", "byte_start", "byte_end")).alias("places"))
    cut = F.transform("places", lambda x: F.struct(x["accession"].alias("accession"), F.substring(F.col("bytes"), (x["byte_start"] + 1).cast("int"), (x["byte_end"] - x["byte_start"]).cast("int")).cast("string").alias("record")))
    return places.join(whole, ["study", "piece"]).select("study", F.explode(cut).alias("x")).select("study", "x.accession", "x.record")
