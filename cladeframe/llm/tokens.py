"""Token-ID output: Parquet list columns in document order.

One row a document: ``doc_id``, ``n_tokens``, ``tokens`` (list of int32). The list
column is dictionary-encoded, the metadata columns are delta-encoded (format
version 2), row groups are small and every page is indexed, so a reader can take
``n_tokens`` without touching the ids, or the ids of a few documents without
reading the rest.

Cases: null text is the empty text, whose row holds the end id alone; equal ids
are ordered by their tokens' count and checksum; a null id sorts first; an empty
table gives an empty file set; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.llm import shared, text

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Words whose ids a task remembers at most; beyond, it forgets those that only one slice had.
REMEMBERED_WORDS = 200_000
SLICE_BYTES = 1 << 20
TOKENS_SCHEMA = "doc_id long, n_tokens long, crc long, tokens array<int>"


class WordCache:
    """A tokenizer whose pieces never span white space, with remembered ids by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep(np.zeros(0, np.int64))

    index: dict[bytes, int] = {}
    flat = begin = length = hits = np.zeros(0, np.int32)

    def keep(self, rows: np.ndarray) -> None:
        """Forget all words but those of the ascending rows."""
        words = list(self.index)
        self.index = {words[r]: k for k, r in enumerate(rows.tolist())}
        length = self.length[rows].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = self.flat[np.repeat(self.begin[rows] - ends[:-1], length) + np.arange(ends[-1])]
        self.used = int(ends[-1])
        room = 1 << max(14, int(len(rows)).bit_length())
        self.flat = np.concatenate([flat, np.zeros(max(1 << 16, self.used), np.int32)])
        self.begin, self.length, self.hits = np.zeros(room, np.int64), np.zeros(room, np.int32), np.zeros(room, np.int32)
        self.begin[: len(rows)], self.length[: len(rows)] = ends[:-1], length

    def pieces(self, word: bytes) -> list[int]:
        """Ids of one word that isn't letters of ASCII alone."""
        if word.isascii() and b"'" not in word and b"<|" not in word:  # letters, single digits and the rest are pieces
            return [t.id for p in _PIECE.findall(word.decode().lower()) for t in self.model.tokenize(_as_chars(p.encode()))]
        said = word.decode()
        plain = said if unicodedata.is_normalized("NFC", said) else unicodedata.normalize("NFC", said)
        plain = "".join(c.lower() for c in plain) if "\u03a3" in plain else plain.lower()  # no final sigma
        if plain.isalpha():
            return [t.id for t in self.model.tokenize(_as_chars(plain.encode()))]
        return self.tokenizer.encode(said, add_special_tokens=False).ids

    def add(self, words: list[bytes]) -> None:
        one, other = self.model.tokenize, self.pieces
        # Letters alone are one piece, which goes straight to the model.
        ids = [[t.id for t in one(w.decode().lower())] if w.isalpha() else other(w) for w in words]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        new = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum()))
        n = len(self.index)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(ids) > len(self.begin):
            self.begin, self.length, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.hits))
        self.flat[self.used : self.used + len(new)] = new
        self.begin[n : n + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(ids)] = lengths
        self.used += len(new)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Places of distinct words in the cache."""
        if len(self.index) + len(words) > REMEMBERED_WORDS:
            often = np.flatnonzero(self.hits[: len(self.index)] > 1)
            self.keep(often if len(often) + len(words) <= REMEMBERED_WORDS else np.zeros(0, np.int64))
        if missing := [w for w in words if w not in self.index]:
            self.add(missing)
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self.hits[rows] += 1
        return rows


_PIECE = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_STOPS = np.isin(np.arange(256), [ord(","), ord(".")])
#: Byte-level vocabularies write a byte as itself where it prints, else as a letter from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = sorted(set(range(256)) - set(_PRINTS))
_BYTE_CHARS = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))


def _as_chars(piece: bytes) -> str:
    return codecs.charmap_decode(piece, "strict", _BYTE_CHARS)[0]


def encode_slice(cache: WordCache, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds by document) of a slice, as the tokenizer gives them for each whole text.

    Pieces never span white space and end before a full stop or comma that follows a
    letter or digit, so each such stretch is encoded once and remembered.
    """
    special = b"<|" in data.tobytes()  # special tokens are matched before lower-casing
    lower = data if special else text.LOWER[data]
    cuts = np.flatnonzero(_STOPS[lower[1:]] & _ALNUM[lower[:-1]]) + 1
    words = text.Words(lower, offsets, lower=False, cuts=cuts)
    _, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    raw = lower.tobytes()
    row = cache.rows([raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])[inverse]
    lengths = cache.length[row].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    ids = cache.flat[np.repeat(cache.begin[row] - ends[:-1], lengths) + np.arange(ends[-1])]
    return ids, ends[words.first]


def encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(path)  # goes with the task: workers live on, and other tasks' words are mostly others
        for batch in batches:
            for first, last, data, offsets in text.string_slices(batch.column("text"), SLICE_BYTES):
                ids, bounds = encode_slice(cache, data, offsets)
                n = last - first
                full = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(n + 1)
                little = np.ascontiguousarray(full, "<u4").data
                crc = [zlib.crc32(little[bounds[k] : bounds[k + 1]]) for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), text.list_array(full.astype(np.int32), bounds)], names=["doc_id", "n_tokens", "crc", "tokens"])

    return run


def splitters(docs: DataFrame, column: str, n: int) -> list[int]:
    """Up to n - 1 ascending values that part the column evenly; n is the partitions, so the list is bounded."""
    if n < 2:
        return []
    row = docs.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 20 * n).alias("at")).first()
    return sorted(set(row["at"] or []))


def bucket_of(column: str, at: list[int]) -> F.Column:
    """How many splitters lie at or below the value; null goes first. A balanced tree of comparisons."""

    def tree(low: int, high: int) -> F.Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) >= F.lit(at[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return F.coalesce(F.when(F.col(column).isNotNull(), tree(0, len(at))), F.lit(0))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", mode: str = "errorifexists") -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending id order below ``path``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = shared.parallelism(docs)
    at = splitters(own, "doc_id", n)
    encoded = own.mapInArrow(text.released(encoder(tokenizer_path, end_id)), TOKENS_SCHEMA)
    dealt = encoded.repartitionById(len(at) + 1, bucket_of("doc_id", at))
    out = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "crc").select("doc_id", "n_tokens", "tokens")
    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES}
    out.write.mode(mode).options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, metadata_only: bool = False) -> DataFrame:
    """The files as a table; with ids, page indexes skip the other pages, and metadata_only never reads the ids."""
    df = spark.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(path)
    if doc_ids is not None:
        df = df.filter(F.col("doc_id").isin(doc_ids))
    return df.drop("tokens") if metadata_only else df


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        little = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4").data
        crc = [zlib.crc32(little[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64()), batch.column("file")], names=["doc_id", "n_tokens", "ids_crc32", "file"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files below ``path``: where each document's ids begin in the whole stream.

    Only one row a file (their number is that of the writing tasks) meets in one place.
    """
    rows = read_tokens(spark, path).withColumn("file", F.col("_metadata.file_name")).select("doc_id", "tokens", "file").mapInArrow(text.released(_checksums), "doc_id long, n_tokens long, ids_crc32 long, file string")
    lengths = read_tokens(spark, path, metadata_only=True).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("total"))
    # Files are numbered by the writing task, tasks hold ascending ranges of ids.
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = lengths.select("file", (F.sum("total").over(Window.orderBy(number, "file")) - F.col("total")).alias("before"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
