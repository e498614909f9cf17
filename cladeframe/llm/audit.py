"""How a chain of document filters interacts: what each removes, in every order.

Documents are sorted by ranges of (text fingerprint, id) and within a range by
fingerprint, full text and id, so copies stand together and a text of a third of all
rows still spreads over many tasks. One pass over the sorted batches sets each
document's failure mask: four filters look at the text, the fifth compares it with its
predecessor and fails every copy whose id is not the first one's. A group that began in
an earlier range is settled afterwards: each task reports the texts (by SHA-256) that its
last fingerprint holds, and the rows that lead its first fingerprint's texts look for
them among earlier tasks' reports, some rows a task.

Masks are merged into additive counters (documents, good, toxic by part and mask: at most
32 rows a part, whatever the documents), and everything reported, for all orders of the
filters, is a sum over them. Texts move once; labels meet ids and masks only.

Cases: null text is the empty text; texts without words fail the least length, and are
neither repetitive nor loud; a null source is the part of the empty string; an id without
a label, or whose labels are null, is neither good nor toxic, of several labels any 1
counts; rows of one id are documents of their own, but not copies of each other; rows
without an id come after all ids and aren't copies of each other; very long texts are
taken whole; other columns are ignored, whatever their names; an empty table gives no
rows. Words are told apart by hashes of
50 bits and more (64, less the bits that number a slice's rows).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import shared, text

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS = 200
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
_STARTS = np.array([b & 0xC0 != 0x80 for b in range(256)])  # of code points
MASKED = "doc_id long, part string, mask int, task int, fingerprint long, digest binary, last boolean"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flagged bytes by document."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that documents fail."""
    n = len(offsets) - 1
    words = text.Words(data, offsets, lower=False)
    bits = np.uint64(n.bit_length())  # of the rows' numbers; what is left holds the words' hashes
    keys = np.sort(words.doc.astype(np.uint64) << (np.uint64(64) - bits) | words.hash >> bits)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    distinct = np.bincount((keys[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)
    fails = (
        words.count < MIN_WORDS,
        100 * distinct < 50 * words.count,
        100 * _sums(_UPPER[data], offsets) > 2 * _sums(_STARTS[data], offsets),
        _sums(_MARKS[data], offsets) > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


class _Groups:
    """The group of equal texts that sorted rows are in, from batch to batch."""

    def __init__(self) -> None:
        self.fingerprint: int | None = None
        self.said: bytes | None = None
        self.first_id: int | None = None
        self.texts: list[bytes] = []  # of the current fingerprint: one, but for collisions
        self.fingerprints = 0

    def step(self, fingerprint: int, said: bytes, doc_id: int | None) -> bool:
        """Whether the row has a predecessor of its text with another, smaller id."""
        if self.fingerprints == 0 or fingerprint != self.fingerprint:
            self.fingerprint, self.texts, self.said = fingerprint, [], None
            self.fingerprints += 1
        if said == self.said:
            return doc_id != self.first_id
        self.said, self.first_id = said, doc_id
        self.texts.append(said)
        return False


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, groups = TaskContext.get().partitionId(), _Groups()
    for batch in batches:
        prints = batch.column("fingerprint").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        for first, last, data, offsets in text.string_slices(batch.column("text")):
            mask = text_masks(data, offsets)
            digests: list[bytes | None] = [None] * (last - first)
            at = offsets.tolist()
            for k in range(last - first):
                copy = groups.step(prints[first + k], data[at[k] : at[k + 1]].tobytes(), ids[first + k])
                if copy:
                    mask[k] |= COPY
                elif groups.fingerprints == 1:  # an earlier task may hold the text
                    digests[k] = hashlib.sha256(groups.said).digest()
            yield _rows(task, mask, digests, batch.column("fingerprint")[first:last], batch.column("doc_id")[first:last], batch.column("part")[first:last], False)
    if groups.fingerprints:
        n = len(groups.texts)
        yield _rows(task, np.zeros(n, np.int32), [hashlib.sha256(t).digest() for t in groups.texts], pa.array([groups.fingerprint] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), True)


def _rows(task: int, mask: np.ndarray, digests: list, prints: pa.Array, ids: pa.Array, parts: pa.Array, last: bool) -> pa.RecordBatch:
    n = len(mask)
    columns = [ids, parts, pa.array(mask.astype(np.int32)), pa.array(np.full(n, task, np.int32)), prints, pa.array(digests, pa.binary()), pa.array(np.full(n, last))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MASKED.split(", ")])


def failure_masks(docs: DataFrame, part: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, mask (bit k: fails the filter FILTERS[k]) by row of ``docs``."""
    said = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), said.alias("text")).withColumn("fingerprint", F.xxhash64("text"))
    by_id = F.col("doc_id").asc_nulls_last()
    ranged = own.repartitionByRange(shared.parallelism(docs), "fingerprint", by_id).sortWithinPartitions("fingerprint", "text", by_id)
    rows = shared.stored(ranged.mapInArrow(text.released(_mask), MASKED), "masks")
    # Rows that lead a text of their task's first fingerprint: a copy if an earlier task ended with that text.
    ends = rows.filter("last").select(F.col("task").alias("before"), "fingerprint", "digest")
    leads = rows.filter("not last and digest is not null")
    earliest = ends.groupBy("fingerprint", "digest").agg(F.min("before").alias("before"))
    settled = leads.join(earliest, ["fingerprint", "digest"], "left").withColumn("mask", F.when(F.col("before") < F.col("task"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")))
    columns = ("doc_id", "part", "mask")
    return rows.filter("not last and digest is null").select(*columns).unionByName(settled.select(*columns))


def part_counters(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents, and those of quality 1 and toxic 1, by part and failure mask."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    # Rows without an id have no label; in the join they would be one key.
    named, nameless = masks.filter("doc_id is not null"), masks.filter("doc_id is null")
    both = named.join(told, "doc_id", "left").unionByName(nameless, allowMissingColumns=True)
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def interactions(counters: DataFrame) -> DataFrame:
    """part, filter_order, step and what the filter of that step does there, for all orders of the filters.

    A part's counters (32 at most) stand in one row while the steps are laid over them.
    """
    steps = []
    for order in permutations(FILTERS):
        done = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            steps.append({"filter_order": "".join(order), "step": k + 1, "bit": bit, "done": done})
            done |= bit
    laid = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, done int>>")
    wide = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    at = wide.select("part", "m", F.explode(laid).alias("s")).select("part", "m", "s.*")
    removed = lambda m: ((m["mask"].bitwiseAND(F.col("done")) == 0) & (m["mask"].bitwiseAND(F.col("bit")) != 0))

    def total(of, where) -> F.Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda a, m: a + F.when(where(m), of(m)).otherwise(F.lit(0)).cast("long"))

    n = lambda m: m["n"]
    orders = len(steps) // len(FILTERS)
    # Of all orders a filter comes before the others that a document fails in one of as many as it fails.
    share = lambda m: m["n"] * orders / F.greatest(F.bit_count(m["mask"]), F.lit(1))
    return at.select(
        "part", "filter_order", "step",
        total(n, lambda m: m["mask"].bitwiseAND(F.col("done").bitwiseOR(F.col("bit"))) == 0).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda m: (m["mask"].bitwiseAND(F.col("bit")) != 0) & (m["mask"].bitwiseAND(F.col("done")) != 0)).alias("redundant"),
        total(n, lambda m: m["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda m: m["good"], removed).alias("good_lost"),
        total(lambda m: m["toxic"], removed).alias("toxic_lost"),
        total(share, lambda m: m["mask"].bitwiseAND(F.col("bit")) != 0).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The interactions of the five filters by part of ``docs``."""
    return interactions(part_counters(failure_masks(docs, F.col(part_col), id_col, text_col), labels, id_col))


#: The same counts by plain SQL.
ORACLE_SQL = r"""
WITH told AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), fails AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
  FROM told
), counters AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM fails LEFT JOIN labels USING (doc_id) GROUP BY part, failed
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS f, left(filter_order, step - 1) AS done FROM orders, range(1, 6) r(step)
), held AS (
  SELECT part, filter_order, step, f, n, good, toxic, failed, contains(failed, f) AS own,
    done <> '' AND regexp_matches(failed, '[' || done || '_]') AS earlier
  FROM counters, steps
), summed AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT own AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE own AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failed = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE own AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM held GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed
"""
