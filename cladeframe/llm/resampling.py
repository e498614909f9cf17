"""Importance resampling towards a target text: hashed word n-grams, log-ratio gains, seeded Gumbel draws.

Features are all runs of 1 to ``order`` words, joined by one blank, each counted as often
as it occurs; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``. They are
found by a byte automaton that works on a whole Arrow buffer: bytes are classified by a
table, words begin and end where the classes' differences are, and the checksums of all
words advance together, one byte a step, by CRC's table (the few words above ``LONG_WORD``
bytes are finished one by one: a step for each byte of the longest word would be a loop
over a text). A run of k words goes on from the state of its first k - 1.

Counts are taken over every document and every target text; what meets are one array a
task and the ``buckets`` gains. A document's weight is the floored mean of its features'
gains; weight plus a Gumbel number seeded by the id is its score, and the highest scores
are drawn. Ranks come from counts by score: scores are whole numbers in a bounded range
(``BROADCAST`` of the counts is bounded by it), so only the drawn rows are ordered, each
score by itself.

Cases: null and empty texts have no features and weight 0; without target texts all gains
come from the documents' counts alone; rows without an id have the score of an empty id and
are neither counted nor drawn; rows of one id are documents of their own, ordered by
features and weight; equal scores go to the smaller id; very long texts and words are taken
whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm import shared, text

BUCKETS = 10_000
LONG_WORD = 64  # bytes that words advance together
_ALL = np.uint32(0xFFFFFFFF)
#: The state that each byte leads to from zero; checksums are linear, so the start and end values of zlib's cancel out.
_TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states (not inverted) after the bytes of every span, all spans at once."""
    out = state.copy()
    size = end - start
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")  # spans that still go on are a prefix
    longest_first = size[order]
    now, at = out[order], start[order]
    for step in range(int(min(longest_first[0], LONG_WORD)) if len(order) else 0):
        active = int(np.searchsorted(-longest_first, -step, "left"))
        byte = data[at[:active] + step]
        now[:active] = _TABLE[(now[:active] ^ byte) & np.uint32(0xFF)] ^ (now[:active] >> np.uint32(8))
    for k in range(int(np.searchsorted(-longest_first, -LONG_WORD, "left"))):
        rest = data[at[k] + LONG_WORD : at[k] + longest_first[k]].tobytes()
        now[k] = zlib.crc32(rest, int(now[k] ^ _ALL)) ^ int(_ALL)
    out[order] = now
    return out


def features(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every run of 1 to ``order`` words."""
    words = text.Words(data, offsets, separators=text.NOT_ALNUM)
    state = np.full(len(words.start), _ALL, np.uint32)
    docs, found = [], []
    for k in range(order):
        total = max(len(words.start) - k, 0)
        inside = words.doc[:total] == words.doc[k : k + total]
        state = state[:total]
        if k:
            state = _TABLE[(state ^ np.uint32(32)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = advance(state, words.data, words.start[k : k + total], words.end[k : k + total])
        docs.append(words.doc[:total][inside])
        found.append(((state[inside] ^ _ALL) % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(found)


def _counter(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, data, offsets in text.string_slices(batch.column("text")):
                total += np.bincount(features(data, offsets, order, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, order: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows of ``text``: at most one row a bucket and task is shuffled."""
    rows = texts.mapInArrow(text.released(_counter(order, buckets)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of a bucket's smoothed shares."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    ratio = [float((t + 1) * (all_s + n)) / float((s + 1) * (all_t + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weigher(gain: np.ndarray, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text.string_slices(batch.column("text")):
                doc, bucket = features(data, offsets, order, len(gain))
                words = np.diff(text.Words(data, offsets, separators=text.NOT_ALNUM).first) if order > 1 else np.bincount(doc, minlength=last - first)
                n = np.bincount(doc, minlength=last - first)
                total = np.bincount(doc, gain[bucket], last - first).astype(np.int64)  # whole numbers, exact in doubles
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], *(pa.array(x.astype(np.int64)) for x in (n, words, weight))], names=["doc_id", "n_features", "n_words", "weight"])

    return run


def gumbel(id_col: str, seed: int) -> F.Column:
    """Floored thousandths of a Gumbel number from the first 32 bits of the id's SHA-256."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, seed: int = 2024, min_words: int = 20, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    Of the documents with ``min_words`` words and more the given percentage (rounded down) of highest scores is drawn.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(own.select("text"), order, buckets), bucket_counts(target.select(F.col(target_col).cast("string").alias("text")), order, buckets))
    weighed = own.mapInArrow(text.released(_weigher(gain, order)), "doc_id long, n_features long, n_words long, weight long")
    scored = shared.stored(weighed.withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scored")
    able = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    by_score = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    # One row a whole-numbered score, whose range the gains and 32 bits bound: a small table, whatever the documents.
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    placed = by_score.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    cut = shared.stored(placed.filter("before < drawn"), "cut")
    # All drawn scores are at or above the lowest of them.
    lowest = cut.agg(F.min("score").alias("s")).first()["s"]
    plain = ("doc_id", "n_features", "weight", "score")
    if lowest is None:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    above = able & (F.col("score") >= F.lit(lowest))
    within = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    ranked = scored.filter(above).withColumn("nth", F.row_number().over(within)).join(shared.sized_broadcast(cut), "score")
    rank = F.col("before") + F.col("nth")
    drawn = ranked.select(*plain, F.when(rank <= F.col("drawn"), rank).alias("rank"))
    return drawn.unionByName(scored.filter(~F.coalesce(above, F.lit(False))).select(*plain, F.lit(None).cast("long").alias("rank")))


#: The same rows by SQL, for single words, 10,000 buckets, seed 2024 and 10 per cent of documents with 20 words and more.
ORACLE_SQL = r"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS entry
), word_rows AS (
  SELECT 0 AS side, doc_id AS id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) FROM benchmark
), vocabulary AS (
  SELECT DISTINCT w, hex(encode(w)) AS h FROM word_rows
), coded AS (
  SELECT w, list_transform(range(len(h) // 2), lambda i: (('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)) AS bytes FROM vocabulary
), hashed AS (
  SELECT w, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, entry[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM coded, polynomial
), rows_of AS (
  SELECT side, id, bucket FROM word_rows JOIN hashed USING (w)
), counts AS (
  SELECT b AS bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM range(10000) r(b) LEFT JOIN rows_of ON bucket = b GROUP BY b
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS g FROM counts
), weighed AS (
  SELECT id, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight FROM rows_of JOIN gain USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weighed ON id = doc_id
), able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 10 * n // 100 THEN nth END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""
