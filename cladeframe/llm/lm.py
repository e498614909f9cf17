"""Stupid-backoff language-model scores, computed relationally.

Counts of all n-grams up to the order live in tables partitioned by n-gram hash; the
documents' n-grams are joined to them and summed per document. Both sides travel
packed: a block (some MB of documents, see ``exchange``) sends each hash partition its
distinct n-grams with their counts as two byte strings, the partition adds up what all
blocks sent and answers with the totals in the same order, and the block, whose
documents are dealt to the same task as the answers, scores its documents. So a hot
n-gram is one entry a block, and no row is made per occurrence. What is gathered
grows with the corpus; nothing is sampled. Most n-grams of two and more words occur
once: a sieve of short hashes (see ``exchange``) finds those, whose count is 1, and the
others alone are sent in full.

Score of word i with history: count(w[i-2..i]) / count(w[i-2..i-1]) where that n-gram
was seen ``min_count`` times, else ``alpha`` times the score with a shorter history;
at last count(w[i]) / all words. A document's score is the sum of natural logarithms.

Cases: null and empty texts have 0 words, score 0.0 and a null mean; equal rows get
equal scores; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeframe.llm import exchange, shared, text

U64 = np.uint64
SCORED = "doc_id long, n_words long, log_score double, mean_log_score double"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])


def _gram_hashes(batch: pa.RecordBatch, order: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """Per slice (first row, end row, words by document, for n = 1..order the hash of the n-gram ending at each word, 0 where none fits)."""
    for first, last, data, offsets in text.string_slices(batch.column("text")):
        words = text.Words(data, offsets)
        place = np.arange(len(words.doc)) - words.first[words.doc]
        grams = [words.hash]
        for n in range(2, order + 1):
            h = np.zeros(len(place), U64)
            if len(place) >= n:
                h[1:] = text.mix(grams[-1][:-1] * U64(text._BASE) + words.hash[1:] + U64(n))
                h[place < n - 1] = 0
            grams.append(h)
        yield first, last, words.count, grams


def _requests(order: int, layout: exchange.Layout):
    """The leading bits of the n-grams of two and more words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in range(order)]

        def told(block: int) -> Iterator[pa.RecordBatch]:
            kept[0].clear()
            for n in range(1, order):
                short, _ = exchange.leading(exchange.distinct(kept[n])[0], layout.bits)
                yield from exchange.requests(block, n + 1, short, np.zeros(0, np.int32), layout.n_parts, layout.bits)
            text.give_back()

        before = None
        for block, batch in exchange.cut(batches, layout.block):
            if before not in (None, block):
                yield from told(before)
            before = block
            for *_, grams in _gram_hashes(batch, order):
                for n, h in enumerate(grams):
                    kept[n].append(h)
        if before is not None:
            yield from told(before)

    return run


def _gathered(docs: list[bytes], order: int) -> tuple[list[pa.Array], list[np.ndarray], list[list[np.ndarray]]]:
    """ids, numbers of words and n-grams of a block's slices."""
    ids, lengths, kept = [], [], [[] for _ in range(order)]
    docs.reverse()
    while docs:
        batch = exchange.unpacked(docs.pop())
        for first, last, count, grams in _gram_hashes(batch, order):
            ids.append(batch.column("doc_id")[first:last])
            lengths.append(count)
            for n, h in enumerate(grams):
                kept[n].append(h)
    return ids, lengths, kept


def _passed(order: int, layout: exchange.Layout):
    """The words, and the longer n-grams that may occur twice in all, with their counts."""

    def run(block: int, answers: exchange.Answers, docs: list[bytes]) -> Iterator[pa.RecordBatch]:
        *_, kept = _gathered(docs, order)
        for n in range(order):
            value, count, _ = exchange.distinct(kept[n])
            if n:
                short, at = exchange.leading(value, layout.bits)
                passed = answers.flags(n + 1, len(short))[at] | (count > 1)
                yield exchange.noted(block, n + 1, passed, layout.n_parts)
                value, count = value[passed], count[passed]
            yield from exchange.requests(block, n + 1, value, count, layout.n_parts)

    return run


def _score(order: int, min_count: int, alpha: float):
    penalty = float(np.log(alpha))

    def finish(ids: list[pa.Array], lengths: list[np.ndarray], kept: list[list[np.ndarray]], answers: exchange.Answers) -> pa.RecordBatch:
        length = np.concatenate(lengths)
        first = np.concatenate([[0], np.cumsum(length)])
        n_words = int(first[-1])
        place = (np.arange(n_words) - np.repeat(first[:-1], length)).astype(np.int32)
        score = shorter = np.zeros(0)
        for n in range(order):  # one order at a time: what is done with is freed
            value, _, inverse = exchange.distinct(kept[n])
            kept[n] = []
            known = np.ones(len(value) + 1, np.int64)
            known[-1] = 0  # no n-gram
            passed = np.flatnonzero(answers.flags(-n - 1, len(value))) if n else np.arange(len(value))
            known[passed] = answers.of(n + 1, passed)[:-1]
            total = known[inverse]
            del value, inverse, known, passed
            with np.errstate(divide="ignore", invalid="ignore"):
                log = np.log(total)
                if n == 0:
                    score = log - np.log(max(answers.sum(1), 1))
                else:
                    # A history that does not fit in the document costs no penalty.
                    score[place >= n] += penalty
                    seen = np.flatnonzero(total[1:] >= min_count) + 1
                    score[seen] = log[seen] - shorter[seen - 1]
            shorter = log
            del total
        sums = np.zeros(len(length))
        has = length > 0
        if has.any():
            sums[has] = np.add.reduceat(score, first[:-1][has])
        mean = pa.array(np.where(has, sums / np.maximum(length, 1), 0.0), mask=~has)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(length.astype(np.int64)), pa.array(sums), mean], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    def run(block: int, answers: exchange.Answers, docs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, lengths, kept = _gathered(docs, order)
        if ids:
            yield finish(ids, lengths, kept, answers)

    return run


def stupid_backoff(docs: DataFrame, order: int = 3, min_count: int = 2, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text", stable_scan: bool = False, block: int = exchange.BLOCK) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every document under the model of all of them.

    stable_scan: ``docs`` reads files directly, so both its readings have the same tasks;
    otherwise it is stored first. A task's memory follows ``block``, the bytes of text that are counted together.
    """
    rows, layout = exchange.blocked(docs, id_col, text_col, stable_scan, block)
    passes = exchange.shared_keys(rows.mapInArrow(text.released(_requests(order, layout)), exchange.REQUEST), layout.n_parts)
    own = exchange.dealt(rows, layout)
    answers = exchange.totals(exchange.met(own, passes, layout, _passed(order, layout), exchange.REQUEST, exchange.REQUEST_ARROW), layout.n_parts)
    return exchange.met(own, answers, layout, _score(order, min_count, alpha), SCORED, SCORED_ARROW)


#: The same scores by plain SQL, for order 3, min_count 2, alpha 0.4.
ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
  SELECT doc_id, i, c, lag(c) OVER d AS b, lag(c, 2) OVER d AS a FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), n1 AS (SELECT c, count(*) AS k FROM grams GROUP BY c),
n2 AS (SELECT b, c, count(*) AS k FROM grams WHERE i >= 2 GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS k FROM grams WHERE i >= 3 GROUP BY a, b, c),
total AS (SELECT count(*) AS k FROM words),
scored AS (
  SELECT g.doc_id, CASE WHEN g.i >= 3 AND t.k >= 2 THEN ln(t.k) - ln(h.k) ELSE (CASE WHEN g.i >= 3 THEN ln(0.4) ELSE 0 END)
    + CASE WHEN g.i >= 2 AND e.k >= 2 THEN ln(e.k) - ln(p.k) ELSE (CASE WHEN g.i >= 2 THEN ln(0.4) ELSE 0 END) + ln(u.k) - ln(total.k) END END AS s
  FROM grams g CROSS JOIN total JOIN n1 u ON u.c = g.c LEFT JOIN n1 p ON p.c = g.b LEFT JOIN n2 e ON e.b = g.b AND e.c = g.c
  LEFT JOIN n2 h ON h.b = g.a AND h.c = g.b LEFT JOIN n3 t ON t.a = g.a AND t.b = g.b AND t.c = g.c
), summed AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 4) AS log_score, round(s / nullif(len(w), 0), 4) AS mean_log_score
FROM split LEFT JOIN summed USING (doc_id)
"""
