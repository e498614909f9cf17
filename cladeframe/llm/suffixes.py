"""Removal of byte strings that occur elsewhere, by a sorted array of sampled suffixes.

Every ``LENGTH``-byte string has one anchor: of the ``ANCHOR``-byte strings within it
that with the least hash, the leftmost of equals. Equal strings have equal anchors at
equal places, so only suffixes that start at anchors (about two in a hundred) are
sorted at first. A suffix is ordered by tokens, the hashes of its leading bytes: range
partitions take even ranges of the leading token, sort locally, and equal neighbours
are repeats; blocks send sorted runs of distinct tokens with counts, so equal tokens
never straddle a boundary and a hot string is one entry a block.

1. Per anchor two tokens: the anchor's bytes, and the span of all strings that have this
   anchor. A span that repeats settles all its strings; an anchor that is alone has none.
2. Where an anchor repeats more often than its span, all its strings' tokens are sorted.

A string repeats if its token has a count of 2 or more. Tokens have 64 bits.

Cases: null and empty texts have no bytes; texts shorter than a string keep all of
theirs; strings never cross documents; occurrences in one document count, overlapping
ones too; repeated rows are copies of each other; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeframe.llm import exchange, shared, text

LENGTH = 200
ANCHOR = 100
SLICE = 1 << 20
U64 = np.uint64


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@dataclass
class Anchors:
    """Of a slice: first and last string by anchor (low, high), and the two tokens."""

    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    span: np.ndarray

    def starts(self, which: np.ndarray) -> np.ndarray:
        """String starts of chosen anchors."""
        n = self.high[which] - self.low[which] + 1
        return np.repeat(self.low[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def tokens(self, which: np.ndarray, length: int, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string starts, their tokens) of chosen anchors."""
        start = self.starts(which)
        if not len(start):
            return start, np.zeros(0, U64)
        return start, np.maximum(text.span_hash(text.prefix_sums(data), start, start + length, 3), U64(1))


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> Anchors:
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return Anchors(empty, empty, empty.astype(U64), empty.astype(U64))
    sums = text.prefix_sums(data)
    at = np.arange(n - anchor + 1)
    h = text.span_hash(sums, at, at + anchor, 1)
    bits = U64(max(24, int(n).bit_length()))
    ranked = (h >> bits << bits) | at.astype(U64)
    best = (_window_min(ranked, length - anchor + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    inside = np.zeros(len(best), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            inside[a : b - length + 1] = True
    start = np.flatnonzero(inside)
    if not len(start):
        return Anchors(empty, empty, empty.astype(U64), empty.astype(U64))
    own = best[start]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)])
    low = start[new]
    high = start[np.concatenate([new[1:], [True]])]
    place = own[new]
    span = text.mix(text.span_hash(sums, low, high + length, 2) + (place - low).astype(U64) * U64(1 << 20 | 1) + (high - low).astype(U64))
    # Anchors have small hashes, being the least of many: mixed anew, they spread evenly over the partitions.
    return Anchors(low, high, np.maximum(text.mix(h[place] + U64(5)), U64(1)), np.maximum(span, U64(1)))


def _slices(docs: list[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in docs:
        for first, last, data, offsets in text.string_slices(batch.column("text"), SLICE):
            yield batch.column("doc_id")[first:last], data, offsets


def _first_requests(length: int, anchor: int, layout: exchange.Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[], []]

        def told(block: int) -> Iterator[pa.RecordBatch]:
            for kind in (1, 2):
                value, count, _ = exchange.distinct(kept[kind - 1])
                yield from exchange.requests(block, kind, value, count, layout.n_parts)

        before = None
        for block, batch in exchange.cut(batches, layout.block):
            if before not in (None, block):
                yield from told(before)
            before = block
            for _, data, offsets in _slices([batch]):
                found = anchors_of(data, offsets, length, anchor)
                kept[0].append(found.anchor)
                kept[1].append(found.span)
        if before is not None:
            yield from told(before)

    return run


def _settled(answers: exchange.Answers, found: list[Anchors]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By slice and anchor: whether all its strings repeat, and whether they are to be sorted."""
    out, totals = [], []
    for kind, name in ((1, "anchor"), (2, "span")):
        value, _, inverse = exchange.distinct([getattr(f, name) for f in found])
        totals.append(answers.of(kind, value)[inverse])
    begin = 0
    for f in found:
        own = slice(begin, begin + len(f.low))
        begin += len(f.low)
        out.append((totals[1][own] >= 2, totals[0][own] > totals[1][own]))
    return out


def _second_requests(length: int, anchor: int, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers, packed in exchange.per_block(batches):
            slices = list(_slices([exchange.unpacked(x) for x in packed]))
            packed.clear()
            found = [anchors_of(data, offsets, length, anchor) for _, data, offsets in slices]
            tokens = [f.tokens(np.flatnonzero(expand), length, data)[1] for f, (_, expand), (_, data, _) in zip(found, _settled(answers, found), slices, strict=True)]
            del found, slices
            value, count, _ = exchange.distinct(tokens)
            yield from exchange.requests(block, 3, value, count, n_parts)

    return run


def _without(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, repeats: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of a slice, given the starts of its repeated strings."""
    n = len(data)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, repeats, 1)
    np.add.at(step, repeats + length, -1)
    gone = np.cumsum(step[:n]) > 0
    first = np.zeros(n + 1, bool)
    first[:n] = gone
    first[1:n] &= ~gone[:-1] if n else False
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = gone[edge]
    removed = np.concatenate([[0], np.cumsum(gone)])
    runs = np.concatenate([[0], np.cumsum(first[:n])])
    kept = [data[a:b][~gone[a:b]].tobytes() if removed[b] > removed[a] else data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(offsets)), pa.array(removed[offsets[1:]] - removed[offsets[:-1]]), pa.array(runs[offsets[1:]] - runs[offsets[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def _removed(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, answers, packed in exchange.per_block(batches):
            slices = list(_slices([exchange.unpacked(x) for x in packed]))
            packed.clear()
            found = [anchors_of(data, offsets, length, anchor) for _, data, offsets in slices]
            settled = _settled(answers, found)
            tokens = [f.tokens(np.flatnonzero(expand), length, data)[1] for f, (_, expand), (_, data, _) in zip(found, settled, slices, strict=True)]
            size = [len(t) for t in tokens]
            value, _, inverse = exchange.distinct(tokens)
            repeated = (answers.of(3, value) >= 2)[inverse]
            del value, inverse
            begin = 0
            for f, (whole, expand), n, (ids, data, offsets) in zip(found, settled, size, slices, strict=True):
                own = f.starts(np.flatnonzero(expand))[repeated[begin : begin + n]]
                begin += n
                yield _without(ids, data, offsets, np.concatenate([own, f.starts(np.flatnonzero(whole & ~expand))]), length)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", stable_scan: bool = False, block: int = exchange.BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: every byte under a ``length``-byte string that also starts elsewhere is removed.

    stable_scan: ``docs`` reads files directly, so all its readings have the same tasks. A task's memory follows ``block``, the bytes of text that are held together.
    """
    rows, layout = exchange.blocked(docs, id_col, text_col, stable_scan, block)
    first = shared.stored(exchange.totals(rows.mapInArrow(_first_requests(length, anchor, layout), exchange.REQUEST), layout.n_parts), "anchors")
    asked = exchange.together(rows, first, layout).mapInArrow(_second_requests(length, anchor, layout.n_parts), exchange.REQUEST)
    second = shared.stored(exchange.totals(asked, layout.n_parts), "strings")
    return exchange.together(rows, first.unionByName(second), layout).mapInArrow(_removed(length, anchor), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
