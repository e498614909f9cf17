"""SimHash near-duplicates by anchor points of a covering code.

A document's fingerprint holds, for each of 64 bits, whether more than half of its word
shingles' XXH64 have it. Fingerprints that differ in at most ``LIMIT`` bits are linked.

Anchors are the code words of two binary Golay codes side by side, over 46 of the bits:
perfect codes, whose every word of 23 bits lies within 3 of exactly one code word. If two
fingerprints differ in at most 2 bits, the nearest anchor of one (within the radius) lies
within radius plus 2 of the other, counted over both halves. So each fingerprint is
replicated to every anchor in that reach (61 on average: its own plus error patterns of
equal syndrome), and at an anchor those at home there are compared with all that came.

Equal fingerprints are one row from the start. A crowded anchor (more than ``HOME_ROWS``
at home, as of a large group of near copies, or more than ``ANCHOR_ROWS`` in all) is left
out of the comparison; the fingerprints that came there meet at midpoints instead: each goes to itself and its 64
neighbours of one bit, and any two that differ in at most 2 bits share such a point, where
no more than 65 fingerprints can be and all of them are linked. So no task holds a large
group, and no group's pairs are written out: links form stars and forests.

Cases: null and empty texts, and texts without words, have the fingerprint zero, linked
like any other; a text of fewer words than a shingle is one shingle of all its words;
rows of one id are linked each by its own text; rows without an id are compared and never
name a component (null where no linked row has an id); very long texts are taken whole;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import graph, meetings, shared, text

SHINGLE = 3
SEED = 42
LIMIT = 2  # differing bits of linked fingerprints
RADIUS = 3  # of the Golay code
LENGTH = 23
GENERATOR = 0b101011100011  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
HOME_ROWS = 4096  # fingerprints at home at an anchor, beyond which it is crowded
ANCHOR_ROWS = 1 << 18  # and of all that come there
HASHES = 1 << 15  # shingles whose bits are summed at once
U64 = np.uint64


def shingle_bits(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a slice of texts."""
    words = text.Words(data, offsets)
    n = len(words.start)
    # Words with one blank after each stand in a buffer of their own; a shingle is a stretch of it.
    length = words.end - words.start
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(int(begin[-1]), 32, np.uint8)
    joined[np.arange(int(length.sum())) + np.repeat(np.arange(n), length)] = words.data[~text.SPACE[words.data]]
    last = np.minimum(np.arange(n) + k - 1, words.first[1:][words.doc] - 1)
    # A shingle starts at every word that has k - 1 after it, or at the first word of a short text.
    at = np.flatnonzero((last == np.arange(n) + k - 1) | ((words.count[words.doc] < k) & (np.arange(n) == words.first[words.doc])))
    raw = joined.tobytes()
    found = map(xxhash.xxh64_intdigest, map(raw.__getitem__, map(slice, begin[at].tolist(), (begin[last[at]] + length[last[at]]).tolist())), repeat(SEED))
    h = np.fromiter(found, U64, len(at))
    doc = words.doc[at]
    total = np.bincount(doc, minlength=len(offsets) - 1)
    ones = np.zeros((len(offsets) - 1, 64), np.int64)
    for a in range(0, len(h), HASHES):
        bits = np.unpackbits(h[a : a + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        start, _ = meetings.runs(doc[a : a + HASHES])
        ones[doc[a : a + HASHES][start]] += np.add.reduceat(bits, start, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").astype(U64)[:, 0]


def _fingerprinter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text.string_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], pa.array(shingle_bits(data, offsets, k).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a long) by row of ``docs``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(text.released(_fingerprinter(k)), "doc_id long, fp long")


@cache
def patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of up to RADIUS + LIMIT bits by syndrome: (first place by syndrome, pattern, bits beyond the radius, syndrome of each byte value at each of three places)."""

    def remainder(v: int) -> int:
        for bit in range(LENGTH - 1, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    of_bit = [remainder(1 << b) for b in range(LENGTH)]
    found = []
    for weight in range(RADIUS + LIMIT + 1):
        for places in combinations(range(LENGTH), weight):
            syndrome = 0
            for p in places:
                syndrome ^= of_bit[p]
            found.append((syndrome, sum(1 << p for p in places), max(0, weight - RADIUS)))
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    syndrome, pattern, beyond = (np.array(c, np.int64) for c in zip(*found, strict=True))
    table = np.zeros((3, 256), np.int64)
    for place in range(3):
        for byte in range(256):
            table[place, byte] = remainder(byte << 8 * place & (1 << LENGTH) - 1)
    return np.searchsorted(syndrome, np.arange(1 << 11)), pattern, beyond, table


def _near(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code word, bits beyond the radius) of every code word in reach of 23-bit words; a row's first is its nearest."""
    first, pattern, beyond, table = patterns()
    syndrome = table[0, block & 255] ^ table[1, block >> 8 & 255] ^ table[2, block >> 16]
    begin, end = first[syndrome], np.append(first, len(pattern))[syndrome + 1]
    row = np.repeat(np.arange(len(block)), end - begin)
    at = np.arange(len(row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[row]
    return row, block[row] ^ pattern[at], beyond[at]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of every anchor within radius plus LIMIT of fingerprints."""
    mask = (1 << LENGTH) - 1
    value = fp.view(U64)
    low = _near((value & U64(mask)).astype(np.int64))
    high = _near((value >> U64(LENGTH) & U64(mask)).astype(np.int64))
    # Every code word of the low half with those of the high half that the remaining reach allows.
    n_high = np.bincount(high[0], minlength=len(fp))
    first_high = np.cumsum(n_high) - n_high
    row = np.repeat(low[0], n_high[low[0]])
    other = np.arange(len(row)) - np.repeat(np.cumsum(n_high[low[0]]) - n_high[low[0]], n_high[low[0]]) + first_high[row]
    words, beyond = np.repeat(low[1], n_high[low[0]]), np.repeat(low[2], n_high[low[0]])
    beyond = beyond + high[2][other]
    keep = beyond <= LIMIT
    row, other = row[keep], other[keep]
    return row, words[keep] << LENGTH | high[1][other], beyond[keep] == 0


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = batch.column("fp").to_numpy()
        for a in range(0, len(whole), 2048):
            fp = whole[a : a + 2048]
            row, anchor, home = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of fingerprints: at every anchor those at home there against all that came."""
    trees = meetings.Forest()
    for table in meetings.grouped(batches, "anchor"):
        anchor, fp, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "home"))
        start, size = meetings.runs(anchor)
        met = (size > 1) & (np.add.reduceat(home.astype(np.int64), start) > 0)
        links: list[tuple[int, int]] = []
        for s, z in zip(start[met].tolist(), size[met].tolist(), strict=True):
            own = fp[s : s + z]
            at_home = np.flatnonzero(home[s : s + z])
            label = np.arange(z)  # of those that are linked at this anchor
            for a in range(0, len(at_home), 64):
                rows = at_home[a : a + 64]
                near = np.bitwise_count(own[rows, None].view(U64) ^ own[None, :].view(U64)) <= LIMIT
                for i in np.flatnonzero(near.sum(1) > 1).tolist():
                    x, others = rows[i], np.flatnonzero(near[i])
                    for other in np.unique(label[others]).tolist():
                        if other != label[x]:
                            y = others[label[others] == other][0]
                            if trees.join(int(own[x]), int(own[y])):
                                links.append((int(own[x]), int(own[y])))
                            label[label == other] = label[x]
        if links:
            one, other = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], names=["a", "b"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint at itself and at its neighbours of one bit."""
    flips = np.concatenate([[U64(0)], U64(1) << np.arange(64, dtype=U64)])
    for batch in batches:
        whole = batch.column("fp").to_numpy()
        for a in range(0, len(whole), 4096):
            fp = whole[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array((fp.view(U64)[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(fp, 65))], names=["point", "fp"])


def links(distinct: DataFrame, home_rows: int = HOME_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(a, b), a < b: enough links of the distinct fingerprints ``fp`` to connect all that are within LIMIT, directly or by others."""
    n = shared.parallelism(distinct)
    replicas = distinct.select("fp").mapInArrow(_replicas, "anchor long, fp long, home boolean")
    at_anchor = replicas.groupBy("anchor").agg(F.count("*").alias("came"), F.count_if("home").alias("home"))
    crowded = shared.stored(at_anchor.filter((F.col("came") > anchor_rows) | (F.col("home") > home_rows)).select("anchor"), "crowded")
    few = replicas.join(shared.sized_broadcast(crowded), "anchor", "left_anti")
    met = few.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(text.released(_compared), "a long, b long")
    there = shared.stored(replicas.join(shared.sized_broadcast(crowded), "anchor", "left_semi").select("fp").distinct(), "there")
    # At a point there are 65 fingerprints at most: all within one bit of it.
    at = there.mapInArrow(_points, "point long, fp long").groupBy("point").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = at.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b").distinct()
    return met.unionByName(stars)


def simhash_components(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", home_rows: int = HOME_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id by row of ``docs``."""
    rows = shared.stored(fingerprints(docs, k, id_col, text_col), "fingerprints")
    distinct = shared.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = shared.stored(graph.components(links(distinct, home_rows, anchor_rows)), "components")
    linked = shared.stored(found.join(distinct.withColumnRenamed("fp", "node"), "node"), "linked")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = shared.joined_by_key(linked, names, "component").select(F.col("node").alias("fp"), "component_id")
    alone = distinct.join(named, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    classes = shared.stored(named.unionByName(alone), "classes")
    return shared.joined_by_key(rows, classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
