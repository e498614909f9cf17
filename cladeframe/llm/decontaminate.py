"""Benchmark decontamination by template canonicalisation.

Words of documents and of benchmark items are brought to a template: numbers, names
(capitalised words within a sentence) and units after numbers become typed
placeholders, everything else is lower-cased. Windows of template words are joined
by hash; where a window's placeholders hold other values than the item's, the values
must replace each other consistently (one document value for each item value, and the
reverse), so a question with other numbers or names is caught, and text that merely
has the same shape is not. Of values that contradict each other those in most windows
win. Windows of the lower-cased words themselves are joined too: a verbatim window
counts whatever its words are.

A document is contaminated by an item if its consistent windows are at least
``min_cover`` of the item's windows, or of those of them that are dense (``MIN_WORDS``
literal words or more), or ``min_windows`` that are dense or verbatim. In all, the windows must hold ``MIN_WORDS``
words that are equal in both. An item shorter than a window is one window of all its
words; one of fewer than ``MIN_WORDS`` words is found where exactly its words stand in a row.

Cases: null and empty texts match nothing; repeated items each match; other columns
are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import text

U64 = np.uint64
WINDOW = 8
MIN_WORDS = 5  # equal words that windows hold at least in all, or they say too little
BROADCAST_WINDOWS = 1_000_000  # beyond, windows are joined by shuffle

# Units that follow a number.
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg t oz lb lbs ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent euro euros dollar dollars usd eur pound pounds cent cents kmh mph w kw v a hz khz mhz ghz kb mb gb tb".split()

_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_GAP = np.array([b in b" \t\r'\"(),;" for b in range(256)])
_NUMBER, _UNIT, _NAME = (text.mix(np.array([k], U64))[0] for k in (11, 12, 13))


def _word_hash(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    return text.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), separators=text.NOT_ALNUM).hash


class Template:
    """Template words of a slice of texts: kind (0 literal, 1 number, 2 unit, 3 name), code (hash of the template word),
    value (hash of what stands there), doc, place (of the word in its text) and first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, units: np.ndarray):
        words = text.Words(data, offsets, separators=text.NOT_ALNUM)
        start, end, n = words.start, words.end, len(words.start)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        number = (digits[end] - digits[start]) == end - start
        # 1,000 and 3.5 are one number: a later part follows its former by one comma or stop.
        joined = np.zeros(n, bool)
        if n > 1:
            joined[1:] = number[1:] & number[:-1] & (start[1:] == end[:-1] + 1) & np.isin(data[end[:-1].clip(max=max(len(data) - 1, 0))], [44, 46]) & (words.doc[1:] == words.doc[:-1])
        keep = ~joined
        last = np.append(np.flatnonzero(keep)[1:], n) - 1
        start, end, doc, number = start[keep], end[last] if n else end, words.doc[keep], number[keep]
        value = text.span_hash(text.prefix_sums(words.data), start, end) if n else np.zeros(0, U64)
        # A name is capitalised and follows another word of its sentence.
        between = np.concatenate([[0], np.cumsum(~_GAP[data])])
        follows = np.zeros(len(start), bool)
        if len(start) > 1:
            follows[1:] = (doc[1:] == doc[:-1]) & (between[start[1:]] == between[end[:-1]])
        name = _UPPER[data[start]] & follows if len(start) else follows
        unit = np.zeros(len(start), bool)
        if len(start) > 1:
            unit[1:] = number[:-1] & follows[1:] & np.isin(value[1:], units)
        self.kind = np.select([number, unit, name], [1, 2, 3], 0)
        self.code = np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], value)
        self.value, self.doc = value, doc
        self.first = np.searchsorted(doc, np.arange(len(offsets)))
        self.place = np.arange(len(doc)) - self.first[doc] if len(doc) else doc

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, is template) of every whole window: of its words, and if it has slots and a literal word of its template."""
        total = max(len(self.code) - width + 1, 0)
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)
        whole = self.doc[:total] == self.doc[width - 1 :]
        literal = np.concatenate([[0], np.cumsum(self.kind == 0)])
        literal = literal[width:] - literal[:total]
        out = []
        for words, ok in ((self.value, whole), (self.code, whole & (literal > 0) & (literal < width))):
            h = np.zeros(total, U64)
            for j in range(width):
                h = h * U64(text._BASE) + words[j : j + total]
            at = np.flatnonzero(ok)
            out.append((at, text.mix(h[at] + U64(width))))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.repeat([False, True], [len(x[0]) for x in out])


def _emitter(key: str, widths: list[int], only: np.ndarray | None, whole_short: bool, longest: int):
    """Rows (key, width, place, window, slots, n_windows) of texts; ``only``: sorted hashes that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = np.sort(_word_hash(UNITS))
        for batch in batches:
            for first, last, data, offsets in text.string_slices(batch.column("text")):
                t = Template(data, offsets, units)
                size = np.diff(t.first)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
                for width in widths:
                    at, h, template = t.windows(width)
                    if width < MIN_WORDS:  # so few words must be the item's own
                        at, h, template = at[~template], h[~template], template[~template]
                    if whole_short and width < longest:  # a short item is one window of its own width
                        ok = size[t.doc[at]] == width
                        at, h, template = at[ok], h[ok], template[ok]
                    if only is not None and len(at):
                        ok = only[np.searchsorted(only, h).clip(max=len(only) - 1)] == h
                        at, h, template = at[ok], h[ok], template[ok]
                    if len(at):
                        out.append((at, h, template, width))
                if not out:
                    continue
                at, h, template = (np.concatenate([x[k] for x in out]) for k in range(3))
                width = np.concatenate([np.full(len(x[0]), x[3]) for x in out])
                slots = []
                for a, w, filled in zip(at.tolist(), width.tolist(), template.tolist(), strict=True):
                    slots.append(np.where(t.kind[a : a + w] > 0, t.value[a : a + w], U64(0)).view(np.int64).tolist() if filled else None)
                doc = t.doc[at]
                count = np.bincount(doc[~template], minlength=last - first)
                literal = np.concatenate([[0], np.cumsum(t.kind == 0)])
                dense = literal[at + width] - literal[at] >= np.minimum(MIN_WORDS, width)
                n_dense = np.bincount(doc[~template & dense], minlength=last - first)
                ids = batch.column("key")[first:last].take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(t.place[at].astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(slots, pa.list_(pa.int64())), pa.array(dense), pa.array(count[doc].astype(np.int64)), pa.array(n_dense[doc].astype(np.int64))], names=[key, "place", "width", "window", "slots", "dense", "n_windows", "n_dense"])

    return run


def _consistent(matches: list[dict]) -> list[dict]:
    """Matches whose slots keep to one mapping: of an item's value the document's that most windows hold, and the reverse."""
    votes: dict[tuple[int, int], list] = {}
    for m in matches:
        for pair in m["pairs"]:
            votes.setdefault(pair, [set(), m["d"]])[0].add(m["i"])
            votes[pair][1] = min(votes[pair][1], m["d"])
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    # Equal votes: the earlier place in the document, so that all slots follow the same copy.
    for b, d in sorted(votes, key=lambda p: (-len(votes[p][0]), votes[p][1], p)):
        if b not in there and d not in back:
            there[b], back[d] = d, b
    return [m for m in matches if all(there.get(b) == d for b, d in m["pairs"])]


def _judged(min_cover: float, min_windows: int):
    """Of the windows that a document and an item share: the row of those that contaminate."""

    def judge(rows: list[dict], item_windows: int, item_dense: int) -> tuple[int, int, int] | None:
        matches = []
        for r in rows:
            theirs, own = r["i_slots"], r["d_slots"]
            filled = theirs is not None and own is not None
            pairs = {(b, d) for b, d in zip(theirs, own, strict=True) if b} if filled else set()
            equal = [k for k in range(r["width"]) if not filled or not theirs[k] or theirs[k] == own[k]]
            matches.append({"i": r["i_place"], "d": r["d_place"], "pairs": pairs, "equal": equal, "dense": r["dense"], "plain": not filled})
        shifts: dict[int, list[dict]] = {}
        for m in matches:
            shifts.setdefault(m["d"] - m["i"], []).append(m)
        best = None
        least = min(MIN_WORDS, max(r["width"] for r in rows))  # a short item is one window of all its words
        # The whole document, and each unbroken copy by itself: other copies can't outvote it.
        for group in ([matches, *shifts.values()] if len(shifts) > 1 else [matches]):
            good = _consistent(group)
            places = {m["i"] for m in good}
            dense = {m["i"] for m in good if m["dense"]}
            strong = {m["i"] for m in good if m["dense"] or m["plain"]}
            if not (len(places) >= max(1, math.ceil(min_cover * item_windows)) or len(dense) >= max(1, math.ceil(min_cover * item_dense)) or len(strong) >= min_windows):
                continue
            if len({m["i"] + k for m in good for k in m["equal"]}) >= least and (best is None or len(places) > best[0]):
                best = len(places), min(m["d"] for m in good), max(m["d"] for m in good)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (found := judge(r["w"], r["item_windows"], r["n_dense"])) is not None:
                    out.append((r["doc_id"], r["item_id"], found[0], r["item_windows"], found[1], found[2]))
            columns = list(zip(*out, strict=True)) or [()] * len(FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=FOUND)

    return run


FOUND = ["doc_id", "item_id", "n_windows", "item_windows", "first_word", "last_word"]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_cover: float = 0.5, min_windows: int = 12, window: int = WINDOW, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows (consistent ones), item_windows, first_word, last_word: one row a document and item that contaminates it."""
    own = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    items = benchmark.select(F.col(item_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    widths = list(range(1, window + 1))
    schema = "{} long, place int, width int, window long, slots array<long>, dense boolean, n_windows long, n_dense long"
    theirs = items.mapInArrow(text.released(_emitter("item_id", widths, None, True, window)), schema.format("item_id"))
    told = ", ".join(f"{c} long" for c in FOUND)
    if theirs.limit(1).isEmpty():
        return docs.sparkSession.createDataFrame([], told)
    widths = sorted(r["width"] for r in theirs.select("width").distinct().collect())
    distinct = theirs.select("window").distinct().limit(BROADCAST_WINDOWS + 1)
    found = [r["window"] for r in distinct.collect()]  # at most BROADCAST_WINDOWS + 1 numbers
    small = len(found) <= BROADCAST_WINDOWS
    only = np.sort(np.array(found, np.int64).view(U64)) if small else None
    ours = own.mapInArrow(text.released(_emitter("doc_id", widths, only, False, window)), schema.format("doc_id")).select("doc_id", "place", "window", "slots")
    # A window that a document repeats with the same values counts once, at its first place.
    ours = ours.groupBy("doc_id", "window", "slots").agg(F.min("place").alias("d_place")).withColumnRenamed("slots", "d_slots")
    theirs = theirs.select("item_id", "window", "width", F.col("place").alias("i_place"), F.col("slots").alias("i_slots"), "dense", "n_dense", F.col("n_windows").alias("item_windows"))
    pairs = ours.join(F.broadcast(theirs) if small else theirs, "window")
    grouped = pairs.groupBy("doc_id", "item_id").agg(F.first("item_windows").alias("item_windows"), F.first("n_dense").alias("n_dense"), F.collect_list(F.struct("i_place", "d_place", "width", "i_slots", "d_slots", "dense")).alias("w"))
    return grouped.mapInArrow(text.released(_judged(min_cover, min_windows)), told)
