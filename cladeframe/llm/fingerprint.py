"""Document fingerprints by a randomised edit embedding.

A walk reads a text's characters: at step j it writes the character under its pointer
and moves on by a random bit that depends on j and that character, shared by all
texts. Texts at a small edit distance fall back into step after each edit, so their
walks differ in few places: edit distance becomes Hamming distance. A fingerprint is a
sample of the walk: steps are parted into blocks of 2**level, one random step of each
is kept (nested: a coarser level keeps one of two neighbours' steps), written as one
hexadecimal digit from 1 to f of the character's hash. The level grows with the text, so fingerprints
have 128 to 384 digits, and fingerprints of different levels are compared at the coarser.

Near documents are found by bands: sampled digits make bucket keys, and all pairs that
share a bucket are verified by their likeness. Banding is a chance method: of pairs at
the wanted likeness about one in a thousand shares no bucket, fewer of nearer ones.

Cases: null and empty texts have the fingerprint ``00`` without digits, alike (1.0)
only to each other; equal texts have equal fingerprints; very long texts are walked to
their end; rows of equal id follow each other by their text's hash; other columns are
ignored; an empty table gives no rows, a single document is followed by itself.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import meetings, shared, text
from cladeframe.llm.tokens import bucket_of, splitters

DIGITS = 256  # digits at most for the expected two steps a character
PERIOD = 4096  # steps after which the walk's random bits recur
GROUP_CHARS = 24 << 20  # characters that are walked together
STEPS = 1 << 16  # steps whose levels are worked out together, at least
_rng = np.random.default_rng(71)
_BITS = _rng.integers(0, 2, PERIOD * 256, dtype=np.uint8)
_DIGIT = _rng.integers(1, 16, 256, dtype=np.uint8)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def level_of(n_chars: np.ndarray | int) -> np.ndarray:
    steps = np.maximum(2 * np.asarray(n_chars, np.int64), 1)
    return np.maximum(np.ceil(np.log2(steps / DIGITS)), 0).astype(np.int64)


def _child(level: int, block: np.ndarray) -> np.ndarray:
    """The block of the level below whose step a block keeps."""
    return 2 * block + (text.mix(block.astype(np.uint64) * np.uint64(64) + np.uint64(level)) & np.uint64(1)).astype(np.int64)


def kept_level(begin: int, steps: int, top: int) -> np.ndarray:
    """Per step from ``begin`` the highest level, up to ``top``, whose blocks keep it; both numbers are multiples of 2**top."""
    out = np.zeros(steps, np.int8)
    position = np.arange(steps)
    for level in range(1, top + 1):
        below = begin >> (level - 1)
        position = position[_child(level, np.arange(begin >> level, (begin + steps) >> level)) - below]
        out[position] = level
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of texts, all walked at once: a step is a few vector operations."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-n, kind="stable")
    n_sorted = n[order]
    live = int(np.count_nonzero(n_sorted))
    level = level_of(n_sorted)
    data = np.zeros(int(n.sum()) + 80, np.uint8)
    begin = np.cumsum(n_sorted) - n_sorted
    for k, i in enumerate(order[:live].tolist()):
        code = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        data[begin[k] : begin[k] + n_sorted[k]] = code ^ (code >> 8) * np.uint32(151)
    top = int(level[0]) if live else 0
    ahead = max(STEPS, 1 << top)  # steps whose levels are known at a time
    keeps = np.zeros(0, np.int8)
    # Documents by falling level: a step of level z is kept by the last ones, of level z or less.
    from_row = [int(np.searchsorted(-level, -z, "left")) for z in range(top + 2)]
    pointer, end = begin[:live].copy(), (begin + n_sorted)[:live]
    digits = np.zeros((live, 2 * DIGITS), np.uint8)
    count = np.zeros(live, np.int64)
    rows = np.arange(live)
    first = from_row.copy()
    for j in itertools.count():
        if j & 63 == 0:
            on = pointer < end
            if not on.all():
                pointer, end, rows = pointer[on], end[on], rows[on]
                first = [int(np.searchsorted(rows, r)) for r in from_row]
            if not len(rows):
                break
            if j % ahead == 0:
                keeps = kept_level(j, ahead, top)
            if count[rows].max() + 64 > digits.shape[1]:  # a slower walk than most
                digits = np.hstack([digits, np.zeros_like(digits)])
        c = data[pointer]
        a = first[keeps[j % ahead]]
        if a < len(rows):
            r = rows[a:]
            ok = pointer[a:] < end[a:]
            if not ok.all():
                r = r[ok]
                digits[r, count[r]] = _DIGIT[c[a:][ok]]
            else:
                digits[r, count[r]] = _DIGIT[c[a:]]
            count[r] += 1
        # A walk that has ended runs on over the next text until it is taken out; nothing more is kept of it.
        pointer += _BITS[(j & PERIOD - 1) * 256 : (j & PERIOD - 1) * 256 + 256][c]
    out = ["00"] * len(texts)
    told = _HEX[digits]
    for k, i in enumerate(order[:live].tolist()):
        out[i] = f"{level[k]:02x}" + told[k, : count[k]].tobytes().decode()
    return out


def _coarser(digits: bytes, level: int, to: int) -> bytes:
    if level == to or not digits:
        return digits
    block = np.arange((len(digits) >> (to - level)) + 1)
    for k in range(to, level, -1):
        block = _child(k, block)
    own = np.frombuffer(digits, np.uint8)
    return own[block[block < len(own)]].tobytes()


def likeness(a: str, b: str) -> float:
    """Part of the kept steps, at the coarser level, that agree."""
    if a == b:
        return 1.0
    la, lb = int(a[:2], 16), int(b[:2], 16)
    top = max(la, lb)
    x, y = np.frombuffer(_coarser(a[2:].encode(), la, top), np.uint8), np.frombuffer(_coarser(b[2:].encode(), lb, top), np.uint8)
    m = min(len(x), len(y))
    return float(np.count_nonzero(x[:m] == y[:m])) / max(len(x), len(y), 1)


def edited(own: str, following: str) -> str:
    """The last half of the characters replaced by as many first ones of the next text."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _group(rows: list[tuple[int | None, str]], last: str) -> pa.RecordBatch:
    """Of documents in order and the text that follows them."""
    texts = [t for _, t in rows]
    changed = [edited(t, u) for t, u in zip(texts, [*texts[1:], last], strict=True)]
    prints = fingerprints([*texts, last, *changed])
    own, after, new = prints[: len(texts)], prints[1 : len(texts) + 1], prints[len(texts) + 1 :]
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(own), pa.array(new), pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)]), pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)])],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task in falling order of id; those marked as guests come last: the first of them follows the last document."""
    held: list[tuple[int | None, str]] = []
    chars = 0
    guest = None
    for batch in batches:
        for i, t, is_guest in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("guest").to_pylist(), strict=True):
            if is_guest:
                guest = t if guest is None else guest
                continue
            if chars > GROUP_CHARS:
                yield _group(held, t)
                held, chars = [], 0
            held.append((i, t))
            chars += 2 * len(t)
    if held:
        yield _group(held, held[0][1] if guest is None else guest)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half comes from the next document in falling order of id (after the last: the first).

    Ranges of ids are dealt to tasks; a task's last document is followed by a copy of the
    next range's first, so one row a range, and no more, is sent twice.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    at = splitters(own, "doc_id", shared.parallelism(docs))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).withColumn("bucket", bucket_of("doc_id", at))
    tops = sorted(((r["bucket"], r["top"]) for r in ids.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()), reverse=True)  # a row a task
    guests = [(tops[(k + 1) % len(tops)][1], b) for k, (b, _) in enumerate(tops)]
    guest_of = docs.sparkSession.createDataFrame(guests, "doc_id long, bucket int")
    rows = own.select("doc_id", "text", bucket_of("doc_id", at).alias("bucket"), F.lit(False).alias("guest"))
    extra = own.join(F.broadcast(guest_of), own["doc_id"].eqNullSafe(guest_of["doc_id"])).select(own["doc_id"], "text", "bucket", F.lit(True).alias("guest"))
    dealt = rows.unionByName(extra).repartitionById(len(at) + 1, F.col("bucket"))
    ordered = dealt.sortWithinPartitions(F.col("guest"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return ordered.select("doc_id", "text", "guest").mapInArrow(_chained, SCHEMA)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        row, limit = 0, len(texts)
        while row < limit:
            end, chars = row, 0
            while end < limit and (end == row or chars + len(texts[end]) <= GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[row:end], pa.array(fingerprints(texts[row:end]))], names=["doc_id", "fingerprint"])
            row = end


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(_printed, "doc_id long, fingerprint string")


BAND_DIGITS = 12  # digits of a key: unrelated texts agree in a fourth of theirs at most, so they rarely share one
MISSED = 0.001  # chance that texts whose digits agree as often as wanted share no key


def _ranges(n: int, least: float) -> list[int]:
    """Lengths, steps of 5 to 4, that samples of n digits and of as few as ``least`` of them have in common."""
    out, r = [], 1.0
    while r < n + 1:
        out.append(int(r))
        r *= 1.25
    below = int(np.searchsorted(out, max(1, int(np.ceil(least * n))), "right")) - 1
    return sorted(set(out[max(below, 0) :]))


@functools.lru_cache(maxsize=1024)
def _places(r: int, least: float) -> np.ndarray:
    bands = int(np.ceil(np.log(MISSED) / np.log1p(-(min(least, 0.999) ** BAND_DIGITS))))
    return np.random.default_rng(r).integers(0, r, (bands, BAND_DIGITS))


def band_keys(fingerprint: str, least: float = 0.8) -> np.ndarray:
    """Keys of sampled digits, at the fingerprint's level and, if a neighbour may be longer, the next."""
    level, digits = int(fingerprint[:2], 16), fingerprint[2:].encode()
    out = []
    for to in (level, level + 1):
        own = np.frombuffer(_coarser(digits, level, to), np.uint8)
        if to > level and len(own) < least * (DIGITS // 2 - 32):  # texts of the next level have half of DIGITS or more
            continue
        for r in _ranges(len(own), least):
            at = _places(r, least)
            h = np.full(len(at), to * 1024 + r, np.uint64) << np.uint64(20) | np.arange(len(at), dtype=np.uint64)
            for k in range(BAND_DIGITS):
                h = text.mix(h + own[at[:, k]])
            out.append(h)
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def _banded(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(f, least) for f in batch.column("fingerprint").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.list_array(np.concatenate([np.zeros(0, np.int64), *keys]), ends)], names=["doc_id", "keys"])

    return run


class _Digits:
    """Fingerprints of a bucket as matrices, one a level at which they are compared."""

    def __init__(self, prints: list[str]):
        self.level = np.array([int(f[:2], 16) for f in prints])
        self.digits = [f[2:].encode() for f in prints]
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _matrix(self, to: int) -> tuple[np.ndarray, np.ndarray]:
        if to not in self.at:
            own = [np.frombuffer(_coarser(d, z, to), np.uint8) if z <= to else np.zeros(0, np.uint8) for d, z in zip(self.digits, self.level.tolist(), strict=True)]
            size = np.array([len(x) for x in own])
            table = np.zeros((len(own), max(int(size.max()), 1)), np.uint8)  # no digit is 0
            for row, x in zip(table, own, strict=True):
                row[: len(x)] = x
            self.at[to] = table, size
        return self.at[to]

    def likeness(self, i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others))
        top = np.maximum(self.level[i], self.level[others])
        for to in np.unique(top).tolist():
            table, size = self._matrix(to)
            j = others[top == to]
            same = ((table[j] == table[i]) & (table[i] > 0)).sum(1)
            out[top == to] = same / np.maximum(np.maximum(size[j], size[i]), 1)
        return out


def _linked(least: float):
    """Of groups in the order of their gid: links that connect something new, after every pair that isn't yet connected was verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = meetings.Forest()
        for table in meetings.grouped(batches, "gid"):
            gid, doc, comp, side = (table.column(c).to_numpy() for c in ("gid", "doc_id", "comp", "side"))
            prints, links = table.column("fingerprint").to_pylist(), []
            for s, z in zip(*(x.tolist() for x in meetings.runs(gid)), strict=True):
                own = _Digits(prints[s : s + z])
                ids, comps, sides = doc[s : s + z].tolist(), comp[s : s + z].tolist(), side[s : s + z].tolist()
                for i in range(1, z):
                    mine = trees.root(comps[i])
                    others = np.array([j for j in range(i) if trees.root(comps[j]) != mine and (not sides[i] or sides[i] != sides[j])], np.int64)
                    while len(others):
                        # The first link of a connected group makes its other pairs needless.
                        part, others = others[:64], others[64:]
                        for j in part[own.likeness(i, part) >= least].tolist():
                            if trees.join(comps[i], comps[j]):
                                links.append((ids[j], ids[i]))
                                mine = trees.root(comps[i])
                                others = np.array([k for k in others.tolist() if trees.root(comps[k]) != mine], np.int64)
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id: the smallest id that verified band matches reach.

    Equal fingerprints are one class from the start. All members of a bucket are held
    against each other, but for pairs that links connect already, so a bucket of near
    copies costs a pass; hot buckets are cut as in ``meetings``. Rows without an id have
    the class of their fingerprint, which they never name.
    """
    n_parts = shared.parallelism(prints)
    classes = shared.stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "fingerprint").filter("doc_id is not null")
    keyed = reps.mapInArrow(text.released(_banded(least)), "doc_id long, keys array<long>").select(F.explode("keys").alias("tok"), "doc_id", F.lit(1).cast("long").alias("n"))

    def verify(groups: DataFrame) -> DataFrame:
        rows = groups.join(reps, "doc_id").select("gid", "doc_id", "comp", "side", "fingerprint").repartition(n_parts, "gid").sortWithinPartitions("gid")
        return rows.mapInArrow(text.released(_linked(least)), "a long, b long")

    comp = meetings.connected(meetings.meetings(keyed, n_parts), verify)
    if comp is None:
        return prints.join(classes, "fingerprint").select("doc_id", F.col("rep").alias("class_id"))
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("class_id"))
    return prints.join(named, "fingerprint").select("doc_id", "class_id")
