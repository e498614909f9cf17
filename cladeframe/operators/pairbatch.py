"""One dynamic program over a batch of pairs: rows x pairs x columns, with a traceback of all pairs at once.

A step of the program handles one row of every pair's matrix as numpy arrays (pairs
stand next to each other), so its cost in Python is shared by the batch. Only one byte of
flags a cell is kept (where its best, its left and its up values come from); values live
for two rows. Pairs of about equal lengths go together, within ``CELLS`` cells a batch, so
memory is bounded. Scores are scaled to whole numbers, so equal values are equal.

A pair may be held to a band of diagonals: then columns are places in the band, and the
work is the query's length times the band's width, whatever the reference's length.

Gaps: the first character costs ``gap_open``, further ones ``gap_extend``. Of equal
alignments a column of two residues is preferred to a gap, a gap in the query to one in
the reference.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

CELLS = 1 << 24
PAIRS = 1024
STAY, LEFT, UP = 0, 1, 2
# Flags of a cell.
BEST_STAY, BEST_LEFT, LEFT_ON, LEFT_STAY, UP_ON, UP_STAY, END = (1 << k for k in range(7))
LOW = -1e18
SCALES = (1, 2, 4, 10, 20, 100, 1000, 10_000)


@dataclass(frozen=True)
class Costs:
    """Scores of symbol codes: ``matrix[q, r]``, or match and mismatch with codes in ``wild`` scoring 0."""

    match: float = 0.0
    mismatch: float = 0.0
    gap_open: float = -5.0
    gap_extend: float = -1.0
    matrix: np.ndarray | None = None
    wild: tuple[int, ...] = ()

    def scaled(self) -> tuple[float, Costs]:
        """A factor that makes all scores whole numbers, and those scores."""
        said = np.array([self.match, self.mismatch, self.gap_open, self.gap_extend, *([] if self.matrix is None else self.matrix.ravel())])
        by = next((k for k in SCALES if (np.abs(said * k - np.rint(said * k)) < 1e-6).all()), None)
        if by is None:
            raise ValueError(f"scores have more than {len(str(SCALES[-1])) - 1} decimals")
        whole = lambda x: float(np.rint(x * by))
        return by, Costs(whole(self.match), whole(self.mismatch), whole(self.gap_open), whole(self.gap_extend), None if self.matrix is None else np.rint(self.matrix * by), self.wild)

    def kind(self, length: int) -> type:
        """Whole numbers below 2**24 are exact in four bytes."""
        most = max(abs(self.match), abs(self.mismatch), abs(self.gap_open), abs(self.gap_extend), 0 if self.matrix is None else float(np.abs(self.matrix).max()))
        return np.float32 if most * (length + 2) < 1 << 23 else np.float64


@dataclass(frozen=True)
class Path:
    """score, first and end places (from 0, end exclusive) on query and reference, and the steps between."""

    score: float
    query: tuple[int, int]
    ref: tuple[int, int]
    steps: np.ndarray

    def rows(self, query: np.ndarray, ref: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """Both aligned code strings."""
        a, b = np.full(len(self.steps), gap, query.dtype), np.full(len(self.steps), gap, ref.dtype)
        a[self.steps != LEFT] = query[slice(*self.query)]
        b[self.steps != UP] = ref[slice(*self.ref)]
        return a, b


def batches(queries: Sequence[np.ndarray], refs: Sequence[np.ndarray], widths: Sequence[int]) -> list[list[int]]:
    """Places of pairs that go together: about equal lengths, and a bounded number of cells."""
    order = sorted(range(len(queries)), key=lambda k: (widths[k], len(queries[k])))
    out: list[list[int]] = []
    longest = widest = 0
    for k in order:
        n, m = max(longest, len(queries[k]) + 1), max(widest, widths[k] + 1)
        unlike = out and (len(queries[k]) + 1) * (widths[k] + 1) > 2 * (len(queries[out[-1][0]]) + 1) * (widths[out[-1][0]] + 1) + 4096
        if not out or unlike or len(out[-1]) >= PAIRS or (len(out[-1]) + 1) * n * m > CELLS:
            out.append([])
            n, m = len(queries[k]) + 1, widths[k] + 1
        out[-1].append(k)
        longest, widest = n, m
    return out


def align(queries: Sequence[np.ndarray], refs: Sequence[np.ndarray], costs: Costs, local: bool = False, bands: Sequence[tuple[int, int]] | None = None) -> list[Path]:
    """Best alignment of every pair of code arrays; ``bands``: least and greatest reference minus query place (local only)."""
    widths = [len(r) for r in refs] if bands is None else [high - low + 1 for low, high in bands]
    out: list[Path | None] = [None] * len(queries)
    for places in batches(queries, refs, widths):
        found = _batch([queries[k] for k in places], [refs[k] for k in places], costs, local, None if bands is None else [bands[k][0] for k in places], max(widths[k] for k in places))
        for k, path in zip(places, found, strict=True):
            out[k] = path
    return out  # type: ignore[return-value]


def _running(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Running maximum down the columns, by doubled steps over whole arrays; both arrays are used up."""
    step = 1
    while step < len(x):
        spare[:step] = x[:step]
        np.maximum(x[step:], x[:-step], out=spare[step:])
        x, spare = spare, x
        step *= 2
    return x


WIDE = 1 << 16  # cells of one row of all pairs of a batch without traceback


def tops(queries: Sequence[np.ndarray], refs: Sequence[np.ndarray], costs: Costs, bands: Sequence[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, row, column) of the end of every pair's best local alignment, as ``align`` finds it, without a traceback.

    Whole numbers in two bytes where they fit. Values below 0 never reach a local alignment,
    so gaps start from the best of all kinds and nothing sinks without bound.
    """
    widths = np.array([len(r) for r in refs] if bands is None else [high - low + 1 for low, high in bands], np.int64)
    lengths = np.array([len(q) for q in queries], np.int64)
    score, row, column = np.zeros(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    order = np.lexsort((lengths, widths))
    a = 0
    while a < len(order):
        b = a + max(1, min(len(order) - a, WIDE // (int(widths[order[a]]) + 1)))
        # Pairs of one batch are at most twice as wide as its first.
        b = a + max(1, int(np.searchsorted(widths[order[a:b]], 2 * widths[order[a]] + 16, "right")))
        places = order[a:b].tolist()
        found = _tops([queries[k] for k in places], [refs[k] for k in places], costs, None if bands is None else [bands[k][0] for k in places], int(widths[places].max()))
        for x, y in zip((score, row, column), found, strict=True):
            x[places] = y
        a = b
    return score, row, column


def _tops(queries: list[np.ndarray], refs: list[np.ndarray], costs: Costs, shift: list[int] | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, banded = len(queries), shift is not None
    n = np.array([len(x) for x in queries])
    rows, columns = int(n.max()), width if banded else width + 1
    by, costs = costs.scaled()
    symbols = np.unique(np.concatenate([*queries, *refs, np.zeros(0, np.int64)]))
    outside = len(symbols)
    table = np.full((outside + 1, outside + 1), costs.mismatch)
    np.fill_diagonal(table, costs.match)
    if costs.matrix is not None:
        table[:outside, :outside] = costs.matrix[np.ix_(symbols, symbols)]
    wild = np.flatnonzero(np.isin(symbols, costs.wild))
    table[wild, :] = table[:, wild] = 0
    equal, other = table[:outside, :outside].diagonal(), table[:outside, :outside][~np.eye(outside, dtype=bool)]
    # One score for equal and a negative one for different symbols: places outside the reference count as different, and gain nothing.
    plain = outside > 0 and len(np.unique(equal)) == 1 and len(np.unique(other)) <= 1 and (not len(other) or other[0] < 0)
    most = max(float(np.abs(table).max()), abs(costs.gap_open), abs(costs.gap_extend))
    kind = np.int16 if most * (rows + width + 4) < 1 << 13 else np.int32 if most * (rows + width + 4) < 1 << 29 else np.int64
    low = kind(-(1 << 13) if kind is np.int16 else -(1 << 29))
    table[:, outside] = table[outside, :] = low
    code = np.zeros(int(symbols.max()) + 1 if outside else 1, np.int16)
    code[symbols] = np.arange(outside)
    q = np.full((rows, p), outside + 1 if plain else outside, np.int16)
    for k, x in enumerate(queries):
        q[: len(x), k] = code[x]
    r = np.full((rows + width if banded else width, p), outside, np.int16)
    for k, x in enumerate(refs):
        if banded:
            first, last = max(shift[k], 0), min(len(x), shift[k] + len(r))
            if last > first:
                r[first - shift[k] : last - shift[k], k] = code[x[first:last]]
        else:
            r[: len(x), k] = code[x]
    flat = table.astype(kind).ravel()
    match, mismatch = (kind(equal[0]), kind(other[0] if len(other) else -1)) if plain else (kind(0), kind(0))
    opened, extended = kind(costs.gap_open), kind(costs.gap_extend)
    slope = (int(extended) * np.arange(columns)).astype(kind)[:, None]
    back = (opened + slope[:-1]).astype(kind)
    # Of a band, the place after the last has no values.
    best, up = np.zeros((columns + 1, p), kind), np.full((columns + 1, p), low, kind)
    best[columns] = low
    stay, run, other_run, further = (np.zeros((columns, p), kind) for _ in range(4))
    top, end_row, end_col = np.zeros(p, np.int64), np.zeros(p, np.int64), np.zeros(p, np.int64)
    now, was = best[:columns], (best[1:], up[1:]) if banded else (best[:columns], up[:columns])
    for i in range(1, rows + 1):
        own = q[i - 1]
        there = r[i - 1 : i - 1 + width] if banded else r
        pair = np.where(there == own, match, mismatch) if plain else flat[np.minimum(own, outside).astype(np.int32) * (outside + 1) + there]
        if banded:
            np.add(now, pair, out=stay)
        else:
            np.add(best[:width], pair, out=stay[1:])
        np.maximum(stay, 0, out=stay)
        np.add(was[1], extended, out=further)
        np.add(was[0], opened, out=run)
        np.maximum(run, further, out=up[:columns])
        np.maximum(stay, up[:columns], out=now)
        highest = _running(np.subtract(now, slope, out=run), other_run)
        np.add(highest[:-1], back, out=further[1:])
        np.maximum(now[1:], further[1:], out=now[1:])
        value = stay.max(0)
        better = np.flatnonzero((value > top) & (i <= n))
        if len(better):
            top[better], end_row[better], end_col[better] = value[better], i, stay[:, better].argmax(0)
    return top / by, end_row, end_col


FRONT = 1 << 16  # cells of one antidiagonal of all pairs of a batch
WAVE = 1 << 24  # cells of all pairs of a batch whose values are kept


@dataclass(frozen=True)
class Plain:
    """Scores that only tell equal from different symbols, in two bytes, and codes whose bitwise difference is 0 or at least ``loss``."""

    by: float
    match: np.int16
    loss: np.int16
    opened: np.int16
    extended: np.int16
    of_query: np.ndarray
    of_ref: np.ndarray
    no_query: int
    no_ref: int

    @staticmethod
    def of(queries: Sequence[np.ndarray], refs: Sequence[np.ndarray], costs: Costs, length: int) -> Plain | None:
        """None where other scores are needed. Symbols that lose even with themselves have one code in queries and another in references."""
        symbols = np.unique(np.concatenate([*queries, *refs, np.zeros(0, np.int64)]))
        if not len(symbols) or np.isin(symbols, costs.wild).any():
            return None
        by, costs = costs.scaled()
        if costs.matrix is None:
            own, other = np.full(len(symbols), costs.match), np.array([costs.mismatch])
        else:
            table = costs.matrix[np.ix_(symbols, symbols)]
            own, other = table.diagonal(), table[~np.eye(len(symbols), dtype=bool)]
        match, mismatch = own.max(), other[0] if len(other) else costs.mismatch if costs.matrix is None else own.min()
        alike = own == match
        loss = match - mismatch
        if match <= 0 or mismatch >= 0 or (other != mismatch).any() or (own[~alike] != mismatch).any() or not costs.gap_open <= costs.gap_extend < 0:
            return None
        step = 1 << int(loss).bit_length()
        most = max(match, -mismatch, -costs.gap_open, -costs.gap_extend)
        if most * (length + 4) >= 1 << 13 or (2 * len(symbols) + 2) * step >= 1 << 15:
            return None
        of_query = np.zeros(int(symbols.max()) + 1, np.int16)
        of_ref = of_query.copy()
        of_query[symbols] = np.arange(len(symbols)) * step
        of_ref[symbols] = np.where(alike, np.arange(len(symbols)), np.arange(len(symbols)) + len(symbols)) * step
        return Plain(by, *(np.int16(x) for x in (match, loss, costs.gap_open, costs.gap_extend)), of_query, of_ref, 2 * len(symbols) * step, (2 * len(symbols) + 1) * step)


def scores(queries: Sequence[np.ndarray], refs: Sequence[np.ndarray], costs: Costs) -> np.ndarray:
    """The scores of ``tops``. Cells of one antidiagonal of all pairs of a batch are one step: none of them waits for another."""
    n, m = np.array([len(x) for x in queries], np.int64), np.array([len(x) for x in refs], np.int64)
    out = np.zeros(len(queries))
    order = np.lexsort((n, m))
    order = order[(n[order] > 0) & (m[order] > 0)]
    a = 0
    while a < len(order):
        b = a + max(1, min(len(order) - a, FRONT // int(n[order[a]])))
        b = a + max(1, int(np.searchsorted(m[order[a:b]], 2 * m[order[a]] + 16, "right")))
        places = order[a:b].tolist()
        own = [queries[k] for k in places], [refs[k] for k in places]
        plain = Plain.of(*own, costs, int(n[places].max() + m[places].max()))
        out[places] = tops(*own, costs)[0] if plain is None else _scores(*own, plain)
        a = b
    return out


def _scores(queries: list[np.ndarray], refs: list[np.ndarray], s: Plain) -> np.ndarray:
    p, rows, width = len(queries), max(len(x) for x in queries), max(len(x) for x in refs)
    q, r = np.full((rows, p), s.no_query, np.int16), np.full((width, p), s.no_ref, np.int16)
    for k, (x, y) in enumerate(zip(queries, refs, strict=True)):
        q[: len(x), k] = s.of_query[x]
        r[width - len(y) :, k] = s.of_ref[y[::-1]]
    # By row, the first stands before the query. Values of this antidiagonal take the place of those of the last but two, or but one.
    best = [np.zeros((rows + 1, p), np.int16) for _ in range(3)]
    up = [np.zeros((rows + 1, p), np.int16) for _ in range(2)]
    left, top = np.zeros((rows + 1, p), np.int16), np.zeros((rows + 1, p), np.int16)
    opened, other = np.zeros((rows + 1, p), np.int16), np.zeros((rows, p), np.int16)
    for t in range(rows + width - 1):
        a, b = max(0, t - width + 1), min(rows, t + 1)
        now, was, before = best[t % 3], best[(t - 1) % 3], best[(t - 2) % 3]
        # Nothing below 0 reaches a local alignment: 0 stands for it.
        gap, x = opened[: b - a + 1], other[: b - a]
        np.maximum(np.add(was[a : b + 1], s.opened, out=gap), 0, out=gap)
        own = left[a + 1 : b + 1]
        np.maximum(np.add(own, s.extended, out=own), gap[1:], out=own)
        above = up[t % 2][a + 1 : b + 1]
        np.maximum(np.add(up[(t - 1) % 2][a:b], s.extended, out=above), gap[:-1], out=above)
        first = width - 1 - t + a
        np.minimum(np.bitwise_xor(q[a:b], r[first : first + b - a], out=x), s.loss, out=x)
        here = now[a + 1 : b + 1]
        np.add(np.subtract(before[a:b], x, out=here), s.match, out=here)
        np.maximum(top[a + 1 : b + 1], here, out=top[a + 1 : b + 1])
        np.maximum(np.maximum(here, own, out=here), above, out=here)
    return top.max(0) / s.by


def traced(queries: Sequence[np.ndarray], refs: Sequence[np.ndarray], costs: Costs, bands: Sequence[tuple[int, int]]) -> list[Path]:
    """``align`` of local pairs in bands.

    Where scores are plain and a batch's values fit in ``WAVE`` cells they are kept, antidiagonal by antidiagonal, and paths are read from them;
    the other pairs go by ``tops`` and ``local``.
    """
    n = np.array([len(x) for x in queries], np.int64)
    widths = np.array([high - low + 1 for low, high in bands], np.int64)
    out: list[Path | None] = [None] * len(queries)
    order = np.lexsort((n, widths))
    kept: np.ndarray | None = None
    a, rest = 0, []
    while a < len(order):
        b = a + max(1, int(np.searchsorted(widths[order[a:]], 2 * widths[order[a]] + 16, "right")))
        longest, widest = (np.maximum.accumulate(x[order[a:b]]) for x in (n, widths))
        cells = (2 * longest + widest + 1) * (widest // 2 + 3) * np.arange(1, b - a + 1)
        b = a + max(1, int(np.searchsorted(cells, WAVE, "right")))
        places = order[a:b].tolist()
        a = b
        own = [queries[k] for k in places], [refs[k] for k in places]
        plain = None if cells[0] > WAVE or not n[places].max() else Plain.of(*own, costs, int(n[places].max() + widths[places].max()))
        if plain is None:
            rest += places
            continue
        kept = np.empty(3 * WAVE, np.int16) if kept is None else kept
        for k, path in zip(places, _traced(*own, plain, np.array([bands[k][0] for k in places], np.int64), widths[places], kept), strict=True):
            out[k] = path
    if rest:
        own = [queries[k] for k in rest], [refs[k] for k in rest], costs, [bands[k] for k in rest]
        for k, path in zip(rest, local(*own, tops(*own)), strict=True):
            out[k] = path
    return out  # type: ignore[return-value]


def _traced(queries: list[np.ndarray], refs: list[np.ndarray], s: Plain, shift: np.ndarray, widths: np.ndarray, kept: np.ndarray) -> list[Path]:
    """Of row i (from 1) and place c of the band, antidiagonal 2 i + c holds every second c; of both kinds of antidiagonals c // 2 is the place."""
    width, narrow = int(widths.max()), int(widths.min())
    p, rows, places = len(queries), max(len(x) for x in queries), width // 2 + 3
    q, r = np.full((rows, p), s.no_query, np.int16), np.full((rows + width, p), s.no_ref, np.int16)
    for k, (x, y) in enumerate(zip(queries, refs, strict=True)):
        q[rows - len(x) :, k] = s.of_query[x[::-1]]
        first, last = max(int(shift[k]), 0), min(len(y), int(shift[k]) + len(r))
        if last > first:
            r[first - shift[k] : last - shift[k], k] = s.of_ref[y[first:last]]
    # A band ends at its own width, whatever the others' of its batch.
    most = [np.where(np.arange(odd, width + 1, 2)[:, None] < widths, np.int16(np.iinfo(np.int16).max), np.int16(0)) for odd in (0, 1)]
    steps = 2 * rows + width
    stay, left, up = kept[: 3 * steps * places * p].reshape(3, steps, places, p)
    # Row 0, and what stands beside the band: a place before the first and one after the last.
    stay[:2, :3] = left[:2, :3] = up[:2, :3] = 0
    left[:, 0] = up[:, 0] = 0
    best = [np.zeros((places, p), np.int16) for _ in range(2)]
    opened, other = np.zeros((places, p), np.int16), np.zeros((places, p), np.int16)
    highest = np.zeros((steps, p), np.int16)
    for t in range(2, steps):
        u, odd = t >> 1, t & 1
        a, b = max(0, u - rows), min(u, (width - odd + 1) // 2)
        stay[t, b + 1] = left[t, b + 1] = up[t, b + 1] = 0
        if b <= a:
            continue
        here, x = stay[t, a + 1 : b + 1], other[: b - a]
        # The left neighbour's place and the upper one's, among those of the antidiagonal before.
        at_left, at_up = (a + 1, a + 2) if odd else (a, a + 1)
        gap = opened[: b - a + 1]
        np.maximum(np.add(best[1 - odd][at_left : at_left + b - a + 1], s.opened, out=gap), 0, out=gap)
        own, above = left[t, a + 1 : b + 1], up[t, a + 1 : b + 1]
        np.maximum(np.add(left[t - 1, at_left : at_left + b - a], s.extended, out=own), gap[:-1], out=own)
        np.maximum(np.add(up[t - 1, at_up : at_up + b - a], s.extended, out=above), gap[1:], out=above)
        np.minimum(np.bitwise_xor(q[rows - u + a : rows - u + b], r[u + odd - 1 + a : u + odd - 1 + b], out=x), s.loss, out=x)
        now = best[odd][a + 1 : b + 1]
        np.add(np.subtract(now, x, out=here), s.match, out=here)
        beside = max(a, (narrow - odd + 1) // 2)
        if beside < b:
            for value in (here, own, above):
                np.minimum(value[beside - a :], most[odd][beside:b], out=value[beside - a :])
        np.max(here, axis=0, out=highest[t])
        np.maximum(np.maximum(here, own, out=now), above, out=now)
    top = highest.max(0)
    row, column = _ends(stay, highest, top, rows, width)
    return _read(stay, left, up, top, row, column, shift, s)


def _ends(stay: np.ndarray, highest: np.ndarray, top: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of every pair's highest value, there the first place."""
    t, k = np.nonzero((highest == top) & (top > 0))
    place = np.arange(stay.shape[1] - 2)[None]
    u, odd = (t >> 1)[:, None], (t & 1)[:, None]
    inside = (place >= u - rows) & (place < np.minimum(u, (width - odd + 1) // 2))
    one, h = np.nonzero(inside & (stay[t, 1:-1, k] == top[k][:, None]))
    row, column, k = (t[one] >> 1) - h, 2 * h + (t[one] & 1), k[one]
    order = np.lexsort((column, row, k))
    own, first = np.unique(k[order], return_index=True)
    out = np.zeros(len(top), np.int64), np.zeros(len(top), np.int64)
    out[0][own], out[1][own] = row[order][first], column[order][first]
    return out


def _read(stay: np.ndarray, left: np.ndarray, up: np.ndarray, top: np.ndarray, row: np.ndarray, column: np.ndarray, shift: np.ndarray, s: Plain) -> list[Path]:
    """Paths from kept values, back from their ends by the preferences of ``_walk``; pairs step together."""
    _, places, p = stay.shape
    line = places * p
    flat_stay, flat_left, flat_up = (x.reshape(-1) for x in (stay, left, up))
    runs: list[list[tuple[int, int]]] = [[] for _ in range(p)]
    t = 2 * row + column
    at = t * line + (column // 2 + 1) * p + np.arange(p)
    matched, begun = np.flatnonzero(top > 0), np.zeros(p, np.int64)
    gapped, kind = np.zeros(0, np.int64), np.full(p, STAY)
    step = 0
    while len(matched) or len(gapped):
        step += 1
        more = []
        if len(matched):
            at[matched] -= 2 * line
            place = at[matched]
            a, b, c = flat_stay[place], flat_left[place], flat_up[place]
            over = np.flatnonzero((a <= 0) | (a < b) | (a < c))
            if len(over):
                ended, a, b, c = matched[over], a[over], b[over], c[over]
                for k, first in zip(ended.tolist(), begun[ended].tolist(), strict=True):
                    runs[k].append((STAY, step - first))
                on = np.maximum(np.maximum(a, b), c) > 0
                kind[ended] = np.where(b >= c, LEFT, UP)
                more.append(ended[on])
                keep = np.ones(len(matched), bool)
                keep[over] = False
                matched = matched[keep]
        if len(gapped):
            place, is_left = at[gapped], kind[gapped] == LEFT
            value = np.where(is_left, flat_left[place], flat_up[place])
            odd = place // line % 2 == 1
            place = place - line + np.where(is_left, np.where(odd, 0, -p), np.where(odd, p, 0))
            at[gapped] = place
            same = np.where(is_left, flat_left[place], flat_up[place]) + s.extended == value
            from_stay = flat_stay[place] + s.opened == value
            for k, x in zip(gapped.tolist(), kind[gapped].tolist(), strict=True):
                runs[k].append((x, 1))
            kind[gapped] = np.where(same, kind[gapped], np.where(from_stay, STAY, np.where(is_left, UP, LEFT)))
            back = kind[gapped] == STAY
            begun[gapped[back]] = step
            matched = np.concatenate([matched, gapped[back]])
            gapped = gapped[~back]
        if more:
            gapped = np.concatenate([gapped, *more])
    out = []
    for k, (own, score, i, c, d) in enumerate(zip(runs, top.tolist(), row.tolist(), column.tolist(), shift.tolist(), strict=True)):
        if not own:
            out.append(Path(0.0, (0, 0), (0, 0), np.zeros(0, np.uint8)))
            continue
        own.reverse()
        way = np.repeat(np.array([x for x, _ in own], np.uint8), [x for _, x in own])
        lefts, ups = sum(n for x, n in own if x == LEFT), sum(n for x, n in own if x == UP)
        end = i + d + c
        out.append(Path(score / s.by, (i - (len(way) - lefts), i), (end - (len(way) - ups), end), way))
    return out


def local(queries: Sequence[np.ndarray], refs: Sequence[np.ndarray], costs: Costs, bands: Sequence[tuple[int, int]], ends: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[Path]:
    """``align`` of pairs whose ``ends`` (of ``tops``) are known.

    Where the symbols before an end, taken without a gap, add up to the whole score, that is the
    alignment: a traceback prefers such a column to a gap and stops where nothing is left.
    Only the other pairs are traced.
    """
    out: list[Path | None] = [None] * len(queries)
    traced = []
    table = costs.matrix
    for k, (score, row, column) in enumerate(zip(*(x.tolist() for x in ends), strict=True)):
        if score <= 0:
            out[k] = Path(0.0, (0, 0), (0, 0), np.zeros(0, np.uint8))
            continue
        end = row + bands[k][0] + column
        n = min(row, end)
        a, b = queries[k][row - n : row], refs[k][end - n : end]
        gain = table[a, b] if table is not None else np.where(a == b, costs.match, costs.mismatch)
        at = np.flatnonzero(np.abs(np.cumsum(gain[::-1]) - score) < 1e-6)
        if not len(at) or costs.wild:
            traced.append(k)
            continue
        n = int(at[0]) + 1
        out[k] = Path(score, (row - n, row), (end - n, end), np.full(n, STAY, np.uint8))
    for k, path in zip(traced, align([queries[k] for k in traced], [refs[k] for k in traced], costs, True, [bands[k] for k in traced]), strict=True):
        out[k] = path
    return out  # type: ignore[return-value]


def _batch(queries: list[np.ndarray], refs: list[np.ndarray], costs: Costs, local: bool, shift: list[int] | None, width: int) -> list[Path]:
    p = len(queries)
    n, m = np.array([len(q) for q in queries]), np.array([len(r) for r in refs])
    rows = int(n.max())
    banded = shift is not None
    columns = width if banded else width + 1
    by, costs = costs.scaled()
    kind = costs.kind(int(n.max() + m.max()))
    symbols = np.unique(np.concatenate([*queries, *refs, np.zeros(0, np.int64)]))
    code = lambda x: np.searchsorted(symbols, x).astype(np.int16)
    outside = len(symbols)  # stands in places that a reference doesn't have, and scores LOW with everything
    q = np.zeros((rows, p), np.int16)
    for k, x in enumerate(queries):
        q[: len(x), k] = code(x)
    r = np.full((rows + width if banded else width, p), outside, np.int16)
    for k, x in enumerate(refs):
        if banded:
            low, high = max(shift[k], 0), min(len(x), shift[k] + len(r))
            if high > low:
                r[low - shift[k] : high - shift[k], k] = code(x[low:high])
        else:
            r[: len(x), k] = code(x)
    table = np.full((outside + 1, outside + 1), costs.mismatch, kind)
    np.fill_diagonal(table, costs.match)
    if costs.matrix is not None:
        table[:outside, :outside] = costs.matrix[np.ix_(symbols, symbols)]
    wild = np.flatnonzero(np.isin(symbols, costs.wild))
    table[wild, :] = table[:, wild] = 0
    table[:, outside] = LOW
    plain = costs.matrix is None and not len(wild)
    has_outside = bool((r == outside).any())
    low, opened, extended = kind(LOW), kind(costs.gap_open), kind(costs.gap_extend)
    slope = (extended * np.arange(columns)).astype(kind)[:, None]
    back = (opened + slope[:-1]).astype(kind)
    stay, left, up, new_stay, new_left, new_up, best, run, other_run, came = (np.full((columns, p), low, kind) for _ in range(10))
    flag, other = np.zeros((columns, p), bool), np.zeros((columns, p), bool)
    trace = np.zeros((rows + 1, columns, p), np.uint8)
    if local:
        stay[:] = 0
        trace[0] = END | BEST_STAY
    else:
        stay[0] = 0
        left[1:] = (opened + extended * np.arange(columns - 1))[:, None]
        trace[0, 0] = BEST_STAY
        trace[0, 1:2] = BEST_LEFT | LEFT_STAY
        trace[0, 2:] = BEST_LEFT | LEFT_ON
    np.maximum(np.maximum(stay, left), up, out=best)
    top = np.zeros(p)
    end_row, end_col = np.zeros(p, np.int64), np.zeros(p, np.int64)
    if not local:
        _finish(0, n, m, best, top, end_row, end_col)

    def mark(told: np.ndarray, where: np.ndarray, bit: int) -> None:
        told |= where.view(np.uint8) * np.uint8(bit)

    for i in range(1, rows + 1):
        own = q[i - 1]
        there = r[i - 1 : i - 1 + width] if banded else r
        if plain:
            pair = np.where(there == own, kind(costs.match), kind(costs.mismatch))
            if has_outside:
                pair[there == outside] = low
        else:
            pair = table.ravel()[own.astype(np.int32) * (outside + 1) + there]
        told = trace[i]
        if banded:
            np.add(best, pair, out=new_stay)
            came_stay, came_left, came_up = (np.concatenate([x[1:], np.full((1, p), low, kind)]) for x in (stay, left, up))
        else:
            new_stay[0] = 0 if local else low
            np.add(best[:-1], pair, out=new_stay[1:])
            came_stay, came_left, came_up = stay, left, up
        if local:
            np.maximum(new_stay, 0, out=new_stay)
            mark(told, np.less_equal(new_stay, 0, out=flag), END)
        np.maximum(came_stay, came_left, out=came)
        came += opened
        further = came_up + extended
        np.maximum(came, further, out=new_up)
        mark(told, np.equal(further, new_up, out=flag), UP_ON)
        mark(told, np.equal(came_stay + opened, new_up, out=other), UP_STAY)
        np.maximum(new_stay, new_up, out=best)
        # left[j] is the best of an earlier place, opened and extended from there: a running maximum.
        highest = _running(np.subtract(best, slope, out=run), other_run)
        np.add(highest[:-1], back, out=new_left[1:])
        np.equal(new_left[:-1] + extended, new_left[1:], out=flag[1:])
        np.equal(new_stay[:-1] + opened, new_left[1:], out=other[1:])
        flag[0] = other[0] = False
        mark(told, flag, LEFT_ON)
        mark(told, other, LEFT_STAY)
        np.maximum(best, new_left, out=best)
        mark(told, np.equal(new_stay, best, out=flag), BEST_STAY)
        mark(told, np.equal(new_left, best, out=flag), BEST_LEFT)
        stay, left, up, new_stay, new_left, new_up = new_stay, new_left, new_up, stay, left, up
        new_left[0] = low
        if local:
            value = stay.max(0)
            better = np.flatnonzero((value > top) & (i <= n))
            if len(better):
                top[better], end_row[better], end_col[better] = value[better], i, stay[:, better].argmax(0)
        else:
            _finish(i, n, m, best, top, end_row, end_col)
    return _walk(trace, top / by, end_row, end_col, local, shift)


def _came(flags: np.ndarray, first: int, second: int, one: int, two: int, else_: int) -> np.ndarray:
    return np.where(flags & first, one, np.where(flags & second, two, else_))


def _finish(i: int, n: np.ndarray, m: np.ndarray, best: np.ndarray, top: np.ndarray, end_row: np.ndarray, end_col: np.ndarray) -> None:
    """Global alignments of queries of i symbols end here."""
    done = np.flatnonzero(n == i)
    top[done], end_row[done], end_col[done] = best[m[done], done], i, m[done]


def _walk(trace: np.ndarray, top: np.ndarray, end_row: np.ndarray, end_col: np.ndarray, local: bool, shift: list[int] | None) -> list[Path]:
    p = len(top)
    i, c = end_row.copy(), end_col.copy()
    every = np.arange(p)
    live = top > 0 if local else (i > 0) | (c > 0)
    now = np.full(p, STAY) if local else _came(trace[i, c, every], BEST_STAY, BEST_LEFT, STAY, LEFT, UP)
    taken = []
    while live.any():
        k = np.flatnonzero(live)
        here = trace[i[k], c[k], k]
        if local:
            ended = (now[k] == STAY) & (here & END > 0)
            live[k[ended]] = False
            k, here = k[~ended], here[~ended]
            if not len(k):
                break
        step = np.full(p, 255, np.uint8)
        step[k] = now[k]
        taken.append(step)
        is_stay, is_left, is_up = (now[k] == x for x in (STAY, LEFT, UP))
        i[k] -= ~is_left
        c[k] -= ~is_up if shift is None else is_left
        if shift is not None:
            c[k] += is_up
        after = _came(trace[i[k], c[k], k], BEST_STAY, BEST_LEFT, STAY, LEFT, UP)
        now[k] = np.where(is_stay, after, np.where(is_left, _came(here, LEFT_ON, LEFT_STAY, LEFT, STAY, UP), _came(here, UP_ON, UP_STAY, UP, STAY, LEFT)))
        if not local:
            live[k[(i[k] == 0) & (c[k] == 0)]] = False
    steps = np.array(taken, np.uint8) if taken else np.zeros((0, p), np.uint8)
    out = []
    for k in range(p):
        own = steps[:, k]
        own = own[own != 255][::-1]
        if not len(own):
            out.append(Path(float(top[k]), (0, 0), (0, 0), own))
            continue
        ref_end = end_col[k] if shift is None else end_row[k] + shift[k] + end_col[k]
        begin_q, begin_r = end_row[k] - np.count_nonzero(own != LEFT), ref_end - np.count_nonzero(own != UP)
        out.append(Path(float(top[k]), (int(begin_q), int(end_row[k])), (int(begin_r), int(ref_end)), own))
    return out
