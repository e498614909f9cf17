"""Alignment operators: affine pairwise alignment, codon dynamic programs, hit chains.

Dynamic programs need state that column expressions can't hold, so these run as
Arrow-batched functions: a batch of pairs a call, rows of the matrix as numpy vectors.
Joins that pair queries with references happen before, in the plan.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe import genes
from cladeframe.operators import pairbatch, sized


@dataclass(frozen=True)
class Scores:
    match: float = 2.0
    mismatch: float = -1.0
    gap_open: float = -2.0
    gap_extend: float = -0.5
    wildcard: str = ""


LOCAL_NT = Scores()
GLOBAL_AA = Scores(gap_open=-5.0, gap_extend=-1.0)
PLAIN = Scores(match=1.0, mismatch=0.0, gap_open=0.0, gap_extend=0.0)


@dataclass(frozen=True)
class Alignment:
    score: float
    query_start: int  # from 1; 0 without an alignment
    query_end: int
    ref_start: int
    ref_end: int
    query: str
    ref: str


def align(query: str, ref: str, scores: Scores = GLOBAL_AA, local: bool = False) -> Alignment:
    """Best affine alignment; the first gap character costs ``gap_open``, further ones ``gap_extend``.

    Of equal alignments a column of two residues is preferred to a gap, a gap in the
    query to one in the reference. Empty sequences align to gaps alone.
    """
    n, m = len(query), len(ref)
    q, r = np.frombuffer(query.encode("utf-32-le"), np.uint32), np.frombuffer(ref.encode("utf-32-le"), np.uint32)
    low = -1e18
    stay = np.full((n + 1, m + 1), low)
    left = np.full((n + 1, m + 1), low)  # gap in the query
    up = np.full((n + 1, m + 1), low)  # gap in the reference
    stay[0, 0] = 0.0
    if local:
        stay[0, :] = stay[:, 0] = 0.0
    else:
        left[0, 1:] = scores.gap_open + scores.gap_extend * np.arange(m)
        up[1:, 0] = scores.gap_open + scores.gap_extend * np.arange(n)
    wild = {ord(c) for c in scores.wildcard}
    slope = scores.gap_extend * np.arange(m + 1)
    for i in range(1, n + 1):
        pair = np.where(r == q[i - 1], scores.match, scores.mismatch)
        if wild:
            pair[np.isin(r, list(wild))] = 0.0
            if int(q[i - 1]) in wild:
                pair[:] = 0.0
        before = np.maximum(np.maximum(stay[i - 1], left[i - 1]), up[i - 1])
        stay[i, 1:] = before[:-1] + pair
        if local:
            stay[i, 1:] = np.maximum(stay[i, 1:], 0.0)
        up[i] = np.maximum(np.maximum(stay[i - 1], left[i - 1]) + scores.gap_open, up[i - 1] + scores.gap_extend)
        # left[j] = max over k < j of best[k] + open + extend * (j - k - 1): a running maximum.
        best = np.maximum(stay[i], up[i])
        run = np.maximum.accumulate(best - slope)
        left[i, 1:] = run[:-1] + scores.gap_open + slope[:-1]
    best = np.maximum(np.maximum(stay, left), up)
    if local:
        i, j = np.unravel_index(int(np.argmax(stay)), stay.shape)
        if stay[i, j] <= 0:
            return Alignment(0.0, 0, 0, 0, 0, "", "")
        kind, score = "stay", float(stay[i, j])
    else:
        i, j = n, m
        score = float(best[n, m])
        kind = "stay" if stay[n, m] == score else "left" if left[n, m] == score else "up"
    end_q, end_r, a, b = int(i), int(j), [], []
    close = lambda x, y: abs(x - y) < 1e-9
    while i > 0 or j > 0:
        if local and kind == "stay" and stay[i, j] <= 0:
            break
        if kind == "stay":
            if i == 0 or j == 0:
                break
            a.append(query[i - 1])
            b.append(ref[j - 1])
            i, j = i - 1, j - 1
            if i == 0 and j == 0:
                break
            top = best[i, j]
            kind = "stay" if close(stay[i, j], top) else "left" if close(left[i, j], top) else "up"
        elif kind == "left":
            a.append("-")
            b.append(ref[j - 1])
            here = left[i, j]
            j -= 1
            if close(left[i, j] + scores.gap_extend, here):
                kind = "left"
            else:
                kind = "stay" if close(stay[i, j] + scores.gap_open, here) else "up"
        else:
            a.append(query[i - 1])
            b.append("-")
            here = up[i, j]
            i -= 1
            if close(up[i, j] + scores.gap_extend, here):
                kind = "up"
            else:
                kind = "stay" if close(stay[i, j] + scores.gap_open, here) else "left"
    return Alignment(score, int(i) + 1 if a else 0, end_q, int(j) + 1 if b else 0, end_r, "".join(reversed(a)), "".join(reversed(b)))


ALIGNED = "score double, query_start int, query_end int, ref_start int, ref_end int, query string, ref string"


def costs(scores: Scores) -> pairbatch.Costs:
    return pairbatch.Costs(scores.match, scores.mismatch, scores.gap_open, scores.gap_extend, None, tuple(ord(c) for c in scores.wildcard))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)


def align_all(pairs: list[tuple[str, str]], scores: Scores = GLOBAL_AA, local: bool = False) -> list[Alignment]:
    """``align`` of many pairs, by one program for all; equal pairs are aligned once."""
    kinds = list(dict.fromkeys(pairs))
    coded = [(_codes(q), _codes(r)) for q, r in kinds]
    said = lambda x: x.astype("<u4").tobytes().decode("utf-32-le")
    done: dict[tuple[str, str], Alignment] = {}
    paths = pairbatch.align([q for q, _ in coded], [r for _, r in coded], costs(scores), local)
    for pair, (q, r), path in zip(kinds, coded, paths, strict=True):
        one = int(len(path.steps) > 0)
        a, b = path.rows(q, r, ord("-"))
        done[pair] = Alignment(path.score, path.query[0] + one, path.query[1], path.ref[0] + one, path.ref[1], said(a), said(b))
    return [done[p] for p in pairs]


def score_all(queries: list[np.ndarray], refs: list[np.ndarray], scores: Scores, local: bool) -> np.ndarray:
    """Scores of ``align_all`` for pairs of code arrays; local ones without a traceback."""
    if local:
        return pairbatch.scores(queries, refs, costs(scores))
    return np.array([x.score for x in pairbatch.align(queries, refs, costs(scores), False)])


def aligner(scores: Scores = GLOBAL_AA, local: bool = False):
    """Vectorised function of (query, ref); null sequences are empty."""

    @F.pandas_udf(ALIGNED)
    def run(query: pd.Series, ref: pd.Series) -> pd.DataFrame:
        found = align_all([(q or "", r or "") for q, r in zip(query, ref, strict=True)], scores, local)
        return pd.DataFrame([vars(x) for x in found], columns=[f.split()[0] for f in ALIGNED.split(", ")])

    return run


def anchored(query: Column, ref: Column, ref_start: Column) -> Column:
    """struct(start, end, aa) of aligned columns: residues on reference columns; insertions are dropped, deletions are not padded."""
    pairs = F.zip_with(F.filter(F.split(ref, ""), lambda c: c != ""), F.filter(F.split(query, ""), lambda c: c != ""), lambda r, q: F.struct(r.alias("r"), q.alias("q")))
    start = F.struct((ref_start - 1).alias("p"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("aa"))

    def step(acc: Column, x: Column) -> Column:
        p = acc["p"] + F.when(x["r"] == "-", 0).otherwise(1)
        both = (x["r"] != "-") & (x["q"] != "-")
        return F.struct(p.alias("p"), F.when(both & (acc["s"] == 0), p).otherwise(acc["s"]).alias("s"), F.when(both, p).otherwise(acc["e"]).alias("e"), F.when(both, F.concat(acc["aa"], x["q"])).otherwise(acc["aa"]).alias("aa"))

    return F.aggregate(pairs, start, step, lambda acc: F.struct(acc["s"].alias("start"), acc["e"].alias("end"), acc["aa"].alias("aa")))


def projected(query: Column, ref: Column, ref_start: Column, ref_length: Column) -> Column:
    """The query's symbols on the reference's own columns, gaps outside the aligned stretch."""
    pairs = F.zip_with(F.filter(F.split(ref, ""), lambda c: c != ""), F.filter(F.split(query, ""), lambda c: c != ""), lambda r, q: F.struct(r.alias("r"), q.alias("q")))
    inner = F.array_join(F.transform(F.filter(pairs, lambda x: x["r"] != "-"), lambda x: x["q"]), "")
    return F.rpad(F.concat(F.repeat(F.lit("-"), ref_start - 1), inner), ref_length, "-")


def residues_to_codons(aligned: str, bases: str) -> str:
    """Codons on an aligned residue string: a gap takes three gap bases."""
    out, k = [], 0
    for c in aligned:
        if c == "-":
            out.append("---")
        else:
            out.append(bases[3 * k : 3 * k + 3])
            k += 1
    return "".join(out)


def codon_alignment():
    """Vectorised function of (aligned residues, bases)."""

    @F.pandas_udf("string")
    def run(aligned: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([residues_to_codons(a or "", b or "") for a, b in zip(aligned, bases, strict=True)])

    return run


# Residue scores and penalties of the frame-shift program.
MATCH, MISMATCH, AMBIGUOUS, STOP = 3, -2, -3, -6
SKIP = {1: -4, 2: -5, 3: -3}
DELETE = -4


def _skipped(row: np.ndarray, skips: tuple[int, ...]) -> None:
    """Raises places of ``row`` to the best value that skips from earlier places give: per skip a running maximum of every k-th place, until nothing rises."""
    n = len(row)
    while True:
        before = row.copy()
        for k in skips:
            filled = np.full(-(-n // k) * k, -(1 << 40), np.int64)
            filled[:n] = row
            lanes = filled.reshape(-1, k) - SKIP[k] * np.arange(len(filled) // k)[:, None]
            best = np.maximum.accumulate(lanes, 0) + SKIP[k] * np.arange(len(filled) // k)[:, None]
            np.maximum(row, best.reshape(-1)[:n], out=row)
        if (row == before).all():
            return


def frameshift(reference: str, bases: str, skips: tuple[int, ...] = (1, 2, 3), may_delete: bool = True, free_start: bool = True) -> dict:
    """Residues of ``bases`` read along a protein with frame shifts.

    A reference residue takes a codon, or is deleted; between codons bases are skipped.
    Start and end on the bases are free, the first best end counts. Returns score, aa,
    nt (codons that were read), events (skips and deletions), nt_start, nt_end (from 0).
    """
    m, n = len(reference), len(bases)
    read = [genes.CODONS.get(bases[j : j + 3], "X") for j in range(max(n - 2, 0))]
    low = -(1 << 30)
    score = np.full((m + 1, n + 1), low, np.int64)
    came = np.zeros((m + 1, n + 1), np.int8)  # 1..3: skipped, 4: codon, 5: deleted, 0: begin
    score[0] = 0 if free_start else low
    score[0, 0] = 0
    code = np.array([ord(c) for c in read], np.int64)
    special = np.where(code == ord("X"), AMBIGUOUS, np.where(code == ord("*"), STOP, 0)) if len(code) else code
    for i in range(m + 1):
        row = score[i]
        unskipped = row.copy()
        _skipped(row, skips)
        # Where several ways lead to the best value: no skip, then the longest.
        settled = row == unskipped
        for k in sorted(skips, reverse=True):
            if k > n:
                continue
            by = np.zeros(n + 1, bool)
            by[k:] = (row[k:] == row[:-k] + SKIP[k]) & (row[:-k] > low // 2)
            came[i][by & ~settled] = k
            settled |= by
        if i == m:
            break
        below = score[i + 1]
        if len(code):
            gain = np.where(special != 0, special, np.where(code == ord(reference[i]), MATCH, MISMATCH))
            reached = row[: n - 2] > low // 2
            new = np.where(reached, row[: n - 2] + gain, low)
            below[3:] = new
            came[i + 1, 3:] = np.where(reached, 4, 0)
        if may_delete:
            drop = np.where(row > low // 2, row + DELETE, low)
            better = drop > below
            below[better] = drop[better]
            came[i + 1][better] = 5
    end = int(np.argmax(score[m]))
    i, j, aa, nt, events, start, last = m, end, [], [], 0, end, end
    while i > 0 or (j > 0 and came[i, j]):
        step = int(came[i, j])
        if step == 0:
            break
        if step == 4:
            aa.append(read[j - 3])
            nt.append(bases[j - 3 : j])
            start, last = j - 3, max(last, j)
            i, j = i - 1, j - 3
        elif step == 5:
            events, i = events + 1, i - 1
        else:
            events, j = events + 1, j - step
    return {"score": int(score[m, end]), "aa": "".join(reversed(aa)), "nt": "".join(reversed(nt)), "events": events, "nt_start": start, "nt_end": last}


FRAME_CELLS = 1 << 20  # of the program over a batch of sequences


def frameshift_all(pairs: list[tuple[str, str]], skips: tuple[int, ...] = (1, 2, 3), may_delete: bool = True, free_start: bool = True) -> list[dict]:
    """``frameshift`` of many (protein, bases): those of one protein and one length are rows of one program; equal pairs run once."""
    groups: dict[tuple[str, int], list[str]] = {}
    for reference, bases in dict.fromkeys(pairs):
        groups.setdefault((reference, len(bases)), []).append(bases)
    done: dict[tuple[str, str], dict] = {}
    for (reference, n), own in groups.items():
        many = max(1, FRAME_CELLS // ((len(reference) + 1) * (n + 1)))
        for a in range(0, len(own), many):
            part = own[a : a + many]
            for bases, found in zip(part, _frameshifts(reference, part, n, skips, may_delete, free_start), strict=True):
                done[reference, bases] = found
    return [done[p] for p in pairs]


def _frameshifts(reference: str, many: list[str], n: int, skips: tuple[int, ...], may_delete: bool, free_start: bool) -> list[dict]:
    m, p = len(reference), len(many)
    read = [[genes.CODONS.get(b[j : j + 3], "X") for j in range(max(n - 2, 0))] for b in many]
    low = -(1 << 30)
    score = np.full((m + 1, n + 1, p), low, np.int64)
    came = np.zeros((m + 1, n + 1, p), np.int8)
    score[0] = 0 if free_start else low
    score[0, 0] = 0
    code = np.frombuffer("".join("".join(x) for x in read).encode("latin-1"), np.uint8).astype(np.int64).reshape(p, max(n - 2, 0)).T
    special = np.where(code == ord("X"), AMBIGUOUS, np.where(code == ord("*"), STOP, 0))
    for i in range(m + 1):
        row = score[i]
        unskipped = row.copy()
        while True:
            before = row.copy()
            for k in skips:
                filled = np.full((-(-(n + 1) // k) * k, p), -(1 << 40), np.int64)
                filled[: n + 1] = row
                slope = SKIP[k] * np.arange(len(filled) // k)[:, None, None]
                best = np.maximum.accumulate(filled.reshape(-1, k, p) - slope, 0) + slope
                np.maximum(row, best.reshape(-1, p)[: n + 1], out=row)
            if (row == before).all():
                break
        settled = row == unskipped
        for k in sorted(skips, reverse=True):
            if k > n:
                continue
            by = np.zeros((n + 1, p), bool)
            by[k:] = (row[k:] == row[:-k] + SKIP[k]) & (row[:-k] > low // 2)
            came[i][by & ~settled] = k
            settled |= by
        if i == m:
            break
        below = score[i + 1]
        if len(code):
            gain = np.where(special != 0, special, np.where(code == ord(reference[i]), MATCH, MISMATCH))
            reached = row[: n - 2] > low // 2
            below[3:] = np.where(reached, row[: n - 2] + gain, low)
            came[i + 1, 3:] = np.where(reached, 4, 0)
        if may_delete:
            drop = np.where(row > low // 2, row + DELETE, low)
            better = drop > below
            below[better] = drop[better]
            came[i + 1][better] = 5
    ends, tops = score[m].argmax(0).tolist(), score[m].max(0).tolist()
    out = []
    for bases, own, end, top, steps in zip(many, read, ends, tops, np.ascontiguousarray(came.transpose(2, 0, 1)), strict=True):
        steps = steps.tolist()
        i, j, aa, nt, events, start, last = m, end, [], [], 0, end, end
        while i > 0 or (j > 0 and steps[i][j]):
            step = steps[i][j]
            if step == 0:
                break
            if step == 4:
                aa.append(own[j - 3])
                nt.append(bases[j - 3 : j])
                start, last = j - 3, max(last, j)
                i, j = i - 1, j - 3
            elif step == 5:
                events, i = events + 1, i - 1
            else:
                events, j = events + 1, j - step
        out.append({"score": int(top), "aa": "".join(reversed(aa)), "nt": "".join(reversed(nt)), "events": events, "nt_start": start, "nt_end": last})
    return out


def frameshift_refined():
    """Vectorised function of (protein, bases)."""

    @F.pandas_udf("score long, aa string, nt string, events int, nt_start int, nt_end int")
    def run(reference: pd.Series, bases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(frameshift_all([(r or "", b or "") for r, b in zip(reference, bases, strict=True)]), columns=["score", "aa", "nt", "events", "nt_start", "nt_end"])

    return run


def chain(starts: list[int], ends: list[int], gains: list[float], bits: list[float]) -> list[int]:
    """Places of the disjoint hits with the largest sum of identical residues, in order along the query."""
    order = sorted(range(len(ends)), key=lambda k: (ends[k], starts[k], -bits[k]))
    ended = [ends[k] for k in order]
    best, take, before = [0.0], [], []
    for i, k in enumerate(order):
        before.append(min(bisect_left(ended, starts[k]), i))
        with_it = gains[k] + best[before[i]]
        take.append(with_it > best[i])
        best.append(max(with_it, best[i]))
    keep, i = [], len(order)
    while i > 0:
        if take[i - 1]:
            keep.append(order[i - 1])
            i = before[i - 1]
        else:
            i -= 1
    return keep[::-1]


def hit_chains(hits: DataFrame, by: list[str]) -> DataFrame:
    """The chained hits of each group (one query against one subject: search programs return some dozens).

    A group is one row with a short array, and the program runs over batches of such rows.
    """

    @F.pandas_udf("array<int>")
    def chosen(starts: pd.Series, ends: pd.Series, gains: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series([chain(a.tolist(), b.tolist(), c.tolist(), d.tolist()) for a, b, c, d in zip(starts, ends, gains, bits, strict=True)])

    rest = [c for c in hits.columns if c not in by]
    grouped = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("h"))
    picked = grouped.withColumn("k", chosen(F.col("h.qstart"), F.col("h.qend"), F.col("h.nident").cast("array<double>"), F.col("h.bitscore").cast("array<double>")))
    return picked.select(*by, F.explode(F.transform("k", lambda i: F.get(F.col("h"), i))).alias("x")).select(*by, "x.*").select(*hits.columns)


def chain_summary(chains: DataFrame, by: list[str]) -> DataFrame:
    """(by..., nident, covered, identity, coverage): positions are counted once."""
    spans = F.transform(F.collect_list(F.struct("qstart", "qend")), lambda x: F.sequence(x["qstart"], x["qend"]))
    out = chains.groupBy(*by).agg(F.sum("nident").alias("nident"), F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("covered"), F.max("qlen").alias("qlen"))
    return out.withColumn("identity", F.col("nident") / F.col("covered")).withColumn("coverage", F.col("covered") / F.col("qlen"))


def paint(length: int, starts: list[int], queries: list[str], subjects: list[str]) -> str:
    out = ["X"] * length
    for start, q, s in zip(starts, queries, subjects, strict=True):
        at = start - 1
        for a, b in zip(q, s, strict=True):
            if a != "-":
                out[at] = "X" if b == "-" else b
                at += 1
    return "".join(out)


def painted(chains: DataFrame, by: list[str]) -> DataFrame:
    """(by..., sequence): the chain's query-aligned residues on a string of X of the query's length."""

    @F.pandas_udf("string")
    def run(length: pd.Series, starts: pd.Series, queries: pd.Series, subjects: pd.Series) -> pd.Series:
        return pd.Series([paint(int(n), a.tolist(), q.tolist(), s.tolist()) for n, a, q, s in zip(length, starts, queries, subjects, strict=True)])

    rows = chains.groupBy(*by).agg(F.max("qlen").alias("n"), F.array_sort(F.collect_list(F.struct("qstart", "qseq", "sseq"))).alias("h"))
    return rows.select(*by, run("n", F.col("h.qstart"), F.col("h.qseq"), F.col("h.sseq")).alias("sequence"))


WORDS = (4, 6, 9, 12)  # lengths of the words that bound a score
MEMBERS = 64  # references whose words are kept as a table


class Sketches:
    """The words of references, to bound alignment scores from above.

    An alignment's equal columns form runs that breaks part (a mismatch or a gap). A run
    of L columns gives L - k + 1 words that stand in both sequences, so of N symbols with
    c common words at least (N - c - k + 1) / k breaks are needed, and each costs a match
    and a mismatch, or a gap. That holds for local and global scores; symbols of the
    wildcard are taken as equal to all.
    """

    def __init__(self, refs: list[str], scores: Scores):
        self.scores, self.size = scores, np.array([len(r) for r in refs])
        wild = sorted({ord(c) for c in scores.wildcard})
        self.wild = np.array(wild, np.int64)
        self.words, self.members = {}, {}
        for k in WORDS:
            found = [self._words(_codes(r), k) for r in refs]
            free = np.array([int((~known).sum()) for _, known in found])
            code = np.concatenate([np.unique(c[known]) for c, known in found] or [np.zeros(0, np.int64)])
            owner = np.repeat(np.arange(len(refs)), [len(np.unique(c[known])) for c, known in found])
            order = np.argsort(code, kind="stable")
            self.words[k] = code[order], owner[order], free
            if len(refs) <= MEMBERS:
                kinds = np.unique(code)
                member = np.zeros((len(kinds) + 1, len(refs)), np.int32)  # the last row is no reference's
                member[np.searchsorted(kinds, code), owner] = 1
                self.members[k] = kinds, member

    def _words(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, holds no wildcard) at every place."""
        total = max(len(codes) - k + 1, 0)
        out, known = np.zeros(total, np.int64), np.ones(total, bool)
        for j in range(k):
            out = out * np.int64(1_000_003) + codes[j : j + total]
            known &= ~np.isin(codes[j : j + total], self.wild)
        return out, known

    def bounds(self, query: str | np.ndarray) -> np.ndarray:
        """No alignment of the query with each reference scores above this."""
        s, codes = self.scores, _codes(query) if isinstance(query, str) else query
        length = np.minimum(self.size, len(codes))
        out = s.match * length.astype(float)
        for k, (code, owner, free) in self.words.items():
            words, known = self._words(codes, k)
            kinds, times = np.unique(words[known], return_counts=True)
            low, high = np.searchsorted(code, kinds), np.searchsorted(code, kinds, "right")
            n = high - low
            at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            common = np.bincount(owner[at], np.repeat(times, n), len(self.size)) + (~known).sum()
            common = np.where(free > 0, np.maximum(common, len(words)), common)  # a reference's wildcards may equal any word
            breaks = np.maximum(np.ceil((length - common - (k - 1)) / k), 0)
            out = np.minimum(out, s.match * length - breaks * min(s.match - s.mismatch, -s.gap_open, s.match * (k - 1)))
        return out


    def all_bounds(self, queries: list[np.ndarray]) -> np.ndarray:
        """``bounds`` of many queries (codes), a row a query: with few references, the places of all queries at once."""
        if not self.members:
            return np.array([self.bounds(q) for q in queries])
        s, size = self.scores, np.array([len(q) for q in queries])
        length = np.minimum(size[:, None], self.size[None])
        out = s.match * length.astype(float)
        codes, ends = np.concatenate([*queries, np.zeros(0, np.int64)]), np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(len(codes))  # symbols of its query from a place on
        owner = np.repeat(np.arange(len(queries)), size)
        for k, (kinds, member) in self.members.items():
            words, known = self._words(codes, k)
            inside = left[: len(words)] >= k
            total = np.bincount(owner[: len(words)][inside], minlength=len(queries))
            at = np.flatnonzero(inside & known)
            place = np.minimum(np.searchsorted(kinds, words[at]), max(len(kinds) - 1, 0))
            hit = kinds[place] == words[at] if len(kinds) else np.zeros(len(at), bool)
            told, of = member[place[hit]], owner[at[hit]]
            common = np.zeros((len(queries), len(self.size)), np.int64)
            if len(of):
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                common[of[first]] = np.add.reduceat(told, first, axis=0)
            common += (total - np.bincount(owner[at], minlength=len(queries)))[:, None]
            common = np.where(self.words[k][2] > 0, np.maximum(common, total[:, None]), common)
            breaks = np.maximum(np.ceil((length - common - (k - 1)) / k), 0)
            out = np.minimum(out, s.match * length - breaks * min(s.match - s.mismatch, -s.gap_open, s.match * (k - 1)))
        return out


def winners(queries: list[str], refs: list[str], scores: Scores, local: bool, sketches: Sketches | None = None, traced: bool = True) -> list[tuple[int, Alignment, int]]:
    """Of every query the first best reference, its alignment, and how many references were aligned: those whose bound reaches the best score so far.

    References are compared by scores; only the winner's alignment is traced, and not even that without ``traced`` (then it has a score alone).
    """
    if not refs:
        return []
    known = sketches or Sketches(refs, scores)
    q, r = [_codes(x) for x in queries], [_codes(x) for x in refs]
    bounds = known.all_bounds(q)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best, at = np.full(len(queries), -np.inf), np.zeros(len(queries), np.int64)
    aligned, tried, step = np.zeros(len(queries), np.int64), 0, 1
    while tried < len(refs):
        own = order[:, tried : tried + step]
        bound = np.take_along_axis(bounds, own, 1)
        # Of equal scores the earlier reference wins.
        k, c = np.nonzero((bound > best[:, None]) | ((bound == best[:, None]) & (own < at[:, None])))
        ref = own[k, c]
        for x, y, score in zip(k.tolist(), ref.tolist(), score_all([q[x] for x in k.tolist()], [r[y] for y in ref.tolist()], scores, local).tolist(), strict=True):
            if score > best[x] or (score == best[x] and y < at[x]):
                best[x], at[x] = score, y
        aligned += np.bincount(k, minlength=len(queries))
        tried, step = tried + step, 2 * step
    if traced:
        found = align_all([(queries[k], refs[y]) for k, y in enumerate(at.tolist())], scores, local)
    else:
        found = [Alignment(x, 0, 0, 0, 0, "", "") for x in best.tolist()]
    return list(zip(at.tolist(), found, aligned.tolist(), strict=True))


QUERIES = 256  # sequences whose references are tried together; of short ones more, up to SYMBOLS
SYMBOLS = 1 << 16


def best_reference(queries: DataFrame, references: DataFrame, on: list[str], query: str, scores: Scores = LOCAL_NT, local: bool = True, traced: bool = True) -> DataFrame:
    """Every query (``query``, seq) against the references (ref_ordinal, ref_name, ref_seq) of its values of ``on``, or against
    all: query, ref_name, the alignment, and how many references were aligned for it.

    The highest score wins, the first of equals. References whose bound does not reach the best
    score so far are not aligned (``Sketches``). Up to ``sized.BYTES`` of references go to the
    tasks; more are met by their key, in blocks that each query visits, a row a pair.
    Queries are spread by a hash of their own, so a genotype with most rows is no hot task.
    Without ``traced`` the alignment's places and rows are not worked out (0 and empty).
    """
    # A number of partitions that stays: alignment costs time, not bytes.
    spread = queries.select(query, *on, "seq").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), query)
    known = references.select(*on, "ref_ordinal", "ref_name", "ref_seq")
    if sized.rows_of(known, "ref_seq") == 0 and not known.isEmpty():
        return _best_of_pairs(spread, known, on, query, scores, local)
    groups: dict[tuple, list] = {}
    for r in sorted(known.collect(), key=lambda r: (r["ref_ordinal"], r["ref_name"])):  # at most sized.BYTES
        groups.setdefault(tuple(r[c] for c in on), []).append((r["ref_name"], r["ref_seq"] or ""))
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    out = f"{query} {kinds[query]}, ref_name string, {ALIGNED}, aligned int".replace("query string, ref string", "query_aligned string, ref_aligned string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[tuple, Sketches] = {}
        fields = [f.split()[0] for f in ALIGNED.split(", ")]
        for batch in batches:
            symbols = sum(len(x or "") for x in batch.column("seq").to_pylist()) or 1
            many = max(QUERIES, min(1 << 13, SYMBOLS * batch.num_rows // symbols))
            for a in range(0, batch.num_rows, many):
                part = batch.slice(a, many)
                keys = list(zip(*(part.column(c).to_pylist() for c in on), strict=True)) if on else [()] * part.num_rows
                seqs = part.column("seq").to_pylist()
                by_key: dict[tuple, list[int]] = {}
                for k, key in enumerate(keys):
                    if key in groups:
                        by_key.setdefault(key, []).append(k)
                rows, place = [], []
                for key, places in by_key.items():
                    refs = [s for _, s in groups[key]]
                    if key not in sketches:
                        sketches[key] = Sketches(refs, scores)
                    for k, (r, al, n) in zip(places, winners([seqs[k] or "" for k in places], refs, scores, local, sketches[key], traced), strict=True):
                        place.append(k)
                        rows.append((groups[key][r][0], *(getattr(al, f) for f in fields), n))
                columns = list(zip(*rows, strict=True)) if rows else [()] * (len(fields) + 2)
                types = [pa.string(), pa.float64(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.int32()]
                told = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(query).take(pa.array(place, pa.int64())), *told], names=[f.split()[0] for f in out.split(", ")])

    found = spread.mapInArrow(run, out)
    return found.withColumnsRenamed({"query_aligned": "query", "ref_aligned": "ref"}) if query != "query" else found


def _best_of_pairs(queries: DataFrame, references: DataFrame, on: list[str], query: str, scores: Scores, local: bool) -> DataFrame:
    """``best_reference`` a row a pair: many references, by their key and a block."""
    n = max(1, references.count() // 10_000)
    blocks = references.withColumn("block", F.pmod(F.xxhash64("ref_name", "ref_ordinal"), F.lit(n)))
    pairs = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(blocks, [*on, "block"])
    scored = pairs.withColumn("al", aligner(scores, local)(F.col("seq"), F.col("ref_seq")))
    first = F.struct((-F.col("al.score")).alias("s"), "ref_ordinal", "ref_name")
    best = scored.groupBy(query).agg(F.min_by(F.struct("ref_name", "al"), first).alias("b"), F.count("*").cast("int").alias("aligned"))
    return best.select(query, F.col("b.ref_name").alias("ref_name"), "b.al.*", "aligned")


def quality(aa: Column, start: Column, end: Column, reference: Column, gene: genes.Gene) -> Column:
    """struct(status, compared, mutations, percent) of an extracted sequence, in columns alone."""
    seq = F.upper(F.coalesce(F.trim(aa), F.lit("")))
    valid = lambda c: c.isin(*genes.VALID_AA)
    span_ok = (end - start + 1) == F.length(seq)
    offsets = F.filter(F.split(seq, ""), lambda c: c != "")
    pairs = F.zip_with(offsets, F.filter(F.split(F.substring(reference, start, F.length(seq)), ""), lambda c: c != ""), lambda q, r: F.struct(q.alias("q"), r.alias("r")))
    said = F.when(span_ok & reference.isNotNull(), F.filter(pairs, lambda x: valid(x["q"]) & x["r"].isNotNull() & valid(x["r"])))
    compared = F.coalesce(F.size(said), F.lit(0))
    compared = F.when(compared < 0, 0).otherwise(compared)
    mutations = F.coalesce(F.aggregate(said, F.lit(0), lambda acc, x: acc + (x["q"] != x["r"]).cast("int")), F.lit(0))
    percent = F.when(compared > 0, F.lit(100.0) * mutations / compared).otherwise(0.0)
    status = F.when(seq == "", "NO_AA_SEQUENCE").when(start.isNull() | end.isNull(), "MISSING_AA_COORDINATES").when(~span_ok, "FLAGGED").when((compared >= gene.divergence_coverage) & (percent >= gene.divergence_percent), "HIGH_DIVERGENCE").otherwise("PASS")
    return F.struct(status.alias("status"), compared.alias("compared"), mutations.alias("mutations"), percent.alias("percent"))
