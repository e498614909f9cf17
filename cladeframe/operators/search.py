"""Seed-and-extend search of many sequences against references, as joins and one batched program.

1. References are cut into words (with neighbourhood words, for proteins); a word that
   stands in more than ``HOT_PLACES`` places of one reference is masked there.
2. Words of the queries meet them in a join; meetings are counted by (query, strand or
   frame, reference, diagonal) with map-side combining, so seeds are never shuffled one by
   one. Diagonals with too few seeds go.
3. Candidates of one query and reference come together with both sequences. Seeds are
   extended without gaps until the score drops by ``x_drop``; diagonals that reach
   ``trigger`` are merged into bands, and each band is aligned by ``pairbatch``. A pair that
   shares a masked word is aligned over its whole matrix instead: masking loses nothing.
4. One hit a query and reference is kept, if chance would give fewer than ``evalue`` such
   hits in the query's search space (Karlin-Altschul statistics).

Words, seeds and candidates are rows of DataFrames; the index is broadcast only if its
counted rows are few. Ambiguous symbols make no seeds and score as differences.

Cases: null and empty sequences, and those shorter than a word, have no hits; references
of one name are references of their own name's group, of which the best hit stays; equal
scores go to the forward strand, then to the earlier place; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe import genes, workdir
from cladeframe.operators import pairbatch, sized

HOT_PLACES = 64  # of a word in one reference
INDEX_ROWS = 2_000_000  # of an index that is broadcast
PAIRS = 2048  # candidates that are extended together

# Background frequencies of residues in per mille, in the order of their symbols.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
BACKGROUND = (78, 19, 54, 63, 39, 74, 22, 51, 57, 90, 22, 45, 52, 43, 51, 71, 58, 64, 13, 32)
#: Residues that replace each other often.
CLASSES = ("AST", "C", "DENQ", "FWY", "G", "HKR", "ILMV", "P")


def residue_matrix(same: int = 5, alike: int = 1, other: int = -2, stop: int = -4) -> np.ndarray:
    """Scores by character code: equal residues, residues of one class, others; X scores -1."""
    out = np.full((128, 128), stop, np.float64)
    known = [ord(c) for c in RESIDUES + "BZX"]
    out[np.ix_(known, known)] = other
    for members in CLASSES:
        at = [ord(c) for c in members]
        out[np.ix_(at, at)] = alike
    for c in RESIDUES:
        out[ord(c), ord(c)] = same
    out[ord("X"), known] = out[known, ord("X")] = -1
    return out


def base_matrix(match: int, mismatch: int) -> np.ndarray:
    out = np.full((128, 128), mismatch, np.float64)
    for c in "ACGT":
        out[ord(c), ord(c)] = match
    return out


def decay(matrix: np.ndarray, symbols: str, frequency: tuple[int, ...]) -> float:
    """The Karlin-Altschul lambda: the positive root of sum(p q exp(lambda s)) = 1, by bisection."""
    at = [ord(c) for c in symbols]
    p = np.array(frequency, float) / sum(frequency)
    weight, score = np.outer(p, p), matrix[np.ix_(at, at)]
    low, high = 1e-4, 5.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if (weight * np.exp(mid * score)).sum() > 1 else (mid, high)
    return low


@dataclass(frozen=True)
class Search:
    """``neighbours``: least score of a neighbourhood word with a reference's (None: equal words only). ``seeds``: least seeds on
    a diagonal. ``slack``: diagonals that a band goes beyond its seeds. ``decay``, ``k``: the statistics' parameters."""

    word: int
    matrix: np.ndarray
    gap_open: float  # of the first character
    gap_extend: float
    decay: float
    k: float
    symbols: str
    translated: bool = False
    neighbours: int | None = None
    seeds: int = 1
    x_drop: float = 20.0
    trigger: float = 26.0
    slack: int = 32
    evalue: float = 1e-6

    @property
    def costs(self) -> pairbatch.Costs:
        return pairbatch.Costs(gap_open=self.gap_open, gap_extend=self.gap_extend, matrix=self.matrix)

    def bits(self, score: float) -> float:
        return (self.decay * score - math.log(self.k)) / math.log(2)


#: Nucleotides against nucleotides, both strands: match 2, mismatch -3, a gap of n costs 5 + 2 n.
BASES = Search(11, base_matrix(2, -3), -7.0, -2.0, 0.625, 0.41, "ACGT")
#: Six translated frames against proteins: a gap of n costs 8 + n; lambda of ungapped scores, lowered for gaps.
TRANSLATED = Search(3, residue_matrix(), -9.0, -1.0, 0.85 * decay(residue_matrix(), RESIDUES, BACKGROUND), 0.04, RESIDUES, True, 11, 2, 16.0, 38.0, 24)

_COMPLEMENT = np.arange(128, dtype=np.uint8)
for _a, _b in zip(*genes.COMPLEMENT, strict=True):
    _COMPLEMENT[ord(_a)] = ord(_b)
_CODON_PLACE = np.full(128, 64, np.int64)
for _k, _c in enumerate(genes.BASES):
    _CODON_PLACE[ord(_c)] = _k
_RESIDUE = np.frombuffer((genes.CODE + "X").encode(), np.uint8)


def _bytes(seq: str | None) -> np.ndarray:
    raw = np.frombuffer((seq or "").upper().replace("U", "T").encode("ascii", "replace"), np.uint8)
    return raw


def readings(seq: np.ndarray, translated: bool) -> list[tuple[int, np.ndarray]]:
    """(strand or frame, symbols): both strands as 1 and -1, or six frames as 1 to 3 and -1 to -3."""
    both = ((1, seq), (-1, _COMPLEMENT[seq & 127][::-1]))
    if not translated:
        return list(both)
    out = []
    for sign, bases in both:
        place = _CODON_PLACE[bases & 127]
        for f in range(3):
            n = max(len(bases) - f, 0) // 3
            x = place[f : f + 3 * n].reshape(n, 3)
            codon = np.where((x < 4).all(1), x @ np.array([16, 4, 1]), 64)
            out.append((sign * (f + 1), _RESIDUE[codon]))
    return out


def proteins(seq: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(1, seq)]


def word_codes(seq: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of the words of known symbols."""
    number = np.full(128, -1, np.int64)
    number[[ord(c) for c in search.symbols]] = np.arange(len(search.symbols))
    x = number[seq & 127]
    total = len(x) - search.word + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.concatenate([[0], np.cumsum(x >= 0)])
    at = np.flatnonzero(known[search.word :] - known[:total] == search.word)
    code = np.zeros(len(at), np.int64)
    for j in range(search.word):
        code = code * len(search.symbols) + x[at + j]
    return at, code


def _with_neighbours(place: np.ndarray, code: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Every word that scores ``neighbours`` with a reference's word stands where that does."""
    a = len(search.symbols)
    at = [ord(c) for c in search.symbols]
    score = search.matrix[np.ix_(at, at)]
    every = np.arange(a**search.word)
    digits = [every // a**k % a for k in range(search.word)]
    places, codes = [], []
    kinds, inverse = np.unique(code, return_inverse=True)
    for k, word in enumerate(kinds.tolist()):
        total = sum(score[word // a**j % a][digits[j]] for j in range(search.word))
        near = every[(total >= search.neighbours) | (every == word)]
        own = place[inverse == k]
        places.append(np.repeat(own, len(near)))
        codes.append(np.tile(near, len(own)))
    return (np.concatenate(places), np.concatenate(codes)) if places else (place, code)


def _words(search: Search, of_query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, group, seq in zip(batch.column("name"), batch.column("grp"), batch.column("seq").to_pylist(), strict=True):
                for strand, symbols in readings(_bytes(seq), search.translated) if of_query else proteins(_bytes(seq)):
                    place, code = word_codes(symbols, search)
                    if not of_query and search.neighbours is not None:
                        place, code = _with_neighbours(place, code, search)
                    for a in range(0, len(place), 1 << 16):
                        n = len(place[a : a + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.repeat(name, n), pa.repeat(group, n), pa.array(np.full(n, strand, np.int32)), pa.array(place[a : a + n].astype(np.int32)), pa.array(code[a : a + n])], names=["name", "grp", "strand", "place", "word"])

    return run


def words(rows: DataFrame, name: str, seq: str, search: Search, of_query: bool) -> DataFrame:
    """name, grp, strand, place (from 0), word."""
    own = rows.select(F.col(name).alias("name"), "grp", F.col(seq).alias("seq"))
    return own.mapInArrow(_words(search, of_query), "name string, grp string, strand int, place int, word long")


def candidates(queries: DataFrame, references: DataFrame, search: Search) -> DataFrame:
    """query, ref, seeds (strand, diagonal, count, first place on the query; a null diagonal: the whole matrix): one row a pair that may have a hit."""
    of_refs = words(references, "ref", "ref_seq", search, False).withColumnRenamed("name", "ref").withColumnRenamed("place", "ref_place").drop("strand")
    of_queries = words(queries, "query", "seq", search, True).withColumnRenamed("name", "query")
    hot = of_refs.groupBy("word", "grp", "ref").count().filter(F.col("count") > HOT_PLACES).select("word", "grp", "ref")
    masks = bool(hot.take(1))
    index = of_refs.join(hot, ["word", "grp", "ref"], "left_anti") if masks else of_refs
    met = of_queries.join(sized.small(index, INDEX_ROWS), ["word", "grp"]).withColumn("diagonal", F.col("ref_place") - F.col("place"))
    both = met.groupBy("query", "ref", "strand", "diagonal").agg(F.count("*").cast("int").alias("n"), F.min("place").alias("place")).filter(F.col("n") >= search.seeds)
    if masks:  # else the queries' words are not made a second time
        masked = of_queries.join(sized.small(hot, INDEX_ROWS), ["word", "grp"]).select("query", "ref", "strand").distinct()
        both = both.unionByName(masked.withColumns({"diagonal": F.lit(None).cast("int"), "n": F.lit(1), "place": F.lit(0)}))
    # A pair has at most as many diagonals as both sequences have symbols.
    return both.groupBy("query", "ref").agg(F.collect_list(F.struct("strand", "diagonal", "n", "place")).alias("seeds"))


@dataclass
class Seeded:
    """One reading of a query, a reference, and the places of their seeds; ``whole``: a masked word is shared."""

    row: int
    strand: int
    query: np.ndarray
    ref: np.ndarray
    diagonal: np.ndarray
    place: np.ndarray
    whole: bool


def reaching(found: list[Seeded], search: Search) -> list[np.ndarray]:
    """Which seeds' extensions without gaps reach ``trigger`` before their score has dropped by ``x_drop``; the seeds of all pairs at once."""
    if not found:
        return []
    ends = [np.cumsum([0, *(len(x) for x in seqs)]) for seqs in ([f.query for f in found], [f.ref for f in found])]
    query, ref = np.concatenate([f.query for f in found]), np.concatenate([f.ref for f in found])
    n = [len(f.place) for f in found]
    owner = np.repeat(np.arange(len(found)), n)
    place = np.concatenate([f.place for f in found]).astype(np.int64)
    q, r = place + ends[0][owner], place + np.concatenate([f.diagonal for f in found]) + ends[1][owner]
    low_q, high_q, low_r, high_r = (e[owner + k] for e in ends for k in (0, 1))
    table = search.matrix
    total = np.zeros(len(q))
    for j in range(search.word):
        total += table[query[q + j], ref[r + j]]
    for step, away in ((1, search.word), (-1, -1)):
        score, best = np.zeros(len(q)), np.zeros(len(q))
        alive = np.flatnonzero(total < search.trigger)
        while len(alive):
            i, j = q[alive] + away, r[alive] + away
            inside = (i >= low_q[alive]) & (j >= low_r[alive]) & (i < high_q[alive]) & (j < high_r[alive])
            alive, i, j = alive[inside], i[inside], j[inside]
            score[alive] += table[query[i], ref[j]]
            best[alive] = np.maximum(best[alive], score[alive])
            alive = alive[(score[alive] > best[alive] - search.x_drop) & (total[alive] + best[alive] < search.trigger)]
            away += step
        total += best
    return np.split(total >= search.trigger, np.cumsum(n)[:-1])


def bands(found: Seeded, reached: np.ndarray, search: Search) -> list[tuple[int, int]]:
    """Bands of diagonals worth aligning."""
    if found.whole:
        return [(-len(found.query), len(found.ref))]
    out: list[list[int]] = []
    for d in np.sort(found.diagonal[reached]).tolist():
        if out and d - search.slack <= out[-1][1]:
            out[-1][1] = d + search.slack
        else:
            out.append([d - search.slack, d + search.slack])
    return [(a, b) for a, b in out]


HIT = "query string, ref string, length int, mismatch int, gaps int, pident double, evalue double, bitscore double, qstart int, qend int, sstart int, send int, frame int, qseq string, sseq string"


def _extended(search: Search):
    def told(row: dict, strand: int, symbols: np.ndarray, ref: np.ndarray, n: int, path: pairbatch.Path) -> tuple:
        a, b = path.rows(symbols, ref, ord("-"))
        gaps = int(((a == ord("-")) | (b == ord("-"))).sum())
        equal = int((a == b).sum())
        bits = search.bits(path.score)
        begin, end = path.query[0] + 1, path.query[1]
        s_begin, s_end = path.ref[0] + 1, path.ref[1]
        if search.translated:
            f = abs(strand) - 1
            begin, end = 3 * path.query[0] + f + 1, 3 * path.query[1] + f
            if strand < 0:
                begin, end = n - begin + 1, n - end + 1
        elif strand < 0:
            begin, end, s_begin, s_end = n - end + 1, n - begin + 1, s_end, s_begin
        evalue = max(len(symbols), 1) * row["space"] * 2.0**-bits
        return row["query"], row["ref"], len(a), len(a) - gaps - equal, gaps, 100.0 * equal / len(a), evalue, bits, begin, end, s_begin, s_end, strand, a.tobytes().decode(), b.tobytes().decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in HIT.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]] for f in HIT.split(", ")]
        for batch in batches:
            for part in range(0, batch.num_rows, PAIRS):
                rows = batch.slice(part, PAIRS).to_pylist()
                seeded = []
                for k, row in enumerate(rows):
                    ref = _bytes(row["ref_seq"]) & 127
                    read = dict(readings(_bytes(row["seq"]) & 127, search.translated))
                    by_strand: dict[int, list] = {}
                    for s in row["seeds"]:
                        by_strand.setdefault(s["strand"], []).append((s["diagonal"], s["place"]))
                    for strand in sorted(by_strand, key=lambda s: (s < 0, abs(s))):
                        at = [x for x in by_strand[strand] if x[0] is not None]
                        diagonal, place = (np.array(x, np.int64) for x in zip(*at, strict=True)) if at else (np.zeros(0, np.int64),) * 2
                        seeded.append(Seeded(k, strand, read[strand], ref, diagonal, place, len(at) < len(by_strand[strand])))
                jobs = [(x.row, x.strand, x.query, x.ref, band) for x, ok in zip(seeded, reaching(seeded, search), strict=True) for band in bands(x, ok, search)]
                paths = pairbatch.traced([j[2] for j in jobs], [j[3] for j in jobs], search.costs, [j[4] for j in jobs])
                best: dict[int, tuple] = {}  # of a pair's bands the first of the highest score
                for job, path in zip(jobs, paths, strict=True):
                    k = job[0]
                    if path.score > 0 and (k not in best or path.score > best[k][-1].score):
                        best[k] = rows[k], *job[1:4], len(rows[k]["seq"]), path
                out = [told(*best[k]) for k in sorted(best)]
                out = [x for x in out if x[6] <= search.evalue]
                columns = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    return run


def hits(queries: DataFrame, references: DataFrame, search: Search = BASES, on: str | None = None, targets: int | None = None) -> DataFrame:
    """The best hit of every query (query, seq) in every reference (ref, ref_seq) where it is significant; places from 1, as search programs write them.

    ``frame``: strand (1, -1) or frame (1 to 3, -1 to -3) of the query; of a reverse strand the
    reference's places run backwards, of a reverse frame the query's. ``on``: a column of both
    tables; queries meet the references of their own value only, which are their search space.
    ``targets``: the best references a query keeps.
    """
    group = F.lit("") if on is None else F.col(on).cast("string")
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda df, name, seq: df.filter(F.length(seq) > 0).select(F.col(name).cast("string").alias(name), F.col(seq).cast("string").alias(seq), group.alias("grp")).filter("grp is not null")
    known = own(references, "ref", "ref_seq").dropDuplicates(["ref"])
    # Read three times from here on: written once, so what makes the queries runs once. A number of partitions that stays: alignment
    # costs time, not bytes, and a join below must not leave the few bytes of many sequences to one task.
    asked = workdir.stored(own(queries, "query", "seq").dropDuplicates(["query"]).repartition(n), "asked")
    space = known.groupBy("grp").agg(F.sum(F.length("ref_seq")).alias("space"))
    of_ref = known.join(space, "grp").drop("grp")
    pairs = candidates(asked, known, search).repartition(n, "query").join(asked.drop("grp"), "query").join(sized.small(of_ref, sized.rows_of(known, "ref_seq")), "ref")
    found = pairs.mapInArrow(_extended(search), HIT)
    if targets is None:
        return found
    order = Window.partitionBy("query").orderBy(F.desc("bitscore"), F.desc("length"), "ref")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= targets).drop("nth")


def as_targets(found: DataFrame, references: DataFrame, target: str) -> DataFrame:
    """Hits in the shape that ``operators.hits`` chooses from: query, target, ..., ordinal (the reference's place); ``references``: ref, ``target``, ordinal."""
    named = references.select("ref", F.col(target).alias("target"), "ordinal").dropDuplicates(["ref"])
    return found.join(sized.small(named), "ref").drop("ref")
