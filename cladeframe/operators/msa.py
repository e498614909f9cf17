"""Progressive multiple alignment: a guide tree from word counts, then profiles merged level by level.

1. Distances: the share of words that two sequences don't have in common, from a join of
   word counts (only pairs that share a word have a row; others are at distance 1).
2. The guide tree joins the nearest clusters first (average linkage). It needs a number a
   pair of sequences, so there may be ``MOST`` sequences; sequences stay in their rows.
3. All merges of one level of the tree run in parallel: a merge is a row with the members
   of two profiles, aligned by an affine program whose column score is the mean score of
   all pairs of symbols. A level is written before the next, so a lost executor costs one
   level.
4. Refinement (of up to ``REFINED`` rows: a round costs their square): each row in turn is
   taken out and aligned anew with the profile of the others; the better sum of pairs stays.

Cases: one sequence is its own alignment; empty sequences become gaps; equal names are told
apart by nothing and fail; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe import workdir
from cladeframe.operators import search

MOST = 2_000  # sequences: consensus and reference sequences, never a cohort
REFINED = 100
GAP = ord("-")


@dataclass(frozen=True)
class Scoring:
    """``matrix`` by character code; gaps: the first column costs ``gap_open``, further ones ``gap_extend``. ``word``: of the distances. ``rounds`` of refinement."""

    matrix: np.ndarray
    symbols: str
    gap_open: float
    gap_extend: float
    word: int
    rounds: int = 2


RESIDUES = Scoring(search.residue_matrix(), search.RESIDUES + "X*", -9.0, -1.0, 3)
BASES = Scoring(search.base_matrix(2, -1), "ACGTN", -5.0, -1.0, 6)


def _profile(rows: list[str], symbols: str) -> np.ndarray:
    """Share of each symbol by column; what is missing to 1 is gaps."""
    codes = np.frombuffer("".join(rows).encode("latin-1", "replace"), np.uint8).reshape(len(rows), -1)
    return np.stack([(codes == ord(c)).mean(0) for c in symbols], 1) if codes.size else np.zeros((0, len(symbols)))


def _path(one: np.ndarray, two: np.ndarray, scoring: Scoring) -> np.ndarray:
    """Steps (0 both, 1 column of the second alone, 2 of the first alone) of the best alignment of two profiles."""
    at = [ord(c) for c in scoring.symbols]
    pair = one @ scoring.matrix[np.ix_(at, at)] @ two.T
    n, m = len(one), len(two)
    # A gap against a column costs as much as the column has symbols.
    weight_one, weight_two = one.sum(1), two.sum(1)
    low = -1e18
    stay, left, up = (np.full((n + 1, m + 1), low) for _ in range(3))
    stay[0, 0] = 0
    opened, extended = scoring.gap_open, scoring.gap_extend
    step = np.concatenate([[0], np.cumsum(extended * weight_two)])
    first = (opened - extended) * weight_two
    if m:
        left[0, 1:] = step[1:] + first[0]
    if n:
        up[1:, 0] = np.cumsum(extended * weight_one) + (opened - extended) * weight_one[0]
    for i in range(1, n + 1):
        stay[i, 1:] = np.maximum(np.maximum(stay[i - 1], left[i - 1]), up[i - 1])[:-1] + pair[i - 1]
        up[i] = np.maximum(up[i], np.maximum(np.maximum(stay[i - 1], left[i - 1]) + opened * weight_one[i - 1], up[i - 1] + extended * weight_one[i - 1]))
        run = np.maximum.accumulate(np.maximum(stay[i], up[i])[:-1] - step[:-1] + first) if m else np.zeros(0)
        left[i, 1:] = run + step[1:]
    out, i, j = [], n, m
    kind = int(np.argmax([stay[n, m], left[n, m], up[n, m]]))
    close = lambda x, y: abs(x - y) < 1e-7
    while i or j:
        out.append(kind)
        if kind == 0:
            i, j = i - 1, j - 1
            kind = int(np.argmax([stay[i, j], left[i, j], up[i, j]]))
        elif kind == 1:
            here, j = left[i, j], j - 1
            kind = 1 if close(left[i, j] + extended * weight_two[j], here) else 0 if stay[i, j] >= up[i, j] else 2
        else:
            here, i = up[i, j], i - 1
            kind = 2 if close(up[i, j] + extended * weight_one[i], here) else 0 if stay[i, j] >= left[i, j] else 1
    return np.array(out[::-1], np.int8)


def merge(one: list[str], two: list[str], scoring: Scoring) -> tuple[list[str], list[str]]:
    """Both profiles' rows in the columns of their alignment."""
    path = _path(_profile(one, scoring.symbols), _profile(two, scoring.symbols), scoring)

    def laid(rows: list[str], has: np.ndarray) -> list[str]:
        out = np.full((len(rows), len(path)), GAP, np.uint8)
        out[:, has] = np.frombuffer("".join(rows).encode("latin-1", "replace"), np.uint8).reshape(len(rows), -1)
        return [r.tobytes().decode("latin-1") for r in out]

    return laid(one, path != 1), laid(two, path != 2)


def _packed(rows: list[str]) -> list[str]:
    """Rows without the columns that are gaps in all."""
    codes = np.frombuffer("".join(rows).encode("latin-1", "replace"), np.uint8).reshape(len(rows), -1)
    return [r.tobytes().decode("latin-1") for r in codes[:, (codes != GAP).any(0)]]


def sum_of_pairs(rows: list[str], scoring: Scoring) -> float:
    """Summed scores of all pairs of rows; a pair's columns of two gaps don't count."""
    codes = np.frombuffer("".join(rows).encode("latin-1", "replace"), np.uint8).reshape(len(rows), -1)
    total = 0.0
    for i in range(len(rows)):
        for j in range(i):
            a, b = codes[i], codes[j]
            both = (a != GAP) | (b != GAP)
            a, b = a[both], b[both]
            kind = np.where(a == GAP, 1, np.where(b == GAP, 2, 0))
            total += scoring.matrix[a[kind == 0], b[kind == 0]].sum()
            opens = (kind > 0) & np.concatenate([[True], kind[1:] != kind[:-1]])[: len(kind)]
            total += scoring.gap_open * opens.sum() + scoring.gap_extend * ((kind > 0).sum() - opens.sum())
    return float(total)


def refine(rows: list[str], scoring: Scoring) -> list[str]:
    """Takes each row out and aligns it with the others again, while the sum of pairs grows."""
    best = sum_of_pairs(rows, scoring)
    for _ in range(scoring.rounds):
        before = best
        for k in range(len(rows)):
            rest = _packed([r for i, r in enumerate(rows) if i != k]) if len(rows) > 1 else []
            if not rest:
                return rows
            other, own = merge(rest, [rows[k].replace("-", "")], scoring)
            tried = [*other[:k], *own, *other[k:]]
            score = sum_of_pairs(tried, scoring)
            if score > best + 1e-9:
                rows, best = tried, score
        if best <= before + 1e-9:
            break
    return rows


def distances(seqs: DataFrame, scoring: Scoring) -> DataFrame:
    """(a, b, distance), a < b, of sequences that share a word."""
    at = F.sequence(F.lit(1), F.length("seq") - scoring.word + 1)
    words = seqs.filter(F.length("seq") >= scoring.word).select("name", F.explode(F.transform(at, lambda k: F.substring("seq", k, F.lit(scoring.word)))).alias("word"))
    counts = words.groupBy("name", "word").agg(F.count("*").alias("n"))
    one, two = (counts.select(F.col("name").alias(x), "word", F.col("n").alias(f"n_{x}")) for x in "ab")
    common = one.join(two, "word").filter("a < b").groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("common"))
    size = seqs.select("name", F.greatest(F.length("seq") - scoring.word + 1, F.lit(1)).alias("words"))
    sizes = lambda x: size.select(F.col("name").alias(x), F.col("words").alias(f"words_{x}"))
    return common.join(sizes("a"), "a").join(sizes("b"), "b").select("a", "b", (1 - F.col("common") / F.least("words_a", "words_b")).alias("distance"))


def guide_tree(names: list[str], near: dict[tuple[str, str], float]) -> list[tuple[int, int, int]]:
    """Merges (left, right, level) by average linkage; node k < n is names[k], node n + i the i-th merge. Equal distances: the earlier nodes."""
    n = len(names)
    place = {x: k for k, x in enumerate(names)}
    d = np.full((2 * n, 2 * n), np.inf)
    d[:n, :n] = 1.0
    for (a, b), v in near.items():
        d[place[a], place[b]] = d[place[b], place[a]] = v
    np.fill_diagonal(d, np.inf)
    size, level = np.ones(2 * n), np.zeros(2 * n, int)
    alive = np.zeros(2 * n, bool)
    alive[:n] = True
    out = []
    for new in range(n, 2 * n - 1):
        at = np.flatnonzero(alive)
        own = d[np.ix_(at, at)]
        i, j = np.unravel_index(int(own.argmin()), own.shape)
        a, b = sorted((int(at[i]), int(at[j])))
        level[new] = max(level[a], level[b]) + 1
        out.append((a, b, int(level[new])))
        d[new, at] = d[at, new] = (size[a] * d[a, at] + size[b] * d[b, at]) / (size[a] + size[b])
        size[new] = size[a] + size[b]
        alive[[a, b]], alive[new] = False, True
        d[new, new] = np.inf
    return out


PROFILE = "node int, names array<string>, rows array<string>"


def _merged(scoring: Scoring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                one, two = merge(r["rows"], r["right_rows"], scoring)
                out.append((r["parent"], [*r["names"], *r["right_names"]], [*one, *two]))
            nodes, names, rows = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array(names, pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string()))], names=["node", "names", "rows"])

    return run


def progressive(seqs: DataFrame, scoring: Scoring = RESIDUES) -> DataFrame:
    """name, aligned of every sequence (name, seq), all of one length."""
    spark = seqs.sparkSession
    own = workdir.stored(seqs.select(F.col("name").cast("string").alias("name"), F.upper(F.coalesce(F.col("seq"), F.lit(""))).alias("seq")), "msa-sequences")
    names = sorted(r["name"] for r in own.select("name").limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} sequences to align")
    if len(set(names)) < len(names):
        raise ValueError("names of sequences to align are not unique")
    if not names:
        return spark.createDataFrame([], "name string, aligned string")
    near = {(r["a"], r["b"]): r["distance"] for r in distances(own, scoring).collect()}  # at most MOST squared
    tree = guide_tree(names, near)
    number = spark.createDataFrame(list(enumerate(names)), "node int, name string")
    profiles = own.join(number, "name").select("node", F.array("name").alias("names"), F.array("seq").alias("rows"))
    for level in range(1, max((x[2] for x in tree), default=0) + 1):
        merges = [(len(names) + k, a, b) for k, (a, b, at) in enumerate(tree) if at == level]
        plan = spark.createDataFrame(merges, "parent int, node int, other int")
        right = profiles.select(F.col("node").alias("other"), F.col("names").alias("right_names"), F.col("rows").alias("right_rows"))
        pairs = profiles.join(F.broadcast(plan), "node").join(right, "other").repartition(len(merges), "parent")
        used = [x for m in merges for x in m[1:]]
        rest = profiles.join(F.broadcast(spark.createDataFrame([(x,) for x in used], "node int")), "node", "left_anti")
        profiles = workdir.stored(rest.unionByName(pairs.mapInArrow(_merged(scoring), PROFILE)), "msa-level")

    @F.pandas_udf("array<string>")
    def refined(rows):
        return rows.map(lambda r: refine(list(r), scoring))

    whole = profiles.withColumn("rows", refined("rows")) if scoring.rounds and 1 < len(names) <= REFINED else profiles
    return whole.select(F.explode(F.arrays_zip("names", "rows")).alias("x")).select(F.col("x.names").alias("name"), F.col("x.rows").alias("aligned"))
