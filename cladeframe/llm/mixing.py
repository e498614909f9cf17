"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).
A pattern offers its words once at no cost, again at a cost of 1 a word, then 2 and so
on: a convex repetition cost. The flow that fills every source's quota at least cost
is found on the patterns alone, by successive shortest paths. Each pattern's
documents then stand in a seeded order; the flow takes them from the front, whole
documents at a time, and the last gap is filled with the best-fitting of a few
further documents of each size. Only patterns and those few (both bounded) reach the
driver; every other step is an aggregation, or a window within one of BUCKETS hash
buckets of a pattern, so a hot source is spread over many tasks.

Cases: null text has size 0; a null source is a source of its own, sorted last;
sources without words have target 0; repeated rows are documents of their own; reruns
agree; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm import shared, text

BUCKETS = 4096
MAX_PATTERNS = 100_000  # membership patterns that the driver accepts
NO_SOURCE = "-"  # a null source; others are written with a leading '+'


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text.string_slices(batch.column("text")):
            n = text.Words(data, offsets, lower=False).count
            yield pa.RecordBatch.from_arrays([batch.column(c)[first:last] for c in ("doc_id", "pattern")] + [pa.array(n.astype(np.int64))], names=["doc_id", "pattern", "size"])


def source_key(source: F.Column) -> F.Column:
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(NO_SOURCE))


def _order(key: str) -> tuple[bool, str]:
    return key == NO_SOURCE, key


def capped_shares(sizes: dict[str, int], weights: dict[str, float], budget: float, most: float) -> dict[str, float]:
    """The budget by weight; a share stops at ``most`` times its size, the excess is shared again until none is above."""
    target: dict[str, float] = {}
    free = sorted(sizes, key=_order)
    while free:
        left, total = budget - sum(target.values()), sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / total > most * sizes[k]]
        if not over:
            target |= {k: left * weights[k] / total for k in free}
            break
        target |= {k: float(most * sizes[k]) for k in over}
        free = [k for k in free if k not in target]
    return target


@dataclass
class Flow:
    """words[p, s]: words of pattern p that go to source s."""

    words: dict[tuple[int, str], int]
    unmet: dict[str, int]


def min_cost_flow(patterns: list[tuple[tuple[str, ...], int]], quota: dict[str, int], copies: int) -> Flow:
    """Fill quotas from patterns (sources, words); the k-th copy of a word costs k - 1.

    Successive shortest paths from a source with unmet quota over patterns and the
    flows they already send elsewhere to spare capacity. Paths are few: each fills a
    quota, uses up a copy or turns a flow round. Quotas that no pattern can fill stay unmet.
    """
    sent: dict[tuple[int, str], int] = {}
    used = [0] * len(patterns)
    unmet = {s: int(q) for s, q in quota.items()}
    member: dict[str, list[int]] = {}
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            member.setdefault(s, []).append(p)
    for start in sorted(quota, key=_order):
        while unmet[start] > 0:
            # Dijkstra over copies' levels: a pattern's cost is its next copy's, a turned flow costs nothing.
            seen_s, seen_p = {start: None}, {}
            heap, stack = [], [start]
            best = None
            while stack:
                s = stack.pop()
                for p in member.get(s, ()):
                    if p in seen_p:
                        continue
                    seen_p[p] = s
                    words = patterns[p][1]
                    if words and used[p] < copies * words:
                        heapq.heappush(heap, (used[p] // words, p))
                    for other in patterns[p][0]:
                        if other not in seen_s and sent.get((p, other), 0) > 0:
                            seen_s[other] = p
                            stack.append(other)
            if heap:
                best = heap[0][1]
            if best is None:
                break
            words = patterns[best][1]
            room = words - used[best] % words
            amount, path, p = min(unmet[start], room), [], best
            while True:
                s = seen_p[p]
                path.append((p, s))
                if s == start:
                    break
                q = seen_s[s]
                amount = min(amount, sent[q, s])
                p = q
            # The last link gives to a source that gives back what another pattern sent it.
            for p, s in path:
                sent[p, s] = sent.get((p, s), 0) + amount
                if s != start:
                    q = seen_s[s]
                    sent[q, s] -= amount
            used[best] += amount
            unmet[start] -= amount
    return Flow({k: v for k, v in sent.items() if v}, {s: v for s, v in unmet.items() if v})


def sized(docs: DataFrame, sources: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pattern (sorted source keys), size in words; stored."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), sources.alias("pattern"), F.col(text_col).cast("string").alias("text"))
    return shared.stored(own.mapInArrow(text.released(_sizes), "doc_id long, pattern array<string>, size long"), "sizes")


def pattern_sizes(rows: DataFrame) -> list[tuple[tuple[str, ...], int]]:
    """(sources, words) of every membership pattern, in a fixed order."""
    found = rows.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    return sorted(((tuple(r["pattern"]), int(r["words"])) for r in found), key=lambda x: [_order(s) for s in x[0]])


def mix(rows: DataFrame, patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, float], copies: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, pattern, size, copies, taken for ``rows`` of ``sized``: how often the mix takes each document.

    ``targets``: words by source key. Flows to several sources of one pattern are taken
    from its one seeded order, one after another.
    """
    flow = min_cost_flow(patterns, {s: round(t) for s, t in targets.items()}, copies)
    total: dict[int, int] = {}
    for (p, _), words in flow.words.items():
        total[p] = total.get(p, 0) + words
    plan = [(list(s), total.get(p, 0) // w if w else 0, total.get(p, 0) % w if w else 0) for p, (s, w) in enumerate(patterns)]
    spark = rows.sparkSession
    plans = spark.createDataFrame(plan, "pattern array<string>, whole long, rest long")
    h = F.xxhash64("doc_id", F.lit(seed))
    keyed = rows.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 52))
    base = keyed.groupBy("pattern", "bucket").agg(F.sum("size").alias("w"))
    before = base.select("pattern", "bucket", (F.sum("w").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("w")).alias("before"))
    # Ascending unsigned h: buckets in order, then h within a bucket.
    within = Window.partitionBy("pattern", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("upto", F.sum("size").over(within)).join(before, ["pattern", "bucket"]).join(F.broadcast(plans), "pattern")
    placed = placed.withColumn("inside", F.col("before") + F.col("upto") <= F.col("rest"))
    placed = shared.stored(placed.select("doc_id", "pattern", "size", "h", "whole", "rest", "inside"), "placed")
    extra = spark.createDataFrame(_fill(placed), "doc_id long, h long, size long, extra boolean")
    out = placed.join(F.broadcast(extra), ["doc_id", "h", "size"], "left")
    n = F.col("whole") + (F.col("inside") | F.coalesce("extra", F.lit(False))).cast("long")
    return out.select("doc_id", "pattern", "size", n.alias("copies"), (n * F.col("size")).alias("taken"))


def _fill(placed: DataFrame) -> list[tuple[int, int, int, bool]]:
    """Documents that close the gap of each pattern: of eight first by hash of every power-of-two size."""
    gaps = {tuple(r["pattern"]): int(r["gap"]) for r in placed.groupBy("pattern", "rest").agg((F.col("rest") - F.sum(F.when(F.col("inside"), F.col("size")).otherwise(0))).alias("gap")).collect()}
    outside = placed.filter(~F.col("inside") & (F.col("size") > 0) & (F.col("rest") > 0) & F.col("doc_id").isNotNull())
    kinds = outside.groupBy("pattern", F.floor(F.log2("size")).alias("kind"), F.pmod("h", F.lit(8)).alias("slot")).agg(F.min(F.struct("h", "doc_id", "size")).alias("d"))
    few: dict[tuple[str, ...], list] = {}
    for r in kinds.collect():
        few.setdefault(tuple(r["pattern"]), []).append(r["d"])
    out = []
    for pattern, found in few.items():
        gap = gaps[pattern]
        rest = []
        for d in sorted(found, key=lambda d: (-d["size"], d["h"], d["doc_id"])):
            if d["size"] <= gap:
                out.append((d["doc_id"], d["h"], d["size"], True))
                gap -= d["size"]
            else:
                rest.append(d)
        over = min(rest, key=lambda d: (d["size"], d["h"]), default=None)
        if over is not None and over["size"] - gap < gap:
            out.append((over["doc_id"], over["h"], over["size"], True))
    return out


def cycle_weights(keys: list[str], cycle: tuple[float, ...]) -> dict[str, float]:
    return {k: cycle[i % len(cycle)] for i, k in enumerate(sorted(keys, key=_order))}


def repeated(docs: DataFrame, sources: F.Column, targets, copies: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, as often as the mix takes them; ``targets`` makes words by source of sizes by source."""
    rows = sized(docs, sources, id_col, text_col)
    patterns = pattern_sizes(rows)
    sizes: dict[str, int] = {}
    for members, words in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + words
    mixed = mix(rows, patterns, targets(sizes), copies, seed)
    # Rows of one id go alike, as often as the first of them.
    own, times, copy = (shared.fresh(docs, c) for c in ("mixed_id", "mixed_copies", "mixed_copy"))
    often = shared.stored(mixed.groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").cast("int").alias(times)).filter(F.col(times) > 0), "copies")
    joined = docs.join(shared.sized_broadcast(often), docs[id_col].cast("long").eqNullSafe(F.col(own)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))
