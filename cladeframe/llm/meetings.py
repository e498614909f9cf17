"""Groups of documents that share a token, cut so that a task can hold one.

Tokens (shingles of a prefix, keys of a band) are dealt to tasks; documents with the
same token meet. A set of documents meets once, however many tokens it shares, and the
meetings of one smallest document are one group where their union is hardly larger
than the largest of them. Meetings above ``MEETING`` rows or ``WEIGHT`` are hot: their
documents are dealt to blocks, and what the blocks leave apart is held against each
other in pairs of blocks (``crossed``), so no task ever holds a hot meeting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import graph, shared, text

MEETING = 1024  # rows of a group, about
WEIGHT = 1 << 21  # and their summed weight
SMALL = 64  # rows of a group that cost next to nothing
LONG_RUN = 1 << 18  # rows of one token beyond which they pass on without being compared to other tokens' rows
U64 = np.uint64


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(key)]]))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables with whole runs of a sorted key, from batches in that order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(column, column[-1]))
        if cut or (held and held[-1].column(key)[-1].as_py() != column[0]):
            if cut:
                held.append(batch.slice(0, cut))
            if held:
                yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Which documents the links so far connect."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their token: every set of several documents once, under a key of the set."""
    seen = np.zeros(0, U64)

    def told(columns: list[np.ndarray], plain: bool) -> pa.RecordBatch:
        nonlocal seen
        tok, doc, n = columns
        start, size = runs(tok)
        if plain:
            key, keep = text.mix(tok.view(U64) ^ U64(0x5DEECE66D)), np.ones(len(tok), bool)
        else:
            sums = text.mix(np.add.reduceat(text.mix(doc.view(U64) + U64(7)), start) + size.astype(U64)) if len(tok) else np.zeros(0, U64)
            first = np.zeros(len(sums), bool)
            first[np.unique(sums, return_index=True)[1]] = True
            first &= (size > 1) & ~np.isin(sums, seen)
            seen = np.concatenate([seen, sums[first]])[-LONG_RUN:]
            key, keep = np.repeat(sums, size), np.repeat(first, size)
        return pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(doc[keep]), pa.array(n[keep])], names=["key", "doc_id", "n"])

    held, streamed = [np.zeros(0, np.int64)] * 3, None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tok", "doc_id", "n")]
        if not len(columns[0]):
            continue
        if streamed is not None:  # the rest of a long run
            m = int(np.searchsorted(columns[0], streamed, "right"))
            if m:
                yield told([c[:m] for c in columns], True)
            columns = [c[m:] for c in columns]
            if not len(columns[0]):
                continue
            streamed = None
        columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        yield told([c[:cut] for c in columns], False)
        held = [c[cut:] for c in columns]
        if len(held[0]) > LONG_RUN:
            streamed = int(held[0][0])
            yield told(held, True)
            held = [np.zeros(0, np.int64)] * 3
    yield told(held, False)


def meetings(tokens: DataFrame, n_parts: int, frequent: DataFrame | None = None) -> DataFrame:
    """key, doc_id, n of (tok, doc_id, n), stored. Rows of tokens known to be ``frequent`` are not brought together here."""
    dealt = tokens.repartition(n_parts, "tok").sortWithinPartitions("tok")
    met = dealt.mapInArrow(text.released(_met), "key long, doc_id long, n long")
    if frequent is not None:
        met = met.unionByName(frequent.select(F.col("tok").alias("key"), "doc_id", "n"))
    return shared.stored(met.distinct(), "meetings")


def keys_of(met: DataFrame) -> DataFrame:
    """key, c, w, s (tasks it is cut for) of meetings of several documents, stored."""
    keys = met.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("w")).filter("c > 1")
    s = F.greatest(F.ceil(F.col("c") / MEETING), F.ceil(F.col("w") / WEIGHT)).cast("int")
    return shared.stored(keys.withColumn("s", s), "keys")


def merged(rows: DataFrame) -> DataFrame:
    """gid, doc_id, n and other columns of the document: groups of one smallest document are one where their union is SMALL or hardly larger than the largest."""
    sizes = rows.groupBy("gid").agg(F.count("*").alias("c"), F.min("doc_id").alias("root"))
    named = rows.join(sizes, "gid")
    unions = named.groupBy("root", "doc_id").agg(F.max("c").alias("c"), F.max("n").alias("n")).groupBy("root").agg(F.count("*").alias("docs"), F.max("c").alias("c"), F.sum("n").alias("w"))
    one = unions.filter((F.col("docs") <= F.greatest(2 * F.col("c"), F.lit(SMALL))) & (F.col("w") <= 2 * WEIGHT)).select("root", F.lit(True).alias("one"))
    gid = F.when(F.col("one"), F.xxhash64("root", F.lit("root"))).otherwise(F.col("gid"))
    return named.join(one, "root", "left").select(gid.alias("gid"), *(c for c in rows.columns if c != "gid")).distinct()


def gathered(rows: DataFrame) -> DataFrame:
    """gid, doc_id, n, comp, side: groups that share documents are one where a task can hold them; groups with sides stay."""
    roots = rows.filter("side = 0").groupBy("gid").agg(F.min("doc_id").alias("a"))
    edges = shared.stored(rows.filter("side = 0").join(roots, "gid").select("gid", "a", F.col("doc_id").alias("b"), "n"), "edges")
    comp = graph.components(edges)
    if edges.isEmpty():
        return rows
    named = edges.join(comp.withColumnRenamed("node", "a"), "a").select("gid", "component", F.col("b").alias("doc_id"), "n")
    sizes = named.groupBy("component", "doc_id").agg(F.max("n").alias("n")).groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    new = named.join(sizes.filter((F.col("c") <= MEETING) & (F.col("w") <= WEIGHT)), "component").select("gid", F.xxhash64("component", F.lit("gathered")).alias("new")).distinct()
    return rows.join(new, "gid", "left").select(F.coalesce("new", "gid").alias("gid"), "doc_id", "n", "comp", "side").distinct()


def cold_groups(met: DataFrame, keys: DataFrame) -> DataFrame:
    """gid, doc_id, n: meetings that one task can hold."""
    return merged(met.join(keys.filter("s = 1").select("key"), "key").withColumnRenamed("key", "gid"))


def _named(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("comp", F.col("doc_id"))
    return rows.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


def hot_blocks(met: DataFrame, keys: DataFrame, comp: DataFrame | None, seed: int) -> DataFrame:
    """gid, doc_id, n, comp: hot meetings dealt to blocks by a hash of the document; of those of one component nothing."""
    rows = _named(met.join(keys.filter("s > 1").select("key", "s"), "key"), comp)
    if comp is not None:
        apart = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        rows = rows.join(apart, "key", "left_semi")
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("s").cast("long"))
    return rows.select(F.xxhash64("key", F.lit(seed), block).alias("gid"), "doc_id", "n", "comp")


def crossed(met: DataFrame, keys: DataFrame, comp: DataFrame | None) -> DataFrame:
    """gid, doc_id, n, comp, side: every pair of blocks of a hot meeting, its largest component's rows on one side only."""
    rows = _named(met.join(keys.filter("s > 1").select("key", "s"), "key"), comp)
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    told = sizes.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"), F.max("m").alias("most"), F.sum("w").alias("w"), F.max_by("w", F.struct("m", "comp")).alias("top_w")).filter("m > most")
    told = told.select("key", "top", F.greatest(F.ceil((F.col("m") - F.col("most")) / MEETING), F.ceil((F.col("w") - F.col("top_w")) / WEIGHT)).cast("int").alias("t"))
    rows = rows.join(told, "key")
    own = lambda of: F.pmod(F.xxhash64("doc_id"), F.col(of).cast("long")).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    one = rows.withColumn("a", own("s")).withColumn("b", every("t")).withColumn("side", F.lit(1))
    two = rows.filter("comp != top").withColumn("b", own("t")).withColumn("a", every("s")).withColumn("side", F.lit(2))
    return one.unionByName(two).select(F.xxhash64("key", F.lit("crossed"), "a", "b").alias("gid"), "doc_id", "n", "comp", "side")


Verify = Callable[[DataFrame], DataFrame]


def connected(met: DataFrame, verify: Verify, more: DataFrame | None = None) -> DataFrame | None:
    """(node, component) over all links between documents that meet, or None where there are none.

    ``verify`` takes groups (gid, doc_id, n, comp, side) and returns links (a, b) that
    connect all linked pairs of a group that differ in comp and don't have the same
    side above 0. ``more``: links known from elsewhere.
    """
    keys = keys_of(met)
    hot = not keys.filter("s > 1").isEmpty()
    groups = _named(cold_groups(met, keys), None)
    if hot:
        groups = groups.unionByName(hot_blocks(met, keys, None, 1))
    links = shared.stored(verify(groups.withColumn("side", F.lit(0))), "links")
    if more is not None:
        links = links.unionByName(more)
    comp = None if links.isEmpty() else shared.stored(graph.components(links), "components")
    for step in (1, 2) if hot else ():
        # Blocks dealt anew first connect most of what other blocks hold; then all that is left is crossed.
        rest = hot_blocks(met, keys, comp, 2).withColumn("side", F.lit(0)) if step == 1 else crossed(met, keys, comp)
        found = shared.stored(verify(rest), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            comp = shared.stored(graph.components(links), "components")
    return comp
