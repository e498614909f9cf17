"""Exact Jaccard self-join of documents' word-shingle sets.

Count vectors: a set's shingles are hashed to 64 groups, and the counts by group are
a point. The summed coordinate minima of two points bound the overlap of their sets
from above, those of two boxes' upper corners that of all pairs in them. Documents
that share a shingle of their prefix meet (two linked sets share one of the first
``n - ceil(t n) + 1`` shingles in any fixed order; shingles that are frequent in a
bounded sample come last, which changes no result). A meeting's points are packed into
an R-tree by size and the widest coordinates; the tree is held against itself from the
root down, and pairs of boxes whose bound admits no link are passed over. Documents
with an admitted partner go on with their whole sets, and pairs are verified where they
meet: only links that connect something new leave a task, so a group of near copies
yields a forest, not all its pairs. Documents with equal sets are one class from the
start; meetings too large for a task are cut (see ``meetings``).

Cases: null and empty texts have the empty set and are linked with nothing; a text
of fewer words than a shingle has one shingle of all its words; very long texts are
taken whole; rows of one id are one document as far as links go, and come back each
with its own size; rows without an id are documents that never name a component (it is
null where no linked document has an id); ids are below 2**62; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import graph, meetings, shared, text

GROUPS = 64
LEAF = 64  # points in a leaf of the R-tree
SAMPLE_DOCS = 16_384  # documents whose shingles decide which are frequent
FREQUENT = 400  # of one in so many sampled documents
SALTS = 16
HASH_BITS = 48  # of a shingle
LATE = 1 << 47  # tokens of frequent shingles have this bit
NO_ID = 1 << 62  # keys of rows without an id are above
U64 = np.uint64


def needed(n, percent: int):
    """Least overlap of a set of n shingles with any linked set."""
    return (n * percent + 99) // 100


def _linkable(overlap: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def _sorted_by_owner(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values below 2**48 in one sort: by owner (below 2**16), then by value."""
    whole = owner.astype(U64) << U64(HASH_BITS) | value
    whole.sort()
    return whole


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles ascending and distinct by document, bounds)."""
    for first, last, data, offsets in text.string_slices(column):
        for a in range(0, last - first, 1 << 15):  # rows of short texts
            b = min(last - first, a + (1 << 15))
            doc, h = text.shingle_hashes(text.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), k)
            whole = _sorted_by_owner(doc, h >> U64(64 - HASH_BITS))
            keep = np.ones(len(whole), bool)
            keep[1:] = whole[1:] != whole[:-1]
            whole = whole[keep]
            yield first + a, first + b, whole & U64((1 << HASH_BITS) - 1), np.searchsorted(whole, np.arange(b - a + 1, dtype=U64) << U64(HASH_BITS))


def _packed(counts: np.ndarray) -> bytes:
    """One byte a group where all are small, else four; the first byte says which."""
    wide = len(counts) > 0 and counts.max() > 255
    return (b"\4" if wide else b"\1") + counts.astype(np.uint32 if wide else np.uint8).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8 if packed[0] == 1 else np.uint32, offset=1).astype(np.uint32)


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts by fewer groups; both numbers are powers of two."""
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(1, dtype=np.uint32)


def _featurizer(k: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, value, bounds in _sets(batch.column("text"), k):
                m, n = last - first, np.diff(bounds)
                owner = np.repeat(np.arange(m), n)
                counts = np.bincount(owner * GROUPS + (value >> U64(HASH_BITS - 6)).astype(np.int64), minlength=m * GROUPS).reshape(m, GROUPS)
                mixed = text.mix(value ^ U64(0xA5A5A5A5DEADBEEF))
                ends = np.concatenate([[0], np.cumsum(text.mix(value), dtype=U64)]), np.concatenate([[0], np.cumsum(mixed, dtype=U64)])
                # An order unrelated to the groups: the mixed value; it names the token too.
                tok = mixed >> U64(17)
                if len(frequent):
                    tok |= U64(LATE) * (frequent[np.searchsorted(frequent, value).clip(max=len(frequent) - 1)] == value)
                ordered = _sorted_by_owner(owner, tok)
                rank = np.arange(len(value)) - np.repeat(bounds[:-1], n)
                keep = rank < np.repeat(np.where(n > 0, n - needed(n, percent) + 1, 0), n)
                prefix, kept = ordered[keep] & U64((1 << HASH_BITS) - 1), np.bincount(owner[keep], minlength=m)
                # As many finer groups as a fourth of the set's size: they bound long texts as tightly as short ones.
                bits = np.maximum(np.ceil(np.log2(np.maximum(n, 1) / 4)).astype(np.int64), 6)
                at = np.concatenate([[0], np.cumsum(1 << bits)])
                fine = np.bincount(at[owner] + (value >> (HASH_BITS - bits[owner]).astype(U64)).astype(np.int64), minlength=int(at[-1]))
                packed = [_packed(counts[r]) for r in range(m)], [_packed(fine[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:last], pa.array(n), *(pa.array((e[bounds[1:]] - e[bounds[:-1]]).view(np.int64)) for e in ends), *(pa.array(x, pa.binary()) for x in packed), text.list_array(prefix.view(np.int64), np.concatenate([[0], np.cumsum(kept)]))],
                    names=["doc_id", "n", "sum1", "sum2", "counts", "fine", "prefix"],
                )

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, value, bounds in _sets(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], text.list_array(value.view(np.int64), bounds)], names=["doc_id", "shingles"])

    return run


def _frequent(own: DataFrame, k: int) -> np.ndarray:
    """Shingles of at least one in FREQUENT sampled documents. The sample and so this list are bounded."""
    total = own.count()
    parts = max(1, total // SAMPLE_DOCS)
    sample = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    least = max(8, min(total, SAMPLE_DOCS) // FREQUENT)
    counts = sample.mapInArrow(text.released(_set_rows(k)), "doc_id long, shingles array<long>").select(F.explode("shingles").alias("s")).groupBy("s").count().filter(F.col("count") >= least)
    return np.sort(np.array([r["s"] for r in counts.select("s").collect()], np.int64).view(U64))


class Tree:
    """An R-tree over the points of one meeting: boxes are sizes from, to and upper corners of count vectors."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, percent: int):
        self.n, self.counts, self.percent = n, counts, percent
        self.rows: list[np.ndarray] = []
        self.box: list[tuple[int, int, np.ndarray]] = []
        self.children: list[tuple[int, int] | None] = []
        self._build(np.arange(len(n)))

    def _build(self, rows: np.ndarray) -> int:
        """Place of a new node over the rows."""
        here = len(self.rows)
        n, counts = self.n[rows], self.counts[rows]
        high = counts.max(0)
        self.rows.append(rows)
        self.box.append((int(n.min()), int(n.max()), high.astype(np.int64)))
        self.children.append(None)
        if len(rows) > LEAF:
            # Sizes that can't link part first; then the coordinate that spreads most.
            by = n if needed(int(n.max()), self.percent) > int(n.min()) else counts[:, int((high - counts.min(0)).argmax())]
            order = rows[np.argsort(by, kind="stable")]
            middle = (len(rows) // 2 + LEAF - 1) // LEAF * LEAF
            self.children[here] = self._build(order[:middle]), self._build(order[middle:])
        return here

    def leaf_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of every two leaves (or one twice) whose boxes admit a link, from the root down."""
        stack = [(0, 0)]
        while stack:
            p, q = stack.pop()
            (low_p, high_p, top_p), (low_q, high_q, top_q) = self.box[p], self.box[q]
            if needed(max(low_p, low_q), self.percent) > min(high_p, high_q, int(np.minimum(top_p, top_q).sum())):
                continue
            down_p, down_q = self.children[p], self.children[q]
            if down_p is None and down_q is None:
                yield self.rows[p], self.rows[q]
            elif p == q:
                a, b = down_p
                stack += [(a, b), (b, b), (a, a)]
            elif down_q is None or (down_p is not None and len(self.rows[p]) >= len(self.rows[q])):
                stack += [(c, q) for c in down_p]
            else:
                stack += [(p, c) for c in down_q]


def _minima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed minima of every row of x with every row of y."""
    if x.shape[1] <= GROUPS:
        return np.minimum(x[:, None, :], y[None, :, :]).sum(2, dtype=np.int64)
    return np.stack([np.minimum(row, y).sum(1, dtype=np.int64) for row in x])


def _parted(n: np.ndarray, counts: np.ndarray, fine: list[np.ndarray] | None, comp: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Which points of a meeting the bounds connect: a label by row, its own place for rows that are alone.

    Only pairs in different components and not on the same side count.
    """
    label = np.arange(len(n))
    for x, y in Tree(n, counts, percent).leaf_pairs():
        if len(set(label[x].tolist()) | set(label[y].tolist())) == 1:
            continue
        if fine is None:
            bound = _minima(counts[x], counts[y])
        else:
            groups = min(len(fine[r]) for r in (*x.tolist(), *y.tolist()))
            bound = _minima(*(np.stack([_folded(fine[r], groups) for r in z.tolist()]) for z in (x, y)))
        ok = _linkable(bound, n[x][:, None], n[y][None, :], percent) & (comp[x][:, None] != comp[y][None, :]) & ((side[x][:, None] != side[y][None, :]) | (side[x] == 0)[:, None])
        while True:
            i, j = np.nonzero(ok & (label[x][:, None] != label[y][None, :]))
            if not len(i):
                break
            a, b = label[x[i[0]]], label[y[j[0]]]
            label[label == max(a, b)] = min(a, b)
    return label


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Count vectors of packed rows: bytes where all are small, else wider numbers."""
    packed = column.to_pylist()
    if all(len(c) == GROUPS + 1 for c in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, GROUPS + 1)[:, 1:]
    return np.array([_unpacked(c) for c in packed], np.uint32).reshape(-1, GROUPS)


def _coarse(percent: int, finer: bool):
    """Groups parted into what the bounds connect, without rows that are alone; ``finer``: by vectors as long as sets need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in meetings.grouped(batches, "gid"):
            gid, n, comp, side = (table.column(c).to_numpy() for c in ("gid", "n", "comp", "side"))
            fine = [_unpacked(c) for c in table.column("counts").to_pylist()] if finer else None
            counts = np.stack([_folded(c, GROUPS) for c in fine]) if finer else _vectors(table.column("counts"))
            keep, part = np.zeros(len(gid), bool), np.zeros(len(gid), np.int64)
            start, size = meetings.runs(gid)
            i = start[size == 2]  # most groups: all at once
            if len(i):
                bound = np.minimum(counts[i], counts[i + 1]).sum(1, dtype=np.int64)
                ok = _linkable(bound, n[i], n[i + 1], percent) & (comp[i] != comp[i + 1]) & ((side[i] != side[i + 1]) | (side[i] == 0))
                if finer:
                    for a in np.flatnonzero(ok).tolist():
                        x, y = fine[i[a]], fine[i[a] + 1]
                        groups = min(len(x), len(y))
                        ok[a] = _linkable(np.minimum(_folded(x, groups), _folded(y, groups)).sum(dtype=np.int64), n[i[a]], n[i[a] + 1], percent)
                keep[i] = keep[i + 1] = ok
            for s, z in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = slice(s, s + z)
                label = part[own] = _parted(n[own], counts[own], fine[own] if finer else None, comp[own], side[own], percent)
                keep[own] = np.bincount(label, minlength=z)[label] > 1
            gid = np.where(part > 0, text.mix(gid.view(U64) + part.astype(U64)).view(np.int64), gid)
            yield pa.RecordBatch.from_arrays([pa.array(gid[keep]), *(table.column(c).combine_chunks().filter(pa.array(keep)) for c in ("doc_id", "n", "comp", "side"))], names=["gid", "doc_id", "n", "comp", "side"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap of every two sets, as products of the membership matrix, some columns at a time."""
    z = len(sets)
    owner = np.repeat(np.arange(z), [len(s) for s in sets])
    whole = np.concatenate(sets)
    order = np.argsort(whole, kind="stable")
    owner, whole = owner[order], whole[order]
    start, size = meetings.runs(whole)
    held = np.repeat(size > 1, size)  # what one set alone has adds nothing
    owner, column = owner[held], np.repeat(np.cumsum(size > 1) - 1, size)[held]
    out = np.zeros((z, z), np.float32)
    width = max(1, (1 << 22) // z)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        member = np.zeros((z, min(width, int(column[-1]) + 1 - c)), np.float32)
        member[owner[a:b], column[a:b] - c] = 1
        out += member @ member.T
    return np.rint(out).astype(np.int64)


def _exact(percent: int):
    """Links that connect something new, of groups whose rows bring their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = meetings.Forest()
        for table in meetings.grouped(batches, "gid"):
            gid, doc, comp, side = (table.column(c).to_numpy() for c in ("gid", "doc_id", "comp", "side"))
            lists = table.column("shingles").combine_chunks()
            value = lists.values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            links: list[tuple[int, int]] = []
            for s, z in zip(*(x.tolist() for x in meetings.runs(gid)), strict=True):
                ids, comps, sides = doc[s : s + z], comp[s : s + z], side[s : s + z]
                if len({trees.root(c) for c in comps.tolist()}) == 1:
                    continue
                sets = [value[bounds[i] : bounds[i + 1]] for i in range(s, s + z)]
                n = np.array([len(x) for x in sets])
                if z == 2:
                    overlap = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]])
                    overlap = np.concatenate([overlap, overlap[:, ::-1]])
                else:
                    overlap = _overlaps(sets)
                ok = _linkable(overlap, n[:, None], n[None, :], percent) & (comps[:, None] != comps[None, :]) & ((sides[:, None] != sides[None, :]) | (sides == 0)[:, None])
                left = np.ones(z, bool)
                for i in range(z):
                    if not left[i]:
                        continue
                    left[i], stack = False, [i]
                    while stack:
                        x = stack.pop()
                        new = np.flatnonzero(ok[x] & left)
                        left[new] = False
                        for y in new.tolist():
                            stack.append(y)
                            if trees.join(int(comps[x]), int(comps[y])):
                                links.append((int(ids[x]), int(ids[y])))
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _of_ids(own: DataFrame, rows: DataFrame) -> DataFrame:
    ids = shared.stored(rows.select("doc_id").distinct(), "ids")
    return own.join(shared.sized_broadcast(ids), "doc_id", "left_semi")


def row_key(doc_id: Column, said: Column) -> Column:
    """The id, or a number above all ids that equal texts without an id share."""
    return F.coalesce(doc_id.cast("long"), F.shiftrightunsigned(F.xxhash64(said), 2) + F.lit(NO_ID))


def _components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """key, n, component by row; keys are those of ``row_key``."""
    said = F.col(text_col).cast("string")
    own = docs.select(row_key(F.col(id_col), said).alias("doc_id"), said.alias("text"))
    n_parts = shared.parallelism(docs)
    schema = "doc_id long, n long, sum1 long, sum2 long, counts binary, fine binary, prefix array<long>"
    points = shared.stored(own.mapInArrow(text.released(_featurizer(k, percent, _frequent(own, k))), schema), "points")
    # Equal sets are one class, whose smallest id stands for it.
    classes = shared.stored(points.filter("n > 0").groupBy("sum1", "sum2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = points.join(classes.select("sum1", "sum2", "n", F.col("rep").alias("doc_id")), ["sum1", "sum2", "n", "doc_id"], "left_semi")
    tokens = reps.select(F.explode("prefix").alias("tok"), "doc_id", "n")
    late = F.col("tok") >= F.lit(LATE)
    met = meetings.meetings(tokens.filter(~late), n_parts, tokens.filter(late))
    light = shared.stored(reps.select("doc_id", "counts", "fine"), "vectors")

    def bounded(groups: DataFrame, vectors: str) -> DataFrame:
        rows = groups.join(light.select("doc_id", F.col(vectors).alias("counts")), "doc_id").select("gid", "doc_id", "n", "comp", "side", "counts")
        left = rows.repartition(n_parts, "gid").sortWithinPartitions("gid").mapInArrow(text.released(_coarse(percent, vectors == "fine")), "gid long, doc_id long, n long, comp long, side int")
        return shared.stored(left, "partnered")

    def verify(groups: DataFrame) -> DataFrame:
        left = bounded(groups, "counts")
        left = bounded(meetings.merged(left.filter("side = 0")).unionByName(left.filter("side > 0")), "fine")
        left = shared.stored(meetings.gathered(left), "groups")
        sets = shared.stored(_of_ids(own, left).mapInArrow(text.released(_set_rows(k)), "doc_id long, shingles array<long>"), "sets")
        both = left.join(sets, "doc_id").select("gid", "doc_id", "comp", "side", "shingles").repartition(n_parts, "gid").sortWithinPartitions("gid")
        return both.mapInArrow(text.released(_exact(percent)), "a long, b long")

    # An id with several texts is one document: the classes of its texts are linked.
    twice = shared.stored(points.filter("n > 0").groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id"), "twice")
    more = None
    if not twice.isEmpty():
        named = points.join(twice, "doc_id", "left_semi").join(classes, ["sum1", "sum2", "n"]).select("doc_id", "rep").distinct()
        more = shared.stored(named.join(named.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").filter("a != b").distinct(), "links")
    comp = meetings.connected(met, verify, more)
    if comp is None:
        comp = docs.sparkSession.createDataFrame([], "node long, component long")
    of_rep = comp.withColumnRenamed("node", "rep")
    named = classes.join(of_rep, "rep", "left").select("sum1", "sum2", "n", F.coalesce("component", "rep").alias("component"))
    # A class of many copies is a hot key: its rows are salted, its one name is copied to each salt.
    left = points.select("doc_id", "n", "sum1", "sum2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    right = named.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, ["sum1", "sum2", "n", "salt"], "left").select(F.col("doc_id").alias("key"), "n", F.coalesce("component", "doc_id").alias("component"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id by row: sets link when 100 * overlap >= percent * union."""
    told = lambda c: F.when(F.col(c) < F.lit(NO_ID), F.col(c))
    return _components(docs, k, percent, id_col, text_col).select(told("key").alias("doc_id"), F.col("n").alias("n_shingles"), told("component").alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns: of each component those of the smallest id, one row an id (the least text by hash, then by itself)."""
    own, key = shared.fresh(docs, "own_key"), shared.fresh(docs, "gone_key")
    gone = shared.stored(_components(docs, k, percent, id_col, text_col).filter("key != component").select(F.col("key").alias(key)).distinct(), "gone")
    keyed = docs.withColumn(own, row_key(docs[id_col], docs[text_col].cast("string")))
    kept = keyed.join(shared.sized_broadcast(gone), F.col(own) == F.col(key), "left_anti")
    twice = shared.stored(kept.groupBy(own).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(own).alias(key)), "twice")
    if twice.isEmpty():
        return kept.drop(own)
    many = shared.sized_broadcast(twice)
    row = F.struct(F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    least = kept.join(many, F.col(own) == F.col(key), "left_semi").groupBy(own).agg(F.min(row).alias("least")).select("least.row.*")
    return kept.join(many, F.col(own) == F.col(key), "left_anti").drop(own).unionByName(least)


#: The same classes by plain SQL, for three words and 90 per cent.
ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT x, y FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(min(y), doc_id)) AS component_id FROM sets LEFT JOIN reach ON x = doc_id GROUP BY doc_id, s
"""
