"""Counting hashed keys over all documents, with packed rows.

A block is up to ``BLOCK`` bytes of text of one scan task, in the order of the scan, so
what a task holds depends neither on the table's size nor on how its files are split.
Per kind of key it sends every hash partition its distinct hashes, ascending, with their
counts: two byte strings. The partition merges what all blocks sent, adds up equal hashes
and answers every block with the totals in the block's own order; there are as many
partitions as keep one of them near ``PART`` bytes of text. Blocks, as compressed slices,
and answers then meet in one task. A hot key is one entry a block; no row is made per
occurrence.

Where most keys occur once, a sieve goes first: blocks send the leading bits of their
hashes alone (``BITS`` more than tell the keys apart), and learn which of them another
block has too. A key that its block has once and no other block has the bits of occurs
once in all; only the others are sent in full, so totals are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import shared, text

U64 = np.uint64
_ZSTD = pa.Codec("zstd")
BLOCK = 24 << 20  # bytes of text of a block; a longer text is a block of its own
PART = 16 << 20  # bytes of text whose keys a hash partition adds up
SLICE = 1 << 20  # bytes of text that are compressed together
BITS = 4  # of a sieve's hashes, beyond those that number a word in four bytes: about one key in twenty passes by chance
REQUEST = "part int, block long, kind int, keys binary, counts binary"
REQUEST_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = "block long, part int, kind int, totals binary, all long"
ANSWER_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("totals", pa.binary()), ("all", pa.int64())])


def pack(x: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: little is left of planes that hardly vary."""
    planes = np.ascontiguousarray(x.astype(U64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], decompressed_size=8 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(U64).reshape(n)


def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct hashes without 0, their counts, place of each hash among them or -1); empties ``parts``."""
    whole = np.concatenate(parts) if parts else np.zeros(0, U64)
    parts.clear()
    order = np.argsort(whole)
    whole = whole[order]
    new = np.ones(len(whole), bool)
    new[1:] = whole[1:] != whole[:-1]
    value = whole[new]
    del whole
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(new))).astype(np.int32)
    inverse = np.empty(len(new), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    if len(value) and value[0] == 0:
        return value[1:], count[1:], inverse - 1
    return value, count, inverse


def pack_flags(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + _ZSTD.compress(np.packbits(x).tobytes(), asbytes=True)


def unpack_flags(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    bits = np.frombuffer(_ZSTD.decompress(raw[8:], decompressed_size=-(-n // 8), asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.unpackbits(bits, count=n).astype(bool)


def requests(block: int, kind: int, value: np.ndarray, count: np.ndarray, n_parts: int, bits: int = 64) -> Iterator[pa.RecordBatch]:
    """A row a partition; partition p has the p-th even range of hashes of so many bits, which are spread evenly."""
    edge = np.array([(p << bits) // n_parts for p in range(1, n_parts)], U64)
    at = [0, *np.searchsorted(value, edge).tolist(), len(value)]
    for p in range(n_parts):
        own = slice(at[p], at[p + 1])
        keys = pack(np.diff(value[own], prepend=U64(0)))  # differences of even hashes need few bytes
        yield pa.RecordBatch.from_pylist([{"part": p, "block": block, "kind": kind, "keys": keys, "counts": pack(count[own])}], REQUEST_ARROW)


def leading(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct leading bits of ascending hashes, place of each hash among them)."""
    short = value >> U64(64 - bits)
    new = np.ones(len(short), bool)
    new[1:] = short[1:] != short[:-1]
    return short[new], np.cumsum(new) - 1


def noted(block: int, kind: int, flags: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """What a block knows of its keys already, and gets back with the answers (``Answers.flags`` of minus ``kind``)."""
    return pa.RecordBatch.from_pylist([{"part": block % n_parts, "block": block, "kind": -kind, "keys": pack_flags(flags), "counts": b""}], REQUEST_ARROW)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    asked: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for batch in batches:
        for row in batch.select(["part", "block", "kind", "keys"]).to_pylist():
            asked.setdefault((row["part"], row["kind"]), []).append((row["block"], row["keys"]))
    for part, kind in list(asked):
        rows = asked.pop((part, kind))
        keys = [np.cumsum(unpack(r[1]), dtype=U64) for r in rows]
        ranked = np.sort(np.concatenate(keys))
        twice = ranked[1:][ranked[1:] == ranked[:-1]]  # a block has each once
        for (block, _), own in zip(rows, keys, strict=True):
            at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
            found = twice[at] == own if len(twice) else np.zeros(len(own), bool)
            yield pa.RecordBatch.from_pylist([{"block": block, "part": part, "kind": kind, "totals": pack_flags(found), "all": 0}], ANSWER_ARROW)


def shared_keys(asked: DataFrame, n_parts: int) -> DataFrame:
    """Per block which of its keys another block has too."""
    return asked.repartitionById(n_parts, F.col("part")).mapInArrow(_shared, ANSWER)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    asked: dict[tuple[int, int], list[tuple[int, bytes, bytes]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            asked.setdefault((row["part"], row["kind"]), []).append((row["block"], row["keys"], row["counts"]))
    for part, kind in list(asked):
        rows = asked.pop((part, kind))
        if kind < 0:
            for block, keys, _ in rows:
                yield pa.RecordBatch.from_pylist([{"block": block, "part": part, "kind": kind, "totals": keys, "all": 0}], ANSWER_ARROW)
            continue
        blocks = [r[0] for r in rows]
        keys = [np.cumsum(unpack(r[1]), dtype=U64) for r in rows]
        counts = np.concatenate([unpack(r[2]) for r in rows]).astype(np.int64)
        del rows
        whole = np.concatenate(keys)
        order = np.argsort(whole, kind="stable")
        ranked = whole[order]
        run = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) if len(ranked) else np.zeros(0, np.int64)
        total = np.zeros(len(whole), np.int64)
        total[order] = np.bincount(run, counts[order]).astype(np.int64)[run] if len(run) else 0
        begin, every = 0, int(counts.sum())
        for block, own in zip(blocks, keys, strict=True):
            told = total[begin : begin + len(own)]
            begin += len(own)
            yield pa.RecordBatch.from_pylist([{"block": block, "part": part, "kind": kind, "totals": pack(told), "all": every}], ANSWER_ARROW)


def totals(asked: DataFrame, n_parts: int) -> DataFrame:
    return asked.repartitionById(n_parts, F.col("part")).mapInArrow(_totals, ANSWER)


@dataclass(frozen=True)
class Layout:
    """Hash partitions, tasks that blocks are dealt to, a block's bytes, and the leading bits of a sieve."""

    n_parts: int
    n_tasks: int
    block: int
    bits: int


def blocked(docs: DataFrame, id_col: str, text_col: str, stable_scan: bool, block: int = BLOCK) -> tuple[DataFrame, Layout]:
    """doc_id, text, block (here: the scan task), and the layout; stored first unless ``docs`` reads files directly, so that every reading has the same tasks."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not stable_scan:
        own = shared.stored(own, "documents")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = own.withColumn("block", F.spark_partition_id())
    return rows, Layout(max(shared.parallelism(docs), -(-size // PART)), max(1, rows.rdd.getNumPartitions(), -(-size // block)), block, min(64, (size // 4).bit_length() + BITS))


def cut(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, some of its documents) of a scan task's rows, one block after another, whatever the batches."""
    number = held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("block")[0].as_py() << 24
        ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < len(ends):
            done = int(ends[row - 1]) if row else 0
            end = max(row, int(np.searchsorted(ends, done + block - held, "right")))
            if end == row and held:
                number, held = number + 1, 0
                continue
            end = max(end, row + 1)
            yield task | number, batch.slice(row, end - row)
            held += int(ends[end - 1]) - done
            row = end


def _packed(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, place = None, 0
        for number, part in cut(batches, block):
            if number != before:
                before, place = number, 0
            ends = np.cumsum(pc.binary_length(part.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            row = 0
            while row < len(ends):
                end = max(row + 1, int(np.searchsorted(ends, (int(ends[row - 1]) if row else 0) + SLICE, "right")))
                sink = pa.BufferOutputStream()
                some = part.slice(row, end - row).select(["doc_id", "text"])
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(some)
                yield pa.RecordBatch.from_pylist([{"block": number, "part": place, "kind": 0, "totals": sink.getvalue().to_pybytes(), "all": 0}], ANSWER_ARROW)
                row, place = end, place + 1

    return run


def unpacked(raw: bytes) -> pa.RecordBatch:
    """doc_id, text of a slice."""
    with pa.ipc.open_stream(raw) as said:
        return said.read_next_batch()


def together(rows: DataFrame, answers: DataFrame, layout: Layout) -> DataFrame:
    """Blocks' documents and answers in the same tasks, a block's answers first; blocks one after another."""
    docs = rows.mapInArrow(_packed(layout.block), ANSWER)
    dealt = F.pmod(F.xxhash64("block"), F.lit(layout.n_tasks)).cast("int")
    return answers.unionByName(docs).repartitionById(layout.n_tasks, dealt).sortWithinPartitions("block", F.col("kind").desc(), "part")


def dealt(rows: DataFrame, layout: Layout) -> DataFrame:
    """Blocks' packed documents by block: read more than once, they move once."""
    return rows.mapInArrow(_packed(layout.block), ANSWER).repartition(layout.n_tasks, "block")


def met(docs: DataFrame, answers: DataFrame, layout: Layout, run: Callable[[int, Answers, list[bytes]], Iterator[pa.RecordBatch]], schema: str, arrow: pa.Schema) -> DataFrame:
    """What ``run`` makes of (block, answers, slices) of every block; ``docs``: see ``dealt``."""

    def one(own: pa.Table, said: pa.Table) -> pa.Table:
        if not own.num_rows:
            return arrow.empty_table()
        answers = Answers()
        for batch in said.to_batches():
            answers.add(batch)
        block, docs = own.column("block")[0].as_py(), own.column("totals").to_pylist()
        del own, said
        out = pa.Table.from_batches(list(run(block, answers, docs)), arrow)
        text.give_back()
        return out

    return docs.groupBy("block").cogroup(answers.repartition(layout.n_tasks, "block").groupBy("block")).applyInArrow(one, schema)


class Answers:
    def __init__(self) -> None:
        self.rows: dict[int, dict[int, bytes]] = {}
        self.all: dict[int, dict[int, int]] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        for row in batch.select(["kind", "part", "totals", "all"]).to_pylist():
            self.rows.setdefault(row["kind"], {})[row["part"]] = row["totals"]
            self.all.setdefault(row["kind"], {})[row["part"]] = row["all"]

    def of(self, kind: int, value: np.ndarray) -> np.ndarray:
        """Totals of a block's distinct hashes, and a 0 at the end for what is none of them."""
        own = self.rows.get(kind, {})
        out = np.concatenate([*(unpack(own[p]) for p in sorted(own)), np.zeros(1, U64)]).astype(np.int64)
        if len(out) != len(value) + 1:
            raise ValueError(f"{len(out) - 1} totals for {len(value)} keys: a scan's tasks differed between two readings")
        return out

    def flags(self, kind: int, n: int) -> np.ndarray:
        """Flags of ``n`` keys of a block."""
        own = self.rows.get(kind, {})
        out = np.concatenate([*(unpack_flags(own[p]) for p in sorted(own)), np.zeros(0, bool)])
        if len(out) != n:
            raise ValueError(f"{len(out)} flags for {n} keys: a scan's tasks differed between two readings")
        return out

    def sum(self, kind: int) -> int:
        """Of the counts of all keys of a kind."""
        return sum(self.all.get(kind, {}).values())


def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Answers, list[bytes]]]:
    """(block, answers, its documents' slices, see ``unpacked``) from rows in the order of ``together``."""
    block, answers, docs = None, Answers(), []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edge = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a == b:
                continue
            if block is not None and blocks[a] != block:
                yield block, answers, docs
                answers, docs = Answers(), []
            block = int(blocks[a])
            own = batch.slice(a, b - a)
            n = int(np.count_nonzero(own.column("kind").to_numpy() > 0))
            answers.add(own.slice(0, n))
            docs += own.slice(n).column("totals").to_pylist()
    if block is not None:
        yield block, answers, docs
