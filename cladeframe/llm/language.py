"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of character n-grams (all orders of ``ORDERS``,
n-grams of bytes of the case-folded text) that both hold, divided by the root of the
product of their own numbers: a presence kernel. Landmarks (Nyström) are drawn in equal
numbers from every language; a text's kernel with the landmarks, whitened by the
landmarks' own kernel, gives features for one-versus-rest kernel ridge regression. Its
weights come from every labelled row: tasks add up the products of their rows' features
(sums of a size that the landmarks fix), Spark adds up the tasks' sums, and the driver
solves. Since the kernel is a product of presence vectors, the landmarks and the ridge
weights fold into one matrix (n-grams by languages), and a batch of documents is scored
by one matrix product.

Only the landmarks, in whose span the weights lie, are chosen rows: of at most
``SAMPLE_DOCS`` labelled documents, by a hash of their id; that bound is a parameter.
Prediction reads the text alone, the whole of it.

Cases: null text and text without a letter is ``und`` with score 0.0; rows without a
label never train; of labels beyond ``SAMPLE_DOCS`` the most frequent are learned; every
labelled row trains, repeated ones each; repeated rows are predicted each; without any training row every text is ``und``; equal scores take
the language that sorts first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import text

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14  # n-grams are hashed to so many
SAMPLE_DOCS = 2_000
LANDMARKS = 200
RIDGE = 1e-2
SLICE = 256 << 10
FOLDS = 5  # parts of the labelled rows; each is scored by what the others teach, for the floors
BEGINNINGS = (16, 32, 64, 128, 256, 512, 1024, 2048, None)  # characters
ROWS = 128  # texts whose presence vectors are held at once
MARGIN = 0.02  # between scores of noise, floors and scores of texts
NOISE = "abcdefghijklmnopqrstuvwxyz"
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct n-grams that documents hold. White space, digits and punctuation are one blank."""
    data = text.LOWER[data].copy()
    blank = text.NOT_ALNUM[data] | ((data >= 48) & (data < 58))
    data[blank] = 32
    n_docs, n = len(offsets) - 1, len(data)
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    seen = np.zeros(n_docs * BUCKETS, bool)
    code = np.zeros(n, np.uint32)
    for order in range(1, max(ORDERS) + 1):
        total = n - order + 1
        if total <= 0:
            break
        code = code[:total] * np.uint32(0x01000193) + data[order - 1 :] + np.uint32(1)
        if order in ORDERS:
            inside = doc[:total] == doc[order - 1 :]
            h = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * order)
            bucket = (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
            seen[(doc[:total] * BUCKETS + bucket)[inside]] = True
    at = np.flatnonzero(seen)
    return at // BUCKETS, at % BUCKETS


def dense(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Presence vectors of length one, a row a document."""
    doc, bucket = presence(data, offsets)
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    out[doc, bucket] = 1
    return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))


def _dense_parts(texts: list[str]) -> Iterator[np.ndarray]:
    """``dense`` of a few texts at a time: the whole table would be large for a driver."""
    for a in range(0, len(texts), 200):
        for *_, data, offsets in text.string_slices(pa.array(texts[a : a + 200], pa.string()), SLICE):
            yield dense(data, offsets)


class Model:
    """languages, and the folded weights: presence vectors @ weights + bias are the regressions' values."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias
        self.floors = np.zeros(BUCKETS.bit_length() + 1)  # least score of a text that isn't ``und``, by the bits of its number of n-grams

    def scored(self, data: np.ndarray, offsets: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language by place, score from 0 to 1, number of n-grams) of a slice; ``held``: its ``presence``, if known."""
        n = len(offsets) - 1
        doc, bucket = presence(data, offsets) if held is None else held
        first = np.searchsorted(doc, np.arange(n))
        size = np.bincount(doc, minlength=n)
        value = np.zeros((n, len(self.languages)), np.float32)
        has = size > 0
        if has.any():
            # The product of the sparse presence matrix with the weights.
            value[has] = np.add.reduceat(self.weights[bucket], first[has], axis=0)
        value = value / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
        best = value.argmax(1)
        return best, np.clip((value[np.arange(n), best] + 1) / 2, 0.0, 1.0), size

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best language by place, score from 0 to 1) of a slice; below the floor the place after the last."""
        best, score, size = self.scored(data, offsets)
        bits = np.ceil(np.log2(size + 1)).astype(np.int64)
        return np.where(score >= self.floors[bits], best, len(self.languages)), score


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, limit: int = SAMPLE_DOCS) -> tuple[list[str], list[str]]:
    """At most ``limit`` labelled texts, of each label the equal share of smallest hashes of the id (without an id: of the text).

    Of more labels than ``limit`` the most frequent are learned. Rows of one id count once, by the least hash of their text.
    """
    said = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter("t is not null and l is not null")
    counts = said.groupBy("l").count().orderBy(F.desc("count"), "l").limit(limit).collect()
    if not counts:
        return [], []
    share = max(1, limit // len(counts))
    # Of a label's 2**40 hash values those that hold about 200 times a share of its rows: what meets in the sort is bounded, and holds the smallest.
    rates = docs.sparkSession.createDataFrame([(r["l"], min(1 << 40, (1 << 40) * 200 * share // r["count"])) for r in counts], "l string, rate long")
    keyed = said.withColumn("k", F.pmod(F.xxhash64(F.coalesce("i", "t"), F.lit("language")), F.lit(1 << 40)))
    # Only hashes meet in the sort; texts are fetched for the chosen.
    keys = keyed.select("l", "k").join(F.broadcast(rates), "l").filter("k < rate").groupBy("l").agg(F.slice(F.array_sort(F.collect_set("k")), 1, share).alias("ks")).select("l", F.explode("ks").alias("k"))
    own = F.struct(F.xxhash64("t").alias("h"), "t")
    chosen = keyed.join(F.broadcast(keys), ["l", "k"], "left_semi").groupBy("l", "k").agg(F.min(own).alias("row")).select("k", "l", "row.t").collect()
    chosen.sort(key=lambda r: (r["k"], r["t"]))
    return [r["t"] for r in chosen], [r["l"] for r in chosen]


@dataclass
class Basis:
    """Languages, the landmarks' presence vectors, and what whitens a kernel with them."""

    languages: list[str]
    marks: np.ndarray
    root: np.ndarray

    @classmethod
    def of(cls, texts: list[str], labels: list[str], seed: int = 0) -> Basis:
        """Landmarks in equal numbers from every language."""
        languages = sorted(set(labels))
        y = np.array([languages.index(v) for v in labels])
        rng = np.random.default_rng(seed)
        each = max(1, LANDMARKS // len(languages))
        marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:each] for k in range(len(languages))])
        z = np.concatenate(list(_dense_parts([texts[k] for k in marks.tolist()])))
        values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
        return cls(languages, z, vectors / np.sqrt(np.maximum(values, 1e-6)))  # features = k(x, marks) @ root

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row a text, and a last column of ones."""
        out = (dense(data, offsets) @ self.marks.T).astype(np.float64) @ self.root
        return np.concatenate([out, np.ones((len(out), 1))], 1)

    def solved(self, sums: np.ndarray) -> Model:
        """The ridge's model of sums of weighted products: features by (features, languages)."""
        n = len(self.marks)
        both, own = sums[:, : n + 1], sums[:, n + 1 :]
        whole = both[n, n]
        mean, shift = both[n, :n] / whole, (2 * own[n] - whole) / whole  # targets are 1 and -1
        centred = both[:n, :n] - whole * np.outer(mean, mean)
        beta = np.linalg.solve(centred + RIDGE * whole / len(self.languages) * np.eye(n), 2 * own[:n] - both[:n, n:] - whole * np.outer(mean, shift))
        return Model(self.languages, (self.marks.T @ (self.root @ beta)).astype(np.float32), (shift - mean @ beta).astype(np.float32))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a few texts: a slice of many short ones is cut, so the presence table stays small."""
    for first, last, data, offsets in text.string_slices(batch.column("t"), SLICE):
        for a in range(0, last - first, ROWS):
            b = min(a + ROWS, last - first)
            yield first + a, first + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


SUMS = pa.schema([("fold", pa.int32()), ("line", pa.int32()), ("part", pa.int32()), ("v", pa.binary())])


def _products(basis: Basis, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, place = len(basis.marks) + 1, {v: k for k, v in enumerate(basis.languages)}
        sums: dict[int, np.ndarray] = {}
        part = 0
        for batch in batches:
            label, fold = np.array([place[v] for v in batch.column("l").to_pylist()], np.int64), batch.column("fold").to_numpy()
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for a, b, data, offsets in _parts(batch):
                x, y = basis.features(data, offsets), label[a:b]
                wide = np.concatenate([x, (y[:, None] == np.arange(len(place))).astype(float)], 1) * weights[y][:, None]
                for f in np.unique(fold[a:b]).tolist():
                    own = fold[a:b] == f
                    sums[f] = sums.get(f, 0) + x[own].T @ wide[own]
        for f in sorted(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, part, np.int32)), pa.array([v.tobytes() for v in sums[f]], pa.binary())], schema=SUMS)

    return run


def _added(lines: pa.Table) -> pa.Table:
    """One line of the tasks' sums; always added in the tasks' order, so that runs agree."""
    rows = lines.sort_by("part")
    total = np.sum([np.frombuffer(v, np.float64) for v in rows.column("v").to_pylist()], axis=0)
    return pa.Table.from_pylist([{"fold": rows.column("fold")[0].as_py(), "line": rows.column("line")[0].as_py(), "part": 0, "v": total.tobytes()}], SUMS)


_alpha: list[np.ndarray] = []


def noise_of(said: str) -> str:
    """``said`` with every letter replaced by a random one; the same each time."""
    if not _alpha:
        _alpha.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    code = np.frombuffer(said.encode("utf-32-le"), np.uint32).copy()
    at = np.flatnonzero(_alpha[0][code])
    code[at] = np.frombuffer(NOISE.encode(), np.uint8)[np.random.default_rng(zlib.crc32(said.encode())).integers(0, len(NOISE), len(at))]
    return code.tobytes().decode("utf-32-le")


EXTREMES = "bits int, clean double, noise double"


def _extremes(model: Model, without: dict[int, Model]):
    """By the bits of a text's number of n-grams the lowest score of texts and their beginnings, by the model and by that without their fold, and the highest of their noise by the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = np.full(BUCKETS.bit_length() + 1, np.nan)
        noise = clean.copy()

        def score(models: list[Model], said: list[str], into: np.ndarray, keep: np.ufunc) -> None:
            for *_, data, offsets in _parts(pa.RecordBatch.from_arrays([pa.array(said, pa.string())], names=["t"])):
                held = presence(data, offsets)
                for m in models:
                    _, value, size = m.scored(data, offsets, held)
                    keep.at(into, np.ceil(np.log2(size + 1)).astype(np.int64), value)

        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for row in range(0, batch.num_rows, ROWS):
                texts = batch.column("t").slice(row, ROWS).to_pylist()
                mixed = [noise_of(t) for t in texts]
                for f in np.unique(fold[row : row + ROWS]).tolist():
                    at = np.flatnonzero(fold[row : row + ROWS] == f).tolist()
                    for chars in BEGINNINGS:
                        own = [k for k in at if (chars is None or len(texts[k]) > chars) and _LETTER.search(texts[k][:chars])]
                        score([model, without[f]], [texts[k][:chars] for k in own], clean, np.fmin)
                        score([without[f]], [mixed[k][:chars] for k in own], noise, np.fmax)
        bits = np.flatnonzero(~np.isnan(clean) | ~np.isnan(noise))
        yield pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int32)), pa.array(clean[bits], from_pandas=True), pa.array(noise[bits], from_pandas=True)], names=["bits", "clean", "noise"])

    return run


def learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str, limit: int = SAMPLE_DOCS, open_set: bool = False) -> Model:
    """The model of all labelled rows; ``open_set``: with floors, which tell texts from noise, from all of them too.

    The floor of a class of sizes lies ``MARGIN`` above its highest noise (above all noise,
    where a class has none), but ``MARGIN`` below the lowest score of its texts. Texts and
    noise are scored by a model of the other folds, texts by the whole model too: of texts whose
    copies have other labels it is the less sure.
    """
    texts, labels = training_rows(docs, id_col, text_col, lang_col, limit)
    if not texts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    basis = Basis.of(texts, labels)
    said = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter("t is not null and l is not null")
    known = docs.sparkSession.createDataFrame([(v,) for v in basis.languages], "l string")
    counts = {r["l"]: r["count"] for r in said.join(F.broadcast(known), "l", "left_semi").groupBy("l").count().collect()}
    fold = F.pmod(F.xxhash64(F.coalesce("i", "t"), F.lit("fold")), F.lit(FOLDS)) if open_set else F.lit(0)
    rows = said.join(F.broadcast(known), "l", "left_semi").select("t", "l", fold.cast("int").alias("fold"), F.spark_partition_id().alias("part"))
    kind = "fold int, line int, part int, v binary"
    weights = 1.0 / np.array([counts[v] for v in basis.languages])  # languages weigh alike, however many rows they have
    lines = rows.mapInArrow(text.released(_products(basis, weights)), kind).groupBy("fold", "line").applyInArrow(_added, kind).collect()
    width = len(basis.marks) + 1 + len(basis.languages)
    sums: dict[int, np.ndarray] = {}
    for r in sorted(lines, key=lambda r: r["fold"]):
        sums.setdefault(r["fold"], np.zeros((len(basis.marks) + 1, width)))[r["line"]] = np.frombuffer(bytes(r["v"]), np.float64)
    whole = np.sum(list(sums.values()), axis=0)
    model = basis.solved(whole)
    if open_set and len(sums) > 1:
        tried = {f: basis.solved(whole - own) for f, own in sums.items()}
        found = rows.select("t", "fold").mapInArrow(text.released(_extremes(model, tried)), EXTREMES).groupBy("bits").agg(F.min("clean").alias("clean"), F.max("noise").alias("noise")).collect()
        by_bits = {r["bits"]: r for r in found}
        highest = max((r["noise"] for r in found if r["noise"] is not None), default=0.0)
        for bits in range(len(model.floors)):
            clean, noise = (by_bits[bits][k] if bits in by_bits else None for k in ("clean", "noise"))
            floor = (highest if noise is None else noise) + MARGIN
            model.floors[bits] = max(floor if clean is None else min(floor, clean - MARGIN), 0.0)
    return model


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for first, last, data, offsets in text.string_slices(batch.column("text"), SLICE):
                n = last - first
                low = data | 32
                ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low < 123))])
                has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                for k in np.flatnonzero(~has).tolist():
                    has[k] = bool(_LETTER.search(data[offsets[k] : offsets[k + 1]].tobytes().decode()))
                if model.languages:
                    # A slice of many short texts is cut, so the presence table stays small.
                    parts = [model.predict(data[offsets[a] : offsets[min(a + 256, n)]], offsets[a : min(a + 256, n) + 1] - offsets[a]) for a in range(0, n, 256)]
                    best, score = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                else:
                    has, best, score = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n)
                best = np.where(has, best, len(model.languages))
                score = np.where(has, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def identify_language(docs: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, lang_pred, score; ``training`` holds the labelled rows (``docs`` by default)."""
    model = learned(docs if training is None else training, id_col, text_col, lang_col, limit)
    text.give_back()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(text.released(_predictor(model)), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.0, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", open_set: bool = False) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text has a language: not ``und``, and a score of ``least``.

    Learns from the labelled rows of ``docs``; rows are filtered where they stand, without a join.
    ``open_set``: texts that score no higher than noise of their size have no learned language. Where nothing can be learned, every text with a letter is kept.
    """
    model = learned(docs, id_col, text_col, lang_col, open_set=open_set)
    text.give_back()
    if not model.languages:
        model = Model(["any"], np.zeros((BUCKETS, 1), np.float32), np.ones(1, np.float32))
    predict = _predictor(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col)], names=["doc_id", "text"])
            said = pa.Table.from_batches(list(predict(iter([own]))))
            ok = np.array(said.column("lang_pred").to_pylist(), dtype=object) != UNDETERMINED
            yield batch.filter(pa.array(ok & (said.column("score").to_numpy() >= least)))

    return docs.mapInArrow(text.released(run), docs.schema)
