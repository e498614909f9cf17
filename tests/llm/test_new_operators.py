"""SimHash, filter audit and resampling against brute force, and the queries themselves on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import xxhash
from helpers import ODD, SCHEMA, lower, make_docs, prose, words

from cladeframe.llm import audit, queries, resampling, simhash, text


def clashing(docs):
    names = ("fp", "node", "component", "salt", "least", "anchor", "fingerprint", "part", "mask", "task", "digest", "last", "score", "rank", "n", "before", "weight", "label")
    return docs.selectExpr("*", *(f"'x' as {c}" for c in names))


# ---- SimHash


def brute_fingerprint(t):
    w = words(t)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest reachable id by place; prints are (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(prints))]


def simhash_texts():
    r = random.Random(5)
    out = [*ODD, "a b", "A  b", "c", " x y"]
    for k in range(6):
        base = prose(600, 40 + k).split(" ")
        for _ in range(12):
            edited = list(base)
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = f"w{r.randrange(99)}"
            out.append(" ".join(edited))
    return out + [prose(r.randint(1, 80), 900 + k) for k in range(40)]


def test_simhash(spark):
    texts = simhash_texts()
    for limits in ((4096, 1 << 18), (2, 30)):  # the second: nearly all anchors are crowded
        docs = clashing(make_docs(spark, texts))
        got = {r["doc_id"]: r for r in simhash.simhash_components(docs, home_rows=limits[0], anchor_rows=limits[1]).collect()}
        prints = [(3 * k + 1, brute_fingerprint(t)) for k, t in enumerate(texts)]
        assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == dict(prints)
        assert {i: r["component_id"] for i, r in got.items()} == {i: c for (i, _), c in zip(prints, brute_components(prints), strict=True)}
        assert len({r["component_id"] for r in got.values()}) < len(texts) - 30
        assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got.values())


def test_simhash_links_of_given_fingerprints(spark):
    """Chains, near groups and random numbers, straight into the links."""
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(300)}
    for _ in range(20):
        x = r.getrandbits(64)
        for _ in range(30):
            prints.add(x)
            x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    centre = r.getrandbits(64)
    prints |= {centre ^ 1 << b for b in range(64)} | {centre ^ 7 << b for b in range(60)}
    rows = sorted(prints)
    want = brute_components([(k, v) for k, v in enumerate(rows)])
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in rows], "fp long")
    for limits in ((4096, 1 << 18), (3, 40)):
        parent = {v: v for v in rows}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in simhash.links(df, *limits).collect():
            a, b = (int(np.int64(e[c]).view(np.uint64)) for c in "ab")
            assert (a ^ b).bit_count() <= 2
            parent[root(a)] = root(b)
        got = {}
        for k, v in enumerate(rows):
            got.setdefault(root(v), k)
        assert [got[root(v)] for v in rows] == want


def test_golay_anchors():
    r = np.random.default_rng(3)
    block = r.integers(0, 1 << 23, 500)
    row, word, beyond = simhash._near(block)
    distance = np.bitwise_count(block[row] ^ word)
    assert (np.bincount(row[distance <= 3], minlength=500) == 1).all() and (distance <= 5).all() and (np.maximum(distance.astype(int) - 3, 0) == beyond).all()
    fp = r.integers(-(1 << 63), 1 << 63, 400)
    near = fp ^ (1 << r.integers(0, 63, 400)) ^ (1 << r.integers(0, 63, 400))
    homes = {i: a for i, a, h in zip(*(x.tolist() for x in simhash.anchors(fp)), strict=True) if h}
    reached = set(zip(*(x.tolist() for x in simhash.anchors(near)[:2]), strict=True))
    assert len(homes) == 400 and all((i, a) in reached for i, a in homes.items())
    assert 50 < len(simhash.anchors(fp)[0]) / 400 < 75


def test_simhash_cases(spark):
    assert simhash.simhash_components(make_docs(spark, [])).count() == 0
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "q r s t u"), (None, "q r s t u"), (3, None), (2, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (None, None), (3, 2), (2, 2)], key=repr)
    long = prose(300_000, 1)
    assert len(long) > text.SLICE_BYTES
    said = simhash.simhash_components(make_docs(spark, [long, "x " * 10, long])).collect()
    assert {r["fingerprint"] for r in said if r["doc_id"] != 4} == {f"{brute_fingerprint(long):016x}"}


def test_simhash_hot_group(spark):
    """A third of all rows are one text, another third near copies: right, and no task holds them as pairs."""
    base = prose(400, 77).split(" ")
    r = random.Random(2)
    texts = ["same text here"] * 400
    for _ in range(400):
        e = list(base)
        e[r.randrange(400)] = f"v{r.randrange(10_000)}"
        texts.append(" ".join(e))
    texts += [prose(30, 5000 + k) for k in range(400)]
    prints = [(3 * k + 1, brute_fingerprint(t)) for k, t in enumerate(texts)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.simhash_components(make_docs(spark, texts), home_rows=50).collect()}
    assert got == {i: c for (i, _), c in zip(prints, brute_components(prints), strict=True)}


# ---- filter audit


def brute_mask(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    upper = sum("A" <= c <= "Z" for c in t)
    return {f for f, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 2 * len(t), bool(set(t) & set("#$%&*|"))), strict=True) if bad}


def brute_audit(rows, labels):
    """rows: (id, text, source); every document through every order, one at a time."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""] = min(ids.get(t or "", i), i)
    failed = [(i, s or "", brute_mask(t) | ({"E"} if (t or "") in ids and (i is None or i > ids[t or ""]) else set())) for i, t, s in rows]
    out = {}
    for order in itertools.permutations("ABCDE"):
        for part in {s for _, s, _ in failed}:
            left = [x for x in failed if x[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                own = [x for x in failed if x[1] == part]
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(f in x[2] for x in gone), sum(x[2] == {f} for x in own),
                    sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed), 0,
                ]
                gone += removed
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    for (part, order, step), v in out.items():
        v[6] = total[part, order[step - 1]]
    return out


AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows(spark, docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in AUDIT] for r in audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}


def test_filter_audit(spark):
    r = random.Random(11)
    texts = [*ODD, *ODD, prose(250, 1), prose(250, 1), prose(250, 2) + " #", "SHOUT " * 250, prose(220, 3).upper(), " ".join(f"w{k}" for k in range(230)), "a " * 300, "é" * 10 + "A"]
    texts += [r.choice(texts) for _ in range(80)]
    docs = clashing(make_docs(spark, texts))
    labels = [(3 * k + 1, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(len(texts)) if r.random() < 0.6] + [(99_999, 1, 1)]
    rows = [(3 * k + 1, t, ["s0", "s1", None][k % 3]) for k, t in enumerate(texts)]
    assert audit_rows(spark, docs, labels) == brute_audit(rows, labels)


def test_copies_over_many_ranges(spark):
    """One text of a third of all rows lies in many ranges: still all but the first of its rows are copies."""
    rows = [(k, "one and the same text" if k % 3 == 0 else f"text {k}" if k % 3 == 1 else f"pair {k // 6}") for k in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        masks = audit.failure_masks(docs.selectExpr("*", "'s' as source"), docs["text"].substr(1, 1))
        got = {r["doc_id"]: bool(r["mask"] & audit.COPY) for r in masks.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == {i: i != first[t] for i, t in rows}


def test_equal_fingerprints_of_different_texts():
    groups = audit._Groups()
    steps = [(5, b"a", 1), (5, b"a", 1), (5, b"a", 2), (5, b"b", 1), (5, b"b", None), (6, b"b", 3), (6, b"b", 4), (7, b"", None), (7, b"", None)]
    assert [groups.step(*s) for s in steps] == [False, False, True, False, True, False, True, False, False]


def test_filter_audit_cases(spark):
    assert audit.filter_audit(make_docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    long = prose(300_000, 1)
    rows = [(None, "x"), (None, "x"), (4, "x"), (4, "x"), (9, long), (8, long), (None, "nobody else has this"), (None, "nobody else has this")]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, source string")
    labels = [(4, 1, 0), (4, 0, 1), (9, 1, 1)]
    assert audit_rows(spark, docs, labels) == brute_audit([(i, t, None) for i, t in rows], [(4, 1, 1), (9, 1, 1)])


# ---- resampling


def own_words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]


def brute_resample(rows, target, order=1, buckets=10_000):
    def feats(t):
        w = own_words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for b in feats(x):
            s[b] += 1
    for x in target:
        for b in feats(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = {}
    for i, x in rows:
        f = feats(x)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, x in rows if len(own_words(x)) >= 20), key=lambda i: (-out[i][2], i))
    for n, i in enumerate(able[: len(able) * 10 // 100], 1):
        out[i][3] = n
    return out


def test_resampling(spark):
    texts = [*ODD, "x" * 200 + " " + "y" * 64 + " " + "z" * 65, *(prose(5 + 3 * k, k) for k in range(150)), prose(60, 4), prose(60, 4)]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    target = [prose(300, 7), prose(40, 8), None, "ß 日本"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for order, buckets in ((1, 10_000), (3, 500)):
        got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in resampling.resample(clashing(make_docs(spark, texts)), bench, order=order, buckets=buckets).collect()}
        assert got == brute_resample(rows, target, order, buckets)


def test_crc_of_spans():
    r = random.Random(1)
    spans = [bytes(r.randrange(256) for _ in range(n)) for n in [0, 1, 2, 63, 64, 65, 66, 300, 5, 5, 0]]
    data = np.frombuffer(b"".join(spans), np.uint8)
    end = np.cumsum([len(s) for s in spans])
    start = end - [len(s) for s in spans]
    got = resampling.advance(np.full(len(spans), 0xFFFFFFFF, np.uint32), data, start, end) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(s) for s in spans]


def test_resampling_cases(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(make_docs(spark, []), bench).count() == 0
    long = prose(300_000, 1)
    rows = [(None, prose(30, 1)), (None, prose(30, 2)), *((5, prose(30, 3)) for _ in range(20)), (6, long)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert len(got) == len(rows) and sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and all(r["doc_id"] is not None for r in got if r["rank"])
    assert [r["n_features"] for r in got if r["doc_id"] == 6] == [300_000]


# ---- the queries themselves


def test_queries(spark, tmp_path):
    r = random.Random(3)
    texts = simhash_texts()
    rows = [(3 * k + 1, t, "en", r.choice(["a", "b", None]), len(t or "")) for k, t in enumerate(texts)]
    target = [prose(50, 1), prose(30, 2)]
    labels = [(3 * k + 1, k % 2, k % 5 == 0) for k in range(0, len(texts), 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    got = queries.op11_simhash(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["fingerprint"], x["component_id"]) for x in got) == [(i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints), strict=True)]
    audited = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in AUDIT] for x in queries.op12_filter_audit(spark, str(tmp_path)).collect()}
    assert audited == brute_audit([(i, t, s) for i, t, _, s, _ in rows], labels)
    drawn = {x["doc_id"]: [x["n_features"], x["weight"], x["score"], x["rank"]] for x in queries.op13_resampling(spark, str(tmp_path)).collect()}
    assert drawn == brute_resample([(i, t) for i, t, *_ in rows], target)


# ---- token output


def test_tokens_of_every_ascii_character(spark, tmp_path):
    """The query itself: every ASCII character alone, in words and between blanks, and random Unicode, against the tokenizer; the files' layout."""
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from cladeframe.llm import shared

    r = random.Random(0)
    ascii_ = [chr(c) for c in range(128)]
    other = [chr(c) for c in (0x85, 0xA0, 0xC5, 0xDF, 0x130, 0x131, 0x301, 0x345, 0x3A3, 0x3C2, 0x2003, 0x2028, 0x3000, 0x4E00, 0xFEFF, 0x1F1E6, 0x1F600)]
    texts = [None, *ascii_, *(f"ab{c}cd" for c in ascii_), *(f"x {c} y" for c in ascii_)]
    texts += ["".join(r.choice(ascii_) if r.random() < 0.6 else r.choice(other) if r.random() < 0.5 else r.choice("abcde   '") for _ in range(r.randint(0, 30))) for _ in range(2000)]
    rows = [(3 * k + 1, t, "en", "s", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op1_token_output(spark, str(tmp_path)).collect()}
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for i, t, *_ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)
    from pathlib import Path

    newest = max((p for p in Path(shared.shared_dir(spark).removeprefix("file:")).glob("cladeframe/tokens-*")), key=lambda p: p.stat().st_mtime)
    for file in newest.glob("part-*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["tokens"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())


# ---- the pipeline's operators where columns, ids or labels are odd


def test_pipeline_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as cp

    bench = prose(20, 3)
    texts = [prose(40, 1), prose(40, 1), f"{prose(9, 5)} {bench}", *(prose(40, 50 + k) for k in range(12))]
    names = ["__key", "__gone", "__own", "__row", "__id", "__copies", "__copy", "own_key", "gone_key", "gone", "row_key", "mixed_id", "mixed_copies", "mixed_copy", "row", "least", "key", "hash", "n"]
    docs = make_docs(spark, texts).selectExpr("*", *(f"'{n}' as `{n}`" for n in names))
    docs = docs.unionByName(docs.filter("doc_id = 7"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r[n] == n for r in out.collect() for n in names)
    assert {r["doc_id"] for r in out.collect()} <= {3 * k + 1 for k in range(len(texts))} - {4, 7}


def test_language_samples_without_ids(spark):
    from cladeframe.llm import language

    r = random.Random(2)
    rows = [(None, f"{lang} {k}", lang) for lang, n in (("a", 300), ("b", 60), ("c", 30), ("d", 30)) for k in range(n)] + [(5, "twice", "a"), (5, "twice too", "a")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language.training_rows(docs.repartition(k), "doc_id", "text", "lang", 100) for k in (3, 7))
    assert one == two and sorted(one[1]) == ["a"] * 25 + ["b"] * 25 + ["c"] * 25 + ["d"] * 25


def test_language_open_set_is_no_switch_of_size(spark):
    """With 60 labelled rows as with 900: noise goes, and all clean texts stay."""
    from test_learned_and_mixed import spoken

    from cladeframe.llm import language

    r = random.Random(8)
    for n in (60, 900):
        clean = [(k, spoken(["en", "de", "es"][k % 3], 20 + k % 40, k), ["en", "de", "es"][k % 3]) for k in range(n)]
        noise = [(2000 + k, "".join(r.choice("bcdfgjkpqvxyz ") for _ in range(400)), None) for k in range(20)]
        kept = {x["doc_id"] for x in language.keep_identified(spark.createDataFrame(clean + noise, "doc_id long, text string, lang string"), open_set=True).collect()}
        assert {i for i, *_ in clean} <= kept and not [i for i in kept if i >= 2000], n


def test_short_benchmark_items(spark):
    from cladeframe.llm import decontaminate

    items = [(1, "What is 7 + 5?"), (2, "Who?"), (3, ""), (4, None), (5, "one two three four five six")]
    texts = ["He asked: what is 7 + 5? Then left.", "What is 8 + 5", "who knows", "whose", "is 7 what 5", "so one two three four five six", "one two three four six five"]
    docs = make_docs(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (7, 2), (16, 5)}


def kernel_ridge(train, labels, texts):
    """The classifier by its definition: sets of n-grams, the kernel matrix in full, the ridge solved on Nyström features."""
    from cladeframe.llm import language

    def grams(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return set(language.presence(data, np.array([0, len(data)]))[1].tolist())

    def kernel(a, b):
        return np.array([[len(x & y) / max(math.sqrt(len(x) * len(y)), 1) for y in b] for x in a])

    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    r = np.random.default_rng(0)
    marks = np.concatenate([r.permutation(np.flatnonzero(y == k))[: max(1, language.LANDMARKS // len(names))] for k in range(len(names))])
    own = [grams(t) for t in train]
    z = [own[k] for k in marks]
    values, vectors = np.linalg.eigh(kernel(z, z))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    x = kernel(own, z) @ root
    w = np.array([len(y) / len(names) / (y == k).sum() for k in y])
    mean = (w[:, None] * x).sum(0) / w.sum()
    out = []
    for k in range(len(names)):
        t = np.where(y == k, 1.0, -1.0)
        shift = (w * t).sum() / w.sum()
        a = (x - mean).T @ (w[:, None] * (x - mean)) + language.RIDGE * len(y) / len(names) * np.eye(x.shape[1])
        beta = np.linalg.solve(a, (x - mean).T @ (w * (t - shift)))
        out.append((kernel([grams(t) for t in texts], z) @ root - mean) @ beta + shift)
    value = np.array(out).T
    return [names[k] for k in value.argmax(1)], np.clip((value.max(1) + 1) / 2, 0, 1)


def test_language_query_is_the_kernel_ridge(spark, tmp_path):
    from test_learned_and_mixed import spoken

    rows = [(k, spoken(["en", "de", "es"][k % 3], 4 + k % 30, k), ["en", "de", "es"][k % 3], "s", 0) for k in range(120)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op3_language_id(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    train = [r for r in rows if not held[r[0]]]
    from cladeframe.llm import language

    texts, labels = language.training_rows(spark.createDataFrame(train, SCHEMA), "doc_id", "text", "lang")
    assert sorted(zip(texts, labels, strict=True)) == sorted((t, v) for _, t, v, *_ in train)
    names, scores = kernel_ridge(texts, labels, [t for _, t, *_ in rows])
    assert {i: got[i]["held_out"] for i in got} == held
    for (i, *_), name, score in zip(rows, names, scores, strict=True):
        assert got[i]["lang_pred"] == name and abs(got[i]["score"] - score) < 1e-3
