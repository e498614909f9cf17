import random

import numpy as np
import pytest
from helpers import ODD, make_docs, prose
from pyspark.sql import functions as F

from cladeframe.llm import graph, language, mixing


def spoken(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    parts = {"en": ["the", "ing", "tion", "and", "sh", "wh"], "de": ["sch", "ung", "ein", "ü", "ß", "heit"], "es": ["ción", "ñ", "que", "ado", "los", "mente"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rows = [(k, spoken(lang, 5 + k % 40, k), lang) for k, lang in enumerate(["en", "de", "es"] * 60)]
    rows += [(900 + k, t, None) for k, t in enumerate([*ODD, "123 !! 45", "日本語"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score")
    got = {r["doc_id"]: r for r in language.identify_language(docs, training=docs.filter(~language.held_out())).collect()}
    test = [r for r in docs.filter(language.held_out()).filter("lang is not null").collect()]
    assert len(test) > 15 and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in test) >= 0.95 * len(test)
    letters = {i: any(c.isalpha() for c in t or "") for i, t, _ in rows}
    for i, g in got.items():
        assert (g["lang_pred"] == "und") == (not letters[i]) and 0 <= g["score"] <= 1
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, ok in letters.items() if ok}


def test_language_without_labels(spark):
    docs = make_docs(spark, ["some text", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify_language(docs).collect()} == {"und"}


def test_open_set(spark):
    r = random.Random(8)
    clean = [(k, spoken(lang, 20 + k % 40, k), lang) for k, lang in enumerate(["en", "de", "es"] * 300)]
    noise = [(2000 + k, "".join(r.choice("bcdfgjkpqvxyz ") for _ in range(400)), None) for k in range(20)] + [(3000, "日本語の文章です" * 20, None)]
    docs = spark.createDataFrame(clean + noise, "doc_id long, text string, lang string")
    kept = {x["doc_id"] for x in language.keep_identified(docs, open_set=True).collect()}
    assert len([i for i in kept if i < 2000]) >= 0.99 * len(clean) and not [i for i in kept if i >= 2000]
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(bare, open_set=True).count() == docs.count()


def test_rare_label_keeps_its_share(spark):
    rows = spark.range(40_000).selectExpr("id as doc_id", "concat('text ', id, repeat(' z', 3000)) as text", "if(id % 4000 = 7, 'rare', 'common') as lang")
    texts, labels = language.training_rows(rows, "doc_id", "text", "lang", 8)
    assert sorted(labels) == ["common"] * 4 + ["rare"] * 4 and min(map(len, texts)) > 6000


def test_shares():
    got = mixing.capped_shares({"+a": 100, "+b": 10, "+c": 100}, {"+a": 5, "+b": 2, "+c": 1}, 315, 2)
    assert got["+b"] == 20 and got["+a"] == 200 and got["+c"] == pytest.approx(95)
    assert mixing.capped_shares({}, {}, 10, 2) == {}
    assert mixing.cycle_weights(["-", "+b", "+a"], (5, 2, 1)) == {"+a": 5, "+b": 2, "-": 1}


def cost(patterns, flow):
    used = [sum(v for (p, _), v in flow.words.items() if p == k) for k in range(len(patterns))]
    return sum(sum(max(0, min(u - c * w, w)) * c for c in range(9)) for u, (_, w) in zip(used, patterns, strict=True))


def test_min_cost_flow_against_enumeration():
    """Least cost of all flows, by trying every split of small quotas."""
    r = random.Random(4)
    for _ in range(40):
        patterns = [(s, r.randint(1, 4)) for s in (("a",), ("b",), ("a", "b"))]
        quota = {"a": r.randint(0, 6), "b": r.randint(0, 6)}
        flow = mixing.min_cost_flow(patterns, quota, 2)
        best = None
        for fa in range(quota["a"] + 1):
            for fb in range(quota["b"] + 1):
                used = [fa, fb, quota["a"] - fa + quota["b"] - fb]
                if all(u <= 2 * w for u, (_, w) in zip(used, patterns, strict=True)):
                    c = sum(max(0, u - w) for u, (_, w) in zip(used, patterns, strict=True))
                    best = c if best is None else min(best, c)
        if best is not None:
            assert not flow.unmet and cost(patterns, flow) == best
        for s in quota:
            assert sum(v for (_, t), v in flow.words.items() if t == s) + flow.unmet.get(s, 0) == quota[s]


def test_mix(spark):
    docs = make_docs(spark, [*ODD, *(prose(20 + 7 * k, k) for k in range(60))], extra=True)

    def run():
        rows = mixing.sized(docs, F.array(mixing.source_key(F.col("source"))))
        patterns = mixing.pattern_sizes(rows)
        sizes = {s[0]: n for s, n in patterns}
        target = mixing.capped_shares(sizes, mixing.cycle_weights(list(sizes), (5, 2, 1)), 1.5 * sum(sizes.values()), 2)
        return target, [(r["doc_id"], r["pattern"][0], r["size"], r["taken"]) for r in mixing.mix(rows, patterns, target).orderBy("doc_id").collect()]

    target, got = run()
    assert run()[1] == got and len(got) == docs.count() and set(target) == {"+s0", "+s1", "-"}
    for s, t in target.items():
        assert abs(sum(x[3] for x in got if x[1] == s) - t) <= 25
    assert all(x[3] <= 2 * x[2] for x in got)


def test_repeated_keeps_columns(spark):
    docs = make_docs(spark, [prose(50, k) for k in range(30)], extra=True)
    out = mixing.repeated(docs, F.array(mixing.source_key(F.col("source"))), lambda sizes: {k: 1.5 * n for k, n in sizes.items()})
    assert out.columns == docs.columns and 30 < out.count() <= 60


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(7, 7), (200, 201)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {row["node"]: row["component"] for row in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b}


def test_all_labelled_rows_teach(spark):
    """With few landmarks and few rows to choose them from, weights and floors still come from every labelled row."""
    rows = [(k, spoken(lang, 5 + k % 40, k), lang) for k, lang in enumerate(["en", "de", "es"] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    texts, labels = language.training_rows(docs, "doc_id", "text", "lang", 30)
    basis = language.Basis.of(texts, labels)
    feats = np.concatenate([basis.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t, _ in rows])
    y = np.array([basis.languages.index(v) for *_, v in rows])
    want = basis.solved(feats.T @ np.concatenate([feats, np.eye(3)[y]], 1) / 100)
    for got in (language.learned(docs, "doc_id", "text", "lang", 30), language.learned(docs, "doc_id", "text", "lang", 30, open_set=True)):
        assert np.abs(got.weights - want.weights).max() < 1e-4 and np.abs(got.bias - want.bias).max() < 1e-4
    kept = {r["doc_id"] for r in language.keep_identified(docs, open_set=True).collect()}
    assert kept == {i for i, *_ in rows}
