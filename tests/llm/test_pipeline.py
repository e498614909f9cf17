import corpus_pipeline as cp
from helpers import make_docs, prose


def test_stages(spark, tmp_path):
    bench = "the quick brown fox jumps over the lazy dog while many other animals look at it from the far side of the river bank"
    base = prose(200, 3)
    texts = [base, base + " more", base, f"{prose(40, 8)} {bench} {prose(40, 9)}", "12 345 !", None, "", *(prose(60, 20 + k) for k in range(20))]
    docs = make_docs(spark, texts)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    (_, lang), (_, near), (_, clean), (_, mixed), (_, out) = cp.STAGES
    one = lang(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and set(ids(docs)) - set(ids(one)) == {13, 16, 19}
    two = near(spark, one, str(tmp_path))
    assert two.columns == docs.columns and set(ids(one)) - set(ids(two)) == {4, 7}
    three = clean(spark, two, str(tmp_path))
    assert three.columns == docs.columns and set(ids(two)) - set(ids(three)) == {10}
    four = mixed(spark, three, str(tmp_path))
    assert four.columns == docs.columns and set(ids(four)) <= set(ids(three))
    assert ids(out(spark, four, str(tmp_path))) == ids(four)


def test_repeated_ids_and_empty(spark, tmp_path):
    docs = make_docs(spark, [prose(30, 1), prose(30, 2)])
    twice = docs.unionByName(docs)
    assert cp.near_duplicates(spark, twice, "").count() == 2
    spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = docs.filter("doc_id < 0")
    for _, stage in cp.STAGES:
        out = stage(spark, out, str(tmp_path))
    assert out.count() == 0
