"""Blocks of the packed exchange: bounded whatever the scan's tasks, with the same results."""

import numpy as np
import pyarrow as pa
from cladeframe.llm import exchange, lm, suffixes
from helpers import ODD, make_docs, prose


def _batches(texts, rows):
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "block": [5] * len(texts)}, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("block", pa.int32())]))
    return [whole.slice(k, rows) for k in range(0, len(texts), rows)]


def test_cut_is_bounded_whatever_the_batches():
    texts = ["", "x" * 10, None, "y" * 60, "z" * 200, "", *("w" * 25 for _ in range(9)), "v" * 101, None]
    found = []
    for rows in (1, 3, len(texts)):
        blocks: dict[int, list] = {}
        for block, part in exchange.cut(iter(_batches(texts, rows)), 100):
            blocks.setdefault(block, []).extend(part.column("doc_id").to_pylist())
        assert [i for own in blocks.values() for i in own] == list(range(len(texts)))
        assert all(sum(len(texts[i] or "") for i in own) <= 100 or sum(bool(texts[i]) for i in own) == 1 for own in blocks.values())
        found.append(blocks)
    assert found[0] == found[1] == found[2] and len(found[0]) > 4


def test_small_blocks_change_nothing(spark):
    docs = make_docs(spark, [*ODD, *(prose(80, seed=k % 5) + prose(20, seed=k) for k in range(30))]).coalesce(1)
    rows, layout = exchange.blocked(docs, "doc_id", "text", False, 2_000)
    packed = rows.mapInArrow(exchange._packed(layout.block), exchange.ANSWER)
    assert rows.rdd.getNumPartitions() == 1 and packed.select("block").distinct().count() > 5 and layout.n_tasks > 5
    for run in (lambda **k: lm.stupid_backoff(docs, **k), lambda **k: suffixes.remove_repeats(docs, 60, 25, **k)):
        one, many = (sorted(map(repr, run(block=b).collect())) for b in (exchange.BLOCK, 2_000))
        assert one == many and len(one) == docs.count()


def test_slices_are_unpacked_as_they_were():
    texts = [None, "", "é😀", "x" * 300]
    out = list(exchange._packed(1 << 20)(iter(_batches(texts, 2))))
    assert [t for b in out for raw in b.column("totals").to_pylist() for t in exchange.unpacked(raw).column("text").to_pylist()] == texts
    assert np.all(np.concatenate([b.column("block").to_numpy() for b in out]) == 5 << 24)


def test_ngrams_that_occur_once_are_not_sent_in_full(spark, monkeypatch):
    docs = make_docs(spark, [*ODD, *(prose(300, seed=k, vocabulary=5000) for k in range(12)), prose(300, seed=3, vocabulary=5000)])
    want = sorted(map(repr, lm.stupid_backoff(docs).collect()))
    sent = []
    totals = exchange.totals
    monkeypatch.setattr(exchange, "totals", lambda asked, n: (sent.append(asked), totals(asked, n))[1])
    for bits in (exchange.BITS, -8):  # few bits: most pass by chance
        monkeypatch.setattr(exchange, "BITS", bits)
        assert sorted(map(repr, lm.stupid_backoff(docs, block=4_000).collect())) == want
    full, crowded = ({kind: sum(len(exchange.unpack(r["keys"])) for r in asked.filter(f"kind = {kind}").collect()) for kind in (1, 3)} for asked in sent)
    assert full[3] < full[1] / 3 and crowded[3] > 2 * full[3] and crowded[1] == full[1]
