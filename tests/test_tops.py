"""Scores without traceback and alignments without gaps are those of the whole program."""

import random

import numpy as np
import pytest
from cladeframe.operators import alignment, pairbatch, search


def _seq(r, n, letters="ACGT"):
    return "".join(r.choice(letters) for _ in range(n))


def _mutated(r, s, rate, indel):
    return "".join("" if r.random() < indel / 2 else r.choice("ACGT") * 2 if r.random() < indel else r.choice("ACGT") if r.random() < rate else c for c in s)


@pytest.mark.parametrize("costs", [search.BASES.costs, alignment.costs(alignment.LOCAL_NT), search.TRANSLATED.costs, pairbatch.Costs(2, -1, -5, -1, None, (ord("N"),))])
@pytest.mark.parametrize("banded", [True, False])
def test_tops_and_local(costs, banded):
    r = random.Random(4)
    letters = "ACGTN" if costs.matrix is None or costs.matrix[65, 67] == -3 else search.RESIDUES
    pairs = []
    for k in range(150):
        ref = _seq(r, r.randint(1, 90), letters)
        pairs.append((_mutated(r, ref[r.randint(0, 20) :], 0.1, 0.05 * (k % 3)) or "A", ref))
    pairs += [("A", "C"), ("AAAA", "AAAA"), ("ACGTACGT" * 4, "ACGT" * 3)]
    q, t = ([np.frombuffer(x.encode(), np.uint8).astype(np.int64) for x in side] for side in zip(*pairs, strict=True))
    bands = [(d - 9, d + 9) for d in (r.randint(-5, 20) for _ in pairs)] if banded else None
    want = pairbatch.align(q, t, costs, True, bands)
    ends = pairbatch.tops(q, t, costs, bands)
    assert [x.score for x in want] == pytest.approx(ends[0].tolist())
    if banded:
        for a, b in zip(pairbatch.local(q, t, costs, bands, ends), want, strict=True):
            assert (a.query, a.ref, a.steps.tolist()) == (b.query, b.ref, b.steps.tolist()) and a.score == pytest.approx(b.score)


def test_winners_by_scores_alone(monkeypatch):
    r = random.Random(5)
    refs = [_seq(r, 60) for _ in range(5)] + [""]
    refs.append(refs[1])
    queries = [_mutated(r, r.choice(refs), 0.2, 0.05) for _ in range(60)] + ["", "A"]
    sketch = alignment.Sketches(refs, alignment.LOCAL_NT)
    assert np.allclose(sketch.all_bounds([alignment._codes(x) for x in queries]), [sketch.bounds(x) for x in queries])
    whole = alignment.winners(queries, refs, alignment.LOCAL_NT, True)
    for q, (at, al, n) in zip(queries, whole, strict=True):
        each = [alignment.align(q, x, alignment.LOCAL_NT, True).score for x in refs]
        assert at == each.index(max(each)) and al.score == max(each) and 1 <= n <= len(refs)
    monkeypatch.setattr(alignment, "align_all", None)  # no traceback without ``traced``
    plain = alignment.winners(queries, refs, alignment.LOCAL_NT, True, traced=False)
    assert [(at, al.score, n) for at, al, n in plain] == [(at, al.score, n) for at, al, n in whole]


def test_wide_distances_are_dealt_by_query(spark, monkeypatch):
    from cladeframe.operators import hits, sized

    rows = [(q, t, 100 + k, k % 5, 0, 1.0, k) for k, (q, t) in enumerate((q, t) for q in range(40) for t in (1, 2, 2))]
    df = hits.with_distance(spark.createDataFrame(rows, "query long, target int, length long, mismatch long, gaps long, bitscore double, ordinal long"))
    want = sorted(map(repr, hits.wide_distances(df, "query", "target", [1, 2, 3]).collect()))
    monkeypatch.setattr(sized.by_key, "__defaults__", (10,))
    assert sized.by_key(df, "query").rdd.getNumPartitions() == 12
    out = hits.wide_distances(df, "query", "target", [1, 2, 3])
    assert sorted(map(repr, out.collect())) == want and len(want) == 40 and out.columns[:3] == ["query", "GT1_Distance", "GT1_AlignedNT"]
