"""Multiple alignment: the optimum of three short sequences by enumeration, and what must hold for any."""

import functools
import random

import pytest

from cladeframe.operators import msa, search

SCORING = msa.Scoring(search.base_matrix(2, -1), "ACGT", -2.0, -2.0, 3, 4)  # gaps without opening costs, so that a column can be scored alone


def related(r, n, length, rate):
    base = "".join(r.choice("ACGT") for _ in range(length))
    out = []
    for _ in range(n):
        s = []
        for c in base:
            x = r.random()
            if x < rate:
                continue
            s.append(r.choice("ACGT") if x < 2 * rate else c)
        out.append("".join(s) or "A")
    return out


def optimum(a, b, c):
    """Best sum of pairs of three sequences, over all alignments."""

    def pair(x, y):
        return 0 if x == y == "-" else -2 if "-" in (x, y) else 2 if x == y else -1

    @functools.cache
    def best(i, j, k):
        if not (i or j or k):
            return 0
        out = -(10**9)
        for x in (0, 1):
            for y in (0, 1):
                for z in (0, 1):
                    if (x or y or z) and x <= i and y <= j and z <= k:
                        p, q, s = (a[i - 1] if x else "-"), (b[j - 1] if y else "-"), (c[k - 1] if z else "-")
                        out = max(out, best(i - x, j - y, k - z) + pair(p, q) + pair(p, s) + pair(q, s))
        return out

    return best(len(a), len(b), len(c))


def aligned(spark, seqs, scoring):
    df = spark.createDataFrame([(f"s{k:03d}", s) for k, s in enumerate(seqs)], "name string, seq string")
    return [r["aligned"] for r in msa.progressive(df, scoring).orderBy("name").collect()]


def test_three_sequences_reach_the_optimum():
    r = random.Random(6)
    reached = 0
    for _ in range(40):
        seqs = related(r, 3, r.randint(5, 12), 0.08)
        rows = [seqs[0]]
        for s in seqs[1:]:
            one, two = msa.merge(rows, [s], SCORING)
            rows = [*one, *two]
        rows = msa.refine(rows, SCORING)
        assert [x.replace("-", "") for x in rows] == seqs
        score, most = msa.sum_of_pairs(rows, SCORING), optimum(*seqs)
        assert score <= most + 1e-9
        reached += score == pytest.approx(most)
    assert reached >= 36


def test_two_sequences_are_the_pairwise_optimum():
    from cladeframe.operators import alignment

    r = random.Random(8)
    plain = alignment.Scores(2, -1, -5, -1)
    scoring = msa.Scoring(search.base_matrix(2, -1), "ACGT", -5.0, -1.0, 3, 0)
    for _ in range(60):
        a, b = related(r, 2, r.randint(1, 25), 0.2)
        one, two = msa.merge([a], [b], scoring)
        assert msa.sum_of_pairs([*one, *two], scoring) == pytest.approx(alignment.align(a, b, plain).score)


def test_progressive(spark):
    r = random.Random(1)
    seqs = related(r, 9, 60, 0.06)
    rows = aligned(spark, seqs, msa.BASES)
    assert len({len(x) for x in rows}) == 1 and [x.replace("-", "") for x in rows] == seqs
    assert all(set(column) != {"-"} for column in zip(*rows, strict=True))
    wide = max(map(len, seqs))
    assert msa.sum_of_pairs(rows, msa.BASES) > msa.sum_of_pairs([s.ljust(wide, "-") for s in seqs], msa.BASES)
    assert aligned(spark, ["MKV", "MKV", "MV"], msa.RESIDUES) in (["MKV", "MKV", "M-V"],)
    assert aligned(spark, ["ACGT"], msa.BASES) == ["ACGT"] and aligned(spark, ["ACGT", None, ""], msa.BASES) == ["ACGT", "----", "----"]
    assert aligned(spark, [], msa.BASES) == []
    with pytest.raises(ValueError, match="unique"):
        msa.progressive(spark.createDataFrame([("a", "A"), ("a", "C")], "name string, seq string"))


def test_guide_tree_joins_the_nearest(spark):
    near = {("a", "b"): 0.1, ("c", "d"): 0.2, ("a", "c"): 0.6, ("b", "c"): 0.5}
    assert msa.guide_tree(list("abcd"), near) == [(0, 1, 1), (2, 3, 1), (4, 5, 2)]
    seqs = {"a": "ACGTACGTAA", "b": "ACGTACGTAC", "c": "GGGGGGTTTT"}
    got = {(r["a"], r["b"]): r["distance"] for r in msa.distances(spark.createDataFrame(sorted(seqs.items()), "name string, seq string"), msa.Scoring(None, "", 0, 0, 3)).collect()}

    def words(s):
        return [s[i : i + 3] for i in range(len(s) - 2)]

    common = sum(min(words(seqs["a"]).count(w), words(seqs["b"]).count(w)) for w in set(words(seqs["a"])))
    assert got == {("a", "b"): pytest.approx(1 - common / 8)}
