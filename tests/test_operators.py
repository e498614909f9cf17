"""Operators on tiny tables with hand-computed answers, ties, and brute force."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cladeframe import genes
from cladeframe.operators import alignment, distance, grouping, hits, profiles, selection


def counts_of(spark, groups):
    rows = [(g, p + 1, c) for g, seqs in groups.items() for s in seqs for p, c in enumerate(s)]
    return spark.createDataFrame(rows, "g string, pos int, call string").groupBy("g", "pos", "call").agg(F.count("*").alias("n"))


def test_pair_distance_worked_example(spark):
    got = {(r["a"], r["b"]): r["distance"] for r in distance.pair_distance(counts_of(spark, {"A": ["AT", "GT"], "B": ["AC", "GC"]}), "g").collect()}
    assert got == {("A", "B"): 0.75, ("A", "A"): 0.5, ("B", "B"): 0.5}


def test_pair_distance_is_that_of_all_pairs(spark):
    r = random.Random(2)
    groups = {g: ["".join(r.choice("ACG") for _ in range(5)) for _ in range(n)] for g, n in (("x", 7), ("y", 4), ("z", 1))}
    got = {(q["a"], q["b"]): q["distance"] for q in distance.pair_distance(counts_of(spark, groups), "g").collect()}
    for a, b in itertools.combinations_with_replacement("xyz", 2):
        pairs = list(itertools.combinations(groups[a], 2)) if a == b else list(itertools.product(groups[a], groups[b]))
        d = [s[k] != t[k] for s, t in pairs for k in range(5)]
        assert got[a, b] == (pytest.approx(sum(d) / len(d)) if d else None)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a1", "1", 1, "ACD"), ("a2", "1", 2, "CXE*"), ("a3", "1", 1, "AC-"), ("a4", "2", 1, "KK"), ("a5", "1", 2, "D")], "accession string, gt string, start int, seq string")


def test_profile_counts(rows):
    got = {(r["gt"], r["pos"], r["aa"]): (r["n"], r["denom"]) for r in profiles.position_counts(rows, ["gt"]).collect()}
    assert got[("1", 2, "C")] == (3, 4) and got[("1", 2, "D")] == (1, 4) and got[("1", 3, "-")] == (1, 2) and got[("1", 5, "*")] == (1, 1) and ("1", 3, "X") not in got
    some = {(r["gt"], r["pos"], r["aa"]): r["n"] for r in profiles.position_counts(rows, ["gt"], [2, 9]).collect()}
    assert some == {("1", 2, "C"): 3, ("1", 2, "D"): 1, ("2", 2, "K"): 1}


def test_consensus_ties_and_gaps(spark):
    prof = spark.createDataFrame([("1", 1, "C", 50.0), ("1", 1, "A", 50.0), ("1", 4, "-", 60.0), ("1", 4, "K", 40.0), ("1", 6, "K", 1.0)], "gt string, pos int, aa string, pct double")
    assert [r["consensus"] for r in profiles.consensus(prof, ["gt"]).collect()] == ["AK"]
    assert [r["consensus"] for r in profiles.consensus(prof, ["gt"], 4).collect()] == ["A"]


def test_entropy_bounds(rows):
    for r in profiles.entropy(profiles.position_counts(rows, ["gt"]), ["gt"], None).collect():
        assert 0 <= r["entropy"] <= 3
    two = {(r["gt"], r["pos"]): r["entropy"] for r in profiles.entropy(profiles.position_counts(rows, ["gt"]), ["gt"]).collect()}
    assert two["1", 2] == pytest.approx(0.81) and two["2", 1] == 0.0 and ("1", 5) not in two


def test_grid(rows):
    counts = profiles.position_counts(rows, ["gt"])
    got = {r["gt"]: r.asDict() for r in profiles.ras_grid(profiles.profile(counts), counts, ["gt"], [2, 3]).collect()}
    assert got["1"]["label"] == "GT1 (4, 2-4)" and got["1"]["P2"] == "C75D25" and got["2"]["label"] == "GT2 (1, 0-1)" and got["2"]["P3"] == ""


HITS = "query string, target int, length long, mismatch long, gaps long, bitscore double, ordinal long"


def test_hit_choices_and_ties(spark):
    h = hits.with_distance(spark.createDataFrame([("q", 2, 200, 10, 0, 9.0, 1), ("q", 2, 200, 10, 0, 9.0, 2), ("q", 1, 200, 10, 0, 9.0, 3), ("q", 3, 300, 15, 0, 1.0, 4), ("r", 5, 0, 0, 0, 1.0, 5), ("r", 6, 10, 9, 0, 1.0, 6)], HITS))
    assert {(r["query"], r["target"]): r["ordinal"] for r in hits.best_per_target(h, "query", "target").collect()}["q", 2] == 1
    assert {r["query"]: r["target"] for r in hits.best_target(h, "query", "target").collect()} == {"q": 3, "r": 6}
    two = {r["query"]: (r["best"], r["second"]) for r in hits.best_two_targets(h, "query", "target").collect()}
    assert two == {"q": (3, 1), "r": (6, 5)}
    assert {r["query"]: r["ordinal"] for r in hits.best_protein(h, "query", 80).collect()} == {"q": 1}


def test_covered_positions(spark):
    got = spark.range(1).select(hits.covered_positions(F.lit(6), F.lit(9), (1, 2, 3, 4)).alias("v")).first()["v"]
    assert got == [2, 3]


def test_rules(spark):
    rows = spark.createDataFrame([("1", "Day1 x", "A"), ("1", "day 2", "B"), ("2", "any", "C"), ("3", None, "D"), ("4", "x", "A"), ("4", "x", "B")], "ref_id string, note string, accession string")
    rules = spark.createDataFrame([("1", "note", "contains", "DAY1"), ("3", "note", "not_contains", "z"), ("4", "accession", "in_accession_list", "l")], "ref_id string, field string, op string, value string")
    lists = spark.createDataFrame([("l", "B")], "list string, accession string")
    kept = sorted((r["ref_id"], r["accession"]) for r in selection.apply_rules(rows, rules, ["note", "accession"], lists).collect())
    assert kept == [("1", "A"), ("2", "C"), ("3", "D"), ("4", "B")]


def test_fallback_override_status(spark):
    calls = spark.createDataFrame([("A.1", "x", 1), ("A.2", "y", 2), ("B", "z", 3), ("A.1", "late", 4)], "accession string, call string, ordinal int")
    asked = spark.createDataFrame([("A.2",), ("A.9",), ("B.1",), ("C",)], "accession string")
    assert {r["accession"]: r["call"] for r in selection.with_fallback(asked, calls, "call").collect()} == {"A.2": "y", "A.9": "x", "B.1": "z", "C": None}
    base, prio = (spark.createDataFrame(x, "k string, v string") for x in ([("a", "1"), ("b", "2")], [("b", "9"), ("c", "8")]))
    assert sorted(tuple(r) for r in selection.overridden(base, prio, "k", "v").collect()) == [("a", "1", "base"), ("b", "9", "priority"), ("c", "8", "priority")]
    status = spark.createDataFrame([("a", "Unassigned"), ("b", "1a")], "k string, v string")
    assert {r["k"]: r["status"] for r in selection.three_way(base.select("k").union(spark.createDataFrame([("z",)], "k string")), status, "k", "v").collect()} == {"a": "unassigned", "b": "assigned", "z": "missing"}


def test_errors_are_raised(spark):
    twice = spark.createDataFrame([("1", "p"), ("1", "q"), ("2", "r")], "ref_id string, path string")
    studies = spark.createDataFrame([("1",), ("2",)], "ref_id string")
    with pytest.raises(PySparkException, match="more than once"):
        selection.with_files(studies, twice, "one").collect()
    assert {r["ref_id"]: r["path"] for r in selection.with_files(studies, twice, "first").collect()} == {"1": "p", "2": "r"}
    with pytest.raises(PySparkException, match="no reference"):
        selection.present_or_fail(spark.createDataFrame([(None,)], "x string"), "x", "reference").collect()


def test_exclusions(spark):
    rows = spark.createDataFrame([(1, None), (2, "X"), (30, "ok")], "n int, s string")
    got = {r["reason"]: r["n"] for r in distance.exclusions(rows, [("missing", F.col("s").isNull()), ("small", F.col("n") < 10)]).collect()}
    assert got == {"missing": 1, "small": 1, "Total": 2}


def test_groups_and_persons(spark):
    rows = spark.createDataFrame([("1", "A", "P1_a_c1", "", "", [24, 26]), ("1", "B", "P1_a_c2", "", "", [24, 26]), ("1", "C", "", "iso Day 3", "", []), ("1", "D", "", "", "", [24])], "ref_id string, accession string, source_clone string, source_isolate string, structured_comment string, positions array<int>")
    got = {r["group_key"]: r for r in grouping.summaries(grouping.group_keys(rows), "ref_id", ["source_clone"], positions="positions").collect()}
    assert got["P1_a"]["selected"] == "B" and got["P1_a"]["source_clone_values"] == "P1_a_c1 | P1_a_c2" and got["P1_a"]["mode"] == "source_clone_prefix"
    assert got["iso"]["mode"] == "" and got["__ungrouped__D"]["covered"] == 1
    field = grouping.person_field(spark.createDataFrame([("p1", "i1"), ("p1", "i2"), ("p2", "")], "patient string, isolate string"), ["patient", "isolate"]).first()
    assert (field["field"], field["score"]) == ("patient", 512)


@pytest.mark.parametrize("seed", range(6))
def test_chain_is_the_best(seed):
    r = random.Random(seed)
    h = [(s := r.randint(1, 30), s + r.randint(0, 12), r.randint(0, 9), r.random()) for _ in range(7)]
    starts, ends, gains, bits = map(list, zip(*h, strict=True))
    kept = alignment.chain(starts, ends, gains, bits)
    assert all(ends[a] < starts[b] for a, b in itertools.pairwise(kept))
    best = max(sum(gains[k] for k in c) for n in range(8) for c in itertools.combinations(range(7), n) if all(ends[a] < starts[b] or ends[b] < starts[a] for a, b in itertools.combinations(c, 2)))
    assert sum(gains[k] for k in kept) == best


def score_of(a, b, s):
    total, open_gap = 0.0, None
    for x, y in zip(a, b, strict=True):
        gap = "q" if x == "-" else "r" if y == "-" else None
        total += (s.match if x == y else s.mismatch) if gap is None else (s.gap_extend if gap == open_gap else s.gap_open)
        open_gap = gap
    return total


def every_alignment(q, r):
    if not q and not r:
        yield "", ""
    if q and r:
        yield from ((q[0] + a, r[0] + b) for a, b in every_alignment(q[1:], r[1:]))
    if r:
        yield from (("-" + a, r[0] + b) for a, b in every_alignment(q, r[1:]))
    if q:
        yield from ((q[0] + a, "-" + b) for a, b in every_alignment(q[1:], r))


@pytest.mark.parametrize("seed", range(8))
def test_alignment_is_the_best(seed):
    r = random.Random(seed)
    q, t = ("".join(r.choice("AC") for _ in range(r.randint(0, 5))) for _ in range(2))
    for s in (alignment.GLOBAL_AA, alignment.LOCAL_NT):
        got = alignment.align(q, t, s)
        assert got.score == pytest.approx(max(score_of(a, b, s) for a, b in every_alignment(q, t))) == pytest.approx(score_of(got.query, got.ref, s))
        assert got.query.replace("-", "") == q and got.ref.replace("-", "") == t
        local = alignment.align(q, t, s, local=True)
        parts = [score_of(a, b, s) for i in range(len(q) + 1) for j in range(i, len(q) + 1) for k in range(len(t) + 1) for m in range(k, len(t) + 1) for a, b in every_alignment(q[i:j], t[k:m])]
        assert local.score == pytest.approx(max(0, *parts))
        if local.score:
            assert q[local.query_start - 1 : local.query_end] == local.query.replace("-", "") and score_of(local.query, local.ref, s) == pytest.approx(local.score)


def test_extract_and_project(spark):
    df = spark.createDataFrame([("MK-LAV", "MKQL-V", 3)], "q string, r string, s int")
    got = df.select(alignment.anchored(F.col("q"), F.col("r"), F.col("s")).alias("x"), alignment.projected(F.col("q"), F.col("r"), F.col("s"), F.lit(9)).alias("p")).first()
    assert tuple(got["x"]) == (3, 7, "MKLV") and got["p"] == "--MK-LV--"
    assert alignment.residues_to_codons("M-K", "ATGAAA") == "ATG---AAA"
    assert alignment.paint(6, [2], ["AC-D"], ["AKQ-"]) == "XAKXXX"


def test_frameshift():
    got = alignment.frameshift("MKL", "ccATGAAATTAcc".upper())
    assert (got["aa"], got["events"], got["nt_start"], got["nt_end"]) == ("MKL", 0, 2, 11)
    shifted = alignment.frameshift("MKLV", "ATGAAAGTTAGTG")
    assert shifted["aa"] == "MKLV" and shifted["events"] == 1
    assert alignment.frameshift("MKW", "ATGAAA")["events"] == 1


def test_quality(spark):
    gene = genes.GENES["NS5A"]
    df = spark.createDataFrame([("ACDE", 1, 4), ("ACDE", 1, 9), ("", 1, 4), ("AC", None, 4), ("KKKE", 1, 4)], "aa string, s int, e int")
    got = [r["q"]["status"] for r in df.select(alignment.quality(F.col("aa"), F.col("s"), F.col("e"), F.lit("ACDEF"), gene).alias("q")).collect()]
    assert got == ["PASS", "FLAGGED", "NO_AA_SEQUENCE", "MISSING_AA_COORDINATES", "HIGH_DIVERGENCE"]


def test_best_reference(spark):
    q = spark.createDataFrame([("a", "1", "ACGTACGT"), ("b", "2", "TTTT")], "accession string, gt string, seq string")
    refs = spark.createDataFrame([("1", 1, "x", "ACGT"), ("1", 2, "y", "ACGTACGT"), ("2", 1, "z", "TTTT"), ("2", 2, "w", "TTTT")], "gt string, ref_ordinal int, ref_name string, ref_seq string")
    assert {r["accession"]: r["ref_name"] for r in alignment.best_reference(q, refs, ["gt"], "accession").collect()} == {"a": "y", "b": "z"}
