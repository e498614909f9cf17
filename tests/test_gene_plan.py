"""The whole plan on a made-up cohort whose answers are known by construction."""

import random

import pytest
from pyspark.sql import functions as F

from cladeframe import genes
from cladeframe.plans.gene import GenePlan, Options

AA_TO_CODON = {}
for codon, aa in genes.CODONS.items():
    AA_TO_CODON.setdefault(aa, codon)


@pytest.fixture(scope="module")
def cohort(spark):
    r = random.Random(5)
    refs = {g: "".join(r.choice(genes.VALID_AA) for _ in range(208)) + "KWWWW" for g in ("1", "2")}  # the end is unlike what precedes it
    rows, hit_rows = [], []
    for k in range(12):
        gt = "1" if k < 8 else "2"
        aa = list(refs[gt][9:209])
        if k % 4 == 0:
            aa[20 - 1] = "W"  # residue 29
        nt = "GG" + "".join(AA_TO_CODON[x] for x in aa)
        acc = f"S{k}.1"
        rows.append((str(k % 3), f"{k % 3}_x.fa", k, acc, acc, nt))
        hit_rows += [(acc, int(gt), 600, 30, 0, 900.0, 28, 627, k), (acc, 3, 600, 200, 5, 300.0, 28, 627, k)]
    fasta = spark.createDataFrame(rows, "ref_id string, path string, ordinal int, header string, accession string, seq string")
    hits = spark.createDataFrame(hit_rows, "query string, target int, length long, mismatch long, gaps long, bitscore double, sstart long, send long, ordinal long")
    references = spark.createDataFrame(list(refs.items()), "gt string, seq string")
    return fasta, hits, references, refs


def test_alignment_way(spark, cohort):
    fasta, gt_hits, references, refs = cohort
    plan = GenePlan("NS5A", options=Options(quality_gate=True))
    sheet = spark.createDataFrame([("0", "5"), ("1", "Exclude"), ("2", "7"), ("9", "Check")], "ref_id string, patients string")
    studies = plan.studies(sheet)
    assert {r["ref_id"] for r in studies.collect()} == {"0", "2"}
    metadata = spark.createDataFrame([("0", "S0.1", "genotype 1a"), ("0", "S3.1", ""), ("2", "S2.1", "x")], "ref_id string, accession string, source_note string")
    rules = spark.createDataFrame([("2", "source_note", "contains", "X")], "ref_id string, field string, op string, value string")
    records = plan.records(studies, fasta, metadata, rules, ["source_note"])
    assert sorted(r["accession"] for r in records.collect()) == ["S0.1", "S2.1", "S3.1", "S6.1", "S9.1"]
    everything = plan.genotypes(fasta, gt_hits, plan.labels(metadata))
    got = {r["accession"]: (r["gt"], r["source"], r["covered"]) for r in everything.collect()}
    assert got["S0.1"] == ("1", "metadata", list(plan.gene.positions)) and got["S9.1"][:2] == ("2", "alignment")
    sub_hits = spark.createDataFrame([(f"S{k}.1", f"{'1' if k < 8 else '2'}{s}", 600, 10 + k % 2 * (5 if s == "a" else -5), 0, 5.0, k) for k in range(12) for s in "ab"] + [("S0.1", "2c", 600, 0, 0, 9.0, 1)], "query string, target string, length long, mismatch long, gaps long, bitscore double, ordinal long")
    subs = plan.subtypes(everything, sub_hits, plan.labels(metadata))
    sub = {r["accession"]: (r["subtype"], r["next_subtype"], r["source"]) for r in subs.collect()}
    assert sub["S0.1"] == ("1a", "1b", "metadata") and sub["S1.1"] == ("1b", "1a", "alignment") and sub["S8.1"][0] == "2a"
    windows = fasta.select(F.col("accession").alias("query"), F.lit(3).alias("qstart"), F.length("seq").alias("qend"), F.lit(28).alias("sstart"))
    proteins = plan.proteins(subs, fasta, windows, references).cache()
    assert {(r["start"], r["end"], r["quality"]["status"]) for r in proteins.collect()} == {(10, 209, "PASS")}
    reports = plan.reports(plan.profile_rows(proteins))
    cons = {r["gt"]: r["consensus"] for r in reports["consensus"].collect()}
    assert cons["1"] == refs["1"][9:209] and cons["2"] == refs["2"][9:209]
    assert {r["gt"] for r in reports["sufficient"].collect()} == set() and reports["grid"].count() == 2
    bits = {(r["gt"], r["pos"]): r["entropy"] for r in reports["entropy"].collect()}
    assert bits["1", 29] == pytest.approx(0.81) and bits["1", 28] == 0.0
    assert {(r["a"], r["b"]) for r in reports["distance"].collect()} == {("1", "1"), ("1", "2"), ("2", "2")}
    assert all(0 <= r["distance"] <= 1 for r in reports["distance"].collect())
    by_sub = plan.reports(plan.profile_rows(proteins), ["gt", "subtype"])
    assert {(r["gt"], r["subtype"]) for r in by_sub["consensus"].collect()} == {("1", "1a"), ("1", "1b"), ("2", "2a"), ("2", "2b")}


def test_external_way(spark, cohort):
    fasta, *_ = cohort
    plan = GenePlan("NS5B", external=True)
    calls = spark.createDataFrame([("S0", "1a", 1), ("S1.1", "Unassigned", 2), ("S2.1", "1b", 3)], "accession string, subtype string, ordinal int")
    priority = spark.createDataFrame([("S2.1", "7a"), ("S4.1", "1d"), ("none", "1d")], "accession string, subtype string")
    got = {r["accession"]: (r["gt"], r["subtype"]) for r in plan.called(fasta, calls, priority).collect()}
    assert got == {"S0.1": ("1", "1a"), "S2.1": ("7", "7a"), "S4.1": ("1", "1d")}
    rows = spark.createDataFrame([("a", "A" * 200, 130), ("b", "A" * 100, 130), ("c", "A" * 20 + "X" + "A" * 200, 130)], "accession string, seq string, start int").withColumn("quality", F.struct(F.lit("PASS").alias("status")))
    assert [r["accession"] for r in plan.profile_rows(rows).collect()] == ["a"]


def test_staged_metadata(spark):
    """Reasons and counters against a loop over the rows."""
    from cladeframe.plans.gene import PRESENT, staged

    r = random.Random(17)
    rows = [(r.choice(["1", "2", "3", " 4 ", "", None]), r.choice(["A", "B", " C", "D", "", None]), r.choice(["yes", "Y ", "no", None, "present", "1"]), k) for k in range(120)]
    fasta = [("1", "1_a.fa", 0, "A x", "A", "AC"), ("1", "1_a.fa", 1, "B", "B", "GT"), ("1", "1_a.fa", 2, "A again", "A", "AA"), ("1", "1_b.fa", 0, "C", "C", "TT"), ("2", "2_a.fa", 0, "Z", "Z", "C"), ("4", "4_a.fa", 0, "D", "D", "G")]
    counts = dict.fromkeys(("skipped_no_gene", "skipped_missing_id", "skipped_duplicate"), 0)
    chosen = set()
    for study, name, flag, _ in rows:
        key = (study or "").strip(), (name or "").strip()
        if (flag or "").strip().lower() not in PRESENT:
            counts["skipped_no_gene"] += 1
        elif not all(key):
            counts["skipped_missing_id"] += 1
        elif key in chosen:
            counts["skipped_duplicate"] += 1
        else:
            chosen.add(key)
    first = {"1": "1_a.fa", "2": "2_a.fa", "4": "4_a.fa"}
    entries = [f for f in fasta if f[1] == first[f[0]] and (f[0], f[4]) in chosen]
    held = {(f[0], f[4]) for f in entries}
    counts |= {"selected_accessions": len(chosen), "selected_studies": len({s for s, _ in chosen}), "missing_fasta": sum(s not in first for s, _ in chosen), "missing_sequence": sum(s in first and (s, a) not in held for s, a in chosen), "staged_studies": len({f[0] for f in entries}), "staged_accessions": len(entries)}
    got = staged(spark.createDataFrame(rows, "ref_id string, accession string, NS3 string, ordinal int"), spark.createDataFrame(fasta, "ref_id string, path string, ordinal int, header string, accession string, seq string"), "NS3")
    assert got.counters.first().asDict() == counts
    assert sorted((x["ref_id"], x["ordinal"], x["header"]) for x in got.entries.collect()) == sorted((f[0], f[2], f[3]) for f in entries)
    assert {x["ref_id"]: (x["ref_name"], x["patients"], x["count"]) for x in got.seed.collect()} == {s: (f"metadata_{s}", n, n) for s in first if (n := sum(f[0] == s for f in entries))}


def test_numbered_and_report_head(spark):
    from cladeframe.operators import reports

    rows = spark.range(0, 5000).selectExpr("id", "cast(hash(id) as long) as k").repartition(7)
    got = {x["id"]: x["number"] for x in reports.numbered(rows, [F.col("k"), F.col("id")]).collect()}
    want = sorted((x["k"], x["id"]) for x in rows.collect())
    assert got == {i: n for n, (_, i) in enumerate(want, 1)}
    one = spark.createDataFrame([("c", "1", "ACDE", "AC-E", 3.0, "HCV1", 4)], "label string, gt string, ref string, query string, score double, reference string, number int")
    assert reports.consensus_report(one, "NS3").first()["text"].startswith("[4] gene=NS3 subtype_consensus=c genotype=GT1 reference=HCV1\nscore=3.000 identity=3/3")
