"""Gene extraction against planted genes and against all steps done one by one."""

import random

import pytest
from pyspark.sql import functions as F

from cladeframe import genes
from cladeframe.operators import alignment, extraction
from cladeframe.plans import gene

SENSE = sorted(c for c, a in genes.CODONS.items() if a != "*")


residues = extraction.residues


def one_by_one(seq, ref, preferred):
    al = alignment.align("".join(b if b in "ACGT" else "N" for b in seq), ref, extraction.WINDOW, local=True)
    if al.score <= 0:
        return None
    start, end = max(0, al.query_start - al.ref_start - 30), min(len(seq), al.query_end + len(ref) - al.ref_end + 30)
    order = sorted(range(3), key=lambda k: (preferred is None or (start + k) % 3 != preferred, k))
    found = []
    for place, k in enumerate(order):
        nt = seq[start + k : end]
        nt = nt[: len(nt) // 3 * 3]
        if not nt:
            continue
        got = alignment.align(residues(nt), residues(ref))
        lead = len(got.ref) - len(got.ref.lstrip("-"))
        trail = len(got.ref) - len(got.ref.rstrip("-"))
        if got.ref.strip("-") and lead + trail and len(nt) // 3 > lead + trail:
            nt = nt[3 * lead : len(nt) - 3 * trail]
            got = alignment.align(residues(nt), residues(ref))
        said = [(a, b) for a, b in zip(got.ref, got.query) if a != "-" and b not in "X*-"]
        score = sum(a == b for a, b in said) / len(said) if said else 0.0
        found.append((-residues(nt).count("*"), score, len(said), -place, (start + k) % 3, nt))
    return max(found)


@pytest.fixture(scope="module")
def reads():
    r = random.Random(4)
    ref = "".join(r.choices(SENSE, k=40))
    bases = lambda n: "".join(r.choices("ACGT", k=n))
    changed = "".join(b if r.random() > 0.08 else r.choice("ACGT") for b in ref)
    whole = [bases(k) + g + bases(45) for k, g in ((0, ref), (31, ref), (50, changed), (61, changed[30:]), (7, changed[:80]))]
    return ref, [*whole, bases(41) + ref[:50] + "A" + ref[50:] + bases(33), whole[2].replace("A", "N", 3), "", "NNNN", None, ref[:7]]


def test_frames(spark, reads):
    ref, seqs = reads
    rows = [(i, s, ref, p) for i, s in enumerate(seqs) for p in (None, 0, 1, 2)]
    df = spark.createDataFrame(rows, "i int, seq string, ref string, own int")
    for r in df.withColumn("gene", extraction.extracted(F.col("seq"), F.col("ref"), F.col("own"))).collect():
        want = one_by_one(r["seq"] or "", ref, r["own"])
        if want is None:
            assert r["gene"]["nt"] is None and r["gene"]["frame"] is None
        else:
            assert (r["gene"]["frame"], r["gene"]["nt"]) == want[4:] and r["gene"]["score"] == pytest.approx(want[1])


def test_planted(reads):
    ref, seqs = reads
    got = [extraction.best_reading(extraction.readings(s or "", ref, refine=True)) for s in seqs]
    assert [g.nt for g in got[:2]] == [ref, ref] and [g.frame for g in got[:2]] == [0, 1]
    assert got[1].aligned_ref_nt == got[1].aligned_query_nt == ref
    # An inserted base shifts the frame: only the refined reading has both halves.
    assert got[5].aa[:16] == residues(ref)[:16] and got[5].aa[-20:] == residues(ref)[-20:]
    assert got[7:10] == [None] * 3


def test_order_of_choice():
    one = extraction.codon_aligned("ATGAAACTG", "ATGAAACTG", 0, "MKL", "L")
    assert (one.signatures, one.score, one.stops) == (2, 1.0, 0)
    other = extraction.codon_aligned("ATGAAACTG", "ATGAAACTG", 1, "QQ", "")
    stop = extraction.codon_aligned("ATGTAACTG", "ATGAAACTG", 2, "M", "L")
    assert extraction.best_reading([stop, other, one]) is one and extraction.best_reading([stop, other]) is other and extraction.best_reading([]) is None
    # Codons outside the reference go.
    assert extraction.codon_aligned("GGGATGAAACTGTGGTGTGCA", "ATGAAACTGTGGTGT", 0).nt == "ATGAAACTGTGGTGT"


def test_plan_without_hits(spark):
    """The proteins of whole sequences are the planted residues."""
    r = random.Random(9)
    ref = "".join(r.choices(SENSE, k=120))
    plan = gene.GenePlan("NS5A")
    assigned = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "accession string, gt string")
    records = spark.createDataFrame([("a", "GG" * 20 + ref + "CC" * 20), ("b", ref[90:]), ("c", "ACGT")], "accession string, seq string")
    refs = spark.createDataFrame([("1", ref, residues(ref)[:3], residues(ref)[-3:])], "gt string, seq string, begin string, end string")
    got = {x["accession"]: x for x in plan.extracted_proteins(assigned, records, refs).collect()}
    assert sorted(got) == ["a", "b"]
    assert (got["a"]["seq"], got["a"]["start"], got["a"]["end"]) == (residues(ref), 1, 120)
    assert (got["b"]["seq"], got["b"]["start"], got["b"]["end"]) == (residues(ref)[30:], 31, 120)
    assert got["a"]["quality"]["status"] == "PASS"
