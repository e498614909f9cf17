"""Reference distances, look-up chains, label groups, exported references and migrated tables on small fixtures."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from cladeframe import genes
from cladeframe.operators import alignment, distance, grouping, reports
from cladeframe.plans import rules
from cladeframe.sources import files


@pytest.mark.parametrize("gene", ["NS3", "NS5A"])
def test_aligned_reference_distance(spark, gene):
    """Against a loop over each pair's alignment: changes, insertions, deletions and places without a residue."""
    r = random.Random(len(gene))
    positions, scores = [1, 4, 9, 15, 22, 30], distance.reference_scores(gene)
    refs, cells, want = [], [], {}
    for k in range(24):
        ref = "".join(r.choice(genes.VALID_AA) for _ in range(30))
        text = [x if r.random() > 0.15 else r.choice(genes.VALID_AA + "*") for x in ref]
        if k % 3 == 0:
            del text[10:12]
        if k % 4 == 0:
            text[18:18] = list("WWW")
        own = {p + 1: x for p, x in enumerate(text) if r.random() > 0.1}
        cells += [(f"s{k}", p, x.lower() if k % 2 else x) for p, x in own.items()]
        if k % 8 == 7:
            want[f"s{k}"] = (None, None, None, None, None, "reference_not_found")
            continue
        refs += [(f"s{k}", f"R{k}", ref, 1), (f"s{k}", "later", ref[::-1], 2)]
        al = alignment.align("".join(own.get(p, "X") for p in range(1, 31)), ref, scores)
        at, pairs = 0, []
        for x, y in zip(al.ref, al.query, strict=True):
            at += x != "-"
            if x != "-" and at in positions and x in genes.VALID_AA and y in genes.VALID_AA:
                pairs.append((at, x, y))
        differ = [f"{p}:{x}>{y}" for p, x, y in pairs if x != y]
        want[f"s{k}"] = (f"R{k}", len(pairs), len(differ), ";".join(differ), len(differ) / len(pairs) if pairs else None, "ok" if pairs else "no_comparable_positions")
    found = distance.aligned_reference_distance(spark.createDataFrame(cells, "subtype string, pos int, aa string"), spark.createDataFrame(refs, "subtype string, accession string, seq string, ordinal int"), positions, scores)
    assert {x["subtype"]: tuple(x)[1:] for x in found.collect()} == want


def test_aligned_reference_distance_without_places(spark):
    cells = spark.createDataFrame([("a", 1, "X"), ("a", 2, "-"), ("b", 1, "A")], "subtype string, pos int, aa string")
    refs = spark.createDataFrame([("a", "R", "AC", 1), ("b", "E", "", 1)], "subtype string, accession string, seq string, ordinal int")
    got = {x["subtype"]: tuple(x)[1:] for x in distance.aligned_reference_distance(cells, refs, [1, 2]).collect()}
    assert got == {"a": ("R", 0, 0, "", None, "no_comparable_positions"), "b": ("E", 0, 0, "", None, "no_comparable_positions")}
    assert distance.aligned_reference_distance(cells.limit(0), refs, [1]).count() == 0


def test_reference_steps(spark):
    refs = spark.createDataFrame([("A", "1", "11"), ("A", "2", " "), ("A", "3", None), ("B", "1", "9"), ("C", "1", None)], "accession string, reference string, pubmed string")
    searched = spark.createDataFrame([("A", "1", "99", None, 0), ("A", "2", "22", "", 1), ("A", "2", "23", "", 2), ("A", "3", "33", "timeout", 0), ("C", None, "5", None, 0)], "accession string, reference string, pmid string, error string, ordinal int")
    crossref = spark.createDataFrame([("A", "2", "10/x", None, 0), ("B", "1", "", None, 0), ("C", "1", "10/c", "timeout", 0)], "accession string, reference string, doi string, error string, ordinal int")
    web = spark.createDataFrame([("A", "1", "77", "10/w1", 0), ("A", "2", "78", "10/w2", 0), ("A", "3", "old", "old", 0), ("A", "3", "79", None, 1), ("B", "1", "80", "10/b", 0)], "accession string, reference string, pmid string, doi string, ordinal int")
    fields = ("pubmed", "pmid_source", "crossref_doi", "web_doi", "kept", "search", "doi_search", "web_search")

    def told(rows):
        return {(x["accession"], x["reference"]): tuple(x[f] for f in fields) for x in rows.collect()}

    assert told(reports.reference_steps(refs, searched, crossref, web)) == {
        ("A", "1"): ("11", "genbank", None, "10/w1", "kept_existing_pubmed", None, "no_match", "completed"),
        ("A", "2"): ("22", "pubmed_esearch", "10/x", None, "missing_pubmed", "matched", "matched", "completed"),
        ("A", "3"): ("79", "openai_web_search", None, None, "missing_pubmed", "error", "no_match", "completed"),
        ("B", "1"): ("9", "genbank", None, None, "kept_existing_pubmed", None, "no_match", "skipped"),
        ("C", "1"): (None, None, None, None, "missing_pubmed", "no_match", "error", "completed"),
    }
    assert told(reports.reference_steps(refs, searched, crossref))["A", "3"] == (None, None, None, None, "missing_pubmed", "error", "no_match", "skipped")


def test_labels(spark):
    rows = spark.createDataFrame([("1_1a_x",), ("plain",), ("_y",), (None,)], "label string")
    assert sorted((x["genotype"], x["name"]) for x in grouping.by_genotype(rows).collect()) == [("", "y"), ("1", "1a_x")]
    named = spark.createDataFrame([("GT1_1a", "ACDEF"), ("GT1_1b_c", "AC"), ("bad", "")], "header string, seq string")
    assert sorted(tuple(x) for x in reports.boundaries(named, "NS3").collect()) == [("NS3", "1a", "ACD", "DEF"), ("NS3", "1b_c", "AC", "AC")]
    with pytest.raises(PySparkException, match="no subtype in header: bad"):
        reports.boundaries(spark.createDataFrame([("bad", "A")], "header string, seq string"), "NS3").collect()


def test_exported_references(spark, tmp_path):
    ref = lambda strain, gene, seq: {"name": "n", "strain": strain, "abstractGene": gene, "refSequence": seq}
    rows = [ref("HCV2", "NS5B", "aa"), ref(" HCV1 ", "NS5A_NTD", " cc "), ref("HCV1", "NS3", ""), ref("HCV1", "NS3", "dd"), ref("HCV1", "NS3", "later"), ref("HCV1a", "NS3", "x"), ref("1", "NS3", "x"), ref("HCV1", "core", "x"), ref(None, None, None), ref("HCV10", "NS3", "ee")]
    (tmp_path / "refs.json").write_text(json.dumps(rows))
    found = files.exported_references(spark, str(tmp_path / "refs.json"), ["NS3", "NS5A_NTD", "NS5B"], {"NS5A_NTD": "NS5A"}).orderBy("genotype", "place")
    assert [(x["header"], x["seq"]) for x in found.collect()] == [("genotype 1 | NS3", "DD"), ("genotype 1 | NS5A", "CC"), ("genotype 2 | NS5B", "AA"), ("genotype 10 | NS3", "EE")]


def test_migrated(spark, tmp_path):
    old, new = tmp_path / "index.tsv", tmp_path / "index.csv"
    old.write_text('a\tb, c\n x \t"say ""no"""\n\t1,2\n')
    assert files.migrated(spark, {str(old): str(new), str(tmp_path / "none.tsv"): str(tmp_path / "none.csv")}) == [str(new)]
    assert not old.exists()
    got = spark.read.csv(str(new), header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert got.columns == ["a", "b, c"] and sorted(tuple(x) for x in got.na.fill("").collect()) == [("", "1,2"), (" x ", 'say "no"')]
    assert files.migrated(spark, {str(old): str(new)}) == []


def test_rule_table(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("RefID,Field,Operator,Value\n7,source_isolate,CONTAINS, Day 1 \n,x,equals,y\n8,,equals,y\n")
    assert [tuple(x) for x in rules.read_rules(spark, str(tmp_path / "rules.csv")).collect()] == [("7", "source_isolate", "contains", "Day 1")]


def test_empty_files_are_errors(spark, tmp_path):
    (tmp_path / "1.fasta").write_text(">a\nAC\n")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".part.crc").write_text("")
    assert files.read_fasta(spark, str(tmp_path), filled=True).count() == 1
    (tmp_path / "2.fasta").write_text("")
    with pytest.raises(ValueError, match="no record in"):
        files.read_fasta(spark, str(tmp_path), filled=True)
