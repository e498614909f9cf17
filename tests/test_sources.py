import io
import zipfile

import pytest

from cladeframe.sources import files, workbooks


def test_fasta(spark, tmp_path):
    (tmp_path / "12_A.fasta").write_text("junk\n>X1.1 first one\nac gt\n\nNN\n>X2 b\r\nA-C*")
    (tmp_path / "13_B.fa").write_text(">X1.1 again\nTTT\n")
    (tmp_path / "note.txt").write_text(">no\nA\n")
    got = sorted((r["ref_id"], r["ordinal"], r["header"], r["accession"], r["seq"]) for r in files.read_fasta(spark, str(tmp_path), endings=files.FASTA_ENDINGS).collect())
    assert got == [("12", 0, "X1.1 first one", "X1.1", "ACGTNN"), ("12", 1, "X2 b", "X2", "A-C*"), ("13", 0, "X1.1 again", "X1.1", "TTT")]
    own = {r["accession"]: (r["ref_ids"], len(r["files"])) for r in files.accession_files(files.read_fasta(spark, str(tmp_path), endings=("fasta", "fa"))).collect()}
    assert own == {"X1.1": (["12", "13"], 2), "X2": (["12"], 1)}
    raw = files.read_fasta(spark, str(tmp_path / "12_A.fasta"), upper=False, raw=True).orderBy("ordinal").first()
    assert raw["seq"] == "acgtNN" and raw["body"] == "ac gt\n\nNN\n"
    files.write_fasta(files.read_fasta(spark, str(tmp_path / "12_A.fasta")), str(tmp_path / "out"), width=4, order=["ordinal"])
    back = files.read_fasta(spark, str(tmp_path / "out")).count()
    assert back == 2


RECORD = """LOCUS       AB123456                  12 bp    RNA     linear   VRL 01-JAN-2010
DEFINITION  Some virus gene,
            complete cds.
ACCESSION   AB123456 AB999999
VERSION     AB123456.2
SOURCE      Some virus
  ORGANISM  Some virus sp
            Viruses; Other.
REFERENCE   1  (bases 1 to 12)
  AUTHORS   Doe,J. and
            Roe,R.
  TITLE     A title
  JOURNAL   J. X 1, 2 (2010)
   PUBMED   12345
REFERENCE   2  (bases 1 to 12)
  AUTHORS   Poe,E.
  TITLE     Direct Submission
COMMENT     ##Data-START##
            Patient Code :: P7
            ##Data-END##
FEATURES             Location/Qualifiers
     source          1..12
                     /organism="Some virus"
                     /isolate="iso 1"
                     /note="genotype: 1a"
                     /note="second
                     line"
     gene            1..12
                     /gene="x"
ORIGIN
        1 acgtacgtac gt
//
LOCUS       CD1
ACCESSION   CD1
ORIGIN
        1 aa
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(RECORD)
    rows = files.parsed_genbank(files.read_genbank(spark, str(tmp_path / "a.gb"))).orderBy("ordinal").collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r["accession"], r["version"], r["definition"], r["organism"], r["sequence"], r["location"]) == ("AB123456", "AB123456.2", "Some virus gene, complete cds.", "Some virus sp", "ACGTACGTACGT", "1..12")
    assert r["qualifiers"] == {"organism": ["Some virus"], "isolate": ["iso 1"], "note": ["genotype: 1a", "second line"]}
    assert [(x["authors"], x["title"], x["pubmed"]) for x in r["references"]] == [("Doe,J. and Roe,R.", "A title", "12345"), ("Poe,E.", "Direct Submission", "")]
    assert "Patient Code :: P7" in r["structured_comment"] and rows[1]["accession"] == "CD1" and rows[1]["start_byte"] == RECORD.index("LOCUS       CD1")
    names = files.read_genbank(spark, str(tmp_path / "a.gb")).select(files.raw_accessions(files.F.col("record")).alias("n")).first()["n"]
    assert names == ["AB123456", "AB999999", "AB123456.2"]


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿RefID,Note\n1,\" a, \"\"b\"\" \"\n2,\n")
    got = files.read_table(spark, str(tmp_path / "t.csv"), ["RefID"]).orderBy("RefID").collect()
    assert [(r["RefID"], r["Note"]) for r in got] == [("1", 'a, "b"'), ("2", "")]
    with pytest.raises(ValueError, match="Missing|missing"):
        files.read_table(spark, str(tmp_path / "t.csv"), ["Nope"])


def test_references(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"genotypeName": "Genotype 1a", "accession": "A", "sequence": "acgu", "firstNA": 2}, {"genotypeName": "other"}]')
    (tmp_path / "g.json").write_text('[{"name": "HCV1NS3", "refSequence": "ac"}, {"name": "HCV1NS5B", "refSequence": "x"}]')
    assert [tuple(r) for r in files.read_subtype_references(spark, str(tmp_path / "s.json")).collect()] == [("1", "1a", "A", "ACGT", 2)]
    assert [tuple(r) for r in files.read_genotype_references(spark, str(tmp_path / "g.json"), "NS3").collect()] == [("1", "AC")]


def test_settings():
    text = '[common]\na = "1"\nb = "2"\n[ns3]\nb = "3"\n'
    assert files.read_settings(text, "ns3", {"a": "9", "b": "", "c": "x"}) == {"a": "9", "b": "3"}


def test_workbooks(spark, tmp_path):
    raw = workbooks.workbook_bytes({"GT1": (["Pos", "AA"], [[1, "A<&"], [2, None]]), "GT 2": (["Pos"], [[3.5]])})
    (tmp_path / "w.xlsx").write_bytes(raw)
    got = sorted((r["sheet"], r["ordinal"], r["cells"]) for r in workbooks.read_workbook(spark, str(tmp_path / "w.xlsx")).collect())
    assert got == [("GT 2", 0, {"Pos": "3.5"}), ("GT1", 0, {"Pos": "1", "AA": "A<&"}), ("GT1", 1, {"Pos": "2", "AA": ""})]


def test_documents(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t><w:br w:type="page"/></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(out.getvalue())
    assert [(r["page"], r["text"]) for r in workbooks.read_documents(spark, str(tmp_path / "d.docx")).orderBy("page").collect()] == [(1, "One"), (2, "Two")]


def test_conditions_of_fasta(spark, tmp_path):
    (tmp_path / "1_a.fa").write_text(">X1 NS3 gene\nac\n>X2 other\ngt\n")
    (tmp_path / "2_b.fa").write_text(">X1 ns3\nac\n")
    (tmp_path / "3_c.fa").write_text("")
    one, two, none = (str(tmp_path / x) for x in ("1_a.fa", "2_b.fa", "3_c.fa"))
    assert files.read_fasta(spark, one, filled=True, unique=True, upper=False).count() == 2
    assert files.read_fasta(spark, [one, none]).count() == 2
    assert [(r["ordinal"], r["accession"]) for r in files.read_fasta(spark, one, containing="ns3").collect()] == [(0, "X1")]
    for kind, paths in (({"filled": True}, [one, none]), ({"unique": True}, [one, two]), ({"containing": "NS5B"}, [one]), ({"containing": "other"}, [one, two])):
        with pytest.raises(Exception, match=r"no record in|occurs more than once: X1|no header contains"):
            files.read_fasta(spark, paths, **kind).collect()


def test_cached_stages(spark, tmp_path):
    from cladeframe import workdir

    source, path, made = tmp_path / "in.txt", str(tmp_path / "stage"), []

    def ask(rerun=False, **settings):
        def make():
            return spark.read.text(str(source)).selectExpr("upper(value) AS value", f"{len(settings)} AS n")

        before = {p.name for p in (tmp_path / "stage").glob("*")} if (tmp_path / "stage").exists() else set()
        rows = sorted(r["value"] for r in workdir.cached(spark, path, make, [str(source)], settings, rerun).collect())
        made.append(len({p.name for p in (tmp_path / "stage").glob("*")} - before))
        return rows

    source.write_text("a\nb\n")
    assert ask() == ask() == ["A", "B"] and made == [1, 0]
    source.write_text("a\nb\nc\n")
    assert ask() == ["A", "B", "C"] and made[-1] == 1
    assert ask(k=1) == ["A", "B", "C"] and made[-1] == 1 and ask(k=1) and made[-1] == 0
    broken = tmp_path / "stage" / "_writing-x"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert ask(k=2) == ["A", "B", "C"] and ask(rerun=True, k=2) == ["A", "B", "C"] and made[-1] == 0
