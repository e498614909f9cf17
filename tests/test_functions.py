"""Column functions on hand-computed values."""

import pytest
from pyspark.sql import functions as F

from cladeframe import genes
from cladeframe.functions import labels as L
from cladeframe.functions import sequences as S


@pytest.fixture(scope="module")
def one(spark):
    def run(value, **inputs):
        row = spark.createDataFrame([tuple(inputs.values()) or (0,)], list(inputs) or ["x"]) if inputs else spark.range(1)
        return row.select(value.alias("v")).first()["v"]

    return run


def lit(x):
    return F.lit(x)


def test_codon_tables():
    assert len(genes.CODONS) == 64 and genes.CODONS["ATG"] == "M" and genes.CODONS["ACA"] == "T" and genes.CODONS["TGA"] == "*"
    wide = genes.iupac_codons()
    assert len(wide) == 15**3 and wide["CTN"] == "L" and wide["ATN"] == "X" and wide["TAR"] == "*"


def test_sequences(one):
    cases = [
        (S.translate(lit("ATGGCNTAAAC")), "MX*"), (S.translate_iupac(lit("ATGGCNTAA")), "MA*"), (S.translate_gapped(lit("ATG---A-G")), "M-X"), (S.translate(lit("AC")), ""), (S.translate(lit("")), ""),
        (S.reverse_complement(lit("ACGTRN")), "NYACGT"), (S.normalize_nt(lit("ac gu!z")), "ACGT"), (S.normalize_nt(lit("acu!"), mask=True), "ACTN"),
        (S.frame_shift(lit(1)), 0), (S.frame_shift(lit(2)), 2), (S.frame_shift(lit(3)), 1), (S.aa_window(lit("GATGGCC"), lit(3)), "MA"), (S.aa_window_start(lit(3)), 2), (S.aa_window_start(lit(4)), 2),
        (S.frames(lit("ATGGCC")), ["MA", "W", "G"]), (S.identity(lit("ACDE"), lit("ACXF")), pytest.approx(2 / 3)), (S.identity(lit("A"), lit("X")), None),
        (S.marker(lit("AC-E"), lit("AD-E")), "|. |"), (S.stop_positions(lit("AC--DE"), lit("A*X**E")), ["2", "2+ins1", "3"]), (S.insertions(lit("A--C"), lit("AKLC")), ["1+ins1:K", "1+ins2:L"]), (S.deletions(lit("ACDE"), lit("A-DE")), ["2:C"]),
        (S.wrap(lit("A" * 5), 2), "AA\nAA\nA"), (S.wrap(lit("AAAA"), 2), "AA\nAA"), (S.residue_at(lit("ABC"), lit(5), lit(6)), "B"), (S.residue_at(lit("ABC"), lit(5), lit(8)), None), (S.base_at(lit("ACNT"), lit(2), lit(6)), "-"),
        (S.is_nucleotide(lit("ACGN")), True), (S.is_nucleotide(lit("ACGL")), False), (S.flank_slice(lit("A" * 100), lit(0), lit(10), lit(12), 3), "A" * 15),
    ]
    for k, (value, want) in enumerate(cases):
        assert one(value) == want, k


def test_labels(one):
    cases = [
        (L.accession_of(lit("AB1.2 rest")), "AB1.2"), (L.versionless(lit("AB1.2")), "AB1"), (L.ref_id(lit("12_Name.fa")), "12"), (L.ref_id(lit("12a_Name"), "digits"), "12"), (L.ref_id(lit("none"), "strict"), ""),
        (L.sanitize(lit("..a b/c_")), "a_b_c"), (L.sanitize(lit("//")), "job"), (L.number(lit(" 3.5 ")), 3.5), (L.number(lit("x")), None), (L.first_year(lit("12-Mar-2009")), 2009), (L.first_year(lit("12009")), None),
        (L.bounded_token(lit("ID Ha07-x"), "Ha[0-9]{2}"), True), (L.bounded_token(lit("IDHa07"), "Ha[0-9]{2}"), False), (L.subtype(lit("B"), lit("1")), "1b"), (L.subtype(lit("3A"), lit("1")), "3a"),
        (L.clone_key(lit("P1_x_c2")), "P1_x"), (L.clone_key(lit("P1")), "P1"), (L.isolate_key(lit("pat 3 - Week 4")), "pat 3"), (L.effective_isolate(lit("iso P7x"), lit("a\nPatient Code ::  P7 \nb")), "P7"),
        (L.without_clone_suffix(lit("pat1-clone12")), "pat1"), (L.without_clone_suffix(lit("pat1_qs3")), "pat1"), (L.without_clone_suffix(lit("pat1")), "pat1"), (L.normalize_text(lit(" A-b, C! ")), "a b c"),
        (L.organism_name(lit(""), lit(None), lit("Hepacivirus hominis x")), "Hepacivirus hominis"), (L.sentences(lit("A b. C?  D")), ["A b.", "C?", "D"]), (L.json_block(lit("x ```json\n[1]\n``` y")), "[1]"), (L.json_block(lit("so {\"a\": 1} ok")), '{"a": 1}'),
        (L.positions(lit("24, ,26,x")), [24, 26]), (L.first_filled(F.array(lit(""), lit(None), lit("7"))), "7"), (L.reference_name(lit("HCV3NS5A"), "NS5A"), "3"), (L.genotype_name(lit("Genotype 1A")), "1a"), (L.label_genotype(lit("GT12_a")), "12"), (L.label_total(lit("GT1 (30, 2-4)")), 30),
        (L.format_percent(lit(12.5)), "12"), (L.format_percent(lit(13.5)), "14"), (L.format_percent(lit(2.25)), "2.2"), (L.format_percent(lit(0.26)), "0.3"), (L.format_percent(lit(0.0)), "0"), (L.round_significant(lit(0.12345)), pytest.approx(0.12)), (L.round_significant(lit(0.0)), 0.0),
        (L.cell_variants(lit("A80K12.5*3")), ["A80", "K12.5", "*3"]), (L.distinct_queries([lit("a"), lit(""), lit("a"), lit("b")]), ["a", "b"]),
    ]
    for k, (value, want) in enumerate(cases):
        assert one(value) == want, k


@pytest.mark.parametrize(
    ("text", "want"),
    [("Genotype: 1a", ("1", "1a")), ("genotype 3; subtype b", ("3", "3b")), ("subtype 2c", ("2", "2c")), ("HCV-1b isolate", ("1", "1b")), ("4D", ("4", "4d")), ("recombinant of genotype 1", None), ("nothing", None), ("", None), (None, None), ("genotype 6", ("6", ""))],
)
def test_genotype_subtype(one, text, want):
    got = one(L.genotype_subtype(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == want


def test_structured_comment(one):
    record = "COMMENT     ##Assembly-Data-START##\n            Method :: x\n            Depth :: 3\n            ##Assembly-Data-END##\n"
    assert one(L.structured_comment(F.lit(record))) == "Method :: x\nDepth :: 3"
