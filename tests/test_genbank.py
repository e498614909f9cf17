"""GenBank files by byte ranges, against the files' own bytes."""

import random

import pytest

from cladeframe.sources import files, genbank


def split(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of the records, by reading line after line."""
    out, start, at = [], 0, 0
    for line in raw.splitlines(keepends=True) if b"\r" not in raw.replace(b"\r\n", b"") else [x + b"\n" for x in raw.split(b"\n")]:
        at = min(at + len(line), len(raw))
        if line.rstrip(b"\r\n") == b"//":
            out.append((start, at))
            start = at
    if raw[start:].strip():
        out.append((start, len(raw)))
    return [(a, b) for a, b in out if raw[a:b].strip()]


def record(r, k, end):
    lines = [f"LOCUS       AC{k}", f"ACCESSION   AC{k}", f"VERSION     AC{k}.1", *("é" * r.randrange(20) + " // inside" for _ in range(r.randrange(6))), "  //", "// ", "ORIGIN", "        1 acgt"]
    return end.join(lines) + end + "//" + end


@pytest.mark.parametrize("size", ["60b", "1000b", "128m"])
def test_records_are_the_bytes_at_their_offsets(spark, tmp_path, size):
    r = random.Random(4)
    texts = {"unix.gb": "".join(record(r, k, "\n") for k in range(30)), "dos.gbk": "".join(record(r, 100 + k, "\r\n") for k in range(20)), "open.gb": record(r, 200, "\n") + "LOCUS       AC201\nACCESSION   AC201", "blank.gb": record(r, 300, "\n") + "\n  \n", "none.gb": "", "one.gb": "ACCESSION   AC400\n//"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = genbank.read_records(spark, str(tmp_path), files.GENBANK_ENDINGS).collect()
        rows = genbank.as_text(genbank.read_records(spark, str(tmp_path / "dos.gbk"))).select("record", "raw").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in texts.items():
        raw = text.encode()
        own = sorted((x for x in found if x["path"].endswith("/" + name)), key=lambda x: x["ordinal"])
        assert [(x["start_byte"], x["end_byte"]) for x in own] == split(raw), name
        assert all(bytes(x["raw"]) == raw[x["start_byte"] : x["end_byte"]] for x in own)
        assert [x["ordinal"] for x in own] == list(range(len(own)))
    assert len(rows) == 20 and all("\r" not in x["record"] and x["record"].endswith("acgt\n") for x in rows)


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    r = random.Random(5)
    (tmp_path / "big.gb").write_text("".join(record(r, k, "\n") for k in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    try:
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "big.gb"))
        assert lines.rdd.getNumPartitions() > 3
        assert genbank.read_records(spark, str(tmp_path / "big.gb")).count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bundles(spark, tmp_path):
    r = random.Random(6)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gb").write_text("".join(record(r, k, "\n") for k in range(12)))
    (tmp_path / "in" / "b.gb").write_text("".join(record(r, k, "\r\n") for k in range(10, 16)) + "ACCESSION   AC90")
    records = genbank.read_records(spark, str(tmp_path / "in"))
    raw = {p: (tmp_path / "in" / p).read_bytes() for p in ("a.gb", "b.gb")}
    last = {x["name"]: x for x in genbank.record_index(records).collect()}
    assert last["AC11"]["path"].endswith("b.gb") and last["AC9"]["path"].endswith("a.gb") and {"AC3", "AC3.1"} <= set(last)
    asked = [("1", f"AC{k}") for k in range(12)] + [("1", "AC2.1"), ("2", "AC14.7"), ("2", "AC90"), ("2", "nobody"), ("3", None), ("4", "nobody")]
    wanted = spark.createDataFrame(asked, "study string, accession string")
    index = genbank.write_bundles(records, wanted, str(tmp_path / "out"), piece_bytes=500).collect()
    found = {(x["study"], x["accession"]): x["found"] for x in index}
    assert found == {(s, a): a != "nobody" for s, a in asked if a}
    assert len({x["piece"] for x in index if x["study"] == "1"}) > 2
    texts = {(x["study"], x["accession"]): x["record"] for x in genbank.read_bundles(spark, str(tmp_path / "out")).collect()}
    assert set(texts) == {k for k, v in found.items() if v}
    for (_, accession), text in texts.items():
        at = last.get(accession) or last[accession.split(".")[0]]
        name = at["path"].rsplit("/", 1)[1]
        assert text.encode().rstrip(b"\n") == raw[name][at["start_byte"] : at["end_byte"]].rstrip(b"\n")
    sources = {x["path"].rsplit("/", 1)[1]: x["records"] for x in spark.read.parquet(str(tmp_path / "out" / "sources")).collect()}
    assert sources == {"a.gb": 10, "b.gb": 7}  # records 10 and 11 of a.gb are superseded


def test_offsets_in_parsed_records(spark, tmp_path):
    (tmp_path / "x.gb").write_bytes(b"ACCESSION   A1\r\nORIGIN\r\n        1 ac\r\n//\r\nACCESSION   A2\r\nORIGIN\r\n        1 gt\r\n//\r\n")
    rows = files.parsed_genbank(files.read_genbank(spark, str(tmp_path / "x.gb"))).orderBy("ordinal").collect()
    assert [(x["accession"], x["sequence"], x["start_byte"]) for x in rows] == [("A1", "AC", 0), ("A2", "GT", 42)]
