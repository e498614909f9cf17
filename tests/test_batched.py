"""Programs over many sequences give what they give one by one; bundles' files are met once."""

import random

import pytest
from cladeframe import workdir
from cladeframe.operators import alignment
from cladeframe.sources import genbank
from pyspark.sql import functions as F


@pytest.mark.parametrize("options", [{}, {"may_delete": False}, {"free_start": False}, {"skips": (1, 2)}])
def test_frameshift_all(options):
    r = random.Random(8)
    pairs = [("".join(r.choice("ACDKM") for _ in range(r.randint(0, 6))), "".join(r.choice("ACGTN") for _ in range(r.randint(0, 24)))) for _ in range(300)]
    pairs += [("ACD", "GCTTGCGAT"), ("ACD", "GCTTTGCGAT"), ("ACD", ""), ("", "ACG"), ("ACD", "GCTTGCGAT"), ("ACD", "gcttgcgat"), ("ACD", "TAGTGCGAT")]
    assert alignment.frameshift_all(pairs, **options) == [alignment.frameshift(*p, **options) for p in pairs]


def test_bundles_meet_a_file_once(spark):
    path = workdir.new_path(spark, "in")
    spark.range(40).select(F.concat(F.lit("LOCUS C"), "id", F.lit("\nACCESSION   C"), "id", F.lit("\n//")).alias("value")).coalesce(1).write.text(path)
    wanted = spark.range(50).select((F.col("id") % 3).cast("string").alias("study"), F.concat(F.lit("C"), F.col("id").cast("string")).alias("accession"))
    out = workdir.new_path(spark, "bundles")
    genbank.write_bundles(genbank.read_records(spark, path), wanted, out, 200)
    found = genbank.read_bundles(spark, out)
    assert sorted((r["study"], r["accession"], r["record"]) for r in found.collect()) == sorted((str(k % 3), f"C{k}", f"LOCUS C{k}\nACCESSION   C{k}\n//\n") for k in range(40))
    # The join's rows are files, not records.
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()
