from pyspark.sql import functions as F

from cladeframe.operators import selection
from cladeframe.plans import rules


def test_rules_as_data(spark):
    assert {g: rules.rules(spark, g).count() for g in rules.RULES} == {"NS3": 19, "NS5A": 13, "NS5B": 7} and len(rules.BLOCKED) == 19
    assert {r["op"] for g in rules.RULES for r in rules.rules(spark, g).collect()} <= set(selection.RULES)
    rows = spark.createDataFrame([("891", "x Ha07", "A"), ("891", "x Ha99", "B"), ("1051", "51a", "C"), ("1051", "52a", "D"), ("2116", "", "E"), ("5", "any", "F")], "ref_id string, source_isolate string, Accession string")
    kept = selection.apply_rules(rows, rules.rules(spark, "NS5B"), ["source_isolate", "Accession"], accession="Accession")
    assert sorted(r["Accession"] for r in kept.collect()) == ["A", "C", "E", "F"]


def test_signatures(spark):
    own = rules.signatures(spark)
    assert own.count() == 24
    got = own.filter("gt = '8' and gene = 'NS3'").select(rules.signature_matches(F.lit("SPIxxVVA"), F.col("begin"), F.col("end")).alias("s")).first()["s"]
    assert (got["matches"], got["mismatches"]) == (1, 1)


def test_summary(spark):
    checked = spark.createDataFrame([("30",), ("7",)], "ref_id string")
    got = {r["ref_id"]: (r["filter_text"], r["included"]) for r in rules.summary(checked, rules.rules(spark, "NS3"), spark.createDataFrame([("30",)], "ref_id string")).collect()}
    assert got == {"30": ("source_isolate contains Day1", "Present"), "7": ("", "Absent")}
