"""The thin queries ``opN_<name>`` over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import audit, jaccard, lm, resampling


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cladeframe.llm import shared, tokens

    path = shared.new_path(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokens.token_index(spark, path)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.stupid_backoff(_table(spark, sf_dir, "documents"), stable_scan=True)
    return scored.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.llm import decontaminate

    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.llm import licenses

    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("matches")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.llm import language

    docs = _table(spark, sf_dir, "documents")
    found = language.identify_language(docs, training=docs.filter(~language.held_out()))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.llm import mixing

    rows = mixing.sized(_table(spark, sf_dir, "documents"), F.array(mixing.source_key(F.col("source"))))
    patterns = mixing.pattern_sizes(rows)
    sizes = {s[0]: n for s, n in patterns}
    target = mixing.capped_shares(sizes, mixing.cycle_weights(list(sizes), (5, 2, 1)), 1.5 * sum(sizes.values()), 2)
    mixed = mixing.mix(rows, patterns, target, copies=2)
    sources = spark.createDataFrame([([s], sizes[s], target[s]) for s in sizes], "pattern array<string>, source_size long, target double")
    return mixed.join(F.broadcast(sources), "pattern").select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.llm import secrets

    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["kind"] != "random")
    return found.select("doc_id", of_kind("assign"), of_kind("access"), of_kind("hex"), F.sha2(secrets.rendered(base), 256).alias("base_sha256"), secrets.rendered(F.col("found")).alias("spans"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.llm import fingerprint

    return fingerprint.edit_probe(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.llm import suffixes

    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), stable_scan=True).drop("kept")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladeframe.llm import simhash

    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_fingerprint": op2_fingerprint,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_stupid_backoff": op9_stupid_backoff,
    "op10_license_scan": op10_license_scan,
    "op11_simhash": op11_simhash,
    "op12_filter_audit": op12_filter_audit,
    "op13_resampling": op13_resampling,
}
ORACLE_SQL: dict[str, str] = {"op8_jaccard_join": jaccard.ORACLE_SQL, "op9_stupid_backoff": lm.ORACLE_SQL, "op12_filter_audit": audit.ORACLE_SQL, "op13_resampling": resampling.ORACLE_SQL}
