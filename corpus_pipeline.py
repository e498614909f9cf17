"""From raw documents to token files: five stages, each one operator of ``cladeframe.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the columns
of ``docs``.

Cases: an empty table passes through all stages; null texts have no language and go; a
null source is a source of its own; rows without an id pass all stages but are never
named by others; of rows of one id one stays; extra columns stay, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import decontaminate, jaccard, language, mixing, shared, tokens

#: Bytes of an Arrow batch, where the session has no bound of its own: a batch is held by the JVM and by Python.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def _bounded(spark: SparkSession) -> None:
    """Stages are run after they return, so the bound stays with the session."""
    for key, (default, own) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language (no letters, or a score like that of noise: rejected)."""
    _bounded(spark)
    return language.keep_identified(docs, open_set=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8 those of the smallest id; one row an id.

    Rows without an id are compared like all others: a copy of a document with an id goes.
    """
    _bounded(spark)
    return jaccard.representatives(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; those without an id are told apart by their texts."""
    _bounded(spark)
    key = shared.fresh(docs, "row_key")
    keyed = docs.withColumn(key, jaccard.row_key(docs["doc_id"], docs["text"].cast("string")))
    found = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return shared.without(keyed, found.select("doc_id"), key).drop(key)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn and share 150% of all words."""

    def targets(sizes: dict[str, int]) -> dict[str, float]:
        return mixing.capped_shares(sizes, mixing.cycle_weights(list(sizes), (5, 2, 1)), 1.5 * sum(sizes.values()), 2)

    _bounded(spark)
    return mixing.repeated(docs, F.array(mixing.source_key(F.col("source"))), targets)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of id; returns where each document's ids are."""
    _bounded(spark)
    path = shared.new_path(spark, "tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokens.token_index(spark, path)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mixing", source_mixing), ("token_output", token_output)]

#: The kernel classifier, the seeded mix and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stored(docs, name)
    return docs
