"""Pipeline over ``documents``: language, near duplicates, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, folder) and works on all rows that the stage before it
kept; all but the last return the columns of ``documents``. Rows may repeat, any column
may be null, further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import bpe, decontaminate, jaccard, language, secrets
from schemaloom.llm.arrow import ship, table
from schemaloom.session import materialize

#: A text is rejected if no language is at least this probable. It is low on purpose: only texts without words fall below it in the data.
LEAST_POSTERIOR = 0.3
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Stages hand whole texts to Python; small batches keep what a task holds of them low."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents without letters or in none of the learned languages; the model is fitted on the labelled ones.

    If no document has a label, nothing can be judged and all are kept.
    """
    ship(spark)
    small_batches(spark)
    model = language.fit(docs.select("text", "lang"))
    if not model.labels:
        return docs
    judged = docs.withColumn("__judged", language.prediction(spark, model, F.col("text")))
    kept = (F.col("__judged.lang") != language.UNKNOWN) & (F.col("__judged.score") >= LEAST_POSTERIOR)
    return judged.where(kept).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    ship(spark)
    return jaccard.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold a benchmark item, copied or with other values."""
    return decontaminate.remove_contaminated(docs, table(spark, folder, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows the text where it changes."""
    if "n_chars" not in docs.columns:
        return secrets.redact(docs)
    found = secrets.redact(docs.withColumn("__before", F.col("text")))
    changed = F.col("text") != F.col("__before")
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[f"`{c}`" for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    ship(spark)
    encoded = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", F.col("ids").alias("token_ids"), F.sha2("ids", 256).alias("ids_sha256"), "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode_tokens),
]

#: SQL cannot fit the language model or replay merges; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
