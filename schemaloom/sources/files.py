"""Schema documents, question files, response logs, pools, catalogs and variant outputs on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.operators.augment import Catalog
from schemaloom.operators.catalog import DOCUMENT_SCHEMA, TABLE_SCHEMA
from schemaloom.operators.evaluate import pending
from schemaloom.operators.ordering import running_totals

QUESTION_SCHEMA = "db_id string, question string, query string"
RESPONSE_SCHEMA = (
    "index bigint, db_id string, sql_gold string, response struct<sql: string>, "
    "completion_tokens bigint, prompt_tokens bigint, total_tokens bigint, model string, provider string, "
    "level int, size int, filter string, "
    "duration_seconds double, filter_duration_seconds double, tables_included array<string>, "
    "execution_accuracy int"
)
#: A log line: number in its file, bytes of the record, CRC-32 of the record, record.
FRAME = r"(?s)^(\d+) (\d+) ([0-9a-f]{8}) (.*)$"


def read_schema_documents(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Nested schema documents; JSON lines, or one pretty-printed document per file."""
    return spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=one_per_file)


def write_schema_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def write_table_defs(defs: DataFrame, path: str) -> None:
    """Nested table rows as compressed JSON lines, one table per line; a database of any size is as many lines as it has tables."""
    defs.write.mode("overwrite").json(path, ignoreNullFields=False, compression="gzip")


def read_table_defs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMA).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON arrays with their position as ``idx``.

    A JSON array is one record to Spark, so a file is read as a whole; positions count on over
    the files in the order of their names, by the sizes of the files before. Larger sets belong in
    JSON lines with an explicit ``idx``, which is kept.
    """
    docs = spark.read.schema(f"idx bigint, {QUESTION_SCHEMA}").json(path, multiLine=True)
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    # A file lies in one partition, so its first number is its own start.
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start"))
    before = running_totals(sizes, [], [F.col("_file")], "_n", "_before")
    numbered = placed.join(before.drop("_n"), "_file").withColumn("idx", F.coalesce("idx", F.col("_before") + F.col("_at") - F.col("_start")))
    return numbered.select("idx", "db_id", "question", "query")


def question_databases(questions: DataFrame) -> DataFrame:
    return questions.select("db_id").distinct()


# --- response log -------------------------------------------------------------
def append_responses(responses: DataFrame, path: str) -> None:
    """Append framed records; every task writes a file of its own."""
    record = F.to_json(F.struct(*responses.columns))
    data = record.cast("binary")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.concat_ws(" ", number.cast("string"), F.octet_length(data).cast("string"), F.lower(F.lpad(F.hex(F.crc32(data)), 8, "0")), record)
    responses.select(line.alias("value")).write.mode("append").text(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """file, number, record, state: 'whole', 'torn' (shorter than it says) or 'damaged'."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    part = lambda i: F.regexp_extract("value", FRAME, i)
    framed = lines.select("file", F.col("value").rlike(FRAME).alias("_framed"), F.try_to_number(part(1), F.lit("9999999999")).cast("bigint").alias("number"),
                          F.try_to_number(part(2), F.lit("9999999999")).cast("bigint").alias("_size"), part(3).alias("_crc"), part(4).alias("record"), "value")
    # Bytes as they lie in the file: a cut may have split a character.
    body = F.octet_length("value") - F.length(part(1)) - F.length(part(2)) - 11
    right = F.lower(F.lpad(F.hex(F.crc32(F.col("record").cast("binary"))), 8, "0")) == F.col("_crc")
    # What a cut leaves of a line: part of the header, or a whole header with too short a record.
    begun = F.col("value").rlike(r"^(\d+( (\d+( [0-9a-f]{0,8})?)?)?)?$")
    state = (
        F.when(F.col("_framed") & (body == F.col("_size")) & right, "whole")
        .when((F.col("_framed") & (body < F.col("_size"))) | (~F.col("_framed") & begun), "torn")
        .otherwise("damaged")
    )
    return framed.select("file", "number", "record", state.alias("state"))


def damaged_files(frames: DataFrame) -> DataFrame:
    """file, n_whole, n_torn, n_damaged of files that lost more than the end of their last line."""
    counts = frames.groupBy("file").agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("whole", "torn", "damaged")],
        F.max(F.when(F.col("state") == "whole", F.col("number"))).alias("_last"))
    gap = F.coalesce(F.col("_last") + 1, F.lit(0)) != F.col("n_whole")
    return counts.filter((F.col("n_damaged") > 0) | (F.col("n_torn") > 1) | gap).select("file", "n_whole", "n_torn", "n_damaged")


def read_responses(spark: SparkSession, path: str, schema: str = RESPONSE_SCHEMA) -> DataFrame:
    """Records of a response log.

    A line that a stopped run left unfinished at the end of its file is dropped; any other
    damage, a missing line included, raises ValueError.
    """
    frames = read_frames(spark, path)
    bad = damaged_files(frames).limit(5).collect()
    if bad:
        raise ValueError(f"damaged response log: {[tuple(r) for r in bad]}")
    return frames.filter(F.col("state") == "whole").select(F.from_json("record", schema).alias("r")).select("r.*")


def resume(questions: DataFrame, spark: SparkSession, path: str, key: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Questions the log at ``path`` does not answer yet; ``key`` tells responses of its variants apart."""
    done = read_responses(spark, path).withColumnRenamed("index", "idx")
    return pending(questions, done, list(key))


# --- sinks by database ----------------------------------------------------------
def write_by_database(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows of a database lie together and in order; a large one is split over several files.

    ``db_id`` stays a column: a folder per database would leave millions of tiny files.
    """
    df.repartitionByRange("db_id", *order).sortWithinPartitions("db_id", *order).write.mode("overwrite").parquet(path)


def write_pools(pools: DataFrame, path: str) -> None:
    """Ranked candidate names (db_id, word, ..., rank)."""
    write_by_database(pools, path, ["rank"])


def write_metadata(metadata: DataFrame, path: str) -> None:
    """One row of counts per database."""
    write_by_database(metadata, path, [])


def write_catalog(catalog: Catalog, path: str) -> None:
    """The flat catalog as three tables, so that no database has to be one row."""
    write_by_database(catalog.tables, f"{path}/tables", ["table_name"])
    write_by_database(catalog.columns, f"{path}/columns", ["table_name", "col_ord"])
    write_by_database(catalog.fks, f"{path}/fks", ["table_name", "fk_ord"])


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    return Catalog(*[spark.read.parquet(f"{path}/{name}") for name in ("tables", "columns", "fks")])


def write_variants(df: DataFrame, path: str) -> None:
    """One folder per (size, level); rows of a database lie together inside.

    ``db_id`` stays a column: a folder per database would leave millions of tiny
    files. The range shuffle splits a large database over several files and the
    sort lets readers skip row groups by ``db_id``.
    """
    keys = ["size", "level", "db_id", "idx"]
    (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite").partitionBy("size", "level").parquet(path)
    )


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
