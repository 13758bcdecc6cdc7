"""Incremental ingestion of response logs, every record once.

The stream itself keeps no keyed state. A micro-batch looks its keys up in a store under
``work_dir`` and adds what is new, so however late a record is delivered again, it changes
nothing, and what the stream holds in memory does not grow:

    records/batch=<n>/bucket=<b>   accepted records, sorted by key; the log itself
    keys/upto=<n>/bucket=<b>       keys of all records up to a batch, in fewer, larger files;
                                   made by the batch behind it before that reads anything
    sums/batch=<n>                 partial sums of the accepted records
    progress                       offsets of the stream

A key lies in the bucket of its hash; a look-up reads the key column of the buckets that
the batch has keys in. A batch that is replayed after a failure reads earlier batches only
and overwrites its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.scalars import percent, ratio
from schemaloom.operators.evaluate import KEY
from schemaloom.session import shared_dir

BUCKETS = 32
#: Batches whose keys lie in files of their own before they are put together.
LOOSE_BATCHES = 16


def _partial(batch: DataFrame, group: list[str]) -> DataFrame:
    seconds = F.col("duration_seconds") + F.coalesce("filter_duration_seconds", F.lit(0.0))
    return batch.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("execution_accuracy").alias("correct"),
        F.sum(seconds).alias("seconds"),
        F.sum("total_tokens").alias("tokens"),
    )


def with_key(df: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds the digest of the key columns, nulls included, and its bucket."""
    digest = F.md5(F.to_json(F.struct(*key)))
    return df.withColumn("__key", digest).withColumn("bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int"))


def first_of_key(batch: DataFrame) -> DataFrame:
    """One record per key, the same one whenever the batch is read."""
    columns = [c for c in batch.columns if c not in ("__key", "bucket")]
    record = F.struct(*columns)
    kept = batch.groupBy("__key", "bucket").agg(F.min_by(record, F.md5(F.to_json(record))).alias("r"))
    return kept.select("__key", "bucket", "r.*")


def packed_upto(batch_id: int) -> int:
    """Last batch whose keys are put together when ``batch_id`` runs, -1 if there is none."""
    last = (batch_id - 1) // LOOSE_BATCHES * LOOSE_BATCHES
    return last if last > 0 else -1


def known_keys(spark: SparkSession, work_dir: str, upto: int, batch_id: int, touched: list[int]) -> DataFrame:
    """Keys of all batches before ``batch_id`` in the given buckets; those until ``upto`` are put together."""
    loose = spark.read.schema("__key string, batch int, bucket int").parquet(f"{work_dir}/records")
    keys = loose.filter((F.col("batch") > upto) & (F.col("batch") < batch_id)).select("__key", "bucket")
    if upto >= 0:
        packed = spark.read.schema("__key string, upto int, bucket int").parquet(f"{work_dir}/keys")
        keys = keys.unionByName(packed.filter(F.col("upto") == upto).select("__key", "bucket"))
    return keys.filter(F.col("bucket").isin(touched))


def _write_bucketed(df: DataFrame, path: str) -> None:
    df.repartition("bucket").sortWithinPartitions("bucket", "__key").write.mode("overwrite").partitionBy("bucket").parquet(path)


def pack_keys(spark: SparkSession, work_dir: str, upto: int, buckets: int = BUCKETS) -> None:
    """Put the keys of all batches until ``upto`` together."""
    keys = known_keys(spark, work_dir, packed_upto(upto), upto + 1, list(range(buckets)))
    _write_bucketed(keys, f"{work_dir}/keys/upto={upto}")


def accept(batch: DataFrame, batch_id: int, work_dir: str, group: list[str], key: list[str] = KEY, buckets: int = BUCKETS) -> None:
    """Add the records of a micro-batch whose keys no earlier batch had; a replay has the same outcome."""
    spark = batch.sparkSession
    upto = packed_upto(batch_id)
    if 0 <= upto == batch_id - 1:  # done again by a replay
        pack_keys(spark, work_dir, upto, buckets)
    keyed = first_of_key(with_key(batch, key, buckets))
    records = f"{work_dir}/records/batch={batch_id}"
    if batch_id:
        touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]  # at most ``buckets``
        keyed = keyed.join(known_keys(spark, work_dir, upto, batch_id, touched), ["bucket", "__key"], "left_anti")
    _write_bucketed(keyed, records)
    # Sums come from what was written, so that a replay cannot sum other rows than it stored.
    written = spark.read.schema(keyed.schema).parquet(records)
    _partial(written, group).write.mode("overwrite").parquet(f"{work_dir}/sums/batch={batch_id}")


def ingest(stream: DataFrame, work_dir: str, group: list[str], key: list[str] = KEY) -> None:
    """Process everything that has arrived, then stop; a later call with the same folder resumes."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: accept(batch, batch_id, work_dir, group, key))
        .option("checkpointLocation", f"{work_dir}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_metrics(spark, work_dir: str, group: list[str]) -> DataFrame:
    """Overall metrics from the partial sums written so far."""
    sums = spark.read.parquet(f"{work_dir}/sums")
    n = F.sum("n")
    return sums.groupBy(*group).agg(
        n.alias("n"),
        percent(F.sum("correct"), n).alias("exa"),
        ratio(F.sum("seconds"), n).alias("seconds"),
        ratio(F.sum("tokens"), n).alias("tokens"),
    )


def stream_metrics(spark, sf_dir: str, to_log, group: list[str]) -> DataFrame:
    """Metrics of the ``events`` file read as a stream; ``to_log`` maps events to log rows."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    work_dir = shared_dir(spark, "stream-metrics")
    ingest(to_log(stream), work_dir, group)
    return current_metrics(spark, work_dir, group)


def redelivered_metrics(spark, log: DataFrame, group: list[str], deliveries: int = 4) -> DataFrame:
    """Metrics of a log that arrives in parts, every part again with the next one and the first part last of all."""
    path, work_dir = shared_dir(spark, "deliveries"), shared_dir(spark, "redelivered")
    part = F.pmod(F.xxhash64(*KEY), F.lit(deliveries)).cast("int")
    times = F.when(part == 0, F.array(F.lit(0), F.lit(1), F.lit(deliveries))).otherwise(F.array(part, part + 1))
    sent = log.withColumn("delivery", F.explode(times))
    for n in range(deliveries + 1):  # one after the other, as a log grows; the files of a delivery make one batch
        sent.filter(F.col("delivery") == n).drop("delivery").write.mode("append").parquet(path)
        ingest(spark.readStream.schema(log.schema).parquet(path), work_dir, group)
    return current_metrics(spark, work_dir, group)
