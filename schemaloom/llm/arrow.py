"""Helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StringType, StructField, StructType

PIECE_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their search path already has it."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(sc, "_schemaloom_shipped", False) or any(p and Path(p).resolve() == package.parent for p in paths):
        return
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._schemaloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_text(df: DataFrame, column: str) -> DataFrame:
    """The text column as string; other types are written as Spark casts them."""
    return df if df.schema[column].dataType == StringType() else df.withColumn(column, F.col(column).cast("string"))


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


class Memory:
    """A table of bounded size that forgets what was not asked for lately.

    ``turn`` starts a new half when the present one is full; entries that are asked for
    again move over from the old half. Forgetting costs time only.
    """

    def __init__(self, half: int) -> None:
        self.half, self.new, self.old = half, {}, {}

    def turn(self) -> None:
        if len(self.new) >= self.half:
            self.new, self.old = {}, self.new

    def recall(self, keys: set) -> set:
        """Make sure that ``new`` has the keys that are known; returns the others."""
        absent = keys.difference(self.new)
        found = absent.intersection(self.old)
        self.new.update((k, self.old[k]) for k in found)
        return absent - found


def add_columns(df: DataFrame, text: str, fields: list[tuple[str, DataType]],
                make: Callable[[], Callable[[list[str | None]], list]]) -> DataFrame:
    """Append columns computed from a text column; all other columns pass through.

    ``make()`` is called once per task and returns a function from texts to one
    sequence per new column. An existing column with the name of a new one is
    replaced, as ``withColumn`` does.
    """
    new = [StructField(n, t) for n, t in fields]
    names = {n.lower() for n, _ in fields}
    df = as_text(df, text)
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    source = df.select([F.col(f"`{f.name}`") for f in kept] + ([F.col(text).alias("__text")] if text.lower() in names else []))
    column = "__text" if text.lower() in names else text
    schema = StructType(kept + new)
    arrow = to_arrow_schema(schema)
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch, column):
                made = work(part.column(part.schema.get_field_index(column)).to_pylist())
                old = [part.column(part.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays(
                    old + [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(f.name).type) for v, f in zip(made, new)],
                    names=keep + [f.name for f in new],
                )

    return source.mapInArrow(run, schema)
