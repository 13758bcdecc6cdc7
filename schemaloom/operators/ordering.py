"""Row numbers, top-k and slot expansion that no single task has to carry.

A plain ``row_number() over (partition by db ...)`` sorts one database in one
task. When a database can hold a third of all rows that task never finishes, so
the numbering here is done per (group, bucket) and shifted by the sizes of the
buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.session import materialize

SLOT_BLOCK = 4096


def number_rows(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """0-based position of each row in its group.

    ``bucket`` must rise with ``order`` and split a group into pieces one task
    can sort; the bucket counts themselves are a small table.
    """
    parted = df.withColumn("_bucket", bucket)
    sizes = parted.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        parted.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*group, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.col("_row") - 1).cast("bigint"))
        .drop("_bucket", "_row", "_offset")
    )


def _ranges(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows with _range, a part of the order by group and ``order``, and _place in it; written once.

    Ranges have about equal numbers of rows, so a group with a third of them lies in a third of the ranges.
    """
    keys = [*[F.col(g) for g in group], *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    in_range = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(placed, "ranges").withColumn("_range", F.shiftright("_at", 33)).withColumn("_place", in_range).drop("_at")


def number_in_order(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """0-based position of each row in its group, in two passes over ranges instead of a window over the group.

    The first pass sorts ranges of rows, the second adds up how many rows of a group lie in the ranges
    before; only these counts, one per group and range, meet in a window.
    """
    placed = _ranges(df, group, order)
    spans = placed.groupBy(*group, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(*group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, [*group, "_range"])
        .withColumn(out, (F.col("_offset") + F.col("_place") - F.col("_first")).cast("bigint"))
        .drop("_range", "_place", "_first", "_offset")
    )


def running_totals(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group that come before each row; a window spans one range of one group."""
    placed = _ranges(df, group, order)
    sums = placed.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    ranges_before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(ranges_before), F.lit(0)).alias("_offset"))
    rows_before = Window.partitionBy(*group, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(rows_before), F.lit(0))
    return placed.withColumn("_inside", inside).join(offsets, [*group, "_range"]).withColumn(out, F.col("_offset") + F.col("_inside")).drop(
        "_range", "_place", "_inside", "_offset")


def number_by_id(df: DataFrame, group: list[str], key: str, out: str, width: int = 65536) -> DataFrame:
    """Position by a whole-number key that is unique in its group."""
    return number_rows(df, group, F.floor(F.col(key) / F.lit(width)).cast("bigint"), [F.col(key)], out)


def number_by_digest(df: DataFrame, group: list[str], digest: Column, ties: list[str], out: str) -> DataFrame:
    """Position by a hex digest, whose leading digits spread any group evenly over 4,096 buckets."""
    keyed = df.withColumn("_digest", digest)
    order = [F.col("_digest"), *[F.col(t) for t in ties]]
    return number_rows(keyed, group, F.substring("_digest", 1, 3), order, out).drop("_digest")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, salt: Column, out: str = "rank", salts: int = 32) -> DataFrame:
    """First ``k`` rows of each group with a 1-based rank.

    Each (group, salt) is cut to ``k`` first, so the last window sees at most
    ``k * salts`` rows of any group. Nothing that belongs to the result is lost.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    first = Window.partitionBy(*group, "_salt").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    kept = salted.withColumn("_pre", F.row_number().over(first)).filter(F.col("_pre") <= k)
    return (
        kept.drop("_pre", "_salt")
        .withColumn(out, F.row_number().over(last))
        .filter(F.col(out) <= k)
    )


def expand_slots(df: DataFrame, keys: list[str], count: str, out: str = "slot") -> DataFrame:
    """One row per slot ``0 .. count-1``; long runs are split over tasks in blocks."""
    last_block = F.floor((F.col(count) - 1) / F.lit(SLOT_BLOCK)).cast("bigint")
    blocks = (
        df.filter(F.col(count) > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
        .repartition(*keys, "_block")
    )
    low = F.col("_block") * F.lit(SLOT_BLOCK)
    high = F.least(low + F.lit(SLOT_BLOCK), F.col(count)) - 1
    return blocks.withColumn(out, F.explode(F.sequence(low, high.cast("bigint")))).drop("_block")
