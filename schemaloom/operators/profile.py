"""Keys, inclusion dependencies and column profiles discovered on data."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DateType, FractionalType, IntegralType, MapType, StringType, TimestampNTZType, TimestampType,
)

from schemaloom.functions.scalars import affinity
from schemaloom.session import materialize

#: Sketches of 2**14 registers are off by 0.8 %; a key's estimate falls under this share of the rows once in 10**9 times.
SKETCH_BITS = 14
LIKELY = 0.95
#: Columns that one number has bits for.
WORD = 62
#: Longer texts meet as digests.
PLAIN_TEXT = 32


def key_check(df: DataFrame, table_name: str, key: list[str]) -> DataFrame:
    """Whether ``key`` is unique and never null; one row."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    has_null = F.lit(False)
    for k in key:
        has_null = has_null | F.col(k).isNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(~has_null).alias("n_distinct"),
        F.coalesce(F.sum(F.when(~has_null, F.col("n"))), F.lit(0)).alias("n_non_null"),
    ).select(
        F.lit(table_name).alias("table_name"),
        F.lit(",".join(key)).alias("key_columns"),
        "n_rows",
        "n_distinct",
        "n_non_null",
        ((F.col("n_rows") == F.col("n_distinct")) & (F.col("n_rows") == F.col("n_non_null"))).alias("is_key"),
    )


def inclusion_check(child: DataFrame, child_name: str, child_col: str, parent: DataFrame, parent_name: str, parent_col: str) -> DataFrame:
    """How many distinct child values have no parent; one row.

    Both sides are reduced to distinct values before they meet, so a frequent
    value costs one row.
    """
    values = child.select(F.col(child_col).alias("v")).filter(F.col("v").isNotNull()).distinct()
    known = parent.select(F.col(parent_col).alias("v")).distinct().withColumn("known", F.lit(True))
    return values.join(known, "v", "left").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("known").isNull()).alias("n_orphans")
    ).select(
        F.lit(child_name).alias("child_table"),
        F.lit(child_col).alias("child_col"),
        F.lit(parent_name).alias("parent_table"),
        F.lit(parent_col).alias("parent_col"),
        "n_values",
        "n_orphans",
        (F.col("n_orphans") == 0).alias("holds"),
    )


def _sketch(columns: tuple[str, ...]) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*columns), F.lit(SKETCH_BITS)))


def _estimates(df: DataFrame, sets: list[tuple[str, ...]]) -> list[int]:
    """Estimated distinct rows of every column set, all from one pass."""
    return list(df.agg(*[_sketch(s).alias(f"s{i}") for i, s in enumerate(sets)]).first()) if sets else []


def _unique(df: DataFrame, sets: list[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """The sets that no two rows agree on, counted exactly."""
    if not sets:
        return set()
    checks = [df.groupBy(*s).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("most")).select(F.lit(i).alias("i"), "most") for i, s in enumerate(sets)]
    return {sets[r.i] for r in reduce(DataFrame.unionByName, checks).collect() if r.most == 1}  # one row per set


def discover_keys(df: DataFrame, table_name: str, most: int = 2) -> DataFrame:
    """table_name, key_columns, n_rows: minimal column sets of up to ``most`` columns that are unique and never null.

    Sets are searched level by level: a set is looked at only if none of its parts is a key and the parts'
    distinct values could tell all rows apart. One pass of sketches rules out most of a level; what is
    left is counted. A table without rows has no keys.
    """
    spark = df.sparkSession
    columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    # The first level needs one pass: rows, values that are not null and a sketch of every column.
    seen = df.agg(F.count(F.lit(1)), *[m for c in columns for m in (F.count(c), _sketch((c,)))]).first()
    n = seen[0]
    values = {c: e for c, full, e in zip(columns, seen[1::2], seen[2::2]) if full == n}
    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1 if n else 1):
        level = [
            s for s in combinations(values, size)
            if not any(set(k) <= set(s) for k in keys) and prod(values[c] / LIKELY for c in s) >= LIKELY * n
        ]
        found = [values[c] for (c,) in level] if size == 1 else _estimates(df, level)
        keys += sorted(_unique(df, [s for s, e in zip(level, found) if e >= LIKELY * n]))
    rows = [(table_name, ",".join(k), n) for k in keys]
    return spark.createDataFrame(rows, "table_name string, key_columns string, n_rows bigint")


def value_class(kind: DataType) -> str | None:
    """Columns of one class can refer to each other; None for nested types."""
    for name, types in (("whole", IntegralType), ("number", FractionalType), ("text", StringType), ("flag", BooleanType),
                        ("time", (DateType, TimestampType, TimestampNTZType))):
        if isinstance(kind, types):
            return name
    return None


def _comparable(column: Column, kind: str) -> Column:
    """A text that is equal for equal values of a class."""
    if kind == "number":
        return column.cast("double").cast("string")
    if kind == "time":
        return column.cast("timestamp").cast("string")
    if kind == "text":
        return F.when(F.length(column) > PLAIN_TEXT, F.concat(F.lit("#"), F.md5(column.cast("binary")))).otherwise(F.concat(F.lit("="), column))
    return column.cast("string")


def inclusions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """child_table, child_col, parent_table, parent_col, n_values of every pair of columns where the child has no value of its own.

    All columns of all tables are read once as (class, value, column). The columns that a value occurs in are
    bits of a few numbers, which partial aggregates put together without sorting rows; equal sets of columns are
    counted, and a pair holds if the sets with the child all have the parent: no two columns are joined. Columns
    without values are in no pair.
    """
    columns: list[tuple[str, str]] = []
    parts = []
    for name, df in tables.items():
        cells = []
        for f in df.schema.fields:
            kind = value_class(f.dataType)
            if kind:
                word, bit = divmod(len(columns), WORD)
                cells.append(F.struct(F.lit(word).alias("word"), F.lit(1 << bit).cast("bigint").alias("bit"), F.lit(kind).alias("kind"),
                                      _comparable(F.col(f"`{f.name}`"), kind).alias("v")))
                columns.append((name, f.name))
        if cells:
            parts.append(df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("v").isNotNull()))
    spark = next(iter(tables.values())).sparkSession
    named = spark.createDataFrame([(i, *c) for i, c in enumerate(columns)], "col int, t string, c string")
    words = [f"w{i}" for i in range(-(-len(columns) // WORD))]
    owners = reduce(DataFrame.unionByName, parts).groupBy("kind", "v").agg(
        *[F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bit"))), F.lit(0).cast("bigint")).alias(w) for i, w in enumerate(words)])
    has = lambda i: F.col(words[i // WORD]).bitwiseAND(F.lit(1 << i % WORD).cast("bigint")) != 0
    cols = F.array_compact(F.array(*[F.when(has(i), F.lit(i)) for i in range(len(columns))]))
    patterns = materialize(owners.groupBy(*words).agg(F.count(F.lit(1)).alias("n")).select(cols.alias("cols"), "n"), "column-patterns")
    of_child = patterns.select("cols", "n", F.explode("cols").alias("child"))
    sizes = of_child.groupBy("child").agg(F.sum("n").alias("n_values"))
    shared = of_child.select("child", "n", F.explode("cols").alias("parent")).groupBy("child", "parent").agg(F.sum("n").alias("n_shared"))
    held = shared.join(sizes, "child").filter((F.col("child") != F.col("parent")) & (F.col("n_shared") == F.col("n_values")))
    side = lambda of: named.select(F.col("col").alias(of), F.col("t").alias(f"{of}_table"), F.col("c").alias(f"{of}_col"))
    return held.join(side("child"), "child").join(side("parent"), "parent").select("child_table", "child_col", "parent_table", "parent_col", "n_values")


def references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Inclusions with ``in_key``: whether the parent column is a key of its table, so that the child can refer to it."""
    keys = reduce(DataFrame.unionByName, [discover_keys(df, name, 1) for name, df in tables.items()])
    keyed = keys.select(F.col("table_name").alias("parent_table"), F.col("key_columns").alias("parent_col"), F.lit(True).alias("in_key"))
    return inclusions(tables).join(keyed, ["parent_table", "parent_col"], "left").select(
        "child_table", "child_col", "parent_table", "parent_col", "n_values", F.coalesce("in_key", F.lit(False)).alias("in_key"))


def _one_row_per_column(df: DataFrame, row: DataFrame, fields: dict[str, list[Column]]) -> DataFrame:
    """The single row of a pass over the table as one row per column; ``fields`` has one value per column each."""
    entries = [F.struct(F.lit(i).alias("col_ord"), *[values[i].alias(n) for n, values in fields.items()]) for i in range(len(df.columns))]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def profile_columns(df: DataFrame, table_name: str, declared: dict[str, str] | None = None) -> DataFrame:
    """One row per column: type, type group, counts, exact distinct values, range of numbers, texts and times.

    All measures of a table come from one aggregate over its typed columns; texts are counted by digest.
    """
    declared = declared or {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = [value_class(f.dataType) for f in df.schema.fields]
    col = [F.col(f"`{c}`") for c in df.columns]
    ranged = [k in ("text", "time") for k in kinds]
    numeric = [k in ("whole", "number") for k in kinds]
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, (c, kind) in enumerate(zip(col, kinds)):
        aggregates += [F.count(c).alias(f"full{i}"), F.count_distinct(F.md5(c.cast("binary")) if kind == "text" else c).alias(f"distinct{i}")]
        if numeric[i] or ranged[i]:
            aggregates += [F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
    row = df.agg(*aggregates)

    def bound(which: str, i: int, as_number: bool) -> Column:
        kind = "double" if as_number else "string"
        if not (numeric[i] if as_number else ranged[i]):
            return F.lit(None).cast(kind)
        value = F.col(f"{which}{i}").cast(kind)
        return F.round(value, 6) if as_number else value

    every = range(len(col))
    fields = {
        "name": [F.lit(c) for c in df.columns],
        "type": [F.lit(declared[c]) for c in df.columns],
        "typegroup": [affinity(F.lit(declared[c])) for c in df.columns],
        "not_null": [F.col("n") == F.col(f"full{i}") for i in every],
        "n_rows": [F.col("n")] * len(col),
        "n_non_null": [F.col(f"full{i}") for i in every],
        "n_distinct": [F.col(f"distinct{i}") for i in every],
        "min_value": [bound("min", i, True) for i in every],
        "max_value": [bound("max", i, True) for i in every],
        "min_text": [bound("min", i, False) for i in every],
        "max_text": [bound("max", i, False) for i in every],
    }
    return _one_row_per_column(df, row, fields).select(F.lit(table_name).alias("table_name"), "*")


def sketch_columns(df: DataFrame, table_name: str, accuracy: int = 10_000) -> DataFrame:
    """table_name, col_ord, name, est_distinct, low, median, high: mergeable sketches of every column from one pass.

    Distinct values are off by about 0.8 %. The 1st, 50th and 99th hundredth are of numbers, and of the lengths of
    texts; their ranks are off by at most 1 / ``accuracy`` of the rows.
    """
    kinds = [value_class(f.dataType) for f in df.schema.fields]
    aggregates = []
    for i, (name, kind) in enumerate(zip(df.columns, kinds)):
        c = F.col(f"`{name}`")
        seen = F.when(c.isNotNull(), F.xxhash64(c))
        aggregates.append(F.hll_sketch_estimate(F.hll_sketch_agg(seen, F.lit(SKETCH_BITS))).alias(f"distinct{i}"))
        size = c if kind in ("whole", "number") else F.length(c) if kind == "text" else F.lit(None)
        aggregates.append(F.percentile_approx(size.cast("double"), [0.01, 0.5, 0.99], accuracy).alias(f"q{i}"))
    every = range(len(df.columns))
    fields = {
        "name": [F.lit(c) for c in df.columns],
        "est_distinct": [F.coalesce(F.col(f"distinct{i}"), F.lit(0)) for i in every],
        **{n: [F.get(f"q{i}", k) for i in every] for k, n in enumerate(("low", "median", "high"))},
    }
    return _one_row_per_column(df, df.agg(*aggregates), fields).select(F.lit(table_name).alias("table_name"), "*")
