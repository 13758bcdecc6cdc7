"""Flat catalog rows <-> nested schema documents, listings and rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions import draws
from schemaloom.functions.scalars import (
    affinity,
    column_phrase,
    foreign_key_phrase,
    prompt_column_line,
)
from schemaloom.operators.ordering import number_by_digest

_TABLE_BODY = (
    "columns: array<struct<name: string, type: string, typegroup: string, notnull: boolean, pk: int>>, "
    "primary_keys: array<string>, "
    "foreign_keys: array<struct<sourceTable: string, sourceColumn: string, targetColumn: string>>"
)
DOCUMENT_SCHEMA = f"dataset string, db_id string, schema map<string, struct<{_TABLE_BODY}>>"
#: Pieces of a schema text that are joined at once.
PIECE_RUN = 1024
#: A table as a row of its own.
TABLE_SCHEMA = "dataset string, db_id string, table_name string, table_ord bigint, " + _TABLE_BODY.replace(": array", " array")


def _ordered(ordinal: str, value: Column) -> Column:
    """Values of a group in ordinal order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def table_defs(tables: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """One row per table with ordered column, key and foreign-key arrays."""
    column = F.struct("name", "type", "typegroup", F.col("not_null").alias("notnull"), "pk")
    cols = columns.groupBy("db_id", "table_name").agg(_ordered("col_ord", column).alias("columns"))
    fk = F.struct(
        F.col("ref_table").alias("sourceTable"),
        F.col("ref_col").alias("sourceColumn"),
        F.col("local_col").alias("targetColumn"),
    )
    refs = fks.groupBy("db_id", "table_name").agg(_ordered("fk_ord", fk).alias("foreign_keys"))
    no_columns = F.array().cast("array<struct<name:string,type:string,typegroup:string,notnull:boolean,pk:int>>")
    no_fks = F.array().cast("array<struct<sourceTable:string,sourceColumn:string,targetColumn:string>>")
    keys = F.transform(F.filter("columns", lambda c: c["pk"] > 0), lambda c: c["name"])
    return (
        tables.join(cols, ["db_id", "table_name"], "left")
        .join(refs, ["db_id", "table_name"], "left")
        .withColumn("columns", F.coalesce("columns", no_columns))
        .withColumn("foreign_keys", F.coalesce("foreign_keys", no_fks))
        .withColumn("primary_keys", keys)
    )


def assemble(tables: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """One nested schema document (``DOCUMENT_SCHEMA``) per database, tables in catalog order.

    For handing documents on: a database has to fit one row, as in the files. Work on
    large databases takes the rows of ``table_defs`` and never assembles them.
    """
    defs = table_defs(tables, columns, fks)
    body = F.struct("columns", "primary_keys", "foreign_keys")
    entry = F.struct(F.col("table_ord").alias("o"), F.col("table_name").alias("k"), body.alias("v"))
    return (
        defs.groupBy("dataset", "db_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("table_ord").alias("o"), entry.alias("e")))).alias("entries"))
        .select(
            "dataset", "db_id",
            F.map_from_entries(F.transform("entries", lambda x: F.struct(x["e"]["k"], x["e"]["v"]))).alias("schema"),
        )
    )


def explode_tables(documents: DataFrame) -> DataFrame:
    """Table rows, as ``table_defs`` returns them, from nested documents."""
    return documents.select(
        "dataset", "db_id", F.posexplode(F.map_entries("schema")).alias("pos", "entry")
    ).select(
        "dataset", "db_id", F.col("entry.key").alias("table_name"), F.col("pos").cast("bigint").alias("table_ord"), "entry.value.*"
    )


def explode_columns(defs: DataFrame) -> DataFrame:
    """Column rows from table rows."""
    return (
        defs.select("db_id", "table_name", F.posexplode("columns").alias("col_ord", "c"))
        .select(
            "db_id", "table_name", "col_ord",
            "c.name", "c.type", "c.typegroup", F.col("c.notnull").alias("not_null"), "c.pk",
        )
    )


def explode_fks(defs: DataFrame) -> DataFrame:
    """Reference rows from table rows."""
    return (
        defs.select("db_id", "table_name", F.posexplode("foreign_keys").alias("fk_ord", "f"))
        .select(
            "db_id", "table_name", "fk_ord",
            F.col("f.targetColumn").alias("local_col"),
            F.col("f.sourceTable").alias("ref_table"),
            F.col("f.sourceColumn").alias("ref_col"),
        )
    )


def user_tables(objects: DataFrame, system_prefix: str = "sqlite_") -> DataFrame:
    """Catalog objects that are tables and not system tables."""
    return objects.filter((F.col("kind") == "table") & ~F.col("table_name").startswith(system_prefix))


def primary_keys(columns: DataFrame) -> DataFrame:
    """Key columns per table, in column order."""
    return (
        columns.filter(F.col("pk") > 0)
        .groupBy("db_id", "table_name")
        .agg(_ordered("col_ord", F.col("name")).alias("primary_keys"))
    )


def foreign_keys(fks: DataFrame) -> DataFrame:
    """Foreign keys per table as ordered structs."""
    fk = F.struct("local_col", "ref_table", "ref_col")
    return fks.groupBy("db_id", "table_name").agg(_ordered("fk_ord", fk).alias("foreign_keys"))


def with_affinity(columns: DataFrame) -> DataFrame:
    """Columns with the type group recomputed from the declared type."""
    return columns.withColumn("typegroup", affinity(F.col("type")))


def table_text(tables: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """Retrieval text per table: name, then columns, then foreign keys.

    Columns and keys share one grouping, so each table is shuffled once.
    """
    pieces = columns.select(
        "db_id", "table_name", F.lit(0).alias("kind"), F.col("col_ord").cast("int").alias("ord"),
        column_phrase(F.col("name"), F.col("typegroup"), F.col("pk")).alias("piece"),
    ).unionByName(
        fks.select(
            "db_id", "table_name", F.lit(1).alias("kind"), F.col("fk_ord").cast("int").alias("ord"),
            foreign_key_phrase(F.col("ref_col"), F.col("ref_table")).alias("piece"),
        )
    )
    listed = F.array_sort(F.collect_list(F.struct("kind", "ord", "piece")))
    body = pieces.groupBy("db_id", "table_name").agg(listed["piece"].alias("pieces"))
    head = F.concat(F.lit("table "), F.col("table_name"))
    return tables.join(body, ["db_id", "table_name"], "left").withColumn(
        "text", F.concat_ws(" ", head, F.array_join("pieces", " "))
    ).drop("pieces")


def prompt_heading() -> Column:
    return F.concat(F.lit("## Database Name: "), F.col("db_id"), F.lit(" \n\n## Database Schema \n\n"))


def schema_pieces(
    tables: DataFrame,
    columns: DataFrame,
    fks: DataFrame,
    group: list[str] | None = None,
    fix_not_null: bool = True,
    seed: int = draws.SEED,
) -> DataFrame:
    """Group, seq and piece: the schema text as ordered rows: a heading (seq -1), one row per table, then one per key.

    A group is a database or a question's selection; tables come in seeded order. The
    shape is the same at any size, and joining the pieces in order gives the whole text.
    """
    group = group or ["db_id"]
    keys = [*group, "table_name"]
    line = prompt_column_line(F.col("name"), F.col("type"), F.col("not_null"), F.col("pk"), fix_not_null)
    bodies = columns.groupBy(*keys).agg(F.array_join(_ordered("col_ord", line), "").alias("lines"))
    order = draws.digest("prompt", F.col("db_id"), F.col("table_name"), seed=seed)
    placed = number_by_digest(tables.select(*keys), group, order, ["table_name"], "seq")
    blocks = placed.join(bodies, keys, "left").select(
        *group,
        "seq",
        F.concat(
            F.lit("# Table: "), F.col("table_name"), F.lit("\n[\n"), F.coalesce("lines", F.lit("")), F.lit("]\n\n")
        ).alias("piece"),
    )
    n_tables = tables.groupBy(*group).agg(F.count(F.lit(1)).alias("n_tables"))
    ranked_fks = number_by_digest(fks, group, order, ["table_name", "fk_ord"], "fk_seq")
    refs = ranked_fks.join(n_tables, group).select(
        *group,
        (F.col("n_tables") + F.col("fk_seq")).alias("seq"),
        F.concat(
            F.when(F.col("fk_seq") == 0, F.lit("## Foreign Keys \n")).otherwise(F.lit("")),
            F.concat_ws(".", "table_name", "local_col"), F.lit(" REFERENCES "), F.concat_ws(".", "ref_table", "ref_col"),
            F.lit("\n"),
        ).alias("piece"),
    )
    heads = n_tables.select(*group, F.lit(-1).cast("bigint").alias("seq"), prompt_heading().alias("piece"))
    return heads.unionByName(blocks).unionByName(refs)


def schema_prompt(
    tables: DataFrame,
    columns: DataFrame,
    fks: DataFrame,
    group: list[str] | None = None,
    fix_not_null: bool = True,
    seed: int = draws.SEED,
) -> DataFrame:
    """Group and schema_text: the pieces of each group joined in order.

    Runs of ``PIECE_RUN`` pieces are joined first, so the last step of a large database sees few and long texts.
    Its text has to fit one row; work on larger databases takes the rows of ``schema_pieces``.
    """
    group = group or ["db_id"]
    pieces = schema_pieces(tables, columns, fks, group, fix_not_null, seed)
    run = F.floor(F.col("seq") / F.lit(PIECE_RUN)).alias("_run")
    runs = pieces.groupBy(*group, run).agg(F.array_join(_ordered("seq", F.col("piece")), "").alias("_text"))
    return runs.groupBy(*group).agg(F.array_join(_ordered("_run", F.col("_text")), "").alias("schema_text"))


def compress(fks: DataFrame, selected: DataFrame, group: list[str]) -> DataFrame:
    """Foreign keys of the selected tables whose referenced table is selected too."""
    own = selected.select(*group, "table_name")
    referenced = selected.select(*group, F.col("table_name").alias("ref_table"))
    return fks.join(own, ["db_id", "table_name"]).join(referenced, [*group, "ref_table"], "left_semi")


def fk_edges(tables: DataFrame, fks: DataFrame) -> DataFrame:
    """Each foreign key with the catalog position of both of its tables."""
    child = tables.select("db_id", "table_name", F.col("table_ord").alias("child_ord"))
    parent = tables.select("db_id", F.col("table_name").alias("ref_table"), F.col("table_ord").alias("parent_ord"))
    return fks.join(child, ["db_id", "table_name"]).join(parent, ["db_id", "ref_table"])


def union_catalogs(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Original tables plus the synthetic ones whose name is still free, ignoring case."""
    taken = original.select("db_id", F.lower("table_name").alias("_key"))
    extra = synthetic.withColumn("_key", F.lower("table_name")).join(taken, ["db_id", "_key"], "left_anti").drop("_key")
    return original.unionByName(extra)


def schema_diff(enlarged: DataFrame, original: DataFrame) -> DataFrame:
    """Tables of the enlarged schema that the original does not have."""
    return enlarged.join(original.select("db_id", "table_name"), ["db_id", "table_name"], "left_anti")
