"""Vocabulary cleaning and candidate filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.constants import EXCLUDED_LEXNAMES, SQL_KEYWORDS


def drop_excluded_senses(lexicon: DataFrame) -> DataFrame:
    """word, zipf of words none of whose senses is excluded."""
    excluded = F.col("lexname").isin(*EXCLUDED_LEXNAMES)
    return (
        lexicon.groupBy("word")
        .agg(F.max("zipf").alias("zipf"), F.bool_or(excluded).alias("excluded"))
        .filter(~F.col("excluded"))
        .drop("excluded")
    )


def clean_vocabulary(lexicon: DataFrame, whitelist: DataFrame, min_len: int = 4, max_zipf: float = 4.0) -> DataFrame:
    """Distinct usable nouns: alphabetic, long enough, rare or whitelisted.

    The whitelist only matters for frequent words, so only those are joined with it.
    """
    lowered = lexicon.withColumn("word", F.lower("word")).filter(
        F.col("word").rlike(r"^\p{L}+$") & (F.char_length("word") >= min_len)
    )
    words = drop_excluded_senses(lowered)
    rare = words.filter(F.col("zipf") <= max_zipf).select("word")
    frequent = words.filter(F.col("zipf") > max_zipf).select("word").join(whitelist, "word", "left_semi")
    return rare.unionByName(frequent)


def exclude_candidates(words: DataFrame, schema_names: DataFrame, vectors: DataFrame) -> DataFrame:
    """(db_id, word) pairs that are no name of their schema, no SQL keyword and have a vector."""
    return (
        words.filter(~F.col("word").isin(*SQL_KEYWORDS))
        .join(schema_names.select("db_id", F.col("name").alias("word")).distinct(), ["db_id", "word"], "left_anti")
        .join(vectors.select("word"), "word", "left_semi")
    )


def lookup_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Words with their vectors; words without one are dropped."""
    return words.join(vectors, "word")


def all_names(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Table and column names per database, with repeats."""
    return tables.select("db_id", F.col("table_name").alias("name")).unionByName(columns.select("db_id", "name"))


def schema_names(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Distinct table and column names per database."""
    return all_names(tables, columns).distinct()


def fresh_words(pools: DataFrame, names: DataFrame) -> DataFrame:
    """Pool words that equal no table or column of their database, ignoring case.

    ``names`` may repeat. It is cut to names that some pool holds before it is
    shuffled; the pools are much smaller, so that cut is usually a broadcast.
    """
    keyed = pools.withColumn("_key", F.lower("word"))
    held = keyed.select("db_id", "_key").distinct()
    taken = names.select("db_id", F.lower("name").alias("_key")).join(held, ["db_id", "_key"], "left_semi").distinct()
    return keyed.join(taken, ["db_id", "_key"], "left_anti").drop("_key")
