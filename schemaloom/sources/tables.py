"""Inputs of the registered queries, derived from the parquet tables.

``documents`` plays the corpus of databases: a source is a database, a document
is a table and every distinct word of its text, in order, is a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions import draws
from schemaloom.functions.scalars import affinity, first_token, raw_tokens, tokens
from schemaloom.operators.ordering import number_by_id, number_in_order
from schemaloom.session import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DECLARED_TYPES = ("INT", "VARCHAR(20)", "REAL", "DATETIME", "DECIMAL(8,2)", "", "TEXT")
LEXNAMES = ("noun.person", "noun.location", "noun.group", "noun.artifact", "noun.act", "noun.state")
SIZES = (0, 50, 100, 250, 500, 800)
POOLS_PER_WORD = 8
#: New tables of a source: so many, and one for every so many that it has.
NEW_TABLES, PER_TABLES = 40, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_name(doc_id):
    return F.concat(F.lit("t"), doc_id.cast("string"))


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, db_id, table_name, table_ord, origin."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("db_id"), "doc_id")
    return number_by_id(docs, ["db_id"], "doc_id", "table_ord").select(
        F.lit("corpus").alias("dataset"),
        "db_id",
        table_name(F.col("doc_id")).alias("table_name"),
        "table_ord",
        F.lit("original").alias("origin"),
    )


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """db_id, table_name, col_ord, name, type, typegroup, not_null, pk; no shuffle."""
    docs = table(spark, sf_dir, "documents")
    words = F.array_distinct(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")))
    key = F.concat(table_name(F.col("doc_id")), F.lit("_id"))
    names = docs.select(
        F.col("source").alias("db_id"),
        table_name(F.col("doc_id")).alias("table_name"),
        F.posexplode_outer(F.concat(F.array(key), words)).alias("col_ord", "name"),
    )
    ordinal = F.col("col_ord")
    declared = F.element_at(F.array(*[F.lit(t) for t in DECLARED_TYPES]), (ordinal % 7 + 1).cast("int"))
    return names.select(
        "db_id",
        "table_name",
        "col_ord",
        "name",
        declared.alias("type"),
        affinity(declared).alias("typegroup"),
        (ordinal % 3 == 0).alias("not_null"),
        F.when(ordinal == 0, 1).otherwise(0).alias("pk"),
    )


def catalog_fks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """db_id, table_name, fk_ord, local_col, ref_table, ref_col.

    Each table but the first points at the key of the table at half its own
    position, through its first non-key column.
    """
    tables = catalog_tables(spark, sf_dir).select("db_id", "table_name", "table_ord")
    docs = table(spark, sf_dir, "documents")
    local = docs.select(
        F.col("source").alias("db_id"), table_name(F.col("doc_id")).alias("table_name"), first_token(F.col("text")).alias("local_col")
    ).filter(F.col("local_col").isNotNull())
    parents = tables.select("db_id", F.col("table_name").alias("ref_table"), F.col("table_ord").alias("ref_ord"))
    return (
        tables.filter(F.col("table_ord") >= 1)
        .withColumn("ref_ord", F.floor(F.col("table_ord") / 2))
        .join(parents, ["db_id", "ref_ord"])
        .join(local, ["db_id", "table_name"])
        .select(
            "db_id",
            "table_name",
            F.lit(0).alias("fk_ord"),
            "local_col",
            "ref_table",
            F.concat("ref_table", F.lit("_id")).alias("ref_col"),
        )
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, db_id, question."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("idx"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("db_id"),
        F.col("text").alias("question"),
    )


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, n over the whole texts of all documents, counted once and stored."""
    docs = table(spark, sf_dir, "documents")
    counts = (
        docs.select(F.explode_outer(raw_tokens(F.col("text"))).alias("word"))
        .filter(F.col("word") != "")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return materialize(counts, "word-counts")


def lexicon(counts: DataFrame) -> DataFrame:
    """word, lexname, zipf from ``word_counts``: one or two senses per word."""
    total = counts.agg(F.sum("n").alias("total"))  # one row

    def sense(text):
        code = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % len(LEXNAMES)
        return F.element_at(F.array(*[F.lit(x) for x in LEXNAMES]), code.cast("int") + 1)

    word = F.col("word")
    second = F.when(F.length(word) % 2 == 0, F.array(sense(F.concat(F.lit("2:"), word))))
    senses = F.concat(F.array(sense(word)), F.coalesce(second, F.array().cast("array<string>")))
    zipf = F.round(F.log10(F.lit(1e9) * F.col("n") / total.scalar()), 6)
    return counts.select("word", F.explode_outer(senses).alias("lexname"), zipf.alias("zipf"))


def whitelist(counts: DataFrame) -> DataFrame:
    """Frequent words that stay allowed."""
    return counts.filter(F.md5(F.concat(F.lit("w:"), F.col("word"))).startswith("0")).select("word")


def candidate_pools(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    """db_id, word, rank: each word enters up to ``POOLS_PER_WORD`` pools; a pool has all its words in seeded order."""
    dbs = number_by_id(
        table(spark, sf_dir, "documents").groupBy(F.col("source").alias("db_id")).agg(F.min("doc_id").alias("first_doc"))
        .withColumn("_all", F.lit(0)),
        ["_all"], "first_doc", "db_ord",
    )
    n_dbs = dbs.agg(F.count(F.lit(1)).alias("n_dbs"))  # one row
    draw = F.floor(draws.uniform("pool", F.col("word"), F.col("pool")) * n_dbs.scalar()).cast("bigint")
    placed = (
        vocab.select("word", F.explode(F.sequence(F.lit(0), F.lit(POOLS_PER_WORD - 1))).alias("pool"))
        .select("word", draw.alias("db_ord"))
        .distinct()
        .join(dbs.select("db_id", "db_ord"), "db_ord")
        .select("db_id", "word")
        .withColumn("_digest", draws.digest("pool-order", F.col("db_id"), F.col("word")))
    )
    ranked = number_in_order(placed, ["db_id"], [F.col("_digest"), F.col("word")], "_place0")
    return ranked.select("db_id", "word", (F.col("_place0") + 1).alias("rank"))


def word_vectors(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    """word, vec: the rarest words of the vocabulary have the vectors, in order."""
    counted = vocab.select("word").join(word_counts(spark, sf_dir), "word")
    placed = number_in_order(counted, [], [F.col("n"), F.md5(F.col("word").cast("binary"))], "vec_id")
    return placed.join(table(spark, sf_dir, "embeddings"), "vec_id").select("word", F.col("embedding").alias("vec"))


def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_result_log(table(spark, sf_dir, "events"))


def as_result_log(events: DataFrame, keep_event: bool = False) -> DataFrame:
    """Response log rows from event rows; works on a stream as well."""
    event = F.col("event_id")
    question = F.expr("event_id div 4")  # four variants answer each question
    k = F.get_json_object("props", "$.k").cast("bigint")
    digits = lambda n: (event % n).cast("string")
    gold = F.concat(
        F.lit("SELECT count(*) FROM t"), (question % 200).cast("string"),
        F.when(question % 3 == 0, F.concat(F.lit(" JOIN t"), (question % 7).cast("string"), F.lit(" ON 1=1"))).otherwise(F.lit("")),
    )
    pred = F.when(
        event % 50 != 0,
        F.concat(
            F.lit("select count(*) from "),
            F.when(event % 11 == 0, F.lit("syn_")).otherwise(F.lit("t")),
            digits(200),
            F.when(event % 3 == 0, F.concat(F.lit(' join "main"."t'), digits(7), F.lit('" on 1=1'))).otherwise(F.lit("")),
        ),
    )
    return events.select(
        question.alias("idx"),
        F.when(event % 2 == 0, "m1").otherwise("m2").alias("model"),
        (F.expr("event_id div 2") % 2 + 1).cast("int").alias("level"),
        F.element_at(F.array(*[F.lit(s) for s in SIZES]), (F.col("user_id") % 6 + 1).cast("int")).alias("size"),
        F.when(event % 5 == 0, "bm25").otherwise("none").alias("filter"),
        F.concat(F.lit("src"), (question % 20).cast("string")).alias("db_id"),
        F.col("value").alias("duration_seconds"),
        F.when(event % 5 == 0, F.col("value") / 100).alias("filter_duration_seconds"),
        (k * 100 + event % 97).alias("total_tokens"),
        F.when(k >= 25, 1).otherwise(0).alias("execution_accuracy"),
        gold.alias("sql_gold"),
        pred.alias("sql_pred"),
        "ts",
        *([event.alias("event")] if keep_event else []),
    )


def log_synthetic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """db_id, table_name of the synthetic tables the response log may name."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("db_id"),
            F.concat(F.lit("SYN_"), (F.col("event_id") % 200).cast("string")).alias("table_name"),
        )
        .distinct()
    )


def _changed_results(rows: DataFrame) -> DataFrame:
    """Predicted rows: one question in four has a changed value, one lacks the rows of a flag."""
    quantity, flag = F.col("l_quantity"), F.col("l_returnflag")
    shifted = F.when((F.col("l_suppkey") % 4 == 1) & (F.col("l_linenumber") == 1), quantity + 1).otherwise(quantity)
    return rows.withColumn("l_quantity", shifted).filter(~((F.col("l_suppkey") % 4 == 0) & (flag == "A")))


def result_bags(spark: SparkSession, sf_dir: str, position: bool = False) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted result rows (qid, a, b, c[, pos]) over all of ``lineitem``."""
    rows = table(spark, sf_dir, "lineitem")
    place = [(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos")] if position else []
    named = [F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("a"), F.col("l_quantity").alias("b"), F.col("l_returnflag").alias("c"), *place]
    return rows.select(*named), _changed_results(rows).select(*named)


WIDE = ["a", "b", "c", "d", "e", "f", "h", "flag_again", "number_again", "nothing"]


def wide_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted rows with ten columns, some of them equal."""
    rows = table(spark, sf_dir, "lineitem")
    taken = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_linenumber", "l_returnflag", "l_linenumber"]
    named = [F.col("l_suppkey").alias("qid"), *[F.col(c).alias(n) for c, n in zip(taken, WIDE)], F.lit(None).cast("string").alias("nothing")]
    return rows.select(*named), _changed_results(rows).select(*named)


REPORT_COLUMNS = ["a", "b", "c"]


def report_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response log, where every fourth gold statement orders its rows."""
    ordered = F.when(F.col("idx") % 4 == 0, F.lit(" ORDER BY 1")).otherwise(F.lit(""))
    return result_log(spark, sf_dir).drop("execution_accuracy").withColumn("sql_gold", F.concat("sql_gold", ordered))


def report_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the gold statement of a question (db_id, idx) and that of a response return.

    Question n reads the lines of order n + 1. Of the responses one in seven changes a value, one in thirteen
    reverses the rows, and a third each turns its columns round by none, one or two places.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") - 1).alias("idx"), F.col("l_partkey").cast("string").alias("a"), F.col("l_quantity").alias("b"),
        F.col("l_returnflag").alias("c"), F.col("l_linenumber").alias("line"))
    asked = as_result_log(table(spark, sf_dir, "events"), keep_event=True)
    gold = asked.select("db_id", "idx").distinct().join(lines, "idx").select("db_id", "idx", "a", F.col("b").cast("string").alias("b"), "c", F.col("line").alias("pos"))
    event = F.col("event")
    rows = asked.filter(F.col("sql_pred").isNotNull()).select("model", "level", "size", "filter", "idx", "db_id", "event").join(lines, "idx")
    changed = F.when((event % 7 == 0) & (F.col("line") == 1), F.col("b") + 1).otherwise(F.col("b")).cast("string")
    reverse = F.when((event % 13 == 0) & (event % 3 != 1), -F.col("line")).otherwise(F.col("line"))
    cells = F.array(F.col("a"), changed, F.col("c"))
    at = lambda i: F.get(cells, ((event + i) % 3).cast("int"))
    pred = rows.select("model", "level", "size", "filter", "idx", "db_id", *[at(i).alias(c) for i, c in enumerate(REPORT_COLUMNS)], reverse.alias("pos"))
    return gold, pred


def schema_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """db_id, word, vec of schema names: every vector names something in one of three databases of its label, a large, a small and a tiny one."""
    part = F.when(F.col("vec_id") % 16 == 0, 2).when(F.col("vec_id") % 16 < 4, 1).otherwise(0)
    return table(spark, sf_dir, "embeddings").select(
        (F.col("label") * 4 + part).alias("db_id"), F.col("vec_id").alias("word"), F.col("embedding").alias("vec")
    )


def vocabulary_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, vec of the vocabulary: all vectors. Names of one database are words for the others."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))
