"""BM25 over the tables of each database.

k1 = 1.5, b = 0.75, epsilon = 0.25; statistics are per database. A term whose
idf is negative gets epsilon times the mean raw idf of its database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.functions.scalars import raw_tokens, tokens
from schemaloom.operators.ordering import expand_slots, top_k
from schemaloom.session import materialize

K1 = 1.5
B = 0.75
EPSILON = 0.25
#: Table positions of a block of posting lists, and the rounding that bounds allow for.
BLOCK = 1024
SLACK = 1e-5


def _term_counts(corpus: DataFrame) -> DataFrame:
    """db_id, term, df, length in one pass over the texts.

    Every table adds one row per distinct term plus one null-term row with its
    length, so table counts and lengths come out of the same partial aggregate.
    """
    lists = corpus.select("db_id", tokens(F.col("text")).alias("words"))
    with_marker = F.concat(F.array_distinct("words"), F.array(F.lit(None).cast("string")))
    return (
        lists.select("db_id", F.size("words").alias("len"), F.explode_outer(with_marker).alias("term"))
        .groupBy("db_id", "term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("len"))).alias("length"))
    )


def _with_idf(counts: DataFrame) -> DataFrame:
    """Term counts with idf; what a database has once (table count, mean length, mean idf) is stored apart.

    These rows are as few as databases, and since they are stored Spark knows it when it joins them.
    """
    totals = materialize(counts.filter(F.col("term").isNull()).select(
        "db_id",
        F.col("df").alias("n_tables"),
        F.try_divide(F.col("length").cast("double"), F.col("df").cast("double")).alias("avg_len"),
    ), "bm25-totals")
    raw_idf = F.log(F.col("n_tables") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = counts.filter(F.col("term").isNotNull()).join(totals, "db_id").withColumn("raw_idf", raw_idf)
    mean = materialize(raw.groupBy("db_id").agg(F.avg("raw_idf").alias("mean_idf")), "bm25-means")
    idf = F.when(F.col("raw_idf") < 0, F.lit(EPSILON) * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    return raw.join(mean, "db_id").select("db_id", "term", "df", "n_tables", "avg_len", idf.alias("idf"))


def bm25_stats(texts: DataFrame) -> DataFrame:
    """db_id, term, df, n_tables, avg_len, idf for texts (db_id, text).

    The counts are written once: both the totals and the terms read them, and the
    texts are not tokenised again.
    """
    return _with_idf(materialize(_term_counts(texts), "term-counts"))


def asked_terms(questions: DataFrame) -> DataFrame:
    """idx, db_id, term, qtf."""
    return (
        questions.select("idx", "db_id", F.explode_outer(raw_tokens(F.col("question"))).alias("term"))
        .filter(F.col("term") != "")
        .groupBy("idx", "db_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def posting_lists(texts: DataFrame, tables: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """db_id, term, block, table_ord, table_name, gain of the terms asked for; ``gain`` is what one occurrence in a question adds.

    Texts are scanned twice, for the statistics and for these terms, and never shuffled: only term counts are.
    """
    terms = materialize(asked.select("db_id", "term").distinct(), "asked-terms")
    weights = bm25_stats(texts).join(terms, ["db_id", "term"]).select("db_id", "term", "idf", "avg_len")
    words = texts.select("db_id", "table_name", tokens(F.col("text")).alias("words"))
    tf = (
        words.select("db_id", "table_name", F.size("words").alias("len"), F.explode_outer("words").alias("term"))
        .join(terms, ["db_id", "term"], "left_semi")
        .groupBy("db_id", "table_name", "len", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    saturation = F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.col("avg_len"))
    gain = F.col("idf") * F.col("tf") * F.lit(K1 + 1) / saturation
    places = tables.select("db_id", "table_name", "table_ord")
    return tf.join(weights, ["db_id", "term"]).join(places, ["db_id", "table_name"]).select(
        "db_id", "term", F.floor(F.col("table_ord") / F.lit(block)).cast("bigint").alias("block"), "table_ord", "table_name", gain.alias("gain"))


def _scores(candidates: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """Whole scores of candidates (idx, db_id, block, table_ord): every term of the question is looked up in its list."""
    wanted = candidates.join(asked, ["idx", "db_id"])
    return (
        wanted.join(postings, ["db_id", "term", "block", "table_ord"])
        .groupBy("idx", "db_id", "table_ord", "table_name")
        .agg(F.round(F.sum(F.col("qtf") * F.col("gain")), 6).alias("score"))
    )


def bm25_scores(texts: DataFrame, tables: DataFrame, questions: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """idx, db_id, table_ord, table_name, score of the tables that can be among the best ``k`` of a question.

    Posting lists are cut into blocks of table positions, each with the largest gain of a term. The lists'
    blocks that promise most to a question are read until they hold k tables, whose whole scores give a
    floor. Elsewhere a term brings up its tables only if the terms that promise no more than it can reach
    the floor together with it: a term common to all tables brings up none by itself. A question that has no k
    positive scores at first has no floor, and all its tables with a common term are scored.
    """
    asked = materialize(asked_terms(questions), "asked")
    postings = materialize(posting_lists(texts, tables, asked, block), "postings")
    tops = materialize(postings.groupBy("db_id", "term", "block").agg(
        F.max("gain").alias("top"), F.count_if(F.col("gain") > 0).alias("n")), "block-tops")
    promised = materialize(
        asked.join(tops, ["db_id", "term"]).select("idx", "db_id", "block", "term", (F.col("qtf") * F.greatest("top", F.lit(0.0))).alias("most"), "n"),
        "promised")
    question, one = ["idx", "db_id"], ["idx", "db_id", "block"]
    places = postings.select("db_id", "term", "block", "table_ord")

    def tables_of(chosen: DataFrame) -> DataFrame:
        return chosen.select(*one, "term").join(places, ["db_id", "term", "block"]).select(*one, "table_ord").distinct()

    # A table can stand in the list of every term, so k times as many entries are sure to hold k tables.
    n_terms = asked.groupBy(*question).agg(F.count(F.lit(1)).alias("n_terms"))
    best_first = Window.partitionBy(*question).orderBy(F.desc("most"), "block", "term").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        promised.filter(F.col("most") > 0)
        .withColumn("_before", F.coalesce(F.sum("n").over(best_first), F.lit(0)))
        .join(n_terms, question)
        .filter(F.col("_before") < k * F.col("n_terms"))
    )
    seeds = materialize(tables_of(first), "first-tables")
    begun = materialize(_scores(seeds, asked, postings), "first-scores")
    ranked = top_k(begun.filter(F.col("score") > 0), question, [F.desc("score"), F.col("table_ord")], k, F.col("table_ord"))
    floors = materialize(ranked.filter(F.col("rank") == k).select(*question, F.col("score").alias("floor")), "floors")
    least_first = Window.partitionBy(*one).orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    needed = (
        promised.withColumn("_sum", F.sum("most").over(least_first))
        .join(floors, question, "left")
        .filter(F.col("floor").isNull() | (F.col("_sum") + SLACK >= F.col("floor")))
    )
    others = tables_of(needed).join(seeds, [*one, "table_ord"], "left_anti")
    return begun.unionByName(_scores(others, asked, postings))


def bm25_top_tables(texts: DataFrame, tables: DataFrame, questions: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """idx, db_id, rank, table_name, table_ord, score: the best ``k`` tables of the question's database.

    Tables without a shared term score zero and still fill up to ``k`` in catalog
    order. Only questions with fewer than ``k`` positive scores need them, and the
    first ``k + matched`` catalog positions are sure to hold enough, so the
    question x table product is never formed.
    """
    keys = ["idx", "db_id"]
    places = tables.select("db_id", "table_name", "table_ord")
    scored = materialize(bm25_scores(texts, tables, questions, k, block), "bm25-scores")
    order = [F.col("score").desc(), F.col("table_ord")]
    matched = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(F.col("score") > 0).alias("positive")
    )
    asked = questions.select(*keys).join(matched, keys, "left")
    short = asked.filter(F.coalesce("positive", F.lit(0)) < k).select(
        *keys, (F.coalesce("matched", F.lit(0)) + k).cast("bigint").alias("reach")
    )
    fill = (
        expand_slots(short, keys, "reach", "table_ord")
        .join(places, ["db_id", "table_ord"])
        .join(scored.select(*keys, "table_ord"), [*keys, "table_ord"], "left_anti")
        .select(*keys, "table_name", "table_ord", F.lit(0.0).alias("score"))
    )
    return top_k(scored.unionByName(fill), keys, order, k, F.col("table_ord"))


def scope(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """Questions with the number of tables of their database: the scoring scope, without its pairs."""
    sizes = tables.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_tables"), F.max("table_ord").alias("last_ord"))
    return questions.join(sizes, "db_id", "left").withColumn("n_tables", F.coalesce("n_tables", F.lit(0).cast("bigint")))
