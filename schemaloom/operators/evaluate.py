"""Execution match, accuracy, token and latency metrics over response logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.scalars import percent, ratio, table_refs
from schemaloom.operators import matching

#: What tells one response from another: its variant and the question. ``filter`` is 'none' where there is none.
KEY = ["model", "level", "size", "filter", "idx"]


def execution_match(
    gold: DataFrame, pred: DataFrame, columns: list[str], ordered: str | None = None, any_column_order: bool = False,
    ordered_questions: DataFrame | None = None,
) -> DataFrame:
    """qid, execution_accuracy: 1 when both results are equal as bags of rows, values compared as text.

    ``ordered`` names a position column that must agree too, for all questions or for
    those in ``ordered_questions`` (qid). Only queries with a row on one side appear; use
    ``score_attempts`` to add empty and failed ones.
    """
    gold_rows, pred_rows = matching.as_rows(gold, columns, ordered), matching.as_rows(pred, columns, ordered)
    if any_column_order:
        return matching.match_any_order(gold_rows, pred_rows, ordered_questions, ordered is not None)
    return matching.cancel(gold_rows, pred_rows, ["qid"], ordered_questions, ordered is not None)


def needs_order(sql: Column) -> Column:
    """Whether a gold statement asks for an order of its rows."""
    return F.coalesce(F.lower(sql).rlike(r"\border\s+by\b"), F.lit(False))


def score_attempts(attempts: DataFrame, matches: DataFrame) -> DataFrame:
    """Accuracy per attempt (qid, failed): failures score 0, two empty results score 1."""
    return attempts.join(matches, "qid", "left").withColumn(
        "execution_accuracy",
        F.when(F.coalesce("failed", F.lit(False)), 0).otherwise(F.coalesce("execution_accuracy", F.lit(1))).cast("int"),
    )


def _seconds() -> Column:
    return F.col("duration_seconds") + F.coalesce("filter_duration_seconds", F.lit(0.0))


def overall_metrics(log: DataFrame, group: list[str]) -> DataFrame:
    """Count, accuracy, mean seconds (model plus filter) and mean tokens."""
    return log.groupBy(*group).agg(*overall_aggregates())


def overall_aggregates() -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        percent(F.sum("execution_accuracy"), n).alias("exa"),
        ratio(F.sum(_seconds()), n).alias("seconds"),
        ratio(F.sum("total_tokens"), n).alias("tokens"),
    ]


def correct_aggregates() -> list[Column]:
    right = F.col("execution_accuracy") == 1
    n = F.count_if(right)
    return [
        n.alias("n_correct"),
        ratio(F.sum(F.when(right, _seconds())), n).alias("seconds_correct"),
        ratio(F.sum(F.when(right, F.col("total_tokens"))), n).alias("tokens_correct"),
    ]


def is_join_query(sql: Column) -> Column:
    return F.lower(sql).contains(" join ")


def join_aggregates() -> list[Column]:
    """Count, accuracy and mean model seconds of questions whose gold SQL joins."""
    joins = is_join_query(F.col("sql_gold"))
    n = F.count_if(joins)
    return [
        n.alias("n_join"),
        percent(F.sum(F.when(joins, F.col("execution_accuracy"))), n).alias("exa_join"),
        ratio(F.sum(F.when(joins, F.col("duration_seconds"))), n).alias("seconds_join"),
    ]


def synthetic_aggregates() -> list[Column]:
    """Count and accuracy of predictions that read a synthetic table; null when there are none."""
    n = F.count_if("uses_synthetic")
    return [
        n.alias("n_synthetic"),
        percent(F.sum(F.when(F.col("uses_synthetic"), F.col("execution_accuracy"))), n).alias("exa_synthetic"),
    ]


def referenced_tables(log: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Key, db_id and table_name: distinct tables each predicted statement reads."""
    refs = F.explode_outer(table_refs(F.col("sql_pred")))
    return log.select(*key, "db_id", refs.alias("table_name")).filter(F.col("table_name").isNotNull())


def synthetic_references(log: DataFrame, synthetic: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys of the predictions that read a synthetic table of their database."""
    names = synthetic.select("db_id", F.lower("table_name").alias("table_name"))
    return referenced_tables(log, key).join(names, ["db_id", "table_name"], "left_semi").select(*key).distinct()


def with_synthetic_flag(log: DataFrame, synthetic: DataFrame, key: list[str] = KEY) -> DataFrame:
    hits = synthetic_references(log, synthetic, key).withColumn("uses_synthetic", F.lit(True))
    return log.join(hits, key, "left").withColumn("uses_synthetic", F.coalesce("uses_synthetic", F.lit(False)))


def with_accuracy(log: DataFrame, gold: DataFrame, pred: DataFrame, columns: list[str], position: str | None = None, key: list[str] = KEY) -> DataFrame:
    """The log with its accuracy worked out from result rows.

    ``gold`` has the rows of a question (db_id, idx), ``pred`` those of a response (``key``, db_id); the columns
    of a prediction may come in any order, and where the gold statement orders its rows the predicted
    ones have to follow (``position``). Statements that failed (null) score 0, two empty results 1.
    """
    named = F.md5(F.to_json(F.struct(*key)))
    asked = log.select("db_id", "idx", named.alias("qid"), needs_order(F.col("sql_gold")).alias("_ordered"), F.col("sql_pred").isNull().alias("failed"))
    tried = asked.filter(~F.col("failed"))
    expected = tried.select("db_id", "idx", "qid").join(gold, ["db_id", "idx"]).drop("db_id", "idx")
    given = pred.withColumn("qid", named).drop("db_id", *key)
    found = execution_match(expected, given, columns, position, True, tried.filter("_ordered").select("qid") if position else None)
    scores = score_attempts(asked.select("qid", "failed").distinct(), found).select("qid", "execution_accuracy")
    return log.drop("execution_accuracy").withColumn("qid", named).join(scores, "qid", "left").drop("qid")


def evaluation_report(log: DataFrame, synthetic: DataFrame, group: list[str], key: list[str] = KEY) -> DataFrame:
    """All metrics of a variant in one aggregate."""
    return with_synthetic_flag(log, synthetic, key).groupBy(*group).agg(
        *overall_aggregates(), *correct_aggregates(), *join_aggregates(), *synthetic_aggregates()
    )


def accuracy(log: DataFrame, group: list[str]) -> DataFrame:
    """Mean of 0/1 scores; a missing score counts as 0."""
    score = F.coalesce("execution_accuracy", F.lit(0))
    return log.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("score"))


def attach_gold(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses of all variants with the gold statement of their question, which may be listed more than once."""
    return responses.join(questions.select("db_id", "idx", "sql_gold").distinct(), ["db_id", "idx"])


def pending(asked: DataFrame, done: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Questions of a variant without a logged response of that variant."""
    return asked.join(done.select(*key).distinct(), key, "left_anti")
