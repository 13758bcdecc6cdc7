"""Results of statements compared as bags or sequences of rows, also with columns in any order.

Columns of both results are told apart without looking at their order: a column starts with
a fingerprint of its bag of values; a row's colour sums what its cells hash to with their
columns' colours, and a column's new colour sums its cells with their rows' colours. Equal
results have equal colours, so sorting columns by colour puts both results into one order.
Columns that still share a colour are either twins (equal in every row, so that their order
does not matter) or have to be tried; only orders that exchange such columns are. Every
answer is settled by comparing the rows themselves.

Fingerprints are sums of hash halves and thus partial aggregates; tables per column are
narrow. A question with most of the rows spreads over its row values.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import factorial, prod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.session import materialize

ROUNDS = 2
#: Column orders of a question that are tried in one pass after the first one failed.
TRIED_AT_ONCE = 24
GOLD, PRED = 0, 1


def as_rows(df: DataFrame, columns: list[str], position: str | None = None) -> DataFrame:
    """qid, cells (text), pos."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    return df.select("qid", cells.alias("cells"), (F.col(position).cast("bigint") if position else F.lit(None).cast("bigint")).alias("pos"))


def cancel(gold: DataFrame, pred: DataFrame, keys: list[str], ordered: DataFrame | None = None, positions: bool = False) -> DataFrame:
    """keys, execution_accuracy of rows (keys, cells, pos): +1 for gold and -1 for predicted rows leave nothing.

    With ``positions`` rows have to stand at the same place; ``ordered`` (qid) limits that to some questions.
    """
    signed = gold.select(*keys, "cells", "pos", F.lit(1).alias("sign")).unionByName(pred.select(*keys, "cells", "pos", F.lit(-1).alias("sign")))
    if not positions:
        per_row = signed.groupBy(*keys, "cells").agg(F.sum("sign").alias("left"))
        return per_row.groupBy(*keys).agg(F.bool_and(F.col("left") == 0).cast("int").alias("execution_accuracy"))
    placed = signed.groupBy(*keys, "cells", "pos").agg(F.sum("sign").alias("left"))
    per_row = placed.groupBy(*keys, "cells").agg(F.sum("left").alias("left"), F.bool_and(F.col("left") == 0).alias("placed"))
    both = per_row.groupBy(*keys).agg(F.bool_and(F.col("left") == 0).alias("bag"), F.bool_and("placed").alias("sequence"))
    if ordered is None:
        return both.select(*keys, F.col("sequence").cast("int").alias("execution_accuracy"))
    flagged = both.join(ordered.select("qid").distinct().withColumn("_ordered", F.lit(True)), "qid", "left")
    return flagged.select(*keys, F.when(F.col("_ordered"), F.col("sequence")).otherwise(F.col("bag")).cast("int").alias("execution_accuracy"))


def _sums(h: Column) -> list[Column]:
    """Order-free sums that cannot overflow."""
    return [F.sum(F.shiftrightunsigned(h, 32)).alias("_hi"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_lo")]


def _cell(*others: Column) -> Column:
    return F.xxhash64(*others, F.col("v"), F.col("v").isNull())


def column_colours(rows: DataFrame) -> DataFrame:
    """side, qid, col, colour, twin for rows (side, qid, cells): columns with equal bags share a colour, equal columns a twin."""
    cells = rows.withColumn("_row", F.monotonically_increasing_id()).select("side", "qid", "_row", F.posexplode_outer("cells").alias("col", "v"))
    exact = F.xxhash64(F.col("_row"), F.col("v"), F.col("v").isNull())
    hi, lo = _sums(exact)
    found = cells.filter(F.col("col").isNotNull()).groupBy("side", "qid", "col").agg(
        *_sums(_cell()), F.count(F.lit(1)).alias("_n"), hi.alias("_thi"), lo.alias("_tlo"))
    return found.select("side", "qid", "col", F.xxhash64("_n", "_hi", "_lo").alias("colour"), F.xxhash64("_thi", "_tlo").alias("twin"))


def tied_questions(columns: DataFrame) -> DataFrame:
    """qid of questions with columns of one colour that are no twins."""
    return (
        columns.groupBy("side", "qid", "colour").agg(F.min("twin").alias("_a"), F.max("twin").alias("_b"))
        .filter(F.col("_a") != F.col("_b")).select("qid").distinct()
    )


def refine(rows: DataFrame, columns: DataFrame, tied: DataFrame) -> DataFrame:
    """``columns`` with colours of tied questions split by the rows that their cells stand in."""
    again = columns.join(tied, "qid", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("col", "colour")))["colour"]  # one entry per column of a result
    coloured = rows.join(again.groupBy("side", "qid").agg(listed.alias("_colours")), ["side", "qid"])
    each = F.zip_with("cells", "_colours", lambda v, c: F.xxhash64(c, v, v.isNull()))
    halves = [F.aggregate(F.transform(each, part), F.lit(0).cast("bigint"), lambda a, x: a + x)
              for part in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    cells = coloured.select("side", "qid", F.xxhash64(*halves).alias("_row"), F.posexplode_outer("cells").alias("col", "v"))
    sums = cells.filter(F.col("col").isNotNull()).groupBy("side", "qid", "col").agg(*_sums(_cell(F.col("_row"))))
    finer = again.join(sums, ["side", "qid", "col"]).select("side", "qid", "col", F.xxhash64("colour", "_hi", "_lo").alias("colour"), "twin")
    return columns.join(tied, "qid", "left_anti").unionByName(finer)


def _groups(columns: list) -> list[tuple[tuple[int, int], list[list[int]]]]:
    """((colour, size), sets of twins) in one order for equal results; columns are (col, colour, twin)."""
    sets = [(k, [c[0] for c in g]) for k, g in groupby(sorted(columns, key=lambda c: (c[1], c[2], c[0])), key=lambda c: (c[1], c[2]))]
    keyed = sorted(((colour, len(cols)), cols) for (colour, _), cols in sets)
    return [(k, [cols for _, cols in g]) for k, g in groupby(keyed, key=lambda e: e[0])]


def nth_order(items: list, n: int) -> list:
    """The n-th permutation of items."""
    items, out = list(items), []
    for k in range(len(items), 0, -1):
        at, n = divmod(n, factorial(k - 1))
        out.append(items.pop(at))
    return out


def column_orders(gold: list, pred: list, first: int, count: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of allowed orders, the order of the gold columns and some orders of the predicted ones."""
    ours, theirs = _groups(gold), _groups(pred)
    if [(k, len(s)) for k, s in ours] != [(k, len(s)) for k, s in theirs]:
        return 0, [], []
    total = prod(factorial(len(sets)) for _, sets in ours)
    orders = []
    for n in range(first, min(first + count, total)):
        order = []
        for _, sets in theirs:
            n, at = divmod(n, factorial(len(sets)))
            order += [c for cols in nth_order(sets, at) for c in cols]
        orders.append(order)
    return total, [c for _, sets in ours for cols in sets for c in cols], orders


def _orders(columns: DataFrame, first: int, count: int) -> DataFrame:
    """qid, total, gold_order, cand, pred_order; questions without an allowed order have total 0 and a null candidate."""
    entry = F.struct("col", "colour", "twin")
    sides = columns.groupBy("qid").agg(*[
        F.collect_list(F.when(F.col("side") == side, entry)).alias(name) for side, name in ((GOLD, "gold"), (PRED, "pred"))])
    kind = columns.schema["qid"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def plain(entries):
            return [(e["col"], e["colour"], e["twin"]) for e in entries]

        for frame in frames:
            out = []
            for qid, gold, pred in zip(frame["qid"], frame["gold"], frame["pred"]):
                total, order, orders = column_orders(plain(gold), plain(pred), first, count)
                out += [(qid, total, order, first + i, o) for i, o in enumerate(orders)] or [(qid, total, [], None, [])]
            made = pd.DataFrame(out, columns=["qid", "total", "gold_order", "cand", "pred_order"])
            yield made.astype({"cand": "Int64"})

    return sides.mapInPandas(run, f"qid {kind}, total bigint, gold_order array<int>, cand bigint, pred_order array<int>")


def match_any_order(gold: DataFrame, pred: DataFrame, ordered: DataFrame | None = None, positions: bool = False) -> DataFrame:
    """qid, execution_accuracy of rows (qid, cells, pos) whose columns may come in any one order, at any width."""
    sides = gold.withColumn("side", F.lit(GOLD)).unionByName(pred.withColumn("side", F.lit(PRED)))
    rows = materialize(sides, "result-rows")
    columns = materialize(column_colours(rows), "result-columns")
    for _ in range(ROUNDS):
        tied = materialize(tied_questions(columns), "tied-questions")
        if tied.isEmpty():
            break
        columns = materialize(refine(rows, columns, tied), "result-columns")
    open_columns, answers, first, count = columns, [], 0, 1
    while True:
        orders = materialize(_orders(open_columns, first, count), "column-orders")

        def turned(side: int, order: str) -> DataFrame:
            placed = rows.filter(F.col("side") == side).join(orders.filter("cand IS NOT NULL").select("qid", "cand", order), "qid")
            return placed.select("qid", "cand", F.transform(order, lambda i: F.get("cells", i)).alias("cells"), "pos")

        tried = cancel(turned(GOLD, "gold_order"), turned(PRED, "pred_order"), ["qid", "cand"], ordered, positions)
        best = tried.groupBy("qid").agg(F.max("execution_accuracy").alias("execution_accuracy"))
        state = materialize(
            orders.groupBy("qid").agg(F.max("total").alias("total")).join(best, "qid", "left")
            .select("qid", "total", F.coalesce("execution_accuracy", F.lit(0)).alias("execution_accuracy")), "matches")
        open_questions = (F.col("execution_accuracy") == 0) & (F.col("total") > first + count)
        answers.append(state.filter(~open_questions).select("qid", "execution_accuracy"))
        rest = state.filter(open_questions).select("qid")
        if rest.isEmpty():
            break
        first, count = first + count, TRIED_AT_ONCE
        open_columns = columns.join(rest, "qid", "left_semi")
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out
