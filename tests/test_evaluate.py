import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from schemaloom.operators import evaluate, matching, vocab
from schemaloom.streaming import results

BAG = "qid int, a int, b string, pos int"


def match(spark, gold, pred, **kw):
    g, p = spark.createDataFrame(gold, BAG), spark.createDataFrame(pred, BAG)
    return {r.qid: r.execution_accuracy for r in evaluate.execution_match(g, p, ["a", "b"], **kw).collect()}


def test_bags(spark):
    gold = [(1, 1, "x", 0), (1, 1, "x", 1), (2, 1, "x", 0), (3, None, "x", 0), (4, 1, "x", 0), (4, 2, "y", 1)]
    pred = [(1, 1, "x", 0), (1, 1, "x", 1), (2, 1, "x", 0), (2, 1, "x", 1), (3, None, "x", 0), (4, 2, "y", 0), (4, 1, "x", 1), (5, 1, "x", 0)]
    assert match(spark, gold, pred) == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0}
    assert match(spark, gold, pred, ordered="pos") == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0}


def test_any_column_order(spark):
    g = spark.createDataFrame([(1, "u", "v"), (1, "p", "q"), (2, "u", "v"), (2, "p", "q")], "qid int, a string, b string")
    p = spark.createDataFrame([(1, "v", "u"), (1, "q", "p"), (2, "v", "u"), (2, "p", "q")], "qid int, a string, b string")
    got = evaluate.execution_match(g, p, ["a", "b"], any_column_order=True)
    assert {r.qid: r.execution_accuracy for r in got.collect()} == {1: 1, 2: 0}


def any_order_by_hand(gold, pred, ordered):
    if not gold or not pred or len(gold[0]) != len(pred[0]):
        return int(not gold and not pred)
    bag = (lambda rows: rows) if ordered else (lambda rows: sorted(rows, key=str))
    return int(any(bag(gold) == bag([tuple(r[i] for i in order) for r in pred]) for order in permutations(range(len(gold[0])))))


@pytest.mark.parametrize("seed", range(3))
def test_any_column_order_equals_trying_all(spark, seed):
    """Few values, so that columns share bags, repeat each other or are empty."""
    rng = random.Random(seed)
    gold_rows, pred_rows, want = [], [], {}
    for qid in range(120):
        width, n = rng.randint(1, 5), rng.randint(0, 4)
        gold = [tuple(rng.choice(["a", "b", None]) for _ in range(width)) for _ in range(n)]
        order = rng.sample(range(width), width)
        pred = [tuple(r[i] for i in order) for r in gold]
        if rng.random() < .5:
            rng.shuffle(pred)
        if pred and rng.random() < .4:
            k = rng.randrange(len(pred))
            pred[k] = tuple(rng.sample(pred[k], width))
        if rng.random() < .1:
            pred = pred[1:]
        gold_rows += [(qid, list(r), i) for i, r in enumerate(gold)]
        pred_rows += [(qid, list(r), i) for i, r in enumerate(pred)]
        if gold or pred:
            want[qid] = any_order_by_hand(gold, pred, qid % 3 == 0)
    schema = "qid int, cells array<string>, pos bigint"
    ordered = spark.createDataFrame([(q,) for q in range(0, 120, 3)], "qid int")
    got = matching.match_any_order(spark.createDataFrame(gold_rows, schema), spark.createDataFrame(pred_rows, schema), ordered, True)
    assert {r.qid: r.execution_accuracy for r in got.collect()} == want


def test_columns_that_only_trying_tells_apart(spark):
    """Every value occurs as often in every column and row, so colours stay equal; 15 columns would have 15! orders."""
    n = 15
    cyclic = [[str((i + j) % n) for j in range(n)] for i in range(n)]
    turned = [row[4:] + row[:4] for row in cyclic]
    other = [row[:] for row in turned]
    other[0][0], other[0][1] = other[0][1], other[0][0]
    wide = [["x"] * 9 + [None] * 6 for _ in range(3)]
    schema = "qid int, cells array<string>, pos bigint"
    gold = [(q, r, i) for q in (1, 2) for i, r in enumerate(cyclic)] + [(3, r, i) for i, r in enumerate(wide)]
    pred = [(1, r, i) for i, r in enumerate(turned)] + [(2, r, i) for i, r in enumerate(other)] + [(3, r[::-1], i) for i, r in enumerate(wide)]
    got = matching.match_any_order(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema))
    assert {r.qid: r.execution_accuracy for r in got.filter("qid <> 1").collect()} == {2: 0, 3: 1}
    total, order, orders = matching.column_orders([(i, 7, i) for i in range(4)], [(i, 7, 9 - i) for i in range(4)], 0, 99)
    assert total == 24 and len({tuple(o) for o in orders}) == 24


def test_accuracy_from_rows(spark):
    schema = "idx bigint, model string, db_id string, sql_gold string, sql_pred string"
    rows = spark.createDataFrame([
        (0, "m", "d", "select a order by a", "x"), (1, "m", "d", "select a", "x"), (2, "m", "d", "select a", None), (3, "m", "d", "select a", "x"),
        (0, "n", "d", "select a order by a", "y"), (1, "n", "d", "select a", "y")], schema)
    gold = spark.createDataFrame([("d", 0, "1", "u", 0), ("d", 0, "2", "v", 1), ("d", 1, "1", "u", 0), ("d", 1, "2", "v", 1), ("d", 2, "1", "u", 0)],
                                 "db_id string, idx bigint, a string, b string, pos int")
    pred = spark.createDataFrame([
        ("m", 0, "d", "u", "1", 0), ("m", 0, "d", "v", "2", 1), ("m", 1, "d", "v", "2", 0), ("m", 1, "d", "u", "1", 1),
        ("n", 0, "d", "2", "v", 0), ("n", 0, "d", "1", "u", 1), ("n", 1, "d", "1", "v", 0), ("n", 1, "d", "2", "u", 1)],
        "model string, idx bigint, db_id string, a string, b string, pos int")
    got = evaluate.with_accuracy(rows, gold, pred, ["a", "b"], "pos", ["model", "idx"])
    assert {(r.model, r.idx): r.execution_accuracy for r in got.collect()} == {("m", 0): 1, ("m", 1): 1, ("m", 2): 0, ("m", 3): 1, ("n", 0): 0, ("n", 1): 0}


def test_failures_and_empty_results(spark):
    attempts = spark.createDataFrame([(1, False), (2, True), (3, False)], "qid int, failed boolean")
    matches = spark.createDataFrame([(1, 0), (2, 1)], "qid int, execution_accuracy int")
    assert {r.qid: r.execution_accuracy for r in evaluate.score_attempts(attempts, matches).collect()} == {1: 0, 2: 0, 3: 1}


LOG = ("idx bigint, model string, duration_seconds double, filter_duration_seconds double, total_tokens bigint, "
       "execution_accuracy int, db_id string, sql_gold string, sql_pred string")


def log(spark):
    return spark.createDataFrame([
        (0, "m", 1.0, 0.5, 10, 1, "d", "select a from t JOIN u", "select * from SYN"),
        (1, "m", 3.0, None, 30, 0, "d", "select a from t", "select * from t"),
        (2, "n", 2.0, None, 20, 0, "e", "select joined from t", None),
    ], LOG)


def test_report(spark):
    synthetic = spark.createDataFrame([("d", "Syn"), ("e", "t")], "db_id string, table_name string")
    rows = {r.model: r for r in evaluate.evaluation_report(log(spark), synthetic, ["model"], ["model", "idx"]).collect()}
    m, n = rows["m"], rows["n"]
    assert (m.n, m.exa, m.seconds, m.tokens) == (2, 50.0, 2.25, 20.0)
    assert (m.n_correct, m.seconds_correct, m.tokens_correct) == (1, 1.5, 10.0)
    assert (m.n_join, m.exa_join, m.seconds_join, m.n_synthetic, m.exa_synthetic) == (1, 100.0, 1.0, 1, 100.0)
    assert (n.n_correct, n.seconds_correct, n.n_join, n.exa_join, n.n_synthetic, n.exa_synthetic) == (0, None, 0, None, 0, None)


def test_variants_share_question_ids(spark):
    """A response counts for its own variant only, and gold is attached once."""
    rows = spark.createDataFrame([
        (0, "m", 1.0, None, 1, 1, "d", "g", "select * from syn"), (0, "n", 1.0, None, 1, 1, "d", "g", "select * from t"),
    ], LOG)
    synthetic = spark.createDataFrame([("d", "Syn")], "db_id string, table_name string")
    key = ["model", "idx"]
    got = {r.model: r.n_synthetic for r in evaluate.evaluation_report(rows, synthetic, ["model"], key).collect()}
    assert got == {"m": 1, "n": 0}
    assert evaluate.attach_gold(rows.drop("sql_gold"), rows).count() == 2
    asked = spark.createDataFrame([("m", 0), ("n", 0), ("o", 0)], "model string, idx bigint")
    assert [r.model for r in evaluate.pending(asked, rows, key).collect()] == ["o"]


def test_stream_resumes_and_takes_records_once(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    rows = log(spark).drop("db_id", "sql_gold", "sql_pred")
    rows.filter("idx < 2").coalesce(1).write.parquet(source)

    def run():
        results.ingest(spark.readStream.schema(rows.schema).parquet(source), work, ["model"], ["model", "idx"])
        return {r.model: (r.n, r.exa, r.seconds) for r in results.current_metrics(spark, work, ["model"]).collect()}

    assert run() == {"m": (2, 50.0, 2.25)}
    rows.coalesce(1).write.mode("append").parquet(source)
    want = {r.model: (r.n, r.exa, r.seconds) for r in evaluate.overall_metrics(rows, ["model"]).collect()}
    assert run() == want
    assert run() == want


def test_replayed_batches_and_late_duplicates(spark, tmp_path, monkeypatch):
    """Whatever is delivered again, in a replay or long after its keys were put together, is counted once."""
    monkeypatch.setattr(results, "LOOSE_BATCHES", 2)
    work, schema = str(tmp_path / "work"), "model string, idx bigint, duration_seconds double, filter_duration_seconds double, total_tokens bigint, execution_accuracy int"
    rng, sent = random.Random(2), []
    for batch_id in range(8):
        fresh = [("m" if i % 2 else None, batch_id * 10 + i, 1.0, None, 5, i % 2) for i in range(6)]
        again = rng.sample(sent, min(len(sent), 7))
        sent += fresh
        rows = spark.createDataFrame(fresh + fresh[:2] + again, schema)
        results.accept(rows, batch_id, work, ["model"], ["model", "idx"], buckets=3)
        if batch_id in (0, 3, 5):  # stopped before the batch was committed
            results.accept(rows.repartition(3), batch_id, work, ["model"], ["model", "idx"], buckets=3)
    got = {r.model: (r.n, r.exa) for r in results.current_metrics(spark, work, ["model"]).collect()}
    assert got == {"m": (24, 100.0), None: (24, 0.0)}
    stored = spark.read.parquet(f"{work}/records")
    assert stored.count() == stored.select("model", "idx").distinct().count() == len(sent)
    assert spark.read.parquet(f"{work}/keys/upto=6").count() == 7 * 6


def test_redelivered_log(spark):
    rows = log(spark).withColumn("level", F.lit(1)).withColumn("size", F.lit(0)).withColumn("filter", F.lit("none"))
    many = rows.crossJoin(spark.range(30).withColumnRenamed("id", "n")).withColumn("idx", F.col("idx") + 10 * F.col("n")).drop("n")
    got = {r.model: (r.n, r.exa, r.seconds) for r in results.redelivered_metrics(spark, many, ["model"]).collect()}
    assert got == {r.model: (r.n, r.exa, r.seconds) for r in evaluate.overall_metrics(many, ["model"]).collect()}


def test_deliveries_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "shared_dir", lambda _, purpose: str(tmp_path / purpose))
    rows = log(spark).withColumn("level", F.lit(1)).withColumn("size", F.lit(0)).withColumn("filter", F.lit("none"))
    many = rows.crossJoin(spark.range(0, 40, 1, 4).withColumnRenamed("id", "n")).withColumn("idx", F.col("idx") + 10 * F.col("n")).drop("n")
    got = {r.model: (r.n, r.exa) for r in results.redelivered_metrics(spark, many, ["model"]).collect()}
    assert got == {r.model: (r.n, r.exa) for r in evaluate.overall_metrics(many, ["model"]).collect()}
    assert len(list((tmp_path / "deliveries").glob("part-*"))) > 5
    assert len(list((tmp_path / "redelivered" / "sums").glob("batch=*"))) == 5


def test_vocabulary(spark):
    lexicon = spark.createDataFrame([
        ("Bank", "noun.artifact", 5.0), ("bank", "noun.act", 5.0), ("river", "noun.location", 2.0), ("river", "noun.act", 2.0),
        ("common", "noun.act", 4.5), ("edge", "noun.act", 4.0), ("ab1c", "noun.act", 1.0), ("abc", "noun.act", 1.0), ("été_x", "noun.act", 1.0), ("étés", "noun.act", 1.0),
    ], "word string, lexname string, zipf double")
    allowed = spark.createDataFrame([("bank",)], "word string")
    assert {r.word for r in vocab.clean_vocabulary(lexicon, allowed).collect()} == {"bank", "edge", "étés"}
