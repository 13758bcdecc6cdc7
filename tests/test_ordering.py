from collections import Counter

from pyspark.sql import functions as F

from schemaloom.functions import draws
from schemaloom.operators.ordering import expand_slots, number_by_digest, number_by_id, number_in_order, running_totals, top_k


def hot(spark, n=900):
    """A group with two thirds of the rows next to small ones."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 17).cast("string"))).alias("g"),
        (F.col("id") * 37 % 10007).alias("k"),
    )


def test_number_by_id_over_bucket_edges(spark):
    df = hot(spark)
    rows = number_by_id(df, ["g"], "k", "pos", width=64).collect()
    by_group = {}
    for r in df.collect():
        by_group.setdefault(r.g, []).append(r.k)
    want = {(g, k): i for g, ks in by_group.items() for i, k in enumerate(sorted(ks))}
    assert {(r.g, r.k): r.pos for r in rows} == want


def test_number_by_digest_is_one_permutation_per_group(spark):
    df = hot(spark)
    digest = draws.digest("t", F.col("g"), F.col("k"))
    rows = number_by_digest(df, ["g"], digest, ["k"], "pos").withColumn("d", digest).collect()
    for g, n in Counter(r.g for r in rows).items():
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(n))
        assert [r.d for r in mine] == sorted(r.d for r in mine)


def test_top_k_equals_plain_ranking(spark):
    df = hot(spark)
    got = top_k(df, ["g"], [F.col("k").desc()], 5, F.col("k")).collect()
    by_group = {}
    for r in df.collect():
        by_group.setdefault(r.g, []).append(r.k)
    want = {(g, i + 1, k) for g, ks in by_group.items() for i, k in enumerate(sorted(ks, reverse=True)[:5])}
    assert {(r.g, r["rank"], r.k) for r in got} == want


def test_expand_slots_covers_blocks(spark):
    df = spark.createDataFrame([("a", 9000), ("b", 1), ("c", 0)], "g string, n bigint")
    rows = expand_slots(df, ["g"], "n").groupBy("g").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d"))
    assert {tuple(r) for r in rows.collect()} == {("a", 9000, 0, 8999, 9000), ("b", 1, 0, 0, 1)}


def test_number_in_order_and_running_totals(spark):
    """Positions and sums of a hot group that lies in several ranges, ties and sparse keys included."""
    df = hot(spark).withColumn("w", F.col("k") % 7)
    by_group = {}
    for r in df.collect():
        by_group.setdefault(r.g, []).append((r.k, r.w))
    position, total = {}, {}
    for g, rows in by_group.items():
        before = 0
        for i, (k, w) in enumerate(sorted(rows)):
            position[g, k], total[g, k] = i, before
            before += w
    assert {(r.g, r.k): r.pos for r in number_in_order(df, ["g"], [F.col("k")], "pos").collect()} == position
    assert {(r.g, r.k): r.t for r in running_totals(df, ["g"], [F.col("k")], "w", "t").collect()} == total
    whole = sorted(k for rows in by_group.values() for k, _ in rows)
    assert {r.k: r.pos for r in number_in_order(df, [], [F.col("k")], "pos").collect()} == {k: i for i, k in enumerate(whole)}
    same = df.select("g", F.lit(1).alias("k"))
    got = number_in_order(same, ["g"], [F.col("k")], "pos").collect()
    assert Counter((r.g, r.pos) for r in got) == Counter((g, i) for g, rows in by_group.items() for i in range(len(rows)))
