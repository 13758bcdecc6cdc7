import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.operators import retrieval, similarity
from schemaloom.plans.pipelines import PoolConfig, candidate_pool


def bm25(docs, question, k1=1.5, b=0.75, eps=0.25):
    """Scores of one database by the published formulas."""
    toks = [d.lower().replace("_", " ").split() for d in docs]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = Counter(t for d in toks for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else eps * mean for t, v in raw.items()}
    out = []
    for d in toks:
        tf = Counter(d)
        out.append(sum(idf[q] * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(d) / avg)) for q in question.lower().split() if tf[q]))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_bm25_matches_brute_force_with_zero_fill(spark, block):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)] + ["the"] * 20
    docs = {"a": [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(40)], "b": ["x y", "y", ""], "c": ["the the", "the"]}
    questions = [(0, "a", "the w1 w1 w2"), (1, "a", "unknown"), (2, "b", "x"), (3, "c", "the"), (4, "a", "w3")]
    rows = [(db, f"{db}{i}", i, t) for db, ts in docs.items() for i, t in enumerate(ts)]
    texts = spark.createDataFrame([(d, n, t) for d, n, _, t in rows], "db_id string, table_name string, text string")
    tables = spark.createDataFrame([(d, n, o) for d, n, o, _ in rows], "db_id string, table_name string, table_ord bigint")
    qs = spark.createDataFrame(questions, "idx bigint, db_id string, question string")
    got = retrieval.bm25_top_tables(texts, tables, qs, 10, block=block).collect()
    for idx, db, question in questions:
        scores = [round(s, 6) for s in bm25(docs[db], question)]
        want = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:10]
        mine = sorted((r for r in got if r.idx == idx), key=lambda r: r["rank"])
        assert [r.table_ord for r in mine] == want
        assert [r.score for r in mine] == pytest.approx([scores[i] for i in want], abs=2e-6)


def test_common_terms_bring_up_no_tables(spark):
    """A term of all tables and a rare one: only tables with the rare one, and the first block, are scored."""
    rng = random.Random(7)
    n = 600
    rows = [("a", f"t{i}", i, " ".join(["all", "some" if i % 2 else "other", *rng.choices("uvwxyz", k=rng.randint(1, 9)), *(["rare"] * 3 if i % 40 == 7 else [])])) for i in range(n)]
    texts = spark.createDataFrame([(d, t, x) for d, t, _, x in rows], "db_id string, table_name string, text string")
    tables = spark.createDataFrame([(d, t, o) for d, t, o, _ in rows], "db_id string, table_name string, table_ord bigint")
    qs = spark.createDataFrame([(q, "a", "all some rare") for q in range(5)], "idx bigint, db_id string, question string")
    pairs = retrieval.bm25_scores(texts, tables, qs, 5, block=32)
    assert pairs.select("idx", "table_ord").distinct().count() == pairs.count() < 5 * n / 4
    got = retrieval.bm25_top_tables(texts, tables, qs, 5, block=32)
    scores = [round(s, 6) for s in bm25([x for *_, x in rows], "all some rare")]
    want = sorted(range(n), key=lambda i: (-scores[i], i))[:5]
    for q in range(5):
        assert [r.table_ord for r in got.filter(F.col("idx") == q).orderBy("rank").collect()] == want


def vectors(n, seed=0, dims=8):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def cloud(spark):
    v = vectors(60)
    scopes = [0 if i < 40 else 1 for i in range(60)]
    df = spark.createDataFrame([(s, i, [float(x) for x in row]) for i, (s, row) in enumerate(zip(scopes, v))], "scope int, id bigint, vec array<float>")
    return df, scopes, v.astype(np.float64)


def test_blocks_do_not_change_dense_top(cloud):
    df, scopes, v = cloud
    for block in (7, 4096):
        got = similarity.dense_top(df, df, 4, skip_self=True, block=block).collect()
        for i in range(60):
            order = sorted((j for j in range(60) if scopes[j] == scopes[i] and j != i), key=lambda j: (-round(float(v[i] @ v[j]), 6), j))[:4]
            assert [r.right_id for r in sorted((r for r in got if r.left_id == i), key=lambda r: r["rank"])] == order


def clustered(spark, n=900, dims=6, centres=9, seed=3):
    """Clusters with some short vectors and some of length 0."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 5
    v = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * .2
    v *= rng.uniform(.5, 2, size=(n, 1))
    v[::50] *= 1e-3
    v[::90] = 0
    return v, spark.createDataFrame([("s" if i % 3 else "t", i, [float(x) for x in row]) for i, row in enumerate(v)], "scope string, id bigint, vec array<double>")


def test_dense_search_skips_rings_and_loses_nothing(spark):
    v, df = clustered(spark)
    found = similarity.dense_search(df, df, 5, skip_self=True, block=20, per_pivot=24)
    norm = np.linalg.norm(v, axis=1)
    unit = v / np.where(norm == 0, 1, norm)[:, None]
    got = {}
    for r in found.hits.collect():
        got.setdefault(r.left_id, []).append((r["rank"], r.right_id))
    sims = np.round(unit @ unit.T, 6)
    for i in range(len(v)):
        mine = [j for j in range(len(v)) if (j % 3 == 0) == (i % 3 == 0) and j != i]
        want = sorted(mine, key=lambda j: (-sims[i, j], j))[:5]
        have = [j for _, j in sorted(got[i])]
        assert [sims[i, j] for j in have] == pytest.approx([sims[i, j] for j in want], abs=2e-6)
    work = {r.scope: r.visited / r.all_pairs for r in found.work.collect()}
    assert max(work.values()) < .5


def test_band_visits_only_rings_in_the_band(spark):
    from schemaloom.operators import pivots

    v, df = clustered(spark)
    centre = spark.createDataFrame([("s", -1, [float(x) for x in v[1]]), ("t", -2, [0.0] * 6)], df.schema)
    got = {(r.left_id, r.right_id) for r in similarity.pairs_in_band(df, centre, .9, 1.0, block=20, per_pivot=24).collect()}
    norm = np.linalg.norm(v, axis=1)
    cos = v @ v[1] / (norm * norm[1] + 1e-8)
    assert got == {(i, -1) for i in range(len(v)) if i % 3 and .9 <= cos[i] <= 1.0}
    best = {r.left_id for r in similarity.pairs_in_band(df, centre, .9, .99, best=7, block=20, per_pivot=24).collect()}
    want = sorted((i for i in range(len(v)) if i % 3 and .9 <= cos[i] <= .99), key=lambda i: (-round(cos[i], 6), i))[:7]
    assert set(want) <= best
    index = pivots.build(df, per_pivot=24)
    visited = pivots.visits(centre.filter("id = -1"), index, lambda rings: F.filter(rings, lambda r: F.cos(r["least"]) >= .9))
    share = {r.scope: r.visited / r.all_pairs for r in pivots.visited_share(visited, centre.filter("id = -1"), index).collect()}
    assert share["s"] < .7


def test_blocked_band_and_ambiguity(cloud):
    df, scopes, v = cloud
    cos = v @ v.T / (1 + 1e-8)
    same = np.equal.outer(scopes, scopes)
    band = {(r.left_id, r.right_id) for r in similarity.pairs_in_band(df, df, 0.2, 0.5, block=9).collect()}
    assert band == set(zip(*np.nonzero(same & (cos >= 0.2) & (cos <= 0.5))))
    close = {r.left_id for r in similarity.close_to_any(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), 0.7, block=9).collect()}
    odd = np.arange(60) % 2 == 1
    assert close == {i for i in range(0, 60, 2) if (same[i] & odd & (cos[i] > 0.7)).any()}


def test_named_words_and_databases(spark, cloud):
    df, _, v = cloud
    words = df.select(F.concat(F.lit("w"), "id").alias("word"), "vec").filter("word <> 'w3'")
    centers = df.filter("id in (3, 4)").select(F.concat(F.lit("db"), "id").alias("db_id"), "vec")
    got = {(r.db_id, r.word) for r in similarity.word_centroid_similarity(words, centers, 0.4, 1.0).collect()}
    cos = v @ v.T / (1 + 1e-8)
    assert got == {(f"db{c}", f"w{i}") for c in (3, 4) for i in range(60) if i != 3 and cos[i, c] >= 0.4}
    assert similarity.word_centroid_similarity(words, centers, 2.0, 3.0).collect() == []


def test_centroid_is_the_mean(spark, cloud):
    df, scopes, v = cloud
    got = {r.scope: r.vec for r in similarity.centroids(df, ["scope"]).collect()}
    for s in (0, 1):
        assert got[s] == pytest.approx(list(v[np.array(scopes) == s].mean(axis=0)))


def test_bands_widen_and_clamp():
    assert PoolConfig(sim_min=0.15, sim_max=0.85).bands() == [(0.15, 0.85), (0.1, 0.9), (0.1, 0.9), (0.1, 0.9), (0.1, 0.9)]


def test_candidate_pool_follows_the_loop(spark):
    """Against the step-by-step loop, one schema with anchors and one without."""
    words, names = vectors(300, 1), vectors(50, 2)
    owner = [0] * 8 + [1] * 42
    cfg = PoolConfig(sim_min=0.3, sim_max=0.4, sim_ambiguity=0.8, min_candidates=40, max_candidates=60, anchor_k=5)
    vocabulary = spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(words)], "word bigint, vec array<float>")
    schema = spark.createDataFrame([(o, 1000 + i, [float(x) for x in n]) for i, (o, n) in enumerate(zip(owner, names))], "db_id int, word bigint, vec array<float>")
    got = candidate_pool(schema.select("db_id", "word"), schema, vocabulary, cfg).collect()

    def cos(a, b):
        return round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8)), 6)

    w64, n64 = words.astype(np.float64), names.astype(np.float64)
    for db in (0, 1):
        mine = [n64[i] for i in range(50) if owner[i] == db]
        center, taken = np.mean(mine, axis=0), set()
        if len(mine) < 30:
            near = sorted((-cos(w, center), i) for i, w in enumerate(w64) if cos(w, center) >= 0.15)[:5]
            taken = {i for _, i in near}
            mine += [w64[i] for _, i in near]
            center = np.mean(mine, axis=0)
        for low, high in cfg.bands():
            found = [(-cos(w, center), i) for i, w in enumerate(w64)
                     if i not in taken and low <= cos(w, center) <= high and not any(cos(w, m) > 0.8 for m in mine)]
            if len(found) >= 40:
                break
        want = [i for _, i in sorted(found)[:60]]
        assert [r.word for r in sorted((r for r in got if r.db_id == db), key=lambda r: r["rank"])] == want


def test_keywords_are_no_candidates(spark):
    from schemaloom.plans.pipelines import candidates_in_band

    schema = spark.createDataFrame([("d", "name", [1.0, 0.0])], "db_id string, word string, vec array<double>")
    words = [("order", [0.5, 0.8]), ("Table", [0.5, 0.8]), ("harbor", [0.5, 0.8]), ("far", [0.0, 1.0])]
    vocabulary = spark.createDataFrame(words, "word string, vec array<double>")
    assert [r.word for r in candidates_in_band(schema, vocabulary, 0.3, 0.7, 0.9).collect()] == ["harbor"]


def test_a_query_travels_once_however_many_rings_it_visits(spark):
    """one row per query, and what is kept of all rings of a part comes back together."""
    from schemaloom.operators import pivots

    v = vectors(600, seed=5)
    df = spark.createDataFrame([(0, i, [float(x) for x in row]) for i, row in enumerate(v)], "scope int, id bigint, vec array<float>")
    index = pivots.build(df, per_pivot=24)
    visited = pivots.visits(df, index, lambda rings: rings)
    assert visited.count() == 600
    assert pivots.visited_share(visited, df, index).first().visited > 20 * 600
    kept = pivots.multiply(visited, index, lambda sims, seen, q, ids: similarity._best_in_row(sims, seen, ids, 3), None, block=50)
    assert kept.count() == 3 * 3 * 600  # best 3 of each of 3 parts
    got = {(r.left_id, r["rank"]): r.right_id for r in similarity.dense_top(df, df, 3, skip_self=True, block=50).collect()}
    sims = np.round(v.astype(np.float64) @ v.T.astype(np.float64), 6)
    for i in range(0, 600, 7):
        want = sorted((j for j in range(600) if j != i), key=lambda j: (-sims[i, j], j))[:3]
        assert [sims[i, got[i, r]] for r in (1, 2, 3)] == pytest.approx([sims[i, j] for j in want], abs=2e-6)
