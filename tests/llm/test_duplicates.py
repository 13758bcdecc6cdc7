"""Jaccard groups, substring removal and fingerprints against brute force."""

import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from schemaloom.llm import fingerprints, jaccard, queries, sketch, substrings
from tools.check_oracles import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
SMALL = {"log2_cells": 16}
BOTH = {**SMALL, "log2_counts": 16}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_statements(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, cur.fetchall())


def words(text):
    return (text or "").encode().split()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """component_id of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    return [(d, len(s), min((x for x in ids[top(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed, n=120):
    """Families of edited texts, one of them large, texts that share a passage, and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.randint(1, 120))
        for _ in range(n // 3 if family == 0 else rng.randint(1, 8)):
            text = [w for w in base if rng.random() > rng.choice([0, 0.01, 0.03, 0.1])]
            if rng.random() < 0.2:
                text = text + passage
            rows.append(" ".join(text) if rng.random() < 0.5 else " ".join(text).upper())
    rows += [None, "", "  \n", "one", "ONE", "one two", "One two", "x" * 3000]
    rng.shuffle(rows)
    return [(i * 3 % 1000 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("pairs_per_posting", [8, 0])
def test_groups_equal_all_pairs(spark, monkeypatch, pairs_per_posting):
    """With 0 every comparison goes through one document of a list at a time."""
    monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", pairs_per_posting)
    rows = near_copies(4) if pairs_per_posting else near_copies(5, 30)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.components(docs, **BOTH).collect()]
    assert sorted(got) == sorted(groups(rows))


def test_full_sketch_changes_nothing(spark):
    """With hardly any cells everything counts as repeated."""
    rows = near_copies(6, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.components(docs, log2_cells=10, log2_counts=10).collect()) == sorted(groups(rows))


def test_common_passage_makes_no_pairs(spark, monkeypatch):
    """Texts that share a passage which is too short to link them are not compared pair by pair."""
    compared, similar = [], jaccard._similar
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, sets: (compared.append(pairs.count()), similar(pairs, sets))[1])
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(n, f"{passage} " + " ".join(f"own{n}x{i}" for i in range(12))) for n in range(60)]
    rows += [(100 + n, rows[n][1] + " more") for n in range(10)]
    got = sorted(tuple(r) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), **BOTH).collect())
    assert got == sorted(groups(rows))
    assert sum(compared) <= 2 * len(rows)


def test_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Many edits of one text lie in lists with each other and with texts that only hold a passage of it."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    edited = lambda: [w if rng.random() > 0.017 else f"e{rng.randint(0, 400)}" for w in base]
    rows = [(n, " ".join(edited())) for n in range(260)]
    rows += [(1000 + n, " ".join(edited()[:110] + [f"own{n % 30}x{i}" for i in range(40)])) for n in range(60)]
    met, similar = [], jaccard._similar
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, sets: (met.append(pairs.count()), similar(pairs, sets))[1])
    got = sorted(tuple(r) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), **BOTH).collect())
    assert got == sorted(groups(rows))
    assert sum(met) <= 14 * len(rows)


def test_groups_of_odd_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A B c d e f"), (None, "a b c d e f"), (None, None), (None, "lonely text"), (1, "")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, class string")
    got = sorted((tuple(r) for r in jaccard.components(docs, **BOTH).collect()), key=str)
    assert got == sorted(groups(rows), key=str)
    kept = sorted((tuple(r) for r in jaccard.keep_first(docs, **BOTH).collect()), key=str)
    assert kept == sorted([(3, "A B c d e f", "z"), (None, None, "z"), (None, "lonely text", "z"), (1, "", "z")], key=str)
    assert jaccard.components(docs.limit(0), **BOTH).count() == 0
    assert jaccard.keep_first(docs.limit(0), **BOTH).columns == docs.columns


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    batches = [keys[:2000], keys[1000:]]
    source = spark.range(2).repartition(2)
    parts = sketch.collect_keys(source, lambda b: (batches[i] for i in b.column(0).to_pylist()), 2, 16)
    bits = sketch.merge(parts, 2, 16)
    assert sketch.repeated(bits, keys[1000:2000], 16).all()
    assert sketch.repeated(bits, keys[:1000], 16).mean() < 0.1


def cut(rows, width=13):
    """Kept words by the definition."""
    windows = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[i:i + width])
                windows[k] = min(windows.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and windows[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("most_copies", [0, 2, 1000])
def test_removal_equals_definition(spark, most_copies):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)]
    passages = [rng.choices(vocabulary, k=k) for k in (13, 14, 40)]
    rows = []
    for i in range(60):
        t = rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \x0b "]).join(t)))
    rows += [(100 + i, rows[i % 5][1]) for i in range(20)]  # exact copies
    rows += [(200, None), (201, ""), (202, "x " * 5000), (203, "x " * 14), (204, rows[0][1] + "\xa0tail"), (None, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, mark int")
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs, log2_cells=16, most_copies=most_copies).collect()), key=str)
    assert got == sorted(cut(rows), key=str)
    assert substrings.remove_repeats(docs.limit(0), **SMALL).count() == 0


def test_one_id_with_two_texts(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), (2, passage + " end"), (2, "other " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in substrings.remove_repeats(docs, **SMALL).collect()}
    assert got == {(1, 20, 0, passage), (2, 21, 20, "end"), (2, 20, 0, ("other " * 20).strip())}


@pytest.mark.parametrize("most_copies", [0, 1, 1000])
def test_one_id_with_a_copy_and_another_text(spark, most_copies):
    p, q = (" ".join(f"{c}{i}" for i in range(20)) for c in "pq")
    rows = [(1, p), (2, p), (2, q), (3, q + " end"), (None, p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in substrings.remove_repeats(docs, log2_cells=16, most_copies=most_copies).collect()}
    assert got == {(1, 20, 0, p), (2, 20, 20, ""), (2, 20, 0, q), (3, 21, 20, "end"), (None, 20, 0, p)}


def test_fingerprints_estimate_jaccard():
    rng = random.Random(3)
    errors = []
    for _ in range(150):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        edit = [w for w in base if rng.random() > rng.choice([0.01, 0.05, 0.2])]
        a, b = (" ".join(x) for x in (base, edit))
        s = fingerprints.signatures(pa.array([a, b]))
        A, B = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (base, edit))
        errors.append(fingerprints.likeness(s[:1], s[1:])[0] - len(A & B) / len(A | B))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_edits_follow_the_definition(spark):
    rows = [(4, "d e f ü g"), (2, "a b c"), (None, "null id"), (9, ""), (7, None), (4, "d e f ü g"), (11, "long " * 5000), (12, "a b c")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, near_next double")
    order = sorted(((-1 if i is None else i, t or "", i) for i, t in rows), key=lambda r: r[:2])
    for part_bytes in (1 << 20, 8):
        got = fingerprints.compare_edits(docs, part_bytes=part_bytes).collect()
        want = []
        for (k, t, i), (_, n, _) in zip(order, order[1:] + order[:1]):
            e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
        assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)
        by = {}
        for r in got:
            by.setdefault(r["n_chars"], set()).add(r["fingerprint"])
        assert all(len(v) == 1 for n, v in by.items() if n in (0, 5, 9))
    assert fingerprints.compare_edits(docs.limit(0)).count() == 0
    alone = fingerprints.compare_edits(docs.where("doc_id = 2")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"a ba ").hexdigest()


def test_fingerprint_column(spark):
    docs = spark.createDataFrame([("a b",), ("a b",), (None,), (" ",)], "text string")
    got = [r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()]
    assert got[0] == got[1] != "" and got[2:] == ["", ""]
