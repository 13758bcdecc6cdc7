"""Lexical search against scores worked out by definition."""

import math
import random
import re

import pytest

from schemaloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, k=10):
    lists = [(doc_id, cut(text)) for doc_id, text, *_ in docs]
    lists = [(d, t) for d, t in lists if t]
    n_docs, total = len(lists), sum(len(t) for _, t in lists)
    dfs = {}
    for _, t in lists:
        for term in set(t):
            dfs[term] = dfs.get(term, 0) + 1
    out = []
    for item_id, text, *_ in items:
        scored = []
        for doc_id, t in lists:
            m = 10 + 90 * len(t) * n_docs // total
            score = 0
            for term in set(cut(text)) & set(t):
                tf = t.count(term)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * dfs[term] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, e[3], -e[0]) for rank, e in enumerate(sorted(scored)[:k], 1)]
    return out


def make(seed, docs, items):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "İ", "日本", "ab_c", "x-y", "THE", "the", "²"]
    shares = [1 / (i + 1) for i in range(len(words))]

    def text(most):
        return None if rng.random() < .03 else " ".join(rng.choices(words, shares, k=rng.randint(0, most))) + rng.choice(["", ".", " !"])

    rows = [(i if rng.random() > .02 else None, text(rng.choice([5, 5, 30, 200])), "clash") for i in range(docs)]
    rows += [(1, "w1 w2 w3", "copy")] * 30 + [(2000 + i, "w4 w40 w41", "copy") for i in range(40)] + [(3000, "w5 " * 50_000, "long")]
    asked = [(i, text(8), "clash") for i in range(items)] + [(0, "w41 w40 w4", None), (0, "unknown", None), (None, "w1", None)]
    return rows, asked


DOC, ITEM = "doc_id long, text string, score string", "item_id long, text string, rank string"


@pytest.mark.parametrize("sizes", [(lexical.BLOCK_DOCS, lexical.GROUP_TERMS), (7, lexical.GROUP_TERMS), (50, 40)])
def test_search_equals_definition(spark, sizes):
    docs, items = make(sizes[0], 300, 25)
    index = lexical.build(spark.createDataFrame(docs, DOC).repartition(3), block_docs=sizes[0])
    found = lexical.search(index, spark.createDataFrame(items, ITEM), group_terms=sizes[1])
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(by_hand(docs, items), key=str)


def test_index_holds_every_posting(spark):
    """Groups of a block give back every (term, document, tf) of its documents."""
    import numpy as np

    docs, _ = make(2, 60, 0)
    index = lexical.build(spark.createDataFrame(docs, DOC), block_docs=16)
    total = 0
    for r in index.blocks.collect():
        starts, tfs, ends, postings = (np.frombuffer(r[c], "<u4") for c in ("group_starts", "tfs", "ends", "docs"))
        sizes = np.diff(ends, prepend=0)
        total += int((tfs * sizes).sum())
        assert r.n_docs <= 16 and len(postings) == sizes.sum()
        for t, df, most in zip(range(len(starts) - 1), np.frombuffer(r.dfs, "<u4"), np.frombuffer(r.max_tfs, "<u4")):
            own = slice(starts[t], starts[t + 1])
            assert sizes[own].sum() == df and tfs[own][0] == most and (np.diff(tfs[own].astype(int)) < 0).all()
    assert total == index.terms == sum(len(cut(d[1])) for d in docs)
    assert index.documents == sum(bool(cut(d[1])) for d in docs)


def test_pruning_leaves_blocks_out():
    """A block whose bound is under the threshold is not scored."""
    import numpy as np

    items = lexical.Items(["rare common"])
    items.weights[:] = 10
    block = lexical.make_block([np.sort(items.vocabulary).tobytes()], [np.array([3, 1], "<u4").tobytes()])
    bound = items.bounds(np.frombuffer(block["terms"], "<u8"), np.frombuffer(block["max_tfs"], "<u4"), 100)
    assert bound[0] == 10 * int(lexical.impacts(np.array([3, 1]), 100).sum())


def test_empty_tables(spark):
    none_docs, none_items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x")], DOC)
    assert lexical.search(lexical.build(none_docs), none_items).collect() == []
    assert lexical.search(lexical.build(none_docs), spark.createDataFrame([(1, "a", "x")], ITEM)).collect() == []
    assert lexical.search(lexical.build(some), none_items).collect() == []
    assert [r.doc_id for r in lexical.search(lexical.build(some), spark.createDataFrame([(1, "A", "x"), (2, None, "x")], ITEM)).collect()] == [1]
