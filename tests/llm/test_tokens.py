"""Byte-level BPE and token files against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from schemaloom.llm import bpe, queries, token_files

FOLDER = "/root/testdata/sf0.001"
PARTS = ["a", "ab", "the", " ", "  ", "\n", "\t", "\xa0", " ", "é", "ñ", "'s", "'LL", "1", "23", "ab1", "!", "?!", "日本", "\x1c", "\x85",
         "🙂", "é", "ſ", "K", "²", "İ", "ΑΣ", "<|endoftext|>", "word.", "word,,", "_", "x_y", "|", "THE"]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_files.VOCABULARY)


def texts(n=400, seed=1):
    rng = random.Random(seed)
    out = ["".join(rng.choices(PARTS, k=rng.randint(0, 50))) for _ in range(n)] + [" ".join(rng.choices(PARTS, k=rng.randint(1, 50))) for _ in range(n)]
    return out + ["", None, "a" * 5000, "ab" * 3000, " " * 4000, "\n \n" * 500, "the " * 20_000]


def test_merge_replay_equals_tiktoken(tik):
    encoder = bpe.Encoder(bpe.VOCABULARY, P.PATTERN, remembered=300)  # forgets all the time
    rows = texts()
    for at in range(0, len(rows), 50):
        for t, got in zip(rows[at:at + 50], encoder.encode(rows[at:at + 50])):
            assert got == np.array(tik.encode_ordinary(t or ""), "<u4").tobytes(), repr(t)[:80]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_merge_replay_on_any_text(text):
    ids = bpe.Encoder(bpe.VOCABULARY, P.PATTERN).encode([text])[0]
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    assert np.frombuffer(ids, "<u4").tolist() == want


def test_lower_rank_made_by_a_merge_goes_first():
    """'abc' is a token of lower rank than 'bc': once 'bc' is merged, 'a' + 'bc' precedes further merges of 'bc'."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"bcbc": 258}
    path = "test-ranks"
    bpe_ranks, pairs = bpe.load_ranks, bpe.load_pairs
    try:
        bpe.load_ranks = lambda p: ranks
        encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = [b"abcbc", b"bcbcbc", b"abcabcbcbc", b"cbcbab"]
        got = bpe.replay_merges(words, path)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [encoding.encode_ordinary(w.decode()) for w in words]
    finally:
        bpe.load_ranks, _ = bpe_ranks, pairs
        bpe.load_pairs.cache_clear()


def test_pair_tables_of_a_rank_hold_all_its_pairs():
    before, after, _, _ = bpe.load_pairs(bpe.VOCABULARY)
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    found = {(x, y): r for y, own in before.items() for x, r in own.items()}
    assert found == {(x, y): r for x, own in after.items() for y, r in own.items()}
    tokens = bpe.load_tokens(bpe.VOCABULARY)
    assert all(ranks[tokens[x] + tokens[y]] == r for (x, y), r in found.items())


def test_parts_equal_whole_texts(library):
    encoder = token_files.Encoder(token_files.VOCABULARY, remembered=300)
    rows = texts(seed=2)
    for at in range(0, len(rows), 50):
        for t, got in zip(rows[at:at + 50], encoder.encode(rows[at:at + 50])):
            assert got == np.array(library.encode(t or "", add_special_tokens=False).ids, encoder.width).tobytes(), repr(t)[:80]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_variable_length_round_trip(values):
    values = np.array(values, np.uint32)
    control, data = token_files.pack(values)
    assert len(control) == -(-len(values) // 4)
    assert token_files.unpack(control, data, len(values)).tolist() == values.tolist()


def test_small_values_take_one_byte():
    control, data = token_files.pack(np.arange(256))
    assert (len(control), len(data)) == (64, 256)


def test_files_hold_every_case(spark, library):
    rows = [(5, "b b"), (None, "no id"), (1, None), (5, "a"), (2, ""), (9, "long " * 5000), (1, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = [tuple(r) for r in token_files.write_and_read(docs).orderBy("start").select("doc_id", "start", "n_tokens").collect()]
    sizes = {t: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows}
    assert [g[0] for g in got] == [None, 1, 1, 2, 5, 5, 9]
    assert [g[2] for g in got] == [sizes["no id"], 1, 1, 1, *sorted([sizes["a"], sizes["b b"]]), sizes["long " * 5000]] or sorted(g[2] for g in got) == sorted(sizes[t] for _, t in rows)
    assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got]).tolist()[:-1]]
    assert token_files.write_and_read(docs.limit(0)).count() == 0


def test_queries_equal_the_libraries(spark, tik, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op6_byte_bpe"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = tik.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    start = 0
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_token_files"](spark, FOLDER).collect()}
    for d in sorted(docs):
        ids = [*library.encode(docs[d], add_special_tokens=False).ids, 1]
        r = found[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encode_passes_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 7, None), (1, None, 8, 1.5)], "doc_id int, text string, N_TOKENS int, other double")
    out = bpe.decode(bpe.encode(docs))
    assert sorted(out.columns) == ["decoded", "doc_id", "n_tokens", "other", "text"]
    assert {(r["text"], r["n_tokens"], bytes(r["decoded"])) for r in out.collect()} == {("a b", 2, b"a b"), (None, 0, b"")}
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_new_pieces_are_replayed_in_bounded_runs(monkeypatch):
    """Memory of a replay goes by its bytes, so a run of many new pieces is cut; one long piece is whole."""
    rng = random.Random(9)
    words = ["".join(rng.choices("bcdfghjkqxz", k=rng.randint(5, 30))) for _ in range(400)] + ["q" * 900]
    text = " ".join(words)
    whole = bpe.Encoder(bpe.VOCABULARY, P.PATTERN).encode([text, None])
    seen, replay = [], bpe.replay_merges
    monkeypatch.setattr(bpe, "REPLAYED", 500)
    monkeypatch.setattr(bpe, "replay_merges", lambda raws, path: (seen.append(raws), replay(raws, path))[1])
    assert bpe.Encoder(bpe.VOCABULARY, P.PATTERN).encode([text, None]) == whole
    assert len(seen) > 5 and all(sum(map(len, raws)) <= 500 or len(raws) == 1 for raws in seen)
