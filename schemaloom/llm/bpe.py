"""Byte-level BPE by merge replay, and decoding.

A run of texts is cut into pieces by the vocabulary's pattern. The distinct
pieces that a task has not met before are laid out as one sequence of byte
tokens, and an inverted index maps the rank of every adjacent pair that can merge
to its positions. Merges are replayed in rank order over a run of pieces at once: the
lowest rank is taken from the index, each of its positions is merged, and only
the two neighbours of a merged position are looked at again. Texts are then read
off a piece -> ids table, so work is per distinct piece and not per occurrence.

Defined cases: null and empty texts have no ids; any byte sequence can be
encoded, since all 256 bytes are tokens; a text of one huge piece is one row of
the index; equal texts have equal ids; rows are independent of one another.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, LongType

from schemaloom.llm.arrow import Memory, add_columns, as_text, pieces

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces in each half of a task's memory.
REMEMBERED = 350_000
#: Bytes of new pieces that are replayed at once; a longer piece is replayed on its own.
REPLAYED = 1 << 18
#: Longer pieces are not remembered.
LONG_PIECE = 64

#: White space of the vocabulary's pattern (Unicode White_Space).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the pattern goes on from other characters into white space, so a
#: text can be cut there and the parts matched on their own.
_CUT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")

#: Parts that the public pattern cuts in a known way: letters, or letters and signs behind them.
_WORD_AND_SIGNS = re.compile(r"( ?[^\W\d_]+)([!-/:-@\[-`{-~]+)")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def load_tokens(path: str) -> list[bytes]:
    """Bytes of each id; unused ids are empty."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@lru_cache(maxsize=4)
def load_pairs(path: str) -> tuple[dict[int, dict[int, int]], dict[int, dict[int, int]], np.ndarray, np.ndarray]:
    """Ranks of the pairs of ids that merge, by right and left id and by left and right id, the id of each byte, and the ranks of pairs of bytes.

    While one rank is replayed all pairs looked up have its id on one side, so that one small table is used at a time.
    """
    ranks = load_ranks(path)
    before, after = {}, {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                before.setdefault(right, {})[left] = after.setdefault(left, {})[right] = rank
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    of_bytes = np.array([[after.get(int(x), {}).get(int(y), -1) for y in single] for x in single], np.int64)
    return before, after, single, of_bytes


def replay_merges(words: list[bytes], path: str) -> list[bytes]:
    """Ids of each word after all merges, as little-endian unsigned 32-bit integers.

    If a merge makes a pair of a lower rank than the one being replayed, the rest of
    that word waits until the lower rank has been replayed.
    """
    if not words:
        return []
    ranks_before, ranks_after, single, of_bytes = load_pairs(path)
    # One sequence of tokens; a position of its own (token -1) stands between words.
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    ends = np.cumsum(sizes) - 1
    start = single[raw]
    start[ends] = -1
    now = np.full(len(raw), -1, np.int64)
    now[:-1] = of_bytes[raw[:-1], raw[1:]]
    now[ends] = -1
    now[ends - 1] = -1
    mergeable = np.flatnonzero(now >= 0)
    mergeable = mergeable[np.argsort(now[mergeable], kind="stable")]
    found, first = np.unique(now[mergeable], return_index=True)
    #: The inverted index: rank of a pair -> positions where the pair starts (or has started).
    index = dict(zip(found.tolist(), (x.tolist() for x in np.split(mergeable, first[1:]))))
    queue = sorted(index)
    tok, rank_at = start.tolist(), now.tolist()
    after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
    push, none = heapq.heappush, {}
    while queue:
        rank = heapq.heappop(queue)
        waiting: set[int] = set()
        spots = index.pop(rank)
        look_before, look_after = ranks_before.get(rank, none).get, ranks_after.get(rank, none).get
        if len(spots) > 1:
            spots.sort()
        for p in spots:
            if rank_at[p] != rank:
                continue
            if waiting and int(np.searchsorted(ends, p)) in waiting:
                if rank not in index:
                    index[rank] = []
                    push(queue, rank)
                index[rank].append(p)
                continue
            gone = after[p]
            then = after[gone]
            tok[p], rank_at[gone] = rank, -1
            tok[gone] = -2
            after[p], before[then] = then, p
            back = before[p]
            # the two neighbours: a separator (-1) is in no pair
            r = rank_at[back] = look_before(tok[back], -1)
            if r >= 0:
                if r in index:
                    index[r].append(back)
                else:
                    index[r] = [back]
                    push(queue, r)
                if r < rank:
                    waiting.add(int(np.searchsorted(ends, p)))
            r = rank_at[p] = look_after(tok[then], -1)
            if r >= 0:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    push(queue, r)
                if r < rank:
                    waiting.add(int(np.searchsorted(ends, p)))
    left = np.array(tok, np.int64)
    kept = left >= 0
    counts = np.add.reduceat(kept, ends - sizes + 1)
    packed = left[kept].astype("<u4").tobytes()
    cuts = [0, *np.cumsum(4 * counts).tolist()]
    return [packed[i:j] for i, j in zip(cuts, cuts[1:])]


def runs(rest: list[tuple[str, bytes]], limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Consecutive pieces of about ``limit`` bytes: a replay holds some hundred bytes for each of them."""
    at, held = 0, 0
    for i, (_, raw) in enumerate(rest):
        if held and held + len(raw) > limit:
            yield rest[at:i]
            at, held = i, 0
        held += len(raw) + 1
    if rest:
        yield rest[at:]


class Encoder:
    """Texts to ids with a bounded memory of pieces; one per task."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED) -> None:
        self.path, self.ranks = path, load_ranks(path)
        self.pattern, self.memory = regex.compile(pattern), Memory(remembered)
        self.common = pattern == public_tokenizers.PATTERN

    def matches(self, part: str) -> list[str]:
        if self.common:
            if part.isalpha() or (part[0] == " " and part[1:].isalpha()):
                return [part]
            if (m := _WORD_AND_SIGNS.fullmatch(part)) and m[1].lstrip(" ").isalpha():
                return [m[1], m[2]]
        return self.pattern.findall(part)

    def learn(self, parts: Iterable[str]) -> None:
        """Remember the little-endian unsigned 32-bit ids of parts and of the matches in them."""
        matches = {part: self.matches(part) for part in parts}
        rest = []
        absent = self.memory.recall(set().union(*matches.values()))
        known = self.memory.new
        for m in absent:
            raw = m.encode()
            if (rank := self.ranks.get(raw)) is not None:
                known[m] = rank.to_bytes(4, "little")
            else:
                rest.append((m, raw))
        for run in runs(rest, REPLAYED):
            for (m, _), ids in zip(run, replay_merges([raw for _, raw in run], self.path)):
                known[m] = ids
        for part, ms in matches.items():
            if len(ms) > 1:
                known[part] = b"".join([known[m] for m in ms])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [_CUT.findall(t) if t else [] for t in texts]
        parts = set().union(*cut)
        self.memory.turn()
        self.learn(self.memory.recall(parts))
        known = self.memory.new
        out = [b"".join([known[part] for part in own]) for own in cut]
        for part in [p for p in parts if len(p) > LONG_PIECE]:
            del known[part]
        return out


def encode(df: DataFrame, text: str = "text", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN,
           ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """Append the ids (little-endian unsigned 32-bit integers) and their number."""

    def make():
        encoder = Encoder(path, pattern)

        def work(texts):
            packed = encoder.encode(texts)
            return [packed, [len(p) // 4 for p in packed]]

        return work

    return add_columns(df, text, [(ids, BinaryType()), (count, LongType())], make)


def decode_ids(packed: bytes | None, tokens: list[bytes]) -> bytes:
    return b"".join([tokens[i] for i in np.frombuffer(packed or b"", dtype="<u4").tolist()])


def encode_checked(df: DataFrame, text: str = "text", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The ids (``ids``), their number (``n_tokens``) and whether they decode to the text (``round_trip``) in place of the text.

    Texts are encoded and decoded in one pass, so a task has one Python worker and no text comes back from it.
    """
    df = as_text(df, text)
    keep = [c for c in df.columns if c not in (text, "ids", "n_tokens", "round_trip")]
    schema = df.select(*[f"`{c}`" for c in keep]).schema.add("ids", BinaryType()).add("n_tokens", LongType()).add("round_trip", BooleanType())

    def run(batches):
        encoder, tokens = Encoder(path, pattern), load_tokens(path)
        for batch in batches:
            for part in pieces(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                packed = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(k)) for k in keep]
                    + [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()),
                       pa.array([decode_ids(p, tokens) == (t or "").encode() for p, t in zip(packed, texts)], pa.bool_())],
                    names=[*keep, "ids", "n_tokens", "round_trip"])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str = VOCABULARY, decoded: str = "decoded") -> DataFrame:
    """Replace the ids column by the bytes they stand for; null ids decode to no bytes."""
    keep = [c for c in df.columns if c not in (ids, decoded)]
    schema = df.select(*[f"`{c}`" for c in keep]).schema.add(decoded, BinaryType())

    def run(batches):
        tokens = load_tokens(path)
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            out = [decode_ids(p, tokens) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(out, pa.binary())], names=[*keep, decoded]
            )

    return df.mapInArrow(run, schema)
