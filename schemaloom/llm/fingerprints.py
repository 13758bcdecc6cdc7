"""One-permutation MinHash fingerprints with b-bit storage.

Every word shingle is hashed once: the top bits of the hash choose one of ``BINS``
bins, the rest is its value, and each bin keeps its smallest value. An empty bin
takes the value of the first non-empty bin in its own fixed random sequence of bins
(optimal densification), so the share of equal bins estimates the Jaccard
similarity of two shingle sets without bias. Only the low ``BITS`` bits of each
value are stored; chance agreement of stored bits, 2**-BITS, is corrected for.

Defined cases: null is the empty text; a text without words has the fingerprint ''
which is like another '' (1) and unlike all others (0); a text with fewer words than
a shingle is one shingle; equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from schemaloom.llm.arrow import add_columns, as_text, pieces
from schemaloom.llm.hashing import hash_words, mix, shingle_hashes, text_slices

SHINGLE = 5
LOG2_BINS = 8
BINS = 1 << LOG2_BINS
BITS = 8
#: Bytes of text one ordered part is planned for, and the most parts.
PART_BYTES = 16 << 20
MOST_PARTS = 10_000

_EMPTY = np.uint64((1 << 64) - 1)


def _donors(attempt: int) -> np.ndarray:
    """The bin that each bin looks at in an attempt."""
    return (mix(np.arange(BINS, dtype=np.uint64), 500 + attempt) >> np.uint64(64 - LOG2_BINS)).astype(np.int64)


def signatures(texts: pa.Array) -> np.ndarray:
    """Rows x (1 + BINS) bytes: 1 and the stored bits of each bin; zeros for a text without words."""
    out = np.zeros((len(texts), 1 + BINS), np.uint8)
    for at, data, offsets in text_slices(texts):
        words = hash_words(data, offsets, lower=False)
        hashes, rows = shingle_hashes(words, SHINGLE)
        least = np.full((words.rows(), BINS), _EMPTY)
        bins = (hashes >> np.uint64(64 - LOG2_BINS)).astype(np.int64)
        np.minimum.at(least.reshape(-1), rows * BINS + bins, hashes & np.uint64((1 << (64 - LOG2_BINS)) - 1))
        full = least != _EMPTY
        some = np.flatnonzero(full.any(axis=1))
        least, full = least[some], full[some]
        row, bin_, attempt = *np.nonzero(~full), 0
        while len(row):
            donor = _donors(attempt)[bin_]
            hit = full[row, donor]
            least[row[hit], bin_[hit]] = least[row[hit], donor[hit]]
            row, bin_, attempt = row[~hit], bin_[~hit], attempt + 1
        out[at + some, 0] = 1
        out[at + some, 1:] = (mix(least, 3) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signature rows, 0 to 1."""
    same = (a[:, 1:] == b[:, 1:]).mean(axis=1)
    chance = 2.0 ** -BITS
    estimate = np.clip((same - chance) / (1 - chance), 0, 1)
    return np.where((a[:, 0] == 1) & (b[:, 0] == 1), estimate, (a[:, 0] == b[:, 0]).astype(float))


def written(rows: np.ndarray) -> list[str]:
    return [r[1:].tobytes().hex() if r[0] else "" for r in rows]


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of a text column as a hex string."""
    return add_columns(df, text, [(name, StringType())], lambda: lambda texts: [written(signatures(pa.array(texts, pa.large_string())))])


def in_order(docs: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """Rows in parts of ascending ids, each sorted and followed by the first row of the next part.

    ``docs`` has doc_id (long) and text. Cuts are quantiles of the ids, at most
    ``MOST_PARTS``; the rows behind a part are marked ``tail``. Null ids come first, equal
    ids are ordered by text.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    keyed = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(min(MOST_PARTS, max(1, total // part_bytes)))
    cuts = keyed.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    placed = keyed.withColumn("part", part)
    firsts = {r["part"]: r["first"] for r in placed.groupBy("part").agg(F.min("key").alias("first")).collect()}  # one row per part
    used = sorted(firsts)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the last part is followed by the first
    heads = [F.when((F.col("part") == p) & (F.col("key") == firsts[p]), F.lit(before[p])) for p in used]
    head = F.coalesce(*heads) if heads else F.lit(None).cast("int")
    both = placed.withColumn("to", F.explode(F.array_compact(F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")),
        F.when(head.isNotNull(), F.struct(head.alias("part"), F.lit(True).alias("tail")))))))
    rows = both.select(F.col("to.part").alias("part"), F.col("to.tail").alias("tail"), "key", "doc_id", "text")
    n = len(cuts) + 1
    return rows.repartitionById(n, "part").sortWithinPartitions("part", "tail", "key", "text"), n


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness to it and to the next text.

    The edit replaces the last half of a text by the beginning of the next one, in
    ascending id order; the first text follows the last.
    """
    rows = as_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text")
    ordered, _ = in_order(rows, part_bytes)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(ids, texts):
        """Results of all texts but the last, which is only the next of the one before it."""
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, texts[1:])]
        own = signatures(pa.array(texts, pa.large_string()))
        other = signatures(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(written(own[:-1])), pa.array(written(other)),
            pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        ids, texts, part, closed = [], [], None, False
        for whole in batches:
            for batch in pieces(whole, "text", 2 << 20):
                for p, tail, d, t in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                    if p != part:
                        part, closed, ids, texts = p, False, [], []
                    if closed:
                        continue
                    ids.append(d)
                    texts.append(t)
                    if tail:
                        closed = True
                        yield compare(ids, texts)
                        ids, texts = [], []
                if len(ids) > 1:
                    yield compare(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    return ordered.mapInArrow(run, schema)
