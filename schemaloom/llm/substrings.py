"""Removal of repeated passages: windows of words that start in an earlier document.

1. Every window of ``width`` words has a key, the smallest hash of the ``GRAM``-word
   grams inside it. Equal windows have equal keys, and neighbouring windows mostly
   share one, so the keys of a text are few: one per run of windows with the same
   key. Per-task count-min sketches of the keys are merged; the count of a window's
   key overestimates the number of documents that hold the window.
2. Windows estimated repeated - no other can be - are grouped exactly by a 128-bit
   hash: partial aggregation gives the smallest document id of each, and a join
   gives every later document its positions.
3. Words covered by those windows go; the others are joined by one space.

Exact copies of a text with a smaller id lose all their words if they have a
window, which needs no grouping: up to ``MOST_COPIES`` of them are set aside by a
broadcast list of 64-bit hashes of (id, text). Further copies take the general way, with
the same result.

Defined cases: null text has no words; rows with a null id neither lose words nor
count as earlier; rows that repeat an id and a text get equal results; rows with
one id and different texts are kept apart; texts shorter than a window stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm import sketch
from schemaloom.llm.arrow import as_text, pieces
from schemaloom.llm.hashing import Words, hash_words, text_slices, window_hashes

WIDTH = 13
GRAM = 7
SKETCH_ROWS = 2
MOST_COPIES = 1_000_000


def window_keys(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest gram hash inside the window from each word on, and whether there is a window."""
    gram = min(GRAM, width)
    grams, _ = window_hashes(words, gram, 5)
    n = len(grams)
    keys = grams.copy()
    for k in range(1, width - gram + 1):
        np.minimum(keys[:n - k], grams[k:], out=keys[:n - k])
    last = np.repeat(words.first[1:], words.counts())
    return keys, np.arange(n) + width <= last


def sketched_keys(batch: pa.RecordBatch, width: int):
    for _, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text"))):
        words = hash_words(data, offsets, lower=False)
        keys, inside = window_keys(words, width)
        first = inside.copy()
        row = words.row_of()
        first[1:] &= (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
        yield keys[first]


def copies(docs: DataFrame, limit: int) -> np.ndarray:
    """Sorted hashes of (id, text) of at most ``limit`` documents whose text an earlier document has."""
    key = [F.xxhash64("text").alias("a"), F.md5("text").alias("b")]
    ids = docs.where("text is not null and doc_id is not null").select("doc_id", "copy_key", *key)
    first = ids.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first")
    later = ids.join(first, ["a", "b"]).where("doc_id > first").select("copy_key").limit(limit)
    return np.sort(later.toPandas()["copy_key"].to_numpy(np.int64))


def _is_in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def repeated_positions(docs: DataFrame, width: int = WIDTH, log2_cells: int = sketch.LOG2_CELLS, set_aside: np.ndarray | None = None) -> DataFrame:
    """(doc_id, mark, starts): word positions where a window starts that an earlier document has.

    ``docs`` has doc_id (long), text, mark (32-bit hash of the text) and copy_key (hash of both).
    """
    spark = docs.sparkSession
    known = set_aside if set_aside is not None else np.empty(0, np.int64)
    aside = spark.sparkContext.broadcast(known)

    def kept(batch):
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        keys = batch.column(batch.schema.get_field_index("copy_key"))
        use = ids.is_valid().to_numpy(zero_copy_only=False) & ~_is_in(keys.to_numpy(zero_copy_only=False), aside.value)
        return batch.filter(pa.array(use))

    parts = sketch.collect_keys(docs.select("doc_id", "copy_key", "text"), lambda b: sketched_keys(kept(b), width), SKETCH_ROWS, log2_cells)
    bits = spark.sparkContext.broadcast(sketch.merge(parts, SKETCH_ROWS, log2_cells))

    def candidates(batches):
        for batch in batches:
            batch = kept(batch)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, data, offsets in text_slices(batch.column(2)):
                words = hash_words(data, offsets, lower=False)
                keys, inside = window_keys(words, width)
                own = np.flatnonzero(inside)
                own = own[sketch.repeated(bits.value, keys[own], log2_cells)]
                a, _ = window_hashes(words, width, 1)
                b, _ = window_hashes(words, width, 2)
                row = words.row_of()[own]
                yield pa.RecordBatch.from_arrays([
                    pa.array(a[own].view(np.int64)), pa.array(b[own].view(np.int64)), pa.array(ids[at + row]),
                    pa.array(marks[at + row] << 32 | (own - words.first[row])),
                ], names=["a", "b", "doc_id", "place"])

    found = docs.select("doc_id", "mark", "text", "copy_key").mapInArrow(candidates, "a long, b long, doc_id long, place long")
    first = found.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").drop("last")
    later = found.join(first, ["a", "b"]).where("doc_id > first")
    mark = F.shiftright("place", 32).cast("int")
    return (later.select("doc_id", mark.alias("mark"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"))
            .groupBy("doc_id", "mark").agg(F.collect_list("start").alias("starts")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                   log2_cells: int = sketch.LOG2_CELLS, most_copies: int = MOST_COPIES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) per row."""
    rows = as_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.hash("text")).withColumn("copy_key", F.xxhash64("doc_id", "text"))
    known = copies(rows, most_copies)
    starts = repeated_positions(rows, width, log2_cells, known)
    aside = docs.sparkSession.sparkContext.broadcast(known)

    def cut(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids, n_words, n_removed, kept = batch.column(0), [], [], []
                gone = _is_in(batch.column(3).to_numpy(zero_copy_only=False), aside.value) & ids.is_valid().to_numpy(zero_copy_only=False)
                for copy, t, own in zip(gone, batch.column(1).to_pylist(), batch.column(2)):
                    words = t.encode().split()
                    n = len(words)
                    if copy and n >= width:
                        left = []
                    elif own.is_valid:
                        edges = np.zeros(n + 1, np.int32)
                        at = own.values.to_numpy(zero_copy_only=False)
                        edges[at] += 1
                        np.subtract.at(edges, at + width, 1)
                        left = [words[i] for i in np.flatnonzero(np.cumsum(edges[:n]) == 0)]
                    else:
                        left = words
                    n_words.append(n)
                    n_removed.append(n - len(left))
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    # null ids match nothing and keep their words
    placed = rows.join(starts, ["doc_id", "mark"], "left").select("doc_id", "text", "starts", "copy_key")
    return placed.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
