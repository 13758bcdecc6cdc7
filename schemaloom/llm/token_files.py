"""Token ids in compact files: frequency ranks in variable-length bytes.

Texts are encoded with a tokenizers-library vocabulary and an end id is added.
Ids are replaced by their rank by frequency over the whole corpus, so common ids
take one byte. Ranks are stored with 1 to 4 little-endian bytes each; the byte
counts are kept apart, two bits each, four to a control byte. Decoding looks the
four byte counts of a control byte up in a table and gathers all values at once.

Container: a Parquet folder of blocks of whole documents in ascending id order,
    shard, block, first (tokens of the shard before the block), n_tokens,
    doc_ids (int64), lengths (uint32), control, data (bytes)
and a folder with the id of every rank. Spark's commit protocol keeps it whole
when executors are lost, and any store that Spark reaches can hold it.

Defined cases: null text is empty and holds the end id only; rows with a null id
come first; rows with equal ids are ordered by their tokens; an empty table gives
empty folders; a long text makes its block longer.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from schemaloom.llm.arrow import Memory, add_columns, as_text, pieces
from schemaloom.session import materialize, shared_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Tokens after which a block is closed.
BLOCK_TOKENS = 1 << 19
#: Bytes of encoded ids that one shard is planned for, and the most shards.
SHARD_BYTES = 8 << 20
MOST_SHARDS = 10_000
REMEMBERED = 400_000
LONG_CHUNK = 64
BLOCK_SCHEMA = "shard int, block int, first long, n_tokens long, doc_ids binary, null_ids long, lengths binary, control binary, data binary"

#: ASCII signs behind a letter and before white space or the end. The vocabulary's pattern always cuts in front of them.
_SIGNS = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])([!-&(-/:-;=?@\[-`{}~]+)(?=[ \n]|$)")


def cut(text: str | None) -> list[str]:
    """Parts of a text that can be encoded on their own: the vocabulary never joins across a space or line feed.

    Latin-1 texts are lower-cased first, as the vocabulary does itself (they hold no
    characters whose lower case depends on others, and no marks to compose).
    """
    if not text:
        return []
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    else:
        text = _SIGNS.sub(r" \1", text.lower())
    return text.replace("\n", " ").split(" ")


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The tokenizer, and which of its ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    if suffix:
        last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return tokenizer, last


class Encoder:
    """Whole texts to ids, part by part; one per task."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        (self.tokenizer, self.last), self.memory = load_tokenizer(path), Memory(remembered)
        self.width = "<u2" if len(self.last) <= 1 << 16 else "<u4"

    def one_by_one(self, parts: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return {p: np.array(e.ids, dtype=self.width).tobytes() for p, e in zip(parts, found)}

    def library(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part. Words of letters are encoded as one text and told apart by the ids that end a word."""
        words = [p for p in parts if p.isalpha()]
        out = self.one_by_one([p for p in parts if not p.isalpha()])
        for k in range(0, len(words), 2000):
            own = words[k:k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own):
                packed, cuts = ids.astype(self.width).tobytes(), (ends * int(self.width[-1])).tolist()
                out.update(zip(own, (packed[i:j] for i, j in zip([0, *cuts], cuts))))
            else:  # a letter was normalised into something that is none
                out.update(self.one_by_one(own))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [cut(t) for t in texts]
        parts = set().union(*split)
        self.memory.turn()
        new = self.memory.recall(parts)
        known = self.memory.new
        known.update(self.library(list(new)))
        out = [b"".join([known[p] for p in own]) for own in split]
        for p in [p for p in new if len(p) > LONG_CHUNK]:
            del known[p]
        return out


def encode(df: DataFrame, text: str = "text", path: str = VOCABULARY, end_id: int = END_ID, ids: str = "ids") -> DataFrame:
    """Append the ids with the end id: little-endian unsigned integers of 16 bits, or of 32 for vocabularies that need them."""

    def make():
        encoder = Encoder(path)
        end = np.array([end_id], dtype=encoder.width).tobytes()
        return lambda texts: [[x + end for x in encoder.encode(texts)]]

    return add_columns(df, text, [(ids, BinaryType())], make)


# --- variable-length bytes ----------------------------------------------------
_LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    n = len(values)
    sizes = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = sizes - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = values.view(np.uint8).reshape(n, 4)
    return control.tobytes(), raw[np.arange(4, dtype=np.uint8) < sizes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(n)


# --- files ----------------------------------------------------------------------
def encode_and_count(rows: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids, counts): ids of every row, and one more row per task with how often it saw each id."""

    def run(batches):
        encoder = Encoder(path)
        end = np.array([end_id], dtype=encoder.width).tobytes()
        total = np.zeros(max(len(encoder.last), end_id + 1), np.int64)
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
                for k in range(0, len(ids), 64):
                    seen = np.bincount(np.frombuffer(b"".join(ids[k:k + 64]), dtype=encoder.width))
                    total[:len(seen)] += seen
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, counts binary")


def frequency_ranks(counts: DataFrame) -> tuple[np.ndarray, int]:
    """Ids by falling frequency over all tasks (ties: smaller id first), and the number of all ids."""

    def add(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                own = np.frombuffer(raw, np.int64)
                total = own + (total if len(total) else 0)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    sums = counts.select("counts").where("counts is not null").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = sums.toPandas().sort_values(["n", "id"], ascending=[False, True])  # one row per vocabulary id at most
    return table["id"].to_numpy(np.int64), int(table["n"].sum())


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode every text and write blocks in ascending id order below ``folder``."""
    spark = docs.sparkSession
    rows = as_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text")
    width = Encoder(path).width
    stored = materialize(encode_and_count(rows, path, end_id), "token-ids")
    by_rank, total = frequency_ranks(stored)
    encoded = stored.where("counts is null").select("doc_id", "ids")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    shards = min(MOST_SHARDS, max(1, total * int(width[-1]) // SHARD_BYTES))
    cuts = encoded.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 100 * shards)).first()[0] if shards > 1 else []
    cuts = np.unique(np.asarray(cuts or [], np.int64))
    held = spark.sparkContext.broadcast((rank_of, cuts))

    def place(batches):
        """Shard of every row."""
        _, cuts = held.value
        for batch in batches:
            ids = batch.column(0)
            shard = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            shard[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, batch.column(1)], names=["shard", "doc_id", "ids"])

    size = int(width[-1])

    def blocks(batches):
        rank_of, _ = held.value
        now, docs, held_ids, tokens = None, [], [], 0
        block = first = 0

        def flush():
            nonlocal block, first
            ids = np.frombuffer(b"".join(held_ids), dtype=width)
            control, data = pack(rank_of[ids])
            lengths = np.fromiter((len(x) // size for x in held_ids), "<u4", len(held_ids))
            out = pa.RecordBatch.from_pylist([{
                "shard": now, "block": block, "first": first, "n_tokens": len(ids),
                "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "null_ids": sum(d is None for d in docs),
                "lengths": lengths.tobytes(), "control": control, "data": data,
            }], schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.int64()), ("lengths", pa.binary()), ("control", pa.binary()), ("data", pa.binary())]))
            block, first = block + 1, first + len(ids)
            return out

        for batch in batches:
            for shard, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if docs and (shard != now or tokens >= BLOCK_TOKENS):
                    yield flush()
                    docs, held_ids, tokens = [], [], 0
                if shard != now:
                    now, block, first = shard, 0, 0
                docs.append(d)
                held_ids.append(ids)
                tokens += len(ids) // size
        if docs:
            yield flush()

    placed = encoded.mapInArrow(place, "shard int, doc_id long, ids binary")
    ordered = placed.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (tokens of all documents before it), n_tokens, ids (uint32 bytes)."""
    by_rank = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    files = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").toPandas()  # MOST_SHARDS rows at most
    base = dict(zip(sums["shard"].tolist(), np.concatenate([[0], np.cumsum(sums["n"].to_numpy(np.int64))])[:-1].tolist()))
    held = spark.sparkContext.broadcast((by_rank, base))

    def run(batches):
        by_rank, base = held.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank[unpack(row["control"], row["data"], row["n_tokens"])].astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                docs = np.frombuffer(row["doc_ids"], "<i8")
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, mask=np.arange(len(docs)) < row["null_ids"]),
                    pa.array(base[row["shard"]] + row["first"] + ends - lengths), pa.array(lengths),
                    pa.array([raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())], pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    folder = shared_dir(docs.sparkSession, "token-files")
    write(docs, folder, doc_id, text, path, end_id)
    return read(docs.sparkSession, folder)
