"""Hierarchical Pitman-Yor language model over pairs of words.

Every word that comes before another one (or the start of a document) is a context with a
restaurant of its own, whose dishes are the words that follow it; all of them share one parent,
the restaurant of words without context, whose own parent is uniform over the known words and one
unknown word. Each table of a restaurant is a customer of its parent.

Seatings are sampled by Gibbs sweeps in blocks: all customers of a pair are seated
anew in the Chinese-restaurant way, given the parent's probability of the word and the
number of tables in the context's restaurant from the sweep before. Draws are hashes of (pair,
customer, sweep), so results do not depend on partitions. Predictions take the tables and the parent's
probabilities averaged over ``SAMPLES`` seatings. A text's score is the sum of the log10
probabilities of its words and one end; ``perplexity`` is 10 to minus their mean.

Pairs are dealt by a hash of both words, so no word and no context is in one task as a whole. What
belongs to a word, as a context or as a word that follows, lies with its owner, a task found by the
word's hash. A sweep is a round of messages: owners tell the holders of pairs what they ask for (pairs
met once have one table whatever is drawn, so they ask for nothing), and these tell the owners the tables drawn.
Messages are arrays of a task's whole share. Only the totals of the shared parent, two numbers a task and
sweep, reach the driver. For scoring, the ``FREQUENT`` most frequent words and pairs at most are broadcast;
what is known of all others is added as texts' pairs are sent to the tasks that hold it.

Defined cases: null and blank texts consist of the end; without training texts every
word is the unknown one; rows that repeat an id and text are scored each; words and pairs are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import math
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel, TaskContext
from pyspark.core.rdd import Partitioner
from pyspark.serializers import pack_long
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from schemaloom.llm.arrow import as_text
from schemaloom.llm.hashing import hash_words, mix, text_slices
from schemaloom.session import materialize

BURN_IN = 2
SAMPLES = 3
FREQUENT = 300_000
#: Bytes of text that a task hands to Python at once.
BATCH_BYTES = 4 << 20
#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 18
#: Pairs that a task gathers before it sends them on.
RUN = 1 << 18
#: Discount and strength of the context restaurants and of their parent.
CONTEXT = (0.6, 5.0)
PARENT = (0.6, 5.0)
#: A task reports words with at least this share of its tokens as possible contexts; see ``frequent_words`` for all others.
CONTEXT_SHARE = 1 / 4096


def _uniform(key: np.ndarray, step: int, sweep: int) -> np.ndarray:
    return (mix(key ^ np.uint64(step), 7000 + sweep) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def seat(counts: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after its ``counts`` customers sat down one by one.

    ``weight`` is the weight of a new table. The first 32 customers are drawn one at a
    time, later ones in runs of a sixteenth of those seated, within which the odds of
    a new table are held; work grows with the logarithm of the count.
    """
    tables = np.minimum(counts, 1).astype(np.float64)
    live = np.flatnonzero(counts > 1)
    seated, step = 1, 0
    while len(live):
        run = 1 if seated < 32 else seated // 16
        n = np.minimum(run, counts[live] - seated)
        odds = weight[live] / (weight[live] + seated - discount * tables[live])
        u = _uniform(key[live], step, sweep)
        if run == 1:
            more = (u < odds).astype(np.float64)
        else:
            mean, spread = n * odds, np.sqrt(n * odds * (1 - odds))
            z = np.sqrt(-2 * np.log(np.maximum(u, 1e-16))) * np.cos(2 * np.pi * _uniform(key[live], step, sweep + 500))
            # few expected tables: at most one, so that small means are kept
            more = np.where(mean < 0.5, u < mean, np.clip(np.rint(mean + spread * z), 0, n))
        tables[live] += more
        seated, step = seated + run, step + 1
        live = live[counts[live] > seated]
    return tables


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


END_HASH = np.uint64(0x5EED_0E4D_0E4D_5EED)
START_HASH = np.uint64(0x5EED_57A7_57A7_5EED)


# --- words and contexts -------------------------------------------------------------
def _documents(texts: pa.Array):
    """Per slice: first row, number of rows, and hash, row and context (the hash before it in its row) of every token, ends included, in order."""
    for at, data, offsets in text_slices(texts, SLICE_BYTES):
        words = hash_words(data, offsets, lower=True)
        rows = words.rows()
        ends = words.first[1:] + np.arange(rows)
        total = len(words.hashes) + rows
        hashes = np.full(total, END_HASH, np.uint64)
        is_end = np.zeros(total, dtype=bool)
        is_end[ends] = True
        hashes[~is_end] = words.hashes
        owner = np.repeat(np.arange(rows), words.counts() + 1)
        context = np.empty(total, np.uint64)
        context[1:] = hashes[:-1]
        context[words.first[:-1] + np.arange(rows)] = START_HASH
        yield at, rows, hashes, owner, context


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context, 3) + word


def _reported(rows: DataFrame) -> DataFrame:
    """hash, n, slack: words with a good share of a task, how often they were counted and how many uses may be missing.

    A task that leaves out words has a row without a hash: no word that it does not report occurs more than ``slack`` times
    in it. That number is taken from the slack of the words it does report, so that a word's uses are at most its ``n``
    and ``slack`` over all tasks and the slack of all rows without a hash.
    """

    def count(batches):
        keys, sums, lost, total, dropped = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
        for batch in batches:
            for _, _, hashes, _, _ in _documents(batch.column(0)):
                own, counts = np.unique(hashes[hashes != END_HASH], return_counts=True)
                total += int(counts.sum())
                merged, first, where = np.unique(np.concatenate([keys, own]), return_index=True, return_inverse=True)
                # words not held may be among those dropped before
                lost = np.where(first < len(keys), np.append(lost, 0)[np.minimum(first, len(keys))], dropped)
                sums = np.bincount(where, np.concatenate([sums, counts]), len(merged)).astype(np.int64)
                keys, keep = merged, sums * 8 >= total * CONTEXT_SHARE
                if not keep.all():
                    dropped = max(dropped, int((sums + lost)[~keep].max()))
                    keys, sums, lost = keys[keep], sums[keep], lost[keep]
        keep = sums >= total * CONTEXT_SHARE
        if not keep.all():
            dropped = max(dropped, int((sums + lost)[~keep].max()))
        kept = [None] * (dropped > 0) + keys[keep].view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([
            pa.array(kept, pa.int64()), pa.array([0] * (dropped > 0) + sums[keep].tolist(), pa.int64()),
            pa.array([dropped] * (dropped > 0) + (lost[keep] - dropped).tolist(), pa.int64())], names=["hash", "n", "slack"])

    return rows.mapInArrow(count, "hash long, n long, slack long")


def _all_counts(rows: DataFrame) -> DataFrame:
    """hash, n: uses of every word in the rows of a task."""

    def send(runs):
        own, where = np.unique(np.concatenate([x for x, _ in runs]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([n for _, n in runs]), len(own)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(counts)], names=["hash", "n"])

    def count(batches):
        runs, size = [], 0
        for batch in batches:
            for _, _, hashes, _, _ in _documents(batch.column(0)):
                runs.append(np.unique(hashes[hashes != END_HASH], return_counts=True))
                size += len(runs[-1][0])
                if size >= RUN:
                    yield send(runs)
                    runs, size = [], 0
        if runs:
            yield send(runs)

    return rows.mapInArrow(count, "hash long, n long")


def frequent_words(rows: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of the ``n`` most frequent words, of equally frequent ones those with the least hashes.

    Tasks report their frequent words with bounds for what they leave out. If these bounds cannot tell which words
    are the ``n``, all words are counted.
    """
    order = [F.desc("n"), F.asc("hash")]
    found = materialize(_reported(rows).groupBy("hash").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack")), "frequent-words")
    unseen = found.filter("hash is null").agg(F.coalesce(F.sum("slack"), F.lit(0))).first()[0]
    words = found.filter("hash is not null")
    best = words.orderBy(*order).limit(n).toPandas()
    if unseen:
        chosen = F.col("hash").isin(best["hash"].tolist())
        others = words.filter(~chosen).agg(F.max(F.col("n") + F.col("slack"))).first()[0] or 0
        if len(best) < n or best["n"].min() <= unseen + max(0, others):
            best = _all_counts(rows).groupBy("hash").agg(F.sum("n").alias("n")).orderBy(*order).limit(n).toPandas()
    return np.sort(best["hash"].to_numpy(np.int64).view(np.uint64))


# --- messages -------------------------------------------------------------------------
class Index:
    """Place of hashes among distinct ones, which are kept in the order of their values."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        self.shift = np.uint64(63 - max(1, len(keys)).bit_length())
        self.start = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, and whether it is there at all."""
        last = len(self.keys) - 1
        if last < 0:
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), dtype=bool)
        at = np.minimum(self.start[keys >> self.shift], last)
        live = np.flatnonzero((self.keys[at] < keys) & (at < last))
        while len(live):
            at[live] += 1
            spot = at[live]
            live = live[(self.keys[spot] < keys[live]) & (spot < last)]
        return at, self.keys[at] == keys


#: Code of words that are not among the known ones.
OTHER = (1 << 24) - 1


class Coder:
    """Codes of known words, the most frequent first, so that codes are small numbers."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.index = keys, Index(keys)
        self.rank = np.empty(len(keys), np.uint32)
        self.rank[np.searchsorted(self.index.keys, keys)] = np.arange(len(keys))

    def codes(self, keys: np.ndarray) -> np.ndarray:
        at, found = self.index.find(keys)
        return np.where(found, self.rank[at], np.uint32(OTHER)) if len(self.keys) else np.full(len(keys), OTHER, np.uint32)


@dataclass
class Coded:
    """Words as codes, in planes of bytes, and the hashes of those without one in order."""

    planes: tuple[np.ndarray, np.ndarray, np.ndarray]
    rest: np.ndarray

    @staticmethod
    def of(code: np.ndarray, keys: np.ndarray) -> Coded:
        return Coded(tuple((code >> np.uint32(8 * i)).astype(np.uint8) for i in range(3)), keys[code == OTHER])

    def code(self) -> np.ndarray:
        low, middle, high = (x.astype(np.uint32) for x in self.planes)
        return low | middle << np.uint32(8) | high << np.uint32(16)

    def hashes(self, coder: Coder) -> np.ndarray:
        code = self.code()
        other = code == OTHER
        keys = np.empty(len(code), np.uint64)
        keys[other] = self.rest
        keys[~other] = coder.keys[code[~other]]
        return keys

    def at(self, keep: np.ndarray) -> Coded:
        """Those that a mask picks."""
        return Coded(tuple(x[keep] for x in self.planes), self.rest[keep[self.code() == OTHER]])

    def distinct(self, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
        """The words that occur, in the order of codes and then of hashes, and the place of each word among them."""
        code, n = self.code().astype(np.int64), len(coder.keys)
        rest, where = np.unique(self.rest, return_inverse=True)
        code[code == OTHER] = n + where
        present = np.zeros(n + len(rest), bool)
        present[code] = True
        return np.concatenate([coder.keys[present[:n]], rest]), (np.cumsum(present) - 1)[code]


def _pack(message) -> bytes:
    raw = pickle.dumps(message, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes):
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in few bytes."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _same(part: int) -> int:
    """Partition of a message; one function for all, so that Spark knows that the parts belong together."""
    return part


def _place(keys: np.ndarray, parts: int) -> np.ndarray:
    """The owners of words."""
    return (mix(keys, 9) % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs and where, in order."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    sizes = np.bincount(part, minlength=parts)
    ends = np.cumsum(sizes)
    for p in np.flatnonzero(sizes):
        yield int(p), order[ends[p] - sizes[p]:ends[p]]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "blob"])


def _trim() -> None:
    """Give free memory back: Python processes wait for their next task beside others that work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python in small batches in what is planned here."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _deal(messages: RDD, parts: int) -> RDD:
    """``partitionBy`` that passes each message on as it comes: messages are large, and ``partitionBy`` would hold hundreds.

    The result is read as other RDDs are, so that a union with them needs no process of its own.
    """
    sc = messages.ctx

    def keyed(_, found):
        for part, blob in found:
            yield pack_long(part)
            yield pickle.dumps([(part, blob)], 5)
        _trim()

    framed = messages.mapPartitionsWithIndex(keyed, preservesPartitioning=True)
    framed._bypass_serializer = True
    pairs = sc._jvm.PairwiseRDD(framed._jrdd.rdd()).asJavaPairRDD()
    moved = pairs.partitionBy(sc._jvm.PythonPartitioner(parts, id(_same)))
    out = RDD(sc._jvm.PythonRDD.valueOfPair(moved), sc, sc.serializer)
    out.partitioner = Partitioner(parts, _same)
    return out


def _dealt(messages: DataFrame, parts: int) -> RDD:
    """Blobs (part, blob) of a DataFrame in their parts."""
    with _small_batches(messages.sparkSession):
        blobs = messages.rdd
    return _deal(blobs.map(tuple), parts)


def _frame(blobs: RDD, like: DataFrame, schema: str | StructType) -> DataFrame:
    """The rows of record batches that an RDD holds as bytes."""

    def rows(batches):
        for batch in batches:
            for blob in batch.column(0):
                yield from pa.ipc.open_stream(blob.as_buffer())

    return like.sparkSession.createDataFrame(blobs.map(lambda b: (b,)), "blob binary").mapInArrow(rows, schema)


def _stream(columns: dict[str, pa.Array], rows: int = 1 << 16) -> Iterator[bytes]:
    table = pa.table(columns)
    for batch in table.to_batches(rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        yield sink.getvalue().to_pybytes()


# --- model ----------------------------------------------------------------------------
@dataclass
class Room:
    """Totals of one sweep: customers and tables of the shared parent."""

    customers: float
    tables: float

    def rest(self, types: int) -> float:
        """Weight that the parent has for each word that could be new."""
        return (PARENT[1] + PARENT[0] * self.tables) / (types + 1)


@dataclass
class Owned:
    """What an owner knows of its words, by word: as contexts and as words that follow.

    ``routes`` has, per task that holds pairs, the places of the contexts and of the words it asks for.
    ``seen`` has tables as a context, customers and tables of the parent in the sweeps that count.
    """

    keys: np.ndarray
    followers: np.ndarray
    uses: np.ndarray
    before: np.ndarray
    n: np.ndarray
    routes: dict[int, list[np.ndarray]]
    tables: np.ndarray
    seated: np.ndarray
    parent: np.ndarray
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def packed(self) -> bytes:
        x = self
        whole = [*map(_small, (x.followers, x.uses, x.before, x.n))], [*map(_small, (x.tables, x.seated, x.parent))]
        return _pack(Owned(x.keys, *whole[0], x.routes, *whole[1], x.seen))

    def above(self, room: Room, types: int) -> np.ndarray:
        """The parent's probability of each word."""
        return (self.seated - PARENT[0] * self.parent + room.rest(types)) / (PARENT[1] + room.customers)


@dataclass
class Model:
    #: hash, n, p (probability without context), customers and back (weight of p where the word is the context) of every known word.
    table: DataFrame
    #: Probability of an unknown word without context.
    unknown: float
    tokens: int
    types: int
    #: Customers and weight of the words without context at the start of a document.
    start: tuple[float, float]
    #: Words with codes; per part the counts of its pairs from all tasks, the pairs met more than once, what owners told in the sweeps that count, and what the owner knows.
    known: Broadcast
    counts: RDD
    many: RDD
    answers: list[RDD]
    owners: RDD


def _merge(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Key, context, word and count of each pair in runs of contexts, words and counts, by key; the runs are used up."""
    context, word, times = (np.concatenate([run[i] for run in runs]) for i in range(3))
    runs.clear()
    key = _pair(context, word)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    where = order[first]
    return key[first], context[where], word[where], np.add.reduceat(times[order], first, dtype=np.int64) if len(first) else times.astype(np.int64)


def _count_pairs(rows: DataFrame, known: Broadcast, parts: int) -> RDD:
    """Per part: contexts, words and counts of its pairs, in the order of their keys."""

    def send(runs):
        key, context, word, times = _merge(runs)
        coder, out = known.value, []
        contexts, words = coder.codes(context), coder.codes(word)
        for p, at in _by_part((key % np.uint64(parts)).astype(np.int64), parts):
            out.append((p, _pack((Coded.of(contexts[at], context[at]), Coded.of(words[at], word[at]), _small(times[at])))))
        return _batch(out)

    def count(batches):
        runs, size = [], 0
        for batch in batches:
            for _, _, words, _, context in _documents(batch.column(0)):
                _, first, times = np.unique(_pair(context, words), return_index=True, return_counts=True)
                runs.append((context[first], words[first], times))
                size += len(first)
                if size >= RUN:
                    yield send(runs)
                    runs, size = [], 0
        if runs:
            yield send(runs)
        _trim()

    return _dealt(rows.mapInArrow(count, "part int, blob binary"), parts)


def _merged(counts: list, coder: Coder) -> tuple[np.ndarray, ...]:
    """Key, context, word and count of the pairs of a part, by key, from the counts of all tasks; these are used up."""
    runs = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint8))]
    while counts:
        contexts, words, times = counts.pop()
        runs.append((contexts.hashes(coder), words.hashes(coder), times))
    return _merge(runs)


def _again(context: np.ndarray, word: np.ndarray, times: np.ndarray, coder: Coder) -> tuple[Coded, Coded, np.ndarray]:
    """The pairs of a part that are met more than once."""
    again = times > 1
    return *[Coded.of(coder.codes(x), x) for x in (context[again], word[again])], _small(times[again])


class _Asked:
    """Pairs of a part that are met more than once, and the words whose state their draws need.

    Words are in the order of their owners, as ``routes`` of these have them.
    """

    def __init__(self, pairs, coder: Coder, parts: int) -> None:
        *both, times = pairs
        self.times = times.astype(np.int64)
        self.keys, self.where, self.sizes = [], [], []
        for words in both:
            own, where = words.distinct(coder)
            self.keys.append(own[where])
            place = _place(own, parts)
            rank = np.empty(len(own), np.int64)
            rank[np.argsort(place, kind="stable")] = np.arange(len(own))
            self.where.append(rank[where])
            self.sizes.append(np.bincount(place, minlength=parts))

    def draw(self, told: list, sweep: int, keep: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Tables of each pair, given what the owners told: (sweep, owner, tables of contexts, parent's probabilities of words)."""
        none = np.empty(0)
        told = sorted(told, key=lambda x: x[1])
        tables, above = (np.concatenate([none, *[x[r] for x in told]])[w[keep]] for r, w in zip((2, 3), self.where))
        d, s = CONTEXT
        return seat(self.times[keep], (s + d * tables) * above, d, _pair(*[k[keep] for k in self.keys]), sweep)


def fit(train: DataFrame, text: str = "text") -> Model:
    """Count the pairs of words of the training texts and seat them."""
    spark = train.sparkSession
    rows = as_text(train.select(F.col(text).alias("text")), "text").select(F.coalesce("text", F.lit("")).alias("text"))
    with _small_batches(spark):
        words = materialize(_all_counts(rows).groupBy("hash").agg(F.sum("n").alias("n")), "words")
    frequent = _frequent_rows(words, FREQUENT)
    known = spark.sparkContext.broadcast(Coder(frequent["hash"].view(np.uint64)[np.argsort(-frequent["n"], kind="stable")]))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = _count_pairs(rows, known, parts)

    def met_again(found):
        _, *pairs = _merged([_unpack(blob) for _, blob in found], known.value)
        yield _pack(_again(*pairs, known.value))

    many = counts.mapPartitions(met_again, preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)

    def tell(part, found):
        coder = known.value
        _, *both, times = _merged([_unpack(blob) for _, blob in found], coder)
        for role, words in enumerate(both):
            own, where = Coded.of(coder.codes(words), words).distinct(coder)
            codes = coder.codes(own)
            count, uses = np.bincount(where, minlength=len(own)), np.bincount(where, times, len(own)).astype(np.int64)
            asks = np.zeros(len(own), bool)
            asks[where[times > 1]] = True
            for to, at in _by_part(_place(own, parts), parts):
                yield to, _pack((part, role, Coded.of(codes[at], own[at]), _small(count[at]), _small(uses[at]), np.packbits(asks[at])))

    def own(told):
        told = [_unpack(x) for _, x in told]
        keys = [x[2].hashes(known.value) for x in told]
        every = np.unique(np.concatenate([np.empty(0, np.uint64), *keys]))
        sums = np.zeros((2, 2, len(every)), np.int64)
        routes = {}
        for (part, role, _, count, uses, asks), k in zip(told, keys):
            at = np.searchsorted(every, k)
            sums[role, 0, at] += count
            sums[role, 1, at] += uses
            routes.setdefault(part, [np.empty(0, np.int32)] * 2)[role] = at[np.unpackbits(asks, count=len(k)).astype(bool)].astype(np.int32)
        (followers, uses), (before, n) = sums
        yield Owned(every, followers, uses, before, n, routes, followers, before, np.minimum(before, 1), []).packed()
        _trim()

    def total(blob):
        owned = _unpack(blob)
        return owned.seated.sum(), owned.parent.sum(), owned.n.sum(), np.count_nonzero(owned.n)

    owned = _deal(counts.mapPartitionsWithIndex(tell), parts).mapPartitions(own, preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)
    customers, tables, tokens, types = (int(x) for x in np.sum(owned.map(total).collect(), axis=0))  # four numbers a task
    rooms, answers = [Room(customers, tables)], []
    used = range(BURN_IN, BURN_IN + SAMPLES)
    for sweep in range(BURN_IN + SAMPLES - 1):
        answered = _deal(_answers(owned, rooms[-1], types, sweep), parts)
        drawn = _deal(many.union(answered).mapPartitionsWithIndex(_drawing(known, parts, sweep)), parts)
        before, owned = owned, owned.union(drawn).mapPartitions(_seating(rooms[-1], types, sweep, sweep + 1 in used), preservesPartitioning=True)
        owned.persist(StorageLevel.DISK_ONLY)
        rooms.append(Room(*(int(x) for x in np.sum(owned.map(total).collect(), axis=0)[:2])))
        before.unpersist()
        if sweep + 1 in used:
            answers.append(answered)

    d, s = CONTEXT
    shares = [1 / (PARENT[1] + rooms[r].customers) for r in used]
    unknown = float(np.mean([rooms[r].rest(types) * x for r, x in zip(used, shares)]))

    def known_words(states):
        for x in map(_unpack, states):
            p = np.mean([(seated - PARENT[0] * parent) * y for (_, seated, parent), y in zip(x.seen, shares)], axis=0) + unknown
            tables = np.mean([t for t, _, _ in x.seen], axis=0)
            yield _pack((x.keys, x.n.astype(np.int64), np.where(x.n > 0, p, 0), x.uses.astype(np.int64), (s + d * tables) / (s + x.uses)))

    owners = owned.mapPartitions(known_words, preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)

    def start(blob):
        x = _unpack(blob)
        at, found = _find(x[0], np.array([START_HASH]))
        return [(float(x[3][at[0]]), float(x[4][at[0]]))] if found[0] else []

    starts = owners.flatMap(start).collect()  # one owner has it
    owned.unpersist()
    names = ["hash", "n", "p", "customers", "back"]
    blobs = owners.flatMap(lambda x: _stream({c: pa.array(v.view(np.int64) if c == "hash" else v) for c, v in zip(names, _unpack(x))}))
    table = materialize(_frame(blobs, train, "hash long, n long, p double, customers long, back double").where("n > 0"), "word-probabilities")

    return Model(table, unknown, tokens, types, (starts or [(0.0, 1.0)])[0], known, counts, many, answers, owners)


def _answers(owned: RDD, room: Room, types: int, sweep: int) -> RDD:
    """What the owners tell those that hold pairs: tables of contexts and the parent's probabilities of words."""

    def answer(part, states):
        for x in map(_unpack, states):
            above = x.above(room, types).astype(np.float32)
            for to, (contexts, words) in x.routes.items():
                if len(contexts) or len(words):
                    yield to, _pack((sweep, part, _small(x.tables[contexts]), above[words]))

    return owned.mapPartitionsWithIndex(answer)


def _drawing(known: Broadcast, parts: int, sweep: int) -> Callable:
    """Seats the pairs of a part; the owners get the tables beyond the first of each pair."""

    def draw(part, found):
        asked = _Asked(_unpack(next(found)), known.value, parts)
        more = asked.draw([_unpack(x) for _, x in found], sweep) - 1
        sums = [np.split(np.bincount(w, more, int(n.sum())).astype(np.int64), np.cumsum(n)[:-1]) for w, n in zip(asked.where, asked.sizes)]
        for to, both in enumerate(zip(*sums)):
            if any(len(x) for x in both):
                yield to, _pack((part, *map(_small, both)))

    return draw


def _seating(room: Room, types: int, sweep: int, keep: bool) -> Callable:
    """The owners' state after a sweep."""

    def seat_words(found):
        x = _unpack(next(found))
        tables, seated = x.followers.astype(np.int64), x.before.astype(np.int64)
        for _, blob in found:
            part, contexts, words = _unpack(blob)
            tables[x.routes[part][0]] += contexts
            seated[x.routes[part][1]] += words
        parent = seat(seated, np.full(len(seated), room.rest(types)), PARENT[0], x.keys, 900 + sweep).astype(np.int64)
        x.tables, x.seated, x.parent = tables, seated, parent
        x.seen = [*x.seen, tuple(_small(y) for y in (tables, seated, parent))] if keep else x.seen
        yield x.packed()
        _trim()

    return seat_words


def _weights(asked: _Asked, told: list, keep: slice | np.ndarray = slice(None)) -> np.ndarray:
    """Count less the discount of the mean tables of pairs, given what the owners told in the sweeps that count."""
    sweeps = {x[0] for x in told}
    drawn = sum(asked.draw([x for x in told if x[0] == sweep], sweep, keep) for sweep in sweeps)
    return (asked.times[keep] - CONTEXT[0] * drawn / max(1, len(sweeps))).astype(np.float32)


def _class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n.astype(np.float64)) * 16).astype(np.int64)


def _frequent_rows(table: DataFrame, most: int) -> dict[str, np.ndarray]:
    """Columns of at most ``most`` words in the order of their hashes: all with a count in the highest classes of counts."""
    level = F.floor(F.log2("n") * 16)
    by_level = table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()  # 16 per doubling
    total, least = 0, None
    for r in by_level:
        total += r["words"]
        if total > most:
            break
        least = r["level"]
    names = table.columns
    kinds = [np.float64 if f.dataType.simpleString() == "double" else np.int64 for f in table.schema]
    if least is None:
        return {c: np.empty(0, k) for c, k in zip(names, kinds)}

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in batch.columns], names=names)

    rows = table.where(level >= least).mapInArrow(packed, ", ".join(f"{c} binary" for c in names)).collect()
    columns = {c: np.frombuffer(b"".join(r[c] for r in rows), k) for c, k in zip(names, kinds)}
    order = np.argsort(columns["hash"].view(np.uint64))
    return {c: x[order] for c, x in columns.items()}


# --- scoring --------------------------------------------------------------------------
#: A log10 probability is summed as a whole number of so many parts, so that sums do not depend on their order.
UNIT = 1 << 20


@dataclass
class Frequent:
    """What scoring broadcasts: of words the smoothed log10 share, probability, customers and weight by code, of pairs the keys and costs.

    The start of a document is the last word.
    """

    words: Coder
    base: np.ndarray
    p: np.ndarray
    customers: np.ndarray
    back: np.ndarray
    pairs: Index
    cost: np.ndarray


def _cost(weight: np.ndarray, customers: np.ndarray, back: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Less log10 of the probability of a word after its context, in units."""
    return np.maximum(np.rint(-UNIT * np.log10(weight / (CONTEXT[1] + customers) + back * p)), 0)


def _frequent(model: Model, most: int, floor: float) -> Frequent:
    """The most frequent words, and of the most frequent pairs those that are met more than once and of such words."""
    rows = _frequent_rows(model.table, most)
    order = np.argsort(-rows["n"], kind="stable")
    rows = {c: x[order] for c, x in rows.items()}
    words = Coder(np.append(rows["hash"].view(np.uint64), START_HASH))
    customers, back, p = np.append(rows["customers"], model.start[0]), np.append(rows["back"], model.start[1]), np.append(rows["p"], 0.0)

    def classes(blob):
        found, n = np.unique(_class(_unpack(blob)[2]), return_counts=True)
        return zip(found.tolist(), n.tolist())

    total, least = 0, None
    for level, n in sorted(model.many.flatMap(classes).reduceByKey(int.__add__, 1).collect(), reverse=True):
        total += n
        if total > most:
            break
        least = level
    keys, cost = np.empty(0, np.uint64), np.empty(0)
    if least is not None:
        known = model.known
        lowest = next(n for n in range(max(2, math.floor(2 ** (least / 16)) - 1), 2 << 60) if _class(np.array([n]))[0] >= least)
        parts = model.many.getNumPartitions()

        def often(found):
            asked = _Asked(_unpack(next(found)), known.value, parts)
            keep = asked.times >= lowest
            weight = _weights(asked, [_unpack(blob) for _, blob in found], keep)
            yield *[x[keep] for x in asked.keys], weight

        found = reduce(RDD.union, model.answers, model.many).mapPartitions(often).collect()  # as many pairs as are broadcast
        context, word, weight = (np.concatenate(x) for x in zip(*found))
        c, w = words.codes(context), words.codes(word)
        good = (c != OTHER) & (w != OTHER)
        keys, cost = _pair(context[good], word[good]), _cost(weight[good], customers[c[good]], back[c[good]], p[w[good]])
    return Frequent(words, np.append(np.log10(rows["n"] + 0.5) - floor, 0.0), p, customers, back, Index(keys), cost[np.argsort(keys)])


@dataclass
class Block:
    """The documents of a run of rows and their sums so far. Messages about a block go to its home."""

    block: int
    ids: pa.Array
    n_tokens: np.ndarray
    n_known: np.ndarray
    base: np.ndarray
    cost: np.ndarray


@dataclass
class Sums:
    """Sums by block and row, in this order; words counted where the texts are do not count in ``n_known`` and ``base``."""

    block: np.ndarray
    row: np.ndarray
    cost: np.ndarray
    n_known: np.ndarray
    base: np.ndarray


@dataclass
class Open:
    """Pairs with a word or a context that was not broadcast; ``p`` and ``back`` are nan until an owner adds them."""

    block: np.ndarray
    row: np.ndarray
    context: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    times: np.ndarray
    p: np.ndarray
    #: Uses of the word, -1 if it was counted where the texts are.
    n: np.ndarray
    customers: np.ndarray
    back: np.ndarray


def _joined(parts: list):
    return type(parts[0])(*[np.concatenate(x) for x in zip(*(vars(y).values() for y in parts))])


def _taken(x, rows: np.ndarray):
    return type(x)(*[y[rows] for y in vars(x).values()])


def _homes(blocks: np.ndarray, parts: int) -> np.ndarray:
    return _place(blocks.astype(np.uint64), parts)


def _summed(x: Sums, parts: int) -> Iterator[tuple[int, bytes]]:
    """One row for each block and row, to the homes of the blocks."""
    order = np.lexsort((x.row, x.block))
    block, row = x.block[order], x.row[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (block[1:] != block[:-1]) | (row[1:] != row[:-1])]))
    if len(first):
        sums = Sums(block[first], row[first], *[np.add.reduceat(y[order], first) for y in (x.cost, x.n_known, x.base)])
        for to, at in _by_part(_homes(sums.block, parts), parts):
            own = _taken(sums, at)
            yield to, _pack(Sums(own.block, _small(own.row), _small(own.cost), _small(own.n_known), own.base if own.base.any() else np.zeros(1)))


def _forward(x: Open, parts: int) -> Iterator[tuple[int, bytes]]:
    """Pairs to the owners of their words, or else of their contexts."""
    for to, at in _by_part(_place(np.where(np.isnan(x.p), x.word, x.context), parts), parts):
        yield to, _pack(_taken(x, at))


def _gathered(messages: list) -> Iterator[Block]:
    """Blocks with the sums of this part added."""
    blocks = {x.block: x for x in messages if isinstance(x, Block)}
    for x in messages:
        if isinstance(x, Sums):
            ends = np.append(np.flatnonzero(np.diff(x.block)) + 1, len(x.block))
            base = np.broadcast_to(x.base, len(x.block))
            for begin, end in zip([0, *ends[:-1]], ends):
                b, rows = blocks[int(x.block[begin])], x.row[begin:end]
                b.cost[rows] += x.cost[begin:end].astype(np.int64)
                b.n_known[rows] += x.n_known[begin:end].astype(np.int64)
                b.base[rows] += base[begin:end]
    return iter(blocks.values())


def _send_texts(rows: DataFrame, held: Broadcast, parts: int) -> DataFrame:
    """Blocks of documents to their homes, and their pairs to the parts that hold them; frequent words and pairs are looked up here."""

    def run(batches):
        known = held.value
        docs, runs, size, first_row, seq = [], [], 0, 0, 0

        def message():
            block = TaskContext.get().partitionId() << 24 | seq
            out = [(int(_homes(np.array([block]), parts)[0]), _pack(Block(block, pa.concat_arrays([x[0] for x in docs]), *[np.concatenate([x[i] for x in docs]) for i in range(1, 5)])))]
            key, c, w, context, word, row, times = (np.concatenate(x) for x in zip(*runs))
            for p, at in _by_part((key % np.uint64(parts)).astype(np.int64), parts):
                out.append((p, _pack((block, Coded.of(c[at], context[at]), Coded.of(w[at], word[at]), _small(np.diff(row[at], prepend=0)), _small(times[at])))))
            return _batch(out)

        for batch in batches:
            for at, n, words, owner, context in _documents(batch.column(1)):
                code = known.words.codes(words)
                before = np.empty_like(code)
                before[1:] = code[:-1]
                before[context == START_HASH] = len(known.base) - 1
                good = code != OTHER
                own = owner[good]
                key = _pair(context, words)
                pair, often = known.pairs.find(key)
                docs.append((batch.column(0).slice(at, n), np.bincount(owner, minlength=n), np.bincount(own, minlength=n), np.bincount(own, known.base[code[good]], n).astype(np.float64),
                             np.bincount(owner[often], known.cost[pair[often]], n).astype(np.int64)))
                rest = np.flatnonzero(~often)
                order = rest[np.argsort(key[rest], kind="stable")]  # by key, then by row
                new = np.ones(len(order), dtype=bool)
                new[1:] = (key[order[1:]] != key[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
                first = np.flatnonzero(new)
                times = np.zeros(len(words), np.int64)
                times[order[first]] = np.diff(np.append(first, len(order)))
                one = np.flatnonzero(times)  # pairs of a row once, in the order of rows
                runs.append((key[one], before[one], code[one], context[one], words[one], owner[one] + first_row, times[one]))
                first_row, size = first_row + n, size + len(one)
                if size >= RUN:
                    yield message()
                    docs, runs, size, first_row, seq = [], [], 0, 0, seq + 1
        if docs:
            yield message()
        _trim()

    return rows.mapInArrow(run, "part int, blob binary")


def _weigh_texts(held: Broadcast, known: Broadcast, parts: int) -> Callable:
    """Adds the weights of pairs. What is complete goes home as sums, all else to the owner of what is missing."""

    def run(found):
        frequent, counts, told, sums, left, stored = held.value, [], [], [], [], None
        for _, blob in found:  # counts, then what owners told, then texts
            message = _unpack(blob)
            if not isinstance(message, Block) and len(message) < 5:
                (counts if len(message) == 3 else told).append(message)
                continue
            if stored is None:
                key, context, word, times = _merged(counts, known.value)
                weight = np.append(times - CONTEXT[0], 0).astype(np.float32)
                weight[np.flatnonzero(times > 1)] = _weights(_Asked(_again(context, word, times, known.value), known.value, parts), told)
                stored = Index(key)
                del key, context, word, times, told
            if isinstance(message, Block):
                yield int(_homes(np.array([message.block]), parts)[0]), blob
                continue
            block, contexts, words, steps, times = message
            context, word, row = contexts.hashes(frequent.words), words.hashes(frequent.words), np.cumsum(steps, dtype=np.int64)
            spot, met = stored.find(_pair(context, word))
            own, times = weight[np.where(met, spot, -1)], times.astype(np.int64)
            c, w = contexts.code(), words.code()
            both = (c != OTHER) & (w != OTHER)
            cost = np.bincount(row[both], _cost(own[both], frequent.customers[c[both]], frequent.back[c[both]], frequent.p[w[both]]) * times[both])
            rows = np.flatnonzero(cost)
            sums.append(Sums(np.full(len(rows), block), rows, cost[rows], np.zeros(len(rows), np.int64), np.zeros(len(rows))))
            at = np.flatnonzero(~both)
            c, w = c[at], w[at]
            p, customers, back = np.full(len(at), np.nan), np.zeros(len(at)), np.full(len(at), np.nan)
            p[w != OTHER] = frequent.p[w[w != OTHER]]
            customers[c != OTHER], back[c != OTHER] = frequent.customers[c[c != OTHER]], frequent.back[c[c != OTHER]]
            left.append(Open(np.full(len(at), block), row[at], context[at], word[at], own[at], times[at], p, np.full(len(at), -1), customers, back))
            if sum(len(x.row) for x in left) + sum(len(x.row) for x in sums) >= RUN:
                yield from _summed(_joined(sums), parts)
                yield from _forward(_joined(left), parts)
                sums, left = [], []
        if left:
            yield from _summed(_joined(sums), parts)
            yield from _forward(_joined(left), parts)

    return run


def _look_up(unknown: float, floor: float, parts: int) -> Callable:
    """Adds what the owners know of rare words, or of rare contexts of words known by now."""

    def run(found):
        keys, n, p, customers, back = _unpack(next(found))
        index = Index(keys)  # keys are in order
        n, p, customers, back = np.append(n, 0), np.append(np.where(n > 0, p, unknown), unknown), np.append(customers, 0), np.append(back, 1.0)
        messages = [_unpack(blob) for _, blob in found]
        if left := [x for x in messages if isinstance(x, Open)]:
            x = _joined(left)
            asked = np.isnan(x.p)
            spot, met = index.find(np.where(asked, x.word, x.context))
            spot = np.where(met, spot, -1)
            x.n, x.p = np.where(asked, n[spot], x.n), np.where(asked, p[spot], x.p)
            x.customers, x.back = np.where(asked, x.customers, customers[spot]), np.where(asked, x.back, back[spot])
            wait = np.isnan(x.back)
            yield from _forward(_taken(x, wait), parts)
            x = _taken(x, ~wait)
            base = np.where(x.n >= 0, (np.log10(np.maximum(x.n, 0) + 0.5) - floor) * x.times, 0)
            yield from _summed(Sums(x.block, x.row, _cost(x.weight, x.customers, x.back, x.p) * x.times, x.times * (x.n > 0), base), parts)
        for x in _gathered(messages):
            yield int(_homes(np.array([x.block]), parts)[0]), _pack(x)

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (smoothed unigrams), score (this model) of every row in log10, and perplexity."""
    rows = as_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    floor, parts = math.log10(model.tokens + 0.5 * (model.types + 1)), model.many.getNumPartitions()
    held = docs.sparkSession.sparkContext.broadcast(_frequent(model, frequent, floor))
    sums = [StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())]
    schema = StructType([rows.schema["doc_id"], *sums])
    kind = to_arrow_schema(schema).field("doc_id").type
    sent = _dealt(_send_texts(rows, held, parts), parts)
    found = _deal(reduce(RDD.union, [*model.answers, sent], model.counts).mapPartitions(_weigh_texts(held, model.known, parts)), parts)
    for _ in range(2):  # rare words, then rare contexts of rare words
        found = _deal(model.owners.union(found).mapPartitions(_look_up(model.unknown, floor, parts)), parts)

    def finish(found):
        for x in _gathered([_unpack(blob) for _, blob in found]):
            yield from _stream(dict(zip(schema.names, (x.ids.cast(kind), *map(pa.array, (x.n_tokens, x.n_known, x.base, x.cost / -UNIT))))))

    one = _frame(found.mapPartitions(finish), docs, schema)
    return one.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
