"""Benchmark decontamination by templates: finds copied and re-parameterised questions.

Texts become sequences of tokens in which numbers, units behind numbers and names
(capitalised words inside a sentence) are typed placeholders; the rest is lower
case, signs are dropped. Windows of tokens of the documents are hash-joined with those
of the benchmark: as they are, and as templates with placeholders for numbers and
units, for names too, and for capitalised words that open a sentence too. A window is
taken in every form that differs from the one before.

A window whose values are all the item's is a match. In one with replaced values each
value of the item must stand for one value of the document; two may become equal. At
the same offset such a window is not counted if it contradicts the values of windows
without replaced ones, which are matches then.

A bit array of the benchmark's window hashes (``2**LOG2_BITS`` bits whatever its size)
lets through the few windows of a document that can join; the join decides.

Windows have ``WIDTH`` tokens, or the whole item where it has fewer. Every window and
every item with a token is looked for as it is; as templates, which chance would meet,
only those with ``LEAST`` tokens and 60 % plain words. Defined cases: null and empty texts
and items without letters and digits match nothing; equal
texts have equal matches; benchmark rows with a null id or text are left out;
repeated benchmark rows count once.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.arrow import Memory, as_text, pieces
from schemaloom.llm.hashing import _POWERS, mix
from schemaloom.session import materialize

WIDTH = 13
LEAST = 5
PLAIN = 0.6
LOG2_BITS = 26
REMEMBERED = 300_000

#: Units that a number may be given in.
UNITS = frozenset("""
    mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres
    mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz
    ml l liter liters litre litres gallon gallons pint pints cup cups
    s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
    percent degree degrees celsius fahrenheit kelvin
    dollar dollars cent cents euro euros usd eur gbp yen
    mph kmh watt watts kw kwh volt volts amp amps joule joules newton newtons pascal hertz hz khz mhz ghz byte bytes kb mb gb tb
""".split())

_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?\n]")
_NUMBER, _UNIT, _NAME = 1, 2, 3
#: Hashes of the placeholders by type; type 0 is a word.
_HOLDER = mix(np.arange(4, dtype=np.uint64), 4242)


class Tokens:
    """Token tables of one task: hash and traits of every token it met lately."""

    def __init__(self) -> None:
        self.memory = Memory(REMEMBERED)

    @staticmethod
    def traits(token: str) -> tuple[int, int]:
        low = token.lower()
        raw = low.encode()
        value = zlib.crc32(raw) << 32 | zlib.crc32(b"\x01" + raw[::-1])
        kind = (1 if token in ".!?\n" else 2 if token[0].isdigit() else 0) | (4 if low in UNITS else 0) | (8 if len(token) > 1 and token.istitle() else 0)
        return value, kind

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Value hashes, placeholder types by form (none, without names, with names, with opening ones) and row starts of the tokens that are not stops."""
        split = [_TOKEN.findall(t) if t else [] for t in texts]
        self.memory.turn()
        parts = set().union(*split)
        known = self.memory.new
        for p in self.memory.recall(parts):
            known[p] = self.traits(p)
        table = {p: i for i, p in enumerate(parts)}
        values = np.array([known[p][0] for p in table], np.uint64)
        kinds = np.array([known[p][1] for p in table], np.uint8)
        at = np.array([table[p] for own in split for p in own], np.int64)
        first = np.concatenate([[0], np.cumsum([len(own) for own in split])])
        kind = kinds[at] if len(at) else np.empty(0, np.uint8)
        stop = (kind & 1).astype(bool)
        opens = np.ones(len(at) + 1, dtype=bool)  # a sentence starts here
        opens[1:] = np.append(stop, False)[:len(at)] if len(at) else True
        opens[first] = True
        keep = ~stop
        starts = np.concatenate([[0], np.cumsum(keep)])[first]
        opens, kind, at = opens[:-1][keep], kind[keep], at[keep]
        number = (kind & 2).astype(bool)
        after_number = np.zeros(len(at), dtype=bool)
        after_number[1:] = number[:-1]
        after_number[starts[:-1][starts[:-1] < len(at)]] = False
        plain = np.where(number, _NUMBER, np.where(after_number & (kind & 4 > 0), _UNIT, 0)).astype(np.uint8)
        name = (plain == 0) & (kind & 8 > 0)
        typed = np.where(name & ~opens, _NAME, plain).astype(np.uint8)
        opened = np.where(name, _NAME, plain).astype(np.uint8)
        hashes = mix(values[at], 1) if len(at) else np.empty(0, np.uint64)
        return hashes, [np.zeros(len(at), np.uint8), plain, typed, opened], starts


def _template_windows(batches, sizes: list[int], bits, whole: bool):
    """Windows of (a, b, text) rows; of whole short texts only where ``whole``."""
    tokens = Tokens()
    for full in batches:
        for batch in pieces(full, "text"):
            values, forms, first = tokens.read(batch.column(2).to_pylist())
            counts = np.diff(first)
            row_of = np.repeat(np.arange(len(counts)), counts)
            last = np.repeat(first[1:], counts)
            up, down = _POWERS.of(len(values) + 1)
            below = None
            for types in forms:
                # a window's hash is a difference of sums, whatever its size
                sums = np.zeros(len(values) + 1, np.uint64)
                np.cumsum(np.where(types > 0, _HOLDER[types], values) * up[:len(values)], out=sums[1:])
                if below is not None:
                    words = np.concatenate([[0], np.cumsum(types == 0)])
                    new = np.concatenate([[0], np.cumsum(types != below)])
                for size in sizes:
                    n = len(values) - size + 1
                    if n <= 0 or (below is not None and size < LEAST):
                        continue
                    inside = np.arange(size, n + size) <= last[:n]
                    if whole and size < WIDTH:
                        inside &= counts[row_of[:n]] == size
                    if below is not None:
                        inside &= (new[size:] > new[:n]) & (words[size:] - words[:n] >= PLAIN * size)
                    spot = np.flatnonzero(inside)
                    found = mix((sums[spot + size] - sums[spot]) * down[spot], 8)
                    if bits is not None:
                        cell = (found >> np.uint64(64 - LOG2_BITS)).astype(np.int64)
                        may = (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                        spot, found = spot[may], found[may]
                    if below is None and size < LEAST:  # the first place in a row stands for all
                        _, one = np.unique(np.stack([row_of[spot].astype(np.uint64), found]), axis=1, return_index=True)
                        spot, found = spot[one], found[one]
                    slots = [np.where(types[p:p + size] > 0, values[p:p + size], 0).view(np.int64).tolist() for p in spot]
                    rows = pa.array(row_of[spot])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(spot), size, np.int32)),
                        pa.array((spot - first[row_of[spot]]).astype(np.int32)), pa.array(found.view(np.int64)), pa.array(slots, pa.list_(pa.int64())),
                    ], names=["a", "b", "size", "pos", "hash", "slots"])
                below = types


WINDOW_SCHEMA = "a long, b long, size int, pos int, hash long, slots array<long>"


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Template windows of the items: item_id, size, item_pos, hash, item_slots, n_windows."""
    items = as_text(benchmark.select(F.col(item_id).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col(text).alias("text")), "text")
    items = items.where("a is not null and text is not null").distinct()
    sizes = list(range(1, WIDTH + 1))
    found = items.mapInArrow(lambda batches: _template_windows(batches, sizes, None, True), WINDOW_SCHEMA).distinct()
    counts = found.groupBy("a").agg(F.countDistinct("pos").alias("n_windows"))
    return found.join(counts, "a").select(F.col("a").alias("item_id"), "size", F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"), "n_windows")


def _filter_bits(windows: DataFrame) -> np.ndarray:
    """Bit per hash cell; the size does not depend on the benchmark."""

    def run(batches):
        own = np.zeros(1 << LOG2_BITS, dtype=bool)
        for batch in batches:
            own[(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - LOG2_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(own, bitorder="little").tobytes(), 1)], pa.binary())], names=["bits"])

    out = np.zeros((1 << LOG2_BITS) // 8, np.uint8)
    for row in windows.select("hash").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def text_keys(text: str):
    """Two hashes that stand for a text."""
    return F.xxhash64(text).alias("a"), F.hash(text).cast("long").alias("b")


def match_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Matches of distinct texts: a, b (text keys), item_id, n_windows, item_windows, n_slots, n_changed.

    n_windows counts the item's windows that were found; n_slots its replaced values in
    them and n_changed those that differ from the item's.
    """
    spark = docs.sparkSession
    items = materialize(item_windows(benchmark, item_id, item_text), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # WIDTH at most
    bits = spark.sparkContext.broadcast(_filter_bits(items))
    rows = as_text(docs.select(F.col(text).alias("text")), "text").where("text is not null").select(*text_keys("text"), "text")
    found = rows.mapInArrow(lambda batches: _template_windows(batches, sizes, bits.value, False), WINDOW_SCHEMA).distinct()
    hits = found.join(items, ["size", "hash"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    pair = F.arrays_zip(F.col("item_slots").alias("mine"), F.col("slots").alias("theirs"))
    hits = hits.withColumn("values", F.array_distinct(F.filter(pair, lambda p: (p["mine"] != 0) & (p["theirs"] != 0))))
    hits = hits.where(F.size(F.array_distinct(F.transform("values", lambda v: v["mine"]))) == F.size("values"))
    hits = hits.withColumn("differs", F.exists("values", lambda v: v["mine"] != v["theirs"]))
    offsets = hits.groupBy("a", "b", "item_id", "shift").agg(
        F.collect_set(F.struct("item_pos", "values", "differs")).alias("windows"), F.max("n_windows").alias("item_windows"))  # within one item
    offsets = offsets.withColumn("held", F.array_distinct(F.flatten(F.transform(F.filter("windows", lambda w: ~w["differs"]), lambda w: w["values"]))))
    contradicts = lambda v: F.exists("held", lambda h: (v["mine"] == h["mine"]) != (v["theirs"] == h["theirs"]))
    offsets = offsets.withColumn("windows", F.filter("windows", lambda w: ~w["differs"] | ~F.exists(w["values"], contradicts)))
    offsets = offsets.withColumn("values", F.array_distinct(F.flatten(F.transform("windows", lambda w: w["values"]))))
    spots = F.flatten(F.collect_list(F.transform("windows", lambda w: w["item_pos"])))
    changed = F.filter("values", lambda v: v["mine"] != v["theirs"])
    return (offsets.groupBy("a", "b", "item_id").agg(
        F.size(F.array_distinct(spots)).cast("long").alias("n_windows"), F.max("item_windows").alias("item_windows"),
        F.max(F.size("values")).cast("long").alias("n_slots"), F.min(F.size(changed)).cast("long").alias("n_changed")))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id and match columns for every document and item that it holds."""
    found = match_texts(docs, benchmark, text)
    ids = docs.select(F.col(doc_id).alias("doc_id"), *text_keys(text))
    return ids.join(materialize(found, "matches"), ["a", "b"]).drop("a", "b")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds no benchmark item; all columns pass through."""
    found = materialize(match_texts(docs, benchmark, text).select(F.col("a").alias("__a"), F.col("b").alias("__b")).distinct(), "matches")
    a, b = text_keys(text)
    return docs.withColumn("__a", a).withColumn("__b", b).join(found, ["__a", "__b"], "left_anti").select(*[f"`{c}`" for c in docs.columns])
