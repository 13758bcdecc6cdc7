"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z in
lower case. A document's length enters its scores only through a whole number m, so
documents of equal m form a stratum in which a term's contribution depends on its frequency
tf alone: the postings of a term are grouped by tf, and one impact is computed per tf. The
largest tf of a term bounds what it can add in a stratum; the sum over an item's terms
bounds every document there.

Build: one pass counts documents by their number of terms, which gives m for every number
and the size of every stratum. A second pass cuts texts into (term, tf) lists and sends them
to their stratum, one with more than ``BLOCK_DOCS`` documents in as many parts as it makes
blocks; tasks write blocks of at most that many documents. All terms of all documents are
indexed.

Search, for items in groups of bounded size: document frequencies are summed over the
blocks; bounds of all blocks are computed from term tables alone; each item's blocks with
the highest bounds are scored until k documents are certain, which gives a threshold; then
all blocks are visited and an item is scored where the bound reaches its threshold, which
rises with what a task has found. Results are exact: a block is left out only if no
document in it can come in, ties included.

Terms are told apart by 64-bit hashes: an item's term meets another one with a chance of
about one in 10**8 for a vocabulary of 10**11 terms.

Defined cases: null texts have no terms and are in no count; items without terms have no
rows; repeated documents and items all stand for themselves; documents with equal scores
come by id, null ids last; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from schemaloom.llm.arrow import as_text
from schemaloom.llm.hashing import Words, hash_words, text_slices
from schemaloom.operators.ordering import top_k
from schemaloom.session import materialize

TOP = 10
BLOCK_DOCS = 2048
#: Terms of the items that are searched at once.
GROUP_TERMS = 200_000
#: Percent of a document's length that enters its normaliser, and the scale of impacts.
LENGTH_SHARE = 90
IMPACT = 1_000_000_000

_CLEAN = np.full(256, 0x20, dtype=np.uint8)
_KEPT = np.concatenate([np.arange(0x30, 0x3A), np.arange(0x41, 0x5B), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)])
_CLEAN[_KEPT] = _KEPT


@dataclass
class Index:
    """Blocks of documents of one stratum: their term tables and postings."""

    blocks: DataFrame
    documents: int
    terms: int


def cut_terms(data: np.ndarray, offsets: np.ndarray) -> Words:
    return hash_words(_CLEAN[data], offsets, lower=True)


def _ints(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _sizes(docs: DataFrame) -> DataFrame:
    """n, docs: how many documents have n terms; documents without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                begins = np.diff((_CLEAN[data] != 0x20).astype(np.int8), prepend=0) == 1
                # A row that begins inside a run of term bytes starts a term of its own.
                edges = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
                begins[edges] = _CLEAN[data[edges]] != 0x20
                sums = np.concatenate([[0], np.cumsum(begins)])
                total.update(np.diff(sums[offsets]).tolist())
        del total[0]
        yield pa.RecordBatch.from_pydict({"n": pa.array(list(total), pa.int64()), "docs": pa.array(list(total.values()), pa.int64())})

    return docs.mapInArrow(run, "n long, docs long").groupBy("n").agg(F.sum("docs").alias("docs"))


def _term_lists(docs: DataFrame, text: str, key: str, documents: int, terms: int, parts: dict[int, int]) -> DataFrame:
    """m, part, key and the distinct terms with their frequencies, of documents with at least one term."""
    kind = docs.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"m long, part int, key {kind}, terms binary, tfs binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = 0
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for at, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                words = cut_terms(data, offsets)
                rows = words.row_of()
                order = np.lexsort((words.hashes, rows))
                h, r = words.hashes[order], rows[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                firsts = np.flatnonzero(new)
                tfs = np.diff(np.append(firsts, len(h)))
                own, owners = h[firsts], r[firsts]
                cuts = np.searchsorted(owners, np.arange(words.rows() + 1))
                counts = words.counts().astype(np.int64)
                found = np.flatnonzero(counts)
                m = (100 - LENGTH_SHARE + LENGTH_SHARE * counts[found] * documents // max(1, terms)).tolist()
                dealt = [(read + i) % parts.get(stratum, 1) for i, stratum in enumerate(m)]
                read += len(m)
                yield pa.RecordBatch.from_arrays([
                    pa.array(m, pa.int64()), pa.array(dealt, pa.int32()), keys.take(pa.array(found + at)),
                    pa.array([_ints(own[cuts[i]:cuts[i + 1]], "<u8") for i in found], pa.binary()),
                    pa.array([_ints(tfs[cuts[i]:cuts[i + 1]], "<u4") for i in found], pa.binary())], schema=arrow)

    return docs.mapInArrow(run, schema)


def make_block(terms: list[bytes], tfs: list[bytes]) -> dict[str, bytes]:
    """Postings of the documents of one block: by term, then tf from high to low, then document.

    terms (sorted), dfs and max_tfs of each; group_starts (first group of each term); tfs and ends of the groups; docs.
    """
    sizes = [len(t) // 8 for t in terms]
    h = np.frombuffer(b"".join(terms), "<u8")
    tf = np.frombuffer(b"".join(tfs), "<u4")
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    order = np.lexsort((doc, -tf.astype(np.int64), h))
    h, tf, doc = h[order], tf[order], doc[order]
    new_term = np.ones(len(h), dtype=bool)
    new_term[1:] = h[1:] != h[:-1]
    new_group = new_term.copy()
    new_group[1:] |= tf[1:] != tf[:-1]
    firsts, groups = np.flatnonzero(new_term), np.flatnonzero(new_group)
    return {
        "terms": _ints(h[firsts], "<u8"), "dfs": _ints(np.diff(np.append(firsts, len(h))), "<u4"), "max_tfs": _ints(tf[firsts], "<u4"),
        "group_starts": _ints(np.append(np.searchsorted(groups, firsts), len(groups)), "<u4"),
        "tfs": _ints(tf[groups], "<u4"), "ends": _ints(np.append(groups[1:], len(h)), "<u4"), "docs": _ints(doc, "<u4"),
    }


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", block_docs: int = BLOCK_DOCS) -> Index:
    """Index of all terms of all documents."""
    source = as_text(docs.select(key, text), text)
    sizes = materialize(_sizes(source.select(text)), "lexical-sizes")
    total = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0)).alias("terms")).first()
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {total.documents}L) div {max(1, total.terms)}L")
    strata = sizes.groupBy(m.alias("m")).agg(F.sum("docs").alias("docs")).filter(F.col("docs") > block_docs)
    # A stratum listed here fills more than one block, so the list is no longer than the index has blocks.
    parts = {r.m: -(-r.docs // block_docs) for r in strata.toLocalIterator()}
    lists = _term_lists(source, text, key, total.documents, total.terms, parts)
    ranges = lists.repartition("m", "part").sortWithinPartitions("m", "part")
    key_type = lists.schema["key"]
    schema = StructType.fromDDL("block long, m long, n_docs int")
    schema = StructType([*schema.fields, StructField("keys", StructType.fromDDL(f"k array<{key_type.dataType.simpleString()}>")["k"].dataType),
                         *StructType.fromDDL("terms binary, dfs binary, max_tfs binary, group_starts binary, tfs binary, ends binary, docs binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        current, keys, terms, tfs = None, [], [], []

        def close() -> pa.RecordBatch:
            nonlocal number, keys, terms, tfs
            made = {"block": number, "m": current, "n_docs": len(keys), "keys": keys, **make_block(terms, tfs)}
            number, keys, terms, tfs = number + 1, [], [], []
            return pa.RecordBatch.from_pylist([made], schema=arrow)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "m", "terms", "tfs")]
            for k in range(batch.num_rows):
                own, stratum, own_terms, own_tfs = (c[k].as_py() for c in columns)
                if keys and (stratum != current or len(keys) == block_docs):
                    yield close()
                current = stratum
                keys.append(own)
                terms.append(own_terms)
                tfs.append(own_tfs)
        if keys:
            yield close()

    return Index(materialize(ranges.mapInArrow(run, schema), "lexical-index"), total.documents, total.terms)


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return IMPACT * tf // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Items:
    """Items as rows of positions in a sorted vocabulary, with weights once document frequencies are known."""

    def __init__(self, texts: list[str | None]) -> None:
        lists = []
        for _, data, offsets in text_slices(pa.array(texts, pa.string())):
            words = cut_terms(data, offsets)
            lists += [np.unique(words.hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
        self.count = len(texts)
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *lists]))
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.places = np.searchsorted(self.vocabulary, np.concatenate([np.empty(0, np.uint64), *lists]))
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, documents: int, dfs: dict[int, int]) -> None:
        for place, df in dfs.items():
            self.weights[place] = weight(documents, df)

    def meet(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the vocabulary and in the block's term table of the terms that both have."""
        if len(terms) == 0 or len(self.vocabulary) == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(terms, self.vocabulary)
        own = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == self.vocabulary)
        return own, at[own]

    def per_item(self, values: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
        """Values by vocabulary position put together by item; 0 for an item without terms."""
        out = np.zeros(self.count, np.int64)
        filled = np.flatnonzero(np.diff(self.first))
        if len(filled):
            out[filled] = ufunc.reduceat(values[self.places], self.first[filled])
        return out

    def bounds(self, terms: np.ndarray, max_tfs: np.ndarray, m: int) -> np.ndarray:
        """No document of the block has a higher score for an item."""
        own, at = self.meet(terms)
        most = np.zeros(len(self.vocabulary), np.int64)
        most[own] = self.weights[own] * impacts(max_tfs[at], m)
        return self.per_item(most, np.add)

    def certain(self, terms: np.ndarray, dfs: np.ndarray) -> np.ndarray:
        """At least so many documents of the block have a score above 0 for an item."""
        own, at = self.meet(terms)
        held = np.zeros(len(self.vocabulary), np.int64)
        held[own] = np.where(self.weights[own] > 0, dfs[at].astype(np.int64), 0)
        return self.per_item(held, np.maximum)


def _column(batch: pa.RecordBatch, name: str, k: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[k].as_py(), kind)


class Block:
    """One block as it is scored; an impact is computed once per term and tf."""

    def __init__(self, batch: pa.RecordBatch, k: int, items: Items) -> None:
        self.items = items
        self.m = batch.column(batch.schema.get_field_index("m"))[k].as_py()
        self.n = batch.column(batch.schema.get_field_index("n_docs"))[k].as_py()
        self.keys = batch.column(batch.schema.get_field_index("keys"))[k]
        self.terms, self.max_tfs = _column(batch, "terms", k, "<u8"), _column(batch, "max_tfs", k, "<u4")
        self.starts, self.tfs, self.ends, self.docs = (_column(batch, c, k, "<u4") for c in ("group_starts", "tfs", "ends", "docs"))
        own, at = items.meet(self.terms)
        self.at = dict(zip(own.tolist(), at.tolist()))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, place: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Documents of a term and what it adds to each."""
        found = self.known.get(place)
        if found is None and place in self.at:
            a, b = self.starts[self.at[place]], self.starts[self.at[place] + 1]
            begin = self.ends[a - 1] if a else 0
            ends = self.ends[a:b].astype(np.int64)
            added = np.repeat(self.items.weights[place] * impacts(self.tfs[a:b], self.m), np.diff(ends, prepend=int(begin)))
            found = self.known[place] = (self.docs[begin:ends[-1]], added)
        return found

    def scores(self, item: int) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for place in self.items.places[self.items.first[item]:self.items.first[item + 1]].tolist():
            found = self.postings(place)
            if found is not None:
                out[found[0]] += found[1]
        return out


def by_rank(entry: tuple[int, object]) -> tuple:
    score, key = entry
    return -score, key is None, 0 if key is None else key


class Best:
    """The k best of every item among what a task has seen, and the score that a newcomer must reach."""

    def __init__(self, k: int, thresholds: np.ndarray) -> None:
        self.k, self.least, self.rows = k, np.maximum(thresholds, 1), {}

    def add(self, item: int, block: Block) -> None:
        scores = block.scores(item)
        found = np.flatnonzero(scores >= self.least[item])
        if not len(found):
            return
        if len(found) > self.k:  # all that tie with the k-th stay for the comparison of ids
            found = found[scores[found] >= np.partition(scores[found], len(found) - self.k)[len(found) - self.k]]
        rows = self.rows.get(item, []) + [(int(scores[d]), block.keys[int(d)].as_py()) for d in found]
        rows.sort(key=by_rank)
        self.rows[item] = rows = rows[:self.k]
        if len(rows) == self.k:
            self.least[item] = max(self.least[item], rows[-1][0])


def _search_group(index: Index, items: Items, k: int) -> DataFrame:
    """item (position in the group), doc, score: the k best of every item and no others."""
    key = index.blocks.schema["keys"].dataType.elementType

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.vocabulary), np.int64)
        for batch in batches:
            for b in range(batch.num_rows):
                own, at = items.meet(_column(batch, "terms", b, "<u8"))
                total[own] += _column(batch, "dfs", b, "<u4")[at]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(met, pa.int64()), "df": pa.array(total[met], pa.int64())})

    tables = index.blocks.select("block", "m", "terms", "dfs", "max_tfs")
    counted = tables.select("terms", "dfs").mapInArrow(frequencies, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
    items.weigh(index.documents, {r.place: r.df for r in counted.toLocalIterator()})

    def first_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's blocks those an item would visit first, as far as they make k documents certain."""
        visits: dict[int, list[tuple[int, int, int]]] = {}
        for batch in batches:
            for b in range(batch.num_rows):
                terms = _column(batch, "terms", b, "<u8")
                block, m = (batch.column(batch.schema.get_field_index(c))[b].as_py() for c in ("block", "m"))
                bounds = items.bounds(terms, _column(batch, "max_tfs", b, "<u4"), m)
                certain = items.certain(terms, _column(batch, "dfs", b, "<u4"))
                for item in np.flatnonzero(bounds).tolist():
                    row = (int(bounds[item]), block, int(certain[item]))
                    own = visits.setdefault(item, [])
                    own.append(row)
                    own.sort(reverse=True)
                    while len(own) > 1 and sum(r[2] for r in own[:-1]) >= k:
                        own.pop()
        rows = [(item, *r) for item, own in visits.items() for r in own]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in rows], pa.int64()) for j, n in enumerate(("item", "bound", "block", "certain"))})

    visits = tables.mapInArrow(first_visits, "item long, bound long, block long, certain long")
    before = Window.partitionBy("item").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    seeds = visits.withColumn("before", F.coalesce(F.sum("certain").over(before), F.lit(0))).where(F.col("before") < k)
    # At most k blocks of every item of the group, which GROUP_TERMS bounds: the index itself is not shuffled.
    first: dict[int, list[int]] = {}
    for r in seeds.select("block", "item").toLocalIterator():
        first.setdefault(r.block, []).append(r.item)
    wanted = F.broadcast(index.blocks.sparkSession.createDataFrame([(b,) for b in first], "block long"))
    result = StructType([*StructType.fromDDL("item long").fields, StructField("doc", key), *StructType.fromDDL("score long").fields])
    arrow = to_arrow_schema(result)

    def emit(best: Best) -> pa.RecordBatch:
        rows = [(item, doc, score) for item, own in best.rows.items() for score, doc in own]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], arrow.field(j).type) for j in range(3)], schema=arrow)

    def visit_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, np.zeros(items.count, np.int64))
        for batch in batches:
            for b in range(batch.num_rows):
                block = Block(batch, b, items)
                for item in first[batch.column(batch.schema.get_field_index("block"))[b].as_py()]:
                    best.add(item, block)
        yield emit(best)

    scored = top_k(index.blocks.join(wanted, "block", "left_semi").mapInArrow(visit_first, result), ["item"], [F.desc("score")], k, F.col("doc"))
    floors = scored.groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)
    thresholds = np.zeros(items.count, np.int64)
    for r in floors.toLocalIterator():
        thresholds[r.item] = r.score

    def visit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, thresholds)
        for batch in batches:
            tables = [items.bounds(_column(batch, "terms", b, "<u8"), _column(batch, "max_tfs", b, "<u4"),
                                   batch.column(batch.schema.get_field_index("m"))[b].as_py()) for b in range(batch.num_rows)]
            # The block that promises most over all items goes first and raises the thresholds for the others.
            for b in sorted(range(batch.num_rows), key=lambda b: -int(tables[b].max(initial=0))):
                due = np.flatnonzero(tables[b] >= best.least)
                if len(due):
                    block = Block(batch, b, items)
                    for item in due.tolist():
                        best.add(item, block)
        yield emit(best)

    return index.blocks.drop("dfs", "block").mapInArrow(visit_all, result)


def search(index: Index, items: DataFrame, text: str = "text", key: str = "item_id", k: int = TOP, group_terms: int = GROUP_TERMS) -> DataFrame:
    """The k documents with the highest scores above 0 for every item: key, rank, doc_id, score."""
    spark = items.sparkSession
    rows = as_text(items.select(key, text), text)
    kept = StructType([*StructType.fromDDL("item long").fields, rows.schema[key]])
    # Work by groups of items: what goes to the tasks is bounded by group_terms and one item.
    parts, group, size = [], [], 0

    def run(group: list) -> DataFrame:
        found = materialize(_search_group(index, Items([r[1] for r in group]), k), "lexical-hits")
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(group)], kept)
        order = [F.desc("score"), F.asc_nulls_last("doc")]
        ranked = top_k(found, ["item"], order, k, F.col("doc"))
        return names.join(ranked, "item").select(key, F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")

    for r in rows.toLocalIterator():
        group.append((r[0], r[1]))
        size += len(r[1] or "") // 2 + 1  # no more terms than that
        if size >= group_terms:
            parts.append(run(group))
            group, size = [], 0
    if group or not parts:
        parts.append(run(group))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
