"""Jaccard similarity join of documents on word shingles, as connected groups.

Exact, with filters under several global orders of the shingles. Two sets that are
similar enough share a shingle among the first ``size - least overlap + 1`` of each
(the prefix), under any order that is the same for all sets. The orders used here go
from rare to frequent shingles, by powers of two of the frequency that merged count-min
sketches estimate, and differ in a random permutation of those alike. Then

- a set whose prefix is full of unrepeated shingles is linked with nothing; most sets
  are set aside so by a first sketch of the corpus, which only tells once from more,
- only the repeated shingles of a prefix need to be compared,
- what many documents share, such as a license, hardly ever enters a prefix,
- a pair is a candidate if its prefixes meet under every order; the others are
  dropped before the sets are compared exactly.

Sets that are equal are one class. Links are wanted as groups, so in the first rounds
every class is compared with one other: the one that leads most of its posting lists.
Those found similar are in one group and need no comparison among each other. Then the pairs
of different groups are compared that the place of a common shingle allows: sets share
no more than either has from their first common shingle on. If such pairs are
many, the classes of a list are compared with a few of them at a time, which then leave the
list, as do those that no other size in it allows a link. No link that joins two groups is lost, and large groups of near copies cost a few comparisons each.

Defined cases: null and blank texts have no shingles, size 0 and are alone; texts
with fewer words than a shingle are one shingle; rows may repeat an id or have a
null id (a group's id is its smallest id that is not null); row order is irrelevant.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.llm import sketch
from schemaloom.llm.arrow import as_text
from schemaloom.llm.hashing import hash_words, mix, shingle_hashes, text_slices
from schemaloom.session import materialize

SHINGLE = 5
#: Least similarity in percent.
PERCENT = 75
ORDERS = 3
SKETCH_ROWS = 1
#: Cells of the sketch; a merged sketch is one bit a cell (32 MB). It only has to tell sets of mostly unrepeated shingles.
LOG2_CELLS = 28
#: Pairs of postings of different groups that meet without another round, per row that the posting lists have at first.
PAIRS_PER_POSTING = 4
#: Documents of a list that the others are compared with in the first round.
PIVOTS = 8
#: Rounds that compare each class with one leader, and the least share of links in a round that is followed by another.
LEADERS = 3
LEAST_FOUND = 0.1
#: Cells and cap of the second sketch, of the sets that are left (a byte a cell).
LOG2_COUNTS = 24
MOST_COUNTED = 255
ROW_SCHEMA = "doc_id long, n long, class binary, quota int, tokens array<long>"


@dataclass
class Sets:
    """Distinct shingles of consecutive rows, sorted within each row."""

    tokens: np.ndarray
    first: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Sets:
    words = hash_words(data, offsets, lower=True)
    hashes, rows = shingle_hashes(words, width)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return Sets(hashes[new], np.searchsorted(rows[new], np.arange(words.rows() + 1)))


def classes_of(sets: Sets) -> list[bytes | None]:
    """128-bit name of every set; None for the empty set."""
    sizes = sets.sizes()
    out: list[bytes | None] = [None] * len(sizes)
    full = np.flatnonzero(sizes)
    if len(full):
        sums = [np.add.reduceat(mix(sets.tokens, s), sets.first[full]) for s in (11, 12)]
        for i, raw in zip(full, np.stack(sums, axis=1).astype(">u8")):
            out[i] = raw.tobytes()
    return out


def least_overlap(n):
    """Smallest part of a set of ``n`` that a similar set must share."""
    return -(-PERCENT * n // 100)


def class_of_texts(texts: pa.Array, width: int = SHINGLE) -> list[bytes | None]:
    out: list[bytes | None] = []
    for _, data, offsets in text_slices(texts):
        out.extend(classes_of(shingle_sets(data, offsets, width)))
    return out


def _rows(docs: DataFrame, bits, width: int, log2_cells: int) -> DataFrame:
    """Size and class of every document; where a link is possible, its repeated shingles and how many of them are in a prefix."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                sizes = sets.sizes()
                rare = ~sketch.repeated(bits.value, sets.tokens, log2_cells)
                seen = np.concatenate([[0], np.cumsum(rare)])
                quota = sizes - least_overlap(sizes) + 1 - (seen[sets.first[1:]] - seen[sets.first[:-1]])
                use = (sizes > 0) & (quota > 0)
                tokens = [sets.tokens[a:b][~rare[a:b]].view(np.int64).tolist() if u else None for u, a, b in zip(use, sets.first, sets.first[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(classes_of(sets), pa.binary()),
                    pa.array(np.where(use, quota, 0).astype(np.int32)), pa.array(tokens, pa.list_(pa.int64())),
                ], names=["doc_id", "n", "class", "quota", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, ROW_SCHEMA)


def _with_prefixes(classes: DataFrame, orders: int, log2_counts: int) -> DataFrame:
    """Classes that can have a link, with a number, the shingles that other classes have too, and those of them in their prefix under each order.

    Of the prefixes under the other orders only half of each hash is kept: they are a test that may let more through.
    """

    def keys(batch):
        yield batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    parts = sketch.collect_keys(classes.select("tokens"), keys, 1, log2_counts, MOST_COUNTED)
    counts = classes.sparkSession.sparkContext.broadcast(sketch.merge(parts, 1, log2_counts, MOST_COUNTED))

    def run(batches):
        for batch in batches:
            shared, first, others = [], [], []
            for row in zip(batch.column(2).to_pylist(), batch.column(3)):
                quota, tokens = row[0], row[1].values.to_numpy(zero_copy_only=False).view(np.uint64)
                seen = sketch.estimates(counts.value, tokens, log2_counts)
                often = tokens[seen > 1]
                quota = min(quota - (len(tokens) - len(often)), len(often))
                if quota <= 0:
                    shared.append([]), first.append([]), others.append([])
                    continue
                level = np.log2(seen[seen > 1]).astype(np.int64)
                prefixes = [often[np.lexsort((mix(often, 100 + k), level))[:quota]] for k in range(orders)]
                shared.append(often.view(np.int64).tolist()), first.append(prefixes[0].view(np.int64).tolist())
                others.append([(p >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist() for p in prefixes[1:]])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(shared, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.list_(pa.int32()))),
            ], names=["class", "n", "tokens", "first", "others"])

    schema = "class binary, n long, tokens array<long>, first array<long>, others array<array<int>>"
    found = classes.select("class", "n", "quota", "tokens").mapInArrow(run, schema).where(F.size("first") > 0)
    found = materialize(found.withColumn("id", F.monotonically_increasing_id()), "prefixes")
    counts.destroy()
    return found


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of undirected ``edges`` (a, b); the root is the smallest node reachable.

    Every node takes the smallest root among itself and its neighbours, then the root of
    its root, until nothing changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnsRenamed({"node": "b", "root": "near"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = materialize(lower.join(jump, "low", "left").select("node", F.col("root").alias("was"), F.least("low", "far").alias("root")), "roots")
        changed = after.where("was <> root").limit(1).count()
        roots = after.select("node", "root")
        if not changed:
            return roots


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose prefixes meet under all orders and that are similar."""
    used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-classes")
    sets = sets.join(used, "id", "left_semi")
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("others").alias("oa"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.col("others").alias("ob"))
    meet = F.forall(F.zip_with("oa", "ob", lambda x, y: F.arrays_overlap(x, y)), lambda x: x)
    shared = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").where(meet).where(100 * shared >= PERCENT * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _rooted(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("root", F.col("id"))
    return lists.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


#: Postings of a token that can be the first one shared by two similar classes of different groups. A pair
#: shares no more than what either has from that token on; ``most`` is the size of the other that this allows.
CAN_LINK = "root <> root2 and n2 <= most and n <= most2"
#: One posting of such a pair allows an equal size, as it is that of the larger class.
WIDE = "most >= n"


def _live(lists: DataFrame) -> DataFrame:
    """Postings that CAN_LINK may hold for with any other of their list, by the least size and the largest bound in it."""
    ends = lists.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("low"), F.max("most").alias("high"))
    return lists.join(ends.where("m > 1"), "token").where("most >= low and n <= high").drop("m", "low", "high")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _leader_pairs(rooted: DataFrame, turn: int) -> DataFrame:
    """Each class with the one that leads most of its lists; a leader is the same for all lists that it could lead."""
    head = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "most", "root"))
    heads = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.expr(WIDE)).alias("wide"), head.alias("head"))
    heads = heads.where("low <> high and wide").select("token", *[F.col(f"head.{c}").alias(f"{c}2") for c in ("id", "n", "most", "root")])
    met = rooted.join(heads, "token").where(CAN_LINK).groupBy("id", "id2").agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy("id").agg(F.max(F.struct("c", "id2"))["id2"].alias("id2")).select(*_ordered("id", "id2")).distinct()


def _groups(sets: DataFrame) -> DataFrame:
    """(class, root) of the classes that are linked with another one."""
    rest = F.size("tokens") - F.col("at")
    most = F.floor((100 + PERCENT) * rest / F.lit(PERCENT)).cast("long") - F.col("n")
    postings = materialize(sets.select("id", "n", "tokens", F.posexplode("first").alias("at", "token")).select("id", "n", "token", most.alias("most")), "postings")
    lists = materialize(_live(postings), "lists")
    roots, pivots, postings_at_first = None, PIVOTS, lists.count()

    def joined(pairs: DataFrame) -> tuple[DataFrame | None, int]:
        links = materialize(_similar(pairs, sets), "links")
        found = links.count()
        return (connected(links if roots is None else links.union(roots.where("node <> root").select("node", "root"))) if found else roots), found

    for turn in range(LEADERS):
        pairs = materialize(_leader_pairs(_rooted(lists, roots), turn), "leader-pairs")
        met = pairs.count()
        if met:
            roots, found = joined(pairs)
        if not met or found < LEAST_FOUND * met:
            break
    while True:
        rooted = _rooted(lists, roots).withColumn("wide", F.expr(WIDE))
        per_root = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), F.count_if("wide").alias("w"))
        spread = per_root.groupBy("token").agg(F.sum("c").alias("m"), F.sum("w").alias("w"), F.sum(F.col("c") * F.col("w")).alias("same"), F.count(F.lit(1)).alias("groups"))
        live = spread.where("groups > 1 and w > 0")
        open_ = materialize(rooted.join(live.select("token", (F.col("m") * F.col("w") - F.col("same")).alias("pairs"), "m"), "token"), "open-lists")
        size = open_.agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("pairs") / F.col("m")).alias("pairs")).first()
        if not size["m"]:
            break
        final = size["pairs"] <= PAIRS_PER_POSTING * postings_at_first
        other = open_.where("wide").select("token", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "most", "root")])
        if not final:
            turn = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("id2"), "id2"))
            other = materialize(other.withColumn("turn", turn).where(F.col("turn") <= pivots).drop("turn"), "pivots")
            left = open_.select("token", "id", "n", "most").join(other.select("token", F.col("id2").alias("id")), ["token", "id"], "left_anti")
            lists = materialize(_live(left), "lists")
            pivots *= 4
        pairs = open_.join(other, "token").where(CAN_LINK).select(*_ordered("id", "id2")).distinct()
        roots, _ = joined(materialize(pairs, "pairs"))
        if final:
            break
    if roots is None:
        return sets.select("class", F.col("class").alias("root")).limit(0)
    name = lambda c: sets.select(F.col("id").alias(c), F.col("class").alias(f"{c}_class"))
    return roots.join(name("node"), "node").join(name("root"), "root").select(F.col("node_class").alias("class"), F.col("root_class").alias("root"))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, orders: int = ORDERS,
         log2_cells: int = LOG2_CELLS, log2_counts: int = LOG2_COUNTS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, class) of all documents and classes (class, root, component_id) of all non-empty sets."""
    spark = docs.sparkSession
    source = as_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text")

    def keys(batch):
        for _, data, offsets in text_slices(batch.column(0)):
            yield shingle_sets(data, offsets, width).tokens

    parts = sketch.collect_keys(source.select("text"), keys, SKETCH_ROWS, log2_cells)
    bits = spark.sparkContext.broadcast(sketch.merge(parts, SKETCH_ROWS, log2_cells))
    rows = materialize(_rows(source, bits, width, log2_cells), "shingle-sets")
    bits.destroy()
    classes = materialize(rows.where("tokens is not null").groupBy("class").agg(
        F.first("n").alias("n"), F.first("quota").alias("quota"), F.first("tokens").alias("tokens")), "classes")
    groups = _groups(_with_prefixes(classes, orders, log2_counts))
    least = materialize(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")), "class-ids")
    rooted = least.join(groups, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "n", "class"), materialize(rooted.join(ids, "root").select("class", "root", "component_id"), "components")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, classes = link(docs, doc_id, text, **options)
    found = rows.join(classes.select("class", "component_id"), "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row with the smallest id of every group of linked documents; other columns pass through.

    Documents without words are kept. Rows without an id give way to rows with one; rows
    of a group that share the smallest id are one row, the one whose text comes first.
    """
    from pyspark.sql.types import BinaryType

    from schemaloom.llm.arrow import add_columns

    _, classes = link(docs, doc_id, text, **options)
    named = add_columns(docs, text, [("__class", BinaryType())], lambda: lambda texts: [class_of_texts(pa.array(texts, pa.large_string()))])
    groups = classes.withColumnsRenamed({"class": "__class", "root": "__root", "component_id": "__component"})
    found = named.join(groups, "__class", "left")
    first = found.where(F.col("__class").isNull() | F.col(doc_id).cast("long").eqNullSafe(F.col("__component")))
    turn = F.row_number().over(Window.partitionBy("__root").orderBy(F.col(text)))
    kept = first.where("__class is not null").withColumn("__turn", turn).where("__turn = 1")
    return first.where("__class is null").select(*[f"`{c}`" for c in docs.columns]).unionByName(kept.select(*[f"`{c}`" for c in docs.columns]))
