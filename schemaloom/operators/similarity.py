"""Vector operators: centroids, similarity bands, ambiguity and dense top-k.

Joins by similarity go through ``pivots``: only rings of vectors that can hold a result are
multiplied, and tasks emit only what is kept. Similarities are compared as they are and
rounded in results; ranks go by the rounded ones, ties by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.vectors import l2_norm
from schemaloom.operators import pivots
from schemaloom.operators.ordering import top_k
from schemaloom.operators.pivots import BLOCK, SLACK, Index
from schemaloom.session import materialize

#: Added to the product of lengths in the formula of cosine similarity.
EPSILON = 1e-8


def normalize(vectors: DataFrame, column: str = "vec") -> DataFrame:
    """Unit-length vectors; a zero vector becomes nulls."""
    with_norm = vectors.withColumn("_norm", l2_norm(F.col(column)))
    scaled = F.transform(column, lambda x: F.try_divide(x.cast("double"), F.col("_norm")))
    return with_norm.withColumn(column, scaled).drop("_norm")


def centroids(vectors: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Element-wise mean of the vectors of each group; a group without vectors has no row."""
    group = group or ["db_id"]
    means = (
        vectors.select(*group, F.posexplode("vec").alias("pos", "x"))
        .groupBy(*group, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))  # one entry per dimension
    return means.groupBy(*group).agg(ordered["x"].alias("vec"))


def shown(sim: Column) -> Column:
    """A similarity as results show and rank it."""
    return F.round(sim, 6)


def _scoped(df: DataFrame) -> DataFrame:
    """Sides without a scope are compared as a whole."""
    return df if "scope" in df.columns else df.select(F.lit(0).alias("scope"), "*")


def _best_in_row(sims: np.ndarray, seen: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best seen entries of each row by rounded value, ties by id."""
    ranked = np.where(seen, sims, -np.inf)
    if sims.shape[1] > k:
        # Only what rounding can bring among the k best is sorted.
        seen = seen & (ranked >= np.partition(ranked, -k, axis=1)[:, -k, None] - 2e-6)
    rows, cols = np.nonzero(seen)
    places = np.empty(len(ids), dtype=np.int64)
    places[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((places[cols], -np.round(sims[rows, cols], 6), rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]


def pairs_in_band(
    left: DataFrame | Index, right: DataFrame, low: float, high: float, best: int | None = None, block: int = BLOCK,
    per_pivot: int = pivots.PER_PIVOT,
) -> DataFrame:
    """(scope, left_id, right_id, sim) with low <= cosine <= high; sides are ([scope,] id, vec), or an index on the left.

    With ``best`` only pairs that can be among so many of a right id are returned; they are cut before they are written.
    """
    def inside(rings):
        return F.filter(rings, lambda r: (F.cos(r["least"]) >= low - SLACK) & (F.cos(r["most"]) <= high + SLACK))

    def pick(sims, seen, right_ids, left_ids):
        kept = seen & (sims >= low) & (sims <= high)
        return _best_in_row(sims, kept, left_ids, best) if best else np.nonzero(kept)

    index = left if isinstance(left, Index) else pivots.build(_scoped(left), per_pivot=per_pivot)
    visited = materialize(pivots.visits(_scoped(right), index, inside), "visits")
    found = pivots.multiply(visited, index, pick, EPSILON, block)
    return found.select("scope", F.col("id").alias("left_id"), F.col("query_id").alias("right_id"), "sim")


def close_to_any(left: DataFrame, right: DataFrame | Index, threshold: float, block: int = BLOCK) -> DataFrame:
    """(scope, left_id) whose cosine to some right vector of the scope exceeds ``threshold``.

    The ring that is sure to be nearest is looked at first; only vectors that are close to none there look at others.
    """
    def reached(rings):
        return F.filter(rings, lambda r: F.cos(r["least"]) > threshold - SLACK)

    def pick(sims, seen, left_ids, right_ids):
        close = seen & (sims > threshold)
        rows = np.nonzero(close.any(axis=1))[0]
        return rows, close[rows].argmax(axis=1)

    left = _scoped(left)
    index = right if isinstance(right, Index) else pivots.build(_scoped(right))

    def hits(queries: DataFrame, choose) -> DataFrame:
        found = pivots.multiply(materialize(pivots.visits(queries, index, choose), "visits"), index, pick, EPSILON, block, once=True)
        return materialize(found.select("scope", F.col("query_id").alias("left_id")).distinct(), "close")

    near = hits(left, lambda rings: reached(pivots.nearest(rings, 1)))
    rest = left.join(near.select("scope", F.col("left_id").alias("id")), ["scope", "id"], "left_anti")
    return near.unionByName(hits(rest, lambda rings: reached(pivots.beyond(rings, 1))))


@dataclass
class DenseSearch:
    """Ranked hits, and how many pairs of a query and a ring were looked at (scope, visited, all_pairs)."""

    hits: DataFrame
    work: DataFrame


def dense_search(
    left: DataFrame, right: DataFrame, k: int = 10, skip_self: bool = False, block: int = BLOCK, per_pivot: int = pivots.PER_PIVOT
) -> DenseSearch:
    """(scope, left_id, rank, right_id, sim): best ``k`` by dot product of unit vectors, ties by id.

    Vectors are scaled to unit length here; one of length 0 has similarity 0 to all. A query first visits
    the nearest rings that hold enough vectors. Its k-th similarity there is the floor that other
    rings have to reach.
    """
    left = _scoped(left)
    index = pivots.build(_scoped(right), per_pivot=per_pivot)
    enough = k + int(skip_self)

    def others(rings):
        return F.filter(pivots.beyond(rings, enough), lambda r: F.cos(r["least"]) >= F.col("floor") - SLACK)

    def pick(sims, seen, left_ids, right_ids):
        return _best_in_row(sims, seen & (right_ids[None, :] != left_ids[:, None]) if skip_self else seen, right_ids, k)

    def found(queries: DataFrame, choose, *more: str) -> tuple[DataFrame, DataFrame]:
        visited = materialize(pivots.visits(queries, index, choose, *more), "visits")
        hits = pivots.multiply(visited, index, pick, None, block)
        return visited, materialize(hits.select("scope", F.col("query_id").alias("left_id"), F.col("id").alias("right_id"), F.round("sim", 6).alias("sim")), "dense-hits")

    order = [F.col("sim").desc(), F.col("right_id")]
    seen, near = found(left, lambda rings: pivots.nearest(rings, enough))
    kept = top_k(near, ["scope", "left_id"], order, k, F.col("right_id"))
    floors = kept.filter(F.col("rank") == k).select("scope", F.col("left_id").alias("id"), F.col("sim").alias("floor"))
    again = left.join(floors, ["scope", "id"], "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    seen_later, far = found(again, others, "floor")
    hits = top_k(near.unionByName(far), ["scope", "left_id"], order, k, F.col("right_id"))
    both = seen.select("scope", "rings").unionByName(seen_later.select("scope", "rings"))
    return DenseSearch(hits, pivots.visited_share(both, left, index))


def dense_top(left: DataFrame, right: DataFrame, k: int = 10, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    return dense_search(left, right, k, skip_self, block).hits


def word_index(words: DataFrame) -> Index:
    """Index of words (word, vec) without a scope, for several joins."""
    return pivots.build(_scoped(words.select(F.col("word").alias("id"), "vec")))


def name_index(names: DataFrame) -> Index:
    """Index of schema names (db_id, word, vec) by database."""
    return pivots.build(names.select(F.col("db_id").alias("scope"), F.col("word").alias("id"), "vec"))


def word_centroid_similarity(words: DataFrame | Index, centers: DataFrame, low: float, high: float, best: int | None = None) -> DataFrame:
    """db_id, word, sim of words within the band around each schema centroid; ``best`` as in ``pairs_in_band``."""
    index = words if isinstance(words, Index) else word_index(words)
    right = centers.select(F.col("db_id").alias("id"), "vec")
    return pairs_in_band(index, right, low, high, best).select(
        F.col("right_id").alias("db_id"), F.col("left_id").alias("word"), "sim"
    )


def ambiguous_words(candidates: DataFrame, names: DataFrame | Index, threshold: float) -> DataFrame:
    """(db_id, word) of candidates (db_id, word, vec) too close to a name of their schema."""
    left = candidates.select(F.col("db_id").alias("scope"), F.col("word").alias("id"), "vec")
    index = names if isinstance(names, Index) else name_index(names)
    return close_to_any(left, index, threshold).select(F.col("scope").alias("db_id"), F.col("left_id").alias("word"))
