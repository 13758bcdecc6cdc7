"""Exact vector search that leaves out what the triangle inequality excludes.

The vectors of a scope are dealt to a few pivots, each vector to the nearest by angle, and
to rings of equal width around it. From a query's angle to a pivot follow the least and the
largest angle to any vector of a ring, and only rings that can hold what the operator looks
for are multiplied with the query. A query is one row with the codes of these rings, however many
they are. The vectors of a scope are cut into parts and its queries into chunks of bounded size, so
a scope with a third of all vectors becomes many equal tasks; a task gives back what is kept of all
rings of its part together. A scope has at most ``PIVOTS`` x ``RINGS`` rings; their bounds are one row.

Angles of vectors of very small length say little about their similarity, whose formula
adds a small number to the product of lengths; such vectors form a ring of their own that
every query visits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.vectors import dot, l2_norm
from schemaloom.operators.ordering import top_k
from schemaloom.session import materialize

#: Queries of a chunk; a part has ``PART`` times as many vectors.
BLOCK = 8192
PART = 4
#: Similarities that a task holds at once, and the vectors that are looked at before queries that found one are left out.
AT_ONCE = 1 << 22
STEP = 1024
#: Most pivots of a scope, and the vectors for each of which one is chosen.
PIVOTS = 64
PER_PIVOT = 1024
#: Most rings around a pivot, and the vectors that a ring should hold.
RINGS = 64
PER_RING = 128
#: Shorter vectors are not placed by angle.
WEAK = 0.1
#: Bounds are this much wider than computed, for rounding of angles and of the similarity formula.
SLACK = 2e-6
KEYS = ["scope", "pivot", "ring"]


@dataclass
class Index:
    """vectors (scope, pivot, ring, id, vec), and per scope the pivots and the bounds of all rings."""

    vectors: DataFrame
    guide: DataFrame

    def kind(self, column: str) -> str:
        return self.vectors.schema[column].dataType.simpleString()


def _plain(df: DataFrame, *more: str) -> DataFrame:
    named = df.select("scope", "id", F.col("vec").cast("array<double>").alias("vec"), *more)
    return named.withColumn("_norm", l2_norm(F.col("vec")))


def _angles() -> Column:
    """Angles of ``vec`` to the unit vectors in ``pivots``."""
    cosine = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("vec"), p) / F.col("_norm")))
    return F.transform("pivots", lambda p: F.acos(cosine(p)))


def build(vectors: DataFrame, pivots: int = PIVOTS, per_pivot: int = PER_PIVOT) -> Index:
    """Index of vectors (scope, id, vec)."""
    plain = _plain(vectors)
    strong = plain.filter(F.col("_norm") >= WEAK)
    size = F.count(F.lit(1))
    n_pivots = F.least(F.lit(pivots), F.ceil(size / F.lit(per_pivot)))
    n_rings = F.least(F.lit(RINGS), 2 * F.ceil(size / (n_pivots * F.lit(PER_RING))))
    wanted = strong.groupBy("scope").agg(n_pivots.alias("_wanted"), n_rings.cast("int").alias("_circles"))
    hashed = strong.select("scope", "id", F.transform("vec", lambda x: x / F.col("_norm")).alias("vec"), F.xxhash64("id").alias("_h"))
    chosen = top_k(hashed, ["scope"], [F.col("_h"), F.col("id")], pivots, F.col("id")).join(wanted, "scope").filter(F.col("rank") <= F.col("_wanted"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec"))), lambda e: e["vec"])  # at most ``pivots``
    guide = materialize(chosen.groupBy("scope").agg(listed.alias("pivots"), F.max("_circles").alias("_circles")), "pivots")
    placed = plain.join(guide, "scope", "left").withColumn("_angles", F.when(F.col("_norm") >= WEAK, _angles()))
    near = F.array_min("_angles")
    pivot = F.coalesce(F.array_position("_angles", near).cast("int") - 1, F.lit(-1))
    angle = F.coalesce(near, F.lit(0.0))
    circles = F.coalesce("_circles", F.lit(1))
    ring = F.least(F.floor(angle * circles / F.lit(math.pi)), circles - 1).cast("int")
    dealt = materialize(placed.select("scope", "id", "vec", pivot.alias("pivot"), ring.alias("ring"), angle.alias("angle")), "pivot-rings")
    bounds = dealt.groupBy(*KEYS).agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n"))
    entries = bounds.groupBy("scope").agg(F.collect_list(F.struct("pivot", "ring", "lo", "hi", "n")).alias("rings"))
    return Index(dealt, materialize(entries.join(guide.drop("_circles"), "scope", "left"), "pivot-guide"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row; as a column of its own it would be put in wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ring_code(pivot: Column, ring: Column) -> Column:
    return ((pivot + 1) * F.lit(RINGS) + ring).cast("smallint")


def visits(queries: DataFrame, index: Index, choose: Callable[[Column], Column], *more: str) -> DataFrame:
    """(scope, rings, id, vec, more) of queries (scope, id, vec, more) with the codes of the rings that ``choose`` keeps.

    ``choose`` gets an array of the rings (most, least, pivot, ring, n), ordered by the largest angle to any of their
    vectors, and returns a part of it; it may use the columns ``more``.
    """
    looked = _plain(queries, *more).join(index.guide, "scope")

    def bounds(angles: Column, r: Column) -> Column:
        angle = F.get(angles, r["pivot"])
        known = (r["pivot"] >= 0) & angle.isNotNull()
        return F.struct(
            F.when(known, F.least(F.lit(math.pi), angle + r["hi"])).otherwise(F.lit(math.pi)).alias("most"),
            F.when(known, F.greatest(F.lit(0.0), angle - r["hi"], r["lo"] - angle)).otherwise(F.lit(0.0)).alias("least"),
            r["pivot"].alias("pivot"), r["ring"].alias("ring"), r["n"].alias("n"))

    def kept(angles: Column) -> Column:
        ordered = F.array_sort(F.transform("rings", lambda r: bounds(angles, r)))
        return _once(ordered, lambda rings: F.transform(choose(rings), lambda r: ring_code(r["pivot"], r["ring"])))

    codes = _once(F.when(F.col("_norm") >= WEAK, _angles()), kept)
    return looked.select("scope", codes.alias("rings"), "id", "vec", *more)


def holding(rings: Column, k: int) -> Column:
    """How many of the ordered rings hold k vectors together."""
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("taken"))
    step = lambda a, r: F.when(a["held"] < k, F.struct((a["held"] + r["n"]).alias("held"), (a["taken"] + 1).alias("taken"))).otherwise(a)
    return F.aggregate(rings, start, step, lambda a: a["taken"])


def nearest(rings: Column, k: int) -> Column:
    """The rings that are sure to be near and hold k vectors together."""
    return F.slice(rings, F.lit(1), holding(rings, k))


def beyond(rings: Column, k: int) -> Column:
    """All rings but ``nearest``."""
    return F.slice(rings, holding(rings, k) + 1, F.greatest(F.size(rings), F.lit(1)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


def multiply(visited: DataFrame, index: Index, pick: Callable, epsilon: float | None, block: int = BLOCK, once: bool = False) -> DataFrame:
    """scope, query_id, id, sim of what ``pick(sims, seen, query_ids, ids)`` keeps of each chunk of queries and part of the vectors.

    ``visited`` is read more than once; a column ``floor`` is the least similarity its query looks for. ``seen`` tells the
    pairs that count. ``epsilon`` is added to the product of the lengths; None stands for unit vectors, where a vector of
    length 0 has similarity 0. With ``once`` a query is done when something was kept.
    """
    visited = visited.filter(F.size("rings") > 0)
    cut = lambda c, most: F.ceil(c / F.lit(most)).cast("int")
    stored_n = index.guide.select("scope", F.aggregate("rings", F.lit(0).cast("bigint"), lambda a, r: a + r["n"]).alias("_n"))
    asked_n = visited.groupBy("scope").agg(F.count(F.lit(1)).alias("_q")).join(stored_n, "scope")
    slots = asked_n.select("scope", cut(F.col("_q"), block).alias("_chunks"), cut(F.col("_n"), PART * block).alias("_parts"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    floored = "floor" in visited.columns
    asked = visited.join(slots, "scope").select(
        "scope", "id", "vec", "rings", *(["floor"] if floored else []), own("_chunks").alias("chunk"), every("_parts").alias("part"))
    stored = index.vectors.join(slots, "scope").select(
        "scope", "id", "vec", ring_code(F.col("pivot"), F.col("ring")).alias("code"), own("_parts").alias("part"), every("_chunks").alias("chunk"))
    query_kind = visited.schema["id"].dataType.simpleString()

    def run(key, rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(part):
            return pd.DataFrame({n: pd.Series(dtype=object) for n in ("scope", "query_id", "id", "sim")})
        part = part.sort_values("code", kind="stable")
        code, ids, b = part["code"].to_numpy(), part["id"].to_numpy(), _matrix(part["vec"])
        # Queries with the same first ring stand together, so that a slice of them looks at few others.
        rows = rows.iloc[np.argsort([r[0] for r in rows["rings"]], kind="stable")]
        query_ids, a = rows["id"].to_numpy(), _matrix(rows["vec"])
        looks = np.zeros((len(rows), int(max(code.max(), max(r.max() for r in rows["rings"]))) + 1), dtype=bool)
        looks[np.repeat(np.arange(len(rows)), [len(r) for r in rows["rings"]]), np.concatenate(list(rows["rings"]))] = True
        lengths, sizes = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        floors = rows["floor"].to_numpy(dtype=np.float64) if floored else None
        found = []
        width = STEP if once else len(part)
        height = max(1, AT_ONCE // width)
        for top in range(0, len(rows), height):
            open_ = np.arange(top, min(top + height, len(rows)))
            wanted = np.flatnonzero(looks[open_].any(axis=0)[code])
            for left in range(0, len(wanted), width):
                at = wanted[left:left + width]
                norms = lengths[open_, None] * sizes[None, at]
                sims = a[open_] @ b[at].T / (np.where(norms == 0, 1, norms) if epsilon is None else norms + epsilon)
                seen = looks[np.ix_(open_, code[at])]
                if floored:
                    seen &= sims >= floors[open_, None] - SLACK
                i, j = pick(sims, seen, query_ids[open_], ids[at])
                found.append((query_ids[open_[i]], ids[at[j]], sims[i, j]))
                if once and len(i):
                    open_ = np.delete(open_, i)
                    if not len(open_):
                        break
        if not found:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in ("scope", "query_id", "id", "sim")})
        q, s, sim = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"scope": np.full(len(q), key[0], dtype=object), "query_id": q, "id": s, "sim": sim})

    by = ["scope", "part", "chunk"]
    return asked.groupBy(*by).cogroup(stored.groupBy(*by)).applyInPandas(
        run, f"scope {index.kind('scope')}, query_id {query_kind}, id {index.kind('id')}, sim double")


def visited_share(visited: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """scope, visited, all_pairs: pairs of a query and a ring that were multiplied, and that there are."""
    rings = index.guide.select("scope", F.size("rings").alias("_rings"))
    all_pairs = queries.groupBy("scope").agg(F.count(F.lit(1)).alias("_q")).join(rings, "scope")
    seen = visited.groupBy("scope").agg(F.sum(F.size("rings")).alias("visited"))
    return all_pairs.join(seen, "scope", "left").select(
        "scope", F.coalesce("visited", F.lit(0)).alias("visited"), (F.col("_q") * F.col("_rings")).alias("all_pairs"))
