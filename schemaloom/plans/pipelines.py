"""Multi-step pipelines over many databases at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.constants import SQL_KEYWORDS
from schemaloom.functions.scalars import chat_messages
from schemaloom.operators import catalog, pivots, retrieval, similarity
from schemaloom.operators.ordering import top_k
from schemaloom.session import materialize


@dataclass(frozen=True)
class PoolConfig:
    """Similarity bounds and sizes of candidate selection."""

    sim_min: float = 0.25
    sim_max: float = 0.55
    sim_ambiguity: float = 0.75
    min_candidates: int = 200
    max_candidates: int = 400
    anchor_k: int = 30
    anchor_min_sim: float = 0.15
    small_schema: int = 30
    steps: int = 4
    step: float = 0.05

    def bands(self) -> list[tuple[float, float]]:
        """Band of each relaxation step, the first one unrelaxed."""
        out = [(self.sim_min, self.sim_max)]
        for _ in range(self.steps):
            low, high = out[-1]
            out.append((round(max(0.10, low - self.step), 6), round(min(0.90, high + self.step), 6)))
        return out


def _by_similarity() -> list:
    return [similarity.shown(F.col("sim")).desc(), F.col("word")]


def anchors(names: DataFrame, vectors: DataFrame, vocabulary: DataFrame, cfg: PoolConfig) -> DataFrame:
    """db_id, word, sim, rank: nearest vocabulary words of schemas with few names.

    ``names`` (db_id, word) counts names without a vector as well. A schema has fewer than
    ``small_schema`` names to leave out, so as many words more than anchors are enough.
    """
    small = names.groupBy("db_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < cfg.small_schema).select("db_id")
    centers = similarity.centroids(vectors.join(small, "db_id", "left_semi"))
    near = similarity.word_centroid_similarity(vocabulary, centers, cfg.anchor_min_sim, 1.0, cfg.anchor_k + cfg.small_schema)
    unnamed = near.join(names, ["db_id", "word"], "left_anti")
    return top_k(unnamed, ["db_id"], _by_similarity(), cfg.anchor_k, F.col("word"))


def expanded_vectors(names: DataFrame, vectors: DataFrame, vocabulary: DataFrame, cfg: PoolConfig) -> DataFrame:
    """Schema vectors plus the vectors of the anchors."""
    extra = anchors(names, vectors, vocabulary, cfg).select("db_id", "word").join(vocabulary, "word")
    return vectors.unionByName(extra.select("db_id", "word", "vec"))


def usable_words(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary without keywords."""
    return vocabulary.filter(~F.lower(F.col("word").cast("string")).isin(*SQL_KEYWORDS))


def unambiguous(banded: DataFrame, vectors: DataFrame, names: pivots.Index, vocabulary: DataFrame, ambiguity: float) -> DataFrame:
    """db_id, word, sim of words that name nothing in their schema and are too close to none of its names."""
    unnamed = materialize(banded.join(vectors.select("db_id", "word"), ["db_id", "word"], "left_anti"), "banded")
    ambiguous = similarity.ambiguous_words(unnamed.join(vocabulary, "word"), names, ambiguity)
    return unnamed.join(ambiguous, ["db_id", "word"], "left_anti")


def candidates_in_band(vectors: DataFrame, vocabulary: DataFrame, low: float, high: float, ambiguity: float) -> DataFrame:
    """db_id, word, sim of unambiguous vocabulary words in the band; keywords and schema names are left out first."""
    words = usable_words(vocabulary)
    banded = similarity.word_centroid_similarity(words, similarity.centroids(vectors), low, high)
    return unambiguous(banded, vectors, similarity.name_index(vectors), words, ambiguity)


def candidate_pool(names: DataFrame, vectors: DataFrame, vocabulary: DataFrame, cfg: PoolConfig) -> DataFrame:
    """db_id, word, sim, step, rank.

    A database stops at the first band with enough words, or at the last one. Most stop at once; for the
    others all further steps are read off one pass over what the widest band adds.
    """
    bands = cfg.bands()
    schema = materialize(expanded_vectors(names, vectors, vocabulary, cfg), "schema-vectors")
    words = materialize(usable_words(vocabulary), "usable-words")
    word_index, name_index = similarity.word_index(words), similarity.name_index(schema)
    centers = materialize(similarity.centroids(schema), "centers")

    def inside(band: tuple[float, float]):
        return F.col("sim").between(*band)

    def found(around: DataFrame, low: float, high: float, but=None) -> DataFrame:
        banded = similarity.word_centroid_similarity(word_index, around, low, high)
        kept = banded if but is None else banded.filter(~but)
        return materialize(unambiguous(kept, schema, name_index, words, cfg.sim_ambiguity), "candidates")

    near = found(centers, *bands[0])
    counts = near.groupBy("db_id").agg(F.count(F.lit(1)).alias("n"))
    enough = materialize(counts.filter(F.col("n") >= cfg.min_candidates).select("db_id"), "enough")
    pool = near.join(enough, "db_id", "left_semi").withColumn("step", F.lit(0))
    going = materialize(centers.join(enough, "db_id", "left_anti"), "centers")
    if len(bands) > 1 and not going.isEmpty():
        further = found(going, min(b[0] for b in bands[1:]), max(b[1] for b in bands[1:]), inside(bands[0]))
        rest = near.join(enough, "db_id", "left_anti").unionByName(further)
        sizes = rest.groupBy("db_id").agg(*[F.count_if(inside(b)).alias(f"n{i}") for i, b in enumerate(bands)])
        step = F.lit(len(bands) - 1)
        for i in reversed(range(1, len(bands) - 1)):
            step = F.when(F.col(f"n{i}") >= cfg.min_candidates, F.lit(i)).otherwise(step)
        chosen = rest.join(sizes.select("db_id", step.alias("step")), "db_id")
        keep = reduce(lambda a, b: a | b, [(F.col("step") == i) & inside(b) for i, b in enumerate(bands)])
        pool = pool.unionByName(chosen.filter(keep))
    return top_k(pool, ["db_id"], _by_similarity(), cfg.max_candidates, F.col("word"))


def prompts(original, questions: DataFrame, best: DataFrame, fix_not_null: bool = True) -> DataFrame:
    """idx, db_id, schema_text, messages, tables_included: the prompt of every question over its ``best`` tables.

    ``best`` (idx, db_id, rank, table_name) comes from any search and is bounded by its k. A question
    without tables gets a prompt with an empty schema.
    """
    keys = ["idx", "db_id"]
    selected = best.select(*keys, "table_name")
    columns = original.columns.join(selected, ["db_id", "table_name"])
    fks = catalog.compress(original.fks, selected, keys)
    text = catalog.schema_prompt(selected, columns, fks, keys, fix_not_null)
    listed = F.array_sort(F.collect_list(F.struct("rank", "table_name")))["table_name"]  # k names
    included = best.groupBy(*keys).agg(listed.alias("tables_included"))
    whole = questions.join(text, keys, "left").join(included, keys, "left")
    schema = F.coalesce("schema_text", catalog.prompt_heading())
    return whole.select(
        *keys, schema.alias("schema_text"), chat_messages(schema, F.col("question")).alias("messages"),
        F.coalesce("tables_included", F.array().cast("array<string>")).alias("tables_included"))


def rendered_tables(original) -> DataFrame:
    """db_id, table_name, text of every table, written once: a search reads it twice."""
    texts = catalog.table_text(original.tables, original.columns, original.fks)
    return materialize(texts.select("db_id", "table_name", "text"), "table-texts")


def lexical_prompts(original, questions: DataFrame, k: int = 10, fix_not_null: bool = True) -> DataFrame:
    """Prompts over the best ``k`` tables by BM25."""
    best = materialize(retrieval.bm25_top_tables(rendered_tables(original), original.tables, questions, k), "best-tables")
    return prompts(original, questions, best, fix_not_null)


def dense_prompts(original, questions: DataFrame, question_vectors: DataFrame, table_vectors: DataFrame, k: int = 10, fix_not_null: bool = True) -> DataFrame:
    """Prompts over the best ``k`` tables by vectors (idx, db_id, vec) and (db_id, table_name, vec)."""
    asked = question_vectors.select(F.col("db_id").alias("scope"), F.col("idx").alias("id"), "vec")
    stored = table_vectors.select(F.col("db_id").alias("scope"), F.col("table_name").alias("id"), "vec")
    found = similarity.dense_top(asked, stored, k)
    best = found.select(F.col("left_id").alias("idx"), F.col("scope").alias("db_id"), "rank", F.col("right_id").alias("table_name"))
    return prompts(original, questions, materialize(best, "best-tables"), fix_not_null)


def unfiltered_pieces(original, questions: DataFrame, fix_not_null: bool = True) -> DataFrame:
    """idx, db_id, seq, piece: the whole schema of its database for every question, as ordered pieces.

    The pieces of a database are rendered once, however many questions it has; they repeat types and keywords and are written with zstd.
    """
    rendered = catalog.schema_pieces(original.tables, original.columns, original.fks, fix_not_null=fix_not_null)
    pieces = materialize(rendered, "schema-pieces", compression="zstd")
    return questions.select("idx", "db_id").join(pieces, "db_id").select("idx", "db_id", "seq", "piece")
