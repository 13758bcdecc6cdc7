"""Registered queries: every operator over the whole of its input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions import draws, scalars
from schemaloom.functions import vectors as vec
from schemaloom.operators import augment, catalog, evaluate, profile, retrieval, similarity, vocab
from schemaloom.operators.augment import Catalog, Recipe
from schemaloom.operators.ordering import number_by_digest, number_in_order
from schemaloom.plans import pipelines
from schemaloom.plans.pipelines import PoolConfig
from schemaloom.session import materialize, shared_dir
from schemaloom.sources import files
from schemaloom.sources import tables as src
from schemaloom.streaming import results as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOP = 10
POOL = PoolConfig(sim_min=0.15, sim_max=0.25, sim_ambiguity=0.35, min_candidates=75, max_candidates=1000)
VARIANT = ["model", "level", "size"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def original(spark, d) -> Catalog:
    return Catalog(src.catalog_tables(spark, d), src.catalog_columns(spark, d), src.catalog_fks(spark, d))


def table_defs(spark, d) -> DataFrame:
    return catalog.table_defs(*vars(original(spark, d)).values())


def lined(column: str):
    return F.array_join(F.col(column), ",")


# --- catalog ----------------------------------------------------------------
@query
def catalog_explode(spark, d):
    """Columns of all tables, from files with one nested table per line."""
    path = shared_dir(spark, "table-defs")
    files.write_table_defs(table_defs(spark, d), path)
    return catalog.explode_columns(files.read_table_defs(spark, path))


@query
def catalog_assemble(spark, d):
    """Nested tables: ordinal, columns, keys and references."""
    fk = F.transform("foreign_keys", lambda f: F.concat_ws(".", f["targetColumn"], f["sourceTable"], f["sourceColumn"]))
    return table_defs(spark, d).select(
        "dataset", "db_id", "table_name", "table_ord",
        F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("column_names"),
        F.array_join("primary_keys", ",").alias("primary_keys"),
        F.array_join(fk, ",").alias("foreign_keys"),
    )


@query
def catalog_tables(spark, d):
    """Tables among the catalog objects; pages and conversations play views and system tables."""
    def objects(name, key, kind, prefix):
        return src.table(spark, d, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("table_name"), F.lit(kind).alias("kind")
        )

    rows = (
        objects("documents", "doc_id", "table", "t")
        .unionByName(objects("pages", "page_id", "view", "v"))
        .unionByName(objects("labels", "doc_id", "table", "sqlite_stat"))
    )
    return catalog.user_tables(rows)


@query
def primary_keys(spark, d):
    return catalog.primary_keys(src.catalog_columns(spark, d)).withColumn("primary_keys", lined("primary_keys"))


@query
def foreign_keys(spark, d):
    flat = F.transform("foreign_keys", lambda f: F.concat_ws(".", f["local_col"], f["ref_table"], f["ref_col"]))
    return catalog.foreign_keys(src.catalog_fks(spark, d)).withColumn("foreign_keys", F.array_join(flat, ","))


def union_all(frames) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def all_tables(spark, d) -> dict[str, DataFrame]:
    return {name: src.table(spark, d, name) for name in src.TABLES}


@query
def key_discovery(spark, d):
    """Minimal keys of one or two columns of all tables."""
    return union_all([profile.discover_keys(df, name) for name, df in all_tables(spark, d).items()])


@query
def fk_discovery(spark, d):
    """Columns whose values all occur in another column, over all columns of all tables."""
    return profile.references(all_tables(spark, d))


@query
def column_profile(spark, d):
    return union_all([profile.profile_columns(df, name) for name, df in all_tables(spark, d).items()])


@query
def column_sketches(spark, d):
    return union_all([profile.sketch_columns(df, name) for name, df in all_tables(spark, d).items()])


@query
def question_dbs(spark, d):
    return files.question_databases(src.questions(spark, d))


@query
def resume_pending(spark, d):
    """Two models are asked about every document; each labelled one was answered by one of them."""
    models = F.explode(F.array(F.lit("m1"), F.lit("m2")))
    asked = src.table(spark, d, "documents").select(models.alias("model"), F.col("doc_id").alias("idx"), F.col("source").alias("db_id"))
    answered = F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2")
    done = src.table(spark, d, "labels").select(answered.alias("model"), F.col("doc_id").alias("index"))
    path = shared_dir(spark, "response-log")
    files.append_responses(done, path)
    return files.resume(asked, spark, path, ("model", "idx"))


@query
def variant_partitions(spark, d):
    path = shared_dir(spark, "variants")
    files.write_variants(src.result_log(spark, d), path)
    back = files.read_variants(spark, path)
    return back.groupBy("size", "level", "db_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("tokens")
    )


# --- scalars ----------------------------------------------------------------
@query
def type_affinity(spark, d):
    columns = src.catalog_columns(spark, d)
    return catalog.with_affinity(columns).groupBy("db_id", "type", "typegroup").agg(F.count(F.lit(1)).alias("n"))


@query
def type_exact(spark, d):
    typed = src.catalog_columns(spark, d).select("db_id", "type", scalars.exact_type(F.col("type")).alias("t"))
    return typed.groupBy("db_id", F.col("type").alias("declared"), "t.type", "t.typegroup").agg(F.count(F.lit(1)).alias("n"))


@query
def make_column(spark, d):
    c = src.catalog_columns(spark, d)
    made = c.select("db_id", "table_name", "col_ord", scalars.make_column(F.col("name"), F.col("type"), F.col("pk"), F.col("not_null")).alias("c"))
    return made.select("db_id", "table_name", "col_ord", "c.*")


@query
def tokenize(spark, d):
    docs = src.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode_outer(scalars.tokens(F.col("text"))).alias("pos", "token")).filter("pos is not null")


@query
def table_text(spark, d):
    return catalog.table_text(*vars(original(spark, d)).values()).select("db_id", "table_name", "text")


@query
def schema_prompt(spark, d):
    """The whole schema text of every database."""
    return catalog.schema_prompt(*vars(original(spark, d)).values())


@query
def schema_prompt_as_published(spark, d):
    """The layout with NOT NULL on nullable columns."""
    return catalog.schema_prompt(*vars(original(spark, d)).values(), fix_not_null=False)


@query
def chat_messages(spark, d):
    """Turns of each conversation as numbered messages."""
    turns = src.table(spark, d, "conversations")
    order = [F.col("turn"), F.col("role"), F.md5(F.col("text").cast("binary"))]
    return number_in_order(turns, ["conv_id"], order, "pos").select("conv_id", F.col("pos").cast("int").alias("pos"), "role", F.col("text").alias("content"))


@query
def sql_table_refs(spark, d):
    return evaluate.referenced_tables(src.result_log(spark, d))


@query
def tool_output_parse(spark, d):
    """Arguments built from the event payload; each event type breaks them in its own way."""
    events = src.table(spark, d, "events")
    sql = F.concat(F.lit("select "), F.get_json_object("props", "$.k"))
    args = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"sql": "'), sql, F.lit('"}')))
        .when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"sql": "'), sql))
        .otherwise(F.concat(F.lit('{"k": 1, "sql": "'), sql, F.lit('"}')))
    )
    return events.select("event_id", scalars.tool_sql(args).alias("sql"))


# --- vectors ----------------------------------------------------------------
@query
def cosine_pairs(spark, d):
    """Cosine of each vector and the next one by id."""
    e = src.table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


@query
def l2_normalize(spark, d):
    e = src.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    unit = similarity.normalize(e).select("vec_id", F.posexplode_outer("vec").alias("pos", "x")).filter("pos is not null")
    return unit.withColumn("x", F.round("x", 6))


@query
def vector_lookup(spark, d):
    """Documents with a vector of the same id; documents without one are dropped."""
    words = src.table(spark, d, "documents").select(F.col("doc_id").alias("word"))
    vectors = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), "label", "embedding")
    return vocab.lookup_vectors(words, vectors).select("word", "label", F.size("embedding").alias("dims"))


@query
def centroid(spark, d):
    c = similarity.centroids(src.schema_vectors(spark, d)).select("db_id", F.posexplode("vec").alias("pos", "x"))
    return c.withColumn("x", F.round("x", 6))


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("sim", similarity.shown(F.col("sim")))


@query
def word_centroid_sim(spark, d):
    centers = similarity.centroids(src.schema_vectors(spark, d))
    return shown(similarity.word_centroid_similarity(src.vocabulary_vectors(spark, d), centers, POOL.anchor_min_sim, 1.0))


@query
def similarity_band(spark, d):
    centers = similarity.centroids(src.schema_vectors(spark, d))
    return shown(similarity.word_centroid_similarity(src.vocabulary_vectors(spark, d), centers, POOL.sim_min, POOL.sim_max))


@query
def ambiguity_anti_join(spark, d):
    return shown(pipelines.candidates_in_band(
        src.schema_vectors(spark, d), src.vocabulary_vectors(spark, d), POOL.sim_min, POOL.sim_max, POOL.sim_ambiguity
    ))


@query
def anchor_expand(spark, d):
    names = src.schema_vectors(spark, d)
    return shown(pipelines.anchors(names.select("db_id", "word"), names, src.vocabulary_vectors(spark, d), POOL))


@query
def candidate_topn(spark, d):
    centers = similarity.centroids(src.schema_vectors(spark, d))
    near = similarity.word_centroid_similarity(src.vocabulary_vectors(spark, d), centers, POOL.sim_min, POOL.sim_max, best=20)
    return pipelines.top_k(shown(near), ["db_id"], [F.col("sim").desc(), F.col("word")], 20, F.col("word"))


@query
def candidate_pool(spark, d):
    names = src.schema_vectors(spark, d)
    return shown(pipelines.candidate_pool(names.select("db_id", "word"), names, src.vocabulary_vectors(spark, d), POOL))


@query
def dense_topk(spark, d):
    """Every vector as a question over the other vectors of its label."""
    v = src.table(spark, d, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return similarity.dense_top(v, v, TOP, skip_self=True).select(
        F.col("scope").alias("label"), F.col("left_id").alias("query_id"), "rank", F.col("right_id").alias("vec_id"), F.col("sim").alias("score")
    )


@query
def dense_topk_tables(spark, d):
    """Questions over the tables of their database that have a vector."""
    vectors = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = src.questions(spark, d).select(F.col("db_id").alias("scope"), F.col("idx").alias("id")).join(vectors, "id")
    tables = src.table(spark, d, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("id")).join(vectors, "id")
    return similarity.dense_top(asked, tables, TOP).select(
        F.col("left_id").alias("idx"), F.col("scope").alias("db_id"), "rank", src.table_name(F.col("right_id")).alias("table_name"), F.col("sim").alias("score")
    )


# --- vocabulary -------------------------------------------------------------
@query
def vocab_clean(spark, d):
    counts = src.word_counts(spark, d)
    return vocab.clean_vocabulary(src.lexicon(counts), src.whitelist(counts))


@query
def vocab_sense_filter(spark, d):
    return vocab.drop_excluded_senses(src.lexicon(src.word_counts(spark, d)))


@query
def schema_names(spark, d):
    return vocab.schema_names(src.catalog_tables(spark, d), src.catalog_columns(spark, d))


@query
def original_columns(spark, d):
    return src.catalog_columns(spark, d).select("db_id", "name").distinct()


@query
def candidate_exclude(spark, d):
    """Words of each source's pages that occur in a document, name none of the source's tables and columns and are no keyword."""
    pages = src.table(spark, d, "pages")
    found = F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit(r"\p{L}+"), F.lit(0)))
    source = F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string"))
    words = pages.select(source.alias("db_id"), F.explode_outer(found).alias("word")).filter("word is not null").distinct()
    known = src.table(spark, d, "documents").select(F.explode_outer(scalars.raw_tokens(F.col("text"))).alias("word")).filter("word <> ''").distinct()
    tables = src.catalog_tables(spark, d).select("db_id", F.col("table_name").alias("name"))
    names = src.catalog_columns(spark, d).select("db_id", "name").unionByName(tables)
    return vocab.exclude_candidates(words, names, known)


def pools(spark, d) -> DataFrame:
    return src.candidate_pools(spark, d, vocab_clean(spark, d))


def names_of(spark, d) -> DataFrame:
    return vocab.all_names(src.catalog_tables(spark, d), src.catalog_columns(spark, d))


@query
def fresh_words(spark, d):
    path = shared_dir(spark, "pools")
    files.write_pools(pools(spark, d), path)
    return vocab.fresh_words(spark.read.parquet(path), names_of(spark, d))


# --- retrieval --------------------------------------------------------------
def texts(spark, d) -> DataFrame:
    """Documents as tables with their text."""
    return src.table(spark, d, "documents").select(
        F.col("source").alias("db_id"), src.table_name(F.col("doc_id")).alias("table_name"), "text"
    )


def best_tables(spark, d) -> DataFrame:
    return retrieval.bm25_top_tables(texts(spark, d), src.catalog_tables(spark, d), src.questions(spark, d), TOP)


@query
def bm25_stats(spark, d):
    stats = retrieval.bm25_stats(texts(spark, d))
    return stats.withColumn("idf", F.round("idf", 6)).withColumn("avg_len", F.round("avg_len", 6))


@query
def bm25_topk(spark, d):
    return best_tables(spark, d)


@query
def bm25_topk_schema(spark, d):
    """The same ranking over the rendered schema text of every table."""
    base = original(spark, d)
    rendered = catalog.table_text(base.tables, base.columns, base.fks).select("db_id", "table_name", "text")
    return retrieval.bm25_top_tables(materialize(rendered, "table-texts"), base.tables, src.questions(spark, d), TOP)


@query
def retrieval_scope(spark, d):
    return retrieval.scope(src.questions(spark, d).select("idx", "db_id"), src.catalog_tables(spark, d))


@query
def compress_schema(spark, d):
    best = materialize(best_tables(spark, d), "best-tables")
    return catalog.compress(src.catalog_fks(spark, d), best, ["idx", "db_id"]).select(
        "idx", "db_id", "table_name", "local_col", "ref_table", "ref_col"
    )


def told(prompts: DataFrame) -> DataFrame:
    return prompts.select(
        "idx", "db_id", "schema_text", lined("tables_included").alias("tables_included"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.element_at("messages", -1)["content"].alias("last_message"),
    )


@query
def prompt_pipeline(spark, d):
    return told(pipelines.lexical_prompts(original(spark, d), src.questions(spark, d), TOP))


@query
def prompt_dense(spark, d):
    """Prompts over the nearest tables; questions and documents have the vectors of their numbers."""
    vectors = src.table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vec"))
    asked = src.questions(spark, d).join(vectors, F.col("idx") == F.col("vec_id")).select("idx", "db_id", "vec")
    stored = src.table(spark, d, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).select(
        F.col("source").alias("db_id"), src.table_name(F.col("doc_id")).alias("table_name"), "vec")
    return told(pipelines.dense_prompts(original(spark, d), src.questions(spark, d), asked, stored, TOP))


@query
def prompt_unfiltered(spark, d):
    return pipelines.unfiltered_pieces(original(spark, d), src.questions(spark, d))


# --- metrics ----------------------------------------------------------------
@query
def metrics_overall(spark, d):
    return evaluate.overall_metrics(src.result_log(spark, d), ["model", "level"])


@query
def metrics_correct(spark, d):
    return src.result_log(spark, d).groupBy("model", "level").agg(*evaluate.correct_aggregates())


@query
def metrics_join_subset(spark, d):
    return src.result_log(spark, d).groupBy("model", "level").agg(*evaluate.join_aggregates())


@query
def metrics_synthetic_subset(spark, d):
    log = evaluate.with_synthetic_flag(src.result_log(spark, d), src.log_synthetic_tables(spark, d))
    return log.groupBy("model", "level").agg(*evaluate.synthetic_aggregates())


@query
def synthetic_refs(spark, d):
    return evaluate.synthetic_references(src.result_log(spark, d), src.log_synthetic_tables(spark, d))


@query
def score_sql(spark, d):
    log = src.result_log(spark, d)
    scored = log.withColumn("execution_accuracy", F.when(F.col("sql_pred").isNotNull(), F.col("execution_accuracy")))
    return evaluate.accuracy(scored, ["model"])


@query
def execution_match(spark, d):
    gold, pred = src.result_bags(spark, d)
    return evaluate.execution_match(gold, pred, ["a", "b", "c"])


def turned(df: DataFrame, columns: list[str], shift) -> DataFrame:
    """The columns as text, every result's turned round by a number of its own."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    at = lambda i: F.get(cells, F.pmod(F.lit(i) + shift, F.lit(len(columns))).cast("int"))
    return df.select("qid", *[at(i).alias(c) for i, c in enumerate(columns)])


@query
def execution_match_any_order(spark, d):
    """Predicted columns come in another order for every question; some order has to match."""
    gold, pred = src.result_bags(spark, d)
    columns = ["a", "b", "c"]
    return evaluate.execution_match(gold, turned(pred, columns, F.col("qid")), columns, any_column_order=True)


@query
def execution_match_ordered(spark, d):
    """Every third statement orders its rows; every fifth result comes in reverse."""
    gold, pred = src.result_bags(spark, d, position=True)
    reverse = pred.withColumn("pos", F.when(F.col("qid") % 5 == 0, -F.col("pos")).otherwise(F.col("pos")))
    ordered = src.table(spark, d, "lineitem").filter(F.col("l_suppkey") % 3 == 0).select(F.col("l_suppkey").alias("qid"))
    return evaluate.execution_match(gold, reverse, ["a", "b", "c"], "pos", ordered_questions=ordered)


@query
def execution_match_wide(spark, d):
    """Ten columns in any order, two of them equal to others and one empty."""
    gold, pred = src.wide_results(spark, d)
    return evaluate.execution_match(gold, turned(pred, src.WIDE, F.col("qid")), src.WIDE, any_column_order=True)


@query
def variant_report(spark, d):
    return evaluate.overall_metrics(src.result_log(spark, d), VARIANT)


@query
def evaluation_report(spark, d):
    """All measures of every variant, the accuracy worked out from the rows that both statements return."""
    log = src.report_log(spark, d)
    gold, pred = src.report_rows(spark, d)
    judged = materialize(evaluate.with_accuracy(log, gold, pred, src.REPORT_COLUMNS, "pos"), "judged-log")
    return evaluate.evaluation_report(judged, src.log_synthetic_tables(spark, d), VARIANT)


@query
def results_with_gold(spark, d):
    log = src.result_log(spark, d)
    responses = log.select(*evaluate.KEY, "db_id", "sql_pred", "total_tokens")
    return evaluate.attach_gold(responses, log.select("idx", "db_id", "sql_gold"))


@query
def stream_metrics(spark, d):
    return streaming.stream_metrics(spark, d, src.as_result_log, ["model", "level"])


@query
def stream_redelivered(spark, d):
    """The same measures although the log arrives in parts, each of them twice and one once more at the end."""
    return streaming.redelivered_metrics(spark, src.result_log(spark, d), ["model", "level"])


# --- seeded augmentation ----------------------------------------------------
@query
def seeded_shuffle(spark, d):
    tables = src.catalog_tables(spark, d).select("db_id", "table_name")
    digest = draws.digest("shuffle", F.col("db_id"), F.col("table_name"))
    return number_by_digest(tables, ["db_id"], digest, ["table_name"], "position")


@query
def seeded_draws(spark, d):
    t = src.table(spark, d, "documents").select(F.col("source").alias("db_id"), F.col("doc_id").alias("slot"))
    at = [F.col("db_id"), F.col("slot")]
    return t.select(
        "db_id", "slot",
        F.round(draws.uniform("u", *at), 6).alias("u"),
        draws.choice("c", list(augment.META_SUFFIXES), *at).alias("chosen"),
        draws.chance("b", 0.4, *at).alias("hit"),
        draws.integer("i", 6, 12, *at).alias("width"),
    )


@query
def column_sample(spark, d):
    owners = src.catalog_tables(spark, d).select("db_id", F.col("table_name").alias("base_table"))
    sampled = augment.sample_columns(owners, src.catalog_columns(spark, d), 0.6, ["db_id", "base_table"])
    return sampled.select("db_id", "base_table", "name", "sample_rank")


@query
def unique_names(spark, d):
    """Parts named alike get numbered; customers' segments are taken names."""
    parts = src.table(spark, d, "part").select(
        F.col("p_brand").alias("db_id"), F.regexp_replace("p_name", " ", "_").alias("name"), F.col("p_partkey").alias("slot")
    )
    taken = src.table(spark, d, "part").filter(F.col("p_size") > 25).select(
        F.col("p_brand").alias("db_id"), F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_2")).alias("table_name")
    )
    return augment.unique_names(parts, ["db_id"], "name", "slot", taken)


def targets(spark, d) -> DataFrame:
    tables = src.table(spark, d, "documents")
    n = F.count(F.lit(1))
    return tables.groupBy(F.col("source").alias("db_id")).agg((n + src.NEW_TABLES + F.floor(n / src.PER_TABLES)).alias("target"))


LEVEL1, LEVEL2 = Recipe(), Recipe(follow=True)


@query
def assign_words(spark, d):
    counts = augment.table_counts(src.catalog_tables(spark, d), targets(spark, d))
    fresh = vocab.fresh_words(materialize(pools(spark, d), "pools"), names_of(spark, d))
    return augment.assign_words(augment.word_slots(counts), fresh).select("db_id", "slot", "kind", "word")


def enlarged(spark, d, cfg) -> tuple[Catalog, Catalog]:
    base = original(spark, d)
    return base, augment.enlarge(base, pools(spark, d), targets(spark, d), cfg)


def through_files(spark, new: Catalog) -> Catalog:
    """The catalog as its sink has it."""
    path = shared_dir(spark, "catalog")
    files.write_catalog(new, path)
    return files.read_catalog(spark, path)


def columns_of(spark, d, cfg, origin: str) -> DataFrame:
    _, new = enlarged(spark, d, cfg)
    names = new.tables.filter(F.col("origin") == origin).select("db_id", "table_name")
    return new.columns.join(names, ["db_id", "table_name"], "left_semi").select(*augment.COLUMN_FIELDS)


@query
def entity_tables(spark, d):
    return columns_of(spark, d, LEVEL1, "entity")


@query
def family_tables(spark, d):
    return columns_of(spark, d, LEVEL2, "family")


@query
def bridge_tables(spark, d):
    rows = augment.bridges(original(spark, d))
    return augment.bridge_fks(rows)


@query
def join_tables(spark, d):
    return columns_of(spark, d, LEVEL2, "join")


@query
def meta_tables(spark, d):
    return columns_of(spark, d, LEVEL2, "meta")


@query
def entity_pairs(spark, d):
    """Seeded walk over the pairs of a source's tables, as many draws as it has tables."""
    members = src.catalog_tables(spark, d).select("db_id", F.col("table_ord").alias("ent_ord"), "table_name")
    wanted = members.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_draws"))
    return augment.pair_walk(members, wanted)


@query
def pair_limit(spark, d):
    """First free pair names of a source; other sources' names for the same pairs are taken."""
    members = src.catalog_tables(spark, d).select("db_id", F.col("table_ord").alias("ent_ord"), "table_name")
    counts = members.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_join"))
    fks = src.catalog_fks(spark, d)
    used = fks.select("db_id", F.concat_ws("_", F.least("table_name", "ref_table"), F.greatest("table_name", "ref_table")).alias("table_name"))
    return augment.join_pairs(members, counts, used)


def enlarged_rows(new: Catalog) -> DataFrame:
    """One row per synthetic table with its columns and references."""
    cols = new.columns.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("col_ord", F.concat_ws(" ", "name", "type").alias("c"))))["c"].alias("c")
    )
    fks = new.fks.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("fk_ord", F.concat_ws(".", "local_col", "ref_table", "ref_col").alias("f"))))["f"].alias("f")
    )
    return (
        new.tables.join(cols, ["db_id", "table_name"]).join(fks, ["db_id", "table_name"], "left")
        .select("db_id", "table_name", "origin", lined("c").alias("column_list"), F.coalesce(lined("f"), F.lit("")).alias("fk_list"))
    )


@query
def enlarge_l1(spark, d):
    return enlarged_rows(enlarged(spark, d, LEVEL1)[1])


@query
def enlarge_l2(spark, d):
    return enlarged_rows(enlarged(spark, d, LEVEL2)[1])


@query
def enlarge_chain(spark, d):
    """From names to counts in one chain: vectors of a source's names, candidate pool, fresh words, enlargement to a published size.

    Words run out where vectors are few; ``n_missing`` has how many.
    """
    base = original(spark, d)
    words = src.word_vectors(spark, d, vocab_clean(spark, d))
    names = vocab.schema_names(base.tables, base.columns)
    known = materialize(names.select("db_id", F.col("name").alias("word")).join(words, "word").select("db_id", "word", "vec"), "name-vectors")
    pool = pipelines.candidate_pool(known.select("db_id", "word"), known, words, POOL)
    size = draws.choice("size", [str(s) for s in src.SIZES if s], F.col("db_id")).cast("bigint")
    wanted = base.tables.select("db_id").distinct().withColumn("target", size)
    new = augment.enlarge(base, pool.select("db_id", "word", "rank"), wanted, LEVEL2, allow_short=True)
    counts = augment.scaling_metadata(base, new)
    return counts.join(new.missing, "db_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))


@query
def catalog_union(spark, d):
    base, new = enlarged(spark, d, LEVEL1)
    new = through_files(spark, new)
    return catalog.union_catalogs(base.tables.select("db_id", "table_name", "origin"), new.tables)


@query
def schema_diff(spark, d):
    base, new = enlarged(spark, d, LEVEL1)
    whole = base.tables.select("db_id", "table_name").unionByName(new.tables.select("db_id", "table_name"))
    return catalog.schema_diff(whole, base.tables)


@query
def fk_edges(spark, d):
    return catalog.fk_edges(src.catalog_tables(spark, d), src.catalog_fks(spark, d)).select(
        "db_id", "table_name", "child_ord", "ref_table", "parent_ord", "local_col", "ref_col"
    )


@query
def fk_counts(spark, d):
    base, new = enlarged(spark, d, LEVEL2)
    return augment.fk_counts(base.fks, new.fks)


@query
def scaling_metadata(spark, d):
    base, new = enlarged(spark, d, LEVEL2)
    path = shared_dir(spark, "metadata")
    files.write_metadata(augment.scaling_metadata(base, through_files(spark, new)), path)
    return spark.read.parquet(path)
