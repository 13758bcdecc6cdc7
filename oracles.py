"""DuckDB statements equivalent to the registered queries.

Written independently of the Spark plans: full scopes instead of fill-ups, full
pair lists instead of seeded walks, plain windows instead of bucketed ones.
"""

from schemaloom.functions.constants import (
    EXACT_TYPE_GROUPS,
    META_SUFFIXES,
    SQL_KEYWORDS,
)
from schemaloom.functions.constants import ENTITY_ATTRIBUTES, META_ATTRIBUTES

ORACLES: dict[str, str] = {}


def sql_list(items):
    return ", ".join(f"'{i}'" for i in items)


def digest(purpose, *keys):
    return "md5('42:" + purpose + ":' || " + " || ':' || ".join(f"{k}::VARCHAR" for k in keys) + ")"


def uniform(purpose, *keys):
    return f"(('0x' || substr({digest(purpose, *keys)}, 1, 8))::BIGINT / 4294967296.0)"


def tokens(text):
    return f"list_filter(regexp_split_to_array(replace(lower({text}), '_', ' '), '{WHITESPACE}'), lambda x: x <> '')"


WHITESPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def affinity(t):
    has = lambda *n: " OR ".join(f"contains(upper({t}), '{x}')" for x in n)
    return (
        f"CASE WHEN {t} IS NULL OR {t} = '' THEN 'BLOB' WHEN {has('INT')} THEN 'INTEGER' "
        f"WHEN {has('CHAR', 'CLOB', 'TEXT')} THEN 'TEXT' WHEN {has('BLOB')} THEN 'BLOB' "
        f"WHEN {has('REAL', 'FLOA', 'DOUB')} THEN 'REAL' WHEN {has('DATE', 'TIME')} THEN 'DATE' ELSE 'NUMERIC' END"
    )


def exact(t):
    kind = f"CASE WHEN upper({t}) IN ({sql_list(EXACT_TYPE_GROUPS)}) THEN upper({t}) ELSE 'TEXT' END"
    arms = " ".join(f"WHEN upper({t}) = '{k}' THEN '{v}'" for k, v in EXACT_TYPE_GROUPS.items())
    return kind, f"CASE {arms} ELSE 'TEXT' END"


TABLES = """
cat_tables AS (
  SELECT 'corpus' AS dataset, source AS db_id, 't' || doc_id AS table_name, doc_id,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS table_ord
  FROM documents
)"""
COLUMNS = f"""
found AS (
  SELECT source AS db_id, doc_id, {tokens('text')} AS ws FROM documents
),
spelled AS (SELECT db_id, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM found),
firsts AS (SELECT db_id, doc_id, w, min(p) AS p FROM spelled GROUP BY db_id, doc_id, w),
placed AS (SELECT db_id, doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS c FROM firsts),
raw_columns AS (
  SELECT db_id, 't' || doc_id AS table_name, c AS col_ord, w AS name FROM placed
  UNION ALL SELECT source, 't' || doc_id, 0, 't' || doc_id || '_id' FROM documents
),
typed AS (
  SELECT *, list_extract(['INT','VARCHAR(20)','REAL','DATETIME','DECIMAL(8,2)','','TEXT'], (col_ord % 7 + 1)::INT) AS type
  FROM raw_columns
),
cat_columns AS (
  SELECT db_id, table_name, col_ord, name, type, {affinity('type')} AS typegroup,
         col_ord % 3 = 0 AS not_null, CASE WHEN col_ord = 0 THEN 1 ELSE 0 END AS pk
  FROM typed
)"""
FKS = """
cat_fks AS (
  SELECT c.db_id, c.table_name, 0 AS fk_ord, l.name AS local_col, p.table_name AS ref_table, p.table_name || '_id' AS ref_col,
         c.table_ord AS child_ord, p.table_ord AS parent_ord
  FROM cat_tables c
  JOIN cat_tables p ON p.db_id = c.db_id AND p.table_ord = c.table_ord // 2
  JOIN cat_columns l ON l.db_id = c.db_id AND l.table_name = c.table_name AND l.col_ord = 1
  WHERE c.table_ord >= 1
)"""
CATALOG = f"{TABLES}, {COLUMNS}, {FKS}"
NAMES = "all_names AS (SELECT db_id, table_name AS name FROM cat_tables UNION SELECT db_id, name FROM cat_columns)"
QUESTIONS = "questions AS (SELECT item_id AS idx, 'src' || (item_id % 20) AS db_id, text AS question FROM benchmark)"


def add(name, select, *ctes):
    ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + select


# --- catalog ----------------------------------------------------------------
add("catalog_explode", "SELECT * FROM cat_columns", COLUMNS)
add("catalog_assemble", """
SELECT t.dataset, t.db_id, t.table_name, t.table_ord, c.column_names, c.primary_keys,
       coalesce(f.local_col || '.' || f.ref_table || '.' || f.ref_col, '') AS foreign_keys
FROM cat_tables t
JOIN (SELECT db_id, table_name, string_agg(name, ',' ORDER BY col_ord) AS column_names,
             string_agg(name, ',' ORDER BY col_ord) FILTER (WHERE pk > 0) AS primary_keys
      FROM cat_columns GROUP BY db_id, table_name) c USING (db_id, table_name)
LEFT JOIN cat_fks f USING (db_id, table_name)""", CATALOG)
add("catalog_tables", "SELECT 't' || doc_id AS table_name, 'table' AS kind FROM documents")
add("primary_keys", """
SELECT db_id, table_name, string_agg(name, ',' ORDER BY col_ord) AS primary_keys
FROM cat_columns WHERE pk > 0 GROUP BY db_id, table_name""", COLUMNS)
add("foreign_keys", """
SELECT db_id, table_name, string_agg(local_col || '.' || ref_table || '.' || ref_col, ',' ORDER BY fk_ord) AS foreign_keys
FROM cat_fks GROUP BY db_id, table_name""", CATALOG)

PROFILE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
CLASSES = {"bigint": "whole", "int": "whole", "double": "number", "string": "text", "timestamp_ntz": "time"}


def specs(table):
    return [c.split() for c in PROFILE[table].split(", ")]


def keys_sql():
    """Every column and pair of columns counted; pairs with a key in them are left out."""
    for t in PROFILE:
        names = [c for c, _ in specs(t)]
        single = {c: f"(count(DISTINCT {c}) = count(*) AND count({c}) = count(*))" for c in names}
        options = [f"CASE WHEN {single[c]} THEN '{c}' END" for c in names]
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                both = f"count(DISTINCT ({a}, {b})) = count(*) AND count({a}) = count(*) AND count({b}) = count(*)"
                options.append(f"CASE WHEN {both} AND NOT {single[a]} AND NOT {single[b]} THEN '{a},{b}' END")
        yield (f"SELECT '{t}' AS table_name, k AS key_columns, n_rows FROM (SELECT unnest(ks) AS k, n_rows FROM "
               f"(SELECT [{', '.join(options)}] AS ks, count(*) AS n_rows FROM {t})) WHERE k IS NOT NULL")


add("key_discovery", " UNION ALL ".join(keys_sql()))


def inclusions_sql():
    """Distinct values of all columns joined with each other."""
    columns = [(t, c, CLASSES[k]) for t in PROFILE for c, k in specs(t) if k in CLASSES]
    form = {"whole": "{}::VARCHAR", "number": "{}::DOUBLE::VARCHAR", "text": "{}", "time": "{}::VARCHAR"}
    cells = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{k}' AS kind, {form[k].format(c)} AS v FROM {t} WHERE {c} IS NOT NULL" for t, c, k in columns)
    unique = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(DISTINCT {c}) = count(*) AND count({c}) = count(*) AS in_key FROM {t}" for t, c, _ in columns)
    return f"""
WITH cells AS MATERIALIZED ({cells}), uniques AS ({unique}),
sizes AS (SELECT t, c, count(*) AS n FROM cells GROUP BY t, c),
shared AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, count(*) AS n FROM cells a JOIN cells b ON a.kind = b.kind AND a.v = b.v AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
SELECT ct AS child_table, cc AS child_col, pt AS parent_table, pc AS parent_col, s.n AS n_values, in_key
FROM shared s JOIN sizes z ON z.t = ct AND z.c = cc AND z.n = s.n JOIN uniques u ON u.t = pt AND u.c = pc"""


add("fk_discovery", inclusions_sql())


def profile_sql():
    for t in PROFILE:
        for i, (c, kind) in enumerate(specs(t)):
            numeric, ranged = kind in ("bigint", "int", "double"), kind in ("string", "timestamp_ntz")
            number = f"round({{}}({c})::DOUBLE, 6)" if numeric else "NULL::DOUBLE"
            text = f"{{}}({c})::VARCHAR" if ranged else "NULL::VARCHAR"
            yield (
                f"SELECT '{t}' AS table_name, {i} AS col_ord, '{c}' AS name, '{kind}' AS type, {affinity(repr(kind))} AS typegroup, "
                f"count(*) = count({c}) AS not_null, count(*) AS n_rows, count({c}) AS n_non_null, count(DISTINCT {c}) AS n_distinct, "
                f"{number.format('min')} AS min_value, {number.format('max')} AS max_value, {text.format('min')} AS min_text, {text.format('max')} AS max_text FROM {t}"
            )


add("column_profile", " UNION ALL ".join(profile_sql()))
add("question_dbs", "SELECT DISTINCT db_id FROM questions", QUESTIONS)
add("resume_pending", """
SELECT model, doc_id AS idx, source AS db_id FROM documents, (VALUES ('m1'), ('m2')) m(model)
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND CASE WHEN l.doc_id % 2 = 0 THEN 'm1' ELSE 'm2' END = model)""")

# --- scalars ----------------------------------------------------------------
add("type_affinity", "SELECT db_id, type, typegroup, count(*) AS n FROM cat_columns GROUP BY db_id, type, typegroup", COLUMNS)
_kind, _group = exact("type")
add("type_exact", f"""
SELECT db_id, type AS declared, {_kind} AS "type", {_group} AS typegroup, count(*) AS n
FROM cat_columns GROUP BY db_id, cat_columns.type""", COLUMNS)
add("make_column", f"""
SELECT db_id, table_name, col_ord, name, {_kind} AS "type", {_group} AS typegroup, not_null, pk FROM cat_columns""", COLUMNS)
add("tokenize", f"""
SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS token
FROM (SELECT doc_id, {tokens('text')} AS x FROM documents)""")
TEXTS = """
texts AS (
  SELECT t.db_id, t.table_name, t.table_ord,
         concat_ws(' ', 'table ' || t.table_name, c.cols, 'foreign key ' || f.ref_col || ' references ' || f.ref_table) AS text
  FROM cat_tables t
  JOIN (SELECT db_id, table_name,
               string_agg('column ' || name || ' type ' || typegroup || CASE WHEN pk > 0 THEN ' primary key' ELSE '' END, ' ' ORDER BY col_ord) AS cols
        FROM cat_columns GROUP BY db_id, table_name) c USING (db_id, table_name)
  LEFT JOIN cat_fks f USING (db_id, table_name)
)"""
add("table_text", "SELECT db_id, table_name, text FROM texts", CATALOG, TEXTS)


def line(fix):
    return f"""'(' || name || ': ' || upper(type) || ',' || CASE WHEN pk = 1 THEN ' PRIMARY KEY,' ELSE '' END
       || CASE WHEN {'not_null' if fix else 'NOT not_null'} THEN ' NOT NULL' ELSE '' END || '),' || chr(10)"""


def prompt(fix):
    """Pieces of the text of every database."""
    nl = "chr(10)"
    return f"""
pieces AS (
  SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY {digest('prompt', 'db_id', 'table_name')}, table_name) - 1 AS seq,
         '# Table: ' || table_name || {nl} || '[' || {nl} || body || ']' || {nl} || {nl} AS piece
  FROM (SELECT db_id, table_name, string_agg({line(fix)}, '' ORDER BY col_ord) AS body FROM cat_columns GROUP BY db_id, table_name)
),
ref_rows AS (
  SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY {digest('prompt', 'db_id', 'table_name')}, table_name, fk_ord) - 1 AS n,
         table_name || '.' || local_col || ' REFERENCES ' || ref_table || '.' || ref_col || {nl} AS piece
  FROM cat_fks
),
sequenced AS (
  SELECT db_id, -1 AS seq, '## Database Name: ' || db_id || ' ' || {nl} || {nl} || '## Database Schema ' || {nl} || {nl} AS piece FROM cat_tables GROUP BY db_id
  UNION ALL SELECT * FROM pieces UNION ALL
  SELECT db_id, n + (SELECT count(*) FROM cat_tables t WHERE t.db_id = r.db_id),
         CASE WHEN n = 0 THEN '## Foreign Keys ' || {nl} ELSE '' END || piece FROM ref_rows r
)"""


WHOLE_PROMPT = "SELECT db_id, string_agg(piece, '' ORDER BY seq) AS schema_text FROM sequenced GROUP BY db_id"
add("schema_prompt", WHOLE_PROMPT, CATALOG, prompt(True))
add("schema_prompt_as_published", WHOLE_PROMPT, CATALOG, prompt(False))
add("chat_messages", """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS pos, role, text AS content FROM conversations""")
LOG = """
log AS (
  SELECT event_id // 4 AS idx, CASE WHEN event_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model,
    (event_id // 2 % 2 + 1)::INT AS level, list_extract([0, 50, 100, 250, 500, 800], (user_id % 6 + 1)::INT) AS size,
    CASE WHEN event_id % 5 = 0 THEN 'bm25' ELSE 'none' END AS filter, 'src' || (event_id // 4 % 20) AS db_id, value AS duration_seconds, CASE WHEN event_id % 5 = 0 THEN value / 100 END AS filter_seconds,
    json_extract_string(props, '$.k')::BIGINT * 100 + event_id % 97 AS total_tokens,
    CASE WHEN json_extract_string(props, '$.k')::BIGINT >= 25 THEN 1 ELSE 0 END AS acc,
    'SELECT count(*) FROM t' || (event_id // 4 % 200) || CASE WHEN event_id // 4 % 3 = 0 THEN ' JOIN t' || (event_id // 4 % 7) || ' ON 1=1' ELSE '' END AS sql_gold,
    CASE WHEN event_id % 50 <> 0 THEN 'select count(*) from ' || CASE WHEN event_id % 11 = 0 THEN 'syn_' ELSE 't' END || (event_id % 200)
      || CASE WHEN event_id % 3 = 0 THEN ' join "main"."t' || (event_id % 7) || '" on 1=1' ELSE '' END END AS sql_pred
  FROM events
)"""
# Words at white space; behind a word that ends in a keyword stands a path, whose last part is the table.
REFS_SQL = """
spoken AS (SELECT model, level, size, filter, idx, db_id, list_filter(string_split(lower(sql_pred), ' '), lambda x: x <> '') AS w FROM log WHERE sql_pred IS NOT NULL),
steps AS (SELECT model, level, size, filter, idx, db_id, w, unnest(range(1, len(w))) AS i FROM spoken),
refs AS (
  SELECT DISTINCT model, level, size, filter, idx, db_id, string_split(translate(w[i + 1], '"`[]', ''), '.')[-1] AS table_name
  FROM steps WHERE suffix(w[i], 'from') OR suffix(w[i], 'join'))"""
SYN = "syn AS (SELECT DISTINCT 'src' || (user_id % 20) AS db_id, 'SYN_' || (event_id % 200) AS table_name FROM events)"
FLAGGED = """
flagged AS (
  SELECT *, (model, level, size, filter, idx) IN (SELECT (r.model, r.level, r.size, r.filter, r.idx) FROM refs r JOIN syn s ON s.db_id = r.db_id AND lower(s.table_name) = r.table_name) AS uses FROM log
)"""
add("sql_table_refs", "SELECT * FROM refs", LOG, REFS_SQL)
add("tool_output_parse", """
SELECT event_id, CASE WHEN json_valid(args) THEN json_extract_string(args, '$.sql') END AS sql FROM (
  SELECT event_id, CASE event_type WHEN 'click' THEN '{"sql": "' || s || '"}' WHEN 'view' THEN props
    WHEN 'purchase' THEN '{"sql": "' || s ELSE '{"k": 1, "sql": "' || s || '"}' END AS args
  FROM (SELECT *, 'select ' || json_extract_string(props, '$.k') AS s FROM events))""")

# --- vectors ----------------------------------------------------------------
VEC = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"


def cos(a, b):
    return f"list_inner_product({a}.v, {b}.v) / ({a}.norm * {b}.norm + 1e-8)"


NAMES_V = "names AS (SELECT (label * 4 + CASE WHEN vec_id % 16 = 0 THEN 2 WHEN vec_id % 16 < 4 THEN 1 ELSE 0 END)::INT AS db_id, vec_id AS word, v, norm FROM e)"
WORDS_V = "words AS (SELECT vec_id AS word, v, norm FROM e)"


def centers(name, source):
    return f"""
{name} AS (
  SELECT db_id, v, sqrt(list_inner_product(v, v)) AS norm FROM (
    SELECT db_id, list(x ORDER BY pos) AS v FROM (
      SELECT db_id, pos, avg(x) AS x FROM (SELECT db_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {source}) GROUP BY db_id, pos)
    GROUP BY db_id)
)"""


CENTERS = centers("centers", "names")
SIMS = f"sims AS (SELECT c.db_id, w.word, {cos('w', 'c')} AS sim FROM words w, centers c)"
BASE_V = [VEC, NAMES_V, WORDS_V, CENTERS, SIMS]
add("cosine_pairs", f"SELECT a.vec_id, round({cos('a', 'b')}, 6) AS sim FROM e a JOIN e b ON b.vec_id = a.vec_id + 1", VEC)
add("l2_normalize", "SELECT vec_id, generate_subscripts(v, 1) - 1 AS pos, round(unnest(v) / norm, 6) AS x FROM e", VEC)
add("vector_lookup", "SELECT doc_id AS word, label, len(embedding) AS dims FROM documents JOIN embeddings ON doc_id = vec_id")
add("centroid", "SELECT db_id, generate_subscripts(v, 1) - 1 AS pos, round(unnest(v), 6) AS x FROM centers", VEC, NAMES_V, CENTERS)
add("word_centroid_sim", "SELECT * REPLACE (round(sim, 6) AS sim) FROM sims WHERE sim BETWEEN 0.15 AND 1.0", *BASE_V)
add("similarity_band", "SELECT * REPLACE (round(sim, 6) AS sim) FROM sims WHERE sim BETWEEN 0.15 AND 0.25", *BASE_V)
add("candidate_topn", """
SELECT * REPLACE (round(sim, 6) AS sim) FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY round(sim, 6) DESC, word) AS rank FROM sims WHERE sim BETWEEN 0.15 AND 0.25)
WHERE rank <= 20""", *BASE_V)
add("ambiguity_anti_join", f"""
SELECT s.* REPLACE (round(sim, 6) AS sim) FROM sims s JOIN words w USING (word) WHERE sim BETWEEN 0.15 AND 0.25
AND (s.db_id, s.word) NOT IN (SELECT (db_id, word) FROM names)
AND NOT EXISTS (SELECT 1 FROM names n WHERE n.db_id = s.db_id AND {cos('w', 'n')} > 0.35)""", *BASE_V)
ANCHORS = """
anchors AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY round(sim, 6) DESC, word) AS rank FROM sims
    WHERE sim >= 0.15 AND sim <= 1.0 AND (db_id, word) NOT IN (SELECT (db_id, word) FROM names) AND db_id IN (SELECT db_id FROM names GROUP BY db_id HAVING count(*) < 30)) WHERE rank <= 30
)"""
add("anchor_expand", "SELECT * REPLACE (round(sim, 6) AS sim) FROM anchors", *BASE_V, ANCHORS)
add("candidate_pool", """
SELECT db_id, word, round(sim, 6) AS sim, step, rank FROM (
  SELECT f.*, step, row_number() OVER (PARTITION BY f.db_id ORDER BY round(sim, 6) DESC, word) AS rank
  FROM found f JOIN steps USING (db_id) JOIN bands b ON b.k = step WHERE sim BETWEEN lo AND hi) WHERE rank <= 1000""",
    *BASE_V, ANCHORS,
    "wide AS (SELECT * FROM names UNION ALL SELECT a.db_id, a.word, w.v, w.norm FROM anchors a JOIN words w USING (word))",
    centers("centers2", "wide"),
    "bands(k, lo, hi) AS (VALUES (0, 0.15, 0.25), (1, 0.10, 0.30), (2, 0.10, 0.35), (3, 0.10, 0.40), (4, 0.10, 0.45))",
    f"near AS (SELECT c.db_id, w.word, {cos('w', 'c')} AS sim FROM words w, centers2 c)",
    f"""found AS (SELECT s.* FROM near s JOIN words w USING (word) WHERE sim BETWEEN 0.10 AND 0.45
      AND (s.db_id, s.word) NOT IN (SELECT (db_id, word) FROM wide)
      AND NOT EXISTS (SELECT 1 FROM wide n WHERE n.db_id = s.db_id AND {cos('w', 'n')} > 0.35))""",
    "counted AS (SELECT f.db_id, k, count(*) FILTER (WHERE sim BETWEEN lo AND hi) AS n FROM found f, bands GROUP BY f.db_id, k)",
    "steps AS (SELECT db_id, coalesce(min(k) FILTER (WHERE n >= 75), 4) AS step FROM counted GROUP BY db_id)")
add("dense_topk", """
SELECT label, query_id, rank, vec_id, score FROM (
  SELECT a.label, a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 6) AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 6) DESC, b.vec_id) AS rank
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 10""", VEC)

add("dense_topk_tables", """
SELECT idx, db_id, rank, table_name, score FROM (
  SELECT q.idx, q.db_id, 't' || d.doc_id AS table_name, round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 6) AS score,
         row_number() OVER (PARTITION BY q.idx ORDER BY round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 6) DESC, d.doc_id) AS rank
  FROM questions q JOIN e a ON a.vec_id = q.idx JOIN documents d ON d.source = q.db_id JOIN e b ON b.vec_id = d.doc_id) WHERE rank <= 10""", VEC, QUESTIONS)

# --- vocabulary -------------------------------------------------------------
LEXICON = f"""
word_list AS (SELECT unnest({tokens('text')}) AS word FROM documents),
word_counts AS (SELECT word, count(*) AS n FROM word_list GROUP BY word),
weighted AS (SELECT word, round(log10(1e9 * n / (SELECT sum(n) FROM word_counts)), 6) AS zipf FROM word_counts),
senses(i, lexname) AS (VALUES (0, 'noun.person'), (1, 'noun.location'), (2, 'noun.group'), (3, 'noun.artifact'), (4, 'noun.act'), (5, 'noun.state')),
coded AS (
  SELECT word, zipf, ('0x' || substr(md5(word), 1, 8))::BIGINT % 6 AS i FROM weighted
  UNION ALL SELECT word, zipf, ('0x' || substr(md5('2:' || word), 1, 8))::BIGINT % 6 FROM weighted WHERE length(word) % 2 = 0
),
lexicon AS (SELECT word, zipf, lexname FROM coded JOIN senses USING (i)),
kept AS (
  SELECT word, max(zipf) AS zipf FROM lexicon GROUP BY word
  HAVING NOT bool_or(lexname IN ('noun.person', 'noun.location', 'noun.group'))
),
vocab AS (
  SELECT word FROM kept WHERE regexp_full_match(word, '\\p{{L}}+') AND length(word) >= 4
  AND (zipf <= 4.0 OR substr(md5('w:' || word), 1, 1) = '0')
)"""
add("vocab_sense_filter", "SELECT * FROM kept", LEXICON)
add("vocab_clean", "SELECT * FROM vocab", LEXICON)
add("schema_names", "SELECT * FROM all_names", TABLES, COLUMNS, NAMES)
add("original_columns", "SELECT DISTINCT db_id, name FROM cat_columns", COLUMNS)
add("candidate_exclude", f"""
SELECT DISTINCT db_id, word FROM (SELECT 'src' || (page_id % 20) AS db_id, unnest(regexp_extract_all(lower(html), '\\p{{L}}+')) AS word FROM pages) w
WHERE word NOT IN ({sql_list(SQL_KEYWORDS)})
AND (db_id, word) NOT IN (SELECT (db_id, name) FROM cat_columns)
AND (db_id, word) NOT IN (SELECT (source, 't' || doc_id) FROM documents)
AND word IN (SELECT unnest({tokens('text')}) FROM documents)""", COLUMNS)
POOLS = f"""
dbs AS (SELECT source AS db_id, row_number() OVER (ORDER BY min(doc_id)) - 1 AS db_ord FROM documents GROUP BY source),
thrown AS (
  SELECT DISTINCT word, floor({uniform('pool', 'word', 'r.range')} * (SELECT count(*) FROM dbs))::BIGINT AS db_ord
  FROM vocab, range(8) r
),
pools AS (
  SELECT db_id, word, row_number() OVER (PARTITION BY db_id ORDER BY {digest('pool-order', 'db_id', 'word')}, word) AS rank
  FROM thrown JOIN dbs USING (db_ord)
),
fresh AS (SELECT * FROM pools WHERE (db_id, lower(word)) NOT IN (SELECT (db_id, lower(name)) FROM all_names))"""
add("fresh_words", "SELECT * FROM fresh", CATALOG, NAMES, LEXICON, POOLS)

# --- retrieval --------------------------------------------------------------
DOCS = "corpus AS (SELECT c.db_id, c.table_name, c.table_ord, d.text FROM cat_tables c JOIN documents d USING (doc_id))"
BM25 = f"""
tok AS (SELECT db_id, table_name, table_ord, unnest({tokens('text')}) AS term FROM corpus),
lens AS (SELECT db_id, table_name, len({tokens('text')}) AS len FROM corpus),
tf AS (SELECT db_id, table_name, term, count(*) AS tf FROM tok GROUP BY db_id, table_name, term),
totals AS (SELECT db_id, count(*) AS n_tables, avg(len) AS avg_len FROM lens GROUP BY db_id),
dfs AS (SELECT db_id, term, count(*) AS df FROM tf GROUP BY db_id, term),
raw AS (SELECT db_id, term, df, n_tables, avg_len, ln(n_tables - df + 0.5) - ln(df + 0.5) AS raw_idf FROM dfs JOIN totals USING (db_id)),
stats AS (
  SELECT db_id, term, df, n_tables, avg_len,
         CASE WHEN raw_idf < 0 THEN 0.25 * avg(raw_idf) OVER (PARTITION BY db_id) ELSE raw_idf END AS idf FROM raw
)"""
RANKED = f"""
asked AS (
  SELECT idx, db_id, term, count(*) AS qtf FROM (SELECT idx, db_id, unnest({tokens('question')}) AS term FROM questions) GROUP BY idx, db_id, term
),
gains AS (
  SELECT a.idx, a.db_id, tf.table_name,
         round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score
  FROM asked a JOIN tf USING (db_id, term) JOIN stats USING (db_id, term) JOIN lens USING (db_id, table_name)
  GROUP BY a.idx, a.db_id, tf.table_name
),
scope AS (
  SELECT q.idx, q.db_id, c.table_name, c.table_ord, coalesce(g.score, 0) AS score
  FROM questions q JOIN corpus c USING (db_id) LEFT JOIN gains g USING (idx, db_id, table_name)
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, table_ord) AS rank FROM scope) WHERE rank <= 10
)"""
TEXT_CORPUS = "corpus AS (SELECT db_id, table_name, table_ord, text FROM texts)"
add("bm25_stats", "SELECT db_id, term, df, n_tables, round(avg_len, 6) AS avg_len, round(idf, 6) AS idf FROM stats", TABLES, DOCS, BM25)
add("bm25_topk", "SELECT * FROM best", TABLES, DOCS, BM25, QUESTIONS, RANKED)
add("bm25_topk_schema", "SELECT * FROM best", CATALOG, TEXTS, TEXT_CORPUS, BM25, QUESTIONS, RANKED)
add("retrieval_scope", """
SELECT q.idx, q.db_id, count(c.table_name) AS n_tables, max(c.table_ord) AS last_ord
FROM questions q LEFT JOIN cat_tables c USING (db_id) GROUP BY q.idx, q.db_id""", TABLES, QUESTIONS)
add("compress_schema", """
SELECT b.idx, b.db_id, b.table_name, f.local_col, f.ref_table, f.ref_col
FROM best b JOIN cat_fks f USING (db_id, table_name) WHERE (b.idx, f.ref_table) IN (SELECT (idx, table_name) FROM best)""",
    CATALOG, DOCS, BM25, QUESTIONS, RANKED)
_nl = "chr(10)"
add("prompt_unfiltered", "SELECT q.idx, q.db_id, seq, piece FROM questions q JOIN sequenced s USING (db_id)", CATALOG, QUESTIONS, prompt(True))
PROMPTS = f"""
SELECT q.idx, q.db_id,
  '## Database Name: ' || q.db_id || ' ' || {_nl} || {_nl} || '## Database Schema ' || {_nl} || {_nl} || coalesce(b.body, '')
    || coalesce('## Foreign Keys ' || {_nl} || r.body, '') AS schema_text,
  coalesce(i.tables_included, '') AS tables_included, 'system,system,user' AS roles, q.question AS last_message
FROM questions q
LEFT JOIN (SELECT idx, string_agg('# Table: ' || table_name || {_nl} || '[' || {_nl} || body || ']' || {_nl} || {_nl}, '' ORDER BY {digest('prompt', 'db_id', 'table_name')}) AS body
      FROM best JOIN bodies USING (db_id, table_name) GROUP BY idx) b USING (idx)
LEFT JOIN (SELECT idx, string_agg(table_name || '.' || local_col || ' REFERENCES ' || ref_table || '.' || ref_col || {_nl}, '' ORDER BY {digest('prompt', 'db_id', 'table_name')}) AS body
      FROM best b JOIN cat_fks f USING (db_id, table_name) WHERE (b.idx, f.ref_table) IN (SELECT (idx, table_name) FROM best) GROUP BY idx) r USING (idx)
LEFT JOIN (SELECT idx, string_agg(table_name, ',' ORDER BY rank) AS tables_included FROM best GROUP BY idx) i USING (idx)"""
BODIES = (f"bodies AS (SELECT db_id, table_name, string_agg({line(True)}, '' ORDER BY col_ord) AS body FROM cat_columns GROUP BY db_id, table_name)")
add("prompt_pipeline", PROMPTS, CATALOG, TEXTS, TEXT_CORPUS, BM25, QUESTIONS, RANKED, BODIES)
add("prompt_dense", PROMPTS, CATALOG, VEC, QUESTIONS, "best AS (" + ORACLES["dense_topk_tables"].split("\n", 2)[-1] + ")", BODIES)

# --- metrics ----------------------------------------------------------------
OVERALL = """count(*) AS n, round(100.0 * sum(acc) / count(*), 6) AS exa,
  round(sum(duration_seconds + coalesce(filter_seconds, 0)) / count(*), 6) AS seconds, round(sum(total_tokens) / count(*), 6) AS tokens"""
CORRECT = """count(*) FILTER (WHERE acc = 1) AS n_correct,
  round(sum(duration_seconds + coalesce(filter_seconds, 0)) FILTER (WHERE acc = 1) / nullif(count(*) FILTER (WHERE acc = 1), 0), 6) AS seconds_correct,
  round(sum(total_tokens) FILTER (WHERE acc = 1) / nullif(count(*) FILTER (WHERE acc = 1), 0), 6) AS tokens_correct"""
_j = "contains(lower(sql_gold), ' join ')"
JOINS = f"""count(*) FILTER (WHERE {_j}) AS n_join, round(100.0 * sum(acc) FILTER (WHERE {_j}) / nullif(count(*) FILTER (WHERE {_j}), 0), 6) AS exa_join,
  round(sum(duration_seconds) FILTER (WHERE {_j}) / nullif(count(*) FILTER (WHERE {_j}), 0), 6) AS seconds_join"""
SYNTH = "count(*) FILTER (WHERE uses) AS n_synthetic, round(100.0 * sum(acc) FILTER (WHERE uses) / nullif(count(*) FILTER (WHERE uses), 0), 6) AS exa_synthetic"
add("metrics_overall", f"SELECT model, level, {OVERALL} FROM log GROUP BY model, level", LOG)
add("stream_metrics", f"SELECT model, level, {OVERALL} FROM log GROUP BY model, level", LOG)
add("stream_redelivered", f"SELECT model, level, {OVERALL} FROM log GROUP BY model, level", LOG)
add("metrics_correct", f"SELECT model, level, {CORRECT} FROM log GROUP BY model, level", LOG)
add("metrics_join_subset", f"SELECT model, level, {JOINS} FROM log GROUP BY model, level", LOG)
add("metrics_synthetic_subset", f"SELECT model, level, {SYNTH} FROM flagged GROUP BY model, level", LOG, REFS_SQL, SYN, FLAGGED)
add("synthetic_refs", "SELECT model, level, size, filter, idx FROM flagged WHERE uses", LOG, REFS_SQL, SYN, FLAGGED)
add("score_sql", "SELECT model, count(*) AS n, round(avg(CASE WHEN sql_pred IS NULL THEN 0 ELSE acc END), 6) AS score FROM log GROUP BY model", LOG)
add("variant_report", f"SELECT model, level, size, {OVERALL} FROM log GROUP BY model, level, size", LOG)
# What the rules of the result rows come to: failures and changed rows are wrong, other column orders are right.
JUDGED = """
judged AS (
  SELECT * REPLACE (CASE WHEN sql_pred IS NULL THEN 0 WHEN event % 7 = 0 AND idx + 1 IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) THEN 0
                    WHEN event % 13 = 0 AND event % 3 <> 1 AND contains(sql_gold, 'ORDER BY') AND idx + 1 IN (SELECT l_orderkey FROM lineitem) THEN 0
                    ELSE 1 END AS acc)
  FROM flagged
)"""
add("evaluation_report", f"SELECT model, level, size, {OVERALL}, {CORRECT}, {JOINS}, {SYNTH} FROM judged GROUP BY model, level, size",
    LOG.replace("json_extract_string(props, '$.k')::BIGINT * 100", "event_id AS event, json_extract_string(props, '$.k')::BIGINT * 100")
       .replace("AS sql_gold", "|| CASE WHEN event_id // 4 % 4 = 0 THEN ' ORDER BY 1' ELSE '' END AS sql_gold"),
    REFS_SQL, SYN, FLAGGED, JUDGED)
add("results_with_gold", "SELECT model, level, size, filter, idx, sql_pred, total_tokens, db_id, sql_gold FROM log", LOG)
add("variant_partitions", "SELECT size, level, db_id, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM log GROUP BY size, level, db_id", LOG)
MATCH = """
gold AS (SELECT l_suppkey AS qid, l_partkey AS a, l_quantity AS b, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4),
pred AS (
  SELECT l_suppkey AS qid, l_partkey AS a, CASE WHEN l_suppkey % 4 = 1 AND l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END AS b,
         l_returnflag AS c, count(*) AS n
  FROM lineitem WHERE NOT (l_suppkey % 4 = 0 AND l_returnflag = 'A') GROUP BY 1, 2, 3, 4
)"""
_match = "SELECT qid, bool_and(coalesce(g.n, 0) = coalesce(p.n, 0))::INT AS execution_accuracy FROM gold g FULL JOIN pred p USING (qid, a, b, c) GROUP BY qid"
add("execution_match", _match, MATCH)
# Every order of three columns against the bags.
_orders = [("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")]
_turned = """
as_text AS (SELECT qid, n, a::VARCHAR AS a, b::VARCHAR AS b, c::VARCHAR AS c FROM pred),
turned AS (
  SELECT qid, n, CASE qid % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS a, CASE qid % 3 WHEN 0 THEN b WHEN 1 THEN c ELSE a END AS b,
         CASE qid % 3 WHEN 0 THEN c WHEN 1 THEN a ELSE b END AS c FROM as_text
),
expected AS (SELECT qid, n, a::VARCHAR AS a, b::VARCHAR AS b, c::VARCHAR AS c FROM gold),
tried AS ("""
_turned += " UNION ALL ".join(
    f"SELECT qid, bool_and(coalesce(g.n, 0) = coalesce(p.n, 0))::INT AS hit FROM expected g FULL JOIN (SELECT qid, n, {x} AS a, {y} AS b, {z} AS c FROM turned) p USING (qid, a, b, c) GROUP BY qid"
    for x, y, z in _orders) + ")"
add("execution_match_any_order", "SELECT qid, max(hit) AS execution_accuracy FROM tried GROUP BY qid", MATCH, _turned)
add("execution_match_ordered", """
SELECT qid, CASE WHEN qid % 3 = 0 AND qid % 5 = 0 AND (SELECT count(*) FROM lineitem WHERE l_suppkey = qid) > 0 THEN 0 ELSE execution_accuracy END AS execution_accuracy
FROM (""" + _match + ")", MATCH)
# The columns are turned by a number that the statement knows, so plain bags tell which ones are equal.
add("execution_match_wide", """
SELECT qid, bool_and(coalesce(g.n, 0) = coalesce(p.n, 0))::INT AS execution_accuracy
FROM (SELECT l_suppkey AS qid, l_partkey AS a, l_quantity AS b, l_extendedprice AS c, l_discount AS d, l_returnflag AS e, l_linestatus AS f, l_linenumber AS h, count(*) AS n FROM lineitem GROUP BY ALL) g
FULL JOIN (SELECT l_suppkey AS qid, l_partkey AS a, CASE WHEN l_suppkey % 4 = 1 AND l_linenumber = 1 THEN l_quantity + 1 ELSE l_quantity END AS b, l_extendedprice AS c, l_discount AS d,
                  l_returnflag AS e, l_linestatus AS f, l_linenumber AS h, count(*) AS n
           FROM lineitem WHERE NOT (l_suppkey % 4 = 0 AND l_returnflag = 'A') GROUP BY ALL) p USING (qid, a, b, c, d, e, f, h)
GROUP BY qid""")

# --- seeded augmentation ----------------------------------------------------
add("seeded_shuffle", f"""
SELECT db_id, table_name, row_number() OVER (PARTITION BY db_id ORDER BY {digest('shuffle', 'db_id', 'table_name')}, table_name) - 1 AS position
FROM cat_tables""", TABLES)
_k = ("source", "doc_id")
add("seeded_draws", f"""
SELECT source AS db_id, doc_id AS slot, round({uniform('u', *_k)}, 6) AS u,
  list_extract([{sql_list(META_SUFFIXES)}], floor({uniform('c', *_k)} * 4)::INT + 1) AS chosen,
  {uniform('b', *_k)} < 0.4 AS hit, (6 + floor({uniform('i', *_k)} * 7))::BIGINT AS width FROM documents""")


def sampled(owners, keys):
    order = digest("column-sample", *[f"o.{k}" for k in keys], "c.col_ord")
    part = ", ".join(f"o.{k}" for k in keys)
    return f"""
    SELECT o.*, c.name, c.type, row_number() OVER (PARTITION BY {part} ORDER BY {order}, c.col_ord) AS sample_rank,
           count(*) OVER (PARTITION BY {part}) AS n
    FROM {owners} o JOIN cat_columns c ON c.db_id = o.db_id AND c.table_name = o.base_table AND c.pk = 0"""


_keep = "sample_rank <= greatest(1, round_even(n * 0.6, 0)::INT)"
add("column_sample", f"SELECT db_id, base_table, name, sample_rank FROM ({sampled('owners', ['db_id', 'base_table'])}) WHERE {_keep}",
    TABLES, COLUMNS, "owners AS (SELECT db_id, table_name AS base_table FROM cat_tables)")
add("unique_names", """
SELECT db_id, name || CASE WHEN n + skip > 1 THEN '_' || (n + skip) ELSE '' END AS name, slot FROM (
  SELECT p_brand AS db_id, replace(p_name, ' ', '_') AS name, p_partkey AS slot, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n,
    CASE WHEN row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) >= 2
      AND (p_brand, p_name) IN (SELECT (p_brand, p_name) FROM part WHERE p_size > 25) THEN 1 ELSE 0 END AS skip
  FROM part)""")
SLOTS = """
counts AS (
  SELECT db_id, n_orig, n_new, round_even(n_new * 0.60, 0)::BIGINT AS n_entity, round_even(n_new * 0.25, 0)::BIGINT AS n_join,
         n_new - round_even(n_new * 0.60, 0)::BIGINT - round_even(n_new * 0.25, 0)::BIGINT AS n_meta
  FROM (SELECT db_id, count(*) AS n_orig, 40 + count(*) // 10 AS n_new FROM cat_tables GROUP BY db_id)
),
fresh_ranked AS (SELECT db_id, word, row_number() OVER (PARTITION BY db_id ORDER BY rank) - 1 AS slot FROM fresh),
assigned AS (
  SELECT f.db_id, f.slot, CASE WHEN f.slot < n_entity THEN 'entity' ELSE 'meta' END AS kind, f.word, n_orig, n_entity
  FROM fresh_ranked f JOIN counts USING (db_id) WHERE f.slot < n_entity + n_meta
)"""
GROUND = [CATALOG, NAMES, LEXICON, POOLS, SLOTS]
add("assign_words", "SELECT db_id, slot, kind, word FROM assigned", *GROUND)


def values(pairs):
    return ", ".join(f"({i}, '{n}', '{t}', '{exact_group(t)}')" for i, (n, t) in enumerate(pairs, 1))


def exact_group(t):
    return EXACT_TYPE_GROUPS.get(t, "TEXT")


def grown(level):
    """Synthetic tables, columns and references as CTEs."""
    fam = f"""
  SELECT a.db_id, a.slot, a.word, b.table_name AS base_table, coalesce(b.table_name || '_', '') || a.word AS table_name
  FROM (SELECT *, CASE WHEN {uniform('family', 'db_id', 'slot')} < 0.4 THEN floor({uniform('family-base', 'db_id', 'slot')} * n_orig)::BIGINT END AS base_ord
        FROM assigned WHERE kind = 'entity') a
  LEFT JOIN cat_tables b ON b.db_id = a.db_id AND b.table_ord = a.base_ord"""
    plain = "SELECT db_id, slot, word, NULL::VARCHAR AS base_table, word AS table_name FROM assigned WHERE kind = 'entity'"
    bridge_members = f"""
  UNION ALL SELECT b.db_id, (SELECT count(*) FROM entities x WHERE x.db_id = b.db_id) + row_number() OVER (PARTITION BY b.db_id ORDER BY {digest('bridge-order', 'b.db_id', 'bridge')}, bridge) - 1, bridge
  FROM bridge_rows b"""
    two = level == 2
    names_used = "SELECT db_id, table_name FROM cat_tables UNION ALL SELECT db_id, table_name FROM entities"
    if two:
        names_used += " UNION ALL SELECT db_id, bridge FROM bridge_rows"
    key = lambda name, by: f"SELECT db_id, {name} AS table_name, 0 AS col_ord, {by} || '_id' AS name, 'INT' AS type, 'INTEGER' AS typegroup, true AS not_null, 1 AS pk"
    family_cols = f"""
  UNION ALL {key('table_name', 'table_name')} FROM entities WHERE base_table IS NOT NULL
  UNION ALL SELECT db_id, table_name, sample_rank, name, {exact('type')[0]}, {exact('type')[1]}, false, 0
    FROM ({sampled("(SELECT * FROM entities WHERE base_table IS NOT NULL)", ['db_id', 'slot'])}) WHERE {_keep} AND name <> table_name || '_id'
  UNION ALL {key('bridge', 'bridge')} FROM bridge_rows
  UNION ALL SELECT db_id, bridge, 1, src_col || '_fk1', 'INT', 'INTEGER', false, 0 FROM bridge_rows
  UNION ALL SELECT db_id, bridge, 2, tgt_col || '_fk2', 'INT', 'INTEGER', false, 0 FROM bridge_rows"""
    return f"""
bridge_rows AS (
  SELECT db_id, table_name || '_' || ref_table || '_bridge' AS bridge, table_name AS src, ref_table AS tgt, local_col AS src_col, ref_col AS tgt_col FROM cat_fks
),
entities AS ({fam if two else plain}),
members AS (SELECT db_id, slot AS ent_ord, table_name FROM entities {bridge_members if two else ''}),
{walk('counts', 'members', 'n_join * 4 + 50')},
used AS ({names_used}),
pairs AS (
  SELECT * FROM (
    SELECT w.db_id, w.a || '_' || w.b AS table_name, w.a, w.b, c.n_join, row_number() OVER (PARTITION BY w.db_id ORDER BY w.draw) AS rank
    FROM walk w JOIN counts c USING (db_id)
    WHERE (w.db_id, lower(w.a || '_' || w.b)) NOT IN (SELECT (db_id, lower(table_name)) FROM used)) WHERE rank <= n_join
),
ents AS (SELECT db_id, count(*) AS n_ent FROM members GROUP BY db_id),
metas AS (
  SELECT m.*, t.table_name AS target FROM (
    SELECT a.db_id, a.slot, a.word,
      a.word || list_extract([{sql_list(META_SUFFIXES)}], floor({uniform('meta-suffix', 'a.db_id', 'a.slot')} * 4)::INT + 1) AS table_name,
      5 + floor({uniform('meta-cols', 'a.db_id', 'a.slot')} * 4)::INT AS n_cols,
      CASE WHEN {uniform('meta-fk', 'a.db_id', 'a.slot')} < 0.1 THEN floor({uniform('meta-target', 'a.db_id', 'a.slot')} * n_ent)::BIGINT END AS target_ord
    FROM assigned a JOIN ents USING (db_id) WHERE kind = 'meta') m
  LEFT JOIN members t ON t.db_id = m.db_id AND t.ent_ord = m.target_ord
),
new_tables AS (
  SELECT db_id, table_name, CASE WHEN base_table IS NULL THEN 'entity' ELSE 'family' END AS origin FROM entities
  UNION ALL SELECT db_id, table_name, 'join' FROM pairs
  UNION ALL SELECT db_id, table_name, 'meta' FROM metas
  {"UNION ALL SELECT db_id, bridge, 'bridge' FROM bridge_rows" if two else ""}
),
entity_attrs(i, name, type, typegroup) AS (
  SELECT * FROM (VALUES {values(ENTITY_ATTRIBUTES)}) UNION ALL SELECT 9 + range, 'attr_' || range, 'TEXT', 'TEXT' FROM range(1, 13)
),
meta_attrs(i, name, type, typegroup) AS (
  SELECT * FROM (VALUES {values(META_ATTRIBUTES)}) UNION ALL SELECT 5 + range, 'meta_' || range, 'TEXT', 'TEXT' FROM range(1, 9)
),
new_columns AS (
  {key('table_name', 'table_name')} FROM entities WHERE base_table IS NULL
  UNION ALL SELECT e.db_id, e.table_name, a.i, a.name, a.type, a.typegroup, false, 0
    FROM entities e JOIN entity_attrs a ON a.i < 6 + floor({uniform('entity-cols', 'e.db_id', 'e.slot')} * 7) WHERE e.base_table IS NULL
  UNION ALL {key('table_name', 'a')} FROM pairs
  UNION ALL SELECT db_id, table_name, 1, b || '_id', 'INT', 'INTEGER', true, 2 FROM pairs
  UNION ALL {key('table_name', 'word')} FROM metas
  UNION ALL SELECT db_id, table_name, 1, target || '_id', 'INT', 'INTEGER', false, 0 FROM metas WHERE target IS NOT NULL
  UNION ALL SELECT m.db_id, m.table_name, a.i + CASE WHEN target IS NULL THEN 0 ELSE 1 END, a.name, a.type, a.typegroup, false, 0
    FROM metas m JOIN meta_attrs a ON a.i + CASE WHEN target IS NULL THEN 0 ELSE 1 END < m.n_cols
  {family_cols if two else ''}
),
new_fks AS (
  SELECT db_id, table_name, 0 AS fk_ord, a || '_id' AS local_col, a AS ref_table, a || '_id' AS ref_col FROM pairs
  UNION ALL SELECT db_id, table_name, 1, b || '_id', b, b || '_id' FROM pairs
  UNION ALL SELECT db_id, table_name, 0, target || '_id', target, target || '_id' FROM metas WHERE target IS NOT NULL
  {"UNION ALL " + BRIDGE_FKS if two else ""}
)"""


BRIDGE_FKS = """SELECT db_id, bridge AS table_name, 0 AS fk_ord, src_col || '_fk1' AS local_col, src AS ref_table, src_col AS ref_col FROM bridge_rows
  UNION ALL SELECT db_id, bridge, 1, tgt_col || '_fk2', tgt, tgt_col FROM bridge_rows"""


def walk(counts, members, draws):
    """Pairs drawn by the keyed permutation, found in the full list of pairs."""
    shift = lambda n, value: f"('0x' || substr({digest('pair-round', 'db_id', n, value)}, 1, 8))::BIGINT"
    return f"""
walk_sizes AS (SELECT db_id, count(*) AS n_ent, (count(*) * (count(*) - 1) // 2)::BIGINT AS m FROM {members} GROUP BY db_id),
all_pairs AS (
  SELECT x.db_id, (x.ent_ord * (x.ent_ord - 1) // 2 + y.ent_ord)::BIGINT AS p, least(x.table_name, y.table_name) AS a, greatest(x.table_name, y.table_name) AS b
  FROM {members} x JOIN {members} y ON x.db_id = y.db_id AND y.ent_ord < x.ent_ord
),
walk_grid AS (SELECT db_id, m, gr, ceil(m / gr)::BIGINT AS gc FROM (SELECT db_id, m, ceil(sqrt(m))::BIGINT AS gr FROM walk_sizes WHERE m > 0)),
walk_steps AS (
  SELECT c.db_id, unnest(range(least({draws}, m)))::BIGINT AS draw, m, gr, gc, -1::BIGINT AS v FROM {counts} c JOIN walk_grid USING (db_id)
  UNION ALL
  SELECT db_id, draw, m, gr, gc, l2 * gc + (r1 + {shift(3, 'l2')}) % gc FROM (
    SELECT *, (l1 + {shift(2, 'r1')}) % gr AS l2 FROM (
      SELECT *, (u % gc + {shift(1, 'l1')}) % gc AS r1 FROM (
        SELECT *, (u // gc + {shift(0, '(u % gc)')}) % gr AS l1 FROM (
          SELECT *, CASE WHEN v < 0 THEN draw ELSE v END AS u FROM walk_steps WHERE v < 0 OR v >= m))))
),
walk_draws AS (SELECT db_id, draw, v AS p FROM walk_steps WHERE v >= 0 AND v < m),
walk AS (SELECT d.db_id, d.draw, a, b FROM walk_draws d JOIN all_pairs USING (db_id, p))"""


for _name, _origin, _level in (("entity_tables", "entity", 1), ("family_tables", "family", 2), ("join_tables", "join", 2), ("meta_tables", "meta", 2)):
    add(_name, f"""
SELECT c.db_id, c.table_name, c.col_ord, c.name, c.type, c.typegroup, c.not_null, c.pk
FROM new_columns c JOIN new_tables t USING (db_id, table_name) WHERE origin = '{_origin}'""", *GROUND, grown(_level))
add("bridge_tables", BRIDGE_FKS, CATALOG, """
bridge_rows AS (SELECT db_id, table_name || '_' || ref_table || '_bridge' AS bridge, table_name AS src, ref_table AS tgt, local_col AS src_col, ref_col AS tgt_col FROM cat_fks)""")
ORIGINALS = "orig AS (SELECT db_id, table_ord AS ent_ord, table_name FROM cat_tables), sizes AS (SELECT db_id, count(*) AS n FROM orig GROUP BY db_id)"
add("entity_pairs", "SELECT * FROM walk", TABLES, ORIGINALS, walk("sizes", "orig", "n"))
add("pair_limit", """
SELECT db_id, rank, table_name, a, b FROM (
  SELECT w.db_id, row_number() OVER (PARTITION BY w.db_id ORDER BY draw) AS rank, a || '_' || b AS table_name, a, b, n
  FROM walk w JOIN sizes USING (db_id)
  WHERE (w.db_id, a || '_' || b) NOT IN (SELECT (db_id, least(table_name, ref_table) || '_' || greatest(table_name, ref_table)) FROM cat_fks)) WHERE rank <= n""",
    CATALOG, ORIGINALS, walk("sizes", "orig", "n * 4 + 50"))
for _level in (1, 2):
    add(f"enlarge_l{_level}", """
SELECT t.db_id, t.table_name, t.origin, c.column_list, coalesce(f.fk_list, '') AS fk_list
FROM new_tables t
JOIN (SELECT db_id, table_name, string_agg(name || ' ' || type, ',' ORDER BY col_ord) AS column_list FROM new_columns GROUP BY db_id, table_name) c USING (db_id, table_name)
LEFT JOIN (SELECT db_id, table_name, string_agg(local_col || '.' || ref_table || '.' || ref_col, ',' ORDER BY fk_ord) AS fk_list FROM new_fks GROUP BY db_id, table_name) f
USING (db_id, table_name)""", *GROUND, grown(_level))
add("catalog_union", "SELECT db_id, table_name, 'original' AS origin FROM cat_tables UNION ALL SELECT * FROM new_tables", *GROUND, grown(1))
add("schema_diff", "SELECT db_id, table_name FROM new_tables", *GROUND, grown(1))
add("fk_edges", "SELECT db_id, table_name, child_ord, ref_table, parent_ord, local_col, ref_col FROM cat_fks", CATALOG)
add("fk_counts", """
SELECT db_id, count(*) FILTER (WHERE s = 0) AS fks_original, count(*) AS fks_total, count(*) FILTER (WHERE s = 1) AS fks_synthetic
FROM (SELECT db_id, 0 AS s FROM cat_fks UNION ALL SELECT db_id, 1 FROM new_fks) GROUP BY db_id""", *GROUND, grown(2))
_meta = " OR ".join(f"ends_with(table_name, '{s}')" for s in META_SUFFIXES)
_class = f"CASE WHEN {_meta} THEN 'meta' WHEN contains(table_name, '_') THEN 'join' ELSE 'entity' END"
METADATA = f"""
SELECT t.*, coalesce(fks_original, 0) AS fks_original, coalesce(fks_total, 0) AS fks_total, coalesce(fks_synthetic, 0) AS fks_synthetic FROM (
  SELECT db_id, count(*) FILTER (WHERE origin = 'original') AS tables_original, count(*) AS tables_total,
    count(*) FILTER (WHERE origin <> 'original') AS tables_synthetic,
    {", ".join(f"count(*) FILTER (WHERE origin <> 'original' AND {_class} = '{c}') AS {c}_est" for c in ('entity', 'join', 'meta'))},
    {", ".join(f"count(*) FILTER (WHERE origin = '{o}') AS n_{o}" for o in ('entity', 'family', 'bridge', 'join', 'meta'))}
  FROM (SELECT db_id, table_name, 'original' AS origin FROM cat_tables UNION ALL SELECT * FROM new_tables) GROUP BY db_id) t
LEFT JOIN (SELECT db_id, count(*) FILTER (WHERE s = 0) AS fks_original, count(*) AS fks_total, count(*) FILTER (WHERE s = 1) AS fks_synthetic
  FROM (SELECT db_id, 0 AS s FROM cat_fks UNION ALL SELECT db_id, 1 FROM new_fks) GROUP BY db_id) f USING (db_id)"""
add("scaling_metadata", METADATA, *GROUND, grown(2))


# --- names to enlarged catalogs -------------------------------------------------
def candidates():
    """The candidate pool with CTE names of its own."""
    statement = ORACLES["candidate_pool"].replace("found", "cand")
    ctes, final = statement.removeprefix("WITH RECURSIVE ").rsplit("\n\nSELECT db_id, word, round", 1)
    own = ctes.replace(VEC + ",\n", "").replace(NAMES_V + ",\n", "").replace(WORDS_V + ",\n", "")
    return own, "SELECT db_id, word, round" + final


_ctes, _pool = candidates()
add("enlarge_chain", "SELECT m.*, greatest(0, n_entity_wanted + n_meta_wanted - coalesce(have, 0))::BIGINT AS n_missing FROM (" + METADATA + ") m "
    "JOIN (SELECT db_id, n_entity AS n_entity_wanted, n_meta AS n_meta_wanted FROM counts) USING (db_id) LEFT JOIN (SELECT db_id, count(*) AS have FROM fresh GROUP BY db_id) USING (db_id)",
    CATALOG, NAMES, LEXICON, VEC,
    "vectored AS (SELECT word, v, norm FROM (SELECT word, row_number() OVER (ORDER BY n, md5(word)) - 1 AS vec_id FROM vocab JOIN word_counts USING (word)) JOIN e USING (vec_id))",
    "names AS (SELECT n.db_id, w.word, v, norm FROM all_names n JOIN vectored w ON n.name = w.word)",
    "words AS (SELECT word, v, norm FROM vectored)",
    _ctes, f"pools AS ({_pool})",
    "fresh AS (SELECT * FROM pools WHERE (db_id, lower(word)) NOT IN (SELECT (db_id, lower(name)) FROM all_names))",
    f"""counts AS (
  SELECT db_id, n_orig, n_new, round_even(n_new * 0.60, 0)::BIGINT AS n_entity, round_even(n_new * 0.25, 0)::BIGINT AS n_join,
         n_new - round_even(n_new * 0.60, 0)::BIGINT - round_even(n_new * 0.25, 0)::BIGINT AS n_meta
  FROM (SELECT db_id, n_orig, greatest(0, list_extract([50, 100, 250, 500, 800], floor({uniform('size', 'db_id')} * 5)::INT + 1) - n_orig) AS n_new
        FROM (SELECT db_id, count(*) AS n_orig FROM cat_tables GROUP BY db_id))
)""",
    SLOTS[SLOTS.index("fresh_ranked AS"):], grown(2))
