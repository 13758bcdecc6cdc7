"""Registered queries of the operators in this package and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import bpe, conversations, decontaminate, fingerprints, jaccard, language, lexical, pages, pitman_yor, secrets, substrings, token_files, warc
from schemaloom.llm.arrow import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 5; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5, F.lit(-1))


@query
def op1_language_id(spark, d):
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold() != 0))
    found = language.predict(docs.select("doc_id", "text", (fold() == 0).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_token_files(spark, d):
    """Every document encoded, written to token files and read back from them."""
    docs = token_files.write_and_read(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_byte_bpe(spark, d):
    """Ids of every document by merge replay, and the bytes they decode to."""
    ids = bpe.encode(table(spark, d, "documents").select("doc_id", "text")).drop("text")
    ids = ids.withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe.decode(ids).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_secret_scan(spark, d):
    """Secrets of every document: counts and spans."""
    found = secrets.scan(table(spark, d, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))

    def count(rank, kind):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [count(rank, rule.kind) for rank, rule in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def _secret_oracle() -> str:
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""
            SELECT n, {rank} AS rank, '{rule.kind}' AS kind, i,
                   list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start,
                   length(m[i]) AS size, length(v[i]) AS value, {rule.least} AS least
            FROM (SELECT n, unnest(range(1, len(m) + 1)) AS i, m, v, g
                  FROM (SELECT n, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {rule.group}) AS v,
                               string_split_regex(text, '{p}') AS g FROM docs))""")
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
        hits AS MATERIALIZED ({" UNION ALL ".join(parts)}),
        spans AS (SELECT n, rank, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS s FROM hits WHERE value >= least),
        sums AS (SELECT n, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
                        string_agg(s, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans
                 FROM spans GROUP BY n)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN sums USING (n)"""


ORACLES["op10_secret_scan"] = _secret_oracle()


@query
def op3_substring_dedup(spark, d):
    """Words of every document that lie in windows of 13 which an earlier document has."""
    found = substrings.remove_repeats(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    spots AS MATERIALIZED (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM docs WHERE len(w) >= 13),
    windows AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM spots),
    firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM windows JOIN firsts USING (h) WHERE doc_id > first),
    lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
    FROM docs LEFT JOIN lists USING (doc_id)"""


@query
def op8_fingerprints(spark, d):
    """Fingerprint of every document and of its edited text, and their likeness."""
    return fingerprints.compare_edits(table(spark, d, "documents").select("doc_id", "text"))


@query
def op2_ngram_jaccard(spark, d):
    """Groups of documents that are linked by similar shingle sets."""
    return jaccard.components(table(spark, d, "documents").select("doc_id", "text"))


ORACLES["op2_ngram_jaccard"] = r"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
                              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM docs WHERE len(w) > 0)),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
    reach AS (SELECT x, x AS y FROM (SELECT DISTINCT x FROM links) UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
    least AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""


@query
def op4_decontamination(spark, d):
    """Documents that hold benchmark items, copied or with other values."""
    return decontaminate.matches(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


@query
def op7_html_extraction(spark, d):
    """Main text of every page."""
    raw = table(spark, d, "pages").select("page_id", "url", "html")
    found = pages.extract(raw, pages.fit(raw))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op9_lm_scoring(spark, d):
    """Log probability of every document by smoothed unigrams and by the Pitman-Yor model."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = pitman_yor.fit(docs.where((fold() != 1) & F.col("doc_id").isNotNull()))
    found = pitman_yor.score(docs, model)
    return found.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op12_conversation_repair(spark, d):
    """Every conversation damaged by its checksums, then repaired by the cheapest edits."""
    return conversations.repair(conversations.damage(table(spark, d, "conversations").select("conv_id", "turn", "role", "text")))


def _repair_oracle() -> str:
    """Dynamic programming over the rows: best (cost, edits) of each state, instead of a search."""
    def best(*options):
        return "list_sort([" + ", ".join(options) + "])[1]"

    def step(state, cost, letter):
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"

    never = "{'c': 1000000000, 'a': ''}"
    user = best("q.s2", *[step(f"q.s{k}", 3, "I") for k in (0, 1, 3)])
    assistant = best("q.s3", step("q.s2", 3, "I"), step("q.s0", 6, "II"), step("q.s1", 6, "II"))
    keep = "(CASE WHEN f = 't' THEN 3 ELSE 0 END)"

    def allowed(test, option):
        return f"CASE WHEN f NOT IN ('b', 'd') AND {test} THEN {option} ELSE {never} END"

    system = best(step("i1", 4, "D"), allowed("r = 's'", step("i0", keep, "K")))
    spoken = best(step("i2", 4, "D"), *[allowed("r = 'u'", step(f"i{k}", keep, "K")) for k in (0, 1, 3)],
                  *[allowed("true", step(f"i{k}", f"3 + {keep}", "R")) for k in (0, 1, 3)])
    answered = best(step("i3", 4, "D"), allowed("r = 'a'", step("i2", keep, "K")), allowed("true", step("i2", f"3 + {keep}", "R")))
    return f"""
        WITH RECURSIVE bytes AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
        raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        summed AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind FROM raw, bytes),
        broken AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                          CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                          unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM summed),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS p FROM broken),
        judged AS MATERIALIZED (
            SELECT conv_id, turn, role, text, p, CASE WHEN role = '' THEN chr(0) ELSE left(role, 1) END AS r,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS f FROM placed),
        walk(conv_id, p, s0, s1, s2, s3) AS (
            SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 1000000000::BIGINT, 'a': ''}}, {{'c': 1000000000::BIGINT, 'a': ''}}, {{'c': 1000000000::BIGINT, 'a': ''}}
            FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, p, {step("i0", 4, "D")}, {system}, {spoken}, {answered}
            FROM (SELECT q.conv_id, j.p, j.r, j.f, q.s0 AS i0, q.s1 AS i1, {user} AS i2, {assistant} AS i3
                  FROM walk q JOIN judged j ON j.conv_id IS NOT DISTINCT FROM q.conv_id AND j.p = q.p + 1)),
        ended AS (SELECT conv_id, least_path.c AS cost, least_path.a AS audit
                  FROM (SELECT conv_id, {best("q.s0", assistant)} AS least_path FROM walk q
                        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1)),
        edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS e FROM ended),
        cut AS (SELECT conv_id, e, audit[e] AS edit, length(replace(left(audit, e), 'I', '')) AS p FROM edits),
        lines AS (SELECT cut.conv_id, e, edit, j.role, coalesce(j.text, '') AS text, count(*) FILTER (WHERE edit <> 'D') OVER (PARTITION BY cut.conv_id ORDER BY e) AS out_no,
                         bool_or(edit = 'K' AND left(j.role, 1) = 's') OVER (PARTITION BY cut.conv_id) AS has_system
                  FROM cut LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM cut.conv_id AND j.p = cut.p),
        repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN (out_no - has_system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END
                                                || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY e) AS t
                     FROM lines WHERE edit <> 'D' GROUP BY conv_id),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 'b') AS blank,
                          count(*) FILTER (WHERE f = 'd') AS duplicate, count(*) FILTER (WHERE f = 't') AS truncated FROM judged GROUP BY conv_id),
        pairs AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(r) OVER (PARTITION BY conv_id ORDER BY p) || r AS two FROM judged)
                  WHERE two NOT IN ('su', 'ua', 'au') GROUP BY conv_id)
        SELECT ended.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM ended LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ended.conv_id LEFT JOIN pairs ON pairs.conv_id IS NOT DISTINCT FROM ended.conv_id
        LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ended.conv_id"""


ORACLES["op12_conversation_repair"] = _repair_oracle()


@query
def op13_warc(spark, d):
    """Every page written to WARC bundles and read back from them."""
    archive = warc.write(table(spark, d, "pages").select("page_id", "url", "html"))
    return warc.read(archive, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def _warc_oracle() -> str:
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v{g} >> {s} & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
    values = ", ".join(f"('0x' || substr(h, {5 * g + 1}, 5))::BIGINT AS v{g}" for g in range(8))
    return f"""
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
        cut AS (SELECT page_id, p, {values}, min(page_id) OVER (PARTITION BY p) AS first FROM payloads)
        SELECT page_id, strlen(p)::BIGINT AS payload_bytes, {letters} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified
        FROM cut"""


ORACLES["op13_warc"] = _warc_oracle()


@query
def op11_lexical_search(spark, d):
    """The ten documents that match each benchmark item best."""
    index = lexical.build(table(spark, d, "documents").select("doc_id", "text"))
    return lexical.search(index, table(spark, d, "benchmark").select("item_id", "text"))


ORACLES["op11_lexical_search"] = r"""
    WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    items AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    sums AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM docs WHERE len(t) > 0),
    norms AS (SELECT d, doc_id, 10 + (90 * len(t) * n) // l AS m FROM docs, sums WHERE len(t) > 0),
    wanted AS (SELECT i, unnest(t) AS term FROM items),
    tfs AS MATERIALIZED (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, sums GROUP BY term, n),
    scores AS (SELECT i, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
               FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN norms USING (d) GROUP BY i, d),
    ranked AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN norms USING (d) WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN items USING (i) WHERE rank <= 10"""
