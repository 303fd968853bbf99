"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.byte_bpe import round_trip
from docsift.llm.divergence import divergence_audit
from docsift.llm.exact_dedup import exact_dedup
from docsift.llm.graph_index import nearest
from docsift.llm.jaccard_join import jaccard_join
from docsift.llm.language_id import identify, prototypes
from docsift.llm.license_scan import ALL_RULES, ALL_SENTENCES, license_scan, sentences
from docsift.llm.mixing import mix
from docsift.llm.packing import pack
from docsift.llm.shared import table
from docsift.llm.substring_dedup import substring_dedup
from docsift.llm.token_counts import token_counts
from docsift.llm.url_filter import LIST_SCHEMA, url_filter


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


#: The list that op2 evaluates: rule, category, action, day. An entry that is neither block nor allow ends the rule's last one.
URL_LIST = (
    ("ads-track.example.com", "ads", "block", "2024-01-10"),
    ("ads-track.example.com", "ads", "remove", "2024-08-01"),
    ("casino-win.example.net", "gambling", "block", "2023-11-05"),
    ("spam-farm.example.org", "spam", "block", "2024-02-20"),
    ("www.spam-farm.example.org", "spam", "allow", "2024-06-01"),
    ("www.spam-farm.example.org", "spam", "remove", "2024-09-15"),
    ("adult-x.example.com", "adult", "block", "2023-05-01"),
    ("cheap-pills.example.net", "pharmacy", "block", "2024-04-01"),
    ("cheap-pills.example.net", "pharmacy", "remove", "2024-05-01"),
    ("cheap-pills.example.net", "pharmacy", "block", "2024-07-01"),
    ("free-bets.example.net", "gambling", "block", "2024-03-15"),
    ("tionsh.example.net/fr", "quality", "block", "2024-10-01"),
    ("blog.tionble.example.com/de", "quality", "block", "2024-01-01"),
    ("blog.tionble.example.com/de", "quality", "remove", "2024-03-01"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages have no date of their own: page_id spreads them over the days of 2024
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date '2024-01-01', cast(page_id % 366 as int))").alias("fetched_on"))
    out = url_filter(pages, spark.createDataFrame(URL_LIST, LIST_SCHEMA))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "listed_on")})


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op6_graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rank file is the vocabulary of byte_bpe_50k.json
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = identify(docs, prototypes(docs.where(~held_out)))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


MIX_SEED = 12


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), cycle=(1, 2, 3), most=3, seed=MIX_SEED).taken().drop("source")


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_url_filter": op2_url_filter, "op3_byte_bpe": op3_byte_bpe, "op4_substring_dedup": op4_substring_dedup, "op5_token_counts": op5_token_counts, "op6_graph_index": op6_graph_index, "op7_license_scan": op7_license_scan, "op8_packing": op8_packing, "op9_language_id": op9_language_id, "op10_jaccard_join": op10_jaccard_join, "op11_divergence": op11_divergence, "op12_mixing": op12_mixing}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


_KNOWN = _values((i, sentences(text)[0]) for i, text in ALL_SENTENCES.items())
_RULES = ", ".join(f"('{name}', {list(rule)})" for name, rule in ALL_RULES)

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op2_url_filter": f"""
        WITH list AS (SELECT rule, category, action, CAST(day AS DATE) AS day, lead(CAST(day AS DATE)) OVER (PARTITION BY rule ORDER BY day) AS until
                      FROM (VALUES {_values(URL_LIST)}) t(rule, category, action, day)),
        captures AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
                            lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host,
                            regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        met AS (SELECT c.page_id, l.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(l.rule) DESC) AS rn
                FROM captures c JOIN list l ON l.action IN ('block', 'allow') AND l.day <= c.fetched_on AND (l.until IS NULL OR c.fetched_on < l.until)
                 AND (c.host = split_part(l.rule, '/', 1) OR c.host LIKE '%.' || split_part(l.rule, '/', 1))
                 AND (l.rule NOT LIKE '%/%' OR c.path || '/' LIKE '/' || split_part(l.rule, '/', 2) || '/%'))
        SELECT c.page_id, c.host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, coalesce(m.action = 'block', false) AS blocked, m.rule, m.category, CAST(m.day AS VARCHAR) AS listed_on
        FROM captures c LEFT JOIN met m ON m.page_id = c.page_id AND m.rn = 1
    """,
    "op7_license_scan": f"""
        WITH known(id, sentence) AS (VALUES {_KNOWN}), rules(name, ids) AS (VALUES {_RULES}),
        cut AS (SELECT doc_id, string_split(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([^.!?;:\\s])[ \\t\\r]*\\n[ \\t]*([a-z(])', '\\1 \\2', 'g') || chr(10),
                       '[.!?;]+[ \\t\\r\\n]+', chr(10), 'g'), '[^A-Za-z0-9.+/\\n-]+', ' ', 'g')), chr(10)) AS parts FROM documents),
        each AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
        found AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM each JOIN known ON trim(part, ' ') = sentence GROUP BY doc_id),
        starts AS (SELECT doc_id, ids, unnest(generate_series(1, len(ids))) AS a FROM found),
        places AS (SELECT DISTINCT doc_id, a, a + len(r.ids) AS b, name FROM starts s JOIN rules r ON list_slice(s.ids, a, a + len(r.ids) - 1) = r.ids),
        held AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT name) AS n FROM places p
                 WHERE NOT EXISTS (SELECT 1 FROM places q WHERE q.doc_id = p.doc_id AND q.a <= p.a AND p.b <= q.b AND q.b - q.a > p.b - p.a) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(array_to_string(f.ids, ','), '') AS sentence_ids, coalesce(h.names, '') AS licenses, CAST(coalesce(h.n, 0) AS INTEGER) AS n_licenses
        FROM documents d LEFT JOIN found f USING (doc_id) LEFT JOIN held h USING (doc_id)
    """,
    "op4_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
        windows AS (SELECT doc_id, i, sha256(array_to_string(list_slice(words, CAST(i AS INTEGER), CAST(i + 49 AS INTEGER)), ' ')) AS h FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50)),
        first AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN first USING (h), generate_series(0, 49) g(k) WHERE low < doc_id),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS pos FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
        counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM w LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op10_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
        grams AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, CAST(i AS INTEGER), CAST(i + 4 AS INTEGER)), ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
        sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM grams GROUP BY doc_id),
        reps AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS rep FROM sets),
        own AS (SELECT g.* FROM grams g JOIN reps r ON g.doc_id = r.doc_id AND r.doc_id = r.rep),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM own a JOIN own b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT p.a, p.b FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b WHERE p.c >= 0.8 * (x.n + y.n - p.c) - 1e-9),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        roots AS (SELECT a AS rep, least(a, min(b)) AS root FROM reach GROUP BY a),
        counts AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY a),
        classed AS (SELECT w.doc_id, coalesce(root, r.rep, w.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(r.rep, w.doc_id) AS rep_id, CAST(coalesce(r.n, 0) AS INTEGER) AS n_shingles
                    FROM w LEFT JOIN reps r USING (doc_id) LEFT JOIN roots ON roots.rep = r.rep LEFT JOIN counts ON counts.rep = r.rep)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, n_links, rep_id, n_shingles FROM classed
    """,
    "op11_divergence": """
        WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS lang_c FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        counted AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        langs AS (SELECT lang, count(*) AS v, sum(lang_c) AS n FROM kept GROUP BY lang),
        sizes AS (SELECT lang, source, sum(c) AS n FROM counted GROUP BY ALL),
        groups AS (SELECT d.lang, d.source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN sizes s USING (lang, source) LEFT JOIN langs l USING (lang)),
        p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (g.n + g.v) AS BIGINT) AS p,
                     CAST(1 + 1000000000::HUGEINT * (k.lang_c + 1) // (l.n + l.v) AS BIGINT) AS q
              FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
        UNION ALL
        SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms QUALIFY rank <= 200
    """,
    "op12_mixing": f"""
        WITH own AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                            md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS digest FROM documents),
        sources AS (SELECT source, sum(size) AS total, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM own GROUP BY source),
        ranked AS (SELECT *, 3 * total AS most, sum(total) OVER () - coalesce(sum(3 * total) OVER (ORDER BY 3 * total / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
                          sum(weight) OVER (ORDER BY 3 * total / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM sources),
        settled AS (SELECT left_size, left_weight FROM ranked WHERE most * left_weight > weight * left_size ORDER BY most / weight, no LIMIT 1),
        aimed AS (SELECT r.source, CAST(r.total AS BIGINT) AS source_size, least(CAST(most AS DOUBLE), coalesce(CAST(weight * s.left_size AS DOUBLE) / CAST(s.left_weight AS DOUBLE), CAST(most AS DOUBLE))) AS target FROM ranked r LEFT JOIN settled s ON true),
        passes AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM aimed),
        placed AS (SELECT o.*, p.source_size, p.target, p.whole, p.quota - p.whole * p.source_size - coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY md5('{MIX_SEED}|' || p.whole || '|' || o.digest), o.r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words
                   FROM own o JOIN passes p ON o.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, left_words)) AS BIGINT) AS taken FROM placed
    """,
}
