"""The jobs as registered queries: each runs twice into one new folder, and its output is read back and compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.queries import CLEAN, TOKENS, UNESCAPED
from docsift.sources.scratch import shared_folder
from jobs import chunk_intake, evidence_report


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that nothing else uses; it stays."""
    return f"{shared_folder(spark).rstrip('/')}/docsift-jobs/{name}-{uuid.uuid4().hex}"


_BODY = CLEAN.format(UNESCAPED.replace("html", "text"))
CHUNKS = f"""
    WITH bodies AS (SELECT doc_id, coalesce(source, '') AS source, {_BODY} AS body FROM documents WHERE doc_id IS NOT NULL),
    parts AS (SELECT *, unnest(generate_series(0, CASE WHEN length(body) <= 700 THEN 0 ELSE CAST(ceil((length(body) - 700) / 620.0) AS BIGINT) END)) AS part FROM bodies WHERE body <> ''),
    chunks AS (SELECT substr(sha1(source || '|1||' || doc_id || '|' || part), 1, 12) AS chunk_id, doc_id, part, source, trim(substr(body, CAST(1 + 620 * part AS INTEGER), 700)) AS shown FROM parts
               WHERE length(trim(substr(body, CAST(1 + 620 * part AS INTEGER), 700))) >= 20)
"""


def job1_chunk_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that stand after two runs, with what the postings count of each."""
    out = _folder(spark, "chunk_intake")
    for _ in range(2):
        chunk_intake.run(spark, f"{sf_dir}/documents.parquet", f"{out}/tables", f"{out}/checkpoint")
    # digests, so that the join moves no texts
    chunks = chunk_intake.current_chunks(spark, f"{out}/tables").select("chunk_id", "doc_id", "part", "source_file", F.sha2(F.col("display_text").cast("binary"), 256).alias("text_sha256"))
    words = chunk_intake.current_index(spark, f"{out}/tables").postings.groupBy("chunk_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"))
    rows = chunks.join(words, "chunk_id", "left")
    return rows.select("chunk_id", "doc_id", "part", "source_file", "text_sha256", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def job2_evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the users' questions after two runs."""
    out = _folder(spark, "evidence_report")
    for _ in range(2):
        evidence_report.run(spark, f"{sf_dir}/conversations.parquet", out, f"{sf_dir}/documents.parquet")
    rows = evidence_report.read_report(spark, out)
    ids = F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), ",")
    return rows.select("conv_id", "turn", "sufficient", "n_terms", F.round("coverage", 9).alias("coverage"), F.array_join("missing", "|").alias("missing"), F.coalesce(ids, F.lit("")).alias("chunk_ids"), F.coalesce(F.round(F.col("evidence")[0]["score"], 6), F.lit(0.0)).alias("best_score"))


QUERIES = {"job1_chunk_intake": job1_chunk_intake, "job2_evidence_report": job2_evidence_report}

ORACLE_SQL = {
    "job1_chunk_intake": CHUNKS + f"""
        , counted AS (SELECT *, {TOKENS.format("shown")} AS t FROM chunks)
        SELECT chunk_id, doc_id, part, source AS source_file, sha256(shown) AS text_sha256, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM counted
    """,
    "job2_evidence_report": CHUNKS + f"""
        , tokens AS (SELECT chunk_id, doc_id, part, {TOKENS.format("shown")} AS t FROM chunks),
        stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tokens),
        postings AS (SELECT chunk_id, doc_id, part, len(t) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM tokens) GROUP BY ALL),
        terms AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, stats GROUP BY term, n),
        asked AS (SELECT conv_id, turn, {TOKENS.format(_BODY)} AS t FROM conversations WHERE role = 'user'),
        words AS (SELECT conv_id, turn, term, count(*) AS qtf FROM (SELECT conv_id, turn, unnest(t) AS term FROM asked) GROUP BY ALL),
        scored AS (SELECT conv_id, turn, chunk_id, doc_id, part, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM words JOIN terms USING (term) JOIN postings USING (term), stats GROUP BY ALL),
        top AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc_id, part) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 5),
        found AS (SELECT conv_id, turn, string_agg(chunk_id, ',' ORDER BY rank) AS ids, max(CASE WHEN rank = 1 THEN score END) AS best, list_distinct(flatten(list(t))) AS t FROM top JOIN tokens USING (chunk_id) GROUP BY ALL),
        shares AS (SELECT a.conv_id, a.turn, list_distinct(a.t) AS asked, f.ids, f.best, list_filter(list_distinct(a.t), lambda x: NOT list_contains(coalesce(f.t, []), x)) AS missing FROM asked a LEFT JOIN found f USING (conv_id, turn)),
        scores AS (SELECT *, CASE WHEN len(asked) = 0 THEN 1.0 ELSE CAST(len(asked) - len(missing) AS DOUBLE) / len(asked) END AS coverage FROM shares)
        SELECT conv_id, turn, ids IS NOT NULL AND coverage >= 0.35 AS sufficient, CAST(len(asked) AS INTEGER) AS n_terms, round(coverage, 9) AS coverage, array_to_string(list_sort(missing), '|') AS missing,
               coalesce(ids, '') AS chunk_ids, coalesce(round(best, 6), 0.0) AS best_score FROM scores
    """,
}
