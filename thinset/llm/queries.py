"""Registered queries of this package and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinset.llm import (archives, chat, decontaminate, dedup, jaccard, lexical, licenses, mixing, neighbours,
                         repeats, secrets, toxicity, urls)
from thinset.workspace import new_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "moments")


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    ratios = secrets.train(secrets.labelled_tokens(docs))
    return secrets.digest(secrets.find_secrets(docs, ratios))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archives.round_trip(_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(_table(spark, folder, "pages"))


def op5_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches, the larger ids first, so that the second meets a filled index."""
    docs = _table(spark, folder, "documents")
    middle = docs.agg(F.expr("(min(doc_id) + max(doc_id)) div 2")).first()[0]
    later = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    index = dedup.DigestIndex(spark, new_path(spark, "digest-index"))
    index.ingest(docs.where(later), "later")
    index.ingest(docs.where(~later), "earlier")
    return index.decisions(docs)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per passage of a benchmark item found in a document."""
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair_roles(_table(spark, folder, "conversations"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(_table(spark, folder, "documents"))).drop("found")


def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, folder, "documents"))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.run_digests(_table(spark, folder, "documents")).drop("n_words")


def op12_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"))


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_secrets, op3_warc, op4_urls, op5_dedup, op6_decontamination,
                            op7_chat, op8_toxicity, op9_licenses, op10_jaccard, op11_runs, op12_neighbours,
                            op13_lexical)}

_TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_jaccard": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
              FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id, doc_id AS other FROM documents
              UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
        FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op13_lexical": f"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term FROM documents),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
        s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM d),
        w AS (SELECT term, floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
              FROM p, s GROUP BY term, s.docs),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term FROM benchmark),
        x AS (SELECT i.item_id, p.doc_id,
                     sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * d.n * s.docs) // s.len))))::BIGINT AS score
              FROM i JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), s GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
                     doc_id, score FROM x WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
}
