"""The numbered operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_embedding_dedup, op02_toxicity, op03_token_counts, op04_language, op05_url_filter, op06_warc_zip, op07_ngram_join, op08_token_files, op09_decontaminate
from . import op11_license_scan, op12_filter_audit, op13_centroids
from . import op10_bpe as bpe
from .common import learn_bucket, stored, table, work_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
VOCAB_SIZE = 49_408
END_ID = 1

#: The rules of the URL query: verdict, host, path.
URL_RULES = [
    op05_url_filter.Rule("allow", "org", "/"),
    op05_url_filter.Rule("block", "example.org", "/es/"),
    op05_url_filter.Rule("block", "example.org", "/en/1"),
    op05_url_filter.Rule("allow", "com", "/fr/"),
    op05_url_filter.Rule("block", "com", "/de/"),
]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out documents (crc32 mod 5 = 0) are never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(learn_bucket("doc_id", 5) != 0)
    model = op02_toxicity.fit(docs, labels)
    return op02_toxicity.score(docs, model).select("doc_id", (learn_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three change batches: all documents come in; those of fewer than 40 tokens are deleted; those left where the newer tokenizer counts over a fifth more are counted anew by it. The second batch is sent twice."""
    v1, v2 = op03_token_counts.TOKENIZERS
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = stored(
        docs.select(
            "source", "lang",
            op03_token_counts.count_tokens("text", op03_token_counts.TOKENIZERS[v1]).alias("n1"),
            op03_token_counts.count_tokens("text", op03_token_counts.TOKENIZERS[v2]).alias("n2"),
        ).withColumns({"gone": F.expr("n1 < 40"), "revised": F.expr("5 * n2 > 6 * n1")}),
        "counted",
    )
    rollup = op03_token_counts.TokenRollup(spark, work_dir(spark, "rollup"))
    changes = op03_token_counts.changes
    rollup.apply("insert", changes(counted, 1, v1, "n1"))
    for _ in range(2):
        rollup.apply("delete", changes(counted.where("gone"), -1, v1, "n1"))
    revised = counted.where("revised and not gone")
    rollup.apply("revise", changes(revised, -1, v1, "n1").unionByName(changes(revised, 1, v2, "n2")))
    return rollup.totals()


OP3_SQL = r"""
WITH counted AS (
  SELECT *, n1 < 40 AS gone, 5 * n2 > 6 * n1 AS revised
  FROM (SELECT source, lang, coalesce(len(regexp_extract_all(text, '\S+')), 0) AS n1,
               coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')), 0) AS n2
        FROM documents)
), changes AS (
  SELECT source, lang, 'white-1' AS tokenizer, 1 AS sign, n1 AS n FROM counted
  UNION ALL SELECT source, lang, 'white-1', -1, n1 FROM counted WHERE gone
  UNION ALL SELECT source, lang, 'white-1', -1, n1 FROM counted WHERE revised AND NOT gone
  UNION ALL SELECT source, lang, 'alnum-2', 1, n2 FROM counted WHERE revised AND NOT gone
)
SELECT source, lang, tokenizer, CAST(sum(sign) AS BIGINT) AS n_docs, CAST(sum(sign * n) AS BIGINT) AS n_tokens
FROM changes GROUP BY source, lang, tokenizer HAVING sum(sign) <> 0 OR sum(sign * n) <> 0
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out documents (crc32 mod 3 = 1) are never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = op04_language.fit(docs.where(learn_bucket("doc_id", 3) != 1))
    got = op04_language.predict(docs.select("doc_id", "text"), dictionaries)
    return got.select("doc_id", (learn_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_warc_zip.warc_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op08_token_files.token_files(spark, docs, VOCABULARY, VOCAB_SIZE, END_ID)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), op09_decontaminate.Params(verbatim=True))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)


def op11_license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_license_scan.digest(table(spark, sf_dir, "documents"))


def op12_filter_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_toxicity, op3_token_counts, op4_language, op5_url_filter, op6_warc_zip, op7_ngram_join, op8_token_files, op9_decontaminate, op10_bpe)}
QUERIES |= {"op11_license_scan": op11_license_scan_query, "op12_filter_audit": op12_filter_audit_query, "op13_centroids": op13_centroids_query}
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(m.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON e.vec_id = n.a
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) m ON e.vec_id = m.a
"""

SQL = {"op1_embedding_dedup": OP1_SQL, "op3_token_counts": OP3_SQL, "op5_url_filter": OP5_SQL, "op6_warc_zip": OP6_SQL, "op9_decontaminate": op09_decontaminate.oracle()}
SQL |= {"op11_license_scan": op11_license_scan.oracle(), "op12_filter_audit": op12_filter_audit.oracle(), "op13_centroids": op13_centroids.oracle()}
