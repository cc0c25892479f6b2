"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, language_id, packing, pii, secrets, sharding, simhash, token_counts, warc

def pii_key(spark: SparkSession) -> bytes:
    """The key of the surrogates: the session's spark.stellarframe.pii.key, which a real run sets to a secret of its own."""
    return spark.conf.get("spark.stellarframe.pii.key", "stellarframe-example-key").encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 24)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"), pii_key(spark))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_embedding_dedup, op2_warc, op3_decontamination, op4_packing, op5_sharding, op6_token_counts, op7_secrets, op8_language_id, op9_pii, op10_simhash, pipeline)
}

_LINKS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / a.n / b.n >= 0.93)"""

# base 32 of the SHA-1: five hexadecimal digits are four letters
_BASE32 = "list_aggregate(list_transform(generate_series(0, 7), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(sha1(t), 5 * i + 1, 5) AS INT) >> b) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '')"


def _secrets_sql() -> str:
    """Matches, and what lies between them, as lists; a match begins after all that is before it."""
    found = []
    for place, r in enumerate(secrets.RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        found.append(f"SELECT doc_id, {place} AS place, '{r.kind}' AS kind, {r.least} AS least, {str(r.base).lower()} AS base, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS part, string_split_regex(t, {pattern}) AS gap FROM d")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(found)}),
one AS (SELECT doc_id, place, kind, least, base, m, part, gap, unnest(generate_series(1, len(m))) AS i FROM f WHERE len(m) > 0),
spot AS (SELECT doc_id, place, kind, base, len(m[i]) AS n, list_sum(list_transform(gap[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s FROM one WHERE len(part[i]) >= least),
said AS (SELECT doc_id, place, kind, base, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS span FROM spot)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, place) FILTER (base), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, place), '') AS spans
FROM documents LEFT JOIN said USING (doc_id) GROUP BY doc_id"""


ORACLE_SQL = {
    "op1_embedding_dedup": f"""WITH RECURSIVE {_LINKS}, r(id, c) AS (SELECT DISTINCT u, u FROM links UNION SELECT links.v, r.c FROM r JOIN links ON links.u = r.id WHERE r.c < links.v),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id), k AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON id = vec_id LEFT JOIN k ON u = vec_id""",
    "op2_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f""",
    "op7_secrets": _secrets_sql(),
}
