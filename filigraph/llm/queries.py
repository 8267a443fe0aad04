"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filigraph.llm import ball_kmeans, exact_dedup, merkle, mixing, ogg, pieces, pii, quality, secrets, simhash, token_counts, toxicity, warc
from filigraph.llm.shared import documents, new_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that no earlier run does this one's work."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(documents(spark, sf_dir), path, new_path(spark, "token_cache"), limit=1024)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.frequent_words(documents(spark, sf_dir))
    model = secrets.train(secrets.synthetic_findings(spark), words=words)
    return secrets.scan(documents(spark, sf_dir), model, path_col="source", words=words)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_features(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key here is for tests; a real one comes from the caller."""
    return pii.pseudonymise(documents(spark, sf_dir), key="demonstration key")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), fanout=2, tamper_every=7)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, dims=64, rounds=5, scale=256, seed=2)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = (
    op1_simhash, op2_warc, op3_exact_dedup, op4_token_counts, op5_mixing, op6_secrets, op7_pieces, op8_toxicity, op9_ogg, op10_pii, op11_merkle, op12_ball_kmeans, op13_quality,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op11_merkle": OP11_SQL, "op12_ball_kmeans": kmeans_sql(40, 64, 5, 256, 2)}


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN p.page_id < g.last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < g.last_id THEN g.last_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""

OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP11_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, c: list_reduce(list_concat([xor(a, c)], CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 7 = 0 AS hit,
    concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(concat(head, coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), tail)) AS leaf,
    sha256(concat(head, coalesce(length(CAST(n_chars + hit::INT AS VARCHAR)) || ':' || (n_chars + hit::INT), '-'), tail)) AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n
  FROM fields),
tree AS (
  SELECT lang, 0 AS lvl, r AS i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
subroots AS (
  SELECT lang, lvl AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, r AS i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
walk AS (
  SELECT l.doc_id, l.lang, l.leaf, l.shown, l.r AS i, s.r AS g, s.subroot, 0 AS lvl, s.height, (SELECT max(lvl) FROM top) AS up, '' AS proof, l.shown AS folded
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, w.lang, leaf, shown, CASE WHEN w.lvl + 1 = height THEN g ELSE w.i // 2 END, g, subroot, w.lvl + 1, height, up, concat(proof, b.h),
    sha256(CASE WHEN w.i % 2 = 0 THEN concat(folded, b.h) ELSE concat(b.h, folded) END)
  FROM walk w LEFT JOIN (SELECT lang, false AS above, lvl, i, h FROM tree UNION ALL SELECT NULL, true, lvl, i, h FROM top) b
    ON b.above = (w.lvl >= height) AND (b.above OR b.lang IS NOT DISTINCT FROM w.lang) AND b.lvl = (CASE WHEN w.lvl >= height THEN w.lvl - height ELSE w.lvl END)
      AND b.i = xor(CASE WHEN w.lvl = height AND height = 0 THEN g ELSE w.i END, 1)
  WHERE w.lvl < height + up)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM top WHERE n = 1) AS verified
FROM walk WHERE lvl = height + up
"""


def kmeans_sql(k: int, dims: int, rounds: int, scale: int, seed: int) -> str:
    """Lloyd's rounds one after the other, every vector against every centroid."""
    parts = [f"""WITH kept AS (
  SELECT vec_id, row_number() OVER () AS vid, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
  FROM embeddings
  WHERE length(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k})"""]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT vid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(c, d * {k} + c) AS c
  FROM (SELECT vid, vec_id, kept.v, c, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (kept.v[i] - c{t}.v[i]) * (kept.v[i] - c{t}.v[i]))) AS BIGINT) AS d FROM kept, c{t})
  GROUP BY vid)""")
        if t < rounds:
            parts.append(f"""m{t} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
  FROM (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{t}, range(1, {dims + 1}) r(i) GROUP BY c, i) GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(m{t}.v, c{t}.v) AS v FROM c{t} LEFT JOIN m{t} ON c{t}.c = m{t}.c)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON a.c = k.c"""
