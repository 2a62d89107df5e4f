"""The registered queries of the subpackage; each is thin and gets its rows from one operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxtally.llm import bpe, centroids, jaccard, langid, near_vectors, packing, periodic, quality, secrets, sharding, topk, toxicity, warc
from voxtally.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("id % 20 = 0"), vectors, 20)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summarised(read(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.collapse(periodic.repeated_tail(read(spark, sf_dir, "documents")), digests=True))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_best_fit_packing, op2_secret_scan, op3_exact_top_k, op4_byte_bpe, op5_language_id, op6_embedding_near_dedup, op7_feistel_shards, op8_toxicity, op9_quality, op10_ngram_jaccard, op11_centroid_clustering, op12_periodic_runs, op13_warc)}


def _lloyd(k: int, rounds: int) -> str:
    """Rounds of plain assignment and replacement; every distance is computed."""
    steps = [f"""kept AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), uid) - 1 AS cluster, v AS c FROM kept ORDER BY cluster LIMIT {k})"]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT uid, vec_id, any_value(v) AS v, arg_min(struct_pack(c := cluster, d := d), struct_pack(d := d, c := cluster)) AS best FROM
            (SELECT uid, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept CROSS JOIN c{r}) GROUP BY uid, vec_id)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY dim) AS c FROM
                (SELECT best.c AS cluster, dim, sum(v[dim])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(dim) GROUP BY ALL) GROUP BY cluster)""")
            steps.append(f"c{r + 1} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cluster))")
    return f"""WITH {", ".join(steps)} SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
        (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} f ON f.cluster = best.c"""


ORACLES: dict[str, str] = {
    "op11_centroid_clustering": _lloyd(16, 3),
    "op13_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        g AS (SELECT *, n >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY d, n) AS again, max(page_id) OVER (PARTITION BY d, n) AS kept FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN kept END AS refers_to, true AS intact FROM g""",
}
