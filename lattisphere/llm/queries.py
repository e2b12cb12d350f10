"""The queries of the corpus operators, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chunkdedup, decontamination, language, quality, sharding, simhash, suffixdedup, tokenstore, topk


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_sharding(spark, sf_dir):
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op6_simhash(spark, sf_dir):
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op1_token_store(spark, sf_dir):
    return tokenstore.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chunk_dedup(spark, sf_dir):
    found = chunkdedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")


def op10_suffix_dedup(spark, sf_dir):
    return suffixdedup.dedup(table(spark, sf_dir, "documents"))


def op8_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_token_store": op1_token_store, "op2_sharding": op2_sharding, "op3_chunk_dedup": op3_chunk_dedup, "op4_quality": op4_quality, "op5_language": op5_language, "op6_simhash": op6_simhash, "op7_bpe": op7_bpe, "op8_topk": op8_topk, "op9_decontamination": op9_decontamination, "op10_suffix_dedup": op10_suffix_dedup}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_SHINGLES = "unnest([array_to_string(w[i : i + n - 1], ' ') for i in range(1, len(w) - n + 2)])"

#: DuckDB SQL where it can express a query; the others need XXH64, CRC-32, a tokenizer, a rolling hash or a fitted model.
ORACLE = {
    "op10_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
 c AS (SELECT doc_id, n, c, substr(h, 400 * c + 1, 498) AS h FROM (SELECT doc_id, h, n, unnest(range(0, n // 200 + 1)) AS c FROM d)),
 s AS (SELECT doc_id, 200 * c + j AS k, substr(h, 2 * j + 1, 100) AS s FROM (SELECT doc_id, c, h, unnest(range(0, greatest(0, least(200, n - 49 - 200 * c)))) AS j FROM c)),
 m AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s), hit AS (SELECT doc_id, k FROM s JOIN m USING (s) WHERE first < doc_id),
 o AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM hit),
 i AS (SELECT doc_id, k, sum(CASE WHEN p IS NULL OR k - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM o),
 r AS (SELECT doc_id, g, min(k) AS a, max(k) + 50 AS b FROM i GROUP BY doc_id, g), t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS z FROM r GROUP BY doc_id),
 x AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS e FROM r UNION ALL SELECT doc_id, z, n FROM t JOIN d USING (doc_id)),
 q AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (e - f)), '' ORDER BY f) AS q FROM x JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(q, h))) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id""",
    "op8_topk": """WITH v AS (SELECT vec_id, [floor(64 * CAST(e AS DOUBLE)) for e in embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 bn AS (SELECT item_id, w, least(5, len(w)) AS n FROM b WHERE len(w) > 0), bs AS (SELECT DISTINCT item_id, n, {_SHINGLES} AS s FROM bn),
 ds AS (SELECT DISTINCT doc_id, n, {_SHINGLES} AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM bn) WHERE len(w) >= n),
 t AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id), m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM bs JOIN ds USING (n, s) GROUP BY doc_id, item_id)
 SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item, n_shared / CAST(n_item AS DOUBLE) AS containment FROM m JOIN t USING (item_id) WHERE n_shared >= 0.8::DOUBLE * n_item""",
}
