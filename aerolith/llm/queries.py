"""The opN_<name> queries: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(documents(spark, sf_dir), ["doc_id", "source"])[0]


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), ["doc_id"])


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import evidence, license_scan

    found = license_scan(documents(spark, sf_dir), ["doc_id"])
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "matches.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        evidence(F.col("places"), F.col("matches")).alias("score"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_tokens, token_files

    path, codec = token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, codec, with_ids=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(documents(spark, sf_dir), ["doc_id"])


def op6_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import sample_digests

    return sample_digests(documents(spark, sf_dir), ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"), F.col("doc_id"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import base_spans, count_kind, found_spans, secret_scan, span_text

    found, name = secret_scan(documents(spark, sf_dir), ["doc_id"])
    spans = F.col(name)
    return found.select(
        "doc_id",
        count_kind(spans, 0).alias("n_assign"),
        count_kind(spans, 1).alias("n_access"),
        count_kind(spans, 2).alias("n_hex"),
        F.sha2(span_text(base_spans(spans)), 256).alias("base_sha256"),
        span_text(found_spans(spans)).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir), ["doc_id"]).drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_lexicon, held_out, score_toxicity

    docs = documents(spark, sf_dir)
    lexicon = fit_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, lexicon, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(embeddings(spark, sf_dir), ["vec_id"]).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents, piece_digests, read_sequences

    return piece_digests(read_sequences(spark, pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0, moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_license_scan": op3_license_scan,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_sample_pieces": op6_sample_pieces,
    "op7_secret_scan": op7_secret_scan,
    "op8_nearest": op8_nearest,
    "op9_remove_repeats": op9_remove_repeats,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a, v b WHERE a.id % 50 = 0 AND b.id <> a.id),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3""",
}
