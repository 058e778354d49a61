"""A training-data pipeline of five operators: each stage takes documents and returns what it keeps.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns that they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import documents, free_name, materialize
from aerolith.llm.mixing import mix_order
from aerolith.llm.near_dup import near_duplicates
from aerolith.llm.pieces import sample_digests
from aerolith.llm.quality import quality_rules
from aerolith.llm.secrets import mask_live, secret_scan

#: near duplicates: words of a shingle and similarity
SHINGLE, SIMILARITY = 5, 0.8


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. The verdict depends on text and language alone, so that only the hashes of rejected
    pairs go back to the documents. A null text counts as empty and goes; repeated rows go or stay together; an empty
    table stays empty."""
    key, lang = free_name(docs, "text_key"), free_name(docs, "text_lang")
    named = [F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias(key), F.coalesce(F.concat(F.lit("l"), F.col("lang").cast("string")), F.lit("")).alias(lang)]
    found = quality_rules(docs.select(*named, "text", "lang"), [key, lang])
    bad = found.filter(~F.col("kept")).select(key, lang).distinct()
    return docs.select("*", *named).join(bad, [key, lang], "left_anti").select(*_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Rows are told apart by their places in the files that they are read
    from (ids may repeat); rows that come from elsewhere are written and numbered first. Texts without words (null and
    empty ones too) are linked with nothing and stay; an empty table stays empty."""
    place = [free_name(docs, "file_path"), free_name(docs, "file_row")]
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias(place[0]), F.col("_metadata.row_index").alias(place[1]))
    except AnalysisException:
        rows = materialize(docs.select("*", F.lit("").alias(place[0]), F.monotonically_increasing_id().alias(place[1])), "numbered")
    ident = free_name(rows, "row_id")
    named = rows.select(*place, F.xxhash64(*place).alias(ident), "text")
    found = near_duplicates(named, place, id_col=ident, k=SHINGLE, threshold=SIMILARITY)
    return rows.join(found.filter(~F.col("kept")).select(*place), place, "left_anti").select(*_own(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced in their texts."""
    found, spans = secret_scan(docs, docs.columns)
    out = [F.col(f"`{c}`") for c in docs.columns]
    at = docs.columns.index("text")
    out[at] = mask_live(F.col("text"), F.col(spans)).alias("text")
    if "n_chars" in docs.columns:
        out[docs.columns.index("n_chars")] = F.when(F.exists(spans, lambda s: s["live"]), F.length(out[at]).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*out)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: a source that has run out leaves its slots to the others."""
    return mix_order(docs, docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, as digests."""
    return sample_digests(docs, ["doc_id", "source"], public_tokenizers.path("piece_bpe_32k.model"), F.col("doc_id"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: perplexity models, banding and sampled segmentations are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
