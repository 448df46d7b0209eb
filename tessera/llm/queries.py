"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, bwtdedup, decontam, langmix, licences, mainhtml, onebit, quality, triejoin, warc
from tessera.llm.common import crc_remainder

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text of documents and decode it again; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, "text", "token_ids", "decoded")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the labelled rows outside the held-out fold; score every text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "text", "score").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn languages outside the held-out fold; take every text of documents apart into languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langmix.fit(docs.where(crc_remainder("doc_id", 4) != 2))
    return langmix.predict(docs.drop("lang"), model, "text", "lang_pred", "score").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_remainder("doc_id", 4) == 2).alias("held_out"),
        "lang_pred",
        "score",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record for every page, revisits for equal payloads, and read the archives back."""
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on pages that mark their article; extract the main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = mainhtml.extract_main(pages, mainhtml.fit(pages), "html", "text")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op1_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th embedding among all others."""
    return onebit.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0, 20)


def op3_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return triejoin.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take every byte out of documents that a 100-byte string with an earlier start covers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bwtdedup.remove(docs, bwtdedup.spans(docs)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("dedup_bytes").alias("n_bytes"),
        F.col("dedup_removed").alias("n_removed"),
        F.col("dedup_spans").alias("n_spans"),
        F.sha2("dedup_kept", 256).alias("kept_sha256"),
    )


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "ids", "names")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("names", ",").alias("licences"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the benchmark items that its passages leak."""
    found = decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), output="found")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.size("found") > 0).alias("contaminated"),
        F.size("found").cast("long").alias("n_items"),
        F.col("found.item_id").alias("item_ids"),
    )


OP1_SQL = """
WITH good AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

QUERIES = {"op1_onebit_search": op1_onebit_search, "op2_licences": op2_licences, "op3_trie_join": op3_trie_join, "op4_byte_bpe": op4_byte_bpe, "op5_decontamination": op5_decontamination, "op6_quality": op6_quality, "op7_warc": op7_warc, "op8_language": op8_language, "op9_bwt_dedup": op9_bwt_dedup, "op10_main_text": op10_main_text}
ORACLE: dict[str, str] = {"op1_onebit_search": OP1_SQL, "op2_licences": licences.sql()}
