"""The named queries of the text operators: each over its whole tables, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrisk.llm import bpe, chat, chunks, decontaminate, fingerprint, html, jaccard, licenses, lm, negatives, packing, quality, spans
from segrisk.llm.text import small_batches

Query = Callable[[SparkSession, str], DataFrame]

LEARNED = "crc32(cast(doc_id AS string)) % 4 <> 2"  # rows whose quality labels may be learned from
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), LEARNED)
    return quality.score(docs, model).select(
        "doc_id",
        F.coalesce(~F.expr(LEARNED), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.with_digests(hits)


def op3_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = f"{chat.STOP}{chat.START}assistant ok"
    tricky = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], own.schema)
    return chat.read_back(chat.prefix_target_examples(own.unionByName(tricky)))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"), jaccard.Rule(size=4, percent=85))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"), "crc32(cast(doc_id AS string)) % 5 = 1")


def op6_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        "whole_license",
        F.size("matches").cast("long").alias("n_matches"),
    )


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = chunks.repeated_passages(_table(spark, sf_dir, "documents"))
    rows = passages.groupBy("doc_id", "variant").agg(
        F.count(F.lit(1)).alias("n_passages"),
        F.sum("size").alias("repeated_bytes"),
        F.sum("n_chunks").alias("n_chunks"),
        F.array_sort(F.collect_list(F.struct("start", "size"))).alias("passages"),
    )
    return rows.drop("variant")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), BYTE_BPE)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(bpe.decoder(BYTE_BPE)("ids"), 256).alias("decoded_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.usable_rows(_table(spark, sf_dir, "embeddings"), relabel_every=7))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = spans.align(_table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return spans.with_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))


def queries() -> dict[str, Query]:
    functions = [
        op1_quality, op2_benchmark_hits, op3_chat_examples, op4_ngram_jaccard, op5_context_mixing,
        op6_phrase_fingerprints, op7_packing, op8_licenses, op9_repeated_passages, op10_main_text,
        op11_bpe_round_trip, op12_hard_negatives, op13_token_alignment,
    ]
    return {f.__name__: in_small_batches(f) for f in functions}


def in_small_batches(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, or a stage, in a session that sends few texts at a time to Python."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        small_batches(spark)
        return query(spark, *args)

    return run
