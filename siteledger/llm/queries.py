"""The catalog of the training-data operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm import chat, exact_dedup, language, licenses, merkle, mixing, neardup, packing, passages, quality, repair, topk, toxicity
from siteledger.llm.folds import remainder
from siteledger.llm.storage import staged

TARGETS = mixing.Targets(
    weights={
        "domain": {"web": 5, "reference": 3, "forum": 2},
        "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
        "source": {"src0": 3},
    },
    share=0.6,
    epochs=2,
    domain=(
        "CASE WHEN source IN ('src0', 'src3', 'src6', 'src9') THEN 'web' "
        "WHEN source IN ('src1', 'src4', 'src7', 'src10') THEN 'reference' ELSE 'forum' END"
    ),
)
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(build: Build) -> Build:
    QUERIES[build.__name__] = build
    return build


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a budget of 60 % of all tokens takes of each document."""
    return mixing.plan(table(spark, sf_dir, "documents"), TARGETS)


@query
def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of fold 0 of 5 are held out."""
    rows = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 5, 0)
    return rows.select(
        "row.doc_id",
        F.coalesce(remainder("row.doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


@query
def op6_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies at a similarity of 0.85."""
    how = neardup.Similarity(words=5, per_hundred=85)
    return neardup.near_groups(table(spark, sf_dir, "documents"), how=how)


@query
def op7_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)
    return packing.with_checksums(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of fold 1 of 3 are held out."""
    rows = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 3, 1)
    return rows.select(
        "row.doc_id",
        F.coalesce(remainder("row.doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in windows of 50 that an earlier document has."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op10_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; those of fold 2 of 4 are held out."""
    rows = language.identified(table(spark, sf_dir, "documents"), 4, 2)
    return rows.select(
        "row.doc_id",
        F.coalesce(remainder("row.doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


@query
def op3_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every 50th vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op9_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, in all layouts, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    hard = spark.range(2).selectExpr(
        "-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text"
    )
    written = staged(chat.formatted(chat.in_all_layouts(rows.unionByName(hard))), "chat")
    return chat.read_back(written).withColumnRenamed("conv", "conv_id")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; a third of them is presented in lower case."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    tampered = merkle.Presented(crc % 3 == 0, {"text": merkle.lower_cased()})
    rows = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), presented=tampered))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged row by row, with the cheapest edits that repair them."""
    rows = table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damaged(rows))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    audits = every.join(found.audits, F.col("id").eqNullSafe(F.col("conv")), "left").drop("conv")
    hashed = repair.digests(found.turns)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return audits.join(hashed, F.col("id").eqNullSafe(F.col("conv")), "left").select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))
