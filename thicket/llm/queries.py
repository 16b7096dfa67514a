"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import dealt, reassembled
from .decontaminate import contamination, digest
from .fingerprints import edited_rows
from .lattice import near_vectors
from .licenses import license_scan
from .mixing import copies
from .near_dedup import Banding, near_duplicates
from .repeats import without_repeats
from .shared import Scratch, table
from .sharding import shuffled_shards
from .spellings import spoilt, variants, word_counts
from .token_counts import token_counts
from .toxicity import THRESHOLD, remainder, toxicity
from .warc import round_trip


def op1_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"), ["doc_id"]).select("row.doc_id", "found.*")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), Banding(shingle_words=2))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, table(spark, sf_dir, "documents"), ["doc_id"]).select("row.doc_id", *(f"found.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    score = F.col("found.score")
    return scored.select("row.doc_id", (remainder(F.col("row.doc_id")) == 1).alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages"))


def op7_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op8_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The shards are written with all columns, and digested as they are read again.
    placed = Scratch(spark, "sharding").cut(shuffled_shards(spark, table(spark, sf_dir, "documents"), shards=8), "placed")
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("row.source").alias("source"))


def op10_parsed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return edited_rows(spark, docs, docs.count())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, word_counts(table(spark, sf_dir, "documents"), spoilt))


def op13_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = reassembled(spark, dealt(turns), turns.count())
    digest = F.when(F.col("event") == "close", F.col("digest")).otherwise(F.sha2(F.concat("role", F.lit("|"), "text"), 256))
    return out.select("event", "conv_id", "turn", F.col("batch").cast("long").alias("batch"), digest.alias("sha256"), "n_missing", "n_breaks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_edit_aware_token_counts, op2_minhash_near_dedup, op3_license_scan, op4_benchmark_decontamination, op5_compression_toxicity, op6_warc_round_trip,
        op7_lattice_near_dedup, op8_hypergeometric_sharding, op9_systematic_mixing, op10_parsed_repeats,
        op11_document_fingerprints, op12_spelling_variants, op13_turn_reassembly,
    )
}
