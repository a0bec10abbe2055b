"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    fingerprints,
    langid,
    lexical_search,
    licences,
    lines,
    mixing,
    neighbours,
    packing,
    periodic_runs,
    quality_trees,
    sentence_pieces,
    simhash_blocks,
    spans,
)
from ledgerloom.llm.store import written
from ledgerloom.llm.text import word_count, words


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spans.substring_dedup(table(spark, sf_dir, "documents"), with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    found = mixing.mix(written(docs, "sizes"), sized="words")
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", "kept_sha256")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_blocks.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_blocks.hex_digits().alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = langid.train(docs.where(langid.bucket(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(langid.bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    found = langid.identify(docs, fitted)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    forest = quality_trees.train(docs, labels.where(langid.bucket(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(langid.bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    found = quality_trees.quality(docs, forest)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))
    text = [fingerprints.hex_digits(F.col(c)) for c in ("fp", "edited_fp")]
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        text[0].alias("fingerprint"), text[1].alias("edited_fingerprint"), "near_edited", "near_next",
    )


def with_cycles(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of them (by a checksum of the id) with a cycle of their own words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    g = F.expr("h div 10")
    listed = docs.select("doc_id", "text", h.alias("h"), F.when(chosen, words(F.col("text"))).alias("w"))
    placed = listed.withColumn("a", F.when(F.size("w") > 0, g % F.size("w")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.size("w") - F.col("a")) / (3 + g % 8))).cast("int"))
    left = F.size("w") - F.col("a")
    cycle = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    cycled = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), cycled).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_cycles(table(spark, sf_dir, "documents")))
    # The longest comes first, then the one that starts first.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("rest"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines_ = F.when(F.size("runs") > 0, F.concat(F.array_join(listed, "\n"), F.lit("\n"))).otherwise("")
    found = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(lines_, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        (-F.col("best.rest")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.rest div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces.encode(table(spark, sf_dir, "documents"), PIECES, decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_source_mixing,
        op3_line_dedup,
        op4_licence_scan,
        op5_nearest_neighbours,
        op6_simhash_near_dedup,
        op7_language_id,
        op8_quality_classifier,
        op9_packing,
        op10_document_fingerprints,
        op11_periodic_runs,
        op12_sentence_pieces,
        op13_lexical_search,
    )
}
