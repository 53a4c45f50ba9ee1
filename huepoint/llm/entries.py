"""The registered queries: thin digests of what the operators return, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huepoint.llm import importance, jaccard, lineblocks, linededup, mixing, oracles, partcodes, personal, pitmanyor, recompression, syncmers, tokenids, toxicity, winnowing
from huepoint.llm._store import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=10)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.scored(table(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can follow, by the steps of op2 that make them."""
    found = pitmanyor.base_scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.round("base_score", 6) + 0.0).alias("base_score"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.write_and_read(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineblocks.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompression.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprints(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", sha, syncmers.written("all_anchors").alias("fingerprint"), syncmers.written("all_edited_anchors").alias("edited_fingerprint"), F.col("match_edited").alias("near_edited"), F.col("match_next").alias("near_next"), "next_id")


def document_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts that op9 compares with."""
    found = syncmers.edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "next_id", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), k=5, percent=75)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal.counted(docs, personal.fit(personal.labelled(docs)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partcodes.coded(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_token_ids": op4_token_ids,
    "op5_source_mixing": op5_source_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_personal_data": op11_personal_data,
    "op12_vector_codes": op12_vector_codes,
    "op13_importance_resampling": op13_importance_resampling,
    "document_edits": document_edits,
    "lm_base_scores": lm_base_scores,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": linededup.SQL,
    "op3_benchmark_decontamination": oracles.DECONTAMINATION,
    "op5_source_mixing": mixing.SQL,
    "op8_substring_dedup": oracles.SUBSTRINGS,
    "op10_ngram_jaccard": oracles.JACCARD,
    "op12_vector_codes": partcodes.SQL,
    "op13_importance_resampling": importance.SQL,
    "document_edits": syncmers.SQL,
    "lm_base_scores": oracles.BASE_SCORES,
}
