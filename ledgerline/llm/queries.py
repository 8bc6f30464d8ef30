"""The queries of this subpackage: each applies one operator to its whole table and gives digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, language_id, line_dedup, lm_score, mixing, pii, quality_rules, shared_windows, simhash, suffix_dedup, token_output
from ledgerline.llm.common import materialize, table


def _fold(modulus: int):
    """crc32(doc_id as text) mod ``modulus`` is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_repeated_chunks", "n_removed_lines", F.sha2("kept", 256).alias("kept_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), _fold(7))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False, words=shared_windows.WORDS)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fp_hex("fp").alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.by_position(mixing.mix(table(spark, sf_dir, "documents")), "doc_id")
    return out.select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", "__mix.taken", "__mix.first_position")


def tokenizer_path() -> str:
    """The vocabulary file that op6 and the pipeline use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path())[1]


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(pii.extract(table(spark, sf_dir, "documents")), "pii-found")
    return pii.find(found, pii.learn_patterns(found))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits, sets = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    told = sets.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    rows = docs.select("doc_id", decontaminate.text_key(F.col("text")).alias("key"), decontaminate.n_words(F.col("text")).alias("n_words"))
    zero = F.lit(0).cast("long")
    return rows.join(hits.join(told, "set"), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _fold(4))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model, carry=("doc_id", "held_out"), with_spans=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_lm_score, op3_suffix_dedup, op4_simhash, op5_mixing, op6_token_output,
    op7_quality_rules, op8_pii, op9_decontaminate, op10_language_id, pipeline,
)}
