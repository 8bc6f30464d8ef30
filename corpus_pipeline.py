"""A training-corpus pipeline: quality rules, near-dedup, decontamination, mixing, token records.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the
columns of ``documents``; the last returns the token records read back from its
files. Mixing may repeat a document, so its rows may share an id from there on.
Every stage takes texts of any length, tables without rows and further columns
under any name but those that begin with two underscores, and keeps these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, mixing, quality_rules, simhash, token_output
from ledgerline.llm.common import materialize, table
from ledgerline.llm.queries import tokenizer_path


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that neither the base rules nor the learned decision list reject.

    Null, empty and blank texts fail the base rules; rows without id can be
    kept; equal rows are judged alike and all stay.
    """
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.apply_rules(docs.select(whole(docs), F.col("text").alias("__text")), rules, "__text", ("__doc",))
    return judged.where("kept").select("__doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies by SimHash (two-word shingles; 3 bits or fewer apart in one of 16 fingerprints).

    That is the one with the smallest id (rows without id last; of several with
    it, one); equal rows are copies. Null, empty and blank texts are one group.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of the benchmark.

    Null and empty texts hold none; equal texts go or stay together; an empty
    benchmark drops nothing.
    """
    hits = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))[0].select(F.col("key").alias("__key"))
    return docs.withColumn("__key", decontaminate.text_key(F.col("text"))).join(hits, "__key", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: whole documents, as many copies as it takes of each.

    Null sources are one source; null and empty texts have no words and are
    never taken; rows without id are taken by their text's place.
    """
    mixed = mixing.mix(docs.select(whole(docs), "doc_id", "text", "source"), carry=["__doc"], cut_last=False)
    return mixing.training_order(mixed).select("__doc.*")


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the documents as token records and return what the files hold.

    Null and empty texts become the end id alone; null ids come first; rows
    that share an id keep all their records.
    """
    return token_output.token_output(docs, tokenizer_path())[1]


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix_sources),
    ("token records", token_records),
]

#: The learned rules, the groups of near copies and the tokenizer have no SQL form; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
