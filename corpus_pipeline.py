"""A corpus pipeline: five stages, each on all rows that its predecessor kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import common, decontam, langid, mixing, ngram_join, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go: no letter at all, or a calibrated score below its threshold."""
    model = langid.train(docs)
    return langid.predict(docs, model).where(~langid.rejected(model)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.representative(docs, shingle_words=5, percent=80).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier go; characters cut in half go too, and documents left empty.
    A text that was not changed stays as it is, null included."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS, F.col("text").isNull().alias("no_text")), along=("lang", "source", "n_chars", "no_text"))
    changed = F.col("n_removed") > 0
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\\ufffd", "")
    text = F.when(changed, left).when(~F.col("along.no_text"), F.col("kept").cast("string"))
    out = cut.withColumn("text", text).where(~changed | (F.trim("text") != ""))
    return out.select("doc_id", "text", "along.lang", "along.source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("along.n_chars")).alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers or names, go."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies."""
    mixed = mixing.pareto_mix(docs).where("taken > 0")
    return mixed.select(*COLUMNS, "size", "target", "taken", F.expr("taken div size").alias("copies"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture)]
ORACLE_SQL = None  # a trained model and byte positions are not expressible in SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's scratch tables and its predecessor's result are deleted when its own is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.tidy(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return docs
