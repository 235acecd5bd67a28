"""A training corpus from raw documents: language, near duplicates, repeated passages, benchmark leaks, windows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontam import find_leaks
from quern.llm.langid import bucket, identify, train
from quern.llm.neardup import near_duplicates
from quern.llm.packing import pack
from quern.llm.scratch import Scratch
from quern.llm.substrings import remove_repeats


def _apart(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that an operator's results are named as renamed, and the names to give back."""
    back = {f"__own_{n}": n for n in names if n in docs.columns}
    return docs.withColumnsRenamed({n: o for o, n in back.items()}), back


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows: not `und`, and with a pooled probability that is no guess."""
    model = train(docs, allowed=bucket("doc_id", 4) != 2)
    own, back = _apart(docs, "lang_pred", "score")
    found = identify(own, model).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.3))
    return found.select(own.columns).withColumnsRenamed(back)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8. Documents without an id stay; of rows with one id the one with the least hash does."""
    found = near_duplicates(docs, percent=80, words=5)
    again = docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty()
    one = docs.join(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti")
    least = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(*docs.columns), "text")).alias("row")
    return (one if again else one.where("doc_id IS NOT NULL").groupBy("doc_id").agg(least).select("row.*").unionByName(one.where("doc_id IS NULL").select(docs.columns))).select(docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words that occur more than once. Documents of which nothing is left go."""
    own, back = _apart(docs, "n_words", "n_removed", "kept")
    done = remove_repeats(own, window=35)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = done.where("n_words = 0 OR n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(own.columns).withColumnsRenamed(back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    own, back = _apart(docs, "leaks")
    found = find_leaks(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(own.columns).withColumnsRenamed(back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


STAGES = [("language", language), ("near_duplicate", near_duplicate), ("substring", substring), ("decontamination", decontamination), ("packing", packing)]

#: A trained network decides in the first stage: SQL cannot express it. Tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each stage's result written and reread."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
