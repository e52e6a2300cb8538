"""From raw documents to packed training sequences: every stage is one of the operators of tallyhouse.llm, over all that the last one kept.

Stages return the columns of documents, except the last, which returns packed pieces. `run` writes each stage's result to the
shared folder and reads it back, so an executor that is lost costs no more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import language, mixing, packing, simhash, suffixes
from tallyhouse.llm.queries import pieces
from tallyhouse.llm.storage import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REPEAT = 256  # bytes of a repeated string that goes: passages of some 50 words and more


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a text or a letter go. A missing label gets the predicted one."""
    found = language.identified(docs.select(COLUMNS), COLUMNS).where(F.col("lang_pred") != language.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, of repeated rows one."""
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_digest"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"))
    keys = ["_digest", "_id", "_none"]
    found = simhash.rooted_duplicates(keyed, keys)
    first = found.groupBy("component_root").agg(F.min(F.struct(F.col("_none"), "_id", "_digest")).alias("kept")).select("kept.*")
    return keyed.join(first, keys, "left_semi").dropDuplicates(keys).select(COLUMNS)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of REPEAT bytes that occur elsewhere too."""
    kept = suffixes.without_repeats(docs, ["doc_id", "lang", "source"], length=REPEAT, as_text=True).withColumnRenamed("kept", "text")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: the words it takes, a row per document and pass."""
    return mixing.mixed_documents(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed(pieces(docs, ["doc_id"]))


STAGES = [
    ("language", known_languages),
    ("near duplicates", near_duplicates),
    ("repeated text", repeated_text),
    ("mixing", source_mix),
    ("packing", packed_sequences),
]

# Hashing networks, differencing and seeded permutations are beyond SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
