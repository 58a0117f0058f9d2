"""From raw documents to packed sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
as Parquet below the shared folder and reads it back as the next stage's documents. All
but the last return the columns that they got, whatever further columns there are and however they are called.
An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylag.llm import language, line_templates, packing, pii, shingle_copies, simhash
from skylag.llm.names import unused
from skylag.llm.queries import vocabulary_path
from skylag.session import materialized

# Four languages score 0.25 each when nothing is known; clean texts lie far above this.
LEAST_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or in no language that the model knows."""
    language_name, score = unused(docs, "_language", "_score")
    told = language.predict(docs, language.fit(docs), language=language_name, score=score)
    return told.filter((F.col(language_name) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates from all documents but the first; documents stay."""
    return line_templates.drop_recurring(docs, count=unused(docs, "_dropped_lines")[0]).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies, once; rows without a doc_id stay.

    Near copies are linked by the operator of op8 (SimHash fingerprints of at most 4 differing bits, which count repeats) or have five-word
    shingles with a Jaccard similarity of 0.8 or more. Unlike texts under one doc_id are documents of their own.
    Of rows that share doc_id and text that with the smallest hash of its other columns stays.
    """
    key, version, hashed, row = unused(docs, "_key", "_version", "_hashed", "_row")
    prints = simhash.near_duplicates(docs.filter("doc_id IS NOT NULL").select(F.xxhash64("text").alias("version"), "text"), "version")
    alike = prints.select("version", F.col("component_id").alias("group"))
    first = shingle_copies.first_of_groups(docs, alike=alike).select(F.col("key").alias(key), F.col("version").alias(version))
    named = docs.filter("doc_id IS NOT NULL").withColumn(hashed, F.xxhash64("text"))
    known = named.join(first, (F.col("doc_id") == F.col(key)) & (F.col(hashed) == F.col(version)), "left_semi")
    others = [F.col(f.name) for f in docs.schema if not f.dataType.simpleString().count("map<")]
    one = known.groupBy("doc_id", hashed).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*others)).alias(row))
    return one.select(F.col(f"{row}.*")).select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their kind in angle brackets."""
    base, spans = unused(docs, "_base", "_spans")
    told = pii.label(docs, pii.fit(docs), base=base, spans=spans)
    clean = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col(spans)))
    return told.withColumn("text", clean).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence, with its ids."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

# Training a model and tokenizing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
