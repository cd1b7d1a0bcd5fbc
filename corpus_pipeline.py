"""Corpus pipeline: language ID, quality, near-duplicates, packing; every stage's rows go through shared Parquet.

Each stage takes any documents table with doc_id and text (and lang for the first stage's training): null texts and texts
without a letter have no language and go in the first stage; empty tables give empty ones; repeated rows are judged alike
and repeat, until the near-duplicate stage keeps rows by id; extra columns are carried by all stages but the last, which
returns pieces and replaces clashing names; texts of any length are judged whole. Ties go by the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.plan import fresh_folder
from sessionloom.llm import language_id, near_dedup, packing, quality
from sessionloom.llm.common import table

#: A document is rejected where no language is found, or where even the best one needs more bits a byte than this.
MOST_BITS = 7.5
#: Quality below this rejects a document.
LEAST_QUALITY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a known language; the model learns from this stage's input."""
    model = language_id.fit(language_id.training_sample(docs.where(~language_id.held_out(F.col("doc_id")))))
    found = language_id.verdict_column(spark, model)
    return docs.where((found["lang_pred"] != "und") & (found["bits_per_byte"] <= MOST_BITS))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score reaches LEAST_QUALITY; learns from labels of the documents that came in."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit_labels(docs, labels)
    rated = quality.with_statistics(docs, keep_text=True)
    return rated.where(model.score_column() >= LEAST_QUALITY).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of every group (five-word shingles, similarity 0.8)."""
    kept = near_dedup.near_duplicates(docs.select("doc_id", "text"), size=5).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text")))


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: The stages' models and tokenizer are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. The last one has read its input when it returns (its pieces are checkpointed), so the folder goes then."""
    folder = fresh_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return packed
