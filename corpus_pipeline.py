"""The corpus pipeline: from `documents` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs; all but the last return the columns of
documents. Labels are read from sf_dir where a stage is trained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm import jaccard, packing, quality_classifier, suffix_dedup, toxicity
from docfacts.llm.common import fresh, table, written
from docfacts.llm.queries import word_file

TOXIC = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose posterior quality is at least one half; null texts are judged as empty.

    Learns from the labelled rows of the original table."""
    out = tuple(fresh(docs.columns, c) for c in quality_classifier.OUT)
    judged = quality_classifier.judge(docs, table(spark, sf_dir, "labels"), out=out, train=table(spark, sf_dir, "documents"))
    return judged.where(F.col(out[3])).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose toxicity score is under TOXIC; learns from the labelled rows of the original table."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "toxicity")
    return toxicity.add_score(docs, model, score_col=score).where(F.col(score) < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest id of each component of near duplicates."""
    return jaccard.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 50 bytes that an earlier document has out of each text; every row stays."""
    out = suffix_dedup.remove_repeats(docs, as_text=True)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, place and sequence."""
    out = packing.pack_documents(docs, word_file())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("suffix_dedup", repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: Trained stages can't be stated in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
