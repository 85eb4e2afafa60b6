"""What a service answers: batches of documents as JSON responses, health, and what this engine can do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators.places import Places
from docfacts.operators.taxa import Taxa


def batch(docs: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(count, results): how many documents an extraction answered, and their rows, as one response for a request's few documents."""
    return extract(docs).agg(F.count(F.lit(1)).alias("count"), F.collect_list(F.struct("*")).alias("results"))


def batch_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("count"))


def health(spark: SparkSession, taxa: Taxa | None = None, places: Places | None = None, vernacular: DataFrame | None = None) -> DataFrame:
    """One row: status, and how many concepts, names, places and common names are loaded (0 where none are)."""
    n = lambda df: F.lit(0).cast("long") if df is None else F.lit(df.count())
    loaded = {"n_concepts": taxa and taxa.concepts, "n_names": taxa and taxa.names, "n_places": places and places.places, "n_vernacular": vernacular}
    return spark.range(1).select(F.lit("ok").alias("status"), *(n(df).alias(k) for k, df in loaded.items()))


def describe(df: DataFrame) -> DataFrame:
    """(name, type) of each column of a result: the response's schema, without running it."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, type string")
