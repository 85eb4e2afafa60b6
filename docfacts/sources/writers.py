"""Sinks: gazetteers, checkpoints, data sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.operators.places import Places
from docfacts.operators.taxa import Taxa


def write_taxa(gaz: Taxa, path: str) -> None:
    """Two Parquet tables; names lie by their blocking key, so that lookups of a block read few files."""
    gaz.concepts.write.mode("overwrite").parquet(f"{path}/concepts")
    gaz.names.repartitionByRange("prefix3", "name_norm").sortWithinPartitions("prefix3", "name_norm").write.mode("overwrite").parquet(f"{path}/names")


def read_taxa(spark, path: str) -> Taxa:
    return Taxa(spark.read.parquet(f"{path}/concepts"), spark.read.parquet(f"{path}/names"))


def write_places(gaz: Places, path: str) -> None:
    gaz.places.write.mode("overwrite").parquet(f"{path}/places")
    gaz.names.repartitionByRange("prefix3", "name_norm").sortWithinPartitions("prefix3", "name_norm").write.mode("overwrite").parquet(f"{path}/names")


def read_places(spark, path: str) -> Places:
    return Places(spark.read.parquet(f"{path}/places"), spark.read.parquet(f"{path}/names"))


def write_vernacular(gaz: DataFrame, path: str) -> None:
    """Tab-separated, sorted by key, scientific names sorted and joined by |."""
    out = gaz.select("common_norm", "common_display", F.array_join(F.array_sort("scientific"), "|").alias("scientific"))
    out.orderBy("common_norm").write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def append_teacher(rows: DataFrame, path: str) -> None:
    """Add (doc, ...) lines to a checkpoint; what is there stays."""
    rows.write.mode("append").json(path)


def write_squad(examples: DataFrame, path: str, version: str = "1.0") -> None:
    """The data set as {version, data: [one example]} documents, one to a line and split over files, for readers.squad with lines=True."""
    one = examples.select(F.lit(version).alias("version"), F.array(F.struct("id", "question", "context", "answers", "is_impossible")).alias("data"))
    one.write.mode("overwrite").json(path)


def write_report(overall: DataFrame, per_tag: DataFrame, sweep: DataFrame, path: str, best: DataFrame | None = None, metadata: dict[str, str] | None = None) -> None:
    """The tables of an evaluation, and a summary of one line: best_tau, best_f1 and metadata; readers.threshold reads it.

    best: the row of qa.best_threshold; by default that of the sweep."""
    from docfacts.operators.qa import best_threshold

    for name, df in (("overall", overall), ("per_tag", per_tag), ("sweep", sweep)):
        df.write.mode("overwrite").json(f"{path}/{name}")
    pairs = [F.lit(x) for kv in (metadata or {}).items() for x in kv]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    (best or best_threshold(sweep)).select("best_tau", "best_f1", meta.alias("metadata")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def response(df: DataFrame) -> DataFrame:
    """Each row as the JSON text of a response."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
