"""The same extractions over a stream of document files: stateless, so append only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.sources.readers import DOCUMENT


def document_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    d = spark.readStream.schema(DOCUMENT).option("multiLine", True).option("maxFilesPerTrigger", files).json(path)
    return d.withColumn("italicized_terms", F.coalesce("italicized_terms", F.array().cast("array<string>")))


def run_stream(docs: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, id_col: str = "_id"):
    """Extract each micro-batch and append what is not in `out` yet; a batch that is run again adds nothing."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        todo = df.dropDuplicates([id_col])
        try:
            done = spark.read.parquet(out).select(id_col)
        except Exception as e:  # noqa: BLE001 - nothing is written before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            todo = todo.join(done, id_col, "left_anti")
        extract(todo).write.mode("append").parquet(out)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
