"""Readers. Every one has an explicit schema; none lists or opens files in the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = """
_id string, reference string, title string, abstract string, language string, source string, source_abbrev string, document_type string, section string,
department string, boe_issue string, page_start string, page_end string, disposition_date string, publication_date string, pubyear int, url string, pdf_url string,
xml_url string, bibliographic_citation string, record_category string, source_format string, references_prior array<string>, italicized_terms array<string>,
text string, n_chars int, ingested_at string
"""
CONCEPT = "id string, preferred_term struct<term:string>, rank struct<name:string>, parents array<string>, synonyms array<struct<term:string>>"
CONCEPTS = "concepts array<struct<id:string,preferred_term:struct<term:string>,rank:struct<name:string>,parents:array<string>,synonyms:array<struct<term:string>>>>"
LABELS = "_id string, is_taxa int, is_location int, is_primary_data int, is_secondary_data int"
EXAMPLE_STRUCT = "struct<id:string,question:string,context:string,answers:struct<text:array<string>,answer_start:array<int>>,is_impossible:boolean>"
PLACE_COLUMNS = 19


def documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one to a file; unknown keys are left out; null italics are empty."""
    d = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return d.withColumn("italicized_terms", F.coalesce("italicized_terms", F.array().cast("array<string>")))


def adhoc(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Documents given as dictionaries: `document` wins over loose text and italics; `_id` over `id`."""
    flat = []
    for r in rows:
        d = r.get("document") or r
        flat.append((d.get("_id") or d.get("id"), d.get("title"), d.get("text") or "", list(d.get("italicized_terms") or [])))
    return spark.createDataFrame(flat, "_id string, title string, text string, italicized_terms array<string>")


def concepts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, term, rank, parents, synonyms, ord) of a taxonomy: one nested file or, for large ones, a concept a line."""
    if lines:
        c = spark.read.schema(CONCEPT).json(path).withColumn("ord", F.monotonically_increasing_id())
    else:
        c = spark.read.schema(CONCEPTS).option("multiLine", True).json(path).select(F.posexplode("concepts").alias("ord", "c")).select("c.*", F.col("ord").cast("long").alias("ord"))
    terms = F.coalesce(F.filter(F.transform("synonyms", lambda s: s["term"]), lambda t: t.isNotNull()), F.array().cast("array<string>"))
    return c.select("id", F.col("preferred_term.term").alias("term"), F.col("rank.name").alias("rank"), "parents", terms.alias("synonyms"), "ord")


def places(spark: SparkSession, path: str) -> DataFrame:
    """(geonameid, name, ..., ord) of a tab-separated dump without quotes; lines of fewer than 15 fields are left out."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("ord")).where("size(f) >= 15")
    at = {"geonameid": 0, "name": 1, "asciiname": 2, "alternates": 3, "fclass": 6, "fcode": 7, "admin1": 10, "admin2": 11, "population": 14}
    return t.select(*(F.get("f", F.lit(i)).alias(c) for c, i in at.items()), "ord")


def vernacular_raw(spark: SparkSession, path: str) -> DataFrame:
    """(sci, cn, ord) of the raw pairs; the header and lines without a tab are left out."""
    t = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("sci string, cn string").csv(path)
    return t.where("cn is not null").withColumn("ord", F.monotonically_increasing_id())


def vernacular(spark: SparkSession, path: str) -> DataFrame:
    """The built gazetteer; of lines with one key the last counts."""
    t = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("common_norm string, common_display string, scientific string").csv(path)
    t = t.where("scientific is not null").withColumn("ord", F.monotonically_increasing_id())
    return t.groupBy("common_norm").agg(F.max_by(F.struct("common_display", "scientific"), "ord").alias("x")).select("common_norm", "x.common_display", F.split("x.scientific", r"\|").alias("scientific"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).schema(LABELS).csv(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """The first column of the lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit("\t"), F.lit(1))).alias("question")).where("question <> '' and not startswith(question, '#')")


def teacher_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, examples) of checkpoints; lines that cannot be read are left out."""
    return spark.read.schema(f"doc string, examples array<{EXAMPLE_STRUCT}>").option("mode", "DROPMALFORMED").json(path)


def evidence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, text string, features map<string,array<struct<start:int,end:int>>>").option("multiLine", True).json(path)


def squad(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Examples of a data set: one {version, data} document to a file or, as write_squad splits large ones, one to a line."""
    d = spark.read.schema(f"version string, data array<{EXAMPLE_STRUCT}>").option("multiLine", not lines).json(path)
    return d.select(F.explode("data").alias("d")).select("d.*")


def threshold(spark: SparkSession, report: str | None = None, env: str = "DOCFACTS_QA_THRESHOLD", default: float = 0.0) -> float:
    """The environment's value, else best_tau of a report, else the default."""
    if os.environ.get(env):
        return float(os.environ[env])
    if report:
        row = spark.read.schema("best_tau double").option("multiLine", True).json(report).where("best_tau is not null").first()
        if row and row[0] is not None:
            return float(row[0])
    return default
