"""Species of documents: candidates from italics, text and common names, resolved once and counted by taxon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.functions.text import BINOMIAL, find_spans, normalize_taxon, spans
from docfacts.sources.shared import written
from docfacts.operators.taxa import Taxa, accepted, resolve_names
from docfacts.operators.vernacular import scan_vernacular

#: Ranks that count as a finding.
RANKS = ("species", "subspecies", "variety", "varietas", "form", "forma", "genus", "species group", "species subgroup", "infraspecificname")
MAX_SPANS = 25


def candidates(docs: DataFrame, scan_text: bool = True, id_col: str = "_id") -> DataFrame:
    """(id, raw, source, fuzzy, ord, spans): italic terms and, on request or where there are none, binomials of the text.

    A string counts once by document, whatever its case: italics before text, then by
    place. Italics have all their places (at most 25); text its first."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("italicized_terms", F.array().cast("array<string>")).alias("it"))
    italics = d.select("id", "text", F.posexplode("it").alias("ord", "raw")).withColumn("raw", F.trim(F.coalesce("raw", F.lit("")))).where("raw <> ''")
    italics = italics.select("id", "raw", F.lit("italics").alias("source"), F.lit(0).alias("rank"), "ord", find_spans(F.col("text"), F.col("raw"), MAX_SPANS).alias("spans"))
    scanned = d.where(F.lit(scan_text) | (F.size("it") == 0)).select("id", F.posexplode(spans(F.col("text"), BINOMIAL)).alias("ord", "m"))
    scanned = scanned.select("id", F.col("m.text").alias("raw"), F.lit("text").alias("source"), F.lit(1).alias("rank"), "ord", F.array("m").alias("spans"))
    both = italics.unionByName(scanned)
    first = both.groupBy("id", F.lower("raw").alias("_low")).agg(F.min_by(F.struct("raw", "source", "rank", "ord", "spans"), F.struct("rank", "ord")).alias("x"))
    return first.select("id", "x.raw", "x.source", (F.col("x.source") == "italics").alias("fuzzy"), F.struct("x.rank", "x.ord").alias("ord"), "x.spans")


def mentions(docs: DataFrame, gaz: Taxa, vernacular: DataFrame | None = None, scan_text: bool = True, ranks: tuple[str, ...] = RANKS, id_col: str = "_id", **kw) -> DataFrame:
    """(id, hit, text, start, end, source, ord): every mention of an accepted taxon."""
    c = written(candidates(docs, scan_text, id_col).withColumn("name_norm", normalize_taxon(F.col("raw"))), "candidates")
    strict = resolve_names(c, gaz, False)
    loose = resolve_names(c.where("fuzzy").join(strict, "name_norm", "left_anti"), gaz, True, **kw)
    hit = c.join(strict.withColumn("f", F.lit(False)), "name_norm", "left").join(loose.select(F.col("name_norm").alias("_n"), F.col("hit").alias("_h")), (F.col("name_norm") == F.col("_n")) & F.col("fuzzy"), "left")
    hit = hit.select("id", "raw", "source", "ord", "spans", F.coalesce("hit", "_h").alias("hit")).where("hit is not null")
    place = F.when(F.size("spans") == 0, F.array(F.lit(None).cast("struct<text:string,start:int,end:int>"))).otherwise(F.col("spans"))
    out = hit.select("id", "hit", F.col("raw").alias("text"), "source", F.col("ord.rank").alias("o1"), F.col("ord.ord").alias("o2"), F.explode(place).alias("s")).select("id", "hit", "text", "s.start", "s.end", "source", "o1", "o2")
    if vernacular is not None:
        v = scan_vernacular(docs, vernacular, id_col).select(F.col(id_col).alias("id"), "common", "scientific", "start", "end")
        alternatives = v.select("scientific").distinct().select("scientific", F.posexplode("scientific").alias("pos", "sci")).withColumn("name_norm", normalize_taxon(F.col("sci")))
        known = alternatives.join(resolve_names(alternatives, gaz, False), "name_norm").groupBy("scientific").agg(F.min_by("hit", "pos").alias("hit"))
        out = out.unionByName(v.join(known, "scientific").select("id", "hit", F.col("common").alias("text"), "start", "end", F.lit("vernacular").alias("source"), F.lit(2).alias("o1"), F.col("start").alias("o2")))
    return written(out.where(accepted(F.col("hit.rank"), ranks)), "mentions")


def findings(found: DataFrame) -> DataFrame:
    """One row per document and taxon: the best hit, count, mentions by place (unplaced last) and sources."""
    m = found.withColumn("ott_id", F.col("hit.ott_id"))
    once = m.groupBy("id", "ott_id", "text", "start").agg(F.min("end").alias("end"), F.min(F.struct("o1", "o2")).alias("ord"))
    by = once.groupBy("id", "ott_id").agg(F.count(F.lit(1)).cast("int").alias("count"), F.array_sort(F.collect_list(F.struct(F.col("start").isNull().alias("unplaced"), F.coalesce("start", F.lit(0)).alias("at"), "ord", "text", "start", "end"))).alias("m"))
    top = m.groupBy("id", "ott_id").agg(F.min_by("hit", F.struct(-F.col("hit.score"), "o1", "o2")).alias("hit"), F.array_sort(F.collect_set("source")).alias("sources"))
    return by.join(top, ["id", "ott_id"]).select("id", "hit.canonical", "ott_id", "hit.rank", "hit.kingdom", "hit.match_type", "hit.score", "count", F.transform("m", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("mentions"), "sources")


def extract_species(docs: DataFrame, gaz: Taxa, vernacular: DataFrame | None = None, scan_text: bool = True, ranks: tuple[str, ...] = RANKS, id_col: str = "_id", **kw) -> DataFrame:
    """(id, n_species, species[]) for every document, most mentioned first, then by name."""
    f = findings(mentions(docs, gaz, vernacular, scan_text, ranks, id_col, **kw))
    item = F.struct(-F.col("count"), "canonical", "ott_id", F.struct("canonical", "ott_id", "rank", "kingdom", "match_type", "score", "count", "mentions", "sources").alias("f"))
    nested = f.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["f"]).alias("species"))
    return docs.select(F.col(id_col).alias("id")).join(nested, "id", "left").select(F.col("id").alias(id_col), F.coalesce(F.size("species"), F.lit(0)).alias("n_species"), "species")


def match_types(f: DataFrame) -> DataFrame:
    return f.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))


