"""Place gazetteer: building with administrative context, and the resolving cascade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions import fuzzy as sim
from docfacts.functions.text import KEEP_CLASSES, class_priority, normalize_place, place_type, prefix3, strip_head
from docfacts.operators.taxa import fuzzy_candidates

MIN_SIMILARITY, MIN_LENGTH, MAX_CANDIDATES = 0.90, 6, 400
#: Single words that are never a place.
COMMON = "norte sur este oeste noreste noroeste sureste suroeste nordeste sudeste sudoeste centro occidental oriental montes laguna pantano embalse arroyo sierra".split()


@dataclass(frozen=True)
class Places:
    """places(geonameid, name, fclass, fcode, province, region, population); names(name_norm, geonameid, is_alt, prefix3, ord)."""

    places: DataFrame
    names: DataFrame


def admin_names(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admin1, region) and (admin1, admin2, province); of rows with one code the last wins."""
    one = raw.where("fcode = 'ADM1' and admin1 <> ''").groupBy("admin1").agg(F.max_by("name", "ord").alias("region"))
    two = raw.where("fcode = 'ADM2' and admin1 <> '' and admin2 <> ''").groupBy("admin1", "admin2").agg(F.max_by("name", "ord").alias("province"))
    return one, two


def with_admin(raw: DataFrame) -> DataFrame:
    one, two = admin_names(raw)
    return raw.join(one, "admin1", "left").join(two, ["admin1", "admin2"], "left")


def build_places(raw: DataFrame) -> Places:
    """From rows (geonameid, name, asciiname, alternates, fclass, fcode, admin1, admin2, population, ord): classes A P H T L V only."""
    kept = raw.where(F.col("fclass").isin(*KEEP_CLASSES)).select("geonameid", "name", "asciiname", "alternates", "fclass", "fcode", "admin1", "admin2", F.coalesce(F.col("population").try_cast("long"), F.lit(0)).alias("population"), "ord")
    places = with_admin(kept).select("geonameid", "name", "fclass", "fcode", F.nullif("province", F.lit("")).alias("province"), F.nullif("region", F.lit("")).alias("region"), "population")
    term = lambda c, alt: F.struct(normalize_place(c).alias("name_norm"), F.lit(alt).alias("is_alt"))
    alternates = F.transform(F.filter(F.split(F.coalesce("alternates", F.lit("")), ","), lambda x: x != ""), lambda x: term(x, 1))
    names = kept.select("geonameid", "ord", F.explode(F.array_distinct(F.concat(F.array(term(F.col("name"), 0), term(F.coalesce("asciiname", F.lit("")), 0)), alternates))).alias("t"))
    names = names.select("t.name_norm", "geonameid", "t.is_alt", "ord").where(F.length("name_norm") >= 2).withColumn("prefix3", prefix3(F.col("name_norm")))
    return Places(places, names.select("name_norm", "geonameid", "is_alt", "prefix3", "ord"))


def rank_key(hint: Column) -> Column:
    """What the best of several places has most of: hinted class, ADM2 for administrative hints, class priority, people; then the smallest id."""
    hinted = F.coalesce(F.contains(hint, F.col("fclass")), F.lit(False)).cast("int")
    adm2 = F.coalesce(F.contains(hint, F.lit("A")) & (F.col("fcode") == "ADM2"), F.lit(False)).cast("int")
    return F.struct(-hinted, -adm2, -class_priority(F.col("fclass")), -F.coalesce("population", F.lit(0)), F.col("geonameid"))


def _hit(match_type: str, score: Column) -> Column:
    return F.struct(F.concat(F.lit("geonames:"), F.col("p.geonameid").cast("string")).alias("geonameid"), F.col("p.name").alias("canonical"), place_type(F.col("p.fclass"), F.col("p.fcode")).alias("type"), F.col("p.fclass").alias("fclass"), F.col("p.fcode").alias("fcode"), F.col("p.province").alias("province"), F.col("p.region").alias("region"), F.lit(match_type).alias("match_type"), score.cast("double").alias("score"))


def _best(found: DataFrame, extra: list[str]) -> DataFrame:
    return found.groupBy("key", *extra).agg(F.min_by(F.struct("geonameid", "name", "fclass", "fcode", "province", "region"), rank_key(F.col("hint"))).alias("p"))


def lookup(keys: DataFrame, gaz: Places, match_type: str, restrict: bool) -> DataFrame:
    """(key, hit) for rows (key, name_norm, hint): the best place of that name; with restrict, of the hinted classes only."""
    ids = gaz.names.select("name_norm", "geonameid").distinct()
    found = keys.join(ids, "name_norm").join(gaz.places, "geonameid")
    if restrict:
        found = found.where(F.contains(F.col("hint"), F.col("fclass")))
    return _best(found, []).select("key", _hit(match_type, F.lit(1.0)).alias("hit"))


def fuzzy(keys: DataFrame, gaz: Places, how: str = "indel", most: int | None = MAX_CANDIDATES) -> DataFrame:
    """(key, hit): the most similar name of the block; its places, the hinted ones if there are any."""
    c = fuzzy_candidates(keys.select("name_norm").distinct(), gaz.names.select("name_norm", "geonameid", "prefix3", "ord"), MIN_LENGTH, MIN_SIMILARITY, most)
    c = c.withColumn("sim", sim.similarity(F.col("name_norm"), F.col("cand"), how)).where(F.col("sim") >= MIN_SIMILARITY)
    best = c.groupBy("name_norm").agg(F.min_by(F.struct("cand", "sim"), F.struct(-F.col("sim"), F.col("ord"))).alias("x")).select("name_norm", "x.cand", "x.sim")
    found = keys.join(best, "name_norm").join(gaz.names.select(F.col("name_norm").alias("cand"), "geonameid").distinct(), "cand").join(gaz.places, "geonameid")
    # rank_key puts hinted classes first, so a hint that no place has leaves all of them
    return _best(found, ["sim"]).select("key", _hit("fuzzy", F.round("sim", 3)).alias("hit"))


def resolve_keys(keys: DataFrame, gaz: Places, with_fuzzy: bool = False, compat: bool = True, **kw) -> DataFrame:
    """(key, hit) for distinct place keys: the whole name, then the core without its generic in the classes that this implies, then, on request, fuzzy."""
    q = keys.select("key").where((F.col("key") != "") & ~(~F.contains("key", F.lit(" ")) & F.col("key").isin(*COMMON))).distinct()
    q = q.select("key", strip_head(F.col("key"), compat).alias("h")).select("key", "h.core", "h.hint")
    out = lookup(q.select("key", F.col("key").alias("name_norm"), F.lit(None).cast("string").alias("hint")), gaz, "exact", False)
    left = q.join(out, "key", "left_anti")
    core = lookup(left.where((F.col("core") != F.col("key")) & ~(~F.contains("core", F.lit(" ")) & F.col("core").isin(*COMMON))).select("key", F.col("core").alias("name_norm"), "hint"), gaz, "core", True)
    out = out.unionByName(core)
    if with_fuzzy:
        out = out.unionByName(fuzzy(left.join(core, "key", "left_anti").select("key", F.col("core").alias("name_norm"), "hint"), gaz, **kw))
    return out


def resolve_places(df: DataFrame, col: str, gaz: Places, with_fuzzy: bool = False, compat: bool = True, **kw) -> DataFrame:
    """All rows and columns of df, and hit (null where unresolved)."""
    keyed = df.drop("hit").withColumn("key", normalize_place(F.col(col)))
    return keyed.join(resolve_keys(keyed.where("key is not null"), gaz, with_fuzzy, compat, **kw), "key", "left").drop("key")
