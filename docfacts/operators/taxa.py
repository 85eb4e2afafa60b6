"""Taxon gazetteer: building, ancestors, and the resolving cascade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docfacts.functions import fuzzy as sim
from docfacts.functions.text import normalize_taxon, prefix3
from docfacts.sources.shared import written

KINGDOM_RANKS = ("kingdom", "domain", "superkingdom")
MIN_SIMILARITY, MIN_LENGTH, MAX_CANDIDATES = 0.90, 8, 400
ABBREVIATED = r"^([a-z])\.?\s+([a-z][a-z-]+)$"
HIT = "struct<ott_id:string,canonical:string,rank:string,kingdom:string,match_type:string,score:double>"


@dataclass(frozen=True)
class Taxa:
    """concepts(ott_id, pref, rank, parent, kingdom); names(name_norm, ott_id, is_syn, prefix3, ord)."""

    concepts: DataFrame
    names: DataFrame


def kingdoms(concepts: DataFrame, levels: int = 6) -> DataFrame:
    """(ott_id, kingdom): the nearest ancestor-or-self of a kingdom rank, by pointer doubling over 2**levels steps.

    Each level is a written table of three short columns, as the next one reads it twice."""
    is_k = F.lower(F.coalesce("rank", F.lit(""))).isin(*KINGDOM_RANKS)
    state = concepts.select("ott_id", F.when(is_k, F.col("pref")).alias("kingdom"), F.when(is_k, F.lit(None)).otherwise(F.nullif("parent", F.lit(""))).alias("jump"))
    for _ in range(levels):
        up = state.select(F.col("ott_id").alias("_at"), F.col("kingdom").alias("_k"), F.col("jump").alias("_j"))
        state = written(state.join(up, state["jump"] == up["_at"], "left").select("ott_id", F.coalesce("kingdom", "_k").alias("kingdom"), F.when(F.col("kingdom").isNull(), F.col("_j")).alias("jump")), "ancestors")
    return state.select("ott_id", "kingdom")


def build_taxa(raw: DataFrame, with_fuzzy: bool = True, compat: bool = True) -> Taxa:
    """From concepts (id, term, rank, parents, synonyms, ord): a term without an id or name is left out; the first parent counts."""
    c = raw.where("id is not null and coalesce(term, '') <> ''").select(F.col("id").cast("string").alias("ott_id"), F.col("term").alias("pref"), F.coalesce("rank", F.lit("")).alias("rank"), F.get("parents", F.lit(0)).cast("string").alias("parent"), "synonyms", "ord")
    own = c.select("ott_id", F.col("pref").alias("term"), F.lit(0).alias("is_syn"), F.struct("ord", F.lit(-1).alias("pos")).alias("ord"))
    other = c.select("ott_id", "ord", F.posexplode("synonyms").alias("pos", "term")).select("ott_id", "term", F.lit(1).alias("is_syn"), F.struct("ord", F.col("pos").cast("int").alias("pos")).alias("ord"))
    names = own.unionByName(other).withColumn("name_norm", normalize_taxon(F.col("term"), compat)).where("name_norm <> ''")
    names = names.select("name_norm", "ott_id", "is_syn", (prefix3(F.col("name_norm")) if with_fuzzy else F.lit(None).cast("string")).alias("prefix3"), "ord")
    base = c.select("ott_id", "pref", "rank", "parent", "ord")
    base = base.groupBy("ott_id").agg(F.min_by(F.struct("pref", "rank", "parent"), "ord").alias("x")).select("ott_id", "x.pref", "x.rank", "x.parent")
    base = written(base, "concepts")
    # every step of the cascade reads both tables
    return Taxa(written(base.join(kingdoms(base), "ott_id"), "taxa"), written(names, "names"))


def _hit(match_type: str | Column, score: Column) -> Column:
    m = F.lit(match_type) if isinstance(match_type, str) else match_type
    return F.struct(F.concat(F.lit("ott:"), F.col("ott_id")).alias("ott_id"), F.col("pref").alias("canonical"), F.col("rank"), F.col("kingdom"), m.alias("match_type"), score.cast("double").alias("score"))


def exact(names: DataFrame, gaz: Taxa) -> DataFrame:
    """(name_norm, hit): a preferred name before a synonym, then the first inserted; names without a concept fall through."""
    first = gaz.names.groupBy("name_norm").agg(F.min_by(F.struct("ott_id", "is_syn"), F.struct("is_syn", "ord")).alias("x")).select("name_norm", "x.ott_id", "x.is_syn")
    return names.join(first, "name_norm").join(gaz.concepts, "ott_id").select("name_norm", _hit(F.when(F.col("is_syn") == 1, "synonym").otherwise("exact"), F.lit(1.0)).alias("hit"))


def abbreviated(names: DataFrame, gaz: Taxa) -> DataFrame:
    """(name_norm, hit): initial and epithet, if exactly one concept fits; the LIKE of both as an equi-join."""
    keyed = gaz.names.where("instr(name_norm, ' ') > 0").select(F.substring("name_norm", 1, 1).alias("initial"), F.element_at(F.split("name_norm", " "), -1).alias("epithet"), "ott_id")
    one = keyed.groupBy("initial", "epithet").agg(F.min("ott_id").alias("ott_id"), F.max("ott_id").alias("_o")).where("ott_id = _o").drop("_o")
    q = names.where(F.col("name_norm").rlike(ABBREVIATED)).select("name_norm", F.regexp_extract("name_norm", ABBREVIATED, 1).alias("initial"), F.regexp_extract("name_norm", ABBREVIATED, 2).alias("epithet"))
    return q.join(one, ["initial", "epithet"]).join(gaz.concepts, "ott_id").select("name_norm", _hit("abbrev", F.lit(1.0)).alias("hit"))


def fuzzy_candidates(names: DataFrame, index: DataFrame, min_length: int = MIN_LENGTH, least: float = MIN_SIMILARITY, most: int | None = MAX_CANDIDATES) -> DataFrame:
    """Pairs (name_norm, cand, ...) in one block of equal first letters that can be similar enough.

    The first `most` names of a block, in order of insertion, as in the rule that this
    reproduces; None lifts that limit. The window's row limit is applied before its shuffle."""
    if most is not None:
        index = index.withColumn("_n", F.row_number().over(W.partitionBy("prefix3").orderBy("ord"))).where(f"_n <= {int(most)}").drop("_n")
    q = names.where(F.length("name_norm") >= min_length).select("name_norm", prefix3(F.col("name_norm")).alias("prefix3"))
    return q.join(index.withColumnRenamed("name_norm", "cand"), "prefix3").where(sim.near_enough(F.col("name_norm"), F.col("cand"), least))


def fuzzy(names: DataFrame, gaz: Taxa, how: str = "indel", most: int | None = MAX_CANDIDATES) -> DataFrame:
    """(name_norm, hit): the most similar name of the block, the first inserted among equals."""
    c = fuzzy_candidates(names, gaz.names.where("prefix3 is not null"), most=most).withColumn("sim", sim.similarity(F.col("name_norm"), F.col("cand"), how))
    best = c.where(F.col("sim") >= MIN_SIMILARITY).groupBy("name_norm").agg(F.min_by(F.struct("ott_id", "sim"), F.struct(-F.col("sim"), F.col("ord"))).alias("x")).select("name_norm", "x.ott_id", "x.sim")
    return best.join(gaz.concepts, "ott_id").select("name_norm", _hit("fuzzy", F.round("sim", 3)).alias("hit"))


def resolve_names(names: DataFrame, gaz: Taxa, with_fuzzy: bool = True, how: str = "indel", most: int | None = MAX_CANDIDATES) -> DataFrame:
    """(name_norm, hit) for the distinct keys that resolve: exact, then abbreviated, then fuzzy; each step sees only what the last left.

    The distinct keys and each step's hits are written tables, as later steps read
    them again."""
    q = written(names.select("name_norm").where("name_norm <> ''").distinct(), "keys")
    out = written(exact(q, gaz), "exact")
    left = q.join(out, "name_norm", "left_anti")
    short = written(abbreviated(left, gaz), "abbreviated")
    out = out.unionByName(short)
    if with_fuzzy:
        out = out.unionByName(fuzzy(left.join(short, "name_norm", "left_anti"), gaz, how, most))
    return out


def keys_of(df: DataFrame, col: str, compat: bool = True) -> DataFrame:
    """(raw, name_norm) of the distinct strings of a column, a written table: each becomes a key once, however many rows and joins name it."""
    raw = df.select(F.col(col).alias("raw")).where("raw is not null").distinct()
    return written(raw.withColumn("name_norm", normalize_taxon(F.col("raw"), compat)), "raw")


def resolve_taxa(df: DataFrame, col: str, gaz: Taxa, with_fuzzy: bool = True, compat: bool = True, **kw) -> DataFrame:
    """All rows and columns of df, and hit (null where unresolved). Each distinct key is resolved once."""
    keys = keys_of(df, col, compat)
    hits = keys.join(resolve_names(keys, gaz, with_fuzzy, **kw), "name_norm").select(F.col("raw").alias("_raw"), "hit")
    df = df.drop("hit")
    return df.join(hits, df[col] == F.col("_raw"), "left").drop("_raw")


def accepted(rank: Column, ranks: tuple[str, ...]) -> Column:
    """An empty rank is accepted."""
    return (F.coalesce(rank, F.lit("")) == "") | F.lower(rank).isin(*ranks)
