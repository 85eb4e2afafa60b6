"""Locations of documents: section windows, recognised spans, filters, gazetteer, counts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions.text import SPAN, classify_place, ends_of, let, plain_lower, running, spans
from docfacts.operators.places import Places, resolve_places
from docfacts.sources.shared import written

#: The headings of a location section, and what begins the next one.
HEADING = r"(?Ui)(?:descripci[oó]n\s+y\s+localizaci[oó]n|localizaci[oó]n\s+y\s+descripci[oó]n|localizaci[oó]n|ubicaci[oó]n|emplazamiento)\s+del?\s+proyecto"
NEXT_SECTION = (
    r"(?U)\n\s*(?:[–—\-•·]\s+[A-ZÁÉÍÓÚ]|\d{1,2}(?:\.\d{1,2})*[.\)]\s+[A-ZÁÉÍÓÚ]"
    r"|(?:Primero|Segundo|Tercero|Cuarto|Quinto|Sexto|S[eé]ptimo|Octavo|Noveno|D[eé]cimo)\b"
    r"|(?:Promotor|Tramitaci[oó]n|An[aá]lisis|Resumen|Alternativas?|Caracterizaci[oó]n|Elementos\s+ambientales|Antecedentes|Fundamentos\s+de\s+[Dd]erecho|Consultas|Resoluci[oó]n)\b)"
)
SECTION_CHARS = 2600
MENTIONS = 10
#: Words that make a span an administrative body or a legal reference.
ADMIN = """
ley decreto orden reglamento articulo capitulo titulo seccion anexo expediente boletin gobierno ministerio departamento consejeria direccion subdireccion servicio
oficina secretaria delegacion ayuntamiento diputacion sostenibilidad ganaderia demografico tramo plan programa resolucion disposicion fundamentos derecho objeto
instituto confederacion sociedad gasoducto oleoducto carretera autovia autopista sau sa
""".split()


def section_windows(text: Column, heading: str = HEADING, boundary: str = NEXT_SECTION, most: int = SECTION_CHARS) -> Column:
    """array<struct<start,end>> of the sections under a heading, each up to the next boundary, merged where they touch.

    SECTION_CHARS is a rule of the sections, not a limit of the input. The pattern looks
    ahead from each heading to its boundary or `most` characters, whichever comes first,
    so the rest of the text isn't searched again for each; a boundary must not look behind
    where it begins."""
    tail = rf"(?:{heading})(?=((?:(?!{boundary})(?s:.)){{0,{most}}}+))"
    empty = F.array().cast("array<struct<start:int,end:int>>")
    each = lambda t, found: let(ends_of(found, F.split(t, F.lit(heading), -1)), lambda ends: let(
        F.regexp_extract_all(t, F.lit(tail), F.lit(_groups(heading) + 1)), lambda after: F.transform(ends, lambda e, i: F.struct(e.alias("start"), (e + F.length(F.get(after, i))).cast("int").alias("end")))))
    sections = lambda t: let(F.regexp_extract_all(t, F.lit(heading), F.lit(0)), lambda found: F.when(F.size(found) > 0, merge_intervals(F.filter(each(t, found), lambda x: x["end"] > x["start"]))).otherwise(empty))
    return let(text, sections)


def _groups(pattern: str) -> int:
    """How many groups a pattern captures."""
    plain = re.sub(r"\[\^?\]?[^\]]*\]", "", re.sub(r"\\.", "", pattern))
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain))


def merge_intervals(c: Column) -> Column:
    """Sorted array<struct<start,end>> with overlapping and touching intervals joined.

    An interval begins a new one where it starts after all ends before it; those are a
    running maximum, so the steps grow with the intervals and not with their square."""
    opens = lambda s, m: F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i)["start"] > F.get(m, i - 1)))
    joined = lambda s, m: let(opens(s, m), lambda o: F.transform(o, lambda a, j: F.struct(F.get(s, a)["start"].alias("start"), F.get(m, F.coalesce(F.get(o, j + 1), F.size(s)) - 1).alias("end"))))
    return let(F.sort_array(c), lambda s: let(running(F.transform(s, lambda x: x["end"]), F.greatest, -(1 << 31)), lambda m: joined(s, m)))


#: A stand-in for a trained recogniser: runs of capitalised words, which may be linked by Spanish particles.
CAPITALISED = r"(?U)\b\p{Lu}[\p{L}'’-]+(?:\s+(?:(?:de|del|la|las|los|el|y)\s+)*\p{Lu}[\p{L}'’-]+)*"
#: The same without `y`; a preposition that begins a sentence; and what makes a span other names, should the gazetteer not have it as it is.
ONE_NAME = CAPITALISED.replace("|y)", ")")
LEAD = r"(?U)^(?:Por|En|Con|Para|Según|Desde|Hasta|Sobre|Entre)\s+"
JOINED = r"(?U)\sy\s|" + LEAD.removeprefix("(?U)")


def capitalised_spans(chunks: DataFrame) -> DataFrame:
    """A native recogniser: rows (id, base, chunk) to (id, base, text, start, end, label). Not a trained model."""
    return chunks.select("id", "base", F.explode(spans(F.col("chunk"), CAPITALISED)).alias("s")).select("id", "base", "s.text", "s.start", "s.end", F.lit("LOC").alias("label"))


def model_spans(load: Callable[[], Callable[[str], list[tuple[str, int, int, str]]]]) -> Callable[[DataFrame], DataFrame]:
    """A recogniser from a loader of a model: load() runs once in each Python worker; the model returns (text, start, end, label)."""

    def recogniser(chunks: DataFrame) -> DataFrame:
        kind = chunks.schema["id"].dataType.simpleString()

        def run(it):
            model = load()
            for pdf in it:
                rows = [(i, b, *x) for i, b, c in zip(pdf["id"], pdf["base"], pdf["chunk"]) for x in model(c)]
                yield pdf.iloc[:0].assign(text="", start=0, end=0, label="").drop(columns="chunk") if not rows else type(pdf)(rows, columns=["id", "base", "text", "start", "end", "label"])

        return chunks.select("id", "base", "chunk").mapInPandas(run, f"id {kind}, base int, text string, start int, end int, label string")

    return recogniser


def chunks_of(docs: DataFrame, id_col: str = "_id", text_col: str = "text") -> DataFrame:
    """(id, scope, base, chunk): the location sections of a document or, where there are none, all of it."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("id", "text", section_windows(F.col("text")).alias("w"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    d = d.select("id", "text", F.when(F.size("w") > 0, "section").otherwise("document").alias("scope"), F.explode(F.when(F.size("w") > 0, F.col("w")).otherwise(whole)).alias("x"))
    return d.select("id", "scope", F.col("x.start").alias("base"), F.substring(F.col("text"), F.col("x.start") + 1, F.col("x.end") - F.col("x.start")).alias("chunk"))


def admissible(norm: Column) -> Column:
    """Not empty, not only punctuation and digits, more than two characters, no digit, no administrative word."""
    return (norm != "") & ~norm.rlike(r"(?U)^[\W\d]+$") & (F.length(norm) > 2) & ~norm.rlike(r"(?U)\d") & ~F.arrays_overlap(F.split(norm, r"(?U)\s+"), F.array(*map(F.lit, ADMIN)))


def _names_in(text: Column) -> Column:
    """The single names of a span."""
    bare = lambda p: F.regexp_replace(p["text"], LEAD, "")
    return F.transform(spans(text, ONE_NAME), lambda p: F.struct(bare(p).alias("text"), (p["end"] - F.length(bare(p))).alias("start"), p["end"].alias("end")))


def location_mentions(docs: DataFrame, gaz: Places | None = None, recogniser=capitalised_spans, labels: tuple[str, ...] = ("LOC",), verified_only: bool = False, id_col: str = "_id") -> DataFrame:
    """(id, key, name, type, verified, geonameid, province, region, match_type, confidence, text, start, end): recognised spans that pass the filters.

    A span that `y` joins, or that a preposition begins, is one name if the gazetteer has
    it, else the names around the `y` without the preposition."""
    found = recogniser(chunks_of(docs, id_col)).where(F.col("label").isin(*labels))
    m = found.select("id", F.trim("text").alias("text"), (F.col("base") + F.col("start")).cast("int").alias("start"), (F.col("base") + F.col("end")).cast("int").alias("end"))
    m = written(m.withColumn("parts", F.when(F.col("text").rlike(JOINED), _names_in(F.col("text"))).otherwise(F.array().cast(f"array<{SPAN}>"))), "recognised")
    # each distinct string is judged and looked up once
    names = m.select(F.explode(F.array_union(F.array("text"), F.transform("parts", lambda p: p["text"]))).alias("name")).distinct()
    names = names.withColumn("norm", plain_lower(F.col("name"))).withColumn("ok", admissible(F.col("norm")))
    none = "struct<geonameid:string,canonical:string,type:string,fclass:string,fcode:string,province:string,region:string,match_type:string,score:double>"
    known = resolve_places(names, "name", gaz) if gaz is not None else names.withColumn("hit", F.lit(None).cast(none))
    known = written(known.select("name", "norm", "ok", F.when(F.col("ok"), F.col("hit")).alias("hit")), "names")
    whole = m.join(known, m["text"] == known["name"]).drop("name")
    apart = F.col("hit").isNull() & (F.size("parts") > 0)
    pieces = whole.where(apart).select("id", "start", F.explode("parts").alias("p")).select("id", F.col("p.text").alias("text"), (F.col("start") + F.col("p.start")).alias("start"), (F.col("start") + F.col("p.end")).alias("end"))
    pieces = pieces.join(known, F.col("text") == F.col("name")).drop("name")
    columns = ["id", "text", "start", "end", "norm", "ok", "hit"]
    m = whole.where(~apart).select(*columns).unionByName(pieces.select(*columns)).where("ok")
    if verified_only:
        m = m.where("hit is not null")
    return m.select(
        "id", F.coalesce("hit.geonameid", F.concat(F.lit("raw:"), F.col("norm"))).alias("key"), F.coalesce("hit.canonical", "text").alias("name"), F.coalesce("hit.type", classify_place(F.col("norm"))).alias("type"),
        F.col("hit").isNotNull().alias("verified"), "hit.geonameid", "hit.province", "hit.region", "hit.match_type", F.col("hit.score").alias("confidence"), "text", "start", "end",
    )


def location_findings(m: DataFrame) -> DataFrame:
    """One row per document and place: counts of all mentions, the first ten of them (a rule of the report), and the first one's attributes."""
    attributes = ("name", "type", "verified", "geonameid", "province", "region", "match_type", "confidence")
    by = m.groupBy("id", "key").agg(F.count(F.lit(1)).cast("int").alias("count"), F.min_by(F.struct(*attributes), F.struct("start", "end")).alias("x"), F.slice(F.array_sort(F.collect_list(F.struct("start", "end", "text"))), 1, MENTIONS).alias("m"))
    return by.select("id", "key", *(f"x.{a}" for a in attributes), "count", F.transform("m", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("mentions"))


def extract_locations(docs: DataFrame, gaz: Places | None = None, recogniser=capitalised_spans, labels: tuple[str, ...] = ("LOC",), verified_only: bool = False, id_col: str = "_id") -> DataFrame:
    """(id, scope, n_locations, n_verified, locations[]): verified first, then by count and name."""
    f = location_findings(location_mentions(docs, gaz, recogniser, labels, verified_only, id_col))
    item = F.struct((~F.col("verified")).alias("u"), (-F.col("count")).alias("c"), "name", "key", F.struct("name", "type", "verified", "geonameid", "province", "region", "match_type", "confidence", "count", "mentions").alias("f"))
    nested = f.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["f"]).alias("locations"), F.count_if("verified").cast("int").alias("n_verified"))
    scope = docs.select(F.col(id_col).alias("id"), F.when(F.size(section_windows(F.coalesce("text", F.lit("")))) > 0, "section").otherwise("document").alias("scope"))
    return scope.join(nested, "id", "left").select(F.col("id").alias(id_col), "scope", F.coalesce(F.size("locations"), F.lit(0)).alias("n_locations"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"), "locations")
