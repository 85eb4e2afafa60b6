"""Common names: building the gazetteer and scanning texts for the longest names."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.functions.text import WORD, ends_of, normalize_vernacular

MAX_WORDS, MIN_SINGLE = 4, 5
ZIPF_SINGLE, ZIPF_ALL = 3.6, 4.3
#: The accented letters that a word of the scan can have, and what they become.
WORD_ACCENTS = ("ÁÉÍÓÚÜÑáéíóúüñ", "AEIOUUNaeiouun")
SCIENTIFIC = r"^[A-Z][a-zA-Z-]+(?:\s+[a-z][a-zA-Z-]+)*$"
#: Single words that are never taken for a species.
STOP = """
papa alcalde quimera gato rata raton mora lino pino haya cana junco sauce roble encina chopo alamo olmo fresno aliso brezo tomillo romero esparto
carrizo aliaga retama jara lentisco madrono acebuche oso lobo zorro conejo liebre perdiz paloma gorrion estornino abeja avispa mosca mosquito hormiga trucha
carpa barbo anguila sardina boga trigo cebada avena centeno vid olivo naranjo limonero almendro nogal castano abedul tejo sabina enebro durillo cornicabra
calafate corcho grama cardo ortiga hinojo malva carrete relleno carrera coladero regenerado cenizo paramo lucia merma boqueron morron podas
cruceta canario serra innominado nerio peregrino puerco lupulo raya sargo aguja lija breca pardo blanca comun pinta rubio obispo fraile araña estrella
pedrosa rellena plumero acido voladora encaje terciaria trebolillo estepa babosa sabia lechera vieja espino
""".split()


def build_vernacular(raw: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """From (sci, cn, ord): (common_norm, common_display, scientific), one row per key.

    frequency: (word, zipf) of words with their accents; without it no name is too common."""
    p = raw.select(F.btrim(F.trim("sci"), F.lit('"')).alias("sci"), F.btrim(F.trim(F.regexp_replace(F.trim("cn"), '"?@es$', "")), F.lit('"')).alias("cn"), "ord").where("sci <> '' and cn <> ''")
    p = p.withColumn("common_norm", normalize_vernacular(F.col("cn"))).where((F.col("common_norm") != "") & ~F.col("common_norm").rlike("[0-9]"))
    p = p.withColumn("n", F.size(F.split("common_norm", " ")))
    single = F.col("n") == 1
    # the word list is compared as keys are, without accents
    stop = [w.replace("ñ", "n") for w in STOP]
    p = p.where(~(single & (F.col("common_norm").isin(*stop) | (F.length("common_norm") < MIN_SINGLE))))
    if frequency is not None:
        words = p.select("sci", "cn", "ord", F.explode(F.split(F.lower("cn"), r"\s+")).alias("word")).join(frequency, "word", "left")
        least = words.groupBy("sci", "cn", "ord").agg(F.min(F.coalesce("zipf", F.lit(0.0))).alias("least"))
        p = p.join(least, ["sci", "cn", "ord"], "left").where(F.coalesce("least", F.lit(0.0)) < F.when(F.col("n") == 1, ZIPF_SINGLE).otherwise(ZIPF_ALL)).drop("least")
    p = p.where(F.col("sci").rlike(SCIENTIFIC) & ~((F.col("n") == 1) & (F.col("common_norm") == normalize_vernacular(F.element_at(F.split("sci", r"\s+"), 1)))))
    return p.groupBy("common_norm").agg(F.min_by("cn", "ord").alias("common_display"), F.array_sort(F.collect_set("sci")).alias("scientific"))


def scan_vernacular(docs: DataFrame, gazetteer: DataFrame, id_col: str = "_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(id, common, scientific, start, end): names from left to right, the longest first, without overlap.

    A name whose text begins with a capital blocks shorter ones at its place and is
    not taken. Words meet the first words of the gazetteer's keys, and groups of those
    that are left the keys themselves, in joins (broadcast only where Spark finds a side
    small); only matches come together by document, once, each with its own piece of the text."""
    # letters of words become small and lose their accents one by one, so places stay; all others stay as they are
    small = F.translate("text", WORD_ACCENTS[0] + string.ascii_uppercase, WORD_ACCENTS[1].lower() + string.ascii_lowercase)
    tok = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    tok = tok.select("id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("t"), F.split("text", WORD, -1).alias("gaps"), F.regexp_extract_all(small, F.lit("[0-9a-z]+"), F.lit(0)).alias("n"))
    tok = tok.withColumn("ends", ends_of(F.col("t"), F.col("gaps")))
    # one row for each word, with the up to max_words words from there and what is between them; only words that begin a key go on
    ahead = F.transform("n", lambda x, i: F.struct(
        i.alias("i"), x.alias("first"), F.slice("n", i + 1, F.lit(max_words)).alias("words"), F.slice("t", i + 1, F.lit(max_words)).alias("heads"), F.slice("gaps", i + 2, F.lit(max_words - 1)).alias("between"), F.get("ends", i).alias("at")))
    g = tok.select("id", F.explode(ahead).alias("g")).select("id", "g.*")
    keys = gazetteer.select(F.col("common_norm").alias("key"), "scientific", F.size(F.split("common_norm", " ")).alias("m")).where(F.col("m") <= max_words)
    firsts = keys.groupBy(F.substring_index("key", " ", 1).alias("first")).agg(F.max("m").alias("most"))
    g = g.join(firsts, "first").select("id", "i", "words", "heads", "between", "at", F.explode(F.sequence(F.lit(1), F.least("most", F.size("words")))).alias("k"))
    g = g.select("id", "i", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("key"), "heads", "between", (F.col("at") - F.length(F.get("heads", F.lit(0)))).alias("start"))
    first = F.substring(F.get("heads", F.lit(0)), 1, 1)
    own = F.array_join(F.transform(F.slice("heads", F.lit(1), F.col("k")), lambda x, i: F.concat(x, F.when(i < F.col("k") - 1, F.get("between", i)).otherwise(""))), "")
    m = g.join(keys.select("key", "scientific"), "key").withColumn("capital", (F.upper(first) == first) & (F.lower(first) != first)).withColumn("common", own).withColumn("end", F.col("start") + F.length("common"))
    per = m.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", (-F.col("k")).alias("k"), "start", "end", "capital", "scientific", "common"))).alias("m"))
    none = F.array().cast("array<struct<start:int,end:int,scientific:array<string>,common:string>>")
    hit = lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"), y["scientific"].alias("scientific"), y["common"].alias("common"))
    state = lambda out, free, last: F.struct(out.alias("out"), free.cast("int").alias("free"), last.alias("last"))
    # of one place the longest comes first, and the others are passed over with it
    taken = F.aggregate("m", state(none, F.lit(0), F.lit(-1)), lambda a, y: F.when((y["i"] < a["free"]) | (y["i"] == a["last"]), a).when(
        y["capital"], state(a["out"], a["free"], y["i"])).otherwise(state(F.array_append(a["out"], hit(y)), y["i"] - y["k"], y["i"])), lambda a: a["out"])
    hits = per.select("id", F.explode(taken).alias("h"))
    return hits.select(F.col("id").alias(id_col), "h.common", "h.scientific", "h.start", "h.end")
