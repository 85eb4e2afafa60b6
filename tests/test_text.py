"""Scalar functions against known pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docfacts.functions import text as T
from docfacts.functions.fuzzy import indel_ratio, near_enough


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("raw", "key"),
    [("Quercus robur L.", "quercus robur"), ("Bellis perennis (L.) 1753", "bellis perennis"), ("Olea Europaea", "olea"), ("Quercus sp.", "quercus ."), ("  Águila   real ", "aguila real"), ("", ""), ("Abies alba van Tieghem", "abies alba")],
)
def test_normalize_taxon(spark, raw, key):
    assert one(spark, raw, T.normalize_taxon) == key


def test_normalize_taxon_without_compat(spark):
    assert one(spark, "Quercus sp.", lambda c: T.normalize_taxon(c, compat=False)) == "quercus"


@pytest.mark.parametrize(("raw", "key"), [("Sierra de Guadarrama (Norte)", "sierra de guadarrama norte"), ("Río  Sosa", "rio sosa"), ("ﬁn", "fin"), ("é", "e")])
def test_normalize_place_is_idempotent(spark, raw, key):
    assert one(spark, raw, T.normalize_place) == key
    assert one(spark, key, T.normalize_place) == key


@pytest.mark.parametrize(
    ("key", "core", "hint"),
    [("rio sosa", "sosa", "H"), ("provincia de huesca", "huesca", "A"), ("sierra de la luna", "luna", "T"), ("parque de x", "parque de x", None), ("parque natural de x", "x", "L"), ("rio", "rio", None), ("casa", "casa", None), ("rio de la", "la", "H"), ("termino municipal de x", "x", "PA")],
)
def test_strip_head(spark, key, core, hint):
    assert tuple(one(spark, key, T.strip_head)) == (core, hint)


def test_spans_have_code_point_offsets(spark):
    text = "🦅 Milvus milvus y Milvus migrans. milvus"
    got = one(spark, text, lambda c: T.spans(c, T.BINOMIAL))
    assert [r["text"] for r in got] == ["Milvus milvus", "Milvus migrans"]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in got)


def test_find_spans_is_literal_and_limited(spark):
    text = "a.b A.B axb " + "a.b " * 30
    got = one(spark, text, lambda c: T.find_spans(c, F.lit("a.b")))
    assert len(got) == 25 and [g["start"] for g in got[:3]] == [0, 4, 12]
    assert one(spark, text, lambda c: T.find_spans(c, F.lit(""))) == []


def test_place_type(spark):
    df = spark.createDataFrame([("H", "STM"), ("H", "XXX"), ("Q", "XXX"), ("A", "ADM2")], "c string, f string")
    assert [r[0] for r in df.select(T.place_type(F.col("c"), F.col("f"))).collect()] == ["river", "water_body", "place", "province"]


def test_place_type_is_what_its_sql_says(spark):
    from docfacts.plans import queries

    assert {"ADM1", "STMM", "RESF", "PPL"} <= set(queries._CODES) and len(queries._CODES) == 42
    df = spark.createDataFrame([(c, f) for c in "AHLPRTV" for f in queries._CODES], "fclass string, fcode string")
    got = df.select("fcode", T.place_type(F.col("fclass"), F.col("fcode")).alias("type"), F.expr(f"case {queries._TYPE_CASE} else 'place' end").alias("sql")).collect()
    assert all(r["type"] == r["sql"] for r in got) and {r["type"] for r in got if r["fcode"] == "STMM"} == {"river"}


@pytest.mark.parametrize(("a", "b", "f1"), [("el río Sosa", "río sosa", 1.0), ("", "", 1.0), ("x", "", 0.0), ("a b b", "b b c", 2 / 3)])
def test_token_f1(spark, a, b, f1):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.token_f1(F.col("a"), F.col("b"))).first()[0] == pytest.approx(f1)


def test_contains_match(spark):
    df = spark.createDataFrame([("Con fecha 14 de enero de 2011 se inició", "14 de enero de 2011"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(T.contains_match(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_parse_reply(spark):
    raw = '<think>{"0": "no"}</think> {"0": " \\"río Sosa\\" ", "1": null}'
    m = one(spark, raw, T.parse_reply)
    assert m["1"] is None
    df = spark.createDataFrame([(m["0"], "el río Sosa")], "a string, t string")
    assert tuple(df.select(T.reply_span(F.col("a"), F.col("t")).alias("s")).first()[0]) == ("río Sosa", 3)


def test_similarity_and_its_prefilter(spark):
    assert indel_ratio("olea europea", "olea europaea") == pytest.approx(0.96)
    pairs = [("olea europea", "olea europaea"), ("accipiter gentiles", "accipiter gentilis"), ("abcdefgh", "zzzzzzzz"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", near_enough(F.col("a"), F.col("b"), 0.9).alias("n"))
    for r in df.collect():
        assert r["n"] or indel_ratio(r["a"], r["b"]) < 0.9


def test_authorship_to_the_end(spark):
    """However many authorities a name has, all go."""
    names = ["Aus bus " + " ".join("Abc" + "d" * i for i in range(11)), "Aus bus (L.) (Mill.) Hoek, 1758 van der Berg", "Aus bus", "", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "a string").select(T.normalize_taxon(F.col("a"))).collect()]
    assert got == ["aus bus", "aus bus", "aus bus", "", None]


def test_fold_is_nfkd(spark):
    import unicodedata

    texts = ["Άλφα ① ⑩ ﬁn Ǆ été ß Œ ½ ㎏ … ĳ ñandú", "x\u0301 y", "カ゛ ｶﾞ", "й Й ё", "plain", "", None]
    want = [t and "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)) for t in texts]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "a string").select(T.fold_accents(F.col("a"))).collect()] == want


def test_spans_of_long_texts(spark):
    """Steps grow with the text, not with its square."""
    import time

    text = "wort Abc " * 100_000
    began = time.time()
    n, last = spark.createDataFrame([(text,)], "t string").repartition(1).select(F.size(T.spans(F.col("t"), T.WORD)), F.element_at(T.spans(F.col("t"), T.WORD), -1)).first()
    assert n == 200_000 and (last["text"], last["start"], last["end"]) == ("Abc", len(text) - 4, len(text) - 1) and time.time() - began < 30


def test_fold_costs_by_the_text(spark):
    """Every character is folded as NFKD has it, and a long text in another script costs no search of the tables for each."""
    import time
    import unicodedata

    fold = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    points = [chr(n) for n in range(0x80, 0x30000) if not 0xAC00 <= n < 0xD800 and not 0xD800 <= n < 0xE000]
    texts = [c for c in points if unicodedata.decomposition(c) or unicodedata.combining(c)] + ["".join(points)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "a string").repartition(1).select("a", T.fold_accents(F.col("a")).alias("b")).where("a is not null").select("b").collect()]
    assert sorted(got) == sorted(map(fold, texts))
    long = spark.createDataFrame([("текст без знаков і ещё " * 200_000,)], "a string").select(F.octet_length(T.fold_accents(F.col("a"))))
    long.first()
    began = time.time()
    assert long.first()[0] and time.time() - began < 6


def test_spans_of_computed_texts(spark):
    """The text is computed once, however many matches it has."""
    import time

    text = "Über Äpfel " * 50_000
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").repartition(1).select(T.spans(T.fold_accents(F.col("t")), T.WORD).alias("s")).select(F.size("s"), F.element_at("s", -1)).first()
    assert got[0] == 100_000 and tuple(got[1]) == ("Apfel", len(text) - 6, len(text) - 1) and time.time() - began < 20


@pytest.mark.parametrize("raw", ["Aus bus (L.)  ", "Aus  bus f. cus", "Aus bus de", "de", "(x)", " Mill.", "A. b-c Mill. & Hoek, 1758", "x y ssp. z 1900"])
def test_normalize_taxon_is_the_plain_rule(spark, raw):
    import re
    import unicodedata

    s = "".join(x for x in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(x)).strip(" ")
    tails = [(r"\s*\([^()]*\)\s*\Z", 0), (r"\s*,?\s*\d{4}\s*\Z", 0), (r"\s+[A-Z][A-Za-z'’.\-]*\.?\Z", 0), (r"\s+(?:van|von|de[nrl]?|del|della|di|da|la|le|el|du|dos|das|bin|ibn|ter|ten)\Z", re.I)]
    while True:
        before = s
        for p, f in tails:
            s = re.sub(p, "", s, flags=f)
        if s == before:
            break
    s = re.sub(r"\b(?:subsp|ssp|var|cf|aff|sp|spp|nr|gen|f)\.?\b", " ", s.strip(" ").lower())
    assert one(spark, raw, T.normalize_taxon) == re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s.]", " ", s)).strip(" ")


def test_token_f1_of_long_answers(spark):
    """Multisets with many repeats, against counts; sorted once, not once for each token."""
    import random
    import time
    from collections import Counter

    pick = random.Random(3).choices
    pairs = [(" ".join(pick("abcdefgh", k=n)), " ".join(pick("abcdefxy", k=m))) for n, m in ((1, 1), (3, 5), (9, 8), (40, 7), (3000, 2000))] + [("a b c", "c b"), ("a a", "a a")]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").repartition(1).select("a", T.token_f1(F.col("a"), F.col("b")).alias("f")).sort("a").select("f").collect()]
    took = time.time() - began
    want = []
    for a, b in sorted(pairs):
        p, g = Counter(a.split()), Counter(b.split())
        same = sum((p & g).values())
        want.append(2 * same / (p.total() + g.total()) if same else 0.0)
    assert got == pytest.approx(want) and took < 20
