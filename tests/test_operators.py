"""Gazetteers, cascades and reports on small hand-written gazetteers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docfacts.operators import locations, places, qa, species, taxa, vernacular


@pytest.fixture(scope="module")
def gaz(spark):
    rows = [
        ("1", "Olea europaea", "species", ["g"], ["Olea sativa"], 0), ("2", "Aythya nyroca", "species", ["k"], [], 1), ("3", "Egretta garzetta", "species", ["k"], [], 2), ("4", "Milvus milvus", "species", ["k"], [], 3),
        ("5", "Anopheles gambiae", "species", ["k"], [], 4), ("6", "Olea", "genus", ["p"], [], 5), ("g", "Olea", "genus", ["p"], [], 6), ("p", "Oleaceae", "family", ["k"], [], 7), ("k", "Chloroplastida", "kingdom", [], [], 8),
        ("9", "Milvus migrans", "", ["lost"], [], 9), ("10", "Apis gambiae", "species", [], [], 10), ("11", "Oleaceae media", "family", [], [], 11),
    ]
    return taxa.build_taxa(spark.createDataFrame(rows, "id string, term string, rank string, parents array<string>, synonyms array<string>, ord long"))


@pytest.mark.parametrize(
    ("raw", "ott", "how"),
    [("Olea europaea L.", "ott:1", "exact"), ("Olea sativa", "ott:1", "synonym"), ("O. europaea", "ott:1", "abbrev"), ("A. gambiae", None, None), ("Olea europea", "ott:1", "fuzzy"), ("Aythys nyroca", "ott:2", "fuzzy"), ("Egretta garceta", "ott:3", "fuzzy"), ("in situ", None, None), ("", None, None), ("Olea", "ott:6", "exact")],
)
def test_resolve_taxa(spark, gaz, raw, ott, how):
    r = taxa.resolve_taxa(spark.createDataFrame([(raw, 7)], "raw string, hit2 int"), "raw", gaz).first()
    assert (r["hit"] and (r["hit"]["ott_id"], r["hit"]["match_type"])) == (ott and (ott, how))
    if raw == "Olea europea":
        assert r["hit"]["score"] == 0.96 and r["hit"]["kingdom"] == "Chloroplastida"


@pytest.fixture(scope="module")
def place_gaz(spark):
    rows = [
        ("1", "Huesca", "Huesca", "", "P", "PPLA2", "51", "22", "50000", 0), ("2", "Provincia de Huesca", "Provincia de Huesca", "Huesca", "A", "ADM2", "51", "22", "200000", 1), ("3", "Aragón", "Aragon", "", "A", "ADM1", "51", "", "0", 2),
        ("4", "Sosa", "Sosa", "", "H", "STM", "51", "22", "", 3), ("5", "Sosa", "Sosa", "", "P", "PPL", "51", "22", "9", 4), ("6", "Sierra de Guara", "Sierra de Guara", "", "T", "MTS", "51", "22", "x", 5), ("7", "Hotel Guara", "Hotel Guara", "", "S", "HTL", "51", "22", "0", 6),
    ]
    return places.build_places(spark.createDataFrame(rows, "geonameid string, name string, asciiname string, alternates string, fclass string, fcode string, admin1 string, admin2 string, population string, ord long"))


@pytest.mark.parametrize(
    ("raw", "gid", "how"),
    [("Huesca", "geonames:1", "exact"), ("provincia de Huesca", "geonames:2", "exact"), ("término municipal de Huesca", "geonames:2", "core"), ("río Sosa", "geonames:4", "core"), ("Sosa", "geonames:5", "exact"), ("Sierra de Guara", "geonames:6", "exact"), ("Hotel Guara", None, None), ("Oeste", None, None), ("", None, None)],
)
def test_resolve_places(spark, place_gaz, raw, gid, how):
    r = places.resolve_places(spark.createDataFrame([(raw,)], "raw string"), "raw", place_gaz).first()["hit"]
    assert (r and (r["geonameid"], r["match_type"])) == (gid and (gid, how))
    if gid == "geonames:4":
        assert (r["type"], r["province"], r["region"]) == ("river", "Provincia de Huesca", "Aragón")


def test_fuzzy_places_are_opt_in(spark, place_gaz):
    df = spark.createDataFrame([("Huescaa",)], "raw string")
    assert places.resolve_places(df, "raw", place_gaz).first()["hit"] is None
    assert places.resolve_places(df, "raw", place_gaz, with_fuzzy=True).first()["hit"]["geonameid"] == "geonames:1"


def test_vernacular(spark):
    raw = spark.createDataFrame([("Milvus milvus", '"milano real"@es', 0), ("Otis tarda", "avutarda", 1), ("Aquila adalberti", "águila imperial ibérica", 2), ("Aquila x", "águila imperial", 3), ("Solanum tuberosum", "papa", 4), ("Salvia officinalis", "Salvia", 5), ("Bad 1", "nombre raro", 6), ("Milvus migrans", "milano real", 7)], "sci string, cn string, ord long")
    g = vernacular.build_vernacular(raw)
    assert {r[0]: r[1] for r in g.select("common_norm", "scientific").collect()} == {"milano real": ["Milvus migrans", "Milvus milvus"], "avutarda": ["Otis tarda"], "aguila imperial iberica": ["Aquila adalberti"]}
    text = "El milano real, la aguila imperial iberica y la Avutarda; avutarda comun. Milano real"
    got = vernacular.scan_vernacular(spark.createDataFrame([("d", text), ("e", None), ("f", "")], "_id string, text string"), g).orderBy("start").collect()
    assert [r["common"] for r in got] == ["milano real", "aguila imperial iberica", "avutarda"]
    assert all(text[r["start"] : r["end"]] == r["common"] for r in got)


def test_species_report(spark, gaz):
    text = "Olea europaea crece. Olea europea. Milvus milvus y milvus milvus; un milano real."
    docs = spark.createDataFrame([("a", text, ["Olea europea", " ", "olea EUROPEA", "Visual Rules", "Aythya nyroca"]), ("b", None, None), ("c", "Oleaceae media sin mas", [])], "_id string, text string, italicized_terms array<string>")
    v = spark.createDataFrame([("milano real", "milano real", ["Nada nada", "Milvus milvus"])], "common_norm string, common_display string, scientific array<string>")
    got = {r["_id"]: r for r in species.extract_species(docs, gaz, v).collect()}
    assert got["b"]["n_species"] == 0 and got["c"]["n_species"] == 0
    a = {s["ott_id"]: s for s in got["a"]["species"]}
    assert set(a) == {"ott:1", "ott:2", "ott:4"}
    assert a["ott:1"]["match_type"] == "exact" and a["ott:1"]["sources"] == ["italics", "text"]
    assert a["ott:2"]["mentions"][0]["start"] is None and a["ott:2"]["count"] == 1
    assert a["ott:4"]["sources"] == ["text", "vernacular"]


def test_italics_only(spark, gaz):
    docs = spark.createDataFrame([("a", "Milvus milvus", ["Olea europaea"]), ("b", "Milvus milvus", [])], "_id string, text string, italicized_terms array<string>")
    got = {r["_id"]: [s["ott_id"] for s in r["species"]] for r in species.extract_species(docs, gaz, scan_text=False).collect()}
    assert got == {"a": ["ott:1"], "b": ["ott:4"]}


def test_locations(spark, place_gaz):
    text = "Ley de Montes. Localización del proyecto. Se ubica en Huesca, junto a Sierra de Guara y Villanueva. Otra vez Huesca.\nPromotor: Aragón."
    docs = spark.createDataFrame([("a", text), ("b", "Por Aragón y Decreto Foral"), ("c", None)], "_id string, text string")
    got = {r["_id"]: r for r in locations.extract_locations(docs, place_gaz).collect()}
    assert got["a"]["scope"] == "section" and got["b"]["scope"] == "document" and got["c"]["n_locations"] == 0
    names = [x["name"] for x in got["a"]["locations"]]
    assert names[:2] == ["Huesca", "Sierra de Guara"] and "Villanueva" in names and "Aragón" not in names
    top = got["a"]["locations"][0]
    assert top["count"] == 2 and all(text[m["start"] : m["end"]] == m["text"] for m in top["mentions"])
    assert got["b"]["n_verified"] == 1 and not any("Decreto" in x["name"] for x in got["b"]["locations"])


def test_merge_intervals(spark):
    got = spark.range(1).select(locations.merge_intervals(F.expr("array(named_struct('start', 5, 'end', 9), named_struct('start', 1, 'end', 3), named_struct('start', 3, 'end', 4), named_struct('start', 6, 'end', 7))"))).first()[0]
    assert [tuple(x) for x in got] == [(1, 4), (5, 9)]


def test_examples_split_and_negatives(spark):
    rows = [(f"d{i}::t{j}", i % 3 == 0) for i in range(40) for j in range(2)]
    df = qa.split_documents(spark.createDataFrame(rows, "id string, pos boolean"), 0.25)
    assert df.where("is_dev").count() == 20
    kept = qa.downsample_negatives(df, "pos", 0.5, ["id"])
    assert kept.where("pos").count() == 28 and kept.where("not pos").count() == 14


def test_teacher(spark):
    docs = spark.createDataFrame([("a", "El río Sosa nace aquí"), ("b", "nada")], "_id string, text string")
    replies = qa.ask_teacher(docs, ["¿?", "¿x?"], lambda: lambda t, q: '{"0": "río Sosa", "1": "falso"}' if "Sosa" in t else 1 / 0)
    got = {r["id"]: r for r in qa.from_teacher(docs, replies, ["¿?", "¿x?"]).collect()}
    assert got["a::t0"]["answers"]["answer_start"] == [3] and got["a::t1"]["is_impossible"]
    assert qa.ask_teacher(docs, ["¿?"], lambda: lambda t, q: "", done=replies).count() == 0


def test_ask_and_scores(spark):
    docs = spark.createDataFrame([("a", "El proyecto está en Huesca. Trabajo realizado en enero.")], "_id string, text string")
    r = qa.ask(docs, spark.createDataFrame([("¿Trabajo realizado cuando?",)], "question string"), threshold=-100.0).first()
    assert r["answered"] == (r["answer"] != "")
    rows = spark.createDataFrame([("x::t0", "uno dos", "uno dos", 1.0), ("y::t0", None, "tres", 0.2), ("z::t1", "uno", "dos cosas", 0.1), ("w::t1", None, "", float("-inf"))], "id string, gold string, span string, margin double")
    sweep = {r["tau"]: r for r in qa.threshold_sweep(rows).collect()}
    for tau, s in sweep.items():
        plain = qa.score_at(rows, tau).first()
        assert all(s[c] == pytest.approx(plain[c]) for c in ("n", "em", "f1", "contains", "ans_recall", "tp", "fp", "fn", "tn"))
    assert qa.best_threshold(qa.threshold_sweep(rows)).first()["best_tau"] == 1.0


def test_sections_of_long_texts(spark):
    """Sections against the plain rule; what follows a heading is not searched to the end of the text."""
    import re
    import time

    heading, most = "(?:the|der) ", 30

    def plain(text):
        out = []
        for m in re.finditer(heading, text):
            e = m.end()
            at = text.find("\n", e)
            b = min(len(text) if at < 0 else at, e + most)
            if b > e:
                if out and e <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([e, b])
        return [tuple(x) for x in out]

    texts = ["", "the ", "the \nthe x\n", "a the b der c\nd the " + "é" * 40, "the end " * 9 + "\n" * 3 + "der 🦅 x", "word the " + "x" * 29, ("text der word\n" + "y" * 40) * 3000 + "the " * 20_000]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1).select("i", locations.section_windows(F.col("t"), heading, "\n", most).alias("w")).sort("i").collect()
    took = time.time() - began
    assert [[tuple(x) for x in r["w"]] for r in rows] == [plain(t) for t in texts] and took < 20
    assert locations._groups(locations.HEADING) == 0 and locations._groups(r"(a)\((?:b)[(](?<n>c)(?<=d)") == 2


def test_vernacular_of_long_texts(spark):
    """Names, capitals and pieces as the plain rule has them, in a text of many names."""
    import time

    g = spark.createDataFrame([("gran pino real", ["A a"]), ("gran pino", ["B b"]), ("pino", ["C c"]), ("real", ["D d"])], "common_norm string, scientific array<string>")
    text = "gran  pino. Real; gran pino\nreal, Gran pino real, pino Pino KK gran " + "x pino-y " * 2_000
    began = time.time()
    got = vernacular.scan_vernacular(spark.createDataFrame([("d", text)], "_id string, text string"), g).orderBy("start").collect()
    took = time.time() - began
    assert [(r["common"], r["scientific"]) for r in got[:4]] == [("gran  pino. Real", ["A a"]), ("gran pino\nreal", ["A a"]), ("pino", ["C c"]), ("real", ["D d"])]
    assert len(got) == 5 + 2_000 and all(text[r["start"] : r["end"]] == r["common"] for r in got) and took < 60


def test_names_become_keys_once(spark, gaz):
    """A string that many rows have is normalised once, whatever reads the keys; rows, their columns and nulls stay."""
    df = spark.range(4000).selectExpr("id", "case when id % 4 = 3 then null else element_at(array('Olea europaea L.', 'Olea europaea', 'in situ'), int(id % 4) + 1) end as raw", "id as hit")
    keys = taxa.keys_of(df, "raw")
    assert sorted(map(tuple, keys.collect())) == [("Olea europaea", "olea europaea"), ("Olea europaea L.", "olea europaea"), ("in situ", "in situ")]
    assert not any("name_norm" in line and "regexp" in line for line in keys._jdf.queryExecution().toString().splitlines())
    got = taxa.resolve_taxa(df, "raw", gaz, with_fuzzy=False)
    assert got.columns == ["id", "raw", "hit"] and {(r["raw"], r["hit"] and r["hit"]["ott_id"], r["n"]) for r in got.groupBy("raw", "hit").agg(F.count(F.lit(1)).alias("n")).collect()} == {("Olea europaea L.", "ott:1", 1000), ("Olea europaea", "ott:1", 1000), ("in situ", None, 1000), (None, None, 1000)}
