"""Readers, sinks and the stream."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docfacts.operators import places, taxa
from docfacts.sources import readers, writers
from docfacts.streaming.files import document_stream, run_stream


def test_documents_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/d{i}.json").write_text(json.dumps({"_id": f"d{i}", "text": "Milvus milvus", "n_chars": 13, "unknown": 1}, indent=1))
    d = readers.documents(spark, str(tmp_path / "in"))
    assert d.count() == 3 and d.first()["italicized_terms"] == []
    for _ in range(2):
        run_stream(document_stream(spark, str(tmp_path / "in")), lambda df: df.select("_id", "n_chars"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_gazetteer_round_trip(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"concepts": [{"id": "1", "preferred_term": {"term": "Olea europaea"}, "rank": {"name": "species"}, "parents": ["2"], "synonyms": [{"term": "Olea sativa"}]}, {"id": "2", "preferred_term": {"term": "Plantae"}, "rank": {"name": "kingdom"}}]}))
    gaz = taxa.build_taxa(readers.concepts(spark, str(tmp_path / "t.json")))
    writers.write_taxa(gaz, str(tmp_path / "taxa"))
    back = writers.read_taxa(spark, str(tmp_path / "taxa"))
    assert back.names.count() == 3 and {r["kingdom"] for r in back.concepts.collect()} == {"Plantae"}
    f = ["9", "Río \"Sosa\"", "Rio Sosa", "Sosa,Soza"] + [""] * 15
    f[6], f[7], f[10], f[11], f[14] = "H", "STM", "51", "22", "0"
    (tmp_path / "p.txt").write_text("\t".join(f) + "\nshort\tline\n")
    g = places.build_places(readers.places(spark, str(tmp_path / "p.txt")))
    assert g.places.count() == 1 and {r["name_norm"] for r in g.names.collect()} == {"rio sosa", "sosa", "soza"}


def test_small_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("_id;is_taxa;is_location;is_primary_data;is_secondary_data\r\na;1;1;0;0\r\n")
    assert readers.labels(spark, str(tmp_path / "l.csv")).first()["is_secondary_data"] == 0
    (tmp_path / "q.txt").write_text("# no\n\n¿Dónde?\ttema\n")
    assert [r[0] for r in readers.questions(spark, str(tmp_path / "q.txt")).collect()] == ["¿Dónde?"]
    (tmp_path / "v.tsv").write_text('sci\tcn\n"Otis tarda"\t"avutarda"@es\nrota\n')
    assert readers.vernacular_raw(spark, str(tmp_path / "v.tsv")).count() == 1
    (tmp_path / "t.jsonl").write_text('{"doc": "a", "examples": [{"id": "a::t0"}]}\nbroken\n')
    assert readers.teacher_lines(spark, str(tmp_path / "t.jsonl")).count() == 1
    (tmp_path / "e.json").write_text('[{"id": "1", "text": "abc", "features": {"wind_farm": [{"start": 0, "end": 2}]}}]')
    from docfacts.operators.qa import from_evidence

    assert from_evidence(readers.evidence(spark, str(tmp_path / "e.json"))).first()["answers"]["text"] == ["ab"]
    assert readers.threshold(spark) == 0.0


def test_data_set_and_report_round_trips(spark, tmp_path):
    """What the sinks write the readers read: the assembled data set, and the threshold of a report."""
    from docfacts.operators import qa, service
    from docfacts.sources import readers, writers

    cache = spark.createDataFrame([(f"d{i}", "parque del monte", {"protected_area": [(0, 6)]}) for i in range(20)], "id string, text string, features map<string,array<struct<start:int,end:int>>>")
    docs = cache.select(F.col("id").alias("_id"), "text")
    replies = docs.select(F.col("_id").alias("doc"), F.lit('{"0": "monte", "1": "nada"}').alias("reply"))
    data = qa.assemble(qa.from_evidence(cache), qa.from_teacher(docs, replies, ["q0", "q1"]))
    counts = {r["part"]: tuple(r)[1:] for r in qa.dataset_counts(data).collect()}
    assert counts == {"dev": (6, 2, 2), "train": (54, 18, 18)}
    assert qa.assemble(data.drop("is_dev"), negatives=0.5).where("not is_dev and is_impossible").count() == 18
    writers.write_squad(data.drop("is_dev"), str(tmp_path / "squad"))
    key = lambda r: (r["id"], r["question"])
    assert sorted(readers.squad(spark, str(tmp_path / "squad"), lines=True).collect(), key=key) == sorted(data.select("id", "question", "context", "answers", "is_impossible").collect(), key=key)
    (tmp_path / "one.json").write_text('{"version": "1.0",\n "data": [\n {"id": "a::sp", "question": "q",\n "context": "c", "answers": {"text": [], "answer_start": []}, "is_impossible": true}]}')
    assert [r["id"] for r in readers.squad(spark, str(tmp_path / "one.json")).collect()] == ["a::sp"]
    rows = spark.createDataFrame([("a::sp", "monte", "monte", 1.5), ("b::sp", "", "rio", 0.2)], "id string, gold string, span string, margin double")
    sweep = qa.threshold_sweep(rows)
    writers.write_report(qa.score_at(rows, 0.0), qa.score_at(rows, 0.0, True), sweep, str(tmp_path / "report"), metadata={"model": "none"})
    assert readers.threshold(spark, str(tmp_path / "report/summary")) == qa.best_threshold(sweep).first()["best_tau"] == 1.5
    r = service.batch(docs, lambda d: d.select("_id")).first()
    assert r["count"] == 20 and len(r["results"]) == 20 and service.batch_size(docs).first()[0] == 20
    assert service.health(spark, vernacular=docs).first().asDict() == {"status": "ok", "n_concepts": 0, "n_names": 0, "n_places": 0, "n_vernacular": 20}
    assert [tuple(r) for r in service.describe(docs).collect()] == [("_id", "string"), ("text", "string")]
