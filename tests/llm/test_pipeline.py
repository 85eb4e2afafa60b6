"""The pipeline's stages over the smallest tables, each against a plain version of what it decides."""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from docfacts.llm import packing, quality_classifier, suffix_dedup, toxicity
from docfacts.llm.queries import word_file
from tests.llm.test_small import plain_components

WORD_TOKENIZER = word_file()
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs, stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name == "quality":
            good = [i for i, r in labels.items() if r["quality"] == 1]
            assert sum(i in kept[name] for i in good) >= 0.95 * len(good)
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert kept[name] == {k for k, _, c in plain_components(rows) if k == c}
        if name == "suffix_dedup":
            assert kept[name] == {r["doc_id"] for r in before.collect()}
            again = suffix_dedup.remove_repeats(before).selectExpr("sum(n_removed)").first()[0]
            lost = sum(len(r["text"].encode()) for r in before.collect()) - sum(len(r["text"].encode()) for r in docs.collect())
            assert again <= lost <= again + 4 * before.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in out.collect()} == kept["suffix_dedup"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_decisions(spark, monkeypatch):
    """Quality and toxicity keep the rows that plain scores of the fitted models keep; pieces cover each text and fit."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], (r["text"] or "").encode(), r["source"], r["lang"]) for r in docs.collect()]

    q = quality_classifier
    model = q.learn(docs, labels)
    rates, mean = q.site_rates(docs, labels, "source", "lang")
    rates = {tuple(r)[:3]: r["rate"] for r in rates.collect()}
    logit = lambda p: math.log(p / (1 - p))
    want = set()
    for i, t, h, p in rows:
        s = float(((q.evidence([t]) - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights)[:-1])[0] + model.weights[-1])
        s = min(max(s, logit(1e-6)), logit(1 - 1e-6))
        if 1 / (1 + math.exp(-s - logit(rates[h, p, zlib.crc32(str(i).encode()) % q.FOLDS]) + logit(mean))) >= q.THRESHOLD:
            want.add(i)
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).collect()} == want and 0 < len(want) < len(rows)

    model = toxicity.learn(docs, labels)
    scores = {i: toxicity.score(model, t) for i, t, _, _ in rows}
    # no score of this small table reaches TOXIC: the middle one as limit makes the stage reject rows
    monkeypatch.setattr(corpus_pipeline, "TOXIC", float(np.median(list(scores.values()))))
    want = {i for i, s in scores.items() if s < corpus_pipeline.TOXIC}
    assert {r["doc_id"] for r in corpus_pipeline.toxic(spark, docs, SF).collect()} == want and 0 < len(want) < len(rows)

    tok, pieces, bins = packing.word_tokenizer(WORD_TOKENIZER), {}, {}
    for r in corpus_pipeline.pack(spark, docs, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t, _, _ in rows:
        n = len(tok.encode([t.decode()])[0]) // 4 + 1
        assert sorted(pieces[i]) == [(k, b, min(packing.CAPACITY, n - b)) for k, b in enumerate(range(0, n, packing.CAPACITY))]
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(x for _, x in b[:k]) for k in range(len(b))] and sum(x for _, x in b) <= packing.CAPACITY
