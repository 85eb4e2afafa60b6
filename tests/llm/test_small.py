"""Each operator against a plain version on small rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import collections
import gc
import hashlib
import re
import tracemalloc
import types
import weakref
import zlib

import numpy as np
import pytest

from docfacts.llm import bpe, common, graph, jaccard, licenses, media, packing, quality_classifier, quality_rules, suffix_dedup, toxicity
from docfacts.llm.license_rules import SIGNATURES
from docfacts.llm.queries import byte_ranks, pattern, word_file
from docfacts.llm.token_counts import Rollup, by_text, count_tokens, deletes, inserts, revisions

BYTE_RANKS, WORD_TOKENIZER = byte_ranks(), word_file()

PASSAGE = "a passage of more than fifty bytes that several of the documents of this test have in common, word for word"
TEXTS = [None, "", " ", "one two", "one two", PASSAGE, "x " + PASSAGE, PASSAGE + " y", PASSAGE, "ab" * 60, "ab" * 45, "é" * 70 + "日本" * 20, "wörd " * 400, "Line\nLine\n\nline LINE", "\x1c\x85 odd  spaces", "long " + " ".join(f"w{i}" for i in range(3000)), "ΑΣ Σ İ ſ don't WE'LL 12,5.", "the cc by cc by and GNU General Public License, version 3. All rights reserved"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", 0, 7) for i, t in enumerate(TEXTS)] + [(None, "null id " + PASSAGE, None, None, None, None), (3, "one two", "en", "s0", 1, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts_of(docs):
    return [(r["doc_id"], (r["text"] or "")) for r in docs.collect()]


def plain_repeats(rows, n=50):
    where = {}
    for i, t in rows:
        b, key = t.encode(), float("inf") if i is None else i
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            where[s] = min(where.get(s, float("inf")), key)
    out = []
    for i, t in rows:
        b, key = t.encode(), float("inf") if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if where[b[p : p + n]] < key:
                gone[p : p + n] = b"\1" * n
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_suffix_dedup(docs, empty, block):
    out = suffix_dedup.remove_repeats(docs, block_bytes=block)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect())
    assert got == plain_repeats(texts_of(docs))
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert {"lang", "source", "score"} <= set(out.columns)


def test_suffix_dedup_hot(spark, monkeypatch):
    rows = [(i, f"{i * 7919 % 1000} head {i} " + PASSAGE + f" tail {i * 31 % 97}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs, block_bytes=1000).collect())
    assert got == plain_repeats(rows)


def test_suffix_dedup_addresses(docs, monkeypatch):
    """Blocks send to every bucket, so buckets are few: of 10 GB a block sends each phase some 600 messages."""
    asked = []
    announce = suffix_dedup._announce
    monkeypatch.setattr(suffix_dedup, "n_blocks", lambda *a: 10_000)
    monkeypatch.setattr(suffix_dedup, "_announce", lambda n: asked.append(n) or announce(n))
    suffix_dedup.remove_repeats(docs)
    assert 256 <= asked[0] <= 700


@pytest.mark.parametrize(("part", "hot"), [(1 << 16, 24), (3, 24), (3, 1)])
def test_suffix_dedup_in_parts(monkeypatch, part, hot):
    """A bucket that compares its contexts in parts finds the same stretches."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(i, f"{i * 7919 % 1000} head {i} " + PASSAGE[i % 5 :] + f" tail {i * 31 % 97} " + PASSAGE[: 50 + i % 9].upper()) for i in range(40)]
    tables = [pa.table({"_id": [i for i, _ in rows[b::4]], "_text": [t.encode() for _, t in rows[b::4]], "_block": [b] * 10}) for b in range(4)]

    def to(moves, n):
        every = pa.concat_tables(moves)
        return [every.filter(pa.compute.equal(every["to"], i)) for i in range(n)]

    s, none = suffix_dedup, suffix_dedup._moves([])
    answers = [s._answer(x) if x.num_rows else none for x in to([s._announce(3)(t, none) for t in tables], 3)]
    contexts = to([s._contexts(3)(t, x) for t, x in zip(tables, to(answers, 4))], 3)
    found = to([s._compare(x) if x.num_rows else none for x in contexts], 4)
    got = collections.Counter()
    for t, x in zip(tables, found):
        b, spans = s._block(t, x, anchors=False)
        gone = s._removed(b, spans)
        for i, begin, size in zip(b.doc.tolist(), b.begin.tolist(), b.size.tolist()):
            cut, raw = gone[begin : begin + size], b.buf[begin : begin + size]
            got[i, size, int(cut.sum()), len(re.findall(b"\1+", cut.astype(np.uint8).tobytes())), hashlib.sha256(raw[~cut].tobytes()).hexdigest()] += 1
    assert got == plain_repeats(rows)


def test_suffix_sort_and_collisions(monkeypatch):
    buf = np.frombuffer(b"banana_bandana_banana_" * 5 + b"\xff" * 12, dtype=np.uint8)
    start = np.arange(100)
    group = start % 3
    for broken in (False, True):
        if broken:  # a hash under which all strings are alike
            monkeypatch.setattr(suffix_dedup, "prefix_hashes", lambda b: np.zeros(len(b) + 1, dtype=np.uint64))
        order, same = suffix_dedup.suffix_sort(buf, start, group, 8)
        key = [(group[i], buf[i : i + 8].tobytes()) for i in order]
        assert key == sorted(key)
        assert [bool(s) for s in same] == [False] + [a == b for a, b in zip(key, key[1:])]


def test_hashes_without_tables_of_powers():
    buf = np.random.default_rng(3).integers(0, 256, (1 << 17) + 7).astype(np.uint8)
    h, codes = common.prefix_hashes(buf), common._byte_codes().tolist()
    plain, power = [0], 1
    for x in buf.tolist():
        plain.append((plain[-1] + codes[x] * power) & common._M)
        power = power * common._BASE & common._M
    assert h.tolist() == plain
    at = np.array([0, 1, 65535, 65536, 65537, 131072])
    assert common.back(at).tolist() == [pow(common._BASE_INV, i, 1 << 64) for i in at.tolist()]
    # a large bucket of contexts takes little beside itself, and nothing stays
    rows = np.random.default_rng(4).integers(97, 123, (1 << 16, suffix_dedup.CONTEXT)).astype(np.uint8)
    tracemalloc.start()
    try:
        key = suffix_dedup._hashes(rows, suffix_dedup.SPAN, suffix_dedup.SPAN + suffix_dedup.GRAM)
        now, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(np.unique(key)) == len(rows) and now < 4 << 20 and most < 64 << 20


def test_worker_gives_up_what_earlier_stages_held(monkeypatch):
    stage = [1]
    task = types.SimpleNamespace(get=lambda: types.SimpleNamespace(stageId=lambda: stage[0]))
    monkeypatch.setattr(common, "TaskContext", task, raising=False)
    held = weakref.ref(packing.word_tokenizer(WORD_TOKENIZER))
    assert list(common.slices(iter([]))) == [] and packing.word_tokenizer(WORD_TOKENIZER) is held()
    stage[0] = 2
    assert list(common.slices(iter([]))) == []
    gc.collect()
    assert held() is None


def test_bpe(docs, empty):
    enc = bpe.encoding(BYTE_RANKS, pattern())
    got = collections.Counter(tuple(r) for r in bpe.encode_documents(docs, BYTE_RANKS, pattern()).collect())
    want = [(i, enc.encode_ordinary(t), t) for i, t in texts_of(docs)]
    assert got == collections.Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in want)
    assert bpe.encode_documents(empty, BYTE_RANKS, pattern()).count() == 0
    for t in TEXTS:
        for limit in (1, 7, 50):
            assert bpe.encode(t or "", BYTE_RANKS, pattern(), limit).tolist() == enc.encode_ordinary(t or "")
    assert bpe.decode([255], BYTE_RANKS, pattern()) == enc.decode_bytes([255])


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeiounrstlm"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, 60))
        bad = i % 2
        if bad:
            for j in (5, 20, 40):
                w[j] = "dreadful" if j % 4 else "vileness"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, lab)
    held = [r for r in toxicity.add_score(d, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in held]) > 0.95
    out = toxicity.add_score(docs, model)
    assert out.columns.count("score") == 1 and out.count() == docs.count() and all(0 <= r["score"] <= 1 for r in out.collect())
    none = toxicity.learn(empty, lab)
    assert 0 <= toxicity.score(none, b"") <= 1
    assert toxicity.add_score(empty, model).count() == 0


def test_toxicity_trains_two_dictionaries(monkeypatch):
    """One dictionary is trained on every ordinary text of the sample, the other on words of toxic texts."""
    import zstandard

    seen = []
    train = zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, samples, **kw: seen.append(list(samples)) or train(size, samples, **kw))
    ordinary = [f"ordinary text {i} has {i * 7} words {i * 31}".encode() for i in range(toxicity.SAMPLE_ROWS)]
    toxic = [f"text {i} of {i * 13} is vileness and {i * 17} dreadful {i * 5} so".encode() for i in range(200)]
    model = toxicity.fit(toxic, ordinary)
    assert seen[0] == toxicity.first_copies(ordinary) and len(seen[0]) > 1900
    assert {b" vileness ", b" dreadful "} <= set(seen[1]) and b" ordinary " not in set(seen[1])
    assert b"vileness" in model.toxic and b"vileness" not in model.ordinary


def test_toxicity_score_is_plain(spark):
    """add_score against window lengths, counts and calibration computed one by one; ties and long texts."""
    import zstandard as z

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeiounrstlm"), 5)) for _ in range(300)]
    text = lambda bad, n: " ".join("dreadful vileness" if bad and j % 20 == 5 else rng.choice(words) for j in range(n))
    model = toxicity.fit([text(1, 60).encode() for _ in range(120)], [text(0, 60).encode() for _ in range(300)], (50, 950))
    rows = [(1, text(1, 60)), (2, text(0, 60)), (3, None), (4, ""), (5, text(1, 40000)), (6, "DREADFUL VILENESS"), (7, "dreadful vileness")]
    rows.append((8, rows[0][1]))
    params = z.ZstdCompressionParameters.from_level(toxicity.LEVEL, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
    length = [lambda w, d=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT): len(z.ZstdCompressor(compression_params=params, dict_data=d).compress(w)) for d in (model.ordinary, model.ordinary + model.toxic)]
    got = {r["doc_id"]: r["score"] for r in toxicity.add_score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        b = (t or "").encode().lower()
        if len(b) > 10000:
            assert got[i] == toxicity.score(model, b)
            continue
        d = [length[0](w) - length[1](w) for w in (b[k : k + 40] for k in range(0, max(1, len(b) - 12), 28))]
        hits = [sum(x >= q for x in d) for q in (2, 3, 4, 5)]
        x = [min(max(d), 8), *(np.log1p(h) for h in hits), *(min(1, 20 * h / len(d)) for h in hits), np.log(len(d)), np.mean(np.clip(d, -2, 8))]
        s = sum(w * (v - m) / c for w, v, m, c in zip(model.weights, x, model.mean, model.scale)) + model.weights[-1]
        assert abs(got[i] - 1 / (1 + np.exp(-s))) < 1e-9
    assert got[1] == got[8] and got[6] == got[7] and got[3] == got[4] and got[1] > 0.5 > got[2] and got[5] > 0.5


def test_toxicity_prior(monkeypatch):
    """Equal classes in the sample don't move the scores: the share of all labelled rows does."""
    toxic, ordinary = [b"x y z vile%d" % i for i in range(40)], [b"x y z fine%d" % i for i in range(40)]
    a, b = toxicity.fit(toxic, ordinary, (40, 40)), toxicity.fit(toxic, ordinary, (40, 4000))
    assert abs((a.weights[-1] - b.weights[-1]) - np.log(100)) < 0.02 and a.weights[:-1] == b.weights[:-1]


def test_copies_count_once():
    texts = [f"w{i} " * 3 + " ".join(f"t{i}x{j}" for j in range(30)) for i in range(3)]
    near = texts[0].replace("t0x7", "other")
    assert toxicity.first_copies([x.encode() for x in (texts[0], near, texts[1], texts[0], texts[2], "", "")]) == [x.encode() for x in texts]


def test_fit_holds_no_sample_unpacked(spark):
    """Fitting on long texts needs memory for a few of them only, and eight bytes a shingle; the sample is the same."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeiounrstlm"), 5)) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words, 4000)) + (" dreadful vileness" * 5 if i % 2 else "")) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    toxic, ordinary, n = toxicity.labelled_sample(docs, labels, "toxic", rows=20)
    order = [r[0] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").collect()]
    assert [list(x) for x in (toxic, ordinary)] == [[rows[i][1].encode() for i in order if i % 2 == v][:20] for v in (1, 0)] and n == (30, 30)
    size = sum(len(t) for _, t in rows)
    tracemalloc.start()
    kept = toxicity.first_copies([t.encode() for _, t in rows])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept) == 60 and peak < 6 * size


def test_quality_rules(docs, empty):
    for r in quality_rules.judge(docs).collect():
        t = next(t or "" for i, t in enumerate(TEXTS) if i == r["doc_id"]) if r["doc_id"] is not None else "null id " + PASSAGE
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        count = collections.Counter(windows)
        cover = {k for j, x in enumerate(windows) if count[x] > 1 for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.judge(empty).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.7
    accuracy = [0.95, 0.8, 0.7, 0.9]
    votes = np.column_stack([np.where(rng.random(len(good)) < 0.2, 0, np.where((rng.random(len(good)) < a) == good, 1, -1)) for a in accuracy])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, g, b = quality_rules.em(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.05 and np.abs(g - accuracy).max() < 0.05 and np.abs(b - accuracy).max() < 0.08


def test_quality_classifier(spark, docs, empty):
    rows = [(i, " ".join(f"{'$$$ ' if i % 4 == 0 else ''}word{(i * j) % 97}," for j in range(40)), f"s{i % 4}", "en", "mine") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string")
    lab = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = quality_classifier.judge(d, lab).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in out)
    rate = {r["source"]: r["site_rate"] for r in out}
    assert rate["s0"] < min(rate["s1"], rate["s2"], rate["s3"])
    assert quality_classifier.judge(docs, lab).count() == docs.count()
    assert quality_classifier.judge(empty, lab).count() == 0
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "1 as h", "2 as f", "3 as site_h", "4 as rate", "5 as n", "6 as s")
    assert {tuple(r)[4:10] for r in quality_classifier.judge(odd, lab.limit(0)).collect()} == {(1, 2, 3, 4, 5, 6)}


def test_site_rates(spark):
    """Shrunken rates against beta-binomial sums done one by one: sparse sites, nulls, a site without labels, repeated rows."""
    rng = np.random.default_rng(4)
    rows, lab = [], {}
    for i in range(600):
        h = None if i % 50 == 0 else f"h{min(i % 7, 4)}"
        rows.append((i, h, f"p{i % 3}" if i % 11 else None))
        if i % 3 and h != "h4":
            lab[i] = int(rng.random() < {"h0": 0.2, "h1": 0.9}.get(h, 0.6))
    rows.append(rows[4])
    rates, mean = quality_classifier.site_rates(spark.createDataFrame(rows, "doc_id long, host string, path string"), spark.createDataFrame(list(lab.items()), "doc_id long, quality int"), "host", "path")
    got = {tuple(r)[:3]: r["rate"] for r in rates.collect()}
    n, s = collections.Counter(), collections.Counter()
    for i, h, p in rows:
        if i in lab:
            n[h, p, zlib.crc32(str(i).encode()) % 5] += 1
            s[h, p, zlib.crc32(str(i).encode()) % 5] += lab[i]
    assert abs(mean - (sum(s.values()) + 0.5) / (sum(n.values()) + 1)) < 1e-12

    def strength(groups):  # (n, s, parent)
        groups = [g for g in groups if g[0]]
        total, squares = sum(g[0] for g in groups), sum(g[0] ** 2 for g in groups)
        between = (sum(k * (x / k - m) ** 2 for k, x, m in groups) - (len(groups) - 1) * mean * (1 - mean)) / (total - squares / total)
        return 1e6 if between <= 0 else min(1e6, max(1.0, mean * (1 - mean) / between - 1))

    sums = lambda c, test: sum(v for k, v in c.items() if test(k))
    hosts, sites = {h for _, h, _ in rows}, {(h, p) for _, h, p in rows}
    kh = strength([(sums(n, lambda k: k[0] == h), sums(s, lambda k: k[0] == h), mean) for h in hosts])
    host = {(h, f): (sums(s, lambda k: k[0] == h and k[2] != f) + kh * mean) / (sums(n, lambda k: k[0] == h and k[2] != f) + kh) for h in hosts for f in range(-1, 5)}
    kp = strength([(sums(n, lambda k: k[:2] == x), sums(s, lambda k: k[:2] == x), host[x[0], -1]) for x in sites])
    want = {(*x, f): (sums(s, lambda k: k[:2] == x and k[2] != f) + kp * host[x[0], f]) / (sums(n, lambda k: k[:2] == x and k[2] != f) + kp) for x in sites for f in range(-1, 5)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_media(docs, empty):
    got = collections.Counter()
    for r in media.store_and_read(docs, keep_media=True).collect():
        assert hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"]
        got[(r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"])] += 1
    want = collections.Counter()
    for i, t in texts_of(docs):
        p = media.payload(t.encode())
        assert len(p) % 64 == 0 and p
        want[(i, len(t.encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert got == want
    assert media.store_and_read(empty).count() == 0


def test_media_store(spark, docs, tmp_path):
    """Tables of chunks and lists: chunks are there once, positions are in order, a second load adds only what is new, a missing chunk is noticed."""
    store, dictionary = media.Store(spark, str(tmp_path / "m")), media.train_dictionary(docs)
    store.add(docs, dictionary)
    n = store.chunks().count()
    assert store.chunks().select("digest").distinct().count() == n and dict(store.positions().dtypes)["position"] == "int"
    plain = {r["doc_id"]: r for r in media.store_and_read(docs, dictionary=dictionary, keep_media=True).collect()}
    got = store.read(dictionary, keep_media=True).collect()
    assert len(got) == docs.count() and all(tuple(r) == tuple(plain[r["doc_id"]]) for r in got if r["doc_id"] != 3)
    where = {}
    for r in store.positions().orderBy("block", "row", "position").collect():
        where.setdefault((r["block"], r["row"]), []).append(bytes(r["digest"]))
    want = collections.Counter(tuple(hashlib.sha256(c).digest()[:20] for c in media.chunks(media.wav(media.payload(t.encode())))) for _, t in texts_of(docs))
    assert collections.Counter(map(tuple, where.values())) == want
    store.add(spark.createDataFrame([(90, TEXTS[5]), (91, "new " * 9)], "doc_id long, text string"), dictionary)
    assert store.chunks().count() == n + 1 and store.read(dictionary).count() == docs.count() + 2
    broken = media.deliver(media.list_rows(docs), media.chunk_rows(docs.limit(3), dictionary))
    with pytest.raises(Exception, match="is missing"):
        media.read(broken, dictionary).collect()


def test_chunks_follow_content():
    data = np.random.default_rng(3).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    a, b = media.chunks(data), media.chunks(data[:1000] + b"inserted" + data[1000:])
    assert b"".join(a) == data and max(map(len, a)) <= media.MAX_CHUNK
    assert len(set(a) & set(b)) >= len(a) - 3


def test_token_rollup(spark, docs, tmp_path):
    d = docs.selectExpr("doc_id", "source", "lang", "length(text) as n")
    r = Rollup(spark, str(tmp_path / "r"))
    r.commit(1, inserts(d, "v1", "n"))
    before = {tuple(x) for x in r.totals().collect()}
    r.commit(1, inserts(d, "v1", "n"))
    r.commit(2, revisions(d, "v1", "n", d["n"] + 1), deletes(d.where("source = 's1'"), "v1", d["n"] + 1))
    r.commit(3, inserts(d.where("source = 's1'"), "v1", d["n"]))
    after = {x[:3]: x[3:] for x in map(tuple, r.totals().collect())}
    assert {x[:3]: x[3] for x in before} == {k: v[0] for k, v in after.items()}
    with pytest.raises(ValueError):
        r.commit(3, inserts(d, "v1", "n"))
    assert r.commit(3, inserts(d.where("source = 's1'"), "v1", d["n"])) is False and r.batches() == [1, 2, 3]
    assert {tuple(x) for x in r.compact(2, str(tmp_path / "c")).totals().collect()} == {tuple(x) for x in r.totals().collect()}


def test_rollup_commit_fails_halfway(spark, tmp_path, monkeypatch):
    """A commit that ends before its rename leaves nothing that is read, and can be repeated; an empty rollup has no rows."""
    d = spark.createDataFrame([("a", "en", 3), (None, None, 4)], "source string, lang string, n long")
    r = Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    with monkeypatch.context() as m:
        m.setattr(Rollup, "_files", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            r.commit(1, inserts(d, "v1", "n"))
    assert r.batches() == [] and r.totals().count() == 0
    assert r.commit(1, inserts(d, "v1", "n")) and {tuple(x) for x in r.totals().collect()} == {("a", "en", "v1", 1, 3), (None, None, "v1", 1, 4)}
    assert r.commit(2, inserts(d.where("false"), "v1", "n")) and r.totals().count() == 2


def test_token_rollup_query(spark, docs, empty, tmp_path, monkeypatch):
    """The whole of op7 against counts done one by one: nulls, repeats across sources, null ids, clashing names."""
    from tokenizers import Tokenizer

    from docfacts.llm import queries

    enc, tok = bpe.encoding(BYTE_RANKS, pattern()), Tokenizer.from_file(WORD_TOKENIZER)
    want: dict[tuple, list] = collections.defaultdict(lambda: [0, 0])
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["source"] is not None, r["source"] or ""))
    seen = set()
    for r in rows:
        if r["text"] is not None and r["text"] in seen:
            continue
        seen.add(r["text"])
        t = r["text"] or ""
        for name, n in (("byte_bpe_50k", len(enc.encode_ordinary(t)) + t.count("\n")), ("word_bpe_49k", len(tok.encode(t, add_special_tokens=False).ids))):
            v = want[r["source"], r["lang"], name]
            v[0], v[1] = v[0] + 1, v[1] + n
    monkeypatch.setattr(queries, "table", lambda *_: docs.withColumnsRenamed({"score": "n", "n_chars": "digest"}))
    got = {tuple(r)[:3]: list(tuple(r)[3:]) for r in queries.op7_token_rollup(spark, "").collect()}
    assert got == want
    monkeypatch.setattr(queries, "table", lambda *_: empty)
    assert queries.op7_token_rollup(spark, "").count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_TOKENIZER)
    out = packing.pack_documents(docs, WORD_TOKENIZER, capacity=128, partition_tokens=1024).collect()
    want = collections.Counter()
    for i, t in texts_of(docs):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 128):
            want[(i, k // 128, k, len(ids[k : k + 128]), zlib.crc32(ids[k : k + 128].tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 128
    size, n = np.unique([r["length"] for r in out], return_counts=True)
    assert packing.lower_bound(size, n, 128) <= len(by) <= packing.lower_bound(size, n, 128) + 2
    assert packing.pack_documents(empty, WORD_TOKENIZER).count() == 0


ODD = ["a.", "..", ".,", "a.b.", "12,5. 3.14, x9y", "rock''s 's 't we'll", "<|endoftext|> x", "a<|startoftext|>", "ñandú. ß. é,", "日本. 語,", "Ωmega. ΑΣ", "\x1c\x85 odd x", "e\u0301 x", "x\u00ad.y.", "ab\u200bc.", "ı. 5. $.", "𝒳. . ,", "a_b_. __.", "\u0600 \u10fb. ꙮ,"]


def test_word_tokenizer():
    """Ids by words, with a small cache, are those of the untouched tokenizer; so are those under another kind of file."""
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(WORD_TOKENIZER), packing.WordTokenizer(WORD_TOKENIZER)
    assert own.by_word and tok.encode("<|endoftext|> x", add_special_tokens=False).ids[0] == 49407
    texts = [t or "" for t in TEXTS] + ODD
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == want and [own.encode([t])[0] for t in texts] == want
    own.by_word = False
    assert own.encode(texts) == want


def pieces_of(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")


def test_packing_certified(spark):
    """Pieces of just over half a sequence can't share one: every partition is certified and nothing is handed on."""
    out = packing.pack(pieces_of(spark, [2100] * 3000), partition_tokens=2100 * 300)
    assert packing.certificate(out) == (3000, 3000)
    assert {r[0] >> 58 for r in out.select("sequence_id").collect()} == {0}
    assert out.where("bins <> bound").count() == 0


def test_packing_exchanges_until_nothing_is_gained(spark):
    """Partitions with a gap exchange pieces; the last round has no partition beyond its bound of tokens."""
    rng = np.random.default_rng(8)
    lengths = [int(x) for x in rng.integers(300, 1800, 4000)]
    out = packing.pack(pieces_of(spark, lengths), partition_tokens=4096 * 64).cache()
    n, least = packing.certificate(out)
    assert least <= n <= 1.02 * least and out.count() == 4000
    assert max(r[0] for r in out.groupBy("sequence_id").sum("length").select("sum(length)").collect()) <= 4096
    assert max(r[0] >> 58 for r in out.select("sequence_id").collect()) >= 1


def test_lower_bound_sees_large_items():
    assert packing.lower_bound(np.array([60]), np.array([5]), 100) == 5
    assert packing.lower_bound(np.array([34, 50]), np.array([4, 1]), 100) >= 2


def test_licenses(docs, empty):
    r = {x["doc_id"]: x for x in licenses.scan(docs).collect()}
    x = r[len(TEXTS) - 1]
    assert (x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == (4, 1, 12, "cc-by,gpl,reserved")
    assert "gpl-3.0" in x["labels"].split(",") and 0 <= x["score"] <= 1
    assert r[0]["n_words"] == 0 and r[0]["labels"] == "" and r[0]["first_word"] is None
    assert licenses.scan(empty).count() == 0
    assert len(licenses.rules()) > 250 and all(k in re.sub(r"\\?", "", x) for (_, _, k, _, _), x in zip(licenses.rules(), SIGNATURES.strip().replace("[", "").replace("]", "").split("\n")))


@pytest.mark.parametrize(
    ("text", "labels"),
    [("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("released under the MIT License", "mit"), ("a mit b", ""), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("GNU General Public License, version 3", "gpl,gpl-3.0"), ("the 3-clause BSD license", "bsd-3-clause"), ("SPDX-License-Identifier: MIT", "mit")],
)
def test_license_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == labels


def test_license_texts(spark):
    """The words of a licence's own text are enough; its name need not be there."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    want = [
        (mit + ' "Software")', "mit"),
        (isc + ", provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        (isc + '. THE SOFTWARE IS PROVIDED "AS IS"', "0bsd"),
        (bsd, "bsd"),
        (bsd + " x. Neither the name of x nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd,bsd-3-clause"),
        ("you may not use this file except in compliance with the License.", "apache-2.0"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("permission is granted to use binary forms", ""),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {i: x for i, (_, x) in enumerate(want)}


def plain_scan(text):
    """Every rule by `re` over the words, in order; then containment, one interval against all others."""
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    spaced, found = "".join(f" {w} " for w in words), []
    for rank, label, _, pattern, sure in licenses.rules():
        for m in re.finditer(pattern, spaced):
            found.append((spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, rank, label, sure))
    kept = [x for x in found if not any((y[0] <= x[0] and x[1] <= y[1] and (y[0], y[1]) != (x[0], x[1])) or (y[0], y[1]) == (x[0], x[1]) and y[2] < x[2] for y in found)]
    base = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels = ",".join(sorted({x[3] for x in kept} | {x for _, x in base}))
    places = [i for i, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), labels, max([x[4] for x in kept], default=0.5 if base else 0.0)


def test_license_scan_is_plain(spark):
    """Every column against all rules one by one: ties, overlaps of different labels, repeats, odd spaces, very long texts."""
    rng = np.random.default_rng(9)
    lines = [re.sub(r"\|\S+|[\[\]?]", "", x.split(" ", 2)[2]).replace("19\\d\\d", "1999") for x in SIGNATURES.strip().split("\n")]
    texts = [*lines, "", "The MIT License (MIT)\n\nCopyright (c) 2020 x, all rights reserved", "cc by cc by-sa 4.0 CC-BY", "É all RIGHTS reserved\u00a0x", "mit mit license mit license"]
    texts += [" ".join(str(rng.choice(lines)) + rng.choice([" ", " x ", ". ", " license "]) for _ in range(12)) for _ in range(40)]
    texts.append(" word" * 60000 + " all rights reserved." + " cc by," * 3000 + " released under the MIT license " * 2000)
    got = {r["i"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i long, body string"), "i", "body").collect()}
    for i, t in enumerate(texts):
        r = got[i]
        have = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
        if i < len(texts) - 1:
            assert have == plain_scan(t), t
    assert have[:4] == (60000 + 3 + 6000 + 10000, 3001, 60000, 60003 + 2 * 2999) and have[4:6] == ("cc-by,reserved", "cc-by,mit,reserved")


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return collections.Counter((k, len(s), (least.get(root(i)) if s else k)) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def test_jaccard(docs, empty):
    got = collections.Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect())
    assert got == plain_components(texts_of(docs))
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 8)
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "EXHAUSTIVE", 0.1)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(120):
        w = list(base) if i < 90 else [f"v{x}" for x in rng.integers(0, 5000, 60)]
        for j in rng.choice(len(w), rng.integers(0, 5), replace=False) if i < 90 else ():
            w[j] = f"e{i}-{j}"
        rows.append((int(1000 - i), " ".join(w)))
    got = collections.Counter(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_components(rows)


@pytest.mark.parametrize("sketch", [1, 16])
def test_jaccard_chains(spark, monkeypatch, sketch):
    """Of a, m and c only a~m and m~c link: that a and c were compared alone says nothing about a's group and c."""
    monkeypatch.setattr(jaccard, "SKETCH", sketch)
    monkeypatch.setattr(jaccard, "SKETCH_ROWS", 1)
    rows = []
    for i in range(60):
        m = [f"t{i}w{j}" for j in range(104)]
        a, c = list(m), list(m)
        for j in (10, 30):
            a[j], c[j + 45] = f"a{i}x{j}", f"c{i}x{j}"
        rows += [(3 * i + j, " ".join(w)) for j, w in enumerate((a, m, c))]
    want = plain_components(rows)
    assert len({c for _, _, c in want}) == 60
    assert collections.Counter(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


@pytest.mark.parametrize(("size", "group", "ahead", "sketch"), [(4, 3, 0.1, 1), (64, 32, 1, 1 << 12), (2048, 2, 0.01, 16)])
def test_jaccard_drift(spark, monkeypatch, size, group, ahead, sketch):
    """Texts that drift word by word, with exact copies that level the frequencies: no link is lost, whatever the sizes of lists and groups."""
    for name, value in (("LIST", size), ("GROUP", group), ("EXHAUSTIVE", ahead), ("SKETCH", sketch), ("SKETCH_ROWS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(size)
    rows = []
    for family in range(25):
        w = [f"f{family}w{j}" for j in range(int(rng.integers(20, 90)))]
        for step in range(int(rng.integers(2, 9))):
            for j in rng.choice(len(w), int(rng.integers(0, 1 + len(w) // 30)) + 1, replace=False):
                w[j] = f"f{family}s{step}x{j}"
            rows += [" ".join(w)] * int(rng.integers(1, 4))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]
    want = plain_components(rows)
    assert len({c for _, _, c in want}) > 25
    assert collections.Counter(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_union_bound():
    """A union's bitmap never says less than what any of its members shares, at any size; it tells unlike sets apart."""
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for _ in range(200):
        members = [np.unique(rng.choice(pool, int(rng.integers(1, 300)))) for _ in range(int(rng.integers(1, 6)))]
        q = np.unique(np.concatenate([rng.choice(m, len(m) // 2) for m in members] + [rng.choice(pool, 5)]))
        bound = jaccard.most_shared(len(q), jaccard.sketch_of(q), jaccard.union_of([jaccard.sketch_of(m) for m in members]))
        assert max(len(np.intersect1d(q, m)) for m in members) <= bound <= len(q)
    a, b = (rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(2))
    assert jaccard.most_shared(300, jaccard.sketch_of(a), jaccard.sketch_of(b)) < jaccard.needed(300)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[3] == 1 and got[5] == 4 and got[130] == 100 and 9 not in got
    labels = graph.components(spark.createDataFrame(links, "a long, b long"))
    more = {r["node"]: r["comp"] for r in graph.extend(labels, spark.createDataFrame([(3, 130), (5, 7), (50, 51)], "a long, b long")).collect()}
    assert more[115] == 1 and more[7] == 4 and more[51] == 50 and len(more) == len(got) + 3
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
