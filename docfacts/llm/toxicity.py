"""Compression-distance classification of toxic text.

Two zstandard dictionaries are trained on a bounded sample of labelled rows: one on
ordinary texts, one on toxic texts. As most of a toxic text is ordinary language, the
toxic dictionary is trained on those of its words that ordinary texts show
significantly less often, and has the ordinary dictionary before it, so that ordinary
words cost the same under both. Every window of a text is compressed with both: a
window that is shorter under the toxic dictionary is evidence. Thresholds on the
differences turn windows into counts, and a logistic calibration turns those into a
score. It is fitted across parts of the sample, each part measured with a dictionary
of the others, and corrected for the share of toxic rows among all labelled ones."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docfacts.llm.common import LOWER, Packed, Words, kept_for_stage, slices, windows_of, written

#: The fit reads at most so many labelled rows of each class (chosen by a hash of
#: their id), each of at most so many bytes.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 1 << 15
#: The driver fetches the sample in so many parts.
SAMPLE_FILES = 16
WINDOW, STEP = 40, 28
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
#: A word tells a class if the likelihood ratio of it, or of its first bytes, is this much in favour.
MIN_RATIO, PREFIXES = 16.0, (5, 8, 12)
#: A text of the sample with this part of its shingles in texts before it is a copy and counts no more.
COPY = 0.5
#: Shingles are looked for among those of other texts in so many parts.
SHINGLE_PARTS = 16
THRESHOLDS = (2, 3, 4, 5)
#: The calibration measures each of so many parts of the sample with a dictionary of the others.
PARTS = 4
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


@kept_for_stage
def _compressor(content: bytes):
    import zstandard as z

    params = z.ZstdCompressionParameters.from_level(LEVEL, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
    return z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT))


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows over the whole text; at least one, also of an empty text."""
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STEP)), STEP)]


def differences(model: Model, text: bytes) -> np.ndarray:
    """Bytes that each window saves under the toxic dictionary against the ordinary one."""
    toxic, ordinary = _compressor(model.ordinary + model.toxic).compress, _compressor(model.ordinary).compress
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text.translate(LOWER))], dtype=np.int64)


def features(model: Model, text: bytes) -> list[float]:
    d = differences(model, text)
    hits = [float((d >= t).sum()) for t in THRESHOLDS]
    n = len(d)
    return [float(min(d.max(), 8)), *(math.log1p(h) for h in hits), *(min(1.0, 20 * h / n) for h in hits), math.log(n), float(np.clip(d, -2, 8).mean())]


def _first_copies(texts: Iterable[bytes]) -> list[int]:
    """Which texts are not, mostly, copies of texts before them. Eight bytes are held for each shingle, which are compared in parts."""
    size, parts = [], [([], []) for _ in range(SHINGLE_PARTS)]
    for i, t in enumerate(texts):
        w = Words([t], lower=True).hashes()
        g = np.unique(windows_of(w, min(5, max(1, len(w)))) if len(w) else w)
        size.append(len(g))
        to = g % np.uint64(SHINGLE_PARTS)
        for k, (hashes, counts) in enumerate(parts):
            hashes.append(g[to == k])
            counts.append(len(hashes[-1]))
    new = np.zeros(len(size), dtype=np.int64)
    for hashes, counts in parts:
        if hashes:
            _, first = np.unique(np.concatenate(hashes), return_index=True)
            new += np.bincount(np.repeat(np.arange(len(size)), counts)[first], minlength=len(size))
    out: list[int] = []
    for i, (n, k) in enumerate(zip(size, new.tolist())):
        if n - k <= COPY * n if n else not out:
            out.append(i)
    return out


def first_copies(texts: Sequence[bytes]) -> list[bytes]:
    """texts without those that are, mostly, copies of texts before them."""
    return [texts[i] for i in _first_copies(texts)]


def _keys(word: bytes) -> set[int]:
    """Numbers of the word and its beginnings."""
    return {hash(word[:n]) for n in PREFIXES}


def _numbers(texts: Sequence[bytes]) -> list[np.ndarray]:
    """The numbers of the words and beginnings of words of each text, each once."""
    return [np.array(sorted(set().union(*map(_keys, set(_WORD.findall(t))))), dtype=np.int64) for t in texts]


def _telling(own: list[np.ndarray], other: list[np.ndarray]) -> set[int]:
    """The numbers that are in significantly more of `own` texts than of `other` (likelihood ratio of two shares)."""
    if not own:
        return set()
    a, k = np.unique(np.concatenate(own), return_counts=True)
    b, n = np.unique(np.concatenate([*other, np.zeros(0, np.int64)]), return_counts=True)
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    m = np.where(b[at] == a, n[at], 0) if len(b) else np.zeros(len(a), np.int64)
    share = len(own) / (len(own) + len(other))
    e, f = (k + m) * share, (k + m) * (1 - share)
    ratio = 2 * (k * np.log(k / e) + m * np.log(np.maximum(m, 1) / np.maximum(f, 1e-9)))
    return set(a[(k > e) & (ratio >= MIN_RATIO)].tolist())


def _train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A dictionary's content by zstandard's trainer; the samples themselves where they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=k, d=d, split_point=1.0, level=LEVEL).as_bytes()[-size:]
    except z.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size] or b" "


def train_ordinary(ordinary: Sequence[bytes]) -> bytes:
    return _train([t[i : i + 512] for t in ordinary for i in range(0, len(t), 512)], ORDINARY_BYTES, 64, 8)


def train_toxic(toxic: Sequence[bytes], telling: set[int]) -> bytes:
    """Trained on toxic texts: on each occurrence of a word that tells them from ordinary ones."""
    return _train([b" " + w + b" " for t in toxic for w in _WORD.findall(t) if not telling.isdisjoint(_keys(w))], TOXIC_BYTES, 32, 6)


def fit(toxic: Sequence[bytes], ordinary: Sequence[bytes], labelled: tuple[int, int] | None = None) -> Model:
    """Train both dictionaries and calibrate; labelled: how many rows of each class there are in all.

    With a class missing, every score is the other class's share. The sample may have
    128 MB: texts are kept compressed and read one by one."""
    n1, n0 = labelled or (len(toxic), len(ordinary))
    toxic, ordinary = (Packed(t.translate(LOWER) for t in texts) for texts in (toxic, ordinary))
    toxic, ordinary = toxic.at(_first_copies(toxic)), ordinary.at(_first_copies(ordinary))
    a, b = _numbers(toxic), _numbers(ordinary)
    model = Model(train_ordinary(ordinary), train_toxic(toxic, _telling(a, b)), (), (), ())
    # the texts that trained a dictionary would flatter it: each part is measured with one of the other parts
    rows, y = [], []
    for part in range(PARTS):
        others = toxic.at([i for i in range(len(toxic)) if i % PARTS != part])
        own_words, other_words = ([x for i, x in enumerate(every) if i % PARTS != part] for every in (a, b))
        own = Model(model.ordinary, train_toxic(others, _telling(own_words, other_words)), (), (), ())
        for label, texts in ((1, toxic[part::PARTS]), (0, ordinary[part::PARTS])):
            rows += [features(own, t) for t in texts]
            y += [label] * len(texts)
    y = np.array(y, dtype=float)
    if not len(y) or y.min() == y.max():
        share = (n1 + 0.5) / (n1 + n0 + 1)
        width = len(features(model, b""))
        return Model(model.ordinary, model.toxic, (0.0,) * width, (1.0,) * width, (*((0.0,) * width), math.log(share / (1 - share))))
    x = np.array(rows, dtype=float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w = logistic((x - mean) / scale, y)
    w[-1] += prior_shift(y, n1, n0)
    return Model(model.ordinary, model.toxic, tuple(mean), tuple(scale), tuple(w))


def prior_shift(y: np.ndarray, n1: int, n0: int) -> float:
    """What the intercept of a fit on labels y lacks where n1 and n0 rows of the classes are labelled in all."""
    return math.log((n1 + 0.5) / (n0 + 0.5)) - math.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and, last, the intercept of a ridge-penalised logistic regression (Newton's method)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(model: Model, text: bytes) -> float:
    f = (np.array(features(model, text)) - model.mean) / model.scale
    s = float(f @ np.array(model.weights[:-1]) + model.weights[-1])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", where=None) -> tuple[Packed, Packed, tuple[int, int]]:
    """Texts of label 1 and of label 0, at most `rows` each, chosen by a hash of the id; and how many ids have each label.

    Only the ids chosen, so bounded a number, are broadcast; held-out ids can be
    excluded by `where`, a condition on id_col. Rows with a null id or label, or
    longer than max_bytes, are not drawn; of rows that share an id all are. The texts
    go through a written table, of which the driver fetches one part at a time."""
    named = labels.select(F.col(id_col), F.col(label).alias("_label")).where(f"{id_col} is not null and _label in (0, 1)")
    if where is not None:
        named = named.where(where)
    named = named.groupBy(id_col).agg(F.max("_label").alias("_label"))
    ids = [named.where(F.col("_label") == v).select(id_col, "_label").orderBy(F.xxhash64(id_col), id_col).limit(rows) for v in (1, 0)]
    n = {r[0]: r[1] for r in named.groupBy("_label").count().collect()}
    drawn = docs.select(id_col, text_col).where(F.octet_length(text_col) <= max_bytes).join(F.broadcast(ids[0].union(ids[1])), id_col)
    drawn = written(drawn.select("_label", F.encode(text_col, "UTF-8").alias("_text"), F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_id")).repartition(SAMPLE_FILES), "sample")
    key, packed = [], Packed()
    for r in drawn.toLocalIterator():
        text = bytes(r[1])
        key.append((r[2], r[3], hashlib.md5(text).digest(), r[0]))
        packed.append(text)
    order = sorted(range(len(key)), key=key.__getitem__)
    return *(packed.at([i for i in order if key[i][3] == v]) for v in (1, 0)), (n.get(1, 0), n.get(0, 0))


def learn(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    """fit() on labelled rows whose crc32(id as text) mod 5 is not 0."""
    return fit(*labelled_sample(docs, labels, "toxic", where=F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0, **kw))


def add_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs, and a score from 0 to 1, higher where toxic.

    A null text is scored as the empty text; equal texts get equal scores; a column
    that is already called score_col is replaced."""
    docs = docs.drop(score_col)
    names = docs.columns

    def run(it):
        known: dict[bytes, float] = {}
        for batch, texts in slices(it, text_col):
            if len(known) > 1000:
                known.clear()
            out = []
            for t in texts:
                s = known.get(t)
                if s is None:
                    s = score(model, t)
                    if len(t) < 4096:
                        known[t] = s
                out.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
