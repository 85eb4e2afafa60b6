"""Hierarchical empirical Bayes: a document classifier's evidence combined with
posteriors of the site (host) and of the path within it.

A site's rate is the share of good ones among its labelled documents, a beta-binomial
posterior: hosts shrink toward the global rate and paths toward their host's, by
strengths that are estimated from grouped counts. Labels of a document's own fold (by
a hash of its id) are left out of the rate that it gets, so no document is its own
evidence. Tables without addresses use other columns: `documents` has a source in place
of the host and a language in place of the path."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docfacts.llm.common import fresh, slices, written
from docfacts.llm.quality_rules import measure
from docfacts.llm.toxicity import SAMPLE_BYTES, SAMPLE_ROWS, labelled_sample, logistic, prior_shift

THRESHOLD = 0.5
#: Parts of the labels; a document's rate leaves its own part out.
FOLDS = 5
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6
OUT = ("p_doc", "site_rate", "quality", "kept")


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def evidence(texts: list[bytes]) -> np.ndarray:
    """What the document classifier sees of each text."""
    f = {k: v.astype(float) for k, v in measure(texts).items()}
    n = np.maximum(f["n_words"], 1)
    letters, lines = np.maximum(f["n_letters"], 1), np.maximum(f["n_lines"], 1)
    x = [
        np.log1p(f["n_words"]), np.minimum(f["n_words"], 10) / 10, f["word_chars"] / n / 6, np.minimum(1, f["n_symbols"] / n), np.minimum(1, 10 * f["n_symbols"] / n),
        f["n_dup_lines"] / lines, f["n_repeat_words"] / n, (f["n_repeat_words"] > 0.2 * n).astype(float), f["n_upper"] / letters, (2 * f["n_upper"] > letters).astype(float), np.minimum(1, f["n_points"] / n), f["n_distinct"] / n,
    ]
    return np.column_stack(x) if len(texts) else np.zeros((0, len(x)))


def fit(good: Sequence[bytes], bad: Sequence[bytes], labelled: tuple[int, int] | None = None) -> Model:
    """A logistic classifier, its prior corrected to the share of good rows among all `labelled` ones (good, bad)."""
    n1, n0 = labelled or (len(good), len(bad))
    x = np.concatenate([evidence(list(texts)) for texts in itertools.batched(itertools.chain(good, bad), 50)] or [evidence([])])
    y = np.array([1.0] * len(good) + [0.0] * len(bad))
    width = evidence([b""]).shape[1]
    if not good or not bad:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model((0.0,) * width, (1.0,) * width, (*(0.0,) * width, math.log(share / (1 - share))))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w = logistic((x - mean) / scale, y)
    w[-1] += prior_shift(y, n1, n0)
    return Model(tuple(mean), tuple(scale), tuple(w))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Model:
    """fit() on a bounded sample of labelled rows: at most `rows` of each class."""
    return fit(*labelled_sample(docs, labels, "quality", rows, max_bytes))


def add_evidence(docs: DataFrame, model: Model, text_col: str = "text", col: str = "p_doc") -> DataFrame:
    """All rows and columns of docs and the document classifier's probability; null text: empty."""
    docs = docs.drop(col)
    names = docs.columns

    def run(it):
        w, mean, scale = np.array(model.weights), np.array(model.mean), np.array(model.scale)
        for batch, texts in slices(it, text_col):
            s = (evidence(texts) - mean) / scale @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))), pa.float64())], names=[*names, col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(col, DoubleType())]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, parent: Column, mean: float) -> float:
    """How many labelled documents of its own a group needs to count as much as its parent: method of moments of a beta-binomial over groups (n, s)."""
    d = F.col("s") / F.col("n") - parent
    g, n, n2, between = groups.where("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * d * d)).first()
    within = mean * (1 - mean)
    if not n or g < 2 or n * n <= n2:
        return MAX_STRENGTH
    between = (between - (g - 1) * within) / (n - n2 / n)
    return MAX_STRENGTH if between <= 0 else min(MAX_STRENGTH, max(MIN_STRENGTH, within / between - 1))


def fold(id_col: str) -> Column:
    """The part of the labels that a row's own is in; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)).cast("int"), F.lit(-1))


def site_rates(docs: DataFrame, labels: DataFrame, host: str, path: str, id_col: str = "doc_id", label: str = "quality") -> tuple[DataFrame, float]:
    """(h, p, f, rate) for each host, path and fold: the posterior rate of the path without the labels of that fold; and the global rate.

    No text is read. Counts are taken by (host, path, fold) first, combined on the map
    side, so a hot host costs a few rows for each task; all else comes from those."""
    site = docs.select(F.col(id_col).alias("id"), F.col(host).alias("h"), F.col(path).alias("p"), fold(id_col).alias("f"))
    good = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("long").alias("y"))
    counts = written(site.join(good, "id").groupBy("h", "p", "f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")), "labelled")
    sites = site.select("h", "p").groupBy("h", "p").agg(F.lit(1).alias("one"))
    n, s = counts.agg(F.sum("n"), F.sum("s")).first()
    mean = ((s or 0) + 0.5) / ((n or 0) + 1)
    k_host = _strength(counts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), F.lit(mean), mean)
    # for each fold what the other folds have; a fold of a host without labels is what the whole host has
    folds = F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1)))
    whole = counts.groupBy("h", "p").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.map_from_arrays(F.collect_list("f"), F.collect_list(F.struct("n", "s"))).alias("by"))
    own = F.col("by")[F.col("f")]
    less = sites.select(F.col("h").alias("h0"), F.col("p").alias("p0")).join(whole, F.col("h0").eqNullSafe(F.col("h")) & F.col("p0").eqNullSafe(F.col("p")), "left")
    less = less.select(F.col("h0").alias("h"), F.col("p0").alias("p"), "n", "s", "by", folds.alias("f"))
    less = less.select("h", "p", "f", *((F.coalesce(c, F.lit(0)) - F.when(F.col("f") < 0, F.lit(0)).otherwise(F.coalesce(own[c], F.lit(0)))).alias(c) for c in ("n", "s")))
    less = written(less, "others")
    hosts = less.groupBy(F.col("h").alias("h1"), F.col("f").alias("f1")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    hosts = hosts.select("h1", "f1", ((F.col("hs") + k_host * mean) / (F.col("hn") + k_host)).alias("host_rate"))
    both = written(less.join(hosts, F.col("h").eqNullSafe(F.col("h1")) & (F.col("f") == F.col("f1"))).select("h", "p", "f", "n", "s", "host_rate"), "hosts")
    k_path = _strength(both.where("f = -1"), F.col("host_rate"), mean)
    return both.select("h", "p", "f", ((F.col("s") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("rate")), mean


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text_col: str = "text", id_col: str = "doc_id", model: Model | None = None, out: tuple[str, str, str, str] = OUT, train: DataFrame | None = None) -> DataFrame:
    """All rows and columns of docs, with the columns `out`: the document classifier's
    probability, the site's rate, the posterior and whether it is kept.

    Posterior odds are the document's odds times the site's odds over the global odds.
    Null hosts or paths are groups of their own; a null text is the empty text; a row
    with a null id leaves no label out; without labels all rates are one half; an empty
    table stays empty. Columns of docs that are named like `out` are replaced; no other
    names are in the way. Texts are read once, and joined rows carry no text unless docs
    asks for it. train: the documents whose labels are learned from, where not docs."""
    docs = docs.drop(*out)
    train = docs if train is None else train
    model = model or learn(train, labels)
    rates, mean = site_rates(train.select(id_col, host, path), labels, host, path, id_col)
    h, p, f, rate, own = (fresh(docs.columns, x) for x in ("site_h", "site_p", "site_f", "site_r", "site_own"))
    rates = written(rates.select(F.col("h").alias(h), F.col("p").alias(p), F.col("f").alias(f), F.col("rate").alias(rate)), "site")
    scored = add_evidence(docs, model, text_col, out[0]).withColumn(own, fold(id_col))
    joined = scored.join(rates, F.col(host).eqNullSafe(F.col(h)) & F.col(path).eqNullSafe(F.col(p)) & (F.col(own) == F.col(f)), "left")
    joined = joined.select(*docs.columns, out[0], F.coalesce(F.col(rate), F.lit(mean)).alias(out[1]))
    s = _logit(F.col(out[0])) + _logit(F.col(out[1])) - math.log(mean / (1 - mean))
    return joined.withColumn(out[2], 1 / (1 + F.exp(-s))).withColumn(out[3], F.col(out[2]) >= THRESHOLD)
