"""Weak supervision over quality rules: each rule votes for or against a text or
abstains; expectation-maximisation over the counts of vote patterns estimates each
rule's accuracy and the share of good texts, without labels; the posterior
probability of quality replaces a filter that all rules must pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import Words, slices, windows_of, written

#: The characters that count as symbols (fixed values of the contract).
SYMBOLS = b"#*$%&|<>"
#: Words of a repeat window, and the limits of the base rule.
REPEAT_WORDS = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
START_ACCURACY, START_PRIOR = 0.85, 0.85
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_points", "n_distinct")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _dup_lines(text: bytes) -> tuple[int, int]:
    seen, dup, n = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            n += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return dup, n


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[cuts])


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base features, and some more, of each text."""
    w = Words(texts)
    h = w.hashes()
    buf, cuts = w.buf, w.doc_start
    starts = (buf & 0xC0) != 0x80
    upper = (buf >= 65) & (buf <= 90)
    letters = upper | (buf >= 97) & (buf <= 122)
    n, doc = w.count, w.doc()
    k = REPEAT_WORDS
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) >= k:
        g = windows_of(h, k)
        own = doc[: len(g)] == doc[k - 1 :]
        at = np.flatnonzero(own)
        key = g[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + k, -1)
    repeat = np.cumsum(covered)[:-1] > 0
    by_doc = np.lexsort((h, doc)) if len(h) else np.zeros(0, int)
    new = np.ones(len(h), dtype=bool)
    if len(h) > 1:
        a, b = by_doc[1:], by_doc[:-1]
        new[1:] = (h[a] != h[b]) | (doc[a] != doc[b])
    lines = [_dup_lines(t) for t in texts]
    word_at = np.concatenate([[0], np.cumsum(n)])
    points = (buf == 46) | (buf == 44) | (buf == 33) | (buf == 63)
    return {
        "n_words": n.astype(np.int64), "word_chars": _sums(~w.space & starts, cuts), "n_symbols": _sums(_SYMBOL[buf], cuts),
        "n_dup_lines": np.array([x[0] for x in lines], np.int64), "n_repeat_words": _sums(repeat, word_at), "n_lines": np.array([x[1] for x in lines], np.int64),
        "n_upper": _sums(upper, cuts), "n_letters": _sums(letters, cuts), "n_points": _sums(points, cuts), "n_distinct": _sums(new, word_at),
    }


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of features per row of docs. A null text has no words; repeated rows and null ids stay."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        for batch, texts in slices(it, "text"):
            f = measure(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[c], pa.int64()) for c in _COLUMNS)], names=["id", *_COLUMNS])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in _COLUMNS))
    return out.withColumnRenamed("id", id_col)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> list[tuple[str, Column, Column]]:
    """(name, condition to vote for, condition to vote against); neither: abstain."""
    n, c = F.col("n_words"), F.col
    return [
        ("symbols", c("n_symbols") * 50 < n, c("n_symbols") * 10 > n),
        ("dup_lines", (c("n_lines") >= 3) & (c("n_dup_lines") == 0), c("n_dup_lines") * 10 > c("n_lines") * 3),
        ("repeats", (n >= 20) & (c("n_repeat_words") * 20 < n), c("n_repeat_words") * 10 > n),
        ("word_length", (c("word_chars") > 3 * n) & (c("word_chars") < 9 * n), (c("word_chars") > 14 * n) | (c("word_chars") < 2 * n)),
        ("capitals", (c("n_letters") > 20) & (c("n_upper") * 8 < c("n_letters")), (c("n_letters") > 20) & (c("n_upper") * 2 > c("n_letters"))),
        ("points", (c("n_points") * 50 > n) & (c("n_points") * 3 < n), (n >= 30) & ((c("n_points") * 200 < n) | (c("n_points") * 2 > n * 1))),
        ("variety", (n >= 20) & (c("n_distinct") * 5 > n * 2), (n >= 50) & (c("n_distinct") * 8 < n)),
    ]


def vote_columns() -> list[Column]:
    return [F.when(yes, 1).when(no, -1).otherwise(0).cast("int").alias(f"vote_{name}") for name, yes, no in rules()]


def em(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """The share of good texts and, by rule, the accuracy of a vote on good and on bad texts.

    patterns: one row of votes (1, -1, 0) for each distinct pattern, with its count."""
    r = patterns.shape[1]
    good, bad, prior = np.full(r, START_ACCURACY), np.full(r, START_ACCURACY), START_PRIOR
    yes, no = patterns == 1, patterns == -1
    for _ in range(steps):
        p = posterior(patterns, prior, good, bad)
        a, b = p * counts, (1 - p) * counts
        # Beta priors keep the accuracies better than chance, so that the classes keep their sense
        new = (a.sum() + 8.5) / (counts.sum() + 10), (a @ yes + 17) / (a @ (yes | no) + 20), (b @ no + 17) / (b @ (yes | no) + 20)
        moved = max(abs(new[0] - prior), np.abs(new[1] - good).max(), np.abs(new[2] - bad).max())
        prior, good, bad = new[0], np.clip(new[1], 0.5, 0.999), np.clip(new[2], 0.5, 0.999)
        if moved < 1e-9:
            break
    return prior, good, bad


def posterior(patterns: np.ndarray, prior: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    yes, no = patterns == 1, patterns == -1
    s = np.log(prior / (1 - prior)) + yes @ np.log(good / (1 - bad)) + no @ np.log((1 - good) / bad)
    return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: bool = True) -> DataFrame:
    """Features, votes, base_failed, quality (the posterior) and kept, by row.

    The driver sees only the counts of vote patterns, at most 3 ** 7 of them. A text
    without words is base_failed; an empty table gives an empty result."""
    f = with_features(docs, id_col, text_col)
    voted = f.select("*", *vote_columns())
    if cut:
        voted = written(voted, "votes")
    names = [f"vote_{name}" for name, *_ in rules()]
    found = voted.where(~base_failed()).groupBy(*names).count().collect()
    if found:
        prior, good, bad = em(np.array([r[:-1] for r in found]), np.array([r[-1] for r in found], dtype=float))
    else:
        prior, good, bad = START_PRIOR, np.full(len(names), START_ACCURACY), np.full(len(names), START_ACCURACY)
    s = F.lit(float(np.log(prior / (1 - prior))))
    for name, g, b in zip(names, good.tolist(), bad.tolist()):
        s = s + F.when(F.col(name) == 1, float(np.log(g / (1 - b)))).when(F.col(name) == -1, float(np.log((1 - g) / b))).otherwise(0.0)
    out = voted.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-s)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
