"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes its lower-case words, each between two spaces of its own. A keyword
gate keeps most texts from the rules; behind it, only rules whose keyword is there
are matched. Detections are word intervals; one inside another is suppressed, and of
equal intervals the rule that comes first stands."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.llm.license_rules import SIGNATURES

#: Fixed values of the contract: phrases whose places are always counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Intervals that one fold of the suppression takes.
BLOCK = 64
_BEGIN, _END = "\x01", "\x02"
_GAP = r"[\x00-/:-`{-\x7F]+"
def _pattern(words: str) -> str:
    """The regular expression of words that each stand between two spaces."""
    out = ""
    for w in words.split():
        must, alternatives = not w.endswith("?"), w.rstrip("?").split("|")
        one = f" {alternatives[0]} " if len(alternatives) == 1 else "(?:" + "|".join(f" {a} " for a in alternatives) + ")"
        out += one if must else f"(?:{one})?"
    return out


@functools.lru_cache(maxsize=1)
def rules() -> list[tuple[int, str, str, str, float]]:
    """(rank, label, keyword, pattern, confidence) of every signature, in order of priority."""
    out = []
    for rank, line in enumerate(SIGNATURES.strip().split("\n")):
        label, sure, words = line.split(" ", 2)
        keyword = re.search(r"\[(.*)\]", words)[1]
        out.append((rank, label, keyword, _pattern(words.replace("[", "").replace("]", "")), float(sure)))
    return out


def _trie(words: list[str]) -> str:
    """A pattern for any of the words that tries each beginning once."""
    if "" in words:
        return ""
    firsts = sorted({w[0] for w in words})
    parts = [re.escape(c) + _trie([w[1:] for w in words if w[0] == c]) for c in firsts]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def gate() -> str:
    """A pattern for texts that have the keyword of any rule or a base phrase, at the beginning of a word."""
    return "(?:^| )" + _trie(sorted({k for _, _, k, _, _ in rules()} | {p for p, _ in BASE}))


def normal_words(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case, a space between each two."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, _GAP, " "))


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _intervals(spaced: Column, pattern: Column) -> Column:
    """Start and end (excluded) word of each match, in steps as many as there are words.

    A mark goes before and after each match; of the words and marks in order, the k-th
    match has 2 k marks before its first and one more before its last."""
    marked = F.split(F.regexp_replace(spaced, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f" {_BEGIN} $1 {_END} ")), " +")
    # places of all marks, a begin and an end by turns; the empty string before the first space counts as a word
    places = F.filter(F.transform(marked, lambda w, i: F.when(w.isin(_BEGIN, _END), i - 1)), lambda i: i.isNotNull())
    # an expression in a lambda is computed anew for each element, a variable isn't
    each = F.flatten(F.transform(F.array(places), lambda m: F.transform(F.sequence(F.lit(0), F.size(m) - 2, F.lit(2)), lambda k: F.struct((F.get(m, k) - k).cast("long").alias("s"), (F.get(m, k + 1) - k - 1).cast("long").alias("e")))))
    return F.when(F.rlike(spaced, pattern), each).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def _uncontained(ordered: Column, kind: str) -> Column:
    """Of intervals by start, the longest first, those that reach beyond all before them; block by block, as appending copies what there is."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / BLOCK).cast("int")), lambda b: F.slice(ordered, b * BLOCK + 1, F.lit(BLOCK)))
    reach = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: -x["back"])))
    before = F.flatten(F.transform(F.array(reach), lambda r: F.transform(r, lambda _, i: F.coalesce(F.array_max(F.slice(r, F.lit(1), i)), F.lit(-1).cast("long")))))
    kept = F.transform(
        F.arrays_zip(blocks.alias("b"), before.alias("r")),
        lambda x: F.aggregate(
            x["b"],
            F.struct(F.array().cast(kind).alias("out"), x["r"].alias("reach")),
            lambda acc, y: F.when(-y["back"] > acc["reach"], F.struct(F.array_append(acc["out"], F.struct(y["s"].alias("s"), (-y["back"]).alias("e"), y["rank"].alias("rank"), y["label"].alias("label"), y["sure"].alias("sure"))).alias("out"), (-y["back"]).alias("reach"))).otherwise(acc),
            lambda acc: acc["out"],
        ),
    )
    return F.flatten(kept)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    A null or empty text has no words, no labels and score 0. Rows are judged alone:
    repeated rows, null ids, empty tables and other columns make no difference."""
    kind = "array<struct<s:bigint,e:bigint,rank:int,label:string,sure:double>>"
    table = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(label).alias("label"), F.lit(k).alias("key"), F.lit(p).alias("pattern"), F.lit(s).alias("sure")) for i, label, k, p, s in rules()))
    w = docs.select(docs[id_col].alias("id"), normal_words(docs[text_col]).alias("w"))
    w = w.select("id", "w", F.when(F.col("w") == "", 0).otherwise(_spaces(F.col("w")) + 1).cast("long").alias("n_words"), F.col("w").rlike(gate()).alias("gated"))
    w = w.withColumn("t", F.when(F.col("gated"), F.concat(F.lit(" "), F.replace("w", F.lit(" "), F.lit("  ")), F.lit(" "))))
    empty = F.array().cast(kind)
    found = F.flatten(F.transform(F.filter(table, lambda r: F.contains(F.col("w"), r["key"])), lambda r: F.transform(_intervals(F.col("t"), r["pattern"]), lambda x: F.struct(x["s"], x["e"], r["rank"].alias("rank"), r["label"].alias("label"), r["sure"].alias("sure")))))
    base = [(label, F.when(F.col("gated") & F.contains(F.col("w"), F.lit(p)), F.transform(_intervals(F.col("t"), F.lit(_pattern(p))), lambda x: x["s"])).otherwise(F.array().cast("array<bigint>"))) for p, label in BASE]
    w = w.select("id", "n_words", F.when(F.col("gated"), found).otherwise(empty).cast(kind).alias("found"), *(c.alias(f"b{i}") for i, (_, c) in enumerate(base)))
    ordered = F.array_sort(F.transform("found", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), x["rank"].alias("rank"), x["label"].alias("label"), x["sure"].alias("sure"))))
    kept = _uncontained(ordered, kind)
    places = F.concat(*(F.col(f"b{i}") for i in range(len(BASE))))
    own = F.filter(F.array(*(F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE))), lambda x: x.isNotNull())
    w = w.select("id", "n_words", F.when(F.size("found") > 0, kept).otherwise(empty).cast(kind).alias("detections"), places.alias("places"), own.alias("own"))
    return w.select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("own", F.transform("detections", lambda x: x["label"])))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["sure"])), F.when(F.size("places") > 0, 0.5), F.lit(0.0)).alias("score"), "detections",
    )
