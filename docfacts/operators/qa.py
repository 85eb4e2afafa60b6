"""Extractive question answering: data sets, windows, decoding, scoring and calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docfacts.functions.text import answer_tokens, contains_norm, doc_of, spans, tag_of, tokens_f1, trivial_answer

MAX_TOKENS, OVERLAP, CONTEXT_CHARS, BEST, MAX_ANSWER = 384, 128, 16000, 20, 40
ACCEPT_ALL = -1e9
#: Questions asked about an evidence feature.
THEMES = {
    "wind_farm": "¿Qué tipo de proyecto se evalúa?", "solar_pv": "¿Qué tipo de proyecto se evalúa?", "power_line": "¿Qué tipo de proyecto se evalúa?", "conducted_surveys": "¿Qué trabajo de campo se realizó?",
    "reported_effort": "¿Cuál fue el esfuerzo de muestreo?", "monitoring_plan": "¿Qué plan de vigilancia se establece?", "seasonal_coverage": "¿Qué cobertura estacional tiene el estudio?",
    "species_from_catalogue": "¿De qué catálogo proceden las especies citadas?", "protected_area": "¿Qué espacio protegido se menciona?",
}
SPECIES_QUESTION, PLACE_QUESTION = "¿Qué especie se menciona en el documento?", "¿Qué localidad se menciona en el documento?"


# examples


def example(qid: Column, question: Column, context: Column, answer: Column | None = None, start: Column | None = None) -> list[Column]:
    """The columns of one example; without an answer it is impossible."""
    if answer is None:
        answers = F.struct(F.array().cast("array<string>").alias("text"), F.array().cast("array<int>").alias("answer_start"))
    else:
        answers = F.struct(F.array(answer).alias("text"), F.array(start.cast("int")).alias("answer_start"))
    return [qid.alias("id"), question.alias("question"), context.alias("context"), answers.alias("answers"), F.lit(answer is None).alias("is_impossible")]


def from_evidence(cache: DataFrame, themes: dict[str, str] = THEMES) -> DataFrame:
    """One example for each themed feature with a placed first mention; cache: (id, text, features map)."""
    rows = cache.select(F.col("id").cast("string").alias("d"), "text", F.explode("features").alias("feature", "spans"))
    q = F.create_map(*(F.lit(x) for kv in themes.items() for x in kv))[F.col("feature")]
    rows = rows.withColumn("q", q).withColumn("m", F.get("spans", F.lit(0))).where("q is not null and m.start is not null and m.end is not null")
    return rows.select(*example(F.concat_ws("::", "d", "feature"), F.col("q"), F.col("text"), F.substring(F.col("text"), F.col("m.start") + 1, F.col("m.end") - F.col("m.start")), F.col("m.start")))


def from_reports(docs: DataFrame, species: DataFrame, locations: DataFrame, id_col: str = "_id") -> DataFrame:
    """One example from the first placed mention of the top species, and one from the top location's first mention."""
    d = docs.select(F.col(id_col).alias("d"), "text")
    s = species.select(F.col(id_col).alias("d"), F.get(F.filter(F.get("species", F.lit(0))["mentions"], lambda m: m["start"].isNotNull()), F.lit(0)).alias("m")).where("m is not null")
    p = locations.select(F.col(id_col).alias("d"), F.get(F.get("locations", F.lit(0))["mentions"], F.lit(0)).alias("m")).where("m is not null")
    one = lambda rows, tag, question: d.join(rows, "d").select(*example(F.concat(F.col("d").cast("string"), F.lit(f"::{tag}")), F.lit(question), F.col("text"), F.col("m.text"), F.col("m.start")))
    return one(s, "sp", SPECIES_QUESTION).unionByName(one(p, "loc", PLACE_QUESTION))


def ask_teacher(docs: DataFrame, questions: list[str], load: Callable[[], Callable[[str, list[str]], str]], done: DataFrame | None = None, context_chars: int = CONTEXT_CHARS, id_col: str = "_id") -> DataFrame:
    """(doc, reply): raw replies of a teacher, one request per document not done yet; a failing request gives an empty reply."""
    kind = docs.schema[id_col].dataType.simpleString()
    todo = docs.select(F.col(id_col).alias("doc"), F.substring(F.coalesce("text", F.lit("")), 1, context_chars).alias("text"))
    if done is not None:
        todo = todo.join(done.select("doc"), "doc", "left_anti")

    def run(it):
        teacher = load()
        for pdf in it:
            out = []
            for t in pdf["text"]:
                try:
                    out.append(teacher(t, questions))
                except Exception:  # noqa: BLE001 - any failure of the service counts as no answer
                    out.append("")
            yield pdf[["doc"]].assign(reply=out)

    return todo.mapInPandas(run, f"doc {kind}, reply string")


def from_teacher(docs: DataFrame, replies: DataFrame, questions: list[str], id_col: str = "_id") -> DataFrame:
    """One example per document and question; an answer that isn't literally in the text is none."""
    from docfacts.functions.text import parse_reply, reply_span

    r = docs.select(F.col(id_col).alias("doc"), "text").join(replies, "doc").withColumn("m", parse_reply(F.col("reply")))
    q = F.posexplode(F.array(*map(F.lit, questions))).alias("i", "question")
    r = r.select("doc", "text", "m", q).withColumn("s", reply_span(F.col("m")[F.col("i").cast("string")], F.col("text")))
    qid = F.concat(F.col("doc").cast("string"), F.lit("::t"), F.col("i").cast("string"))
    return r.where("s is not null").select(*example(qid, F.col("question"), F.col("text"), F.col("s.answer"), F.col("s.start"))).unionByName(r.where("s is null").select(*example(qid, F.col("question"), F.col("text"))))


def split_documents(examples: DataFrame, share: float = 0.1, seed: str = "0") -> DataFrame:
    """All rows and is_dev: the documents first in a hash order, floor(share * documents) of them, are development.

    The rank goes over distinct documents only, by counts of hash ranges and ranks
    within them, so no task orders all documents."""
    docs = examples.select(doc_of(F.col("id")).alias("_d")).distinct().withColumn("_h", F.md5(F.concat("_d", F.lit(seed)))).withColumn("_r", F.substring("_h", 1, 4))
    ranked = rank_within(docs, "_r", ["_h", "_d"])
    n = docs.agg(F.floor(F.count(F.lit(1)) * share).alias("_n"))
    dev = ranked.join(F.broadcast(n)).select("_d", (F.col("rank") <= F.col("_n")).alias("is_dev"))
    return examples.withColumn("_d", doc_of(F.col("id"))).join(dev, "_d").drop("_d")


def rank_within(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """rank from 1 over all rows in the order of (part, *order): row numbers within parts, and the counts before them.

    part must have a bounded number of values (here: 65,536 prefixes of a hash)."""
    counts = rows.groupBy(part).count()
    before = counts.withColumn("_b", F.coalesce(F.sum("count").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col(part).alias("_p"), "_b")
    own = rows.withColumn("_k", F.row_number().over(W.partitionBy(part).orderBy(*order)))
    return own.join(F.broadcast(before), own[part] == before["_p"]).withColumn("rank", F.col("_k") + F.col("_b")).drop("_k", "_b", "_p")


def downsample_negatives(rows: DataFrame, positive: str, ratio: float, key: list[str]) -> DataFrame:
    """All positive rows and floor(ratio * positives) negative ones, first in a hash order of their key."""
    neg = rows.where(~F.col(positive)).withColumn("_h", F.md5(F.concat_ws("|", *key))).withColumn("_r", F.substring("_h", 1, 4))
    n = rows.agg(F.floor(F.count_if(positive) * ratio).alias("_n"))
    kept = rank_within(neg, "_r", ["_h", *key]).join(F.broadcast(n)).where("rank <= _n").select(*rows.columns)
    return rows.where(positive).unionByName(kept)


def assemble(*sources: DataFrame, share: float = 0.1, seed: str = "0", negatives: float | None = None) -> DataFrame:
    """The data set: examples of all sources, with is_dev by document.

    negatives: how many impossible examples of the training part are kept for each
    possible one; None: all. Nothing is collected."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    rows = split_documents(rows, share, seed)
    if negatives is None:
        return rows
    train = downsample_negatives(rows.where("not is_dev").withColumn("_yes", ~F.col("is_impossible")), "_yes", negatives, ["id", "question"]).drop("_yes")
    return train.unionByName(rows.where("is_dev"))


def dataset_counts(rows: DataFrame) -> DataFrame:
    """(part, n_examples, n_impossible, n_documents) of the training and the development part."""
    part = F.when(F.col("is_dev"), "dev").otherwise("train").alias("part")
    return rows.select(part, "is_impossible", doc_of(F.col("id")).alias("d")).groupBy("part").agg(F.count(F.lit(1)).alias("n_examples"), F.count_if("is_impossible").alias("n_impossible"), F.count_distinct("d").alias("n_documents"))


# windows


def cap_context(examples: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """Contexts of at most `chars` characters: their beginning or, if the answer lies beyond, around the answer (a rule of the data set)."""
    s, a = F.get("answers.answer_start", F.lit(0)), F.get("answers.text", F.lit(0))
    lo = F.when(s.isNull() | (s + F.length(a) <= chars), 0).otherwise(F.greatest(F.lit(0), s - chars // 2))
    moved = F.struct(F.col("answers.text").alias("text"), F.transform("answers.answer_start", lambda x: (x - F.col("_lo")).cast("int")).alias("answer_start"))
    return examples.withColumn("_lo", lo).withColumn("context", F.substring(F.col("context"), F.col("_lo") + 1, F.lit(chars))).withColumn("answers", moved).drop("_lo")


def windows(rows: DataFrame, text_col: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, reserved: Column | int = 0, token: str = r"(?U)\S+") -> DataFrame:
    """All columns of rows and w, first, tokens: overlapping windows over all tokens (array<struct<text,start,end>>).

    reserved: tokens of the window that the question takes. The pre-tokeniser is a
    pattern; windows end where one reaches the last token."""
    room = F.greatest(F.lit(max_tokens) - (F.lit(reserved) if isinstance(reserved, int) else reserved), F.lit(overlap + 1))
    t = rows.withColumn("_t", spans(F.coalesce(F.col(text_col), F.lit("")), token)).withColumn("_room", room).withColumn("_step", F.col("_room") - overlap)
    count = F.greatest(F.lit(1), F.ceil((F.size("_t") - overlap) / F.col("_step"))).cast("int")
    t = t.withColumn("w", F.explode(F.sequence(F.lit(0), count - 1)))
    first = (F.col("w") * F.col("_step")).cast("int")
    return t.withColumn("first", first).withColumn("tokens", F.slice("_t", F.col("first") + 1, F.col("_room").cast("int"))).drop("_t", "_room", "_step")


def answer_tokens_in(tokens: Column, start: Column, end: Column) -> Column:
    """struct(first, last): the tokens, from 1 in the window, that cover characters start to end; (0, 0) where the window doesn't hold them."""
    n = F.size(tokens)
    inside = (n > 0) & (F.get(tokens, F.lit(0))["start"] <= start) & (F.get(tokens, n - 1)["end"] >= end)
    first = F.size(F.filter(tokens, lambda x: x["start"] <= start))
    last = n - F.size(F.filter(tokens, lambda x: x["end"] >= end)) + 1
    return F.when(inside, F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))).otherwise(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last")))


# decoding


def best_spans(scored: DataFrame, keys: list[str], best: int = BEST, longest: int = MAX_ANSWER) -> DataFrame:
    """keys, score, no_answer, w, si, ei: the best span over the windows of each question.

    scored: keys, w, start_logits, end_logits (arrays by token; place 0 is no answer).
    Only the `best` starts and ends of each window are paired (a rule of the decoder),
    in the window's own row; windows come together as one candidate each."""
    top = lambda c: F.transform(F.slice(F.array_sort(F.transform(c, lambda x, i: F.struct((-x).alias("v"), (-i).alias("i")))), 1, best), lambda x: F.struct((-x["v"]).alias("v"), (-x["i"]).cast("int").alias("i")))
    pairs = F.flatten(F.transform(top(F.col("start_logits")), lambda s: F.transform(F.filter(top(F.col("end_logits")), lambda e: (s["i"] > 0) & (e["i"] >= s["i"]) & (e["i"] - s["i"] <= longest)), lambda e: F.struct((s["v"] + e["v"]).alias("score"), (-F.col("w")).alias("w"), (-s["i"]).alias("si"), (-e["i"]).alias("ei")))))
    one = scored.select(*keys, (F.get("start_logits", F.lit(0)) + F.get("end_logits", F.lit(0))).alias("cls"), F.array_max(pairs).alias("b"))
    out = one.groupBy(*keys).agg(F.max("b").alias("b"), F.max("cls").alias("no_answer"))
    return out.select(*keys, F.col("b.score").alias("score"), "no_answer", (-F.col("b.w")).alias("w"), (-F.col("b.si")).alias("si"), (-F.col("b.ei")).alias("ei"))


def lexical_scorer(windowed: DataFrame) -> DataFrame:
    """Start and end scores from words shared with the question: a stand-in for a trained reader, without a model."""
    q = F.transform(F.split(F.lower("question"), r"(?U)\W+"), lambda w: w)
    hit = lambda t: F.array_contains(F.filter(q, lambda w: F.length(w) > 3), F.regexp_replace(F.lower(t["text"]), r"(?U)\W+", "")).cast("double")
    score = F.transform("tokens", hit)
    near = F.transform(score, lambda x, i: F.when(x > 0, 0.0).otherwise(F.aggregate(F.slice(score, F.greatest(F.lit(1), i - 4), F.lit(5)), F.lit(0.0), lambda a, y: a + y)))
    return windowed.withColumn("start_logits", F.concat(F.array(F.lit(0.0)), near)).withColumn("end_logits", F.concat(F.array(F.lit(0.0)), F.transform(near, lambda x: x * 0.5)))


def ask(docs: DataFrame, questions: DataFrame, scorer=lexical_scorer, threshold: float = 0.0, chars: int = CONTEXT_CHARS, id_col: str = "_id") -> DataFrame:
    """(id, question, answer, answered, score, start, end) for every document and every row of questions (question)."""
    d = docs.select(F.col(id_col).alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("context"))
    w = windows(d.crossJoin(F.broadcast(questions.select("question"))), "context", reserved=F.size(F.split("question", r"(?U)\s+")) + 4)
    scored = scorer(w).select("id", "question", "w", "tokens", "start_logits", "end_logits")
    b = best_spans(scored, ["id", "question"])
    b = b.join(scored.select("id", "question", "w", "tokens"), ["id", "question", "w"], "left").join(d, "id")
    start, end = F.get("tokens", F.col("si") - 1)["start"], F.get("tokens", F.col("ei") - 1)["end"]
    b = b.withColumn("start", start).withColumn("end", end).withColumn("span", F.trim(F.substring(F.col("context"), F.col("start") + 1, F.col("end") - F.col("start")))).withColumn("margin", F.col("score") - F.col("no_answer"))
    ok = F.col("span").isNotNull() & (F.col("margin") >= threshold) & ~trivial_answer(F.col("span"))
    ok = F.coalesce(ok, F.lit(False))
    return b.select(F.col("id").alias(id_col), "question", F.when(ok, F.col("span")).otherwise("").alias("answer"), ok.alias("answered"), F.when(ok, F.col("margin")).otherwise(0.0).alias("score"), F.when(ok, F.col("start")).alias("start"), F.when(ok, F.col("end")).alias("end"))


# evaluation


def eval_rows(decoded: DataFrame) -> DataFrame:
    """(id, gold, span, margin): spans that are no answer become empty with margin -inf; decoded has the same columns, margin null where there is no span."""
    bad = F.col("span").isNull() | trivial_answer(F.col("span"))
    return decoded.select("id", "gold", F.when(bad, "").otherwise(F.col("span")).alias("span"), F.when(bad | F.col("margin").isNull(), float("-inf")).otherwise(F.col("margin")).alias("margin"))


def judged(rows: DataFrame) -> DataFrame:
    """Each row's scores if it is answered; strings become tokens once, and are compared once, not for each threshold."""
    t = rows.select("id", "margin", (F.coalesce("gold", F.lit("")) != "").alias("has"), (F.col("span") != "").alias("any"), answer_tokens("span").alias("p"), answer_tokens("gold").alias("g"))
    t = t.select("id", "margin", "has", "any", "p", "g", F.array_join("p", " ").alias("ps"), F.array_join("g", " ").alias("gs"))
    return t.select("id", "margin", "has", "any", (F.col("ps") == F.col("gs")).cast("double").alias("em"), tokens_f1(F.col("p"), F.col("g")).alias("f1"), contains_norm(F.col("ps"), F.col("gs")).cast("double").alias("cm"))


def _metrics(yes: Column) -> list[Column]:
    has = F.col("has")
    good = lambda c: F.avg(F.when(~has, (~yes).cast("double")).when(yes, F.col(c)).otherwise(0.0))
    tp, fn = F.count_if(has & yes), F.count_if(has & ~yes)
    return [F.count(F.lit(1)).alias("n"), good("em").alias("em"), good("f1").alias("f1"), good("cm").alias("contains"), F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0)).alias("ans_recall"), tp.alias("tp"), F.count_if(~has & yes).alias("fp"), fn.alias("fn"), F.count_if(~has & ~yes).alias("tn")]


def score_at(rows: DataFrame, tau: float, by_tag: bool = False) -> DataFrame:
    """Exact match, F1, containment, recall of answers and the confusion at one threshold, overall or by the tag of the id."""
    j = judged(rows).withColumn("tag", tag_of(F.col("id")))
    yes = (F.col("margin") >= tau) & F.col("any")
    return j.groupBy("tag").agg(*_metrics(yes)) if by_tag else j.agg(*_metrics(yes))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """tau and the metrics at it, for every distinct margin rounded to 2 places and for accepting all.

    Running sums over the sums of each distinct margin, not rows times thresholds: the
    rounded margins are few whatever the input, so the last window is small."""
    j = judged(rows).withColumn("m", F.when(F.col("margin") > float("-inf"), F.col("margin")))
    # thresholds are rounded margins, but rows are held against them unrounded: place each row at the largest threshold that it reaches
    r = F.round("m", 2)
    cand = j.where("m is not null").select(r.alias("tau")).distinct().union(j.sparkSession.range(1).select(F.lit(ACCEPT_ALL).alias("tau")))
    low = F.when(r <= F.col("m"), r).otherwise(F.round(r - 0.01, 2))
    up = j.withColumn("slot", F.when(F.col("m").isNull(), float("-inf")).otherwise(low))
    has, ans = F.col("has"), F.col("any")
    part = up.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("h"), F.count_if(has & ans).alias("tp"), F.count_if(~has & ans).alias("fp"), *(F.sum(F.when(has & ans, F.col(c)).otherwise(0.0)).alias(c) for c in ("em", "f1", "cm")))
    both = part.select(F.col("slot").alias("tau"), F.lit(False).alias("is_tau"), "n", "h", "tp", "fp", "em", "f1", "cm").unionByName(cand.select("tau", F.lit(True).alias("is_tau"), *(F.lit(0).cast("long").alias(c) for c in ("n", "h", "tp", "fp")), *(F.lit(0.0).alias(c) for c in ("em", "f1", "cm"))))
    w = W.orderBy(F.col("tau").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = both.select("tau", "is_tau", F.sum("n").over(every).alias("n"), F.sum("h").over(every).alias("h"), *(F.sum(c).over(w).alias(c) for c in ("tp", "fp", "em", "f1", "cm"))).where("is_tau")
    tn = F.col("n") - F.col("h") - F.col("fp")
    return s.select("tau", "n", *(((F.col(c) + tn) / F.col("n")).alias(a) for c, a in (("em", "em"), ("f1", "f1"), ("cm", "contains"))), F.coalesce(F.col("tp") / F.nullif("h", F.lit(0)), F.lit(0.0)).alias("ans_recall"), "tp", "fp", (F.col("h") - F.col("tp")).alias("fn"), tn.alias("tn"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """(best_tau, best_f1): the lowest threshold of the best F1."""
    return sweep.agg(F.min_by("tau", F.struct(-F.round("f1", 9), F.col("tau"))).alias("best_tau"), F.max("f1").alias("best_f1"))
