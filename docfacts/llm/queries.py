"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm import bpe, jaccard, licenses, media, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity
from docfacts.llm.common import shared_dir, table, written
from docfacts.llm.token_counts import Rollup, deletes, inserts, revisions



def vocabulary(name: str) -> str:
    """The place of a vocabulary file; another folder can be named in DOCFACTS_TOKENIZERS."""
    folder = os.environ.get("DOCFACTS_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def byte_ranks() -> str:
    return vocabulary("byte_bpe_50k.tiktoken")


def word_file() -> str:
    return vocabulary("word_bpe_49k.json")


def pattern() -> str:
    return public_tokenizers.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without the bytes covered by 50-byte strings that also start in a document of smaller id: counts and the digest of what is left. Null texts are empty; see suffix_dedup.remove_repeats."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of each whole text and their decoding, as counts and digests. Null texts are empty; one row per row; see bpe.encode_documents."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), byte_ranks(), pattern())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for each text, learned from labelled rows that are not held out. Null texts are scored as empty ones, null ids are not held out; see toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return toxicity.add_score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of each text and the verdict of rules that vote or abstain. Null texts have no words and fail; see quality_rules.judge."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior quality of each document. `documents` has no address: source stands for the host, language for the path; see quality_classifier.judge."""
    out = quality_classifier.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "source", "lang", "p_doc", "site_rate", "quality", "kept")


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a stored 8-bit payload, read back from deduplicated chunks. Null texts are 64 bytes 0; see media.store_and_read."""
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of documents and tokens by source, language and tokenizer after four batches, two of them committed twice:
    all documents under the byte-level and under the word tokenizer; repeats of a text
    taken out of both; and the byte counts of the kept texts of several lines revised by
    a token for each line end. Null texts count as documents without tokens that repeat
    nothing; null sources and languages are groups; an empty table gives no rows."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), byte_ranks(), pattern(), word_file())
    texts = written(token_counts.by_text(written(counted, "counted")), "texts")
    byte, word = "byte_bpe_50k", "word_bpe_49k"
    rollup = Rollup(spark, f"{shared_dir(spark).rstrip('/')}/docfacts/rollup-{uuid.uuid4().hex}")
    rollup.commit(1, inserts(texts, byte, "byte_tokens", "n"))
    for _ in range(2):
        rollup.commit(2, inserts(texts, word, "word_tokens", "n"))
    again = texts.where("repeats > 0")
    rollup.commit(3, deletes(again, byte, "byte_tokens", "repeats"), deletes(again, word, "word_tokens", "repeats"))
    for _ in range(2):
        rollup.commit(4, revisions(texts.where("n > repeats and line_ends > 0"), byte, "byte_tokens", F.col("byte_tokens") + F.col("line_ends"), F.col("n") - F.col("repeats")))
    return rollup.totals()


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document and its place in a sequence. Null texts are the end id alone; see packing.pack."""
    out = packing.pack_documents(table(spark, sf_dir, "documents"), word_file())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases and all license labels of each text. Null texts have none; see licenses.scan."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingle count and component of each document. Texts without words are alone; see jaccard.near_duplicates."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_byte_bpe, op3_toxicity, op4_quality_rules, op5_quality_classifier, op6_media_chunks, op7_token_rollup, op8_best_fit_packing, op9_license_scan, op10_jaccard_join)
}

_OP1 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, h, unnest(range(1, length(h) - 98, 2)) as i from d where length(h) >= 100),
s as (select doc_id, i, md5(substr(h, i, 100)) as x from p),
m as (select x, min(doc_id) as first from s group by x),
hit as (select doc_id, i from s join m using (x) where doc_id > first),
e as (select doc_id, i, case when i - lag(i) over w <= 100 then 0 else 1 end as new from hit window w as (partition by doc_id order by i)),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from e),
r as (select doc_id, run, min(i) as a, max(i) + 100 as b from g group by doc_id, run),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 1) as z from r),
t as (select doc_id, count(*) as n_spans, sum(b - a) // 2 as n_removed, string_agg(substr(h, z, a - z), '' order by a) as keep, max(b) as last
  from k join d using (doc_id) group by doc_id)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(keep, '') || substr(h, coalesce(last, 1)))) as kept_sha256
from d left join t using (doc_id)
"""

_OP10 = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then len(w) || ' ' || array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as x
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select a as doc_id, a as root from l union select l.b, r.root from r join l on l.a = r.doc_id where r.root < l.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce((select min(root) from r where r.doc_id = w.doc_id), w.doc_id)) as component_id
from w left join n using (doc_id)
"""

SQL: dict[str, str] = {"op10_jaccard_join": _OP10, "op1_suffix_dedup": _OP1}
