"""Token totals kept by deltas.

Texts are counted once, with the tokenizers of public vocabulary files, into a narrow
table. A batch of signed rows (insert +, delete -, revision: - the old count, + the new)
becomes one small table of additive sums by source, language and tokenizer version.

A batch is committed by writing it to a staging folder and renaming that to the batch's
own. A commit that fails before the rename leaves nothing that is read, and can be
repeated; a batch that is there already is left alone if its sums are the same and
refused if they differ. Totals are the sums over committed batches."""

from __future__ import annotations

import functools
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docfacts.llm.bpe import encoding, parts
from docfacts.llm.common import slices
from docfacts.llm.packing import word_tokenizer

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, rank_file: str, pattern: str, word_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, lang, digest, byte_tokens, word_tokens, line_ends) of each row, in one pass over the texts.

    A null text has no digest and no tokens. Only the named columns are read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        enc, tok = encoding(rank_file, pattern), word_tokenizer(word_file)
        for batch, raw in slices(it, "text"):
            null = batch.column(3).is_null().to_pylist()
            texts = [r.decode("utf-8") for r in raw]
            cols = [
                pa.array([None if n else hashlib.blake2b(r, digest_size=16).digest() for r, n in zip(raw, null)], pa.binary()),
                pa.array([sum(len(enc.encode_ordinary(p)) for p in parts(t)) for t in texts], pa.int64()),
                pa.array([len(ids) // 4 for ids in tok.encode(texts)], pa.int64()),
                pa.array([r.count(b"\n") for r in raw], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["id", "source", "lang", "digest", "byte_tokens", "word_tokens", "line_ends"])

    narrow = docs.select(docs[id_col].alias("id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, source string, lang string, digest binary, byte_tokens long, word_tokens long, line_ends long")


def by_text(counted: DataFrame) -> DataFrame:
    """A row for each text, source and language: n rows, and how many of them repeat a text (all but the one of smallest id).

    Rows of a text are combined on the map side before they meet, so a group of copies
    costs a row for each task, source and language. Null texts repeat nothing; null ids come last."""
    sums = counted.groupBy("digest", "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("byte_tokens", "word_tokens", "line_ends")))
    w = W.partitionBy("digest").orderBy(F.col("least").asc_nulls_last(), "source", "lang")
    texts = sums.where("digest is not null").withColumn("repeats", F.col("n") - F.when(F.row_number().over(w) == 1, 1).otherwise(0))
    return texts.unionByName(sums.where("digest is null").withColumn("repeats", F.lit(0).cast("long")))


def inserts(rows: DataFrame, tokenizer: str, tokens: str | Column, n: str | Column | None = None) -> DataFrame:
    """Signed rows that add each row's document and tokens; n: how many such documents a row stands for.

    A null count is 0; null sources and languages are groups."""
    tokens, n = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long") for c in (tokens, F.lit(1) if n is None else n))
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), n.alias("n_docs"), (n * tokens).alias("n_tokens"))


def deletes(rows: DataFrame, tokenizer: str, tokens: str | Column, n: str | Column | None = None) -> DataFrame:
    """Signed rows that take each row's documents and tokens away."""
    return inserts(rows, tokenizer, tokens, n).withColumns({c: -F.col(c) for c in SUMS})


def revisions(rows: DataFrame, tokenizer: str, old: str | Column, new: str | Column, n: str | Column | None = None) -> DataFrame:
    """Signed rows that change counts and leave the number of documents."""
    before, after = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in (old, new))
    return inserts(rows, tokenizer, after - before, n).withColumn("n_docs", F.lit(0).cast("long"))


class Rollup:
    """Totals in a shared folder, one subfolder for each committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _digest(self, rows: DataFrame) -> tuple:
        """A number for the sums, whatever their order."""
        return tuple(rows.select(F.xxhash64(*KEYS, *SUMS).alias("h")).agg(F.count("h"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first())

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={int(batch)}"

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(folder)

    def commit(self, batch: int, *signed: DataFrame) -> bool:
        """Commit a batch; False where it was there already with the same sums, ValueError where with others.

        Sums are combined on the map side: a source with a third of all rows costs
        one row for each task and key. Nothing is read of a commit that ends before
        its rename; what it left in the staging folder is never read."""
        rows = functools.reduce(DataFrame.unionByName, signed)
        sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where(" or ".join(f"{c} <> 0" for c in SUMS)).select(*KEYS, *SUMS)
        staged, folder = f"{self.path}/_staging/{uuid.uuid4().hex}", self._folder(batch)
        sums.write.parquet(staged)
        fs, path = self._files()
        try:
            if not fs.exists(path(folder)):
                # of two commits at once the second rename fails, or ends inside the first's folder
                moved = fs.rename(path(staged), path(folder))
                inner = path(f"{folder}/{staged.rsplit('/', 1)[1]}")
                if moved and not fs.exists(inner):
                    return True
                if moved:
                    fs.rename(inner, path(staged))
            if self._digest(self._read(staged)) != self._digest(self._read(folder)):
                raise ValueError(f"batch {batch} was committed with other sums")
            return False
        finally:
            fs.delete(path(staged), True)

    def batches(self) -> list[int]:
        """The numbers of the committed batches."""
        fs, path = self._files()
        names = [x.getPath().getName() for x in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def totals(self) -> DataFrame:
        """The sums of all committed batches; keys of which nothing is left are not returned. None committed: no rows."""
        rows = [self._folder(b) for b in self.batches()]
        rows = self.spark.read.schema(SCHEMA).parquet(*rows) if rows else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where(" or ".join(f"{c} <> 0" for c in SUMS))

    def compact(self, upto: int, into: str) -> Rollup:
        """A copy, in another folder, in which the batches up to `upto` are one."""
        out, first = Rollup(self.spark, into), [b for b in self.batches() if b <= upto]
        if first:
            out.commit(upto, *(self._read(self._folder(b)) for b in first))
        for b in self.batches():
            if b > upto:
                out.commit(b, self._read(self._folder(b)))
        return out
