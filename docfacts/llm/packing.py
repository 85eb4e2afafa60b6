"""Best-fit packing with a certificate.

Documents become pieces of at most `capacity` tokens. Each partition packs its
pieces best-fit decreasing and compares its bins with a lower bound from
dual-feasible functions. A partition that meets its bound is certified and closed.
From one with a gap the bins that are not nearly full go on: their pieces meet those
of other partitions and are packed again, in as many partitions as they fill, until
nothing is open, the whole meets the bound of all pieces, or a round saves no bin."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import kept_for_stage, quiet_threads, slices, written

CAPACITY = 4096
END_ID = 1
#: Words kept in a worker's cache; it is emptied when full.
CACHE_WORDS = 500_000
#: Tokens and pieces of one packing partition at most, about.
PARTITION_TOKENS, PARTITION_PIECES = CAPACITY * 4096, 1 << 18
#: A bin with less than this part of the capacity unused isn't handed on.
SLACK = 0.01

PIECES = "piece int, start long, length long, ids_crc32 long"
#: Fixed value: the pre-tokens of the word tokenizer's file; none spans white space.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-case ASCII.
_ASCII_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Split by Python as white space, but not by the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters before this are letters in every version of Unicode since 7.
_OLD = "\u0530"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte; a space stays, as it parts words here."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)} | {32: " "}


class WordTokenizer:
    """A tokenizer with a bounded cache by word.

    Where the file has the pre-tokens above, after lower-casing and NFC, a text's ids
    are those of its words one after another; words are learned in batches, without the
    steps that leave them as they are. Texts that hold a special token's string or aren't
    NFC, and all texts under another file, go through the tokenizer as they are."""

    def __init__(self, path: str):
        quiet_threads()
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        steps = [x["type"] for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        split = ((kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": PRE_TOKENS} and kind["model"].get("end_of_word_suffix") == "</w>"
        self.special = [x["content"] for x in kind.get("added_tokens", [])]
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for k, i in vocab.items() if k.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, text: str) -> list[str] | None:
        if not self.by_word or _ODD_SPACE.search(text) or any(x in text for x in self.special):
            return None
        if text.isascii() or unicodedata.is_normalized("NFC", text) and "Σ" not in text and "İ" not in text:
            return text.lower().split()
        return None

    def _learn(self, new: list[str]) -> None:
        """Put the ids of new words into the cache: of letters alone in one batch, of others from their pre-tokens."""
        cache = self.cache
        made: dict[str, list[str]] = {}
        plain: set[str] = set()
        rest = []
        for w in new:
            base = w[:-1] if w[-1] in ".," else w
            if base.isalpha() and (base.isascii() or max(base) < _OLD):
                plain.add(base)
                if base is not w:
                    made[w] = [base, w[-1]]
            elif w.isascii():
                made[w] = _ASCII_PRE_TOKENS.findall(w)
                plain.update(made[w])
            else:
                rest.append(w)
        plain.update(".,")
        words = [w for w in plain if w not in cache]
        if words:
            joined = " ".join(words).encode().decode("latin1").translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cut) != len(words):
                raise ValueError("the tokenizer's words don't end where they should")
            stored = ids.tobytes()
            cache.update(zip(words, (stored[a:b] for a, b in zip([0, *cut], cut))))
        for w, parts in made.items():
            cache[w] = b"".join([cache[x] for x in parts])
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
            cache[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._words(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = set().union(*(s for s in split if s)).difference(cache)
        if new:
            self._learn(list(new))
        return [self._whole(t) if s is None else b"".join(map(cache.__getitem__, s)) for t, s in zip(texts, split)]


@kept_for_stage
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of each row: ids of the text, then END_ID, cut every `capacity` tokens.

    A null or empty text is the single piece [END_ID]; repeated rows give repeated pieces."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        tok = word_tokenizer(tokenizer_file)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch, raw in slices(it, "text"):
            ids = [x + end for x in tok.encode([r.decode("utf-8") for r in raw])]
            cut = [range(0, len(x), 4 * capacity) for x in ids]
            row = np.repeat(np.arange(len(ids)), [len(c) for c in cut])
            begin = [b for c in cut for b in c]
            part = [ids[r][b : b + 4 * capacity] for r, b in zip(row.tolist(), begin)]
            cols = [batch.column(0).take(pa.array(row)), pa.array([b // (4 * capacity) for b in begin], pa.int32()), pa.array([b // 4 for b in begin], pa.int64()), pa.array([len(p) // 4 for p in part], pa.int64()), pa.array([zlib.crc32(p) for p in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(part, pa.binary())] * keep_ids, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {PIECES}" + ", ids binary" * keep_ids)
    return out.withColumnRenamed("id", id_col)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the best of a family of dual-feasible functions."""
    if not len(lengths) or not counts.sum():
        return 0
    x, n = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    half = np.unique(x[x <= capacity // 2])
    for lam in half[np.unique(np.linspace(0, len(half) - 1, 64).astype(int))] if len(half) else ():
        value = np.where(x > capacity - lam, capacity, np.where(x >= lam, x, 0))
        best = max(best, -(-int((value * n).sum()) // capacity))
    for k in range(1, 33):
        y = (k + 1) * x
        value = np.where(y % capacity == 0, x * k, y // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each length, and the fill of each bin; ties by position."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(fill, dtype=np.int64)


def pack(pieced: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """Add sequence_id, offset, bins and bound (of the partition that made the sequence) to each piece.

    Repeated rows and null ids are packed like any other; an empty table stays empty.
    Only counts by length (at most `capacity` rows) and a few sums reach the driver."""
    kind = pieced.schema[id_col].dataType.simpleString()
    rows = pieced.select(F.col(id_col).alias("id"), "piece", "start", "length", "ids_crc32")
    schema = f"id {kind}, {PIECES}, sequence_id long, offset long, bins long, bound long, open boolean"
    counts = rows.groupBy("length").count().collect()
    size, n = np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts], np.int64)
    least, tokens, items, before = lower_bound(size, n, capacity), int((size * n).sum()), int(n.sum()), None
    done: list[DataFrame] = []
    closed, step = 0, 0
    while True:
        parts = max(1, -(-tokens // partition_tokens), -(-items // PARTITION_PIECES))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.lit(step)), F.lit(parts)).cast("int"))
        packed = written(dealt.groupBy("part").applyInPandas(_packer(capacity, step), schema), f"packed{step}")
        first = F.col("offset") == 0
        shut, left, tokens, items = packed.agg(F.count_if(first & ~F.col("open")), F.count_if(first & F.col("open")), F.sum(F.when(F.col("open"), F.col("length"))), F.count_if("open")).first()
        closed += shut
        if not left or parts == 1 or closed + left <= least or before is not None and shut + left >= before:
            done.append(packed.drop("open"))
            break
        done.append(packed.where("not open").drop("open"))
        rows, before, step = packed.where("open").select("id", "piece", "start", "length", "ids_crc32"), left, step + 1
    out = functools.reduce(DataFrame.unionByName, done)
    return out.withColumnRenamed("id", id_col)


def _packer(capacity: int, step: int):
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="part").sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        size = pdf["length"].to_numpy()
        bins, offset, fill = best_fit_decreasing(size, capacity)
        bound = lower_bound(*np.unique(size, return_counts=True), capacity)
        if len(fill) > bound:
            loose = fill < capacity - int(capacity * SLACK)
        else:
            # certified; where only the sum of the lengths bounds it, its emptiest bin may still fill up elsewhere
            loose = np.zeros(len(fill), dtype=bool)
            loose[np.argmin(fill)] = bound == -(-int(size.sum()) // capacity) and fill.min() < capacity // 2
        return pdf.assign(sequence_id=(step << 58) + (int(key[0]) << 26) + bins, offset=offset, bins=len(fill), bound=bound, open=loose[bins])

    return one


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences there are, and the fewest that any packing of these pieces has."""
    counts = packed.groupBy("length").count().collect()
    least = lower_bound(np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts], np.int64), capacity)
    return packed.where("offset = 0").count(), least


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """pieces(), written, then pack()."""
    return pack(written(pieces(docs, tokenizer_file, capacity, id_col, text_col), "pieces"), capacity, id_col, **kw)
