"""Shared pieces of the training-data operators: tables written to the shared
folder, Arrow slices of bounded size, and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.sources.shared import shared_dir, written  # noqa: F401

#: Bytes of text that one Python step handles at a time (a longer single text is one step).
SLICE_BYTES = 1 << 20
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release(spark: SparkSession) -> None:
    """Let the driver drop the broadcasts and shuffles of plans that are no longer held.

    Spark's cleaner learns of them only when the JVM collects its garbage, by default every half hour."""
    spark.sparkContext._jvm.java.lang.System.gc()


_stage: int | None = None
_caches: list = []


def settle() -> None:
    """At the first call in a stage: give up what this Python worker holds for earlier ones.

    Workers live on from stage to stage; without this each keeps every stage's models and freed memory."""
    global _stage
    context = TaskContext.get()
    if context is None or context.stageId() == _stage:
        return
    _stage = context.stageId()
    for cached in _caches:
        cached.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc's alone
        ctypes.CDLL(None).malloc_trim(0)


def kept_for_stage(f):
    """A cache of f's results that a worker empties when it begins another stage."""
    cached = functools.lru_cache(maxsize=4)(f)
    _caches.append(cached)

    @functools.wraps(f)
    def call(*args):
        settle()
        return cached(*args)

    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_blocks(docs: DataFrame, text: str = "text", block_bytes: int = 4 << 20) -> int:
    """How many blocks of about block_bytes of text each the rows make (one scan of the text's length)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(max(1, -(-total // block_bytes)))


def block_of(n: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def slices(it: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that each has about `limit` bytes of text; texts as UTF-8 (null: empty)."""
    settle()
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        size = np.array([0 if x is None else x for x in pa.compute.binary_length(col).to_pylist()], dtype=np.int64)
        group = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a), [x or b"" for x in col.slice(a, b - a).to_pylist()]


class Packed(Sequence):
    """Texts that are kept compressed, each unpacked when it is read."""

    def __init__(self, texts: Iterable[bytes] = ()):
        self._packed: list[bytes] = []
        for t in texts:
            self.append(t)

    def append(self, text: bytes) -> None:
        import zstandard

        self._packed.append(zstandard.compress(text, 1))

    def at(self, places: Iterable[int]) -> Packed:
        out = Packed()
        out._packed = [self._packed[i] for i in places]
        return out

    def __len__(self) -> int:
        return len(self._packed)

    def __getitem__(self, at):
        import zstandard

        return self.at(range(len(self))[at]) if isinstance(at, slice) else zstandard.decompress(self._packed[at])


@functools.lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_LOW = 16


@functools.lru_cache(maxsize=1)
def _low_powers() -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < 2**_LOW; all others are products of two."""
    return _multiples(_BASE, 1 << _LOW), _multiples(_BASE_INV, 1 << _LOW)


def _multiples(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def back(at: np.ndarray) -> np.ndarray:
    """B**-i modulo 2**64 for each place i."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    high = _multiples(pow(_BASE_INV, 1 << _LOW, 1 << 64), (int(at.max()) >> _LOW) + 1)
    return high[at >> _LOW] * _low_powers()[1][at & ((1 << _LOW) - 1)]


def scale(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Multiply x[i], in place, by B**i or B**-i modulo 2**64."""
    low, step = _low_powers()[inverse], pow((_BASE, _BASE_INV)[inverse], 1 << _LOW, 1 << 64)
    high = 1
    for i in range(0, len(x), 1 << _LOW):
        part = x[i : i + (1 << _LOW)]
        part *= low[: len(part)]
        if i:
            part *= np.uint64(high)
        high = high * step & _M
    return x


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of the first i bytes, modulo 2**64."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    if len(buf):
        np.take(_byte_codes(), buf, out=out[1:], mode="clip")
        np.cumsum(scale(out[1:]), dtype=np.uint64, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: where they are, whose they are, and a 64-bit hash each."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.translate(LOWER)
        self.buf = buf = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.doc_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.space = space = _SPACE[buf]
        inside = np.concatenate([[False], ~space, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        at = np.searchsorted(self.start, self.doc_start)
        self.first = at[:-1]
        self.count = np.diff(at)

    def hashes(self) -> np.ndarray:
        h = prefix_hashes(self.buf)
        return mix((h[self.end] - h[self.start]) * back(self.start))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def windows_of(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def quiet_threads() -> None:
    for k in ("RAYON_NUM_THREADS", "OMP_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
