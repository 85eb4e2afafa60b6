"""Media columns by content-defined chunking.

A payload is stored as an 8-bit mono WAV file. Rolling gear hashes cut the file into
chunks; equal chunks, found by digest, are kept once; ordered chunk lists bring the
files together again, which are verified before anything is computed from them."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import slices

UNIT = 64
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 16384, 12
BLOCK_BYTES = 2 << 20
#: The chunk codec's dictionary is trained on at most so many texts of at most so many bytes.
DICTIONARY_TEXTS, DICTIONARY_TEXT_BYTES, DICTIONARY_BYTES = 600, 1 << 14, 1 << 16
LEVEL = 12
RATE = 8000


@functools.lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def payload(text: bytes) -> bytes:
    """text and bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * ((-len(text)) % UNIT if text else UNIT)


def wav(samples: bytes) -> bytes:
    """A RIFF file of 8-bit mono samples; an even number of them, so no pad byte."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples(media: bytes) -> bytes:
    """The samples of a file that wav() made."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack_from("<H", media, 34)[0] != 8:
        raise ValueError("not an 8-bit WAV file")
    size = struct.unpack_from("<I", media, 40)[0]
    if 44 + size != len(media):
        raise ValueError("truncated WAV file")
    return media[44:]


def cut_points(buf: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the gear hash of the 64 bytes up to there has its top bits 0."""
    if not len(buf):
        return np.zeros(0, np.int64)
    h = _gear()[buf]
    step = 1
    while step < 64:
        h[step:] += h[:-step] << np.uint64(step)  # the right side is read before it is changed
        step *= 2
    return np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1


def chunks(media: bytes, points: list[int] | None = None) -> list[bytes]:
    """Content-defined chunks of MIN_CHUNK to MAX_CHUNK bytes; the last may be shorter."""
    points = cut_points(np.frombuffer(media, np.uint8)).tolist() if points is None else points
    out, begin = [], 0
    for p in [*points, len(media)]:
        while p - begin > MAX_CHUNK:
            out.append(media[begin : begin + MAX_CHUNK])
            begin += MAX_CHUNK
        if p - begin >= MIN_CHUNK or p == len(media) and p > begin:
            out.append(media[begin:p])
            begin = p
    return out


def feature(data: bytes) -> str:
    """Sum, sum of squares, peak and number of changes of sign around 128 of the samples."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    return f"{int(a.sum())}:{int((a * a).sum())}:{int(a.max())}:{int(((a[1:] > 127) != (a[:-1] > 127)).sum())}"


def train_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """A dictionary for the chunk codec, from a bounded sample by hash; empty where there is too little text."""
    import zstandard as z

    texts = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).where(F.octet_length("t").between(64, DICTIONARY_TEXT_BYTES))
    chosen = texts.groupBy("h").agg(F.count(F.lit(1))).select("h").orderBy("h").limit(DICTIONARY_TEXTS)
    rows = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("t")).orderBy("h").collect()
    try:
        return z.train_dictionary(DICTIONARY_BYTES, [c for r in rows for c in chunks(wav(payload(r[1].encode())))]).as_bytes()
    except (z.ZstdError, ValueError):
        return b""


def codec(dictionary: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(dictionary) if dictionary else None
    kw = {"dict_data": d} if d else {}
    return z.ZstdCompressor(level=LEVEL, write_checksum=False, write_dict_id=False, **kw), z.ZstdDecompressor(**kw)


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
#: An ordered chunk list: a row's place in its block, its id, the text's bytes, the digest of its media, and its chunks' digests one after another.
LIST = "struct<row:int,id:{kind},n_bytes:bigint,sha256:binary,names:binary>"
DIGEST_BYTES = 20


def _digests(text: bytes) -> tuple[bytes, list[bytes], list[bytes]]:
    """The media of a text, its chunks and their digests."""
    media = wav(payload(text))
    cut = chunks(media)
    return media, cut, [hashlib.sha256(c).digest()[:DIGEST_BYTES] for c in cut]


def list_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, digest): which chunks a block of documents has, each once; and rows
    (block, digest, list): each document's ordered chunk list, with a key of its own in
    place of a digest (shorter than one, so equal to none)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        task, n = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch, texts in slices(it, "text", BLOCK_BYTES):
            block, n = (task << 24) + n, n + 1
            own: dict[bytes, None] = {}
            names, sums = [], []
            for text in texts:
                media, _, digests = _digests(text)
                sums.append(hashlib.sha256(media).digest())
                names.append(b"".join(digests))
                own.update(dict.fromkeys(digests))
            m, k = len(own), len(texts)
            keys = [*own, *(struct.pack("<qi", block, i) for i in range(k))]
            lists = pa.StructArray.from_arrays([pa.array(range(k), pa.int32()), batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(sums, pa.binary()), pa.array(names, pa.binary())], names=["row", "id", "n_bytes", "sha256", "names"])
            yield pa.RecordBatch.from_arrays([pa.array([block] * (m + k), pa.int64()), pa.array(keys, pa.binary()), pa.concat_arrays([pa.nulls(m, lists.type), lists])], names=["block", "digest", "list"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, "block long, digest binary, list " + LIST.format(kind=kind))


def chunk_rows(docs: DataFrame, dictionary: bytes, text_col: str = "text") -> DataFrame:
    """(digest, data): each chunk once, compressed; equal ones are combined within a block, on the map side, and then by digest."""

    def run(it):
        pack = codec(dictionary)[0]
        for _, texts in slices(it, "text", BLOCK_BYTES):
            own: dict[bytes, bytes] = {}
            for text in texts:
                for c, digest in zip(*_digests(text)[1:]):
                    if digest not in own:
                        own[digest] = pack.compress(c)
            yield pa.RecordBatch.from_arrays([pa.array([*own], pa.binary()), pa.array([*own.values()], pa.binary())], names=["digest", "data"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))


def deliver(lists: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of list_rows, with the data of the chunks they name, joined by digest.

    A chunk that all blocks share is a row for each block: no row holds a list of blocks."""
    return lists.join(stored, "digest", "left").select("block", "digest", "data", "list")


def read(delivered: DataFrame, dictionary: bytes, id_col: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """Put the media of each block's lists together, verify them and describe them."""
    kind = delivered.schema["list"].dataType["id"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        unpack = codec(dictionary)[1]
        stored = dict(zip(table.column("digest").to_pylist(), table.column("data").to_pylist()))
        lists = table.column("list").combine_chunks()
        lists = lists.filter(lists.is_valid())
        ids, sizes, sums, names = (lists.field(c) for c in ("id", "n_bytes", "sha256", "names"))
        open_chunks: dict[bytes, bytes] = {}
        out: list[tuple] = []
        for doc, n, digest, every in zip(ids.to_pylist(), sizes.to_pylist(), sums.to_pylist(), names.to_pylist()):
            parts = []
            for i in range(0, len(every), DIGEST_BYTES):
                name = every[i : i + DIGEST_BYTES]
                if name not in open_chunks:
                    if stored.get(name) is None:
                        raise ValueError(f"a chunk of the media of {doc} is missing")
                    open_chunks[name] = unpack.decompress(stored[name], max_output_size=MAX_CHUNK)
                parts.append(open_chunks[name])
            media = b"".join(parts)
            if hashlib.sha256(media).digest() != digest:
                raise ValueError(f"media of {doc} isn't what was stored")
            data = samples(media)
            out.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), digest.hex(), feature(data), len(parts), media if keep_media else None))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * keep_media
        cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
        return pa.table([ids, *cols], names=["id", *(c.split()[0] for c in RESULT.split(", "))] + ["media"] * keep_media)

    out = delivered.groupBy("block").applyInArrow(one, f"id {kind}, {RESULT}" + ", media binary" * keep_media)
    return out.withColumnRenamed("id", id_col)


class Store:
    """A chunk table (digest, data) and a list table (block, list), as Parquet in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, docs: DataFrame, dictionary: bytes, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Write the chunks of docs that the table doesn't have yet, then their lists; a list is never there without its chunks."""
        new = chunk_rows(docs, dictionary, text_col)
        if self._has("chunks"):
            new = new.join(self.chunks().select("digest"), "digest", "left_anti")
        new.write.mode("append").parquet(f"{self.path}/chunks")
        offset = (self.lists().agg(F.max("block")).first()[0] or 0) + 1 if self._has("lists") else 0
        lists = list_rows(docs, id_col, text_col).where("list is not null")
        lists.select((F.col("block") + F.lit(offset)).alias("block"), "list").write.mode("append").parquet(f"{self.path}/lists")

    def _has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def positions(self) -> DataFrame:
        """(block, row, id, position, digest): the lists, a row for each chunk of a document."""
        place = F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("list.names") / DIGEST_BYTES).cast("int") - 1), lambda i: F.substring(F.col("list.names"), i * DIGEST_BYTES + 1, F.lit(DIGEST_BYTES))))
        return self.lists().select("block", "list.row", "list.id", place.alias("position", "digest"))

    def read(self, dictionary: bytes, id_col: str = "doc_id", keep_media: bool = False) -> DataFrame:
        """All stored media, read back, verified and described."""
        lists = self.lists()
        asked = self.positions().select("block", "digest").distinct().withColumn("list", F.lit(None).cast(lists.schema["list"].dataType))
        rows = asked.unionByName(lists.select("block", F.encode(F.concat_ws(":", "block", "list.row"), "utf-8").alias("digest"), "list"))
        return read(deliver(rows, self.chunks()), dictionary, id_col, keep_media)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None, keep_media: bool = False) -> DataFrame:
    """Cut each text's media into chunks, keep each chunk once, read all back, verify and describe it.

    A null or empty text is 64 bytes 0. Repeated rows are kept once and described
    each; null ids stay; an empty table gives an empty one; other columns aren't read. A
    file whose digest differs from the one that was taken ends the job, and so does a
    text of 4 GB or more (a WAV file's sizes have 32 bits). The chunks pass through
    shuffles only; Store keeps them in tables."""
    dictionary = train_dictionary(docs, text_col) if dictionary is None else dictionary
    return read(deliver(list_rows(docs, id_col, text_col), chunk_rows(docs, dictionary, text_col)), dictionary, id_col, keep_media)
