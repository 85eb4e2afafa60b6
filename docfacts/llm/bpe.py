"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A long text is split before encoding, at places where no match of the pre-split
pattern can span the cut, so that the ids equal those of the whole text."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docfacts.llm.common import kept_for_stage, slices

#: A text of more characters than this is split at safe boundaries.
LONG_CHARS = 1 << 16
#: One space between two characters that are not space: a match of the pattern may
#: begin at that space but none runs across it, and the left part ends without space.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@kept_for_stage
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, limit: int = LONG_CHARS) -> list[str]:
    """Consecutive parts of text of about limit characters each, cut at safe boundaries only."""
    out, begin = [], 0
    while len(text) - begin > limit:
        m = _SAFE.search(text, begin + limit)
        if not m:
            break
        out.append(text[begin : m.start()])
        begin = m.start()
    out.append(text[begin:])
    return out


def encode(text: str, rank_file: str, pattern: str, limit: int = LONG_CHARS) -> np.ndarray:
    """The ids of text as little-endian unsigned 32-bit integers."""
    enc = encoding(rank_file, pattern)
    if len(text) <= limit:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in parts(text, limit)])


def decode(ids, rank_file: str, pattern: str) -> bytes:
    """The raw bytes of ids; they need not be valid UTF-8."""
    return encoding(rank_file, pattern).decode_bytes([int(i) for i in ids] if not isinstance(ids, list) else ids)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, on
    request, the ids as bytes.

    A null text counts as empty: no ids. Repeated rows give repeated rows, a null id
    stays null, other columns are not read, an empty table gives an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        enc = encoding(rank_file, pattern)
        for batch, texts in slices(it, "text"):
            n, a, b, c = [], [], [], []
            for raw in texts:
                text = raw.decode("utf-8")
                ids = [i for p in parts(text) for i in enc.encode_ordinary(p)]
                stored = np.array(ids, dtype="<u4").tobytes()
                n.append(len(ids))
                a.append(hashlib.sha256(stored).hexdigest())
                b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                c.append(stored)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(c, pa.binary())] * keep_ids, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
    return out.withColumnRenamed("id", id_col)
