"""Exact n-gram Jaccard join and its components by a token-group matrix.

Documents are sets of word shingles. An inverted index over each set's prefix, its
rarest shingles, joins every two sets that can be similar. A first pass compares each
set with the one it shares most with; what links falls into groups of similar
documents. For each group the union of its members' shingles is stored once, as a
bitmap of hashes, beside small bitmaps of the members. The matrix of shingles against
groups has few columns: of two groups of different components that share an index entry,
each member of one is held against the other's union, which bounds its overlap with any
member there. Only groups of pairs that the bounds let through are opened: their texts
are fetched and compared member by member."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docfacts.llm.common import Words, mix, release, settle, slices, windows_of, written
from docfacts.llm.graph import components, extend

SHINGLE, PERCENT = 5, 80
#: Counters of the frequency sketch: a fixed size, whatever the input. It only orders shingles; any order gives the same result.
SKETCH, SKETCH_ROWS = 1 << 20, 64
#: Documents of a group at most, and entries that one index list has at most, about.
GROUP, LIST = 32, 2048
BUCKET_BYTES, MIN_BUCKETS = 1 << 22, 256
FLUSH = 1 << 20
#: The first pass leaves out pairs that share fewer index entries; the second finds what they may have hidden.
FIRST_SHARED = 4
#: While more pairs of components than this for each row of the matrix lie ahead, likely links are looked for first.
EXHAUSTIVE = 1
#: The search goes on while at least this part of the pairs that it compares links.
YIELD = 0.15


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle, no words none."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = windows_of(h, k)
    out = []
    for first, n in zip(w.first.tolist(), w.count.tolist()):
        if n >= k:
            out.append(np.unique(g[first : first + n - k + 1]))
        elif n:
            x = np.uint64(n)
            for y in h[first : first + n]:
                x = mix(np.array([x], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + y)[0]
            out.append(np.array([x], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A 63-bit number of a set, the same for equal sets; 0 only for the empty set."""
    if not len(s):
        return 0
    x = mix(s)
    a = int(x.sum(dtype=np.uint64)) ^ (int(np.bitwise_xor.reduce(x * np.uint64(0x9E3779B97F4A7C15) + (x >> np.uint64(7)))) * 3 & ((1 << 64) - 1)) ^ len(s) << 40
    return max(1, int(mix(np.array([a & ((1 << 64) - 1)], np.uint64))[0] >> np.uint64(1)))


def needed(n: int, percent: int = PERCENT) -> int:
    """The overlap that a set of n needs at least to link with anything."""
    return -(-percent * n // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch_of(s: np.ndarray) -> bytes:
    """A bitmap of a set: the bits of its hashes modulo a power of two of 2 to 4 times its size, 64 at least."""
    m = 1 << max(6, (2 * len(s) - 1).bit_length())
    bits = np.zeros(m, dtype=bool)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap brought down to `size` bytes: bits that are alike modulo fewer bits fall together."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def union_of(sketches: list[bytes]) -> bytes:
    """The bitmap of the union, at the size of the smallest."""
    size = min(map(len, sketches))
    return np.bitwise_or.reduce([folded(np.frombuffer(x, np.uint8), size) for x in sketches]).tobytes()


def most_shared(n: int, sketch: bytes, union: bytes) -> int:
    """No subset of the union shares more than this with the set of n: each bit that the union lacks is a shingle that it lacks."""
    size = min(len(sketch), len(union))
    q, u = folded(np.frombuffer(sketch, np.uint8), size), folded(np.frombuffer(union, np.uint8), size)
    return n - int(np.bitwise_count(q & ~u).sum())


# passes over the texts


def _sets_and_sketch(docs: DataFrame, k: int) -> DataFrame:
    """For each row: its set's number and size (kind 0); for each task: its part of the sketch (kind 1)."""

    def run(it):
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch, texts in slices(it, "text"):
            sets = shingle_sets(texts, k)
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([None] * n, pa.binary())], names=["kind", "id", "fp", "n", "data"])
        import zstandard

        if counts.any():
            part = [zstandard.compress(x.astype("<u4").tobytes(), 1) for x in counts.reshape(SKETCH_ROWS, -1)]
            n = SKETCH_ROWS
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([None] * n, pa.int64()), pa.array(list(range(n)), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(part, pa.binary())], names=["kind", "id", "fp", "n", "data"])

    return docs.mapInArrow(run, "kind int, id long, fp long, n long, data binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """The sum of the parts as 8 times the logarithm, a byte each: SKETCH bytes, whatever the input."""
    import zstandard

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // SKETCH_ROWS, dtype=np.int64)
        for data in table.column("data").to_pylist():
            total += np.frombuffer(zstandard.decompress(data), "<u4")
        level = np.minimum(255, np.ceil(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        return pa.table({"fp": pa.array([table.column("fp")[0].as_py()], pa.int64()), "data": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros((SKETCH_ROWS, SKETCH // SKETCH_ROWS), dtype=np.uint8)
    for r in parts.groupBy("fp").applyInArrow(add, "fp long, data binary").collect():
        out[r[0]] = np.frombuffer(r[1], np.uint8)
    return out.reshape(-1)


def _index(docs: DataFrame, sketch, buckets: int, k: int, percent: int) -> DataFrame:
    """Index entries (shingle, set, size and rest) of every set's prefix, in pieces by bucket; equal sets once for each task.

    rest: how many shingles of the set, in the common order, are not before the entry."""

    def flush(tokens, owner, size):
        token, fp, n = np.concatenate(tokens), np.concatenate(owner), np.concatenate(size)
        level = sketch.value[(token & np.uint64(SKETCH - 1)).astype(np.int64)]
        split = np.ceil(2.0 ** (level / 8.0) / LIST).astype(np.uint64)
        to = (mix(token + (fp.view(np.uint64) % np.maximum(split, np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.diff(to[order])) + 1
        parts = np.split(order, cut)
        data = [np.concatenate([token[x].view(np.int64), fp[x], n[x]]).astype("<i8").tobytes() for x in parts]
        return pa.RecordBatch.from_arrays([pa.array([int(to[x[0]]) for x in parts], pa.int64()), pa.array(data, pa.binary())], names=["to", "data"])

    def run(it):
        tokens, owner, size, held, known = [], [], [], 0, set()
        for _, texts in slices(it, "text"):
            for s in shingle_sets(texts, k):
                n = len(s)
                fp = set_id(s)
                if not n or fp in known:
                    continue
                known.add(fp)
                take = n - needed(n, percent) + 1
                rank = (sketch.value[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(s) >> np.uint64(8))
                tokens.append(s[np.argsort(rank, kind="stable")[:take]])
                owner.append(np.full(take, fp, dtype=np.int64))
                size.append((n << 32) + n - np.arange(take, dtype=np.int64))
                held += take
            if held > FLUSH:
                yield flush(tokens, owner, size)
                tokens, owner, size, held = [], [], [], 0
            if len(known) > 1 << 18:
                known.clear()
        if held:
            yield flush(tokens, owner, size)

    return docs.mapInArrow(run, "to long, data binary")


def _lists(sketch):
    """Of a bucket: the different lists of at least two sets that share a shingle, and how many shingles have that list.

    Shingles whose lists are split (by the sketch, so everywhere alike) keep the shingle as their key."""

    def run(table: pa.Table) -> pa.Table:
        settle()
        data = [np.frombuffer(x, "<i8").reshape(3, -1) for x in table.column("data").to_pylist()]
        token, fp, n = np.concatenate(data, axis=1)
        order = np.lexsort((fp, token))
        token, fp, n = token[order], fp[order], n[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
        token, fp, n = token[new], fp[new], n[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(first, len(token)))
        level = sketch.value[(token[first].view(np.uint64) & np.uint64(SKETCH - 1)).astype(np.int64)]
        split = np.ceil(2.0 ** (level / 8.0) / LIST) > 1
        sums = np.add.reduceat(mix(fp.view(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
        key = np.where(split, token[first].view(np.uint64), mix(sums + count.astype(np.uint64))).view(np.int64)
        at = np.flatnonzero((count > 1) | split)
        _, pick, same, weight = np.unique(key[at], return_index=True, return_inverse=True, return_counts=True)
        # of shingles with one list, each set's largest rest counts
        size = count[at]
        ends = np.cumsum(count[at[pick]])
        into = np.repeat((ends - count[at[pick]])[same], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        come = np.repeat(first[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        total = int(ends[-1]) if len(ends) else 0
        ids, sizes = np.zeros(total, np.int64), np.zeros(total, np.int64)
        ids[into] = fp[come]
        np.maximum.at(sizes, into, n[come])
        cut = pa.array(np.append(0, ends).astype(np.int32))
        at = at[pick]
        lists = (pa.ListArray.from_arrays(cut, pa.array(x, pa.int64())) for x in (ids, sizes >> 32, sizes & 0xFFFFFFFF))
        return pa.table([pa.array(key[at], pa.int64()), pa.array(split[at]), *lists, pa.array(weight, pa.int64())], names=["key", "split", "fps", "ns", "rs", "weight"])

    return run


_LISTS = "key long, split boolean, fps array<bigint>, ns array<bigint>, rs array<bigint>, weight long"


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(fp, n, z, bits): the compressed text of one row for each wanted set, and its bitmap; equal sets are combined on the map side."""

    def run(it):
        import zstandard

        known: set[int] = set()
        pack = zstandard.ZstdCompressor(level=6, write_checksum=False).compress
        for _, texts in slices(it, "text"):
            rows = []
            for s, t in zip(shingle_sets(texts, k), texts):
                fp = set_id(s)
                if len(s) and fp not in known:
                    known.add(fp)
                    rows.append((fp, len(s), pack(t), sketch_of(s)))
            if len(known) > 1 << 18:
                known.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["fp", "n", "z", "bits"])

    texts = docs.mapInArrow(run, "fp long, n long, z binary, bits binary").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "z", "bits")))
    return texts.join(wanted, "fp", "left_semi")


# comparing groups


def _open(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between the groups of each row (ma, mb: arrays of (fp, n, z)); one link for two groups suffices."""

    def run(it):
        import zstandard

        settle()
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}

        def sets(members):
            new = [m for m in members if m["fp"] not in known]
            if len(known) > 512:
                known.clear()
                new = members
            if new:
                known.update(zip([m["fp"] for m in new], shingle_sets([unpack(m["z"]) for m in new], k)))
            return [(m["fp"], known[m["fp"]]) for m in members]

        def union(group):
            return group[0][1] if len(group) == 1 else np.unique(np.concatenate([s for _, s in group]))

        def compare(a, b):
            least = min(len(s) for _, s in b)
            ua, ub = union(a), union(b)
            if len(np.intersect1d(ua, ub, assume_unique=True)) < needed(max(min(len(s) for _, s in a), least), percent):
                return None
            for fq, q in a:
                # a member of b that links shares this much with q, so does the union
                if len(np.intersect1d(q, ub, assume_unique=True)) < needed(max(len(q), least), percent):
                    continue
                for fd, d in b:
                    if similar(q, d, percent):
                        return fq, fd
            return None

        for batch in it:
            out = []
            for ma, mb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both = dict(sets(ma + mb))
                link = compare([(m["fp"], both[m["fp"]]) for m in ma], [(m["fp"], both[m["fp"]]) for m in mb])
                if link:
                    out.append(link)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["a", "b"])

    return rows.select("ma", "mb").mapInArrow(run, "a long, b long")


def _compare_pairs(pairs: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the groups of each pair (ga, gb)."""
    left = groups.select(F.col("g").alias("ga"), F.col("members").alias("ma"))
    right = groups.select(F.col("g").alias("gb"), F.col("members").alias("mb"))
    return _open(pairs.join(left, "ga").join(right, "gb"), k, percent)


def _unions(sketches: DataFrame, grouped: DataFrame) -> DataFrame:
    """(g, least, union, sets): each group's union, once, and its members' sizes and bitmaps."""

    def run(it):
        for batch in it:
            sets = batch.column(1).to_pylist()
            least, union = [min(m["n"] for m in x) for x in sets], [union_of([m["bits"] for m in x]) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.int64()), pa.array(union, pa.binary()), batch.column(1)], names=["g", "least", "union", "sets"])

    of = sketches.join(grouped, "fp", "left").select(F.coalesce("g", "fp").alias("g"), F.struct("n", "bits").alias("m"))
    return of.groupBy("g").agg(F.collect_list("m").alias("sets")).mapInArrow(run, "g long, least long, union binary, sets array<struct<n:bigint,bits:binary>>")


def _bounded(pairs: DataFrame, unions: DataFrame, percent: int) -> DataFrame:
    """The pairs (ga, gb) that may link: on both sides some member shares enough with the other's union."""

    def may(sets, union, least):
        return any(most_shared(m["n"], m["bits"], union) >= needed(max(m["n"], least), percent) for m in sets)

    def run(it):
        for batch in it:
            c = {f.name: batch.column(i).to_pylist() for i, f in enumerate(batch.schema)}
            keep = [may(sa, ub, lb) and may(sb, ua, la) for sa, ua, la, sb, ub, lb in zip(c["sa"], c["ua"], c["la"], c["sb"], c["ub"], c["lb"])]
            yield batch.select(["ga", "gb"]).filter(pa.array(keep, pa.bool_()))

    a, b = (unions.select(F.col("g").alias(f"g{x}"), F.col("least").alias(f"l{x}"), F.col("union").alias(f"u{x}"), F.col("sets").alias(f"s{x}")) for x in "ab")
    return pairs.join(a, "ga").join(b, "gb").select("ga", "gb", "sa", "ua", "la", "sb", "ub", "lb").mapInArrow(run, "ga long, gb long")


def _groups(labels: DataFrame, entries: int) -> DataFrame:
    """(fp, comp, g): components as groups of similar documents; large ones in parts of about half GROUP sets.

    g tells the members: a set that is alone keeps its own number, several have a
    negative number made of all of them. A pair of numbers thus stands for the same
    comparison in every pass."""
    size = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    part = F.when(F.col("m") <= GROUP, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / (GROUP // 2))))
    dealt = labels.join(size, "comp").select(F.col("node").alias("fp"), "comp", part.alias("part"))
    w = W.partitionBy("comp", "part")
    dealt = dealt.withColumn("several", F.count(F.lit(1)).over(w)).withColumn("digest", F.bit_xor(F.xxhash64("fp")).over(w))
    own = F.xxhash64("comp", "part", "several", "digest").bitwiseOR(F.lit(-(1 << 63)))
    return written(dealt.select("fp", "comp", F.when(F.col("several") == 1, F.col("fp")).otherwise(own).alias("g")), "grouped", entries)


def _matrix(lists: DataFrame, grouped: DataFrame, entries: int) -> DataFrame:
    """(key, g, comp, least, most, rest): index entries against groups, where more than one component has the entry."""
    row = lists.select("key", F.explode(F.arrays_zip("fps", "ns", "rs")).alias("x")).select("key", F.col("x.fps").alias("fp"), F.col("x.ns").alias("n"), F.col("x.rs").alias("r"))
    row = row.join(grouped, "fp", "left").select("key", F.coalesce("g", "fp").alias("g"), F.coalesce("comp", "fp").alias("comp"), "n", "r")
    row = row.groupBy("key", "g", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("r").alias("rest"))
    several = row.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    return written(row.join(several, "key", "left_semi"), "matrix", entries)


def _chain(row: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each group a few others: neighbours under an entry in an order of that entry's and turn's own, the most frequent first."""
    w = W.partitionBy("key").orderBy(F.xxhash64("g", "key", F.lit(turn)), "g")
    nxt = row.withColumn("x", F.lead(F.struct("g", "comp", "least", "most", "rest")).over(w)).where("x is not null and x.comp <> comp")
    nxt = nxt.select("g", "least", "most", "rest", F.col("x.g").alias("h"), F.col("x.least").alias("l2"), F.col("x.most").alias("m2"), F.col("x.rest").alias("r2")).where(_can_link("least", "most", "rest", "l2", "m2", "r2", percent))
    pair = nxt.groupBy(F.least("g", "h").alias("ga"), F.greatest("g", "h").alias("gb")).agg(F.count(F.lit(1)).alias("n"))
    ends = pair.select(F.explode(F.array("ga", "gb")).alias("end"), F.struct("ga", "gb").alias("x"), "n")
    orders = (F.struct("n", F.xxhash64("x")), F.xxhash64("x", "end"), F.xxhash64("end", "x", F.lit(1)))
    best = ends.groupBy("end").agg(*(F.max_by("x", o).alias(f"x{i}") for i, o in enumerate(orders)))
    return best.select(F.explode(F.array("x0", "x1", "x2")).alias("x")).select("x.ga", "x.gb").distinct()


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """pairs without those of the same members on both sides that were compared before."""
    return pairs.join(tried.select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")), ["ga", "gb"], "left_anti")


def _members(texts: DataFrame, grouped: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, members) of the groups in pairs."""
    used = pairs.select(F.col("ga").alias("g")).union(pairs.select("gb")).distinct()
    return texts.join(grouped, "fp", "left").select(F.coalesce("g", "fp").alias("g"), F.struct("fp", "n", "z").alias("m")).join(used, "g", "left_semi").groupBy("g").agg(F.collect_list("m").alias("members"))


def _can_link(a_least: str, a_most: str, a_rest: str, b_least: str, b_most: str, b_rest: str, percent: int):
    """Sizes are near enough, and from their first common shingle on both sets are long enough for the overlap that a link needs.

    What two sets share is not before their first common entry, so a pair that links
    meets this under that entry."""
    c = F.col
    sizes = (100 * c(a_most) >= percent * c(b_least)) & (100 * c(b_most) >= percent * c(a_least))
    return sizes & ((100 + percent) * F.least(c(a_rest), c(b_rest)) >= percent * (c(a_least) + c(b_least)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle
    sets; component_id is the smallest id reachable. Ids are whole numbers. Rows
    without words are linked with nothing: their component is their own id. Null ids
    count for no component's smallest id; a component without any id has a null one.
    Rows that share a text or an id are in one component by their sets alone; an empty
    table gives an empty one. Sets are known by 63-bit numbers and shingles by 64-bit
    ones. No link is lost: prefixes, size bounds and unions only leave out pairs that
    cannot link, and two sets already connected."""
    from docfacts.llm.common import n_blocks

    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    first = written(_sets_and_sketch(d, shingle), "sets")
    base = first.where("kind = 0").select("id", "fp", "n")
    sketch = spark.sparkContext.broadcast(_sketch(first.where("kind = 1")))
    buckets = max(MIN_BUCKETS, n_blocks(d, "text", BUCKET_BYTES))
    text = d.select("text")
    lists = written(_index(text, sketch, buckets, shingle, percent).groupBy("to").applyInArrow(_lists(sketch), _LISTS), "lists")

    # first pass: each set against the one it shares most with
    entry = lists.select("key", "split", "weight", F.col("fps")[0].alias("a"), F.col("ns")[0].alias("na"), F.col("rs")[0].alias("ra"), F.explode(F.arrays_zip("fps", "ns", "rs")).alias("x"))
    star = entry.select("a", "na", F.col("x.fps").alias("b"), F.col("x.ns").alias("nb"), "weight", "ra", F.col("x.rs").alias("rb"))
    heads = lists.where("split").select("key", F.struct(F.col("fps")[0].alias("fp"), F.col("ns")[0].alias("n"), F.col("rs")[0].alias("r")).alias("head"))
    top = heads.groupBy("key").agg(F.min("head").alias("top"))
    chain = heads.join(top, "key").select(F.col("top.fp").alias("a"), F.col("top.n").alias("na"), F.col("head.fp").alias("b"), F.col("head.n").alias("nb"), F.lit(FIRST_SHARED).cast("long").alias("weight"), F.col("top.r").alias("ra"), F.col("head.r").alias("rb"))
    star = star.union(chain).where((F.col("a") != F.col("b")) & _can_link("na", "na", "ra", "nb", "nb", "rb", percent))
    star = star.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.min(F.least("na", "nb")).alias("n"))
    best = star.where((F.col("weight") >= FIRST_SHARED) | (F.col("n") < 10 * FIRST_SHARED)).groupBy("b").agg(F.max(F.struct("weight", "a")).alias("x"))
    entries = lists.agg(F.sum(F.size("fps"))).first()[0] or 0
    pairs = written(best.select(F.col("x.a").alias("ga"), F.col("b").alias("gb")), "pairs", entries)
    wanted = lists.where("size(fps) > 1 or split").select(F.explode("fps").alias("fp")).distinct()
    texts = written(_texts(text, wanted, shingle), "texts")
    single = texts.select(F.col("fp").alias("g"), F.array(F.struct("fp", "n", "z")).alias("members"))
    links = written(_compare_pairs(pairs, single, shingle, percent), "links")
    tried, labels, turn, useful = pairs, components(links, rows=entries), 0, True
    sketches, texts = texts.select("fp", "n", "bits"), texts.select("fp", "n", "z")

    def look(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The pairs that the unions' bounds let through, and the links that opening them finds."""
        opened = written(_bounded(pairs, unions, percent), name, entries)
        return opened, written(_compare_pairs(opened, _members(texts, grouped, opened), shingle, percent), "links")

    while True:
        release(spark)
        grouped = _groups(labels, entries)
        unions = written(_unions(sketches, grouped), "unions")
        row = _matrix(lists, grouped, entries)
        n, ahead = row.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("comp").alias("c")).agg(F.sum("n"), F.sum(F.expr("c * (c - 1) / 2"))).first()
        if not useful or (ahead or 0) <= EXHAUSTIVE * (n or 0):
            break
        turn += 1
        # many components meet under the same entries: join what is alike before all of them are paired
        some = written(_untried(_chain(row, percent, turn), tried), "chain", entries)
        opened, more = look(some, "opened")
        useful = more.count() >= YIELD * opened.count() > 0
        tried = tried.union(some)
        labels = extend(labels, more, rows=entries)

    # second pass: all groups of different components that share an index entry
    a, b = (row.select("key", *(F.col(c).alias(f"{p}{c}") for c in ("g", "comp", "least", "most", "rest"))) for p in "ab")
    cross = a.join(b, "key").where((F.col("ag") < F.col("bg")) & (F.col("acomp") != F.col("bcomp")) & _can_link("aleast", "amost", "arest", "bleast", "bmost", "brest", percent))
    _, more = look(_untried(cross.select(F.col("ag").alias("ga"), F.col("bg").alias("gb")).distinct(), tried), "cross")
    labels = extend(labels, more, rows=entries)
    release(spark)

    # the smallest id of each component
    smallest = base.where("fp <> 0").groupBy("fp").agg(F.min("id").alias("least")).join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    smallest = written(smallest, "least")
    of = smallest.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = written(smallest.join(of, "comp").select("fp", "component_id"), "of")
    out = base.join(of, "fp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("fp") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that are the first, by id, of their component.

    Rows with a null id are kept, and so are rows that share the id of a row kept."""
    found = near_duplicates(docs, id_col, text_col, **kw)
    later = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(later, id_col, "left_anti").select(*docs.columns)
