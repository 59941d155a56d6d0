"""Removal of every byte that a string of `length` bytes covers which starts anywhere else too.

Blockwise suffix comparison over a cover sample, with bounded memory:

1. Cover sample. Of all suffixes only those at sampled positions are named. A position is
   sampled by content: its GRAM bytes have the least hash in some window of `length` bytes. So
   every string of `length` bytes holds a sampled position, and equal strings hold it at the
   same place (about 2 in 170 positions; a periodic cover needs 12 in 133 for the same reach).
2. Names. Each sampled suffix gets two names, fixed in one pass: of its first GRAM bytes (the
   bucket) and of its whole surroundings, from which every string of `length` bytes that holds
   it is cut. Equal surroundings are the long ties: they are settled by their names alone, and
   all such strings repeat. Buckets with one occurrence end here.
3. Buckets. What is left is where surroundings differ inside a bucket. Those bytes are fetched,
   and the strings of the bucket are sorted one block at a time: strings at one distance from
   the sample compare by 8 bytes at either end and, for what lies between, by ranks that a
   difference cover (period 13) of the surroundings has been given beforehand.
   Buckets of more than `hot` different surroundings (say, a phrase in a third of all
   documents) are dealt out by the strings' hashes instead, so no task holds such a bucket.

All strings holding one sample overlap in it, so each occurrence yields one stretch of bytes;
a document's stretches are merged next to its text.

What this is not: no suffix array is ever in order. Positions are sampled by content, buckets and
ranks are hashes, and equal hashes are taken for equal bytes without a look at these. Names that
decide a long tie are pairs of 64-bit hashes: over 100 TB (10^12 samples) two different
surroundings share a pair with probability 10^-15. Inside a bucket of m surroundings strings
compare by one 64-bit key for each of 169 distances: 169 * m^2 / 2^65, which is 2 * 10^-9 for the
largest bucket that a task holds (20,000).

Defined cases: a null text counts as empty; texts shorter than `length` lose nothing; matches
never cross documents, but may overlap in one. Rows that repeat are occurrences of their own.
Null ids are allowed. An empty table gives an empty result. Only the id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import U64, mix64, release, slices, small_batches, stored

GRAM = 32
SEGMENT = 1 << 20  # positions hashed at a time
PERIOD, COVER = 13, (0, 1, 3, 9)  # a difference cover: every difference mod 13 is one of two elements
END = 8  # bytes compared at either end of a string
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=U64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers of BASE, from which any substring's hash follows."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(byte_values()[data] * powers(BASE, SEGMENT + 4096)[: len(data)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(INVERSE, SEGMENT + 4096)[start]


def sliding(x: np.ndarray, n: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best over every n neighbours of x: out[i] = best(x[i : i + n])."""
    size = -(-len(x) // n) * n
    padded = np.full(size + n, fill, U64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, n)
    ahead = best.accumulate(rows, axis=1).reshape(-1)
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = len(x) - n + 1
    return best(back[:m], ahead[n - 1 : n - 1 + m])


def sampled(data: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of concatenated texts, the hashes of their grams, and the prefix hash."""
    prefix = prefix_hash(data)
    n = len(data) - length + 1
    grams = len(data) - GRAM + 1
    at = np.arange(grams)
    h = mix64(substring_hash(prefix, at, at + GRAM)) | U64(1)
    span = length - GRAM + 1
    least = sliding(h, span, np.minimum, np.iinfo(U64).max)[:n]
    least[owner[:n] != owner[length - 1 :]] = 0  # windows across two texts
    padded = np.zeros(len(h) + span - 1, U64)
    padded[span - 1 : span - 1 + n] = least
    chosen = np.flatnonzero(sliding(padded, span, np.maximum, 0)[: len(h)] == h)
    return chosen, h[chosen], prefix


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """docs: id, h, text. Sampled positions: k (name of the gram), c (name of the surroundings), id, h, pos, l and r (bytes known before and after pos)."""
    left = length - GRAM

    def of(parts: list[bytes], first: int) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), sizes)
        if len(data) < length:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        pos, k, prefix = sampled(data, owner, length)
        begin = (np.cumsum(sizes) - sizes)[owner[pos]]
        start = np.maximum(pos - left, begin)
        end = np.minimum(pos + length, begin + sizes[owner[pos]])
        c = mix64(substring_hash(prefix, start, end) + ((pos - start) * 1009 + (end - pos)).astype(U64) * U64(0xD6E8FEB86659FD93))
        return owner[pos] + first, pos - begin, k.view(np.int64), c.view(np.int64), pos - start, end - pos

    def long_text(text: bytes, row: int) -> Iterator[tuple[np.ndarray, ...]]:
        """A long text in overlapping segments; each keeps the samples whose surroundings it holds whole."""
        step = SEGMENT - 4 * length
        for a in range(0, len(text), step):
            b = min(len(text), a + SEGMENT)
            own, pos, k, c, l, r = of([text[a:b]], row)
            keep = ((pos >= 2 * length) | (a == 0)) & ((pos < step + 2 * length) | (b == len(text)))
            yield own[keep], pos[keep] + a, k[keep], c[keep], l[keep], r[keep]
            if b == len(text):
                break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SEGMENT // 4):
                texts = part.column(2).cast(pa.binary()).to_pylist()
                found, some, first, size = [], [], 0, 0
                for i, text in enumerate([t or b"" for t in texts] + [None]):
                    if text is None or size + len(text) > SEGMENT:
                        if some:
                            found.append(of(some, first))
                        some, first, size = [], i, 0
                    if text is not None and len(text) > SEGMENT:
                        found += list(long_text(text, i))
                        first = i + 1
                    elif text is not None:
                        some.append(text)
                        size += len(text)
                own, pos, k, c, l, r = (np.concatenate(x) for x in zip(*found)) if found else of([], 0)
                if len(own):
                    ids = part.select(["id", "h"]).take(pa.array(own))
                    arrays = [pa.array(k), pa.array(c), *ids.columns, *(pa.array(x, pa.int32()) for x in (pos, l, r))]
                    yield pa.RecordBatch.from_arrays(arrays, ["k", "c", "id", "h", "pos", "l", "r"])

    return docs.select("id", "h", "text").mapInArrow(run, "k long, c long, id long, h long, pos int, l int, r int")


def cut_surroundings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around each wanted sample: k, c, n, id, h, pos, l, r, data, m."""
    lists = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("k", "c", "n", "pos", "l", "r", "m")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                if not part.num_rows:
                    continue
                lists = part.column(3)
                flat = lists.flatten()
                own = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                texts = part.column(2).cast(pa.binary()).to_pylist()
                pos, l, r = (flat.field(f).to_numpy() for f in ("pos", "l", "r"))
                data = [texts[i][a:b] for i, a, b in zip(own.tolist(), (pos - l).tolist(), (pos + r).tolist())]
                ids = part.select(["id", "h"]).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*(flat.field(f) for f in ("k", "c", "n")), *ids.columns, *(flat.field(f) for f in ("pos", "l", "r")), pa.array(data, pa.binary()), flat.field("m")], ["k", "c", "n", "id", "h", "pos", "l", "r", "data", "m"])

    both = texts.join(lists, ["id", "h"]).select("id", "h", "text", "w")
    return both.mapInArrow(run, "k long, c long, n long, id long, h long, pos int, l int, r int, data binary, m long")


def window_keys(data: list[bytes], k: np.ndarray, l: np.ndarray, r: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each surroundings and distance j of a string's start before the sample: a key equal for equal strings of a bucket, and whether there is such a string."""
    left, m = length - GRAM, len(data)
    width = left + length
    grid = np.zeros((m, width), np.uint8)
    for i, (d, a) in enumerate(zip(data, l.tolist())):
        grid[i, left - a : left - a + len(d)] = np.frombuffer(d, np.uint8)
    prefix = np.zeros((m, width + 1), U64)
    np.cumsum(byte_values()[grid] * powers(BASE, SEGMENT + 4096)[:width], axis=1, out=prefix[:, 1:])
    words = np.lib.stride_tricks.sliding_window_view(grid, END, axis=1)
    words = np.ascontiguousarray(words).view(">u8")[..., 0].astype(U64)
    gap = max((p - q) % PERIOD for p, q in zip(COVER[1:] + COVER[:1], COVER)) - 1
    middle = length - gap  # bytes that a rank stands for
    ranks = {}
    for p in range(width - middle + 1):
        if p % PERIOD in COVER:
            ranks[p] = mix64(prefix[:, p + middle] - prefix[:, p])
    keys = np.empty((m, left + 1), U64)
    bucket = mix64(k.view(U64))
    for j in range(left + 1):
        s = left - j
        p = next(p for p in range(s, s + gap + 1) if p % PERIOD in COVER)
        tail = words[:, s + length - END]
        keys[:, j] = mix64(mix64(words[:, s] + bucket) * U64(BASE) + ranks[p] * U64(3) + mix64(tail))
    j = np.arange(left + 1)
    return keys, (l[:, None] >= j) & (r[:, None] >= length - j)


def repeated(keys: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Where a column holds the same key in another row. Sorted column by column: one distance is one block."""
    out = np.zeros(keys.shape, bool)
    for j in range(keys.shape[1]):
        rows = np.flatnonzero(there[:, j])
        order = rows[np.argsort(keys[rows, j], kind="stable")]
        same = keys[order[1:], j] == keys[order[:-1], j]
        out[order[1:][same], j] = True
        out[order[:-1][same], j] = True
    return out


def compared(surroundings: DataFrame, length: int) -> DataFrame:
    """Stretches (id, h, start, end) of the samples that occur with their surroundings once. Rows of one k are met together."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        k, n, ids, h, pos, l, r = (np.array([x[i] for x in rows], np.int64) for i in (0, 2, 3, 4, 5, 6, 7))
        keys, there = window_keys([x[8] for x in rows], k, l, r, length)
        hit = repeated(keys, there) & (n == 1)[:, None]
        some = np.flatnonzero(hit.any(axis=1))
        first, last = hit[some].argmax(axis=1), hit.shape[1] - 1 - hit[some, ::-1].argmax(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(h[some]), pa.array((pos[some] - last).astype(np.int32)), pa.array((pos[some] - first + length).astype(np.int32))], ["id", "h", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= 2048 and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    # by an expression: Spark drops a repartition by k above a join by k, and may then read that join's rows where they were written
    return surroundings.repartition(F.xxhash64("k")).sortWithinPartitions("k").mapInArrow(run, "id long, h long, start int, end int")


def compared_hot(surroundings: DataFrame, length: int) -> DataFrame:
    """The same for large buckets: the strings' keys are counted by key, so that no bucket is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                k, l, r = (np.asarray(part.column(c).to_numpy(), np.int64) for c in (0, 6, 7))
                keys, there = window_keys(part.column(8).to_pylist(), k, l, r, length)
                i, j = np.nonzero(there)
                ids = part.select(["n", "id", "h", "pos"]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(k[i]), pa.array(j.astype(np.int32)), pa.array(keys[i, j].view(np.int64)), *ids.columns], ["k", "j", "key", "n", "id", "h", "pos"])

    strings = surroundings.mapInArrow(run, "k long, j int, key long, n long, id long, h long, pos int")
    again = strings.groupBy("k", "j", "key").agg(F.count("*").alias("m")).where("m > 1").select("k", "j", "key")
    hits = strings.where("n = 1").join(again, ["k", "j", "key"]).groupBy("id", "h", "pos").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    return hits.select("id", "h", (F.col("pos") - F.col("b")).alias("start"), (F.col("pos") - F.col("a") + length).alias("end"))


def stretches(docs: DataFrame, length: int = 200, hot: int = 20_000) -> DataFrame:
    """docs: id, h, text. All (id, h, start, end) that repeated strings cover, not merged."""
    spark = docs.sparkSession
    samples, samples_at = stored(anchors(docs.where(F.octet_length("text") >= length), length), "samples")
    # counts are written before they are joined, so that Spark can split a join's hot key (say, of a line in a third of all documents)
    often, often_at = stored(samples.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k"), "often")
    shared, shared_at = stored(samples.join(often, "k"), "shared")
    release(spark, samples_at)
    release(spark, often_at)
    named = shared.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "pos", "l", "r")).alias("at"))
    named, named_at = stored(named.select("k", "c", "n", "at.*"), "named")
    ties = shared.join(named.where("n > 1").select("k", "c"), ["k", "c"]).where(F.col("l") + F.col("r") >= length)
    ties = ties.select("id", "h", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end"))
    mixed, mixed_at = stored(named.groupBy("k").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("k", "m"), "mixed")
    around, around_at = stored(cut_surroundings(docs, named.join(mixed, "k")), "surroundings")
    rest = compared(around.where(F.col("m") <= hot), length)
    if not mixed.where(F.col("m") > hot).isEmpty():
        rest = rest.union(compared_hot(around.where(F.col("m") > hot), length))
    rest, _ = stored(rest, "rest")
    release(spark, around_at)
    release(spark, mixed_at)
    out, _ = stored(ties, "ties")
    for path in (shared_at, named_at):
        release(spark, path)
    return out.union(rest)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot: int = 20_000, keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a row is known by its id, where ids are unique; else by its id and a hash of its text
    ids = texts.select("given", "id")
    unique = ids.where("given is null").isEmpty() and ids.groupBy("id").count().where("count > 1").isEmpty()
    texts = texts.withColumn("h", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    found = stretches(texts.select("id", "h", "text"), length, hot)
    lists = found.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sizes, removed, spans, digests, kept = [], [], [], [], []
                for text, w in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                    left, at, n = [], 0, 0
                    for x in sorted((x["start"], x["end"]) for x in w or ()):
                        if x[0] > at or not n:
                            left.append(text[at : x[0]])
                            n += 1
                        at = max(at, x[1])
                    rest = b"".join([*left, text[at:]])
                    sizes.append(len(text))
                    removed.append(len(text) - len(rest))
                    spans.append(n)
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                arrays = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)] + [pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays, *([pa.array(kept, pa.binary())] * keep_text)], names)

    names = ["given", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] * keep_text)]
    kind = texts.schema["given"].dataType.simpleString()
    both = texts.join(lists, ["id", "h"], "left").select("given", "text", "w")
    out = both.mapInArrow(run, f"given {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    return out.withColumnRenamed("given", id_col)
