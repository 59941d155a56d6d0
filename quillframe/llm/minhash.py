"""Near-duplicate documents: MinHash with banding, verification, and connected components.

1. One narrow pass reads whole texts and keeps, for each document, the size of its set of word
   shingles, a 128-bit fingerprint of the set, `bands` band keys and a sketch of one byte for
   each of bands x rows universal hash minima.
2. Documents with equal sets are one class; only its smallest id goes on. Thousands of copies
   thus cost one row each, and never a pair.
3. In every bucket (equal band key) each class is paired with the bucket's pivot: the class that
   meets most others over all its buckets, as the common origin of many copies does. Pairs pass
   the signature check (an estimate far below the threshold ends here), then are confirmed on
   full shingle sets made anew from both texts. Components come from the confirmed links. In
   buckets of more than BLOCK classes this is repeated, with a member of the bucket's largest
   component as the pivot and the classes outside it, until a round joins nothing.
4. In buckets that still hold several components, every class outside the largest one is held
   against all classes of other components: first by signatures, each pair in the first bucket
   that it shares, found from the band keys themselves; then classes with a close partner by
   their full sets. A task first lets a few of the largest component look for others, follows
   the components as they join, and tells only links that join some. So every pair that shares
   a bucket is in one component or has been checked, and none is told for each pair of a group.

A bucket that fits a block (16,384 classes, 16 MB of sets) sends each row once. Of a larger one
the rows outside its largest component go to every block: with n rows of which k are outside,
n * k / BLOCK, as any exact check of k rows that link with none of n must in some form.

With 42 bands of 6 rows a pair at similarity 0.8 shares no bucket with probability 3e-6, and
less above; the signature check fails it with probability below 1e-11.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with
nothing; a text with fewer words than a shingle has its whole word sequence as one shingle. A
row with a null id is linked with nothing (component_id null, kept true). Exact repeats of a row
get equal results; rows that share an id but not the text are linked each by its text, and all
belong to one component. An empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import U64, cut, mix64, release, slices, small_batches, stored
from quillframe.llm.components import connected_components
from quillframe.llm.vectors import by_key

BLOCK, BYTES = 16_384, 16 << 20  # classes, and bytes of full sets, of a bucket that a task compares with as many
FEW = 64  # classes of a bucket whose pairs are looked at together with those of other buckets
PAIRS = 1 << 15  # at a time


def shingles(text: str, words: int) -> np.ndarray:
    """The set of word shingles as sorted 64-bit hashes; A-Z count as lower case, blanks are space and 09-0D."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII rules
    if not found:
        return np.zeros(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), U64, len(found))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, U64)
    for k in range(size):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def universal(n: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=U64)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash over the set, in slices that bound memory."""
    out = np.full(len(a), np.iinfo(U64).max, U64)
    for i in range(0, len(hashes), 4096):
        np.minimum(out, (a[:, None] * hashes[None, i : i + 4096] + b[:, None]).min(axis=1), out=out)
    return out >> U64(32)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """docs: id, text. Returns id, n_shingles, fp (null for an empty set), keys, sketch."""
    a, b = universal(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sizes, prints, keys, sketches = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text or "", words)
                    sizes.append(len(found))
                    if not len(found):
                        prints.append(None)
                        keys.append(None)
                        sketches.append(None)
                        continue
                    low = minima(found, a, b)
                    key = np.arange(bands, dtype=U64)
                    for column in low.reshape(bands, rows).T:
                        key = mix64(key * U64(0x9E3779B97F4A7C15) + column)
                    prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(key.view(np.int64))
                    sketches.append(low.astype(np.uint8).tobytes())
                arrays = [pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["id", "n_shingles", "fp", "keys", "sketch"])

    return docs.mapInArrow(run, "id long, n_shingles long, fp binary, keys array<long>, sketch binary")


def least_matches(bands: int, rows: int, percent: int) -> int:
    """Equal sketch bytes that a pair at the threshold shows but with probability below 1e-11."""
    n, p = bands * rows, percent / 100
    return int(n * p - 7 * (n * p * (1 - p)) ** 0.5)


def alike(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of class ids whose signatures agree in `least` places at least."""
    left = classes.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((sa == sb).sum(axis=1) >= least))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough, as links u, v. texts: id, text."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, U64)
        for batch in batches:
            u, v = [], []
            for part in slices(batch, 3):
                for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in range(4))):
                    if a != last:
                        last, mine = a, shingles(ta, words)
                    other = shingles(tb, words)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(other) - both):
                        u.append(a)
                        v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    # the second join leaves the rows of one a together, by which its set is made once
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def in_blocks(buckets: DataFrame, weight: Column | None = None) -> DataFrame:
    """Rows of buckets (key) that hold several components (comp), dealt to tasks, with the columns task, asks and answers.

    Rows outside a bucket's largest component ask, all rows answer. Those who answer are dealt to blocks,
    those who ask to groups, of BLOCK rows and BYTES of weight at most; every block and group of a bucket
    are one task. Of a bucket that is one block each row goes to one task, once.
    """
    sums = [F.count("*").alias("m"), F.sum(F.lit(0) if weight is None else weight).alias("w")]
    each = buckets.groupBy("key", "comp").agg(*sums)
    sizes = each.groupBy("key").agg(F.max(F.struct("m", "comp", "w")).alias("top"), F.sum("m").alias("n"), F.sum("w").alias("w")).where("n > top.m")
    parts = lambda n, w: F.ceil(F.greatest(n / F.lit(BLOCK), w / F.lit(BYTES), F.lit(1))).cast("int")
    sizes = sizes.select("key", F.col("top.comp").alias("main"), parts(F.col("n"), F.col("w")).alias("blocks"), parts(F.col("n") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("groups"))
    ask, b, g = F.col("comp") != F.col("main"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda g, b, asks, answers: F.struct(F.xxhash64("key", g, b).alias("task"), asks.alias("asks"), answers.alias("answers"))
    own = F.transform(numbers(F.col("groups")), lambda x: cell(x, b, ask & (x == g), F.lit(True)))
    others = F.transform(F.filter(numbers(F.col("blocks")), lambda x: ask & (x != b)), lambda x: cell(g, x, F.lit(True), F.lit(False)))
    return buckets.join(sizes, "key").select(*buckets.columns, F.explode(F.concat(own, others)).alias("cell")).select(*buckets.columns, "cell.*")


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of every run of equal keys."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist())) if len(keys) else []


def as_matrix(values: list[bytes]) -> np.ndarray:
    """Rows of bytes, filled to whole 64-bit words."""
    rows = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))


def agreeing(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Number of equal bytes among the first `width` of rows as_matrix() gave, at most 255 words long."""
    lanes = (x == y).view(U64).sum(axis=1, dtype=U64)
    lanes = (lanes & U64(0x00FF00FF00FF00FF)) + (lanes >> U64(8) & U64(0x00FF00FF00FF00FF))
    return (lanes * U64(0x0001000100010001) >> U64(48)).astype(np.int64) - (-width % 8)


def takers(buckets: DataFrame, bands: int, rows: int, least: int) -> DataFrame:
    """key, id, comp of the rows that are close to one of another component. buckets: key, band, id, comp, keys, sketch.

    Close: the signatures agree in `least` places at least, and this bucket is the first that the two share.
    """
    width = bands * rows

    def close(x, y, sketch: np.ndarray, keys: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which of the pairs (rows x or the row x, rows y) are close."""
        out = agreeing(sketch[x], sketch[y], width) >= least
        some = np.flatnonzero(out)
        left = keys[x[some]] if isinstance(x, np.ndarray) else keys[x]
        out[some] = (left == keys[y[some]]).argmax(axis=1) == band[y[some]]
        return out

    def find(t: pa.Table) -> Iterator[pa.RecordBatch]:
        comp, band, asks, answers = (t.column(c).to_numpy() for c in ("comp", "band", "asks", "answers"))
        sketch = as_matrix(t.column("sketch").to_pylist())
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(comp), bands)
        hit = np.zeros(len(comp), bool)
        few: list[tuple[int, int]] = []
        for a, b in runs(t.column("task").to_numpy()):
            if b - a <= FEW:
                few.append((a, b))
                continue
            here = slice(a, b)
            for x in np.flatnonzero(asks[here]) + a:
                if hit[here].all():
                    break
                # a pair of which both are known to take part need not be looked at
                y = np.flatnonzero(answers[here] & (comp[here] != comp[x]) & ~(hit[x] & hit[here])) + a
                y = y[close(int(x), y, sketch, keys, band)]
                hit[y] = True
                hit[x] |= len(y) > 0
        if few:
            lows, highs = np.array(few).T
            which = np.repeat(np.arange(len(few)), highs - lows)
            row = np.arange(len(which)) - np.repeat(np.cumsum(highs - lows) - (highs - lows), highs - lows) + lows[which]
            ask = asks[row]
            x_all, low, size = row[ask], lows[which[ask]], (highs - lows)[which[ask]]
            before = np.concatenate([[0], np.cumsum(size)])
            for i in range(0, int(before[-1]), PAIRS):
                n = np.arange(i, min(i + PAIRS, int(before[-1])))
                at = np.searchsorted(before, n, side="right") - 1
                x, y = x_all[at], low[at] + n - before[at]
                good = answers[y] & (comp[x] != comp[y]) & ((x < y) | ~asks[y] | ~answers[x])
                x, y = x[good], y[good]
                ok = close(x, y, sketch, keys, band)
                hit[x[ok]] = True
                hit[y[ok]] = True
        yield t.select(["key", "id", "comp"]).filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["key", "id", "comp"])

    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return by_key(in_blocks(buckets), "task", find, "key long, id long, comp long", 5000, parts).distinct()


class Shared:
    """Sizes of the intersections of a group's sets, exactly: as bits over the shingles that two sets hold at least, where these are few."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes, self.bits = sets, np.array([len(s) for s in sets]), None
        if len(sets) > FEW:
            _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            width = int((count > 1).sum())
            if len(sets) * width <= 8 * BYTES:
                column = np.cumsum(count > 1) - 1
                held = count[code] > 1
                owner = np.repeat(np.arange(len(sets)), self.sizes)[held]
                code = column[code[held]]
                words = max(1, -(-width // 64))
                self.bits = np.zeros((len(sets), words), U64)
                for i in range(0, len(sets), 256):
                    some = slice(*np.searchsorted(owner, [i, i + 256]))
                    dense = np.zeros((min(256, len(sets) - i), 64 * words), bool)
                    dense[owner[some] - i, code[some]] = True
                    self.bits[i : i + 256] = np.packbits(dense, axis=1).view(U64)

    def both(self, x: int, ys: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[ys] & self.bits[x]).sum(axis=1, dtype=np.int64)
        mine, out = self.sets[x], []
        for at in range(0, len(ys), 256):
            some = [self.sets[k] for k in ys[at : at + 256]]
            sizes, flat = np.array([len(s) for s in some]), np.concatenate(some)
            place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            out.append(np.add.reduceat((mine[place] == flat).astype(np.int64), np.cumsum(sizes) - sizes))
        return np.concatenate(out)


def links_across(buckets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links u, v between components of one bucket; of those that join the same components in a task, the first.

    buckets: key, id, comp, hashes (the full shingle set). A row that has come to the largest component need not ask.
    """

    def joins(ids: np.ndarray, comp: np.ndarray, asks: np.ndarray, answers: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        out, root, shared = [], comp.copy(), Shared(sets)
        main = comp[~asks & answers]
        main = main[0] if len(main) else None

        def ask(x: int, among: np.ndarray) -> None:
            y = np.flatnonzero(among & (root != root[x]))
            if len(y):
                both = shared.both(x, y)
                for k in y[100 * both >= percent * (shared.sizes[x] + shared.sizes[y] - both)]:
                    if root[k] != root[x]:
                        out.append((ids[x], ids[k]))
                        a, b = (root[x], root[k]) if root[k] == main else (root[k], root[x])
                        root[root == a] = b

        if len(ids) > FEW:  # some of the largest component look at all others first
            rows = np.flatnonzero(comp == main)
            for x in rows[:: max(1, len(rows) // 8)]:
                ask(x, asks)
        for x in np.flatnonzero(asks):
            if main is None or root[x] != main:
                ask(x, answers)
        return out

    def find(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, comp, asks, answers = (t.column(c).to_numpy() for c in ("id", "comp", "asks", "answers"))
        sets = [np.frombuffer(h, U64) for h in t.column("hashes").to_pylist()]
        found = [pair for a, b in runs(t.column("task").to_numpy()) for pair in joins(ids[a:b], comp[a:b], asks[a:b], answers[a:b], sets[a:b])]
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return by_key(in_blocks(buckets, F.octet_length("hashes")), "task", find, "u long, v long", 2000, parts)


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """id, hashes: the sorted shingle set of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, words).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["id", "hashes"])

    return texts.select("id", "text").mapInArrow(run, "id long, hashes binary")


def next_pivots(placed: DataFrame, number: int) -> DataFrame:
    """key, main, pivot of buckets of more than BLOCK rows that hold several components: a member of the largest, by chance."""
    each = placed.groupBy("key", "comp").agg(F.count("*").alias("m"), F.max(F.struct(F.xxhash64("id", F.lit(number)).alias("h"), "id")).alias("p"))
    most = each.groupBy("key").agg(F.max(F.struct("m", "comp", "p")).alias("top"), F.sum("m").alias("n"))
    return most.where((F.col("n") > BLOCK) & (F.col("n") > F.col("top.m"))).select("key", F.col("top.comp").alias("main"), F.col("top.p.id").alias("pivot"))


def linked_classes(signed: DataFrame, texts: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """fp, root of each class. texts: id, text, where rows of one id have one set; signed: signatures() of them."""
    spark = texts.sparkSession
    usable = signed.where("id is not null and fp is not null")
    reps = usable.groupBy("fp").agg(F.min("id").alias("rep"))
    first = usable.join(reps.select(F.col("fp").alias("f"), "rep"), (F.col("fp") == F.col("f")) & (F.col("id") == F.col("rep")))
    classes, classes_at = stored(first.select("id", "keys", "sketch").dropDuplicates(["id"]), "classes")

    members = classes.select("id", F.posexplode("keys").alias("band", "key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared, shared_at = stored(members.join(sizes, "key"), "buckets")
    met = shared.groupBy("id").agg(F.sum("m").alias("met"))
    pivots = shared.join(met, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("n"))).alias("p")).select("key", (-F.col("p.n")).alias("pivot"))
    least = least_matches(bands, rows, percent)
    sketches = classes.select("id", "sketch")
    class_texts = texts.where("id is not null")

    def links(pairs: DataFrame) -> DataFrame:
        """Signature check, then full sets, of distinct pairs."""
        close = cut(alike(pairs, sketches, least))
        ends = close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id"))).distinct()
        needed = class_texts.join(ends, "id", "left_semi").dropDuplicates(["id"])
        return cut(confirmed(close, needed, words, percent))

    known = links(shared.join(pivots, "key").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    component = connected_components(known)
    for number in count(1):
        placed = shared.join(component, shared["id"] == component["node"], "left").select("key", "band", "id", F.coalesce("root", "id").alias("comp"))
        pivots = cut(next_pivots(placed, number))
        if pivots.isEmpty():
            break
        more = links(placed.join(pivots, "key").where("comp <> main").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
        if more.isEmpty():
            break
        known = known.union(more)
        component = connected_components(known)

    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    taking, taking_at = stored(takers(placed.join(mixed, "key").join(classes, "id"), bands, rows, least), "takers")
    needed = class_texts.join(taking.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    rest = cut(links_across(taking.join(full_sets(needed, words), "id"), percent))
    if not rest.isEmpty():
        component = connected_components(known.union(rest))
    for path in (taking_at, shared_at, classes_at):
        release(spark, path)
    return reps.join(component, reps["rep"] == component["node"], "left").select("fp", F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 42, rows: int = 6) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links, its own included), kept (component_id is its own)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed, signed_at = stored(signatures(texts, words, bands, rows), "signatures")
    fp = F.xxhash64("fp")
    several = signed.where("id is not null").groupBy("id").agg(F.min(fp).alias("x"), F.max(fp).alias("y")).where("x <> y")
    if several.isEmpty():
        roots = linked_classes(signed, texts, words, percent, bands, rows)
        out = signed.join(roots, "fp", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))
    else:
        release(docs.sparkSession, signed_at)
        out = of_repeated_ids(texts, words, percent, bands, rows)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def of_repeated_ids(texts: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, component_id where rows of one id differ: every different row is linked by itself, and rows of one id belong together."""
    rows_, _ = stored(texts.select("id", F.when(F.col("id").isNotNull(), F.xxhash64("id", "text")).alias("row"), "text"), "rows")
    own = rows_.select(F.col("row").alias("id"), "text")
    signed, _ = stored(signatures(own, words, bands, rows), "signatures")
    roots = linked_classes(signed, own, words, percent, bands, rows)
    one = signed.where("id is not null").select(F.col("id").alias("row"), "n_shingles", "fp").distinct().join(roots, "fp", "left")
    one = cut(rows_.select("id", "row").where("id is not null").distinct().join(one, "row").select("id", "row", "n_shingles", F.coalesce("root", "row").alias("part")))
    first = one.groupBy("id").agg(F.min("part").alias("first"))
    joint = connected_components(one.join(first, "id").select(F.col("part").alias("u"), F.col("first").alias("v")))
    one = one.join(joint, one["part"] == joint["node"], "left").select("id", "row", "n_shingles", F.coalesce("root", "part").alias("part"))
    least = one.groupBy("part").agg(F.min("id").alias("component_id"))
    named = one.join(least, "part").select("row", "n_shingles", "component_id")
    lone = signed.where("id is null").select(F.col("id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return rows_.where("id is not null").join(named, "row").select("id", "n_shingles", "component_id").unionByName(lone)
