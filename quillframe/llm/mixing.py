"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of the id, all blocks being of about one size whatever
their source. A source's target fixes how many whole passes over its blocks the mix makes and how
many further blocks it draws, plus one part of a block so that the words taken end within about
one document of the target. These block quotas are split exactly among the output shards: a binary
tree over the shards draws, at each node, the left half's share from a multivariate hypergeometric
distribution. Every leaf then takes the next blocks of each source's permuted sequence, so draws
are disjoint, and its rows are shuffled locally. What the mix takes of a document is the list of
shards that have drawn its block.

The number of shards follows the data: SHARD_BYTES of text each, LEAST_SHARDS at least, and
MAX_BLOCKS / PER_SHARD at most (beyond 350 GB shards grow instead). The plan is one row for each
block, MAX_BLOCKS + MAX_SOURCES at most (some 30 MB), and meets the documents by a broadcast, so a
hot source needs no shuffle of its documents; the driver gathers no more rows than that in any
step. The exact end of the part block is found in two steps of hash ranges, so that no task orders
more than a small share of a block. More than MAX_SOURCES different sources raise ValueError.

Defined cases: a null text has size 0 and takes 0 words; null sources are one source, which
comes last; rows that repeat (same id and source) get the same decision each; an empty table
gives an empty result; with no words at all, every target is 0. Other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillframe.llm.common import release, stored, word_count

SHARD_BYTES, LEAST_SHARDS, PER_SHARD = 16 << 20, 4, 8  # of text in a shard; shards; blocks of a shard
MAX_BLOCKS, MAX_SOURCES = 1 << 18, 1 << 14

PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("shards", T.ArrayType(T.IntegerType())),  # of the block's whole draws
        T.StructField("part_end", T.LongType()),  # last order key that the part takes, if this is the part block
        T.StructField("part_shard", T.IntegerType()),
    ]
)
BLOCKS = T.StructType([T.StructField("s", T.StringType()), T.StructField("blocks", T.IntegerType())])


def targets(sizes: list[int], weights: tuple[float, ...], share: float, cap: float) -> list[float]:
    """Share the words by weight; what lies above a source's cap goes to the others, by weight again."""
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    most, left, open_ = cap * np.array(sizes, float), share * float(sum(sizes)), np.ones(len(sizes), bool)
    out = np.zeros(len(sizes))
    while open_.any():
        out[open_] = left * weight[open_] / weight[open_].sum()
        over = open_ & (out > most)
        if not over.any():
            break
        out[over] = most[over]
        left -= most[over].sum()
        open_ &= ~over
    return out.tolist()


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of each shard (shards x sources); columns add up to the quotas exactly."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(q: np.ndarray, first: int, end: int) -> None:
        if end - first == 1 or not q.sum():
            out[first] = q
            return
        middle = (first + end) // 2
        n = int(round(q.sum() * (middle - first) / (end - first)))
        left = np.random.default_rng([seed, first, end]).multivariate_hypergeometric(q, n, method="marginals")
        split(left, first, middle)
        split(q - left, middle, end)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def block_of(key: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), blocks).cast("int")


def order_of(key: Column, seed: int) -> Column:
    """Order inside a block: 62 bits that the block number doesn't depend on."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed + 1)), 2)


def with_blocks(rows: DataFrame, key: str, source: str, counts: dict, seed: int) -> DataFrame:
    """rows with __block; counts: blocks of each source."""
    table = rows.sparkSession.createDataFrame(list(counts.items()), BLOCKS).select(F.col("s").alias("__s"), F.col("blocks").alias("__blocks"))
    joined = rows.join(F.broadcast(table), rows[source].eqNullSafe(table["__s"]))  # MAX_SOURCES rows at most
    return joined.select(*rows.columns, block_of(F.col(key), F.col("__blocks"), seed).alias("__block"))


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int | None = None, seed: int = 20) -> tuple[list[tuple], dict, int]:
    """sized: id, source, size, bytes. Returns rows of PLAN, the number of blocks of each source, and the number of shards."""
    found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.sum("bytes").alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # code points, null last
    sources, sizes = [r["source"] for r in found], [int(r["n"]) for r in found]
    aims = targets(sizes, weights, share, cap)
    if shards is None:
        shards = max(LEAST_SHARDS, -(-int(share * sum(r["bytes"] for r in found)) // SHARD_BYTES))
    shards = min(shards, MAX_BLOCKS // PER_SHARD)
    counts = {s: max(1, -(-n * PER_SHARD * shards // max(1, sum(sizes)))) for s, n in zip(sources, sizes)}

    keyed = with_blocks(sized, "id", "source", counts, seed).select("source", "size", F.col("__block").alias("block"), order_of(F.col("id"), seed).alias("o"))
    words = {s: np.zeros(counts[s], np.int64) for s in sources}
    for r in keyed.groupBy("source", "block").agg(F.sum("size").alias("n")).collect():
        words[r["source"]][r["block"]] = r["n"]

    passes, extra, part, rest, orders = [], [], [], [], []
    for i, (s, n) in enumerate(zip(sources, sizes)):
        order = np.random.default_rng([seed, 7, i]).permutation(counts[s])
        whole = int(aims[i] // n) if n else 0
        left = aims[i] - whole * n
        upto = np.cumsum(words[s][order])
        k = int(np.searchsorted(upto, left, side="right")) if n else 0
        rest.append(left - (upto[k - 1] if k else 0))
        # blocks without words may come last: then nothing is left to take from a part
        part.append(int(order[k]) if n and k < len(order) and rest[-1] > 0 else -1)
        passes.append(whole)
        extra.append(k if n and left > 0 else 0)
        orders.append(order)

    ends = part_ends(sized.sparkSession, keyed, sources, part, rest)
    quotas = np.array([passes[i] * counts[s] + extra[i] + (ends[i] is not None) for i, s in enumerate(sources)], np.int64)
    by_shard = split_quotas(quotas, shards, seed) if len(sources) else np.zeros((shards, 0), np.int64)
    rows = []
    for i, source in enumerate(sources):
        draws = [b for _ in range(passes[i]) for b in orders[i].tolist()] + orders[i][: extra[i]].tolist() + ([-1] if ends[i] is not None else [])
        drawn: list[list[int]] = [[] for _ in range(counts[source])]
        part_shard = -1
        for b, shard in zip(draws, np.repeat(np.arange(shards), by_shard[:, i]).tolist()):
            if b < 0:
                part_shard = shard
            else:
                drawn[b].append(shard)
        for b, taken in enumerate(drawn):
            partly = ends[i] is not None and b == part[i]
            rows.append((source, b, sizes[i], float(aims[i]), taken, ends[i] if partly else -1, part_shard if partly else -1))
    return rows, counts, shards


def part_ends(spark: SparkSession, keyed: DataFrame, sources: list, part: list[int], rest: list[float]) -> list[int | None]:
    """For each source, the last order key of its part block whose documents come nearest to the rest of its target."""
    ranges = max(1, min(1024, MAX_BLOCKS // max(1, len(sources))))  # of a part block
    width = (1 << 62) // ranges
    need = [(s, p, float(r)) for s, p, r in zip(sources, part, rest) if p >= 0]
    ends: dict = {}
    if need:
        want = F.broadcast(spark.createDataFrame([(s, p) for s, p, _ in need], "s string, p int"))
        inside = keyed.join(want, keyed["source"].eqNullSafe(want["s"]) & (keyed["block"] == want["p"])).select("source", "size", "o", F.floor(F.col("o") / width).cast("int").alias("sub"))
        sums: dict = {}
        for r in inside.groupBy("source", "sub").agg(F.sum("size").alias("n")).collect():
            sums.setdefault(r["source"], {})[r["sub"]] = r["n"]
        last = []
        for s, _, r in need:
            for sub, n in sorted(sums[s].items()):
                if n and r < n:
                    last.append((s, sub, r))
                    break
                r -= n
        ends = {s: None for s, _, _ in need}
        if last:
            finest = F.broadcast(spark.createDataFrame(last, "s string, p int, r double"))
            docs = inside.join(finest, inside["source"].eqNullSafe(finest["s"]) & (inside["sub"] == finest["p"]))
            upto = F.sum("size").over(Window.partitionBy("source", "sub").orderBy("o").rangeBetween(Window.unboundedPreceding, 0))
            near = docs.select("source", "sub", "o", "r", "size", upto.alias("upto")).where(F.col("upto") - F.col("size") / 2 <= F.col("r"))
            ends |= {s: sub * width - 1 for s, sub, _ in last}
            ends |= {r["source"]: r["o"] for r in near.groupBy("source").agg(F.max("o").alias("o")).collect()}
    return [ends.get(s) if p >= 0 else None for s, p in zip(sources, part)]


def decided(rows: DataFrame, key: str, source: str, plan: list[tuple], counts: dict, seed: int = 20) -> DataFrame:
    """rows with __source_size, __target and __shards: one shard for each time the mix takes the row."""
    table = rows.sparkSession.createDataFrame(plan, PLAN).select(*(F.col(f).alias(f"__p_{f}") for f in PLAN.names))
    placed = with_blocks(rows, key, source, counts, seed)
    # a row for each block, MAX_BLOCKS + MAX_SOURCES at most
    joined = placed.join(F.broadcast(table), placed[source].eqNullSafe(table["__p_source"]) & (placed["__block"] == table["__p_block"]))
    partly = order_of(F.col(key), seed) <= F.col("__p_part_end")
    shards = F.when(partly, F.concat("__p_shards", F.array("__p_part_shard"))).otherwise(F.col("__p_shards"))
    return joined.select(*rows.columns, F.col("__p_source_size").alias("__source_size"), F.col("__p_target").alias("__target"), shards.alias("__shards"))


def sized_table(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), size.alias("bytes"))


def mix_plan_of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20, **options) -> DataFrame:
    """id, source, size, source_size, target, taken, shards: what the mix takes of each document, and the shards it goes to (joined by commas)."""
    sized, _ = stored(sized_table(docs, id_col, text_col, source_col), "sizes")
    plan, counts, _ = plan_mix(sized, seed=seed, **options)
    out = decided(sized, "id", "source", plan, counts, seed)
    shards = F.array_join(F.array_sort("__shards").cast("array<string>"), ",")
    return out.select(F.col("id").alias(id_col), "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.size("__shards")).alias("taken"), shards.alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, one partition for each shard, shuffled inside it.

    Documents without words take no part in a mix of words; they are left out.
    """
    sized, at = stored(sized_table(docs, id_col, text_col, source_col), "sizes")
    plan, counts, shards = plan_mix(sized, seed=seed, **options)
    release(docs.sparkSession, at)
    taken = decided(docs, id_col, source_col, plan, counts, seed).where(word_count(F.col(text_col)) > 0)
    rows = taken.select(*docs.columns, F.posexplode("__shards").alias("__copy", "__shard"))
    local = F.xxhash64(F.col(id_col), F.col("__copy"), F.lit(seed + 2))
    return rows.repartitionById(shards, "__shard").sortWithinPartitions(local).select(*docs.columns)
