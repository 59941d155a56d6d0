"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Graph. Every node keeps its `degree` nearest nodes known so far. First lists come from `trees`
partitions of space by random hyperplanes (each halfway between two nodes of a sample of at most
2 * trees * 40 vectors): nodes of one cell meet in chunks of `leaf`; cells with more rows are
split by a hash. Then rounds of NN-descent: at every node its `joined` nearest neighbours meet
those nodes that have it among theirs, neighbours in both directions, and the node itself. Pairs
are compared once: an entry is new until a round has used it, and pairs of two old entries are
left out, as are nodes without a new entry. Ids are settled first, so that a vector is sent once
to each meeting that needs it. A meeting tells each of its nodes its `told` nearest; answers are
merged with the node's list. A node to which more than `spread` nodes point has several meetings,
so work stays linear and no task holds a hub. Rounds end when fewer than `settled` of the list
entries change.

Search. A query starts from its own node's list if it is a node, else from a fixed set of entry
nodes, keeps a beam of `beam` nodes nearest so far, and in each step expands the `expand`
nearest ones not yet expanded, by two joins with the graph; a query ends when its beam has none.

Vectors travel in their own precision. Chunks are centred and scaled by a power of two before
distances are estimated by inner products, and distances of chosen pairs are made from
differences in double precision, so neither magnitude nor a far origin nor groups of near-copies
spoil them. Chunks hold nodes in a fixed order, so reruns agree.

Rows with equal vectors are one node; of its ids the k + 1 smallest go on, which is all that a
result with ties to the smaller id can name. State between rounds is a table in the shared
folder. Recall against brute force is measured in the tests and given in the README.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, neither do vectors whose length is not the most frequent one's. Rows that repeat an id
count once (with the least vector). A query with fewer candidates gets what there is. An empty
table gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillframe.llm.common import release, stored
from quillframe.llm.vectors import by_key, ranks_within, usable

STATE = "node long, v binary, near array<long>, dist array<double>, fresh array<boolean>"
PLANES = 40  # hyperplanes of a tree at most


def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1).astype(np.float64)


def lists_of(keys: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int, kind: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each key its `most` nearest different ids; keys come out sorted, nearest first. Of entries that repeat, the least kind counts."""
    kind = np.zeros(len(keys), np.int8) if kind is None else kind
    order = np.lexsort((dist, kind, ids, keys))
    keys, ids, dist, kind = keys[order], ids[order], dist[order], kind[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids, dist, kind = keys[first], ids[first], dist[first], kind[first]
    order = np.lexsort((ids, dist, keys))
    keys, ids, dist, kind = keys[order], ids[order], dist[order], kind[order]
    keep = ranks_within(keys) < most
    return keys[keep], ids[keep], dist[keep], kind[keep]


def as_lists(keys: np.ndarray, nodes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values of each of nodes (sorted, all of keys among them) as one list."""
    ends = np.searchsorted(keys, nodes, side="right")
    starts = np.searchsorted(keys, nodes, side="left")
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows by differences, without overflow."""
    diff = x - y
    scale = np.ldexp(1.0, np.frexp(np.abs(diff).max(initial=0.0))[1])
    return np.sqrt(np.square(diff / scale).sum(axis=-1)) * scale if scale else np.zeros(len(x))


def local_join(met: pa.Table, kind: str, chunk: int, told: int) -> Iterator[pa.RecordBatch]:
    """met: center, node, v, new, sorted by center and node. Tells each node its nearest in each chunk, of pairs with a new one."""
    center, node, new = (met.column(c).to_numpy() for c in ("center", "node", "new"))
    v = matrix(met.column("v"), kind)
    group = np.concatenate([[0], np.cumsum((np.diff(center) != 0))]) if len(center) else center
    place = ranks_within(group)
    part = np.concatenate([[0], np.cumsum((np.diff(group) != 0) | (place[1:] % chunk == 0))]) if len(group) else group
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    keys, ids, dists = [], [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        m = b - a
        if m < 2 or not new[a:b].any():
            continue
        x = v[a:b]
        x = x - x.mean(axis=0) if np.abs(x).max() < 1e300 else x / 4
        largest = np.abs(x).max()
        x = x / np.ldexp(1.0, np.frexp(largest)[1]) if largest else x
        norm = (x * x).sum(axis=1)
        d = norm[:, None] + norm[None, :] - 2 * (x @ x.T)
        np.fill_diagonal(d, np.inf)
        d[~(new[a:b, None] | new[None, a:b])] = np.inf
        t = min(told, m - 1)
        near = np.argpartition(d, t - 1, axis=1)[:, :t]
        i, j = np.repeat(np.arange(a, b), t), near.ravel() + a
        good = np.isfinite(np.take_along_axis(d, near, 1)).ravel() & (node[i] != node[j])
        i, j = i[good], j[good]
        keys.append(node[i])
        ids.append(node[j])
        dists.append(np.concatenate([distances(v[i[k : k + 8192]], v[j[k : k + 8192]]) for k in range(0, len(i), 8192)]) if len(i) else np.zeros(0))
    if keys:
        k, i, d, _ = lists_of(np.concatenate(keys), np.concatenate(ids), np.concatenate(dists), 2 * told)
        nodes = np.unique(k)
        flags = pa.array(np.ones(len(k), bool))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.binary()), as_lists(k, nodes, i, pa.int64()), as_lists(k, nodes, d, pa.float64()), as_lists(k, nodes, flags, pa.bool_())], ["node", "v", "near", "dist", "fresh"])


def merge(rows: pa.Table, degree: int, joined: int) -> Iterator[pa.RecordBatch]:
    """rows: node, v (null in messages), near, dist, fresh, sorted by node. Nearest of all lists; changed: entries that the state lacked.

    Entries of the state among the `joined` nearest have been used by the round: they are no longer new.
    """
    node = rows.column("node").to_numpy()
    near, dist, fresh = (rows.column(c).combine_chunks() for c in ("near", "dist", "fresh"))
    sizes = np.nan_to_num(near.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    mine = rows.column("v").is_valid().to_numpy()
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    unused = fresh.flatten().to_numpy(zero_copy_only=False).astype(bool) & (place >= joined)
    kind = np.where(np.repeat(mine, sizes), unused, 2).astype(np.int8)  # 0 old, 1 new in the state, 2 new to it
    k, i, d, kind = lists_of(np.repeat(node, sizes), near.flatten().to_numpy(), dist.flatten().to_numpy(), degree, kind)
    own = np.flatnonzero(mine)
    nodes = node[own]
    changed = np.bincount(np.searchsorted(nodes, k), kind == 2, len(nodes)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), rows.column("v").combine_chunks().take(pa.array(own)), as_lists(k, nodes, i, pa.int64()), as_lists(k, nodes, d, pa.float64()), as_lists(k, nodes, pa.array(kind > 0), pa.bool_()), pa.array(changed)], ["node", "v", "near", "dist", "fresh", "changed"])


def in_cells(nodes: DataFrame, kind: str, total: int, trees: int, leaf: int) -> DataFrame:
    """center, node, v, new: every node in one cell of each tree; a cell of more than `leaf` nodes is split by a hash."""
    depth = min(PLANES, max(0, int(np.ceil(np.log2(max(1, total / leaf))))))
    trees = trees if depth else 1
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(2 * trees * max(1, depth)).collect()
    ends = np.stack([np.frombuffer(r["v"], kind).astype(np.float64) for r in chosen]) / 2
    pairs = [(ends[2 * j % len(ends)], ends[(2 * j + 1) % len(ends)]) for j in range(trees * depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), kind) / 2
            codes = np.zeros((len(v), trees), np.int64)
            for j, (p, q) in enumerate(pairs):
                size = np.abs(p - q).max() or 1.0  # on which side of the middle of p and q, sizes kept near 1
                codes[:, j % trees] = 2 * codes[:, j % trees] + (((v - (p / 2 + q / 2)) / max(size, np.abs(v).max(initial=0))) @ ((p - q) / size) > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, trees, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["node", "v", "codes"])

    placed = nodes.select("node", "v").mapInArrow(run, "node long, v binary, codes array<long>").select("node", "v", F.posexplode("codes").alias("tree", "code"))
    cells = placed.groupBy("tree", "code").agg(F.ceil(F.count("*") / F.lit(leaf)).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("node", "tree"), F.col("parts"))
    return placed.join(cells, ["tree", "code"]).select(F.xxhash64("tree", "code", salt).alias("center"), "node", "v", F.lit(True).alias("new"))


def met_at_neighbours(state: DataFrame, joined: int, spread: int) -> DataFrame:
    """center, node, v, new: every node at each of its nearest neighbours, at the nodes that have it among theirs, and at itself.

    Centers without a new entry are left out; those that many nodes point to have several keys.
    """
    listed = state.select("node", F.explode(F.arrays_zip(F.slice("near", 1, joined).alias("near"), F.slice("fresh", 1, joined).alias("fresh"))).alias("x")).select("node", "x.near", "x.fresh")
    ways = F.explode(F.array(F.struct(F.col("node").alias("c"), F.col("near").alias("u")), F.struct(F.col("near").alias("c"), F.col("node").alias("u")))).alias("way")
    edges = listed.select(ways, "fresh").select("way.*", "fresh").groupBy("c", "u").agg(F.max("fresh").alias("new"))
    centers = edges.groupBy("c").agg(F.max("new").alias("any"), F.ceil(F.count("*") / F.lit(spread)).cast("int").alias("parts")).where("any")
    part = lambda n: F.xxhash64("c", n).alias("center")
    met = edges.join(centers, "c").select(part(F.pmod(F.xxhash64("u"), F.col("parts"))), "u", "new")
    own = centers.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "c").select(part(F.col("p").cast("long")), F.col("c").alias("u"), F.lit(False).alias("new"))
    return met.unionByName(own).join(state.select(F.col("node").alias("u"), "v"), "u").select("center", F.col("u").alias("node"), "v", "new")


def neighbour_graph(nodes: DataFrame, kind: str = "<f8", degree: int = 32, joined: int = 16, trees: int = 12, leaf: int = 1024, told: int = 8, settled: float = 0.02, spread: int = 256) -> tuple[DataFrame, str | None]:
    """nodes: node, v (binary, numbers of `kind`). Returns a table node, v, near, dist, fresh, and its path."""
    spark = nodes.sparkSession
    empty = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("near", "long"), ("dist", "double"), ("fresh", "boolean"))]
    state, at = nodes.select("node", "v", *empty), None
    total = state.count()
    if not total:
        return state, at
    meet, chunk, most = in_cells(nodes, kind, total, trees, leaf), 2 * leaf, 2 * told
    while True:
        told_all = by_key(meet, "center", lambda t, chunk=chunk, most=most: local_join(t, kind, chunk, most), STATE, 5000, then=("node", "new"))
        new, new_at = stored(by_key(state.unionByName(told_all), "node", lambda t: merge(t, degree, joined), STATE + ", changed int"), "graph")
        if at:
            release(spark, at)
        at = new_at
        changed = new.agg(F.sum("changed")).first()[0] or 0
        state = new.drop("changed")
        if changed <= settled * degree * total:
            return state, at
        meet, chunk, most = met_at_neighbours(state, joined, spread), 2 * spread, told


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, kind: str = "<f8", beam: int = 256, expand: int = 32) -> DataFrame:
    """queries: q, v (binary), near (start nodes). Returns q, near, dist (nearest first, beam at most)."""
    spark = queries.sparkSession
    links = graph.select(F.col("node").alias("x"), F.col("near").alias("links"))
    points = nodes.select(F.col("node").alias("y"), F.col("v").alias("yv"))

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        q = t.column("q").to_numpy()
        heads = np.flatnonzero(t.column("v").is_valid().to_numpy())
        asked = matrix(t.column("v").take(pa.array(heads)), kind)
        at = {int(x): i for i, x in enumerate(q[heads])}
        found = np.flatnonzero(t.column("yv").is_valid().to_numpy())
        fq, fy = q[found], t.column("y").take(pa.array(found)).to_numpy()
        points = matrix(t.column("yv").take(pa.array(found)), kind) if len(found) else np.zeros((0, asked.shape[1]))
        rows = np.array([at[int(x)] for x in fq], np.int64)
        d = np.empty(len(found))
        for i in range(0, len(found), 8192):
            d[i : i + 8192] = distances(points[i : i + 8192], asked[rows[i : i + 8192]])
        lists = {c: t.column(c).combine_chunks().take(pa.array(heads)) for c in ("near", "dist", "done")}
        sizes = np.nan_to_num(lists["near"].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        k = np.concatenate([np.repeat(q[heads], sizes), fq])
        ids = np.concatenate([lists["near"].flatten().to_numpy(), fy])
        dist = np.concatenate([lists["dist"].flatten().to_numpy(), d])
        done = set(zip(np.repeat(q[heads], [len(x or ()) for x in lists["done"].to_pylist()]).tolist(), lists["done"].flatten().to_pylist()))
        k, ids, dist, _ = lists_of(k, ids, dist, beam)
        fresh = np.fromiter(((a, b) not in done for a, b in zip(k.tolist(), ids.tolist())), bool, len(k))
        fk, fi = k[fresh], ids[fresh]
        nxt = ranks_within(fk) < expand
        fk, fi = fk[nxt], fi[nxt]
        order = np.argsort(q[heads], kind="stable")
        sorted_q = q[heads][order]
        done_now = [sorted({b for b in (x or ())} | set(fi[fk == y].tolist())) for x, y in zip(lists["done"].take(pa.array(order)).to_pylist(), sorted_q)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sorted_q), t.column("v").take(pa.array(heads[order])).combine_chunks(), as_lists(k, sorted_q, ids, pa.int64()), as_lists(k, sorted_q, dist, pa.float64()), pa.array(done_now, pa.list_(pa.int64())), as_lists(fk, sorted_q, fi, pa.int64())],
            ["q", "v", "near", "dist", "done", "todo"],
        )

    schema = "q long, v binary, near array<long>, dist array<double>, done array<long>, todo array<long>"
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    state, at = queries.select("q", "v", empty("long").alias("near"), empty("double").alias("dist"), empty("long").alias("done")), None
    reach = queries.select("q", F.explode("near").alias("y"))
    while True:
        seen = reach.distinct().join(points, "y").select("q", "y", "yv")
        rows = state.select("q", "v", "near", "dist", "done", F.lit(None).cast("long").alias("y"), F.lit(None).cast("binary").alias("yv"))
        rows = rows.unionByName(seen, allowMissingColumns=True)
        new, new_at = stored(by_key(rows, "q", settle, schema), "beams")
        if at:
            release(spark, at)
        state, at = new.drop("todo"), new_at
        todo = new.select("q", F.explode("todo").alias("x"))
        if todo.isEmpty():
            break
        reach = todo.join(links, "x").select("q", F.explode("links").alias("y"))
    return state.select("q", "near", "dist")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = 32, beam: int = 256, entries: int = 32, **options) -> DataFrame:
    """query_id, rank, id, score: of each query the k nearest rows found, by Euclidean distance, ties to the smaller id.

    A query whose vector is a row's starts at that row's node; others start at `entries` nodes
    chosen by hash. A query's own id is no candidate.
    """
    spark = rows.sparkSession
    single = rows.schema[vector_col].dataType.elementType == T.FloatType() == queries.schema[vector_col].dataType.elementType
    kind = "<f4" if single else "<f8"

    def pack(df: DataFrame, key: str) -> DataFrame:
        """Vectors as bytes, in their own precision."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(x, kind).tobytes() for x in b.column(1).to_pylist()], pa.binary())], [key, "v"])

        return df.mapInArrow(run, f"{key} long, v binary")

    plain = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    sound = usable(rows, id_col, vector_col, allow_zero=False).select("id", plain.alias("v"))
    length = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = length["n"] if length else 0
    sound, sound_at = stored(sound.where(F.size("v") == length), "sound")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = sound.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    members, _ = stored(members.select(F.col("ids")[0].alias("node"), "ids", "v"), "members")
    release(spark, sound_at)
    nodes, nodes_at = stored(pack(members.select("node", "v"), "node"), "points")
    graph, graph_at = neighbour_graph(nodes, kind, degree, **options)

    asked = usable(queries, id_col, vector_col, allow_zero=False).where(F.size("v") == length).select(F.col("id").alias("q"), plain.alias("v"))
    home = asked.join(members.select("v", "node"), "v", "left").select("q", "v", "node")
    near = graph.select("node", F.concat(F.array("node"), "near").alias("near"))
    doors = [r["node"] for r in graph.orderBy(F.xxhash64("node"), "node").limit(entries).select("node").collect()]
    begun = home.join(near, "node", "left").select("q", "v", F.coalesce("near", F.array(*map(F.lit, doors)).cast("array<long>")).alias("near"))
    starts = pack(begun.select("q", "v"), "q").join(begun.select("q", "near"), "q")
    starts, starts_at = stored(starts, "starts")
    beams = greedy_search(starts, nodes, graph, kind, beam)
    for path in (nodes_at, graph_at, starts_at):
        if path:
            release(spark, path)
    found = beams.select("q", F.explode(F.arrays_zip("near", "dist")).alias("x")).select("q", F.col("x.near").alias("node"), F.col("x.dist").alias("score"))
    spread = found.join(members.select("node", "ids"), "node").select("q", F.explode("ids").alias("id"), "score").where("id <> q")
    order = F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))
    best = spread.withColumn("rank", order).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
