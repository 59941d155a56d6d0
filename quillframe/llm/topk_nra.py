"""Exact top-k by integer inner product, by no-random-access aggregation (NRA).

Rows are dealt to blocks of about `block` rows and queries to groups of `group`; each pair of a
block and a group is one task (a stated query set against all rows, in blocks). In a task every
dimension is a list of the block's rows sorted by their contribution to the query's score. The
lists are read in parallel, from their good ends, in doubling steps. A row's lower bound adds
the worst values of its unread lists, its upper bound their current values; rows whose upper
bound falls below the k-th lower bound are out. Reading stops when no more than k rows are in, or
when the lists end, at which the bounds of every row meet. Rows that bounds cannot separate, by
ties or rounding, are told apart by their final scores, which are integer sums of the rows still
in. The k best of each block are merged by a grouped limit, so a query gathers k rows for each
block at most.

How much of the lists is read depends on the data: little where a few dimensions decide, nearly
all of it where vectors are near-uniform in many dimensions (`entries` counts it).

Contributions are float64, bounds allow for the rounding of their sums; final scores are int64.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part,
nor do those whose floor(scale * x) add up, by size, to 2^31 or more, since scores of such
vectors may leave 64 bits; a zero vector takes part. Only vectors of the query's length are its
candidates. Rows that repeat an id count once (with the least vector). Ties go to the smaller
id; a query with fewer candidates gets them all. An empty table gives an empty result. Only the
id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.llm.common import stored
from quillframe.llm.vectors import usable

FIRST = 64  # entries read of each list in the first step
LARGEST = 1 << 31  # of the sum of a vector's components, by size


class Lists:
    """A block's rows and, for each dimension, its list: the rows and their values in ascending order."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.read = ids, values, 0  # list entries read so far
        self.rows = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(values.T, self.rows, axis=1).astype(np.float64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, ties to the smaller id."""
        n = len(self.ids)
        inside = self.ids != own
        dims = np.flatnonzero(query).tolist()
        weight = query[dims].astype(np.float64)
        # worst[d]: what the last entry of list d would add; the lists of negative weights are read upwards
        worst = np.array([w * self.sorted[d, 0 if w > 0 else -1] for d, w in zip(dims, weight)])
        known, read = np.zeros(n), np.zeros((len(dims), n), np.float32)
        at, step = 0, FIRST
        while at < n and dims and inside.sum() > k:
            end = min(n, at + step)
            rows, adds, now = [], [], np.empty(len(dims))
            for i, (d, w) in enumerate(zip(dims, weight.tolist())):
                part = slice(n - end, n - at) if w > 0 else slice(at, end)
                some = self.rows[d, part]
                rows.append(some)
                adds.append(w * self.sorted[d, part])
                read[i, some] = 1
                now[i] = adds[-1][0 if w > 0 else -1]
            self.read += len(dims) * (end - at)
            known += np.bincount(np.concatenate(rows), np.concatenate(adds), n)
            lower = known + worst.sum() - worst.astype(np.float32) @ read
            upper = known + now.sum() - now.astype(np.float32) @ read
            floor = np.partition(lower[inside], -k)[-k]
            slack = 1e-5 * (1 + np.abs(worst).sum() + np.abs(now).sum())  # of rounding in the float32 sums
            inside &= upper >= floor - slack
            at, step = end, 2 * step
        rest = np.flatnonzero(inside)
        scores = self.values[rest] @ query
        best = np.lexsort((self.ids[rest], -scores))[:k]
        return self.ids[rest[best]], scores[best]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 8192, group: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", entries: Accumulator | None = None) -> DataFrame:
    """query_id, rank, id, score of the k rows with the highest integer inner product with each query.

    Components become floor(scale * x). queries: same columns as rows; a query's own id is no candidate.
    entries: an accumulator, if given, that gets the number of list entries read.
    """

    def whole(df: DataFrame) -> DataFrame:
        found = usable(df, id_col, vector_col, allow_zero=True)
        size = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.abs(F.floor(x * scale).cast("double")))
        whole_ = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
        return found.where(size < LARGEST).select("id", whole_.alias("v"))

    base, _ = stored(whole(rows), "vectors")
    asked, _ = stored(whole(queries), "queries")
    blocks, groups = (max(1, -(-df.count() // size)) for df, size in ((base, block), (asked, group)))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), number(groups).alias("g"))
    posed = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), number(blocks).alias("b"))

    def search(_: tuple, some: pd.DataFrame, asked_here: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = some["v"].map(len) if len(some) else pd.Series(dtype=int)
        for size in set(lengths):
            part = some[lengths == size]
            lists = Lists(part["id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.int64))
            for own, v in zip(asked_here["id"], asked_here["v"]):
                if len(v) == size:
                    ids, scores = lists.top(np.asarray(v, np.int64), own, k)
                    out += [(own, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
            if entries is not None:
                entries.add(lists.read)
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    found = dealt.groupBy("b", "g").cogroup(posed.groupBy("b", "g")).applyInPandas(search, "query_id long, id long, score long")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", order).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
