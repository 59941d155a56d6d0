"""Vector searches: exact top-k against brute force, neighbour search by recall, defined cases of both."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import ann, topk_nra


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int")


def sample(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


ODD = [(9000, None), (9100, []), (9200, [float("nan")] * 16), (9300, [None] * 16), (9400, [float("inf")] + [0.0] * 15), (9500, [0.0] * 16), (None, [1.0] * 16), (9600, [1.0] * 3)]


@pytest.mark.parametrize("block, group", [(8192, 1024), (300, 4)])
def test_exact_top_k(spark, block, group):
    x = sample(1500, 16)
    x[200:900] = x[7]  # a large group of equal vectors
    vectors = [*enumerate(x), *ODD, (3, x[3])]
    rows = frame(spark, vectors)
    got = topk_nra.top_k(rows, rows.where("vec_id % 100 = 0"), block=block, group=group).collect()
    v = {i: np.floor(1024 * np.asarray(a, float)).astype(int) for i, a in [*enumerate(x), (9500, [0.0] * 16)]}
    v3 = {9600: np.array([1024] * 3)}
    want = []
    for q in [i for i in v if i % 100 == 0]:
        best = sorted(((-int(v[q] @ w), i) for i, w in v.items() if i != q))[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert not any(r["query_id"] in v3 for r in got)
    assert sorted(map(tuple, got)) == sorted(want)


def test_nra_reads_lists_and_stops_before_they_end(spark):
    rng = np.random.default_rng(2)
    values = np.floor(rng.exponential(size=(5000, 4)) ** 3 * 100).astype(np.int64)
    lists, query = topk_nra.Lists(np.arange(5000), values), np.array([5, 1, 0, 2])
    ids, scores = lists.top(query, -1, 10)
    every = values @ query
    best = np.lexsort((np.arange(5000), -every))[:10]
    assert ids.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
    assert 0 < lists.read < 5000
    # the whole query, on skewed vectors: a fraction of all entries is read, but some in every block
    rows = frame(spark, enumerate(values / 1024))
    entries = spark.sparkContext.accumulator(0)
    got = topk_nra.top_k(rows, rows.where("vec_id % 100 = 0"), block=1000, entries=entries).collect()
    assert 0 < entries.value < 0.5 * 50 * 5000 * 4
    for q in (0, 700):
        every = values @ values[q]
        every[q] = -1
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, every[i]) for i in np.lexsort((np.arange(5000), -every))[:10]]
    # small blocks read their lists too
    entries = spark.sparkContext.accumulator(0)
    few = frame(spark, enumerate(sample(300, 8)))
    topk_nra.top_k(few, few.where("vec_id = 0"), entries=entries).collect()
    assert entries.value > 0


def test_components_that_leave_64_bits_take_no_part(spark):
    rows = frame(spark, [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [1e30, 0.0]), (3, [-3e6, 0.0]), (4, [2e6, 0.0])])
    got = [tuple(r) for r in topk_nra.top_k(rows, rows.where("vec_id in (0, 2, 4)")).collect()]
    assert sorted(got) == [(0, 1, 4, 1024 * 1024 * 2_000_000), (0, 2, 1, 2 * 1024 * 1024), (4, 1, 1, 2 * 1024 * 1024 * 2_000_000), (4, 2, 0, 1024 * 1024 * 2_000_000)]


def test_neighbour_search(spark):
    x = sample(1200, 16, 3)
    x[500:620] = x[11]  # equal vectors
    vectors = [*enumerate(x), *ODD, (3, x[3])]
    rows = frame(spark, vectors)
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 100 = 0 or vec_id = 11")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    sound = [*range(1200)]
    hits = []
    for q in [i for i in sound if i % 100 == 0 or i == 11]:
        d = np.sqrt(((x[sound].astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1200), d))[:10]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11)) and [s for _, _, s in found] == sorted(s for _, _, s in found)
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in found)
        hits.append(len({i for _, i, _ in found} & set(best.tolist())) / 10)
        if q in (500, 600, 11):
            assert [i for _, i, _ in found] == best.tolist()
    assert set(got) == {i for i in sound if i % 100 == 0 or i == 11}
    assert np.mean(hits) >= 0.9


def recall(spark, x, asked, kind="float"):
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    found = {}
    for r in ann.nearest(rows, rows.where(F.col("vec_id").isin(asked))).collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x, hits = np.asarray(x, np.float32 if kind == "float" else np.float64).astype(float), []
    for q in asked:
        d = np.sqrt((np.square((x - x[q]) / np.abs(x).max())).sum(axis=1)) * np.abs(x).max()
        d[q] = np.inf
        bound = np.sort(d)[9] * (1 + 1e-12)
        assert all(s == pytest.approx(d[i], rel=1e-9) for i, s in found[q])
        hits.append(sum(d[i] <= bound for i, _ in found[q]) / 10)
    return np.mean(hits)


@pytest.mark.parametrize("scale, kind", [(1e6, "float"), (1e-9, "float"), (1e200, "double")])
def test_recall_at_any_magnitude(spark, scale, kind):
    assert recall(spark, sample(2000, 32, 8) * scale if kind == "float" else sample(2000, 32, 8).astype(float) * scale, list(range(0, 2000, 100)), kind) >= 0.9


def test_recall_in_a_group_of_near_copies(spark):
    """A third of the rows differ from one vector by less than a ten-thousandth of its length."""
    x = sample(3000, 16, 9)
    x[::3] = x[0] + 1e-5 * sample(1000, 16, 10)
    assert recall(spark, x, [*range(0, 3000, 300), *range(1, 3000, 300)]) >= 0.9


def test_reruns_agree_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (600, 4)).astype(float)  # many equal vectors and equal distances
    x[(x == 0).all(axis=1)] = 1
    rows = frame(spark, enumerate(x))
    once, again = (sorted(map(tuple, ann.nearest(rows, rows.where("vec_id % 50 = 0")).collect())) for _ in range(2))
    assert once == again
    for q in range(0, 600, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [i for k, _, i, _ in once if k == q] == np.lexsort((np.arange(600), d))[:10].tolist()


def test_queries_that_are_no_rows_and_few_candidates(spark):
    x = sample(40, 8, 5)
    rows, asked = frame(spark, list(enumerate(x))), frame(spark, [(1000, x[4] + 0.01)])
    found = sorted((r["rank"], r["vec_id"]) for r in ann.nearest(rows, asked).collect())
    best = np.argsort(((x - x[4] - 0.01) ** 2).sum(axis=1))[:10]
    assert len({i for _, i in found} & set(best.tolist())) >= 9
    few = ann.nearest(frame(spark, list(enumerate(x[:3]))), frame(spark, [(0, x[0])])).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann.nearest(frame(spark, []), frame(spark, [])).count() == 0
    assert topk_nra.top_k(frame(spark, []), frame(spark, [])).count() == 0
