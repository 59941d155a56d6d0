"""Near-duplicates against brute force, with planted copies, chains and defined cases."""

import random

import pytest

from quillframe.llm import minhash
from quillframe.llm.components import connected_components


def brute(rows, words, percent=80):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(x), None if i is None else find(i), i is None or find(i) == i) for i, x in sets), key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                base = copy  # a chain
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one\x0btwo"), (906, "ONE two"), (None, rows[0][1]), (907, rows[0][1]), (907, rows[0][1]), (908, "É x y"), (909, "é x y")]


@pytest.mark.parametrize("words, block", [(2, 1024), (2, 3), (5, 1024)])
def test_against_brute_force(spark, monkeypatch, words, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(words)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, n_shingles int")
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, words=words).collect()), key=repr)
    assert got == brute(rows, words)


def test_links_that_no_pivot_shows(spark, monkeypatch):
    """With pivots that link with nothing, the second pass finds all links."""
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real, calls = minhash.confirmed, []

    def none_at_first(pairs, *rest):
        calls.append(1)
        return real(pairs, *rest).where("false")

    monkeypatch.setattr(minhash, "confirmed", none_at_first)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, words=2).collect()), key=repr)
    assert calls and got == brute(rows, 2)


@pytest.mark.parametrize("few", [0, 64])
def test_a_large_group_of_near_copies(spark, monkeypatch, few):
    """Copies of one text with many edits: some link with its origin, some with each other only, some with none."""
    monkeypatch.setattr(minhash, "FEW", few)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base, rows = [rng.choice(words) for _ in range(80)], []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(80)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    want = brute(rows, 2)
    assert len({r[2] for r in want}) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs, words=2).collect()), key=repr) == want


def test_rows_dealt_to_blocks_stay_linear_in_one_block(spark, monkeypatch):
    rows = [(7, 0, i, 0 if i % 3 else i) for i in range(1000)] + [(8, 1, i, 5) for i in range(50)]
    buckets = spark.createDataFrame(rows, "key long, band int, id long, comp long")
    assert minhash.in_blocks(buckets).count() == 1000  # a bucket of one component has nothing to settle
    monkeypatch.setattr(minhash, "BLOCK", 100)
    dealt = minhash.in_blocks(buckets).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault(r["task"], []).append(r)
    met = set()
    for some in tasks.values():
        met |= {(x["id"], y["id"]) for x in some if x["asks"] for y in some if y["answers"] and x["comp"] != y["comp"]}
    comp = {i: c for k, _, i, c in rows if k == 7}
    assert met == {(x, y) for x in comp for y in comp if comp[x] != 0 and comp[x] != comp[y]}


def test_ids_with_several_texts(spark):
    rows = corpus(3)[:60]
    rows += [(rows[0][0], rows[1][1]), (rows[2][0], "alone and unlike all others"), (rows[2][0], rows[9][1]), (None, rows[4][1]), (rows[5][0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, words=2).collect()), key=repr)
    assert got == brute(rows, 2)


def test_a_very_long_text(spark):
    rng = random.Random(5)
    text = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:140_000])), (3, " ".join(text[:60_000])), (4, "x" * 1_000_000), (5, "x" * 1_000_000)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_pairs_whose_sketch_bytes_agree_in_an_earlier_band(spark, monkeypatch):
    """Bytes of the minima agree by chance in a band whose keys differ; the pair meets in a later one."""
    rng, bands, size = random.Random(3), 42, 6
    a, b = minhash.universal(bands * size)
    words, rows = [f"w{i}" for i in range(5000)], []
    while len(rows) < 6:
        base = [rng.choice(words) for _ in range(60)]
        copy = [*base[:54], *(rng.choice(words) for _ in range(6))]  # 53 of 65 shingles of two words are shared
        x, y = (minhash.minima(minhash.shingles(" ".join(t), 2), a, b).reshape(bands, size) for t in (base, copy))
        same, bytes_same = (x == y).all(axis=1), (x.astype("u1") == y.astype("u1")).all(axis=1)
        if same.any() and bytes_same.argmax() < same.argmax():
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    real = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda *args: real(*args).where("false"))  # pivots show no link
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words=2).collect()}
    assert got == {i: i - i % 2 for i in range(6)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (7, 6)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{i: 100 for i in range(101, 140)}}
