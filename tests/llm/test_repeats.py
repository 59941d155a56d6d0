"""Removal of repeated passages against brute force over every window."""

import collections
import hashlib
import random

import pytest

from quillframe.llm import suffix_dedup


def brute(rows, length):
    seen, texts = collections.Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(b)))
        kept = bytes(c for c, x in zip(b, gone) if not x)
        out.append((i, len(b), sum(gone), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(unique):
    rng = random.Random(3)
    make = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    base = make("abcdefgh \né", 5000)
    rows = [(1, base[:1000]), (2, base[300:700] + "x" + base[:250]), (3, "q" + base[100:300] + "z"), (4, None), (5, ""), (6, "a" * 900), (7, base[:1000]), (9, base[:199])]
    rows += [(20 + i, make("xyz", 250) + base[3000:3230] + make("xyz", 250)) for i in range(30)]
    rows += [(60 + i, make("xyz", 200) + base[4000 : 4150 + i] + make("xyz", 200)) for i in range(40)]
    rows += [(200, make("uvw", 300) * 4), (201, make("rst", 200) * 2)]
    return rows if unique else [*rows, (7, base[:1000]), (7, base[50:400]), (None, base[2000:2300]), (8, base[2050:2350]), (None, None)]


@pytest.mark.parametrize("unique, hot, segment", [(True, 20_000, 1 << 20), (False, 3, 1 << 20), (True, 20_000, 1200)])
def test_against_brute_force(spark, monkeypatch, unique, hot, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rows = corpus(unique)
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, h int, w string")
    out = suffix_dedup.remove_repeats(docs, hot=hot)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == brute(rows, 200)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_a_bucket_meet_when_spark_turns_joins_to_broadcasts(spark):
    # a join turned to a broadcast at run time reads its other side where that was written, not by key
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    rows = corpus(True)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for hot in (25, 35):  # some buckets above it, some below
            got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, hot=hot).collect()), key=repr)
            assert got == brute(rows, 200)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
