"""The corpus pipeline against plain versions of its stages, and the registration of queries."""

import collections
import random

import pytest

import __spark_entry__
import corpus_pipeline
from quillframe.llm import mixing, secrets
from quillframe.llm.queries import QUERIES, tokenizer_file

tokenizers = pytest.importorskip("tokenizers")


def near_duplicates(rows):
    sets = {}
    for i, text, *_ in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) == i}


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    words = {"xx": ["alo", "mira", "tesu", "kalo", "neri", "vosa"], "yy": ["brzk", "grtt", "wkls", "pfnd", "sktr", "dzwm"]}
    rows = []
    for i in range(120):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(20, 80)))
        if i % 9 == 0:
            text += " password=abc123XYZ done"
        rows.append((i, text, lang, rng.choice(["s1", "s1", "s2", None]), len(text)))
    rows += [(200 + k, rows[3 * k][1] + (" alo" if k % 2 else ""), rows[3 * k][2], "s2", 1) for k in range(12)]
    rejected = [(300, None, "xx", "s1", 0), (301, "12 34 --", "xx", "s1", 8), (302, "", None, "s1", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + rejected, columns).write.parquet(f"{tmp_path}/documents.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name

    kept = near_duplicates(rows)
    redacted = {r[0]: secrets.redacted(r[1], secrets.base_spans(r[1])) for r in rows if r[0] in kept}
    assert any("[REDACTED]" in t for t in redacted.values())
    source = {r[0]: r[3] for r in rows}
    left = spark.createDataFrame([(i, t, source[i]) for i, t in redacted.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_plan_of_documents(left).collect()}
    library = tokenizers.Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    want = collections.Counter()
    for i, text in redacted.items():
        want[i, tuple(library.encode(text, add_special_tokens=False).ids)] += copies[i]
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_the_last_stage_decodes_what_it_has_encoded(spark):
    library = tokenizers.Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    texts = ["Plain Words, and numbers 123.", "Éa\u0301 ÇPA!!\nΣΑΣ", "ᏣᎳᎩ ⴰⵣⵓⵍ", "".join(library.get_added_tokens_decoder()[i].content for i in library.get_added_tokens_decoder()) + "a", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in corpus_pipeline.encode(spark, docs, "").collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False))


def test_one_row_of_each_group_stays_where_ids_repeat_or_are_null(spark):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(2)
    a, b, c = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (2, a, "x"), (2, a, "y"), (None, b, "x"), (None, b, "x"), (None, c, "x"), (3, b + " w1", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [r["text"][:40] for r in kept.collect()]
    assert sorted(got) == sorted(t[:40] for t in (a, b, c))


def test_stages_of_an_empty_table_and_of_clashing_names(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, score double, shards string, spans string, size int"
    empty = spark.createDataFrame([], columns)
    text = "some plain words that a reader may well read in one go"
    rows = [(i, f"{text} {'abcdefgh'[i]}" * (i + 1), "en", None, i, None, "a", 0.5, "1", "b", 3) for i in range(8)]
    full = spark.createDataFrame(rows, columns)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (empty, full):
            got = stage(spark, docs, str(tmp_path))
            assert name == "encode" or got.columns == docs.columns
            assert got.count() == 0 if docs is empty else got.count() >= 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_what_sql_says_of_the_operators_is_registered_beside_them():
    parts = {"url_rules", "mix_targets", "secret_rules", "text_bytes"}
    assert parts <= set(__spark_entry__.queries()) and parts <= set(__spark_entry__.oracle_sql())
    assert not parts & set(QUERIES)
