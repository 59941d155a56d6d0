"""The registered queries of this subpackage: name -> f(spark, sf_dir), and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import ann, bpe, langid, minhash, mixing, secrets, suffix_dedup, token_counts, topk_nra, url_filter


def tokenizer_file(name: str) -> str:
    """Content of a public tokenizer file, read on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk_nra.top_k(rows, rows.where("vec_id % 100 = 0"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan_of_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), outputs=("ids_sha256", "decoded_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: host, path and rule."""
    return op3_url_filter(spark, sf_dir).drop("verdict")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: sizes and targets, and that no document is taken more than twice."""
    return op5_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", "target", (F.col("taken") > 2 * F.col("size")).alias("over"))


def secret_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: the numbers of the rules' findings."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9 and op10: the size of each text in bytes, and that no more than that is removed."""
    removed = op9_repeated_passages(spark, sf_dir).select("doc_id", F.col("n_bytes").alias("n_bytes_9"), (F.col("n_removed") <= F.col("n_bytes")).alias("within"))
    return op10_token_counts(spark, sf_dir).select("doc_id", "n_bytes").join(removed, "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_nearest_neighbours, op2_near_duplicates, op3_url_filter, op4_exact_top_k, op5_source_mix, op6_secret_scan, op7_bpe_round_trip, op8_language_id, op9_repeated_passages, op10_token_counts)
}

#: Queries of their own that hold what SQL can say of an operator.
PARTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (url_rules, mix_targets, secret_rules, text_bytes)}

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = rf"""({"|".join(map(_either, ("password", "passwd", "secret", "token")))}|{_either("api")}_?{_either("key")})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": """
        with sound as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        scored as (
            select q.vec_id as query_id, r.vec_id,
                   cast(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
            from sound q join sound r on q.vec_id <> r.vec_id and len(q.v) = len(r.v)
            where q.vec_id % 100 = 0
        ),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
    """,
    "op2_near_duplicates": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents
        ),
        sets as (
            select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
                else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
            from words
        ),
        classes as (select list_sort(s) as s, min(doc_id) as rep from sets where len(s) > 0 group by 1),
        items as (select rep, len(s) as n, unnest(s) as x from classes),
        pairs as (
            select a.rep as a, b.rep as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb
            from items a join items b on a.x = b.x and a.rep < b.rep group by 1, 2
        ),
        linked as (select a, b from pairs where 100 * shared >= 80 * (na + nb - shared)),
        edges as (select a, b from linked union select b, a from linked),
        reach as (select rep as a, rep as b from classes union select r.a, e.b from reach r join edges e on r.b = e.a),
        roots as (select a, min(b) as root from reach group by a)
        select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(r.root, d.doc_id) as component_id,
               coalesce(r.root, d.doc_id) = d.doc_id as kept
        from sets d left join classes c on list_sort(d.s) = c.s left join roots r on r.a = c.rep
    """,
}

PARTS_SQL: dict[str, str] = {
    "url_rules": r"""
        with parts as (
            select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) as path
            from pages
        ),
        rules(rule, of, start) as (values ('com/', 'com', '/'), ('example.com/en/', 'example.com', '/en/'), ('www.example.com/en/', 'www.example.com', '/en/'), ('net/es/', 'net', '/es/'), ('net/fr/', 'net', '/fr/'))
        select page_id, host, path, (select arg_max(rule, len(rule)) from rules where (host = of or ends_with(host, '.' || of)) and starts_with(path, start)) as rule from parts
    """,
    "mix_targets": r"""
        with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
        sources as (
            select source, sum(size) as n, 2 * sum(size) as most, [5, 2, 1][1 + (row_number() over (order by source is null, source collate "binary") - 1) % 3] as w
            from sized group by source
        ),
        levels as (
            select *, 1.5 * sum(n) over () - coalesce(sum(most) over (order by most / w, source rows between unbounded preceding and 1 preceding), 0) as left_,
                   sum(w) over (order by most / w, source rows between current row and unbounded following) as weights
            from sources
        ),
        level as (select left_, weights from levels where left_ / weights <= most / w order by most / w, source limit 1),
        targets as (
            select source, n, case when (select left_ from level) * w / (select weights from level) > most then cast(most as double)
                                   else cast((select left_ from level) as double) * w / (select weights from level) end as target
            from sources
        )
        select doc_id, size, cast(n as bigint) as source_size, coalesce(target, 0) as target, false as over
        from sized join targets on sized.source is not distinct from targets.source
    """,
    "secret_rules": f"""
        select doc_id,
               cast(len(list_filter(regexp_extract_all(coalesce(text, ''), '{ASSIGN}', 2), lambda x: len(x) >= 6)) as bigint) as n_assign,
               cast(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) as bigint) as n_access,
               cast(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 24)) as bigint) as n_hex
        from documents
    """,
    "text_bytes": "select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes, cast(strlen(coalesce(text, '')) as bigint) as n_bytes_9, true as within from documents",
}
