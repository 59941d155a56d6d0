"""Registered queries of the CSV engine and their DuckDB SQL.

Each query exports whole tables to CSV (once for each input folder and session, next to the
session's shared folder) and reads them back with the engine.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.errors import CsvError
from quillframe.functions.convert import display_money
from quillframe.operators import analytics, compare
from quillframe.options import ReadOptions
from quillframe.sources.money import read_money
from quillframe.sources.reader import read_common, read_csv, read_naive
from quillframe.sources.records import remove, shared_folder
from quillframe.sources.sinks import benchmark_rows, money_rows, write_csv
from quillframe.streaming.incremental import stream_csv

_exports: dict[tuple[str, str], str] = {}


def _folder(spark: SparkSession) -> str:
    key = (spark.sparkContext.applicationId, "")
    if key not in _exports:
        _exports[key] = f"{shared_folder(spark)}/quillframe-csv-{uuid.uuid4().hex}"
        atexit.register(_gone, spark, _exports[key])
    return _exports[key]


def _gone(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Path of a small file with these bytes in the session's shared folder."""
    path = f"{_folder(spark)}/{uuid.uuid4().hex}-{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(data))
    stream.close()
    return path


def exported(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame] | None = None) -> str:
    """Path of the CSV export of a table, or of what make() gives, under that name."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}")
    if key not in _exports:
        path = f"{_folder(spark)}/{uuid.uuid4().hex}-{name}"
        write_csv(make() if make else spark.read.parquet(f"{sf_dir}/{name}.parquet"), path)
        _exports[key] = path
    return _exports[key]


def _read(name: str, schema: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read_csv(spark, exported(spark, sf_dir, name), schema)


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"))


def empty_float_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = exported(spark, sf_dir, "orders_blanked", lambda: _blanked(spark, sf_dir))
    return read_csv(spark, path, "o_orderkey:int, o_totalprice:float")


def _priced(spark: SparkSession, sf_dir: str, name: str, price: str) -> str:
    """An export whose prices are written as money, with two decimals."""
    rows = lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn(price, F.col(price).cast("decimal(18,2)"))
    return exported(spark, sf_dir, f"{name}_priced", rows)


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv(spark, _priced(spark, sf_dir, "lineitem", "l_extendedprice"), "l_orderkey:int, l_linenumber:int, l_extendedprice:cents, l_returnflag:str")


def _money_file(spark: SparkSession, sf_dir: str) -> str:
    def make() -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        cents = (F.col("l_extendedprice").cast("decimal(18,2)")).cast("string")
        note = F.when(F.col("l_linenumber") % 3 == 0, 'said "hello", twice\nand left').otherwise("order shipped")
        return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("user_id"), note.alias("note"), cents.alias("amount"), F.col("l_returnflag").alias("category"))

    return exported(spark, sf_dir, "lineitem_money", make)


def money_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("amount_cents"))


def money_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.total(_money(spark, sf_dir), "l_extendedprice")


def money_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.total_by(_money(spark, sf_dir), "l_returnflag", "l_extendedprice")


def money_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_csv(spark, _priced(spark, sf_dir, "part", "p_retailprice"), "p_brand:str, p_retailprice:cents")
    return analytics.largest(rows, "p_brand", "p_retailprice")


def money_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_money(spark, _money_file(spark, sf_dir)).decoded().withColumn("id", F.col("id").cast("bigint"))


def money_profile_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_money(spark, _money_file(spark, sf_dir)).total_by_category()


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv(spark, exported(spark, sf_dir, "customer"), "c_custkey:int, c_mktsegment:str")


def dict_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.dictionary_of(_segments(spark, sf_dir), "c_mktsegment", ["c_custkey"]).select(F.col("code").cast("bigint").alias("code"), "c_mktsegment")


def dict_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, dictionary = analytics.encode(_segments(spark, sf_dir), "c_mktsegment", ["c_custkey"])
    return analytics.decode(coded, dictionary, "c_mktsegment")


def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_csv(spark, exported(spark, sf_dir, "documents"), "doc_id:int").agg(F.count("*").alias("n"))


def blank_lines_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth region or nation row is followed by blank lines."""
    path = f"{exported(spark, sf_dir, 'nation')}-blank"
    key = (spark.sparkContext.applicationId, path)
    if key not in _exports:
        rows = spark.read.text(exported(spark, sf_dir, "nation"), lineSep="\n")
        rows.select(F.explode(F.array(F.col("value"), F.lit(""))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
        _exports[key] = path
    return read_csv(spark, path, "n_nationkey:int, n_name:str")


def common_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_common(spark, exported(spark, sf_dir, "documents"), "doc_id:int, text:str, lang:str")


def naive_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the naive reader gets right on messy data, which are fewer than it returns."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = read_naive(spark, exported(spark, sf_dir, "documents_text", lambda: rows), "doc_id:int, text:str")
    return compare.integrity(got, rows, "doc_id")


def errors_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of the first error in file order of a file with two bad cells."""
    path = exported(spark, sf_dir, "two_errors", lambda: spark.range(9000).coalesce(1).select(F.when(F.col("id") == 3000, "x").when(F.col("id") == 6000, "y").otherwise("1").alias("a"), F.lit("2").alias("b")))
    try:
        read_csv(spark, path, "a:int", ReadOptions(chunk_bytes=4096))
        code, cell = "NONE", ""
    except CsvError as e:
        code, cell = e.code, "x" if '"x"' in str(e) else "?"
    return spark.createDataFrame([(code, cell)], "code string, cell string")


def partition_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents, and rows that differ between readings with small and large splits."""
    path = exported(spark, sf_dir, "documents")
    schema = "doc_id:int, text:str, source:str"
    small, large = (read_csv(spark, path, schema, ReadOptions(chunk_bytes=n, validate=False)) for n in (8191, 64 << 20))
    tagged = small.select("*", F.lit(1).alias("side")).unionByName(large.select("*", F.lit(-1).alias("side")))
    each = tagged.groupBy("doc_id", F.xxhash64("text", "source").alias("h")).agg(F.sum("side").alias("d"), F.count("*").alias("n"))
    return each.agg((F.sum("n") / 2).cast("bigint").alias("n"), F.sum(F.abs("d")).alias("mismatches"))


def _outcome(read: Callable[[], DataFrame]) -> tuple[str, int | None]:
    """Code and offset of the error that reading raises."""
    try:
        read().collect()
    except CsvError as e:
        return e.code, e.offset
    return "NONE", None


def error_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of bad records: with and without a byte order mark, after quoted newlines and carriage returns, in small splits."""
    body = b"a,b\n" + b"1,2\n" * 3000 + b"x,2\n" + b"1,2\n" * 3000
    small = ReadOptions(chunk_bytes=4096)
    cases = [
        ("plain", body, small),
        ("mark", b"\xef\xbb\xbf" + body, small),
        ("mark, one split", b"\xef\xbb\xbf" + body, ReadOptions()),
        ("quoted newlines", b"\xef\xbb\xbfa,b\n" + b'1,"x\ny"\n' * 2000 + b"1\n", small),
        ("carriage returns", b"a,b\r\n" + b"1,2\r\n" * 10 + b'1,2"3"\r\n', ReadOptions()),
    ]
    found = [(name, *_outcome(lambda d=data, o=options: read_csv(spark, put(spark, "offsets.csv", d), "a:int", o))) for name, data, options in cases]
    return spark.createDataFrame(found, "name string, code string, byte_offset long")


def typed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every kind of failure."""
    read = lambda data, schema="a:int", **options: lambda: read_csv(spark, put(spark, "errors.csv", data), schema, ReadOptions(**options))
    many = b"k,v\n" + b"".join(b"%d,1\n" % i for i in range(40))
    cases = [
        ("unknown column", read(b"b\n1\n")),
        ("column requested twice", read(b"a\n1\n", [("a", "int"), ("a", "str")])),
        ("empty file", read(b"")),
        ("too few fields", read(b"a,b\n1\n")),
        ("bad number", read(b"a\n1.0\n")),
        ("open quote", read(b'a,b\n1,"z\n')),
        ("quote inside a field", read(b'a,b\n1,z"z"\n')),
        ("long record", read(b"a\n" + b"1" * 30 + b"\n", max_record_bytes=20)),
        ("no columns", read(b"a\n1\n", [])),
        ("other header", lambda: read_money(spark, put(spark, "errors.csv", b"id,user\n1,2\n")).rows),
        ("no text", read(b"a\n\xff\n", "a:str")),
        ("many categories", lambda: analytics.dictionary_of(read(many, "k:str, v:int")(), "k", ["v"], 30)),
        ("no file", lambda: read_csv(spark, f"{_folder(spark)}/none.csv", "a:int")),
    ]
    return spark.createDataFrame([(name, _outcome(case)[0]) for name, case in cases], "name string, code string")


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a folder, read as a stream in two batches at least where there are several."""
    folder, at = exported(spark, sf_dir, "orders"), f"{_folder(spark)}/{uuid.uuid4().hex}"
    stream_csv(spark, folder, "o_orderkey:int, o_custkey:int, o_orderpriority:str", lambda df, n: df.drop("file").write.mode("append").parquet(f"{at}/rows"), f"{at}/log", files_per_batch=2).awaitTermination()
    return spark.read.parquet(f"{at}/rows")


def generated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated clean, messy and money files: rows, rows on which strict and common reader differ, categories."""
    out = []
    for name, rows, schema, column in (
        ("clean", benchmark_rows(spark, 4000), "id:int, amount:float, category:str, note:str", "category"),
        ("messy", benchmark_rows(spark, 4000, messy=True), "id:int, amount:float, category:str, note:str", "category"),
        ("money", money_rows(spark, 4000), "id:u64, amount:cents, category:str, note:str", "category"),
    ):
        path = exported(spark, "", f"generated-{name}", lambda rows=rows: rows.coalesce(2))
        strict, common = read_csv(spark, path, schema), read_common(spark, path, schema)
        out.append((name, strict.count(), compare.mismatches(strict, common, "id").count(), strict.select(column).distinct().count()))
    return spark.createDataFrame(out, "name string, n long, mismatches long, categories long")


def common_scan_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_common(spark, _money_file(spark, sf_dir), "id:u64, user_id:u32, amount:cents, category:str")
    return found.select(F.col("id").cast("bigint").alias("id"), "user_id", F.col("amount").alias("amount_cents"), "category")


def money_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(spark, sf_dir).select("l_orderkey", "l_linenumber", display_money(F.col("l_extendedprice")).cast("string").alias("amount"))


def lossy_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose cents a detour by doubles changes, cutting off and rounding."""
    path, schema = _priced(spark, sf_dir, "orders", "o_totalprice"), "o_orderkey:int, o_totalprice:cents"
    each = [read_naive(spark, path, schema, money).withColumnRenamed("o_totalprice", money) for money in ("truncate", "round")]
    both = read_csv(spark, path, schema).join(each[0], "o_orderkey").join(each[1], "o_orderkey")
    differs = lambda c: F.sum((F.col(c) != F.col("o_totalprice")).cast("long"))
    return both.agg(F.count("*").alias("n"), differs("truncate").alias("cut_off"), differs("round").alias("rounded"))


def lazy_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lazy read of ragged records: null where a record is none, null where a cell is bad."""
    path = put(spark, "ragged.csv", b"a,b,c\n1,2,3\n4,5\n6,7,8,9\nx,10,11\n12,\"y\"\"z\",13\n")
    return read_csv(spark, path, "a:int, b:str", ReadOptions(validate=False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_typed_lineitem": _read("lineitem", "l_orderkey:int, l_linenumber:int, l_extendedprice:float, l_returnflag:str"),
    "scan_quoted_documents": _read("documents", "doc_id:int, text:str, lang:str"),
    "scan_quoted_pages": _read("pages", "page_id:int, url:str, html:str"),
    "scan_conversations": _read("conversations", "conv_id:int, turn:int, role:str, text:str"),
    "scan_events_json": _read("events", "event_id:int, user_id:u32, event_type:str, props:str"),
    "projection_reorder": _read("orders", "o_orderpriority:str, o_orderkey:int"),
} | {
    f.__name__: f
    for f in (common_scan_documents, empty_float_nan, money_cents, money_total, money_by_category, money_top3, money_profile, money_profile_by_category, dict_codes, dict_decode, count_rows, blank_lines_skipped, naive_integrity, errors_first, partition_invariance, error_offsets, typed_errors, stream_scan, generated_files, common_scan_money, money_display, lossy_money, lazy_ragged)
}

CENTS = "cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint)"
ORACLE_SQL: dict[str, str] = {
    "scan_typed_lineitem": "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_extendedprice, l_returnflag from lineitem",
    "scan_quoted_documents": "select doc_id, text, lang from documents",
    "scan_quoted_pages": "select page_id, url, html from pages",
    "scan_conversations": "select conv_id, cast(turn as bigint) as turn, role, text from conversations",
    "scan_events_json": "select event_id, user_id, event_type, props from events",
    "projection_reorder": "select o_orderpriority, o_orderkey from orders",
    "common_scan_documents": "select doc_id, text, lang from documents",
    "empty_float_nan": "select o_orderkey, case when o_orderkey % 7 = 0 then cast('NaN' as double) else o_totalprice end as o_totalprice from orders",
    "money_cents": f"select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, {CENTS} as amount_cents from lineitem",
    "money_total": f"select cast(sum({CENTS}) as bigint) as total_cents from lineitem",
    "money_by_category": f"select l_returnflag, cast(sum({CENTS}) as bigint) as total_cents from lineitem group by 1",
    "money_top3": "select p_brand, cast(sum(cast(cast(p_retailprice as decimal(18,2)) * 100 as bigint)) as bigint) as total_cents from part group by 1 order by 2 desc, 1 limit 3",
    "money_profile": f"select cast(l_orderkey * 10 + l_linenumber as bigint) as id, l_suppkey as user_id, {CENTS} as amount_cents, l_returnflag as category from lineitem",
    "money_profile_by_category": f"select l_returnflag as category, cast(sum({CENTS}) as bigint) as total_cents from lineitem group by 1",
    "dict_codes": "select row_number() over (order by min(c_custkey)) - 1 as code, c_mktsegment from customer group by 2",
    "dict_decode": "select c_custkey, c_mktsegment from customer",
    "count_rows": "select count(*) as n from documents",
    "blank_lines_skipped": "select cast(n_nationkey as bigint) as n_nationkey, n_name from nation",
    "errors_first": "select 'BAD_VALUE' as code, 'x' as cell",
    "partition_invariance": "select count(*) as n, cast(0 as bigint) as mismatches from documents",
    "error_offsets": """
        select * from (values ('plain', 'BAD_VALUE', cast(4 + 4 * 3000 as bigint)), ('mark', 'BAD_VALUE', 3 + 4 + 4 * 3000), ('mark, one split', 'BAD_VALUE', 3 + 4 + 4 * 3000),
            ('quoted newlines', 'FIELD_COUNT', 3 + 4 + 8 * 2000), ('carriage returns', 'BARE_QUOTE', 5 + 5 * 10)) as t(name, code, byte_offset)
    """,
    "typed_errors": """
        select * from (values ('unknown column', 'UNKNOWN_COLUMN'), ('column requested twice', 'DUPLICATE_COLUMN'), ('empty file', 'EMPTY_INPUT'), ('too few fields', 'FIELD_COUNT'),
            ('bad number', 'BAD_VALUE'), ('open quote', 'UNTERMINATED_QUOTE'), ('quote inside a field', 'BARE_QUOTE'), ('long record', 'RECORD_TOO_LARGE'), ('no columns', 'INVALID_OPTIONS'),
            ('other header', 'BAD_HEADER'), ('no text', 'INVALID_UTF8'), ('many categories', 'TOO_MANY_CATEGORIES'), ('no file', 'FILE_NOT_FOUND')) as t(name, code)
    """,
    "stream_scan": "select o_orderkey, o_custkey, o_orderpriority from orders",
    "generated_files": "select * from (values ('clean', cast(4000 as bigint), cast(0 as bigint), cast(7 as bigint)), ('messy', 4000, 0, 7), ('money', 4000, 0, 6)) as t(name, n, mismatches, categories)",
    "common_scan_money": f"select cast(l_orderkey * 10 + l_linenumber as bigint) as id, l_suppkey as user_id, {CENTS} as amount_cents, l_returnflag as category from lineitem",
    "money_display": "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(cast(l_extendedprice as decimal(18,2)) as varchar) as amount from lineitem",
    "lossy_money": """
        with cents as (select cast(cast(o_totalprice as decimal(18,2)) as double) * 100 as x, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as exact from orders)
        select count(*) as n, cast(sum(case when cast(trunc(x) as bigint) <> exact then 1 else 0 end) as bigint) as cut_off,
               cast(sum(case when cast(round(x) as bigint) <> exact then 1 else 0 end) as bigint) as rounded from cents
    """,
    "lazy_ragged": "select * from (values (cast(1 as bigint), '2'), (null, null), (null, null), (null, '10'), (12, 'y\"z')) as t(a, b)",
}
