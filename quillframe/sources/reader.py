"""Readers of CSV files: strict and parallel, common (one task a file), and a naive one as a warning."""

from __future__ import annotations

import csv
import io

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.errors import CODES, BadHeader, EmptyInput, InvalidOptions, MissingFile
from quillframe.functions.convert import CONVERT, TYPES, preview
from quillframe.options import ReadOptions, Schema, positions, requested
from quillframe.packaging import ship
from quillframe.sources.records import BOM, Blocks, byte_setting, has_mark, head, quotes, records

ORDER = ["_file", "_blk", "_pos"]
# RFC 4180 fields, with possessive repeats so that long records don't exhaust the stack
RECORD = r'^(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+\z'


def _session(spark: SparkSession, options: ReadOptions) -> SparkSession:
    """A session of the same application whose split size is the option's."""
    if options.chunk_bytes is None:
        return spark
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(options.chunk_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def split_record(record: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline="")), [])


def _raw(spark: SparkSession, path: str, options: ReadOptions, task_bytes: int | None) -> tuple[DataFrame, Blocks, DataFrame]:
    try:
        found, known, scan = records(spark, path, options.max_record_bytes + 1, options.workers, task_bytes)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingFile(f"no file at {path}") from e
        raise
    # one final CR belongs to the line end
    whole = F.col("rec").cast("string")
    rec = F.when(whole.endswith("\r"), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    size = F.when(F.col("rec").isNotNull(), F.octet_length(rec)).otherwise(F.col("size"))
    return found.select(F.col("file").alias("_file"), F.col("blk").alias("_blk"), F.col("pos").alias("_pos"), rec.alias("rec"), size.cast("long").alias("size")), known, scan


def _header(spark: SparkSession, file: str | None, options: ReadOptions, exact: str | None) -> str:
    """The first record of the first file; those of other files are held against it when records are read."""
    record = head(spark, file, options.max_record_bytes) if file else None
    record = record[:-1] if record and record.endswith("\r") else record
    if not record:
        raise BadHeader("the file has no header") if exact else EmptyInput("the file is empty")
    size = len(record.encode("utf-8", "replace"))
    if size > options.max_record_bytes:
        raise CODES["RECORD_TOO_LARGE"](f"the header has more than {options.max_record_bytes} bytes", file, 0)
    if exact is not None and record != exact:
        raise BadHeader(f"the header is not {exact!r}", file, 0)
    if record.count('"') % 2:
        raise CODES["UNTERMINATED_QUOTE"]("in the header", file, 0)
    return record


def _quoted_fields(rec: Column, ncols: int, at: list[int]) -> Column:
    """The cells at the given places of a record with quotes, as an array. The record is parsed once, whatever their number."""
    names = [f"c{i}" for i in range(ncols)]
    parsed = F.from_csv(rec, ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "lineSep": "\u0001", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": "\u0000"})
    # a function's argument is evaluated once; written out, each cell would parse the record anew
    return F.transform(F.array(parsed), lambda r: F.array(*(F.coalesce(r[names[i]], F.lit("")) for i in at)))[0]


def _checked(found: DataFrame, known: Blocks, first_record: str, header: list[str], columns: list[tuple[str, str]], options: ReadOptions) -> DataFrame:
    """Converted columns beside error code and detail of each record (null if it is sound)."""
    first = known.table.where("blk = 0").select(F.col("file").alias("_f"), F.col("first").alias("_p"))
    body = found.join(known.small(first), (F.col("_file") == F.col("_f")) & (F.col("_pos") == F.col("_p")), "left").withColumn("_first", F.col("_p").isNotNull())
    if options.blank_lines == "skip":
        body = body.where((F.col("size") > 0) | F.col("rec").isNull() | F.col("_first"))
    rec, limit = F.col("rec"), options.max_record_bytes
    at = positions(header, columns)
    quoted = F.coalesce(rec.contains('"'), F.lit(False))
    body = body.select(*ORDER, "_first", "rec", "size", quoted.alias("_quoted"))
    body = body.select("*", F.when(~F.col("_quoted"), F.split(rec, ",", -1)).alias("_plain"), F.when(F.col("_quoted"), _quoted_fields(rec, len(header), at)).alias("_cells"))
    # the parser has a field count of its own; commas outside quotes give the record's
    bare = F.regexp_replace(rec, '"[^"]*+"', "")
    number = F.when(F.col("_quoted"), F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).otherwise(F.size("_plain"))
    cell = lambda j: F.when(F.col("_quoted"), F.col("_cells")[j]).otherwise(F.get("_plain", F.lit(at[j])))
    body = body.select(*ORDER, "_first", "rec", "size", "_quoted", number.alias("_n"), *(cell(j).alias(f"c{j}") for j in range(len(at))))
    kinds = [k for _, k in columns]
    body = body.select("*", *(CONVERT[k](F.col(f"c{j}")).alias(f"v{j}") for j, k in enumerate(kinds)))
    q = F.col("_quoted")
    code = F.when(F.col("_first"), F.when(~rec.eqNullSafe(F.lit(first_record)), "BAD_HEADER")).when(F.col("size") > limit, "RECORD_TOO_LARGE").when(q & (quotes(rec) % 2 == 1), "UNTERMINATED_QUOTE").when(q & ~rec.rlike(RECORD), "BARE_QUOTE").when(F.col("_n") != len(header), "FIELD_COUNT")
    detail = F.when(F.col("_first"), F.lit("the header differs from the first file's")).when(F.col("size") > limit, F.concat(F.col("size").cast("string"), F.lit(" bytes"))).when(F.col("_n") != len(header), F.concat(F.col("_n").cast("string"), F.lit(f" fields instead of {len(header)}")))
    for j in sorted(range(len(at)), key=lambda j: at[j]):
        name, kind, c = columns[j][0], kinds[j], F.col(f"c{j}")
        if kind == "str":  # splitting may already have replaced bad bytes
            bad, wrong = ~F.is_valid_utf8(rec) & (~F.is_valid_utf8(c) | c.contains("\ufffd")), "INVALID_UTF8"
        else:
            bad, wrong = F.col(f"v{j}").isNull(), "BAD_VALUE"
        code = code.when(bad, wrong)
        detail = detail.when(bad, F.concat(F.lit(f"{name!r} as {kind}: "), preview(F.make_valid_utf8(c))))
    values = [F.col(f"v{j}").cast(TYPES[k]).alias(name) for j, (name, k) in enumerate(columns)]
    return body.select(*ORDER, "_first", code.alias("_code"), detail.alias("_detail"), *values)


def _raise_first(checked: DataFrame, known: Blocks, scan: DataFrame) -> None:
    """Raise the first error in file order, with the byte offset of its record in the file (a byte order mark counts)."""
    # not a filter: pushed below the conversions it would repeat them all
    bad = checked.agg(F.min(F.when(F.col("_code").isNotNull(), F.struct("_file", "_blk", "_pos", "_code", "_detail"))).alias("x")).first()["x"]
    if bad is None:
        return
    here = (F.col("file") == bad["_file"]) & (F.col("blk") == bad["_blk"])
    start = known.table.where(here).first()["offset"]
    inside = scan.where(here & (F.col("pos") < bad["_pos"])).agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    mark = len(BOM) if has_mark(scan.sparkSession, bad["_file"]) else 0
    raise CODES[bad["_code"]](bad["_detail"] or "malformed record", bad["_file"], start + inside + mark)


def read_csv(spark: SparkSession, path: str | list[str], schema: Schema, options: ReadOptions | None = None, ordered: bool = False, keep_order: bool = False, exact_header: str | None = None) -> DataFrame:
    """Strictly read the requested columns of a CSV file, of a folder or a list of files with one header.

    ordered: rows come in file order. keep_order: the order columns _file, _blk, _pos stay.
    """
    options = options or ReadOptions()
    columns = requested(schema)
    own = _session(spark, options)
    ship(spark)
    # the session's split size stays what a task reads
    found, known, scan = _raw(own, path, options, byte_setting(spark, "spark.sql.files.maxPartitionBytes") if options.chunk_bytes else None)
    first_record = _header(own, known.file, options, exact_header)
    header = split_record(first_record)
    positions(header, columns)
    checked = _checked(found, known, first_record, header, columns, options)
    if options.validate:
        _raise_first(checked, known, scan)
        rows = checked.where(~F.col("_first"))
        values = [F.col(f"`{name}`") for name, _ in columns]
    else:  # a header that differs fails when it is read; records that are none have null cells, so have bad cells
        wrong = F.raise_error(F.concat(F.lit("BAD_HEADER: the header differs from the first file's: "), F.col("_file"))).cast("boolean")
        rows = checked.where(F.when(~F.col("_first"), True).when(F.col("_code").isNull(), False).otherwise(wrong))
        values = [F.when(F.col("_code").isNull() | F.col("_code").isin("BAD_VALUE", "INVALID_UTF8"), F.col(f"`{name}`")).alias(name) for name, _ in columns]
    out = rows.orderBy(*ORDER) if ordered else rows
    return out.select(*(ORDER if keep_order else []), *values)


def read_common(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """The library reader with quoted newlines: right for well-formed files, but one task for each file."""
    columns = requested(schema)
    text = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    text = text.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    try:
        rows = text.csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingFile(f"no file at {path}") from e
        raise
    positions(rows.columns, columns)
    cell = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
    kind = {"int": lambda c: c.cast("bigint"), "float": lambda c: F.when(F.trim(c) == "", float("nan")).otherwise(c.try_cast("double")), "str": lambda c: c}
    return rows.select(*(kind.get(k, CONVERT[k])(cell(name)).cast(TYPES[k]).alias(name) for name, k in columns))


def read_naive(spark: SparkSession, path: str, schema: Schema, money: str = "truncate") -> DataFrame:
    """What not to do: split on newlines and commas, bad numbers as 0. Wrong for quoted fields; kept for comparison.

    money: how cents are made from a double, by cutting off ("truncate") or by rounding ("round"); the first loses
    a cent of amounts like 19.99, the second of amounts beyond 2^53.
    """
    if money not in ("truncate", "round"):
        raise InvalidOptions("money is truncate or round")
    columns = requested(schema)
    rows = spark.read.text(path)
    header = rows.first()["value"].split(",")
    at = positions(header, columns)
    cells = F.split(F.col("value"), ",", -1)
    body = rows.where((F.col("value") != ",".join(header)) & (F.length("value") > 0))
    cell = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit(""))
    number = {"int": ("bigint", 0), "float": ("double", 0.0), "u64": ("bigint", 0), "u32": ("bigint", 0)}

    def value(i: int, kind: str) -> Column:
        if kind in ("str", "name"):
            return cell(i)
        if kind == "cents":
            cents = cell(i).try_cast("double") * 100
            return F.coalesce((F.round(cents) if money == "round" else cents).try_cast("bigint"), F.lit(0))
        return F.coalesce(cell(i).try_cast(number[kind][0]), F.lit(number[kind][1]))

    return body.select(*(value(i, k).alias(name) for i, (name, k) in zip(at, columns)))
