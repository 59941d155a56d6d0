"""CSV records from a splittable text scan, by quote parity.

A record ends at a newline that an even number of quotes precedes. Each file split (block)
counts its quotes in a first narrow pass, one row a block; a running sum over the blocks of a
file gives the parity that each block starts with. Files without any line of odd quotes, the
usual case, need nothing more: their lines are records. Otherwise the blocks' lines are joined
to records where they lie, in Arrow batches; only the pieces at the ends of blocks, two a block
at most, are shuffled and put together. No line order is sorted and no data is moved.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.errors import InvalidOptions

_folders: list[str] = []
MAX_BROADCAST_BLOCKS = 1 << 18  # block rows of about 100 bytes
MAX_DRIVER_BLOCKS = 1 << 12  # up to so many block rows are numbered on the driver, more in the shared folder
BOM = b"\xef\xbb\xbf"
PARTITIONS = "spark.sql.files.maxPartitionNum"


def byte_setting(spark: SparkSession, key: str) -> int:
    """A setting of a size, such as 16m, in bytes."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))


def packed(text: DataFrame, task_bytes: int) -> int:
    """The number of splits of a scan. Small ones are dealt to tasks of about task_bytes, each split a block as before: a task for each would cost more than its text."""
    spark = text.sparkSession
    size = int(str(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = byte_setting(spark, "spark.sql.files.maxPartitionBytes")
    if split < task_bytes:
        spark.conf.set(PARTITIONS, str(max(-(-size // task_bytes), 2 * spark.sparkContext.defaultParallelism)))
    return -(-size // split)


def lines(spark: SparkSession, path: str, tasks: int | None = None, task_bytes: int | None = None) -> tuple[DataFrame, int]:
    """file, blk (offset of the split), pos (order inside a scan), value (binary, without line end), read by `tasks` tasks at most; about how many blocks there are.

    task_bytes: what a task reads if splits are smaller; only for a session of the reader's own, whose settings it changes.
    """
    # the split size, as an option, keeps scans with different splits apart when one plan holds both
    reader = spark.read.option("lineSep", "\n").option("splitBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    text = reader.text(path)
    number = packed(text, task_bytes) if task_bytes else 0
    scan = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"), F.col("value"))
    scan = (scan.coalesce(tasks) if tasks else scan).select("file", "blk", F.monotonically_increasing_id().alias("pos"), F.col("value").cast("binary").alias("value"))
    return scan, max(number, scan.rdd.getNumPartitions())


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where the master is local (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise InvalidOptions("spark.checkpoint.dir must name a folder that driver and executors share")
        _folders.append(tempfile.mkdtemp(prefix="quillframe-"))
        atexit.register(shutil.rmtree, _folders[-1], True)
        path = _folders[-1]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def kept(table: DataFrame) -> DataFrame:
    """A small table written once to the session's shared folder, so that later steps don't scan the input for it."""
    shared_folder(table.sparkSession)
    return table.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def has_mark(spark: SparkSession, file: str) -> bool:
    """Whether a file starts with a byte order mark, which the scan leaves out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return [stream.read() for _ in BOM] == list(BOM)
    finally:
        stream.close()


def head(spark: SparkSession, file: str, limit: int) -> str | None:
    """The first record of a file, or as much of it as exceeds limit; None if the file is empty. Reads its first lines only."""
    n = 1
    while True:
        lines_ = [r["value"] for r in spark.read.option("lineSep", "\n").text(file).take(n)]
        text = ""
        for k, line in enumerate(lines_):
            text = f"{text}\n{line}" if k else line
            if text.count('"') % 2 == 0 or len(text) > limit:
                return text
        if len(lines_) < n:
            return text if lines_ else None
        n *= 4


def quotes(value: Column) -> Column:
    """Number of quotes; texts without one, the usual case, are only searched."""
    plain = value.cast("string")
    return F.when(plain.contains('"'), F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit('"'), F.lit("")))).otherwise(0)


def counted(scan: DataFrame) -> DataFrame:
    """One row a block: its odd lines, bytes and positions. One pass over the input, combined before its shuffle."""
    lines_ = scan.select("file", "blk", "pos", F.octet_length("value").alias("size"), (quotes(F.col("value")) % 2).alias("odd"))
    at = F.when(F.col("odd") == 1, F.col("pos"))
    return lines_.groupBy("file", "blk").agg(F.sum("odd").alias("odd"), F.sum(F.col("size") + 1).alias("bytes"), F.min("pos").alias("first"), F.min(at).alias("first_odd"), F.max(at).alias("last_odd"))


def placed(each: DataFrame) -> DataFrame:
    """Blocks with the parity they start with, where an open record began, and their offset."""
    before = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    found = each.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    # a block opens the record that is open at its end if it starts outside one, or closes one and opens another
    opens = F.when(((F.col("inside") + F.col("odd")) % 2 == 1) & (F.col("odd") > 0), F.col("blk"))
    found = found.withColumn("opened", F.when(F.col("inside") == 1, F.last(opens, ignorenulls=True).over(before)))
    return found.select("file", "blk", "odd", "inside", "opened", "offset", "first", "first_odd", "last_odd")


@dataclass(frozen=True)
class Blocks:
    """table: file, blk, odd, inside, opened, offset, first, first_odd, last_odd (positions). quoted: whether a line of odd quotes was seen. file: the first one."""

    table: DataFrame
    number: int
    quoted: bool
    file: str | None

    def small(self, table: DataFrame) -> DataFrame:
        """For a join: broadcast where the table's size allows it."""
        return F.broadcast(table) if self.number <= MAX_BROADCAST_BLOCKS else table


def blocks(scan: DataFrame, expected: int) -> Blocks:
    spark = scan.sparkSession
    if expected <= MAX_DRIVER_BLOCKS // 4:
        found = counted(scan).limit(MAX_DRIVER_BLOCKS + 1).collect()
        if len(found) <= MAX_DRIVER_BLOCKS:
            found.sort(key=lambda r: (r["file"], r["blk"]))
            rows, file, inside, offset, opened = [], None, 0, 0, None
            for r in found:
                if r["file"] != file:
                    file, inside, offset, opened = r["file"], 0, 0, None
                rows.append((file, r["blk"], r["odd"], inside, opened if inside else None, offset, r["first"], r["first_odd"], r["last_odd"]))
                after = (inside + r["odd"]) % 2
                opened = r["blk"] if after and r["odd"] else opened
                inside, offset = after, offset + r["bytes"]
            table = spark.createDataFrame(rows, "file string, blk long, odd long, inside long, opened long, offset long, first long, first_odd long, last_odd long")
            return Blocks(table, len(rows), any(r[2] for r in rows), rows[0][0] if rows else None)
    table = kept(placed(counted(scan)))
    known = table.agg(F.count("*"), F.sum("odd"), F.min("file")).first()
    return Blocks(table, known[0], bool(known[1]), known[2])


def assemble(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Lines (file, blk, pos, value, inside, opened) of whole blocks to records and pieces.

    part: null for a whole record; else the block in which the record began. size: its bytes; rec is
    null if it has more than limit, so that a stray quote doesn't fill memory.
    """
    names = ["file", "blk", "pos", "rec", "size", "part"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    now: tuple | None = None  # file and block being read
    open_: dict | None = None  # record being read: pos, pieces, size, part

    def row(held: dict, part: int | None) -> list:
        size = held["size"] - 1
        return [now[0], now[1], held["pos"], b"\n".join(held["pieces"]) if size <= limit else None, size, part]

    for batch in batches:
        out: list[list] = []
        whole: list[pa.RecordBatch] = []
        file, blk = batch.column(0), batch.column(1).to_numpy()
        names_here = file.to_pylist()
        starts = [0, *[i for i in range(1, batch.num_rows) if blk[i] != blk[i - 1] or names_here[i] != names_here[i - 1]], batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            block = names_here[a], int(blk[a])
            part = batch.slice(a, b - a)
            if block != now:
                if open_ is not None:
                    out.append(row(open_, open_["part"] if open_["part"] is not None else now[1]))
                now = block
                inside = part.column(4)[0].as_py()
                open_ = {"pos": part.column(2)[0].as_py(), "pieces": [], "size": 0, "part": part.column(5)[0].as_py()} if inside else None
            value, pos = part.column(3), part.column(2).to_numpy()
            odd = pc.count_substring(value, '"').to_numpy() % 2
            after = (np.cumsum(odd) + (open_ is not None)) % 2  # open after the line
            ends = np.flatnonzero(after == 0)  # lines that end a record
            first = 0
            if open_ is not None:  # lines of the record that was open before
                first = int(ends[0]) + 1 if len(ends) else len(pos)
                ends = ends[1:] if len(ends) else ends
                for x in value.slice(0, first).to_pylist():
                    open_["size"] += len(x) + 1
                    if open_["size"] <= limit + 1:
                        open_["pieces"].append(x)
                    else:
                        open_["pieces"] = []
                if after[first - 1] == 0:
                    out.append(row(open_, open_["part"]))
                    open_ = None
            if len(ends):  # whole records of one or more lines
                offsets = np.concatenate([[0], ends + 1 - first]).astype(np.int32)
                body = value.slice(first, int(ends[-1]) + 1 - first)
                single = pa.array(offsets)
                joined = pc.binary_join(pa.ListArray.from_arrays(single, body), b"\n") if len(body) > len(ends) else body
                size = pc.binary_length(joined).cast(pa.int64())
                begin = pos[first + offsets[:-1]]
                n = len(ends)
                if pc.max(size).as_py() > limit:
                    joined = pa.array([x if len(x) <= limit else None for x in joined.to_pylist()], pa.binary())
                whole.append(pa.RecordBatch.from_arrays([pa.array([block[0]] * n, pa.string()), pa.array(np.full(n, block[1])), pa.array(begin), joined, size, pa.nulls(n, pa.int64())], names))
                first = int(ends[-1]) + 1
            if first < len(pos) and open_ is None:  # a record that goes on
                rest = value.slice(first).to_pylist()
                open_ = {"pos": int(pos[first]), "pieces": rest, "size": sum(map(len, rest)) + len(rest), "part": None}
                if open_["size"] > limit + 1:
                    open_["pieces"] = []
        yield from whole
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(open_, open_["part"] if open_["part"] is not None else now[1]), types)], names)


def records(spark: SparkSession, path: str, limit: int, tasks: int | None = None, task_bytes: int | None = None) -> tuple[DataFrame, Blocks, DataFrame]:
    """file, blk, pos, rec (binary, null if over limit), size of every record; the blocks; the scan.

    Above MAX_BROADCAST_BLOCKS blocks (32 TB in splits of 128 MB) of files with quoted newlines the block
    table no longer goes to every task: lines are shuffled to their blocks and sorted there instead.
    """
    scan, expected = lines(spark, path, tasks, task_bytes)
    known = blocks(scan, expected)
    if not known.quoted:
        whole = scan.select("file", "blk", "pos", F.when(F.octet_length("value") <= limit, F.col("value")).alias("rec"), F.octet_length("value").cast("long").alias("size"))
        return whole, known, scan
    names = ["file", "blk", "pos", "value", "inside", "opened"]
    laid = scan.join(known.small(known.table.drop("offset", "first")), ["file", "blk"])

    def assembled(some: DataFrame) -> DataFrame:
        if known.number > MAX_BROADCAST_BLOCKS:
            some = some.repartition("file", "blk").sortWithinPartitions("file", "blk", "pos")
        return some.select(*names).mapInArrow(lambda b: assemble(b, limit), "file string, blk long, pos long, rec binary, size long, part long")

    # pieces are made from the lines at the ends of blocks: up to the quote that closes the record before, from the one that opens the last
    head_ = (F.col("inside") == 1) & (F.col("first_odd").isNull() | (F.col("pos") <= F.col("first_odd")))
    tail = ((F.col("inside") + F.col("odd")) % 2 == 1) & (F.col("pos") >= F.col("last_odd"))
    found = assembled(laid)
    pieces = assembled(laid.where(head_ | F.coalesce(tail, F.lit(False)))).where("part is not null").groupBy("file", "part").agg(F.sort_array(F.collect_list(F.struct("blk", "pos", "rec"))).alias("x"), (F.sum("size") + F.count("*") - 1).alias("size"))
    # a piece over the limit has no bytes, and then its record is over it too
    text = F.array_join(F.transform("x", lambda p: p["rec"].cast("string")), "\n").cast("binary")
    stitched = pieces.select("file", F.col("part").alias("blk"), F.col("x")[0]["pos"].alias("pos"), F.when(F.col("size") <= limit, text).alias("rec"), "size")
    return found.where("part is null").select("file", "blk", "pos", "rec", "size").unionByName(stitched), known, scan
