"""The strict reader against goldens, typed errors and an independent parser."""

import csv
import io
import math
import random

import pytest

from quillframe import errors as E
from quillframe.operators import compare
from quillframe.options import ReadOptions
from quillframe.sources.money import read_money
from quillframe.sources.reader import read_common, read_csv, read_naive
from quillframe.sources.sinks import benchmark_rows, money_rows, write_csv

MARK = b"\xef\xbb\xbf"
EDGE = MARK + b'no,weight,label\r\n7,0.25,"salt, coarse"\r\n8,,"upper\r\nlower"\r\n-9,1e2,tin'
H = b"id,user_id,note,amount,category\n"


def put(tmp_path, data: bytes, name: str = "f.csv") -> str:
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_edge_golden(spark, tmp_path):
    got = rows(read_csv(spark, put(tmp_path, EDGE), "no:int, weight:float, label:str", ordered=True))
    assert [(r[0], r[2]) for r in got] == [(7, "salt, coarse"), (8, "upper\r\nlower"), (-9, "tin")]
    assert got[0][1] == 0.25 and math.isnan(got[1][1]) and got[2][1] == 100.0


CASES = [
    ("column that is not there", EDGE, "colour:int", {}, E.UnknownColumn),
    ("text where a number should be", EDGE, "label:int", {}, E.BadValue),
    ("short record", b"p,q,r\n1,2,3\n4,5\n", "p:int", {}, E.FieldCount),
    ("long record", b"p,q\n1,2,3\n", "p:int", {}, E.FieldCount),
    ("quote without an end", b'p,q\n5,"never\nclosed\n', "p:int", {}, E.UnterminatedQuote),
    ("quote in the middle", b'p,q\n5,in"ch"es\n', "p:int", {}, E.BareQuote),
    ("text after a quote", b'p,q\n5,"a"b\n', "p:int", {}, E.BareQuote),
    ("open record over the limit", b'p\n3,"' + b"w" * 70_000, "p:int", {"max_record_bytes": 9_000}, E.RecordTooLarge),
    ("record over the limit", b"p,q\n3," + b"w" * 3000 + b"\n4,v\n", "p:int", {"max_record_bytes": 1500}, E.RecordTooLarge),
    ("header over the limit", b"w" * 3000 + b"\n3\n", "w:int", {"max_record_bytes": 1500}, E.RecordTooLarge),
    ("nothing", b"", "p:int", {}, E.EmptyInput),
    ("nothing but a mark", MARK, "p:int", {}, E.EmptyInput),
    ("beyond 64 bits", b"p\n-9223372036854775809\n", "p:int", {}, E.BadValue),
    ("blank before a number", b"p\n\t12\n", "p:int", {}, E.BadValue),
    ("literal beyond a double", b"p\n-2e308\n", "p:float", {}, E.BadValue),
    ("bytes that are no text", b"p\nab\xc3\n", "p:str", {}, E.InvalidUtf8),
    ("empty line", b"p\n1\n\n2\n", "p:int", {"blank_lines": "error"}, E.BadValue),
    ("one column twice", EDGE, [("no", "int"), ("no", "str")], {}, E.DuplicateColumn),
    ("no columns", EDGE, {}, {}, E.InvalidOptions),
    ("empty name", b"p\n\"\"\n", "p:name", {}, E.BadValue),
]


@pytest.mark.parametrize("name, data, schema, options, error", CASES, ids=[c[0] for c in CASES])
def test_typed_errors(spark, tmp_path, name, data, schema, options, error):
    with pytest.raises(error) as found:
        read_csv(spark, put(tmp_path, data), schema, ReadOptions(**options)).collect()
    assert found.value.code == error.code


def test_missing_file_and_options(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none.csv"), "a:int")
    with pytest.raises(ValueError):
        ReadOptions(chunk_bytes=100)
    with pytest.raises(E.InvalidOptions):
        ReadOptions(workers=0)


def test_first_error_wins_with_its_offset(spark, tmp_path):
    lines = ["1,2"] * 9000
    lines[3000], lines[6000] = "x,2", "y,2"
    path = put(tmp_path, ("a,b\n" + "\n".join(lines) + "\n").encode())
    for size in (4096, 8191):
        with pytest.raises(E.BadValue, match="x") as found:
            read_csv(spark, path, "a:int", ReadOptions(chunk_bytes=size))
        assert found.value.offset == 4 + 4 * 3000


def random_table(seed: int, n: int, end: str) -> bytes:
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    writer.writerow(["id", "note", "x"])
    for i in range(n):
        note = "".join(rng.choice(["a", ",", '"', "\n", "\r\n", "é", "\\", "#", " "]) for _ in range(rng.randint(0, 12)))
        writer.writerow([i, note * (800 if i % 97 == 5 else 1), f"{i}.5"])
    return out.getvalue().encode()


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n")])
def test_any_split_size_gives_the_rows_of_an_independent_parser(spark, tmp_path, seed, end):
    data = random_table(seed, 400, end)
    path = put(tmp_path, data)
    want = [(int(r[0]), r[1], float(r[2])) for r in list(csv.reader(io.StringIO(data.decode(), newline="")))[1:]]
    for options in (ReadOptions(chunk_bytes=4096), ReadOptions(chunk_bytes=5000), ReadOptions(), ReadOptions(workers=1)):
        assert rows(read_csv(spark, path, "id:int, note:str, x:float", options, ordered=True)) == want


def test_fold_of_several_files(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f'id,t\n{i},"a\nb"\n'.encode(), f"{i}.csv")
    assert sorted(rows(read_csv(spark, str(tmp_path), "t:str, id:int"))) == [("a\nb", i) for i in range(3)]
    put(tmp_path, b"id,u\n1,2\n", "9.csv")
    with pytest.raises(E.BadHeader):
        read_csv(spark, str(tmp_path), "id:int")


MONEY = [
    ("only the header", H, []),
    ("no header", b"", None),
    ("last line without an end", H + b"31,7,crate,8.05,freight", [805]),
    ("two-character line ends", H.replace(b"\n", b"\r\n") + b"31,7,crate,8.05,freight\r\n32,7,sack,0.40,duties\r\n", [805, 40]),
    ("byte order mark", MARK + H + b"31,7,crate,8.05,freight\n", [805]),
    ("comma in quotes", H + b'31,7,"crate, large",8.05,freight\n', [805]),
    ("newline in quotes", H + b'31,7,"upper\nlower",8.05,freight\n32,8,sack,0.40,duties\n', [805, 40]),
    ("quotes in quotes", H + b'31,7,"the ""old"" mill",8.05,freight\n', [805]),
    ("every field in quotes", H + b'"31","7","crate","8.05","freight"\n', [805]),
    ("whole amount", H + b"31,7,crate,1000,freight\n", [100_000]),
    ("amount that no double holds", H + b"31,7,crate,90071992547409.93,freight\n", [9_007_199_254_740_993]),
    ("three decimals", H + b"31,7,crate,8.050,freight\n", None),
    ("negative amount", H + b"31,7,crate,-8.05,freight\n", None),
    ("quote without an end", H + b'31,7,"crate,8.05,freight\n', None),
    ("four fields", H + b"31,7,crate,8.05\n", None),
    ("six fields", H + b"31,7,crate,8.05,freight,fast\n", None),
    ("plus sign", H + b"+31,7,crate,8.05,freight\n", None),
    ("user beyond 32 bits", H + b"31,4294967296,crate,8.05,freight\n", None),
    ("empty line", H + b"31,7,crate,8.05,freight\n\n", None),
    ("empty category", H + b"31,7,crate,8.05,\n", None),
]


@pytest.mark.parametrize("name, data, cents", MONEY, ids=[c[0] for c in MONEY])
def test_money_profile(spark, tmp_path, name, data, cents):
    path = put(tmp_path, data)
    if cents is None:
        with pytest.raises(E.CsvError):
            read_money(spark, path)
    else:
        table = read_money(spark, path)
        assert sorted(r["amount_cents"] for r in table.rows.collect()) == sorted(cents)
        assert table.count() == len(cents) and table.is_empty() == (not cents) and table.total_cents().first()[0] == sum(cents)


def test_offsets_count_a_byte_order_mark(spark, tmp_path):
    path = put(tmp_path, MARK + b"p,q\n" + b"1,2\n" * 3000 + b"x,2\n")
    for options in (ReadOptions(chunk_bytes=4096), ReadOptions()):
        with pytest.raises(E.BadValue) as found:
            read_csv(spark, path, "p:int", options)
        assert found.value.offset == 3 + 4 + 4 * 3000


def test_lazy_reads(spark, tmp_path):
    lazy = ReadOptions(validate=False)
    ragged = put(tmp_path, b'a,b,c\n1,2,3\n4,5\n6,7,8,9\nx,10,11\n12,"y""z",13\n14,q"r,15\n')
    got = rows(read_csv(spark, ragged, "b:str, a:int", lazy, ordered=True))
    assert got == [("2", 1), (None, None), (None, None), ("10", None), ('y"z', 12), (None, None)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "in" / "2.csv").write_bytes(b"b,a\n1,2\n")
    frame = read_csv(spark, str(tmp_path / "in"), "a:int", lazy)
    with pytest.raises(Exception, match="BAD_HEADER"):
        frame.collect()


def test_plans_for_many_blocks_and_few_workers(spark, tmp_path, monkeypatch):
    from quillframe.sources import records

    data = random_table(3, 300, "\n")
    path = put(tmp_path, data)
    want = [(int(r[0]), r[1]) for r in list(csv.reader(io.StringIO(data.decode(), newline="")))[1:]]
    for driver, broadcast in ((0, 1 << 18), (0, 0), (1 << 12, 0)):
        monkeypatch.setattr(records, "MAX_DRIVER_BLOCKS", driver)
        monkeypatch.setattr(records, "MAX_BROADCAST_BLOCKS", broadcast)
        for workers in (None, 2):
            assert rows(read_csv(spark, path, "id:int, note:str", ReadOptions(chunk_bytes=4096, workers=workers), ordered=True)) == want
    monkeypatch.undo()
    plain = put(tmp_path, b"a\n" + b"1\n" * 20_000, "plain.csv")
    assert read_csv(spark, plain, "a:int", ReadOptions(chunk_bytes=4096, workers=3, validate=False)).rdd.getNumPartitions() == 3


def test_small_splits_share_tasks_and_stay_blocks(spark, tmp_path):
    from quillframe.sources import records

    small = ReadOptions(chunk_bytes=4096, validate=False)
    plain = put(tmp_path, b"a\n" + b"".join(b"%d\n" % i for i in range(60_000)), "plain.csv")
    frame = read_csv(spark, plain, "a:int", small, keep_order=True)
    assert frame.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    found = rows(frame.orderBy("_blk", "_pos"))
    assert [r[3] for r in found] == list(range(60_000))
    assert len({r[1] for r in found}) == -(-(tmp_path / "plain.csv").stat().st_size // 4096)
    data = random_table(4, 2500, "\n")
    path = put(tmp_path, data)
    want = [(int(r[0]), r[1]) for r in list(csv.reader(io.StringIO(data.decode(), newline="")))[1:]]
    assert len(data) > 40 * 4096 and b'"' in data
    assert rows(read_csv(spark, path, "id:int, note:str", small, ordered=True)) == want
    assert spark.conf.get(records.PARTITIONS, None) is None


def test_conversions_against_patterns(spark):
    """Every short text over a few characters, against the patterns that define the kinds."""
    import itertools
    import re

    from pyspark.sql import functions as F
    from quillframe.functions.convert import strict_float, strict_int

    cells = ["".join(c) for n in range(5) for c in itertools.product("07+-.eEx \t", repeat=n)]
    cells += ["1d", "1f", "0x1p3", "0X1P3", "nan", "NaN", "-inf", "Infinity", "+INF", "1_0", "１", "9" * 18, "9223372036854775807", "9223372036854775808", "1e308", "1e309", "-1e309", "infinit", "1\x00", "\x001", "1\u00a0", "0" * 50, "1" + "0" * 400]
    frame = spark.createDataFrame([(c,) for c in cells], "c string").select("c", strict_int(F.col("c")).alias("i"), strict_float(F.col("c")).alias("f"))
    for cell, i, f in frame.collect():
        whole = int(cell) if re.fullmatch(r"[+-]?[0-9]+", cell) else None
        assert i == (whole if whole is not None and -(2**63) <= whole < 2**63 else None), repr(cell)
        if re.fullmatch(r"[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?", cell):
            assert f == (float(cell) if math.isfinite(float(cell)) else None), repr(cell)
        elif cell.strip(" \t") == "" or cell.lower() == "nan":
            assert math.isnan(f), repr(cell)
        elif re.fullmatch("[+-]?inf(inity)?", cell.lower()):
            assert f == float(cell), repr(cell)
        else:
            assert f is None, repr(cell)


def test_a_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from quillframe.sources.records import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(E.InvalidOptions):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_money_detours_and_display(spark, tmp_path):
    from pyspark.sql import functions as F
    from quillframe.functions.convert import display_money

    path = put(tmp_path, b"a,b\n1,19.99\n2,90071992547409.93\n3,0.07\n")
    exact = [r[1] for r in rows(read_csv(spark, path, "a:int, b:cents", ordered=True))]
    assert exact == [1999, 9007199254740993, 7]
    far = int(90071992547409.93 * 100)
    assert far != exact[1]
    assert [r[1] for r in rows(read_naive(spark, path, "a:int, b:cents"))] == [1998, far, 7]
    assert [r[1] for r in rows(read_naive(spark, path, "a:int, b:cents", "round"))] == [1999, far, 7]
    with pytest.raises(E.InvalidOptions):
        read_naive(spark, path, "b:cents", "guess")
    assert [str(r[0]) for r in read_csv(spark, path, "a:int, b:cents", ordered=True).select(display_money(F.col("b"))).collect()] == ["19.99", "90071992547409.93", "0.07"]


def test_outcomes_and_measures(spark, tmp_path):
    from quillframe.operators.measure import best_seconds, measured

    good, bad = put(tmp_path, b"a\n1\n"), put(tmp_path, b"a\nx\n", "bad.csv")
    read = lambda path: lambda: read_csv(spark, path, "a:int")
    assert compare.same_outcome(read(good), lambda: read_common(spark, good, "a:int"))
    assert compare.same_outcome(read(bad), read(bad)) and not compare.same_outcome(read(good), read(bad))
    found = measured(read(good))
    assert found["rows"] == 1 and found["seconds"] > 0 and found["heap_mb"] > 0 and best_seconds(read(good), 1) > 0


def test_cancelled_jobs_and_failing_workers(spark, tmp_path):
    import threading
    import time

    from pyspark.sql import functions as F
    from quillframe.operators.measure import cancel, cancellable

    def slowly(batches):
        for batch in batches:
            time.sleep(30)
            yield batch

    threading.Timer(3, cancel, (spark, "slow")).start()
    with pytest.raises(E.Cancelled), cancellable(spark, "slow"):
        spark.range(10).mapInArrow(slowly, "id long").collect()

    def fails(batches):
        raise RuntimeError("broken worker")
        yield from batches

    with pytest.raises(Exception, match="broken worker"):
        spark.range(10).mapInArrow(fails, "id long").agg(F.count("*")).collect()


def test_command_line(spark, capsys, monkeypatch):
    from quillframe import __main__ as command

    monkeypatch.setattr(command, "SIZES", (200,))
    assert command.main(["10"]) == 2
    assert command.main(["500"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 3 and "200 of 200" in out[1]


def test_too_many_categories(spark, tmp_path):
    from quillframe.operators import analytics

    path = put(tmp_path, b"k,v\n" + b"".join(b"%d,1\n" % (i % 50) for i in range(200)))
    frame = read_csv(spark, path, "k:str, v:int")
    assert analytics.dictionary_of(frame, "k", ["v"], 50).count() == 50
    with pytest.raises(E.TooManyCategories):
        analytics.dictionary_of(frame, "k", ["v"], 49)


def test_generators_readers_and_integrity(spark, tmp_path):
    schema = "id:int, amount:float, category:str, note:str"
    truth = benchmark_rows(spark, 3000, messy=True)
    path = str(tmp_path / "messy")
    write_csv(truth.coalesce(1), path)
    strict, common = read_csv(spark, path, schema), read_common(spark, path, schema)
    assert compare.same_rows(strict, common) and compare.same_table(strict, common, "id")
    naive = compare.integrity(read_naive(spark, path, schema), strict, "id").first()
    assert naive["intact"] < 3000 < naive["rows"]
    money = str(tmp_path / "money")
    write_csv(money_rows(spark, 2000).coalesce(1), money)
    table = read_money(spark, money)
    assert table.count() == 2000 and table.dictionary.count() == 6
    assert sum(r["total_cents"] for r in table.total_by_category().collect()) == table.total_cents().first()[0]


def test_stream_reads_each_file_once(spark, tmp_path):
    from quillframe.streaming.incremental import stream_csv

    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for i in range(2):
        put(folder, f"id\n{i}\n".encode(), f"{i}.csv")
    for _ in range(2):
        stream_csv(spark, str(folder), "id:int", lambda df, n: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "log")).awaitTermination()
        put(folder, b"id\n7\n", "7.csv")
    assert sorted(seen) == [0, 1, 7]
