import struct

import pytest
from pyspark.sql import functions as F

from lodestone.operators.structure import containing_function
from lodestone.operators.truth import linker_map_members
from lodestone.sources import readers, sinks
from lodestone.streaming import checkpoints


def test_matrix_and_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("liba.a", "p", "current", "gcc", "O2", "3", "selected", None, "/x"), ("libb.a", "p", "current", "gcc", "O2", "3", "missing", "why", None)], readers.LIBRARY_MATRIX)
    sinks.write_table(df, str(tmp_path / "m"), "tsv")
    assert [r.archive for r in readers.library_matrix(spark, str(tmp_path / "m")).collect()] == ["liba.a"]


def test_several_objects_a_line(spark):
    df = spark.createDataFrame([(1, '{"a":1} {"b":{"c":2}}'), (2, "x"), (3, None), (4, '{"a":')], "i int, t string")
    assert [(r.i, r.object_no, r.object) for r in readers.objects_of_lines(df, "t", strict=False).orderBy("i", "object_no").collect()] == [(1, 0, '{"a":1}'), (1, 1, '{"b":{"c":2}}')]
    assert readers.objects_of_lines(df.filter("i in (1, 3)"), "t").count() == 2
    for i in (2, 4):
        with pytest.raises(Exception, match="invalid JSON line"):
            readers.objects_of_lines(df.filter(f"i = {i}"), "t").collect()


def test_report_round_trip(spark):
    df = spark.createDataFrame([("YES", "liba.a", 0.5)], "s string, l string, v double")
    line = df.select(sinks.report_line(F.col("s"), {"library": F.col("l"), "score": F.col("v")}).alias("line"))
    r = readers.parse_report_lines(line, "line").first()
    assert (r.status, r.library, r.score) == ("YES", "liba.a", 0.5)


def test_bundle_round_trip_and_gaps(spark, tmp_path):
    elf, lib = spark.createDataFrame([("e1",), ("e2",)], "elf_id string"), spark.createDataFrame([("l1",)], "library_id string")
    match = spark.createDataFrame([("e1", "l1"), ("e3", "l1")], "elf_id string, library_id string")
    sinks.write_bundle({"elf": elf, "library": lib, "library_match": match}, str(tmp_path / "b"))
    assert sinks.read_bundle(spark, str(tmp_path / "b"), "library_match", "elf_id string, library_id string").count() == 2
    assert {(r.elf_id, r.n) for r in sinks.bundle_gaps(elf, lib, match).collect()} == {("e2", 0), ("e3", 1)}


def test_linker_map_section(spark):
    text = "junk\nArchive member included to satisfy reference by file (symbol)\n\n/u/liba.a(x.o)\n              main.o (f)\nlibb.a(y.o)  z\n\nlibc.a(no.o)\n"
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "k int, t string")
    assert {(r.archive, r.member) for r in linker_map_members(df, "k", "t").collect()} == {("/u/liba.a", "x.o"), ("libb.a", "y.o")}


def elf(*segments, dynamic=(), machine=62):
    """A small x86-64 executable with the given program header types; a dynamic segment (2) holds the tags ``dynamic``."""
    head = bytearray(64 + 56 * len(segments) + 16 * (len(dynamic) + 1))
    head[:6] = b"\x7fELF\x02\x01"
    struct.pack_into("<HH", head, 16, 2, machine)
    struct.pack_into("<Q", head, 32, 64)
    struct.pack_into("<HH", head, 54, 56, len(segments))
    for i, kind in enumerate(segments):
        struct.pack_into("<I4xQ16xQ", head, 64 + 56 * i, kind, 64 + 56 * len(segments), 16 * (len(dynamic) + 1))
    for i, tag in enumerate(dynamic):
        struct.pack_into("<q", head, 64 + 56 * len(segments) + 16 * i, tag)
    return bytes(head)


def test_elf_headers(spark):
    files = {"static": elf(1), "interp": elf(1, 3), "pie": elf(1, 2, dynamic=(5,)), "needed": elf(1, 2, dynamic=(5, 1)), "after the end": elf(2, dynamic=(0, 1)), "arm": elf(1, machine=40), "cut": elf(1, 2)[:100], "no": b"no", "null": None}
    got = {r.path: r for r in readers.elf_headers(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    assert {k: r.link_type for k, r in got.items()} == {"static": "static", "interp": "dynamic", "pie": "static-pie", "needed": "dynamic", "after the end": "static-pie", "arm": None, "cut": None, "no": None, "null": None}
    assert got["needed"].has_needed and not got["pie"].has_needed and got["arm"].problem and got["cut"].problem == "bad program headers"


def test_patterns_fall_back_to_deeper_folders(spark, tmp_path):
    for name in ("a.so", "b.txt", "x/c.so", "x/y/d.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    names = lambda *p, **k: [x.rsplit("/", 1)[1] for x in readers.resolve_patterns(spark, f"file://{tmp_path}", list(p), **k)]
    assert names("*.so") == ["a.so"] and names("*.bin") == ["d.bin"] and names("b.txt", "*.so") == ["a.so", "b.txt"] and names("none") == [] and names("*", limit=1) == ["a.so"]


def test_report_settings_and_numbers(spark):
    text = "Library minimum score: 0.25\nAssembly normalization: v2\nPASS | library=a | windows=3/9 | edges=1/2/4 | coverage=87.5% | score=0.5\nLibrary minimum score: .5\nDone processing in 00:01:02\n"
    df = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "k int, t string")
    got = {r.k: tuple(r)[1:] for r in readers.report_settings(df, "k", "t").collect()}
    assert got[1] == ("00:01:02", 0.5, "v2", "mean", True) and got[2] == got[3] == ("", 0.0, "legacy", "mean", False)
    line = df.select(F.explode(F.split("t", "\n")).alias("l")).filter("l like 'PASS%'")
    r = line.select(*(v.alias(k) for k, v in readers.report_numbers("l").items())).first()
    assert tuple(r) == (3, 9, 1, 2, 4, 87.5, 0.5)


def test_interval_join_ties(spark):
    f = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 50, 60), (1, 2, 50, 55), (1, 3, 9000, 20000)], "u int, function_index int, start bigint, stop bigint")
    a = spark.createDataFrame([(1, 50), (1, 52), (1, 58), (1, 99), (1, 100), (1, 15000), (1, None), (2, 50)], "u int, address bigint")
    got = {(r.u, r.address): r.resolved_function for r in containing_function(a, f, ["u"], "address").collect()}
    assert got == {(1, 50): 2, (1, 52): 2, (1, 58): 1, (1, 99): 0, (1, 100): None, (1, 15000): 3, (1, None): None, (2, 50): None}


def test_stream_keeps_the_latest_row(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string").write.parquet(src)
    stream = checkpoints.read_log(spark, src, "k int, t int, v string")
    checkpoints.latest_into(stream, ["k"], ["t"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(1, 2, "c")], "k int, t int, v string").write.mode("append").parquet(src)
    checkpoints.latest_into(stream, ["k"], ["t"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()} == {(1, "c"), (2, "b")}
