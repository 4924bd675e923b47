import itertools
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import coordinates as O
from lodestone.operators import decide as D
from lodestone.operators import metrics as K
from lodestone.operators import replay as P
from lodestone.operators import truth as T
from lodestone.queries import studies
from lodestone.sources import readers, sinks


def test_screen_of_the_fixture(spark):
    rows = [(f"p{p}", f"{c}/{o}") for p in range(75) for c in range(4) for o in range(4)]
    got = O.balanced_screen(spark.createDataFrame(rows, "program string, build string"), "program", "build").toPandas()
    assert len(got) == 150 and (got.groupby("program").size() == 2).all() and set(got.groupby("build").size()) == {9, 10}
    with pytest.raises(Exception, match="incomplete"):
        O.balanced_screen(spark.createDataFrame(rows[:-16] + [("p74", "0/0")], "program string, build string"), "program", "build").collect()


def test_panel_of_the_fixture(spark):
    rows = list(itertools.product([f"f{i}" for i in range(60)], ["current", "minor", "major"], ["a", "b", "c", "d"], ["O0", "O2", "O3", "Os"]))
    df = spark.createDataFrame(rows, "family string, role string, compiler string, level string")
    got = O.build_panel(df, "family", "level", "compiler", "role").toPandas()
    assert len(got) == 720 and (got.groupby("family").size() == 12).all() and (got.groupby(["family", "level"]).size() == 3).all()
    with pytest.raises(Exception, match="incomplete"):
        O.build_panel(df.filter("not (family = 'f1' and compiler = 'a')").unionByName(df.filter("family = 'f1' and compiler = 'a' and role = 'x'")), "family", "level", "compiler", "role").collect()


def test_search_and_profiles():
    score = lambda p: -((p["a"] - 3) ** 2) - (p["b"] - 1) ** 2
    grid = {"a": [0, 1, 2, 3, 4], "b": [0, 1, 2]}
    assert P.greedy_search({"a": 0, "b": 0}, grid, score) == ({"a": 3, "b": 1}, 0)
    assert P.random_search(grid, score, 200, 1)[1] == 0
    profiles = P.profile_design({"a": 0, "b": 0}, grid, 6)
    assert len(profiles) == 6 and profiles[0] == {"a": 0, "b": 0} and {p["a"] for p in profiles[1:]} == set(grid["a"]) and profiles == P.profile_design({"a": 0, "b": 0}, grid, 6)


def test_pair_map_last_wins_and_numbers(spark):
    df = spark.createDataFrame([([1, 10, 2, 20, 1, 30],), ([],), ([5],)], "x array<int>")
    assert [r[0] for r in df.select(O.pair_map(F.col("x"))).collect()] == [{2: 20, 1: 30}, {}, {}]
    n = spark.createDataFrame([("0x1F",), (" 12 ",), ("-3",), ("true",), ("",), (None,), ("0x",)], "t string")
    assert [r[0] for r in n.select(O.whole_number(F.col("t"))).collect()] == [31, 12, -3, None, None, None, None]


def test_descriptors_and_missing_index(spark):
    m = spark.createDataFrame([("u", 0), ("u", 1)], "unit string, elf_index int")
    d = spark.createDataFrame([("u", 0, "main"), ("u", 1, "f")], "unit string, function_index int, name string")
    assert [r.elf_function.name for r in O.with_descriptors(m, d, ["unit"], "elf_index", "elf").orderBy("elf_index").collect()] == ["main", "f"]
    with pytest.raises(Exception, match="no elf function"):
        O.with_descriptors(m, d.filter("function_index = 0"), ["unit"], "elf_index", "elf").collect()


def test_symbols_hints_outcomes_statuses(spark):
    s = spark.createDataFrame([("T", "f"), ("u", "f"), ("W", "f"), ("t", "$x"), ("t", ""), (None, "f"), ("T", None)], "k string, s string")
    assert [r[0] for r in s.select(O.useful_symbol(F.col("k"), F.col("s"))).collect()] == [True, False, False, False, False, False, False]
    m = spark.createDataFrame([(1, 0, 3, 0.5, 1.0, 1.0), (1, 1, 2, 0.9, 0.1, 0.1), (1, 1, 1, 0.9, 0.1, 0.1)], "u int, cu_function int, elf_function int, dominant_ratio double, coverage_mean double, coverage_ratio double")
    assert [(r.cu_function, r.elf_function) for r in D.best_function_hint(m, ["u"]).collect()] == [(1, 1)]
    o = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (None, True), (True, None), (None, None)], "a boolean, b boolean")
    assert [r[0] for r in o.select(D.detection_outcome(F.col("a"), F.col("b"))).collect()] == ["both", "first_only", "second_only", "neither", "missing_first", "missing_second", "missing_both"]
    assert [r[0] for r in o.select(D.cu_status(F.col("a"), F.col("b"))).collect()] == ["DROP_RODATA", "PASS", "DROP", "DROP", "DROP", "PASS", "DROP"]


def test_metrics_of_nothing_are_zero(spark):
    df = spark.createDataFrame([], "expected boolean, predicted boolean")
    r = K.metrics(df.agg(*K.counts())).first().asDict()
    assert all(v == 0 for v in r.values())


def test_units_are_counted_without_a_row_for_each_pair_and_unit(spark, tmp_path):
    n = 50_000  # builds that link one library, and its units: 2.5e9 rows if written out
    i = spark.range(n)
    i.selectExpr("id as build_id", "' lib.a' as library", "concat('d/u', id, '.c.o') as cu_name", "id % 2 = 0 as passed").union(i.selectExpr("id", "'none.a'", "'u0.o'", "id < 10")).write.parquet(f"{tmp_path}/block_matches.parquet")
    i.selectExpr("'lib.a' as archive_basename", "concat('u', if(id < 100, id, id + 1000000), '.o') as name", "2 as n_functions").write.parquet(f"{tmp_path}/archive_members.parquet")
    i.selectExpr("id as build_id", "'lib.a ' as archive_basename", "true as selected_by_linker").union(i.selectExpr("id", "'none.a'", "id >= 10")).write.parquet(f"{tmp_path}/elf_archives.parquet")
    end = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    end.start()
    try:
        r = studies.cu_metrics(spark, str(tmp_path)).first()
    finally:
        end.cancel()
    assert r[:4] == (n + 10, 50, n // 2 - 50 + 10, n * n - 50)


def test_units_of_pairs_with_nulls_and_of_contradictory_pairs(spark):
    c = spark.createDataFrame([(1, 1, True, True), (1, 1, False, True), (2, 1, True, True), (None, 1, True, True), (3, None, None, None), (4, 2, True, None)], "a int, b int, expected boolean, labelled boolean")
    p = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 1, "x"), (2, 1, "x"), (None, 1, "x"), (3, None, "x"), (4, 2, "x"), (2, 1, None)], "a int, b int, cu string")
    u = spark.createDataFrame([(1, "x"), (1, "z"), (1, "z"), (1, None), (None, "x"), (2, "x")], "b int, cu string")
    assert K.cu_metrics(p, u, c, ["a", "b"], unit_keys=["b"]).first()[:4] == (4, 2, 4, 4)


def test_two_builds_of_one_family(spark):
    rows = [("c", "libssl", True, True), ("c", "libssl", True, False), ("c", "libcrypto", False, True), ("c", "libz", True, None)]
    r = D.family_rollup(spark.createDataFrame(rows, "case string, family string, e boolean, p boolean"), ["case", "family"], "e", "p")
    assert {(x.family, x.expected, x.predicted) for x in r.collect()} == {("libssl", True, True), ("libcrypto", False, True), ("libz", True, False)}


def test_pareto_keeps_tradeoffs_and_first_of_equals(spark):
    rows = [(1, 1, 0.99, 0.5), (1, 2, 0.98, 1.0), (1, 3, 0.98, 1.0), (1, 4, 0.9, 0.4), (1, 5, None, 2.0), (1, 6, float("nan"), 2.0), (2, 7, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "g int, i int, a double, b double").repartition(3)
    assert sorted(r.i for r in P.pareto(df, ["g"], ["a", "b"], "i").collect()) == [1, 2, 7]


def test_files_truth_and_checkpoints(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.a").write_bytes(b"!<arch>\nrest")
    (tmp_path / "a" / "y").write_bytes(b"\x7fELF")
    assert [r.path[-3:] for r in readers.discover(spark, str(tmp_path / "a"), b"!<arch>\n").collect()] == ["x.a"]
    (tmp_path / "t.json").write_text('{"binary": "b", "program": "p", "compiler": "gcc", "archives": [{"archive": "/x/liba.a", "compiler": "clang"}, {"archive": "libb.a"}]}')
    rows = readers.ground_truth(spark, str(tmp_path / "t.json"), ["p"], ["gcc"]).collect()
    assert [(r.archive, r.compiler, r.elf_compiler) for r in rows] == [("/x/liba.a", "clang", "gcc"), ("libb.a", None, "gcc")]
    assert readers.ground_truth(spark, str(tmp_path / "t.json"), ["q"]).count() == 0
    done = spark.createDataFrame([("s1", 1), ("s2", 2)], "signature string, case_id int")
    sinks.append_checkpoint(done, str(tmp_path / "cp"))
    sinks.append_checkpoint(done.filter("case_id = 2"), str(tmp_path / "cp"))
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    assert sorted(r[0] for r in sinks.pending(cases, spark.read.parquet(str(tmp_path / "cp")), "s2").collect()) == [1, 3]
    with pytest.raises(Exception, match="misses"):
        sinks.require_empty(cases, "misses").collect()
    assert sinks.require_empty(cases.limit(0), "misses").collect() == []


def test_conflicts_and_replacement(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None)], "k int, p string")
    assert [(r.k, r.versions) for r in readers.conflicting(df, ["k"], "p").collect()] == [(1, 2)]
    fresh = spark.createDataFrame([(1, "z")], "k int, p string")
    assert sorted((r.k, r.p or "") for r in T.replaced(df, fresh, "k").collect()) == [(1, "z"), (2, "a"), (2, "a"), (3, "")]


def test_pareto_of_small_and_large_groups(spark):
    """Groups on either side of the sizes that are handled apart, against brute force."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"g{g}", i, *map(float, rng.integers(0, 6, 3) / 5)) for g, n in enumerate((1, 2, 5, 63, 64, 65, 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, a double, b double, c double").repartition(5)
    want = set()
    for g, i, *v in rows:
        beats = lambda w, j: all(x >= y for x, y in zip(w, v)) and (any(x > y for x, y in zip(w, v)) or j < i)
        if not any(h == g and beats(w, j) for h, j, *w in rows):
            want.add((g, i))
    for part_rows in (20_000, 7):
        assert {(r.g, r.i) for r in P.pareto(df, ["g"], ["a", "b", "c"], "i", part_rows).collect()} == want
