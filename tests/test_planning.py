import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.planning import archive_pools, balanced_folds, covering_cases, diversity, quota_cases, source_matches, version_plan
from lodestone.operators.quality import completeness, inventory, markdown_table, record_violations, repeated_identities, report_conflicts, set_gaps, shard_violations, truth_conflicts
from lodestone.operators.scenario import compatible, with_provenance
from lodestone.operators.store import cached_only, canonical_json, combined_digest, differences, misses, read_entries, reusable, write_entries
from lodestone.operators.truth import cohort_cells
from lodestone.plans.skew import bounded, salted_join
from lodestone.sources import sinks


def test_folds_keep_groups_and_both_labels(spark):
    rng = random.Random(4)
    rows = [(f"g{i}", rng.randrange(1, 9), rng.randrange(0, 4), rng.randrange(1, 9), [f"f{rng.randrange(5)}"]) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, cases bigint, positive bigint, negative bigint, families array<string>")
    got = balanced_folds(df, "g", 4, seed=2).toPandas()
    assert sorted(got.g) == sorted(r[0] for r in rows) and set(got.fold) == {0, 1, 2, 3}
    pos = {r[0]: r[2] for r in rows}
    assert all(sum(pos[g] for g in part.g) > 0 for _, part in got.groupby("fold"))
    sizes = got.groupby("fold").cases.sum()
    assert sizes.max() - sizes.min() <= 9 and balanced_folds(df, "g", 4, seed=2).toPandas().equals(got)
    assert balanced_folds(df.limit(0), "g", 4).collect() == []
    with pytest.raises(Exception, match="groups are more than"):
        balanced_folds(df, "g", 4, most_groups=5).collect()


def test_covering_cases_take_the_rarest_first(spark):
    rows = [("s", 1, "a"), ("s", 1, "b"), ("s", 2, "b"), ("s", 3, "b"), ("s", 3, "c"), ("s", 3, "d"), ("t", 9, "a"), ("s", None, "z"), ("s", 1, None), ("s", 1, "a")]
    got = [(r.g, r.c) for r in covering_cases(spark.createDataFrame(rows, "g string, c int, l string"), "g", "c", "l").orderBy("g", "place").collect()]
    assert got == [("s", 1), ("s", 3), ("t", 9)]


def test_quotas_pools_diversity_and_plans(spark):
    cases = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(30)], "id int, s string")
    assert [r["count"] for r in quota_cases(cases, ["s"], 4, "id").groupBy("s").count().collect()] == [4, 4]
    linked = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "case int, archive string")
    scored = spark.createDataFrame([(1, "a", 0.9), (1, "c", 0.5), (1, "d", 0.5), (2, "a", 0.1), (2, "e", None)], "case int, archive string, score double")
    cat = spark.createDataFrame([("a", "x", "g", "O1"), ("a", "y", "g", "O1"), ("z", "x", "g", "O1")], "archive string, role string, compiler string, optimization string")
    assert {(r.archive, r.pool) for r in archive_pools(linked, scored, cat).collect()} == {("a", "positive"), ("b", "positive"), ("c", "hard_negative"), ("a", "hard_negative"), ("a", "diverse")}
    d = {r.archive: (r.n_role, r.enough, r.ambiguous) for r in diversity(cat, "archive", {"role": 2, "compiler": 1}, F.col("optimization")).collect()}
    assert d == {"a": (2, True, False), "z": (1, False, False)}
    slots = spark.createDataFrame([("l", f"p{i}") for i in range(10)] + [("m", "p1"), ("n", None)], "lib string, slot string")
    plan = version_plan(slots, spark.createDataFrame([("l", "v1"), ("l", "v2"), ("l", "v3"), ("q", "v1")], "lib string, v string"), "lib", "slot", "v").toPandas()
    assert len(plan) == 10 and plan.v.value_counts().max() - plan.v.value_counts().min() <= 1
    s = source_matches(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, stem string"), spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "stem string, d string"), ["id"], "stem", "d")
    assert {r.id: (r.sources, r.status) for r in s.collect()} == {1: (2, "mapped"), 2: (2, "ambiguous"), 3: (0, "unmapped")}


def test_cohorts_wrap_around(spark):
    cells = spark.createDataFrame([("gcc-12", "gcc", 2, 3), ("clang-16", "clang", None, None)], "compiler string, family string, program_count int, cohort_offset int")
    progs = spark.createDataFrame([(p, ["gcc"] if p != "c" else ["gcc", "clang"]) for p in "abcd"], "program string, supports array<string>")
    assert {(r.compiler, r.program) for r in cohort_cells(cells, progs, "program").collect()} == {("gcc-12", "d"), ("gcc-12", "a"), ("clang-16", "c")}


def test_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert {(r.k, r.side) for r in set_gaps(a, b, ["k"]).collect()} == {(1, "missing"), (3, "extra")}
    f = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 1.0)], "k int, x double, y double")
    assert {(r.k, r.problem) for r in completeness(spark.createDataFrame([(1,), (3,)], "k int"), f, ["k"], ["x", "y"]).collect()} == {(1, "null_x"), (3, "missing")}
    m = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", None), ("c", "1")], "k string, sha string")
    assert {(r.k, r.kind) for r in repeated_identities(m, ["k"], "sha").collect()} == {("a", "identical"), ("b", "ambiguous")}
    p = spark.createDataFrame([("a", "PASS"), ("a", "DROP"), ("b", "PASS")], "k string, s string")
    assert [tuple(r) for r in report_conflicts(p, spark.createDataFrame([("a", 1), ("c", 2)], "k string, n int"), ["k"], F.col("s") == "PASS", "n").orderBy("k").collect()] == [("b", 1, 0), ("c", 0, 2)]
    s = spark.createDataFrame([("s1", "l1", 1), ("s1", "l2", 2), ("s2", "l1", 1), ("s2", "l1", 3), ("s2", "l1", 3)], "shard string, lib string, id int")
    assert {tuple(r) for r in shard_violations(s, "shard", ["lib"], ["id"]).collect()} == {("catalog", "s2", 1), ("repeated", "s2", 1), ("crossed", "s1", 1)}
    r = spark.createDataFrame([("a", 0, "PASS", True, "x"), ("a", 2, "DROP", True, "y"), ("b", 0, None, None, "x"), ("b", 0, "DROP", False, "z")], "k string, i int, s string, p boolean, d string")
    assert {tuple(x) for x in record_violations(r, ["k"], "i", "s", "p", r, ["d"]).collect()} == {("contiguous", 1), ("status", 2), ("descriptor", 1)}
    t, man = spark.createDataFrame([(1, "a", "g"), (1, "b", "g")], "k int, i string, c string"), spark.createDataFrame([(1, "a", True, "h"), (1, "n", False, None), (1, "q", True, None)], "k int, i string, expected boolean, c string")
    assert {(x.i, x.field) for x in truth_conflicts(t, man, "k", "i", ["c"]).collect()} == {("a", "c"), ("b", "row"), ("q", "expected")}
    inv = inventory(spark.createDataFrame([("E", 1), ("E", 2), ("C", 1)], "t string, k int"), spark.createDataFrame([("E", 1, 5), ("C", 1, 7)], "t string, k int, n int"), "t", "k", "n")
    assert {r.t: (r.entries, r.bytes, r.missing, r.valid) for r in inv.collect()} == {"E": (1, 5, 1, False), "C": (1, 7, 0, True)}
    md = [r.line for r in markdown_table(spark.createDataFrame([("a|b", None)], "x string, y int"), ["x"]).orderBy("line_no").collect()]
    assert md == ["| x | y |", "|-|-|", "| a\\|b |  |"]


def test_store(spark, tmp_path):
    path, schema = f"file://{tmp_path}/store", "key string, n int, archive string"
    assert read_entries(spark, path, schema).count() == 0
    one = spark.createDataFrame([("aa", 1, "x"), ("bb", 2, "x")], schema)
    write_entries(one, path)
    write_entries(spark.createDataFrame([("bb", 2, "x"), ("cc", 3, "y")], schema), path)
    (tmp_path / "store" / "batch=cut").mkdir()  # a batch that never committed
    got = read_entries(spark, path, schema)
    assert sorted(tuple(r) for r in got.collect()) == [("aa", 1, "x"), ("bb", 2, "x"), ("cc", 3, "y")]
    want = spark.createDataFrame([("aa",), ("zz",), (None,), ("aa",)], "key string")
    assert [r.key for r in misses(want, got).collect()] == ["zz"] and cached_only(want.filter("key = 'aa'"), got).count() == 1
    with pytest.raises(Exception, match="not in the store: zz"):
        cached_only(want.filter("key is not null"), got).collect()
    assert {r.side: r.rows for r in differences(got, one).collect()} == {"left": 1, "right": 0} and {r.rows for r in differences(one, one).collect()} == {0}
    assert spark.range(1).select(canonical_json({"b": F.lit(None).cast("int"), "a": F.lit("x")})).first()[0] == '{"a":"x","b":null}'
    parts = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a")], "k string, o int, c string")
    assert combined_digest(parts, ["k"], "o", "c").first().digest == combined_digest(parts.orderBy("o"), ["k"], "o", "c").first().digest
    reused, missing = reusable(spark.createDataFrame([(1, "a", "p", "s"), (1, "b", "p", "s")], "c int, a string, p string, s string"), spark.createDataFrame([(1, "a", "p", "s", 5), (1, "b", "p", "old", 6)], "c int, a string, p string, s string, v int"), ["c", "a"], "p", "s")
    assert [r.v for r in reused.collect()] == [5] and [r.a for r in missing.collect()] == ["b"]


def test_sinks_check_what_they_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sinks.write_checked(df, f"file://{tmp_path}/c") == 2
    elf, lib = spark.createDataFrame([("e",)], "elf_id string"), spark.createDataFrame([("l",)], "library_id string")
    units = spark.createDataFrame([("e", "l", "PASS"), ("e", "l", "DROP")], "elf_id string, library_id string, cu_status string")
    match = lambda n: spark.createDataFrame([("e", "l", n)], "elf_id string, library_id string, accepted int")
    sinks.write_checked_bundle(elf, lib, match(1), units, f"file://{tmp_path}/b")
    with pytest.raises(ValueError, match="passing units differ"):
        sinks.write_checked_bundle(elf, lib, match(2), units, f"file://{tmp_path}/b2")
    with pytest.raises(ValueError, match="missing or repeated"):
        sinks.write_checked_bundle(elf, lib, match(1).unionByName(match(1)), units, f"file://{tmp_path}/b3")
    cp = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "other", 1)], "case_id string, signature string, t int")
    assert {tuple(r) for r in sinks.migrated(cp, "new", ("old",), ["t"]).collect()} == {("a", "new", 2), ("b", "other", 1)}
    assert [r.case_id for r in sinks.pending(spark.createDataFrame([("a",), ("b",)], "case_id string"), cp, "newer", legacy=("old",)).collect()] == ["b"]


def test_exact_artifacts_and_provenance(spark):
    cat = spark.createDataFrame([(1, "/x/gcc/O1/a.a", "a", "p", "gcc", "O1", "r"), (2, None, "b", "q", "gcc", "O2", "r"), (3, None, "b", "q", "gcc", "O2", "s")], "label int, path string, family string, package string, compiler string, optimization string, role string")
    refs = spark.createDataFrame([(1, "a", "/x/gcc/O1/a.a"), (2, "b", "/y/gcc/O2/b.a"), (3, "b", "b.a"), (4, "b", None)], "id int, family string, path string")
    got = {r.id: (r.label, r.package, r.compiler, r.role, r.source) for r in with_provenance(refs, cat, "path").collect()}
    assert got == {1: (1, "p", "gcc", "r", "exact_path"), 2: (None, "q", "gcc", None, "path_parts"), 3: (None, None, None, None, "unresolved"), 4: (None, None, None, None, "unresolved")}
    same = cat.alias("a").join(cat.alias("c"), compatible("same_exact_artifact"))
    assert same.count() == 3


def test_salted_join_and_bounded(spark):
    rng = random.Random(2)
    left = [(rng.choice(["h", "a", "b", None]), i) for i in range(60)]
    right = [(rng.choice(["h"] * 8 + ["a", "c", None]), i) for i in range(90)]
    a, b = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    for share in (0.0, 0.3, 2.0):
        got = sorted((r.k, r.x, r.y) for r in salted_join(a, b, ["k"], share, 4).collect())
        assert got == sorted((k, x, y) for k, x in left for j, y in right if k is not None and k == j)
    with pytest.raises(ValueError, match="more than 5 rows"):
        bounded(a, 5)
