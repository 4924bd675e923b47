from datetime import datetime as T

from pyspark.sql import functions as F

from lodestone.operators.orphans import archive_references, orphan_counts, orphan_rows, validity

ELF = "ref_id bigint, archive string, archive_basename string, linked_at timestamp_ntz, period string, n int"
MEM = "member_id bigint, archive string, archive_basename string, extracted_at timestamp_ntz"
CAT = "archive string, status string, registered_at timestamp_ntz, deleted_at timestamp_ntz"


def run(spark, elf, mem, cat, share=0.001, **kw):
    c = validity(spark.createDataFrame(cat, CAT), F.nullif(F.trim("archive"), F.lit("")), "registered_at", "deleted_at", F.col("status") == "selected")
    return orphan_rows(archive_references(spark.createDataFrame(elf, ELF), spark.createDataFrame(mem, MEM)), c, share, **kw)


CATALOG = [(" liba.a ", "selected", T(2024, 1, 1), T(2025, 3, 15)), ("liba.a", "selected", T(2025, 6, 1), None), ("libm.a", "missing", None, None), (None, "selected", T(2024, 1, 1), None), ("libz.a", None, T(2024, 1, 1), None), ("libq.a", "selected", T(2024, 1, 1), T(2023, 1, 1))]
REFS = [
    (1, None, " liba.a", T(2025, 3, 14, 23), "x", 1), (2, None, "liba.a", T(2025, 3, 15), "x", 1), (3, "/p/liba.a", "  ", T(2025, 6, 1), "x", 1), (4, "/p/liba.a", None, T(2025, 5, 31), "x", 1),
    (5, None, None, T(2025, 1, 1), "x", 1), (6, "/p/", "", T(2025, 1, 1), "x", 1), (7, None, "liba.a", None, "x", 1), (8, None, "LIBA.a", T(2025, 7, 1), "x", 1), (9, None, "libm.a", T(2025, 7, 1), "x", 1), (2, None, "liba.a", T(2025, 3, 15), "x", 1),
    (10, None, "libz.a", T(2025, 7, 1), "x", 1), (11, None, "libq.a", T(2025, 7, 1), "x", 1),
]


def test_lifetimes_names_nulls_and_repeats_for_heavy_and_light_keys(spark):
    for share in (0.0, 0.001, 0.3, 2.0):  # all heavy ... none heavy
        got = run(spark, REFS, [(1, "x/libnone.a", None, T(2025, 2, 2))], CATALOG, share).collect()
        assert sorted((r.table_name, r.row_id) for r in got) == sorted([("archive_members", 1), *(("elf_archives", i) for i in (2, 4, 8, 9, 10, 11))])


def test_many_lifetimes_of_heavy_keys_are_salted(spark):
    got = run(spark, REFS, [], CATALOG, 0.0, most_broadcast=0, salts=3).collect()
    assert sorted(r.row_id for r in got) == [2, 4, 8, 9, 10, 11]


def test_repeats_that_differ_show_the_earliest(spark):
    got = run(spark, [(1, None, "libx.a", T(2025, 2, 2), "x", 1), (1, None, "liby.a", T(2025, 1, 2), "x", 1)], [], CATALOG).collect()
    assert [(r.row_id, r.ref_key, r.period) for r in got] == [(1, "liby.a", "2025-01")]


def test_counts_and_empty_tables(spark):
    n = orphan_counts(run(spark, REFS, [], CATALOG)).collect()
    assert {(r.period, r.n_orphans) for r in n} == {("2025-03", 1), ("2025-05", 1), ("2025-07", 4)}
    assert run(spark, [], [], CATALOG).collect() == []
    assert len(run(spark, REFS, [], []).collect()) == 8
