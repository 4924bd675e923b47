import random
from collections import defaultdict

from lodestone.operators.hot_keys import dense_key_stats, hot_keys

SCHEMA = "name string, v int, w double, t timestamp_ntz, id bigint, `__key` string, n string"


def rows(n=3000, seed=3):
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = rng.choice(["hot"] * 6 + ["warm"] * 2 + [None, "", " x "] + [f"k{rng.randrange(200)}"])
        t = None if rng.random() < 0.1 else datetime(2025, 1, 1) + timedelta(hours=rng.randrange(50))
        out.append((name, rng.choice([None, 1, 2, 2**30]), rng.choice([None, 0.5]), t, i, "clash", "clash"))
    return out + out[:100]


def brute(data):
    by = defaultdict(list)
    for r in data:
        by[r[0]].append(r)
    out = {}
    for k, rs in by.items():
        vs, ws = [r[1] for r in rs if r[1] is not None], [r[2] for r in rs if r[2] is not None]
        best = max(rs, key=lambda r: (r[3] is not None, r[3] or 0, r[4]) if r[3] else (False, 0, r[4]))
        out[k] = (len(rs), sum(vs) if vs else None, sum(ws) if ws else None, best[4])
    return out


def test_counts_sums_latest_with_nulls_ties_repeats_and_clashing_columns(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    for split_rows in (500_000, 50):  # the small bound flushes and compacts many times
        got = dense_key_stats(df, "name", ["v", "w"], ["t"], ["id"], split_rows=split_rows).collect()
        assert {r.key_value: (r.n, r.sum_v, r.sum_w, r.latest_id) for r in got} == brute(data)


def test_blocks_that_span_batches(spark):
    data = rows(1500, 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = dense_key_stats(spark.createDataFrame(data, SCHEMA).repartition(5), "name", ["v", "w"], ["t"], ["id"], split_rows=40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.key_value: (r.n, r.sum_v, r.sum_w, r.latest_id) for r in got} == brute(data) and len(got) == len(brute(data))


def test_integer_keys_keep_their_type(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (None, 2), (2, None)], "k int, v bigint")
    got = dense_key_stats(df, "k", ["v"])
    assert got.schema["key_value"].dataType.simpleString() == "int"
    assert {(r.key_value, r.n, r.sum_v) for r in got.collect()} == {(1, 2, 5), (None, 1, 2), (2, 1, None)}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dense_key_stats(df, "name", ["v"], ["t"], ["id"]).collect() == []
    assert hot_keys(df, "name").collect() == []


def test_hot_keys_count_all_rows_and_take_values_as_stored(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("a ",)] * 1 + [(None,)] * 97, "name string")
    assert {r.key_value for r in hot_keys(df, "name").collect()} == {"a"}


def test_a_value_at_exactly_the_share_is_in(spark):
    for total in (50, 150, 350, 1150):
        k = total // 50
        df = spark.createDataFrame([("a",)] * k + [("b",)] * (k - 1) + [(f"x{i}",) for i in range(total - 2 * k + 1)], "name string")
        hit = {r.key_value for r in hot_keys(df, "name").collect()}
        assert "a" in hit and (k == 1 or not any(x.startswith("x") for x in hit)) and ("b" not in hit)
