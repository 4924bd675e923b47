import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators.records import DEFAULTS, causes, parse_records, record_detail, record_json, replay_libraries, replay_units, source_calls, unit_records, unit_windows, with_defaults
from lodestone.operators.replay import GATES, factorial, gate_depth
from lodestone.operators.search import greedy_on_spark, keep_trials, parzen_search, trial_table, tuned

KEYS = ["binary_path", "library"]


def unit(cu, windows, **more):
    base = {"type": "block_cu", "binary_path": "/b", "library": "liba.a", "name": f"u{cu}.o", "target_cu_index": cu, "target_function_count": 4, "windows": windows, "rodata": 0.0}
    return {**base, **more}


def window(mean, matches=(), **gates):
    return {**{g: 1.0 for g in GATES}, "coverage_mean": mean, "function_matches": list(matches), **gates}


def lines(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in records], "value string")


def read(spark, *records, **kw):
    parsed = parse_records(lines(spark, *records), "value", [], **kw)
    units = unit_records(parsed, [])
    return units, unit_windows(units, KEYS), source_calls(parsed, [])


def test_mappings_defaults_and_repeats(spark):
    one = unit(0, [window(0.9, [{"target_function_index": 1, "source_function_index": 7}, {"target_function_index": 1, "source_function_index": 8}])])
    two = unit(1, [window(0.8, [0, 5, 2, 6], function_coverage=None), window(0.7)])
    bare = unit(2, [], coverage_mean=0.5, function_matches=[3, 9])
    units, windows, calls = read(spark, one, one, two, bare, {"type": "source_call_targets", "binary_path": "/b", "calls": [[5, [6, 7]], [8, []]]}, {"type": "other"})
    got = {(r.target_cu_index, r.window_no): r for r in windows.collect()}
    assert got[0, 0].mapping == {1: 8} and got[1, 0].mapping == {0: 5, 2: 6} and got[1, 1].mapping == {} and got[2, 0].mapping == {3: 9}
    assert got[1, 0].function_coverage == 0.5 and got[2, 0].coverage_mean == 0.5 and got[2, 0].coverage_ratio == 0.0 and len(got) == 4
    assert {r.target_cu_index: r.n_windows for r in units.collect()} == {0: 1, 1: 2, 2: 0}
    assert {(r.caller, r.callee) for r in calls.collect()} == {(5, 6), (5, 7)}


def test_bad_texts_odd_mappings_and_conflicts_are_errors(spark):
    assert read(spark, None, unit(0, []))[0].count() == 1
    for bad in ("{cut", ""):
        with pytest.raises(Exception, match="invalid JSON feature"):
            read(spark, bad)[0].collect()
        assert read(spark, bad, unit(0, []), strict=False)[0].count() == 1
    with pytest.raises(Exception, match="odd flattened"):
        read(spark, unit(0, [window(0.9, [1])]))[1].collect()
    with pytest.raises(Exception, match="conflicting records"):
        read(spark, unit(0, [window(0.9)]), unit(0, [window(0.8)]))[0].collect()


def test_shapes_leave_out_what_they_do_not_hold(spark):
    df = spark.createDataFrame([("PASS", 0.5), ("DROP", 0.4), ("DROP_RODATA", 0.3)], "cu_status string, best_score double").withColumns({"windows": F.array(F.struct(F.lit(0.5).alias("coverage_mean"))), "rodata_bytes": F.lit(9), "coverage_mean": F.lit(0.5)})
    for replay, shapes in ((False, ["full", "compact", "compact"]), (True, ["replay"] * 3)):
        got = [json.loads(r.value) for r in record_json(df.withColumn("record_detail", record_detail(F.col("cu_status"), replay))).collect()]
        assert [g["record_detail"] for g in got] == shapes and [g["schema_version"] for g in got] == [3 if replay else 2] * 3
        assert [g.get("rejection_reason") for g in got] == ([None] * 3 if replay else [None, "block_gates", "rodata_penalty"])
        assert all(("windows" in g) == (g["record_detail"] != "compact") for g in got) and all(("best_score" in g) == (g["record_detail"] != "full") for g in got)


def replayed(spark, records, **settings):
    units, windows, calls = read(spark, *records)
    c = with_defaults(spark.range(1).select(F.lit("c").alias("config")), **({"min_coverage_mean": 0.5} | settings))
    per = replay_units(windows, units, c, KEYS)
    return {r.target_cu_index: r for r in per.collect()}, replay_libraries(per, calls, c, ["binary_path"], KEYS).collect()[0]


RODATA = dict(rodata_has_rodata=True, rodata_bytes=600, rodata_strings=0, rodata_ngrams=0, rodata_string_informative=True, rodata_byte_informative=True)


def test_penalty_bonus_and_top_three(spark):
    records = [unit(0, [window(0.8)], rodata_string_score=1.0, rodata_byte_score=1.0, **RODATA), unit(1, [window(0.9)], rodata_string_score=0.1, rodata_byte_score=0.1, **RODATA), unit(2, [window(0.4)])]
    per, lib = replayed(spark, records)
    assert abs(per[0].score - (0.8 + 0.3 * 0.2)) < 1e-9 and per[1].penalised and not per[2].passed
    assert lib.accepted == 1 and lib.penalised == 1 and abs(lib.library_score - 0.86 / 2) < 1e-9
    off, lib = replayed(spark, records, rodata_on=False)
    assert not off[1].penalised and lib.accepted == 2 and abs(lib.library_score - 0.85) < 1e-9


def test_cross_unit_calls_move_the_score(spark):
    calls = {"type": "source_call_targets", "binary_path": "/b", "calls": [[10, [20]]]}
    edge = lambda f: [{"caller_function_index": 0, "callee_cu_index": 1, "callee_function_index": f}]
    two = unit(1, [window(0.8, [0, 20, 1, 21])])
    for f, expected, evaluable, matched in ((0, 1, 1, 1), (1, 1, 1, 0), (2, 1, 0, 0)):
        _, lib = replayed(spark, [unit(0, [window(0.8, [0, 10])], inter_cu_calls=edge(f)), two, calls], cross_saturation=1, cross_penalty=0.1)
        assert (lib.edges_expected, lib.edges_evaluable, lib.edges_matched) == (expected, evaluable, matched)
        assert abs(lib.adjusted - {0: 0.8 + 0.2 * 0.2, 1: 0.8 - 0.1 * 0.8, 2: 0.8}[f]) < 1e-9
    _, lib = replayed(spark, [unit(0, [window(0.8, [0, 10])], inter_cu_calls=edge(0)), unit(1, [window(0.1)]), calls])
    assert lib.edges_expected == 0 and lib.adjusted == lib.library_score


def test_library_threshold_and_empty_logs(spark):
    assert replayed(spark, [unit(0, [window(0.8)])], library_min_score=0.9)[1].predicted is False
    units, windows, calls = read(spark)
    c = with_defaults(factorial(spark, {g: 0.5 for g in GATES}))
    assert replay_libraries(replay_units(windows, units, c, KEYS), calls, c, ["binary_path"], KEYS).collect() == []


def test_every_cause(spark):
    gates = {g: 0.5 for g in GATES}
    named = lambda lib, **kw: unit(0, kw.pop("windows", [window(0.9)]), library=lib, **kw)
    records = [
        named("small", target_function_count=1), named("none", windows=[]), named("first", windows=[window(0.1)]), named("fifth", windows=[window(0.9, call_edge_ratio=0.1), window(0.9, coverage_ratio=0.0)]),
        named("data", rodata_string_score=0.1, rodata_byte_score=0.1, **RODATA), named("fine"),
    ]
    units, windows, _ = read(spark, *records)
    ask = spark.createDataFrame([("/b", x) for x in ("small", "none", "first", "fifth", "data", "fine", "gone", "alias")], "binary_path string, library string")
    got = {r.library: (r.category, r.depth) for r in causes(ask, windows, units, ask.filter("library = 'alias'"), KEYS, gates).collect()}
    assert got == {"small": ("candidate_below_two_functions", 8), "none": ("record_present_no_windows", 0), "first": ("failed_coverage_mean", 0), "fifth": ("failed_call_edge_ratio", 4), "data": ("failed_rodata", 8), "fine": ("unexpected_record_pass", 8), "gone": ("record_absent", 0), "alias": ("record_absent_alias_available", 0)}
    assert windows.agg(F.max(gate_depth(gates))).first()[0] == 8 and DEFAULTS["cross_bonus"] == 0.2


def test_searches(spark, tmp_path):
    grid = {"x": [0.0, 1.0, 2.0, 3.0], "y": [0.0, 1.0, 2.0]}
    target = lambda p: -abs(p["x"] - 2) - abs(p["y"] - 1)
    calls = []

    def score(configs):
        calls.append(configs.count())
        return configs.select("config", (-F.abs(F.col("x") - 2) - F.abs(F.col("y") - 1)).alias("s"))

    best, history = greedy_on_spark(spark, {"x": 0.0, "y": 0.0}, grid, score, restarts=2)
    assert best == {"x": 2.0, "y": 1.0} and len(history) >= 14 and sum(calls) <= 12
    found, top = parzen_search(grid, lambda ps: [target(p) for p in ps], 40, startup=10, seed=3)
    assert found == best and top == 0 and parzen_search(grid, lambda ps: [target(p) for p in ps], 40, startup=10, seed=3) == (found, top)
    path = f"file://{tmp_path}/trials"
    assert trial_table(spark, path, "a").count() == 0
    keep_trials(spark, path, "a", [(0, best, 0.5)])
    keep_trials(spark, path, "b", [(0, best, 0.1)])
    assert [(r.trial, r.score, json.loads(r.params)) for r in trial_table(spark, path, "a").collect()] == [(0, 0.5, best)]


def test_a_study_goes_on_where_it_stopped(spark, tmp_path):
    grid, path, asked = {"x": [0.0, 1.0, 2.0]}, f"file://{tmp_path}/study", []

    def folds(ps):
        asked.extend(ps)
        return [[-abs(p["x"] - 1), -abs(p["x"] - 1) - 1] for p in ps]

    first = tuned(spark, path, "s", grid, folds, lambda p: p["x"], 6, batch=3, startup=3)
    again = tuned(spark, path, "s", grid, folds, lambda p: p["x"], 10, batch=2, startup=3)
    assert first == again == ({"x": 1.0}, -0.5, 1.0) and len(asked) == 10
    assert [r.trial for r in trial_table(spark, path, "s").orderBy("trial").collect()] == list(range(10))


def test_windows_see_ahead_and_keep_their_own(spark):
    from lodestone.operators.inference import encode_sequences, windows

    assert windows(0, 5, 2) == [] and windows(11, 5, 2) == [(0, 5, 7), (5, 10, 11), (10, 11, 11)]
    df = spark.createDataFrame([(1, ["a", None, "ccc", "d", "e"]), (2, []), (3, None)], "k int, s array<string>")
    load = lambda: lambda texts: [[len(t), i, len(texts)] for i, t in enumerate(texts)]
    got = {(r.k, r.position): r.vector for r in encode_sequences(df, ["k"], "s", load, 2, 1).collect()}
    assert got == {(1, 0): [1, 0, 3], (1, 1): [0, 1, 3], (1, 2): [3, 0, 3], (1, 3): [1, 1, 3], (1, 4): [1, 0, 1]}
