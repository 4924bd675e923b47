import json
import random

import numpy as np

from lodestone.functions.flooding import SchemaGraph, correspondences, flood
from lodestone.functions import flooding
from lodestone.operators.schema_drift import all_changes, field_changes, file_schemas, read_shape, rejected, target_matcher, unified, with_object
from lodestone.queries.problems import CASTS, MARKERS

SCHEMA = "file_id bigint, campaign_id bigint, file_seq int, line_no int, payload string, leaves string, shape int"


def lines(spark, files):
    rows = [(f, c, q, i, p, "clash", 1) for f, c, q, ps in files for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, SCHEMA)


FILES = [
    (1, 1, 1, ['{"schema_version": 1, "norm": "v2"}', '{"schema_version": null}', '{"schema_version": 2, "cut']),
    (2, 1, 4, ['{"meta": {"Schema_Rev": "v2"}, "norm": "v2", "pool": [1]}', '{"meta": {"Schema_Rev": "v2"}, "norm": "v2", "pool": [1]}']),
    (3, 1, 6, ["", None, "[1]", "3", '{"a": 1} x', '{"schema": 1}{"schema": 1}']),
    (4, 1, 9, ['{"norm": true, "b`t": {"it\'s": 1}}']),
    (5, 2, 1, ['{"norm": 1}']),
]


def test_whole_objects(spark):
    df = lines(spark, FILES)
    assert with_object(df, "payload").filter("__object is not null").count() == 6


def test_field_changes_against_the_definition(spark):
    got = {(r.file_id, r.field_name, r.change_kind) for r in field_changes(file_schemas(lines(spark, FILES)), MARKERS).collect()}
    s, n, p = MARKERS
    assert got == {(2, s, "renamed"), (2, s, "retyped"), (2, p, "added"), (3, s, "removed"), (3, n, "removed"), (3, p, "removed"), (4, n, "added")}


def test_unified_types_and_repeats(spark):
    df = lines(spark, FILES)
    rows = unified(df, file_schemas(df), MARKERS, CASTS).collect()
    got = {(r.file_id, r.line_no): (r.feature_schema_version, r.asm_normalization, r.palmtree_pooling) for r in rows}
    assert got[(1, 0)] == (1, "v2", None) and got[(2, 0)] == (2, "v2", "[1]") and got[(4, 0)] == (None, "true", None) and got[(1, 1)] == (None, None, None)


def test_empty_table(spark):
    df = lines(spark, [])
    files = file_schemas(df)
    assert field_changes(files, MARKERS).collect() == [] and all_changes(files).collect() == [] and unified(df, files, MARKERS, CASTS).collect() == []


def test_shapes():
    assert read_shape("OBJECT<a: OBJECT<`b.c`: VOID, d: ARRAY<OBJECT<x: STRING>>>, e: OBJECT<>, `k``l`: DECIMAL(2,1)>") == [(("a", "d"), "array"), (("k`l",), "number")]


def test_flooding_finds_moved_and_renamed_keys():
    a = SchemaGraph([(("library",), "string"), (("best_score",), "number"), (("asm_normalization",), "string")])
    b = SchemaGraph([(("library",), "string"), (("scores", "best"), "number"), (("analysis", "norm_mode"), "string")])
    pairs = {(p, q) for p, q, _ in correspondences(a, b, flood(a, b))}
    assert (("library",), ("library",)) in pairs and (("best_score",), ("scores", "best")) in pairs and (("asm_normalization",), ("analysis", "norm_mode")) in pairs


def test_all_changes_reports_renaming(spark):
    old, new = {"library": "x", "best_score": 0.5, "windows_total": 1}, {"library": "x", "scores": {"best": 0.5}, "windows_total": "1"}
    df = lines(spark, [(1, 1, 1, [json.dumps(old)]), (2, 1, 2, [json.dumps(new)])])
    got = {(r.change_kind, r.old_path, r.new_path) for r in all_changes(file_schemas(df)).collect()}
    assert got == {("renamed", "best_score", "scores.best"), ("retyped", "windows_total", "windows_total")}


WORDS = ["schema", "norm", "pool", "lib", "name", "version", "meta", "cfg", "best_score", "normPoolSchema", "palmtree_pooling", "POOLED", "renormed"]


def carried(leaves):
    return {(f, p) for p, _ in leaves for f, (mark, _) in MARKERS.items() if mark in "/".join(p).lower()}


def random_leaves(rng):
    path = lambda: tuple("".join(rng.sample(WORDS, rng.randint(1, 2))) for _ in range(rng.randint(1, 4)))
    return sorted({(path(), rng.choice(["string", "number", "array"])) for _ in range(rng.randint(0, 20))})


def test_flooding_selects_every_path_with_a_fields_letters():
    rng, match = random.Random(5), target_matcher(MARKERS)
    for _ in range(300):
        leaves = random_leaves(rng)
        assert {(f, p) for f, p, _ in match(leaves)} == carried(leaves)


def test_without_flooding_nothing_is_selected(monkeypatch):
    monkeypatch.setattr(flooding, "flood", lambda a, b, seed=None: np.ones((len(a.paths), len(b.paths))))
    assert target_matcher(MARKERS)([(("schema",), "number"), (("norm",), "string")]) == []


def test_rejected_lines_and_quoted_keys(spark):
    df = lines(spark, [(1, 1, 1, ['{"norm": 1}', '{"norm": 1', "", None, "[1]", '{"a": 1, "a": 2}', '{"it\'s norm": "q"}'])])
    assert {(r.line_no, r.reason) for r in rejected(df).collect()} == {(1, "broken"), (2, "empty"), (3, "null"), (4, "no_object"), (5, "broken")}
    got = {r.line_no: r.asm_normalization for r in unified(df, file_schemas(df), MARKERS, CASTS).collect()}
    assert got == {0: "1", 6: "q"}
