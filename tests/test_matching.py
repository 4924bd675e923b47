import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions.assignment import assign_max, assignment_scores
from lodestone.functions.source_tokens import source_tokens
from lodestone.operators.decide import library_score
from lodestone.operators.similarity import GATES, MatchParams, block_best, classes, dense_edges, full_match, indexed_blocks, match_pair, match_windows, packs, rolling_max, window_size


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10_000))
def test_assignment_is_optimal(m, n, seed):
    m, n = min(m, n), max(m, n)
    g = np.round(np.random.default_rng(seed).normal(size=(m, n)), 1)
    cols = assign_max(g)
    assert len(set(cols.tolist())) == m
    assert np.isclose(g[np.arange(m), cols].sum(), max(sum(g[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(n), m)))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 1000))
def test_assignment_takes_hits_before_similarity(m, n, seed):
    sim = np.random.default_rng(seed).uniform(-1, 1, (m, n))
    _, ratio = assignment_scores(sim, 0.3)
    small, tall = (sim, False) if m <= n else (sim.T, True)
    hits = max(sum(small[i, c] >= 0.3 for i, c in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert np.isclose(ratio, hits / m)


def test_empty_side_scores_zero():
    assert assignment_scores(np.zeros((0, 3)), 0.5) == (0.0, 0.0)
    assert match_pair((1, np.array([], int), []), (1, np.array([0]), [1.0]), MatchParams()) == []


def test_prefilter_window_of_the_fixture():
    # two unit functions, five binary functions of one block each, multiplier 1, padding 0
    assert window_size(5, 2, 1.0, 0) == 2
    best = np.array([[0.1, 0.2, 0.3, 0.4, 0.5], [0.2, 0.3, 0.4, 0.5, 0.6]])
    roll = rolling_max(best, 2)
    assert roll.shape == (2, 4) and int(np.argmax(roll.mean(0))) == 3


def test_function_coverage_gate():
    v = np.eye(2).ravel()
    p = dict(block_threshold=0.9, coverage_mean=0.0, coverage_ratio=0.0, assignment_quality=0.0, assignment_ratio=0.0, call_edge_ratio=0.0, function_concentration=0.0, function_spread=0.0, multiplier=1, padding=0)
    windows = match_pair((2, np.array([0, 1]), v), (2, np.array([0, 1]), [1.0, 0, 1.0, 0]), MatchParams(function_coverage=0.6, **p))
    assert windows[0]["function_coverage"] == 0.5 and not windows[0]["passed"]
    assert match_pair((2, np.array([0, 1]), v), (2, np.array([0, 1]), [1.0, 0, 1.0, 0]), MatchParams(function_coverage=0.0, **p))[0]["passed"]


def test_library_score(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0.5, 1.0, 0.25, 0.75],), ([],), ([0.5],)], "s array<double>")
    for mode, want in (("mean", [0.625, 0.0, 0.5]), ("max", [1.0, 0.0, 0.5]), ("top3_mean", [0.75, 0.0, 0.5]), ("top3_noisy_or", [1.0, 0.0, 0.5])):
        assert [round(r[0], 9) for r in df.select(library_score(F.col("s"), mode)).collect()] == want
    with pytest.raises(ValueError):
        library_score(F.col("s"), "median")


def test_source_tokens_ignore_comments_and_layout():
    assert source_tokens('int  a = 1; // x\n/* "y" */ char *s = "/* no */";') == source_tokens('int a=1;\nchar*s="/* no */";')
    assert source_tokens('R"x(a//b)x" 1e+5 a->b') == ['R"x(a//b)x"', "1e+5", "a", "->", "b"]


def test_call_gate_alone_rejects_a_window(spark):
    """Equal units whose calls run the other way: only the call gate can tell."""
    rows = [("u", f, i, [1.0 if d == i else 0.0 for d in range(2)], 9) for i, f in enumerate((10, 20))]
    blocks = spark.createDataFrame(rows, "u string, f int, i int, v array<double>, n int")
    one = indexed_blocks(blocks, "u", "f", ["i"], "v", "n")
    calls = lambda a, b: dense_edges(blocks, spark.createDataFrame([("u", a, b), ("u", a, 99)], "u string, caller int, callee int"), "u", "f")
    p = MatchParams(function_coverage=0.05, coverage_mean=0.9)
    for elf, ratio, passed in ((calls(10, 20), 1.0, True), (calls(20, 10), 0.0, False), (None, 1.0, True)):
        w = match_windows(one, one, p, calls(10, 20), elf).collect()
        assert [(x.call_edge_ratio, x.passed, x.evaluated) for x in w] == [(ratio, passed, True)]


def random_blocks(spark, rng, units, functions, blocks):
    rows, at = [], 0
    for u in range(units):
        for f in range(rng.integers(1, functions + 1)):
            for _ in range(rng.integers(0, blocks + 1)):
                rows.append((u, int(f), at, [float(x) for x in rng.normal(size=8)], int(rng.integers(3, 9))))
                at += 1
            rows.append((u, int(f), at, None, 9))  # a block without a vector: the function counts
            at += 1
    return rows, spark.createDataFrame(rows, "u int, f int, i int, v array<double>, n int")


def test_tiles_give_the_windows_of_whole_binaries(spark):
    rng = np.random.default_rng(3)
    cu_rows, cu = random_blocks(spark, rng, 6, 5, 3)
    elf_rows, elf = random_blocks(spark, rng, 2, 60, 2)
    edges = lambda rows, step: [(u, f, (f * step) % 7) for u, f in {(r[0], r[1]) for r in rows}]
    cu_e, elf_e = edges(cu_rows, 2), edges(elf_rows, 3)
    p = MatchParams(block_threshold=0.5, coverage_mean=0.5, coverage_ratio=0.3, assignment_quality=0.1, assignment_ratio=0.1, function_concentration=0.1, function_spread=0.1, multiplier=1.5, padding=1)

    def whole(rows):
        out = {}
        for u in sorted({r[0] for r in rows}):
            fs = sorted({r[1] for r in rows if r[0] == u})
            kept = sorted((fs.index(r[1]), r[2], r[3]) for r in rows if r[0] == u and r[3] is not None and r[4] >= 5)
            out[u] = (len(fs), np.array([k[0] for k in kept], int), [np.float32(x) for k in kept for x in k[2]])
        return out

    inside = lambda es, u, n: {(a, b) for x, a, b in es if x == u and b < n}
    want = {}
    for a, one in whole(cu_rows).items():
        for b, two in whole(elf_rows).items():
            for w in match_pair(one, two, p, inside(cu_e, a, one[0]), inside(elf_e, b, two[0])):
                want[str(a), str(b), w["window_start"]] = w
    sides = [indexed_blocks(x, "u", "f", ["i"], "v", "n") for x in (cu, elf)]
    calls = [dense_edges(x, spark.createDataFrame(e, "u int, caller int, callee int"), "u", "f") for x, e in ((cu, cu_e), (elf, elf_e))]
    assert any(w["passed"] for w in want.values()) and any(not w["evaluated"] for w in want.values())
    for stride, blocks in ((1, 1 << 17), (7, 0), (1000, 1 << 17)):
        got = match_windows(*sides, p, *calls, stride=stride, broadcast_blocks=blocks).collect()
        assert len(got) == len(want) > 50
        for r in got:
            w = want[r.cu, r.elf, r.window_start]
            assert all(abs(r[k] - w[k]) < 1e-6 for k in ("coverage_min", *GATES)) and (r.passed, r.evaluated, r.window_stop, r.windows_total) == (w["passed"], w["evaluated"], w["window_stop"], w["windows_total"])
    m = full_match(*sides, p, *calls, stride=5).collect()
    assert {(r.cu, r.elf) for r in m} == {(a, b) for a, b, _ in want} and len(m) == len({(a, b) for a, b, _ in want})
    assert packs(sides[0], classes(sides[0], pack_blocks=4)).agg({"pack": "max"}).first()[0] > 0


def test_empty_sides(spark):
    none = indexed_blocks(spark.createDataFrame([], "u int, f int, i int, v array<double>, n int"), "u", "f", ["i"], "v", "n")
    one = indexed_blocks(spark.createDataFrame([(1, 1, 1, [1.0, 0.0], 9)], "u int, f int, i int, v array<double>, n int"), "u", "f", ["i"], "v", "n")
    for a, b in ((none, one), (one, none), (none, none)):
        assert match_windows(a, b, MatchParams()).collect() == [] and block_best(a, b).collect() == [] and full_match(a, b, MatchParams()).collect() == []
