import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm.knn import hilbert_key, nearest
from lodestone.llm.split_overlap import linked, overlaps

SCHEMA = "record_id bigint, split_name string, source_project string, programs array<string>, hashes array<string>, elem string, n int"


def records(seed=4, n=160):
    rng = random.Random(seed)
    sha = lambda i: f"{i:064x}"
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and base:
            hs, ps = map(list, rng.choice(base))
            if hs and rng.random() < 0.6:
                hs[rng.randrange(len(hs))] = sha(rng.randrange(10**6))
        elif kind < 0.6:
            hs, ps = [sha(k) for k in range(6)], ["id-kit", "ls-kit", "env_kit", "cat kit"]  # the hot class
        else:
            hs, ps = [sha(rng.randrange(40)) for _ in range(rng.randrange(8))], [f"p-{rng.randrange(12)}" for _ in range(rng.randrange(8))]
        base.append((hs, ps))
        dirty = [rng.choice([h.upper(), "sha256:" + h, h]) for h in hs] + [None, "zz"] * (rng.random() < 0.2)
        names = [rng.choice([p.upper(), f" {p} ", p.replace("-", "_"), p.replace("-", " ")]) for p in ps] + [None] * (rng.random() < 0.2)
        rows.append((i, rng.choice(["train", "train", "validation", "test", None]), rng.choice(["a", None]), None if rng.random() < 0.05 else names, None if rng.random() < 0.05 else dirty, "x", 1))
    return rows + rows[:10]


def brute(rows):
    sets = {}
    for i, split, _, ps, hs, *_ in rows:
        h = {m[0].lower() for x in hs or [] if x and (m := re.search("[0-9A-Fa-f]{64}", x))}
        p = {re.sub("[-_ ]", "-", x.strip().lower()) for x in ps or [] if x}
        sets[i] = (split, h, p)
    out = set()
    for i, (si, hi, pi) in sets.items():
        for j, (sj, hj, pj) in sets.items():
            if si in ("validation", "test") and sj == "train":
                if hi and hj and 5 * len(hi & hj) >= 4 * len(hi | hj):
                    out.add((i, j, "hashes"))
                if min(len(pi), len(pj)) >= 4 and 5 * len(pi & pj) >= 4 * len(pi | pj):
                    out.add((i, j, "programs"))
    return out


def test_overlaps_equal_brute_force(spark):
    for seed in (4, 5):
        rows = records(seed)
        got = overlaps(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {(r.eval_id, r.train_id, r.basis) for r in got} == brute(rows) and len(got) == len(brute(rows)) > 20
        assert all(0.8 - 1e-9 <= r.jaccard <= r.containment <= 1 for r in got)


def test_one_row_a_record_with_its_class_and_links(spark):
    rows = records(6)
    want = {}
    for e, t, basis in brute(rows):
        for i in (e, t):
            want[i, basis] = want.get((i, basis), 0) + 1
    got = linked(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.record_id, r.basis): r.n_links for r in got} == want and len(got) == len(want)
    assert all(r.class_id <= r.record_id for r in got)
    assert linked(spark.createDataFrame([], SCHEMA)).collect() == []


def test_overlaps_of_empty_and_one_sided_tables(spark):
    assert overlaps(spark.createDataFrame([], SCHEMA)).collect() == []
    assert overlaps(spark.createDataFrame([(1, "train", "a", ["x"] * 9, ["0" * 64], "x", 1), (None, "test", "a", None, ["0" * 64], "x", 1)], SCHEMA)).collect() == []


def test_hilbert_curve_steps_to_a_neighbour_each_time():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = hilbert_key(cells, bits)
        path = cells[np.argsort(key)]
        assert sorted(key.tolist()) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


V = "id bigint, v array<float>, near string, vec string"


def test_nearest_finds_close_vectors_and_bears_bad_ones(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 64))
    close = base[:100] + rng.normal(size=(100, 64)) * 0.05
    rows = [(i, [float(x) for x in v], "x", "x") for i, v in enumerate(np.r_[base, close])]
    rows += rows[:20]  # repeated rows
    rows += [(9001, None, "x", "x"), (9002, [], "x", "x"), (9003, [0.0] * 64, "x", "x"), (9004, [float("nan")] * 64, "x", "x"), (9005, [1.0] * 63, "x", "x"), (9006, [None] + [1.0] * 63, "x", "x"), (None, [1.0] * 64, "x", "x"), (9007, [float("inf")] * 64, "x", "x"), (9008, [3e38] * 64, "x", "x")]
    df = spark.createDataFrame(rows, V).repartition(3)
    got = nearest(df, "id", "v", min_similarity=0.9).collect()
    pairs = {(min(r.id, r.neighbour_id), max(r.id, r.neighbour_id)) for r in got}
    assert pairs == {(i, 400 + i) for i in range(100)} and all(r.id != r.neighbour_id for r in got)
    everything = nearest(df, "id", "v", k=3, window=600).toPandas()
    unit = np.array([r[1] for r in rows[:500]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    want = {(i, int(j)) for i in range(500) for j in np.argsort(-sim[i])[:3]}
    have = {(int(a), int(b)) for a, b in zip(everything.id, everything.neighbour_id) if a < 500}
    assert len(have & want) >= 0.98 * len(want)  # id 9008 is a neighbour of some


def test_ties_go_to_smaller_ids_and_hot_vectors_cost_no_more(spark):
    rows = [(i, [1.0, 2.0] * 32, "x", "x") for i in range(3000)] + [(5000, [1.0, 2.01] * 32, "x", "x")]
    got = nearest(spark.createDataFrame(rows, V), "id", "v", k=5, window=16).toPandas()
    assert (got.groupby("id").size() == 5).all() and got.groupby("id").neighbour_id.nunique().eq(5).all() and got.id.nunique() == 3001
    small = nearest(spark.createDataFrame(rows[:8], V), "id", "v", k=3).toPandas()
    assert sorted(small[small.id == 7].neighbour_id) == [0, 1, 2]


def top(rows, k):
    """The k nearest of each row by brute force, ties to smaller ids."""
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(v @ v.T, 6)
    np.fill_diagonal(sim, -2)
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -sim[i]))[:k]}


def test_exact_search_finds_the_nearest_of_far_vectors(spark):
    v = np.random.default_rng(2).normal(size=(3000, 64))
    rows = [(i, [float(x) for x in r], "x", "x") for i, r in enumerate(v)]
    got = nearest(spark.createDataFrame(rows, V), "id", "v", exact=True).toPandas()
    have = set(zip(got.id, got.neighbour_id))
    assert len(have & top(rows, 5)) >= 0.999 * 5 * len(rows) and (got.groupby("id")["rank"].max() == 5).all()


def test_copies_get_the_smallest_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)], "x", "x") for i in range(300)]
    rows += [(1000 + i, rows[7][1], "x", "x") for i in range(2000)] + [(5000, [x * 1.001 + 0.001 for x in rows[7][1]], "x", "x")]
    want = {(7, 1000 + i) for i in range(5)} | {(i, j) for i in range(1000, 3000) for j in [x for x in (7, *range(1000, 1006)) if x != i][:5]} | {(5000, j) for j in (7, *range(1000, 1004))}
    for exact in (False, True):
        got = nearest(spark.createDataFrame(rows, V).repartition(3), "id", "v", window=16, min_similarity=0.9, exact=exact).toPandas()
        assert set(zip(got.id, got.neighbour_id)) == want and len(got) == len(want)


def test_dense_groups_wider_than_the_window(spark):
    rng = np.random.default_rng(4)
    far, centre = rng.normal(size=(1500, 64)), rng.normal(size=64)
    near = centre + rng.normal(size=(1500, 64)) * 0.2
    rows = [(i, [float(x) for x in r], "x", "x") for i, r in enumerate(np.r_[far, near])]
    got = nearest(spark.createDataFrame(rows, V), "id", "v", window=32, min_similarity=0.9).toPandas()
    want = {x for x in top(rows, 5) if x[0] >= 1500}
    assert len(set(zip(got.id, got.neighbour_id)) & want) >= 0.98 * len(want)


def test_query_sets_and_text_ids(spark):
    v = np.random.default_rng(6).normal(size=(600, 64))
    rows = [(i, [float(x) for x in r], "x", "x") for i, r in enumerate(v)] + [(600 + i, [float(x) for x in v[i]], "x", "x") for i in range(40)]
    df = spark.createDataFrame(rows, V)
    want = {p for p in top(rows, 5) if p[0] % 20 == 0}
    got = nearest(df, "id", "v", exact=True, queries="id % 20 = 0").collect()
    assert {(r.id, r.neighbour_id) for r in got} == want
    texts = df.withColumn("id", F.format_string("n%04d", "id"))
    got = nearest(texts, "id", "v", exact=True, queries="cast(substring(id, 2) as int) % 20 = 0").collect()
    assert {(int(r.id[1:]), int(r.neighbour_id[1:])) for r in got} == want
    near = nearest(df, "id", "v", min_similarity=0.9, queries="id < 20", part_rows=100).collect()
    assert {(r.id, r.neighbour_id) for r in near} == {(i, 600 + i) for i in range(20)}


def test_no_vectors(spark):
    assert nearest(spark.createDataFrame([], V), "id", "v").collect() == []
