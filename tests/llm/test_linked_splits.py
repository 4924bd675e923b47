import random

from lodestone.llm.linked_splits import Components, assign, connect, leads

SCHEMA = "id bigint, a string, b string, st string, root string, key string"
TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a, b, *_ in rows:
        find(("id", i))
        for k in (("a", a), ("b", b)):
            if k[1] is not None:
                parent[find(k)] = find(("id", i))
    out = {}
    for i, *_ in rows:
        out.setdefault(find(("id", i)), set()).add(i)
    return sorted(map(frozenset, out.values()), key=min)


def make(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < 0.1 else rng.choice(["hot"] * 1 + [f"p{rng.randrange(150)}"] * 3), None if rng.random() < 0.2 else f"s{rng.randrange(600)}", rng.choice(["x", "y", None]), "z", "z") for i in range(n)]
    return rows + rows[:9]


def grouped(state):
    by = {}
    for r in state.members.collect():
        by.setdefault(r.root, set()).add(r.id)
    return sorted(map(frozenset, by.values()), key=min)


def test_connect_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 3000) for i in range(50)] + [(7, 7)]
    random.Random(3).shuffle(chain)
    got = {r.node: r.root for r in connect(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 50)) and got[3000] == 2000 and got[2049] == 2000
    assert connect(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_one_batch(spark):
    rows = make()
    state = assign(spark.createDataFrame(rows + [(None, "hot", None, "x", "z", "z")], SCHEMA), "id", ["a", "b"], "st", spark.createDataFrame(TARGETS, "split_name string, target_share double"))
    assert grouped(state) == components(rows)
    splits = {}
    for r in state.members.collect():
        assert splits.setdefault(r.root, r.split_name) == r.split_name and r.status == "new"
    want = {(min(c), i) for c in components(rows) for i in c if i != min(c)}
    assert {tuple(r) for r in leads(state).collect()} == want


def test_shares_are_met_alike_over_strata(spark):
    rng = random.Random(8)
    rows = [(i, f"p{rng.randrange(900)}", None, rng.choice("xyz"), "z", "z") for i in range(3000)]
    state = assign(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"], "st", spark.createDataFrame(TARGETS, "split_name string, target_share double"))
    pdf = state.members.toPandas()
    for part in (pdf, *(g for _, g in pdf.groupby("stratum"))):
        share = part.split_name.value_counts(normalize=True)
        assert all(abs(share[s] - t) < 0.01 for s, t in TARGETS)


def test_batches_keep_splits_merge_and_quarantine(spark):
    t = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    first = [(10 + i, f"p{i}", f"s{i}", "x", "z", "z") for i in range(40)]
    one = assign(spark.createDataFrame(first, SCHEMA), "id", ["a", "b"], "st", t)
    was = {r.id: r.split_name for r in one.members.collect()}
    train = [i for i, s in was.items() if s == "train"]
    other = [i for i, s in was.items() if s != "train"]
    assert train and other
    a, b, c = train[0], train[1], other[0]
    second = [
        (100, f"p{a - 10}", f"s{b - 10}", "x", "z", "z"),  # merges two of one split
        (101, f"p{train[2] - 10}", f"s{c - 10}", "x", "z", "z"),  # would merge two splits
        (1, f"p{train[3] - 10}", None, "x", "z", "z"),  # joins one, with a smaller id
        (102, "new", None, "x", "z", "z"), (103, None, None, "x", "z", "z"), (10, "p0", "s0", "x", "z", "z"),
    ]
    two = assign(spark.createDataFrame(second, SCHEMA), "id", ["a", "b"], "st", t, one)
    now = {r.id: r for r in two.members.collect()}
    assert all(now[i].split_name == s for i, s in was.items()) and len(now) == 45
    assert now[100].split_name == "train" and now[100].status == "kept" and now[a].root == now[b].root == now[100].root
    assert now[101].split_name is None and now[101].status == "quarantined"
    assert now[1].split_name == "train" and now[102].status == "new" and now[103].status == "new"
    assert grouped(two) == components(first + second)
    assert {r.lead_build_id for r in leads(two).collect() if r.build_id == train[3]} == {1}


def test_only_bridging_rows_are_quarantined_and_parts_keep_their_splits(spark):
    t = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    first = [(10 + i, f"p{i}", f"s{i}", "x", "z", "z") for i in range(40)]
    one = assign(spark.createDataFrame(first, SCHEMA), "id", ["a", "b"], "st", t)
    was = {r.id: r.split_name for r in one.members.collect()}
    train, other = [i - 10 for i, s in was.items() if s == "train"], [i - 10 for i, s in was.items() if s != "train"]
    a, b, c, d = train[0], train[1], other[0], other[1]
    second = [
        (100, f"p{a}", f"s{c}", "x", "z", "z"), (101, f"p{a}", "n1", "x", "z", "z"), (102, "n2", f"s{c}", "x", "z", "z"),  # a bridge and rows beside it
        (103, f"p{b}", "n3", "x", "z", "z"), (104, f"p{d}", "n3", "x", "z", "z"), (105, "n4", "n3", "x", "z", "z"),  # two rows bridge by a new key
    ]
    two = assign(spark.createDataFrame(second, SCHEMA), "id", ["a", "b"], "st", t, one)
    now = {r.id: r for r in two.members.collect()}
    assert now[100].status == "quarantined" and now[100].split_name is None
    assert now[101].split_name == "train" and now[102].split_name == was[10 + c] and now[101].status == now[102].status == "kept"
    assert sorted(now[i].status for i in (103, 104)) == ["kept", "quarantined"] and now[105].split_name is not None
    third = [(200, f"p{a}", None, "x", "z", "z"), (201, None, f"s{c}", "x", "z", "z"), (202, "n2", None, "x", "z", "z"), (203, f"p{d}", None, "x", "z", "z"), (204, "n5", "n1", "x", "z", "z")]
    three = assign(spark.createDataFrame(third, SCHEMA), "id", ["a", "b"], "st", t, two)
    end = {r.id: r for r in three.members.collect()}
    want = {200: "train", 201: was[10 + c], 202: was[10 + c], 203: was[10 + d], 204: "train"}
    assert {i: end[i].split_name for i in want} == want and all(end[i].status == "kept" for i in want)
    assert all(end[i].split_name == s for i, s in was.items()) and len(end) == 51
    assert sum(r.status == "quarantined" for r in end.values()) == 2 and grouped(three) == components(first + second + third)


def test_many_batches_by_path_equal_union_find(spark, tmp_path):
    """Random rows in four batches, of which each is loaded from what the ones before left."""
    rows, path = make(160, 9), f"file://{tmp_path}/many"
    t = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    was = {}
    for n in range(4):
        assign(spark.createDataFrame(rows[n * 42 : (n + 1) * 42], SCHEMA), "id", ["a", "b"], "st", t, Components.load(spark, path)).save(path, n)
        state = Components.load(spark, path)
        now = {r.id: r for r in state.members.collect()}
        assert grouped(state) == components(rows[: (n + 1) * 42]) and all(now[i].split_name == s for i, s in was.items())
        assert all((r.split_name is None) == (r.status == "quarantined") for r in now.values())
        was = {i: r.split_name for i, r in now.items()}


def test_empty_table(spark):
    t = spark.createDataFrame(TARGETS, "split_name string, target_share double")
    state = assign(spark.createDataFrame([], SCHEMA), "id", ["a", "b"], "st", t)
    assert state.members.collect() == [] and leads(state).collect() == []
    again = assign(spark.createDataFrame([(1, None, None, None, "z", "z")], SCHEMA), "id", ["a", "b"], "st", t, state)
    assert [(r.id, r.split_name) for r in again.members.collect()] == [(1, "train")]


def test_state_by_path_and_the_splits_it_keeps(spark, tmp_path):
    """Two old components, a row that bridges them, and rows of a third batch; ids are texts."""
    schema, path = SCHEMA.replace("id bigint", "id string"), f"file://{tmp_path}/state"
    t = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    make_rows = lambda *xs: spark.createDataFrame([(i, a, b, "x", "z", "z") for i, a, b in xs], schema)
    assert Components.load(spark, path) is None
    assign(make_rows(*((f"a{i}", "A", f"s{i}") for i in range(5)), *((f"b{i}", "B", f"t{i}") for i in range(5))), "id", ["a", "b"], "st", t).save(path, 1)
    first = {r.id: r.split_name for r in Components.load(spark, path).members.collect()}
    assert len({first["a0"], first["b0"]}) == 2
    assign(make_rows(("c1", "A", "u1"), ("c2", "A", "t0")), "id", ["a", "b"], "st", t, Components.load(spark, path)).save(path, 2)
    spark.range(1).write.parquet(f"{path}/v=3/keys")  # a version that was never committed
    assign(make_rows(("d1", "A", None), ("d2", "B", None)), "id", ["a", "b"], "st", t, Components.load(spark, path)).save(path, 4)
    end = {r.id: r for r in Components.load(spark, path).members.collect()}
    assert {i: r.split_name for i, r in end.items() if i in first} == first
    assert end["c1"].split_name == end["d1"].split_name == first["a0"] and end["d2"].split_name == first["b0"]
    assert [i for i, r in end.items() if r.status == "quarantined"] == ["c2"] and end["c2"].split_name is None
    # a whole version may follow, and what comes after it builds on that
    state = Components.load(spark, path)
    state.save(path, 5, whole=True)
    assign(make_rows(("e1", "C", None), ("e2", "A", "B9")), "id", ["a", "b"], "st", t, Components.load(spark, path)).save(path, 6)
    last = {r.id: r for r in Components.load(spark, path).members.collect()}
    assert {i: (r.part, r.root, r.split_name) for i, r in last.items() if i in end} == {i: (r.part, r.root, r.split_name) for i, r in end.items()} and last["e2"].split_name == first["a0"]
    parts = {}
    for r in last.values():
        if r.split_name:
            assert parts.setdefault(r.part, r.split_name) == r.split_name
