import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.mixing import mix, mix_plan, shares
from lodestone.llm.packing import OpenBins, pack
from lodestone.llm.tokens import encoding, token_counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(1, 5))
def test_bins_hold_everything_once_and_never_overflow(sizes, most):
    bins, done = OpenBins(20, most), []
    for i, s in enumerate(sizes):
        done += list(bins.add(s, (i, s)))
        assert bins.count <= most
    done += list(bins.close())
    assert sorted(i for rows, _ in done for i, _ in rows) == list(range(len(sizes)))
    assert all(sum(s for _, s in rows) + free == 20 for rows, free in done)


def test_best_fit_and_fullest_closes_first():
    bins = OpenBins(10, 2)
    assert list(bins.add(6, "a")) == [] and list(bins.add(5, "b")) == []
    assert list(bins.add(4, "c")) == [(["a", "c"], 0)]  # fills the fuller one
    assert list(bins.add(9, "d")) == [] and list(bins.add(8, "e")) == [(["d"], 1)]


def test_pack_cuts_only_what_exceeds_and_takes_nulls_repeats_and_empties(spark):
    rows = [(1, 10, "x"), (1, 10, "x"), (2, None, "x"), (3, 0, "x"), (None, 4, "x"), (4, 250, "x"), (5, 100, "x"), (6, 101, "x")]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, fill string"), "doc_id", "n_tokens", 100, 3).toPandas()
    assert got[got.item_id == 4].sort_values("piece_no")[["start", "end"]].values.tolist() == [[0, 100], [100, 200], [200, 250]]
    assert set(got[got.piece_no > 0].item_id) == {4, 6}
    assert (got.groupby("container_id")["size"].sum() == got.groupby("container_id")["fill"].first()).all() and got.fill.max() <= 100
    assert got["size"].sum() == 475 and len(got[got.item_id == 1]) == 2 and len(got) == 11
    assert pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), "doc_id", "n_tokens").collect() == []


def test_fill_on_many_items(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20, 600)) for i in range(6000)]
    got = pack(spark.createDataFrame(rows, "i bigint, n bigint"), "i", "n", 2048).toPandas()
    assert got.groupby("container_id").fill.first().mean() > 0.97 * 2048


def test_token_counts_of_odd_texts(spark):
    long = "a" * 300_000 + " \n" * 50_000
    rows = [(1, None), (2, ""), (3, "x"), (4, "<|endoftext|>"), (5, "a\r\nb\x00�é"), (6, long)]
    got = {r.i: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "i int, text string"), "text", ["i"]).collect()}
    enc = encoding()
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in rows} and got[4] > 1


T = "source string, target_share double, max_uses int, tokens string"
D = "doc_id bigint, source string, n_tokens bigint, weights string"


def docs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([" A", "a", "A "]), 10, "x") for i in range(600)] + [(1000 + i, "b", 50, "x") for i in range(20)] + [(2000 + i, "c", 5, "x") for i in range(10)] + [(1, None, 100, "x"), (None, "a", 10, "x"), (9, "a", 0, "x"), (9, "zz", 40, "x")]
    return spark.createDataFrame(rows, D)


def test_mix_reaches_shares_with_capped_repeats(spark):
    targets = spark.createDataFrame([("a", 0.5, 1, "x"), ("B", 0.4, 4, "x"), ("c", 0.05, 2, "x"), ("none", 0.05, 9, "x")], T)
    plan = mix_plan(docs(spark), targets)
    total = 600 * 10 + 1000 + 50 + 100 + 10 + 40
    assert {r.source for r in shares(mix(docs(spark), plan), plan).filter("lacks").collect()} == {"c", "none"}
    got = mix(docs(spark), plan, bucket_rows=50)
    pdf = got.toPandas()
    assert pdf.groupby(["source", "use_no", "doc_id"], dropna=False).size().max() == 1
    sums = pdf.groupby("source").n_tokens.sum()
    assert 0.5 * total <= sums["a"] < 0.5 * total + 10 and 0.4 * total <= sums["b"] < 0.4 * total + 50 and sums["c"] == 100
    assert pdf[pdf.source == "b"].use_no.max() == 3 and pdf.position.is_monotonic_increasing and pdf.position.between(0, 1).all()
    s = {r.source: r for r in shares(got, plan).collect()}
    assert abs(s["a"].reached_share - 0.5) < 0.002 and s["none"].tokens == 0 and s["c"].most_uses == 2


def test_held_shares_shrink_the_total(spark):
    targets = spark.createDataFrame([("a", 0.6, 1, "x"), ("b", 0.35, 4, "x"), ("c", 0.05, 2, "x")], T)
    plan = mix_plan(docs(spark), targets, hold=True)
    s = {r.source: r for r in shares(mix(docs(spark), plan), plan).collect()}
    assert s["c"].tokens == 100 and 1200 <= s["a"].tokens < 1210 and 700 <= s["b"].tokens < 750 and not any(r.lacks for r in s.values())


def test_schedule_moves_short_documents_forward(spark):
    targets = spark.createDataFrame([("a", 0.5, 1, "x"), ("b", 0.5, 9, "x")], T)
    rows = spark.createDataFrame([(i, "a", 5, "x") for i in range(2000)] + [(5000 + i, "b", 50, "x") for i in range(200)], D)
    pdf = mix(rows, mix_plan(rows, targets, tilt=1.0)).toPandas()
    early = pdf[pdf.position < 0.25].groupby("source").n_tokens.sum()
    late = pdf[pdf.position >= 0.75].groupby("source").n_tokens.sum()
    assert early["a"] > 1.3 * early["b"] and late["b"] > 1.3 * late["a"]


@pytest.mark.parametrize("rows", [[], [(1, "a", None, "x"), (2, None, 0, "x")]])
def test_mix_without_tokens(spark, rows):
    df = spark.createDataFrame(rows, D)
    targets = spark.createDataFrame([("a", 1.0, 2, "x")], T)
    assert mix(df, mix_plan(df, targets)).collect() == [] and mix(df, mix_plan(df, targets, hold=True)).collect() == []
    assert [r.reached_share for r in shares(mix(df, mix_plan(df, targets)), mix_plan(df, targets)).collect()] == [0.0]
