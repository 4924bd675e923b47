"""Train, validation and test splits that keep related records together.

Method: an incremental, persisted component table. A batch's keys meet the components they already
belong to; links between components are contracted round by round, each round's links flattened by
pointer jumping. Components that have a split keep it, new ones fill the deficits of the target
shares, and a batch that would merge components of different splits has its merging rows, and only
those, quarantined: the components stay apart as parts, each with its split, of one larger component.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.session import cut, written
from lodestone.plans.skew import lookup_join


@dataclass(frozen=True)
class Components:
    """What is kept between batches: ``keys(key, part)`` and ``splits(part, split_name)``, ``members(id, root, part, stratum, split_name, status)``, and ``bridges(a, b)``, parts that quarantined rows link.

    ``delta`` has what the last batch added: new ``keys``, ``members`` and ``bridges``, ``splits`` of parts it made or grew, and ``moves(part, above)`` of old parts it merged into others.
    """

    keys: DataFrame
    splits: DataFrame
    members: DataFrame
    bridges: DataFrame | None = None
    delta: dict[str, DataFrame] | None = None

    def save(self, path: str, version: int, whole: bool = False) -> None:
        """Write what the last batch added (or, of a first batch or with ``whole``, all of the state) below ``path`` as ``version``.

        Its last table commits it, so a version that was cut short is never read.
        """
        full = whole or self.delta is None
        tables = {"keys": self.keys, "splits": self.splits, "members": self.members, "bridges": self.bridges} if full else self.delta
        tables = {k: t for k, t in tables.items() if t is not None}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/v={version}/{name}")
        done = self.keys.sparkSession.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(full).alias("full"), F.lit(",".join(tables)).alias("tables"))
        done.coalesce(1).write.mode("append").parquet(f"{path}/commits")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Components | None:
        """The latest committed state below ``path``, the last whole version with all that came after it; None where none is."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return None
        # one row a batch; of a version saved again the later commit is like the first
        commits = {r.version: r for r in spark.read.parquet(f"{path}/commits").collect()}
        read = lambda v: {n: spark.read.parquet(f"{path}/v={v}/{n}") for n in commits[v].tables.split(",")}
        first = max(v for v, r in commits.items() if r.full)
        state = Components(**read(first))
        for v in sorted(v for v in commits if v > first):
            state = state.after(read(v))
        return state

    def after(self, delta: dict[str, DataFrame]) -> Components:
        """The state with a batch's ``delta`` taken in.

        Each table is read once, so plans grow by a few joins a batch; a hot part's rows are split by AQE, as each part has one row on the other side.
        """
        moves = delta["moves"]
        above = lambda t: t.join(moves, "part", "left").withColumn("part", F.coalesce("above", "part")).drop("above")
        keys = above(self.keys).select("key", "part").unionByName(delta["keys"])
        replaced = moves.select("part").unionByName(delta["splits"].select("part")).distinct()
        kept = self.splits.join(replaced, "part", "left_anti")
        cols = ["id", "part", "stratum", "split_name", "status"]
        members = above(self.members.select(*cols)).select(*cols).unionByName(delta["members"].select(*cols))
        bridges = delta["bridges"] if self.bridges is None else delta["bridges"].unionByName(self.bridges)
        for c in ("a", "b"):
            bridges = bridges.join(moves.withColumnRenamed("part", c), c, "left").withColumn(c, F.coalesce("above", c)).drop("above")
        bridges = written(bridges.select("a", "b").distinct(), "split-bridges")
        # parts that quarantined rows link have one root
        top = cut(connect(bridges)).select(F.col("node").alias("part"), "root")
        members = members.join(top, "part", "left").select("id", F.coalesce("root", "part").alias("root"), *cols[1:])
        return Components(keys, kept.unionByName(delta["splits"]), members, bridges, delta)


def flatten_links(links: DataFrame) -> DataFrame:
    """Pointer jumping: ``links(child, parent)``, a forest with one parent a child, to ``(child, root)``."""
    now = cut(links)
    while True:
        up = now.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        jumped = cut(now.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        now = jumped.select("child", "parent")
        if jumped.filter("moved").isEmpty():
            return now


def connect(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; the root is the smallest node of its component.

    Each round hooks every current root that has a smaller one next to it to the smallest such root,
    flattens those links, and contracts the edges; only roots without a smaller neighbour are left.
    """
    left = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = flatten_links(both.groupBy("a").agg(F.min("b").alias("b")).filter("b < a").select(F.col("a").alias("child"), F.col("b").alias("parent")))
        levels.append(links)
        ra = links.select(F.col("child").alias("a"), F.col("parent").alias("pa"))
        rb = links.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
        moved = left.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        left = cut(moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots = levels[-1].select(F.col("child").alias("node"), F.col("parent").alias("root"))
    for links in reversed(levels[:-1]):
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        lower = links.select(F.col("child").alias("node"), F.col("parent").alias("root")).join(up, "root", "left")
        roots = lower.select("node", F.coalesce("above", "root").alias("root")).unionByName(roots)
    return roots


def fill_deficits(sizes: DataFrame, held: DataFrame | None, targets: DataFrame, cells: int = 1024, heavy_share: float = 0.001) -> DataFrame:
    """``(root, split_name)`` for new components ``sizes(root, stratum, n)``, next to the ``held(split_name, stratum, n)`` rows.

    Components with ``heavy_share`` of the rows or more stand alone (``1 / heavy_share`` at most); all
    others share ``cells`` hash cells. These few cells, largest first, go to the split that lacks most
    of what the cell holds, counted by stratum. Only cells, never components, meet in one task, so its
    input is bounded by (``cells`` + 1 / ``heavy_share``) rows a stratum.
    """
    whole = sizes.groupBy("root").agg(F.sum("n").alias("size"))
    total = sizes.agg(F.sum("n")).scalar()
    heavy = F.col("size") >= F.lit(heavy_share) * total
    placed = whole.select("root", F.when(heavy, F.concat(F.lit("c"), F.col("root"))).otherwise(F.concat(F.lit("h"), F.pmod(F.xxhash64("root"), F.lit(cells)))).alias("cell"))
    load = sizes.join(placed, "root").groupBy("cell", "stratum").agg(F.sum("n").alias("n"))
    rows = load.select("cell", "stratum", F.col("n").cast("double").alias("n"), F.lit(None).cast("string").alias("split_name"))
    if held is not None:
        rows = rows.unionByName(held.select(F.lit(None).cast("string").alias("cell"), "stratum", F.col("n").cast("double").alias("n"), "split_name"))
    rows = rows.unionByName(targets.select(F.lit(None).cast("string").alias("cell"), F.lit(None).cast("string").alias("stratum"), F.col("target_share").cast("double").alias("n"), "split_name"))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        share = group[group.cell.isna() & group.stratum.isna()].sort_values(["n", "split_name"], ascending=[False, True])
        names, part = share.split_name.tolist(), share.n.to_numpy() / max(share.n.sum(), 1e-12)
        new, old = group[group.cell.notna()], group[group.cell.isna() & group.stratum.notna()]
        strata = sorted({*new.stratum, *old.stratum})
        at = {s: i for i, s in enumerate(strata)}
        table = new.pivot_table(index="cell", columns="stratum", values="n", aggfunc="sum", fill_value=0.0).reindex(columns=strata, fill_value=0.0)
        have = np.zeros((len(names), len(strata)))
        for s, x, n in zip(old.split_name, old.stratum, old.n):
            if s in names:
                have[names.index(s), at[x]] += n
        want = part[:, None] * (have.sum(0) + table.to_numpy().sum(0))[None, :]
        out = []
        for cell in sorted(table.index, key=lambda c: (-table.loc[c].sum(), c)):
            v = table.loc[cell].to_numpy()
            # squared relative misfit that the cell leaves behind, by split
            scale = np.maximum(want, 1.0)
            gain = ((want - have) ** 2 / scale - (want - have - v) ** 2 / scale).sum(1)
            best = int(np.argmax(gain))
            have[best] += v
            out.append((cell, names[best]))
        return pd.DataFrame(out, columns=["cell", "split_name"])

    chosen = rows.groupBy(F.lit(1).alias("one")).applyInPandas(place, "cell string, split_name string")
    # as many rows as cells at most
    return placed.join(F.broadcast(chosen), "cell").select("root", "split_name")


def _split_sides(links: DataFrame, splits: DataFrame) -> DataFrame:
    """``links(a, b, torn)``, each once: torn where both sides have a split and it differs.

    New nodes that hang together take the split of the smallest old component next to any of them.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    side = lambda t, c: t.withColumnsRenamed({"node": c, "split_name": f"s{c}"})
    own = splits.withColumnRenamed("part", "node")
    both = cut(pairs.join(side(own, "a"), "a", "left").join(side(own, "b"), "b", "left"))
    new = cut(connect(both.filter("sa is null and sb is null").select("a", "b")))
    new = new.unionByName(new.select(F.col("root").alias("node"), "root").distinct())
    next_to = both.filter("sa is not null and sb is null").select(F.col("b").alias("node"), F.col("a").alias("old"), F.col("sa").alias("split_name"))
    next_to = next_to.unionByName(both.filter("sb is not null and sa is null").select(F.col("a").alias("node"), F.col("b").alias("old"), F.col("sb").alias("split_name")))
    next_to = cut(next_to.join(new, "node", "left").withColumn("root", F.coalesce("root", "node")))
    given = next_to.groupBy("root").agg(F.min_by("split_name", "old").alias("split_name"))
    named = cut(new.unionByName(next_to.select("node", "root")).distinct().join(given, "root").select("node", "split_name"))
    both = both.join(side(named, "a").withColumnRenamed("sa", "na"), "a", "left").join(side(named, "b").withColumnRenamed("sb", "nb"), "b", "left")
    return cut(both.select("a", "b", F.coalesce(F.coalesce("sa", "na") != F.coalesce("sb", "nb"), F.lit(False)).alias("torn")))


def assign(batch: DataFrame, id_col: str, key_cols: Sequence[str], stratum: str, targets: DataFrame, state: Components | None = None) -> Components:
    """Take a batch of rows into the component table and give them splits.

    Rows are related if any of ``key_cols`` holds the same (null relates nothing), or by a chain of
    such rows. ``members`` has, of all batches so far, each row's ``id``, its component's ``root`` (the
    id of the component: its smallest row when it was first seen), ``split_name``, and ``status``: ``kept`` or ``new`` by whether the component had a
    split before, or ``quarantined`` with a null split for rows that would merge components of
    different splits. Components that only quarantined rows link share a ``root``, but each stays a
    ``part`` of its own with its keys and its split, which later rows get. Rows repeated within or after a batch count once; null ids take no part. Ids
    are of any ordered type. Keep the result with ``save`` and take the next batch with ``load`` in any later session.
    """
    rows = batch.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *(F.concat(F.lit(f"{i}:"), F.col(c)).alias(f"k{i}") for i, c in enumerate(key_cols)), F.coalesce(F.col(stratum), F.lit("-")).alias("stratum"))
    rows = rows.dropDuplicates(["id"])
    if state is not None:
        rows = rows.join(state.members.select("id"), "id", "left_anti")
    rows = written(rows, "split-rows")
    ks = [f"k{i}" for i in range(len(key_cols))]
    pairs = rows.select("id", F.explode(F.array(*ks)).alias("key")).filter("key is not null")
    keys = pairs.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    if state is not None:
        keys = keys.join(state.keys, "key", "left").select("key", F.coalesce("part", "rep").alias("rep"), "n")
    keys = cut(keys)
    # a row links the representatives of its keys; equal key combinations link once
    combos = rows.select(*ks).distinct()
    links = None
    for i in range(1, len(ks)):
        two = combos.select(F.col(ks[0]).alias("key"), F.col(ks[i]).alias("other")).filter("key is not null and other is not null").distinct()
        count = lambda k: two.groupBy(k).agg(F.count(F.lit(1)).alias("w"))
        one = lookup_join(two, keys.select("key", "rep").join(count("key"), "key"), "key", "w").select(F.col("rep").alias("a"), "other")
        other = lookup_join(one, keys.select(F.col("key").alias("other"), F.col("rep").alias("b")).join(count("other"), "other"), "other", "w").select("a", "b")
        links = other if links is None else links.unionByName(other)
    if len(ks) > 2:  # any further key of a row whose first key is null
        for i in range(1, len(ks)):
            for j in range(i + 1, len(ks)):
                two = combos.filter(F.col(ks[0]).isNull()).select(F.col(ks[i]).alias("key"), F.col(ks[j]).alias("other")).dropna().distinct()
                one = two.join(keys.select("key", F.col("rep").alias("a")), "key").join(keys.select(F.col("key").alias("other"), F.col("rep").alias("b")), "other")
                links = links.unionByName(one.select("a", "b"))
    # without a second key there is nothing to chain
    if links is None:
        links = keys.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    torn = None
    if state is not None:
        sides = _split_sides(links, state.splits)
        links, torn = sides.filter("not torn").select("a", "b"), sides.filter("torn").select("a", "b")
    roots = cut(connect(links))
    found = keys.select("key", F.col("rep").alias("node"), "n").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    found = cut(found)
    ids = rows.select("id", "stratum", F.coalesce(*ks).alias("key"))
    lone = ids.filter("key is null").select("id", "stratum", F.col("id").alias("root"))
    weight = ids.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    tied = lookup_join(ids.filter("key is not null"), found.select("key", "root").join(weight, "key"), "key", "w").select("id", "stratum", "root")
    tied = written(tied.unionByName(lone), "split-tied")

    if state is None:
        sizes = tied.groupBy("root", "stratum").agg(F.count(F.lit(1)).alias("n"))
        splits = cut(fill_deficits(sizes, None, targets))
        weight = tied.groupBy("root").agg(F.count(F.lit(1)).alias("w"))
        members = lookup_join(tied, splits.join(weight, "root"), "root", "w").select("id", "root", F.col("root").alias("part"), "stratum", "split_name", F.lit("new").alias("status"))
        return Components(found.select("key", F.col("root").alias("part")), splits.withColumnRenamed("root", "part"), written(members, "split-members"))

    # old components that the batch links: the root each now belongs to, and the one split that they have
    span = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    old = span.join(state.splits.withColumnRenamed("part", "node"), "node").select("root", "split_name")
    met = old.groupBy("root").agg(F.min("split_name").alias("split_name"))
    same = state.splits.withColumnRenamed("part", "root").join(span.select(F.col("node").alias("root")), "root", "left_anti").select("root", "split_name")
    known = cut(same.unionByName(met))
    fresh = tied.join(known, "root", "left_anti")
    held = state.members.filter("split_name is not null").groupBy("split_name", "stratum").agg(F.count(F.lit(1)).alias("n"))
    grown = fill_deficits(fresh.groupBy("root", "stratum").agg(F.count(F.lit(1)).alias("n")), held, targets)
    marks = cut(known.withColumn("status", F.lit("kept")).unionByName(grown.withColumn("status", F.lit("new"))))
    # the rows whose own keys lead to different splits
    named = found.join(known, "root").select("key", "split_name", "n")
    apart = lookup_join(pairs, named, "key", "n").groupBy("id").agg(F.min("split_name").alias("low"), F.max("split_name").alias("high"))
    apart = apart.filter("low <> high").select("id", F.lit(True).alias("apart"))
    weight = tied.groupBy("root").agg(F.count(F.lit(1)).alias("w"))
    fresh_members = lookup_join(tied, marks.join(weight, "root"), "root", "w").join(apart, "id", "left")
    fresh_members = fresh_members.select("id", F.col("root").alias("part"), "stratum", F.when(F.col("apart").isNull(), F.col("split_name")).alias("split_name"), F.when(F.col("apart"), "quarantined").otherwise(F.col("status")).alias("status"))
    # old parts that now belong to another; their rows keep their split
    moves = roots.select(F.col("node").alias("part"), F.col("root").alias("above")).join(state.splits.select("part"), "part", "left_semi")
    touched = tied.select(F.col("root").alias("part")).distinct()
    splits = marks.select(F.col("root").alias("part"), "split_name").join(touched.unionByName(moves.select(F.col("above").alias("part"))).distinct(), "part", "left_semi")
    new_keys = found.join(state.keys.select("key"), "key", "left_anti").select("key", F.col("root").alias("part"))
    for c in ("a", "b"):
        torn = torn.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    delta = {"keys": new_keys, "members": fresh_members, "moves": moves, "splits": splits, "bridges": torn.select("a", "b").distinct()}
    return state.after({k: written(t, f"split-{k}") for k, t in delta.items()})


def leads(state: Components) -> DataFrame:
    """``lead_build_id, build_id`` of every row but its component's smallest, which leads it."""
    m = state.members
    groups = m.groupBy("root").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("w"))
    return lookup_join(m.select("root", "id"), groups, "root", "w").filter("id <> lead").select(F.col("lead").alias("lead_build_id"), F.col("id").alias("build_id"))
