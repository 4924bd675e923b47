"""Parameter replay, Pareto frontier, attribution, folds and search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.session import written
from lodestone.plans.skew import spread

GATES = ("coverage_mean", "coverage_ratio", "assignment_quality", "assignment_ratio", "call_edge_ratio", "function_concentration", "function_spread", "function_coverage")
#: Gates that a module of the factorial study switches off when it is missing.
MODULE_GATES = {"H": ("assignment_quality", "assignment_ratio"), "S": ("call_edge_ratio", "function_concentration", "function_spread", "function_coverage")}


def factorial(spark: SparkSession, full: Mapping[str, float]) -> DataFrame:
    """The 16 subsets of the modules H, S, X, R beside B, with each gate of ``full``, or 0 where its module is missing.

    Without X cross-unit calls earn nothing (``cross_bonus``), without R constant data is not looked at (``rodata_on``).
    """
    grid = spark.range(0, 1, 1, 1).select(F.lit("B").alias("config"))
    for m in "HSXR":
        grid = grid.withColumn(f"has_{m}", F.explode(F.array(F.lit(True), F.lit(False))))
    name = F.when(F.col("has_H") & F.col("has_S") & F.col("has_X") & F.col("has_R"), "FULL").otherwise(F.concat(F.lit("B"), *(F.when(F.col(f"has_{m}"), m).otherwise("") for m in "HSXR")))
    gates = {}
    for g in GATES:
        module = next((m for m, gs in MODULE_GATES.items() if g in gs), None)
        value = F.lit(float(full.get(g, 0.0)))
        gates[f"min_{g}"] = F.when(F.col(f"has_{module}"), value).otherwise(F.lit(0.0)) if module else value
    modules = {"cross_bonus": F.when(F.col("has_X"), F.lit(float(full.get("cross_bonus", 0.2)))).otherwise(F.lit(0.0)), "rodata_on": F.col("has_R")}
    return grid.withColumn("config", name).withColumns(gates | modules)


def replay(windows: DataFrame, configs: DataFrame, keys: list[str], n_configs: int = 16) -> DataFrame:
    """Of each (configuration, ``keys``) how many windows pass all gates, and their best coverage mean.

    The configurations are few and are broadcast; windows are scanned once and pre-aggregated before
    the shuffle. A null metric passes no gate above 0.
    """
    ok = F.lit(True)
    for g in GATES:
        ok = ok & (F.coalesce(F.col(g), F.lit(0.0)) >= F.col(f"min_{g}"))
    j = windows.crossJoin(F.broadcast(configs.select("config", *(f"min_{g}" for g in GATES))))
    return j.groupBy("config", *keys).agg(F.count_if(ok).alias("passing"), F.coalesce(F.max(F.when(ok, F.col("coverage_mean"))), F.lit(0.0)).alias("score"))


def gate_depth(gates: Mapping[str, float]) -> Column:
    """How many gates a window passes before the first it fails."""
    depth, open_ = F.lit(0), F.lit(True)
    for g, v in gates.items():
        open_ = open_ & F.coalesce(F.col(g) >= v, F.lit(False))
        depth = depth + open_.cast("int")
    return depth


def attribution(windows: DataFrame, keys: list[str], gates: Mapping[str, float]) -> DataFrame:
    """The deepest gate any window of a case reached, and the first failed gate there; ``passed`` if none."""
    names = [*gates, "passed"]
    deep = windows.groupBy(*keys).agg(F.max(gate_depth(gates)).alias("depth"), F.count(F.lit(1)).alias("windows"))
    return deep.withColumn("category", F.array(*map(F.lit, names))[F.col("depth")])


def _dominated(own: np.ndarray, own_at: np.ndarray, other: np.ndarray, other_at: np.ndarray, step: int = 256) -> np.ndarray:
    """Which rows of ``own`` a row of ``other`` dominates: at least as good everywhere, and better somewhere or earlier."""
    out = np.zeros(len(own), bool)
    # good rows first, as they dominate most
    best = np.argsort(-other.sum(1), kind="stable")
    other, other_at = other[best], other_at[best]
    for lo in range(0, len(own), step):
        x, at = own[lo : lo + step], own_at[lo : lo + step]
        for to in range(0, len(other), 4 * step):
            todo = np.flatnonzero(~out[lo : lo + step])
            y, y_at = other[to : to + 4 * step], other_at[to : to + 4 * step]
            ge = np.ones((len(todo), len(y)), bool)
            gt = y_at[None, :] < at[todo, None]
            for k in range(x.shape[1]):
                a, b = x[todo, k, None], y[None, :, k]
                ge &= b >= a
                gt |= b > a
            out[lo + todo[(ge & gt).any(1)]] = True
    return out


def _beaten(code: np.ndarray, v: np.ndarray, at: np.ndarray, small: int = 64, pairs: int = 1 << 20) -> np.ndarray:
    """Which rows a row of the same group dominates; small groups are compared together, pair by pair, large ones by themselves."""
    by = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.r_[True, code[by][1:] != code[by][:-1]])
    sizes = np.diff(np.r_[starts, len(by)])
    out = np.zeros(len(code), bool)
    for s, n in zip(starts[sizes > small], sizes[sizes > small]):
        rows = by[s : s + n]
        out[rows] = _dominated(v[rows], at[rows], v[rows], at[rows])
    starts, sizes = starts[sizes <= small], sizes[sizes <= small]
    cut = np.flatnonzero(np.diff(np.r_[0, np.cumsum(sizes.astype(np.int64) ** 2) // pairs])) if len(sizes) else []
    for part in np.split(np.arange(len(sizes)), cut):
        s, n = starts[part], sizes[part]
        own = np.repeat(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n), np.repeat(n, n))
        first, width = np.repeat(s, n * n), np.repeat(n, n * n)
        turn = np.arange(len(own)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
        x, y = by[own], by[first + turn % width]
        ge, gt = np.ones(len(x), bool), at[y] < at[x]
        for k in range(v.shape[1]):
            ge &= v[y, k] >= v[x, k]
            gt |= v[y, k] > v[x, k]
        out[x[ge & gt]] = True
    return out


def pareto(windows: DataFrame, keys: list[str], metrics: Sequence[str], order: str, part_rows: int = 20_000) -> DataFrame:
    """The windows no other of their group dominates; of equal vectors the first by ``order``, a unique number, stays.

    Rows with a null or non-finite metric are dropped. Each batch first drops what its own rows dominate; what is left of a
    group is cut into parts of about ``part_rows`` rows, each of which meets all that is left of the group in a task of its own.
    """
    finite = F.lit(True)
    for m in metrics:
        finite = finite & F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < F.lit(float("inf")))
    names = list(metrics)

    def frontier(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of whole groups that their own group leaves."""
        code = pdf.groupby("__g", sort=False).ngroup().to_numpy()
        return pdf[~_beaten(code, pdf[names].to_numpy(float), pdf[order].to_numpy())]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield frontier(b)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extra, held, now, small = ["__k", "__s", "__own"], [], None, []
        for b in batches:
            one, many = b[b.__k == 1], b[b.__k > 1]
            if len(one):
                # all groups but the last have ended
                rows = pd.concat([*small, one])
                last = rows.__g.to_numpy() == rows.__g.iloc[-1]
                small = [rows[last]]
                if not last.all():
                    yield frontier(rows[~last]).drop(columns=extra)
            for key, part in many.groupby(["__g", "__s"], sort=False):
                if key != now:
                    if held:
                        yield held[0].drop(columns=extra)
                    held, now = [], key
                own, other = part[part.__own], part[~part.__own]
                if len(own):
                    held = [pd.concat([*held, own])]
                if held and len(other):
                    gone = _dominated(held[0][names].to_numpy(float), held[0][order].to_numpy(), other[names].to_numpy(float), other[order].to_numpy())
                    held = [held[0][~gone]]
        for rows in held:
            yield rows.drop(columns=extra)
        for rows in small:
            yield frontier(rows).drop(columns=extra)

    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = windows.filter(finite).withColumn("__g", group)
    part = written(rows.mapInPandas(local, rows.schema), "pareto-local")
    # groups that need more than one part: a row stands for part_rows rows at least; AQE splits the join if one is hot
    large = part.groupBy("__g").agg(F.count(F.lit(1)).alias("__w")).filter(F.col("__w") > part_rows).select("__g", F.ceil(F.col("__w") / part_rows).cast("int").alias("__k"))
    sized = part.join(large, "__g", "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
    own = sized.withColumn("__s", F.pmod(F.xxhash64(order), F.col("__k")).cast("int")).withColumn("__own", F.lit(True))
    other = sized.filter("__k > 1").withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__k") - 1))).withColumn("__own", F.lit(False))
    both = spread(own.unionByName(other), "__g", "__s").sortWithinPartitions("__g", "__s", F.desc("__own"))
    return both.mapInPandas(scan, part.schema).drop("__g").select(*windows.columns)


def grouped_folds(cases: DataFrame, group: str, n_folds: int, seed: str = "fold") -> DataFrame:
    """``group, cases, fold``: groups are never split; ranked by size and then by digest they are dealt back and forth over the folds.

    For folds balanced by labels too see ``planning.balanced_folds``. The ranks are found by range partitions, not in one task.
    """
    from lodestone.operators.truth import sharded

    sizes = cases.groupBy(group).agg(F.count(F.lit(1)).alias("cases"))
    order = sizes.withColumns({"__down": -F.col("cases"), "__digest": F.sha2(F.concat_ws(":", F.lit(seed), F.col(group)), 256)})
    r = F.col("position") - 1
    lap, at = F.floor(r / n_folds), F.pmod(r, F.lit(n_folds))
    return sharded(order, ["__down", "__digest"], 1).select(group, "cases", F.when(lap % 2 == 0, at).otherwise(n_folds - 1 - at).cast("int").alias("fold"))


def greedy_search(start: Mapping[str, float], grid: Mapping[str, Sequence[float]], score: Callable[[Mapping[str, float]], float], rounds: int = 5) -> tuple[dict, float]:
    """Coordinate search from ``start``: values in grid order, strict improvements only, until a round changes nothing."""
    best, top = dict(start), score(start)
    for _ in range(rounds):
        before = dict(best)
        for name, values in grid.items():
            for v in values:
                trial = {**best, name: v}
                if trial != best and (s := score(trial)) > top:
                    best, top = trial, s
        if best == before:
            break
    return best, top


def random_search(grid: Mapping[str, Sequence[float]], score: Callable[[Mapping[str, float]], float], trials: int, seed: int = 0) -> tuple[dict, float]:
    """Seeded random draws from the grid; the first best draw wins."""
    import random

    rng = random.Random(seed)
    best, top = {}, float("-inf")
    for _ in range(trials):
        trial = {k: rng.choice(list(v)) for k, v in grid.items()}
        if (s := score(trial)) > top:
            best, top = trial, s
    return best, top


def profile_design(defaults: Mapping[str, float], grid: Mapping[str, Sequence[float]], n: int, seed: str = "profiles") -> list[dict]:
    """``n`` profiles: the defaults first, then shuffled grid columns so every value occurs when ``n`` allows it."""
    import random

    out = [dict(defaults)]
    columns = {}
    for k, values in grid.items():
        rng = random.Random(f"{seed}:{k}")
        column: list[float] = []
        while len(column) < n - 1:
            block = list(values)
            rng.shuffle(block)
            column += block
        columns[k] = column
    return out + [{**defaults, **{k: columns[k][i] for k in grid}} for i in range(n - 1)]
