"""The block matcher: cosine of all block pairs of two units, windows of functions, best match.

Library units travel whole, several in one bounded pack; a binary is cut into tiles of bounded runs of
functions, each long enough that every window of a class of units lies whole in one tile. A pack meets a
tile in one matrix product in an Arrow batch, and no row ever holds a whole binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.assignment import assignment_scores
from lodestone.operators.replay import pareto
from lodestone.plans.session import written
from lodestone.plans.skew import spread


@dataclass(frozen=True)
class MatchParams:
    """Thresholds of the matcher; always passed explicitly. The defaults are fixed values."""

    block_threshold: float = 0.90
    coverage_mean: float = 0.975
    coverage_ratio: float = 0.65
    assignment_quality: float = 0.875
    assignment_ratio: float = 0.40
    call_edge_ratio: float = 0.30
    function_concentration: float = 0.75
    function_spread: float = 0.30
    function_coverage: float = 0.05
    multiplier: float = 2.5
    padding: int = 6
    prefilter: bool = True


GATES = ("coverage_mean", "coverage_ratio", "assignment_quality", "assignment_ratio", "call_edge_ratio", "function_concentration", "function_spread", "function_coverage")
WINDOW = "cu string, elf string, window_start int, window_stop int, windows_total int, " + ", ".join(f"{m} double" for m in ("coverage_mean", "coverage_min", *GATES[1:])) + ", evaluated boolean, passed boolean"


def indexed_blocks(blocks: DataFrame, unit: str, function: str, order: list[str], vector: str, n_instructions: str, min_instructions: int = 5) -> DataFrame:
    """The eligible blocks: ``unit, n_functions, f`` (dense number of the function, by ``function`` order), ``pos`` (what orders the blocks of a function) and ``v``.

    A block is eligible with a vector and at least ``min_instructions``. Functions count even when none of
    their blocks is eligible; units without an eligible block have no row. A unit's functions, never its blocks,
    meet in one window.
    """
    own = Window.partitionBy("unit")
    fn = blocks.select(F.col(unit).alias("unit"), F.col(function).alias("__f")).distinct()
    fn = fn.withColumns({"f": (F.row_number().over(own.orderBy("__f")) - 1).cast("int"), "n_functions": F.count(F.lit(1)).over(own).cast("int")})
    ok = blocks.filter(F.col(vector).isNotNull() & (F.col(n_instructions) >= min_instructions))
    rows = ok.select(F.col(unit).alias("unit"), F.col(function).alias("__f"), F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order))).alias("pos"), F.col(vector).cast("array<float>").alias("v"))
    return rows.join(fn, ["unit", "__f"]).select("unit", "n_functions", "f", "pos", "v")


def block_spans(blocks: DataFrame, unit: list[str], function: str, order: list[str], vector: str, n_instructions: str, min_instructions: int = 5) -> DataFrame:
    """``unit.., f, low, high``: where each function's eligible blocks lie among the unit's; a function without any has an empty span."""
    ok = F.col(vector).isNotNull() & (F.col(n_instructions) >= min_instructions)
    g = blocks.groupBy(*unit, function).agg(F.count_if(ok).alias("__n"))
    w = Window.partitionBy(*unit).orderBy(function)
    high = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return g.select(*unit, (F.row_number().over(w) - 1).alias("f"), (high - F.col("__n")).alias("low"), high.alias("high"))


def dense_edges(blocks: DataFrame, edges: DataFrame, unit: str, function: str) -> DataFrame:
    """``unit, a, b``: distinct call edges ``edges(unit, caller, callee)`` in dense function numbers; ends that are no function of ``blocks`` are left out."""
    at = blocks.select(F.col(unit).alias("unit"), F.col(function).alias("f")).distinct().withColumn("n", (F.row_number().over(Window.partitionBy("unit").orderBy("f")) - 1).cast("int"))
    e = edges.select(F.col(unit).alias("unit"), "caller", "callee").distinct()
    for side, no in (("caller", "a"), ("callee", "b")):
        e = e.join(at.select("unit", F.col("f").alias(side), F.col("n").alias(no)), ["unit", side])
    return e.select("unit", "a", "b")


def eligible_units(units: DataFrame, library: list[str], n_functions: str, order: list[str], least: int = 2) -> DataFrame:
    """The units of at least ``least`` functions, with ``target_cu_index``: their dense place in their library."""
    kept = units.filter(F.col(n_functions) >= least)
    return kept.withColumn("target_cu_index", F.row_number().over(Window.partitionBy(*library).orderBy(*order)) - 1)


def _matrix(flat, n: int) -> np.ndarray:
    m = np.asarray(flat, float).reshape(n, -1) if n else np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _function_max(sim: np.ndarray, spans: np.ndarray, n_functions: int) -> np.ndarray:
    """Best similarity of each row in each function; -inf for functions without a block."""
    out = np.full((len(sim), n_functions), -np.inf)
    if len(spans) and len(sim):
        starts = np.flatnonzero(np.r_[True, spans[1:] != spans[:-1]])
        out[:, spans[starts]] = np.maximum.reduceat(sim, starts, axis=1)
    return out


def window_size(elf_functions: int, cu_functions: int, multiplier: float, padding: int) -> int:
    return min(elf_functions, max(cu_functions, int(np.ceil(cu_functions * multiplier)) + padding))


def rolling_max(best: np.ndarray, width: int) -> np.ndarray:
    """Maximum over each full window of ``width`` columns."""
    if best.shape[1] <= width:
        return best.max(1, keepdims=True)
    return np.lib.stride_tricks.sliding_window_view(best, width, axis=1).max(2)


def _structure(argmax_fn: np.ndarray, cu_fn: np.ndarray) -> tuple[float, float, dict[int, int]]:
    """Concentration, spread and the dominant function of each unit function (ties to the lowest)."""
    if not len(cu_fn):
        return 0.0, 0.0, {}
    pairs, counts = np.unique(cu_fn.astype(np.int64) << 32 | argmax_fn, return_counts=True)
    own = pairs >> 32
    by = np.lexsort((pairs, -counts, own))
    first = by[np.r_[True, own[by][1:] != own[by][:-1]]]
    mapping = dict(zip((own[first]).tolist(), (pairs[first] & 0xFFFFFFFF).tolist()))
    return float(counts[first].sum() / len(cu_fn)), len(set(mapping.values())) / len(mapping), mapping


def match_pair(cu: tuple, elf: tuple, p: MatchParams, cu_edges: set = frozenset(), elf_edges: set = frozenset(), tile: tuple[int, int, int] | None = None, sim: np.ndarray | None = None) -> list[dict]:
    """The windows of one pair of units, each with its metrics and whether it passes and was evaluated.

    Either side is ``(functions, function of each block, vectors)``. With ``tile = (first, stride, functions of the
    whole binary)`` the binary's side is the tile from function ``first`` on, and the windows are those that start in the
    ``stride`` functions from there. ``sim`` are the similarities, if they are known.
    """
    (cn, cf, cv), (en, ef, ev) = cu, elf
    if not len(cf) or not len(ef):
        return []
    first, stride, whole = tile or (0, en, en)
    width = window_size(whole, cn, p.multiplier, p.padding)
    starts = min(stride, whole - width + 1 - first)
    if starts < 1:
        return []
    sim = _matrix(cv, len(cf)) @ _matrix(ev, len(ef)).T if sim is None else sim
    span = starts + width - 1
    near = np.searchsorted(ef, first + span)
    roll = rolling_max(_function_max(sim[:, :near], ef[:near] - first, span), width)
    out = []
    for s in range(roll.shape[1]):
        lo, hi = np.searchsorted(ef, [first + s, first + s + width])
        if lo == hi:
            continue
        c = roll[:, s]
        w = {"window_start": first + s, "window_stop": first + s + width, "windows_total": whole - width + 1, "coverage_mean": round(float(c.mean()), 12), "coverage_min": float(c.min()), "coverage_ratio": round(float((c >= p.block_threshold).mean()), 12)}
        w |= {"assignment_quality": 0.0, "assignment_ratio": 0.0, "call_edge_ratio": 0.0, "function_concentration": 0.0, "function_spread": 0.0, "function_coverage": 0.0, "evaluated": False, "passed": False}
        out.append(w)
        if p.prefilter and (w["coverage_mean"] < p.coverage_mean or w["coverage_ratio"] < p.coverage_ratio):
            continue
        sub = sim[:, lo:hi]
        w["assignment_quality"], w["assignment_ratio"] = assignment_scores(sub, p.block_threshold)
        w["function_concentration"], w["function_spread"], mapping = _structure(ef[lo + sub.argmax(1)], cf)
        known = [(mapping[a], mapping[b]) for a, b in cu_edges if a in mapping and b in mapping]
        w["call_edge_ratio"] = sum(x in elf_edges for x in known) / len(known) if known else 1.0
        w["function_coverage"] = len(set(cf[c >= p.block_threshold].tolist())) / cn
        w["evaluated"] = True
        # summation order must not decide between equal windows
        w |= {g: round(w[g], 12) for g in GATES}
        w["passed"] = all(w[g] >= getattr(p, g) for g in GATES)
    return out


def classes(cus: DataFrame, pack_blocks: int = 8192) -> dict[int, tuple[int, int]]:
    """Blocks and packs of each class of library units: the power of two that holds a unit's functions. One row a power of two is fetched."""
    n = cus.groupBy(_class().alias("cls")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.cls: (r.n, -(-r.n // pack_blocks)) for r in n}


def _class() -> Column:
    return F.ceil(F.log2(F.greatest("n_functions", F.lit(1)))).cast("int")


def packs(cus: DataFrame, known: dict[int, tuple[int, int]], edges: DataFrame | None = None) -> DataFrame:
    """Library units in packs: ``cls, pack`` and, by unit, ``units, n_functions, sizes, functions, vectors, edge_sizes, edges``. A unit is never split."""
    b = cus.groupBy("unit", "n_functions").agg(F.array_sort(F.collect_list(F.struct("f", "pos", "v"))).alias("b"), F.count(F.lit(1)).alias("size"))
    b = b.withColumn("cls", _class())
    if edges is not None:
        e = edges.groupBy("unit").agg(F.flatten(F.array_sort(F.collect_list(F.array("a", "b")))).alias("e"))
        b = b.join(e, "unit", "left")
    else:
        b = b.withColumn("e", F.lit(None).cast("array<int>"))
    n_packs = _by_class({c: n for c, (_, n) in known.items()})
    b = b.withColumns({"e": F.coalesce("e", F.array().cast("array<int>")), "pack": F.pmod(F.xxhash64("unit"), n_packs).cast("int")})
    u = b.groupBy("cls", "pack").agg(F.array_sort(F.collect_list(F.struct(F.col("unit").cast("string").alias("unit"), "n_functions", "size", "b", "e"))).alias("u"))
    of = lambda f: F.transform("u", f)
    return u.select(
        "cls", "pack", of(lambda x: x["unit"]).alias("units"), of(lambda x: x["n_functions"]).alias("n_functions"), of(lambda x: x["size"]).alias("sizes"), F.flatten(of(lambda x: F.transform(x["b"], lambda y: y["f"]))).alias("functions"),
        F.flatten(F.flatten(of(lambda x: F.transform(x["b"], lambda y: y["v"])))).alias("vectors"), of(lambda x: F.size(x["e"])).alias("edge_sizes"), F.flatten(of(lambda x: x["e"])).alias("edges"),
    )


def _by_class(values: dict[int, int]) -> Column:
    return F.coalesce(*(F.when(F.col("cls") == c, v) for c, v in values.items()), F.lit(1))


def tiles(elfs: DataFrame, wide: dict[int, int], stride: int, edges: DataFrame | None = None) -> DataFrame:
    """Binaries in tiles: ``elf, cls, tile, first, stride, whole`` (functions of the binary), ``tile_functions, tile_vectors, tile_edges``.

    ``wide`` has the widest window of each class. A class's tile begins every ``stride`` functions (or every widest window, if that is more)
    and goes on for one widest window, so each function is in two tiles at most and each window in one.
    """
    spec = F.explode(F.array(*(F.struct(F.lit(c).alias("cls"), F.lit(max(w, stride)).alias("stride"), F.lit(w).alias("wide")) for c, w in wide.items())))

    def cut(df: DataFrame, low: str, high: str) -> DataFrame:
        begin = F.greatest(F.lit(0), F.floor((F.col(high) - F.col("stride") - F.col("wide") + 1) / F.col("stride")) + 1)
        inside = lambda t: (t * F.col("stride") <= F.col(low)) & (F.col(high) < (t + 1) * F.col("stride") + F.col("wide") - 1)
        each = F.explode(F.filter(F.sequence(begin, F.floor(F.col(low) / F.col("stride"))), inside))
        return df.withColumn("__c", spec).select("*", "__c.*").withColumn("tile", each).withColumn("tile", F.col("tile").cast("int"))

    g = cut(elfs, "f", "f").groupBy(F.col("unit").alias("elf"), "cls", "tile", "stride", F.col("n_functions").alias("whole")).agg(F.array_sort(F.collect_list(F.struct("f", "pos", "v"))).alias("b"))
    g = g.select("elf", "cls", "tile", (F.col("tile") * F.col("stride")).alias("first"), "stride", "whole", F.transform("b", lambda x: x["f"]).alias("tile_functions"), F.flatten(F.transform("b", lambda x: x["v"])).alias("tile_vectors"))
    if edges is None:
        return g.withColumn("tile_edges", F.array().cast("array<int>"))
    ends = edges.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    e = cut(ends.filter("low >= 0"), "low", "high").groupBy(F.col("unit").alias("elf"), "cls", "tile").agg(F.flatten(F.array_sort(F.collect_list(F.array("a", "b")))).alias("tile_edges"))
    return g.join(e, ["elf", "cls", "tile"], "left").withColumn("tile_edges", F.coalesce("tile_edges", F.array().cast("array<int>")))


def _met(packed: DataFrame, tiled: DataFrame, known: dict[int, tuple[int, int]], broadcast_blocks: int, only: DataFrame | None = None) -> DataFrame:
    """Every pack beside every tile of its class, or beside those of ``only(cu, elf)``, which then come as ``allowed``.

    Packs of up to ``broadcast_blocks`` blocks in all are broadcast; more meet the tiles in a shuffle that
    spreads each pack over as many tasks as the session has cores.
    """
    n_packs = _by_class({c: n for c, (_, n) in known.items()})
    turns = tiled.withColumn("pack", F.explode(F.sequence(F.lit(0), (n_packs - 1).cast("int"))))
    if only is not None:
        packed = written(packed, "match-packs")
        place = packed.select("cls", "pack", F.explode("units").alias("cu"))
        allowed = only.join(place, "cu").groupBy("elf", "cls", "pack").agg(F.collect_list("cu").alias("allowed"))
        turns = turns.withColumn("elf", F.col("elf").cast("string")).join(allowed, ["elf", "cls", "pack"])
    if sum(n for n, _ in known.values()) <= broadcast_blocks:
        return spread(turns, "elf", "tile", "pack").join(F.broadcast(packed), ["cls", "pack"])
    salts = packed.sparkSession.sparkContext.defaultParallelism
    turns = turns.withColumn("salt", F.pmod(F.xxhash64("elf", "tile"), F.lit(salts)).cast("int"))
    return turns.join(packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["cls", "pack", "salt"])


def _units_of(x, allowed=None):
    """``(unit, n_functions, rows of the pack, functions, edges)`` of a pack's units."""
    ends, edge_ends = np.cumsum(x.sizes), np.cumsum(x.edge_sizes)
    functions, edges = np.asarray(x.functions, int), np.asarray(x.edges, int)
    for k, unit in enumerate(x.units):
        if allowed is None or unit in allowed:
            at, e = slice(ends[k] - x.sizes[k], ends[k]), edges[edge_ends[k] - x.edge_sizes[k] : edge_ends[k]].reshape(-1, 2)
            yield unit, int(x.n_functions[k]), at, functions[at], {tuple(map(int, r)) for r in e}


def match_windows(cus: DataFrame, elfs: DataFrame, params: MatchParams, cu_edges: DataFrame | None = None, elf_edges: DataFrame | None = None, only: DataFrame | None = None, stride: int = 256, broadcast_blocks: int = 1 << 17) -> DataFrame:
    """Windows of all pairs of units (or of ``only(cu, elf)``), both from ``indexed_blocks``; pairs with an empty side have none.

    Call edges (see ``dense_edges``) take part where both sides have them; without them the call gate is met.
    """
    given, filtered = asdict(params), only is not None
    both = cu_edges is not None and elf_edges is not None
    known = classes(cus)
    if not known:
        return elfs.sparkSession.createDataFrame([], WINDOW)
    packed = packs(cus, known, cu_edges if both else None)
    wide = {c: max(2**c, int(np.ceil(2**c * params.multiplier)) + params.padding) for c in known}
    tiled = tiles(elfs, wide, stride, elf_edges if both else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = MatchParams(**given)
        for b in batches:
            rows = []
            for x in b.itertuples(index=False):
                ef = np.asarray(x.tile_functions, int)
                sim = _matrix(x.vectors, len(x.functions)) @ _matrix(x.tile_vectors, len(ef)).T
                calls = {tuple(map(int, e)) for e in np.asarray(x.tile_edges, int).reshape(-1, 2)}
                for unit, n, at, cf, e in _units_of(x, set(x.allowed) if filtered else None):
                    found = match_pair((n, cf, None), (x.whole, ef, None), p, e, calls, (x.first, x.stride, x.whole), sim[at])
                    rows += [{"cu": unit, "elf": str(x.elf), **w} for w in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOW.split(", ")])

    return _met(packed, tiled, known, broadcast_blocks, only).mapInPandas(run, WINDOW)


def best_windows(windows: DataFrame) -> DataFrame:
    """The best window of each pair, by passing and then by metric; the earliest wins ties."""
    key = F.struct("passed", *GATES, (-F.col("window_start")).alias("early"))
    best = windows.groupBy("cu", "elf").agg(F.max_by(F.struct("window_start", "window_stop", "passed", *GATES), key).alias("w"), F.max("windows_total").alias("windows_total"), F.count_if("evaluated").alias("windows_evaluated"))
    return best.select("cu", "elf", "w.*", "windows_total", "windows_evaluated", (F.col("windows_total") - F.col("windows_evaluated")).alias("windows_skipped"))


def block_best(cus: DataFrame, elfs: DataFrame, stride: int = 256, broadcast_blocks: int = 1 << 17) -> DataFrame:
    """Of each block of each unit the best block anywhere in each binary: ``cu, elf, block, cu_function, best, elf_function`` (the first of equals)."""
    schema = "cu string, elf string, block int, cu_function int, best double, elf_function int"
    known = classes(cus)
    if not known:
        return elfs.sparkSession.createDataFrame([], schema)
    # no window has to fit, so a tile is as wide as its stride, whatever the class
    packed, tiled = packs(cus, known), tiles(elfs, {c: 1 for c in known}, stride)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for x in b.itertuples(index=False):
                ef = np.asarray(x.tile_functions, int)
                sim = _matrix(x.vectors, len(x.functions)) @ _matrix(x.tile_vectors, len(ef)).T
                at = sim.argmax(1)
                sizes = np.asarray(x.sizes, int)
                block = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                parts.append(pd.DataFrame({"cu": np.repeat(np.asarray(x.units, object), sizes), "elf": str(x.elf), "block": block, "cu_function": np.asarray(x.functions, int), "best": sim[np.arange(len(at)), at], "elf_function": ef[at]}))
            yield pd.concat(parts) if parts else pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")])

    found = _met(packed, tiled, known, broadcast_blocks).mapInPandas(run, schema)
    top = F.max(F.struct("best", (-F.col("elf_function")).alias("low"))).alias("t")
    return found.groupBy("cu", "elf", "block", "cu_function").agg(top).select("cu", "elf", "block", "cu_function", F.col("t.best").alias("best"), (-F.col("t.low")).alias("elf_function"))


def negative_bounds(best: DataFrame, params: MatchParams) -> DataFrame:
    """Bound of each pair from ``block_best``: mean and hit ratio of the best similarity anywhere in the binary, and whether it rules the pair out."""
    b = best.groupBy("cu", "elf").agg(F.avg("best").alias("bound_mean"), F.avg((F.col("best") >= params.block_threshold).cast("double")).alias("bound_ratio"))
    return b.withColumn("rejected", (F.col("bound_mean") < params.coverage_mean) | (F.col("bound_ratio") < params.coverage_ratio))


def function_mapping(best: DataFrame, threshold: float) -> DataFrame:
    """Of each unit function the binary function that most of its blocks are nearest to: ``cu, elf, cu_function, elf_function, dominant_ratio, coverage_mean, coverage_ratio``, from ``block_best``."""
    keys = ["cu", "elf", "cu_function"]
    votes = best.groupBy(*keys, "elf_function").agg(F.count(F.lit(1)).alias("n"), F.sum("best").alias("s"), F.sum((F.col("best") >= threshold).cast("int")).alias("h"))
    g = votes.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("elf_function")).alias("low"))).alias("t"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("h").alias("h"))
    return g.select(*keys, (-F.col("t.low")).alias("elf_function"), (F.col("t.n") / F.col("n")).alias("dominant_ratio"), (F.col("s") / F.col("n")).alias("coverage_mean"), (F.col("h") / F.col("n")).alias("coverage_ratio"))


def full_match(cus: DataFrame, elfs: DataFrame, params: MatchParams, cu_edges: DataFrame | None = None, elf_edges: DataFrame | None = None, stride: int = 256) -> DataFrame:
    """The whole matcher: the negative bound, the windows of the pairs it leaves, their best window and how many windows no other dominates (``frontier``).

    A pair that the bound rules out has no window (start and stop -1), the bound as ``coverage_mean``, and all its windows skipped.
    """
    bounds = written(negative_bounds(block_best(cus, elfs, stride), params), "match-bounds")
    windows = written(match_windows(cus, elfs, params, cu_edges, elf_edges, bounds.filter("not rejected").select("cu", "elf"), stride), "match-windows")
    front = pareto(windows.filter("evaluated").select("cu", "elf", "window_start", *GATES), ["cu", "elf"], GATES, "window_start").groupBy("cu", "elf").agg(F.count(F.lit(1)).alias("frontier"))
    best = best_windows(windows).join(front, ["cu", "elf"], "left").withColumns({"frontier": F.coalesce("frontier", F.lit(0)), "bound_rejected": F.lit(False)})
    size = lambda x, c, n: x.select(F.col("unit").cast("string").alias(c), F.col("n_functions").alias(n)).distinct()
    out = bounds.filter("rejected").join(size(cus, "cu", "cn"), "cu").join(size(elfs, "elf", "en"), "elf")
    width = F.least("en", F.greatest("cn", F.ceil(F.col("cn") * params.multiplier) + params.padding))
    total = (F.col("en") - width + 1).cast("int")
    none = [F.lit(0.0).alias(g) for g in GATES if g not in ("coverage_mean", "coverage_ratio")]
    out = out.select("cu", "elf", F.lit(-1).alias("window_start"), F.lit(-1).alias("window_stop"), F.lit(False).alias("passed"), F.col("bound_mean").alias("coverage_mean"), F.lit(0.0).alias("coverage_ratio"), *none, total.alias("windows_total"), F.lit(0).cast("bigint").alias("windows_evaluated"), total.cast("bigint").alias("windows_skipped"), F.lit(0).cast("bigint").alias("frontier"), F.lit(True).alias("bound_rejected"))
    return best.unionByName(out)


def pooled(blocks: DataFrame, keys: list[str], vector: str, mask: str | None = None) -> DataFrame:
    """Mean pooling: the mean of each dimension over a group's vectors, as ``keys.., dim, value``; null vectors and numbers are masked out.

    With ``mask``, a column that is true for what counts, vectors outside it add nothing and the denominator is the number
    that count, 1 at least: a group without any pools to zeros.
    """
    if mask is None:
        return blocks.select(*keys, F.posexplode(vector).alias("dim", "__x")).groupBy(*keys, "dim").agg(F.avg(F.col("__x").cast("double")).alias("value"))
    x = blocks.select(*keys, F.coalesce(F.col(mask), F.lit(False)).alias("__m"), F.posexplode(vector).alias("dim", "__x"))
    return x.groupBy(*keys, "dim").agg((F.sum(F.when(F.col("__m"), F.col("__x").cast("double")).otherwise(0.0)) / F.greatest(F.count_if("__m"), F.lit(1))).alias("value"))
