"""Most similar vectors for every vector, by shifted space-filling curves or by an exact scan of a query set.

Equal vectors are searched once, by their smallest id, and expanded after the search. The curves:
vectors are projected by several random rotations; on each projection, moved by a random
shift, a Hilbert curve gives every vector a key. Rows are range-partitioned by curve and key (the
boundaries come from a bounded sample, so keys are made once), each row
is compared with the rows of a window around it in key order, and the windows' best of all curves are
merged. Rows whose windows are crowded with near vectors are searched again by the exact scan. On
the curves vectors travel as 16-bit integers with a scale (cosines within about 1e-5).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.truth import sharded
from lodestone.plans.session import written
from lodestone.plans.skew import lookup_join


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (n, dims) with ``bits`` bits a dimension, as uint64.

    The published transposition algorithm: undo the excess rotations from the top bit down, Gray-encode,
    and interleave; ``dims * bits`` may be 63 at most.
    """
    axes = [cells[:, i].astype(np.uint32) for i in range(cells.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        low = np.uint32(level - 1)
        for i, x in enumerate(axes):
            high = (x & np.uint32(level)) != 0
            swap = np.where(high, np.uint32(0), (axes[0] ^ x) & low)
            axes[0] = axes[0] ^ np.where(high, low, np.uint32(0)) ^ swap
            if i:
                axes[i] = x ^ swap
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.uint32)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((axes[-1] & np.uint32(level)) != 0, np.uint32(level - 1), np.uint32(0))
        level >>= 1
    key = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for x in axes:
            key = (key << np.uint64(1)) | (((x ^ turn) >> np.uint32(bit)) & np.uint32(1)).astype(np.uint64)
    return key


def _curves(dim: int, curves: int, project: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [(np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :project].astype(np.float32), rng.random(project)) for _ in range(curves)]


def _unpacked(b: pa.RecordBatch, dim: int) -> np.ndarray:
    """Unit vectors of a batch with ``scale`` and ``vec``; as 16-bit integers, or as 32-bit floats by the length."""
    blobs, scale = b"".join(b.column("vec").to_pylist()), b.column("scale").to_numpy()
    if len(blobs) == 4 * dim * len(scale):
        return np.frombuffer(blobs, "<f4").reshape(-1, dim)
    v = np.frombuffer(blobs, "<i2").reshape(-1, dim).astype(np.float32) * (scale / 32767)[:, None]
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def all_pairs(queries: DataFrame, base: DataFrame, k: int, dim: int, block: int = 65536) -> DataFrame:
    """``(id, near)``: the ``k`` nearest others in ``base`` of each of ``queries``, both ``id, scale, vec`` with each id once.

    Exact, cosines equal to six places being ties: blocks of at most about ``block`` queries each meet every row of ``base``, which is streamed in as many
    parts as give every core a cell, so the work is the product of both, ``base`` is shuffled once a block and the queries
    once a part.
    """
    wide = queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-queries.count() // block))
    parts_ = max(1, -(-wide // blocks))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        ids = None

        def ready() -> None:
            nonlocal ids, vec, score, found
            ids, vec = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            # one more than k, as a row meets itself
            score, found = np.full((len(ids), k + 1), -2, np.float32), np.full((len(ids), k + 1), -1, np.int64)

        vec = score = found = None
        for b in batches:
            if not b.num_rows:
                continue
            i, v, side = b.column("id").to_numpy(), _unpacked(b, dim), b.column("base").to_numpy(zero_copy_only=False)
            if not side.all():
                parts.append((i[~side], v[~side]))
            if not side.any():
                continue
            if ids is None:
                if not parts:
                    return
                ready()
            i, v = i[side], v[side]
            for lo in range(0, len(i), 2048):
                other, turned = i[lo : lo + 2048], np.ascontiguousarray(v[lo : lo + 2048].T)
                for at in range(0, len(ids), 512):
                    sim = vec[at : at + 512] @ turned
                    floor = score[at : at + 512, -1]
                    if floor.min() <= -2 and len(other) > k + 1:
                        floor = np.maximum(floor, np.partition(sim, -k - 1, axis=1)[:, -k - 1])
                    hit = np.flatnonzero(sim >= floor[:, None] - np.float32(1e-6))
                    if not len(hit):
                        continue
                    r, j = np.divmod(hit, len(other))
                    rows = np.unique(r)
                    # cosines are told apart to six places, below which they are rounding
                    s, o = np.r_[np.round(sim[r, j], 6), score[at + rows].ravel()], np.r_[other[j], found[at + rows].ravel()]
                    r = np.r_[r, np.repeat(rows, k + 1)]
                    by = np.lexsort((o, -s, r))
                    first = np.searchsorted(r[by], rows)
                    take = by[first[:, None] + np.arange(k + 1)]
                    score[at + rows], found[at + rows] = s[take], o[take]
        if ids is None:
            return
        for at in range(0, len(ids), 8192):
            s, o, own = score[at : at + 8192], found[at : at + 8192], ids[at : at + 8192]
            keep = (o != own[:, None]) & (s > -2)
            keep &= keep.cumsum(1) <= k
            offs = np.r_[0, keep.sum(1).cumsum()].astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(-np.minimum(s[keep], 1.0)), pa.array(o[keep])], names=["far", "id"])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(pa.array(offs), pairs)], names=["id", "near"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    asked = queries.select(own(blocks).alias("q"), every(parts_).alias("p"), F.lit(False).alias("base"), "id", "scale", "vec")
    given = base.select(every(blocks).alias("q"), own(parts_).alias("p"), F.lit(True).alias("base"), "id", "scale", "vec")
    cells = asked.unionByName(given).withColumn("g", F.col("q") * parts_ + F.col("p")).drop("q", "p").repartitionById(blocks * parts_, "g")
    found = cells.sortWithinPartitions("base").drop("g").mapInArrow(scan, "id bigint, near array<struct<far:float,id:bigint>>")
    return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def curve_keys(v: np.ndarray, turn: np.ndarray, shift: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of unit vectors on one curve."""
    # unit vectors projected to one axis are nearly normal with deviation 1 / sqrt(dim): make them uniform
    x = v @ turn * np.float32(np.sqrt(v.shape[1]))
    u = 0.5 * (1 + np.tanh(0.7978845608 * (x + 0.044715 * x**3)))
    return hilbert_key(np.minimum(((u + shift) * (1 << (bits - 1))).astype(np.uint32), (1 << bits) - 1), bits).astype(np.int64)


def nearest(
    df: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64, min_similarity: float = -1.0, curves: int = 6, project: int = 15, bits: int = 4, window: int = 128, seed: int = 20250101, exact: bool = False, crowd: float = 0.9,
    queries: str = "true", sample: int = 20_000, part_rows: int = 65_536,
) -> DataFrame:
    """For every vector its ``k`` most similar others: ``id, neighbour_id, similarity, rank``.

    Similarity is the cosine; ``min_similarity`` drops neighbours below it. Only vectors of ``dim``
    finite numbers that are not all zero take part. Rows that repeat an id count once. Among neighbours
    of equal similarity the smaller id comes first, for any number of equal vectors. ``queries`` is a condition
    on ``id``: neighbours come from all vectors, but only of these ids. With ``exact`` every query meets every
    vector, in blocks; else the search is approximate: a neighbour is missed when no curve brings
    it within ``window`` places, but rows that have ``window // 2`` vectors at ``min_similarity`` (or
    ``crowd``, if none is given) in a window meet every other vector too; see the README for measured
    recall. At most ``sample`` vectors, about, give the boundaries of the range partitions of ``part_rows`` rows
    each; all vectors are indexed. Ids are integers or any other ordered type. Null ids take no part; an
    empty table gives no row.
    """
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        at = sharded(df.select(F.col(id_col).alias("__id")).filter("__id is not null").distinct(), ["__id"], 1).select("__id", "position")
        at = written(at.withColumn("__asked", F.expr(re.sub(r"\bid\b", "__id", queries))), "knn-ids")
        chosen = at.filter("__asked")
        plain = df.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")).join(at, "__id")
        plain = plain.select(F.when(F.col("__asked"), 2 * F.col("position")).otherwise(2 * F.col("position") + 1).alias("__no"), "__v")
        out = nearest(plain, "__no", "__v", k, dim, min_similarity, curves, project, bits, window, seed, exact, crowd, "id % 2 = 0", sample, part_rows)
        back = at.select(F.when(F.col("__asked"), 2 * F.col("position")).otherwise(2 * F.col("position") + 1).alias("neighbour_id"), F.col("__id").alias("__near"))
        out = out.join(back, "neighbour_id").join(chosen.select((2 * F.col("position")).alias("id"), "__id"), "id")
        return out.select(F.col("__id").alias("id"), F.col("__near").alias("neighbour_id"), "similarity", "rank")
    project = min(project, dim, 63 // bits)
    finite = F.forall(F.col("__v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("__v")).filter(F.col("id").isNotNull() & (F.size("__v") == dim))
    src = src.filter(finite & F.exists("__v", lambda x: x != 0)).select("id", F.col("__v").cast("array<float>").alias("__v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("__v").flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            v = v / np.abs(v).max(1, keepdims=True)
            v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)
            top = np.zeros(len(v), np.float32) if exact else np.abs(v).max(1)
            short = v.astype("<f4") if exact else np.rint(v * (32767 / top)[:, None]).astype("<i2")
            blob = pa.Array.from_buffers(pa.binary(short.itemsize * dim), len(v), [None, pa.py_buffer(short.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(top.astype(np.float32)), blob], names=["id", "scale", "vec"])

    def keyed_by(bounds: list[np.ndarray]):
        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns = _curves(dim, curves, project, seed)
            for b in batches:
                if not b.num_rows:
                    continue
                v = _unpacked(b, dim)
                for c, (turn, shift) in enumerate(turns):
                    key = curve_keys(v, turn, shift, bits)
                    part = c * (len(bounds[c]) + 1) + np.searchsorted(bounds[c], key, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(v), c, np.int32)), pa.array(key), b.column("id"), b.column("scale"), b.column("vec")], names=["part", "curve", "key", "id", "scale", "vec"])

        return keyed

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 1024
        ids = np.empty(0, np.int64)
        crv = np.empty(0, np.int32)
        vec = np.empty((0, dim), np.float32)
        done = 0  # rows before this index have had their window

        def best(upto: int) -> Iterator[pa.RecordBatch]:
            nonlocal done
            for at in range(done, upto, 128):
                end = min(at + 128, upto)
                lo, hi = max(0, at - window), min(len(ids), end + window)
                sim = vec[at:end] @ vec[lo:hi].T
                gap = np.abs(np.arange(at, end)[:, None] - np.arange(lo, hi)[None, :])
                sim[(gap > window) | (gap == 0) | (crv[at:end, None] != crv[None, lo:hi])] = -2
                # a window that holds so many near rows may hide nearer ones outside it
                full = (sim >= (min_similarity if min_similarity > -1 else crowd)).sum(1) >= max(1, window // 2)
                if min_similarity > -1:
                    r, j = np.nonzero(sim >= min_similarity - 1e-4)
                else:
                    kk = min(k, sim.shape[1])
                    j = np.argpartition(-sim, kk - 1, axis=1)[:, :kk].ravel()
                    r = np.repeat(np.arange(end - at), kk)
                    keep = sim[r, j] > -2
                    r, j = r[keep], j[keep]
                if not len(r):
                    continue
                s, other = np.minimum(sim[r, j], 1.0), ids[lo + j]
                by = np.lexsort((other, -s, r))
                r, s, other = r[by], s[by], other[by]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                size = np.diff(np.r_[first, len(r)])
                keep = np.arange(len(r)) - np.repeat(first, size) < k
                r, s, other = r[keep], s[keep], other[keep]
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                offs = pa.array(np.r_[first, len(r)].astype(np.int32))
                pairs = pa.StructArray.from_arrays([pa.array(-s.astype(np.float32)), pa.array(other)], names=["far", "id"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + r[first]]), pa.ListArray.from_arrays(offs, pairs), pa.array(full[r[first]])], names=["id", "near", "full"])
            done = upto

        for b in batches:
            i = b.column("id").to_numpy()
            c = b.column("curve").to_numpy()
            key = b.column("key").to_numpy()
            if not len(i):
                continue
            # repeated rows have the same key and id, so they are neighbours here
            new = np.r_[True, (i[1:] != i[:-1]) | (key[1:] != key[:-1]) | (c[1:] != c[:-1])]
            new[0] = not (len(ids) and ids[-1] == i[0] and crv[-1] == c[0])
            v = _unpacked(b, dim)
            ids, crv, vec = np.r_[ids, i[new]], np.r_[crv, c[new]], np.r_[vec, v[new].astype(np.float32)]
            if len(ids) - window - done >= step:
                yield from best(len(ids) - window)
                cut = max(0, done - window)
                ids, crv, vec, done = ids[cut:], crv[cut:], vec[cut:], done - cut
        yield from best(len(ids))

    points = src.mapInArrow(packed, "id bigint, scale float, vec binary")
    seen = Observation()
    base = points.withColumn("asked", F.expr(queries)).groupBy("vec", "scale").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count(F.lit(1)).alias("w"), F.bool_or("asked").alias("asked"))
    base = written(base.observe(seen, F.count(F.lit(1)).alias("rows")), "knn-vectors")
    rows = seen.get["rows"]
    if exact:
        near = all_pairs(base.filter("asked"), base, k, dim)
    else:
        # partitions follow a sample's quantiles: as many to a curve as its rows need, and at least one a core in all
        wide = max(-(-rows // part_rows), -(-df.sparkSession.sparkContext.defaultParallelism // curves), 1)
        drawn = base.select("id", "scale", "vec").sample(min(1.0, sample / max(rows, 1)), seed=7).toArrow() if rows else None
        bounds = [np.empty(0, np.int64)] * curves
        if drawn is not None and drawn.num_rows and wide > 1:
            v = _unpacked(drawn.combine_chunks().to_batches()[0], dim)
            marks = np.arange(1, wide) * len(v) // wide
            bounds = [np.sort(curve_keys(v, turn, shift, bits))[marks] for turn, shift in _curves(dim, curves, project, seed)]
        else:
            wide = 1
        points_of = base.select("id", "scale", "vec").mapInArrow(keyed_by(bounds), "part int, curve int, key bigint, id bigint, scale float, vec binary")
        lines = points_of.repartitionById(wide * curves, "part").sortWithinPartitions("curve", "key", "id").drop("part")
        found = lines.mapInArrow(scan, "id bigint, near array<struct<far:float,id:bigint>>, full boolean")
        # at most curves * k candidates a row; one found on several curves is kept once
        near = written(found.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"), F.max("full").alias("full")), "knn-near")
        crowded = near.filter("full").select("id")
        if not crowded.isEmpty():
            asked = base.filter("asked").join(crowded, "id", "left_semi")
            near = near.filter("not full").select("id", "near").unionByName(all_pairs(asked, base, k, dim))
    # an id that has several vectors counts once
    near = near.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    twins = base.filter("id <> last")
    if not twins.isEmpty():
        mark = F.md5(F.concat("vec", F.col("scale").cast("string").cast("binary"))).alias("mark")
        members = written(lookup_join(points.select(mark, "id"), twins.select(mark, F.col("id").alias("rep"), "w"), "mark", "w").select("rep", "id").distinct(), "knn-twins")
        # a group shows its k + 1 smallest ids; the limit is applied before the shuffle
        order = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
        shown = members.withColumn("at", order).filter(F.col("at") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("ids"))
        shown = written(shown, "knn-shown")
        others = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.far").alias("far"), F.col("n.id").alias("rep"))
        others = others.join(shown, "rep", "left").select("id", "far", F.explode(F.coalesce("ids", F.array("rep"))).alias("other"))
        own = shown.select(F.col("rep").alias("id"), F.lit(-1.0).cast("float").alias("far"), F.explode("ids").alias("other"))
        full = others.unionByName(own).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("far", F.col("other").alias("id")))).alias("near"))
        full = written(full, "knn-full")
        sized = full.withColumnRenamed("id", "rep").join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("w")), "rep")
        near = full.unionByName(lookup_join(members.filter("id <> rep"), sized, "rep", "w").select("id", "near"))
    merged = near.select("id", F.expr(f"aggregate(near, slice(near, 1, 0), (best, x) -> if(x.id = id or size(best) >= {k} or exists(best, y -> y.id = x.id), best, concat(best, array(x))))").alias("near"))
    rows = merged.filter(queries).select("id", F.posexplode("near").alias("rank", "n"))
    return rows.select("id", F.col("n.id").alias("neighbour_id"), (-F.col("n.far")).cast("double").alias("similarity"), (F.col("rank") + 1).alias("rank")).filter(F.col("similarity") >= min_similarity)
