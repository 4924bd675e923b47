"""Per-key results over keys of which a few hold most rows.

Method: dense accumulator arrays. Every equal input split dictionary-encodes its keys and
reduces into dense numpy arrays (``bincount`` and ordered scatter), so a hot key costs a split
one array cell. The arrays are cut into blocks of the key space and summed block by block in a
distributed reduction; one key contributes at most one cell per split, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, BLOCK, COUNT, PICK = "__key", "__block", "__n", "__pick"


def _compact(t: pa.Table, n_sums: int, order: Sequence[str]) -> pa.Table:
    """One row per key of ``t``: counts and sums by ``bincount``, the first row in ``order``."""
    enc = pc.dictionary_encode(t[KEY].combine_chunks(), null_encoding="encode")
    codes = enc.indices.to_numpy(zero_copy_only=False)
    size = len(enc.dictionary)
    out = {KEY: enc.dictionary}
    if order:
        keyed = t.append_column("__code", enc.indices)
        by = pc.sort_indices(keyed, sort_keys=[("__code", "ascending"), *((c, "descending") for c in order)], null_placement="at_end").to_numpy()
        first = by[np.unique(codes[by], return_index=True)[1]]
    else:
        first = np.empty(size, np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    at = pa.array(first)
    out[BLOCK] = t[BLOCK].take(at)
    out[COUNT] = pa.array(np.rint(np.bincount(codes, weights=t[COUNT].to_numpy(), minlength=size)).astype(np.int64))
    for i in range(n_sums):
        for c in (f"__s{i}", f"__v{i}"):
            out[c] = pa.array(np.bincount(codes, weights=t[c].to_numpy(), minlength=size))
    for c in t.column_names:
        if c not in out:
            out[c] = t[c].take(at)
    return pa.table({c: out[c] for c in t.column_names})


def _reducer(n_sums: int, order: Sequence[str], rows: int, packed: bool):
    """The task of either side: compacts what it reads whenever ``rows`` rows have piled up."""

    def flatten(b: pa.RecordBatch) -> pa.Table:
        lists = {c: b.column(c) for c in b.schema.names if c != BLOCK}
        sizes = pc.list_value_length(next(iter(lists.values()))).to_numpy()
        flat = {BLOCK: pa.array(np.repeat(b.column(BLOCK).to_numpy(), sizes))} | {c: x.flatten() for c, x in lists.items()}
        return pa.table(flat).select(b.schema.names)

    def pack(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.take(pc.sort_indices(t, sort_keys=[(BLOCK, "ascending")])).combine_chunks()
        blocks = t[BLOCK].to_numpy()
        starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        at = pa.array(np.r_[starts, len(blocks)].astype(np.int32))
        arrays = []
        for c in t.column_names:
            x = t[c].combine_chunks()
            x = x if isinstance(x, pa.Array) else x.chunk(0)
            arrays.append(pa.array(blocks[starts].astype(np.int32)) if c == BLOCK else pa.ListArray.from_arrays(at, x))
        yield pa.RecordBatch.from_arrays(arrays, names=t.column_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        pending = floor = 0
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            t = flatten(b) if packed else pa.Table.from_batches([b])
            # a batch says which columns hold no null, what was compacted does not
            t = t.cast(pa.schema([f.with_nullable(True) for f in t.schema]))
            if packed:
                # blocks come in order: what is before the batch's last block is whole
                own = t[BLOCK].to_numpy()
                cut = int(np.searchsorted(own, own[-1]))
                if cut or (held and last != own[-1]):
                    whole = pa.concat_tables([*held, t.slice(0, cut)])
                    if whole.num_rows:
                        yield from _compact(whole, n_sums, order).drop_columns([BLOCK]).to_batches(max_chunksize=10_000)
                    held, pending, floor, t = [], 0, 0, t.slice(cut)
                last = own[-1]
            held.append(t)
            pending += t.num_rows
            if pending > rows + 2 * floor:
                done = _compact(pa.concat_tables(held), n_sums, order)
                if not packed and done.num_rows > rows:
                    yield from pack(done)
                    held, pending, floor = [], 0, 0
                else:
                    held, pending, floor = [done], done.num_rows, done.num_rows
        if held:
            done = _compact(pa.concat_tables(held), n_sums, order)
            if packed:
                yield from done.drop_columns([BLOCK]).to_batches(max_chunksize=10_000)
            else:
                yield from pack(done)

    return run


def dense_key_stats(
    df: DataFrame,
    key: str,
    sums: Sequence[str] = (),
    latest_by: Sequence[str] = (),
    latest_row: Sequence[str] = (),
    key_alias: str = "key_value",
    split_rows: int = 500_000,
) -> DataFrame:
    """Count, sums and the latest row of every value of ``key``.

    Returns ``key_alias``, ``n`` (rows), ``sum_<c>`` for each of ``sums``, and ``latest_<c>`` for
    each of ``latest_row``, taken from the row that is greatest by ``latest_by`` (nulls come
    last; rows equal in all of ``latest_by`` are told apart by ``latest_row`` itself).

    Null keys form one group. A sum ignores nulls and is null where a key has only nulls;
    integral columns sum to BIGINT (exact up to 2**53), others to DOUBLE. Repeated rows count as
    often as they occur. An empty table gives no row. Columns not named are never read, so
    extra columns of any name do no harm.
    """
    spark = df.sparkSession
    # a task holds the keys of one block at a time
    blocks = 32 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    order = list(dict.fromkeys([*latest_by, *latest_row])) if latest_row else []
    cols = [F.col(f"`{key}`").alias(KEY), F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(blocks)).cast("int").alias(BLOCK), F.lit(1).cast("long").alias(COUNT)]
    for i, c in enumerate(sums):
        x = F.col(f"`{c}`").cast("double")
        cols += [F.coalesce(x, F.lit(0.0)).alias(f"__s{i}"), x.isNotNull().cast("double").alias(f"__v{i}")]
    cols += [F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order)]
    flat = df.select(*cols)
    shape = [(f.name, f.dataType) for f in flat.schema.fields]
    lists = T.StructType([T.StructField(n, t if n == BLOCK else T.ArrayType(t)) for n, t in shape])
    singles = T.StructType([T.StructField(n, t) for n, t in shape if n != BLOCK])
    by = [f"__o{i}" for i in range(len(order))]
    partial = flat.mapInArrow(_reducer(len(sums), by, split_rows, False), lists)
    reduced = partial.repartition(BLOCK).sortWithinPartitions(BLOCK).mapInArrow(_reducer(len(sums), by, split_rows, True), singles)
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return reduced.select(
        F.col(KEY).alias(key_alias),
        F.col(COUNT).alias("n"),
        *(F.when(F.col(f"__v{i}") > 0, F.col(f"__s{i}")).cast("long" if isinstance(kinds[c], whole) else "double").alias(f"sum_{c}") for i, c in enumerate(sums)),
        *(F.col(f"__o{order.index(c)}").alias(f"latest_{c}") for c in latest_row),
    )


def hot_keys(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """The non-null values of ``key`` that hold at least ``share`` of all rows: ``key_value``, ``n``.

    Rows with a null key count among all rows; a value at exactly the share is in. An empty table gives no row.
    """
    stats = dense_key_stats(df, key)
    # the same partial arrays, whose shuffle both uses read: the table is scanned once
    total = stats.agg(F.sum("n").alias("n"))
    return stats.filter(F.col("key_value").isNotNull() & (F.col("n") >= F.lit(share * (1 - 1e-12)) * total.scalar()))
