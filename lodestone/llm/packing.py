"""Filling containers of fixed capacity with items that are cut only if they alone exceed it.

Method: bounded-space online best-fit. Each task keeps a fixed number of open containers in a bitset
keyed by free space; an item goes where least space is left, and when too many are open the fullest
closes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class OpenBins:
    """Open containers by free space: a bitset of the spaces that occur, and the containers of each."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = self.count = 0
        self.at: dict[int, list[list]] = {}

    def _put(self, free: int, rows: list) -> None:
        self.at.setdefault(free, []).append(rows)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> list:
        rows = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return rows

    def add(self, size: int, item) -> Iterator[tuple[list, int]]:
        """Place an item; yields each container that closes, with its free space."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            rows = self._take(free)
        else:
            free, rows = self.capacity, []
        rows.append(item)
        if free == size:
            yield rows, 0
            return
        self._put(free - size, rows)
        if self.count > self.most:
            free = (self.bits & -self.bits).bit_length() - 1
            yield self._take(free), free

    def close(self) -> Iterator[tuple[list, int]]:
        for free in sorted(self.at):
            for rows in self.at[free]:
                yield rows, free


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int = 2048, open_bins: int = 64) -> DataFrame:
    """Containers of the items ``sizes(id, size)``.

    Returns ``container_id, item_id, piece_no, start, end`` (the item's units in this piece), ``size``
    and ``fill`` (units used in the container). An item above ``capacity`` is cut into full pieces and
    a rest; no other item is cut. Items of size 0 or null take no space and lie in an open container.
    Null ids are items like any other. Items are spread by hash, so neither order nor file layout
    matters, and within a task they come in hash order, so a task run again makes the same containers; each task leaves ``open_bins`` containers part-filled at most. Repeated rows are
    separate items. An empty table gives no container.
    """
    src = sizes.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    src = src.repartition("item_id", "size").sortWithinPartitions(F.xxhash64("item_id"), "item_id", "size")
    kind = src.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        made = 0
        bins = OpenBins(capacity, open_bins)
        held: list[tuple] = []
        of = None

        def note(rows: list, free: int) -> None:
            nonlocal made
            held.extend((task + made, *r, capacity - free) for r in rows)
            made += 1

        def flush() -> pa.RecordBatch:
            c, i, p, a, z, f = zip(*held)
            held.clear()
            start, end = np.array(a, np.int64), np.array(z, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(i, of), pa.array(p, pa.int32()), pa.array(start), pa.array(end), pa.array(end - start), pa.array(f, pa.int64())], names=["container_id", "item_id", "piece_no", "start", "end", "size", "fill"])

        for b in batches:
            of = b.column("item_id").type
            for item, size in zip(b.column("item_id").to_pylist(), b.column("size").to_pylist()):
                cuts = range(0, size, capacity) if size > capacity else (0,)
                for k, at in enumerate(cuts):
                    end = min(at + capacity, size)
                    for done in bins.add(end - at, (item, k, at, end)):
                        note(*done)
                if len(held) > 10_000:
                    yield flush()
        for done in bins.close():
            note(*done)
            if len(held) > 10_000:
                yield flush()
        if held:
            yield flush()

    return src.mapInArrow(run, f"container_id bigint, item_id {kind}, piece_no int, start bigint, end bigint, size bigint, fill bigint")
