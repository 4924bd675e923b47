"""Batch inference over long sequences, in windows with look-ahead, by any encoder that a task loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encoder = Callable[[Sequence[str]], np.ndarray]


def windows(n: int, size: int, ahead: int) -> list[tuple[int, int, int]]:
    """``(start, stop, seen)`` of each window of ``size`` items; it sees up to ``ahead`` items more, whose results are dropped."""
    return [(a, min(a + size, n), min(a + size + ahead, n)) for a in range(0, n, size)]


def encode_sequences(df: DataFrame, keys: list[str], items: str, load: Callable[[], Encoder], size: int = 500, ahead: int = 20) -> DataFrame:
    """``keys.., position, vector`` of every item of an array column.

    ``load()`` gives the encoder, a function from texts to one row of numbers each; it runs once a task. A sequence is encoded in windows of
    ``size`` items that see ``ahead`` more, and each window's result is cut to its own items. Null and empty sequences have no row; a null item is
    an empty text. A sequence is one row and is never shuffled.
    """
    fields = [df.schema[k] for k in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "position int", "vector array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for b in batches:
            for row in b.itertuples(index=False):
                texts = row[-1]
                if texts is None or not len(texts):
                    continue
                encode = encode or load()
                texts = ["" if t is None else t for t in texts]
                parts = [np.asarray(encode(texts[a:seen]), float)[: z - a] for a, z, seen in windows(len(texts), size, ahead)]
                out = np.concatenate(parts)
                frame = pd.DataFrame({k: [v] * len(out) for k, v in zip(keys, row)}, columns=keys)
                yield frame.assign(position=np.arange(len(out), dtype=np.int32), vector=list(out))

    return df.select(*keys, items).mapInPandas(run, schema)
