"""Sizes of texts in tokens of a public byte-level BPE vocabulary, counted in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the rank file lies on every machine; a parameter of all operators that count tokens.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern, which splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(ranks_path: str = RANKS):
    """The encoder; a task loads it once."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, keep: Sequence[str], count_as: str = "n_tokens", ranks_path: str = RANKS) -> DataFrame:
    """The columns ``keep`` and ``count_as``, the number of ids of the whole ``text``; null and empty texts have 0.

    Only the named columns are read, and texts never cross a shuffle.
    """
    kept = [f"__k{i}" for i in range(len(keep))]
    src = df.select(*(df[c].alias(k) for c, k in zip(keep, kept)), df[text].alias("__text"))
    schema = T.StructType([f for f in src.schema.fields if f.name != "__text"] + [T.StructField("__n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path).encode_ordinary
        for b in batches:
            n = [len(enc(t)) if t else 0 for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(n, pa.int64())], names=[*kept, "__n"])

    return src.mapInArrow(run, schema).toDF(*keep, count_as)
