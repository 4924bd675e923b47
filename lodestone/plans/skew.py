"""Joins and orderings that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all shuffle partitions, for rows that cost far more than their few bytes tell: they must not be merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast, its rows counted first: more than ``most`` are an error. For tables of settings and coordinates."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows in a table that is to be broadcast")
    return F.broadcast(df)


def heavy_part(counts: DataFrame, weight: str, share: float) -> DataFrame:
    """The rows of ``counts`` with at least ``share`` of the sum of ``weight``: ``1 / share`` rows at most, whatever the data."""
    return counts.filter(F.col(weight) >= F.lit(share) * counts.agg(F.sum(weight)).scalar())


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, share: float = 0.001) -> DataFrame:
    """Inner join with a table that has each ``key`` once and in ``weight`` how many rows of ``left`` have it.

    Rows with a heavy key meet a broadcast of at most ``1 / share`` rows, all others a shuffle in
    which no key has more than ``share`` of the rows. ``weight`` is dropped. Null keys match nothing.
    """
    heavy = heavy_part(right, weight, share)
    names = F.broadcast(heavy.select(key))
    rest = left.join(names, key, "left_anti").join(right.join(names, key, "left_anti").drop(weight), key)
    return left.join(F.broadcast(heavy.drop(weight)), key).unionByName(rest)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], share: float = 0.001, salts: int = 32) -> DataFrame:
    """Inner join in which keys that hold ``share`` of the rows of ``right`` are split over ``salts`` tasks.

    At most ``1 / share`` keys are heavy, and their list is broadcast; their rows of ``left`` are repeated for each
    salt, all others are joined once. Both sides should be written tables, as each is read twice. Null keys match nothing.
    """
    keys = list(keys)
    counts = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    heavy = F.broadcast(heavy_part(counts, "__n", share).select(*keys, F.lit(True).alias("__hot")))
    own = F.pmod(F.xxhash64(*right.columns), F.lit(salts)).cast("int")
    r = right.join(heavy, keys, "left").withColumn("__salt", F.when(F.col("__hot"), own).otherwise(0)).drop("__hot")
    each = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    l = left.join(heavy, keys, "left").withColumn("__salt", F.explode(each)).drop("__hot")
    return l.join(r, [*keys, "__salt"]).drop("__salt")
