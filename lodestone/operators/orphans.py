"""References to records that do not exist at the time of the reference.

Method: skew-aware split. References are pre-aggregated per key and period, the few heavy keys
(whose number is bounded by ``1 / heavy_share``) are checked against a broadcast of their own
catalog rows, all other keys by a shuffle anti-join, and both results are united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.session import written


def reference_name(basename: str, path: str) -> Column:
    """The name a reference gives: ``basename`` without outer blanks or, if null or blank, what follows the last ``/`` of ``path``; null if that is blank too."""
    own, tail = F.trim(F.col(basename)), F.trim(F.substring_index(F.col(path), "/", -1))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(tail, F.lit("")))


def validity(catalog: DataFrame, key: Column, start: str, end: str, keep: Column) -> DataFrame:
    """The lifetimes ``ref_key, valid_from, valid_to`` of the catalog's kept rows; a null ``valid_to`` is open.

    A row with a null key, or null or empty lifetime start, is never valid.
    """
    return catalog.filter(keep).select(key.alias("ref_key"), F.col(start).alias("valid_from"), F.col(end).alias("valid_to")).filter("ref_key is not null and valid_from is not null and (valid_to is null or valid_to > valid_from)").distinct()


def _covers(low: str, high: str) -> Column:
    return (F.col("valid_from") <= F.col(low)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(high)))


def _merged(catalog: DataFrame) -> DataFrame:
    """Lifetimes without those that begin and end within another that begins at the same time: one row a key and start."""
    open_end = F.bool_or(F.col("valid_to").isNull())
    return catalog.groupBy("ref_key", "valid_from").agg(F.when(~open_end, F.max("valid_to")).alias("valid_to"))


def orphan_rows(references: DataFrame, catalog: DataFrame, heavy_share: float = 0.001, most_broadcast: int = 1_000_000, salts: int = 64) -> DataFrame:
    """The rows of ``references(table_name, row_id, ref_key, ref_time)`` without a valid catalog row.

    ``catalog`` has ``ref_key, valid_from, valid_to`` (see ``validity``). Returns the columns of
    ``references`` and ``period`` (the month), one row per table and row id. References without
    key or time are no cases. Either table may be empty: no references give no row, an empty
    catalog makes every reference an orphan. Of a repeated row id that differs the earliest by time and key counts.
    The lifetimes of the heavy keys are counted: up to ``most_broadcast`` rows are broadcast, more are salted
    over ``salts`` parts of each heavy key.
    """
    refs = references.select("table_name", "row_id", "ref_key", "ref_time", F.date_format("ref_time", "yyyy-MM").alias("period")).filter("ref_key is not null and ref_time is not null")
    groups = written(refs.groupBy("ref_key", "period").agg(F.count(F.lit(1)).alias("n"), F.min("ref_time").alias("low"), F.max("ref_time").alias("high")), "orphan-groups")
    totals = groups.groupBy("ref_key").agg(F.sum("n").alias("n"))
    # at most 1 / heavy_share keys can be heavy, so this side is safe to broadcast
    heavy = F.broadcast(written(totals.filter(F.col("n") >= F.lit(heavy_share) * groups.agg(F.sum("n")).scalar()).select("ref_key"), "orphan-heavy"))
    lifetimes = _merged(catalog)
    lifetimes_heavy = written(lifetimes.join(heavy, "ref_key", "left_semi"), "orphan-lifetimes")
    small = lifetimes_heavy.limit(most_broadcast + 1).count() <= most_broadcast
    lifetimes_rest = lifetimes.join(heavy, "ref_key", "left_anti")

    def uncovered(part: DataFrame, lives: DataFrame, low: str, high: str, hot: bool) -> DataFrame:
        lives = lives.withColumnRenamed("ref_key", "cat_key")
        on = (F.col("ref_key") == F.col("cat_key")) & _covers(low, high)
        if not hot:
            return part.join(lives, on, "left_anti")
        if small:
            return part.join(F.broadcast(lives), on, "left_anti")
        salted = part.withColumn("__s", F.pmod(F.xxhash64(*part.columns), F.lit(salts)))
        lives = lives.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return salted.join(lives, on & (F.col("__s") == F.col("__t")), "left_anti").drop("__s")

    # a group one lifetime covers whole needs no look at its rows
    open_heavy = uncovered(groups.join(heavy, "ref_key", "left_semi"), lifetimes_heavy, "low", "high", True).select("ref_key", "period")
    open_rest = uncovered(groups.join(heavy, "ref_key", "left_anti"), lifetimes_rest, "low", "high", False).select("ref_key", "period")
    # heavy keys have (keys x months) groups at most; the rest goes through a shuffle unless AQE measures it small
    of_heavy = uncovered(refs.join(F.broadcast(open_heavy), ["ref_key", "period"], "left_semi"), lifetimes_heavy, "ref_time", "ref_time", True)
    of_rest = uncovered(refs.join(open_rest, ["ref_key", "period"], "left_semi"), lifetimes_rest, "ref_time", "ref_time", False)
    found = of_heavy.unionByName(of_rest).groupBy("table_name", "row_id").agg(F.min(F.struct("ref_time", "ref_key", "period")).alias("r"))
    return found.select("table_name", "row_id", "r.ref_key", "r.ref_time", "r.period")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table and period: ``table_name, period, n_orphans, n_keys``."""
    return orphans.groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("ref_key").alias("n_keys"))


def archive_references(elf_archives: DataFrame, archive_members: DataFrame) -> DataFrame:
    """Both reference tables in the form ``orphan_rows`` takes."""
    parts = [
        t.select(F.lit(name).alias("table_name"), F.col(i).alias("row_id"), reference_name("archive_basename", "archive").alias("ref_key"), F.col(at).alias("ref_time"))
        for t, name, i, at in ((elf_archives, "elf_archives", "ref_id", "linked_at"), (archive_members, "archive_members", "member_id", "extracted_at"))
    ]
    return reduce(DataFrame.unionByName, parts)
