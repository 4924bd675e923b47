"""Decisions: gates, acceptance, library scores, family roll-ups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATORS = ("mean", "max", "top3_mean", "top3_noisy_or")


def passes(gates: Mapping[str, float | Column]) -> Column:
    """All metrics reach their gates; a null metric does not."""
    out = F.lit(True)
    for metric, gate in gates.items():
        out = out & F.coalesce(F.col(metric) >= gate, F.lit(False))
    return out


def cu_status(passed: Column, penalised: Column) -> Column:
    """``DROP``, ``DROP_RODATA`` or ``PASS``; constant data is judged only after the gates."""
    return F.when(~F.coalesce(passed, F.lit(False)), "DROP").when(F.coalesce(penalised, F.lit(False)), "DROP_RODATA").otherwise("PASS")


def library_score(scores: Column, mode: str, floor: float = 0.0) -> Column:
    """One score from an array of scores; 0.0 for none; an unknown mode is an error."""
    if mode not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {mode!r}")
    s = F.filter(scores, lambda x: x.isNotNull())
    n = F.size(s)
    top = F.slice(F.sort_array(s, asc=False), 1, 3)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    span = max(1e-12, 1.0 - floor)
    odds = F.aggregate(top, F.lit(1.0), lambda acc, x: acc * (1.0 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - floor) / span))))
    value = {"mean": total(s) / n, "max": F.array_max(s), "top3_mean": total(top) / F.least(n, F.lit(3)), "top3_noisy_or": 1.0 - odds}[mode]
    return F.when(n == 0, F.lit(0.0)).otherwise(value)


def top_scores(df: DataFrame, keys: list[str], score: Column, k: int = 3) -> DataFrame:
    """The ``k`` best scores a group as an array, without ever collecting a group: partial top-k, then one array."""
    from pyspark.sql import Window

    ranked = df.select(*keys, score.alias("__s")).filter("__s is not null").withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__s")))).filter(F.col("__r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("__s"), asc=False).alias("scores"))


def library_evidence(records: DataFrame, keys: list[str], score: str, passed: str, penalised: str, mode: str = "top3_mean", floor: float = 0.0) -> DataFrame:
    """Accepted units and the score of each library.

    For ``top3_mean`` a unit that passed but is penalised counts as 0.0, so a rejection cannot raise
    the mean; for other modes it is left out. ``mean`` and ``max`` are plain aggregates, so no mode collects a group.
    """
    ok = F.coalesce(F.col(passed), F.lit(False))
    pen = F.coalesce(F.col(penalised), F.lit(False))
    value = F.when(ok & ~pen, F.col(score))
    if mode == "top3_mean":
        value = F.when(ok & pen, F.lit(0.0)).otherwise(value)
    counts = records.groupBy(*keys).agg(F.count_if(ok & ~pen).alias("accepted"), F.count_if(ok & pen).alias("penalised"), F.avg(value).alias("__mean"), F.max(value).alias("__max"))
    if mode in ("mean", "max"):
        return counts.select(*keys, "accepted", "penalised", F.coalesce(f"__{mode}", F.lit(0.0)).alias("library_score"))
    tops = top_scores(records, keys, value)
    out = counts.join(tops, keys, "left").withColumn("library_score", F.coalesce(library_score(F.col("scores"), mode, floor), F.lit(0.0)))
    return out.select(*keys, "accepted", "penalised", "library_score")


def family_rollup(decisions: DataFrame, keys: list[str], expected: str, predicted: str) -> DataFrame:
    """Expected and predicted of a family: true if so for any of its builds."""
    return decisions.groupBy(*keys).agg(F.coalesce(F.bool_or(expected), F.lit(False)).alias("expected"), F.coalesce(F.bool_or(predicted), F.lit(False)).alias("predicted"), F.count(F.lit(1)).alias("builds"))


def best_candidate(decisions: DataFrame, keys: list[str], score: str, accepted: str, label: str) -> DataFrame:
    """The candidate of each family that is greatest by score, accepted units and label."""
    return decisions.groupBy(*keys).agg(F.max(F.struct(score, accepted, label)).alias("b")).select(*keys, "b.*")


def detection_outcome(a: Column, b: Column) -> Column:
    """How two pipelines' answers compare; null is a missing answer."""
    return (
        F.when(a.isNull() & b.isNull(), "missing_both").when(a.isNull(), "missing_first").when(b.isNull(), "missing_second")
        .when(a & b, "both").when(a, "first_only").when(b, "second_only").otherwise("neither")
    )


def best_function_hint(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Best function match of each unit: greatest by ratio, mean, hits, then the lowest indices."""
    key = F.struct("dominant_ratio", "coverage_mean", "coverage_ratio", (-F.col("cu_function")).alias("t"), (-F.col("elf_function")).alias("s"))
    return matches.groupBy(*keys).agg(F.max_by(F.struct("cu_function", "elf_function", "dominant_ratio", "coverage_mean", "coverage_ratio"), key).alias("h")).select(*keys, "h.*")
