"""Confusion counts and what follows from them; every 0/0 is 0.0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def counts(expected: str = "expected", predicted: str = "predicted", weight: Column | None = None) -> list[Column]:
    """Aggregates ``tp, fp, fn, tn``; nulls count as false."""
    e, p = F.coalesce(F.col(expected), F.lit(False)), F.coalesce(F.col(predicted), F.lit(False))
    return [F.count_if(c).alias(n) for n, c in (("tp", e & p), ("fp", ~e & p), ("fn", e & ~p), ("tn", ~e & ~p))]


def metrics(df: DataFrame) -> DataFrame:
    """``evaluated, accuracy, precision, recall, specificity, f1, balanced_accuracy, mcc, prevalence`` from ``tp, fp, fn, tn``, rounded to 6."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    rec, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    out = {
        "accuracy": ratio(tp + tn, n), "precision": ratio(tp, tp + fp), "recall": rec, "specificity": spec, "f1": ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (rec + spec) / 2,
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "prevalence": ratio(tp + fn, n),
    }
    return df.withColumns({"evaluated": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), **{k: F.round(v, 6) for k, v in out.items()}})


def f1_metrics(df: DataFrame) -> DataFrame:
    """``precision, recall, f1`` from ``tp, fp, fn``."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return df.withColumns({"precision": F.round(ratio(tp, tp + fp), 6), "recall": F.round(ratio(tp, tp + fn), 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)})


def grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping grouping sets in one pass: ALL, and each value of each key: ``scope, value`` and metrics."""
    sets = [[], *([k] for k in keys)]
    agg = df.groupingSets(sets, *keys).agg(*counts(), F.grouping_id().alias("__id"))
    bit = {k: (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    scope = reduce(lambda acc, k: acc.when(F.col("__id") == bit[k], k), keys, F.when(F.lit(False), "")).otherwise("ALL")
    value = reduce(lambda acc, k: acc.when(F.col("__id") == bit[k], F.col(k)), keys, F.when(F.lit(False), "")).otherwise("ALL")
    return metrics(agg.select(scope.alias("scope"), value.alias("value"), "tp", "fp", "fn", "tn"))


def with_all(df: DataFrame, key: str, sub: str) -> DataFrame:
    """Metrics by (key, sub), and by key with sub ``ALL``."""
    agg = df.groupingSets([[key, sub], [key]], key, sub).agg(*counts(), F.grouping(sub).alias("__all"))
    return metrics(agg.select(key, F.when(F.col("__all") == 1, "ALL").otherwise(F.col(sub)).alias(sub), "tp", "fp", "fn", "tn"))


#: The rates whose plain mean over groups is reported.
MACRO = ("accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy")


def pooled_and_macro(df: DataFrame, key: str) -> DataFrame:
    """One row with pooled counts and metrics, and the plain mean over groups of six rates (``MACRO``)."""
    by = metrics(df.groupBy(key).agg(*counts()))
    pooled = by.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")), *(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in MACRO), F.count(F.lit(1)).alias("groups"))
    return metrics(pooled)


def cu_metrics(predicted: DataFrame, expected: DataFrame, candidates: DataFrame, keys: list[str], cu: str = "cu", unit_keys: list[str] | None = None) -> DataFrame:
    """One row ``cu_evaluated_pairs, cu_tp, cu_fp, cu_fn, cu_precision, cu_recall, cu_f1`` of unit identities; there is no tn.

    ``candidates(keys.., expected, labelled)`` are the pairs of case and candidate: one that is expected but has no labelled units is left
    out, all units predicted for one that is not expected are false. ``predicted`` is ``(keys.., cu)``, ``expected`` is ``(unit_keys.., cu)``:
    its units hold for every pair with these of the ``keys`` (all of them by default). They are counted and never written out by pair, whose
    number times that of the units may be far more than either table has. Pairs with a null key are evaluated, but match nothing.
    """
    on = unit_keys or keys
    yes, known = F.coalesce("expected", F.lit(False)), reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    pairs = candidates.filter(~yes | F.coalesce("labelled", F.lit(False))).groupBy(*keys).agg(F.max(yes.cast("int")).alias("__e"), F.max((~yes).cast("int")).alias("__o"))
    units = expected.select(*on, cu).distinct()
    said = predicted.select(*keys, cu).distinct().join(units.withColumn("__t", F.lit(1)), [*on, cu], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("__p"), F.count("__t").alias("__h"))
    by = pairs.join(said, keys, "left").groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.when(known, F.col("__e"))).alias("__e"), F.sum(F.col("__e") * F.col("__h")).alias("__h"), F.sum((F.col("__e") + F.col("__o")) * F.col("__p")).alias("__p"))
    full = by.join(units.groupBy(*on).agg(F.count(F.lit(1)).alias("__u")), on, "left")
    n, e, h, p = (F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("__n"), F.col("__e") * F.col("__u"), F.col("__h"), F.col("__p")))
    c = full.agg(n.alias("cu_evaluated_pairs"), h.alias("cu_tp"), (p - h).alias("cu_fp"), (e - h).alias("cu_fn"))
    tp, fp, fn = (F.col(x).cast("double") for x in ("cu_tp", "cu_fp", "cu_fn"))
    return c.withColumns({"cu_precision": F.round(ratio(tp, tp + fp), 6), "cu_recall": F.round(ratio(tp, tp + fn), 6), "cu_f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)})


def evaluated(decisions: DataFrame, case: str, family: Column, exact: bool = False) -> DataFrame:
    """Counts and metrics over families of builds, of which one expected or predicted build is enough; with ``exact`` over single builds."""
    rows = decisions if exact else decisions.withColumn("__f", family).groupBy(case, "__f").agg(F.coalesce(F.bool_or("expected"), F.lit(False)).alias("expected"), F.coalesce(F.bool_or("predicted"), F.lit(False)).alias("predicted"))
    return metrics(rows.agg(*counts()))


def folds(df: DataFrame, fold: Column) -> DataFrame:
    """Cross-validation summary: mean and population deviation of the folds' f1, and the pooled f1."""
    by = metrics(df.groupBy(fold.alias("fold")).agg(*counts()))
    out = by.agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.stddev_pop("f1"), 6).alias("std_f1"), F.count(F.lit(1)).alias("folds"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return out.withColumn("pooled_f1", F.round(ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)).drop("tp", "fp", "fn")


def set_classification(predicted: DataFrame, expected: DataFrame, universe: DataFrame, keys: list[str], case: str) -> DataFrame:
    """tp, fp, fn as set operations, tn over (universe and expected) without both; per case."""
    p = predicted.select(case, *keys).distinct().withColumn("predicted", F.lit(True))
    e = expected.select(case, *keys).distinct().withColumn("expected", F.lit(True))
    u = universe.select(case, *keys).distinct()
    full = u.join(e, [case, *keys], "full").join(p, [case, *keys], "full")
    return f1_metrics(full.groupBy(case).agg(*counts()))


def delta(df: DataFrame, config: str, baseline: str, metric: str) -> DataFrame:
    """Each configuration's distance from the baseline row, which is one row."""
    base = df.filter(F.col(config) == baseline).agg(F.max(metric)).scalar()
    return df.withColumn(f"delta_{metric}", F.round(F.col(metric) - base, 6))
