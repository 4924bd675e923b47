"""Selections and plans: balanced folds, covering cases, archive pools, version plans."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_key(cases: np.ndarray, positive: np.ndarray, negative: np.ndarray, families: np.ndarray, fold: np.ndarray, n_folds: int) -> tuple:
    """What tells a good assignment of groups to folds, greatest first: every fold and its rest have both labels; the least positives and
    families of a fold; the spread of positives and of cases."""
    pos, neg, size = (np.bincount(fold, weights=x, minlength=n_folds) for x in (positive, negative, cases))
    usable = bool((pos > 0).all() and (neg > 0).all() and (positive.sum() - pos > 0).all() and (negative.sum() - neg > 0).all())
    seen = np.array([families[fold == f].any(0).sum() for f in range(n_folds)])
    return usable, pos.min(), int(seen.min()), -(pos.max() - pos.min()), -(size.max() - size.min())


def balanced_folds(labels: DataFrame, group: str, n_folds: int, seed: int = 0, attempts: int = 256, most_groups: int = 100_000) -> DataFrame:
    """``group, cases, fold``: groups are never split; the best of at least ``attempts`` seeded deals by ``fold_key`` wins, the first of equals.

    ``labels(group, cases, positive, negative, families)`` has a row for each group, a table of at most ``most_groups`` rows that one task reads
    (more are an error). A deal shuffles the groups and puts each into one of the smallest folds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_groups:
            raise ValueError(f"{len(pdf)} groups are more than {most_groups}")
        pdf = pdf.sort_values(group, ignore_index=True)
        k = min(n_folds, len(pdf))
        names = sorted({f for fs in pdf.families for f in fs})
        fams = np.array([[n in set(fs) for n in names] for fs in pdf.families], bool).reshape(len(pdf), len(names))
        cases, pos, neg = (pdf[c].to_numpy(np.int64) for c in ("cases", "positive", "negative"))
        rng, best, top = random.Random(f"{seed}:folds"), None, None
        for _ in range(max(attempts, 1)):
            order, sizes, fold = list(range(len(pdf))), [0] * k, np.zeros(len(pdf), np.int64)
            rng.shuffle(order)
            for place, g in enumerate(order):
                low = min(sizes)
                f = place if place < k else rng.choice([i for i, s in enumerate(sizes) if s == low])
                fold[g] = f
                sizes[f] += int(cases[g])
            key = fold_key(cases, pos, neg, fams, fold, k)
            if top is None or key > top:
                best, top = fold, key
        return pd.DataFrame({group: pdf[group], "cases": cases, "fold": best.astype(np.int32)})

    kind = labels.schema[group].dataType.simpleString()
    return labels.select(group, "cases", "positive", "negative", "families").groupBy(F.lit(1).alias("one")).applyInPandas(run, f"`{group}` {kind}, cases bigint, fold int")


def covering_cases(labels: DataFrame, group: str, case: str, label: str) -> DataFrame:
    """``group, case, place``: of each group a small set of cases that together have all its labels.

    While labels are uncovered, the rarest (by cases, then by name) is covered by the case that covers most of what is left, ties to the
    smallest case. A group's distinct (case, label) pairs meet in one task, so a group should be one split's or panel's table.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by_case = pdf.groupby(case)[label].agg(set).to_dict()
        rare = sorted(pdf.groupby(label).size().items(), key=lambda x: (x[1], x[0]))
        holders = pdf.groupby(label)[case].agg(sorted).to_dict()
        left, chosen = set(holders), []
        for name, _ in rare:
            if name in left:
                pick = min(holders[name], key=lambda c: (-len(by_case[c] & left), c))
                chosen.append(pick)
                left -= by_case[pick]
        return pd.DataFrame({group: pdf[group].iloc[0], case: chosen, "place": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    rows = labels.select(group, case, label).dropna().distinct()
    t = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(group).applyInPandas(run, f"`{group}` {t[group]}, `{case}` {t[case]}, place int")


def quota_cases(cases: DataFrame, strata: Sequence[str], quota: int, key: str, seed: str = "quota") -> DataFrame:
    """At most ``quota`` cases of each combination of ``strata``, those first by digest: the same on every run, whatever the order."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key))
    return cases.withColumn("__r", rank).filter(F.col("__r") <= quota).drop("__r")


def archive_pools(linked: DataFrame, scored: DataFrame, catalog: DataFrame, hard: int = 1, least_builds: int = 2) -> DataFrame:
    """``archive, pool``: ``positive`` archives that a case links; of each case the ``hard`` best-scoring archives it does not link (``hard_negative``);
    and ``diverse`` ones with at least ``least_builds`` versions, compilers or optimizations. An archive may be in several pools.

    ``linked(case, archive)``, ``scored(case, archive, score)``, ``catalog(archive, role, compiler, optimization)``.
    """
    pos = linked.select("archive").distinct()
    wrong = scored.filter("score is not null").join(linked.select("case", "archive").distinct(), ["case", "archive"], "left_anti")
    top = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("score"), "archive"))
    neg = wrong.groupBy("case", "archive").agg(F.max("score").alias("score")).withColumn("__r", top).filter(F.col("__r") <= hard).select("archive").distinct()
    wide = catalog.groupBy("archive").agg(*(F.countDistinct(c).alias(c) for c in ("role", "compiler", "optimization")))
    div = wide.filter(F.greatest("role", "compiler", "optimization") >= least_builds).select("archive")
    parts = [df.filter("archive is not null").withColumn("pool", F.lit(n)) for df, n in ((pos, "positive"), (neg, "hard_negative"), (div, "diverse"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def version_plan(slots: DataFrame, versions: DataFrame, library: str, slot: str, version: str, seed: str = "versions") -> DataFrame:
    """``library, slot, version``: every slot of a library gets the version used least so far, ties by digest, so counts differ by one at most.

    Slots are taken in digest order. This is sequential for a library, so it runs as one group each; a library's slots are the programs that may link it.
    """
    digest = lambda *p: hashlib.sha256(":".join(map(str, (seed, *p))).encode()).hexdigest()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        options = sorted(right[version].unique())
        used, out = dict.fromkeys(options, 0), []
        for s in sorted(left[slot].unique(), key=lambda s: (digest(key[0], s), s)):
            if options:
                v = min(options, key=lambda o: (used[o], digest(key[0], s, o)))
                used[v] += 1
                out.append((key[0], s, v))
        return pd.DataFrame(out, columns=[library, slot, version])

    a, b = slots.select(library, slot).dropna().distinct(), versions.select(library, version).dropna().distinct()
    t = {f.name: f.dataType.simpleString() for f in [*a.schema.fields, *b.schema.fields]}
    return a.groupBy(library).cogroup(b.groupBy(library)).applyInPandas(run, f"`{library}` {t[library]}, `{slot}` {t[slot]}, `{version}` {t[version]}")


def diversity(builds: DataFrame, archive: str, needs: Mapping[str, int], digest: Column | None = None) -> DataFrame:
    """``archive``, the distinct values of each column of ``needs``, ``enough`` (all reach their need) and ``ambiguous`` (one exact build with several contents)."""
    g = builds.groupBy(archive).agg(*(F.countDistinct(c).alias(f"n_{c}") for c in needs))
    enough = F.lit(True)
    for c, n in needs.items():
        enough = enough & (F.col(f"n_{c}") >= n)
    g = g.withColumn("enough", enough)
    if digest is None:
        return g
    exact = builds.groupBy(archive, *needs).agg(F.countDistinct(digest).alias("__d"))
    return g.join(exact.groupBy(archive).agg((F.max("__d") > 1).alias("ambiguous")), archive, "left")


def source_matches(members: DataFrame, sources: DataFrame, keys: Sequence[str], stem: str, digest: str) -> DataFrame:
    """Every member with the sources of its stem: ``keys.., stem, sources, contents, status``: ``mapped`` to one content, ``ambiguous`` among several, or ``unmapped``.

    ``sources(stem, digest)``; the join is by stem, so a stem that many sources share is one row of counts.
    """
    s = sources.groupBy(stem).agg(F.count(F.lit(1)).alias("sources"), F.countDistinct(digest).alias("contents"))
    j = members.select(*keys, stem).distinct().join(s, stem, "left").fillna(0, ["sources", "contents"])
    return j.withColumn("status", F.when(F.col("contents") == 0, "unmapped").when(F.col("contents") == 1, "mapped").otherwise("ambiguous"))
