"""Parameter search: the driver proposes, Spark replays every proposal of a step in one job."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Params = dict[str, float]


def config_table(spark: SparkSession, trials: Sequence[Mapping[str, float]]) -> DataFrame:
    """``config`` (the trial's place) and a column for each parameter."""
    names = sorted(trials[0])
    return spark.createDataFrame([(str(i), *(float(t[n]) for n in names)) for i, t in enumerate(trials)], "config string, " + ", ".join(f"`{n}` double" for n in names)).coalesce(1)


def _evaluate(spark: SparkSession, trials: list[Params], score: Callable[[DataFrame], DataFrame], known: dict) -> list[float]:
    """The score of each trial; those not met before are replayed together."""
    key = lambda t: tuple(sorted(t.items()))
    fresh = list({key(t): t for t in trials if key(t) not in known}.values())
    if fresh:
        from lodestone.operators.records import with_defaults

        # one row a trial comes back
        got = {r[0]: r[1] for r in score(with_defaults(config_table(spark, fresh))).collect()}
        known.update({key(t): float(got.get(str(i)) or 0.0) for i, t in enumerate(fresh)})
    return [known[key(t)] for t in trials]


def greedy_on_spark(spark: SparkSession, start: Params, grid: Mapping[str, Sequence[float]], score: Callable[[DataFrame], DataFrame], rounds: int = 5, restarts: int = 1, seed: int = 0) -> tuple[Params, list[dict]]:
    """Coordinate search: parameters in grid order, each moved to its best value where that is strictly better, until a round changes nothing.

    ``score(configs)`` gives ``(config, score)`` of a table of parameter rows; all values of a parameter are one such table. The first
    restart begins at ``start``, each other at seeded random values; a later one must be strictly better to win.
    Returns the best parameters and the history ``step, parameter, value, f1``.
    """
    rng, known, history = random.Random(seed), {}, []
    best, top = dict(start), -math.inf
    for restart in range(max(1, restarts)):
        now = dict(start) if restart == 0 else {**start, **{k: rng.choice(list(v)) for k, v in grid.items()}}
        have = _evaluate(spark, [now], score, known)[0]
        for _ in range(rounds):
            moved = False
            for name, values in grid.items():
                trials = [{**now, name: v} for v in values]
                scores = _evaluate(spark, trials, score, known)
                history += [{"step": len(history) + i, "parameter": name, "value": v, "f1": s} for i, (v, s) in enumerate(zip(values, scores))]
                chosen = max(range(len(trials)), key=lambda i: (scores[i], -i))
                if scores[chosen] > have:
                    moved |= trials[chosen] != now
                    now, have = trials[chosen], scores[chosen]
            if not moved:
                break
        if have > top:
            best, top = now, have
    return best, history


def parzen_search(grid: Mapping[str, Sequence[float]], score: Callable[[list[Params]], list[float]], trials: int, startup: int = 50, batch: int = 8, gamma: float = 0.25, candidates: int = 24, seed: int = 0, seen: Sequence[tuple[Params, float]] = ()) -> tuple[Params, float]:
    """Tree-structured Parzen search over a grid of values: seeded random trials first, then batches that the better trials favour.

    For each parameter the ``gamma`` best trials and the others give two smoothed densities over its values; of ``candidates`` draws from the
    better ones' density that with the largest ratio of both is tried. ``score`` takes a batch, so a batch is one replay.
    The first best trial wins. ``seen`` trials of an earlier run count and are not tried again.
    """
    seen = list(seen)
    rng = random.Random(f"{seed}:{len(seen)}")

    def density(rows: list[Params], name: str) -> list[float]:
        values = list(grid[name])
        weight = [1.0 + sum(r[name] == v for r in rows) for v in values]
        return [w / sum(weight) for w in weight]

    while len(seen) < trials:
        todo = min(batch, trials - len(seen), max(1, startup - len(seen)) if len(seen) < startup else batch)
        ask = []
        for _ in range(todo):
            if len(seen) < startup:
                ask.append({k: rng.choice(list(v)) for k, v in grid.items()})
                continue
            ranked = [p for p, _ in sorted(seen, key=lambda x: -x[1])]
            cut = max(1, math.ceil(gamma * len(ranked)))
            good, bad = ({k: density(part, k) for k in grid} for part in (ranked[:cut], ranked[cut:]))
            drawn = [{k: rng.choices(list(v), good[k])[0] for k, v in grid.items()} for _ in range(candidates)]
            gain = lambda p: sum(math.log(good[k][list(v).index(p[k])] / bad[k][list(v).index(p[k])]) for k, v in grid.items())
            ask.append(max(drawn, key=gain))
        seen += list(zip(ask, score(ask)))
    return max(seen, key=lambda x: x[1])


def trial_table(spark: SparkSession, path: str, study: str) -> DataFrame:
    """The trials of a study that were kept below ``path``: ``study, trial, params, score``; empty before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "study string, trial long, params string, score double")
    return spark.read.schema("study string, trial long, params string, score double").parquet(path).filter(F.col("study") == study)


def keep_trials(spark: SparkSession, path: str, study: str, rows: Sequence[tuple[int, Params, float]]) -> None:
    """Add finished trials to a study; each call is one atomic append."""
    import json

    spark.createDataFrame([(study, i, json.dumps(p, sort_keys=True), float(s)) for i, p, s in rows], "study string, trial long, params string, score double").coalesce(1).write.mode("append").parquet(path)


def tuned(spark: SparkSession, path: str, study: str, grid: Mapping[str, Sequence[float]], folds: Callable[[list[Params]], list[Sequence[float]]], held_out: Callable[[Params], float], trials: int, batch: int = 8, **how) -> tuple[Params, float, float]:
    """Tune by the mean over folds, keep every trial below ``path``, and judge the winner once on what was held out: ``(params, mean, held-out score)``.

    ``folds`` gives each trial's scores by fold. A study that was broken off goes on from the trials it kept.
    """
    import json

    # a study's trials are its own bounded history
    kept = [(json.loads(r.params), r.score) for r in trial_table(spark, path, study).orderBy("trial").collect()]

    def score(ask: list[Params]) -> list[float]:
        means = [sum(s) / max(len(s), 1) for s in folds(ask)]
        keep_trials(spark, path, study, [(len(kept) + i, p, m) for i, (p, m) in enumerate(zip(ask, means))])
        kept.extend(zip(ask, means))
        return means

    best, top = parzen_search(grid, score, trials, batch=batch, seen=list(kept), **how)
    return best, top, held_out(best)
