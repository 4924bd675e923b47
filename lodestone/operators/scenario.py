"""Build-compatibility scenarios between linked archives and candidate builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCENARIOS = ("same_exact_artifact", "same_build_configuration", "cross_optimization_any", "cross_compiler_any", "cross_version_any")
#: Which of (compiler, optimization, role) must differ; the others, and the package, must agree.
DIFFERS = {"same_build_configuration": None, "cross_optimization_any": "optimization", "cross_compiler_any": "compiler", "cross_version_any": "role"}


def compatible(scenario: str, anchor: str = "a", candidate: str = "c") -> Column:
    """Predicate between an anchor and a candidate build; an unknown scenario is an error. Nulls never agree.

    ``same_exact_artifact`` is the anchor's own ``label``, whatever its coordinates.
    """
    if scenario == "same_exact_artifact":
        return F.coalesce(F.col(f"{anchor}.label") == F.col(f"{candidate}.label"), F.lit(False))
    if scenario not in DIFFERS:
        raise ValueError(f"unknown scenario {scenario!r}")
    out = F.col(f"{anchor}.package") == F.col(f"{candidate}.package")
    for dim in ("compiler", "optimization", "role"):
        same = F.col(f"{anchor}.{dim}") == F.col(f"{candidate}.{dim}")
        out = out & (~same if DIFFERS[scenario] == dim else same)
    return out


def scenario_outcomes(anchors: DataFrame, candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row for each scenario, case and expected family: ``outcome`` tp, or fn by ``reason``.

    ``anchors(case, family, label, package, compiler, optimization, role)``: anchors with a null coordinate are
    left out; ``label`` is the very build that was linked, or null. ``candidates(label, family, package, ...)`` is the catalog, ``accepted(case, label)``.
    """
    full = anchors.dropna(subset=["package", "compiler", "optimization", "role"]).distinct()
    grid = full.select("case", "family").distinct().withColumn("scenario", F.explode(F.array(*map(F.lit, SCENARIOS))))
    got = accepted.distinct().withColumn("__got", F.lit(True))
    # the catalog is joined by family and package; which dimension differs decides the scenarios a build serves
    pair = full.alias("a").join(candidates.alias("c"), (F.col("a.family") == F.col("c.family")) & (F.col("a.package") == F.col("c.package")))
    serves = F.filter(F.array(*(F.when(compatible(s), F.lit(s)) for s in SCENARIOS)), lambda s: s.isNotNull())
    options = pair.select("a.case", "a.family", "c.label", F.explode(serves).alias("scenario")).distinct()
    seen = options.join(got, ["case", "label"], "left").groupBy("scenario", "case", "family").agg(F.count(F.lit(1)).alias("options"), F.coalesce(F.bool_or("__got"), F.lit(False)).alias("hit"))
    anywhere = accepted.join(candidates.select("label", "family"), "label").select("case", "family").distinct().withColumn("__any", F.lit(True))
    out = grid.join(seen, ["scenario", "case", "family"], "left").join(anywhere, ["case", "family"], "left")
    reason = F.when(F.col("hit"), "detected").when(F.col("options").isNull(), "unavailable").when(F.col("__any"), "off_scenario_only").otherwise("undetected")
    return out.select("scenario", "case", "family", F.when(F.col("hit"), "tp").otherwise("fn").alias("outcome"), reason.alias("reason"))


def scenario_matrix(outcomes: DataFrame) -> DataFrame:
    """Per scenario: tp, fn, the fn's reasons, and recall strict and over available builds."""
    n = lambda r: F.count_if(F.col("reason") == r)
    agg = outcomes.groupBy("scenario").agg(n("detected").alias("tp"), F.count_if(F.col("outcome") == "fn").alias("fn"), n("unavailable").alias("unavailable"), n("off_scenario_only").alias("off_scenario_only"), n("undetected").alias("undetected"))
    div = lambda a, b: F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 6)
    return agg.withColumns({"recall": div(F.col("tp"), F.col("tp") + F.col("fn")), "recall_available": div(F.col("tp"), F.col("tp") + F.col("fn") - F.col("unavailable"))})


def transitions(anchors: DataFrame, candidates: DataFrame, accepted: DataFrame, dimension: str) -> DataFrame:
    """Directed transitions of one dimension: ``source_value, target_value, positives, detected``."""
    others = [d for d in ("compiler", "optimization", "role") if d != dimension]
    a, c = anchors.dropna(subset=["package", "compiler", "optimization", "role"]).distinct().alias("a"), candidates.alias("c")
    on = (F.col("a.family") == F.col("c.family")) & (F.col("a.package") == F.col("c.package"))
    for d in others:
        on = on & (F.col(f"a.{d}") == F.col(f"c.{d}"))
    pair = a.join(c, on).select("a.case", "a.family", F.col(f"a.{dimension}").alias("source_value"), F.col(f"c.{dimension}").alias("target_value"), "c.label").distinct()
    hit = pair.join(accepted.distinct().withColumn("__got", F.lit(True)), ["case", "label"], "left").groupBy("case", "family", "source_value", "target_value").agg(F.coalesce(F.bool_or("__got"), F.lit(False)).alias("hit"))
    return hit.groupBy("source_value", "target_value").agg(F.count(F.lit(1)).alias("positives"), F.count_if("hit").alias("detected"))


def with_provenance(refs: DataFrame, catalog: DataFrame, path: str) -> DataFrame:
    """References with the coordinates of the archive their ``path`` names: ``label, package, compiler, optimization, role, source``.

    ``catalog(label, path, family, package, compiler, optimization, role)``. The catalog's row of the same path wins (``exact_path``); then
    the reference's own columns fill what is missing; then the path's folders give compiler and optimization, and package
    or role are taken from the family's builds of these where they have only one (``path_parts``, else ``unresolved``).
    """
    from lodestone.functions.text import path_coordinates

    exact = catalog.filter("path is not null").groupBy(F.col("path").alias("__path")).agg(F.min(F.struct("label", "package", "compiler", "optimization", "role")).alias("__x"))
    parts = path_coordinates(F.col(path))
    known = catalog.select("compiler", "optimization").distinct()
    single = catalog.groupBy("family", "compiler", "optimization").agg(*(F.when(F.countDistinct(c) == 1, F.min(c)).alias(f"__{c}") for c in ("package", "role")))
    r = refs.withColumns({"__path": F.col(path), "__pc": parts["toolchain"], "__po": parts["optimization"]})
    r = r.join(exact, "__path", "left").join(known.select(F.col("compiler").alias("__pc"), F.col("optimization").alias("__po"), F.lit(True).alias("__read")), ["__pc", "__po"], "left")
    r = r.join(single.withColumnsRenamed({"compiler": "__pc", "optimization": "__po"}), ["family", "__pc", "__po"], "left")
    read = lambda c: F.when(F.col("__read"), F.col(c))
    source = F.when(F.col("__x").isNotNull(), "exact_path").when(F.col("__read"), "path_parts").otherwise("unresolved")
    keep = [c for c in refs.columns if c not in ("package", "compiler", "optimization", "role")]
    own = lambda c: F.col(c) if c in refs.columns else F.lit(None).cast("string")
    return r.select(
        *keep, F.col("__x.label").alias("label"), F.coalesce("__x.package", own("package"), read("__package")).alias("package"), F.coalesce("__x.compiler", own("compiler"), read("__pc")).alias("compiler"),
        F.coalesce("__x.optimization", own("optimization"), read("__po")).alias("optimization"), F.coalesce("__x.role", own("role"), read("__role")).alias("role"), source.alias("source"),
    )


def selectors(case_compiler: Column, case_optimization: Column, **replace: Column) -> dict[str, Column]:
    """The baseline build (the binary's compiler and optimization, current version) with one coordinate replaced."""
    return {k: F.coalesce(replace[k], base) if k in replace else base for k, base in (("compiler", case_compiler), ("optimization", case_optimization), ("role", F.lit("current")))}
