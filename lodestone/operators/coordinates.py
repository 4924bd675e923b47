"""Build coordinates, selections and record checks that join small catalogs to large tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.skew import bounded


def useful_symbol(kind: Column, symbol: Column) -> Column:
    """A definition with a name: not undefined or weak, not empty, not a mapping symbol."""
    return F.coalesce(~F.upper(kind).isin("U", "W", "V") & (symbol != "") & ~symbol.startswith("$"), F.lit(False))


def missing_reason(package: Column, toolchain: Column, optimization: Column, variant_built: Column) -> Column:
    """Why a coordinate has no archive."""
    return (
        F.when((package == "glibc") & toolchain.startswith("clang-"), "unsupported_compiler")
        .when((package == "glibc") & (optimization == "O0"), "unsupported_optimization")
        .when(~F.coalesce(variant_built, F.lit(False)), "variant_not_built_or_unsupported")
        .otherwise("archive_not_produced_by_version")
    )


def chosen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row least by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def held_by_all(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Keys that occur with every value of ``member``."""
    n = df.agg(F.countDistinct(member)).scalar()
    return df.groupBy(*keys).agg(F.countDistinct(member).alias("__n")).filter(F.col("__n") == n).select(*keys)


def field_diff(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Differences of two tables that have each key once: ``key, field, left_value, right_value``; a missing row shows as field ``row``. Nulls equal nulls."""
    l, r = a.select(key, F.lit(True).alias("__l"), *(F.col(f).cast("string").alias(f"l_{f}") for f in fields)), b.select(key, F.lit(True).alias("__r"), *(F.col(f).cast("string").alias(f"r_{f}") for f in fields))
    j = l.join(r, key, "full")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    pairs = [F.when(both & ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left_value"), F.col(f"r_{f}").alias("right_value"))) for f in fields]
    lone = F.when(~both, F.struct(F.lit("row").alias("field"), F.when(F.col("__l").isNotNull(), "present").alias("left_value"), F.when(F.col("__r").isNotNull(), "present").alias("right_value")))
    return j.select(key, F.explode(F.filter(F.array(*pairs, lone), lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def exceeds(used: DataFrame, stock: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys used more often than they are in stock: ``keys.., n_used, n_stock``."""
    u, s = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_used")), stock.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stock"))
    return u.join(s, list(keys), "left").withColumn("n_stock", F.coalesce("n_stock", F.lit(0))).filter("n_used > n_stock")


def index_gaps(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Groups whose distinct indices are not 0, 1, 2, ...: ``keys.., n_indices, low, high``."""
    g = df.groupBy(*keys).agg(F.countDistinct(index).alias("n_indices"), F.min(index).alias("low"), F.max(index).alias("high"))
    return g.filter("low <> 0 or high <> n_indices - 1")


def expanded(df: DataFrame, keys: Sequence[str], names: str) -> DataFrame:
    """Array members in order, repeated names numbered: ``keys.., position, name, occurrence``."""
    m = df.select(*keys, F.posexplode(names).alias("position", "name"))
    return m.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, "name").orderBy("position")))


def with_descriptors(mapping: DataFrame, descriptors: DataFrame, keys: Sequence[str], index: str, prefix: str) -> DataFrame:
    """Indices joined back to what they stand for; an index without a descriptor is an error when it is read."""
    d = descriptors.select(*keys, F.col("function_index").alias(index), F.struct(*(c for c in descriptors.columns if c not in keys)).alias(f"{prefix}_function"))
    j = mapping.join(d, [*keys, index], "left")
    return j.withColumn(f"{prefix}_function", F.when(F.col(f"{prefix}_function").isNull(), F.raise_error(F.concat(F.lit(f"no {prefix} function "), F.col(index)))).otherwise(F.col(f"{prefix}_function")))


def pair_map(flat: Column) -> Column:
    """Map of a flat array key, value, key, value ...; the last value of a key wins, a key without value is left out."""
    n = F.floor(F.size(flat) / 2).cast("int")
    keys = F.transform(F.slice(flat, F.lit(1), n * 2), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    k = F.transform(F.filter(keys, lambda p: p["i"] % 2 == 0), lambda p: p["x"])
    v = F.transform(F.filter(keys, lambda p: p["i"] % 2 == 1), lambda p: p["x"])
    pos = F.transform(k, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    last = F.filter(pos, lambda p: ~F.exists(pos, lambda q: (q["x"] == p["x"]) & (q["i"] > p["i"])))
    return F.map_from_arrays(F.transform(last, lambda p: p["x"]), F.transform(last, lambda p: F.get(v, p["i"])))


def whole_number(text: Column) -> Column:
    """A hexadecimal (``0x...``) or decimal integer of a text, null for anything else, also for true and false."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(t, 3, 16), 16, 10).cast("bigint")).when(t.rlike("^[+-]?[0-9]{1,18}$"), t.cast("bigint"))


def encode_words(rows: DataFrame, key: str, words: Column, vocabulary: DataFrame, unknown: int = 1, pad: int = 0, length: int | None = None) -> DataFrame:
    """``key, ids`` of each row's words in order; unknown words get ``unknown``; padded or cut to ``length`` where one is given.

    ``vocabulary(word, token_id)``. Rows without words get only padding.
    """
    w = rows.select(key, F.posexplode_outer(words).alias("pos", "word"))
    j = w.join(vocabulary.select("word", "token_id"), "word", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(unknown)).cast("int").alias("t"))))), lambda x: x["t"])
    g = j.groupBy(key).agg(ids.alias("ids"))
    return g if length is None else g.withColumn("ids", F.slice(F.concat("ids", F.array_repeat(F.lit(pad), length)), 1, length))


def grid(base: DataFrame, values: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every combination of the given values as columns beside the rows of ``base``."""
    for name, options in values.items():
        base = base.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return base


def balanced_screen(cases: DataFrame, group: str, cell: str, per_group: int = 2, seed: str = "screen") -> DataFrame:
    """``per_group`` cases of every group so that all cells occur nearly equally often.

    Groups, in digest order, take consecutive cells of a ring, so cell counts differ by one at most. Each group
    must have every cell, else reading the result is an error. Groups and cells are small catalogs.
    """
    alone = Window.partitionBy(F.lit(1))
    cells = cases.select(cell).distinct()
    cells = cells.select(cell, (F.row_number().over(alone.orderBy(cell)) - 1).alias("__c"), F.count(F.lit(1)).over(alone).alias("__k"))
    groups = cases.select(group).distinct()
    groups = groups.select(group, (F.row_number().over(alone.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(group)), 256))) - 1).alias("__g"))
    turn = groups.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(per_group - 1))))
    want = turn.crossJoin(bounded(cells)).filter(F.col("__c") == F.pmod(F.col("__g") * per_group + F.col("__j"), F.col("__k"))).select(group, cell)
    j = want.join(cases.withColumn("__have", F.lit(True)), [group, cell], "left")
    lacks = F.raise_error(F.concat(F.lit("incomplete matrix: "), F.concat_ws("/", F.col(group).cast("string"), F.col(cell).cast("string")))).cast("boolean")
    return j.filter(F.coalesce("__have", lacks)).drop("__have")


def build_panel(builds: DataFrame, family: str, level: str, choice: str, variant: str, seed: str = "panel") -> DataFrame:
    """Of every family and ``level`` all values of ``choice`` but one, each with one ``variant``, both rotating from family to family.

    A family of 4 levels, 4 choices and 3 variants gives 12 builds, 3 for each level. An incomplete matrix is an error when read.
    """
    alone = Window.partitionBy(F.lit(1))

    def index(column: str, name: str, order=None) -> DataFrame:
        return builds.select(column).distinct().select(column, (F.row_number().over(alone.orderBy(F.col(column) if order is None else order)) - 1).alias(name), F.count(F.lit(1)).over(alone).alias(f"{name}n"))

    f = index(family, "__f", F.sha2(F.concat_ws(":", F.lit(seed), F.col(family)), 256))
    grid_ = f
    for part in (index(level, "__l"), index(choice, "__c"), index(variant, "__v")):
        grid_ = grid_.crossJoin(bounded(part))
    left_out = F.pmod(F.col("__f") + F.col("__l"), F.col("__cn"))
    want = grid_.filter((F.col("__c") != left_out) & (F.col("__v") == F.pmod(F.col("__f") + F.col("__l") + F.col("__c"), F.col("__vn")))).select(family, level, choice, variant)
    keys = [family, level, choice, variant]
    j = want.join(builds.withColumn("__have", F.lit(True)), keys, "left")
    lacks = F.raise_error(F.concat(F.lit("incomplete matrix: "), F.concat_ws("/", *keys))).cast("boolean")
    return j.filter(F.coalesce("__have", lacks)).drop("__have")
