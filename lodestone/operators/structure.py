"""Call structure: interval joins, unique-key joins, call preservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def indexed(df: DataFrame, partition: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: 0-based place in address (or any given) order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def symbol_functions(symbols: DataFrame, kind: str, size: str, address: str) -> DataFrame:
    """The symbols that stand for functions where no function list exists: kind ``FUNC``, a size above 0 and an address."""
    return symbols.filter((F.col(kind) == "FUNC") & (F.col(size) > 0) & F.col(address).isNotNull())


def prefix_join(keys: DataFrame, archives: DataFrame, key: str = "key", archive: str = "archive") -> DataFrame:
    """``key, archive`` of every archive that is named as a key or begins with it and a dot; where a key is an archive's name, only that one.

    The only keys that can match an archive are its name and its prefixes that end before a dot, so this is an equi join.
    """
    parts = F.split(archive, "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    j = archives.select(archive, F.explode(prefixes).alias(key)).join(keys.select(key), key).withColumn("__exact", F.col(archive) == F.col(key))
    best = j.groupBy(key).agg(F.bool_or("__exact").alias("__any"))
    return j.join(best, key).filter("__exact or not __any").select(key, archive)


def call_edge_counts(calls: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Calls ``scope.., caller_cu, caller_function, callee_cu, callee_function`` counted by pair of functions and by pair of units (``relocations``, and for units ``function_edges``)."""
    by_function = calls.groupBy(*scope, "caller_cu", "caller_function", "callee_cu", "callee_function").agg(F.count(F.lit(1)).alias("relocations"))
    by_unit = by_function.groupBy(*scope, "caller_cu", "callee_cu").agg(F.sum("relocations").alias("relocations"), F.count(F.lit(1)).alias("function_edges"))
    return by_function, by_unit


def containing_function(addresses: DataFrame, functions: DataFrame, unit: list[str], address: str, page: int = 4096) -> DataFrame:
    """Interval join: the function of ``functions(unit.., function_index, start, stop)`` that an address falls in.

    An exact entry wins, else the shortest enclosing ``[start, stop)``, else null; ties go to the
    lower index. Both sides meet by unit and page of addresses, so a large unit is not compared whole.
    ``addresses`` keeps all its columns and rows; a null address finds nothing.
    """
    paged = functions.filter("start < stop").withColumn("__page", F.explode(F.sequence(F.floor(F.col("start") / page), F.floor((F.col("stop") - 1) / page))))
    spans = paged.select(*(F.col(u).alias(f"__{u}") for u in unit), "__page", F.col("function_index").alias("__f"), F.col("start").alias("__a"), F.col("stop").alias("__z"))
    keyed = addresses.withColumn("__page", F.floor(F.col(address) / page))
    on = (keyed["__page"] == spans["__page"]) & (F.col(address) >= F.col("__a")) & (F.col(address) < F.col("__z"))
    for u in unit:
        on = on & (keyed[u] == F.col(f"__{u}"))
    hit = keyed.join(spans.hint("merge"), on).groupBy(*unit, address).agg(F.min(F.struct((F.col("__a") != F.col(address)).alias("x"), (F.col("__z") - F.col("__a")).alias("n"), "__f")).alias("best"))
    return addresses.join(hit.select(*unit, address, F.col("best.__f").alias("resolved_function")), [*unit, address], "left")


def resolved_calls(calls: DataFrame, functions: DataFrame, unit: list[str], caller: str, address: str) -> DataFrame:
    """Distinct ``unit.., caller, callee`` of calls that resolve to another function of the unit."""
    found = containing_function(calls.select(*unit, caller, address).distinct(), functions, unit, address)
    return found.filter(F.col("resolved_function").isNotNull() & (F.col("resolved_function") != F.col(caller))).select(*unit, F.col(caller).alias("caller"), F.col("resolved_function").alias("callee")).distinct()


def unique_definitions(defs: DataFrame, scope: list[str], symbol: str, owner: str) -> DataFrame:
    """Symbols that exactly one owner defines in their scope."""
    return defs.groupBy(*scope, symbol).agg(F.countDistinct(owner).alias("__n"), F.min(owner).alias("definer")).filter("__n = 1").drop("__n")


def inter_unit_calls(refs: DataFrame, defs: DataFrame, scope: list[str], symbol: str, owner: str) -> DataFrame:
    """External symbols to their only definition; calls within a unit are dropped. Distinct edges."""
    edges = refs.join(unique_definitions(defs, scope, symbol, owner), [*scope, symbol])
    return edges.filter(F.col("definer") != F.col(owner)).select(*scope, F.col(owner).alias("caller"), "definer", symbol).distinct()


def relocation_edges(refs: DataFrame, defs: DataFrame, scope: list[str], symbol: str, owner: str) -> DataFrame:
    """As ``inter_unit_calls``, but the caller is taken out before the test for a single definition; relocations are counted.

    Only the two extreme owners of a symbol are needed, so no list of definers is built.
    """
    known = defs.groupBy(*scope, symbol).agg(F.countDistinct(owner).alias("__n"), F.min(owner).alias("__lo"), F.max(owner).alias("__hi"))
    own = defs.select(*scope, symbol, F.col(owner).alias("__own")).distinct()
    counted = refs.groupBy(*scope, symbol, owner).agg(F.count(F.lit(1)).alias("relocations"))
    j = counted.join(known, [*scope, symbol]).join(own.withColumnRenamed("__own", owner).withColumn("__self", F.lit(True)), [*scope, symbol, owner], "left")
    other = F.when(F.col("__self") & (F.col("__n") == 2), F.when(F.col("__lo") == F.col(owner), F.col("__hi")).otherwise(F.col("__lo"))).when(F.col("__self").isNull() & (F.col("__n") == 1), F.col("__lo"))
    return j.withColumn("definer", other).filter("definer is not null").groupBy(*scope, F.col(owner).alias("caller"), "definer").agg(F.sum("relocations").alias("relocations"), F.count(F.lit(1)).alias("symbols"))


def preserved_ratio(cu_edges: DataFrame, mapping: DataFrame, elf_edges: DataFrame, unit: str, empty: float = 1.0) -> DataFrame:
    """Share of a unit's mapped call edges that the binary has too; ``empty`` where none can be evaluated.

    ``cu_edges(unit, caller, callee)``, ``mapping(unit, cu_function, elf_function)``, ``elf_edges(caller, callee)``.
    Edges with an unmapped end cannot be evaluated.
    """
    of = lambda end: mapping.select(F.col(unit), F.col("cu_function").alias(end), F.col("elf_function").alias(f"elf_{end}"))
    mapped = cu_edges.distinct().join(of("caller"), [unit, "caller"], "left").join(of("callee"), [unit, "callee"], "left")
    have = elf_edges.select(F.col("caller").alias("elf_caller"), F.col("callee").alias("elf_callee")).distinct().withColumn("__hit", F.lit(1))
    ok = F.col("elf_caller").isNotNull() & F.col("elf_callee").isNotNull()
    out = mapped.join(have, ["elf_caller", "elf_callee"], "left").groupBy(unit).agg(F.count(F.lit(1)).alias("edges_total"), F.count_if(ok).alias("edges_evaluable"), F.count_if(ok & F.col("__hit").isNotNull()).alias("edges_matched"))
    return out.withColumn("ratio", F.when(F.col("edges_evaluable") > 0, F.col("edges_matched") / F.col("edges_evaluable")).otherwise(F.lit(empty)))


def cross_adjustment(score: Column, evaluable: Column, coverage: Column, ratio: Column, bonus: float = 0.2, penalty: float = 0.0, saturation: int = 8) -> Column:
    """Score moved by cross-unit call evidence, within 0 and 1."""
    rel = F.least(F.lit(1.0), evaluable / F.lit(float(max(saturation, 1)))) * coverage
    moved = score + F.lit(bonus) * rel * ratio * (1 - score) - F.lit(penalty) * rel * (1 - ratio) * score
    return F.when(evaluable > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))).otherwise(score)


def cross_unit_evidence(edges: DataFrame, accepted: DataFrame, mapping: DataFrame, elf_edges: DataFrame, library: str, both: bool = True) -> DataFrame:
    """Cross-unit call evidence of each library.

    ``edges(library, caller_cu, caller_function, callee_cu, callee_function)``, ``accepted(library, cu)``,
    ``mapping(library, cu, cu_function, elf_function)``. ``both`` wants either end accepted, else one
    is enough. Ratio and coverage are 0.0 where there is nothing to divide by.
    """
    acc = lambda end: accepted.select(library, F.col("cu").alias(f"{end}_cu")).distinct().withColumn(f"__{end}", F.lit(1))
    e = edges.distinct().join(acc("caller"), [library, "caller_cu"], "left").join(acc("callee"), [library, "callee_cu"], "left")
    has_a, has_b = F.col("__caller").isNotNull(), F.col("__callee").isNotNull()
    e = e.filter((has_a & has_b) if both else (has_a | has_b))
    m = lambda end: mapping.select(library, F.col("cu").alias(f"{end}_cu"), F.col("cu_function").alias(f"{end}_function"), F.col("elf_function").alias(f"elf_{end}"))
    e = e.join(m("caller"), [library, "caller_cu", "caller_function"], "left").join(m("callee"), [library, "callee_cu", "callee_function"], "left")
    have = elf_edges.select(F.col("caller").alias("elf_caller"), F.col("callee").alias("elf_callee")).distinct().withColumn("__hit", F.lit(1))
    ok = F.col("elf_caller").isNotNull() & F.col("elf_callee").isNotNull()
    out = e.join(have, ["elf_caller", "elf_callee"], "left").groupBy(library).agg(F.count(F.lit(1)).alias("edges_expected"), F.count_if(ok).alias("edges_evaluable"), F.count_if(ok & F.col("__hit").isNotNull()).alias("edges_matched"))
    return out.withColumns({"ratio": F.coalesce(F.col("edges_matched") / F.nullif("edges_evaluable", F.lit(0)), F.lit(0.0)), "coverage": F.coalesce(F.col("edges_evaluable") / F.nullif("edges_expected", F.lit(0)), F.lit(0.0))})


def relocation_at(instructions: DataFrame, relocations: DataFrame, unit: list[str], address: str, value: str) -> DataFrame:
    """The relocation at an instruction's address or, failing that, one byte on."""
    r = relocations.groupBy(*unit, F.col("offset")).agg(F.min(value).alias("__v"))
    at = lambda d: r.select(*unit, (F.col("offset") - d).alias(address), F.col("__v").alias(f"__v{d}"))
    return instructions.join(at(0), [*unit, address], "left").join(at(1), [*unit, address], "left").withColumn("relocation", F.coalesce("__v0", "__v1")).drop("__v0", "__v1")
