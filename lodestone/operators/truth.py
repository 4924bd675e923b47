"""Ground truth, catalogs, manifests, and the checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.skew import bounded


def linker_map_members(maps: DataFrame, key: str, text: str) -> DataFrame:
    """``key, archive, member`` that a GNU linker map's inclusion section lists.

    The section starts after a line that begins with ``Archive member included``; records start in
    column zero; the first blank line after a record ends it. A text without the section gives no row.
    """
    section = F.regexp_extract(text, r"(?:^|\n)Archive member included[^\n]*\n\s*([\s\S]*?\S[\s\S]*?)(?:\n[ \t\r]*\n|$)", 1)
    lines = maps.select(F.col(key), F.explode(F.split(section, r"\r?\n")).alias("line"))
    rec = r"^(\S.*?\.a)\(([^()]+)\)"
    return lines.select(key, F.regexp_extract("line", rec, 1).alias("archive"), F.regexp_extract("line", rec, 2).alias("member")).filter("member <> ''")


def member_mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, archive, member`` of every ``x.a(y.o)`` anywhere in a text."""
    hit = F.explode(F.regexp_extract_all(text, F.lit(r"(\S+?\.a\([^()]+\.o\))"), F.lit(1)))
    return texts.select(key, hit.alias("hit")).select(key, F.regexp_extract("hit", r"^(\S+?\.a)\(", 1).alias("archive"), F.regexp_extract("hit", r"\(([^()]+\.o)\)", 1).alias("member"))


def lookup_dimension(facts: DataFrame, path: Column, dim: DataFrame, dim_path: str, value: str, as_name: str) -> DataFrame:
    """Exact path first, else the basename where the dimension has it once; else null. Keeps all facts."""
    exact = dim.groupBy(F.col(dim_path).alias("__p")).agg(F.min(value).alias("__exact"))
    base = dim.groupBy(F.substring_index(dim_path, "/", -1).alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__base")).filter("__n = 1").drop("__n")
    j = facts.withColumn("__p", path).withColumn("__b", F.substring_index("__p", "/", -1)).join(exact, "__p", "left").join(base, "__b", "left")
    return j.withColumn(as_name, F.coalesce("__exact", "__base")).drop("__p", "__b", "__exact", "__base")


def latest(df: DataFrame, keys: list[str], order: Sequence[str]) -> DataFrame:
    """Latest-wins compaction: of each key the row greatest by ``order``, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def occurrences(df: DataFrame, keys: list[str], order: Sequence[str], name: str = "occurrence_no") -> DataFrame:
    """1-based number of each repeat of a key, in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def deduplicated(df: DataFrame, digest: str, order: Sequence[str]) -> DataFrame:
    """One representative for each digest: the row at place ``first 64 bits of the digest mod copies`` in ``order``."""
    from lodestone.functions.text import digest_index

    w = Window.partitionBy(digest)
    n = df.withColumn("copies", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1)
    return n.filter(F.col("__i") == digest_index(F.col(digest), F.col("copies"))).drop("__i")


def sharded(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Round-robin shard of each row by its place in a total order, found without one task holding all rows.

    Rows are range-partitioned; a row's place is its partition's offset plus its place there.
    """
    part = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    return _places(part, order).withColumn("shard", F.pmod(F.col("position") - 1, F.lit(shards)).cast("int"))


def _places(part: DataFrame, order: Sequence[str]) -> DataFrame:
    from lodestone.plans.session import written

    part = written(part, "range-parts")
    sizes = part.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(F.lit(1)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    # one row a partition
    local = part.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return local.join(F.broadcast(offsets), "__p").withColumn("position", F.col("__o") + F.col("__i")).drop("__p", "__o", "__i")


def position_ranges(placed: DataFrame, size: int) -> DataFrame:
    """``first, last, n`` (1-based, inclusive) of each run of ``size`` places of ``position``."""
    return placed.groupBy(F.floor((F.col("position") - 1) / size).alias("part")).agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count(F.lit(1)).alias("n"))


def confirmed_units(archives: DataFrame, keys: list[str]) -> DataFrame:
    """``keys.., cu``: units that a linker map confirms, from either encoding of ground truth.

    ``confirmed_compilation_units`` (names) counts where it is not null, and then only if ``confirmed_compilation_units_method`` is ``linker_map``;
    else of ``compilation_units`` those ``included`` by ``ground_truth_method`` ``linker_map``. Names are normalised and distinct.
    """
    from lodestone.functions.text import cu_name

    lists = F.when(F.col("confirmed_compilation_units_method") == "linker_map", F.col("confirmed_compilation_units")).otherwise(F.array().cast("array<string>"))
    single = F.transform(F.filter("compilation_units", lambda u: F.coalesce(u["included"], F.lit(False)) & (u["ground_truth_method"] == "linker_map")), lambda u: u["compilation_unit"])
    names = F.when(F.col("confirmed_compilation_units").isNotNull(), lists).otherwise(single)
    return archives.select(*keys, F.explode(names).alias("__n")).select(*keys, cu_name(F.col("__n")).alias("cu")).distinct()


def present(included: Column) -> Column:
    """Is an archive present in the truth: it has an included unit, or no count of them."""
    return F.when(included.isNull(), F.lit(True)).otherwise(included > 0)


def cohort_cells(cells: DataFrame, programs: DataFrame, program: str) -> DataFrame:
    """Expected ``program`` x cell rows: each cell (``program_count``, ``cohort_offset``, ``family``, ...) takes so many programs from its offset on, around the end to the start.

    ``programs`` has ``supports`` (families) and is ordered by ``program``; both are tables of settings.
    A null count means all programs, a null offset 0.
    """
    alone = Window.partitionBy(F.lit(1))
    ring = programs.select(program, "supports", (F.row_number().over(alone.orderBy(program)) - 1).alias("__at"), F.count(F.lit(1)).over(alone).alias("__n"))
    grid = cells.crossJoin(bounded(ring))
    count, offset = F.least(F.coalesce("program_count", "__n"), F.col("__n")), F.coalesce("cohort_offset", F.lit(0))
    inside = F.pmod(F.col("__at") - offset, F.col("__n")) < count
    return grid.filter(inside & F.array_contains("supports", F.col("family"))).drop("__at", "__n", "supports")


def matrix_gap(coordinates: Sequence[DataFrame], observed: DataFrame) -> DataFrame:
    """Cells of the Cartesian matrix of a few small coordinate tables that were not observed."""
    cells = coordinates[0]
    for c in coordinates[1:]:
        cells = cells.crossJoin(bounded(c))
    return cells.join(observed.select(*cells.columns).distinct(), cells.columns, "left_anti")


def multiset_diff(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose number of copies differs: ``cols.., n_left, n_right``. Nulls equal nulls."""
    both = a.select(*cols, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*cols, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*cols).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).filter("n_left <> n_right")


def violations(df: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """``check_name, n_violations, first_key`` of every constraint; a null condition is a violation."""
    bad = {n: F.coalesce(~c, F.lit(True)) for n, c in checks.items()}
    row = F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), b.alias("bad"), F.col(key).alias("k")) for n, b in bad.items())))
    return df.select(row.alias("x")).groupBy("x.check_name").agg(F.count_if("x.bad").alias("n_violations"), F.min(F.when(F.col("x.bad"), F.col("x.k"))).alias("first_key"))


def replaced(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Merge in which the right side replaces all rows of its keys."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def priority_status(df: DataFrame, keys: list[str], status: str, order: Sequence[str]) -> DataFrame:
    """Of each key the status that comes first in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(status))
    return df.groupBy(*keys).agg(F.min_by(status, rank).alias(status), F.count(F.lit(1)).alias("n_rows"))


def symbol_members(symbols: DataFrame, binary_symbols: DataFrame, archive: str, member: str, symbol: str, binary: str) -> DataFrame:
    """Members inferred by symbols that are unique in their archive and that a binary defines: ``binary, archive, member, n_symbols``."""
    own = symbols.groupBy(archive, symbol).agg(F.countDistinct(member).alias("__n"), F.min(member).alias(member)).filter("__n = 1").drop("__n")
    return own.join(binary_symbols.select(binary, symbol).distinct(), symbol).groupBy(binary, archive, member).agg(F.countDistinct(symbol).alias("n_symbols"))
