"""Constant-data evidence: printable strings, byte grams, containment, evidence classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_strings(data: Column) -> Column:
    """Printable runs of four bytes or more of a binary or text column."""
    text = F.decode(data.cast("binary"), "ISO-8859-1")
    return F.regexp_extract_all(text, F.lit("([ -~]{4,})"), F.lit(1))


def constant_sections(sections: DataFrame, unit: list[str], name: str, size: str, data: str, order: str) -> DataFrame:
    """``unit.., data, strings, n_sections``: a unit's constant data, its sections joined by one NUL byte, and the strings of each.

    Sections are named ``.rodata`` or ``.rodata.*``; one whose data is null or not ``size`` bytes long is skipped. Strings never
    run over a section's end. Units without such a section have no row; a unit's sections are bounded by the unit.
    """
    own = (F.col(name) == ".rodata") | F.col(name).startswith(".rodata.")
    s = sections.filter(own & (F.octet_length(data) == F.col(size))).select(*unit, F.struct(F.col(order).alias("o"), F.hex(F.col(data).cast("binary")).alias("h"), ascii_strings(F.col(data)).alias("s")).alias("x"))
    g = s.groupBy(*unit).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select(*unit, F.unhex(F.array_join(F.transform("x", lambda v: v["h"]), "00")).alias("data"), F.flatten(F.transform("x", lambda v: v["s"])).alias("strings"), F.size("x").alias("n_sections"))


def gram_rows(df: DataFrame, keys: list[str], data: str, n: int = 16) -> DataFrame:
    """``keys.., gram``: the distinct ``n``-byte grams of each row's binary or text column as 64-bit hashes, without all-zero ones.

    Data shorter than ``n`` is one gram; null and empty data has none. A row's repeats are dropped before they become rows.
    """
    # a text becomes up to as many rows as it has bytes: spread the texts first
    raw = df.select(*keys, F.col(data).cast("binary").alias("__b")).filter(F.octet_length("__b") > 0).repartition(*keys)
    # slices of binary cost the same wherever they lie, unlike those of text
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length("__b") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.substring("__b", i, F.lit(n))))
    zeros = F.xxhash64(F.unhex(F.repeat(F.lit("00"), F.least(F.octet_length("__b"), F.lit(n)))))
    return raw.select(*keys, F.explode(F.array_distinct(F.array_remove(cuts, zeros))).alias("gram"))


def string_weight(value: Column) -> Column:
    """0 below four characters, 0.5 below six, else the length up to 80."""
    n = F.length(value)
    return F.when(n < 4, F.lit(0.0)).when(n < 6, F.lit(0.5)).otherwise(F.least(n, F.lit(80)).cast("double"))


def string_containment(cu: DataFrame, elf: DataFrame, unit: str, value: str) -> DataFrame:
    """Weighted multiset containment of each unit's strings in the binary's: ``unit, target_strings, matched_weight, total_weight, string_score``.

    A value counts as often as both sides have it. Rows are pre-counted on either side, so a string
    that is everywhere is one row a unit. Units without weighty strings score 0.0.
    """
    have = elf.groupBy(value).agg(F.count(F.lit(1)).alias("__e"))
    want = cu.groupBy(unit, value).agg(F.count(F.lit(1)).alias("__c"))
    w = string_weight(F.col(value))
    both = want.join(have, value, "left")
    out = both.groupBy(unit).agg(F.sum("__c").alias("target_strings"), F.sum(F.least("__c", F.coalesce("__e", F.lit(0))) * w).alias("matched_weight"), F.sum(F.col("__c") * w).alias("total_weight"))
    return out.withColumn("string_score", F.coalesce(F.col("matched_weight") / F.nullif("total_weight", F.lit(0.0)), F.lit(0.0)))


def gram_containment(cu: DataFrame, elf: DataFrame, unit: str, gram: str) -> DataFrame:
    """Set containment of each unit's grams in the binary's: ``unit, target_grams, matched_grams, byte_score``.

    ``cu`` has each gram of a unit once, as ``gram_rows`` gives them where a unit is one row.
    """
    have = elf.select(gram).distinct().withColumn("__hit", F.lit(1))
    out = cu.select(unit, gram).join(have, gram, "left").groupBy(unit).agg(F.count(F.lit(1)).alias("target_grams"), F.count("__hit").alias("matched_grams"))
    return out.withColumn("byte_score", F.col("matched_grams") / F.col("target_grams"))


def combined_score(string_score: Column, byte_score: Column, strings_ok: Column, bytes_ok: Column) -> Column:
    """0.7 strings + 0.3 bytes if both inform, the strings alone, half the bytes alone, or 0."""
    return F.when(strings_ok & bytes_ok, 0.7 * string_score + 0.3 * byte_score).when(strings_ok, string_score).when(bytes_ok, 0.5 * byte_score).otherwise(F.lit(0.0))


def informative(has_rodata: Column, n_bytes: Column, n_strings: Column, n_grams: Column, enabled: bool = True, min_bytes: int = 512, min_strings: int = 16, min_grams: int = 32) -> Column:
    """Enough constant data to judge by, on any of three counts."""
    return F.lit(enabled) & F.coalesce(has_rodata, F.lit(False)) & ((n_bytes >= min_bytes) | (n_strings >= min_strings) | (n_grams >= min_grams))


def evidence(is_informative: Column, score: Column, penalty_at: float = 0.35, confirm_at: float = 0.9) -> Column:
    """``neutral``, ``penalty`` (tested first, as in replay) or ``confirm``."""
    return F.when(~is_informative, "neutral").when(score <= penalty_at, "penalty").when(score >= confirm_at, "confirm").otherwise("neutral")


def bonus(score: Column, rodata: Column, confirmed: Column, confirm_at: float = 0.9, weight: float = 0.3) -> Column:
    """A confirmed unit's score moves towards 1 by how far its data lies above the threshold."""
    conf = F.lit(1.0) if confirm_at >= 1 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rodata - confirm_at) / (1 - confirm_at)))
    lifted = F.least(F.lit(1.0), F.greatest(score, score + F.lit(weight) * conf * (1 - score)))
    return F.when(confirmed, lifted).otherwise(score)
