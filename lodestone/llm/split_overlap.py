"""Same or nearly the same records across splits.

Method: the elements of evaluation records are hashed and partitioned, training records are scanned
for hits, and the containment of each evaluation record in each hit training record is computed; a
pair counts if its Jaccard index, which follows from containment and sizes, reaches the threshold.

Exact copies are one class, so a set that many records share is compared once. Candidates come from
an exact prefix filter: with elements ordered rarest first, two sets with Jaccard ``t`` or more share
an element among the first ``n - ceil(t n) + 1`` of either. No candidate is capped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.session import written
from lodestone.plans.skew import lookup_join, salted_join


def digests(column: str) -> Column:
    """The 64 hex digits in each string, in lower case; strings without them and nulls do not count."""
    return F.array_distinct(F.filter(F.transform(F.col(column), lambda h: F.lower(F.regexp_extract(h, "([0-9A-Fa-f]{64})", 1))), lambda h: h != ""))


def plain_name(name: Column) -> Column:
    """A name without case and outer blanks, in which ``-``, ``_`` and inner blank are one."""
    return F.translate(F.lower(F.trim(name)), "_ ", "--")


def names(column: str) -> Column:
    """The distinct plain names of an array; nulls and blank names do not count."""
    return F.array_distinct(F.filter(F.transform(F.col(column), plain_name), lambda n: n != ""))


def members(records: DataFrame, basis: str, elements: Column, min_size: int, train: str = "train", evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """``record_id, split_name, source_project, is_train, basis, c1, c2, elems``: each record's class (a 128-bit hash of its set) and element hashes.

    Records of other or null splits, and sets smaller than ``min_size``, take no part. Hashes differ from basis to basis,
    so sets of several bases may share one table.
    """
    elems = F.array_sort(F.transform(elements, lambda e: F.xxhash64(F.lit(basis), e)))
    part = records.filter(F.col("split_name").isin(train, *evaluation) & F.col("record_id").isNotNull())
    sets = part.select("record_id", "split_name", "source_project", (F.col("split_name") == train).alias("is_train"), F.lit(basis).alias("basis"), elems.alias("elems")).filter(F.size("elems") >= min_size)
    return sets.withColumns({"c1": F.xxhash64("elems"), "c2": F.xxhash64(F.lit(7), F.reverse("elems"))})


def class_overlaps(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes ``e1, e2, t1, t2`` (evaluation, training) with ``basis``, ``containment`` and ``jaccard`` >= ``threshold``."""
    classes = sets.groupBy("basis", "c1", "c2").agg(F.first("elems").alias("elems"), F.bool_or("is_train").alias("in_train"), F.bool_or(~F.col("is_train")).alias("in_eval"))
    classes = written(classes, "overlap-classes")
    tokens = classes.select("basis", "c1", "c2", "in_train", "in_eval", F.explode("elems").alias("elem"))
    freq = written(tokens.groupBy("elem").agg(F.count(F.lit(1)).alias("n")), "overlap-elements").withColumn("freq", F.col("n"))
    ordered = lookup_join(tokens, freq, "elem", "n").groupBy("basis", "c1", "c2", "in_train", "in_eval").agg(F.array_sort(F.collect_list(F.struct("freq", "elem"))).alias("by_freq"))
    # written once: prefixes and the comparison both read it
    whole = written(ordered.select("*", F.transform("by_freq", lambda x: x["elem"]).alias("elems")).drop("by_freq"), "overlap-ordered").withColumn("n", F.size("elems"))
    least = lambda n: F.ceil(F.lit(threshold) * n - 1e-9)
    prefix = whole.select("c1", "c2", "n", "in_train", "in_eval", F.posexplode(F.slice("elems", F.lit(1), (F.col("n") - least(F.col("n")) + 1).cast("int"))).alias("pos", "elem"))
    train = prefix.filter("in_train").select("elem", F.col("n").alias("tn"), F.col("pos").alias("tpos"), F.col("c1").alias("t1"), F.col("c2").alias("t2"))
    # one evaluation row for each training size that can reach the threshold: it also spreads frequent elements over sizes
    sizes = F.sequence(least(F.col("n")).cast("int"), F.floor(F.col("n") / threshold + 1e-9).cast("int"))
    evals = prefix.filter("in_eval").select("elem", F.col("n").alias("en"), F.col("pos").alias("epos"), F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.explode(sizes).alias("tn"))
    need = F.ceil((F.col("en") + F.col("tn")) * threshold / (1 + threshold) - 1e-9)
    reach = F.least("epos", "tpos") + 1 + F.least(F.col("en") - F.col("epos"), F.col("tn") - F.col("tpos")) - 1
    hits = salted_join(evals, train, ["elem", "tn"]).filter(reach >= need).select("e1", "e2", "t1", "t2").distinct()
    # candidates are written, so neither they nor the prefixes are planned or made again for the comparison
    hits = written(hits, "overlap-hits")
    of = lambda a, b, name, *more: whole.select(F.col("c1").alias(a), F.col("c2").alias(b), F.col("elems").alias(name), *more)
    both = hits.join(of("e1", "e2", "es", "basis"), ["e1", "e2"]).join(of("t1", "t2", "ts"), ["t1", "t2"])
    common = F.size(F.array_intersect("es", "ts"))
    scored = both.select("basis", "e1", "e2", "t1", "t2", (common / F.size("es")).alias("containment"), (common / (F.size("es") + F.size("ts") - common)).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= threshold - 1e-12)


def _sets(records: DataFrame, min_names: int) -> DataFrame:
    return written(members(records, "hashes", digests("hashes"), 1).unionByName(members(records, "programs", names("programs"), min_names)), "overlap-sets")


def overlaps(records: DataFrame, threshold: float = 0.8, min_names: int = 4) -> DataFrame:
    """All pairs of an evaluation and a training record that are nearly the same in digests or in names.

    ``eval_id, train_id, split_name, source_project`` (of the evaluation record), ``basis``
    (``hashes`` or ``programs``), ``containment`` (share of the evaluation record's elements that the
    training record has) and ``jaccard``. A repeated row counts once. Null or empty arrays and null
    elements match nothing; an empty table gives no row. Exact copies are written out as pairs; ``linked``
    has one row a record instead.
    """
    sets = _sets(records, min_names)
    pairs = class_overlaps(sets, threshold)
    rows = sets.select("record_id", "split_name", "source_project", "is_train", "c1", "c2").distinct()
    evals = rows.filter(~F.col("is_train")).select(F.col("record_id").alias("eval_id"), "split_name", "source_project", F.col("c1").alias("e1"), F.col("c2").alias("e2"))
    train = rows.filter("is_train").select(F.col("record_id").alias("train_id"), F.col("c1").alias("t1"), F.col("c2").alias("t2"))
    out = pairs.join(evals, ["e1", "e2"]).join(train, ["t1", "t2"])
    return out.select("eval_id", "train_id", "split_name", "source_project", "basis", "containment", "jaccard")


def linked(records: DataFrame, threshold: float = 0.8, min_names: int = 4) -> DataFrame:
    """One row for each record with a cross-split overlap: ``record_id, basis, class_id`` (the smallest record with the same set) and ``n_links``, the records of the other side it overlaps.

    Classes stand for their records throughout, so the result never grows with the square of a group of copies.
    """
    sets = _sets(records, min_names)
    pairs = written(class_overlaps(sets, threshold), "overlap-pairs")
    rows = sets.select("record_id", "is_train", "basis", "c1", "c2").distinct()
    sizes = rows.groupBy("basis", "c1", "c2").agg(F.min("record_id").alias("class_id"), F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_eval"))
    sizes = written(sizes, "overlap-sizes")
    side = lambda a, n: sizes.select(F.col("c1").alias(f"{a}1"), F.col("c2").alias(f"{a}2"), n)
    of_eval = pairs.join(side("t", "n_train"), ["t1", "t2"]).groupBy(F.col("e1").alias("c1"), F.col("e2").alias("c2")).agg(F.sum("n_train").alias("n_links")).withColumn("is_train", F.lit(False))
    of_train = pairs.join(side("e", "n_eval"), ["e1", "e2"]).groupBy(F.col("t1").alias("c1"), F.col("t2").alias("c2")).agg(F.sum("n_eval").alias("n_links")).withColumn("is_train", F.lit(True))
    links = of_eval.unionByName(of_train).join(sizes.select("c1", "c2", "class_id", (F.col("n_train") + F.col("n_eval")).alias("w")), ["c1", "c2"])
    links = links.select(F.struct("c1", "c2", "is_train").alias("key"), "class_id", "n_links", "w")
    return lookup_join(rows.withColumn("key", F.struct("c1", "c2", "is_train")), links, "key", "w").select("record_id", "basis", "class_id", "n_links")
