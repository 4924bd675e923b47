"""Mixing sources to target weights.

Method: time-varying curriculum. Each source has a weight schedule over training time whose mean is
its target share; the schedule is integrated to cumulative token demand, the demand inverted at each
document's place in its source to give its training position, and documents are range-sorted by
position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.skew import bounded


def source_key(column: str = "source") -> Column:
    """A source's name in lower case without outer blanks."""
    return F.lower(F.trim(F.col(column)))


def mix_plan(sizes: DataFrame, targets: DataFrame, phases: int = 4, tilt: float = 0.5, total: int | None = None, hold: bool = False) -> DataFrame:
    """One row per target source: what it has, what is demanded, and its schedule.

    ``sizes(doc_id, source, n_tokens)``, ``targets(source, target_share, max_uses)``. ``demand`` is
    ``target_share`` of ``total`` (default: the tokens of all documents, also those of other or null
    sources); with ``hold`` the total shrinks until no source lacks tokens, so that all shares hold (an empty source
    with a share then empties the mix). ``capacity`` is ``max_uses`` times what the source has; ``taken`` is the smaller.
    ``weights`` are the schedule's weights by phase, normed to mean 1: sources with short documents
    weigh more early and those with long ones more late, by up to ``tilt``; ``starts`` is the
    cumulated demand, in shares of the source, where each phase begins.
    """
    have = sizes.groupBy(source_key().alias("source")).agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("docs"))
    all_tokens = F.lit(total) if total is not None else have.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    # the plan has a row for each target and is broadcast, so their number is checked here
    t = bounded(targets).select(source_key().alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_uses").cast("long").alias("max_uses"))
    # the targets are a table of settings: its rows meet in one window
    t = t.join(have, "source", "left").fillna(0, ["tokens", "docs"])
    everything = Window.partitionBy(F.lit(1))
    length = F.percent_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.col("tokens") / F.greatest(F.col("docs"), F.lit(1)), "source"))
    t = t.withColumn("len_rank", length)
    mean = F.sum(F.col("target_share") * F.col("len_rank")).over(everything) / F.sum("target_share").over(everything)
    t = t.withColumn("lean", mean - F.col("len_rank"))
    mids = [1 - 2 * (p + 0.5) / phases for p in range(phases)]
    t = t.withColumn("weights", F.array(*(1 + F.lit(tilt * m) * F.col("lean") for m in mids)))
    starts = F.array(*(sum((F.col("weights")[q] for q in range(p)), F.lit(0.0)) / phases for p in range(phases)))
    t = t.withColumns({"capacity": F.col("max_uses") * F.col("tokens"), "starts": starts})
    most = F.least(all_tokens, F.min(F.when(F.col("target_share") > 0, F.col("capacity") / F.col("target_share"))).over(everything)) if hold else all_tokens
    t = t.withColumn("demand", F.col("target_share") * most)
    return t.withColumn("taken", F.least("demand", F.col("capacity").cast("double"))).drop("len_rank", "lean")


def mix(sizes: DataFrame, plan: DataFrame, seed: int = 11, bucket_rows: int = 20_000) -> DataFrame:
    """The selection in training order: ``position`` (0 to 1), ``doc_id, source, use_no, n_tokens``.

    Every use of a source runs through its documents in another hash order, and ends when the demand is
    met, so each source gives ``taken`` tokens, over by less than one document. Texts without tokens,
    and sources without a target, are left out; a null id is a document like any other. Cumulative
    tokens are summed in hash buckets of about ``bucket_rows`` documents, so no source meets in one task.
    """
    p = plan.filter("docs > 0 and taken > 0").select("source", "docs", "tokens", "taken", "weights", "starts")
    docs = sizes.filter("n_tokens > 0").select("doc_id", source_key().alias("source"), "n_tokens")
    # one row a target: a table of settings, so a hot source is not shuffled by its name
    uses = docs.join(F.broadcast(p), "source").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("tokens")).cast("int"))))
    spread = F.xxhash64("doc_id", "use_no", F.lit(seed))
    buckets = F.ceil(F.col("docs") / bucket_rows)
    uses = uses.withColumn("h", spread)
    uses = uses.withColumn("bucket", F.floor(F.shiftrightunsigned("h", 11) / float(1 << 53) * buckets).cast("int"))
    place = ["source", "use_no", "bucket"]
    sums = uses.groupBy(*place).agg(F.sum("n_tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("use_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*place, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy(*place).orderBy(F.shiftrightunsigned("h", 11), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = uses.withColumn("upto", F.sum("n_tokens").over(inner)).join(sums, place)
    run = run.withColumn("begin", F.col("offset") + F.col("upto") - F.col("n_tokens")).filter(F.col("begin") < F.col("taken"))
    # invert the cumulative demand: the last phase that begins at or before this place, then within it
    x = F.least((F.col("begin") + F.col("n_tokens") / 2) / F.col("taken"), F.lit(1.0))
    run = run.withColumn("x", x).withColumn("phase", F.size(F.filter("starts", lambda s: s <= F.col("x"))) - 1)
    n = F.size("weights")
    position = (F.col("phase") + F.least((F.col("x") - F.get("starts", "phase")) * n / F.get("weights", "phase"), F.lit(1.0))) / n
    return run.select(position.alias("position"), "doc_id", "source", "use_no", "n_tokens").orderBy("position", "source", "doc_id", "use_no")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, target_share, reached_share, share_of_mix, tokens, most_uses, lacks`` of every target source.

    ``reached_share`` is of the total that was demanded, ``share_of_mix`` of what all sources gave; a source ``lacks``
    tokens if what it gave, all uses together, is less than its demand.
    """
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("got"), F.max("use_no").alias("most_uses"))
    whole = F.sum(F.coalesce("got", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    tokens = F.coalesce("got", F.lit(0))
    rows = plan.select("source", "target_share", "demand").join(got, "source", "left")
    reached = F.coalesce(F.round(tokens * F.col("target_share") / F.nullif("demand", F.lit(0.0)), 6), F.lit(0.0))
    return rows.select("source", "target_share", reached.alias("reached_share"), F.round(tokens / F.greatest(whole, F.lit(1)), 6).alias("share_of_mix"), tokens.alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), (tokens < F.col("demand")).alias("lacks"))
