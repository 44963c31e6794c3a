"""Mixing sources to target weights by weighted fair queueing, on DataFrames only.

Each source is a queue: its documents in shuffled order, then the same again, up to ``epochs`` times.
A copy's virtual finish time is its source's words up to and with it, divided by the source's
weight. Copies of all sources are sorted by that time into ranges, and the order is cut where the
running sum of words reaches the total budget. A queue that has run empty stops, and the others share
what it leaves by weight; so a source gets about the lesser of its weight's share and ``epochs`` times
its size, and ends within a document of it.

Running sums go over ranges of the order: a sum for each range, sums of the ranges before it, then
sums within it. No task gets a whole source, or all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import in_ranges, running, scratch, shielded, written

WEIGHTS = (5, 2, 1)
BUDGET, EPOCHS = 1.5, 2


def n_words(text: Column | str) -> Column:
    """The number of runs of other than ASCII white space."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    return F.coalesce((F.size(parts) - F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """``sizes``: source, source_size; a row for each source. Adds weight, and target: by weight, none above
    ``epochs`` times its size, ``budget`` times all sizes in all."""
    place = running(sizes, [F.col("source").asc_nulls_last()], "sources", _place=F.lit(1))
    full = F.col("source_size") * epochs
    ranked = place.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))).drop("_place").withColumn("ratio", full / F.col("weight"))
    by = written(running(ranked, [F.col("ratio"), F.col("source").asc_nulls_last()], "ratios", _full=full, _weight=F.col("weight")), "levels")
    total = by.agg(F.sum("source_size"), F.sum("weight")).first()
    # If the sources before this one are full, and this and the rest are not: their level.
    level = F.try_divide(F.lit(float(total[0] or 0) * budget) - F.col("_full"), F.lit(total[1]) - F.col("_weight"))
    least = by.where(level <= F.col("ratio")).agg(F.min(F.struct("ratio", level.alias("level")))["level"]).first()[0]
    target = full.cast("double") if least is None else F.least(full.cast("double"), F.col("weight") * F.lit(least))
    return by.select("source", "source_size", "weight", target.alias("target"))


def finish_time(epoch: Column) -> Column:
    """The virtual finish time of a copy."""
    return (F.col("source_size") * epoch + F.col("before") + F.col("size")) / F.col("weight")


def tie(epoch: Column) -> Column:
    """What orders copies of one finish time."""
    return F.xxhash64(F.lit("tie"), "doc_id", "source", "digest", epoch)


def tagged(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """``rows``: doc_id, source, digest (of the text), size (long). Adds source_size, weight, target, before (words
    of the source's shuffled order ahead of this document) and copies (numbers of those that are taken)."""
    with scratch() as keep:
        source = F.col("source").asc_nulls_last()
        shuffled = rows.withColumn("u", F.xxhash64(F.lit("mix"), "doc_id", "digest"))
        queues = written(running(shuffled, [source, F.col("u"), F.col("doc_id"), F.col("digest"), F.col("size")], "queues", ahead=F.col("size")), "queued")
        sizes = queues.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("ahead").alias("start"))
        goal = targets(sizes.select("source", "source_size"), weights, budget, epochs)
        known = goal.join(sizes.select(F.col("source").alias("s"), "start"), F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "weight", "target", "start")
        own = queues.join(written(known, "goals"), F.col("source").eqNullSafe(F.col("s"))).withColumn("before", F.col("ahead") - F.col("start")).drop("s", "u", "ahead", "start")
        own = keep(written(own, "tagged"))
        total = own.agg(F.sum("size")).first()[0] or 0
        numbers = F.array(*(F.lit(e) for e in range(epochs)))
        copies = own.withColumn("e", F.explode(numbers)).select(finish_time(F.col("e")).alias("finish"), tie(F.col("e")).alias("tie"), "size")
        order, ahead, within = in_ranges(copies, [F.col("finish"), F.col("tie"), F.col("size")], "order", ahead=F.col("size"))
        # The budget ends in one range: running sums are needed there alone.
        last = ahead.where(F.col("ahead") <= budget * total).agg(F.max(F.struct("ahead", "_range"))).first()[0]
        cut = None
        if last:
            inner = order.where(F.col("_range") == last["_range"]).withColumn("in", F.coalesce(F.sum("size").over(within), F.lit(0)))
            fits = inner.where(F.lit(last["ahead"]) + F.col("in") + F.col("size") / 2 <= budget * total).select("finish", "tie")
            cut = order.where(F.col("_range") < last["_range"]).select("finish", "tie").unionByName(fits).agg(F.max(F.struct("finish", "tie"))).first()[0]
        if cut is None:
            taken = F.array().cast("array<int>")
        else:
            taken = F.filter(numbers, lambda e: (finish_time(e) < cut["finish"]) | ((finish_time(e) == cut["finish"]) & (tie(e) <= cut["tie"])))
        return own.withColumn("copies", taken)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), n_words("text").alias("size"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken (words the mix takes, repeats counted).

    Null text: size 0. Null source: a source, after all others. Null doc_id: as any other. Repeated
    rows: each counts. Empty table: no rows. All sizes 0: targets 0. Extra columns are ignored."""
    out = tagged(written(sized(docs), "sizes"), **how)  # ranges read their rows twice
    return out.select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs``, repeats included, sorted by virtual finish time over ranges of
    it, with two columns more: epoch (0 and up) and virtual_finish. Columns of ``docs`` that bear these
    names are replaced."""
    docs, back = shielded(docs.drop("epoch", "virtual_finish"), "_d", "_s", "_h", "_n", "_m", "weight", "source_size", "before", "size", "copies", "digest")
    keyed = docs.withColumn("digest", F.xxhash64("text"))
    tags = tagged(written(sized(docs), "sizes"), **how).where(F.size("copies") > 0).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("digest").alias("_h"), "size", "weight", "source_size", "before", "copies")
    # Rows alike in all three are told apart by number only where there are several of them.
    tags = written(tags.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_s", "_h").orderBy("before"))), "tags")
    many = tags.where("_n > 1").limit(1).count() > 0
    if many:
        keyed = keyed.withColumn("_m", F.row_number().over(Window.partitionBy("doc_id", "source", "digest").orderBy("text")))
    else:
        keyed = keyed.withColumn("_m", F.lit(1))
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("digest") == F.col("_h")) & (F.col("_m") == F.col("_n"))
    out = keyed.join(tags, on).withColumn("epoch", F.explode("copies"))
    return out.withColumn("virtual_finish", finish_time(F.col("epoch"))).select(*docs.columns, "epoch", "virtual_finish").orderBy("virtual_finish", "doc_id").withColumnsRenamed(back)
