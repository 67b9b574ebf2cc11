"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the key order is the
order in which a mix takes documents; a source's budget is cut at an exact
place of the running sum of words in that order.

* the key range of each source is divided into bins, their number following
  the source's rows, so a source that holds a third of all rows has more bins,
  not larger ones;
* bin sums and a running sum over bins (one row per bin) find the bin in which
  the budget ends, and only that bin's rows are sorted for the exact place;
* what is left is one row per source (epochs, cutting key, part), joined back
  on the source.  Texts are never shuffled.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; rows that repeat a document (same id, source and size) tie and
share the part that falls on them evenly, rounded down; a null id counts as
the text ``null`` in the key; an empty table gives an empty result; a text's
length does not matter, as only its number of words is kept; other columns are
carried along by ``mixed_documents`` and not read else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binscore.llm.common import broadcast_if_small, word_count_udf
from binscore.session import cut_lineage

KEY_BITS = 60


def mix_key(doc_id: Column, seed: int) -> Column:
    """60 hash-random bits of the id, the same in every run and engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """Words each source gives: ``(source, source_size, target)``.

    ``sizes`` has one row per source.  ``share`` of all words is dealt by
    weight (repeating in code-point order, null last); no target passes
    ``max_epochs`` times its source's size, and what is above goes to the
    others by weight.  In the order of size / weight the capped sources come
    first, so one running sum finds the level at which nothing is above."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * F.lit(max_epochs)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]),
                                                ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_level = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    w = w.withColumn("level", level).withColumn("cap", cap)
    # the first source whose share by weight stays within its cap sets the level of all that follow
    w = w.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                                           F.struct((F.col("cap") / F.col("weight")).alias("r"),
                                                    F.col("level").alias("l")))).over(whole)["l"])
    by_weight = F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), by_weight).alias("target"))


def mix_cuts(sized: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_epochs: int = 3,
             rows_per_bin: int = 50_000) -> DataFrame:
    """One row per source: ``source, source_size, target, epochs`` (whole
    passes), and where the last pass ends: ``cut_key, cut_id, cut_size``,
    ``cut_part`` (words that it takes at that place, over ``cut_rows`` tied
    rows).  ``sized``: ``doc_id, source, size, mix_key``."""
    by_source = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                                        F.count("*").alias("source_rows")))
    plan = (targets(by_source.select("source", "source_size"), weights, share, max_epochs)
            .withColumn("goal", F.floor(F.col("target") + 0.5))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)))
            .withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size")))
    plan = cut_lineage(plan.join(by_source.select(F.col("source").alias("_s"), "source_rows"),
                                 F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
                       .withColumn("bins", F.ceil(F.col("source_rows") / F.lit(rows_per_bin))))
    width = F.ceil(F.lit(1 << KEY_BITS) / F.col("bins")).cast("long")
    by_name = broadcast_if_small(plan.select(F.col("source").alias("_s"), "bins", "rest"))
    rows = (sized.join(by_name, F.col("source").eqNullSafe(F.col("_s")))
            .where(F.col("rest") > 0)
            .withColumn("bin", F.floor(F.col("mix_key") / width).cast("long")))
    bins = rows.groupBy("source", "rest", "bin").agg(F.sum("size").alias("bin_size"))
    run = Window.partitionBy("source").orderBy("bin")
    last = (bins.withColumn("bin_end", F.sum("bin_size").over(run))
            .where((F.col("bin_end") >= F.col("rest")) & (F.col("bin_end") - F.col("bin_size") < F.col("rest")))
            .groupBy(F.col("source").alias("_c"))
            .agg(F.min(F.struct("bin", (F.col("bin_end") - F.col("bin_size")).alias("bin_start"))).alias("at")))
    inside = (rows.join(last, F.col("source").eqNullSafe(F.col("_c")) & (F.col("bin") == F.col("at.bin")))
              .groupBy("source", "rest", "at", "mix_key", "doc_id", "size")
              .agg(F.count("*").alias("tied")))
    order = Window.partitionBy("source").orderBy("mix_key", "doc_id", "size")
    total = F.col("size") * F.col("tied")
    cut = (inside.withColumn("end", F.col("at.bin_start") + F.sum(total).over(order))
           .where((F.col("end") >= F.col("rest")) & (F.col("end") - total < F.col("rest")))
           .select(F.col("source").alias("_c"), F.col("mix_key").alias("cut_key"), F.col("doc_id").alias("cut_id"),
                   F.col("size").alias("cut_size"), (F.col("rest") - F.col("end") + total).alias("cut_part"),
                   F.col("tied").alias("cut_rows")))
    return cut_lineage(plan.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left")
                       .select("source", "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size",
                               "cut_part", "cut_rows"))


def _place(key: Column, doc_id: Column, size: Column) -> tuple[Column, Column]:
    """Whether a row lies before its source's cut, and whether at it."""
    at = (key == F.col("cut_key")) & doc_id.eqNullSafe(F.col("cut_id")) & (size == F.col("cut_size"))
    before = F.struct(key, doc_id, size) < F.struct(F.col("cut_key"), F.col("cut_id"), F.col("cut_size"))
    some = F.col("cut_key").isNotNull()
    return F.coalesce(some & before, F.lit(False)), F.coalesce(some & at, F.lit(False))


def with_size(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size, mix_key`` of every row."""
    return docs.select("doc_id", "source", word_count_udf()(F.col("text")).alias("size"),
                       mix_key(F.col("doc_id"), seed).alias("mix_key"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_epochs: int = 3,
                seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row:
    ``taken`` are the words the mix takes of it, repeats counted, exact to the
    word: the row at the cut gives only its part."""
    sized = cut_lineage(with_size(docs, seed))
    cuts = broadcast_if_small(mix_cuts(sized, weights, share, max_epochs).withColumnRenamed("source", "_m"))
    before, at = _place(F.col("mix_key"), F.col("doc_id"), F.col("size"))
    taken = (F.col("epochs") * F.col("size") + F.when(before, F.col("size"))
             .when(at, F.expr("cut_part div cut_rows")).otherwise(F.lit(0)))
    return (sized.join(cuts, F.col("source").eqNullSafe(F.col("_m")))
            .select("doc_id", "source", F.col("size").cast("long"), F.col("source_size").cast("long"), "target",
                    taken.cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_epochs: int = 3,
                    seed: int = 17) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated once per epoch, all columns
    kept.  Documents stay whole: the one at the cut is taken a last time if at
    least half of it fits."""
    sized = cut_lineage(with_size(docs, seed))
    cuts = mix_cuts(sized, weights, share, max_epochs)
    cuts = broadcast_if_small(cuts.select(F.struct(*cuts.columns).alias("_llm_cut")))
    names = docs.columns
    size, key = word_count_udf()(F.col("text")), mix_key(F.col("doc_id"), seed)
    rows = (docs.select(F.struct(*[docs[c] for c in names]).alias("_llm_row"), size.alias("_llm_size"),
                        key.alias("_llm_key"))
            .join(cuts, F.col("_llm_row.source").eqNullSafe(F.col("_llm_cut.source")))
            .select("_llm_row", F.col("_llm_size").alias("size"), F.col("_llm_key").alias("mix_key"), "_llm_cut.*"))
    before, at = _place(F.col("mix_key"), F.col("_llm_row.doc_id"), F.col("size"))
    fits = at & (F.expr("2 * cut_part >= cut_size * cut_rows"))
    copies = F.col("epochs") + F.when(before | fits, 1).otherwise(0)
    # a document without words costs nothing and is kept once
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(copies).cast("int")
    return (rows.select("_llm_row", F.explode(F.array_repeat(F.lit(0), copies)).alias("_llm_copy"))
            .select("_llm_row.*"))
