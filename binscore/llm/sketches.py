"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every distinct hash of a five-word shingle that lies below a
fixed fraction of the hash range, and the smallest hash whatever it is, so
that short texts have one too.  Its size follows the text, and so sketches of
very unequal texts can be compared: the share of the smaller sketch that the
larger one has estimates containment.  The sketch of a union is made from the
union of sketches (``merge``).

Defined results: a null text counts as empty; a text without words has an
empty sketch, which is like another empty one (1) and unlike any other (0); a
text of fewer than five words has one shingle, its whole word sequence; equal
texts have equal sketches.  The next document is the next row by descending
id, null ids last, rows of one id by their text; the last row's is the first,
a single row's itself; an empty table gives no rows; whole texts are sketched
whatever their length; other columns are not read.  Rows of one id are dealt by
the first ``PREFIX`` characters of their text; equal rows stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: One hash in this many is kept.
SCALE = 4
WHITE = "\t\n\x0b\x0c\r "


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def shingle_hashes(found: Column) -> Column:
    """XXH64 of each run of ``SHINGLE`` words (of all if there are fewer)."""
    many = F.transform(F.sequence(F.lit(1), F.size(found) - (SHINGLE - 1)),
                       lambda i: F.xxhash64(F.slice(found, i, F.lit(SHINGLE))))
    return (F.when(F.size(found) >= SHINGLE, many).when(F.size(found) > 0, F.array(F.xxhash64(found)))
            .otherwise(F.array().cast("array<long>")))


def _kept(hashes: Column, scale: int) -> Column:
    limit = F.lit(-(1 << 63) + (1 << 64) // scale)
    return let(hashes, lambda h: let(F.array_min(h), lambda least: F.array_sort(F.array_distinct(
        F.filter(h, lambda x: (x < limit) | (x == least))))))


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Sorted hashes that the sketch of a text keeps."""
    return _kept(let(words(text), shingle_hashes), scale)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return _kept(F.concat(a, b), scale)


def likeness(a: Column, b: Column, a_size: Column, b_size: Column) -> Column:
    """Estimated containment of the smaller text in the larger, 0 to 1.  Which
    one is smaller is told by the texts' sizes: by the sketches' own it would
    be the one that happened to keep less."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return (F.when(none, (F.size(a) == F.size(b)).cast("double"))
            .otherwise(F.size(F.array_intersect(a, b)) / F.when(a_size <= b_size, F.size(a)).otherwise(F.size(b))))


def as_text(kept: Column) -> Column:
    """The sketch as 16 hex digits a hash."""
    return F.array_join(F.transform(kept, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


#: Characters of a text that tell rows of one frequent id apart.
PREFIX = 200


def _place(text: Column) -> Column:
    """What rows are ordered by, ascending: descending id, null ids last, text."""
    return F.struct(F.isnull("doc_id").alias("none"), F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(0).cast("long")).alias("id"),
                    text.alias("text"))


def _literal(place) -> Column:
    return F.struct(F.lit(place["none"]).alias("none"), F.lit(place["id"]).cast("long").alias("id"), F.lit(place["text"]).alias("text"))


def _cuts(rows: DataFrame, n: int) -> list:
    """At most about 2 n places between which the rows are dealt evenly: n
    approximate quantiles of the ids, and for an id with more than its share of
    all rows (at most n such) places within its rows, by their text."""
    ids = rows.select("doc_id")
    found = ids.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()
    cuts = [{"none": False, "id": ~int(c), "text": ""} for c in set(found[1] or [])]
    cuts.append({"none": True, "id": 0, "text": ""})
    hot = ids.groupBy("doc_id").count().where(F.col("count") > max(found[0] / n, 1)).collect()
    if hot:
        side = F.broadcast(rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r["doc_id"]).cast("long") for r in hot])).alias("_hot")))
        part = rows.join(side, F.col("doc_id").eqNullSafe(F.col("_hot"))).select(_place(F.substring("text", 1, PREFIX)).alias("p"))
        share = min(n, -(-n * sum(r["count"] for r in hot) // max(found[0], 1)) + 1)
        least = part.repartitionByRange(share, "p").groupBy(F.spark_partition_id()).agg(F.min("p").alias("p"))
        cuts += [r["p"].asDict() for r in least.collect()]
    keyed = {(c["none"], c["id"], c["text"].encode()): c for c in cuts}
    return [keyed[k] for k in sorted(keyed)]


def _range_of(place: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at or before a place: a binary search."""
    bounds = F.array(*[_literal(c) for c in cuts])
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def step(at, size):
        return F.when((at + size <= len(cuts)) & (F.get(bounds, at + size - 1) <= place), at + size).otherwise(at)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), step)


def with_next(rows: DataFrame, carried=("text",)) -> DataFrame:
    """``rows`` (``doc_id``, ``text``, not null) with the next row's ``carried``
    columns as ``next_<column>``.

    Rows are dealt into ranges of their order; within one, the next row is the
    window's lead.  The first rows of a range are also sent, as guests, to the end
    of the range before it (those of the first to the last), so each text is
    shuffled once and no range is joined with another.  To the driver come the
    cuts and the first place of every range, about two a shuffle partition."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = _cuts(rows.select("doc_id", "text"), n)
    place = _place(F.substring("text", 1, PREFIX))
    ranged = rows.withColumn("_range", _range_of(place, cuts))
    first = {r["_range"]: r["p"] for r in ranged.select("_range", place.alias("p")).groupBy("_range").agg(F.min("p").alias("p")).collect()}
    if not first:  # no rows
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    used = sorted(first)
    before = dict(zip(used, used[-1:] + used[:-1]))
    every = range(len(cuts) + 1)
    firsts = F.array(*[_literal(first[r]) if r in first else F.lit(None) for r in every])
    hosts = F.array(*[F.lit(before.get(r)).cast("int") for r in every])
    homes = F.array(F.struct(F.lit(False).alias("guest"), F.col("_range").alias("range")),
                    F.when(F.get(firsts, F.col("_range")) == place,
                           F.struct(F.lit(True).alias("guest"), F.get(hosts, F.col("_range")).alias("range"))))
    dealt = ranged.withColumn("_home", F.explode(F.filter(homes, lambda h: h.isNotNull()))).drop("_range")
    dealt = dealt.select("*", "_home.*").drop("_home")
    window = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    led = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in carried])
    return led.where(~F.col("guest")).drop("guest", "range")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """For every row its sketch, its edited text (the last half replaced by
    the beginning of the next document), that text's sketch, and the likeness
    of its sketch to the edited text's and the next document's.  A document is
    sketched once, before it meets the next."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), sketch(F.col("text"), scale).alias("kept"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(rows, ("text", "n_chars", "kept")).select(
        "doc_id", "n_chars", "kept", edited.alias("edited"), "next_n_chars", "next_kept")
    rows = rows.select("*", F.char_length("edited").alias("n_edited"), sketch(F.col("edited"), scale).alias("edited_kept"))
    return rows.select(
        "doc_id", "n_chars", "kept", "edited", "edited_kept",
        likeness(F.col("kept"), F.col("edited_kept"), F.col("n_chars"), F.col("n_edited")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept"), F.col("n_chars"), F.col("next_n_chars")).alias("near_next"))
