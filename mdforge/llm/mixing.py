"""Mixing sources to target weights along a time-varying curriculum, in DataFrame terms only.

Every source has a weight that changes linearly over the training run: from
``(1 - ramp) * target`` to ``(1 + ramp) * target`` or the reverse, by the source's place.
The integral of the schedule is the source's cumulative token demand; it ends at its
target. Documents of a source queue in a fixed pseudo-random order, again and again; the
inverse of the demand gives the moment at which a queued copy is asked for, and a range
sort by that moment is the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdforge.llm.common import WORD_RE, settle

#: No document is used more often than this.
MOST = 3.0
#: How far a source's weight is from its mean at either end of the run, as a share of it.
RAMP = 0.5


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE.replace("+", "++"))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """(source, source_size, place, target) of a table (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a
    target stops at ``most`` times its source, the excess goes to the others by weight.
    The sources are sorted by size / weight: those before some place are full, the rest
    share what is left, and prefix sums give that place at once. The table has one row
    per source.
    """
    spark = sizes.sparkSession
    by_name = Window.partitionBy("all").orderBy(F.col("source").isNull(), F.col("source"))
    by_fill = Window.partitionBy("all").orderBy("fill", "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("all", F.lit(0)).withColumn("place", F.row_number().over(by_name) - 1).withColumn("w", w)
    s = s.withColumn("fill", F.lit(most) * F.col("source_size") / F.col("w"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy("all")
    s = (
        s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("full", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("w_rest", F.sum("w").over(rest))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("w_rest"))
        .withColumn("open", F.col("fill") > F.col("level"))
        .withColumn("rate", F.min(F.when(F.col("open"), F.col("level"))).over(everything))
    )
    # The first source that the level doesn't fill fixes the level for all after it.
    first = F.min(F.when(F.col("open"), F.struct("fill", "place", "level"))).over(everything)
    s = s.withColumn("rate", first["level"])
    target = F.least(F.lit(most) * F.col("source_size"), F.coalesce(F.col("rate") * F.col("w"), F.lit(most) * F.col("source_size")))
    return s.select("source", "source_size", "place", target.alias("target"))


def moment(words_before: Column, target: Column, rising: Column, ramp: float) -> Column:
    """Inverse of the demand ``target * ((1 -+ ramp) t +- ramp t^2)``: t in 0..1."""
    y = F.least(words_before / target, F.lit(1.0))
    a = F.when(rising, F.lit(ramp)).otherwise(F.lit(-ramp))
    b = F.lit(1.0) - a
    return F.when(target <= 0, F.lit(0.0)).otherwise(2 * y / (b + F.sqrt(F.greatest(b * b + 4 * a * y, F.lit(0.0)))))


def queue(docs: DataFrame, seed: int = 11, same: Column | None = None) -> DataFrame:
    """(doc_id, source, size, before, source_size, place, target, row, same): a source's queue.

    ``before``: words of the source's documents before this one, in the order of a hash
    whose first three hex digits name one of 4,096 buckets: running sums are taken inside
    a bucket of a source, then over the buckets, so no window holds a whole source.
    Repeated rows stay apart: they get different places in the queue and a ``row`` number of
    their own; ``same`` is a value that equal rows share. Null ids, sources and texts are
    allowed. An empty table gives an empty queue.
    """
    same = F.lit(0).cast("long") if same is None else same
    size = docs.select("doc_id", "source", words(F.col("text")).alias("size"), same.alias("same"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = size.withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3)).withColumn("row", F.monotonically_increasing_id())
    size = settle(size, "sizes")
    per_bucket = size.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_bucket = settle(per_bucket, "buckets")
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = per_bucket.withColumn("start", F.coalesce(F.sum("bucket_size").over(w), F.lit(0))).drop("bucket_size")
    start = start.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "same").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    on = F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket"))
    return size.join(start.alias("b"), on).select(
        "d.doc_id", "d.source", "d.size", (F.col("within") + F.col("start")).alias("before"), "source_size", "place", "target", "d.row", "d.same"
    )


def _taken(epoch: Column) -> Column:
    """Words of a document that the mix takes in an epoch: the last one may cut it."""
    left = F.round("target").cast("long") - epoch * F.col("source_size") - F.col("before")
    return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")


def copies(queued: DataFrame, ramp: float = RAMP) -> DataFrame:
    """The copies of queued documents that the mix uses: the queue's columns, epoch, words, position.

    ``words`` of a copy are asked for, all of them but where the source's demand ends.
    ``position`` (0..1) is when the demand reaches the copy's middle.
    """
    c = queued.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(int(MOST))])))
    c = c.withColumn("words", _taken(F.col("epoch"))).where(F.col("words") > 0)
    middle = F.col("epoch") * F.col("source_size") + F.col("before") + F.col("words") / 2
    return c.withColumn("position", moment(middle, F.col("target"), F.col("place") % 2 == 0, ramp))


def in_order(c: DataFrame) -> DataFrame:
    """Copies sorted by position: partitions are consecutive stretches of the training run."""
    return c.repartitionByRange("position", "source", "doc_id", "epoch").sortWithinPartitions("position", "source", "doc_id", "epoch")


def mix_counts(docs: DataFrame, ramp: float = RAMP, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken (words used, repeats counted), epochs, position.

    One row per row of ``docs``, summed over its copies in the curriculum; ``position`` is
    that of the first copy, null without one. The words taken of a source add up to its
    target, rounded; at most one document of a source is cut.
    """
    q = settle(queue(docs, seed), "queue")
    run = settle(in_order(copies(q.select("row", "doc_id", "source", "size", "before", "source_size", "place", "target"), ramp)), "curriculum")
    used = run.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").cast("int").alias("epochs"), F.min("position").alias("position"))
    return q.join(used, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("epochs", F.lit(0)).alias("epochs"), "position"
    )


def curriculum(docs: DataFrame, ramp: float = RAMP, seed: int = 11) -> DataFrame:
    """(doc_id, source, epoch, words, position) of all copies in training order."""
    return in_order(copies(queue(docs, seed), ramp)).select("doc_id", "source", "epoch", "words", "position")


def mixed_documents(docs: DataFrame, ramp: float = RAMP, seed: int = 11) -> DataFrame:
    """``docs`` in training order, a row for each copy the mix uses, same columns.

    Copies are whole documents: the one that the end of a source's demand cuts comes if at
    least half of it is asked for, or if it is the source's first, so that every source with
    words has one. Documents without words have nothing to mix and go. Rows that share an
    id, or have none, count and come one by one.
    """
    same = F.xxhash64(*[F.col(f"`{x}`") for x in docs.columns])
    q = settle(queue(docs, seed, same), "queue")
    c = copies(q, ramp)
    c = c.where((2 * F.col("words") >= F.col("size")) | ((F.col("epoch") == 0) & (F.col("before") == 0)))
    c = c.select(F.col("doc_id").alias("_id"), F.col("same").alias("_key"), F.struct("position", "epoch").alias("_copy"))
    # Rows that are equal in all columns become one; each of their copies takes it. Other
    # rows, which are nearly all, are not dealt out for it.
    d = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_doc"), same.alias("_same"), F.col("doc_id").alias("_doc_id"))
    again = settle(q.groupBy("doc_id", "same").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_eid"), F.col("same").alias("_ekey")), "again")
    equal = F.col("_doc_id").eqNullSafe(F.col("_eid")) & (F.col("_same") == F.col("_ekey"))
    d = d.join(again, equal, "left_anti").union(d.join(again, equal, "left_semi").dropDuplicates(["_doc_id", "_same"]))
    out = d.join(c, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_key")))
    return out.repartitionByRange(F.col("_copy.position"), F.col("_id")).sortWithinPartitions("_copy.position", "_id", "_copy.epoch").select("_doc.*")
