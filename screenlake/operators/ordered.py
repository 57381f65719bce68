"""Ordered scans that do not need a whole group in one task.

A plain ``lag`` or running sum over ``partitionBy(image_id)`` sends an image to one task.
Here the order axis is cut into bands: the scan runs inside ``(keys, band)`` and the last
row (or the sum) of earlier bands is carried over from a small per-band table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def with_previous(
    df: DataFrame, keys: Sequence[str], axis: Column, order: Sequence[Column | str], cols: Sequence[str], band: float = 256.0
) -> DataFrame:
    """Add ``prev`` (struct of ``cols`` of the preceding row, NULL for the first) and the
    helper column ``_band``.  ``order`` must start with ``axis``."""
    by = [*keys, "_band"]
    rows = df.withColumn("_band", F.floor(axis / band).cast("long"))
    scan = W.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_prev", F.lag(F.struct(*cols)).over(scan))
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    carry = last.select(*by, F.lag("_last").over(W.partitionBy(*keys).orderBy("_band")).alias("_carry"))
    rows = rows.join(carry, by, "left")
    return rows.withColumn("prev", F.coalesce("_prev", "_carry")).drop("_prev", "_carry")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` over rows that carry ``_band`` (see ``with_previous``)."""
    by = [*keys, "_band"]
    rows = df.withColumn("_v", value)
    sums = rows.groupBy(*by).agg(F.sum("_v").alias("_s"))
    before = sums.select(*by, (F.sum("_s").over(W.partitionBy(*keys).orderBy("_band")) - F.col("_s")).alias("_before"))
    rows = rows.withColumn("_local", F.sum("_v").over(W.partitionBy(*by).orderBy(*order)))
    rows = rows.join(before, by, "left")
    return rows.withColumn(name, F.col("_before") + F.col("_local")).drop("_v", "_local", "_before")


def islands(
    df: DataFrame,
    keys: Sequence[str],
    axis: Column,
    order: Sequence[Column | str],
    cols: Sequence[str],
    breaks: Callable[[Column], Column],
    name: str,
    band: float = 256.0,
) -> DataFrame:
    """Number the runs of rows between breaks (0-based).  ``breaks`` gets the previous row
    as a struct column; the first row of a group never breaks."""
    rows = with_previous(df, keys, axis, order, cols, band)
    step = F.when(F.col("prev").isNotNull() & breaks(F.col("prev")), 1).otherwise(0)
    return running_sum(rows, keys, order, step.cast("long"), name).drop("prev", "_band")


def running_max_before(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column, order: Sequence[Column | str], name: str, band: float = 256.0) -> DataFrame:
    """Maximum of ``hi`` over all earlier rows of a group (NULL for the first), in bands of
    ``lo``.  ``order`` must start with ``lo``.  Leaves ``_band`` for ``running_sum``."""
    by = [*keys, "_band"]
    rows = df.withColumn("_hi", hi).withColumn("_band", F.floor(lo / band).cast("long"))
    before = W.unboundedPreceding, -1
    inside = F.max("_hi").over(W.partitionBy(*by).orderBy(*order).rowsBetween(*before))
    tops = rows.groupBy(*by).agg(F.max("_hi").alias("_top"))
    carry = tops.select(*by, F.max("_top").over(W.partitionBy(*keys).orderBy("_band").rowsBetween(*before)).alias("_carry"))
    rows = rows.withColumn("_in", inside).join(carry, by, "left")
    return rows.withColumn(name, F.greatest("_in", "_carry")).drop("_hi", "_in", "_carry")


def nearest(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], axis: str, cols: Sequence[str], band: float = 256.0) -> DataFrame:
    """Add ``near``: struct of ``axis`` and ``cols`` of the anchor whose ``axis`` value is nearest
    to the row's (ties: the smaller value, then the smaller ``cols``); NULL without an anchor.

    Anchors lie between the rows of their band in two sorted scans, up and down; bands without
    one take theirs from a small per-band table.  No row holds the anchors of its group."""
    by = [*keys, "_band"]
    known = anchors.where(F.col(axis).isNotNull()).groupBy(*keys, axis).agg(F.min(F.struct(axis, *cols)).alias("_anchor"))
    both = rows.withColumn("_row", F.lit(True)).unionByName(known, allowMissingColumns=True)
    both = both.withColumn("_band", F.floor(F.col(axis) / band).cast("long"))
    seen = lambda order: F.last("_anchor", True).over(W.partitionBy(*by).orderBy(order))
    both = both.withColumn("_below", seen(F.asc(axis))).withColumn("_above", seen(F.desc(axis)))
    ends = both.groupBy(*by).agg(F.min("_anchor").alias("_lo"), F.max("_anchor").alias("_hi"))
    beyond = lambda end, order: F.last(end, True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*by, beyond("_hi", F.asc("_band")).alias("_left"), beyond("_lo", F.desc("_band")).alias("_right"))
    both = both.where("_row").join(ends, by, "left")
    below, above = F.coalesce("_below", "_left"), F.coalesce("_above", "_right")
    gap = lambda a: F.abs(F.col(axis) - a[axis])
    near = F.when(above.isNull() | (gap(below) <= gap(above)), below).otherwise(above)
    return both.select(*rows.columns, near.alias("near"))


def with_part(rows: DataFrame, at: Column, extents: DataFrame, keys: Sequence[str], lo: Column, hi: Column, cell: float = 64.0) -> DataFrame:
    """Add ``_part``: groups are cut where no extent ``lo`` to ``hi`` of ``extents`` crosses.

    ``at`` is a coordinate of each row inside its extent.  Extents are first reduced to the
    farthest end for each starting cell, so the running maximum goes over that small table and
    the rows themselves are neither sorted nor numbered here."""
    step = lambda c: F.floor(c / cell).cast("long")
    ends = extents.groupBy(*keys, step(lo).alias("_c")).agg(F.max(step(hi)).alias("_e"))
    order = W.partitionBy(*keys).orderBy("_c")
    ends = ends.withColumn("_reach", F.max("_e").over(order.rowsBetween(W.unboundedPreceding, -1)))
    starts = F.when(F.col("_c") > F.col("_reach"), 1).otherwise(0).cast("long")
    parts = ends.select(*keys, "_c", F.sum(starts).over(order).alias("_p"))
    # rows without a place keep to themselves, as one part
    return rows.withColumn("_c", step(at)).join(parts, [*keys, "_c"], "left").withColumn("_part", F.coalesce("_p", F.lit(-1))).drop("_c", "_p")
