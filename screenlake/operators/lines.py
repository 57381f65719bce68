"""Text lines from OCR boxes (WIN-1, WIN-2, SRT-3) and what is read off them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from screenlake.functions import geometry as G
from screenlake.functions.semantics import upper_median
from screenlake.operators.folds import fold_beside, fold_sorted
from screenlake.operators.ordered import islands


def group_lines_gap(items: DataFrame, rule: str = "document") -> DataFrame:
    """Rows by the distance to the *previous* item in (y, x) order.

    ``document``: top edges differ by more than max(8, 0.6 h).  ``code``: centres differ by
    more than max(4, half the larger height)."""
    b = G.box()
    if rule == "document":
        breaks = lambda p: F.abs(b.y - p["y"]) > F.greatest(F.lit(8.0), b.h * 0.6)
    else:
        breaks = lambda p: F.abs((p["y"] + p["h"] / 2) - b.cy) > F.greatest(F.lit(4.0), F.greatest(p["h"], b.h) * 0.5)
    order = [F.col("y"), F.col("x"), F.col("ord")]
    return islands(items, ["image_id"], F.col("y"), order, ["y", "h"], breaks, "line")


def group_lines_fold(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First-fit lines: an item joins the first line whose running mean centre is within
    max(10, 0.6 median height), in centre order.  Adds ``line`` (0-based).

    Items with the same centre always end in the same line (joining moves the mean toward
    them), so they are added to its mean together.  Only lines that can still accept are
    remembered.  Items are dealt by group and sorted once; the fold passes along them."""
    keys = keys or ["image_id"]
    # sorted for the fold already, which the window keeps
    rows = items.withColumn("_cy", G.box().cy).repartition(*keys).sortWithinPartitions(*keys, "_cy")
    rows = rows.withColumn("_m", upper_median("h").over(W.partitionBy(*keys)))
    tol = F.greatest(F.lit(10.0), F.when(F.col("_m") == 0, 20.0).otherwise(F.col("_m")) * 0.6)
    rows = rows.withColumn("_tol", tol).drop("_m").where(F.col("_cy").isNotNull())
    n = len(keys)

    def lines_of(group: Iterator[tuple]) -> Iterator[int]:
        opened, live, centre, count = 0, [], None, 0
        for row in group:
            y, tolerance = row[n:]
            # Spark takes NaN as equal to itself
            if count and (y == centre or (y != y and centre != centre)):
                count += 1
            else:
                if count and first[1]:
                    first[0] = (first[0] * first[1] + centre * count) / (first[1] + count)
                if count:
                    first[1] += count
                # centres ascend: a line whose mean is out of reach stays so
                live = [line for line in live if abs(line[0] - y) <= tolerance]
                if not live:
                    live = [[y, 0, opened]]
                    opened += 1
                first, centre, count = live[0], y, 1
            yield first[2]

    line = T.StructField("line", T.IntegerType())
    return fold_beside(rows, keys, ["_cy"], ["_cy", "_tol"], line, lines_of).drop("_cy", "_tol")


def flow_clusters(items: DataFrame) -> DataFrame:
    """First-fit flow nodes: in centre order an item joins the first cluster whose union
    box is centred within max(12, 0.8 h) of it.  Adds ``cluster``.

    Items with equal top and bottom share a cluster, so the fold runs over the distinct
    (top, bottom) extents; equal centres are taken shorter extent first."""
    b = G.box()
    rows = items.withColumn("_y1", b.y).withColumn("_y2", b.bottom)
    ext = rows.select("image_id", "_y1", "_y2").where(F.col("_y1").isNotNull() & F.col("_y2").isNotNull()).distinct()
    tallest = ext.groupBy("image_id").agg(F.max(F.col("_y2") - F.col("_y1")).alias("_h"))
    cy, h = (F.col("_y1") + F.col("_y2")) / 2, F.col("_y2") - F.col("_y1")
    entries = ext.join(tallest, "image_id").select("image_id", cy.alias("cy"), h.alias("h"), "_y1", "_y2", "_h")

    def clusters_of(group: Iterator[tuple]) -> Iterator[tuple]:
        opened, live = 0, []
        for image, cy, h, y1, y2, tallest in group:
            # centres ascend: what even the tallest item cannot reach from here stays out of reach
            live = [c for c in live if (c[0] + c[1]) / 2 >= cy - max(12.0, tallest * 0.8)]
            tolerance = max(12.0, h * 0.8)
            hit = next((c for c in live if abs((c[0] + c[1]) / 2 - cy) <= tolerance), None)
            if hit is None:
                hit = [y1, y2, opened]
                live.append(hit)
                opened += 1
            else:
                hit[0], hit[1] = min(hit[0], y1), max(hit[1], y2)
            yield image, y1, y2, hit[2]

    schema = T.StructType([rows.schema["image_id"], T.StructField("_y1", T.DoubleType()), T.StructField("_y2", T.DoubleType()), T.StructField("cluster", T.IntegerType())])
    out = fold_sorted(entries, ["image_id"], ["cy", "h", "_y1", "_y2"], schema, clusters_of)
    return rows.join(out, ["image_id", "_y1", "_y2"]).drop("_y1", "_y2")


def reading_order(items: DataFrame, row_tol: float = 8.0) -> DataFrame:
    """Rank of every item by line (centre steps above ``row_tol`` open a line) and then
    centre x.  The rank is the number of items in earlier lines plus the place in the
    own line, so no task holds an image."""
    from pyspark.sql import Window as W

    rows = items.withColumn("_cy", G.box().cy).withColumn("_cx", G.box().cx)
    order = [F.col("_cy"), F.col("_cx"), F.col("ord")]
    lined = islands(rows, ["image_id"], F.col("_cy"), order, ["_cy"], lambda p: F.col("_cy") - p["_cy"] > row_tol, "line")
    sizes = lined.groupBy("image_id", "line").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("image_id", "line", (F.sum("_n").over(W.partitionBy("image_id").orderBy("line")) - F.col("_n")).alias("_b"))
    place = F.row_number().over(W.partitionBy("image_id", "line").orderBy("_cx", "ord"))
    return lined.withColumn("_p", place).join(before, ["image_id", "line"]).withColumn("rank", F.col("_b") + F.col("_p")).drop(
        "_p", "_b", "_cy", "_cx"
    )
