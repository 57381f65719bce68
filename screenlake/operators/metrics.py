"""Detection metrics, coverage, quality and profile aggregations (AGG-*)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from screenlake.functions import geometry as G
from screenlake.operators.folds import fold_sorted
from screenlake.operators.ordered import running_sum

# Element types whose recovery matters for editing.
CRITICAL_TYPES = [
    "button", "iconButton", "input", "textarea", "select", "checkbox", "radio", "switch", "link", "tab", "dropdown",
    "card", "listItem", "row", "text", "title", "subtitle", "image", "avatar", "icon", "badge", "tag", "table",
]


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _scores(df: DataFrame) -> DataFrame:
    """recall / precision / F1 from gt_count, pred_count, matched (0 on empty sides)."""
    recall, precision = _ratio(F.col("matched"), F.col("gt_count")), _ratio(F.col("matched"), F.col("pred_count"))
    df = df.withColumn("recall", recall).withColumn("precision", precision)
    total = F.col("recall") + F.col("precision")
    return df.withColumn("f1", F.when(total > 0, 2 * F.col("recall") * F.col("precision") / total).otherwise(F.lit(0.0)))


def _counts(gt: DataFrame, pred: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """gt / pred / matched counts per key: one union, one partially combined aggregate."""
    zero, one = F.lit(0), F.lit(1)
    area = F.greatest(F.lit(0.0), F.col("w")) * F.greatest(F.lit(0.0), F.col("h"))
    rows = gt.select(*keys, one.alias("g"), zero.alias("p"), zero.alias("m"), F.lit(0.0).alias("a"))
    rows = rows.unionAll(pred.select(*keys, zero, one, zero, area)).unionAll(matches.select(*keys, zero, zero, one, F.lit(0.0)))
    return rows.groupBy(*keys).agg(
        F.sum("g").alias("gt_count"), F.sum("p").alias("pred_count"), F.sum("m").alias("matched"), F.sum("a").alias("area")
    )


def detection_metrics(gt: DataFrame, pred: DataFrame, matches: DataFrame, meta: DataFrame) -> DataFrame:
    """Per image recall, precision, F1, capped coverage, counts and ``area``, the summed area of
    the predictions.  Images of ``meta`` without any box count with zeros."""
    page = F.col("width").cast("double") * F.col("height")
    both = _counts(gt, pred, matches, ["image_id"]).join(meta, "image_id", "full")
    out = _scores(both.fillna(0, ["gt_count", "pred_count", "matched"]).fillna(0.0, ["area"]))
    coverage = F.when(page > 0, F.least(F.lit(1.0), F.col("area") / page)).otherwise(F.lit(0.0))
    return out.select("image_id", "gt_count", "pred_count", "matched", "recall", "precision", "f1", coverage.alias("coverage"), "area")


def detection_metrics_by_type(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """The same scores per (image, type) over the union of both sides' types."""
    out = _scores(_counts(gt, pred, matches, ["image_id", "type"]))
    return out.select("image_id", "type", "gt_count", "pred_count", "matched", "recall", "precision", "f1")


def benchmark_summary(per_image: DataFrame, per_type: DataFrame) -> DataFrame:
    """Corpus means; the macro F1 is the mean over types of the mean over images."""
    head = per_image.agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("mean_precision"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("mean_f1"),
        F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("mean_coverage"),
        F.count(F.lit(1)).alias("total_images"),
        F.coalesce(F.sum("pred_count"), F.lit(0)).alias("total_predictions"),
        F.coalesce(F.sum("gt_count"), F.lit(0)).alias("total_gt"),
    )
    macro = per_type.groupBy("type").agg(F.avg("f1").alias("f1")).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    # both sides are single rows
    return head.withColumn("_k", F.lit(1)).join(macro.withColumn("_k", F.lit(1)), "_k").drop("_k")


def coverage_capped(pred: DataFrame, meta: DataFrame) -> DataFrame:
    """Sum of box areas over page area, capped at 1 (overlap counts twice)."""
    area = F.greatest(F.lit(0.0), F.col("w")) * F.greatest(F.lit(0.0), F.col("h"))
    page = F.col("width").cast("double") * F.col("height")
    sums = pred.groupBy("image_id").agg(F.sum(area).alias("area"))
    out = meta.join(sums, "image_id", "left")
    share = F.when(page > 0, F.least(F.lit(1.0), F.coalesce("area", F.lit(0.0)) / page)).otherwise(F.lit(0.0))
    return out.select("image_id", share.alias("coverage"))


def union_area(boxes: DataFrame, keys: list[str] | None = None, tile: float = 256.0) -> DataFrame:
    """Exact area of the union of the boxes of each image.

    Boxes are clipped to the tiles they cover, each tile is swept along x on its own over a
    coverage tree of its distinct y edges (n log n), and the areas of the tiles are added up."""
    keys = keys or ["image_id"]
    from screenlake.operators.spatial import spread

    b = G.box()
    tiles = spread(boxes.where(G.valid_box(b)).select(*keys, "x", "y", "w", "h"), b, tile)
    x0, x1 = F.greatest(b.x, F.col("_tx") * tile), F.least(b.right, (F.col("_tx") + 1) * tile)
    y0, y1 = F.greatest(b.y, F.col("_ty") * tile), F.least(b.bottom, (F.col("_ty") + 1) * tile)
    cell = [*keys, "_tx", "_ty"]
    # equal clipped boxes add nothing: copies collapse before the sweep
    parts = tiles.select(*cell, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    parts = parts.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).distinct()
    n = len(keys)

    def sweep(group: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(group)
        yield (*rows[0][:n], covered_area([r[n + 2 :] for r in rows]))

    schema = T.StructType([*(parts.schema[k] for k in keys), T.StructField("area", T.DoubleType())])
    return fold_sorted(parts, cell, ["x0"], schema, sweep).groupBy(*keys).agg(F.sum("area").alias("union_area"))


def covered_area(boxes: list[tuple[float, float, float, float]]) -> float:
    """Area under boxes (x0, x1, y0, y1): a sweep along x.  The tree over the distinct y edges
    holds, for each node, how many boxes cover all of it and the length covered within it."""
    ys = sorted({y for b in boxes for y in b[2:]})
    at = {y: i for i, y in enumerate(ys)}
    size = 1
    while size < len(ys) - 1:
        size *= 2
    full, length = [0] * (2 * size), [0.0] * (2 * size)
    last = len(ys) - 1
    span = lambda i, j: ys[min(j, last)] - ys[min(i, last)]

    def add(low: int, high: int, by: int) -> None:
        # the nodes that make up low to high, bottom up, and then all above their ends
        i, j, width, touched = low + size, high + size, 1, []
        while i < j:
            if i & 1:
                touched.append((i, width))
                i += 1
            if j & 1:
                j -= 1
                touched.append((j, width))
            i, j, width = i // 2, j // 2, width * 2
        for node, width in touched:
            full[node] += by
            settle(node, width)
        for leaf in (low + size, high - 1 + size):
            node, width = leaf // 2, 2
            while node:
                settle(node, width)
                node, width = node // 2, width * 2

    def settle(node: int, width: int) -> None:
        if full[node]:
            first = node * width - size
            length[node] = span(first, first + width)
        elif node >= size:
            length[node] = 0.0
        else:
            length[node] = length[2 * node] + length[2 * node + 1]

    edges = sorted([(b[0], 1, at[b[2]], at[b[3]]) for b in boxes] + [(b[1], -1, at[b[2]], at[b[3]]) for b in boxes])
    area, before = 0.0, edges[0][0]
    for x, by, low, high in edges:
        area += length[1] * (x - before)
        before = x
        add(low, high, by)
    return area


def unexplained_area(boxes: DataFrame, meta: DataFrame) -> DataFrame:
    """1 - union area / page area, never below 0; 0 for an empty page."""
    page = F.col("width").cast("double") * F.col("height")
    out = meta.join(union_area(boxes), "image_id", "left")
    share = F.when(page > 0, F.greatest(F.lit(0.0), 1 - F.coalesce("union_area", F.lit(0.0)) / page)).otherwise(F.lit(0.0))
    return out.select("image_id", share.alias("unexplained"))


def critical_coverage(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of critical nodes with evidence; 1 for an image without critical nodes."""
    seen = evidence.select("image_id", "node_id").distinct().withColumn("hit", F.lit(1.0))
    rows = nodes.select("image_id", "node_id", "type").join(seen, ["image_id", "node_id"], "left")
    critical = F.col("type").isin(CRITICAL_TYPES)
    share = F.avg(F.when(critical, F.coalesce("hit", F.lit(0.0))))
    return rows.groupBy("image_id").agg(F.coalesce(share, F.lit(1.0)).alias("critical_coverage"))


def quality_report(nodes: DataFrame, evidence: DataFrame, meta: DataFrame) -> DataFrame:
    """Editable / flattened / unexplained / critical ratios per image.  ``nodes`` carries
    ``render_mode``; the page root takes no part in the area."""
    ratios = nodes.groupBy("image_id").agg(
        F.avg(F.col("render_mode").isin("native", "hybrid").cast("double")).alias("editable_ratio"),
        F.avg((F.col("render_mode") == "asset").cast("double")).alias("flattened_ratio"),
    )
    area = unexplained_area(nodes.where(F.col("type") != "page"), meta)
    out = ratios.join(critical_coverage(nodes, evidence), "image_id").join(area, "image_id", "left")
    warning = F.when(F.col("unexplained").isNull(), F.lit("no-image-dimensions:unexplainedAreaRatio-set-to-zero")).otherwise(F.lit(""))
    return out.withColumn("warnings", warning).withColumn("unexplained", F.coalesce("unexplained", F.lit(0.0)))


def distribution(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def stability(run1: DataFrame, run2: DataFrame) -> DataFrame:
    """Node counts of two runs per image and whether they agree."""
    one = run1.groupBy("image_id").agg(F.count(F.lit(1)).alias("n1"))
    two = run2.groupBy("image_id").agg(F.count(F.lit(1)).alias("n2"))
    both = one.join(two, "image_id", "full")
    return both.select(
        "image_id", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2")
    ).withColumn("stable", F.col("n1") == F.col("n2"))


def latency_profile(df: DataFrame, keys: list[str], value: str = "duration_ms") -> DataFrame:
    """Mean, median and p90 (element ``floor(n*p)`` of the sorted values), requests per
    second of busy time, and maximum.

    The rank is found over a value -> count histogram in bands of values, each about 1.6 % wide:
    counts run inside a band, and only the few band sums of a key are added up together, so a
    key with most of the rows is spread over many tasks."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    hist = hist.withColumn("_band", (F.signum("v") * F.floor(F.log1p(F.abs("v")) * 64)).cast("long"))
    sizes = hist.groupBy(*keys).agg(F.sum("c").alias("n"))
    ranked = running_sum(hist, keys, ["v"], F.col("c"), "upto").join(sizes, keys)

    def at(p: float) -> Column:
        idx = F.least(F.floor(F.col("n") * p), F.col("n") - 1)
        return F.min(F.when(F.col("upto") > idx, F.col("v")))

    total = F.sum(F.col("v") * F.col("c"))
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), (total / F.max("n")).alias("mean_ms"), at(0.5).alias("median_ms"), at(0.9).alias("p90_ms"),
        F.when(total > 0, F.max("n") * 1000.0 / total).alias("per_second"), F.max("v").alias("max_ms"),
    )


def merge_votes(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Best score per source and the distinct sources of each group."""
    best = cands.groupBy(*keys, "source").agg(F.max("score").alias("score"))
    return best.groupBy(*keys).agg(
        F.array_sort(F.collect_list("source")).alias("sources"), F.max("score").alias("best_score"),
        F.max_by("source", F.struct("score", "source")).alias("best_source"),
    )


def component_stats(nodes: DataFrame) -> DataFrame:
    """Count per (image, type); buttons split by variant."""
    kind = F.when(F.col("type") == "button", F.concat(F.lit("button:"), F.coalesce("variant", F.lit("default")))).otherwise(F.col("type"))
    return nodes.groupBy("image_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
