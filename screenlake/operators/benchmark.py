"""The benchmark from annotations to corpus means: shape checks, eligibility, matching, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from screenlake.operators import metrics as X
from screenlake.operators.matching import match_greedy_gt
from screenlake.session import cut_lineage
from screenlake.sources.annotations import elements_of, ground_truth, judge


def image_results(
    annotations: DataFrame | None, pred: DataFrame, meta: DataFrame, eligible: DataFrame | None = None, min_iou: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """(per image, per image and type).

    ``annotations``: image_id and the parsed shape, or None to measure coverage alone.  ``pred``:
    image_id, ord, box_id, type, box.  ``meta``: image_id, width, height of the images to run.
    With ``eligible(image_id)`` only those images take part.

    An unusable annotation gives a row with ``error`` and zeros.  An image without annotation has
    its coverage only.  ``scored`` images count in the means: the annotated ones, and with
    annotations given those that have any predicted area."""
    by_image = eligible is not None
    if by_image:
        # what judges the findings meets them where they were dealt by image
        chosen = cut_lineage(eligible.select("image_id").distinct(), dealt=True)
        meta, pred = (df.join(chosen, "image_id", "left_semi") for df in (meta, pred))
        annotations = None if annotations is None else annotations.join(chosen, "image_id", "left_semi")
    if annotations is None:
        gt, pairs = pred.select("image_id", "type").limit(0), pred.select("image_id", "type").limit(0)
        out = X.detection_metrics(gt, pred, pairs, meta)
        none = F.lit(None).cast("string").alias("error")
        return out.select("*", none, F.lit(False).alias("scored")), X.detection_metrics_by_type(gt, pred.limit(0), pairs)
    # annotations are parsed and judged once, whatever reads them below
    usable = F.when(F.col("reason").isNull(), F.col("elements"))
    notes = cut_lineage(judge(annotations).select("image_id", "reason", usable.alias("elements")), dealt=by_image)
    ok = notes.where(F.col("reason").isNull())
    errors = notes.where(F.col("reason").isNotNull()).groupBy("image_id").agg(F.min("reason").alias("error"))
    gt = ground_truth(elements_of(ok))
    known = ok.select("image_id").distinct().withColumn("annotated", F.lit(True))
    judged = pred.join(errors, "image_id", "left_anti")
    compared = judged.join(known, "image_id", "left_semi")
    pairs = cut_lineage(match_greedy_gt(gt, compared, min_iou).select("image_id", "type"))
    out = X.detection_metrics(gt, judged, pairs, meta).join(known, "image_id", "left").join(errors, "image_id", "left")
    scored = F.col("error").isNull() & (F.coalesce("annotated", F.lit(False)) | (F.col("area") > 0))
    return out.withColumn("scored", scored).drop("annotated"), X.detection_metrics_by_type(gt, compared, pairs)


def flow_summary(per_image: DataFrame, per_type: DataFrame) -> DataFrame:
    """Corpus means over scored images; coverage and totals over all images."""
    scored = X.benchmark_summary(per_image.where("scored"), per_type).select("mean_recall", "mean_precision", "mean_f1", "macro_f1")
    every = X.benchmark_summary(per_image, per_type).select("mean_coverage", "total_images", "total_predictions", "total_gt")
    errors = per_image.agg(F.count("error").alias("errors"))
    # single rows
    return scored.crossJoin(every).crossJoin(errors)
