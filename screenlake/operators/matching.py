"""One-to-one box matching and annotation differences (JOIN-2, JOIN-3, JOIN-4).

Both matchers take the edges of the tile join in a total order and accept an edge if both its
ends are free.  Bands of an image between which no edge runs are walked on their own, each in one
pass over its sorted edges that remembers the ends already taken.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from screenlake.operators.folds import fold_sorted
from screenlake.operators.ordered import with_part
from screenlake.operators.spatial import KEY, iou_join
from screenlake.session import cut_lineage


def greedy_walk(edges: DataFrame, boxes: DataFrame, keys: list[str], rank: list[str], a_id: str, b_id: str) -> DataFrame:
    """The edges that a walk in ``rank`` order takes: those with both ends still free.

    ``boxes`` are those of both sides; edges have the top ``_y`` of one of their ends.  Bands
    that no box crosses share no edge, so each is a walk of its own."""
    banded = with_part(edges, F.col("_y"), boxes, keys, F.col("y"), F.col("y") + F.col("h"))
    rows = banded.select(*keys, "_part", *rank, F.col(a_id).alias("_a"), F.col(b_id).alias("_b"), "iou")
    n = len(keys)
    fields = [edges.schema[c] for c in (*keys, a_id, b_id, "iou")]

    def walk(group: Iterator[tuple]) -> Iterator[tuple]:
        used_a, used_b = set(), set()
        for row in group:
            a, b, value = row[-3:]
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                yield (*row[:n], a, b, value)

    return fold_sorted(rows, [*keys, "_part"], rank, T.StructType(fields), walk)


def _edges(pairs: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    return pairs.select(*keys, *columns, "iou", (-F.col("iou")).alias("neg_iou"), F.col("a_y").alias("_y"))


def match_greedy_gt(gt: DataFrame, pred: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Ground truth in ``ord`` order; each takes the free same-type prediction with the
    highest IoU >= ``min_iou`` (ties: first prediction).

    Inputs: image_id, ord, box_id, type, x, y, w, h.
    Output: image_id, type, gt_id, pred_id, iou."""
    keys = ["image_id", "type"]
    cols = [*keys, "ord", "box_id", "x", "y", "w", "h"]
    gt, pred = gt.select(*cols), pred.select(*cols)
    pairs = iou_join(gt, pred, min_iou, same_type=True)
    edges = _edges(pairs, keys, F.col("a_ord").alias("gt_ord"), F.col("b_ord").alias("pred_ord"), F.col("a_box_id").alias("gt_id"), F.col("b_box_id").alias("pred_id"))
    return greedy_walk(edges, gt.unionByName(pred), keys, ["gt_ord", "neg_iou", "pred_ord"], "gt_id", "pred_id")


def match_greedy_global(pred: DataFrame, human: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Pairs by IoU descending, then prediction id, then human id; type-agnostic."""
    keys = list(KEY)
    cols = ["image_id", "box_id", "x", "y", "w", "h"]
    pred, human = pred.select(*cols), human.select(*cols)
    pairs = iou_join(pred, human, min_iou)
    edges = _edges(pairs, keys, F.col("a_box_id").alias("pred_id"), F.col("b_box_id").alias("human_id"))
    return greedy_walk(edges, pred.unionByName(human), keys, ["neg_iou", "pred_id", "human_id"], "pred_id", "human_id")


# Types a user acts on, and type pairs that detectors confuse.
INTERACTIVE_TYPES = ["button", "iconButton", "input", "textarea", "select", "checkbox", "radio", "switch", "tab"]
CONFUSED_PAIRS = [
    "icon:text", "header:navbar", "footer:navbar", "container:card", "container:section",
    "container:row", "card:section", "card:row", "section:row", "button:input",
]


def annotation_diff(pred: DataFrame, human: DataFrame) -> DataFrame:
    """Differences between predicted and human elements of each image.

    Inputs: image_id, box_id, type, text, semantic_role, children (ARRAY<STRING>), box.
    Matched pairs get the first of wrong_structure / wrong_type / wrong_text /
    wrong_bbox (IoU < 0.85) that applies; the rest is false_positive or missed.

    Both sides and the matches are dealt by image and joined there."""
    pred, human = (df.repartition("image_id") for df in (pred, human))
    matches = cut_lineage(match_greedy_global(pred, human, 0.5).repartition("image_id"), dealt=True)

    def side(df: DataFrame, p: str) -> DataFrame:
        text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
        return df.select(
            "image_id", F.col("box_id").alias(p + "id"), F.col("type").alias(p + "type"), text.alias(p + "text"),
            F.col("semantic_role").alias(p + "role"),
            F.coalesce("children", F.array().cast("array<string>")).alias(p + "children"),
        )

    p_side, h_side = side(pred, "pred_"), side(human, "human_")
    rows = p_side.withColumn("_p", F.lit(True)).join(matches, ["image_id", "pred_id"], "left").withColumn("_m", F.col("iou").isNotNull())
    rows = rows.join(h_side, ["image_id", "human_id"], "full")
    category = (
        F.when(F.col("_p").isNull(), "missed").when(~F.col("_m"), "false_positive")
        .when(~F.col("pred_role").eqNullSafe(F.col("human_role")) | (F.col("pred_children") != F.col("human_children")), "wrong_structure")
        .when(F.col("pred_type") != F.col("human_type"), "wrong_type")
        .when(F.col("pred_text") != F.col("human_text"), "wrong_text")
        .when(F.col("iou") < 0.85, "wrong_bbox")
    )
    cols = ["image_id", "category", "pred_id", "pred_type", "human_id", "human_type", "iou"]
    rows = cut_lineage(rows.withColumn("category", category).where(F.col("category").isNotNull()).select(*cols), dealt=True)

    unmatched = F.col("category").isin("missed", "false_positive")
    pair = F.concat_ws(":", F.least("pred_type", "human_type"), F.greatest("pred_type", "human_type"))
    severity = (
        F.when(unmatched & F.coalesce("pred_type", "human_type").isin(INTERACTIVE_TYPES), "high")
        .when((F.col("category") == "wrong_type") & pair.isin(CONFUSED_PAIRS), "high")
        .when(F.col("iou") < 0.5, "high")
        .when((F.col("category") == "wrong_bbox") & (F.col("iou") >= 0.7), "low")
        .otherwise("medium")
    )
    hint = (
        F.when(F.col("category") == "missed", F.concat(F.lit("review recall for "), "human_type", F.lit(" detection")))
        .when(F.col("category") == "false_positive", F.concat(F.lit("review precision for "), "pred_type", F.lit(" detection")))
        .when(
            F.col("category") == "wrong_type",
            F.concat(F.lit("review "), "pred_type", F.lit(" to "), "human_type", F.lit(" type disambiguation")),
        )
        .when(F.col("category") == "wrong_bbox", F.lit("review bbox refinement and region merging"))
        .when(F.col("category") == "wrong_text", F.lit("review OCR-to-element text binding"))
        .otherwise(F.lit("review containment and semantic-role inference"))
    )
    diff_id = (
        F.when(F.col("category") == "false_positive", F.concat(F.lit("prediction:"), "pred_id"))
        .when(F.col("category") == "missed", F.concat(F.lit("annotation:"), "human_id"))
        .otherwise(F.concat(F.lit("match:"), "pred_id", F.lit(":"), "human_id"))
    )
    return rows.select(
        "image_id", diff_id.alias("diff_id"), "category", "pred_id", "human_id", "iou",
        severity.alias("severity"), F.coalesce("iou", F.lit(1.0)).alias("confidence"),
        F.lit("auto").alias("review_status"), hint.alias("hint"),
    )
