"""Spatial joins.

Nothing here compares all boxes of an image: boxes are spread over the grid tiles they
cover and joined on ``(image, tile)``.  A pair is kept only in the tile that holds the
top-left corner of its intersection, so no DISTINCT is needed, and an image that holds
a large share of all boxes is cut into as many join keys as it has tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from screenlake.functions import geometry as G
from screenlake.functions.semantics import mean_median
from screenlake.session import cut_lineage

KEY = ("image_id",)
TILE = 128.0


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str] = KEY) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keys))


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def spread(df: DataFrame, b: G.Box, size: float) -> DataFrame:
    """One row per tile that the (closed) box touches."""
    xs = F.sequence(_cell(b.x, size), _cell(b.right, size))
    ys = F.sequence(_cell(b.y, size), _cell(b.bottom, size))
    ok = (b.w >= 0) & (b.h >= 0)
    return df.where(ok).withColumn("_tx", F.explode(xs)).withColumn("_ty", F.explode(ys))


def touching_pairs(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = KEY,
    tile: float = TILE,
    reach: float = 0.0,
    reach_x: Column | None = None,
    reach_y: Column | None = None,
) -> DataFrame:
    """All pairs (a, b) with equal ``keys`` whose closed boxes touch; ``reach`` widens
    the boxes of ``a`` on every side, ``reach_x`` / ``reach_y`` (columns of ``a``) per axis.
    Columns come out as ``a_*`` and ``b_*``."""
    raw, bb = G.box("a_"), G.box("b_")
    right = prefixed(b, "b_", keys)
    if reach == 0 and reach_x is None and reach_y is None:
        # both sides are filtered alike, so a table that meets itself is shuffled once
        left, ab = prefixed(a, "a_", keys), raw
    else:
        zero = F.lit(0.0)
        left = a.withColumn("_rx", F.lit(reach) + (zero if reach_x is None else reach_x))
        left = prefixed(left.withColumn("_ry", F.lit(reach) + (zero if reach_y is None else reach_y)), "a_", keys)
        rx, ry = F.col("a__rx"), F.col("a__ry")
        ab = G.Box(raw.x - rx, raw.y - ry, raw.w + 2 * rx, raw.h + 2 * ry)
    on = [*keys, "_tx", "_ty"]
    owner = (F.col("_tx") == _cell(F.greatest(ab.x, bb.x), tile)) & (
        F.col("_ty") == _cell(F.greatest(ab.y, bb.y), tile)
    )
    touch = (
        (F.least(ab.right, bb.right) >= F.greatest(ab.x, bb.x))
        & (F.least(ab.bottom, bb.bottom) >= F.greatest(ab.y, bb.y))
    )
    # both sides may be large whatever the file sizes suggest: never broadcast a box table
    pairs = spread(left, ab, tile).join(spread(right, bb, tile).hint("merge"), on)
    return pairs.where(owner & touch).drop("_tx", "_ty", "a__rx", "a__ry")


def points_in_boxes(
    points: DataFrame,
    boxes: DataFrame,
    px: Column,
    py: Column,
    keys: Sequence[str] = KEY,
    tile: float = TILE,
    reach: float = 0.0,
) -> DataFrame:
    """Pairs (point row ``a_*``, box row ``b_*``) with the point in the widened box.  A
    point lies in exactly one tile, so every pair is produced once."""
    left = (
        points.withColumn("_px", px).withColumn("_py", py)
        .withColumn("_tx", _cell(F.col("_px"), tile)).withColumn("_ty", _cell(F.col("_py"), tile))
    )
    left = left.select(*keys, "_px", "_py", "_tx", "_ty", *(F.col(c).alias("a_" + c) for c in points.columns if c not in keys))
    bb = G.expand(G.box("b_"), reach)
    right = spread(prefixed(boxes, "b_", keys), bb, tile)
    pairs = left.join(right.hint("merge"), [*keys, "_tx", "_ty"]).where(G.contains_point(bb, F.col("_px"), F.col("_py")))
    return pairs.drop("_tx", "_ty", "_px", "_py")


def iou_join(
    a: DataFrame, b: DataFrame, min_iou: float, same_type: bool = False, keys: Sequence[str] = KEY
) -> DataFrame:
    """Pairs with IoU >= ``min_iou`` (> 0) and, if asked, equal type.  Adds ``iou``."""
    on = [*keys, "type"] if same_type else list(keys)
    pairs = touching_pairs(a, b, on).withColumn("iou", G.iou(G.box("a_"), G.box("b_")))
    return pairs.where(F.col("iou") >= min_iou)


def containment_edges(boxes: DataFrame, mode: str = "inclusive", id_col: str = "box_id", keys: Sequence[str] = KEY) -> DataFrame:
    """(outer ``b_*``, inner ``a_*``) pairs.  The inner box is looked up by its top-left
    corner only, so it sits in one tile however large it is."""
    eps = G.EPS if mode == "eps" else 0.0
    pairs = points_in_boxes(boxes, boxes, F.col("x"), F.col("y"), keys, reach=eps)
    return pairs.where(
        (F.col("a_" + id_col) != F.col("b_" + id_col)) & G.contains(G.box("b_"), G.box("a_"), mode)
    )


def tightest_parent(
    boxes: DataFrame, mode: str = "strict", id_col: str = "box_id", tie: str | None = None, keys: Sequence[str] = KEY
) -> DataFrame:
    """Every box with the id of the smallest box that contains it (NULL for roots)."""
    tie = tie or id_col
    edges = containment_edges(boxes, mode, id_col, keys)
    parents = edges.groupBy(*keys, F.col("a_" + id_col).alias(id_col)).agg(
        F.min_by(F.col("b_" + id_col), F.struct(F.col("b_w") * F.col("b_h"), F.col("b_" + tie))).alias("parent_id")
    )
    return boxes.join(parents, [*keys, id_col], "left")


def project_evidence(nodes: DataFrame, cands: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """Evidence links per node, matching type first, then by IoU (ties: candidate order).

    ``nodes``: image_id, node_id, type, box.  ``cands``: image_id, cand_id, type, box.  Both are
    dealt by image once, and joined and ranked there."""
    links = iou_join(nodes.repartition("image_id"), cands.repartition("image_id"), min_iou).withColumn("type_match", F.col("a_type") == F.col("b_type"))
    order = W.partitionBy("image_id", "a_node_id").orderBy(F.desc("type_match"), F.desc("iou"), "b_cand_id")
    ranked = links.select(
        "image_id", F.col("a_node_id").alias("node_id"), F.col("b_cand_id").alias("cand_id"),
        "iou", "type_match", F.row_number().over(order).alias("rank"),
    )
    return cut_lineage(ranked, dealt=True)


def items_in_region(items: DataFrame, regions: DataFrame, margin: float = 4.0, min_overlap: float = 0.35) -> DataFrame:
    """Items whose centre lies in the region widened by ``margin``, or that overlap the
    region by ``min_overlap`` of their own area."""
    # regions hold many items: on wider tiles both sides are copied less
    pairs = touching_pairs(items, regions, tile=2 * TILE, reach=margin)
    inner, outer = G.box("a_"), G.box("b_")
    hit = G.center_inside(inner, G.expand(outer, margin)) | (G.overlap_ratio(inner, outer) >= min_overlap)
    return pairs.where(hit)


def items_near_region(items: DataFrame, regions: DataFrame, margin: float = 4.0, near: float = 25.0) -> DataFrame:
    """Items that are outside a region but whose centre is within ``near`` px of it."""
    pairs = points_in_boxes(items, regions, G.box().cx, G.box().cy, reach=near)
    return pairs.where(~G.center_inside(G.box("a_"), G.box("b_")))


def merge_items(full: DataFrame, local: DataFrame, min_overlap: float = 0.6) -> DataFrame:
    """Local OCR replaces a same-text full item it overlaps; the rest is appended.

    Both inputs: image_id, ord, text, box.  ``source`` tells where a row came from, and
    a replacing local item takes the ``ord`` of the item it replaces."""
    cols = ["image_id", "ord", "text", "x", "y", "w", "h"]
    pairs = touching_pairs(full.select(*cols), local.select(*cols), ["image_id", "text"])
    pairs = pairs.where(G.overlap_ratio(G.box("a_"), G.box("b_")) >= min_overlap)
    # each local item takes the first full item it overlaps; the last local one stays
    first = pairs.groupBy("image_id", F.col("b_ord").alias("l_ord")).agg(F.min("a_ord").alias("f_ord"))
    taken = first.groupBy("image_id", F.col("f_ord").alias("ord")).agg(F.max("l_ord").alias("l_ord"))
    kept = full.select(*cols).join(taken, ["image_id", "ord"], "left_anti").withColumn("source", F.lit("full"))
    swapped = (
        local.select(*cols).withColumnRenamed("ord", "l_ord")
        .join(taken, ["image_id", "l_ord"]).select(*cols).withColumn("source", F.lit("local"))
    )
    fresh = (
        local.select(*cols)
        .join(first.select("image_id", F.col("l_ord").alias("ord")), ["image_id", "ord"], "left_anti")
        .withColumn("source", F.lit("appended"))
    )
    return kept.unionByName(swapped).unionByName(fresh)


# Text confidence, margin, coverage bounds and aspect of the text veto,
# and the label gap in median text heights.
VETO_CONFIDENCE, VETO_MARGIN, VETO_SHARE, VETO_SHARE_WIDE, VETO_WIDE = 0.9, 2.0, 0.2, 0.1, 1.7
TEXTURE_CONFIDENCE, TEXTURE_SHARE = 0.65, 0.55
LABEL_GAP = 1.2


def text_veto(cands: DataFrame, ocr: DataFrame, textured: bool = False) -> DataFrame:
    """Drop candidates that text covers.  The coverage by all confident text boxes is
    summed (an aggregated anti join); wide candidates have a lower bound.  The sum is rounded
    to nine digits, so the order in which it is added up does not decide at a bound."""
    conf = TEXTURE_CONFIDENCE if textured else VETO_CONFIDENCE
    facts = ocr.where((F.col("confidence") >= conf) & (F.length(F.trim("text")) > 0)).select(
        "image_id", *G.expand(G.box(), VETO_MARGIN).aliased()
    )
    pairs = touching_pairs(cands.select("image_id", "cand_id", "x", "y", "w", "h"), facts)
    share = pairs.groupBy("image_id", F.col("a_cand_id").alias("cand_id")).agg(
        F.round(F.sum(G.coverage(G.box("a_"), G.box("b_"))), 9).alias("text_share")
    )
    wide = F.col("w") / F.col("h") >= VETO_WIDE
    bound = F.lit(TEXTURE_SHARE) if textured else F.when(wide, VETO_SHARE_WIDE).otherwise(VETO_SHARE)
    rows = cands.join(share, ["image_id", "cand_id"], "left").withColumn("text_share", F.coalesce("text_share", F.lit(0.0)))
    return rows.where(F.col("text_share") < bound)


def text_height(ocr: DataFrame) -> DataFrame:
    """Averaged median height of confident text per image."""
    good = ocr.where((F.col("confidence") >= 0.85) & (F.length(F.trim("text")) >= 2))
    return good.groupBy("image_id").agg(mean_median("h").alias("median_h"))


def nearest_label(cands: DataFrame, ocr: DataFrame) -> DataFrame:
    """The nearest text beside each candidate: same row (vertical overlap >= 0.5 of the
    smaller height), gap <= 1.2 median text heights; ties go to the higher confidence."""
    reach = F.coalesce("median_h", F.lit(20.0)) * LABEL_GAP
    base = cands.select("image_id", "cand_id", "x", "y", "w", "h")
    base = base.join(text_height(ocr), "image_id", "left").withColumn("reach", reach)
    facts = ocr.where(F.length(F.trim("text")) > 0).select("image_id", "box_id", F.trim("text").alias("text"), "confidence", "x", "y", "w", "h")
    pairs = touching_pairs(base, facts, reach_x=F.col("reach"))
    a, b = G.box("a_"), G.box("b_")
    gap = F.when(b.x >= a.right, b.x - a.right).when(a.x >= b.right, a.x - b.right)
    over = F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)) / F.least(a.h, b.h)
    hits = pairs.withColumn("gap", gap).where((F.col("gap") <= F.col("a_reach")) & (over >= 0.5))
    return hits.groupBy("image_id", F.col("a_cand_id").alias("cand_id")).agg(
        F.min_by(F.struct(F.col("b_text").alias("text"), F.col("gap")), F.struct("gap", -F.col("b_confidence"), "b_box_id")).alias("r")
    ).select("image_id", "cand_id", "r.text", "r.gap")


def _row_candidates(left: DataFrame, items: DataFrame, tol: float, band: float = 64.0) -> DataFrame:
    """(left row, item cell) pairs whose centres differ by at most ``tol`` heights of the
    left box.  Items are first collapsed to one row per (centre y, left edge) with their
    first text, so copies of an item cost one row; rows meet in bands of y."""
    cells = items.groupBy("image_id", G.box().cy.alias("i_cy"), F.col("x").alias("i_x")).agg(
        F.min_by(F.struct("ord", "text"), "ord").alias("i")
    )
    b = G.box()
    lo, hi = b.cy - b.h * tol, b.cy + b.h * tol
    spread_rows = left.withColumn("_band", F.explode(F.sequence(F.floor(lo / band).cast("long"), F.floor(hi / band).cast("long"))))
    cells = cells.withColumn("_band", F.floor(F.col("i_cy") / band).cast("long"))
    pairs = spread_rows.join(cells, ["image_id", "_band"]).drop("_band")
    return pairs.where(F.abs(F.col("i_cy") - b.cy) <= b.h * tol)


def colon_values(items: DataFrame) -> DataFrame:
    """Labels that end in a colon with the first item (input order) to their right on
    their row: left edge beyond the label's right edge - 5, centre within 0.8 heights."""
    labels = items.where(F.trim("text").rlike("[：:]$"))
    pairs = _row_candidates(labels.select("image_id", F.col("ord").alias("l_ord"), "text", "x", "y", "w", "h"), items, 0.8)
    # an item with a positive width starts left of its own right edge - 5 only if w <= 5
    hits = pairs.where((F.col("i_x") > G.box().right - 5) & (F.col("i.ord") != F.col("l_ord")))
    label = F.trim(F.regexp_replace(F.trim("text"), "[：:]$", ""))
    best = hits.groupBy("image_id", "l_ord", label.alias("label")).agg(F.min_by(F.trim("i.text"), "i.ord").alias("value"))
    return best.where(F.col("value") != "").select("image_id", F.col("l_ord").alias("ord"), "label", "value")


def right_labels(marks: DataFrame, items: DataFrame) -> DataFrame:
    """The nearest item right of a mark (smallest left edge beyond the mark's, centre
    within 0.8 mark heights)."""
    pairs = _row_candidates(marks.select("image_id", F.col("ord").alias("m_ord"), "x", "y", "w", "h"), items, 0.8)
    hits = pairs.where(F.col("i_x") > F.col("x"))
    return hits.groupBy("image_id", F.col("m_ord").alias("ord")).agg(
        F.min_by(F.trim("i.text"), F.struct("i_x", "i.ord")).alias("label")
    )


def field_labels(texts: DataFrame, meta: DataFrame, dealt: bool = False) -> DataFrame:
    """Text nodes that act as labels: in the left 30 % and below the top 12 % of the page,
    at most 12 characters, with a sibling text to the right within 20 % of the page width
    that overlaps at least half of the smaller height.

    ``texts``: image_id, parent_id, node_id, text, box of text-like nodes.  Both inputs are dealt by
    image (``dealt``: they are already) and joined there."""
    if not dealt:
        texts, meta = texts.repartition("image_id"), meta.repartition("image_id")
    rows = texts.where(F.length(F.trim("text")) > 0).join(meta.select("image_id", "width", "height"), "image_id")
    left = rows.where(
        (F.col("x") <= F.col("width") * 0.3) & (F.col("y") >= F.col("height") * 0.12) & (F.length(F.trim("text")) <= 12)
    )
    others = rows.select("image_id", "parent_id", "node_id", "x", "y", "w", "h")
    pairs = touching_pairs(left, others, ["image_id", "parent_id"], reach_x=F.col("width") * 0.2)
    a, b = G.box("a_"), G.box("b_")
    over = F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)) / F.least(a.h, b.h)
    hit = (F.col("a_node_id") != F.col("b_node_id")) & (b.x >= a.right) & (b.x - a.right <= F.col("a_width") * 0.2) & (over >= 0.5)
    return cut_lineage(pairs.where(hit).select("image_id", F.col("a_node_id").alias("node_id")).distinct(), dealt=True)


def control_labels(nodes: DataFrame, max_gap: float = 30.0) -> DataFrame:
    """Per parent: its first control child (checkbox, radio, switch) and the first text
    child that starts within ``max_gap`` of the control's right edge on the same row."""
    controls = nodes.where(F.col("type").isin("checkbox", "radio", "switch") & F.col("parent_id").isNotNull())
    first = controls.groupBy("image_id", "parent_id").agg(F.min_by(F.struct("ord", "node_id", "x", "y", "w", "h"), "ord").alias("c"))
    first = first.select("image_id", "parent_id", "c.*")
    texts = nodes.where(F.col("type") == "text").select("image_id", "parent_id", "ord", "node_id", "x", "y", "w", "h")
    pairs = touching_pairs(first, texts, ["image_id", "parent_id"], reach_x=F.lit(max_gap))
    a, b = G.box("a_"), G.box("b_")
    hit = (F.abs(b.x - a.right) <= max_gap) & (F.least(a.bottom, b.bottom) > F.greatest(a.y, b.y))
    return pairs.where(hit).groupBy("image_id", "parent_id", F.col("a_node_id").alias("control_id")).agg(
        F.min_by("b_node_id", "b_ord").alias("label_id")
    )


def bind_text(nodes: DataFrame, ocr: DataFrame) -> DataFrame:
    """Where each OCR item goes in a node tree.

    ``nodes``: image_id, node_id, ord, kind ('control' / 'region'), text, box.
    ``ocr``: image_id, ord, text, box.  Items are taken in order: the smallest control
    that covers 70 % of the item gets its text if it has none yet (or confirms an equal
    one); else the smallest region with IoU >= 0.5 that has no text; else the item
    becomes a text child of the smallest region holding it, or of the page.

    The target of an item does not depend on other items, only who comes first does, so
    the order is settled by one minimum per target instead of a walk.

    Items and nodes are dealt by image once, and all joins and minima are taken there."""
    items = ocr.select("image_id", F.col("ord").alias("item"), "text", "x", "y", "w", "h").repartition("image_id")
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    targets = nodes.select("image_id", "node_id", F.col("ord").alias("n_ord"), "kind", "text", "x", "y", "w", "h")
    pairs = touching_pairs(items, targets.repartition("image_id"))
    a, b = G.box("a_"), G.box("b_")
    control = (F.col("b_kind") == "control") & (G.coverage(a, b) >= 0.7)
    tight = (F.col("b_kind") == "region") & (G.iou(a, b) >= 0.5)
    holds = (F.col("b_kind") == "region") & (
        ((a.x >= b.x - G.EPS) & (a.y >= b.y - G.EPS) & (a.right <= b.right + G.EPS) & (a.bottom <= b.bottom + G.EPS)) | G.center_inside(a, b)
    )

    def smallest(cond: Column, name: str) -> Column:
        size = F.struct(b.area, F.col("b_n_ord"))
        return F.min_by(F.when(cond, F.struct(F.col("b_node_id").alias("id"), F.col("b_text").alias("text"))), F.when(cond, size)).alias(name)

    best = pairs.groupBy("image_id", F.col("a_item").alias("item")).agg(smallest(control, "c"), smallest(tight, "r"), smallest(holds, "p"))
    rows = items.join(best, ["image_id", "item"], "left")

    def first_for(df: DataFrame, target: str) -> DataFrame:
        won = df.where(F.col(f"{target}.id").isNotNull() & F.col(f"{target}.text").isNull())
        return won.groupBy("image_id", F.col(f"{target}.id").alias("_t")).agg(F.min_by(F.struct("item", "text"), "item").alias("_first"))

    cf = first_for(rows, "c").select("image_id", F.col("_t").alias("_cid"), F.col("_first").alias("_cf"))
    rows = rows.withColumn("_cid", F.col("c.id")).join(cf, ["image_id", "_cid"], "left")
    sets = F.col("c.text").isNull() & (F.col("_cf.item") == F.col("item"))
    same = norm(F.coalesce("c.text", "_cf.text")) == norm(F.col("text"))
    rows = rows.withColumn("_step1", F.when(F.col("c.id").isNull(), F.lit(None)).when(sets, "control-text").when(same, "control-confirm"))
    rest = rows.where(F.col("_step1").isNull())
    rf = first_for(rest, "r").select("image_id", F.col("_t").alias("_rid"), F.col("_first.item").alias("_rf"))
    rows = rows.withColumn("_rid", F.col("r.id")).join(rf, ["image_id", "_rid"], "left")
    takes = F.col("_step1").isNull() & F.col("r.text").isNull() & (F.col("_rf") == F.col("item"))
    action = F.coalesce("_step1", F.when(takes, "region-text"), F.lit("text-child"))
    target = F.when(F.col("_step1").isNotNull(), F.col("c.id")).when(takes, F.col("r.id")).otherwise(F.coalesce("p.id", F.lit("page")))
    return cut_lineage(rows.select("image_id", F.col("item").alias("ord"), action.alias("action"), target.alias("target_id")), dealt=True)


#: Rings that one plan searches.
RINGS = 3


def nearest_downstream(nodes: DataFrame, directions: DataFrame, first_reach: float = 32.0) -> DataFrame:
    """Every node with its nearest node further along the flow (centre beyond + 5 px).

    ``nodes``: image_id, ord, box.  ``directions``: image_id, direction.  The search ring
    doubles; a node leaves the search once its best hit lies within the ring, because
    nothing outside can be nearer, and only nodes with something ahead search at all.  The tile size follows the ring, so a node always
    probes a handful of tiles.

    Nodes are dealt by image once for ``RINGS`` rings, which one plan searches there; a round
    searches for the nodes that are still without a hit."""
    pts = nodes.select("image_id", "ord", G.box().cx.alias("x"), G.box().cy.alias("y")).repartition("image_id")
    # a node with nothing ahead of it never starts, so every search ends at a hit
    far = pts.groupBy("image_id").agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
    beyond, aside = F.col("_my") > F.col("y") + 5, F.col("_mx") > F.col("x") + 5
    any_ahead = F.when(F.col("direction") == "top-down", beyond).when(F.col("direction") == "left-right", aside).otherwise(beyond | aside)
    none = F.lit(None).cast(T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("dst", nodes.schema["ord"].dataType)]))
    todo = pts.join(directions.select("image_id", "direction"), "image_id").join(far, "image_id").where(any_ahead).drop("_mx", "_my")
    reach, found = first_reach, None
    down, right = F.col("b_y") > F.col("y") + 5, F.col("b_x") > F.col("x") + 5
    ahead = F.when(F.col("direction") == "top-down", down).when(F.col("direction") == "left-right", right).otherwise(down | right)
    dx, dy = F.col("x") - F.col("b_x"), F.col("y") - F.col("b_y")
    dist = F.sqrt(dx * dx + dy * dy)
    while True:
        state = todo.withColumn("_hit", none)
        for _ in range(RINGS):
            tile = max(reach, TILE)
            there = pts.select("image_id", _cell(F.col("x"), tile).alias("_tx"), _cell(F.col("y"), tile).alias("_ty"), F.col("ord").alias("b_ord"), F.col("x").alias("b_x"), F.col("y").alias("b_y"))
            # a node probes its tiles until it has a hit; a row without a tile carries it on
            cells = lambda c: F.sequence(_cell(c - reach, tile), _cell(c + reach, tile))
            tiles = F.flatten(F.transform(cells(F.col("x")), lambda tx: F.transform(cells(F.col("y")), lambda ty: F.struct(tx.alias("_tx"), ty.alias("_ty")))))
            itself = F.array(F.struct(F.lit(None).cast("long").alias("_tx"), F.lit(None).cast("long").alias("_ty")))
            probes = state.select("*", F.inline(F.when(F.col("_hit").isNull(), F.concat(itself, tiles)).otherwise(itself)))
            hit = (F.col("ord") != F.col("b_ord")) & ahead & (dist <= reach)
            pairs = probes.join(there.hint("merge"), ["image_id", "_tx", "_ty"], "left").where(F.col("_tx").isNull() | hit)
            pairs = pairs.withColumn("_hit", F.coalesce("_hit", F.when(F.col("_tx").isNotNull(), F.struct(dist.alias("dist"), F.col("b_ord").alias("dst")))))
            state = pairs.groupBy("image_id", "ord", "x", "y", "direction").agg(F.min("_hit").alias("_hit"))
            reach *= 2
        # nodes may share an id: the nearest hit of an id is its hit
        same = W.partitionBy("image_id", "ord")
        state = state.withColumn("_k", F.row_number().over(same.orderBy(F.col("_hit").asc_nulls_last()))).withColumn("_best", F.min("_hit").over(same))
        state = cut_lineage(state.where("_best IS NULL OR _k = 1").drop("_hit", "_k"), dealt=True)
        best = state.where("_best IS NOT NULL").select("image_id", F.col("ord").alias("src"), "_best.dst", "_best.dist")
        found = best if found is None else found.unionByName(best)
        todo = state.where("_best IS NULL").select("image_id", "ord", "x", "y", "direction")
        if todo.isEmpty():
            return found
        todo = todo.repartition("image_id")
