"""Queries over the geometry functions (GEO-*) and the detection slice (JOIN-1..4, AGG-1..7)."""

from pyspark.sql import functions as F

from screenlake.functions import geometry as G
from screenlake.functions.semantics import keep_first  # noqa: F401
from screenlake.operators import matching as M, metrics as X, spatial as S
from screenlake.plans.registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


def gt_of(t):
    return t.boxes.select("image_id", F.col("box_id").alias("ord"), "box_id", "type", "x", "y", "w", "h")


def pred_of(t):
    return t.preds.select("image_id", F.col("box_id").alias("ord"), "box_id", "type", "x", "y", "w", "h")


# shared pieces of oracle SQL -------------------------------------------------------
INTER = (
    "greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * "
    "greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
)
IOU = f"CASE WHEN a.w*a.h + b.w*b.h - {INTER} > 0 THEN ({INTER}) / (a.w*a.h + b.w*b.h - {INTER}) ELSE 0 END"


@query("geo_pair_measures", f"""
SELECT a.image_id, a.box_id, round({IOU}, 6) AS iou, round({INTER}, 6) AS inter,
       round(({INTER}) / (a.w*a.h), 6) AS cover_a, round(({INTER}) / (b.w*b.h), 6) AS cover_b,
       round(greatest(0.0, greatest(a.x, b.x) - least(a.x+a.w, b.x+b.w)), 6) AS gap,
       round(greatest(0.0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) / greatest(1.0, least(a.h, b.h)), 6) AS v_over,
       round(sqrt((a.x+a.w/2-b.x-b.w/2)*(a.x+a.w/2-b.x-b.w/2) + (a.y+a.h/2-b.y-b.h/2)*(a.y+a.h/2-b.y-b.h/2)), 6) AS dist
FROM boxes a JOIN preds b ON b.image_id = a.image_id AND b.box_id = concat('p', a.box_id)""")
def _(t):
    a, b = S.prefixed(t.boxes, "a_"), S.prefixed(t.preds, "b_")
    j = a.join(b, (a.image_id == b.image_id) & (F.col("b_box_id") == F.concat(F.lit("p"), "a_box_id"))).drop(b.image_id)
    p, q = G.box("a_"), G.box("b_")
    return j.select(
        "image_id", F.col("a_box_id").alias("box_id"), r6(G.iou(p, q), "iou"), r6(G.intersection_area(p, q), "inter"),
        r6(G.coverage(p, q), "cover_a"), r6(G.overlap_ratio(q, p), "cover_b"), r6(G.h_gap(p, q), "gap"),
        r6(G.v_overlap_ratio(p, q), "v_over"), r6(G.center_distance(p, q), "dist"),
    )


@query("geo_containment_modes", """
SELECT a.image_id, a.box_id, b.x >= a.x AND b.y >= a.y AND b.x+b.w <= a.x+a.w AND b.y+b.h <= a.y+a.h AND a.w*a.h > b.w*b.h AS strict,
       b.x >= a.x-1e-6 AND b.y >= a.y-1e-6 AND b.x+b.w <= a.x+a.w+1e-6 AND b.y+b.h <= a.y+a.h+1e-6 AND a.w*a.h > b.w*b.h AS eps,
       b.x >= a.x AND b.y >= a.y AND b.x+b.w <= a.x+a.w AND b.y+b.h <= a.y+a.h AS inclusive,
       b.x+b.w/2 >= a.x AND b.x+b.w/2 <= a.x+a.w AND b.y+b.h/2 >= a.y AND b.y+b.h/2 <= a.y+a.h AS center_in
FROM boxes a JOIN preds b ON b.image_id = a.image_id AND b.box_id = concat('p', a.box_id)""")
def _(t):
    a, b = S.prefixed(t.boxes, "a_"), S.prefixed(t.preds, "b_")
    j = a.join(b, (a.image_id == b.image_id) & (F.col("b_box_id") == F.concat(F.lit("p"), "a_box_id"))).drop(b.image_id)
    o, i = G.box("a_"), G.box("b_")
    return j.select(
        "image_id", F.col("a_box_id").alias("box_id"), G.contains(o, i, "strict").alias("strict"),
        G.contains(o, i, "eps").alias("eps"), G.contains(o, i, "inclusive").alias("inclusive"),
        G.center_inside(i, o).alias("center_in"),
    )


@query("geo_transforms", """
SELECT image_id, box_id, x-4 AS ex, w+8 AS ew, x+2 AS sx, w-4 AS sw,
       greatest(0.0, least(420.0, floor(x+0.5))) AS cx, greatest(0.0, least(420.0, floor(x+w+0.5))) - greatest(0.0, least(420.0, floor(x+0.5))) AS cw,
       CASE WHEN least(x+w, 300) > greatest(x, 100) AND least(y+h, 600) > greatest(y, 200) THEN greatest(x, 100) END AS clip_x,
       CASE WHEN least(x+w, 300) > greatest(x, 100) AND least(y+h, 600) > greatest(y, 200) THEN least(y+h, 600) - greatest(y, 200) END AS clip_h,
       round(x*1.5, 6) AS scaled_x, round(h*0.5, 6) AS scaled_h
FROM preds""")
def _(t):
    b = G.box()
    c = G.clamp(b, F.lit(420), F.lit(820))
    k = G.clip(b, G.Box(F.lit(100.0), F.lit(200.0), F.lit(200.0), F.lit(400.0)))
    s = G.scale(b, F.lit(1.5), F.lit(0.5))
    e, h = G.expand(b, 4.0), G.shrink(b, 2.0)
    return t.preds.select(
        "image_id", "box_id", e.x.alias("ex"), e.w.alias("ew"), h.x.alias("sx"), h.w.alias("sw"), c.x.alias("cx"), c.w.alias("cw"),
        k.x.alias("clip_x"), k.h.alias("clip_h"), r6(s.x, "scaled_x"), r6(s.h, "scaled_h"),
    )


@query("geo_union_box", """
SELECT image_id, type, min(x) AS x, min(y) AS y, max(x+w)-min(x) AS w, max(y+h)-min(y) AS h FROM boxes GROUP BY image_id, type""")
def _(t):
    return t.boxes.groupBy("image_id", "type").agg(*G.union_box())


@query("geo_valid_box", """
SELECT image_id, count(*) AS n, count(CASE WHEN x > 0 THEN 1 END) AS n_valid
FROM boxes GROUP BY image_id""")
def _(t):
    # a zero x poisons the box with NaN, which must not count as valid
    bad = F.when(F.col("x") > 0, F.col("w")).otherwise(F.lit(float("nan")))
    b = G.Box(F.col("x"), F.col("y"), bad, F.col("h"))
    return t.boxes.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(G.valid_box(b), 1)).alias("n_valid")
    )


@query("geo_node_ids", """
SELECT image_id, box_id, CASE WHEN k = 1 THEN base ELSE concat(base, '#', CAST(k AS STRING)) END AS node_id FROM (
  SELECT image_id, box_id, base, row_number() OVER (PARTITION BY image_id, base ORDER BY box_id) AS k FROM (
    SELECT image_id, box_id, concat(type, ':', CAST(CAST(floor(x/8+0.5) AS BIGINT) AS STRING), ',', CAST(CAST(floor(y/8+0.5) AS BIGINT) AS STRING), ',',
           CAST(CAST(floor(w/8+0.5) AS BIGINT) AS STRING), ',', CAST(CAST(floor(h/8+0.5) AS BIGINT) AS STRING)) AS base FROM boxes) t) u""")
def _(t):
    from screenlake.operators.typing_rules import node_ids

    eighth = F.lit(0.125)
    small = t.boxes.select("image_id", "box_id", "type", *G.scale(G.box(), eighth, eighth).aliased())
    return node_ids(small, "box_id").select("image_id", "box_id", "node_id")


@query("geo_complexity", """
SELECT image_id, CASE WHEN px < 500000 OR sz < 100000 THEN 'low' WHEN px < 2000000 OR sz < 1000000 THEN 'medium' ELSE 'high' END AS complexity,
       round(asp, 6) AS aspect FROM (
  SELECT image_id, (400 + image_id % 2000) * CAST(800 + image_id % 700 AS DOUBLE) AS px, image_id * 1700 AS sz,
         CAST(400 + image_id % 2000 AS DOUBLE) / (800 + image_id % 700) AS asp FROM pages_meta) t""")
def _(t):
    w, h, s = F.col("image_id") % 2000 + 400, F.col("image_id") % 700 + 800, F.col("image_id") * 1700
    return t.pages_meta.select("image_id", G.complexity_bucket(w, h, s).alias("complexity"), r6(G.aspect(w, h), "aspect"))


@query("iou_join", f"""
SELECT a.image_id, a.box_id AS gt_id, b.box_id AS pred_id, round({IOU}, 6) AS iou
FROM boxes a JOIN preds b ON a.image_id = b.image_id AND a.type = b.type
WHERE {IOU} >= 0.5""")
def _(t):
    return S.iou_join(gt_of(t), pred_of(t), 0.5, same_type=True).select(
        "image_id", F.col("a_box_id").alias("gt_id"), F.col("b_box_id").alias("pred_id"), r6(F.col("iou"), "iou")
    )


GT_FOLD = f"""
WITH RECURSIVE edges AS (
  SELECT image_id, type, gt_id, pred_id, iou, row_number() OVER (PARTITION BY image_id, type ORDER BY gt_id, iou DESC, pred_id) AS k FROM (
    SELECT a.image_id, a.type, a.box_id AS gt_id, b.box_id AS pred_id, {IOU} AS iou
    FROM boxes a JOIN preds b ON a.image_id = b.image_id AND a.type = b.type WHERE {IOU} >= 0.5) e),
fold AS (
  SELECT image_id, type, CAST(0 AS BIGINT) AS k, CAST([] AS STRING[]) AS ug, CAST([] AS STRING[]) AS up, FALSE AS took FROM edges GROUP BY image_id, type
  UNION ALL
  SELECT e.image_id, e.type, e.k,
         CASE WHEN list_contains(ug, e.gt_id) OR list_contains(up, e.pred_id) THEN ug ELSE list_append(ug, e.gt_id) END,
         CASE WHEN list_contains(ug, e.gt_id) OR list_contains(up, e.pred_id) THEN up ELSE list_append(up, e.pred_id) END,
         NOT (list_contains(ug, e.gt_id) OR list_contains(up, e.pred_id))
  FROM fold f JOIN edges e ON e.image_id = f.image_id AND e.type = f.type AND e.k = f.k + 1),
matches AS (SELECT e.* FROM edges e JOIN fold f ON e.image_id = f.image_id AND e.type = f.type AND e.k = f.k WHERE f.took)"""


@query("match_greedy_gt", GT_FOLD + " SELECT image_id, type, gt_id, pred_id, round(iou, 6) AS iou FROM matches")
def _(t):
    return M.match_greedy_gt(gt_of(t), pred_of(t)).withColumn("iou", F.round("iou", 6))


GLOBAL_FOLD = f"""
WITH RECURSIVE edges AS (
  SELECT image_id, pred_id, human_id, iou, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, pred_id, human_id) AS k FROM (
    SELECT a.image_id, a.box_id AS human_id, b.box_id AS pred_id, {IOU.replace('a.', 'B_').replace('b.', 'a.').replace('B_', 'b.')} AS iou
    FROM boxes a JOIN preds b ON a.image_id = b.image_id WHERE {IOU.replace('a.', 'B_').replace('b.', 'a.').replace('B_', 'b.')} >= 0.5) e),
fold AS (
  SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRING[]) AS ug, CAST([] AS STRING[]) AS up, FALSE AS took FROM edges GROUP BY image_id
  UNION ALL
  SELECT e.image_id, e.k,
         CASE WHEN list_contains(ug, e.human_id) OR list_contains(up, e.pred_id) THEN ug ELSE list_append(ug, e.human_id) END,
         CASE WHEN list_contains(ug, e.human_id) OR list_contains(up, e.pred_id) THEN up ELSE list_append(up, e.pred_id) END,
         NOT (list_contains(ug, e.human_id) OR list_contains(up, e.pred_id))
  FROM fold f JOIN edges e ON e.image_id = f.image_id AND e.k = f.k + 1),
matches AS (SELECT e.* FROM edges e JOIN fold f ON e.image_id = f.image_id AND e.k = f.k WHERE f.took)"""


@query("match_greedy_global", GLOBAL_FOLD + " SELECT image_id, pred_id, human_id, round(iou, 6) AS iou FROM matches")
def _(t):
    return M.match_greedy_global(pred_of(t), gt_of(t)).withColumn("iou", F.round("iou", 6))


@query("annotation_diff", GLOBAL_FOLD + """,
p AS (SELECT image_id, box_id, type, CASE WHEN p % 17 = 0 THEN 'x' ELSE 'ab c' END AS text, CASE WHEN q % 19 = 0 THEN 'nav' END AS role FROM preds),
g AS (SELECT image_id, box_id, type, 'ab  c ' AS text, CAST(NULL AS STRING) AS role FROM boxes),
rows_ AS (
  SELECT m.image_id, CASE WHEN p.role IS DISTINCT FROM g.role THEN 'wrong_structure' WHEN p.type <> g.type THEN 'wrong_type'
         WHEN p.text <> 'ab c' THEN 'wrong_text' WHEN m.iou < 0.85 THEN 'wrong_bbox' END AS category,
         m.pred_id, m.human_id, m.iou, p.type AS pt, g.type AS ht, concat('match:', m.pred_id, ':', m.human_id) AS diff_id
  FROM matches m JOIN p ON p.image_id = m.image_id AND p.box_id = m.pred_id JOIN g ON g.image_id = m.image_id AND g.box_id = m.human_id
  UNION ALL
  SELECT p.image_id, 'false_positive', p.box_id, NULL, NULL, p.type, NULL, concat('prediction:', p.box_id) FROM p
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.image_id = p.image_id AND m.pred_id = p.box_id)
  UNION ALL
  SELECT g.image_id, 'missed', NULL, g.box_id, NULL, NULL, g.type, concat('annotation:', g.box_id) FROM g
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.image_id = g.image_id AND m.human_id = g.box_id))
SELECT image_id, diff_id, category, pred_id, human_id, round(iou, 6) AS iou,
       CASE WHEN category IN ('missed', 'false_positive') AND coalesce(pt, ht) IN ('button', 'input') THEN 'high'
            WHEN category = 'wrong_type' AND concat(least(pt, ht), ':', greatest(pt, ht)) IN ('icon:text', 'button:input', 'card:row') THEN 'high'
            WHEN iou < 0.5 THEN 'high' WHEN category = 'wrong_bbox' AND iou >= 0.7 THEN 'low' ELSE 'medium' END AS severity,
       CASE category WHEN 'missed' THEN concat('review recall for ', ht, ' detection') WHEN 'false_positive' THEN concat('review precision for ', pt, ' detection')
            WHEN 'wrong_type' THEN concat('review ', pt, ' to ', ht, ' type disambiguation') WHEN 'wrong_bbox' THEN 'review bbox refinement and region merging'
            WHEN 'wrong_text' THEN 'review OCR-to-element text binding' ELSE 'review containment and semantic-role inference' END AS hint
FROM rows_ WHERE category IS NOT NULL""")
def _(t):
    none = F.lit(None).cast("array<string>")
    p = t.preds.select(
        "image_id", "box_id", "type", F.when(F.col("p") % 17 == 0, "x").otherwise("ab c").alias("text"),
        F.when(F.col("q") % 19 == 0, "nav").alias("semantic_role"), none.alias("children"), "x", "y", "w", "h",
    )
    g = t.boxes.select(
        "image_id", "box_id", "type", F.lit("ab  c ").alias("text"), F.lit(None).cast("string").alias("semantic_role"),
        none.alias("children"), "x", "y", "w", "h",
    )
    d = M.annotation_diff(p, g)
    return d.select("image_id", "diff_id", "category", "pred_id", "human_id", r6(F.col("iou"), "iou"), "severity", "hint")


def per_image(t):
    gt, pred = gt_of(t), pred_of(t)
    return X.detection_metrics(gt, pred, M.match_greedy_gt(gt, pred), t.pages_meta)


def per_type(t):
    gt, pred = gt_of(t), pred_of(t)
    return X.detection_metrics_by_type(gt, pred, M.match_greedy_gt(gt, pred))


IMG_METRICS = GT_FOLD + """,
g AS (SELECT image_id, count(*) AS gt_count FROM boxes GROUP BY image_id),
p AS (SELECT image_id, count(*) AS pred_count, sum(greatest(0, w) * greatest(0, h)) AS area FROM preds GROUP BY image_id),
m AS (SELECT image_id, count(*) AS matched FROM matches GROUP BY image_id),
base AS (SELECT image_id, coalesce(gt_count, 0) AS gt_count, coalesce(pred_count, 0) AS pred_count, coalesce(matched, 0) AS matched, least(1.0, coalesce(area, 0) / (420 * 820)) AS coverage
  FROM g FULL JOIN p USING (image_id) LEFT JOIN m USING (image_id)),
img AS (SELECT *, CASE WHEN gt_count > 0 THEN matched / CAST(gt_count AS DOUBLE) ELSE 0 END AS recall, CASE WHEN pred_count > 0 THEN matched / CAST(pred_count AS DOUBLE) ELSE 0 END AS "precision" FROM base),
scored AS (SELECT *, CASE WHEN recall + "precision" > 0 THEN 2 * recall * "precision" / (recall + "precision") ELSE 0 END AS f1 FROM img)"""

TYPE_METRICS = """,
tg AS (SELECT image_id, type, count(*) AS gt_count FROM boxes GROUP BY image_id, type),
tp AS (SELECT image_id, type, count(*) AS pred_count FROM preds GROUP BY image_id, type),
tm AS (SELECT image_id, type, count(*) AS matched FROM matches GROUP BY image_id, type),
tb AS (SELECT image_id, type, coalesce(gt_count, 0) AS gt_count, coalesce(pred_count, 0) AS pred_count, coalesce(matched, 0) AS matched
  FROM tg FULL JOIN tp USING (image_id, type) LEFT JOIN tm USING (image_id, type)),
ti AS (SELECT *, CASE WHEN gt_count > 0 THEN matched / CAST(gt_count AS DOUBLE) ELSE 0 END AS recall, CASE WHEN pred_count > 0 THEN matched / CAST(pred_count AS DOUBLE) ELSE 0 END AS "precision" FROM tb),
tscored AS (SELECT *, CASE WHEN recall + "precision" > 0 THEN 2 * recall * "precision" / (recall + "precision") ELSE 0 END AS f1 FROM ti)"""


@query("detection_metrics", IMG_METRICS + """
SELECT image_id, gt_count, pred_count, matched, round(recall, 6) AS recall, round("precision", 6) AS "precision", round(f1, 6) AS f1, round(coverage, 6) AS coverage FROM scored""")
def detection_metrics(t):
    m = per_image(t)
    return m.select("image_id", "gt_count", "pred_count", "matched", *(r6(F.col(c), c) for c in ("recall", "precision", "f1", "coverage")))


@query("detection_metrics_by_type", GT_FOLD + TYPE_METRICS + """
SELECT image_id, type, gt_count, pred_count, matched, round(recall, 6) AS recall, round("precision", 6) AS "precision", round(f1, 6) AS f1 FROM tscored""")
def _(t):
    m = per_type(t)
    return m.select("image_id", "type", "gt_count", "pred_count", "matched", *(r6(F.col(c), c) for c in ("recall", "precision", "f1")))


@query("benchmark_summary", IMG_METRICS + TYPE_METRICS + """
SELECT round(avg(recall), 6) AS mean_recall, round(avg("precision"), 6) AS mean_precision, round(avg(f1), 6) AS mean_f1, round(avg(coverage), 6) AS mean_coverage,
       count(*) AS total_images, CAST(sum(pred_count) AS BIGINT) AS total_predictions, CAST(sum(gt_count) AS BIGINT) AS total_gt,
       (SELECT round(avg(f), 6) FROM (SELECT type, avg(f1) AS f FROM tscored GROUP BY type) x) AS macro_f1
FROM scored""")
def _(t):
    gt, pred = gt_of(t), pred_of(t)
    matches = M.match_greedy_gt(gt, pred)
    s = X.benchmark_summary(
        X.detection_metrics(gt, pred, matches, t.pages_meta), X.detection_metrics_by_type(gt, pred, matches)
    )
    return s.select(*(r6(F.col(c), c) if c.startswith(("mean", "macro")) else c for c in s.columns))


@query("coverage_capped", """
SELECT m.image_id, round(least(1.0, coalesce(sum(p.w * p.h), 0) / (420 * 820)), 6) AS coverage FROM pages_meta m LEFT JOIN preds p ON p.image_id = m.image_id GROUP BY m.image_id""")
def _(t):
    return X.coverage_capped(t.preds, t.pages_meta).select("image_id", r6(F.col("coverage"), "coverage"))


UNION = """
WITH xs AS (SELECT image_id, x AS e FROM boxes UNION SELECT image_id, x + w FROM boxes),
strips AS (SELECT * FROM (SELECT image_id, e AS x0, lead(e) OVER (PARTITION BY image_id ORDER BY e) AS x1 FROM xs) t WHERE x1 IS NOT NULL),
hits AS (SELECT s.image_id, x0, x1, b.y AS y0, b.y + b.h AS y1 FROM strips s JOIN boxes b ON b.image_id = s.image_id AND b.x <= s.x0 AND b.x + b.w >= s.x1),
run AS (SELECT *, max(y1) OVER (PARTITION BY image_id, x0 ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
area AS (SELECT image_id, sum((x1 - x0) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) AS union_area FROM run GROUP BY image_id)"""


@query("union_area", UNION + " SELECT image_id, round(union_area, 4) AS union_area FROM area")
def _(t):
    return X.union_area(t.boxes).select("image_id", F.round("union_area", 4).alias("union_area"))


@query("unexplained_area", UNION + """
SELECT m.image_id, round(greatest(0, 1 - coalesce(union_area, 0) / (420 * 820)), 6) AS unexplained FROM pages_meta m LEFT JOIN area USING (image_id)""")
def _(t):
    return X.unexplained_area(t.boxes, t.pages_meta).select("image_id", r6(F.col("unexplained"), "unexplained"))
