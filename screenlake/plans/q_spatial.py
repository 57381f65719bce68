"""Queries over spatial joins, fusion and text lines."""

from pyspark.sql import functions as F

from screenlake.functions import geometry as G
from screenlake.operators import fusion as U, lines as L, spatial as S
from screenlake.plans.q_geometry import INTER, IOU, r6
from screenlake.plans.registry import query

INSIDE = "b.x >= a.x AND b.y >= a.y AND b.x+b.w <= a.x+a.w AND b.y+b.h <= a.y+a.h"


@query("containment_edges", f"""
SELECT a.image_id, a.box_id AS outer_id, b.box_id AS inner_id FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id <> b.box_id AND {INSIDE}""")
def _(t):
    e = S.containment_edges(t.boxes, "inclusive")
    return e.select("image_id", F.col("b_box_id").alias("outer_id"), F.col("a_box_id").alias("inner_id"))


@query("tightest_parent", f"""
SELECT c.image_id, c.box_id, g.parent_id FROM boxes c LEFT JOIN (
  SELECT b.image_id, b.box_id, a.box_id AS parent_id, row_number() OVER (PARTITION BY b.image_id, b.box_id ORDER BY a.w*a.h, a.box_id) AS k
  FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id <> b.box_id AND {INSIDE} AND a.w*a.h > b.w*b.h) g
ON g.image_id = c.image_id AND g.box_id = c.box_id AND g.k = 1""")
def _(t):
    return S.tightest_parent(t.boxes, "strict").select("image_id", "box_id", "parent_id")


@query("project_evidence", f"""
SELECT a.image_id, a.node_id, b.cand_id, round({IOU}, 6) AS iou, a.type = b.type AS type_match,
       row_number() OVER (PARTITION BY a.image_id, a.node_id ORDER BY a.type = b.type DESC, {IOU} DESC, b.cand_id) AS rank
FROM nodes a JOIN candidates b ON a.image_id = b.image_id WHERE {IOU} >= 0.3""")
def _(t):
    n = t.nodes.select("image_id", "node_id", "type", "x", "y", "w", "h")
    c = t.candidates.select("image_id", "cand_id", "type", "x", "y", "w", "h")
    return S.project_evidence(n, c).withColumn("iou", F.round("iou", 6))


@query("nodes_with_evidence", f"""
SELECT a.image_id, a.node_id FROM nodes a WHERE EXISTS (SELECT 1 FROM preds b WHERE a.image_id = b.image_id AND {IOU} >= 0.3)""")
def _(t):
    n = t.nodes.select("image_id", "node_id", "type", "x", "y", "w", "h")
    p = t.preds.select("image_id", F.col("box_id").alias("cand_id"), "type", "x", "y", "w", "h")
    links = S.project_evidence(n, p)
    return n.join(links, ["image_id", "node_id"], "left_semi").select("image_id", "node_id")


REGIONS = "(SELECT image_id, box_id AS region_id, x, y, w*2 AS w, h*2 AS h FROM boxes WHERE type = 'card')"


def regions(t):
    return t.boxes.where("type = 'card'").select("image_id", F.col("box_id").alias("region_id"), "x", "y", (F.col("w") * 2).alias("w"), (F.col("h") * 2).alias("h"))


@query("items_in_region", f"""
SELECT a.image_id, b.region_id, a.box_id FROM ocr_items a JOIN {REGIONS} b ON a.image_id = b.image_id
WHERE (a.x+a.w/2 >= b.x-4 AND a.x+a.w/2 <= b.x+b.w+4 AND a.y+a.h/2 >= b.y-4 AND a.y+a.h/2 <= b.y+b.h+4) OR ({INTER}) / (a.w*a.h) >= 0.35""")
def _(t):
    hits = S.items_in_region(t.ocr_items, regions(t))
    return hits.select("image_id", F.col("b_region_id").alias("region_id"), F.col("a_box_id").alias("box_id"))


@query("items_near_region", f"""
SELECT a.image_id, b.region_id, a.box_id FROM ocr_items a JOIN {REGIONS} b ON a.image_id = b.image_id
WHERE a.x+a.w/2 >= b.x-25 AND a.x+a.w/2 <= b.x+b.w+25 AND a.y+a.h/2 >= b.y-25 AND a.y+a.h/2 <= b.y+b.h+25
  AND NOT (a.x+a.w/2 >= b.x AND a.x+a.w/2 <= b.x+b.w AND a.y+a.h/2 >= b.y AND a.y+a.h/2 <= b.y+b.h)""")
def _(t):
    hits = S.items_near_region(t.ocr_items, regions(t))
    return hits.select("image_id", F.col("b_region_id").alias("region_id"), F.col("a_box_id").alias("box_id"))


@query("merge_items", f"""
WITH f AS (SELECT image_id, box_id AS ord, text, x, y, w, h FROM ocr_items WHERE p % 3 <> 0),
l AS (SELECT image_id, box_id AS ord, text, x + 1 AS x, y, w, h FROM ocr_items WHERE q % 2 = 0),
pr AS (SELECT a.image_id, b.ord AS l_ord, min(a.ord) AS f_ord FROM f a JOIN l b ON a.image_id = b.image_id AND a.text = b.text WHERE ({INTER}) / (a.w*a.h) >= 0.6 GROUP BY a.image_id, b.ord),
tk AS (SELECT image_id, f_ord AS ord, max(l_ord) AS l_ord FROM pr GROUP BY image_id, f_ord)
SELECT image_id, ord, text, x, 'full' AS source FROM f WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.image_id = f.image_id AND tk.ord = f.ord)
UNION ALL SELECT l.image_id, tk.ord, l.text, l.x, 'local' FROM l JOIN tk ON tk.image_id = l.image_id AND tk.l_ord = l.ord
UNION ALL SELECT image_id, ord, text, x, 'appended' FROM l WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.image_id = l.image_id AND pr.l_ord = l.ord)""")
def _(t):
    o = t.ocr_items.withColumnRenamed("box_id", "ord")
    full = o.where("p % 3 <> 0").select("image_id", "ord", "text", "x", "y", "w", "h")
    local = o.where("q % 2 = 0").select("image_id", "ord", "text", (F.col("x") + 1).alias("x"), "y", "w", "h")
    return S.merge_items(full, local).select("image_id", "ord", "text", "x", "source")


@query("text_veto", """
WITH facts AS (SELECT image_id, x-2 AS x, y-2 AS y, w+4 AS w, h+4 AS h FROM ocr_items WHERE confidence >= 0.9),
s AS (SELECT a.image_id, a.cand_id, round(sum(greatest(0.0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) / (a.w*a.h)), 9) AS share
  FROM candidates a JOIN facts b ON a.image_id = b.image_id GROUP BY a.image_id, a.cand_id)
SELECT c.image_id, c.cand_id, round(coalesce(share, 0) + 0.0000000123, 6) AS text_share FROM candidates c LEFT JOIN s ON s.image_id = c.image_id AND s.cand_id = c.cand_id
WHERE coalesce(share, 0) < CASE WHEN c.w / c.h >= 1.7 THEN 0.1 ELSE 0.2 END""")
def _(t):
    return S.text_veto(t.candidates, t.ocr_items).select("image_id", "cand_id", r6(F.col("text_share") + 0.0000000123, "text_share"))


@query("nearest_label", """
WITH m AS (SELECT image_id, quantile_cont(h, 0.5) AS mh FROM ocr_items WHERE confidence >= 0.85 AND length(text) >= 2 GROUP BY image_id),
c AS (SELECT b.*, 1.2 * coalesce(mh, 20) AS reach FROM boxes b LEFT JOIN m USING (image_id) WHERE type = 'icon'),
pr AS (SELECT c.image_id, c.box_id AS cand_id, o.text, o.confidence, o.box_id AS oid, c.reach,
  CASE WHEN o.x >= c.x + c.w THEN o.x - c.x - c.w WHEN c.x >= o.x + o.w THEN c.x - o.x - o.w END AS gap
  FROM c JOIN ocr_items o ON o.image_id = c.image_id WHERE greatest(0, least(c.y+c.h, o.y+o.h) - greatest(c.y, o.y)) / least(c.h, o.h) >= 0.5)
SELECT image_id, cand_id, text, round(gap, 6) AS gap FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, cand_id ORDER BY gap, confidence DESC, oid) AS k FROM pr WHERE gap <= reach) t WHERE k = 1""")
def _(t):
    icons = t.boxes.where("type = 'icon'").select("image_id", F.col("box_id").alias("cand_id"), "x", "y", "w", "h")
    return S.nearest_label(icons, t.ocr_items).withColumn("gap", F.round("gap", 6))


COLON = "(SELECT image_id, box_id AS ord, CASE WHEN p % 14 IN (3, 6) THEN concat(substring(text, 1, 2), CASE WHEN p % 2 = 0 THEN ':' ELSE '：' END) WHEN p % 14 = 10 THEN '☐' ELSE text END AS text, x, y, w, h FROM ocr_items)"


def colon_items(t):
    p = F.col("p")
    label = F.concat(F.substring("text", 1, 2), F.when(p % 2 == 0, ":").otherwise("："))
    text = F.when((p % 14).isin(3, 6), label).when(p % 14 == 10, "☐").otherwise(F.col("text"))
    return t.ocr_items.select("image_id", F.col("box_id").alias("ord"), text.alias("text"), "x", "y", "w", "h")


@query("colon_values", f"""
SELECT image_id, ord, label, value FROM (
  SELECT l.image_id, l.ord, substring(l.text, 1, length(l.text) - 1) AS label, o.text AS value, row_number() OVER (PARTITION BY l.image_id, l.ord ORDER BY o.ord) AS k
  FROM {COLON} l JOIN {COLON} o ON o.image_id = l.image_id AND o.ord <> l.ord
  WHERE (l.text LIKE '%:' OR l.text LIKE '%：') AND o.x > l.x + l.w - 5 AND abs(o.y+o.h/2 - l.y-l.h/2) <= l.h * 0.8) t WHERE k = 1""")
def _(t):
    return S.colon_values(colon_items(t))


@query("right_labels", f"""
SELECT image_id, ord, label FROM (
  SELECT l.image_id, l.ord, o.text AS label, row_number() OVER (PARTITION BY l.image_id, l.ord ORDER BY o.x, o.ord) AS k
  FROM {COLON} l JOIN {COLON} o ON o.image_id = l.image_id WHERE l.text = '☐' AND o.x > l.x AND abs(o.y+o.h/2 - l.y-l.h/2) <= l.h * 0.8) t WHERE k = 1""")
def _(t):
    items = colon_items(t)
    return S.right_labels(items.where("text = '☐'"), items)


@query("field_labels", """
WITH tx AS (SELECT c.image_id, f.node_id AS parent_id, c.node_id, c.x, c.y, c.w, c.h, c.p FROM tree_nodes c JOIN tree_nodes f ON c.image_id = f.image_id AND f.n = 2 + c.n % 4 WHERE c.n > 5)
SELECT DISTINCT a.image_id, a.node_id FROM tx a JOIN tx b ON a.image_id = b.image_id AND a.parent_id = b.parent_id AND a.node_id <> b.node_id
WHERE a.x <= 420 * 0.3 AND a.y >= 820 * 0.12 AND a.p % 3 <> 0 AND b.x >= a.x + a.w AND b.x - a.x - a.w <= 84 AND greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) / least(a.h, b.h) >= 0.5""")
def _(t):
    d = t.dealt
    n = d.tree_nodes.select("image_id", F.col("node_id").alias("child_id"), "p", "x", "y", "w", "h").join(d.kids, ["image_id", "child_id"])
    texts = n.select(
        "image_id", "parent_id", F.col("child_id").alias("node_id"), F.when(F.col("p") % 3 == 0, "much longer than a label").otherwise("Name").alias("text"), "x", "y", "w", "h"
    )
    return S.field_labels(texts, d.pages_meta, dealt=True)


@query("control_labels", """
WITH tx AS (SELECT c.image_id, f.node_id AS parent_id, c.node_id, c.n, CASE WHEN c.type = 'icon' THEN 'checkbox' ELSE 'text' END AS type, c.x, c.y, c.w, c.h
  FROM tree_nodes c JOIN tree_nodes f ON c.image_id = f.image_id AND f.n = 2 + c.n % 4 WHERE c.n > 5),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, parent_id ORDER BY n) AS k FROM tx WHERE type = 'checkbox') t WHERE k = 1)
SELECT image_id, parent_id, control_id, label_id FROM (
  SELECT a.image_id, a.parent_id, a.node_id AS control_id, b.node_id AS label_id, row_number() OVER (PARTITION BY a.image_id, a.parent_id ORDER BY b.n) AS k
  FROM ct a JOIN tx b ON a.image_id = b.image_id AND a.parent_id = b.parent_id AND b.type = 'text'
  WHERE abs(b.x - a.x - a.w) <= 30 AND least(a.y+a.h, b.y+b.h) > greatest(a.y, b.y)) t WHERE k = 1""")
def _(t):
    n = t.tree_nodes.withColumnRenamed("node_id", "child_id").join(t.kids, ["image_id", "child_id"])
    kind = F.when(F.col("type") == "icon", "checkbox").otherwise("text")
    n = n.select("image_id", "parent_id", F.col("child_id").alias("node_id"), F.col("n").alias("ord"), kind.alias("type"), "x", "y", "w", "h")
    return S.control_labels(n)


@query("bind_text", f"""
WITH n AS (SELECT image_id, node_id, n, CASE WHEN type IN ('card', 'row') THEN 'region' ELSE 'control' END AS kind, CASE WHEN p % 4 = 0 THEN 'Save' END AS text, x, y, w, h FROM tree_nodes WHERE n > 1),
o AS (SELECT image_id, box_id AS item, text, x + 2 AS x, y + 1 AS y, w, h FROM ocr_items),
pr AS (SELECT a.image_id, a.item, a.text AS otext, b.node_id, b.n, b.kind, b.text AS ntext, b.w*b.h AS area, ({INTER}) / (a.w*a.h) AS cov, {IOU} AS iou,
   a.x >= b.x-1e-6 AND a.y >= b.y-1e-6 AND a.x+a.w <= b.x+b.w+1e-6 AND a.y+a.h <= b.y+b.h+1e-6 OR (a.x+a.w/2 >= b.x AND a.x+a.w/2 <= b.x+b.w AND a.y+a.h/2 >= b.y AND a.y+a.h/2 <= b.y+b.h) AS holds
  FROM o a JOIN n b ON a.image_id = b.image_id),
c AS (SELECT image_id, item, otext, node_id, ntext FROM (SELECT *, row_number() OVER (PARTITION BY image_id, item ORDER BY area, n) AS k FROM pr WHERE kind = 'control' AND cov >= 0.7) t WHERE k = 1),
cs AS (SELECT *, min(item) OVER (PARTITION BY image_id, node_id) AS first_item, first_value(otext) OVER (PARTITION BY image_id, node_id ORDER BY item) AS first_text FROM c),
s1 AS (SELECT image_id, item, node_id, CASE WHEN ntext IS NULL AND item = first_item THEN 'control-text' WHEN lower(coalesce(ntext, first_text)) = lower(otext) THEN 'control-confirm' END AS act FROM cs),
r AS (SELECT image_id, item, node_id, ntext FROM (SELECT *, row_number() OVER (PARTITION BY image_id, item ORDER BY area, n) AS k FROM pr WHERE kind = 'region' AND iou >= 0.5) t WHERE k = 1),
rest AS (SELECT r.*, min(item) OVER (PARTITION BY image_id, node_id) AS first_item FROM r WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.image_id = r.image_id AND s1.item = r.item AND s1.act IS NOT NULL)),
p AS (SELECT image_id, item, node_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, item ORDER BY area, n) AS k FROM pr WHERE kind = 'region' AND holds) t WHERE k = 1)
SELECT o.image_id, o.item AS ord, CASE WHEN s1.act IS NOT NULL THEN s1.act WHEN rest.ntext IS NULL AND rest.first_item = o.item THEN 'region-text' ELSE 'text-child' END AS action,
       CASE WHEN s1.act IS NOT NULL THEN s1.node_id WHEN rest.ntext IS NULL AND rest.first_item = o.item THEN rest.node_id ELSE coalesce(p.node_id, 'page') END AS target_id
FROM o LEFT JOIN s1 ON s1.image_id = o.image_id AND s1.item = o.item LEFT JOIN rest ON rest.image_id = o.image_id AND rest.item = o.item LEFT JOIN p ON p.image_id = o.image_id AND p.item = o.item""")
def _(t):
    n = t.tree_nodes.where("n > 1").select(
        "image_id", "node_id", F.col("n").alias("ord"), F.when(F.col("type").isin("card", "row"), "region").otherwise("control").alias("kind"),
        F.when(F.col("p") % 4 == 0, "Save").alias("text"), "x", "y", "w", "h",
    )
    o = t.ocr_items.select("image_id", F.col("box_id").alias("ord"), "text", (F.col("x") + 2).alias("x"), (F.col("y") + 1).alias("y"), "w", "h")
    return S.bind_text(n, o)


DIRECTION = "CASE WHEN max(y+h/2)-min(y+h/2) > 1.3*(max(x+w/2)-min(x+w/2)) THEN 'top-down' WHEN max(x+w/2)-min(x+w/2) > 1.3*(max(y+h/2)-min(y+h/2)) THEN 'left-right' ELSE 'unknown' END"


@query("flow_direction", f"SELECT image_id, CASE WHEN count(*) < 2 THEN 'unknown' ELSE {DIRECTION} END AS direction FROM boxes GROUP BY image_id")
def _(t):
    from screenlake.operators.layout import flow_direction

    return flow_direction(t.boxes)


@query("nearest_downstream", f"""
WITH d AS (SELECT image_id, {DIRECTION} AS direction FROM boxes GROUP BY image_id)
SELECT image_id, src, dst, round(dist, 6) AS dist FROM (
  SELECT a.image_id, a.box_id AS src, b.box_id AS dst, sqrt((a.x+a.w/2-b.x-b.w/2)*(a.x+a.w/2-b.x-b.w/2) + (a.y+a.h/2-b.y-b.h/2)*(a.y+a.h/2-b.y-b.h/2)) AS dist,
         row_number() OVER (PARTITION BY a.image_id, a.box_id ORDER BY sqrt((a.x+a.w/2-b.x-b.w/2)*(a.x+a.w/2-b.x-b.w/2) + (a.y+a.h/2-b.y-b.h/2)*(a.y+a.h/2-b.y-b.h/2)), b.box_id) AS k
  FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id <> b.box_id JOIN d ON d.image_id = a.image_id
  WHERE CASE direction WHEN 'top-down' THEN b.y+b.h/2 > a.y+a.h/2+5 WHEN 'left-right' THEN b.x+b.w/2 > a.x+a.w/2+5 ELSE b.y+b.h/2 > a.y+a.h/2+5 OR b.x+b.w/2 > a.x+a.w/2+5 END) t WHERE k = 1""")
def _(t):
    from screenlake.operators.layout import flow_direction

    n = t.boxes.select("image_id", F.col("box_id").alias("ord"), "x", "y", "w", "h")
    return S.nearest_downstream(n, flow_direction(t.boxes)).withColumn("dist", F.round("dist", 6))


# --- fusion -------------------------------------------------------------------------
FUSE = """
WITH RECURSIVE it AS (SELECT *, row_number() OVER (PARTITION BY image_id, type ORDER BY score DESC, cand_id, x, y, w, h) AS k FROM candidates),
fold AS (
  SELECT image_id, type, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, score DOUBLE, members INT, src STRING[])[]) AS cs FROM it GROUP BY image_id, type
  UNION ALL
  SELECT image_id, type, k, CASE WHEN hit IS NULL OR hit = 0
      THEN list_append(cs, {'id': cand_id, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score, 'members': CAST(1 AS INT), 'src': [source]})
      ELSE list_transform(cs, lambda c, i: CASE WHEN i = hit AND ious[i] >= 0.7
        THEN {'id': c.id, 'x': c.x*(c.score/(c.score+e.score)) + e.x*(e.score/(c.score+e.score)), 'y': c.y*(c.score/(c.score+e.score)) + e.y*(e.score/(c.score+e.score)), 'w': c.w*(c.score/(c.score+e.score)) + e.w*(e.score/(c.score+e.score)),
              'h': c.h*(c.score/(c.score+e.score)) + e.h*(e.score/(c.score+e.score)), 'score': (c.score+e.score)/2, 'members': CAST(c.members + 1 AS INT), 'src': list_append(c.src, e.source)} ELSE c END) END
  FROM (SELECT f.cs, e.*, list_transform(f.cs, lambda c: greatest(0.0, least(c.x+c.w, e.x+e.w) - greatest(c.x, e.x)) * greatest(0.0, least(c.y+c.h, e.y+e.h) - greatest(c.y, e.y))
        / (c.w*c.h + e.w*e.h - greatest(0.0, least(c.x+c.w, e.x+e.w) - greatest(c.x, e.x)) * greatest(0.0, least(c.y+c.h, e.y+e.h) - greatest(c.y, e.y)))) AS ious,
        list_position(list_transform(ious, lambda v: v >= 0.5), true) AS hit FROM fold f JOIN it e ON e.image_id = f.image_id AND e.type = f.type AND e.k = f.k + 1) e),
last AS (SELECT f.image_id, f.type, unnest(f.cs) AS c FROM fold f JOIN (SELECT image_id, type, max(k) AS k FROM it GROUP BY image_id, type) m ON m.image_id = f.image_id AND m.type = f.type AND m.k = f.k),
fused AS (SELECT image_id, type, c.id AS cand_id, c.x AS x, c.y AS y, c.w AS w, c.h AS h, c.score AS score, c.members AS members, array_to_string(list_sort(list_distinct(c.src)), ',') AS sources FROM last)"""


@query("fuse_candidates", FUSE + " SELECT image_id, type, cand_id, round(x + 0.0000123, 4) AS x, round(y + 0.0000123, 4) AS y, round(w + 0.0000123, 4) AS w, round(h + 0.0000123, 4) AS h, round(score + 0.0000000123, 6) AS score, members, sources FROM fused")
def _(t):
    f = U.fuse_candidates(t.candidates, 0.5, 0.7)
    return f.select("image_id", "type", "cand_id", *(F.round(F.col(c) + 0.0000123, 4).alias(c) for c in "xywh"), r6(F.col("score") + 0.0000000123, "score"), "members", F.array_join("sources", ",").alias("sources"))


@query("merge_votes", """
WITH b AS (SELECT image_id, type, source, max(score) AS score FROM candidates GROUP BY image_id, type, source)
SELECT image_id, type, string_agg(source, ',' ORDER BY source) AS sources, max(score) AS best_score, arg_max(source, concat(CAST(CAST(round(score * 100) AS INT) + 1000 AS STRING), source)) AS best_source
FROM b GROUP BY image_id, type""")
def _(t):
    from screenlake.operators.metrics import merge_votes

    return merge_votes(t.candidates, ["image_id", "type"]).withColumn("sources", F.array_join("sources", ","))


@query("flag_conflicts", f"""
SELECT c.image_id, c.ord, c.type, CASE WHEN t.bt IS NOT NULL THEN concat('cross-type-overlap:', t.bt) END AS conflict_reason
FROM (SELECT image_id, box_id AS ord, type FROM preds) c LEFT JOIN (
  SELECT a.image_id, a.box_id, b.type AS bt, row_number() OVER (PARTITION BY a.image_id, a.box_id ORDER BY b.box_id) AS k
  FROM preds a JOIN preds b ON a.image_id = b.image_id AND a.type <> b.type WHERE {IOU} >= 0.3) t ON t.image_id = c.image_id AND t.box_id = c.ord AND t.k = 1""")
def _(t):
    p = t.preds.select("image_id", F.col("box_id").alias("ord"), "type", "x", "y", "w", "h")
    return U.flag_conflicts(p, 0.3).select("image_id", "ord", "type", "conflict_reason")


DEDUPE = """
WITH RECURSIVE it AS (SELECT image_id, type, cand_id AS ord, x, y, w, h, score, row_number() OVER (PARTITION BY image_id, type ORDER BY cand_id) AS k FROM candidates),
fold AS (
  SELECT image_id, type, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(o STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, score DOUBLE, slot STRING)[]) AS cs FROM it GROUP BY image_id, type
  UNION ALL
  SELECT image_id, type, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(cs, {'o': ord, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score, 'slot': ord})
      ELSE list_transform(cs, lambda c, i: CASE WHEN i = hit AND e.score > c.score THEN {'o': e.ord, 'x': e.x, 'y': e.y, 'w': e.w, 'h': e.h, 'score': e.score, 'slot': c.slot} ELSE c END) END
  FROM (SELECT f.cs, e.*, list_position(list_transform(f.cs, lambda c: greatest(0.0, least(c.x+c.w, e.x+e.w) - greatest(c.x, e.x)) * greatest(0.0, least(c.y+c.h, e.y+e.h) - greatest(c.y, e.y))
        / (c.w*c.h + e.w*e.h - greatest(0.0, least(c.x+c.w, e.x+e.w) - greatest(c.x, e.x)) * greatest(0.0, least(c.y+c.h, e.y+e.h) - greatest(c.y, e.y))) >= 0.8), true) AS hit
        FROM fold f JOIN it e ON e.image_id = f.image_id AND e.type = f.type AND e.k = f.k + 1) e)
SELECT f.image_id, f.type, c.o AS ord, c.slot AS slot FROM (SELECT f.image_id, f.type, unnest(f.cs) AS c FROM fold f JOIN (SELECT image_id, type, max(k) AS k FROM it GROUP BY image_id, type) m ON m.image_id = f.image_id AND m.type = f.type AND m.k = f.k) f"""


@query("dedupe_boxes", DEDUPE)
def _(t):
    c = t.candidates.select("image_id", "type", F.col("cand_id").alias("ord"), "x", "y", "w", "h", "score")
    return U.dedupe_boxes(c, "type").select("image_id", "type", "ord", "slot")


SEEDS = """
WITH RECURSIVE it AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY source <> 'ocr', w*h, cand_id) AS k FROM candidates),
fold AS (
  SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(o STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]) AS cs FROM it GROUP BY image_id
  UNION ALL
  SELECT image_id, k, CASE WHEN hit THEN cs ELSE list_append(cs, {'o': cand_id, 'x': x, 'y': y, 'w': w, 'h': h}) END
  FROM (SELECT f.cs, e.*, coalesce(list_bool_or(list_transform(f.cs, lambda c:
        greatest(0.0, least(c.x+c.w, e.x+e.w) - greatest(c.x, e.x)) * greatest(0.0, least(c.y+c.h, e.y+e.h) - greatest(c.y, e.y)) / (c.w*c.h + e.w*e.h - greatest(0.0, least(c.x+c.w, e.x+e.w) - greatest(c.x, e.x)) * greatest(0.0, least(c.y+c.h, e.y+e.h) - greatest(c.y, e.y))) >= 0.8
        OR (least(c.w*c.h, e.w*e.h) / greatest(c.w*c.h, e.w*e.h) >= 0.2 AND greatest(0.0, least(c.x+c.w, e.x+e.w) - greatest(c.x, e.x)) * greatest(0.0, least(c.y+c.h, e.y+e.h) - greatest(c.y, e.y)) / least(c.w*c.h, e.w*e.h) >= 0.8))), false) AS hit
        FROM fold f JOIN it e ON e.image_id = f.image_id AND e.k = f.k + 1) e)
SELECT f.image_id, c.o AS cand_id FROM (SELECT f.image_id, unnest(f.cs) AS c FROM fold f JOIN (SELECT image_id, max(k) AS k FROM it GROUP BY image_id) m ON m.image_id = f.image_id AND m.k = f.k) f"""


@query("dedupe_seeds", SEEDS)
def _(t):
    s = t.candidates.withColumn("anchored", F.col("source") == "ocr")
    return U.dedupe_seeds(s).select("image_id", "cand_id")


@query("union_sources", """
SELECT s.source, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'skipped' ELSE 'ok' END AS status
FROM (SELECT 'cv' AS source UNION ALL SELECT 'ui-detector' UNION ALL SELECT 'omniparser') s
LEFT JOIN (SELECT 'cv' AS source, count(*) AS n FROM boxes UNION ALL SELECT 'ui-detector', count(*) FROM preds) c ON c.source = s.source""")
def _(t):
    cols = ["image_id", "box_id", "type", "x", "y", "w", "h"]
    u = U.union_sources(t.spark, {"cv": t.boxes.select(*cols), "ui-detector": t.preds.select(*cols, "score"), "omniparser": None})
    return U.source_diagnostics(u, ["cv", "ui-detector", "omniparser"])


# --- lines --------------------------------------------------------------------------
def items(t):
    return t.ocr_items.withColumnRenamed("box_id", "ord")


LINE_GAP = """
ln AS (SELECT *, sum(brk) OVER (PARTITION BY image_id ORDER BY y, x, box_id ROWS UNBOUNDED PRECEDING) AS line FROM (
  SELECT *, CASE WHEN lag(y) OVER w IS NOT NULL AND {cond} THEN 1 ELSE 0 END AS brk FROM ocr_items WINDOW w AS (PARTITION BY image_id ORDER BY y, x, box_id)) t)"""
DOC_GAP = LINE_GAP.format(cond="abs(y - lag(y) OVER w) > greatest(8, 0.6*h)")
CODE_GAP = LINE_GAP.format(cond="abs(lag(y) OVER w + lag(h) OVER w / 2 - y - h/2) > greatest(4, 0.5*greatest(lag(h) OVER w, h))")


@query("group_lines_document", "WITH " + DOC_GAP + " SELECT image_id, box_id AS ord, CAST(line AS BIGINT) AS line FROM ln")
def _(t):
    return L.group_lines_gap(items(t)).select("image_id", "ord", "line")


@query("group_lines_code", "WITH " + CODE_GAP + " SELECT image_id, box_id AS ord, CAST(line AS BIGINT) AS line FROM ln")
def _(t):
    return L.group_lines_gap(items(t), "code").select("image_id", "ord", "line")


LINE_FOLD = """
med AS (SELECT image_id, greatest(10.0, 0.6 * list_sort(list(h))[count(*) // 2 + 1]) AS tol FROM ocr_items GROUP BY image_id),
it AS (SELECT o.*, y + h/2 AS cy, tol, row_number() OVER (PARTITION BY image_id ORDER BY y + h/2, x + w/2, box_id) AS k FROM ocr_items o JOIN med USING (image_id)),
fold AS (
  SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(y DOUBLE, n DOUBLE)[]) AS ls, CAST('' AS STRING) AS ord, CAST(0 AS BIGINT) AS line FROM it GROUP BY image_id
  UNION ALL
  SELECT image_id, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(ls, {'y': cy, 'n': CAST(1 AS DOUBLE)}) ELSE list_transform(ls, lambda l, i: CASE WHEN i = hit THEN {'y': (l.y * l.n + cy) / (l.n + 1), 'n': l.n + 1} ELSE l END) END,
         box_id, CASE WHEN hit IS NULL OR hit = 0 THEN len(ls) ELSE hit - 1 END
  FROM (SELECT f.ls, e.*, list_position(list_transform(f.ls, lambda l: abs(l.y - e.cy) <= e.tol), true) AS hit FROM fold f JOIN it e ON e.image_id = f.image_id AND e.k = f.k + 1) e),
lined AS (SELECT i.*, f.line FROM fold f JOIN it i ON i.image_id = f.image_id AND i.k = f.k WHERE f.k > 0)"""


@query("group_lines_fold", "WITH RECURSIVE " + LINE_FOLD + " SELECT image_id, box_id AS ord, CAST(line AS INT) AS line FROM lined")
def _(t):
    return L.group_lines_fold(items(t)).select("image_id", "ord", "line")


@query("flow_clusters", """
WITH RECURSIVE it AS (SELECT *, y + h/2 AS cy, row_number() OVER (PARTITION BY image_id ORDER BY y + h/2, h, box_id) AS k FROM ocr_items),
fold AS (
  SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a DOUBLE, b DOUBLE)[]) AS ls, CAST('' AS STRING) AS ord, CAST(0 AS BIGINT) AS cl FROM it GROUP BY image_id
  UNION ALL
  SELECT image_id, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(ls, {'a': y, 'b': y + h}) ELSE list_transform(ls, lambda l, i: CASE WHEN i = hit THEN {'a': least(l.a, e.y), 'b': greatest(l.b, e.y + e.h)} ELSE l END) END,
         box_id, CASE WHEN hit IS NULL OR hit = 0 THEN len(ls) ELSE hit - 1 END
  FROM (SELECT f.ls, e.*, list_position(list_transform(f.ls, lambda l: abs((l.a + l.b) / 2 - e.cy) <= greatest(12, 0.8 * e.h)), true) AS hit FROM fold f JOIN it e ON e.image_id = f.image_id AND e.k = f.k + 1) e)
SELECT image_id, ord, CAST(cl AS INT) AS cluster FROM fold WHERE k > 0""")
def _(t):
    return L.flow_clusters(items(t)).select("image_id", "ord", "cluster")


@query("reading_order", """
WITH a AS (SELECT image_id, box_id, x + w/2 AS cx, y + h/2 AS cy FROM ocr_items),
b AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY image_id ORDER BY cy, cx, box_id) > 8 THEN 1 ELSE 0 END AS brk FROM a),
c AS (SELECT *, sum(brk) OVER (PARTITION BY image_id ORDER BY cy, cx, box_id ROWS UNBOUNDED PRECEDING) AS line FROM b)
SELECT image_id, box_id AS ord, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY image_id ORDER BY line, cx, box_id) AS rank FROM c""")
def _(t):
    return L.reading_order(items(t)).select("image_id", "ord", "line", "rank")
