"""Queries over layout reconstruction, page-level aggregates and node typing."""

from pyspark.sql import functions as F

from screenlake.functions import rulebook as RB
from screenlake.operators import entities as E, layout as Y, metrics as X, spatial as S, typing_rules as T
from screenlake.plans.q_geometry import INTER, IOU, r6
from screenlake.plans.q_text import any_word, case, hit, in_list, lit
from screenlake.plans.registry import query

MED = "list_sort(list({0}))[count(*) // 2 + 1]"


# --- shared inputs ----------------------------------------------------------------------
KID_TYPE = "CASE c.type WHEN 'button' THEN 'container' WHEN 'text' THEN 'section' WHEN 'icon' THEN 'unknown' ELSE c.type END"
KIDN = f"""
kidn AS (SELECT c.image_id, f.node_id AS parent_id, c.node_id, c.n AS ord, {KID_TYPE} AS type, CAST(floor(c.x / 20) AS DOUBLE) AS x, c.y, c.w, c.h, c.p, c.q
  FROM tree_nodes c LEFT JOIN tree_nodes f ON c.image_id = f.image_id AND c.n > 5 AND f.n = 2 + c.n % 4)"""


def kid_nodes(t):
    c, f = t.tree_nodes, t.tree_nodes.select("image_id", F.col("node_id").alias("parent_id"), (F.col("n") - 2).alias("_slot")).where("_slot BETWEEN 0 AND 3")
    c = c.withColumn("_slot", F.when(F.col("n") > 5, F.col("n") % 4))
    kind = F.when(F.col("type") == "button", "container").when(F.col("type") == "text", "section").when(F.col("type") == "icon", "unknown").otherwise(F.col("type"))
    rows = c.join(f, ["image_id", "_slot"], "left")
    return rows.select("image_id", "parent_id", "node_id", F.col("n").alias("ord"), kind.alias("type"), F.floor(F.col("x") / 20).cast("double").alias("x"), "y", "w", "h", "p", "q")


REG = """
reg0 AS (SELECT image_id, box_id AS region_id, CASE WHEN p % 5 = 0 THEN 0 ELSE x END AS x, CASE WHEN q % 5 = 0 THEN q % 30 WHEN q % 5 = 1 THEN 760 ELSE y END AS y,
   CASE WHEN q % 3 = 0 THEN w * 3 ELSE w END AS w, CASE WHEN p % 7 = 0 THEN h * 9 ELSE h * 2 END AS h FROM boxes WHERE type IN ('card', 'row')),
reg1 AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w*h DESC, region_id) AS rk, floor(w*h / (420 * 820.0) * 10000 + 0.5) / 10000 AS rel FROM reg0),
reg AS (SELECT image_id, region_id, x, y, w, h, CAST(rel AS DOUBLE) AS rel_area, CASE WHEN y+h/2 < 123 AND w > 210 THEN 'header' WHEN y+h/2 > 697 AND w > 210 THEN 'footer'
   WHEN (x+w/2 < 105 OR x+w/2 > 315) AND h > 328 THEN 'sidebar' WHEN h < 82 AND w > 126 THEN 'nav' WHEN w > 168 AND h > 164 THEN 'table' WHEN rel > 0.02 AND rel < 0.3 THEN 'card' WHEN rel > 0.3 THEN 'main' ELSE 'content' END AS type
  FROM reg1)"""


def raw_regions(t):
    b, p, q = t.boxes.where("type IN ('card', 'row')"), F.col("p"), F.col("q")
    return b.select(
        "image_id", F.col("box_id").alias("region_id"), F.when(p % 5 == 0, 0.0).otherwise(F.col("x")).alias("x"),
        F.when(q % 5 == 0, (q % 30).cast("double")).when(q % 5 == 1, 760.0).otherwise(F.col("y")).alias("y"),
        F.when(q % 3 == 0, F.col("w") * 3).otherwise(F.col("w")).alias("w"), F.when(p % 7 == 0, F.col("h") * 9).otherwise(F.col("h") * 2).alias("h"),
    )


def regions(t):
    return T.classify_regions(raw_regions(t), t.pages_meta).select("image_id", "region_id", "x", "y", "w", "h", "rel_area", "type")


def items(t):
    return t.ocr_items.withColumnRenamed("box_id", "ord")


# --- sibling groups ----------------------------------------------------------------------
SIM = "NOT (abs({a} - {b}) / greatest({a}, {b}) > 0.15)"


@query("detect_repeats", f"""
WITH RECURSIVE {KIDN},
it AS (SELECT *, row_number() OVER (PARTITION BY image_id, parent_id ORDER BY type, w, h, y, x, node_id) AS k FROM kidn WHERE parent_id IS NOT NULL AND type IN ('card', 'row', 'section', 'listItem')),
fold AS (
  SELECT image_id, parent_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(type STRING, w0 DOUBLE, w1 DOUBLE, h0 DOUBLE, h1 DOUBLE, n BIGINT, id STRING)[]) AS gs FROM it GROUP BY image_id, parent_id
  UNION ALL
  SELECT image_id, parent_id, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(gs, {{'type': type, 'w0': w, 'w1': w, 'h0': h, 'h1': h, 'n': CAST(1 AS BIGINT), 'id': node_id}})
     ELSE list_transform(gs, lambda g, i: CASE WHEN i = hit THEN {{'type': g.type, 'w0': least(g.w0, e.w), 'w1': greatest(g.w1, e.w), 'h0': least(g.h0, e.h), 'h1': greatest(g.h1, e.h), 'n': g.n + 1, 'id': g.id}} ELSE g END) END
  FROM (SELECT f.gs, e.*, list_position(list_transform(f.gs, lambda g: g.type = e.type AND {SIM.format(a='g.w0', b='e.w')} AND {SIM.format(a='g.w1', b='e.w')} AND {SIM.format(a='g.h0', b='e.h')} AND {SIM.format(a='g.h1', b='e.h')}), true) AS hit
        FROM fold f JOIN it e ON e.image_id = f.image_id AND e.parent_id = f.parent_id AND e.k = f.k + 1) e),
g AS (SELECT f.image_id, f.parent_id, unnest(f.gs) AS g, generate_subscripts(f.gs, 1) AS ix FROM fold f JOIN (SELECT image_id, parent_id, max(k) AS k FROM it GROUP BY image_id, parent_id) m ON m.image_id = f.image_id AND m.parent_id = f.parent_id AND m.k = f.k),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, parent_id ORDER BY g.n DESC, ix) AS rk FROM g WHERE g.n >= 2)
SELECT image_id, parent_id AS target_id, g.n AS count, g.id AS template_id, g.type AS template_type FROM r WHERE rk = 1""")
def _(t):
    return Y.detect_repeats(kid_nodes(t))


@query("slots", """
SELECT image_id, node_id AS id, 'cardTemplate' AS name FROM tree_nodes WHERE type = 'card' AND n = 3""")
def _(t):
    # a repeat table with one card template per image that has one in third place
    rep = t.tree_nodes.where("type = 'card' AND n = 3").select("image_id", F.col("node_id").alias("template_id"), F.col("type").alias("template_type"))
    return Y.slots(rep)


@query("promote_lists", f"""
WITH RECURSIVE {KIDN},
par AS (SELECT image_id, node_id FROM kidn WHERE type IN ('container', 'section', 'unknown')),
it AS (SELECT k.*, row_number() OVER (PARTITION BY k.image_id, k.parent_id ORDER BY ord) AS k FROM kidn k JOIN par ON par.image_id = k.image_id AND par.node_id = k.parent_id),
fold AS (
  SELECT image_id, parent_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(type STRING, w DOUBLE, h DOUBLE)[]) AS gs, CAST('' AS STRING) AS node_id, CAST(0 AS BIGINT) AS g FROM it GROUP BY image_id, parent_id
  UNION ALL
  SELECT image_id, parent_id, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(gs, {{'type': type, 'w': w, 'h': h}}) ELSE gs END, node_id, CASE WHEN hit IS NULL OR hit = 0 THEN len(gs) + 1 ELSE hit END
  FROM (SELECT f.gs, e.*, list_position(list_transform(f.gs, lambda z: z.type = e.type AND {SIM.format(a='z.w', b='e.w')} AND {SIM.format(a='z.h', b='e.h')}), true) AS hit
        FROM fold f JOIN it e ON e.image_id = f.image_id AND e.parent_id = f.parent_id AND e.k = f.k + 1) e),
m AS (SELECT i.*, f.g FROM fold f JOIN it i ON i.image_id = f.image_id AND i.parent_id = f.parent_id AND i.k = f.k WHERE f.k > 0),
s AS (SELECT image_id, parent_id, g, count(*) AS n, max(x+w/2)-min(x+w/2) AS dx, max(y+h/2)-min(y+h/2) AS dy, avg(w) AS mw, avg(h) AS mh FROM m GROUP BY image_id, parent_id, g HAVING count(*) >= 3 AND min(type) IN ('card', 'unknown', 'image', 'section', 'row')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, parent_id ORDER BY n DESC, g) AS rk FROM s) r WHERE rk = 1 AND dx < mw * 0.5 AND (NOT dy < mh * 0.5 OR dx <= dy))
SELECT k.image_id, k.node_id, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.image_id = k.image_id AND b.parent_id = k.node_id) THEN 'list'
  WHEN EXISTS (SELECT 1 FROM m JOIN b ON b.image_id = m.image_id AND b.parent_id = m.parent_id AND b.g = m.g WHERE m.image_id = k.image_id AND m.node_id = k.node_id) THEN 'listItem' ELSE k.type END AS new_type FROM kidn k""")
def _(t):
    return Y.promote_lists(kid_nodes(t)).select("image_id", "node_id", "new_type")


CONSTRAINTS = f"""{KIDN},
ch AS (SELECT * FROM kidn WHERE parent_id IS NOT NULL),
st AS (SELECT image_id, parent_id, count(*) AS n, max(x+w/2)-min(x+w/2) AS dcx, max(y+h/2)-min(y+h/2) AS dcy, avg(w) AS mw, avg(h) AS mh, max(x)-min(x) AS dl, max(x+w)-min(x+w) AS dr, max(y)-min(y) AS dt, max(y+h)-min(y+h) AS db,
  quantile_cont(w, 0.5) * 0.3 AS tw, quantile_cont(h, 0.5) * 0.3 AS th FROM ch GROUP BY image_id, parent_id HAVING count(*) >= 2),
dd AS (SELECT *, CASE WHEN dcx < mw*0.5 AND dcy < mh*0.5 THEN CASE WHEN dcx <= dcy THEN 'column' ELSE 'row' END WHEN dcx < mw*0.5 THEN 'column' WHEN dcy < mh*0.5 THEN 'row' ELSE 'grid' END AS direction FROM st),
gp AS (SELECT c.image_id, c.parent_id, d.direction, CASE d.direction WHEN 'row' THEN c.x - lag(c.x+c.w) OVER (PARTITION BY c.image_id, c.parent_id ORDER BY c.x, c.node_id)
     WHEN 'column' THEN c.y - lag(c.y+c.h) OVER (PARTITION BY c.image_id, c.parent_id ORDER BY c.y, c.x, c.node_id)
     ELSE c.y - max(c.y+c.h) OVER (PARTITION BY c.image_id, c.parent_id ORDER BY c.y, c.x, c.node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS g FROM ch c JOIN dd d USING (image_id, parent_id)),
gm AS (SELECT image_id, parent_id, quantile_cont(g, 0.5) AS gap FROM gp WHERE g > 0 GROUP BY image_id, parent_id),
cons AS (SELECT image_id, parent_id AS target_id, n AS children, direction, floor(coalesce(gap, 0) * 10 + 0.5) / 10 AS gap,
  CASE direction WHEN 'row' THEN CASE WHEN dt <= th THEN 'top' WHEN dcy <= th THEN 'center' WHEN db <= th THEN 'bottom' ELSE 'start' END WHEN 'column' THEN CASE WHEN dl <= tw THEN 'left' WHEN dcx <= tw THEN 'center' WHEN dr <= tw THEN 'right' ELSE 'start' END ELSE 'start' END AS align
  FROM dd LEFT JOIN gm USING (image_id, parent_id))"""


@query("container_constraints", "WITH " + CONSTRAINTS + " SELECT * FROM cons")
def _(t):
    return Y.container_constraints(kid_nodes(t))


LAYOUT = """
lf AS (SELECT image_id, bool_or(type = 'sidebar') AS sb, bool_or(type = 'header') AS hd, bool_or(type = 'footer') AS ft, bool_and(abs(x+w/2-210) < 63) AS mid, count(CASE WHEN type = 'card' THEN 1 END) AS cards FROM reg GROUP BY image_id),
lc AS (SELECT image_id, count(CASE WHEN abs(y - mt) < 10 THEN 1 END) AS rowc FROM (SELECT *, min(y) OVER (PARTITION BY image_id) AS mt FROM reg WHERE type = 'card') c GROUP BY image_id),
lay AS (SELECT m.image_id, CASE WHEN cards >= 3 AND rowc >= 2 THEN 'grid' WHEN sb AND hd THEN 'sidebar' WHEN cards >= 2 THEN 'columns' WHEN hd AND ft AND NOT sb THEN 'stack' WHEN mid THEN 'centered' ELSE 'stack' END AS layout_type
  FROM pages_meta m LEFT JOIN lf USING (image_id) LEFT JOIN lc USING (image_id))"""


@query("layout_type", "WITH " + REG + "," + LAYOUT + " SELECT image_id, layout_type FROM lay")
def _(t):
    return Y.layout_type(regions(t), t.pages_meta)


@query("responsive_hints", "WITH " + REG + "," + LAYOUT + "," + CONSTRAINTS + """
SELECT image_id, 'mobile' AS breakpoint, 'sidebar-collapse' AS layout FROM reg GROUP BY image_id HAVING bool_or(type = 'sidebar')
UNION ALL SELECT image_id, 'mobile', 'stack-vertically' FROM cons GROUP BY image_id HAVING bool_or(direction = 'grid' AND children > 2)
UNION ALL SELECT image_id, 'mobile', 'horizontal-scroll' FROM reg GROUP BY image_id HAVING bool_or(type = 'table')
UNION ALL SELECT l.image_id, 'tablet', 'merge-columns' FROM lay l JOIN (SELECT image_id, count(*) AS n FROM reg GROUP BY image_id) r USING (image_id) WHERE layout_type = 'columns' AND n > 2""")
def _(t):
    n = kid_nodes(t)
    reg = regions(t)
    return Y.responsive_hints(n, reg, Y.layout_type(reg, t.pages_meta), Y.container_constraints(n), t.pages_meta)


# --- text -------------------------------------------------------------------------------
@query("text_level", f"""
SELECT o.image_id, o.box_id AS ord, CASE WHEN h > m * 2.5 THEN 'title' WHEN h > m * 1.6 THEN 'heading' WHEN h < m * 0.7 THEN 'caption' ELSE 'body' END AS level
FROM ocr_items o JOIN (SELECT image_id, {MED.format('h')} AS m FROM ocr_items GROUP BY image_id) t ON t.image_id = o.image_id""")
def _(t):
    return Y.text_level(items(t)).select("image_id", "ord", "level")


@query("node_text_level", """
SELECT n.image_id, n.node_id, CASE WHEN type <> 'text' THEN type WHEN coalesce(fs, h) >= m * 1.5 THEN 'title' WHEN coalesce(fs, h) >= m * 1.15 THEN 'subtitle' ELSE 'text' END AS new_type
FROM (SELECT *, CASE WHEN p % 3 = 0 THEN h * 0.8 END AS fs FROM nodes) n LEFT JOIN (SELECT image_id, quantile_cont(CASE WHEN p % 3 = 0 THEN h * 0.8 ELSE h END, 0.5) AS m FROM nodes WHERE type = 'text' GROUP BY image_id) t ON t.image_id = n.image_id""")
def _(t):
    n = t.nodes.withColumn("font_size", F.when(F.col("p") % 3 == 0, F.col("h") * 0.8))
    return Y.node_text_level(n).select("image_id", "node_id", "new_type")


@query("typography_scale", """
WITH m AS (SELECT image_id, quantile_cont(h, 0.5) AS m FROM ocr_items GROUP BY image_id),
l AS (SELECT o.image_id, h, CASE WHEN h > m * 1.6 THEN 'title' WHEN h > m * 1.2 THEN 'heading' WHEN h < m * 0.8 THEN 'caption' ELSE 'body' END AS level FROM ocr_items o JOIN m USING (image_id))
SELECT image_id, level, CAST(floor(quantile_cont(h, 0.5) + 0.5) AS BIGINT) AS size_px, count(*) AS count FROM l GROUP BY image_id, level""")
def _(t):
    return Y.typography_scale(items(t))


@query("top_title", """
SELECT image_id, node_id, round(d, 6) AS dist FROM (SELECT image_id, node_id, abs(x+w/2-210)/420 AS d, row_number() OVER (PARTITION BY image_id ORDER BY abs(x+w/2-210)/420, n) AS k FROM nodes
  WHERE type = 'text' AND y / 820 <= 0.15 AND abs(x+w/2-210)/420 <= 0.18) t WHERE k = 1""")
def _(t):
    n = t.nodes.withColumn("ord", F.col("n"))
    return Y.top_title(n, t.pages_meta).withColumn("dist", F.round("dist", 6))


ZONES = """
e AS (SELECT image_id, min(y) AS t, max(y+h) AS b FROM ocr_items GROUP BY image_id),
z AS (SELECT o.*, CASE WHEN b - t <= 0 THEN 'body' WHEN y+h/2 < t + (b-t)*0.15 THEN 'header' WHEN y+h/2 > b - (b-t)*0.15 THEN 'footer' ELSE 'body' END AS zone FROM ocr_items o JOIN e USING (image_id))"""


@query("zones", "WITH " + ZONES + " SELECT image_id, box_id AS ord, zone FROM z")
def _(t):
    return Y.zones(items(t)).select("image_id", "ord", "zone")


@query("document_title", "WITH " + ZONES + """
SELECT image_id, text AS title FROM (SELECT image_id, text, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN zone = 'header' THEN 0 ELSE 1 END, y, box_id) AS k FROM z) r WHERE k = 1""")
def _(t):
    return Y.document_title(Y.zones(items(t)))


@query("spacing", """
WITH v AS (SELECT image_id, y - py - ph AS g FROM (SELECT image_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(w) OVER w AS pw, lag(h) OVER w AS ph FROM boxes WHERE type = 'card' WINDOW w AS (PARTITION BY image_id ORDER BY y, box_id)) a WHERE abs(x - px) < pw * 0.5 AND y - py - ph > 0),
hz AS (SELECT image_id, x - px - pw AS g FROM (SELECT image_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(w) OVER w AS pw, lag(h) OVER w AS ph FROM boxes WHERE type = 'card' WINDOW w AS (PARTITION BY image_id ORDER BY x, box_id)) a WHERE abs(y - py) < ph * 0.5 AND x - px - pw > 0),
s AS (SELECT image_id, avg(g) AS g, count(CASE WHEN a = 'v' THEN 1 END) AS nv, count(CASE WHEN a = 'h' THEN 1 END) AS nh FROM (SELECT image_id, g, 'v' AS a FROM v UNION ALL SELECT image_id, g, 'h' FROM hz) u GROUP BY image_id)
SELECT m.image_id, floor(coalesce(g, 0) * 10 + 0.5) / 10 AS average_gap, CASE WHEN coalesce(g, 0) < 5 THEN 'compact' WHEN g < 15 THEN 'comfortable' ELSE 'spacious' END AS scale, coalesce(nv, 0) AS n_vertical, coalesce(nh, 0) AS n_horizontal
FROM (SELECT DISTINCT image_id FROM boxes WHERE type = 'card') m LEFT JOIN s USING (image_id)""")
def _(t):
    return Y.spacing(t.boxes.where("type = 'card'").withColumnRenamed("box_id", "region_id"))


POS = "CASE WHEN image_id % 3 = 0 THEN 'top right' WHEN image_id % 3 = 1 THEN '左下' ELSE NULL END"


@query("rank_regions", """
SELECT image_id, region_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY s DESC, region_id) AS INT) AS rank FROM (
  SELECT image_id, box_id AS region_id, confidence + CASE image_id % 3 WHEN 0 THEN (x+w/2)/10000 - (y+h/2)/10000 WHEN 1 THEN (y+h/2)/10000 - (x+w/2)/10000 ELSE 0 END AS s FROM ocr_items) t""")
def _(t):
    b = t.ocr_items.withColumnRenamed("box_id", "region_id")
    return Y.rank_regions(b, F.expr(POS)).select("image_id", "region_id", "rank")


@query("top_k_per_group", """
SELECT image_id, type, box_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id, type ORDER BY w*h DESC, box_id) AS k FROM boxes) t WHERE k <= 3""")
def _(t):
    b = t.boxes.withColumn("area", F.col("w") * F.col("h"))
    return Y.top_k_per_group(b, ["image_id", "type"], [F.desc("area"), "box_id"], 3).select("image_id", "type", "box_id", "rank")


@query("distinct_keep_first", "SELECT image_id, text, min(box_id) AS box_id FROM ocr_items GROUP BY image_id, text")
def _(t):
    from screenlake.functions.semantics import keep_first

    return keep_first(t.ocr_items.select("image_id", "text", "box_id"), ["image_id", "text"], ["box_id"])


@query("layout_region", f"""
WITH q AS (SELECT request_id, request_id % (SELECT max(image_id) + 1 FROM pages_meta) AS image_id, intent FROM intents),
m AS (SELECT image_id, {MED.format('x + w/2')} AS m FROM ocr_items GROUP BY image_id),
s AS (SELECT q.request_id, o.*, intent FROM ocr_items o JOIN q USING (image_id) JOIN m USING (image_id) WHERE CASE WHEN regexp_matches(intent, 'right|右') THEN x + w/2 >= m WHEN regexp_matches(intent, 'left|左') THEN x + w/2 <= m ELSE TRUE END),
p AS (SELECT *, regexp_matches(lower(intent), '价格|金额|价|price|amount') AND {hit('text', RB.PRICE_TEXT)} AS pr FROM s),
u AS (SELECT *, bool_or(pr) OVER (PARTITION BY request_id) AS anyp FROM p)
SELECT request_id, image_id, concat(CAST(CAST(floor(min(x)+0.5) AS BIGINT) AS STRING), ',', CAST(CAST(floor(min(y)+0.5) AS BIGINT) AS STRING), ',', CAST(CAST(floor(max(x+w)+0.5) AS BIGINT) AS STRING), ',', CAST(CAST(floor(max(y+h)+0.5) AS BIGINT) AS STRING)) AS box, CAST(0.55 AS DOUBLE) AS confidence
FROM u WHERE pr OR NOT anyp GROUP BY request_id, image_id""")
def _(t):
    # the requests go round all images; the other side is a single row
    q = t.intents.crossJoin(t.pages_meta.agg((F.max("image_id") + 1).alias("images")))
    q = q.select("request_id", (F.col("request_id") % F.col("images")).alias("image_id"), F.col("intent").alias("query"))
    return Y.layout_region(t.ocr_items, q)


COUNTS = "(SELECT image_id, image_id AS region_id, CAST(y AS INT) AS y, count(*) * 3 + sum(p) % 4 AS n FROM boxes GROUP BY image_id, CAST(y AS INT))"


def row_counts(t):
    y = F.col("y").cast("int").alias("y")
    return t.boxes.groupBy("image_id", y).agg((F.count(F.lit(1)) * 3 + F.sum("p") % 4).alias("n")).withColumn("region_id", F.col("image_id"))


BANDS = f"""
c AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY image_id) AS mx FROM {COUNTS} r) t WHERE n > mx * 0.3),
b AS (SELECT *, sum(brk) OVER (PARTITION BY image_id ORDER BY y) AS band FROM (SELECT *, CASE WHEN y > lag(y) OVER (PARTITION BY image_id ORDER BY y) + 1 THEN 1 ELSE 0 END AS brk FROM c) t),
bands AS (SELECT image_id, region_id, CAST(band AS BIGINT) AS band, min(y) AS start, max(y) AS "end" FROM b GROUP BY image_id, region_id, band)"""


@query("dense_bands", "WITH " + BANDS + ' SELECT image_id, region_id, band, start, "end" FROM bands')
def _(t):
    return Y.dense_bands(row_counts(t))


@query("band_split", "WITH " + BANDS + """
SELECT image_id, region_id, bands, CAST(split_y AS BIGINT) AS split_y FROM (SELECT image_id, region_id, count(*) AS bands, floor((max(CASE WHEN band = 1 THEN "end" END) + max(CASE WHEN band = 2 THEN start END)) / 2) + 1 AS split_y FROM bands GROUP BY image_id, region_id HAVING count(*) >= 4) t
WHERE split_y > 20 AND split_y < 780""")
def _(t):
    b = t.pages_meta.select("image_id", F.col("image_id").alias("region_id"), F.lit(0).alias("y1"), F.lit(800).alias("y2"))
    return Y.band_split(Y.dense_bands(row_counts(t)), b)


@query("media_score", """
WITH m AS (SELECT image_id, quantile_cont(h, 0.5) AS mh FROM ocr_items WHERE confidence >= 0.85 AND length(text) >= 2 GROUP BY image_id),
c AS (SELECT b.image_id, b.box_id AS cand_id, x, y, w, h, b.p % 4 = 0 AS anchored, b.q % 6 = 0 AS textured, greatest(w, h) AS lg, least(w, h) AS sm, w*h / (420*820.0) AS rel, h > w AND least(w, h) >= 80 AND w*h / (420*820.0) >= 0.02 AS large, greatest(w, h) <= greatest(60, 2.4 * coalesce(mh, 20)) AS compact FROM boxes b LEFT JOIN m USING (image_id)),
s AS (SELECT *, CASE WHEN anchored THEN 6 ELSE 0 END + CASE WHEN textured THEN 5 ELSE 0 END + CASE WHEN compact THEN 2 ELSE 0 END + CASE WHEN large THEN 10 ELSE 0 END + least(1, rel * 10) AS score FROM c WHERE (lg / sm < 4 OR large) AND (compact OR textured OR rel >= 0.02))
SELECT image_id, cand_id, round(score, 6) AS score, CAST(rk AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y, x, cand_id) AS rk FROM s) t""")
def _(t):
    c = t.boxes.select("image_id", F.col("box_id").alias("cand_id"), (F.col("p") % 4 == 0).alias("anchored"), (F.col("q") % 6 == 0).alias("textured"), "x", "y", "w", "h")
    return Y.media_score(c, S.text_height(t.ocr_items), t.pages_meta).select("image_id", "cand_id", r6(F.col("score"), "score"), "rank")


# --- page level -------------------------------------------------------------------------
@query("page_class", "WITH " + REG + """,
f AS (SELECT image_id, count(CASE WHEN type = 'sidebar' THEN 1 END) AS s, count(CASE WHEN type = 'table' THEN 1 END) AS tb, count(CASE WHEN type = 'card' THEN 1 END) AS c FROM reg GROUP BY image_id),
i AS (SELECT image_id, count(*) AS n FROM boxes WHERE type = 'input' AND image_id % 3 = 0 GROUP BY image_id),
o AS (SELECT image_id, count(*) AS m FROM ocr_items WHERE p % 91 = 0 GROUP BY image_id)
SELECT image_id, CASE WHEN m > 0 THEN 'mobile-ui' WHEN s > 0 AND (tb > 0 OR n > 0) THEN 'admin-ui' WHEN c >= 3 THEN 'dashboard' WHEN n > 0 THEN 'form' ELSE 'general-ui' END AS page_class
FROM pages_meta LEFT JOIN f USING (image_id) LEFT JOIN i USING (image_id) LEFT JOIN o USING (image_id)""")
def _(t):
    ocr = t.ocr_items.select("image_id", F.when(F.col("p") % 91 == 0, "9:41").otherwise("x").alias("text"))
    comps = t.boxes.select("image_id", F.expr("CASE WHEN type = 'input' AND image_id % 3 <> 0 THEN 'text' ELSE type END").alias("type"))
    return Y.page_class(regions(t), comps, ocr, t.pages_meta)


# kinds of images: some without inputs, buttons, cards or tables
PT_TYPE = """CASE WHEN n.p % 51 = 0 THEN 'title' WHEN n.p % 51 = 1 AND n.image_id % 4 = 1 THEN 'navbar' WHEN n.p % 17 = 2 AND n.image_id % 5 = 0 THEN 'section' WHEN n.p % 17 = 3 AND n.image_id % 6 = 0 THEN 'switch'
  WHEN n.type = 'input' AND n.image_id % 3 <> 0 THEN 'text' WHEN n.type = 'button' AND n.image_id % 4 >= 2 THEN 'image' WHEN n.type = 'card' AND n.image_id % 5 >= 2 THEN 'row' WHEN n.type = 'row' AND n.image_id % 7 = 0 THEN 'listItem' WHEN n.type = 'icon' AND n.image_id % 7 >= 3 THEN 'image' ELSE n.type END"""
PT_TEXT = "CASE WHEN image_id % 4 <= 1 THEN 'plain' ELSE text END"


def page_types(t):
    n = t.nodes.withColumn("type", F.expr(PT_TYPE.replace("n.", "")))
    reg = regions(t)
    return Y.page_type(n, reg, t.ocr_items.withColumn("text", F.expr(PT_TEXT)), Y.layout_type(reg, t.pages_meta))


def _sig(cond, s):
    return f"CASE WHEN {cond} THEN {lit(s)} END"


_RULES = [
    ("login", [("inputs >= 1 AND buttons >= 1", "components:input+button"), ("w_login > 0", "ocr:登录"), ("comps < 6", "components:few(<6)"), ("layout_type = 'centered'", "layout:centered")]),
    ("form", [("inputs >= 2", "components:multi-input"), ("inputs >= 1 AND texts > 0", "text:labels"), ("buttons > 0 AND w_submit > 0", "button:submit")]),
    ("table", [("tables >= 1 OR r_tables > 0", "components:table"), ("w_table > 0", "ocr:header-keyword")]),
    ("list", [("items >= 2", "components:multi-listItem"), ("items >= 1 AND texts >= 3", "ocr:multi-row")]),
    ("dashboard", [("regions >= 4", "layout:multi-region(>=4)"), ("w_metric > 0", "ocr:metric"), ("cards >= 2", "components:multi-card")]),
    ("detail", [("titles > 0", "components:title"), ("sections > 0", "components:section"), ("inter <= 2", "components:few-interactive")]),
    ("setting", [("w_setting > 0", "ocr:setting"), ("controls >= 2", "components:controls")]),
    ("navigation", [("navs >= 1", "components:navbar/tab"), ("navs >= 1 AND comps <= 4", "content:sparse")]),
]
PAGE_TYPE = "WITH " + REG + "," + LAYOUT + f""",
pn AS (SELECT n.image_id, {PT_TYPE} AS type FROM nodes n),
nc AS (SELECT image_id, count(CASE WHEN type = 'input' THEN 1 END) AS inputs, count(CASE WHEN type IN ('button','iconButton') THEN 1 END) AS buttons, count(CASE WHEN type = 'card' THEN 1 END) AS cards, count(CASE WHEN type = 'listItem' THEN 1 END) AS items,
  count(CASE WHEN type = 'table' THEN 1 END) AS tables, count(CASE WHEN type IN ('navbar','tab') THEN 1 END) AS navs, count(CASE WHEN type IN {in_list(Y.INTERACTIVE)} THEN 1 END) AS inter, count(CASE WHEN type <> 'page' THEN 1 END) AS comps,
  count(CASE WHEN type IN ('title','subtitle') THEN 1 END) AS titles, count(CASE WHEN type IN ('section','container') THEN 1 END) AS sections, count(CASE WHEN type IN {in_list(Y.CONTROLS)} THEN 1 END) AS controls FROM pn GROUP BY image_id),
rc AS (SELECT image_id, count(*) AS regions, count(CASE WHEN type = 'table' THEN 1 END) AS r_tables FROM reg GROUP BY image_id),
tx AS (SELECT DISTINCT image_id, lower({PT_TEXT}) AS t, x, y, w, h FROM ocr_items),
tc AS (SELECT image_id, count(*) AS texts, {', '.join(f"count(CASE WHEN {any_word('t', ws)} THEN 1 END) AS {n}" for n, ws in (('w_login', Y.LOGIN_WORDS), ('w_table', Y.TABLE_WORDS), ('w_metric', Y.METRIC_WORDS), ('w_setting', Y.SETTING_WORDS), ('w_submit', Y.SUBMIT_WORDS)))} FROM tx GROUP BY image_id),
j AS (SELECT nc.*, coalesce(regions, 0) AS regions, coalesce(r_tables, 0) AS r_tables, coalesce(texts, 0) AS texts, coalesce(w_login, 0) AS w_login, coalesce(w_table, 0) AS w_table, coalesce(w_metric, 0) AS w_metric, coalesce(w_setting, 0) AS w_setting, coalesce(w_submit, 0) AS w_submit, layout_type
  FROM nc LEFT JOIN rc USING (image_id) LEFT JOIN tc USING (image_id) LEFT JOIN lay USING (image_id)),
sc AS ({' UNION ALL '.join(f"SELECT image_id, {i} AS i, '{n}' AS name, {len(c)} AS total, list_filter([{', '.join(_sig(x, s) for x, s in c)}], lambda s: s IS NOT NULL) AS sig FROM j" for i, (n, c) in enumerate(_RULES))}),
bs AS (SELECT *, len(sig) / CAST(total AS DOUBLE) AS conf, row_number() OVER (PARTITION BY image_id ORDER BY len(sig) / CAST(total AS DOUBLE) DESC, len(sig) DESC, i) AS k FROM sc),
pt AS (SELECT image_id, CASE WHEN conf >= 0.5 THEN name ELSE 'unknown' END AS page_type, CASE WHEN conf >= 0.5 THEN floor(conf * 100 + 0.5) / 100 ELSE 0 END AS confidence, CASE WHEN conf >= 0.5 THEN array_to_string(sig, ',') ELSE '' END AS signals FROM bs WHERE k = 1)"""


@query("page_type", PAGE_TYPE + " SELECT image_id, page_type, CAST(confidence AS DOUBLE) AS confidence, signals FROM pt")
def _(t):
    return page_types(t)


@query("ocr_quality", """
WITH s AS (SELECT image_id * 20 + q % (1 + image_id % 20) AS image_id, count(*) AS n, count(CASE WHEN p % 3 <> 0 THEN confidence END) AS k, avg(CASE WHEN p % 3 <> 0 THEN confidence END) AS a FROM ocr_items GROUP BY ALL),
i AS (SELECT image_id * 20 + k AS image_id FROM pages_meta, range(20) AS r(k)),
m AS (SELECT image_id, CASE WHEN image_id % 7 = 0 THEN 300 ELSE 420 END AS width, CASE image_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS c FROM i),
r AS (SELECT m.*, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) = 0 THEN 0.2 WHEN k >= n / 2.0 THEN least(1, greatest(0, a + CASE WHEN n >= 20 THEN 0.05 WHEN n >= 8 THEN 0 ELSE -0.05 END)) WHEN n >= 20 THEN 0.85 WHEN n >= 8 THEN 0.7 ELSE 0.5 END, 9) AS oc FROM m LEFT JOIN s USING (image_id))
SELECT image_id, CAST(CASE WHEN width < 400 THEN 0.4 WHEN c = 'low' THEN 0.9 WHEN c = 'high' THEN 0.6 ELSE 0.7 END AS DOUBLE) AS clarity, floor(round(oc * 100, 7) + 0.5) / 100 AS ocr_confidence,
  concat_ws(',', CASE WHEN width < 400 THEN 'low-resolution' END, CASE WHEN n = 0 THEN 'no-ocr-text' END, CASE WHEN n > 0 AND oc < 0.4 THEN 'low-ocr-confidence' END) AS issues FROM r""")
def _(t):
    # each image is dealt to 1 to 20 crops, the other crops of the 20 stay empty
    i = F.col("image_id")
    items_ = t.ocr_items.select((i * 20 + F.col("q") % (1 + i % 20)).alias("image_id"), F.when(F.col("p") % 3 != 0, F.col("confidence")).alias("confidence"))
    crops = t.pages_meta.select(F.explode(F.sequence(i * 20, i * 20 + 19)).alias("image_id"))
    meta = crops.select("image_id", F.when(i % 7 == 0, 300).otherwise(420).alias("width"), F.when(i % 3 == 0, "low").when(i % 3 == 1, "medium").otherwise("high").alias("complexity"))
    return Y.ocr_quality(items_, meta)


STATS = "SELECT image_id, CASE WHEN type = 'button' THEN concat('button:', CASE p % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'danger' ELSE 'default' END) ELSE type END AS kind, count(*) AS n FROM nodes GROUP BY ALL"


def stats(t):
    return X.component_stats(t.nodes.withColumn("variant", F.when(F.col("p") % 4 == 0, "primary").when(F.col("p") % 4 == 1, "danger")))


@query("component_stats", STATS)
def _(t):
    return stats(t)


_KIND = "CASE kind " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in Y.COMPONENT_NAMES) + " END"
_KORD = "CASE kind " + " ".join(f"WHEN {lit(k)} THEN {i}" for i, (k, _) in enumerate(Y.COMPONENT_NAMES)) + " END"


@query("describe_page", PAGE_TYPE + f""",
st AS ({STATS}),
ph AS (SELECT image_id, string_agg(concat(CAST(n AS STRING), ' 个', {_KIND}), '、' ORDER BY {_KORD}) AS body FROM st WHERE {_KORD} IS NOT NULL GROUP BY image_id),
rn AS (SELECT image_id, count(*) AS n FROM reg GROUP BY image_id)
SELECT pt.image_id, concat(CASE page_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in Y.PAGE_NAMES)} END, '页', CASE WHEN body IS NOT NULL THEN concat('，含 ', body) ELSE '' END, '；',
  CASE layout_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in Y.LAYOUT_NAMES)} ELSE layout_type END, '布局', CASE WHEN n > 0 THEN concat('，含 ', CAST(n AS STRING), ' 个区域') ELSE '' END, '。') AS summary
FROM pt LEFT JOIN ph USING (image_id) LEFT JOIN lay USING (image_id) LEFT JOIN rn USING (image_id)""")
def _(t):
    reg = regions(t)
    return Y.describe_page(stats(t), page_types(t), Y.layout_type(reg, t.pages_meta), reg)


@query("distribution", "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def _(t):
    return X.distribution(t.nodes, "type")


@query("stability", """
SELECT image_id, n1, coalesce(n2, 0) AS n2, n1 = coalesce(n2, 0) AS stable FROM (SELECT image_id, count(*) AS n1 FROM boxes GROUP BY image_id) a LEFT JOIN (SELECT image_id, count(*) AS n2 FROM boxes WHERE image_id % 7 <> 0 OR p % 2 = 0 GROUP BY image_id) b USING (image_id)""")
def _(t):
    return X.stability(t.boxes, t.boxes.where("image_id % 7 <> 0 OR p % 2 = 0"))


@query("latency_profile", """
SELECT provider, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms, list_sort(list(duration_ms))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS median_ms, list_sort(list(duration_ms))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS p90_ms,
  round(count(*) * 1000.0 / sum(duration_ms), 6) AS per_second, max(duration_ms) AS max_ms FROM requests GROUP BY provider""")
def _(t):
    p = X.latency_profile(t.requests, ["provider"])
    return p.select("provider", "n", r6(F.col("mean_ms"), "mean_ms"), "median_ms", "p90_ms", r6(F.col("per_second"), "per_second"), "max_ms")


@query("critical_coverage", f"""
WITH ev AS (SELECT DISTINCT a.image_id, a.node_id FROM nodes a JOIN preds b ON a.image_id = b.image_id WHERE {IOU} >= 0.3)
SELECT n.image_id, round(coalesce(avg(CASE WHEN n.type IN {in_list(X.CRITICAL_TYPES)} THEN CASE WHEN ev.node_id IS NOT NULL THEN 1.0 ELSE 0 END END), 1), 6) AS critical_coverage
FROM nodes n LEFT JOIN ev ON ev.image_id = n.image_id AND ev.node_id = n.node_id GROUP BY n.image_id""")
def _(t):
    n = t.nodes.select("image_id", "node_id", "type", "x", "y", "w", "h")
    p = t.preds.select("image_id", F.col("box_id").alias("cand_id"), "type", "x", "y", "w", "h")
    return X.critical_coverage(n, S.project_evidence(n, p)).select("image_id", r6(F.col("critical_coverage"), "critical_coverage"))


@query("quality_report", f"""
WITH nn AS (SELECT *, CASE WHEN p % 10 = 0 THEN 'asset' WHEN p % 10 = 1 THEN 'hybrid' WHEN p % 10 = 2 THEN 'semantic-only' ELSE 'native' END AS mode FROM nodes),
ev AS (SELECT DISTINCT a.image_id, a.node_id FROM nodes a JOIN preds b ON a.image_id = b.image_id WHERE {IOU} >= 0.3),
cc AS (SELECT n.image_id, coalesce(avg(CASE WHEN n.type IN {in_list(X.CRITICAL_TYPES)} THEN CASE WHEN ev.node_id IS NOT NULL THEN 1.0 ELSE 0 END END), 1) AS cc FROM nodes n LEFT JOIN ev ON ev.image_id = n.image_id AND ev.node_id = n.node_id GROUP BY n.image_id),
bx AS (SELECT * FROM nn WHERE type <> 'page'),
xs AS (SELECT image_id, x AS e FROM bx UNION SELECT image_id, x + w FROM bx),
strips AS (SELECT * FROM (SELECT image_id, e AS x0, lead(e) OVER (PARTITION BY image_id ORDER BY e) AS x1 FROM xs) t WHERE x1 IS NOT NULL),
hits AS (SELECT s.image_id, x0, x1, b.y AS y0, b.y + b.h AS y1 FROM strips s JOIN bx b ON b.image_id = s.image_id AND b.x <= s.x0 AND b.x + b.w >= s.x1),
run AS (SELECT *, max(y1) OVER (PARTITION BY image_id, x0 ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
area AS (SELECT image_id, sum((x1 - x0) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) AS u FROM run GROUP BY image_id)
SELECT image_id, round(avg(CASE WHEN mode IN ('native', 'hybrid') THEN 1.0 ELSE 0 END), 6) AS editable_ratio, round(avg(CASE WHEN mode = 'asset' THEN 1.0 ELSE 0 END), 6) AS flattened_ratio,
  round(max(cc), 6) AS critical_coverage, round(greatest(0, 1 - coalesce(max(u), 0) / (420 * 820)), 6) AS unexplained, '' AS warnings
FROM nn LEFT JOIN cc USING (image_id) LEFT JOIN area USING (image_id) GROUP BY image_id""")
def _(t):
    p = F.col("p") % 10
    n = t.nodes.withColumn("render_mode", F.when(p == 0, "asset").when(p == 1, "hybrid").when(p == 2, "semantic-only").otherwise("native"))
    c = t.preds.select("image_id", F.col("box_id").alias("cand_id"), "type", "x", "y", "w", "h")
    links = S.project_evidence(n.select("image_id", "node_id", "type", "x", "y", "w", "h"), c)
    q = X.quality_report(n, links, t.pages_meta)
    return q.select("image_id", *(r6(F.col(c), c) for c in ("editable_ratio", "flattened_ratio", "critical_coverage", "unexplained")), "warnings")


# --- colours ----------------------------------------------------------------------------
@query("dominant_color", """
WITH s AS (SELECT image_id, r - r % 64 + r % 3 AS r, g - g % 64 + g % 5 AS g, b - b % 64 AS b FROM samples),
k AS (SELECT image_id, r // 16 AS br, g // 16 AS bg, b // 16 AS bb, count(*) AS n, CAST(floor(avg(r) + 0.5) AS INT) AS r, CAST(floor(avg(g) + 0.5) AS INT) AS g, CAST(floor(avg(b) + 0.5) AS INT) AS b FROM s GROUP BY image_id, r // 16, g // 16, b // 16),
t AS (SELECT *, sum(n) OVER (PARTITION BY image_id) AS tot, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, br, bg, bb) AS kf FROM k),
d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN n < greatest(2, floor(tot * 0.02)) THEN 1 ELSE 0 END, 0.299 * r + 0.587 * g + 0.114 * b, br, bg, bb) AS kd FROM t)
SELECT image_id, max(CASE WHEN kf = 1 THEN printf('#%02x%02x%02x', r, g, b) END) AS dominant, max(CASE WHEN kd = 1 THEN printf('#%02x%02x%02x', r, g, b) END) AS darkest, CAST(max(tot) AS BIGINT) AS samples FROM d GROUP BY image_id""")
def _(t):
    s = t.samples.select("image_id", (F.col("r") - F.col("r") % 64 + F.col("r") % 3).alias("r"), (F.col("g") - F.col("g") % 64 + F.col("g") % 5).alias("g"), (F.col("b") - F.col("b") % 64).alias("b"))
    return Y.dominant_color(s, ["image_id"])


COLORS = "(SELECT image_id, r - r % 64 AS r, g - g % 64 AS g, b - b % 64 AS b, count(*) AS n FROM samples GROUP BY ALL)"


def colors(t):
    q = lambda c: (F.col(c) - F.col(c) % 64).alias(c)
    return t.samples.select("image_id", q("r"), q("g"), q("b")).groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


PALETTE = f"""
c0 AS (SELECT *, greatest(r, g, b) / 255.0 AS hi, least(r, g, b) / 255.0 AS lo, sum(n) OVER (PARTITION BY image_id) AS tot, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS k FROM {COLORS} x),
c1 AS (SELECT *, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s, n / CAST(tot AS DOUBLE) AS sh FROM c0),
pal AS (SELECT *, CASE WHEN k = 1 THEN 'background' WHEN s < 0.08 THEN CASE WHEN l < 0.25 THEN 'text' WHEN l > 0.85 THEN 'surface' WHEN sh < 0.03 THEN 'border' ELSE 'muted' END WHEN s > 0.5 AND sh < 0.05 THEN 'accent' WHEN s > 0.25 THEN 'primary' ELSE 'muted' END AS role FROM c1)"""


@query("palette_roles", "WITH " + PALETTE + " SELECT image_id, r, g, b, n, role, floor(sh * 10000 + 0.5) / 10000 AS frequency FROM pal")
def _(t):
    return Y.palette_roles(colors(t)).select("image_id", "r", "g", "b", "n", "role", "frequency")


_LUM = "0.2126 * {c0} + 0.7152 * {c1} + 0.0722 * {c2}"
_CH = "CASE WHEN {v} / 255.0 <= 0.03928 THEN {v} / 255.0 / 12.92 ELSE pow(({v} / 255.0 + 0.055) / 1.055, 2.4) END"
LUM = _LUM.format(c0=_CH.format(v="r"), c1=_CH.format(v="g"), c2=_CH.format(v="b"))


@query("theme", "WITH " + PALETTE + f""",
pb AS (SELECT image_id, printf('#%02x%02x%02x', r, g, b) AS hex, {LUM} AS lum FROM pal WHERE k = 1),
pt AS (SELECT * FROM (SELECT image_id, printf('#%02x%02x%02x', r, g, b) AS hex, {LUM} AS lum, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN role = 'text' THEN 0 WHEN l < 0.25 THEN 1 ELSE 2 END, CASE WHEN role = 'text' OR l < 0.25 THEN k ELSE -k END) AS kk FROM pal) a WHERE kk = 1),
pp AS (SELECT * FROM (SELECT image_id, printf('#%02x%02x%02x', r, g, b) AS hex, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN role = 'primary' THEN 0 WHEN s > 0.25 THEN 1 ELSE 2 END, k) AS kk FROM pal) a WHERE kk = 1)
SELECT pb.image_id, pb.hex AS background, pp.hex AS "primary", pt.hex AS text_color, pb.lum < 0.2 AS is_dark_mode, round((greatest(pb.lum, pt.lum) + 0.05) / (least(pb.lum, pt.lum) + 0.05), 6) AS contrast_ratio
FROM pb JOIN pt USING (image_id) JOIN pp USING (image_id)""")
def _(t):
    return Y.theme(Y.palette_roles(colors(t))).withColumn("contrast_ratio", F.round("contrast_ratio", 6))


# --- typing -----------------------------------------------------------------------------
@query("classify_regions", "WITH " + REG + " SELECT image_id, region_id, type, rel_area FROM reg")
def _(t):
    return regions(t).select("image_id", "region_id", "type", "rel_area")


COMP_TEXT = "CASE p % 14 WHEN 0 THEN '全部' WHEN 1 THEN 'on' WHEN 2 THEN '[7]' WHEN 3 THEN '请选择' WHEN 5 THEN '✓' WHEN 6 THEN '删除' WHEN 7 THEN '请输入名称' WHEN 8 THEN 'submit' WHEN 9 THEN '取消' ELSE text END"


@query("infer_components", f"""
WITH c AS (SELECT image_id, box_id, {COMP_TEXT} AS text, x, y, w, h FROM ocr_items WHERE w*h >= 200 AND w*h <= 420*820*0.15),
k AS (SELECT *, CASE WHEN {hit('text', T.BUTTON_WORDS)} THEN 'button' WHEN length(text) <= 6 AND {hit('text', T.TAB_WORDS)} THEN 'tab' WHEN {hit('text', T.CHECK_WORDS)} THEN CASE WHEN {hit('text', T.TOGGLE_WORDS)} THEN 'toggle' ELSE 'checkbox' END
  WHEN {hit('text', T.BADGE_MARKS)} THEN 'badge' WHEN w > 12 AND h > 12 AND w < 50 AND h < 50 AND w/h > 0.8 AND w/h < 1.2 THEN 'avatar' WHEN {hit('text', T.INPUT_WORDS)} THEN 'input' WHEN {hit('text', T.DROPDOWN_WORDS)} THEN 'dropdown' ELSE 'unknown' END AS type FROM c),
u AS (SELECT *, row_number() OVER (PARTITION BY image_id, type, floor(x+0.5), floor(y+0.5) ORDER BY box_id) AS d FROM k WHERE type <> 'unknown'),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS rk FROM u WHERE d = 1)
SELECT image_id, box_id AS ord, type, CASE WHEN {hit('text', T.DANGER_WORDS)} THEN 'danger' WHEN {hit('text', T.SUCCESS_WORDS)} THEN 'success' WHEN type = 'button' AND {hit('text', T.PRIMARY_WORDS)} THEN 'primary' WHEN type = 'button' AND {hit('text', T.GHOST_WORDS)} THEN 'ghost' ELSE 'default' END AS variant,
  CASE WHEN text = '全部' THEN 'active' ELSE 'default' END AS state FROM r""")
def _(t):
    o = t.ocr_items.select("image_id", F.col("box_id").alias("ord"), F.expr(COMP_TEXT).alias("text"), "x", "y", "w", "h")
    return T.infer_components(o, t.pages_meta).select("image_id", "ord", "type", "variant", "state")


@query("map_types", f"""
SELECT image_id, box_id, CASE type WHEN 'button' THEN 'button' WHEN 'icon' THEN 'icon' WHEN 'card' THEN 'card' WHEN 'input' THEN 'input' ELSE 'unknown' END AS node_type FROM boxes""")
def _(t):
    return t.boxes.select("image_id", "box_id", T.map_types(F.col("type"), T.COMPONENT_TYPES).alias("node_type"))


LEAF_TYPE = "CASE p % 4 WHEN 0 THEN 'container' WHEN 1 THEN 'unknown' ELSE type END"
LEAF_TEXT = "CASE q % 3 WHEN 0 THEN NULL WHEN 1 THEN 'VIP' ELSE '未读消息 12' END"
LEAFN = f"ln AS (SELECT n.image_id, n.node_id, n.parent_id, n.n AS ord, CASE WHEN n.type = 'page' THEN 'page' ELSE {LEAF_TYPE.replace('type', 'n.type').replace('p %', 'n.p %')} END AS type, {LEAF_TEXT.replace('q %', 'n.q %')} AS text, x, y, CASE WHEN n.p % 5 = 0 THEN w * 4 ELSE w END AS w, CASE WHEN n.p % 5 = 0 THEN 6 WHEN n.p % 7 = 0 THEN h * 3 ELSE h END AS h, NOT EXISTS (SELECT 1 FROM nodes c WHERE c.image_id = n.image_id AND c.parent_id = n.node_id) AS leaf, n.p, n.q FROM nodes n)"


def leaf_nodes(t):
    n = t.nodes.select(
        "image_id", "node_id", "parent_id", F.col("n").alias("ord"), F.when(F.col("type") == "page", "page").otherwise(F.expr(LEAF_TYPE)).alias("type"), F.expr(LEAF_TEXT).alias("text"), "x", "y",
        F.when(F.col("p") % 5 == 0, F.col("w") * 4).otherwise(F.col("w")).alias("w"), F.when(F.col("p") % 5 == 0, 6.0).when(F.col("p") % 7 == 0, F.col("h") * 3).otherwise(F.col("h")).alias("h"), "p", "q",
    )
    return n


@query("promote_leaf", "WITH " + LEAFN + """
SELECT image_id, node_id, CASE WHEN NOT leaf THEN type WHEN type IN ('unknown','container') AND text IS NULL AND (w/h > 20 OR h/w > 20) AND least(w,h) <= 16 THEN 'divider' WHEN type IN ('unknown','container') AND text IS NULL AND w/h > 10 AND h < 30 THEN 'progress'
  WHEN type = 'input' AND h > 80 THEN 'textarea' WHEN type = 'button' AND length(coalesce(text, '')) <= 2 AND w < 48 AND w/h > 0.7 AND w/h < 1.4 THEN 'iconButton' WHEN type IN ('unknown','container') AND length(text) <= 6 AND w < 120 AND h < 32 THEN 'tag' ELSE type END AS new_type FROM ln""")
def _(t):
    return T.promote_leaf(leaf_nodes(t)).select("image_id", "node_id", "new_type")


@query("promote_container", f"""
WITH kn AS (SELECT c.image_id, f.node_id AS parent_id, c.node_id, CASE WHEN c.p % 3 = 0 OR c.image_id % 4 = 0 THEN 'button' ELSE CASE c.type WHEN 'card' THEN 'container' WHEN 'row' THEN 'section' WHEN 'text' THEN 'unknown' ELSE c.type END END AS type, c.x, CASE WHEN c.image_id % 2 = 0 THEN 10 ELSE c.y END AS y, CASE WHEN c.n <= 5 THEN 400 ELSE c.w END AS w, CASE WHEN c.n <= 5 THEN 90 ELSE c.h END AS h
  FROM tree_nodes c LEFT JOIN tree_nodes f ON c.image_id = f.image_id AND c.n > 5 AND f.n = 2 + c.n % 4),
s AS (SELECT image_id, parent_id, count(*) AS n, count(CASE WHEN type IN ('button','iconButton','icon') THEN 1 END) AS a, max(CASE WHEN type IN ('button','iconButton','icon') THEN y+h/2 END) - min(CASE WHEN type IN ('button','iconButton','icon') THEN y+h/2 END) AS ay,
  bool_and(type IN {in_list(T.INTERACTIVE)}) AS alli, max(x+w/2)-min(x+w/2) AS dx, max(y+h/2)-min(y+h/2) AS dy, avg(w) AS mw, avg(h) AS mh FROM kn WHERE parent_id IS NOT NULL GROUP BY image_id, parent_id)
SELECT k.image_id, k.node_id, CASE WHEN type IN ('container','section','unknown') AND a >= 2 AND a / CAST(n AS DOUBLE) >= 2.0/3 AND w >= h AND ay <= h * 0.5 THEN 'toolbar'
  WHEN type IN ('container','unknown') AND n >= 2 AND NOT alli THEN CASE WHEN dx < mw*0.5 AND dy < mh*0.5 THEN CASE WHEN dx <= dy THEN 'column' ELSE 'row' END WHEN dx < mw*0.5 THEN 'column' WHEN dy < mh*0.5 THEN 'row' ELSE 'grid' END ELSE type END AS new_type
FROM kn k LEFT JOIN s ON s.image_id = k.image_id AND s.parent_id = k.node_id""")
def _(t):
    c = t.tree_nodes.withColumn("_slot", F.when(F.col("n") > 5, F.col("n") % 4))
    f = t.tree_nodes.select("image_id", F.col("node_id").alias("parent_id"), (F.col("n") - 2).alias("_slot")).where("_slot BETWEEN 0 AND 3")
    kind = F.when((F.col("p") % 3 == 0) | (F.col("image_id") % 4 == 0), "button").when(F.col("type") == "card", "container").when(F.col("type") == "row", "section").when(F.col("type") == "text", "unknown").otherwise(F.col("type"))
    top = F.col("n") <= 5
    n = c.join(f, ["image_id", "_slot"], "left").select(
        "image_id", "parent_id", "node_id", kind.alias("type"), "x", F.when(F.col("image_id") % 2 == 0, 10.0).otherwise(F.col("y")).alias("y"),
        F.when(top, 400.0).otherwise(F.col("w")).alias("w"), F.when(top, 90.0).otherwise(F.col("h")).alias("h"),
    )
    return T.promote_container(n).select("image_id", "node_id", "new_type")


BADGE_TEXT = "CASE p % 6 WHEN 0 THEN '12+' WHEN 1 THEN 'NEW' WHEN 2 THEN '未读' WHEN 3 THEN '3' ELSE 'hello' END"


@query("promote_badge", f"""
SELECT image_id, node_id, CASE WHEN type = 'tag' AND (regexp_matches(text, '^[0-9]') OR (w < 32 AND h < 24)) THEN 'badge' WHEN type = 'text' AND length(text) <= 8 AND w <= 80 AND h <= 28 AND ({hit('text', T.BADGE_NUMBER)} OR {hit('text', T.BADGE_WORDS)}) THEN 'badge' ELSE type END AS new_type
FROM (SELECT image_id, node_id, CASE WHEN type = 'icon' THEN 'tag' ELSE type END AS type, {BADGE_TEXT} AS text, w, h FROM nodes) t""")
def _(t):
    n = t.nodes.select("image_id", "node_id", F.when(F.col("type") == "icon", "tag").otherwise(F.col("type")).alias("type"), F.expr(BADGE_TEXT).alias("text"), "w", "h")
    return T.promote_badge(n).select("image_id", "node_id", "new_type")


@query("split_badge", """
WITH l AS (SELECT n.image_id, n.node_id, n.parent_id, n.type, o.text, n.x, n.w, NOT EXISTS (SELECT 1 FROM nodes c WHERE c.image_id = n.image_id AND c.parent_id = n.node_id) AS leaf FROM nodes n JOIN ocr_items o ON o.image_id = n.image_id AND o.box_id = n.node_id),
m AS (SELECT *, regexp_extract(text, '^(.+?)\\s*(\\d+)$', 1) AS a, regexp_extract(text, '^(.+?)\\s*(\\d+)$', 2) AS d FROM l),
s AS (SELECT *, leaf AND type = 'text' AND a <> '' AND length(d) <= 4 AND (regexp_matches(a, '[一-鿿]') OR length(regexp_replace(a, '[^a-zA-Z]', '', 'g')) >= 2) AS ok, w * (length(d) / CAST(length(a) + length(d) AS DOUBLE)) AS bw FROM m)
SELECT image_id, node_id, parent_id, type, CASE WHEN ok THEN a ELSE text END AS text, round(x, 6) AS x, round(CASE WHEN ok THEN w - bw ELSE w END, 6) AS w FROM s
UNION ALL SELECT image_id, concat(node_id, '__badge'), node_id, 'badge', d, round(x + w - bw, 6), round(bw, 6) FROM s WHERE ok""".replace("\\\\", "\\"))
def _(t):
    o = t.ocr_items.select("image_id", F.col("box_id").alias("node_id"), "text")
    n = t.nodes.select("image_id", "node_id", "parent_id", "type", "x", "y", "w", "h").join(o, ["image_id", "node_id"])
    return T.split_badge(n).select("image_id", "node_id", "parent_id", "type", "text", r6(F.col("x"), "x"), r6(F.col("w"), "w"))


NB_TEXT = "CASE p % 45 WHEN 0 THEN '请选择城市' WHEN 1 THEN 'radio A' WHEN 2 THEN '勾选协议' ELSE 'plain' END"


def with_parent(t):
    """Tree nodes with their parent's id as in ``kids``, met by place as ids may repeat."""
    parents = t.tree_nodes.select("image_id", F.col("n").alias("_at"), F.col("node_id").alias("parent_id"))
    placed = t.tree_nodes.withColumn("_at", F.when(F.col("n") > 5, 2 + F.col("n") % 4))
    return placed.join(parents, ["image_id", "_at"], "left").drop("_at")


@query("promote_by_neighbour", f"""
WITH n AS (SELECT c.image_id, f.node_id AS parent_id, c.node_id, c.type, c.x, c.y, c.w, c.h, NOT EXISTS (SELECT 1 FROM kids k WHERE k.image_id = c.image_id AND k.parent_id = c.node_id) AS leaf FROM tree_nodes c LEFT JOIN tree_nodes f ON c.image_id = f.image_id AND c.n > 5 AND f.n = 2 + c.n % 4),
ic AS (SELECT DISTINCT a.image_id, a.node_id FROM n a JOIN n b ON b.image_id = a.image_id AND b.parent_id = a.parent_id AND b.type = 'icon' AND b.w <= 48 AND b.h <= 48 WHERE a.type = 'input' AND b.x >= a.x + a.w AND a.y < b.y + b.h AND a.y + a.h > b.y),
o AS (SELECT image_id, {NB_TEXT} AS text, x, y, w, h FROM ocr_items),
fl AS (SELECT a.image_id, a.node_id, bool_or({any_word('o.text', T.SELECT_WORDS)}) AS s, bool_or({any_word('o.text', T.RADIO_WORDS)}) AS r, bool_or({any_word('o.text', T.CHECKBOX_WORDS)}) AS c
  FROM n a JOIN o ON o.image_id = a.image_id WHERE a.type = 'input' AND a.x - 20 < o.x + o.w AND a.x + a.w + 20 > o.x AND a.y - 20 < o.y + o.h AND a.y + a.h + 20 > o.y GROUP BY a.image_id, a.node_id)
SELECT n.image_id, n.node_id, CASE WHEN n.type <> 'input' THEN n.type WHEN ic.node_id IS NOT NULL OR coalesce(s, FALSE) THEN 'select' WHEN leaf AND n.w < 32 AND n.h < 32 AND r THEN 'radio' WHEN leaf AND n.w < 32 AND n.h < 32 AND c THEN 'checkbox' ELSE 'input' END AS new_type
FROM n LEFT JOIN ic ON ic.image_id = n.image_id AND ic.node_id = n.node_id LEFT JOIN fl ON fl.image_id = n.image_id AND fl.node_id = n.node_id""")
def _(t):
    n = with_parent(t).select("image_id", "parent_id", "node_id", "type", "x", "y", "w", "h")
    o = t.ocr_items.select("image_id", F.expr(NB_TEXT).alias("text"), "x", "y", "w", "h")
    return T.promote_by_neighbour(n, o).select("image_id", "node_id", "new_type")


CT_COLOR = "CASE q % 4 WHEN 0 THEN '#f00' WHEN 1 THEN '#808080' WHEN 2 THEN '2266cc' ELSE NULL END"
CT_TEXT = "CASE p % 5 WHEN 0 THEN ' Save' WHEN 1 THEN 'Hello  World' ELSE NULL END"


@query("correct_types", f"""
WITH n AS (SELECT c.image_id, f.node_id AS parent_id, c.node_id, CASE WHEN c.n BETWEEN 2 AND 5 THEN 'table' WHEN c.type = 'icon' THEN 'container' WHEN c.type = 'row' THEN 'footer' ELSE c.type END AS type, {CT_TEXT.replace('p %', 'c.p %')} AS text, {CT_COLOR.replace('q %', 'c.q %')} AS bg, c.x, c.y, CASE WHEN c.p % 3 = 0 THEN c.w * 3 ELSE c.w END AS w, c.h,
   c.n > 5 OR NOT EXISTS (SELECT 1 FROM kids k WHERE k.image_id = c.image_id AND k.parent_id = c.node_id) AS leaf FROM tree_nodes c LEFT JOIN tree_nodes f ON c.image_id = f.image_id AND c.n > 5 AND f.n = 2 + c.n % 4),
ls AS (SELECT p.image_id, p.node_id FROM n p JOIN n c ON c.image_id = p.image_id AND c.parent_id = p.node_id AND c.type = 'card' WHERE p.type = 'table' GROUP BY p.image_id, p.node_id HAVING count(*) >= 2),
o AS (SELECT image_id, CASE p % 2 WHEN 0 THEN 'save' ELSE 'hello world' END AS text, x, y, w, h FROM ocr_items),
tt AS (SELECT DISTINCT a.image_id, a.node_id FROM n a JOIN o b ON b.image_id = a.image_id AND b.text = lower(regexp_replace(trim(a.text), '\\s+', ' ', 'g')) WHERE a.leaf AND a.type IN {in_list(T.TEXT_REGIONS)} AND {IOU} >= 0.5)
SELECT n.image_id, n.node_id, CASE WHEN ls.node_id IS NOT NULL THEN 'list' WHEN leaf AND n.type IN {in_list(T.BUTTON_REGIONS)} AND (bg = '#f00' OR bg = '2266cc') AND ((n.w < 200 AND n.h < 60 AND n.type IN ('container', 'unknown')) OR (NOT (n.w < 200 AND n.h < 60) AND n.w <= 399 AND n.h <= 73.8 AND text = ' Save')) THEN 'button'
   WHEN tt.node_id IS NOT NULL THEN 'text' WHEN n.type = 'card' AND EXISTS (SELECT 1 FROM ls WHERE ls.image_id = n.image_id AND ls.node_id = n.parent_id) THEN 'listItem' ELSE n.type END AS new_type
FROM n LEFT JOIN ls ON ls.image_id = n.image_id AND ls.node_id = n.node_id LEFT JOIN tt ON tt.image_id = n.image_id AND tt.node_id = n.node_id""".replace("\\\\", "\\"))
def _(t):
    n = with_parent(t)
    kind = F.when(F.col("n").between(2, 5), "table").when(F.col("type") == "icon", "container").when(F.col("type") == "row", "footer").otherwise(F.col("type"))
    n = n.select(
        "image_id", "parent_id", "node_id", kind.alias("type"), F.expr(CT_TEXT).alias("text"), F.expr(CT_COLOR).alias("bg_color"), "x", "y",
        F.when(F.col("p") % 3 == 0, F.col("w") * 3).otherwise(F.col("w")).alias("w"), "h",
    )
    o = t.ocr_items.select("image_id", F.when(F.col("p") % 2 == 0, "save").otherwise("hello world").alias("text"), "x", "y", "w", "h")
    return T.correct_types(n, o, t.pages_meta).select("image_id", "node_id", "new_type")


@query("prune_outside", """
WITH RECURSIVE n AS (SELECT image_id, node_id, parent_id, CASE WHEN p % 11 = 0 THEN x + 500 ELSE x END AS x, y, w, h FROM nodes),
g AS (SELECT image_id, node_id FROM n WHERE parent_id IS NOT NULL AND x >= 420 UNION ALL SELECT n.image_id, n.node_id FROM g JOIN n ON n.image_id = g.image_id AND n.parent_id = g.node_id)
SELECT image_id, node_id FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.image_id = n.image_id AND g.node_id = n.node_id)""")
def _(t):
    n = t.nodes.select("image_id", "node_id", "parent_id", F.when(F.col("p") % 11 == 0, F.col("x") + 500).otherwise(F.col("x")).alias("x"), "y", "w", "h")
    return T.prune_outside(n, t.pages_meta).select("image_id", "node_id")


V_COLOR = "CASE q % 6 WHEN 0 THEN '#2266cc' WHEN 1 THEN 'c33' WHEN 2 THEN '#30b040' WHEN 3 THEN 'none' WHEN 4 THEN '#999999' ELSE NULL END"
V_TEXT = "CASE p % 5 WHEN 0 THEN '已禁用' WHEN 1 THEN 'Selected item' ELSE 'ok' END"


@query("infer_variants", f"""
WITH n AS (SELECT image_id, node_id, type, {V_COLOR} AS color, CASE WHEN p % 7 = 0 THEN 'ghost' WHEN p % 7 = 1 THEN 'odd' END AS vh, CASE WHEN q % 9 = 0 THEN 'active' END AS sh, q % 8 = 0 AS dis, {V_TEXT} AS text FROM nodes)
SELECT image_id, node_id, CASE WHEN type <> 'button' THEN 'default' WHEN color IS NULL OR color = 'none' THEN CASE WHEN vh = 'ghost' THEN 'ghost' ELSE 'default' END WHEN color = '#2266cc' THEN 'primary' WHEN color = 'c33' THEN 'danger' WHEN color = '#30b040' THEN 'success' WHEN vh = 'ghost' THEN 'ghost' ELSE 'default' END AS variant,
  CASE WHEN type <> 'button' THEN 'default' WHEN sh IS NOT NULL THEN sh WHEN dis THEN 'disabled' WHEN text = '已禁用' THEN 'disabled' WHEN text = 'Selected item' THEN 'selected' ELSE 'default' END AS state,
  concat(CASE WHEN type <> 'button' THEN 'non-button type' WHEN color IS NULL OR color = 'none' THEN CASE WHEN vh = 'ghost' THEN 'props:variant=ghost' ELSE 'no color signal' END WHEN color = '#2266cc' THEN concat('color~primary(', CAST(CAST(floor(sqrt(3*3 + 6*6 + 12*12) + 0.5) AS INT) AS STRING), ')') WHEN color = 'c33' THEN 'color:red-ish' WHEN color = '#30b040' THEN 'color:green-ish' WHEN vh = 'ghost' THEN 'props:variant=ghost' ELSE 'color:other' END, '; ',
    CASE WHEN type <> 'button' THEN 'non-stateful type' WHEN sh IS NOT NULL THEN concat('props:state=', sh) WHEN dis THEN 'interactive:disabled' WHEN text = '已禁用' THEN 'text:disabled' WHEN text = 'Selected item' THEN 'text:selected' ELSE 'no state signal' END) AS reason FROM n""")
def _(t):
    n = t.nodes.select(
        "image_id", "node_id", "type", F.expr(V_COLOR).alias("color"), F.when(F.col("p") % 7 == 0, "ghost").when(F.col("p") % 7 == 1, "odd").alias("variant_hint"),
        F.when(F.col("q") % 9 == 0, "active").alias("state_hint"), (F.col("q") % 8 == 0).alias("disabled"), F.expr(V_TEXT).alias("text"),
    )
    th = t.pages_meta.select("image_id", F.lit("#1f60d8").alias("primary"))
    return T.infer_variants(n, th).select("image_id", "node_id", "variant", "state", "reason")


@query("infer_interactivity", """
WITH n AS (SELECT image_id, node_id, CASE WHEN type = 'row' THEN 'title' ELSE type END AS type, CASE q % 3 WHEN 0 THEN 'aaaaaa' WHEN 1 THEN '#2030ff' ELSE 'none' END AS tc, CASE p % 3 WHEN 0 THEN '#909090' WHEN 1 THEN '#f00' ELSE NULL END AS bc, CASE WHEN p % 4 = 0 THEN ' ' ELSE 'x' END AS text FROM nodes)
SELECT image_id, node_id, type = 'input' AND text = 'x' AND tc = 'aaaaaa' AS placeholder, coalesce(type = 'button' AND bc = '#909090', FALSE) AS disabled, type IN ('text', 'title') AND text = 'x' AND tc = '#2030ff' AS link FROM n""")
def _(t):
    n = t.nodes.select(
        "image_id", "node_id", F.when(F.col("type") == "row", "title").otherwise(F.col("type")).alias("type"), F.when(F.col("q") % 3 == 0, "aaaaaa").when(F.col("q") % 3 == 1, "#2030ff").otherwise("none").alias("text_color"),
        F.when(F.col("p") % 3 == 0, "#909090").when(F.col("p") % 3 == 1, "#f00").alias("bg_color"), F.when(F.col("p") % 4 == 0, " ").otherwise("x").alias("text"),
    )
    return T.infer_interactivity(n).select("image_id", "node_id", "placeholder", "disabled", "link")


OV = "CASE WHEN p % 6 = 0 THEN 0 ELSE x END AS x, CASE WHEN q % 6 = 0 THEN 700 ELSE y END AS y, CASE WHEN q % 6 = 0 THEN 300 ELSE w END AS w, CASE WHEN p % 6 = 0 THEN 600 ELSE h * 2.5 END AS h"


@query("overlay_geometry", "WITH " + REG + f""",
n AS (SELECT image_id, node_id, CASE WHEN p % 2 = 0 THEN 'card' ELSE 'icon' END AS type, {OV} FROM nodes WHERE parent_id IS NOT NULL),
o AS (SELECT *, CASE WHEN (x <= 21 OR x + w >= 399) AND h >= 492 AND w < 336 THEN 'drawer' WHEN y + h >= 779 AND w >= 252 AND h < 574 THEN 'bottomSheet' END AS overlay FROM n WHERE type = 'card')
SELECT DISTINCT a.image_id, a.node_id, a.overlay FROM o a JOIN reg b ON b.image_id = a.image_id AND b.region_id <> a.node_id WHERE overlay IS NOT NULL AND ({INTER}) / (a.w*a.h) >= 0.2""")
def _(t):
    p, q = F.col("p"), F.col("q")
    n = t.nodes.select(
        "image_id", "node_id", "parent_id", F.col("node_id").alias("region_id"), F.when(p % 2 == 0, "card").otherwise("icon").alias("type"), F.when(p % 6 == 0, 0.0).otherwise(F.col("x")).alias("x"),
        F.when(q % 6 == 0, 700.0).otherwise(F.col("y")).alias("y"), F.when(q % 6 == 0, 300.0).otherwise(F.col("w")).alias("w"), F.when(p % 6 == 0, 600.0).otherwise(F.col("h") * 2.5).alias("h"),
    )
    return T.overlay_geometry(n, regions(t), t.pages_meta).select("image_id", "node_id", "overlay")


CR_TYPE = """CASE WHEN p % 40 = 0 THEN 'checkbox' WHEN p % 8 = 1 THEN 'text' WHEN p % 40 = 2 THEN 'title' WHEN p % 8 = 3 THEN 'section' WHEN c.type = 'icon' AND c.image_id % 3 <> 0 THEN 'row'
  WHEN c.type = 'button' AND c.image_id % 5 <> 0 THEN 'row' WHEN c.type = 'input' AND c.image_id % 2 = 0 THEN 'row' ELSE c.type END"""


@query("composite_roles", f"""
WITH n AS (SELECT c.image_id, f.node_id AS parent_id, c.node_id, c.n, CASE WHEN c.n <= 5 THEN CASE c.n % 2 WHEN 0 THEN 'button' ELSE 'section' END ELSE {CR_TYPE.replace('p %', 'c.p %')} END AS type, CASE WHEN c.q % 13 = 0 THEN 'label' END AS role, c.x, c.y, c.w, c.h
   FROM tree_nodes c LEFT JOIN tree_nodes f ON c.image_id = f.image_id AND c.n > 5 AND f.n = 2 + c.n % 4),
s AS (SELECT image_id, parent_id, bool_or(type = 'icon') AS ic, bool_or(type IN ('title','subtitle')) AS ti, bool_or(type = 'button') AS bu, bool_or(type = 'input') AS inp, bool_or(type = 'text' AND coalesce(role, '') = 'label') AS la FROM n WHERE parent_id IS NOT NULL GROUP BY image_id, parent_id),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, parent_id ORDER BY n) AS k FROM n WHERE type = 'checkbox' AND parent_id IS NOT NULL) t WHERE k = 1),
cl AS (SELECT DISTINCT a.image_id, a.parent_id FROM ct a JOIN n b ON b.image_id = a.image_id AND b.parent_id = a.parent_id AND b.type = 'text' WHERE abs(b.x - a.x - a.w) <= 30 AND least(a.y+a.h, b.y+b.h) > greatest(a.y, b.y))
SELECT n.image_id, n.node_id, CASE WHEN n.type = 'button' AND ic THEN 'iconButton' ELSE n.type END AS new_type, CASE WHEN inp AND la THEN 'formField' WHEN cl.parent_id IS NOT NULL THEN 'controlItem' WHEN n.type IN ('section','container') AND ti AND bu THEN 'banner' ELSE n.role END AS new_role
FROM n LEFT JOIN s ON s.image_id = n.image_id AND s.parent_id = n.node_id LEFT JOIN cl ON cl.image_id = n.image_id AND cl.parent_id = n.node_id""")
def _(t):
    n = with_parent(t)
    kind = F.when(F.col("n") <= 5, F.when(F.col("n") % 2 == 0, "button").otherwise("section")).otherwise(F.expr(CR_TYPE.replace("c.", "")))
    n = n.select("image_id", "parent_id", "node_id", F.col("n").alias("ord"), kind.alias("type"), F.when(F.col("q") % 13 == 0, "label").alias("role"), "x", "y", "w", "h")
    return T.composite_roles(n).select("image_id", "node_id", "new_type", "new_role")


@query("render_modes", """
WITH RECURSIVE n AS (SELECT image_id, node_id, parent_id, CASE WHEN q % 19 = 0 THEN 'mask' ELSE type END AS type, p % 2 = 0 AS banner, p % 10 = 0 AS sep FROM nodes),
w AS (SELECT image_id, node_id, CASE WHEN banner THEN CASE WHEN sep THEN 'hybrid' ELSE 'asset' END WHEN type = 'mask' THEN 'semantic-only' ELSE 'native' END AS render_mode FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.image_id, n.node_id, CASE WHEN w.render_mode = 'asset' THEN 'semantic-only' WHEN banner THEN CASE WHEN sep THEN 'hybrid' ELSE 'asset' END WHEN type = 'mask' THEN 'semantic-only' ELSE 'native' END
  FROM w JOIN n ON n.image_id = w.image_id AND n.parent_id = w.node_id)
SELECT * FROM w""")
def _(t):
    n = t.nodes.select(
        "image_id", "node_id", "parent_id", F.when(F.col("q") % 19 == 0, "mask").otherwise(F.col("type")).alias("type"), F.when(F.col("p") % 2 == 0, "banner").alias("role"),
        (F.col("p") % 10 == 0).alias("separable"),
    )
    return T.render_modes(n).select("image_id", "node_id", "render_mode")


@query("classify_media", """
WITH a AS (SELECT image_id, box_id AS ord, CASE p % 5 WHEN 0 THEN 'logo' WHEN 1 THEN 'image' ELSE 'icon' END AS type, CASE p % 6 WHEN 0 THEN 'Our Logo' WHEN 1 THEN ' Home ' END AS nt, x - 20 AS x, y, w * 1.5 AS w, h * 3 AS h FROM boxes),
k AS (SELECT *, CASE WHEN type <> 'icon' THEN type WHEN nt = 'Our Logo' THEN 'logo' WHEN w*h / (420*820.0) >= 0.02 AND w >= 96 AND h >= 96 THEN 'image' ELSE 'icon' END AS kind FROM a WHERE w*h >= 16)
SELECT image_id, ord, kind AS type, CASE WHEN nt IS NOT NULL THEN trim(nt) ELSE CASE kind WHEN 'icon' THEN '图标' WHEN 'image' THEN '图片' ELSE 'Logo' END END AS alt_text, greatest(0, x) AS crop_x, greatest(1, x + w - greatest(0, x)) AS crop_w FROM k""")
def _(t):
    p = F.col("p")
    a = t.boxes.select(
        "image_id", F.col("box_id").alias("ord"), F.when(p % 5 == 0, "logo").when(p % 5 == 1, "image").otherwise("icon").alias("type"), F.when(p % 6 == 0, "Our Logo").when(p % 6 == 1, " Home ").alias("nearby_text"),
        (F.col("x") - 20).alias("x"), "y", (F.col("w") * 1.5).alias("w"), (F.col("h") * 3).alias("h"),
    )
    return T.classify_media(a, t.pages_meta).select("image_id", "ord", "type", "alt_text", "crop_x", "crop_w")
