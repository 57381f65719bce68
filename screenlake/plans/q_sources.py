"""Queries over sources, projections, cache analysis, extension points and streaming."""

import uuid

from pyspark.sql import functions as F

from screenlake.operators import cache as C, extension as X, layout as Y, reconstruction as P, review as R
from screenlake.plans import q_layout as QL
from screenlake.plans.q_geometry import r6
from screenlake.plans.q_text import ENT_TEXT, ENTITIES
from screenlake.plans.registry import query
from screenlake.session import cut_lineage, shared_folder
from screenlake.sources import annotations as A, images as I, ocr as O
from screenlake.streaming import jobs as J


# --- annotations ------------------------------------------------------------------------
def annotation_json(t, images=None):
    """An annotation document per image (of ``images``), with defects spread over the images."""
    i, p = F.col("image_id"), F.col("p")
    el = F.struct(
        F.when((i % 11 == 5) & (F.col("n") == 2), F.lit(None)).otherwise(F.col("node_id")).alias("id"), F.col("type"),
        F.struct(F.when((i % 11 == 6) & (F.col("n") == 3), F.lit(None)).otherwise(F.col("x")).alias("x"), "y", "w", "h").alias("bbox"),
        F.when((i % 11 == 7) & (F.col("n") == 4), F.lit(None)).otherwise(F.lit("native")).alias("render"),
    )
    nodes = t.tree_nodes if images is None else t.tree_nodes.join(images, "image_id", "left_semi")
    rows = nodes.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", el.alias("e")))), lambda s: s["e"]).alias("elements"))
    i = F.col("image_id")
    doc = F.struct(
        F.when(i % 11 == 1, F.lit(None)).otherwise(F.concat(i.cast("string"), F.lit(".png"))).alias("image"),
        F.struct(F.when(i % 11 == 2, F.lit(None)).otherwise(F.lit(420.0)).alias("width"), F.lit(820.0).alias("height")).alias("imageSize"),
        F.lit("app").alias("platform"), F.when(i % 11 == 3, F.lit(None)).otherwise(F.lit("light")).alias("theme"), F.lit("en").alias("language"), F.lit("high").alias("dpi"),
        F.when(i % 11 == 4, F.lit(None)).otherwise(F.col("elements")).alias("elements"),
    )
    text = F.when(i % 11 == 8, "[broken").otherwise(F.to_json(doc))
    return A.parse_annotations(rows.select("image_id", text.alias("json")), "json")


REASONS = """CASE m.image_id % 11 WHEN 1 THEN 'invalid: annotation missing required field: image' WHEN 2 THEN 'invalid: annotation imageSize must have numeric width and height' WHEN 3 THEN 'invalid: annotation missing required field: theme'
  WHEN 4 THEN 'invalid: annotation missing required field: elements' WHEN 5 THEN CASE WHEN n >= 2 THEN 'invalid: annotation element missing id or type' END WHEN 6 THEN CASE WHEN n >= 3 THEN concat('invalid: annotation element ', n3, ' has invalid bbox') END
  WHEN 7 THEN CASE WHEN n >= 4 THEN concat('invalid: annotation element ', n4, ' missing render field') END WHEN 8 THEN 'invalid: annotation root must be an object' END"""
SIZES = "(SELECT image_id, count(*) AS n, max(CASE WHEN n = 3 THEN node_id END) AS n3, max(CASE WHEN n = 4 THEN node_id END) AS n4 FROM tree_nodes GROUP BY image_id)"


@query("reject_invalid", f"SELECT image_id, reason FROM (SELECT m.image_id, {REASONS} AS reason FROM (SELECT * FROM (SELECT image_id, max(n) AS n, max(CASE WHEN n = 3 THEN node_id END) AS n3, max(CASE WHEN n = 4 THEN node_id END) AS n4 FROM tree_nodes GROUP BY image_id) s) m) t WHERE reason IS NOT NULL")
def _(t):
    return A.reject_invalid(annotation_json(t))[1].select("image_id", "reason")


@query("ground_truth", f"""
SELECT n.image_id, CAST(n - 1 AS INT) AS ord, node_id AS box_id, type, x, y, w, h FROM tree_nodes n
JOIN (SELECT m.image_id, {REASONS} AS reason FROM {SIZES} m) r ON r.image_id = n.image_id WHERE r.reason IS NULL""")
def _(t):
    return A.ground_truth(A.elements_of(A.reject_invalid(annotation_json(t))[0]))


def annotation_folder(t):
    """The annotations as files of one image each, in packs."""
    docs = annotation_json(t).where("_corrupt_record IS NULL").drop("_corrupt_record")
    content = F.to_json(F.struct(*(c for c in docs.columns if c not in ("image_id", "json"))))
    folder = f"{shared_folder(t.spark).rstrip('/')}/annotations-{uuid.uuid4().hex}"
    A.pack_annotations(docs.select(F.format_string("k=%d/annotation.json", "image_id").alias("file"), content.alias("content")), folder)
    return folder


IMAGE_OF_FILE = r"/k=(\d+)/[^/]*$"


@query("scan_annotations", f"""
SELECT s.image_id, coalesce(r.reason, 'ok') AS outcome, CASE WHEN r.reason IS NULL THEN s.n ELSE 0 END AS elements FROM {SIZES} s
LEFT JOIN (SELECT m.image_id, {REASONS} AS reason FROM {SIZES} m) r ON r.image_id = s.image_id WHERE s.image_id % 11 <> 8""")
def _(t):
    notes, _ = A.scan_annotations(t.spark, annotation_folder(t))
    ok, bad = A.reject_invalid(cut_lineage(notes))
    rows = ok.select("file", F.lit("ok").alias("outcome"), F.size("elements").cast("bigint").alias("elements")).unionByName(bad.select("file", F.col("reason").alias("outcome"), F.lit(0).cast("bigint").alias("elements")))
    return rows.select(F.regexp_extract("file", IMAGE_OF_FILE, 1).cast("bigint").alias("image_id"), "outcome", "elements")


@query("stream_ingest_annotations", f"""
WITH r AS (SELECT s.image_id, s.reason FROM (SELECT m.image_id, {REASONS} AS reason FROM {SIZES} m) s WHERE s.image_id % 11 <> 8)
SELECT n.image_id, node_id AS element_id, CAST(n - 1 AS INT) AS ord, type, CAST(NULL AS STRING) AS reason FROM tree_nodes n JOIN r ON r.image_id = n.image_id WHERE r.reason IS NULL
UNION ALL SELECT image_id, NULL, -1, NULL, reason FROM r WHERE reason IS NOT NULL""")
def _(t):
    out, checkpoint = folders(t)
    J.stream_ingest_annotations(t.spark, annotation_folder(t), out, f"{out}-rejects", checkpoint).awaitTermination()
    image = lambda c: F.regexp_extract(c, IMAGE_OF_FILE, 1).cast("bigint").alias("image_id")
    none = F.lit(None)
    good = t.spark.read.parquet(out).select(image("image_id"), "element_id", "ord", "type", none.cast("string").alias("reason"))
    bad = t.spark.read.parquet(f"{out}-rejects").select(image("file"), none.cast("string").alias("element_id"), F.lit(-1).alias("ord"), none.cast("string").alias("type"), "reason")
    return good.unionByName(bad)


def whole_trees(t):
    """Each image's nodes as one nested JSON text, built from the deepest level up."""
    nodes = t.dealt.nodes
    # nodes that share an id stand at each place of that id, as in the walk of the SQL
    level = nodes.select("image_id", "node_id", "parent_id", "n", "type", "x", "y", "w", "h").join(R.tree_depths(nodes).hint("merge"), ["image_id", "node_id"])
    level = cut_lineage(level, dealt=True)
    own = F.to_json(F.struct(F.col("node_id").alias("id"), "type", F.struct("x", "y", "w", "h").alias("bbox"))).alias("own")
    inner = F.expr("concat(left(own, length(own) - 1), ',\"children\":[', array_join(kids, ','), ']}')")
    below = None
    for depth in range(level.agg(F.max("depth")).head()[0] or 0, -1, -1):
        here = level.where(F.col("depth") == depth).repartition("image_id").select("image_id", "node_id", "parent_id", "n", own)
        here = here.withColumn("tree", F.col("own")) if below is None else here.join(below.hint("merge"), ["image_id", "node_id"], "left").withColumn("tree", F.when(F.col("kids").isNull(), F.col("own")).otherwise(inner))
        kids = F.transform(F.array_sort(F.collect_list(F.struct("n", "tree"))), lambda k: k["tree"])
        below = here.groupBy("image_id", F.col("parent_id").alias("node_id")).agg(kids.alias("kids"))
    return cut_lineage(here.select("image_id", "tree"), dealt=True)


@query("stream_ingest_findings", f"""
WITH e AS (SELECT n.* FROM tree_nodes n JOIN (SELECT m.image_id, {REASONS} AS reason FROM {SIZES} m) r ON r.image_id = n.image_id WHERE r.reason IS NULL)
SELECT image_id, 'bbox-out-of-bounds' AS code, node_id AS element_id, CAST(NULL AS STRING) AS detail FROM e WHERE x < 0 OR y < 0 OR x + w > 420.5 OR y + h > 820.5
UNION ALL SELECT image_id, 'duplicate-id', node_id, NULL FROM (SELECT image_id, node_id, row_number() OVER (PARTITION BY image_id, node_id) AS k FROM e) t WHERE k > 1""")
def _(t):
    out, checkpoint = folders(t)
    J.stream_ingest_annotations(t.spark, annotation_folder(t), out, f"{out}-rejects", checkpoint, f"{out}-findings").awaitTermination()
    found = t.spark.read.parquet(f"{out}-findings")
    return found.select(F.regexp_extract("image_id", IMAGE_OF_FILE, 1).cast("bigint").alias("image_id"), "code", "element_id", "detail")


WALK = """
WITH RECURSIVE w AS (
  SELECT image_id, node_id, parent_id, 0 AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.image_id, n.node_id, n.parent_id, w.depth + 1 FROM w JOIN nodes n ON n.image_id = w.image_id AND n.parent_id = w.node_id)
SELECT w.image_id, w.node_id, w.parent_id, w.depth, n.type, n.x FROM w JOIN nodes n ON n.image_id = w.image_id AND n.node_id = w.node_id WHERE w.depth >= 1"""


@query("flatten_tree_rows", WALK)
def _(t):
    return X.flatten_tree_rows(whole_trees(t), "image_id", "tree").select("image_id", "node_id", "parent_id", "depth", "type", "x")


@query("flatten_tree", WALK)
def _(t):
    root = whole_trees(t)
    flat = A.flatten_tree(root, "image_id", "tree")
    return flat.select("image_id", "node_id", "parent_id", "depth", "type", "x")


# --- OCR and detector payloads ------------------------------------------------------------
def ocr_json(t):
    k = F.col("p") % 7
    obj = lambda **kw: F.to_json(F.struct(*(v.alias(n) for n, v in kw.items())))
    corners = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    fmt = lambda c: c.cast("bigint").cast("string")
    pos = F.concat_ws(",", fmt(F.col("x")), fmt(F.col("y")), fmt(F.col("x") + F.col("w")), fmt(F.col("y") + F.col("h")))
    rect = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    four = F.array(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    item = (
        F.when(k == 0, obj(text=F.col("text"), box=corners, confidence=F.col("confidence"))).when(k == 1, obj(text=F.col("text"), position=pos)).when(k == 2, obj(text=F.col("text"), boundingBox=rect, confidence=F.col("confidence")))
        .when(k == 3, obj(text=F.col("text"), bbox=four)).when(k == 4, F.concat(F.lit('"'), "text", F.lit('"'))).when(k == 5, obj(text=F.lit("  "), box=corners)).otherwise(obj(text=F.col("text"), position=F.lit("1,2,x,4"), confidence=F.col("confidence")))
    )
    arr = F.concat(F.lit("["), item, F.lit("]"))
    q = F.col("q") % 4
    doc = F.when(q == 0, arr).when(q == 1, F.concat(F.lit('{"texts":'), arr, F.lit("}"))).when(q == 2, F.concat(F.lit('{"items":'), arr, F.lit("}"))).otherwise(F.concat(F.lit('{"ocr":{"texts":'), arr, F.lit("}}")))
    return t.ocr_items.select("box_id", doc.alias("json"))


@query("ocr_items_from_json", """
SELECT box_id, text, CASE WHEN p % 7 <= 3 THEN x END AS x, CASE WHEN p % 7 <= 3 THEN y END AS y, CASE WHEN p % 7 <= 3 THEN w END AS w, CASE WHEN p % 7 <= 3 THEN h END AS h, CASE WHEN p % 7 IN (0, 2) THEN confidence END AS confidence FROM ocr_items WHERE p % 7 <> 5""")
def _(t):
    return O.ocr_items_from_json(ocr_json(t), "json", "box_id").select("box_id", "text", "x", "y", "w", "h", "confidence")


@query("normalize_raw_ocr", """
SELECT image_id, box_id AS ord, CASE WHEN p % 5 = 0 THEN 'x' ELSE text END AS text, floor(x + 0.25 + 0.5) AS x, floor(y + 0.5) AS y, floor(x + w + 0.75 + 0.5) - floor(x + 0.25 + 0.5) AS w, floor(y + h + 0.5) - floor(y + 0.5) AS h, confidence,
  CASE WHEN p % 5 <> 0 AND regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN p % 5 = 0 OR regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM ocr_items WHERE NOT (confidence < 0.5 AND (p % 5 = 0 OR length(text) <= 1))""")
def _(t):
    x, y, w, h = (F.col(c) for c in "xywh")
    xa, xb = x + 0.25, x + w + 0.75
    poly = F.when(F.col("q") % 2 == 0, F.array(F.array(xb, y), F.array(xa, y), F.array(xb, y + h), F.array(xa, y + h)))
    raw = t.ocr_items.select(
        "image_id", F.col("box_id").alias("ord"), F.when(F.col("p") % 5 == 0, " x ").otherwise(F.col("text")).alias("text"), F.col("confidence").alias("score"), poly.alias("polygon"),
        xa.alias("rx"), y.alias("ry"), (xb - xa).alias("rw"), h.alias("rh"),
    )
    return O.normalize_raw_ocr(raw)


# images of digits only, with some Chinese, and as they are
LANG_TEXT = "CASE WHEN image_id % 3 = 0 THEN CAST(p AS STRING) WHEN image_id % 3 = 1 AND q % 16 = 0 THEN '中文' ELSE text END"


@query("document_language", f"SELECT image_id, CASE WHEN bool_or(regexp_matches(text, '[一-鿿]')) THEN 'zh' WHEN bool_or(regexp_matches(text, '[A-Za-z]')) THEN 'en' ELSE 'unknown' END AS language FROM (SELECT image_id, {LANG_TEXT} AS text FROM ocr_items) t GROUP BY image_id")
def _(t):
    return O.document_language(t.ocr_items.withColumn("text", F.expr(LANG_TEXT)))


@query("valid_ocr", """
SELECT image_id, box_id, CASE WHEN p % 3 = 0 THEN 1.0 ELSE confidence + 0.3 END AS confidence FROM ocr_items WHERE (p % 3 = 0 OR confidence + 0.3 <= 1) AND q % 13 <> 0""")
def _(t):
    i = t.ocr_items.select("image_id", "box_id", "x", "y", F.when(F.col("q") % 13 == 0, 0.0).otherwise(F.col("w")).alias("w"), "h", F.when(F.col("p") % 3 != 0, F.col("confidence") + 0.3).alias("confidence"))
    return O.valid_ocr(i).select("image_id", "box_id", "confidence")


@query("detections_from_scores", """
WITH s AS (SELECT image_id, box_id, x, y, w, h, (p % 10) / 10.0 AS a, (q % 10) / 10.0 AS b, ((p + q) % 10) / 10.0 AS c FROM boxes)
SELECT image_id, box_id AS ord, CASE WHEN greatest(a, b, c) = a THEN 'button' WHEN greatest(a, b, c) = b THEN 'icon' ELSE 'unknown' END AS type, CAST(greatest(a, b, c) AS DOUBLE) AS score, round(x, 6) AS x, round(h, 6) AS h FROM s WHERE greatest(a, b, c) >= 0.5""")
def _(t):
    p, q = F.col("p"), F.col("q")
    rows = t.boxes.select(
        "image_id", F.col("box_id").alias("ord"), ((F.col("x") + F.col("w") / 2) / 420).alias("cx"), ((F.col("y") + F.col("h") / 2) / 820).alias("cy"), (F.col("w") / 420).alias("w"), (F.col("h") / 820).alias("h"),
        F.array(p % 10 / 10, q % 10 / 10, (p + q) % 10 / 10).alias("scores"),
    )
    d = I.detections_from_scores(rows, ["button", "icon"], 0.5, t.pages_meta)
    return d.select("image_id", "ord", "type", "score", r6(F.col("x"), "x"), r6(F.col("h"), "h"))


@query("detections_from_normalized", """
SELECT image_id, box_id AS ord, CASE WHEN p % 4 = 0 THEN 'icon' WHEN q % 2 = 0 THEN 'button' ELSE 'text' END AS type, round(x, 6) AS x, round(w, 6) AS w FROM boxes WHERE p % 6 <> 0""")
def _(t):
    p, q = F.col("p"), F.col("q")
    rows = t.boxes.select(
        "image_id", F.col("box_id").alias("ord"), (F.col("x") / 420).alias("x1"), (F.col("y") / 820).alias("y1"), F.when(p % 6 == 0, F.col("x") / 420).otherwise((F.col("x") + F.col("w")) / 420).alias("x2"),
        ((F.col("y") + F.col("h")) / 820).alias("y2"), F.when(p % 4 == 0, "Search Icon").otherwise("Submit").alias("content"), (q % 2 == 0).alias("interactivity"),
    )
    return I.detections_from_normalized(rows, t.pages_meta).select("image_id", "ord", "type", r6(F.col("x"), "x"), r6(F.col("w"), "w"))


@query("decode_inline_images", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'data-uri' WHEN 1 THEN CASE WHEN length(to_base64(encode(concat('PNG', text)))) > 100 THEN 'base64' ELSE 'path' END ELSE 'path' END AS source,
  CAST(CASE WHEN doc_id % 3 = 0 THEN octet_length(encode(text)) + 4 WHEN doc_id % 3 = 1 AND length(to_base64(encode(concat('PNG', text)))) > 100 THEN octet_length(encode(concat('PNG', text))) ELSE -1 END AS BIGINT) AS size,
  CASE WHEN doc_id % 3 = 0 THEN 'image/png' END AS mime FROM documents""")
def _(t):
    body = F.concat(F.unhex(F.lit("89504E47")), F.encode("text", "UTF-8"))
    plain = F.concat(F.lit("PNG").cast("binary"), F.encode("text", "UTF-8"))
    clean = lambda b: F.regexp_replace(F.base64(b), "[\r\n]", "")
    k = F.col("doc_id") % 3
    rows = t.documents.select("doc_id", F.when(k == 0, F.concat(F.lit("data:image/png;base64,"), clean(body))).when(k == 1, clean(plain)).otherwise("folder/a b.png").alias("raw"))
    return I.decode_inline_images(rows, "raw").select("doc_id", "source", F.coalesce(F.col("size").cast("bigint"), F.lit(-1)).alias("size"), "mime")


# --- projections ------------------------------------------------------------------------
@query("apply_detect_toggles", """
SELECT image_id, box_id, CASE WHEN image_id % 2 = 0 THEN text ELSE '' END AS text FROM ocr_items WHERE image_id % 3 <> 0""")
def _(t):
    i = F.col("image_id")
    flags = t.pages_meta.select(i.alias("request_id"), F.when(i % 3 == 0, False).alias("detect_component"), (i % 2 == 0).alias("detect_text"), F.lit(True).alias("detect_icon"), F.lit(True).alias("detect_layout"))
    comps = t.ocr_items.select(i.alias("request_id"), "box_id", "text")
    return P.apply_detect_toggles(comps, flags, "components").select(F.col("request_id").alias("image_id"), "box_id", "text")


@query("evidence_from_layout", """
SELECT image_id, concat('cv-', box_id) AS cand_id, type, CAST(0.7 AS DOUBLE) AS score, 'cv' AS source FROM boxes WHERE p % 17 <> 0 UNION ALL SELECT image_id, concat('cv-region-', box_id), type, 0.6, 'cv' FROM boxes WHERE type = 'card'
UNION ALL SELECT image_id, concat('ocr-', box_id), 'text', 0.9, 'ocr' FROM ocr_items""")
def _(t):
    b = t.boxes.withColumnRenamed("box_id", "ord")
    comps = b.withColumn("text", F.lit("t")).withColumn("w", F.when(F.col("p") % 17 == 0, float("nan")).otherwise(F.col("w")))
    e = P.evidence_from_layout(comps, b.where("type = 'card'"), t.ocr_items.withColumnRenamed("box_id", "ord"))
    return e.select("image_id", "cand_id", "type", "score", "source")


@query("layout_block", "WITH " + QL.REG + "," + QL.LAYOUT + """
SELECT l.image_id, 'general-ui' AS page_type, layout_type, CASE WHEN m.n IS NULL THEN 0 ELSE m.n END AS media_area_count FROM lay l LEFT JOIN (SELECT image_id, count(*) AS n FROM boxes WHERE type = 'icon' GROUP BY image_id) m ON m.image_id = l.image_id""")
def _(t):
    reg = QL.regions(t)
    pages = t.pages_meta.select("image_id", F.lit("general-ui").alias("page_class"))
    sp = Y.spacing(t.boxes.where("type = 'card'").withColumnRenamed("box_id", "region_id"))
    b = P.layout_block(pages, Y.layout_type(reg, t.pages_meta), sp, t.boxes.where("type = 'icon'"))
    return b.select("image_id", "page_type", "layout_type", "media_area_count")


@query("design_block", "WITH " + QL.PALETTE + """
SELECT image_id, string_agg(concat(printf('#%02x%02x%02x', r, g, b), '=', role), ',' ORDER BY k) AS palette FROM pal GROUP BY image_id""")
def _(t):
    pal = Y.palette_roles(QL.colors(t))
    d = P.design_block(Y.theme(pal), pal)
    return d.select("image_id", F.array_join(F.transform("palette", lambda p: F.concat(p["hex"], F.lit("="), p["role"])), ",").alias("palette"))


def spec(t):
    n = QL.kid_nodes(t)
    media = t.boxes.where("type = 'icon'").select("image_id", F.col("box_id").alias("ord"), "type", F.lit("图标").alias("alt_text"))
    return P.assemble_reconstruction(n, Y.container_constraints(n), Y.detect_repeats(n), media, Y.layout_type(QL.regions(t), t.pages_meta))


@query("assemble_reconstruction", "WITH " + QL.REG + "," + QL.LAYOUT + "," + QL.CONSTRAINTS + """
SELECT n.image_id, count(*) AS node_count, any_value(layout_type) AS layout_type, any_value(coalesce(c.k, 0)) AS n_constraints, any_value(coalesce(m.k, 0)) AS n_images
FROM nodes n LEFT JOIN lay USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS k FROM cons GROUP BY image_id) c ON c.image_id = n.image_id LEFT JOIN (SELECT image_id, count(*) AS k FROM boxes WHERE type = 'icon' GROUP BY image_id) m ON m.image_id = n.image_id GROUP BY n.image_id""")
def _(t):
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return spec(t).select("image_id", "node_count", "layout_type", size("constraints").alias("n_constraints"), size("images").alias("n_images"))


@query("summary_only", "SELECT image_id, count(*) AS node_count, CAST(min(5, count(*)) AS BIGINT) AS tree_size FROM nodes GROUP BY image_id".replace("min(5, count(*))", "least(5, count(*))"))
def _(t):
    # in this tree the first five nodes of an image have no parent
    return P.summary_only(spec(t)).select("image_id", "node_count", F.size("tree").cast("bigint").alias("tree_size"))


@query("spec_consistency", """
WITH act AS (SELECT image_id, type, count(*) AS n FROM nodes GROUP BY image_id, type),
dec AS (SELECT image_id, type, CASE WHEN image_id % 9 = 0 AND type = 'icon' THEN n + 1 ELSE n END AS n FROM act WHERE NOT (image_id % 10 = 1 AND type = 'card'))
SELECT image_id, 'count-mismatch' AS code, type AS detail FROM act FULL JOIN dec USING (image_id, type) WHERE coalesce(act.n, 0) <> coalesce(dec.n, 0)
UNION ALL SELECT image_id, 'negative-bbox', node_id FROM nodes WHERE p % 53 = 0
UNION ALL SELECT image_id, 'missing-target', concat('repeat:', node_id, 'x') FROM nodes WHERE q % 47 = 0
UNION ALL SELECT image_id, 'duplicate-node-id', node_id FROM nodes GROUP BY image_id, node_id HAVING count(*) > 1""")
def _(t):
    n = t.nodes.withColumn("w", F.when(F.col("p") % 53 == 0, -1.0).otherwise(F.col("w")))
    i = F.col("image_id")
    dec = t.nodes.groupBy("image_id", "type").agg(F.count(F.lit(1)).alias("n")).where(~((i % 10 == 1) & (F.col("type") == "card")))
    dec = dec.withColumn("n", F.when((i % 9 == 0) & (F.col("type") == "icon"), F.col("n") + 1).otherwise(F.col("n")))
    refs = t.nodes.select("image_id", F.lit("repeat").alias("kind"), F.when(F.col("q") % 47 == 0, F.concat("node_id", F.lit("x"))).otherwise(F.col("node_id")).alias("target_id"))
    return P.spec_consistency(n, dec, refs)


@query("markdown", """
WITH RECURSIVE w AS (
  SELECT image_id, n, 0 AS depth, [n] AS trail FROM tree_nodes WHERE parent_n IS NULL
  UNION ALL SELECT c.image_id, c.n, w.depth + 1, list_append(w.trail, c.n) FROM w JOIN tree_nodes c ON c.image_id = w.image_id AND c.parent_n = w.n),
b AS (SELECT t.image_id, trail, repeat('  ', depth) AS pad, t.* EXCLUDE (image_id) FROM w JOIN tree_nodes t ON t.image_id = w.image_id AND t.n = w.n)
SELECT image_id, concat('# UI Semantic AST (v1)', chr(10), chr(10), string_agg(concat(
  pad, '- **', node_id, '** - `', type, '`', CASE WHEN p % 3 = 0 THEN concat(' text: "t', p, '"') ELSE '' END, chr(10), pad, '  ```', chr(10), pad, '  type: ', type, chr(10),
  pad, '  bbox: { x: ', CAST(x AS BIGINT), ', y: ', CAST(y AS BIGINT), ', w: ', CAST(w AS BIGINT), ', h: ', CAST(h AS BIGINT), ' }', chr(10), pad, '  ```'), chr(10) ORDER BY trail)) AS markdown
FROM b GROUP BY image_id""")
def _(t):
    # places in the tree stand in for ids, which may repeat
    places = t.tree_nodes.select("image_id", F.col("n").cast("string").alias("node_id"), F.col("parent_n").cast("string").alias("parent_id"), "n")
    paths = R.tree_paths(places, "n").select("image_id", F.col("node_id").cast("int").alias("n"), "depth", F.col("trail").alias("path"))
    text = F.when(F.col("p") % 3 == 0, F.concat(F.lit("t"), F.col("p").cast("string")))
    return P.markdown(t.tree_nodes.withColumn("text", text).join(paths.hint("merge"), ["image_id", "n"]))


# --- cache ------------------------------------------------------------------------------
HITS = """
WITH RECURSIVE r AS (SELECT request_id, cache_key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY cache_key ORDER BY ts, request_id) AS k FROM requests),
w AS (SELECT request_id, cache_key, k, t AS last, FALSE AS hit FROM r WHERE k = 1
  UNION ALL SELECT r.request_id, r.cache_key, r.k, CASE WHEN r.t - w.last < {ttl} THEN w.last ELSE r.t END, r.t - w.last < {ttl} FROM w JOIN r ON r.cache_key = w.cache_key AND r.k = w.k + 1)
SELECT request_id, hit FROM w"""


@query("cache_hits", HITS.format(ttl=86400 * 1_000_000))
def _(t):
    return C.cache_hits(t.requests, ttl=86400).select("request_id", "hit")


@query("cache_hits_busy_keys", HITS.format(ttl=3600 * 1_000_000).replace("FROM requests", "FROM (SELECT request_id, ts, provider AS cache_key FROM requests) q"))
def _(t):
    r = t.requests.select("request_id", "ts", F.col("provider").alias("cache_key"))
    return C.cache_hits(r, ttl=3600).select("request_id", "hit")


@query("cache_key", """
SELECT doc_id, concat(substring(sha256(text), 1, 32), ':', substring(sha256(lang), 1, 16), ':', substring(sha256(concat(CAST(n_chars AS STRING), ':0.5')), 1, 8)) AS k FROM documents""")
def _(t):
    return t.documents.select("doc_id", C.cache_key(F.col("text"), F.col("lang"), F.col("n_chars"), F.lit(0.5)).alias("k"))


# --- extension points --------------------------------------------------------------------
def word_detector():
    """Stand-in for a model: every second word of a text is a detection."""
    def run(row):
        if row["doc_id"] % 50 == 0:
            raise ValueError("unreadable")
        return [{"label": "word", "size": float(len(w))} for w in row["text"].split(" ")[::2]]

    return run


@query("detect_with", """
SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE (len(string_split(text, ' ')) + 1) // 2 END AS detections, doc_id % 50 = 0 AS failed FROM documents""")
def _(t):
    d = X.detect_with(t.documents.select("doc_id", "text"), word_detector, "label string, size double", "doc_id")
    return d.groupBy("doc_id").agg(F.count("label").alias("detections"), F.max(F.col("error").isNotNull()).alias("failed"))


def echo_model():
    """Stand-in for a model: answers prose for classify, misses the field at first."""
    def run(prompts):
        return ['{"texts":[]}' if "IMPORTANT" in p else "{}" if p.startswith("ocr") else '{"description":"' + p[:3] + '"}' for p in prompts]

    return run


@query("infer_with", """
SELECT doc_id AS request_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS attempt, CAST(NULL AS STRING) AS error FROM documents""")
def _(t):
    even = F.col("doc_id") % 2 == 0
    p = t.documents.select(F.col("doc_id").alias("request_id"), F.when(even, "ocr").otherwise("summary").alias("skill"), F.concat(F.when(even, "ocr").otherwise("sum"), F.col("lang")).alias("prompt"))
    return X.infer_with(p, echo_model, 1).select("request_id", "attempt", "error")


@query("export_with", "SELECT image_id, CAST(count(*) AS STRING) AS document FROM nodes GROUP BY image_id")
def _(t):
    return X.export_with(t.nodes.select("image_id", "node_id"), lambda pdf: str(len(pdf))).select("image_id", "document")


# --- streaming --------------------------------------------------------------------------
def text_time(name):
    """Times as text: the same in every session time zone."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def table_stream(t, name):
    """A given table as a stream.  The pattern fits one file as well as a folder of files."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


def folders(t):
    """Output and checkpoint of a stream, in the folder that all machines share."""
    base = f"{shared_folder(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def stream_requests(t):
    return table_stream(t, "events").select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("provider"), F.concat_ws("|", "event_type", "props").alias("cache_key"), F.col("value").alias("duration_ms")
    )


@query("stream_latest_actions", """
SELECT image_id, subject_id, action_id, action FROM (SELECT *, row_number() OVER (PARTITION BY image_id, subject_kind, subject_id ORDER BY created_at DESC, action_id DESC) AS k FROM review_actions) t WHERE k = 1""")
def _(t):
    act = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "view", "rejected").when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "signup", "overridden").otherwise("suppressed")
    a = table_stream(t, "events").select(F.col("event_id").alias("action_id"), F.col("user_id").alias("image_id"), F.lit("structure-finding").alias("subject_kind"), F.col("props").alias("subject_id"), act.alias("action"), F.col("ts").alias("created_at"))
    return J.run_available(J.stream_latest_actions(a), *folders(t), "update", ("image_id", "subject_kind", "subject_id")).select("image_id", "subject_id", "action_id", "action")


@query("stream_cache_hits", HITS.format(ttl=86400 * 1_000_000))
def _(t):
    return J.run_available(J.stream_cache_hits(stream_requests(t), ttl=86400), *folders(t)).select("request_id", "hit")


@query("idle_sessions", """
WITH b AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY provider ORDER BY ts) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS brk FROM requests),
s AS (SELECT *, sum(brk) OVER (PARTITION BY provider ORDER BY ts) AS sid FROM b)
SELECT provider, count(*) AS n, round(sum(duration_ms), 4) AS busy_ms, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS ended FROM s GROUP BY provider, sid""")
def _(t):
    closed = J.run_available(J.idle_sessions(stream_requests(t)), *folders(t)).drop("epoch")
    s = closed.unionByName(J.open_sessions(t.requests.withColumn("ts", F.col("ts").cast("timestamp")), closed))
    return s.select("provider", "n", F.round("busy_ms", 4).alias("busy_ms"), text_time("started"), text_time("ended"))


LATENCY = """
SELECT provider, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, round(avg(duration_ms) + 0.0000000123, 6) AS mean_ms, max(duration_ms) AS max_ms,
  quantile_disc(duration_ms, 0.5) AS median_ms, quantile_disc(duration_ms, 0.9) AS p90_ms FROM ({rows}) r GROUP BY provider, r.started"""


def latency_rows(t, size, slide=None):
    s = J.run_available(J.stream_latency(stream_requests(t), size, slide), *folders(t), "update", ("provider", "started", "ended"))
    return s.select("provider", text_time("started"), "n", r6(F.col("mean_ms") + 0.0000000123, "mean_ms"), "max_ms", "median_ms", "p90_ms")


@query("stream_latency", LATENCY.format(rows="SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS started FROM requests"))
def _(t):
    return latency_rows(t, "1 hour")


@query("stream_latency_sliding", LATENCY.format(rows="""
  SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS started FROM requests UNION ALL SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR FROM requests"""))
def _(t):
    return latency_rows(t, "12 hours", "6 hours")


@query("stream_entities", ENTITIES + " SELECT doc_id, CAST(pos AS INT) AS pos, type, value FROM ents")
def _(t):
    return J.run_available(J.stream_entities(table_stream(t, "documents").select("doc_id", F.expr(ENT_TEXT).alias("text"))), *folders(t)).select("doc_id", "pos", "type", "value")
