"""Queries over review, validation and dataset operators."""

import uuid

from pyspark.sql import functions as F

from screenlake.operators import dataset as D, review as R
from screenlake.plans.q_geometry import IOU
from screenlake.plans.registry import query
from screenlake.session import shared_folder
from screenlake.sources import annotations as A


def elements(t, nodes=None):
    return (nodes or t.nodes).select(
        "image_id", F.col("node_id").alias("element_id"), F.col("n").alias("ord"), "type",
        F.when(F.col("p") % 5 == 0, "9:41").when(F.col("p") % 5 == 1, "OK").otherwise("a longer text").alias("text"), "x", "y", "w", "h",
    )


def relations(t):
    rel = t.nodes.where("parent_id IS NOT NULL").select(
        "image_id", F.col("n").alias("ord"), F.col("parent_id").alias("src"), F.col("node_id").alias("dst"),
        F.lit("contains").alias("type"), F.when(F.col("p") % 5 == 0, "human").otherwise("derived").alias("source"),
        F.when(F.col("q") % 2 == 0, "confirmed").alias("review_status"),
    )
    return rel


def findings(t):
    d = t.dealt
    return R.structure_findings(elements(d), relations(d), d.kids, dealt=True)


def actions(t):
    return t.finding_actions.drop("element_id")


KEYTXT = "concat(CAST(CAST(floor({0}.x+0.5) AS BIGINT) AS STRING), ',', CAST(CAST(floor({0}.y+0.5) AS BIGINT) AS STRING), ',', CAST(CAST(floor({0}.w+0.5) AS BIGINT) AS STRING), ',', CAST(CAST(floor({0}.h+0.5) AS BIGINT) AS STRING))"

FINDINGS = f"""
WITH iso AS (
  SELECT c.image_id, 'isolated-content' AS code, 2 AS version, 'medium' AS severity, c.node_id AS element_id, f.node_id AS parent_id, c.type,
         {KEYTXT.format('c')} AS bbox_hash, 0 AS evidence_pct
  FROM nodes c JOIN nodes f ON f.image_id = c.image_id AND f.node_id = c.parent_id AND f.type = 'page'
  WHERE c.type IN ('text', 'icon', 'button', 'input')),
sib AS (SELECT n.*, k.parent_id AS par FROM nodes n JOIN kids k ON k.image_id = n.image_id AND k.child_id = n.node_id),
ovp AS (
  SELECT a.image_id, a.par, a.type, a.node_id AS ia, b.node_id AS ib, {IOU} AS iou,
         CASE WHEN a.w*a.h <= b.w*b.h THEN a.node_id ELSE b.node_id END AS small,
         CASE WHEN a.w*a.h <= b.w*b.h THEN {KEYTXT.format('a')} ELSE {KEYTXT.format('b')} END AS bbox_hash
  FROM sib a JOIN sib b ON a.image_id = b.image_id AND a.par = b.par AND a.type = b.type AND a.node_id < b.node_id WHERE {IOU} > 0.3),
ov AS (SELECT image_id, 'sibling-overlap' AS code, 1 AS version, 'medium' AS severity, small AS element_id, par AS parent_id, type, bbox_hash,
         CAST(floor(iou * 100 + 0.5) AS INT) AS evidence_pct
  FROM (SELECT *, row_number() OVER (PARTITION BY image_id, par, small ORDER BY ia, ib) AS k FROM ovp) t WHERE k = 1),
med AS (SELECT image_id, par, type, list_sort(list(w))[CAST(count(*) - count(*) % 2 AS INT) // 2 + 1] AS mw, list_sort(list(h))[CAST(count(*) - count(*) % 2 AS INT) // 2 + 1] AS mh
  FROM sib GROUP BY image_id, par, type HAVING count(*) >= 2),
sz AS (SELECT s.image_id, 'sibling-size-inconsistent' AS code, 1 AS version, 'low' AS severity, s.node_id AS element_id, s.par AS parent_id, s.type,
         {KEYTXT.format('s')} AS bbox_hash,
         CAST(greatest(25, floor(abs(s.w-mw)/greatest(1.0,mw)*100+0.5), floor(abs(s.h-mh)/greatest(1.0,mh)*100+0.5)) AS INT) AS evidence_pct
  FROM sib s JOIN med m ON m.image_id = s.image_id AND m.par = s.par AND m.type = s.type
  WHERE abs(s.w-mw)/greatest(1.0,mw) > 0.25 OR abs(s.h-mh)/greatest(1.0,mh) > 0.25),
findings AS (SELECT *, concat(code, ':', element_id) AS subject_id, concat(CAST(version AS STRING), ':', code, ':', element_id, ':', bbox_hash, ':', type) AS signature
  FROM (SELECT * FROM iso UNION ALL SELECT * FROM ov UNION ALL SELECT * FROM sz) u)"""

LAST = """,
last_action AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, subject_kind, subject_id ORDER BY created_at DESC, action_id DESC) AS k FROM finding_actions) t WHERE k = 1),
reviewed AS (SELECT f.*, CASE WHEN a.action IS NULL OR a.signature <> f.signature THEN NULL WHEN a.action IN ('confirmed','accepted') THEN 'confirmed'
   WHEN a.action = 'overridden' THEN 'overridden' WHEN a.action IN ('suppressed','rejected') THEN 'suppressed' ELSE 'auto' END AS status
  FROM findings f LEFT JOIN last_action a ON a.image_id = f.image_id AND a.subject_id = f.subject_id)"""


@query("rule_isolated_content", FINDINGS + " SELECT image_id, code, version, severity, element_id, parent_id, type, bbox_hash, evidence_pct FROM iso")
def _(t):
    d = t.dealt
    return R.rule_isolated_content(elements(d), relations(d), d.kids, dealt=True)


@query("rule_sibling_overlap", FINDINGS + " SELECT image_id, code, version, severity, element_id, parent_id, type, bbox_hash, evidence_pct FROM ov")
def _(t):
    d = t.dealt
    return R.rule_sibling_overlap(elements(d, d.tree_nodes), d.kids, dealt=True)


@query("rule_sibling_size", FINDINGS + " SELECT image_id, code, version, severity, element_id, parent_id, type, bbox_hash, evidence_pct FROM sz")
def _(t):
    # the nodes without their parents, which the rule does not ask for
    d = t.dealt
    return R.rule_sibling_size(elements(d, d.tree_nodes), d.kids, dealt=True)


@query("structure_findings", FINDINGS + " SELECT * FROM findings")
def _(t):
    return findings(t)


@query("latest_actions", """
SELECT image_id, subject_kind, subject_id, action_id, action, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, subject_kind, subject_id ORDER BY created_at DESC, action_id DESC) AS k FROM review_actions) t WHERE k = 1""")
def _(t):
    return R.latest_actions(t.review_actions)


@query("review_status", FINDINGS + LAST + " SELECT image_id, subject_id, severity, status FROM reviewed")
def _(t):
    return R.review_status(findings(t), actions(t)).select("image_id", "subject_id", "severity", "status")


def headers(t):
    draft = F.when(F.col("image_id") % 9 == 0, F.array(F.lit(R.DRAFT_WARNING))).otherwise(F.array().cast("array<string>"))
    return t.pages_meta.select("image_id", draft.alias("warnings"))


ELIG = LAST + """,
elig AS (SELECT m.image_id, CASE WHEN m.image_id % 9 = 0 THEN 'draft: annotation not human-reviewed'
   WHEN EXISTS (SELECT 1 FROM reviewed r WHERE r.image_id = m.image_id AND r.severity = 'medium' AND (r.status IS NULL OR r.status = 'auto')) THEN 'open-high-severity-findings' END AS reason
  FROM pages_meta m)"""


@query("eligibility", FINDINGS + ELIG + " SELECT image_id, reason IS NULL AS eligible, reason FROM elig")
def _(t):
    return R.eligibility(headers(t), R.review_status(findings(t), actions(t)))


@query("exclusion_tally", FINDINGS + ELIG + """
SELECT count(*) AS total, CAST(0 AS BIGINT) AS sidecar, CAST(0 AS BIGINT) AS invalid, count(CASE WHEN reason LIKE 'draft%' THEN 1 END) AS draft,
       count(CASE WHEN reason LIKE 'open%' THEN 1 END) AS open_high_severity, CAST(0 AS BIGINT) AS other FROM elig WHERE reason IS NOT NULL""")
def _(t):
    e = R.eligibility(headers(t), R.review_status(findings(t), actions(t)))
    return R.exclusion_tally(e.where("NOT eligible").select("image_id", "reason"))


@query("rule_calibration", FINDINGS + LAST + """
SELECT code, version, count(*) AS raised, count(CASE WHEN status='confirmed' THEN 1 END) AS confirmed, count(CASE WHEN status='overridden' THEN 1 END) AS overridden,
       count(CASE WHEN status='suppressed' THEN 1 END) AS suppressed, count(CASE WHEN status='auto' THEN 1 END) AS rejected, count(CASE WHEN status IS NULL THEN 1 END) AS unreviewed
FROM reviewed GROUP BY code, version""")
def _(t):
    return R.rule_calibration(R.review_status(findings(t), actions(t)))


RULE_PRECISION = """
WITH c AS (SELECT code, max(version) AS version, count(*) AS raised, count(CASE WHEN status <> 'unreviewed' THEN 1 END) AS reviewed,
  count(CASE WHEN status = 'confirmed' THEN 1 END) AS tp FROM rule_hits GROUP BY code)
SELECT code, version, reviewed > 0 AS calibrated, round(CASE WHEN reviewed > 0 THEN tp / CAST(reviewed AS DOUBLE) ELSE 0 END, 6) AS "precision", reviewed, raised,
       reviewed = 0 OR tp / CAST(reviewed AS DOUBLE) < 0.5 AS advisory_only FROM c"""


@query("rule_precision", RULE_PRECISION)
def rule_precision(t):
    def n(s):
        return F.count(F.when(F.col("status") == s, 1)).alias(s)

    counts = t.rule_hits.groupBy("code", "version").agg(
        F.count(F.lit(1)).alias("raised"), n("confirmed"), n("overridden"), n("suppressed"), n("rejected"), n("unreviewed")
    )
    return R.rule_precision(counts).withColumn("precision", F.round("precision", 6))


@query("write_report", RULE_PRECISION)
def _(t):
    path = f"{shared_folder(t.spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    report = rule_precision(t)
    A.write_report(report, path)
    return t.spark.read.schema(report.schema).json(path)


@query("orphan_relations", """
SELECT image_id, src, dst, CASE WHEN src LIKE '%x' THEN src ELSE dst END AS missing FROM (
  SELECT image_id, CASE WHEN p % 11 = 0 THEN concat(parent_id, 'x') ELSE parent_id END AS src, CASE WHEN p % 7 = 0 THEN concat(node_id, 'x') ELSE node_id END AS dst
  FROM nodes WHERE parent_id IS NOT NULL) t WHERE src LIKE '%x' OR dst LIKE '%x'""")
def _(t):
    rel = t.nodes.where("parent_id IS NOT NULL").select(
        "image_id", F.when(F.col("p") % 11 == 0, F.concat("parent_id", F.lit("x"))).otherwise(F.col("parent_id")).alias("src"),
        F.when(F.col("p") % 7 == 0, F.concat("node_id", F.lit("x"))).otherwise(F.col("node_id")).alias("dst"),
    )
    return R.orphan_relations(rel, elements(t)).select("image_id", "src", "dst", "missing")


MISMATCH = """
SELECT image_id, parent_id, child_id, 'child-not-in-contains' AS code FROM (
  SELECT image_id, parent_id, child_id FROM kids EXCEPT SELECT image_id, src, dst FROM relations) a
UNION ALL
SELECT image_id, src, dst, 'contains-not-in-children' FROM (
  SELECT image_id, src, dst FROM relations EXCEPT SELECT image_id, parent_id, child_id FROM kids) b"""


@query("children_vs_contains", MISMATCH)
def _(t):
    return R.children_vs_contains(t.kids, t.relations)


def cyclic(t):
    back = t.relations.where(F.col("image_id") % 50 == 0)
    back = back.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "source")
    return t.relations.unionByName(back)


CYCLES = """
WITH RECURSIVE e AS (SELECT image_id, src, dst FROM relations UNION SELECT image_id, dst, src FROM relations WHERE image_id % 50 = 0),
reach AS (SELECT image_id, src, dst FROM e UNION SELECT r.image_id, r.src, e.dst FROM reach r JOIN e ON e.image_id = r.image_id AND e.src = r.dst),
cyc AS (SELECT DISTINCT image_id FROM reach WHERE src = dst)"""


@query("containment_cycles", CYCLES + " SELECT image_id FROM cyc")
def _(t):
    return R.containment_cycles(cyclic(t))


@query("validate_annotations", CYCLES + """,
el AS (SELECT image_id, CASE WHEN p % 97 = 0 THEN 'dup' ELSE box_id END AS element_id, CASE WHEN q % 41 = 0 THEN 'page' ELSE type END AS type,
   x - (CASE WHEN p % 31 = 0 THEN 400 ELSE 0 END) AS x, y, CASE WHEN p % 83 = 0 THEN 0 ELSE w END AS w, h FROM boxes),
ids AS (SELECT DISTINCT image_id, element_id FROM el),
kn AS (SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM ids WHERE ids.image_id = e.image_id AND ids.element_id = e.src) AND EXISTS (SELECT 1 FROM ids WHERE ids.image_id = e.image_id AND ids.element_id = e.dst)),
kreach AS (SELECT image_id, src, dst FROM kn UNION SELECT r.image_id, r.src, e.dst FROM kreach r JOIN kn e ON e.image_id = r.image_id AND e.src = r.dst)
SELECT image_id, 'duplicate-id' AS code, element_id, CAST(NULL AS STRING) AS detail FROM (SELECT image_id, element_id, row_number() OVER (PARTITION BY image_id, element_id ORDER BY x) AS k FROM el) t WHERE k > 1
UNION ALL SELECT image_id, 'bbox-invalid-size', element_id, NULL FROM el WHERE w <= 0 OR h <= 0
UNION ALL SELECT image_id, 'bbox-out-of-bounds', element_id, NULL FROM el WHERE x < 0 OR y < 0 OR x + w > 420.5 OR y + h > 820.5
UNION ALL SELECT image_id, 'multiple-page-roots', NULL, NULL FROM el WHERE type = 'page' GROUP BY image_id HAVING count(*) > 1
UNION ALL SELECT image_id, 'relation-endpoint-missing', NULL, CASE WHEN EXISTS (SELECT 1 FROM ids WHERE ids.image_id = e.image_id AND ids.element_id = e.src) THEN dst ELSE src END FROM e
  WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.image_id = e.image_id AND ids.element_id = e.src) OR NOT EXISTS (SELECT 1 FROM ids WHERE ids.image_id = e.image_id AND ids.element_id = e.dst)
UNION ALL SELECT image_id, 'multiple-parents', dst, NULL FROM kn GROUP BY image_id, dst HAVING count(*) > 1
UNION ALL SELECT DISTINCT image_id, 'containment-cycle', NULL, NULL FROM kreach WHERE src = dst
UNION ALL SELECT image_id, 'child-not-in-contains', parent_id, child_id FROM (SELECT image_id, parent_id, child_id FROM kids EXCEPT SELECT image_id, src, dst FROM e) a
UNION ALL SELECT image_id, 'contains-not-in-children', src, dst FROM (SELECT image_id, src, dst FROM e EXCEPT SELECT image_id, parent_id, child_id FROM kids) b""")
def _(t):
    p, q = F.col("p"), F.col("q")
    el = t.boxes.select(
        "image_id", F.when(p % 97 == 0, "dup").otherwise(F.col("box_id")).alias("element_id"),
        F.when(q % 41 == 0, "page").otherwise(F.col("type")).alias("type"),
        (F.col("x") - F.when(p % 31 == 0, 400).otherwise(0)).alias("x"), "y", F.when(p % 83 == 0, 0.0).otherwise(F.col("w")).alias("w"), "h",
    )
    rel = cyclic(t).select("image_id", "src", "dst", "type").distinct()
    return R.validate_annotations(el, rel, t.kids, t.pages_meta)


@query("normalize_tree", """
WITH human AS (SELECT c.image_id, c.node_id, c.parent_id FROM nodes c WHERE c.parent_id IS NOT NULL AND c.p % 5 = 0),
geo AS (SELECT * FROM (SELECT b.image_id, b.box_id, a.box_id AS parent_id, row_number() OVER (PARTITION BY b.image_id, b.box_id ORDER BY a.w*a.h, a.box_id) AS k
  FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id <> b.box_id AND b.x >= a.x AND b.y >= a.y AND b.x+b.w <= a.x+a.w AND b.y+b.h <= a.y+a.h AND a.w*a.h > b.w*b.h) t WHERE k = 1)
SELECT b.image_id, b.box_id AS element_id, coalesce(h.parent_id, g.parent_id) AS parent_id, CASE WHEN h.parent_id IS NOT NULL THEN 'human' ELSE 'derived' END AS source
FROM boxes b LEFT JOIN human h ON h.image_id = b.image_id AND h.node_id = b.box_id LEFT JOIN geo g ON g.image_id = b.image_id AND g.box_id = b.box_id
WHERE coalesce(h.parent_id, g.parent_id) IS NOT NULL""")
def _(t):
    return R.normalize_tree(elements(t), relations(t))


@query("tree_paths", """
WITH RECURSIVE w AS (
  SELECT image_id, node_id, 0 AS depth, node_id AS root_id, node_id AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.image_id, n.node_id, w.depth + 1, w.root_id, concat(w.path, '/', n.node_id) FROM w JOIN nodes n ON n.image_id = w.image_id AND n.parent_id = w.node_id)
SELECT * FROM w""")
def _(t):
    return R.tree_paths(t.nodes)


TEXT_OF = "CASE n.p % 5 WHEN 0 THEN '9:41' WHEN 1 THEN 'OK' ELSE 'a longer text' END"


@query("auto_review", FINDINGS + f""",
pg AS (SELECT image_id, w AS pw, h AS ph FROM nodes WHERE type = 'page'),
cont AS (SELECT image_id, bool_or(type IN ('card', 'row')) AS hc FROM nodes GROUP BY image_id),
j AS (SELECT f.*, n.x, n.y, n.w, n.h, {TEXT_OF} AS txt, pw, ph, hc FROM findings f JOIN nodes n ON n.image_id = f.image_id AND n.node_id = f.element_id
   LEFT JOIN pg ON pg.image_id = f.image_id JOIN cont ON cont.image_id = f.image_id
   WHERE NOT EXISTS (SELECT 1 FROM finding_actions a WHERE a.image_id = f.image_id AND a.signature = f.signature))
SELECT image_id, subject_id, signature, code, type,
  CASE WHEN code = 'sibling-size-inconsistent' THEN CASE WHEN evidence_pct >= 42 THEN 'confirmed' ELSE 'suppressed' END
       WHEN code = 'sibling-overlap' THEN 'confirmed' WHEN NOT hc THEN 'suppressed' WHEN type = 'icon' THEN 'suppressed' WHEN txt = '9:41' THEN 'suppressed'
       WHEN w / pw > 0.8 THEN 'suppressed' WHEN y / ph < 0.05 AND type = 'text' AND length(txt) <= 8 THEN 'suppressed'
       WHEN (y + h) / ph > 0.95 AND type = 'text' AND length(txt) <= 4 THEN 'suppressed' WHEN type = 'text' AND length(txt) <= 4 THEN 'suppressed' ELSE 'confirmed' END AS action
FROM j""")
def _(t):
    d = t.dealt
    return R.auto_review(findings(d), elements(d), actions(d), dealt=True)


@query("pending_isolated", FINDINGS + f""",
j AS (SELECT f.type, n.y / pg.h AS yr, (n.y + n.h) / pg.h AS br, n.w / pg.w AS wr, {TEXT_OF} AS txt, f.image_id FROM findings f JOIN nodes n ON n.image_id = f.image_id AND n.node_id = f.element_id
   JOIN nodes pg ON pg.image_id = f.image_id AND pg.type = 'page'
   WHERE f.code = 'isolated-content' AND NOT EXISTS (SELECT 1 FROM finding_actions a WHERE a.image_id = f.image_id AND a.subject_id = f.subject_id)),
cont AS (SELECT image_id, bool_or(type IN ('card', 'row')) AS has_containers FROM nodes GROUP BY image_id)
SELECT type, CASE WHEN yr < 0.1 THEN 'top' WHEN br > 0.9 THEN 'bottom' ELSE 'middle' END AS "position", has_containers, wr > 0.8 AS full_width,
       CASE WHEN txt = '9:41' THEN 'time' WHEN txt = 'OK' THEN 'short-label' ELSE 'long-text' END AS text_category, count(*) AS n
FROM j JOIN cont USING (image_id) GROUP BY ALL""")
def _(t):
    return R.pending_isolated(findings(t), elements(t), actions(t))


def manifest_inputs(t):
    docs = t.documents
    note = F.concat(F.lit("set/doc_"), F.col("doc_id").cast("string"), F.lit(".json"))
    image = F.concat(F.lit("set/doc_"), F.col("doc_id").cast("string"), F.lit(".png"))
    ann = docs.join(t.labels, "doc_id", "left").select(
        note.alias("annotation_file"), image.alias("image_file"),
        F.when(F.col("quality") == 0, F.array(F.lit(R.DRAFT_WARNING))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    files = (
        docs.select(note.alias("path"), F.col("text").alias("content"))
        .unionByName(docs.select(image.alias("path"), F.concat("lang", "source").alias("content")))
        .unionByName(docs.where("doc_id % 3 = 0").select(F.concat(note, F.lit(".prediction.json")).alias("path"), F.col("source").alias("content")))
        .unionByName(docs.where("doc_id % 4 = 0").select(F.concat(note, F.lit(".session.json")).alias("path"), F.col("lang").alias("content")))
    )
    return ann, files


MANIFEST_SQL = """
WITH man AS (SELECT concat('doc_', CAST(d.doc_id AS STRING)) AS sample_id, concat('set/doc_', CAST(d.doc_id AS STRING), '.png') AS image_file, concat('set/doc_', CAST(d.doc_id AS STRING), '.json') AS annotation_file,
       sha256(concat(lang, source)) AS image_hash, sha256(text) AS annotation_hash, CASE WHEN d.doc_id % 3 = 0 THEN sha256(source) END AS prediction_hash, CAST(NULL AS STRING) AS ai_review_hash,
       CASE WHEN d.doc_id % 4 = 0 THEN sha256(lang) END AS review_actions_hash, coalesce(l.quality, 1) <> 0 AS reviewed, CAST(NULL AS STRING) AS split
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("build_manifest", MANIFEST_SQL + " SELECT * FROM man")
def _(t):
    return D.build_manifest(*manifest_inputs(t))


@query("export_samples", MANIFEST_SQL + """
SELECT m.sample_id, m.annotation_hash, d.lang AS human_final, CASE WHEN d.doc_id % 3 = 0 THEN d.source END AS pipeline_prediction, CASE WHEN d.doc_id % 4 = 0 THEN d.lang END AS review_actions
FROM man m JOIN documents d ON m.sample_id = concat('doc_', CAST(d.doc_id AS STRING)) WHERE m.reviewed""")
def _(t):
    man = D.build_manifest(*manifest_inputs(t))
    sid = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("sample_id")
    human = t.documents.select(sid, F.col("lang").alias("body"))
    pred = t.documents.where("doc_id % 3 = 0").select(sid, F.col("source").alias("body"))
    acts = t.documents.where("doc_id % 4 = 0").select(sid, F.col("lang").alias("body"))
    none = t.documents.where("false").select(sid, F.col("lang").alias("body"))
    out = D.export_samples(man, human, pred, none, acts)
    return out.select("sample_id", "annotation_hash", "human_final", "pipeline_prediction", "review_actions")


FAMILY = """
fam AS (SELECT sample_id, CASE WHEN regexp_extract(annotation_file, '[0-9]{12}') <> '' THEN regexp_extract(annotation_file, '[0-9]{12}') ELSE sample_id END AS family FROM manifest),
ranks AS (SELECT family, row_number() OVER (ORDER BY md5(concat('7:', family)), family) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT family FROM fam) f),
assigned AS (SELECT sample_id, family, CASE WHEN n = 1 OR r < floor(n * 0.7 + 0.5) THEN 'train' WHEN r < floor(n * 0.7 + 0.5) + floor(n * 0.15 + 0.5) THEN 'validation' ELSE 'test' END AS split
  FROM fam JOIN ranks USING (family))"""


@query("family_key", "WITH " + FAMILY + " SELECT sample_id, family FROM fam")
def _(t):
    return t.manifest.select("sample_id", D.family_key(F.col("annotation_file"), F.col("sample_id")).alias("family"))


@query("assign_splits", "WITH " + FAMILY + " SELECT sample_id, family, split FROM assigned")
def _(t):
    return D.assign_splits(t.manifest, seed=7)


@query("write_samples", "WITH " + FAMILY + " SELECT sample_id, family, split FROM assigned")
def _(t):
    path = f"{shared_folder(t.spark).rstrip('/')}/samples-{uuid.uuid4().hex}"
    A.write_samples(D.assign_splits(t.manifest, seed=7), path)
    return t.spark.read.parquet(path).select("sample_id", "family", "split")


@query("split_leakage", "WITH " + FAMILY + """
SELECT family, count(DISTINCT split) AS n_splits FROM (
  SELECT family, CASE WHEN family LIKE '20240000%1' AND sample_id LIKE 'shot_1%' THEN 'test' ELSE split END AS split FROM assigned) t GROUP BY family HAVING count(DISTINCT split) > 1""")
def _(t):
    a = D.assign_splits(t.manifest, seed=7)
    moved = F.col("family").like("20240000%1") & F.col("sample_id").like("shot_1%")
    return D.split_leakage(a.withColumn("split", F.when(moved, "test").otherwise(F.col("split"))))


@query("baseline_from_predictions", """
SELECT a.image_id, CAST(count(*) AS BIGINT) AS drafts, CAST(0 AS BIGINT) AS differences FROM preds a GROUP BY a.image_id""")
def _(t):
    none = F.lit(None)
    pred = t.preds.select(
        "image_id", "box_id", F.lit("b").alias("type"), F.lit("").alias("text"), none.cast("string").alias("semantic_role"),
        none.cast("array<string>").alias("children"), "x", "y", "w", "h",
    )
    draft, _, diff = D.baseline_from_predictions(pred)
    drafts = draft.groupBy("image_id").agg(F.count(F.lit(1)).alias("drafts"))
    n = diff.groupBy("image_id").agg(F.count(F.lit(1)).alias("differences"))
    return drafts.join(n, "image_id", "left").fillna(0)


RARE = """
freq AS (SELECT t AS type, count(*) AS n FROM (SELECT CASE WHEN p % 400 = 0 THEN concat('rare', CAST(q AS STRING)) ELSE type END AS t, image_id FROM boxes) b GROUP BY t)"""


def rare_elements(t):
    kind = F.when(F.col("p") % 400 == 0, F.concat(F.lit("rare"), F.col("q").cast("string"))).otherwise(F.col("type"))
    return t.boxes.select("image_id", kind.alias("type"))


@query("type_frequency", "WITH " + RARE + " SELECT type, n, n >= 30 AS meets_threshold FROM freq")
def _(t):
    return D.type_frequency(rare_elements(t))


PRIORITY = "WITH " + RARE + """,
pq AS (SELECT image_id, floor(coalesce(sum(CASE WHEN n < 30 THEN 1.0 / n END), 0) * 1000 + 0.5) / 1000 AS score, coalesce(string_agg(CASE WHEN n < 30 THEN type END, ',' ORDER BY type), '') AS types
  FROM (SELECT DISTINCT image_id, CASE WHEN p % 400 = 0 THEN concat('rare', CAST(q AS STRING)) ELSE type END AS type FROM boxes) b JOIN freq USING (type) GROUP BY image_id)"""


@query("priority_queue", PRIORITY + " SELECT image_id, CAST(score AS DOUBLE) AS score, types FROM pq")
def _(t):
    e = rare_elements(t)
    return D.priority_queue(e, D.type_frequency(e))


@query("global_top_k", PRIORITY + " SELECT image_id, CAST(score AS DOUBLE) AS score FROM pq ORDER BY score DESC, image_id LIMIT 10")
def _(t):
    from screenlake.operators.layout import global_top_k

    e = rare_elements(t)
    q = D.priority_queue(e, D.type_frequency(e)).select("image_id", "score")
    return global_top_k(q, [F.desc("score"), "image_id"], 10)
