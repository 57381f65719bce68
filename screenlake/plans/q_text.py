"""Queries over rule tables, requests and text mining."""

import re

from pyspark.sql import functions as F

from screenlake.functions import rulebook as RB
from screenlake.operators import entities as E, rules as Q
from screenlake.plans.q_geometry import r6
from screenlake.plans.registry import query


# --- oracle helpers: spell rule lists as SQL ------------------------------------------
def lit(s):
    return "'" + s.replace("'", "''") + "'"


def hit(text, pattern):
    return f"regexp_matches({text}, {lit(pattern)})"


def case(text, rules, default="NULL"):
    return "CASE " + " ".join(f"WHEN {hit(text, p)} THEN {lit(n)}" for n, p in rules) + f" ELSE {default} END"


def any_word(text, values):
    return "(" + " OR ".join(f"contains({text}, {lit(v)})" for v in values) + ")"


def lookup(key, table):
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table) + " END"


def sql_list(values):
    return "[" + ", ".join(map(lit, values)) + "]"


def in_list(values):
    return "(" + ", ".join(map(lit, values)) + ")"


# --- requests --------------------------------------------------------------------------
def requests(t):
    return t.intents.withColumn("skills", F.split("skills", ","))


SKILLS = "CASE " + " ".join(f"WHEN {any_word('lower(intent)', k)} THEN {sql_list(s)}" for k, s in RB.INTENT_SKILLS) + f" ELSE {sql_list(RB.DEFAULT_SKILLS)} END"


@query("route_intent", f"""
WITH a AS (SELECT *, CASE WHEN request_id % 9 = 0 THEN ['ocr', 'bogus'] WHEN request_id % 9 = 1 THEN ['bogus'] END AS requested FROM intents),
b AS (SELECT *, CASE WHEN requested IS NOT NULL THEN {sql_list(RB.DEFAULT_SKILLS)} ELSE {SKILLS} END AS base,
   has_target OR {any_word('lower(intent)', RB.SKIP_SUMMARY_WORDS)} AS skip, has_target OR {any_word('lower(intent)', RB.NEED_OCR_WORDS)} AS need FROM a),
c AS (SELECT *, CASE WHEN skip THEN list_filter(base, lambda s: s <> 'summary') ELSE base END AS trimmed FROM b),
d AS (SELECT *, CASE WHEN request_id % 9 = 0 THEN ['ocr'] WHEN need AND NOT list_contains(trimmed, 'ocr') THEN list_append(trimmed, 'ocr') ELSE trimmed END AS sk FROM c)
SELECT request_id, array_to_string(CASE WHEN list_contains(sk, 'summary') AND NOT list_contains(sk, 'ocr') THEN list_append(sk, 'ocr') ELSE sk END, ',') AS skills FROM d""")
def _(t):
    asked = F.when(F.col("request_id") % 9 == 0, F.array(F.lit("ocr"), F.lit("bogus"))).when(F.col("request_id") % 9 == 1, F.array(F.lit("bogus")))
    rows = t.intents.drop("skills").withColumn("requested", asked)
    return Q.route_intent(rows).select("request_id", F.array_join("skills", ",").alias("skills"))


def scenarios(t):
    cat = F.when(F.col("request_id") % 5 == 0, "screenshot").when(F.col("request_id") % 5 == 1, "document").otherwise("photo")
    return Q.detect_scenario(t.intents.withColumn("category", cat))


CATEGORY = "CASE request_id % 5 WHEN 0 THEN 'screenshot' WHEN 1 THEN 'document' ELSE 'photo' END"
SCENARIO = "CASE " + " ".join(
    f"WHEN {any_word('lower(intent)', k)} OR {CATEGORY} IN {in_list(c)} THEN {lit(n)}" for n, _, k, c in RB.SCENARIOS
) + " WHEN has_boxes OR has_target THEN 'requirement' ELSE 'general' END"


@query("detect_scenario", f"SELECT request_id, scenario, scenario <> 'general' AS skip_summary FROM (SELECT request_id, {SCENARIO} AS scenario FROM intents) t")
def _(t):
    return scenarios(t).select("request_id", "scenario", "skip_summary")


@query("wants_key_content", f"""
SELECT request_id, has_target OR regexp_matches(intent, {lit(RB.MARKED_INTENT)}) OR (has_boxes AND (contains(skills, 'ocr') OR contains(skills, 'summary'))) AS wants_key_content FROM intents""")
def _(t):
    return Q.wants_key_content(requests(t)).select("request_id", "wants_key_content")


ALIAS = "CASE " + " ".join(f"WHEN lower(target_color) IN {in_list(v)} THEN {lit(n)}" for n, v in RB.COLOR_ALIASES) + " END"


@query("requested_color", f"SELECT request_id, coalesce({ALIAS}, {case('lower(intent)', RB.COLOR_INTENT)}) AS color FROM intents")
def _(t):
    return Q.requested_color(requests(t)).select("request_id", "color")


@query("tag_first_match", f"SELECT image_id, box_id, {case('lower(text)', RB.SCENE_WORDS)} AS scene FROM ocr_items")
def _(t):
    return Q.tag_first_match(t.ocr_items, "text", RB.SCENE_WORDS, None, "scene").select("image_id", "box_id", "scene")


@query("refine_scene", f"SELECT conv_id, turn, {case('lower(text)', RB.SCENE_WORDS)} AS scene FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", Q.refine_scene(F.col("text")).alias("scene"))


LEVEL = "CASE " + " ".join(f"WHEN {hit('lower(text)', p)} THEN {i}" for i, (_, p) in enumerate(RB.CODE_LANGUAGES)) + " END"


@query("tag_groups", f"""
SELECT image_id, coalesce({sql_list([n for n, _ in RB.CODE_LANGUAGES])}[min({LEVEL}) + 1], 'unknown') AS language FROM ocr_items GROUP BY image_id""")
def _(t):
    return Q.tag_groups(t.ocr_items, ["image_id"], "text", RB.CODE_LANGUAGES, "unknown", "language")


CLS_TEXT = "concat(text, CASE q % 7 WHEN 0 THEN ' receipt 小票' WHEN 1 THEN ' Bar Chart 柱状' WHEN 2 THEN ' def main (x): print (x)' WHEN 3 THEN ' 占比 30%' WHEN 4 THEN ' SELECT a FROM b' WHEN 5 THEN ' report 报告' ELSE '' END)"
CLS_CAT = "CASE p % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'chart' WHEN 2 THEN 'table' ELSE 'ui' END"


@query("text_classifiers", f"""
SELECT image_id, box_id, coalesce({case('t', RB.DOCUMENT_TYPES)}, CASE WHEN c = 'document' THEN {case('t', RB.DOCUMENT_TYPES_IF_DOCUMENT)} END, 'generic') AS document_type,
       CASE WHEN c = 'table' THEN c ELSE coalesce({case('t', RB.CHART_TYPES)}, CASE WHEN c = 'chart' THEN CASE WHEN regexp_matches(t, '%|百分比|占比') THEN 'pie' ELSE 'bar' END END, 'unknown') END AS chart_type,
       {case('t', RB.CODE_LANGUAGES, "'unknown'")} AS code_language
FROM (SELECT image_id, box_id, lower({CLS_TEXT}) AS t, {CLS_CAT} AS c FROM ocr_items) x""")
def _(t):
    rows = t.ocr_items.withColumn("t", F.expr(CLS_TEXT)).withColumn("c", F.expr(CLS_CAT))
    return rows.select(
        "image_id", "box_id", Q.document_type(F.col("t"), F.col("c")).alias("document_type"),
        Q.chart_type(F.col("t"), F.col("c")).alias("chart_type"), Q.code_language(F.col("t")).alias("code_language"),
    )


@query("scene_vote", f"""
WITH r AS (SELECT request_id, {CATEGORY} AS category, {SCENARIO} AS scenario, scene_hint, intent FROM intents),
s AS (SELECT request_id, 0 AS i, {lookup('category', RB.CLASS_SCENE)} AS scene, 0.7 AS conf, concat('classify=', category) AS reason FROM r
  UNION ALL SELECT request_id, 1, {lookup('scenario', RB.SCENARIO_SCENE)}, 0.9, concat('scenario=', scenario) FROM r
  UNION ALL SELECT request_id, 2, scene_hint, 0.8, concat('scene-hint=', scene_hint) FROM r
  UNION ALL SELECT request_id, 3, {case('lower(intent)', RB.SCENE_WORDS)}, 0.9, concat({case('lower(intent)', RB.SCENE_WORDS)}, ' keywords') FROM r),
b AS (SELECT request_id, scene, max(conf) AS conf, min(i) AS i, arg_min(reason, -conf * 10 + i * 0.01) AS reason FROM s WHERE scene IS NOT NULL GROUP BY request_id, scene),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY conf DESC, i) AS rk FROM b)
SELECT r.request_id, coalesce(k.scene, 'other') AS scene, CAST(coalesce(k.conf, 0) AS DOUBLE) AS scene_confidence, coalesce(k.reason, 'no signal') AS scene_reason
FROM r LEFT JOIN k ON k.request_id = r.request_id AND k.rk = 1""")
def _(t):
    v = Q.scene_vote(scenarios(t).withColumn("text", F.col("intent")))
    return v.select("request_id", "scene", "scene_confidence", "scene_reason")


# each document gets one of the known scenes or an unknown one
SCENES = [name for name, _ in RB.NEXT_ACTIONS] + ["unknown"]


@query("next_actions", f"""
WITH a(place, scene, actions) AS (VALUES {', '.join(f"({i}, {lit(name)}, {lit(','.join(dict(RB.NEXT_ACTIONS).get(name, RB.DEFAULT_ACTIONS)))})" for i, name in enumerate(SCENES))})
SELECT doc_id, scene, actions FROM documents JOIN a ON place = doc_id % {len(SCENES)}""")
def _(t):
    scene = F.get(F.array(*map(F.lit, SCENES)), (F.col("doc_id") % len(SCENES)).cast("int"))
    docs = t.documents.select("doc_id", scene.alias("scene"))
    return docs.withColumn("actions", F.array_join(Q.next_actions(F.col("scene")), ","))


RULE_COLS = "request_id, request_id % 5000 AS image_width, CAST(value * 1000000 AS BIGINT) AS image_size, request_id % 3000 AS memory_mb, quality, intent"


@query("apply_rule_table", """
SELECT request_id, CASE WHEN sz > 52428800 THEN 'reject-huge' WHEN mem < 1024 THEN 'memory-guard' WHEN quality = 'fast' AND w >= 400 THEN 'fast-lane' WHEN w > 3000 THEN 'large-image-resize' END AS rule,
       CASE WHEN sz > 52428800 THEN 'deny' WHEN mem < 1024 THEN 'warn' ELSE 'allow' END AS action,
       CASE WHEN sz > 52428800 THEN NULL WHEN mem < 1024 THEN '' WHEN quality = 'fast' AND w >= 400 THEN 'skip' WHEN w > 3000 THEN 'resize' END AS override
FROM (SELECT request_id, request_id % 5000 AS w, CAST(value * 1000000 AS BIGINT) AS sz, request_id % 3000 AS mem, quality FROM intents) t""")
def _(t):
    rows = t.intents.selectExpr(*RULE_COLS.split(", ")[:1], "request_id % 5000 AS image_width", "CAST(value * 1000000 AS BIGINT) AS image_size", "request_id % 3000 AS memory_mb", "quality")
    rules = [*RB.POLICIES, ("fast-lane", 50, {"quality": "== fast", "image_width": ">= 400"}, "allow", "skip")]
    return Q.apply_rule_table(rows, rules).select("request_id", "rule", "action", "override")


PROVIDERS = [
    Q.Provider("tiny", "onnx", "fast", 800, False, ("classify", "describe")),
    Q.Provider("mid", "llama-cpp", "fast", 2000, False, ("classify", "ocr", "summary")),
    Q.Provider("big", "llama-cpp", "high", 4000, True, ("classify", "ocr", "summary", "describe")),
    Q.Provider("reader", "onnx", "fast", 500, False, ("ocr",)),
]


@query("choose_candidate", """
WITH p AS (SELECT * FROM (VALUES (1, 'tiny', 'onnx', 'fast', 800, FALSE, ['classify', 'describe']), (2, 'mid', 'llama-cpp', 'fast', 2000, FALSE, ['classify', 'ocr', 'summary']),
  (3, 'big', 'llama-cpp', 'high', 4000, TRUE, ['classify', 'ocr', 'summary', 'describe']), (4, 'reader', 'onnx', 'fast', 500, FALSE, ['ocr'])) v(i, name, runtime, pq, mem, gpu, sk)),
r AS (SELECT request_id, string_split(skills, ',') AS skills, CASE WHEN request_id % 3 = 0 THEN 'high' ELSE 'fast' END AS quality, CASE request_id % 8 WHEN 0 THEN 'mid' WHEN 1 THEN 'big' END AS provider,
  (request_id % 10) * 600 AS memory_mb, request_id % 2 = 0 AS has_gpu FROM intents),
f AS (SELECT r.*, p.* FROM r JOIN p ON r.memory_mb >= p.mem AND (NOT p.gpu OR r.has_gpu) AND list_has_all(p.sk, r.skills)),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN provider IS NOT NULL THEN CASE WHEN name = provider THEN 0 ELSE 9 END WHEN quality = 'high' AND pq = 'high' THEN 1 WHEN len(sk) = len(skills) THEN 2 WHEN pq = 'fast' THEN 3 ELSE 4 END, i) AS rk FROM f)
SELECT r.request_id, CASE WHEN r.provider IS NULL OR k.name = r.provider THEN k.name END AS chosen,
       CASE WHEN k.name IS NULL THEN 'no provider satisfies the requested skills and resources' WHEN r.provider <> k.name THEN concat('requested provider is unavailable or infeasible: ', r.provider) END AS error
FROM r LEFT JOIN k ON k.request_id = r.request_id AND k.rk = 1""")
def _(t):
    r = requests(t).drop("quality").select(
        "request_id", "skills", F.when(F.col("request_id") % 3 == 0, "high").otherwise("fast").alias("quality"),
        F.when(F.col("request_id") % 8 == 0, "mid").when(F.col("request_id") % 8 == 1, "big").alias("provider"),
        (F.col("request_id") % 10 * 600).alias("memory_mb"), (F.col("request_id") % 2 == 0).alias("has_gpu"),
    )
    return Q.choose_candidate(r, PROVIDERS).select("request_id", "chosen", "error")


@query("build_prompts", """
SELECT conv_id * 1000 + turn AS request_id, concat('Describe ', lang, ' ', CAST(length(text) AS STRING), 'x7 low.', CASE WHEN turn % 2 = 0 THEN concat(chr(10), chr(10), 'Focus on: color=red') ELSE '' END,
   concat(chr(10), chr(10), 'OCR context from a dedicated OCR provider:', chr(10), CASE WHEN length(text) > 2000 THEN concat(substring(text, 1, 2000), chr(10), '...[truncated, OCR total ', CAST(length(text) AS STRING), ' chars]') ELSE text END),
   CASE WHEN turn % 3 = 0 THEN concat(chr(10), chr(10), 'IMPORTANT: Your previous response was missing the required field "description". Include ALL required fields.') ELSE '' END) AS prompt
FROM (SELECT *, role AS lang FROM conversations WHERE text <> '') c""")
def _(t):
    rows = t.conversations.where("text <> ''").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.lit("summary").alias("skill"), F.col("role").alias("intent"),
        F.when(F.col("turn") % 2 == 0, "color=red").alias("focus"), F.length("text").alias("width"), F.lit(7).alias("height"),
        F.lit("png").alias("format"), F.lit("low").alias("complexity"), F.col("text").alias("ocr_text"),
        F.when(F.col("turn") % 3 == 0, "missing required field: description").alias("last_error"),
    )
    template = {"summary": "Describe {{intent}} {{metadata.width}}x{{metadata.height}} {{metadata.complexity}}."}
    return Q.build_prompts(rows, template, RB.OCR_CONTEXT_CHARS).select("request_id", "prompt")


@query("quality_suggestion", """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND (length(text) > 1500 OR doc_id % 3 = 0) THEN concat('Complex image detected (', CASE WHEN length(text) > 1500 THEN 'text-dense' ELSE '' END,
   CASE WHEN length(text) > 1500 AND doc_id % 3 = 0 THEN ', ' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'large-image' ELSE '' END, '). Retry with options.quality="high" for more accurate results.') END AS suggestion FROM documents""")
def _(t):
    rows = t.documents.select(
        "doc_id", F.col("text").alias("ocr_text"), F.when(F.col("doc_id") % 3 == 0, 3000).otherwise(300).alias("width"), F.lit(1000).alias("height"),
        F.when(F.col("doc_id") % 4 == 0, "high").alias("quality"),
    )
    return Q.quality_suggestion(rows).select("doc_id", "suggestion")


EVIDENCE = "CASE q % 8 WHEN 0 THEN 'a dragon and a knight' WHEN 1 THEN 'vivid glowing portrait of a girl and a boy' WHEN 2 THEN 'a flowchart with boxes' WHEN 3 THEN 'python code in an editor' WHEN 4 THEN '菜单 管理' WHEN 5 THEN 'an invoice' WHEN 6 THEN '' ELSE 'kpi dashboard' END"
CCAT = "CASE p % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'photo' WHEN 2 THEN 'other' WHEN 3 THEN 'screenshot' WHEN 4 THEN 'ui' ELSE 'illustration' END"


def _infer_sql(t):
    n = len(RB.CATEGORY_WORDS)
    mood, fig = f"len(regexp_extract_all({t}, {lit(RB.MOOD_WORDS)}))", f"len(regexp_extract_all({t}, {lit(RB.FIGURE_WORDS)}))"
    cat = f"CASE WHEN {mood} > 0 AND {fig} > 0 THEN 'illustration' ELSE {case(t, RB.CATEGORY_WORDS)} END"
    conf = f"CASE WHEN {mood} > 0 AND {fig} > 0 THEN least(0.65, 0.5 + least(0.03 * ({mood} + {fig}), 0.15)) "
    for i, (_, p) in enumerate(RB.CATEGORY_WORDS):
        groups = 1 + len(re.findall(r"(?<!\\)\((?!\?)", p))
        conf += f"WHEN {hit(t, p)} THEN {min(0.5 + min(groups * 0.05, 0.2) + (n - i) * 0.02, 0.75)!r} "
    return cat, conf + "END"


_CAT, _CONF = _infer_sql("ev")
EXCL = "CASE category " + " ".join(f"WHEN {lit(n)} THEN inf IN {in_list(v)}" for n, v in RB.EXCLUSIONS) + " END"


@query("correct_category", f"""
WITH o AS (SELECT image_id, box_id, {CCAT} AS category, CASE WHEN p % 5 = 0 THEN 0.7 ELSE 0.9 END AS confidence, {EVIDENCE} AS ev, p % 11 = 0 AS has_ui FROM boxes),
i AS (SELECT *, {_CAT} AS inf, {_CONF} AS iconf, {EXCL.replace('inf IN', f'({_CAT}) IN')} AS ex FROM o)
SELECT image_id, box_id, CASE WHEN has_ui AND category IN ('document', 'other', 'screenshot') THEN 'ui' WHEN ev <> '' AND coalesce(ex, FALSE) THEN inf ELSE category END AS new_category,
  round(CASE WHEN has_ui AND category IN ('document', 'other', 'screenshot') THEN greatest(confidence, 0.75) WHEN ev <> '' AND coalesce(ex, FALSE) THEN iconf
       WHEN ev <> '' AND category <> 'ui' AND inf = category THEN CASE WHEN confidence = 0.7 THEN 0.65 ELSE confidence END
       WHEN ev <> '' AND category <> 'ui' THEN 0.5 WHEN ev = '' AND category = 'document' THEN 0.5 ELSE confidence END, 6) AS new_confidence FROM i""")
def _(t):
    rows = t.boxes.select(
        "image_id", "box_id", F.expr(CCAT).alias("category"), F.when(F.col("p") % 5 == 0, 0.7).otherwise(0.9).alias("confidence"),
        F.expr(EVIDENCE).alias("summary"), F.lit("").alias("ocr_text"), (F.col("p") % 11 == 0).alias("has_ui"),
    )
    return Q.correct_category(rows).select("image_id", "box_id", "new_category", r6(F.col("new_confidence"), "new_confidence"))


PRESET = "CASE " + " ".join(f"WHEN {c} THEN {lit(n)}" for n, c in RB.COLOR_PRESETS) + " ELSE 'none' END"


@query("color_class", f"SELECT image_id, color, count(*) AS n FROM (SELECT image_id, {PRESET} AS color FROM samples) t GROUP BY image_id, color")
def _(t):
    return Q.color_class(t.samples).groupBy("image_id", "color").agg(F.count(F.lit(1)).alias("n"))


@query("annotation_stats", """
WITH s AS (SELECT image_id, CAST(x AS INT) AS px, CAST(y AS INT) AS py, CASE p % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'none' END AS color FROM boxes),
b AS (SELECT image_id, box_id AS region_id, CASE q % 2 WHEN 0 THEN 'red' ELSE 'blue' END AS color, CAST(x AS INT) AS x1, CAST(y AS INT) AS y1, CAST(x + w AS INT) AS x2, CAST(y + h AS INT) AS y2 FROM boxes),
n AS (SELECT b.image_id, b.region_id, count(*) AS colored, count(CASE WHEN px - x1 < 5 OR x2 - px <= 5 OR py - y1 < 5 OR y2 - py <= 5 THEN 1 END) AS edge
  FROM b JOIN s ON s.image_id = b.image_id AND s.color = b.color AND px >= x1 AND px < x2 AND py >= y1 AND py < y2 GROUP BY b.image_id, b.region_id),
v AS (SELECT b.*, coalesce(colored, 0) AS colored, coalesce(edge, 0) AS edge, CAST(x2 - x1 AS DOUBLE) * (y2 - y1) AS area, CAST(greatest(0, x2 - x1 - 10) AS DOUBLE) * greatest(0, y2 - y1 - 10) AS inn FROM b LEFT JOIN n USING (image_id, region_id))
SELECT image_id, region_id, colored, edge AS edge_colored, round(colored / area, 6) AS fill, round(edge / (area - inn), 6) AS density,
  round(least(greatest(0, 1 - colored / area * 4) * 0.4 + CASE WHEN colored > 0 THEN CAST(edge AS DOUBLE) / colored ELSE 0 END * 0.4 + least(edge / (area - inn) / 0.5, 1) * 0.2, 0.99), 6) AS confidence FROM v""")
def _(t):
    b = t.boxes
    s = b.select("image_id", F.col("x").cast("int").alias("px"), F.col("y").cast("int").alias("py"), F.when(F.col("p") % 3 == 0, "red").when(F.col("p") % 3 == 1, "blue").otherwise("none").alias("color"))
    r = b.select(
        "image_id", F.col("box_id").alias("region_id"), F.when(F.col("q") % 2 == 0, "red").otherwise("blue").alias("color"), F.col("x").cast("int").alias("x1"),
        F.col("y").cast("int").alias("y1"), (F.col("x") + F.col("w")).cast("int").alias("x2"), (F.col("y") + F.col("h")).cast("int").alias("y2"),
    )
    a = Q.annotation_stats(s, r)
    return a.select("image_id", "region_id", "colored", "edge_colored", *(r6(F.col(c), c) for c in ("fill", "density", "confidence")))


# --- entities --------------------------------------------------------------------------
ENT_TEXT = "concat(text, ' call 13912345678 or mail ', lang, '.x@ex.org; see https://ex.org/d/', CAST(doc_id AS STRING), ' on 2024-05-', CAST(10 + doc_id % 19 AS STRING), ' and 2024-05-11')"


def ent_hits(text):
    parts = []
    for i, (kind, pattern) in enumerate(RB.ENTITY_PATTERNS):
        parts.append(f"SELECT doc_id, {i} AS t, '{kind}' AS type, unnest(m) AS value, generate_subscripts(m, 1) AS ix FROM (SELECT doc_id, regexp_extract_all({text}, {lit(pattern)}) AS m FROM documents) x")
    return " UNION ALL ".join(parts)


ENTITIES = f"""
WITH h AS ({ent_hits(ENT_TEXT)}),
f AS (SELECT doc_id, t, type, value, min(ix) AS ix FROM h GROUP BY doc_id, t, type, value),
ents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY t, ix) - 1 AS pos, type, value FROM f)"""


def doc_entities(t):
    return E.extract_entities(t.documents.select("doc_id", F.expr(ENT_TEXT).alias("text")), "doc_id", "text")


@query("extract_entities", ENTITIES + " SELECT doc_id, CAST(pos AS INT) AS pos, type, value FROM ents")
def _(t):
    return doc_entities(t).select("doc_id", "pos", "type", "value")


@query("entity_index", ENTITIES + " SELECT type, value, count(DISTINCT doc_id) AS n_docs, count(*) AS n_mentions FROM h GROUP BY type, value")
def _(t):
    return E.entity_index(E.entity_mentions(t.documents.select("doc_id", F.expr(ENT_TEXT).alias("text")), "doc_id", "text"), "doc_id")


def item_hits():
    parts = []
    for i, (kind, pattern) in enumerate(RB.ENTITY_PATTERNS):
        parts.append(f"SELECT image_id, box_id, {i} AS t, '{kind}' AS type, unnest(regexp_extract_all(text, {lit(pattern)})) AS value FROM ocr_items")
    return " UNION ALL ".join(parts)


@query("extract_item_entities", f"""
WITH h AS ({item_hits()}), f AS (SELECT image_id, t, type, value, min(box_id) AS o FROM h GROUP BY image_id, t, type, value)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY t, o) AS INT) AS rank, type, value FROM f""")
def _(t):
    return E.extract_item_entities(t.ocr_items.withColumnRenamed("box_id", "ord"))


@query("flow_relations", """
SELECT c.image_id, CASE WHEN f.p % 6 = 0 THEN CAST(c.parent_n AS STRING) ELSE f.type END AS "from", CASE WHEN c.p % 6 = 0 THEN CAST(c.n AS STRING) ELSE c.type END AS "to", 'flow' AS type
FROM tree_nodes c JOIN tree_nodes f ON f.image_id = c.image_id AND f.n = c.parent_n""")
def _(t):
    n = t.tree_nodes.select("image_id", F.col("n").alias("id"), F.when(F.col("p") % 6 == 0, "").otherwise(F.col("type")).alias("label"))
    e = t.tree_nodes.where("parent_n IS NOT NULL").select("image_id", F.col("n").alias("ord"), F.col("parent_n").cast("long").alias("src"), F.col("n").cast("long").alias("dst"))
    return E.flow_relations(n.withColumn("id", F.col("id").cast("long")), e).select("image_id", "from", "to", "type")


@query("logic_facts", f"""
WITH c AS (SELECT image_id, min(box_id) AS ord, t AS condition FROM (SELECT image_id, box_id, CASE p % 9 WHEN 0 THEN 'Yes' WHEN 1 THEN '否' ELSE text END AS t FROM ocr_items) x WHERE regexp_matches(lower(t), '^(是|否|yes|no|true|false|成功|失败|通过|不通过)$') GROUP BY image_id, t),
d AS (SELECT image_id, CASE WHEN max(y+h/2)-min(y+h/2) > 1.3*(max(x+w/2)-min(x+w/2)) THEN 'top-down' WHEN max(x+w/2)-min(x+w/2) > 1.3*(max(y+h/2)-min(y+h/2)) THEN 'left-right' ELSE 'unknown' END AS direction FROM boxes GROUP BY image_id),
l AS (SELECT image_id, 'sql' AS language, count(*) AS n FROM boxes WHERE type = 'text' GROUP BY image_id)
SELECT image_id, fact FROM (SELECT image_id, concat('分支条件: ', condition) AS fact FROM c UNION ALL SELECT image_id, concat('流向: ', direction) FROM d WHERE direction <> 'unknown'
  UNION ALL SELECT image_id, '语言: sql' FROM l UNION ALL SELECT image_id, concat('代码行数: ', CAST(n AS STRING)) FROM l) u""")
def _(t):
    from screenlake.operators.layout import flow_direction

    text = F.when(F.col("p") % 9 == 0, "Yes").when(F.col("p") % 9 == 1, "否").otherwise(F.col("text"))
    cond = E.branch_conditions(t.ocr_items.select("image_id", F.col("box_id").alias("ord"), text.alias("text")))
    lang = t.boxes.where("type = 'text'").groupBy("image_id").agg(F.lit("sql").alias("language"), F.count(F.lit(1)).alias("line_count"))
    return E.logic_facts(cond, flow_direction(t.boxes), lang).select("image_id", "fact")


GROUP_SQL = f"""CASE WHEN {hit('text', RB.GROUP_DATE)} THEN 'dates' WHEN {hit('text', RB.GROUP_BUTTON)} THEN 'buttons' WHEN {hit('text', RB.GROUP_HINT)} THEN 'hints'
  WHEN {hit('text', RB.GROUP_LABEL)} THEN 'formLabels' WHEN y < my * 0.15 AND length(text) <= 20 THEN 'headers' WHEN {hit('text', RB.GROUP_VALUE)} OR contains(text, '日期') THEN 'values' ELSE 'other' END"""


@query("semantic_groups", f"""
SELECT image_id, "group", text, min(box_id) AS ord FROM (SELECT o.image_id, box_id, text, {GROUP_SQL} AS "group" FROM ocr_items o JOIN (SELECT image_id, max(y + h) AS my FROM ocr_items GROUP BY image_id) m ON m.image_id = o.image_id) t
GROUP BY image_id, "group", text""")
def _(t):
    return E.semantic_groups(t.ocr_items.withColumnRenamed("box_id", "ord")).select("image_id", "group", "text", "ord")


UI_TEXT = "CASE q % 9 WHEN 0 THEN concat('菜单管理', CAST(p % 5 AS STRING)) WHEN 1 THEN '编辑' WHEN 2 THEN concat('价格', CAST(p % 7 AS STRING)) WHEN 3 THEN CAST(p AS STRING) ELSE text END"
MOB_TEXT = "CASE q % 4 WHEN 0 THEN concat('双拼比萨', CAST(p % 9 AS STRING)) WHEN 1 THEN '12:30' WHEN 2 THEN CASE WHEN p % 5 = 0 THEN '商品详情' WHEN p % 40 = 1 THEN '详情' ELSE '加入' END ELSE '配料' END"
EV_TEXT = f"CASE WHEN image_id % 3 = 0 THEN {MOB_TEXT} WHEN image_id % 3 = 1 THEN {UI_TEXT} ELSE 'plain' END"

_ADMIN = [("navigation", RB.UI_NAV), ("actions", RB.UI_ACTION), ("fields", RB.UI_FIELD), ("tableHeaders", RB.UI_FIELD), ("values", RB.UI_VALUE), ("modules", RB.UI_MODULE)]
_PHONE = [("navigation", RB.MOBILE_NAV), ("actions", RB.MOBILE_ACTION), ("fields", RB.MOBILE_FIELD), ("values", RB.MOBILE_VALUE), ("modules", RB.MOBILE_MODULE)]


UI_EVIDENCE = f"""
WITH l AS (SELECT image_id, box_id, {EV_TEXT} AS text FROM ocr_items),
s AS (SELECT image_id, count(*) AS n, count(CASE WHEN {hit('text', RB.MOBILE_PRODUCT)} THEN 1 END) AS product, count(CASE WHEN {hit('lower(text)', RB.MOBILE_ADMIN)} THEN 1 END) AS adm,
  count(CASE WHEN {hit('lower(text)', RB.UI_SIGNAL)} THEN 1 END) AS sig, count(CASE WHEN {hit('text', RB.MOBILE_STATUS)} THEN 1 END) AS st, count(CASE WHEN contains(text, '详情') THEN 1 END) AS ti, count(DISTINCT CASE WHEN {hit('text', RB.MOBILE_FIELD)} THEN text END) AS fi FROM l GROUP BY image_id),
k AS (SELECT image_id, CASE WHEN product >= 4 AND adm < 3 AND (st > 0 OR ti > 0 OR fi >= 4) THEN 'mobile-ui' WHEN sig >= 4 THEN 'admin-ui' END AS page_type FROM s WHERE n >= 8),
h AS ({' UNION ALL '.join(f"SELECT l.image_id, page_type, '{f}' AS field, box_id, text FROM l JOIN k USING (image_id) WHERE page_type = 'admin-ui' AND {hit('lower(text)', p)}" for f, p in _ADMIN)}
  UNION ALL {' UNION ALL '.join(f"SELECT l.image_id, page_type, '{f}', box_id, text FROM l JOIN k USING (image_id) WHERE page_type = 'mobile-ui' AND {hit('text', p)}" for f, p in _PHONE)})
SELECT image_id, page_type, field, text, CAST(min(rk) AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY image_id, field ORDER BY box_id) AS rk FROM h) r GROUP BY image_id, page_type, field, text
UNION ALL SELECT image_id, page_type, 'title', coalesce(min(CASE WHEN text = '详情' THEN text END), arg_min(text, box_id)), 1 FROM l JOIN k USING (image_id) WHERE page_type = 'mobile-ui' AND contains(text, '详情') GROUP BY image_id, page_type"""


@query("ui_evidence", UI_EVIDENCE)
def _(t):
    return ui_evidence(t)


def ui_evidence(t):
    lines = t.ocr_items.select("image_id", F.col("box_id").alias("ord"), F.expr(EV_TEXT).alias("text"))
    return E.ui_evidence(lines).select("image_id", "page_type", "field", "text", "pos")


@query("ui_layout", f"""
WITH l AS (SELECT image_id, box_id, {UI_TEXT} AS text, x, y, w, h FROM ocr_items),
s AS (SELECT image_id, greatest(260, max(x + w) * 0.25) AS side, max(y + h) * 0.82 AS foot FROM l GROUP BY image_id HAVING count(*) >= 8),
j AS (SELECT l.*, side, foot, x <= side AS lft, EXISTS (SELECT 1 FROM l l2 WHERE l2.image_id = l.image_id AND l2.text = l.text AND l2.x <= side) AS in_side FROM l JOIN s USING (image_id)),
h AS (SELECT image_id, 'leftSidebar' AS slot, text, box_id FROM j WHERE lft UNION ALL SELECT image_id, 'footerActions', text, box_id FROM j WHERE y >= foot AND {hit('text', RB.LAYOUT_FOOTER)}
  UNION ALL SELECT image_id, 'tableHeaders', text, box_id FROM j WHERE NOT lft AND {hit('text', RB.LAYOUT_HEADER)} UNION ALL SELECT image_id, 'rowValues', text, box_id FROM j WHERE NOT lft AND {hit('text', RB.LAYOUT_VALUE)}
  UNION ALL SELECT image_id, 'rowActions', text, box_id FROM j WHERE NOT lft AND {hit('text', RB.LAYOUT_ROW_ACTION)} UNION ALL SELECT image_id, 'titleCandidates', text, box_id FROM j WHERE NOT lft AND NOT in_side AND {hit('text', RB.LAYOUT_TITLE)}),
d AS (SELECT image_id, slot, text, min(box_id) AS ord FROM h GROUP BY image_id, slot, text)
SELECT image_id, slot, text, ord FROM d""")
def _(t):
    items = t.ocr_items.select("image_id", F.col("box_id").alias("ord"), F.expr(UI_TEXT).alias("text"), "x", "y", "w", "h")
    return E.ui_layout(items).select("image_id", "slot", "text", "ord")


@query("key_topics", r"""
WITH m AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN regexp_extract_all(text, '[一-鿿]{2,4}') ELSE regexp_extract_all(text, '\b[A-Z][a-z]{2,}\b') END AS ts FROM documents),
e AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS ix FROM m),
c AS (SELECT doc_id, term, count(*) AS n, min(ix) AS ix FROM e GROUP BY doc_id, term HAVING count(*) >= 2)
SELECT doc_id, CAST(rank AS INT) AS rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ix) AS rank FROM c) t WHERE rank <= 5""")
def _(t):
    return E.key_topics(t.documents, "doc_id", "text")


BARE = r"""replace(replace(regexp_replace({0}, '[\s,，。.;；:："''“”‘’/\\|\-—_、]', '', 'g'), '（', '('), '）', ')')"""


@query("near_duplicate_text", f"""
WITH o AS (SELECT image_id, box_id, CASE WHEN p % 14 = 2 AND q % 2 = 0 THEN concat(text, '/more') ELSE text END AS text FROM ocr_items),
n AS (SELECT image_id, box_id, {BARE.format('text')} AS n FROM o)
SELECT b.image_id, b.box_id AS ord, min(a.box_id) AS dup_of FROM n a JOIN n b ON a.image_id = b.image_id AND a.box_id < b.box_id
WHERE a.n <> '' AND b.n <> '' AND (a.n = b.n OR (length(a.n) >= 8 AND length(b.n) > length(a.n) AND contains(b.n, a.n)) OR (length(b.n) >= 8 AND length(a.n) > length(b.n) AND contains(a.n, b.n)))
GROUP BY b.image_id, b.box_id""")
def _(t):
    more = (F.col("p") % 14 == 2) & (F.col("q") % 2 == 0)
    items = t.ocr_items.select("image_id", F.col("box_id").alias("ord"), F.when(more, F.concat("text", F.lit("/more"))).otherwise(F.col("text")).alias("text"))
    return E.near_duplicate_text(items)


@query("label_value_fields", """
SELECT image_id, box_id, trim(regexp_extract(text, '^([^：:]{1,20})[：:]\\s*(.+)$', 1)) AS label, trim(regexp_extract(text, '^([^：:]{1,20})[：:]\\s*(.+)$', 2)) AS value
FROM ocr_items WHERE regexp_matches(text, '^([^：:]{1,20})[：:]\\s*(.+)$') AND NOT regexp_matches(regexp_extract(text, '^([^：:]{1,20})[：:]\\s*(.+)$', 2), '[：:]')""".replace("\\\\", "\\"))
def _(t):
    return E.label_value_fields(t.ocr_items).select("image_id", "box_id", "label", "value")


CHECK_TEXT = "CASE p % 14 WHEN 0 THEN '☐' WHEN 1 THEN '☑ agree' WHEN 2 THEN '[x] terms' WHEN 3 THEN '✓' WHEN 4 THEN '□ later' ELSE text END"


@query("check_states", f"""
WITH i AS (SELECT image_id, box_id, {CHECK_TEXT} AS text, x, y, w, h, p % 14 AS k FROM ocr_items),
m AS (SELECT *, k IN (1, 2, 3) AS checked, CASE k WHEN 1 THEN 'agree' WHEN 2 THEN 'terms' WHEN 4 THEN 'later' END AS rest FROM i WHERE k <= 4),
a AS (SELECT m.image_id, m.box_id, o.text AS label, row_number() OVER (PARTITION BY m.image_id, m.box_id ORDER BY o.x, o.box_id) AS rk FROM m JOIN i o ON o.image_id = m.image_id AND o.x > m.x AND abs(o.y + o.h/2 - m.y - m.h/2) <= m.h * 0.8),
l AS (SELECT m.image_id, m.box_id, coalesce(m.rest, a.label) AS label, m.checked FROM m LEFT JOIN a ON a.image_id = m.image_id AND a.box_id = m.box_id AND a.rk = 1)
SELECT image_id, label, checked, ord FROM (SELECT image_id, label, checked, box_id AS ord, row_number() OVER (PARTITION BY image_id, label ORDER BY box_id) AS rk FROM l WHERE label IS NOT NULL) t WHERE rk = 1""")
def _(t):
    items = t.ocr_items.select("image_id", F.col("box_id").alias("ord"), F.expr(CHECK_TEXT).alias("text"), "x", "y", "w", "h")
    return E.check_states(items).select("image_id", "label", "checked", "ord")


DOC_TEXT = "concat('Invoice No: ', CAST(20240000 + p AS STRING), chr(10), 'Seller: ACME ', CAST(q AS STRING), chr(10), 'Tax: ¥', CAST(p AS STRING), '.50', chr(10), text, chr(10), 'Store: shop', CAST(q AS STRING), chr(10), 'amount 77')"


@query("document_fields", f"""
WITH d AS (SELECT box_id, {DOC_TEXT} AS text, CASE p % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' ELSE 'generic' END AS dt FROM ocr_items),
f AS ({' UNION ALL '.join(f"SELECT box_id, {i} AS pos, {lit(label)} AS label, trim(regexp_extract(text, {lit('(?i)' + p)}, 1)) AS value FROM d" + ("" if ty is None else f" WHERE dt IN {in_list(ty)}") for i, (ty, label, p) in enumerate(RB.DOCUMENT_FIELDS))})
SELECT * FROM f WHERE value <> ''""")
def _(t):
    docs = t.ocr_items.select("box_id", F.expr(DOC_TEXT).alias("text"), F.when(F.col("p") % 3 == 0, "invoice").when(F.col("p") % 3 == 1, "receipt").otherwise("generic").alias("dt"))
    return E.document_fields(docs, "box_id", "text", "dt")
