"""Queries over tables, fields, charts, code and model output."""

from pyspark.sql import functions as F

from screenlake.operators import documents as D, entities as E, outputs as O
from screenlake.plans.q_geometry import r6
from screenlake.plans.q_spatial import CODE_GAP, DOC_GAP, INTER, LINE_FOLD
from screenlake.plans.q_text import UI_EVIDENCE, hit, lit, ui_evidence
from screenlake.plans.registry import query


def items(t):
    return t.ocr_items.withColumnRenamed("box_id", "ord")


@query("line_items", "WITH " + DOC_GAP + f""",
l AS (SELECT image_id, CAST(line AS BIGINT) AS line, list(text ORDER BY y, x, box_id) AS ts FROM ln GROUP BY image_id, line),
n AS (SELECT *, list_filter(ts, lambda t: regexp_matches(t, {lit(D.NUMBER_CELL)})) AS nums, array_to_string(list_filter(ts, lambda t: NOT regexp_matches(t, {lit(D.NUMBER_CELL)})), ' ') AS description FROM l)
SELECT image_id, line, description, nums[1] AS quantity, nums[2] AS unit_price, CASE WHEN len(nums) >= 3 THEN nums[3] WHEN len(nums) = 2 THEN nums[2] END AS amount FROM n WHERE description <> ''""")
def _(t):
    return D.line_items(items(t))


BARE = r"""replace(replace(regexp_replace({0}, '[\s,，。.;；:："''“”‘’/\\|\-—_、]', '', 'g'), '（', '('), '）', ')')"""


@query("reconstruct_table", "WITH RECURSIVE " + LINE_FOLD + f""",
hd AS (SELECT image_id, list(x + w/2 ORDER BY x + w/2, box_id) AS cx, list(text ORDER BY x + w/2, box_id) AS names, count(DISTINCT CASE WHEN {BARE.format('text')} <> '' THEN {BARE.format('text')} END) AS uq FROM lined WHERE line = 0 GROUP BY image_id HAVING count(*) >= 2),
h2 AS (SELECT * FROM hd WHERE uq >= len(names) * 0.5),
b AS (SELECT l.*, names, list_position(list_transform(cx, lambda c: abs(c - (l.x + l.w/2))), list_min(list_transform(cx, lambda c: abs(c - (l.x + l.w/2))))) - 1 AS col FROM lined l JOIN h2 USING (image_id) WHERE line > 0),
fl AS (SELECT image_id, line, count(DISTINCT col) AS f, max(len(names)) AS c FROM b GROUP BY image_id, line),
ok AS (SELECT image_id FROM fl GROUP BY image_id HAVING max(f) >= 2 AND sum(f) / CAST(sum(c) AS DOUBLE) >= 0.4),
ce AS (SELECT image_id, line, col, max(names) AS names, list(text ORDER BY x + w/2, box_id) AS ts FROM b WHERE image_id IN (SELECT image_id FROM ok) GROUP BY image_id, line, col)
SELECT image_id, CAST(line - 1 AS INT) AS row, CAST(col AS INT) AS col, names[col + 1] AS header,
  array_to_string(list_filter(ts, lambda v, i: NOT (regexp_matches(v, '^[0-9]+(\\.[0-9]+)?$') AND list_contains(ts[1:i-1], v))), ' ') AS text FROM ce""".replace("\\\\.", "\\."))
def _(t):
    return D.reconstruct_table(items(t)).select("image_id", F.col("row").cast("int").alias("row"), "col", "header", "text")


# lines and their texts per (image, region), folded item by item
REGION_FOLD = f"""
rg AS (SELECT image_id, box_id AS region_id, x, y, w * 3 AS w, h * 4 AS h, p % 100 / 100.0 AS confidence FROM boxes WHERE type = 'card'),
ins AS (SELECT a.image_id, b.region_id, a.box_id, a.text, a.x, a.y, a.w, a.h FROM ocr_items a JOIN rg b ON a.image_id = b.image_id
  WHERE (a.x+a.w/2 >= b.x-4 AND a.x+a.w/2 <= b.x+b.w+4 AND a.y+a.h/2 >= b.y-4 AND a.y+a.h/2 <= b.y+b.h+4) OR ({INTER}) / (a.w*a.h) >= 0.35),
med AS (SELECT image_id, region_id, greatest(10.0, 0.6 * coalesce(nullif(list_sort(list(h))[count(*) // 2 + 1], 0), 20)) AS tol FROM ins GROUP BY image_id, region_id),
it AS (SELECT o.*, y + h/2 AS cy, x + w/2 AS cx, tol, row_number() OVER (PARTITION BY image_id, region_id ORDER BY y + h/2, x + w/2, box_id) AS k FROM ins o JOIN med USING (image_id, region_id)),
fold AS (
  SELECT image_id, region_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(y DOUBLE, n DOUBLE)[]) AS ls, CAST(0 AS BIGINT) AS line FROM med
  UNION ALL
  SELECT image_id, region_id, k, CASE WHEN coalesce(hit, 0) = 0 THEN list_append(ls, {{'y': cy, 'n': CAST(1 AS DOUBLE)}}) ELSE list_transform(ls, lambda l, i: CASE WHEN i = hit THEN {{'y': (l.y * l.n + cy) / (l.n + 1), 'n': l.n + 1}} ELSE l END) END,
         CASE WHEN coalesce(hit, 0) = 0 THEN len(ls) ELSE hit - 1 END
  FROM (SELECT f.ls, e.*, list_position(list_transform(f.ls, lambda l: abs(l.y - e.cy) <= e.tol), true) AS hit FROM fold f JOIN it e ON e.image_id = f.image_id AND e.region_id = f.region_id AND e.k = f.k + 1) e),
lined AS (SELECT i.*, {BARE.format('i.text')} AS bare, f.line FROM fold f JOIN it i USING (image_id, region_id, k)),
li AS (SELECT *, row_number() OVER ln AS j, regexp_matches(text, {lit(D.AMOUNT)}) AND coalesce(lead(text) OVER ln IN ('¥', '￥', '夫')
    AND abs(cy - lead(cy) OVER ln) <= 0.7 * greatest(h, lead(h) OVER ln) AND lead(x) OVER ln >= x AND lead(x) OVER ln - x - w <= greatest(8, 0.7 * w, h, lead(h) OVER ln), FALSE) AS money,
    CASE WHEN regexp_matches(text, {lit(D.UNIT)}) THEN '（元）' ELSE text END AS shown FROM lined WINDOW ln AS (PARTITION BY image_id, region_id, line ORDER BY cx, box_id)),
lt AS (
  SELECT image_id, region_id, line, CAST(0 AS BIGINT) AS j, CAST([] AS STRING[]) AS parts, CAST([] AS STRING[]) AS seen, FALSE AS skip FROM li WHERE j = 1
  UNION ALL
  SELECT image_id, region_id, line, j, CASE WHEN keep THEN list_append(parts, CASE WHEN money THEN concat(text, ' ¥') ELSE shown END) ELSE parts END, CASE WHEN keep THEN list_append(seen, CASE WHEN money THEN concat(bare, '¥') ELSE {BARE.format('shown')} END) ELSE seen END, keep AND money
  FROM (SELECT t.parts, t.seen, l.*, NOT skip AND len(list_filter(seen, lambda s: s <> '' AND l.bare <> '' AND (s = l.bare OR (length(l.bare) >= 8 AND contains(s, l.bare)) OR (length(s) >= 8 AND contains(l.bare, s))))) = 0 AS keep
        FROM lt t JOIN li l ON l.image_id = t.image_id AND l.region_id = t.region_id AND l.line = t.line AND l.j = t.j + 1) s)"""


@query("key_content", "WITH RECURSIVE " + REGION_FOLD + f""",
ps AS (SELECT image_id, region_id, line, trim(array_to_string(arg_max(parts, j), ' ')) AS t FROM lt GROUP BY image_id, region_id, line),
bd AS (SELECT image_id, region_id, count(*) AS n, string_agg(t, '；' ORDER BY line) AS body FROM ps WHERE t <> '' GROUP BY image_id, region_id),
jn AS (SELECT image_id, region_id, line, trim(string_agg(text, ' ' ORDER BY j)) AS t FROM li GROUP BY image_id, region_id, line),
fv AS (SELECT image_id, region_id, line, trim(regexp_extract(t, '^([^：:]{{1,20}})[：:]\\s*(.+)$', 1)) AS l, trim(regexp_extract(t, '^([^：:]{{1,20}})[：:]\\s*(.+)$', 2)) AS v FROM jn WHERE regexp_matches(t, '^([^：:]{{1,20}})[：:]\\s*(.+)$')),
fd AS (SELECT image_id, region_id, count(*) AS n, string_agg(concat(l, '=', v), '，' ORDER BY line) AS fields FROM fv WHERE NOT regexp_matches(v, '[：:]') GROUP BY image_id, region_id),
ul AS (SELECT image_id, region_id, bool_and(regexp_matches(text, {lit(D.UNIT)})) AS u FROM li WHERE line = 1 GROUP BY image_id, region_id),
hd AS (SELECT image_id, region_id, list(cx ORDER BY j) AS cxs, string_agg(concat(text, CASE WHEN u THEN '（元）' ELSE '' END), '、' ORDER BY j) AS columns, count(*) AS c, count(DISTINCT nullif(bare, '')) AS uq, bool_or(coalesce(u, FALSE)) AS u FROM li LEFT JOIN ul USING (image_id, region_id) WHERE line = 0 GROUP BY image_id, region_id),
tb AS (SELECT l.*, h.c, h.u, list_position(list_transform(cxs, lambda z: abs(z - l.cx)), list_min(list_transform(cxs, lambda z: abs(z - l.cx)))) AS col FROM li l JOIN hd h USING (image_id, region_id) WHERE line > 0 AND h.c >= 2 AND uq >= h.c * 0.5),
fl AS (SELECT image_id, region_id, line, count(DISTINCT col) AS f, max(c) AS c FROM tb GROUP BY image_id, region_id, line),
ok AS (SELECT image_id, region_id FROM fl GROUP BY image_id, region_id HAVING max(f) >= 2 AND sum(f) / CAST(sum(c) AS DOUBLE) >= 0.4),
nr AS (SELECT image_id, region_id, count(DISTINCT line) AS n FROM tb JOIN ok USING (image_id, region_id) WHERE text <> '' AND NOT (u AND line = 1) GROUP BY image_id, region_id)
SELECT r.image_id, r.region_id, CAST(row_number() OVER (PARTITION BY r.image_id ORDER BY confidence DESC, r.region_id) AS INT) AS rank,
  CASE WHEN nr.n > 0 THEN 'table' WHEN fd.n > 0 THEN 'fields' WHEN bd.n > 0 THEN 'text' ELSE 'empty' END AS kind, coalesce(nr.n, 0) AS n_rows, coalesce(fd.n, 0) AS n_fields, coalesce(bd.n, 0) AS n_lines,
  CASE WHEN nr.n > 0 THEN concat('关键区域包含表格：', columns, '，共 ', nr.n, ' 行。') WHEN fd.n > 0 THEN concat('关键区域包含字段：', fields, '。') WHEN bd.n > 0 THEN concat('关键区域包含：', body, '。') ELSE '关键区域未识别到明确文本。' END AS summary
FROM rg r LEFT JOIN nr USING (image_id, region_id) LEFT JOIN hd USING (image_id, region_id) LEFT JOIN fd USING (image_id, region_id) LEFT JOIN bd USING (image_id, region_id)""")
def _(t):
    r = t.boxes.where("type = 'card'").select("image_id", F.col("box_id").alias("region_id"), "x", "y", (F.col("w") * 3).alias("w"), (F.col("h") * 4).alias("h"), (F.col("p") % 100 / 100).alias("confidence"))
    return D.key_content(items(t), r)


CH_TEXT = "CASE p % 7 WHEN 0 THEN concat('Sales: ', CAST(q AS STRING), ' %') WHEN 1 THEN concat('¥', CAST(q AS STRING), ',00') WHEN 2 THEN '1,2,3,4' WHEN 3 THEN concat('Q', CAST(q % 5 AS STRING)) ELSE text END"


@query("chart_metrics", f"""
WITH t AS (SELECT image_id, box_id, {CH_TEXT} AS t FROM ocr_items),
m AS (SELECT *, trim(regexp_extract(t, {lit(D.METRIC)}, 1)) AS l, regexp_replace(regexp_extract(t, {lit(D.METRIC)}, 2), '\\s+', '', 'g') AS v FROM t),
k AS (SELECT image_id, box_id, CASE WHEN l <> '' AND v <> '' AND NOT {hit('v', D.COORDINATES)} THEN l WHEN {hit('t', D.STANDALONE)} AND NOT {hit('t', D.COORDINATES)} THEN '' END AS label,
  CASE WHEN l <> '' AND v <> '' AND NOT {hit('v', D.COORDINATES)} THEN v WHEN {hit('t', D.STANDALONE)} AND NOT {hit('t', D.COORDINATES)} THEN t END AS value FROM m)
SELECT image_id, value, label, ord FROM (SELECT image_id, value, label, box_id AS ord, row_number() OVER (PARTITION BY image_id, value ORDER BY box_id) AS rk FROM k WHERE value IS NOT NULL) r WHERE rk = 1""".replace("\\\\s", "\\s"))
def _(t):
    return D.chart_metrics(t.ocr_items.select("image_id", F.col("box_id").alias("ord"), F.expr(CH_TEXT).alias("text")))


@query("chart_categories", """
WITH e AS (SELECT image_id, max(y + h) AS m FROM ocr_items GROUP BY image_id),
a AS (SELECT o.*, y >= m * 0.7 AS ax FROM ocr_items o JOIN e USING (image_id)),
b AS (SELECT *, bool_or(ax) OVER (PARTITION BY image_id) AS anyx FROM a)
SELECT image_id, text AS label, min(box_id) AS ord FROM b WHERE (ax OR NOT anyx) AND length(text) BETWEEN 1 AND 12 AND NOT regexp_matches(text, '^[0-9]+$') GROUP BY image_id, text""")
def _(t):
    return D.chart_categories(items(t))


@query("chart_title", "SELECT image_id, text AS title FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, box_id) AS k FROM ocr_items) t WHERE k = 1")
def _(t):
    return D.chart_title(items(t))


CODE_TEXT = "CASE WHEN image_id % 2 = 0 THEN concat(CAST(q % 99 + 1 AS STRING), '  ', text) ELSE text END"


@query("code_lines", "WITH " + CODE_GAP + f""",
m AS (SELECT image_id, min(x) AS x0, list_sort(list(w / length({CODE_TEXT})))[count(*) // 2 + 1] AS cw FROM ocr_items GROUP BY image_id),
l AS (SELECT image_id, CAST(line AS BIGINT) AS line, min(x) AS x, trim(regexp_replace(array_to_string(list({CODE_TEXT} ORDER BY x, box_id), ' '), '\\s+', ' ', 'g')) AS t FROM ln GROUP BY image_id, line),
j AS (SELECT l.image_id, line, concat(repeat(' ', CAST(greatest(0, floor((x - x0) / greatest(2, cw) + 0.5)) AS INT)), t) AS t FROM l JOIN m USING (image_id)),
g AS (SELECT *, count(*) OVER (PARTITION BY image_id) >= 3 AND count(CASE WHEN regexp_matches(t, '^\\s*\\d{{1,4}}\\s+\\S') THEN 1 END) OVER (PARTITION BY image_id) >= 0.6 * count(*) OVER (PARTITION BY image_id) AS gutter FROM j)
SELECT image_id, line, CASE WHEN gutter THEN regexp_replace(t, '^\\s*\\d{{1,4}}\\s+', '') ELSE t END AS text, gutter AS has_line_numbers FROM g""".replace("\\\\", "\\"))
def _(t):
    return D.code_lines(t.ocr_items.select("image_id", F.col("box_id").alias("ord"), F.expr(CODE_TEXT).alias("text"), "x", "y", "w", "h"))


# --- model output -----------------------------------------------------------------------
LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')"


@query("repetition_flag", f"""
WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents),
c AS (SELECT doc_id, max(n) AS mx FROM (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, unnest(ls) AS s FROM l) u GROUP BY doc_id, s) v GROUP BY doc_id)
SELECT l.doc_id, len(ls) >= 6 AND (coalesce(mx, 0) > 3 OR (length(array_to_string(ls[1:4], chr(10))) > 20 AND contains(array_to_string(ls[5:], chr(10)), array_to_string(ls[1:4], chr(10))))) AS repetitive FROM l LEFT JOIN c USING (doc_id)""")
def _(t):
    return O.repetition_flag(t.documents, "text").select("doc_id", "repetitive")


GROUND = """
g AS (SELECT conv_id, turn, raw_text, source_text, list_distinct(list_concat(regexp_extract_all(raw_text, '[一-鿿]{2,}'), regexp_extract_all(lower(raw_text), '[a-z]{3,}'))) AS ts FROM model_outputs),
gs AS (SELECT *, CASE WHEN source_text <> '' AND raw_text <> '' AND len(ts) > 0 THEN len(list_filter(ts, lambda t: contains(lower(source_text), t))) / CAST(len(ts) AS DOUBLE) END AS share FROM g)"""


@query("grounding", "WITH " + GROUND + " SELECT conv_id, turn, round(share, 6) AS grounded_share, coalesce(share >= 0.15, TRUE) AS grounded FROM gs")
def _(t):
    g = O.grounding(t.model_outputs, "raw_text", "source_text")
    return g.select("conv_id", "turn", r6(F.col("grounded_share"), "grounded_share"), "grounded")


@query("prefer_source_text", f"""
WITH {GROUND},
x AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN substring(source_text, 1, 30) WHEN 2 THEN source_text ELSE raw_text END AS s FROM gs),
l AS (SELECT *, list_filter(list_transform(string_split(s, chr(10)), lambda v: trim(v)), lambda v: v <> '') AS ls FROM x),
r AS (SELECT *, (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(l.ls) AS v) u GROUP BY v) w) AS mx FROM l)
SELECT conv_id, turn, CASE WHEN trim(s) = '' THEN 'empty' WHEN len(ls) >= 6 AND (coalesce(mx, 0) > 3 OR (length(array_to_string(ls[1:4], chr(10))) > 20 AND contains(array_to_string(ls[5:], chr(10)), array_to_string(ls[1:4], chr(10))))) THEN 'repetitive'
  WHEN NOT coalesce(share >= 0.15, TRUE) THEN CASE WHEN length(s) > 100 AND regexp_matches(s, '[一-鿿]') THEN NULL ELSE 'ungrounded' END WHEN source_text = '' THEN NULL WHEN length(s) < 40 THEN 'short' WHEN contains(source_text, trim(s)) THEN 'copy'
  WHEN len(ls) >= 3 AND len(list_filter(ls, lambda v: contains(source_text, v))) / CAST(len(ls) AS DOUBLE) > 0.6 THEN 'copied-lines' END AS prefer_reason FROM r""")
def _(t):
    c = F.col("conv_id") % 5
    g = O.grounding(t.model_outputs, "raw_text", "source_text")
    s = F.when(c == 0, "").when(c == 1, F.substring("source_text", 1, 30)).when(c == 2, F.col("source_text")).otherwise(F.col("raw_text"))
    return O.prefer_source_text(g.withColumn("s", s), "s", "source_text").select("conv_id", "turn", "prefer_reason")


RAW = """CASE p % 14 WHEN 0 THEN '{"description":"ok"}' WHEN 1 THEN concat('```json', chr(10), '{"description":"ok"}', chr(10), '```') WHEN 2 THEN 'Sure! {"description":"ok"} done' WHEN 3 THEN '{''description'':''ok'',}'
 WHEN 4 THEN '{"description":"ok"' WHEN 5 THEN 'A plain sentence' WHEN 6 THEN '42' WHEN 7 THEN '{"result":"from result"}' WHEN 8 THEN '{"title":"T","n":3}' WHEN 9 THEN '{}' WHEN 10 THEN '' WHEN 11 THEN '{"description":null,"a":"b"}'
 WHEN 12 THEN '{"category":"ui"}' ELSE 'This looks like a chart.' END"""
SKILL = "CASE p % 14 WHEN 12 THEN 'classify' WHEN 13 THEN 'classify' ELSE 'summary' END"


def raw_outputs(t):
    # string literals of the shared text double their quotes; Spark spells them differently
    p = F.col("p") % 14
    texts = [
        '{"description":"ok"}', '```json\n{"description":"ok"}\n```', 'Sure! {"description":"ok"} done', "{'description':'ok',}", '{"description":"ok"', "A plain sentence", "42",
        '{"result":"from result"}', '{"title":"T","n":3}', "{}", "", '{"description":null,"a":"b"}', '{"category":"ui"}', "This looks like a chart.",
    ]
    raw = None
    for i, s in enumerate(texts):
        raw = (F if raw is None else raw).when(p == i, F.lit(s))
    return t.boxes.select("image_id", "box_id", raw.alias("raw_text"), F.when(p >= 12, "classify").otherwise("summary").alias("skill"))


@query("parse_model_output", """
SELECT image_id, box_id, CAST(NULL AS STRING) AS error, CASE p % 14 WHEN 1 THEN 'stripped-markdown,extracted-json' WHEN 2 THEN 'extracted-json' WHEN 3 THEN 'fixed-syntax' WHEN 4 THEN 'auto-closed-braces' WHEN 5 THEN 'wrapped-natural-language' WHEN 6 THEN 'wrapped-natural-language'
  WHEN 7 THEN 'recovered-description-from-result' WHEN 8 THEN 'synthesized-description' WHEN 9 THEN 'default-description' WHEN 10 THEN 'wrapped-natural-language' WHEN 11 THEN 'synthesized-description' WHEN 12 THEN 'default-confidence' WHEN 13 THEN 'wrapped-natural-language' ELSE '' END AS repairs,
  CASE p % 14 WHEN 5 THEN 'A plain sentence' WHEN 6 THEN '42' WHEN 7 THEN 'from result' WHEN 8 THEN 'title: T' WHEN 9 THEN 'Analysis unavailable.' WHEN 10 THEN 'Unable to describe image.' WHEN 11 THEN 'a: b' WHEN 12 THEN NULL WHEN 13 THEN NULL ELSE 'ok' END AS description,
  CASE p % 14 WHEN 12 THEN 'ui' WHEN 13 THEN 'chart' END AS category, CAST(CASE p % 14 WHEN 12 THEN 0.5 WHEN 13 THEN 0.7 END AS DOUBLE) AS confidence FROM boxes""")
def _(t):
    v = O.parse_model_output(raw_outputs(t)).withColumn("v", F.try_parse_json("json"))
    get = lambda f, typ: F.try_variant_get("v", f"$.{f}", typ).alias(f)
    return v.select("image_id", "box_id", "error", F.array_join("repairs", ",").alias("repairs"), get("description", "string"), get("category", "string"), get("confidence", "double"))


@query("parse_reasoning", """
SELECT image_id, box_id, CASE p % 3 WHEN 0 THEN 'a,b' END AS insights, CASE p % 3 WHEN 0 THEN 'r' END AS risks, CASE p % 3 WHEN 0 THEN '' END AS next_actions FROM boxes""")
def _(t):
    p = F.col("p") % 3
    raw = F.when(p == 0, '```json\n{"insights":[" a ","b",""],"risks":["r"],"next_actions":[]}\n```').when(p == 1, "no json here").otherwise('{"insights":["x","X","x"],"risks":["x"],"next_actions":[]}')
    return O.parse_reasoning(t.boxes.select("image_id", "box_id", raw.alias("raw_text")), most=3, max_chars=200).select("image_id", "box_id", *(F.array_join(c, ",").alias(c) for c in ("insights", "risks", "next_actions")))


def _part(field, n, lead):
    return f"coalesce('{lead}' || max(CASE WHEN field = '{field}' THEN t{n} END) || '。', '')"


@query("compose_result", f"""
WITH ev AS ({UI_EVIDENCE}),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, field ORDER BY pos) AS r FROM ev),
fx AS (SELECT image_id, page_type, field, {', '.join(f"string_agg(text, '、' ORDER BY r) FILTER (WHERE r <= {n}) AS t{n}" for n in (5, 6, 8))} FROM rk GROUP BY image_id, page_type, field),
ui AS (SELECT image_id, CASE WHEN page_type = 'mobile-ui' THEN concat('这是一个移动端应用页面。', {_part('title', 5, '页面标题为')}, {_part('modules', 5, '页面模块包括')}, {_part('fields', 8, '可见内容包括')}, {_part('actions', 5, '操作按钮有')})
  ELSE concat('这是一个中文后台管理系统页面。', {_part('modules', 5, '系统模块包括')}, {_part('navigation', 5, '导航包含')}, {_part('tableHeaders', 6, '表格列包括')}, {_part('actions', 8, '可执行操作包括')}) END AS ui FROM fx GROUP BY image_id, page_type),
o AS (SELECT image_id, max(CASE WHEN k < 12 THEN k END) AS s, max(CASE WHEN k >= 12 THEN k END) AS c FROM (SELECT image_id, p % 14 AS k, row_number() OVER (PARTITION BY image_id, p % 14 >= 12 ORDER BY box_id) AS n FROM boxes) b WHERE n = 1 GROUP BY image_id),
j AS (SELECT m.image_id, s, c, ui, CASE s WHEN 5 THEN 'A plain sentence' WHEN 6 THEN '42' WHEN 7 THEN 'from result. result: from result' WHEN 8 THEN 'title: T' WHEN 9 THEN 'Analysis unavailable.' WHEN 10 THEN 'Unable to describe image.' WHEN 11 THEN 'a: b' ELSE CASE WHEN s IS NULL THEN '' ELSE 'ok' END END AS summary,
  CASE m.image_id % 4 WHEN 1 THEN 'This image contains text content.Main title: "ok text".' WHEN 2 THEN 'This image contains text content.Main title: "Alpha beam".Topics include: Alpha.' END AS general
  FROM pages_meta m LEFT JOIN o USING (image_id) LEFT JOIN ui USING (image_id))
SELECT image_id AS request_id, concat(CASE WHEN c IS NOT NULL THEN 'classify' ELSE '' END, CASE WHEN c IS NOT NULL AND s IS NOT NULL THEN ',' ELSE '' END, CASE WHEN s IS NOT NULL THEN 'summary' ELSE '' END) AS skills,
  CASE WHEN c = 12 THEN 'ui' WHEN c = 13 THEN 'chart' WHEN ui IS NOT NULL THEN 'ui' ELSE 'unknown' END AS category, CASE c WHEN 12 THEN 'ui' WHEN 13 THEN 'chart' END AS original_category,
  summary, CASE WHEN general IS NOT NULL OR summary = '' THEN coalesce(ui, general, summary) ELSE summary END AS final_summary FROM j""")
def _(t):
    from screenlake.functions.semantics import keep_first

    parsed = O.parse_model_output(keep_first(raw_outputs(t), ["image_id", "skill"], ["box_id"]))
    k = F.col("image_id") % 4
    req = t.pages_meta.select(F.col("image_id").alias("request_id"), F.when(k == 1, "ok text").when(k == 2, "Alpha beam\nAlpha two").alias("ocr_text"))
    out = O.compose_result(req, parsed.withColumnRenamed("image_id", "request_id"), evidence=ui_evidence(t))
    return out.select("request_id", F.array_join(F.coalesce("skills", F.array()), ",").alias("skills"), "category", "original_category", "summary", "final_summary")
