"""Deterministic screen/document views over the given tables.

Each view is one SELECT that both Spark and an ANSI engine run unchanged; ``{name}``
marks the tables and views it reads.  ``view()`` gives the Spark DataFrame,
``with_views()`` inlines the views a statement uses as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from screenlake.session import cut_lineage

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "boxes": """
SELECT CAST((l_orderkey - l_orderkey % 16) / 16 AS BIGINT) AS image_id,
       concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
                 CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS box_id,
       CASE l_suppkey % 6 WHEN 0 THEN 'button' WHEN 1 THEN 'text' WHEN 2 THEN 'icon'
            WHEN 3 THEN 'card' WHEN 4 THEN 'row' ELSE 'input' END AS type,
       CAST((l_partkey * 37) % 360 AS DOUBLE) AS x,
       CAST((l_suppkey * 53 + l_linenumber * 11) % 760 AS DOUBLE) AS y,
       CAST(8 AS DOUBLE) + l_quantity * 2 AS w,
       CAST(8 + l_partkey % 40 AS DOUBLE) AS h,
       l_partkey AS p, l_suppkey AS q, l_orderkey AS o
FROM {lineitem}""",
    "pages_meta": "SELECT DISTINCT image_id, 420 AS width, 820 AS height FROM {boxes}",
    "preds": """
SELECT image_id, concat('p', box_id) AS box_id,
       CASE WHEN p % 13 = 0 THEN 'image' ELSE type END AS type,
       x + (p % 7) - 3 AS x, y + (q % 5) - 2 AS y,
       w * (CAST(85 + (p % 4) * 10 AS DOUBLE) / 100) AS w, h,
       CAST(40 + p % 60 AS DOUBLE) / 100 AS score, p, q, o
FROM {boxes} WHERE q % 10 <> 0""",
    "candidates": """
SELECT image_id, concat('cv:', box_id) AS cand_id, type, x, y, w, h, CAST(0.7 AS DOUBLE) AS score, 'cv' AS source FROM {boxes}
UNION ALL
SELECT image_id, concat('det:', box_id), type, x, y, w, h, score, 'ui-detector' FROM {preds}
UNION ALL
SELECT image_id, concat('ocr:', box_id), 'text', x + 1, y + 1, w, h, CAST(0.9 AS DOUBLE), 'ocr' FROM {boxes} WHERE type = 'text'""",
    "ocr_items": """
SELECT image_id, box_id, x, y, w, h,
       CAST(30 + p % 70 AS DOUBLE) / 100 AS confidence,
       CASE p % 14
         WHEN 0 THEN concat('Date: 2024-0', CAST(1 + q % 9 AS STRING), '-1', CAST(q % 9 AS STRING))
         WHEN 1 THEN concat('user', CAST(p AS STRING), '@mail.example.com')
         WHEN 2 THEN concat('https://shop.example.com/item/', CAST(p % 50 AS STRING))
         WHEN 3 THEN concat('Total: ', CAST(p AS STRING))
         WHEN 4 THEN 'Save'
         WHEN 5 THEN CAST(q AS STRING)
         WHEN 6 THEN concat('价格：', CAST(q AS STRING))
         WHEN 7 THEN '请输入名称'
         WHEN 8 THEN 'error: request failed'
         WHEN 9 THEN concat('1380013', CAST(1000 + p % 9000 AS STRING))
         WHEN 10 THEN 'Delete'
         WHEN 11 THEN concat('Inbox ', CAST(q % 90 AS STRING))
         WHEN 12 THEN 'const total = 0'
         ELSE '订单 管理 订单' END AS text,
       p, q
FROM {boxes}""",
    "relations": """
SELECT b.image_id, a.box_id AS src, b.box_id AS dst, 'contains' AS type,
       CASE WHEN b.p % 5 = 0 THEN 'human' ELSE 'derived' END AS source
FROM {boxes} a JOIN {boxes} b ON a.image_id = b.image_id AND a.box_id <> b.box_id
 AND b.x >= a.x AND b.y >= a.y AND b.x + b.w <= a.x + a.w AND b.y + b.h <= a.y + a.h
 AND a.w * a.h > b.w * b.h""",
    "review_actions": """
SELECT event_id AS action_id, user_id AS image_id, 'structure-finding' AS subject_kind, props AS subject_id,
       CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'rejected' WHEN 'purchase' THEN 'confirmed'
                       WHEN 'signup' THEN 'overridden' ELSE 'suppressed' END AS action,
       ts AS created_at
FROM {events}""",
    "requests": """
SELECT event_id AS request_id, ts, event_type AS provider, concat(event_type, '|', props) AS cache_key, value AS duration_ms,
       user_id
FROM {events}""",
    "manifest": """
SELECT concat('shot_', CAST(o_orderkey AS STRING)) AS sample_id,
       CASE WHEN o_orderkey % 11 = 0 THEN concat('shot_', CAST(o_orderkey AS STRING), '.json')
            ELSE concat('screen_', CAST(202400000000 + (o_orderkey % 700) AS STRING), '_', CAST(o_orderkey AS STRING), '.json') END AS annotation_file
FROM {orders}""",
    "model_outputs": """
SELECT a.conv_id, a.turn, a.text AS raw_text, u.text AS source_text
FROM {conversations} a JOIN {conversations} u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1
WHERE a.role = 'assistant'""",
    "rule_hits": """
SELECT d.doc_id, CASE WHEN d.n_chars < 400 THEN 'short-text' ELSE 'long-text' END AS code, 1 AS version,
       CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN l.quality = 0 THEN 'confirmed' ELSE 'suppressed' END AS status
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # a tree per image: every box hangs under the card/row that comes before it in a
    # 3-ary heap over the box order; the first box of an image is its page root
    "tree_nodes": """
SELECT image_id, box_id AS node_id, n, p, q,
       CASE WHEN n = 1 THEN NULL ELSE CAST((n + 1 - (n + 1) % 3) / 3 AS BIGINT) END AS parent_n,
       CASE WHEN n = 1 THEN 'page' ELSE type END AS type, x, y, w, h
FROM (SELECT b.*, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS n FROM {boxes} b) t""",
    "nodes": """
SELECT c.image_id, c.node_id, f.node_id AS parent_id, c.n, c.p, c.q, c.type, c.x, c.y, c.w, c.h
FROM {tree_nodes} c LEFT JOIN {tree_nodes} f ON c.image_id = f.image_id AND c.parent_n = f.n""",
    # wide sibling groups: every box after the fifth hangs under one of boxes 2..5
    "kids": """
SELECT c.image_id, f.node_id AS parent_id, c.node_id AS child_id
FROM {tree_nodes} c JOIN {tree_nodes} f ON c.image_id = f.image_id AND f.n = 2 + c.n % 4 WHERE c.n > 5""",
    "finding_actions": """
SELECT image_id, node_id AS element_id, p + q AS action_id, 'structure-finding' AS subject_kind,
       concat(CASE p % 3 WHEN 0 THEN 'sibling-size-inconsistent' WHEN 1 THEN 'sibling-overlap' ELSE 'isolated-content' END, ':', node_id) AS subject_id,
       CASE q % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'overridden' ELSE 'suppressed' END AS action,
       CASE WHEN q % 7 = 0 THEN 'stale' ELSE NULL END AS signature,
       p * 100 + q AS created_at
FROM {tree_nodes} WHERE q % 3 <> 0""",
    "intents": """
SELECT event_id AS request_id, user_id AS image_id,
       CASE event_id % 12
         WHEN 0 THEN 'please read the text in the red box'
         WHEN 1 THEN 'describe this page'
         WHEN 2 THEN '识别蓝框里的价格'
         WHEN 3 THEN 'analyze the ui layout and components'
         WHEN 4 THEN 'extract the table of amounts on the right'
         WHEN 5 THEN '这段代码报错怎么修复'
         WHEN 6 THEN 'what colors does the design use'
         WHEN 7 THEN 'summarize the invoice'
         WHEN 8 THEN 'find every button on the login form'
         WHEN 9 THEN 'what is in the flowchart'
         WHEN 10 THEN 'read the green box on the left'
         ELSE '分析图表趋势' END AS intent,
       CASE event_id % 5 WHEN 0 THEN 'red' WHEN 1 THEN '蓝色' WHEN 2 THEN 'orange' ELSE NULL END AS target_color,
       CASE event_id % 6 WHEN 0 THEN 'code' WHEN 1 THEN 'document' WHEN 2 THEN 'chart' ELSE NULL END AS scene_hint,
       event_id % 7 = 0 AS has_target, event_id % 3 = 0 AS has_boxes,
       CASE event_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'classify,ocr' WHEN 2 THEN 'describe' ELSE 'summary,classify' END AS skills,
       CASE event_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' ELSE 'accurate' END AS quality,
       value, ts
FROM {events}""",
    "samples": """
SELECT image_id, box_id AS region_id, CAST((p * 29 + o * 7) % 256 AS INT) AS r,
       CAST((q * 31 + o * 3) % 256 AS INT) AS g, CAST((p * 17 + q * 5 + o) % 256 AS INT) AS b
FROM {boxes}""",
}

# views that cost a sort or a join: written once per session and data folder
WRITTEN = ("tree_nodes", "nodes", "kids", "relations")
# kept in buckets of the image, as the window of the first has dealt them: the joins of the others, and
# queries that ask for the dealt tables, meet them there
DEALT = ("tree_nodes", "nodes", "kids")
_written: dict[tuple[str, str, str], DataFrame] = {}

_REF = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A base table or a view of this module as a (lazy) DataFrame.  ``dealt``: views that are
    written in buckets of the image are read as such, others as plain files."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        df = spark.sql(VIEWS[name], **{ref: view(spark, sf_dir, ref, dealt or name in DEALT) for ref in sorted(set(_REF.findall(VIEWS[name])))})
        if name not in WRITTEN:
            return df
        _written[key] = cut_lineage(df, name in DEALT)
    df = _written[key]
    files = [] if dealt or name not in DEALT else df.inputFiles()
    return spark.read.schema(df.schema).parquet(files[0].rsplit("/", 1)[0]) if files else df


def with_views(sql: str) -> str:
    """Put the views that ``sql`` mentions in front of it as common table expressions."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed or name not in VIEWS:
            return
        for ref in _REF.findall(VIEWS[name]):
            visit(ref)
        needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql, re.IGNORECASE):
            visit(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({_REF.sub(lambda m: m.group(1), VIEWS[n])})" for n in needed)
    body = sql.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"
