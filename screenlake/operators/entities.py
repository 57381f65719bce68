"""Text mining of OCR text (TXT-7..12, TXT-16..18, TXT-24)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from screenlake.functions import rulebook as RB
from screenlake.functions.semantics import keep_first
from screenlake.operators.layout import top_k_per_group
from screenlake.session import cut_lineage

CJK = r"[一-鿿]"
_ENTITY = "array<struct<type:string,value:string,label:string>>"


def _first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def _found(text: Column, kind: str, pattern: str, per_type: int | None) -> Column:
    hits = _first(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), per_type)
    return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(None).cast("string").alias("label")))


def entities_of(text: Column, scenario: Column | None = None, key_content: Column | None = None, per_type: int | None = None, limit: int | None = None) -> Column:
    """Entities of one text as an ordered array: scenario entities, key-content fields,
    then URLs, e-mails, phones and dates; distinct by type, value and label.  All of them,
    unless ``per_type`` or ``limit`` asks for the first ones."""
    none = F.array().cast(_ENTITY)
    parts = [
        none if scenario is None else F.coalesce(scenario, none),
        none if key_content is None else F.coalesce(key_content, none),
        *(_found(text, kind, pattern, per_type) for kind, pattern in RB.ENTITY_PATTERNS),
    ]
    return _first(F.array_distinct(F.concat(*parts)), limit)


def extract_entities(docs: DataFrame, key: str, text: str, scenario: str | None = None, key_content: str | None = None) -> DataFrame:
    """Long form (key, pos, type, value, label); a map-only job."""
    arr = entities_of(F.col(text), None if scenario is None else F.col(scenario), None if key_content is None else F.col(key_content))
    return docs.select(key, F.posexplode(arr).alias("pos", "e")).select(key, "pos", "e.type", "e.value", "e.label")


def entity_mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every mention (key, type, value), repeats included; a map-only job."""
    def mentions(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    every = (mentions(kind, pattern) for kind, pattern in RB.ENTITY_PATTERNS)
    return docs.select(key, F.explode(F.concat(*every)).alias("e")).select(key, "e.type", "e.value")


def extract_item_entities(items: DataFrame, keys: Sequence[str] = ("image_id",), per_type: int | None = None, limit: int | None = None) -> DataFrame:
    """The same over OCR items of an image (no pattern spans two items): the distinct values
    by type in item order, or the first ``per_type`` of a type and ``limit`` of an image."""
    rows = None
    for rank, (kind, pattern) in enumerate(RB.ENTITY_PATTERNS):
        hits = items.select(*keys, "ord", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("at", "value"))
        hits = hits.select(*keys, F.lit(rank).alias("t"), F.lit(kind).alias("type"), "value", "ord", "at")
        rows = hits if rows is None else rows.unionByName(hits)
    first = keep_first(rows, [*keys, "t", "type", "value"], ["ord", "at"])
    some = top_k_per_group(first, [*keys, "t"], ["ord", "at"], per_type)
    kept = top_k_per_group(some.drop("rank"), keys, ["t", "ord", "at"], limit)
    return kept.select(*keys, "rank", "type", "value")


def entity_index(mentions: DataFrame, key: str) -> DataFrame:
    """Corpus-level value index: number of documents and of mentions per (type, value)."""
    per_doc = mentions.groupBy("type", "value", key).agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("type", "value").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c").alias("n_mentions"))


def flow_relations(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges with node labels instead of ids (the id stands in for a missing label), all or
    the first ``limit`` per image in edge order."""
    label = nodes.where(F.col("label") != "").select("image_id", "id", "label")
    rows = edges.join(label.withColumnRenamed("id", "src").withColumnRenamed("label", "_s"), ["image_id", "src"], "left")
    rows = rows.join(label.withColumnRenamed("id", "dst").withColumnRenamed("label", "_d"), ["image_id", "dst"], "left")
    rows = rows.select(
        "image_id", "ord", F.coalesce("_s", F.col("src").cast("string")).alias("from"), F.coalesce("_d", F.col("dst").cast("string")).alias("to"),
        F.lit("flow").alias("type"),
    )
    return top_k_per_group(rows, ["image_id"], ["ord"], limit).drop("ord")


def logic_facts(conditions: DataFrame, directions: DataFrame, languages: DataFrame, limit: int | None = None) -> DataFrame:
    """Branch conditions, flow direction, language and line count as facts per image, all or
    the first ``limit`` in that order.  ``conditions``: image_id, ord, condition; ``directions``:
    image_id, direction; ``languages``: image_id, language, line_count."""
    zero = F.lit("")
    cond = conditions.where(F.col("condition") != "").select("image_id", F.lit(0).alias("k"), F.col("ord").cast("string").alias("o"), F.concat(F.lit("分支条件: "), "condition").alias("fact"))
    flow = directions.where(F.col("direction") != "unknown").select("image_id", F.lit(1).alias("k"), zero.alias("o"), F.concat(F.lit("流向: "), "direction").alias("fact"))
    lang = languages.where(F.col("language") != "unknown").select("image_id", F.lit(2).alias("k"), zero.alias("o"), F.concat(F.lit("语言: "), "language").alias("fact"))
    count = languages.where(F.col("line_count") > 0).select("image_id", F.lit(3).alias("k"), zero.alias("o"), F.concat(F.lit("代码行数: "), F.col("line_count").cast("string")).alias("fact"))
    rows = cond.unionByName(flow).unionByName(lang).unionByName(count)
    return top_k_per_group(rows, ["image_id"], ["k", "o"], limit).drop("k", "o")


def branch_conditions(items: DataFrame) -> DataFrame:
    """Distinct yes/no style texts of an image with their first position."""
    hits = items.select("image_id", "ord", F.trim("text").alias("condition")).where(F.col("condition").rlike(RB.CONDITION))
    return keep_first(hits, ["image_id", "condition"], ["ord"])


def is_decision(label: Column) -> Column:
    hit = F.lit(False)
    for w in RB.DECISION_WORDS:
        hit = hit | F.lower(label).contains(w)
    return hit


def semantic_groups(items: DataFrame) -> DataFrame:
    """Group of every distinct OCR text of an image: dates, buttons, hints, formLabels,
    headers (top 15 %), values, other; each text once per group, at its first position."""
    extent = items.groupBy("image_id").agg(F.greatest(F.lit(1.0), F.max(F.col("y") + F.col("h"))).alias("_maxy"))
    rows = items.withColumn("text", F.trim("text")).where(F.col("text") != "").join(extent, "image_id")
    text = F.col("text")
    header = (F.col("y") < F.col("_maxy") * 0.15) & (F.length(text) <= 20) & ~text.contains("\n")
    group = (
        F.when(text.rlike(RB.GROUP_DATE), "dates").when(text.rlike(RB.GROUP_BUTTON), "buttons").when(text.rlike(RB.GROUP_HINT), "hints")
        .when(text.rlike(RB.GROUP_LABEL), "formLabels").when(header, "headers")
        .when(text.rlike(RB.GROUP_VALUE) | text.contains("日期"), "values").otherwise("other")
    )
    return keep_first(rows.select("image_id", group.alias("group"), "text", "ord"), ["image_id", "group", "text"], ["ord"])


def ui_evidence(items: DataFrame, limits: Mapping[str, int] | None = None) -> DataFrame:
    """Page evidence from OCR lines in long form (image_id, page_type, field, pos, text).

    Needs at least eight lines; the mobile rule is tried first, then at least four lines
    with admin signals.  A field lists the distinct ones of its matching lines; ``limits``
    gives the number of matching lines that a field takes at most, by field.  A mobile page
    has a ``title`` where a line is or else holds the word for details."""
    lines = items.select("image_id", "ord", F.trim("text").alias("text")).where(F.col("text") != "")
    lower = F.lower("text")
    n = lambda p, c=F.col("text"): F.count(F.when(c.rlike(p), 1))
    stats = lines.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_lines"), n(RB.MOBILE_STATUS).alias("status"), n(RB.MOBILE_PRODUCT).alias("product"),
        n(RB.MOBILE_ADMIN, lower).alias("admin"), n(RB.UI_SIGNAL, lower).alias("signals"), n("详情").alias("titles"),
        F.count_distinct(F.when(F.col("text").rlike(RB.MOBILE_FIELD), F.col("text"))).alias("m_fields"),
    ).where(F.col("n_lines") >= 8)
    mobile = (F.col("product") >= 4) & (F.col("admin") < 3) & ((F.col("status") > 0) | (F.col("titles") > 0) | (F.col("m_fields") >= 4))
    page = F.when(mobile, "mobile-ui").when(F.col("signals") >= 4, "admin-ui")
    kinds = stats.select("image_id", "n_lines", page.alias("page_type")).where(F.col("page_type").isNotNull())
    rows = lines.join(kinds, "image_id")
    admin = [("navigation", RB.UI_NAV), ("actions", RB.UI_ACTION), ("fields", RB.UI_FIELD), ("tableHeaders", RB.UI_FIELD), ("values", RB.UI_VALUE), ("modules", RB.UI_MODULE)]
    phone = [("navigation", RB.MOBILE_NAV), ("actions", RB.MOBILE_ACTION), ("fields", RB.MOBILE_FIELD), ("values", RB.MOBILE_VALUE), ("modules", RB.MOBILE_MODULE)]
    hits = F.filter(
        F.concat(
            *(F.array(F.when((F.col("page_type") == "admin-ui") & lower.rlike(p), F.lit(f))) for f, p in admin),
            *(F.array(F.when((F.col("page_type") == "mobile-ui") & F.col("text").rlike(p), F.lit(f))) for f, p in phone),
        ),
        lambda s: s.isNotNull(),
    )
    named = rows.where((F.col("page_type") == "mobile-ui") & F.contains("text", F.lit("详情"))).groupBy("image_id", "page_type")
    title = named.agg(F.min_by("text", F.struct(F.col("text") != "详情", "ord")).alias("text")).withColumn("field", F.lit("title")).withColumn("pos", F.lit(1))
    rows = rows.select("image_id", "page_type", "ord", "text", F.explode(hits).alias("field"))
    rows = top_k_per_group(rows, ["image_id", "field"], ["ord"], None)
    for field, most in (limits or {}).items():
        rows = rows.where((F.col("field") != field) | (F.col("rank") <= most))
    fields = keep_first(rows.select("image_id", "page_type", "field", "text", F.col("rank").alias("pos")), ["image_id", "page_type", "field", "text"], ["pos"])
    return fields.unionByName(title)


def ui_summary(evidence: DataFrame) -> DataFrame:
    """Sentence on each page (image_id, page_type, ui_summary) from ``ui_evidence`` rows: title and
    first modules, contents and actions of a mobile page, or modules, navigation, table columns and
    actions of an admin page."""
    top = top_k_per_group(evidence.where(F.col("pos").isNotNull()), ["image_id", "page_type", "field"], ["pos"], 8)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"])
    per = top.groupBy("image_id", "page_type", "field").agg(listed.alias("_ts"))
    fields = per.groupBy("image_id", "page_type").agg(F.map_from_entries(F.collect_list(F.struct("field", "_ts"))).alias("_f"))
    fields = evidence.select("image_id", "page_type").distinct().join(fields, ["image_id", "page_type"], "left")

    def part(field: str, n: int, lead: str) -> Column:
        texts = F.try_element_at("_f", F.lit(field))
        return F.when(F.size(texts) > 0, F.concat(F.lit(lead), F.array_join(F.slice(texts, 1, n), "、"), F.lit("。"))).otherwise("")

    phone = F.concat(F.lit("这是一个移动端应用页面。"), part("title", 1, "页面标题为"), part("modules", 5, "页面模块包括"), part("fields", 8, "可见内容包括"), part("actions", 5, "操作按钮有"))
    columns = part("tableHeaders", 6, "表格列包括")
    columns = F.when(columns != "", columns).otherwise(part("fields", 6, "主要字段有"))
    admin = F.concat(F.lit("这是一个中文后台管理系统页面。"), part("modules", 5, "系统模块包括"), part("navigation", 5, "导航包含"), columns, part("actions", 8, "可执行操作包括"))
    return fields.select("image_id", "page_type", F.when(F.col("page_type") == "mobile-ui", phone).otherwise(admin).alias("ui_summary"))


def ui_layout(items: DataFrame, max_titles: int | None = None) -> DataFrame:
    """Sidebar / main / footer split of boxed OCR text in long form (image_id, slot, text,
    ord of first mention); images with fewer than eight boxed items give nothing.  With
    ``max_titles``, the first so many distinct title candidates."""
    stats = items.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("x") + F.col("w")).alias("mx"), F.max(F.col("y") + F.col("h")).alias("my"))
    stats = stats.where(F.col("n") >= 8).select("image_id", F.greatest(F.lit(260.0), F.col("mx") * 0.25).alias("side"), (F.col("my") * 0.82).alias("foot"))
    rows = items.join(stats, "image_id")
    left, text = F.col("x") <= F.col("side"), F.col("text")
    sidebar_texts = rows.where(left).select("image_id", "text").distinct().withColumn("_in_side", F.lit(True))
    rows = rows.join(sidebar_texts, ["image_id", "text"], "left")
    slots = F.array_compact(F.array(
        F.when(left, "leftSidebar"), F.when((F.col("y") >= F.col("foot")) & text.rlike(RB.LAYOUT_FOOTER), "footerActions"),
        F.when(~left & text.rlike(RB.LAYOUT_HEADER), "tableHeaders"), F.when(~left & text.rlike(RB.LAYOUT_VALUE), "rowValues"),
        F.when(~left & text.rlike(RB.LAYOUT_ROW_ACTION), "rowActions"),
        F.when(~left & text.rlike(RB.LAYOUT_TITLE) & F.col("_in_side").isNull(), "titleCandidates"),
    ))
    out = keep_first(rows.select("image_id", F.explode(slots).alias("slot"), "text", "ord"), ["image_id", "slot", "text"], ["ord"])
    titles = top_k_per_group(out.where(F.col("slot") == "titleCandidates"), ["image_id"], ["ord"], max_titles).drop("rank")
    return out.where(F.col("slot") != "titleCandidates").unionByName(titles)


def key_topics(docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """Words that occur at least twice, most frequent first (ties: first mention): runs of
    2-4 CJK characters where the text has CJK, else capitalised words."""
    cjk = F.regexp_extract_all(text, F.lit(CJK + "{2,4}"), F.lit(0))
    latin = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]{2,}(?![A-Za-z0-9_])"), F.lit(0))
    terms = docs.select(key, F.posexplode(F.when(F.col(text).rlike(CJK), cjk).otherwise(latin)).alias("at", "term"))
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).where("n >= 2")
    return top_k_per_group(counts, [key], [F.desc("n"), "at"], k).select(key, "rank", "term", "n")


#: Space and punctuation that texts are compared without.
BARE = " \t\n\x0b\f\r,，。.;；:：\"'“”‘’/\\|-—_、"


def comparable(text: Column) -> Column:
    """Text without punctuation and spaces, with ASCII brackets; one pass over its characters."""
    return F.translate(text, "（）" + BARE, "()")


def near_duplicate_text(items: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Items that repeat an earlier one: equal without punctuation, or the shorter (>= 8
    characters) contained in the longer.  ``dup_of`` is the first such earlier item.

    Copies collapse to one row per text first.  Containment meets on 8-grams: the longer
    text lists its own, the shorter brings the one of its own that the group holds least often
    (ties: the first; grams are hashes, the containment itself is then checked on the texts).
    A beginning that all texts share is thus never what they meet on.

    Items are dealt by ``keys`` once, and the grams are counted and met there."""
    rows = items.select(*keys, "ord", comparable(F.col("text")).alias("_n")).where(F.col("_n") != "").repartition(*keys)
    texts = rows.groupBy(*keys, "_n").agg(F.min("ord").alias("_o"))
    held = texts.where(F.length("_n") >= 8).select(*keys, "_n", "_o", F.explode(F.sequence(F.lit(1), F.length("_n") - 7)).alias("_at"))
    held = held.withColumn("_g", F.xxhash64(F.substring("_n", F.col("_at"), F.lit(8))))
    # a gram that is held once has no longer text to meet
    often = held.withColumn("_f", F.count(F.lit(1)).over(W.partitionBy(*keys, "_g"))).where("_f > 1")
    rarest = often.groupBy(*keys, F.col("_n").alias("_sn"), F.col("_o").alias("_so")).agg(F.min(F.struct("_f", "_at", "_g")).alias("_r"), F.count(F.lit(1)).alias("_k"))
    # every gram of a text that lies in another is held by both
    short = rarest.where(F.col("_k") == F.length("_sn") - 7).select(*keys, "_sn", "_so", F.col("_r._g").alias("_g"))
    pairs = often.select(*keys, F.col("_n").alias("_ln"), F.col("_o").alias("_lo"), "_g").join(short.hint("merge"), [*keys, "_g"])
    pairs = pairs.where((F.length("_ln") > F.length("_sn")) & F.col("_ln").contains(F.col("_sn")))
    ends = F.array(F.struct(F.col("_ln").alias("_n"), F.col("_so").alias("_first")), F.struct(F.col("_sn").alias("_n"), F.col("_lo").alias("_first")))
    links = pairs.select(*keys, F.inline(ends)).groupBy(*keys, "_n").agg(F.min("_first").alias("_first"))
    first = texts.join(links.hint("merge"), [*keys, "_n"], "left").select(*keys, "_n", F.least("_o", "_first").alias("dup_of"))
    found = rows.join(first.hint("merge"), [*keys, "_n"]).where(F.col("dup_of") < F.col("ord")).select(*keys, "ord", "dup_of")
    return cut_lineage(found, dealt=True)


def label_value(text: Column) -> Column:
    """``label: value`` of a line as a struct, else NULL: label of at most 20 characters, no second colon."""
    pattern = r"^([^：:]{1,20})[：:]\s*(.+)$"
    t = F.trim(text)
    label, value = (F.trim(F.regexp_extract(t, pattern, i)) for i in (1, 2))
    return F.when(t.rlike(pattern) & ~value.rlike("[：:]"), F.struct(label.alias("label"), value.alias("value")))


def label_value_fields(lines: DataFrame, text: str = "text") -> DataFrame:
    """``label: value`` lines, with their label and value."""
    rows = lines.withColumn("_f", label_value(F.col(text))).where(F.col("_f").isNotNull())
    return rows.withColumn("label", F.col("_f.label")).withColumn("value", F.col("_f.value")).drop("_f")


def check_states(items: DataFrame) -> DataFrame:
    """Checked / unchecked marks with their label: the rest of the text, else the nearest
    text to the right; each label once.  A lone ``x`` is a mark, a word with x is not."""
    from screenlake.operators.spatial import right_labels

    text = F.trim("text")
    state = F.when(F.lower(text).rlike(RB.CHECKED_MARKS), True).when(text.rlike(RB.UNCHECKED_MARKS), False)
    marks = items.withColumn("checked", state).where(F.col("checked").isNotNull())
    marks = marks.withColumn("_rest", F.trim(F.regexp_replace(text, RB.MARK_PREFIX, "")))
    labels = right_labels(marks.where(F.col("_rest") == ""), items)
    rows = marks.join(labels, ["image_id", "ord"], "left")
    rows = rows.withColumn("label", F.when(F.col("_rest") != "", F.col("_rest")).otherwise(F.col("label")))
    rows = rows.where(F.coalesce(F.col("label") != "", F.lit(False))).select("image_id", "label", "checked", "ord")
    return keep_first(rows, ["image_id", "label"], ["ord"])


def document_fields(docs: DataFrame, key: str, text: str, doc_type: str) -> DataFrame:
    """Labelled fields of a document by its type (key, pos, label, value), each value once."""
    entries = []
    for i, (types, label, pattern) in enumerate(RB.DOCUMENT_FIELDS):
        value = F.trim(F.regexp_extract(text, "(?i)" + pattern, 1))
        wanted = value != "" if types is None else (value != "") & F.col(doc_type).isin(types)
        entries.append(F.when(wanted, F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), value.alias("value"))))
    fields = docs.select(key, F.explode(F.array_compact(F.array(*entries))).alias("f")).select(key, "f.*")
    return fields
