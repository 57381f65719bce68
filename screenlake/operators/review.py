"""Annotation structure rules, validation and review state (WIN-9..11, DS-1..9, AGG-10..12).

Shared inputs
    elements   image_id, element_id, ord, type, text, x, y, w, h
    relations  image_id, ord, src, dst, type, source, review_status
    children   image_id, parent_id, child_id      (the declared child lists, exploded)
    actions    image_id, action_id, subject_kind, subject_id, action, signature, created_at
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from screenlake.functions import geometry as G
from screenlake.functions.semantics import constant_table, js_round, upper_median
from screenlake.operators.spatial import tightest_parent, touching_pairs
from screenlake.operators.trees import climb
from screenlake.session import cut_lineage

# Fixed values of the structure rules.
RULES = [
    ("isolated-content", 2, "medium"),
    ("sibling-overlap", 1, "medium"),
    ("sibling-size-inconsistent", 1, "low"),
]
CONTENT_TYPES = [
    "text", "title", "subtitle", "icon", "image", "avatar", "button", "input", "textarea", "select", "checkbox", "radio", "switch",
]
PAGE_LEVEL_TYPES = ["navbar", "header", "footer", "tabbar", "toolbar", "title", "subtitle"]
CONTAINER_TYPES = [
    "card", "section", "column", "navbar", "header", "footer", "tabbar", "toolbar", "container", "row", "grid", "list",
    "table", "dialog", "bottomSheet", "drawer",
]
DRAFT_WARNING = "pipeline-generated draft annotation - not human verified"
SIBLING_IOU = 0.3
SIZE_DEVIATION = 0.25


def _with_ends(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Relations with ``_src`` and ``_dst``: whether there is an element at that end."""
    ids = elements.select("image_id", F.col("element_id").alias("_id")).distinct()
    for end in ("src", "dst"):
        # ids may be a small file of many rows: never broadcast them through the driver
        known = ids.withColumnRenamed("_id", end).withColumn("_" + end, F.lit(True)).hint("merge")
        relations = relations.join(known, ["image_id", end], "left").withColumn("_" + end, F.coalesce("_" + end, F.lit(False)))
    return relations


def _orphans(relations: DataFrame) -> DataFrame:
    missing = relations.where(~(F.col("_src") & F.col("_dst"))).withColumn("missing", F.when(F.col("_src"), F.col("dst")).otherwise(F.col("src")))
    return missing.drop("_src", "_dst")


def orphan_relations(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Relations with a missing end; names the missing id (the source end first)."""
    return _orphans(_with_ends(relations, elements))


def _known_ends(relations: DataFrame, elements: DataFrame) -> DataFrame:
    ids = elements.select("image_id", F.col("element_id").alias("_id")).distinct()
    out = relations.join(ids.withColumnRenamed("_id", "src"), ["image_id", "src"], "left_semi")
    return out.join(ids.withColumnRenamed("_id", "dst"), ["image_id", "dst"], "left_semi")


def _content_under_pages(elements: DataFrame, relations: DataFrame, children: DataFrame) -> DataFrame:
    """Content elements whose parent is a page, with ``parent_id``.  The parent is that of the last contains
    relation, else of the first declared child list (by parent order); unknown parents don't count."""
    first = elements.groupBy("image_id", F.col("element_id").alias("parent_id")).agg(F.min("ord").cast("double").alias("_p"), F.max(F.col("type") == "page").alias("_page"))

    def first_parent(links: DataFrame, name: str, *rank: str) -> DataFrame:
        known = links.join(first.hint("merge"), ["image_id", "parent_id"])
        return known.groupBy("image_id", "element_id").agg(F.min_by(F.struct("parent_id", "_page"), F.struct(*rank)).alias(name))

    rel = relations.where(F.col("type") == "contains").select("image_id", F.col("dst").alias("element_id"), F.col("src").alias("parent_id"), (-F.col("ord")).alias("_at"))
    declared = children.select("image_id", F.col("child_id").alias("element_id"), "parent_id")
    content = elements.where(F.col("type").isin(CONTENT_TYPES) & ~F.col("type").isin(PAGE_LEVEL_TYPES))
    # relations of one place, and lists, go by their parent's place; no union, which would lose the deal
    for links, *rank in ((rel, "_related", "_at", "_p"), (declared, "_declared", "_p")):
        content = content.join(first_parent(links, *rank).hint("merge"), ["image_id", "element_id"], "left")
    return content.withColumn("_f", F.coalesce("_related", "_declared")).where("_f._page").withColumn("parent_id", F.col("_f.parent_id"))


def _finding(df: DataFrame, code: str, evidence: Column) -> DataFrame:
    _, version, severity = next(r for r in RULES if r[0] == code)
    return df.select(
        "image_id", F.lit(code).alias("code"), F.lit(version).alias("version"), F.lit(severity).alias("severity"),
        "element_id", "parent_id", "type", G.box_key(G.box()).alias("bbox_hash"), evidence.cast("int").alias("evidence_pct"),
    )


def rule_isolated_content(elements: DataFrame, relations: DataFrame, children: DataFrame, dealt: bool = False) -> DataFrame:
    """Content elements that hang directly under the page.

    The inputs of the rules are dealt by image (``dealt``: they are already) and joined there."""
    return cut_lineage(_isolated_content(*_by_image(dealt, elements, relations, children)), dealt=True)


def _isolated_content(elements: DataFrame, relations: DataFrame, children: DataFrame) -> DataFrame:
    return _finding(_content_under_pages(elements, relations, children), "isolated-content", F.lit(0))


def _by_image(dealt: bool, *inputs: DataFrame) -> tuple[DataFrame, ...]:
    return inputs if dealt else tuple(df.repartition("image_id") for df in inputs)


def _siblings(elements: DataFrame, children: DataFrame) -> DataFrame:
    kids = children.withColumnRenamed("child_id", "element_id")
    return elements.select("image_id", "element_id", "type", "x", "y", "w", "h").join(kids, ["image_id", "element_id"])


def rule_sibling_overlap(elements: DataFrame, children: DataFrame, dealt: bool = False) -> DataFrame:
    """Same-type siblings with IoU > 0.3: the smaller one, once, with the first overlap in
    child-list order (child lists are kept sorted by id)."""
    elements, children = _by_image(dealt, elements, children)
    return cut_lineage(_sibling_overlap(_marked_siblings(elements, children)), dealt=True)


def _marked_siblings(elements: DataFrame, children: DataFrame) -> DataFrame:
    """Siblings in the order of their parents; ``_in_page`` where the parent is a page."""
    pages = elements.where(F.col("type") == "page").select("image_id", F.col("element_id").alias("parent_id"), F.lit(True).alias("_in_page")).distinct()
    return _siblings(elements, children).join(pages.hint("merge"), ["image_id", "parent_id"], "left")


def _sibling_overlap(sib: DataFrame) -> DataFrame:
    sib = sib.where(F.col("_in_page").isNull()).drop("_in_page")
    pairs = touching_pairs(sib, sib, ["image_id", "parent_id", "type"]).where(F.col("a_element_id") < F.col("b_element_id"))
    a, b = G.box("a_"), G.box("b_")
    pairs = pairs.withColumn("iou", G.iou(a, b)).where(F.col("iou") > SIBLING_IOU)
    first_smaller = a.area <= b.area
    small = F.when(first_smaller, F.struct(F.col("a_element_id").alias("element_id"), *a.aliased())).otherwise(
        F.struct(F.col("b_element_id").alias("element_id"), *b.aliased())
    )
    flagged = pairs.select(
        "image_id", "parent_id", "type", small.alias("s"), "iou", F.struct("a_element_id", "b_element_id").alias("o")
    )
    flagged = flagged.groupBy("image_id", "parent_id", "type", "s").agg(F.min_by("iou", "o").alias("iou"))
    return _finding(flagged.select("image_id", "parent_id", "type", "iou", "s.*"), "sibling-overlap", js_round(F.col("iou") * 100))


def rule_sibling_size(elements: DataFrame, children: DataFrame, dealt: bool = False) -> DataFrame:
    """Siblings of a type whose width or height is more than 25 % off the upper median."""
    return cut_lineage(_sibling_size(_siblings(*_by_image(dealt, elements, children))), dealt=True)


def _sibling_size(sib: DataFrame) -> DataFrame:
    keys = ["image_id", "parent_id", "type"]
    # where they were joined: the siblings of a parent are not joined a second time for their medians
    group = W.partitionBy(*keys)
    rows = sib.dropna(subset=keys).select("*", F.count(F.lit(1)).over(group).alias("n"), upper_median("w").over(group).alias("mw"), upper_median("h").over(group).alias("mh"))
    rows = rows.where(F.col("n") >= 2)
    one = F.lit(1.0)
    dw = F.abs(F.col("w") - F.col("mw")) / F.greatest(one, F.col("mw"))
    dh = F.abs(F.col("h") - F.col("mh")) / F.greatest(one, F.col("mh"))
    hits = rows.where((dw > SIZE_DEVIATION) | (dh > SIZE_DEVIATION))
    # the evidence names both deviations; the larger one is what review works with
    return _finding(hits, "sibling-size-inconsistent", F.greatest(F.lit(25.0), js_round(dw * 100), js_round(dh * 100)))


def structure_findings(elements: DataFrame, relations: DataFrame, children: DataFrame, dealt: bool = False) -> DataFrame:
    """All rule findings with review subject and versioned signature.

    The inputs are dealt by image once (``dealt``: they are already); every join of the rules has the
    image among its keys and takes place there, as does what reads the findings."""
    elements, relations, children = _by_image(dealt, elements, relations, children)
    sib = cut_lineage(_marked_siblings(elements, children), dealt=True)
    rows = _isolated_content(elements, relations, children).unionByName(_sibling_overlap(sib)).unionByName(_sibling_size(sib))
    return cut_lineage(rows, dealt=True).withColumn("subject_id", F.concat_ws(":", "code", "element_id")).withColumn(
        "signature", F.concat_ws(":", F.col("version").cast("string"), "code", "element_id", "bbox_hash", "type")
    )


def latest_actions(actions: DataFrame) -> DataFrame:
    """The last action per (image, kind, subject)."""
    keys = ["image_id", "subject_kind", "subject_id"]
    rest = [c for c in actions.columns if c not in keys]
    last = actions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "action_id")).alias("r"))
    return last.select(*keys, *(F.col("r")[c].alias(c) for c in rest))


def review_status(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Findings with their review status; NULL when unreviewed or signed for an older
    state of the element."""
    last = latest_actions(actions.where(F.col("subject_kind") == "structure-finding"))
    last = last.select("image_id", "subject_id", "action", F.col("signature").alias("_signed"))
    rows = findings.join(last, ["image_id", "subject_id"], "left")
    stale = F.coalesce(F.col("_signed") != F.col("signature"), F.lit(False))
    status = (
        F.when(F.col("action").isNull() | stale, F.lit(None).cast("string"))
        .when(F.col("action").isin("confirmed", "accepted"), "confirmed")
        .when(F.col("action") == "overridden", "overridden")
        .when(F.col("action").isin("suppressed", "rejected"), "suppressed")
        .otherwise("auto")
    )
    return rows.withColumn("status", status).drop("_signed", "action")


def eligibility(headers: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per image: eligible for the benchmark, else the reason.  ``reviewed`` comes from
    ``review_status``; only medium findings keep an image out."""
    closed = F.coalesce(F.col("status").isin("confirmed", "overridden", "suppressed"), F.lit(False))
    still_open = reviewed.where((F.col("severity") == "medium") & ~closed).select("image_id").distinct().withColumn("_open", F.lit(True))
    rows = headers.join(still_open, "image_id", "left")
    draft = F.array_contains(F.coalesce("warnings", F.array().cast("array<string>")), DRAFT_WARNING)
    reason = F.when(draft, "draft: annotation not human-reviewed").when(F.col("_open"), "open-high-severity-findings")
    return rows.select("image_id", reason.isNull().alias("eligible"), reason.alias("reason"))


def exclusion_tally(excluded: DataFrame) -> DataFrame:
    """One row of counts by reason kind."""
    r = F.col("reason")
    kind = (
        F.when(r == "sidecar", "sidecar").when(r.startswith("invalid"), "invalid").when(r.startswith("draft"), "draft")
        .when(r == "open-high-severity-findings", "open_high_severity").otherwise("other")
    )
    rows = excluded.withColumn("k", kind)
    count = lambda name: F.count(F.when(F.col("k") == name, 1)).alias(name)
    return rows.agg(F.count(F.lit(1)).alias("total"), *map(count, ("sidecar", "invalid", "draft", "open_high_severity", "other")))


def rule_calibration(reviewed: DataFrame) -> DataFrame:
    """Counts per rule over reviewed findings; rules without findings give zero rows."""
    rules = constant_table(reviewed.sparkSession, ["code", "version"], [(c, v) for c, v, _ in RULES])
    status = F.coalesce("status", F.lit("unreviewed"))
    counts = reviewed.groupBy("code").agg(
        F.count(F.lit(1)).alias("raised"),
        *(F.count(F.when(status == s, 1)).alias(a) for s, a in (
            ("confirmed", "confirmed"), ("overridden", "overridden"), ("suppressed", "suppressed"), ("auto", "rejected"), ("unreviewed", "unreviewed"),
        )),
    )
    return F.broadcast(rules).join(counts, "code", "left").fillna(0)


def rule_precision(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision = (confirmed + overridden) / reviewed; uncalibrated or below the
    threshold means advisory only."""
    sums = counts.groupBy("code").agg(F.max("version").alias("version"), *(
        F.sum(c).alias(c) for c in ("raised", "confirmed", "overridden", "suppressed", "rejected")
    ))
    seen = F.col("confirmed") + F.col("overridden") + F.col("suppressed") + F.col("rejected")
    rows = sums.withColumn("reviewed", seen)
    precision = F.when(F.col("reviewed") > 0, (F.col("confirmed") + F.col("overridden")) / F.col("reviewed")).otherwise(F.lit(0.0))
    rows = rows.withColumn("precision", precision).withColumn("calibrated", F.col("reviewed") > 0)
    return rows.select(
        "code", "version", "calibrated", "precision", "reviewed", "raised",
        (~F.col("calibrated") | (F.col("precision") < threshold)).alias("advisory_only"),
    )


def children_vs_contains(children: DataFrame, relations: DataFrame) -> DataFrame:
    """Declared children without a contains relation, and the reverse: both sides meet in one grouping."""
    declared = children.select("image_id", "parent_id", "child_id", F.lit(1).alias("_declared"), F.lit(0).alias("_related"))
    related = relations.where(F.col("type") == "contains").select("image_id", F.col("src").alias("parent_id"), F.col("dst").alias("child_id"), F.lit(0).alias("_declared"), F.lit(1).alias("_related"))
    both = declared.unionByName(related).groupBy("image_id", "parent_id", "child_id").agg(F.max("_declared").alias("_declared"), F.max("_related").alias("_related"))
    code = F.when(F.col("_related") == 0, "child-not-in-contains").otherwise("contains-not-in-children")
    return both.where(F.col("_declared") != F.col("_related")).select("image_id", "parent_id", "child_id", code.alias("code"))


def containment_cycles(relations: DataFrame) -> DataFrame:
    """Images whose contains graph has a cycle.

    Edges that leave a root or enter a leaf cannot lie on a cycle; they are peeled from
    both ends until nothing changes, and what remains holds the cycles."""
    edges = relations.where(F.col("type") == "contains").select("image_id", "src", "dst").distinct()
    left = cut_lineage(edges)
    n = left.count()
    while n:
        inner = left.join(left.select("image_id", F.col("dst").alias("src")).distinct(), ["image_id", "src"], "left_semi")
        inner = inner.join(left.select("image_id", F.col("src").alias("dst")).distinct(), ["image_id", "dst"], "left_semi")
        inner = cut_lineage(inner.select("image_id", "src", "dst"))
        m = inner.count()
        left = inner
        if m == n:
            break
        n = m
    return left.select("image_id").distinct()


def _element_errors(elements: DataFrame, meta: DataFrame) -> DataFrame:
    """Errors of the elements themselves, in one pass over the sorted elements of each image."""
    big = 1.7976931348623157e308
    finite = F.lit(True)
    for c in "xywh":
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) <= big), F.lit(False))
    ok, b = F.col("_ok"), G.box()
    # what a box can show by itself is judged before the shuffle; only its far edges meet the size of the image
    rows = elements.withColumn("_ok", finite).select(
        "image_id", "element_id", "_ok", F.coalesce(F.col("type") == "page", F.lit(False)).alias("_page"), (ok & ((b.w <= 0) | (b.h <= 0))).alias("_flat"),
        ((b.x < 0) | (b.y < 0)).alias("_before"), b.right.alias("_right"), b.bottom.alias("_bottom"),
    )
    sorted_ids = W.partitionBy("image_id").orderBy("element_id")
    # one error per repeat of an id, one for the second root
    rows = rows.withColumn("_again", F.lag(F.struct("element_id")).over(sorted_ids).eqNullSafe(F.struct("element_id")))
    rows = rows.withColumn("_pages", F.sum(F.col("_page").cast("long")).over(sorted_ids.rowsBetween(W.unboundedPreceding, 0)))
    # sizes may be given twice, which must not repeat the errors of ids and roots
    sizes = meta.select("image_id", "width", "height", F.row_number().over(W.partitionBy("image_id").orderBy("image_id")).alias("_size"))
    rows = rows.join(sizes.hint("merge"), "image_id", "left")
    once, el = F.coalesce(F.col("_size") == 1, F.lit(True)), F.col("element_id")
    outside = F.col("_before") | (F.col("_right") > F.col("width") + 0.5) | (F.col("_bottom") > F.col("height") + 0.5)
    none = F.lit(None).cast(elements.schema["element_id"].dataType)
    errors = [
        (F.col("_again") & once, "duplicate-id", el), (~ok, "bbox-invalid", el), (F.col("_flat"), "bbox-invalid-size", el),
        (ok & outside, "bbox-out-of-bounds", el), (F.col("_page") & (F.col("_pages") == 2) & once, "multiple-page-roots", none),
    ]
    found = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(code).alias("code"), at.alias("element_id"))) for when, code, at in errors)))
    return rows.select("image_id", F.explode(found).alias("_e")).select("image_id", "_e.code", "_e.element_id")


def validate_annotations(elements: DataFrame, relations: DataFrame, children: DataFrame, meta: DataFrame) -> DataFrame:
    """Errors (image_id, code, element_id, detail) of every annotation.

    Elements are dealt by image once for their own errors and once, as ids, for the ends of the
    relations; these are looked up where they were dealt and written."""
    none = F.lit(None).cast("string")

    def err(df: DataFrame, code: str, element: Column | None = None, detail: Column | None = None) -> DataFrame:
        return df.select(
            "image_id", F.lit(code).alias("code"), (none if element is None else element).alias("element_id"),
            (none if detail is None else detail).alias("detail"),
        )

    ends = _with_ends(relations.select("image_id", "src", "dst", "type").repartition("image_id"), elements.select("image_id", "element_id").repartition("image_id"))
    ends = cut_lineage(ends, dealt=True)
    known = ends.where(F.col("_src") & F.col("_dst"))
    parents = known.where(F.col("type") == "contains").groupBy("image_id", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mismatch = children_vs_contains(children, ends)
    parts = [
        _element_errors(elements, meta).withColumn("detail", none),
        err(_orphans(ends), "relation-endpoint-missing", None, F.col("missing")),
        err(parents, "multiple-parents", F.col("dst")),
        err(containment_cycles(known), "containment-cycle"),
        mismatch.select("image_id", "code", F.col("parent_id").alias("element_id"), F.col("child_id").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def normalize_tree(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Final parent per element: the last confirmed human contains relation, else the
    tightest containing element.  Only elements with a parent are returned.

    Elements and relations are dealt by image once and joined there."""
    elements = elements.select("image_id", "element_id", "x", "y", "w", "h").repartition("image_id")
    confirmed = F.col("review_status").isNull() | (F.col("review_status") == "confirmed")
    human = relations.where((F.col("type") == "contains") & (F.col("source") == "human") & confirmed).select("image_id", "src", "dst", "ord")
    human = _known_ends(human.repartition("image_id"), elements)
    human = human.groupBy("image_id", F.col("dst").alias("element_id")).agg(F.max_by("src", "ord").alias("_human"))
    rows = tightest_parent(elements, "strict", "element_id").join(human, ["image_id", "element_id"], "left")
    rows = rows.select(
        "image_id", "element_id", F.coalesce("_human", "parent_id").alias("parent_id"),
        F.when(F.col("_human").isNotNull(), "human").otherwise("derived").alias("source"),
    )
    return cut_lineage(rows.where(F.col("parent_id").isNotNull()), dealt=True)


def tree_paths(nodes: DataFrame, ord: str | None = None) -> DataFrame:
    """Depth and root of every node, level by level (image_id, node_id, parent_id).  Walks
    from the roots, so nodes on a cycle are never reached and the levels come to an end.
    With ``ord``, the place among siblings, ``trail`` lists the places from the root down: the
    order of trails is the pre-order walk."""
    places = [] if ord is None else [F.array(ord).alias("trail")]
    base = nodes.select("image_id", "node_id", "parent_id", *places)
    level = cut_lineage(base.where(F.col("parent_id").isNull()).select("image_id", "node_id", F.lit(0).alias("depth"), F.col("node_id").alias("root_id"), F.col("node_id").alias("path"), *([] if ord is None else ["trail"])))
    out = level
    for depth in itertools.count(1):
        up = level.select("image_id", F.col("node_id").alias("parent_id"), "root_id", F.col("path").alias("_path"), *([] if ord is None else [F.col("trail").alias("_trail")]))
        # a level is a small file and many rows: never broadcast one through the driver
        nxt = base.join(up.hint("merge"), ["image_id", "parent_id"]).select(
            "image_id", "node_id", F.lit(depth).alias("depth"), "root_id", F.concat_ws("/", "_path", "node_id").alias("path"),
            *([] if ord is None else [F.concat("_trail", "trail").alias("trail")]),
        )
        level = cut_lineage(nxt)
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    return out


def tree_depths(nodes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Depth of every node (image_id, node_id, depth), with the columns ``carry`` beside it.  Nodes
    climb to their roots, so those on a cycle or below an unknown parent are left out."""
    base = nodes.select(*dict.fromkeys(["image_id", "node_id", "parent_id", *carry])).repartition("image_id")
    rows = base.select("image_id", "node_id", *carry, F.lit(0).alias("depth"), F.col("parent_id").alias("_up"))
    return climb(rows, {"depth": F.col("depth") + F.col("_udepth") + 1}, dropped=True).where(F.col("_up").isNull()).drop("_up")


# Fixed values of the review heuristics (patterns and bounds).
STATUS_BAR = r"^(\d{1,2}:\d{2}|\d+%|(?i:AM|PM)|(?i:中国移动|中国联通|中国电信|WiFi|Wi-Fi|5G|4G|LTE|GPRS))$"
GARBLED_NETWORK = r"(?i)(5G|4G|LTE)"
GARBLED_DIGITS = r"^[\d\s%G]+$"


def _page_ratios(findings: DataFrame, elements: DataFrame) -> DataFrame:
    el = elements.select(
        "image_id", "element_id", F.trim(F.coalesce("text", F.lit(""))).alias("_text"), *G.box().aliased("e_")
    )
    page = F.col("type") == "page"
    image = elements.groupBy("image_id").agg(
        F.min_by(F.when(page, F.struct("w", "h")), F.when(page, F.col("ord"))).alias("_page"), F.max(F.col("type").isin(CONTAINER_TYPES)).alias("has_containers")
    )
    rows = findings.join(el, ["image_id", "element_id"], "left").join(image, "image_id", "left")
    pw, ph = F.col("_page.w"), F.col("_page.h")
    return rows.select(
        "*", (F.col("e_y") / ph).alias("y_ratio"), ((F.col("e_y") + F.col("e_h")) / ph).alias("bottom_ratio"),
        (F.col("e_w") / pw).alias("width_ratio"), (F.col("e_w") * F.col("e_h") / (pw * ph)).alias("area_ratio"),
        ((pw > 0) & (ph > 0)).alias("_has_page"),
    )


def auto_review(findings: DataFrame, elements: DataFrame, actions: DataFrame, dealt: bool = False) -> DataFrame:
    """Heuristic confirm / suppress decision for findings whose signature was not
    reviewed yet; ``action`` is NULL where the heuristic does not decide.

    The inputs are dealt by image (``dealt``: they are already) and joined there."""
    findings, elements, actions = _by_image(dealt, findings, elements, actions)
    signed = actions.where(F.col("signature").isNotNull()).select("image_id", "signature").distinct()
    rows = _page_ratios(findings.join(signed, ["image_id", "signature"], "left_anti"), elements)
    text, n, kind = F.col("_text"), F.length("_text"), F.col("type")
    status_bar = text.rlike(STATUS_BAR)
    digit = text.rlike(r"\d")
    garbled = (n > 0) & (n <= 14) & digit & (text.rlike(GARBLED_NETWORK) | (text.rlike(GARBLED_DIGITS) & (n <= 12)))
    top, bottom = F.col("y_ratio") < 0.05, F.col("bottom_ratio") > 0.95
    code, pct = F.col("code"), F.col("evidence_pct")
    suppressed, confirmed, open_ = F.lit("suppressed"), F.lit("confirmed"), F.lit(None).cast("string")
    action = (
        F.when(code == "sibling-size-inconsistent", F.when((pct > 50) | (pct >= 42), confirmed).otherwise(suppressed))
        .when(code == "sibling-overlap", confirmed)
        .when(code != "isolated-content", open_)
        .when(~F.col("has_containers"), suppressed)
        .when(kind == "icon", suppressed)
        .when(F.col("e_x").isNull(), open_)
        .when(status_bar, suppressed)
        .when(~F.coalesce("_has_page", F.lit(False)), open_)
        .when(F.col("width_ratio") > 0.80, suppressed)
        .when((kind == "image") & (F.col("area_ratio") > 0.20), suppressed)
        .when(top & (kind == "text") & (garbled | (n <= 8)), suppressed)
        .when(bottom & ((kind == "avatar") | ((kind == "text") & (n <= 4))), suppressed)
        .when(kind == "avatar", suppressed)
        .when((kind == "text") & (n <= 4), suppressed)
        .otherwise(confirmed)
    )
    return cut_lineage(rows.select("image_id", "subject_id", "signature", "code", "type", action.alias("action")), dealt=True)


def pending_isolated(findings: DataFrame, elements: DataFrame, actions: DataFrame) -> DataFrame:
    """Breakdown of isolated-content findings nobody reviewed yet, by type, page
    position, containers, full width and text category."""
    seen = actions.select("image_id", "subject_id").distinct()
    rows = findings.where(F.col("code") == "isolated-content").join(seen, ["image_id", "subject_id"], "left_anti")
    rows = _page_ratios(rows, elements)
    text = F.col("_text")
    category = (
        F.when(text == "", "none").when(text.rlike(r"^\d{1,2}:\d{2}$"), "time").when(text.rlike(r"^\d+%$"), "percent")
        .when(text.rlike(r"^(?i:AM|PM)$"), "ampm")
        .when(text.rlike(r"^(?i:中国移动|中国联通|中国电信|WiFi|Wi-Fi|5G|4G|LTE|GPRS)$"), "status-token")
        .when(F.length(text) <= 4, "short-label").otherwise("long-text")
    )
    position = F.when(F.col("y_ratio") < 0.10, "top").when(F.col("bottom_ratio") > 0.90, "bottom").otherwise("middle")
    return rows.groupBy(
        "type", position.alias("position"), "has_containers", (F.col("width_ratio") > 0.80).alias("full_width"),
        category.alias("text_category"),
    ).agg(F.count(F.lit(1)).alias("n"))
