"""Node typing and enrichment rules (TYP-*).

Nodes are an adjacency list: image_id, node_id, parent_id, ord, type, text, x, y, w, h.
Rules that retype return ``new_type`` beside the old one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from screenlake.functions import geometry as G
from screenlake.functions.semantics import js_round, keep_first, round_half_up
from screenlake.operators.layout import direction_of, top_k_per_group
from screenlake.operators.rules import words
from screenlake.operators.spatial import touching_pairs
from screenlake.operators.trees import climb

# Fixed values of the typing rules.
REGION_TYPES = [("header", "header"), ("footer", "footer"), ("sidebar", "sidebar"), ("card", "card"), ("nav", "navbar"), ("table", "table"), ("main", "section"), ("content", "container")]
COMPONENT_TYPES = [
    ("button", "button"), ("input", "input"), ("dropdown", "dropdown"), ("table", "table"), ("tab", "tab"), ("card", "card"), ("checkbox", "checkbox"),
    ("toggle", "switch"), ("badge", "badge"), ("avatar", "avatar"), ("icon", "icon"), ("image", "image"), ("unknown", "unknown"),
]
MEDIA_TYPES = [("icon", "icon"), ("image", "image"), ("logo", "avatar")]
BUTTON_WORDS = (
    r"(?i)^(保存|取消|确定|提交|关闭|新增|删除|编辑|查询|搜索|筛选|登录|注册|添加|修改|确认|返回|下一步|上一步|下载|导出|导入|刷新|重置|"
    r"save|cancel|submit|close|add|delete|edit|search|filter|login|register|confirm|back|next|download|export|import|refresh|reset)$"
)
TAB_WORDS = r"(?i)^(全部|待办|已完成|已关闭|进行中|tab|概览|详情|设置|all|active|done|close|open|tab)$"
CHECK_WORDS, TOGGLE_WORDS = r"(?i)^(✓|√|☑|☐|是|否|开|关|on|off|yes|no|启用|停用)$", r"(?i)^(开|关|on|off)$"
BADGE_MARKS = r"(?i)^\[?\d+\]?$|^new$|^hot$|^sale$"
INPUT_WORDS, DROPDOWN_WORDS = r"(?i)^(请输入|请选择|请搜索|搜索|placeholder|select|choose)", r"(?i)▼|▾|请选择|select"
DANGER_WORDS, SUCCESS_WORDS = r"(?i)^(删除|移除|危险|delete|remove|danger)", r"(?i)^(成功|完成|通过|success|approve)"
PRIMARY_WORDS = r"(?i)^(保存|确定|提交|新增|确认|登录|注册|save|submit|confirm|add|login|register)$"
GHOST_WORDS = r"(?i)^(取消|关闭|返回|重置|cancel|close|back|reset)$"
BADGE_WORDS = (
    r"(?i)^(?:new|hot|vip|pro|plus|live|beta|sale|top|up|3d|hd|4k|8k|限时特惠|限时|特惠|推荐|热门|精选|新品|爆款|首发|独家|官方|认证|已认证|未认证|"
    r"未读消息|未读|已读|在线|离线|忙碌|勿扰|隐身|满减|直降|包邮|即将售罄|售罄|缺货|预售|预约|会员|免费|优惠|折扣)$"
)
BADGE_NUMBER, BADGE_SPLIT = r"^\d+(?:\.\d+)?(?:\+)?$", r"^(.+?)\s*(\d+)$"
SCRIPT_CHARS = "[一-鿿぀-ヿ가-힯]"
ACTION_WORDS = (
    r"(?i)^(?:保存|取消|确定|提交|关闭|新增(?:地址)?|删除|编辑|查询|搜索|筛选|登录|注册|添加|修改|确认|返回|下一步|上一步|下载|导出|导入|刷新|重置|兑换|使用|"
    r"立即使用|去使用|领取|购买|支付|完成|继续|save|cancel|submit|close|add|delete|edit|search|filter|login|register|confirm|back|next|download|export|"
    r"import|refresh|reset|redeem|use|buy|pay|continue)$"
)
SELECT_WORDS, RADIO_WORDS, CHECKBOX_WORDS = ["请选择", "选择", "下拉", "selected", "select"], ["单选", "radio", "○"], ["多选", "checkbox", "☑", "□", "勾选"]
INTERACTIVE = ["button", "iconButton", "input", "textarea", "select", "checkbox", "radio", "switch", "dropdown"]
BUTTON_REGIONS = ["container", "unknown", "footer", "navbar", "card", "section"]
TEXT_REGIONS = ["container", "unknown", "header", "footer", "navbar", "card", "section"]
VARIANTS = ["primary", "secondary", "success", "danger", "ghost", "default"]
STATES = ["default", "active", "disabled", "selected"]
DISABLED_WORDS = ["已禁用", "禁用", "disabled", "不可用", "不可点击"]
SELECTED_WORDS = ["已选", "选中", "selected", "active", "已激活", "当前"]
OVERLAY_TYPES = ["card", "container", "section", "unknown", "sidebar", "footer"]
LOGO_WORDS = r"(?i)logo|品牌|标志|商标"
ALT_TEXT = [("icon", "图标"), ("image", "图片"), ("logo", "Logo")]


def node_ids(nodes: DataFrame, order: str) -> DataFrame:
    """``type:x,y,w,h`` ids; the second and later nodes of a base get ``#2``, ``#3``…"""
    base = F.concat_ws(":", "type", G.box_key(G.box()))
    k = F.row_number().over(W.partitionBy("image_id", "_base").orderBy(order))
    out = nodes.withColumn("_base", base).withColumn("_k", k)
    name = F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat_ws("#", "_base", F.col("_k").cast("string")))
    return out.withColumn("node_id", name).drop("_base", "_k")


def map_types(kind: Column, table: Sequence[tuple[str, str]]) -> Column:
    out = None
    for a, b in table:
        out = (F if out is None else out).when(kind == a, F.lit(b))
    return out.otherwise("unknown")


def classify_regions(regions: DataFrame, meta: DataFrame, k: int | None = None) -> DataFrame:
    """Type of all regions, or the ``k`` largest, by relative position and area."""
    rows = top_k_per_group(regions.withColumn("_a", G.box().area), ["image_id"], [F.desc("_a"), "region_id"], k)
    rows = rows.join(meta.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id")
    b, w, h = G.box(), F.col("_w"), F.col("_h")
    rows = rows.withColumn("rel_area", round_half_up(F.col("_a") / (w.cast("double") * h), 4))
    rel = F.col("rel_area")
    kind = (
        F.when((b.cy < h * 0.15) & (b.w > w * 0.5), "header").when((b.cy > h * 0.85) & (b.w > w * 0.5), "footer")
        .when(((b.cx < w * 0.25) | (b.cx > w * 0.75)) & (b.h > h * 0.4), "sidebar").when((b.h < h * 0.1) & (b.w > w * 0.3), "nav")
        .when((b.w > w * 0.4) & (b.h > h * 0.2), "table").when((rel > 0.02) & (rel < 0.3), "card").when(rel > 0.3, "main").otherwise("content")
    )
    return rows.withColumn("type", kind).drop("_a", "_w", "_h")


def component_type(text: Column, b: G.Box) -> Column:
    n = F.length(text)
    small = (b.w > 12) & (b.h > 12) & (b.w < 50) & (b.h < 50) & (b.w / b.h > 0.8) & (b.w / b.h < 1.2)
    return (
        F.when(text.rlike(BUTTON_WORDS), "button").when((n <= 6) & text.rlike(TAB_WORDS), "tab")
        .when(text.rlike(CHECK_WORDS), F.when(text.rlike(TOGGLE_WORDS), "toggle").otherwise("checkbox")).when(text.rlike(BADGE_MARKS), "badge")
        .when(small, "avatar").when(text.rlike(INPUT_WORDS), "input").when(text.rlike(DROPDOWN_WORDS), "dropdown").otherwise("unknown")
    )


def infer_components(ocr: DataFrame, meta: DataFrame, k: int | None = None) -> DataFrame:
    """Components named by OCR text and size, one per type and rounded corner, all or the
    first ``k`` per image, with variant and state."""
    b, text = G.box(), F.trim("text")
    rows = ocr.join(meta.select("image_id", "width", "height"), "image_id")
    page = F.col("width").cast("double") * F.col("height")
    rows = rows.where((b.area >= 200) & (b.area <= page * 0.15)).withColumn("text", text)
    rows = rows.withColumn("type", component_type(F.col("text"), b)).where(F.col("type") != "unknown")
    rows = rows.withColumn("_rx", js_round(F.col("x"))).withColumn("_ry", js_round(F.col("y")))
    t, button = F.col("text"), F.col("type") == "button"
    variant = (
        F.when(t.rlike(DANGER_WORDS), "danger").when(t.rlike(SUCCESS_WORDS), "success").when(button & t.rlike(PRIMARY_WORDS), "primary")
        .when(button & t.rlike(GHOST_WORDS), "ghost").otherwise("default")
    )
    rows = rows.select("image_id", "ord", "type", "text", "x", "y", "w", "h", "_rx", "_ry", variant.alias("variant"), F.when(t.rlike("(?i)^(全部|all)$"), "active").otherwise("default").alias("state"))
    once = keep_first(rows, ["image_id", "type", "_rx", "_ry"], ["ord"])
    return top_k_per_group(once, ["image_id"], ["ord"], k).drop("_rx", "_ry")


def with_leaf(nodes: DataFrame) -> DataFrame:
    parents = nodes.where(F.col("parent_id").isNotNull()).select("image_id", F.col("parent_id").alias("node_id")).distinct().withColumn("_p", F.lit(True))
    return nodes.join(parents, ["image_id", "node_id"], "left").withColumn("is_leaf", F.col("_p").isNull()).drop("_p")


def promote_leaf(nodes: DataFrame) -> DataFrame:
    """Leaves by shape and text: divider, progress, textarea, iconButton, tag."""
    rows = with_leaf(nodes)
    w, h, t = F.col("w"), F.col("h"), F.col("type")
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    generic = t.isin("unknown", "container")
    extreme = (w > 0) & (h > 0) & ((w / h > 20) | (h / w > 20))
    new = (
        F.when(~F.col("is_leaf"), t).when(generic & (n == 0) & extreme & (F.least(w, h) <= 16), "divider")
        .when(generic & (n == 0) & (h > 0) & (w / h > 10) & (h < 30), "progress").when((t == "input") & (h > 80), "textarea")
        .when((t == "button") & (n <= 2) & (w < 48) & (h > 0) & (w / h > 0.7) & (w / h < 1.4), "iconButton")
        .when(generic & (n > 0) & (n <= 6) & (w < 120) & (h < 32), "tag").otherwise(t)
    )
    return rows.withColumn("new_type", new)


def promote_container(nodes: DataFrame) -> DataFrame:
    """Generic containers become a toolbar (>= 2 actions, >= 2/3 of the children, one row),
    else container / unknown take the direction of two or more children that are not all
    interactive."""
    kids = nodes.where(F.col("parent_id").isNotNull())
    b, act = G.box(), F.col("type").isin("button", "iconButton", "icon")
    n = F.count(F.lit(1))
    s = kids.groupBy("image_id", F.col("parent_id").alias("node_id")).agg(
        n.alias("_n"), F.count(F.when(act, 1)).alias("_a"), (F.max(F.when(act, b.cy)) - F.min(F.when(act, b.cy))).alias("_ay"),
        F.min(F.col("type").isin(INTERACTIVE).cast("int")).alias("_all"), (F.max(b.cx) - F.min(b.cx)).alias("_dx"), (F.max(b.cy) - F.min(b.cy)).alias("_dy"),
        F.avg("w").alias("_mw"), F.avg("h").alias("_mh"),
    )
    rows = nodes.join(s, ["image_id", "node_id"], "left")
    t = F.col("type")
    toolbar = (
        t.isin("container", "section", "unknown") & (F.col("_a") >= 2) & (F.col("_a") / F.col("_n") >= 2 / 3) & (F.col("h") > 0) & (F.col("w") >= F.col("h"))
        & (F.col("_ay") <= F.col("h") * 0.5)
    )
    lay = t.isin("container", "unknown") & (F.col("_n") >= 2) & (F.col("_all") == 0)
    d = direction_of(F.col("_n"), F.col("_dx"), F.col("_dy"), F.col("_mw"), F.col("_mh"))
    new = F.when(F.coalesce(toolbar, F.lit(False)), "toolbar").when(F.coalesce(lay, F.lit(False)), d).otherwise(t)
    return rows.withColumn("new_type", new).drop("_n", "_a", "_ay", "_all", "_dx", "_dy", "_mw", "_mh")


def promote_badge(nodes: DataFrame) -> DataFrame:
    """Tags with a number or a tiny box, and short number / keyword texts, are badges."""
    t, text = F.col("type"), F.trim("text")
    n = F.length(text)
    tag = (t == "tag") & (F.coalesce(text.rlike(r"^\d"), F.lit(False)) | ((F.col("w") < 32) & (F.col("h") < 24)))
    label = t.isin("text", "subtitle") & (n > 0) & (n <= 8) & (F.col("w") <= 80) & (F.col("h") <= 28) & (text.rlike(BADGE_NUMBER) | text.rlike(BADGE_WORDS))
    return nodes.withColumn("new_type", F.when(tag | F.coalesce(label, F.lit(False)), "badge").otherwise(t))


def split_badge(nodes: DataFrame) -> DataFrame:
    """Leaf texts like ``Inbox 12`` are split into the label and a badge child whose width
    is its share of the characters."""
    rows = with_leaf(nodes)
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_l", F.regexp_extract(text, BADGE_SPLIT, 1)).withColumn("_d", F.regexp_extract(text, BADGE_SPLIT, 2))
    label, digits = F.col("_l"), F.col("_d")
    latin = F.regexp_count(label, F.lit("[a-zA-Z]")) >= 2
    ok = F.col("is_leaf") & F.col("type").isin("text", "subtitle") & (label != "") & (F.length(digits) <= 4) & (label.rlike(SCRIPT_CHARS) | latin)
    bw = F.col("w") * (F.length(digits) / (F.length(label) + F.length(digits)))
    keep = [c for c in nodes.columns if c not in ("node_id", "parent_id", "type", "text", "x", "w")]

    def part(node: Column, parent: Column, kind: Column, txt: Column, x: Column, w: Column) -> Column:
        return F.struct(node.alias("node_id"), parent.alias("parent_id"), kind.alias("type"), txt.alias("text"), x.alias("x"), w.alias("w"))

    c = F.col
    whole = part(c("node_id"), c("parent_id"), c("type"), c("text"), c("x"), c("w"))
    first = part(c("node_id"), c("parent_id"), c("type"), label, c("x"), c("w") - bw)
    badge = part(F.concat("node_id", F.lit("__badge")), c("node_id"), F.lit("badge"), digits, c("x") + c("w") - bw, bw)
    return rows.select(*keep, F.explode(F.when(ok, F.array(first, badge)).otherwise(F.array(whole))).alias("p")).select(*keep, "p.*").select(*nodes.columns)


def promote_by_neighbour(nodes: DataFrame, ocr: DataFrame, near: float = 20.0, band: float = 64.0) -> DataFrame:
    """Inputs become select (a small icon to the right in the same row, or select words
    within 20 px), radio or checkbox (small leaf inputs with such words nearby)."""
    rows = with_leaf(nodes)
    inputs = rows.where(F.col("type") == "input")
    b = G.box()
    # icons collapse to their rightmost left edge per vertical extent; rows meet in y bands
    icons = nodes.where(F.col("type").isin("icon", "avatar") & (b.w <= 48) & (b.h <= 48) & F.col("parent_id").isNotNull())
    icons = icons.groupBy("image_id", "parent_id", F.col("y").alias("i_y"), F.col("h").alias("i_h")).agg(F.max("x").alias("i_x"))
    cells = lambda y, h: F.explode(F.sequence(F.floor(y / band).cast("long"), F.floor((y + h) / band).cast("long")))
    left = inputs.select("image_id", "parent_id", "node_id", "x", "y", "w", "h").withColumn("_band", cells(F.col("y"), F.col("h")))
    right = icons.withColumn("_band", cells(F.col("i_y"), F.col("i_h")))
    pair = left.join(right, ["image_id", "parent_id", "_band"])
    pair = pair.where((F.col("i_x") >= b.right) & (b.y < F.col("i_y") + F.col("i_h")) & (b.bottom > F.col("i_y")))
    by_icon = pair.select("image_id", "node_id").distinct().withColumn("_icon", F.lit(True))
    low = F.lower("text")
    telling = ocr.where(low.rlike(words(SELECT_WORDS + RADIO_WORDS + CHECKBOX_WORDS))).select("image_id", low.alias("text"), "x", "y", "w", "h")
    close = touching_pairs(inputs.select("image_id", "node_id", "x", "y", "w", "h"), telling, reach=near)
    a, o = G.expand(G.box("a_"), near), G.box("b_")
    close = close.where((a.x < o.right) & (a.right > o.x) & (a.y < o.bottom) & (a.bottom > o.y))
    says = lambda ws: F.max(F.col("b_text").rlike(words(ws)).cast("int"))
    flags = close.groupBy("image_id", F.col("a_node_id").alias("node_id")).agg(says(SELECT_WORDS).alias("_s"), says(RADIO_WORDS).alias("_r"), says(CHECKBOX_WORDS).alias("_c"))
    rows = rows.join(by_icon, ["image_id", "node_id"], "left").join(flags, ["image_id", "node_id"], "left")
    small = F.col("is_leaf") & (F.col("w") < 32) & (F.col("h") < 32)
    new = (
        F.when(F.col("type") != "input", F.col("type")).when(F.col("_icon") | (F.col("_s") > 0), "select").when(small & (F.col("_r") > 0), "radio")
        .when(small & (F.col("_c") > 0), "checkbox").otherwise("input")
    )
    return rows.withColumn("new_type", new).drop("_icon", "_s", "_r", "_c")


def hex_channels(color: Column) -> tuple[Column, Column, Column]:
    """Channels of ``#rgb`` / ``#rrggbb`` (NULL when it is not a colour)."""
    return digit_channels(hex_digits(color))


def hex_digits(color: Column) -> Column:
    """``#rgb`` / ``#rrggbb`` as six digits."""
    h = F.regexp_replace(F.trim(color), "^#", "")
    return F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)


def digit_channels(h: Column) -> tuple[Column, Column, Column]:
    ok = h.rlike("^[0-9a-fA-F]{6}$")
    return tuple(F.when(ok, F.conv(F.substring(h, i, 2), 16, 10).cast("double")) for i in (1, 3, 5))


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / top).otherwise(F.lit(0.0))


def correct_types(nodes: DataFrame, ocr: DataFrame, meta: DataFrame) -> DataFrame:
    """Tables of cards become lists; saturated small leaves become buttons; leaves that a
    text of the same wording fills (IoU >= 0.5) become text.  Needs ``bg_color``."""
    rows = with_leaf(nodes).join(meta.select("image_id", F.col("width").alias("_pw"), F.col("height").alias("_ph")), "image_id")
    cards = nodes.where((F.col("type") == "card") & F.col("parent_id").isNotNull()).groupBy("image_id", "parent_id").agg(F.count(F.lit(1)).alias("_cards"))
    lists = nodes.where(F.col("type") == "table").select("image_id", F.col("node_id").alias("parent_id")).join(cards.where("_cards >= 2"), ["image_id", "parent_id"])
    lists = lists.select("image_id", "parent_id", F.lit(True).alias("_in_list"))
    rows = rows.join(lists, ["image_id", "parent_id"], "left")
    rows = rows.join(lists.select("image_id", F.col("parent_id").alias("node_id"), F.lit(True).alias("_is_list")), ["image_id", "node_id"], "left")
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    named = rows.where(F.col("is_leaf") & F.col("type").isin(TEXT_REGIONS) & (F.trim("text") != ""))
    named = named.select("image_id", "node_id", norm(F.col("text")).alias("t"), "x", "y", "w", "h")
    same = touching_pairs(named, ocr.select("image_id", norm(F.col("text")).alias("t"), "x", "y", "w", "h"), ["image_id", "t"])
    tight = same.where(G.iou(G.box("a_"), G.box("b_")) >= 0.5).select("image_id", F.col("a_node_id").alias("node_id")).distinct()
    rows = rows.join(tight.withColumn("_tight", F.lit(True)), ["image_id", "node_id"], "left")
    t, w, h = F.col("type"), F.col("w"), F.col("h")
    absolute = (w < 200) & (h < 60)
    relative = ~absolute & (w <= F.col("_pw") * 0.95) & (h <= F.col("_ph") * 0.09)
    action = F.coalesce(F.trim("text").rlike(ACTION_WORDS), F.lit(False))
    # digits and channels as columns of their own: spelled out they are computed again for each use
    rows = rows.withColumn("_hex", hex_digits(F.col("bg_color")))
    rows = rows.withColumns(dict(zip(("_r", "_g", "_b"), digit_channels(F.col("_hex")))))
    sat = F.coalesce(saturation(F.col("_r"), F.col("_g"), F.col("_b")), F.lit(0.0))
    button = F.col("is_leaf") & t.isin(BUTTON_REGIONS) & (w > 0) & (h > 0) & (sat > 0.15) & ((absolute & t.isin("container", "unknown")) | (relative & action))
    new = (
        F.when(F.col("_is_list"), "list").when(button, "button").when(F.col("_tight"), "text").when(F.col("_in_list") & (t == "card"), "listItem").otherwise(t)
    )
    return rows.withColumn("new_type", new).drop("_pw", "_ph", "_in_list", "_is_list", "_tight", "_hex", "_r", "_g", "_b")


def prune_outside(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """Drop nodes that do not intersect the page together with their subtrees: every node
    climbs until it meets such an ancestor."""
    b = G.box()
    rows = nodes.join(meta.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id")
    out = (b.x >= F.col("_w")) | (b.right <= 0) | (b.y >= F.col("_h")) | (b.bottom <= 0)
    rows = rows.withColumn("_gone", F.coalesce(F.col("parent_id").isNotNull() & out, F.lit(False)))
    # what is gone itself need not ask its ancestors
    rows = rows.select("image_id", "node_id", "_gone", F.when(~F.col("_gone"), F.col("parent_id")).alias("_up")).repartition("image_id")
    gone = climb(rows, {"_gone": F.col("_gone") | F.col("_u_gone")}).where("_gone").select("image_id", "node_id")
    return nodes.join(gone, ["image_id", "node_id"], "left_anti")


def infer_variants(nodes: DataFrame, themes: DataFrame) -> DataFrame:
    """Variant and state of every node with the reason.

    Needs color, variant_hint, state_hint, disabled, text; ``themes``: image_id, primary."""
    rows = nodes.join(themes.select("image_id", F.col("primary").alias("_primary")), "image_id", "left")
    # channels as columns of their own: spelled out in every branch they would swamp codegen
    names = ["_r", "_g", "_b", "_pr", "_pg", "_pb"]
    rows = rows.withColumns(dict(zip(names, (*hex_channels(F.col("color")), *hex_channels(F.col("_primary"))))))
    r, g, b, pr, pg, pb = map(F.col, names)
    dist = F.sqrt((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb))
    hint = F.col("variant_hint").isin(VARIANTS)
    case = lambda *pairs: F.coalesce(*(F.when(c, F.struct(F.lit(v).alias("v") if isinstance(v, str) else v.alias("v"), F.lit(w).alias("why") if isinstance(w, str) else w.alias("why"))) for c, v, w in pairs))
    by_hint = (hint, F.col("variant_hint"), F.concat(F.lit("props:variant="), "variant_hint"))
    yes = F.lit(True)
    variant = F.when(F.col("type") != "button", case((yes, "default", "non-button type"))).when(r.isNull(), case(by_hint, (yes, "default", "no color signal"))).otherwise(
        case(
            (dist < 48, "primary", F.concat(F.lit("color~primary("), js_round(dist).cast("bigint").cast("string"), F.lit(")"))),
            ((r >= 140) & (r - g >= 50) & (r - b >= 50), "danger", "color:red-ish"), ((g >= 120) & (g - r >= 40) & (g - b >= 40), "success", "color:green-ish"),
            by_hint, (yes, "default", "color:other"),
        )
    )
    low = F.lower(F.coalesce("text", F.lit("")))
    state = F.when(~F.col("type").isin("button", "checkbox", "radio", "tab"), case((yes, "default", "non-stateful type"))).otherwise(
        case(
            (F.col("state_hint").isin(STATES), F.col("state_hint"), F.concat(F.lit("props:state="), "state_hint")), (F.col("disabled"), "disabled", "interactive:disabled"),
            (low.rlike(words(DISABLED_WORDS)), "disabled", "text:disabled"), (low.rlike(words(SELECTED_WORDS)), "selected", "text:selected"), (yes, "default", "no state signal"),
        )
    )
    rows = rows.withColumn("_v", variant).withColumn("_s", state)
    return rows.select("image_id", "node_id", "type", F.col("_v.v").alias("variant"), F.col("_s.v").alias("state"), F.concat_ws("; ", "_v.why", "_s.why").alias("reason"))


def infer_interactivity(nodes: DataFrame) -> DataFrame:
    """placeholder / disabled / link flags from text_color and bg_color."""
    lum = lambda r, g, b: 0.299 * r + 0.587 * g + 0.114 * b
    names = ["_tr", "_tg", "_tb", "_br", "_bg", "_bb"]
    rows = nodes.withColumns(dict(zip(names, (*hex_channels(F.col("text_color")), *hex_channels(F.col("bg_color"))))))
    tr, tg, tb, br, bg, bb = map(F.col, names)
    t, text = F.col("type"), F.trim(F.coalesce("text", F.lit(""))) != ""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        *nodes.columns, flag(t.isin("input", "textarea", "select") & text & (lum(tr, tg, tb) >= 140)).alias("placeholder"),
        flag(t.isin("button", "iconButton") & lum(br, bg, bb).between(80, 200) & (saturation(br, bg, bb) < 0.15)).alias("disabled"),
        flag(t.isin("text", "title", "subtitle") & text & (tb > tr + 20) & (tb > tg + 20)).alias("link"),
    )


def overlay_geometry(nodes: DataFrame, regions: DataFrame, meta: DataFrame) -> DataFrame:
    """Drawers and bottom sheets: container-like nodes that hug a page edge and overlap a
    region other than their own by at least 20 % of their area."""
    cands = nodes.where(F.col("type").isin(OVERLAY_TYPES) & F.col("parent_id").isNotNull() & (F.col("w") * F.col("h") > 0))
    cands = cands.select("image_id", "node_id", "region_id", "x", "y", "w", "h").join(meta.select("image_id", "width", "height"), "image_id")
    b, pw, ph = G.box(), F.col("width"), F.col("height")
    side = ((b.x <= pw * 0.05) | (b.right >= pw - pw * 0.05)) & (b.h >= ph * 0.6) & (b.w < pw * 0.8)
    bottom = (b.bottom >= ph - ph * 0.05) & (b.w >= pw * 0.6) & (b.h < ph * 0.7)
    cands = cands.withColumn("overlay", F.when(side, "drawer").when(bottom, "bottomSheet")).where(F.col("overlay").isNotNull())
    pairs = touching_pairs(cands.drop("width", "height"), regions.select("image_id", "region_id", "x", "y", "w", "h"), tile=512.0)
    hit = ~F.col("a_region_id").eqNullSafe(F.col("b_region_id")) & (G.coverage(G.box("a_"), G.box("b_")) >= 0.2)
    return pairs.where(hit).select("image_id", F.col("a_node_id").alias("node_id"), F.col("a_overlay").alias("overlay"), F.lit(1000).alias("z_index")).distinct()


def composite_roles(nodes: DataFrame) -> DataFrame:
    """Roles from child sets: button + icon -> iconButton; title + button -> banner;
    control + label -> controlItem; input + label -> formField (the last rule that holds
    names the role).  Children are typed before their parents, which matters only for
    buttons that turn into iconButtons and count as buttons either way."""
    from screenlake.operators.spatial import control_labels

    kids = nodes.where(F.col("parent_id").isNotNull())
    t = F.col("type")
    any_ = lambda c: F.max(c.cast("int"))
    s = kids.groupBy("image_id", F.col("parent_id").alias("node_id")).agg(
        any_(t == "icon").alias("_icon"), any_(t.isin("title", "subtitle")).alias("_title"), any_(t.isin("button", "iconButton")).alias("_button"),
        any_(t.isin("input", "textarea", "select")).alias("_input"), any_((t == "text") & F.coalesce(F.col("role") == "label", F.lit(False))).alias("_label"),
    )
    ctl = control_labels(nodes).select("image_id", F.col("parent_id").alias("node_id"), "control_id", F.col("label_id").alias("label_node_id"))
    rows = nodes.join(s, ["image_id", "node_id"], "left").join(ctl, ["image_id", "node_id"], "left")
    on = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    new = F.when((t == "button") & on("_icon"), "iconButton").otherwise(t)
    role = (
        F.when(on("_input") & on("_label"), "formField").when(F.col("control_id").isNotNull(), "controlItem")
        .when(t.isin("section", "container") & on("_title") & on("_button"), "banner").otherwise(F.col("role"))
    )
    return rows.select("image_id", "node_id", "type", new.alias("new_type"), role.alias("new_role"), "control_id", "label_node_id")


def render_modes(nodes: DataFrame, banner_fallback: bool = True) -> DataFrame:
    """Render mode per node: a child of an asset is semantic-only, a banner is an asset
    (hybrid when ``separable``), a mask is semantic-only, everything else native.

    Only a banner can be an asset, and one that is not separable is one unless its parent is: a
    node lies below an asset if the run of such banners above it is of odd length."""
    rows = nodes.select("image_id", "node_id", "parent_id", "type", (F.lit(banner_fallback) & F.coalesce(F.col("role") == "banner", F.lit(False))).alias("_banner"), F.coalesce("separable", F.lit(False)).alias("_sep"))
    rows = rows.repartition("image_id").select("image_id", "node_id", "type", "_banner", "_sep", F.lit(0).alias("_run"), F.col("parent_id").alias("_up"))
    rows = climb(rows, {"_run": F.col("_run") + F.col("_u_run") + 1}, only=F.col("_banner") & ~F.col("_sep"))
    # a run on a cycle has no first banner, so none of it is an asset
    rows = rows.withColumn("_below", F.when(F.col("_up").isNull() & (F.col("_run") % 2 == 1), True))
    mode = (
        F.when(F.col("_below"), "semantic-only").when(F.col("_banner"), F.when(F.col("_sep"), "hybrid").otherwise("asset"))
        .when(F.col("type") == "mask", "semantic-only").otherwise("native")
    )
    reason = F.when(F.col("_banner") & F.col("_below").isNull(), F.when(F.col("_sep"), "banner-background-separable").otherwise("banner-background-not-separable"))
    return rows.select("image_id", "node_id", "type", mode.alias("render_mode"), reason.alias("reason"))


def classify_media(areas: DataFrame, meta: DataFrame) -> DataFrame:
    """Icons become logos (by text) or images (>= 2 % of the page, sides >= 96); alt text
    and crop; areas under 16 px² are dropped.  Needs image_id, ord, type, nearby_text, box."""
    rows = areas.join(meta.select("image_id", "width", "height"), "image_id")
    b, text = G.box(), F.trim(F.coalesce("nearby_text", F.lit("")))
    rel = b.area / F.greatest(F.lit(1.0), F.col("width").cast("double") * F.col("height"))
    kind = F.when(F.col("type") != "icon", F.col("type")).when(text.rlike(LOGO_WORDS), "logo").when((rel >= 0.02) & (b.w >= 96) & (b.h >= 96), "image").otherwise("icon")
    rows = rows.where(b.area >= 16).withColumn("type", kind).withColumn("_t", text)
    cx, cy = F.greatest(F.lit(0.0), b.x), F.greatest(F.lit(0.0), b.y)
    return rows.select(
        "image_id", "ord", "type", F.when(F.col("_t") != "", F.col("_t")).otherwise(map_types(F.col("type"), ALT_TEXT)).alias("alt_text"),
        cx.alias("crop_x"), cy.alias("crop_y"), F.greatest(F.lit(1.0), b.right - cx).alias("crop_w"), F.greatest(F.lit(1.0), b.bottom - cy).alias("crop_h"),
    )
