"""Layout reconstruction over regions and nodes."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from screenlake.operators.folds import fold_sorted
from screenlake.session import cut_lineage


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int | None) -> DataFrame:
    """Ranked rows of every group, the first ``k`` or all.  With ``k``, Spark keeps only ``k`` rows per group and map
    task before the shuffle (window group limit), so a hot group stays small."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def global_top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows of the whole table (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def flow_direction(nodes: DataFrame) -> DataFrame:
    """top-down / left-right when one centre spread exceeds 1.3 times the other."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    s = nodes.groupBy("image_id").agg(
        (F.max(cx) - F.min(cx)).alias("sx"), (F.max(cy) - F.min(cy)).alias("sy"), F.count(F.lit(1)).alias("n")
    )
    kind = (
        F.when(F.col("n") < 2, "unknown").when(F.col("sy") > F.col("sx") * 1.3, "top-down")
        .when(F.col("sx") > F.col("sy") * 1.3, "left-right").otherwise("unknown")
    )
    return s.select("image_id", kind.alias("direction"))


# --- groups of similar siblings ---------------------------------------------------------
SIZE_TOLERANCE = 0.15
REPEATABLE = ["listItem", "card", "row", "section"]
LIST_ITEMS = ["card", "unknown", "image", "section", "row"]
GENERIC = ["container", "section", "unknown"]


def _differs(a: Column, b: Column) -> Column:
    """Relative difference above the size tolerance."""
    top = F.greatest(a, b)
    return F.when(top > 0, F.abs(a - b) / top > SIZE_TOLERANCE).otherwise(F.lit(False))


def _size_cells(kids: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Siblings collapsed to their distinct (type, w, h) with count, first member and
    centre extents.  Equal sizes always share a group, so folds run over these cells."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    return kids.groupBy(*keys, "type", "w", "h").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord"), F.min_by("node_id", order).alias("first_id"),
        F.min(cx).alias("x0"), F.max(cx).alias("x1"), F.min(cy).alias("y0"), F.max(cy).alias("y1"),
    )


def differ(a: float, b: float) -> bool:
    """``_differs`` of two numbers."""
    big = max(a, b)
    return big > 0 and abs(a - b) / big > SIZE_TOLERANCE


def size_level(v: float) -> int:
    """Sizes that don't differ are on the same level or on levels side by side."""
    return math.floor(math.log(v) / math.log(1 / 0.84)) if v > 0 else -10_000


def detect_repeats(nodes: DataFrame) -> DataFrame:
    """Per parent the largest group (>= 2) of repeatable children of one type whose sizes
    differ pairwise by at most 15 %; the template is its first member in size order.

    ``nodes``: image_id, parent_id, node_id, type, box."""
    keys = ["image_id", "parent_id"]
    kids = nodes.where(F.col("parent_id").isNotNull() & F.col("type").isin(REPEATABLE))
    cells = _size_cells(kids, keys, F.struct("y", "x", "node_id")).select(*keys, "type", "w", "h", "n", F.col("first_id").alias("id"))

    def largest(group: Iterator[tuple]) -> Iterator[tuple]:
        best, live = None, []  # groups as [type, w0, w1, h0, h1, n, id, number]
        opened = 0
        for image, parent, kind, w, h, n, first in group:
            # sizes ascend within a type: a group that is too narrow now stays so
            live = [g for g in live if g[0] == kind and not differ(g[1], w)]
            hit = next((g for g in live if not (differ(g[2], w) or differ(g[3], h) or differ(g[4], h))), None)
            if hit is None:
                hit = [kind, w, w, h, h, 0, first, opened]
                live.append(hit)
                opened += 1
            hit[1:6] = min(hit[1], w), max(hit[2], w), min(hit[3], h), max(hit[4], h), hit[5] + n
            if best is None or (hit[5], -hit[7]) > (best[5], -best[7]):
                best = hit
        if best[5] >= 2:
            yield image, parent, best[5], best[6], best[0]

    schema = T.StructType([nodes.schema["image_id"], T.StructField("target_id", nodes.schema["parent_id"].dataType), T.StructField("count", T.LongType()), T.StructField("template_id", nodes.schema["node_id"].dataType), T.StructField("template_type", T.StringType())])
    return fold_sorted(cells, keys, ["type", "w", "h", "n", "id"], schema, largest)


def slots(repeats: DataFrame) -> DataFrame:
    return repeats.where(F.col("template_id").isNotNull()).select(
        "image_id", F.col("template_id").alias("id"), F.concat("template_type", F.lit("Template")).alias("name")
    )


def promote_lists(nodes: DataFrame) -> DataFrame:
    """Retype generic containers to ``list`` and a column of at least three children that
    resemble their seed to ``listItem``.

    ``nodes``: image_id, parent_id, node_id, ord, type, box.  Adds ``new_type``."""
    keys = ["image_id", "parent_id"]
    parents = nodes.where(F.col("type").isin(GENERIC)).select("image_id", F.col("node_id").alias("parent_id"))
    kids = nodes.where(F.col("parent_id").isNotNull()).join(parents, keys, "left_semi")
    cells = _size_cells(kids, keys, F.col("ord")).select(*keys, F.col("first_ord").alias("o"), "type", "w", "h", "n", "x0", "x1", "y0", "y1")
    sums = ("n", "sw", "sh", "x0", "x1", "y0", "y1")

    def seeded(group: Iterator[tuple]) -> Iterator[tuple]:
        """A row for each cell with its group, then a row for each group with its sums."""
        seeds, near = [], defaultdict(list)
        for image, parent, _, kind, w, h, n, x0, x1, y0, y1 in group:
            lw, lh = size_level(w), size_level(h)
            around = (g for i in (lw - 1, lw, lw + 1) for j in (lh - 1, lh, lh + 1) for g in near.get((kind, i, j), ()))
            g = min((g for g in around if not (differ(seeds[g][1], w) or differ(seeds[g][2], h))), default=None)
            if g is None:
                g = len(seeds)
                near[kind, lw, lh].append(g)
                seeds.append([kind, w, h, 0, 0.0, 0.0, x0, x1, y0, y1])
            s = seeds[g]
            s[3:] = s[3] + n, s[4] + w * n, s[5] + h * n, min(s[6], x0), max(s[7], x1), min(s[8], y0), max(s[9], y1)
            yield (image, parent, kind, w, h, g, *[None] * len(sums))
        for g, (kind, w, h, *rest) in enumerate(seeds):
            yield (image, parent, kind, w, h, g, *rest)

    schema = T.StructType([nodes.schema["image_id"], nodes.schema["parent_id"], T.StructField("type", T.StringType()), T.StructField("w", T.DoubleType()), T.StructField("h", T.DoubleType()), T.StructField("g", T.IntegerType())] + [T.StructField(c, T.LongType() if c == "n" else T.DoubleType()) for c in sums])
    folded = cut_lineage(fold_sorted(cells, keys, ["o", "type", "w", "h"], schema, seeded))
    groups = folded.where((F.col("n") >= 3) & F.col("type").isin(LIST_ITEMS)).select(*keys, "g", F.struct(*sums).alias("s"))
    best = groups.groupBy(*keys).agg(F.max_by(F.struct("g", "s"), F.struct(F.col("s.n"), -F.col("g"))).alias("b")).select(*keys, "b.g", "b.s")
    dx, dy = F.col("s.x1") - F.col("s.x0"), F.col("s.y1") - F.col("s.y0")
    xa, ya = dx < F.col("s.sw") / F.col("s.n") * 0.5, dy < F.col("s.sh") / F.col("s.n") * 0.5
    lists = best.where(xa & (~ya | (dx <= dy))).select(*keys, "g")
    cells_of = folded.where(F.col("n").isNull()).select(*keys, "type", "w", "h", "g")
    items = cells_of.join(lists, [*keys, "g"]).select(*keys, "type", "w", "h", F.lit(True).alias("_item"))
    heads = lists.select("image_id", F.col("parent_id").alias("node_id"), F.lit(True).alias("_list"))
    out = nodes.join(items, [*keys, "type", "w", "h"], "left").join(heads, ["image_id", "node_id"], "left")
    new = F.when(F.col("_list"), "list").when(F.col("_item"), "listItem").otherwise(F.col("type"))
    return out.withColumn("new_type", new).drop("_item", "_list")


# --- containers -------------------------------------------------------------------------
def direction_of(n: Column, dx: Column, dy: Column, mean_w: Column, mean_h: Column) -> Column:
    """row / column / grid from centre spreads against half the mean size."""
    xa, ya = dx < mean_w * 0.5, dy < mean_h * 0.5
    return (
        F.when(n < 2, "column").when(xa & ya, F.when(dx <= dy, "column").otherwise("row")).when(xa, "column").when(ya, "row").otherwise("grid")
    )


def container_constraints(nodes: DataFrame) -> DataFrame:
    """Direction, median positive gap and alignment of every container with >= 2 children."""
    from screenlake.functions.semantics import round_half_up
    from screenlake.operators.ordered import running_max_before, with_previous

    keys = ["image_id", "parent_id"]
    kids = nodes.where(F.col("parent_id").isNotNull()).select(*keys, "node_id", "x", "y", "w", "h")
    x, y, w, h = (F.col(c) for c in "xywh")
    cx, cy = x + w / 2, y + h / 2

    def span(c: Column) -> Column:
        return F.max(c) - F.min(c)

    s = kids.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), span(cx).alias("dcx"), span(cy).alias("dcy"), F.avg("w").alias("mw"), F.avg("h").alias("mh"),
        span(x).alias("dl"), span(x + w).alias("dr"), span(y).alias("dt"), span(y + h).alias("db"),
        F.expr("percentile(w, 0.5D)").alias("medw"), F.expr("percentile(h, 0.5D)").alias("medh"),
    ).where("n >= 2")
    direction = direction_of(F.col("n"), F.col("dcx"), F.col("dcy"), F.col("mw"), F.col("mh"))
    s = s.withColumn("direction", direction)
    row = F.col("direction") == "row"
    rows = kids.join(s.select(*keys, "direction"), keys)
    rows = rows.withColumn("_lo", F.when(row, x).otherwise(y)).withColumn("_end", F.when(row, x + w).otherwise(y + h))
    order = ["_lo", "x", "node_id"]
    rows = running_max_before(rows, keys, F.col("_lo"), F.col("_end"), order, "_reach").drop("_band")
    rows = with_previous(rows, keys, F.col("_lo"), order, ["_end"])
    gap = F.col("_lo") - F.when(F.col("direction") == "grid", F.col("_reach")).otherwise(F.col("prev._end"))
    gaps = rows.select(*keys, gap.alias("g")).where("g > 0").groupBy(*keys).agg(F.expr("percentile(g, 0.5D)").alias("gap"))
    tol_h = F.when(F.col("medh") * 0.3 == 0, 1.0).otherwise(F.col("medh") * 0.3)
    tol_w = F.when(F.col("medw") * 0.3 == 0, 1.0).otherwise(F.col("medw") * 0.3)
    align = (
        F.when(row, F.when(F.col("dt") <= tol_h, "top").when(F.col("dcy") <= tol_h, "center").when(F.col("db") <= tol_h, "bottom").otherwise("start"))
        .when(F.col("direction") == "column", F.when(F.col("dl") <= tol_w, "left").when(F.col("dcx") <= tol_w, "center").when(F.col("dr") <= tol_w, "right").otherwise("start"))
        .otherwise("start")
    )
    out = s.join(gaps, keys, "left")
    return out.select(
        "image_id", F.col("parent_id").alias("target_id"), F.col("n").alias("children"), "direction",
        round_half_up(F.coalesce("gap", F.lit(0.0)), 1).alias("gap"), align.alias("align"),
    )


def responsive_hints(nodes: DataFrame, regions: DataFrame, layout: DataFrame, constraints: DataFrame, meta: DataFrame) -> DataFrame:
    """Break-point hints per image: sidebar-collapse, stack-vertically, horizontal-scroll,
    merge-columns.  Every input is reduced to flags per image first."""
    any_ = lambda c: F.max(c.cast("int"))
    r = regions.groupBy("image_id").agg(any_(F.col("type") == "sidebar").alias("r_side"), any_(F.col("type") == "table").alias("r_table"), F.count(F.lit(1)).alias("r_n"))
    page = meta.select("image_id", F.col("width").alias("_pw"))
    n = nodes.join(page, "image_id").groupBy("image_id").agg(
        any_((F.col("type") == "sidebar") & (F.col("x") < F.col("_pw") * 0.3) & (F.col("w") < F.col("_pw") * 0.3)).alias("n_side"),
        any_(F.col("type") == "table").alias("n_table"),
    )
    c = constraints.groupBy("image_id").agg(any_((F.col("direction") == "grid") & (F.col("children") > 2)).alias("grid"))
    rows = layout.join(r, "image_id", "left").join(n, "image_id", "left").join(c, "image_id", "left").fillna(0)
    hint = lambda cond, bp, name: F.when(cond, F.struct(F.lit(bp).alias("breakpoint"), F.lit(name).alias("layout")))
    hints = F.array_compact(F.array(
        hint((F.col("r_side") > 0) | (F.col("n_side") > 0), "mobile", "sidebar-collapse"), hint(F.col("grid") > 0, "mobile", "stack-vertically"),
        hint((F.col("r_table") > 0) | (F.col("n_table") > 0), "mobile", "horizontal-scroll"),
        hint((F.col("layout_type") == "columns") & (F.col("r_n") > 2), "tablet", "merge-columns"),
    ))
    return rows.select("image_id", F.explode(hints).alias("h")).select("image_id", "h.breakpoint", "h.layout")


# --- text levels and zones --------------------------------------------------------------
def text_level(items: DataFrame) -> DataFrame:
    """title / heading / body / caption against the upper median text height."""
    from screenlake.functions.semantics import upper_median, with_group

    rows = with_group(items, ["image_id"], upper_median("h").alias("_m"))
    h, m = F.col("h"), F.col("_m")
    level = F.when(h > m * 2.5, "title").when(h > m * 1.6, "heading").when(h < m * 0.7, "caption").otherwise("body")
    return rows.withColumn("level", level).drop("_m")


def node_text_level(nodes: DataFrame) -> DataFrame:
    """Text nodes become title (>= 1.5) or subtitle (>= 1.15) against the averaged median
    font size (box height where no font size is known).  Adds ``new_type``."""
    size = F.coalesce("font_size", "h")
    mid = nodes.where(F.col("type") == "text").select("image_id", size.alias("_s")).groupBy("image_id").agg(F.expr("percentile(_s, 0.5D)").alias("_m"))
    rows = nodes.join(mid, "image_id", "left")
    new = F.when(F.col("type") != "text", F.col("type")).when(size >= F.col("_m") * 1.5, "title").when(size >= F.col("_m") * 1.15, "subtitle").otherwise("text")
    return rows.withColumn("new_type", new).drop("_m")


def typography_scale(items: DataFrame) -> DataFrame:
    """Size (rounded averaged median) and count per text level of an image."""
    from screenlake.functions.semantics import js_round, mean_median, with_group

    rows = with_group(items, ["image_id"], mean_median("h").alias("_m"))
    h, m = F.col("h"), F.col("_m")
    level = F.when((m > 0) & (h > m * 1.6), "title").when((m > 0) & (h > m * 1.2), "heading").when((m > 0) & (h < m * 0.8), "caption").otherwise("body")
    out = rows.withColumn("level", level).groupBy("image_id", "level").agg(F.expr("percentile(h, 0.5D)").alias("s"), F.count(F.lit(1)).alias("count"))
    return out.select("image_id", "level", js_round(F.col("s")).cast("bigint").alias("size_px"), "count")


def top_title(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """The text in the top 15 % whose centre is nearest to (and within 18 % of) the page
    centre; ties: node order."""
    rows = nodes.where(F.col("type").isin("text", "title", "subtitle")).join(meta.select("image_id", "width", "height"), "image_id")
    top = F.col("y") / F.col("height")
    dist = F.abs(F.col("x") + F.col("w") / 2 - F.col("width") / 2) / F.col("width")
    rows = rows.withColumn("dist", dist).where((top >= 0) & (top <= 0.15) & (F.col("dist") <= 0.18))
    return rows.groupBy("image_id").agg(F.min_by(F.struct("node_id", "dist"), F.struct("dist", "ord")).alias("r")).select("image_id", "r.node_id", "r.dist")


def zones(items: DataFrame) -> DataFrame:
    """header / body / footer by 15 % of the text envelope (body when it has no height)."""
    from screenlake.functions.semantics import with_group

    rows = with_group(items, ["image_id"], F.min("y").alias("_t"), F.max(F.col("y") + F.col("h")).alias("_b"))
    cy, height = F.col("y") + F.col("h") / 2, F.col("_b") - F.col("_t")
    zone = (
        F.when(F.coalesce(height <= 0, F.lit(True)) | cy.isNull(), "body").when(cy < F.col("_t") + height * 0.15, "header")
        .when(cy > F.col("_b") - height * 0.15, "footer").otherwise("body")
    )
    return rows.withColumn("zone", zone).drop("_t", "_b")


def document_title(zoned: DataFrame) -> DataFrame:
    """The top item of the header, or of the page when there is no header."""
    rank = F.struct(F.when(F.col("zone") == "header", 0).otherwise(1), F.col("y"), F.col("ord"))
    return zoned.groupBy("image_id").agg(F.min_by(F.trim("text"), rank).alias("title"))


def spacing(regions: DataFrame) -> DataFrame:
    """Positive gaps between position-sorted neighbours that share a column (row), their
    mean and scale; regions: image_id, region_id, box."""
    from screenlake.functions.semantics import round_half_up
    from screenlake.operators.ordered import with_previous

    base = regions.select("image_id", "region_id", "x", "y", "w", "h")
    cols = ["x", "y", "w", "h"]
    v = with_previous(base, ["image_id"], F.col("y"), ["y", "region_id"], cols)
    v = v.where(F.abs(F.col("x") - F.col("prev.x")) < F.col("prev.w") * 0.5).select("image_id", F.lit("v").alias("axis"), (F.col("y") - F.col("prev.y") - F.col("prev.h")).alias("gap"))
    h = with_previous(base, ["image_id"], F.col("x"), ["x", "region_id"], cols)
    h = h.where(F.abs(F.col("y") - F.col("prev.y")) < F.col("prev.h") * 0.5).select("image_id", F.lit("h").alias("axis"), (F.col("x") - F.col("prev.x") - F.col("prev.w")).alias("gap"))
    gaps = v.unionByName(h).where("gap > 0")
    count = lambda a: F.count(F.when(F.col("axis") == a, 1))
    stats = gaps.groupBy("image_id").agg(F.avg("gap").alias("g"), count("v").alias("n_vertical"), count("h").alias("n_horizontal"))
    out = base.select("image_id").distinct().join(stats, "image_id", "left").fillna(0)
    scale = F.when(F.col("g") < 5, "compact").when(F.col("g") < 15, "comfortable").otherwise("spacious")
    return out.select("image_id", round_half_up(F.col("g"), 1).alias("average_gap"), scale.alias("scale"), "n_vertical", "n_horizontal")


def position_score(position: Column) -> Column:
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    p, zero = F.coalesce(position, F.lit("")), F.lit(0.0)
    term = lambda pattern, v: F.when(p.rlike(pattern), v / 10_000).otherwise(zero)
    return term("right|右", cx) - term("left|左", cx) + term("bottom|下", cy) - term("top|上", cy)


def rank_regions(boxes: DataFrame, position: Column, k: int | None = None) -> DataFrame:
    """Annotation boxes by confidence plus a tiny position score, best first."""
    rows = boxes.withColumn("score", F.col("confidence") + position_score(position))
    order = [F.desc("score"), "region_id"]
    return top_k_per_group(rows, ["image_id"], order, k)


def layout_region(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Target region from a description: the right or left half by the upper median centre,
    the price-like items if a price is asked for (and there are any), as a union box.

    ``items``: image_id, text, box.  ``queries``: one row per request (request_id,
    image_id, query)."""
    from screenlake.functions import rulebook as RB
    from screenlake.functions.semantics import js_round, upper_median

    cx = F.col("x") + F.col("w") / 2
    base = items.withColumn("_cx", cx)
    mid = base.groupBy("image_id").agg(upper_median("_cx").alias("_m"))
    q = queries.join(mid, "image_id")
    rows = base.join(q, "image_id")
    right, left = F.col("query").rlike("right|右"), F.col("query").rlike("left|左")
    rows = rows.where(F.when(right, F.col("_cx") >= F.col("_m")).when(left, F.col("_cx") <= F.col("_m")).otherwise(F.lit(True)))
    price = F.col("query").rlike(RB.PRICE_WORDS) & F.col("text").rlike(RB.PRICE_TEXT)
    x, y, r, b = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ext = rows.groupBy("request_id", "image_id").agg(
        F.min(F.when(price, x)).alias("px"), F.min(F.when(price, y)).alias("py"), F.max(F.when(price, r)).alias("pr"), F.max(F.when(price, b)).alias("pb"),
        F.min(x).alias("ax"), F.min(y).alias("ay"), F.max(r).alias("ar"), F.max(b).alias("ab"),
    )
    corner = lambda c: js_round(F.coalesce("p" + c, "a" + c)).cast("bigint").cast("string")
    return ext.select("request_id", "image_id", F.concat_ws(",", corner("x"), corner("y"), corner("r"), corner("b")).alias("box"), F.lit(0.55).alias("confidence"))


def dense_bands(counts: DataFrame, share: float = 0.3) -> DataFrame:
    """Runs of rows whose coloured-pixel count exceeds ``share`` of the region's maximum.

    ``counts``: image_id, region_id, y, n.  Missing rows count as empty.  A run ends where
    the next dense row is not adjacent."""
    from screenlake.functions.semantics import with_group
    from screenlake.operators.ordered import islands

    keys = ["image_id", "region_id"]
    rows = with_group(counts, keys, F.max("n").alias("_max")).where(F.col("n") > F.col("_max") * share).drop("_max")
    runs = islands(rows, keys, F.col("y"), ["y"], ["y"], lambda p: F.col("y") > p["y"] + 1, "band")
    return runs.groupBy(*keys, "band").agg(F.min("y").alias("start"), F.max("y").alias("end"))


def band_split(bands: DataFrame, boxes: DataFrame) -> DataFrame:
    """Split row of regions with at least four bands: between the second and third band,
    if at least 20 px remain on both sides."""
    s = bands.groupBy("image_id", "region_id").agg(
        F.count(F.lit(1)).alias("bands"), F.max(F.when(F.col("band") == 1, F.col("end"))).alias("e1"), F.max(F.when(F.col("band") == 2, F.col("start"))).alias("s2")
    ).where("bands >= 4")
    rows = s.join(boxes.select("image_id", "region_id", "y1", "y2"), ["image_id", "region_id"])
    split = F.floor((F.col("e1") + F.col("s2")) / 2) + 1
    return rows.select("image_id", "region_id", "bands", split.alias("split_y"), "y1", "y2").where(
        (F.col("split_y") > F.col("y1") + 20) & (F.col("split_y") < F.col("y2") - 20)
    ).drop("y1", "y2")


def media_score(cands: DataFrame, heights: DataFrame, meta: DataFrame, k: int | None = None) -> DataFrame:
    """Media candidates with their score and rank, all or the best ``k`` per image.

    ``cands``: image_id, cand_id, anchored, textured, box; ``heights``: median text height
    (see ``text_height``).  The work image has blocks of 20 px."""
    block = 20.0
    rows = cands.join(heights, "image_id", "left").join(meta.select("image_id", "width", "height"), "image_id")
    w, h = F.col("w"), F.col("h")
    longest, shortest = F.greatest(w, h), F.least(w, h)
    rel = w * h / F.greatest(F.lit(1.0), F.col("width").cast("double") * F.col("height"))
    large = (h > w) & (shortest >= block * 4) & (rel >= 0.02)
    compact = longest <= F.greatest(F.lit(block * 3), F.coalesce("median_h", F.lit(20.0)) * 2.4)
    keep = ((longest / shortest < 4) | large) & (compact | F.col("textured") | (rel >= 0.02))
    points = lambda cond, v: F.when(cond, float(v)).otherwise(0.0)
    score = points(F.col("anchored"), 6) + points(F.col("textured"), 5) + points(compact, 2) + points(large, 10) + F.least(F.lit(1.0), rel * 10)
    rows = rows.where(keep).withColumn("score", score)
    return top_k_per_group(rows, ["image_id"], [F.desc("score"), "y", "x", "cand_id"], k)


# --- page level -------------------------------------------------------------------------
def layout_type(regions: DataFrame, meta: DataFrame) -> DataFrame:
    """grid / sidebar / columns / stack / centered from the region types of an image.

    Three or more cards of which two start within 10 px of the top card make a grid."""
    cards = regions.where(F.col("type") == "card")
    top = cards.groupBy("image_id").agg(F.min("y").alias("_top"), F.count(F.lit(1)).alias("cards"))
    row = cards.join(top, "image_id").groupBy("image_id").agg(F.count(F.when(F.abs(F.col("y") - F.col("_top")) < 10, 1)).alias("top_row"), F.max("cards").alias("cards"))
    has = lambda kind: F.max((F.col("type") == kind).cast("int")).alias(kind)
    mid = F.abs(F.col("x") + F.col("w") / 2 - F.col("width") / 2) < F.col("width") * 0.15
    flags = regions.join(meta.select("image_id", "width"), "image_id").groupBy("image_id").agg(
        has("sidebar"), has("header"), has("footer"), F.min(mid.cast("int")).alias("all_mid"), F.count(F.lit(1)).alias("n")
    )
    rows = meta.select("image_id").join(flags, "image_id", "left").join(row, "image_id", "left").fillna(0)
    on = lambda c: F.col(c) > 0
    kind = (
        F.when((F.col("cards") >= 3) & (F.col("top_row") >= 2), "grid").when(on("sidebar") & on("header"), "sidebar").when(F.col("cards") >= 2, "columns")
        .when(on("header") & on("footer") & ~on("sidebar"), "stack").when(on("all_mid") & on("n"), "centered").otherwise("stack")
    )
    return rows.select("image_id", kind.alias("layout_type"))


def page_class(regions: DataFrame, components: DataFrame, ocr: DataFrame, meta: DataFrame) -> DataFrame:
    """mobile-ui / admin-ui / dashboard / form / general-ui."""
    n = lambda cond: F.count(F.when(cond, 1))
    t = F.col("type")
    r = regions.groupBy("image_id").agg(n(t == "sidebar").alias("side"), n(t == "table").alias("tab"), n(t == "card").alias("cards"))
    c = components.groupBy("image_id").agg(n(t == "input").alias("inputs"))
    o = ocr.groupBy("image_id").agg(n(F.col("text").rlike(r"^\d{1,2}:\d{2}$|返回|详情")).alias("mobile"))
    rows = meta.select("image_id").join(r, "image_id", "left").join(c, "image_id", "left").join(o, "image_id", "left").fillna(0)
    kind = (
        F.when(F.col("mobile") > 0, "mobile-ui").when((F.col("side") > 0) & ((F.col("tab") > 0) | (F.col("inputs") > 0)), "admin-ui")
        .when(F.col("cards") >= 3, "dashboard").when(F.col("inputs") > 0, "form").otherwise("general-ui")
    )
    return rows.select("image_id", kind.alias("page_class"))


# Fixed values of the page types.
LOGIN_WORDS = ["登录", "login", "sign in", "sign-in", "注册", "register"]
TABLE_WORDS = ["名称", "状态", "操作", "价格", "姓名", "时间", "数量", "金额", "类型", "编号"]
METRIC_WORDS = ["统计", "数据", "总数", "合计", "率", "占比", "metric", "total", "count", "%"]
SETTING_WORDS = ["设置", "setting", "配置", "偏好", "选项"]
SUBMIT_WORDS = ["提交", "submit", "确认", "确定", "保存", "登录", "注册", "下一步", "search", "搜索"]
INTERACTIVE = ["input", "textarea", "button", "iconButton", "checkbox", "radio", "switch", "select", "dropdown", "tab"]
CONTROLS = ["input", "textarea", "switch", "checkbox", "radio", "select"]


def page_type(nodes: DataFrame, regions: DataFrame, texts: DataFrame, layout: DataFrame) -> DataFrame:
    """Best of eight page types; each scores the share of its checks that hold (>= 0.5,
    ties: more signals, then rule order), with the signals that held.

    ``texts``: image_id, text, box (node texts and OCR; the same text in the same box
    counts once).  Words are looked up inside single texts."""
    from screenlake.operators.rules import words

    n = lambda cond: F.count(F.when(cond, 1))
    t = F.col("type")
    nc = nodes.groupBy("image_id").agg(
        n(t == "input").alias("inputs"), n(t.isin("button", "iconButton")).alias("buttons"), n(t == "card").alias("cards"), n(t == "listItem").alias("items"),
        n(t == "table").alias("tables"), n(t.isin("navbar", "tab")).alias("navs"), n(t.isin(INTERACTIVE)).alias("inter"), n(t != "page").alias("comps"),
        n(t.isin("title", "subtitle")).alias("titles"), n(t.isin("section", "container")).alias("sections"), n(t.isin(CONTROLS)).alias("controls"),
    )
    rc = regions.groupBy("image_id").agg(F.count(F.lit(1)).alias("regions"), n(t == "table").alias("r_tables"))
    low = F.lower(F.trim("text"))
    uniq = texts.where(F.col("text") != "").select("image_id", low.alias("_t"), "x", "y", "w", "h").distinct()
    has = lambda ws: n(F.col("_t").rlike(words(ws)))
    tc = uniq.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("texts"), has(LOGIN_WORDS).alias("w_login"), has(TABLE_WORDS).alias("w_table"), has(METRIC_WORDS).alias("w_metric"),
        has(SETTING_WORDS).alias("w_setting"), has(SUBMIT_WORDS).alias("w_submit"),
    )
    rows = nc.join(rc, "image_id", "left").join(tc, "image_id", "left").fillna(0).join(layout, "image_id", "left")
    c = F.col
    rules = [
        ("login", [((c("inputs") >= 1) & (c("buttons") >= 1), "components:input+button"), (c("w_login") > 0, "ocr:登录"), (c("comps") < 6, "components:few(<6)"), (F.coalesce(c("layout_type") == "centered", F.lit(False)), "layout:centered")]),
        ("form", [(c("inputs") >= 2, "components:multi-input"), ((c("inputs") >= 1) & (c("texts") > 0), "text:labels"), ((c("buttons") > 0) & (c("w_submit") > 0), "button:submit")]),
        ("table", [((c("tables") >= 1) | (c("r_tables") > 0), "components:table"), (c("w_table") > 0, "ocr:header-keyword")]),
        ("list", [(c("items") >= 2, "components:multi-listItem"), ((c("items") >= 1) & (c("texts") >= 3), "ocr:multi-row")]),
        ("dashboard", [(c("regions") >= 4, "layout:multi-region(>=4)"), (c("w_metric") > 0, "ocr:metric"), (c("cards") >= 2, "components:multi-card")]),
        ("detail", [(c("titles") > 0, "components:title"), (c("sections") > 0, "components:section"), (c("inter") <= 2, "components:few-interactive")]),
        ("setting", [(c("w_setting") > 0, "ocr:setting"), (c("controls") >= 2, "components:controls")]),
        ("navigation", [(c("navs") >= 1, "components:navbar/tab"), ((c("navs") >= 1) & (c("comps") <= 4), "content:sparse")]),
    ]
    scored = []
    for i, (name, checks) in enumerate(rules):
        signals = F.array_compact(F.array(*(F.when(cond, F.lit(s)) for cond, s in checks)))
        scored.append(F.struct((F.size(signals) / F.lit(len(checks))).alias("conf"), F.size(signals).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name"), signals.alias("signals")))
    rows = rows.withColumn("_b", F.array_max(F.array(*scored)))
    ok = F.col("_b.conf") >= 0.5
    return rows.select(
        "image_id", F.when(ok, F.col("_b.name")).otherwise("unknown").alias("page_type"),
        F.when(ok, F.floor(F.col("_b.conf") * 100 + 0.5) / 100).otherwise(0.0).alias("confidence"),
        F.when(ok, F.array_join("_b.signals", ",")).otherwise("").alias("signals"),
    )


def ocr_quality(items: DataFrame, meta: DataFrame) -> DataFrame:
    """Clarity, OCR confidence and issues per image.  ``meta``: image_id, width, complexity.

    The mean is rounded to nine digits before it is judged, so the order in which its items are
    added up decides neither a bound nor a half."""
    ok = F.col("confidence").between(0.0, 1.0)
    s = items.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("k"), F.avg(F.when(ok, F.col("confidence"))).alias("avg"))
    rows = meta.join(s, "image_id", "left").fillna(0, ["n", "k"])
    n = F.col("n")
    low = (F.col("width") > 0) & (F.col("width") < 400)
    clarity = F.when(low, 0.4).when(F.col("complexity") == "low", 0.9).when(F.col("complexity") == "high", 0.6).otherwise(0.7)
    boost = F.when(n >= 20, 0.05).when(n >= 8, 0.0).otherwise(-0.05)
    conf = (
        F.when(n == 0, 0.2).when(F.col("k") >= n / 2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("avg") + boost)))
        .otherwise(F.when(n >= 20, 0.85).when(n >= 8, 0.7).otherwise(0.5))
    )
    rows = rows.withColumn("_c", F.round(conf, 9))
    issues = F.array_compact(F.array(F.when(low, "low-resolution"), F.when(n == 0, "no-ocr-text"), F.when((n > 0) & (F.col("_c") < 0.4), "low-ocr-confidence")))
    two = lambda c: F.floor(F.round(c * 100, 7) + 0.5) / 100
    return rows.select("image_id", two(clarity).alias("clarity"), two(F.col("_c")).alias("ocr_confidence"), F.array_join(issues, ",").alias("issues"))


# Phrases of the page description, in output order.
PAGE_NAMES = [("login", "登录"), ("form", "表单"), ("list", "列表"), ("table", "表格"), ("detail", "详情"), ("dashboard", "仪表盘"), ("setting", "设置"), ("navigation", "导航"), ("unknown", "未知")]
LAYOUT_NAMES = [("grid", "网格"), ("columns", "分栏"), ("sidebar", "侧边栏"), ("centered", "居中"), ("split-pane", "分屏"), ("stack", "堆叠")]
COMPONENT_NAMES = [
    ("title", "标题"), ("subtitle", "副标题"), ("input", "输入框"), ("textarea", "文本域"), ("button:primary", "主按钮"), ("button:secondary", "次按钮"),
    ("button:success", "成功按钮"), ("button:danger", "危险按钮"), ("button:ghost", "幽灵按钮"), ("button:default", "按钮"), ("iconButton", "图标按钮"),
    ("checkbox", "复选框"), ("radio", "单选框"), ("switch", "开关"), ("select", "下拉框"), ("dropdown", "下拉菜单"), ("tab", "标签页"), ("table", "表格"),
    ("listItem", "列表项"), ("card", "卡片"), ("navbar", "导航栏"), ("sidebar", "侧边栏"), ("header", "页眉"), ("footer", "页脚"), ("dialog", "对话框"),
    ("drawer", "抽屉"), ("image", "图片"), ("avatar", "头像"), ("icon", "图标"), ("badge", "徽章"), ("tag", "标签"), ("progress", "进度条"),
    ("divider", "分割线"), ("section", "区块"), ("container", "容器"), ("text", "文本"),
]


def _name(key: Column, table: list[tuple[str, str]], default: Column | str) -> Column:
    out = None
    for k, v in table:
        out = (F if out is None else out).when(key == k, F.lit(v))
    return out.otherwise(default)


def describe_page(stats: DataFrame, pages: DataFrame, layout: DataFrame, regions: DataFrame) -> DataFrame:
    """One sentence per image from component counts (see ``component_stats``), page type,
    layout type and region count.  An image has one row per component kind, so the
    phrases joined here are bounded by the kind list."""
    order = _name(F.col("kind"), [(k, str(i)) for i, (k, _) in enumerate(COMPONENT_NAMES)], F.lit(None).cast("string")).cast("int")
    phrase = F.concat(F.col("n").cast("string"), F.lit(" 个"), _name(F.col("kind"), COMPONENT_NAMES, F.lit("")))
    parts = stats.withColumn("_o", order).where(F.col("_o").isNotNull()).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("_o", phrase.alias("p")))).alias("_p"))
    r = regions.groupBy("image_id").agg(F.count(F.lit(1)).alias("_r"))
    rows = pages.join(layout, "image_id", "left").join(parts, "image_id", "left").join(r, "image_id", "left")
    body = F.array_join(F.transform("_p", lambda s: s["p"]), "、")
    kinds = F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("，含 "), body)).otherwise("")
    lay = F.concat(_name(F.col("layout_type"), LAYOUT_NAMES, F.col("layout_type")), F.lit("布局"))
    lay = F.when(F.coalesce("_r", F.lit(0)) > 0, F.concat(lay, F.lit("，含 "), F.col("_r").cast("string"), F.lit(" 个区域"))).otherwise(lay)
    text = F.concat(_name(F.col("page_type"), PAGE_NAMES, F.lit("未知")), F.lit("页"), kinds, F.lit("；"), lay, F.lit("。"))
    return rows.select("image_id", text.alias("summary"))


# --- colours ----------------------------------------------------------------------------
def dominant_color(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average colour of the fullest 4-bit-per-channel bucket and of the darkest bucket
    that holds at least max(2, 2 %) of the samples (else of all).  Buckets are at most
    4096 per region, so the second step is bounded."""
    shift = lambda c: F.shiftright(c, 4)
    b = samples.groupBy(*keys, shift("r").alias("br"), shift("g").alias("bg"), shift("b").alias("bb")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b")
    )
    half = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    b = b.select(*keys, "br", "bg", "bb", "n", half("r").alias("r"), half("g").alias("g"), half("b").alias("b"))
    total = b.groupBy(*keys).agg(F.sum("n").alias("total"))
    b = b.join(total, list(keys)).withColumn("lum", 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    hexa = lambda s: F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(F.col(f"{s}.{c}")), 2, "0") for c in "rgb")))
    small = F.col("n") < F.greatest(F.lit(2), F.floor(F.col("total") * 0.02))
    out = b.groupBy(*keys).agg(
        F.max_by(F.struct("r", "g", "b"), F.struct("n", -F.col("br"), -F.col("bg"), -F.col("bb"))).alias("f"),
        F.min_by(F.struct("r", "g", "b"), F.struct(small.cast("int"), F.col("lum"), "br", "bg", "bb")).alias("d"), F.max("total").alias("samples"),
    )
    return out.select(*keys, hexa("f").alias("dominant"), hexa("d").alias("darkest"), "samples")


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """(saturation, lightness) of 0..255 channels."""
    hi, lo = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    light = (hi + lo) / 2
    sat = F.when(hi == lo, 0.0).when(light > 0.5, (hi - lo) / (2 - hi - lo)).otherwise((hi - lo) / (hi + lo))
    return sat, light


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    def ch(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return 0.2126 * ch(r) + 0.7152 * ch(g) + 0.0722 * ch(b)


def palette_roles(colors: DataFrame) -> DataFrame:
    """Role of every palette colour of an image (image_id, r, g, b, n): the most frequent
    is the background; the others by saturation, lightness and share."""
    from screenlake.functions.semantics import round_half_up

    sat, light = hsl(F.col("r"), F.col("g"), F.col("b"))
    tot = colors.groupBy("image_id").agg(F.sum("n").alias("_total"), F.max_by(F.struct("r", "g", "b"), F.struct("n", -F.col("r"), -F.col("g"), -F.col("b"))).alias("_bg"))
    rows = colors.join(tot, "image_id").withColumn("s", sat).withColumn("l", light).withColumn("_share", F.col("n") / F.col("_total"))
    first = F.struct("r", "g", "b") == F.col("_bg")
    role = (
        F.when(first, "background")
        .when(F.col("s") < 0.08, F.when(F.col("l") < 0.25, "text").when(F.col("l") > 0.85, "surface").when(F.col("_share") < 0.03, "border").otherwise("muted"))
        .when((F.col("s") > 0.5) & (F.col("_share") < 0.05), "accent").when(F.col("s") > 0.25, "primary").otherwise("muted")
    )
    return rows.select("image_id", "r", "g", "b", "n", role.alias("role"), round_half_up(F.col("_share"), 4).alias("frequency"), "s", "l")


def theme(palette: DataFrame) -> DataFrame:
    """Background, primary and text colour, dark mode and WCAG contrast per image from
    ``palette_roles``.  Each pick is the most frequent colour of the first class present."""
    rank = F.struct(-F.col("n"), F.col("r"), F.col("g"), F.col("b"))
    rgb = F.struct("r", "g", "b")

    def pick(*classes: Column) -> Column:
        """min_by over (class number, frequency rank)"""
        level = None
        for i, cond in enumerate(classes):
            level = (F if level is None else level).when(cond, F.lit(i))
        return F.min_by(rgb, F.struct(level.otherwise(F.lit(len(classes))).alias("k"), rank.alias("o")))

    last = F.max_by(rgb, rank)
    dark = F.min_by(rgb, F.struct(F.when(F.col("role") == "text", 0).when(F.col("l") < 0.25, 1).otherwise(2).alias("k"), rank.alias("o")))
    has_dark = F.max(((F.col("role") == "text") | (F.col("l") < 0.25)).cast("int")) > 0
    t = palette.groupBy("image_id").agg(
        pick(F.col("role") == "background").alias("bg"), F.when(has_dark, dark).otherwise(last).alias("tx"),
        pick(F.col("role") == "primary", F.col("s") > 0.25).alias("pr"),
    )
    lum = lambda c: relative_luminance(F.col(f"{c}.r"), F.col(f"{c}.g"), F.col(f"{c}.b"))
    lb, lt = lum("bg"), lum("tx")
    hexa = lambda s: F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(F.col(f"{s}.{c}")), 2, "0") for c in "rgb")))
    return t.select(
        "image_id", hexa("bg").alias("background"), hexa("pr").alias("primary"), hexa("tx").alias("text_color"), (lb < 0.2).alias("is_dark_mode"),
        ((F.greatest(lb, lt) + 0.05) / (F.least(lb, lt) + 0.05)).alias("contrast_ratio"),
    )
