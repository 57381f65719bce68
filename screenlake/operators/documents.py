"""Tables, fields, charts and code read off text lines (TXT-19..23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from screenlake.functions import geometry as G
from screenlake.functions.semantics import js_round, keep_first, upper_median, with_group
from screenlake.operators.entities import comparable, label_value
from screenlake.operators.lines import group_lines_fold, group_lines_gap
from screenlake.operators.ordered import nearest
from screenlake.operators.spatial import items_in_region
from screenlake.session import cut_lineage

BOX = ("x", "y", "w", "h")
# Number, amount and unit patterns.
NUMBER_CELL = r"^[¥￥$]?\s*[\d,]+\.?\d*$"
AMOUNT, CURRENCY, UNIT = r"^\d+(?:\.\d+)?$", ["¥", "￥", "夫"], r"^[(（]元[)）]$"
METRIC = r"^(.{1,12}?)\s*[:：]?\s*([¥￥$]?\s*[\d,]+\.?\d*\s*%?)$"
STANDALONE = r"(?i)^([¥￥$]?\s*[\d,]+\.?\d*\s*[%万亿kmb]?|[\d,]+\.?\d*\s*%)$"
COORDINATES = r"^\s*\d+\s*([,，]\s*\d+\s*){3,}$"


def _ordered(order: Sequence[str | Column], value: Column) -> Column:
    """Values of one text line in order.  A line is one row of text on a page."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda s: s["_v"])


def line_items(items: DataFrame) -> DataFrame:
    """Rows of a document body as description, quantity, unit price and amount: the texts
    that are not numbers make the description, the numbers fill the columns in order."""
    rows = group_lines_gap(items).withColumn("_t", F.trim("text")).where(F.col("_t") != "")
    per = rows.groupBy("image_id", "line").agg(_ordered(["y", "x", "ord"], F.col("_t")).alias("ts"))
    number = lambda t: t.rlike(NUMBER_CELL)
    nums = F.transform(F.filter("ts", number), lambda t: F.regexp_replace(t, r"[¥￥$\s]", ""))
    per = per.withColumn("nums", nums).withColumn("description", F.array_join(F.filter("ts", lambda t: ~number(t)), " "))
    n = F.size("nums")
    return per.where(F.col("description") != "").select(
        "image_id", "line", "description", F.get("nums", F.lit(0)).alias("quantity"), F.get("nums", F.lit(1)).alias("unit_price"),
        F.when(n >= 3, F.get("nums", F.lit(2))).when(n == 2, F.get("nums", F.lit(1))).alias("amount"),
    )


def _cell_text(cell: Column) -> Column:
    """Text of one table cell from its ordered texts: an amount with a currency sign gives
    ``amount ¥``; a repeated amount is dropped; units get full-width brackets."""
    amount = F.get(F.filter(cell, lambda t: t.rlike(AMOUNT)), F.lit(0))
    money = F.size(F.filter(cell, lambda t: t.isin(CURRENCY))) > 0

    def add(acc: Column, t: Column) -> Column:
        unit = F.when(t.rlike(UNIT), F.lit("（元）")).otherwise(t)
        seen = t.rlike(AMOUNT) & F.exists(acc, lambda p: (p == unit) | p.startswith(F.concat(unit, F.lit(" "))))
        return F.when(seen, acc).otherwise(F.array_append(acc, unit))

    parts = F.aggregate(cell, F.array().cast("array<string>"), add)
    return F.when(amount.isNotNull() & money, F.concat(amount, F.lit(" ¥"))).otherwise(F.array_join(parts, " "))


def _headers(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Header cells of lined items (keys, col, cx, header, unit_line): the texts of the first line by
    centre.  A second line of units only belongs to the header."""
    units = rows.where(F.col("line") == 1).groupBy(*keys).agg(F.min(F.col("text").rlike(UNIT)).alias("_u"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_cx", "ord"))
    head = rows.where(F.col("line") == 0).select(*keys, (place - 1).alias("col"), F.col("_cx").alias("cx"), "text").join(units, keys, "left")
    unit = F.coalesce("_u", F.lit(False))
    return head.select(*keys, "col", "cx", "text", F.concat("text", F.when(unit, "（元）").otherwise("")).alias("header"), unit.alias("unit_line"))


def reconstruct_table(items: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Table cells in long form (keys, row, col, header, text); row 0 is the first data row.

    The first text line is the header; every other item goes to the column whose header
    centre is nearest (ties: left).  A group is a table when it has at least two header
    items, half of them different, a row with two filled columns, and 40 % filled cells.
    A second line of units only is merged into the header."""
    keys = list(keys)
    # lines are read five times below: folded once, then a table
    lines = cut_lineage(group_lines_fold(items.select(*keys, "ord", "text", *BOX), keys))
    # creation order of lines is top to bottom
    rows = lines.withColumn("_cx", G.box().cx)
    head = _headers(rows, keys)
    name = comparable(F.col("text"))
    shape = head.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_c"), F.count_distinct(F.when(name != "", name)).alias("_names"), F.max("unit_line").alias("_u")
    )
    shape = shape.where((F.col("_c") >= 2) & (F.col("_names") >= F.col("_c") * 0.5)).drop("_names")
    body = rows.where(F.col("line") > 0).join(shape, keys)
    centres = head.select(*keys, F.col("cx").alias("_cx"), "col")
    body = nearest(body, centres, keys, "_cx", ["col"]).withColumn("col", F.col("near.col")).where(F.col("col").isNotNull())
    # a unit line is one of the data lines for this test
    fill = body.groupBy(*keys, "line").agg(F.count_distinct("col").alias("_f"), F.max("_c").alias("_c"))
    ok = fill.groupBy(*keys).agg(F.max(F.col("_f") >= 2).alias("_two"), (F.sum("_f") / F.sum("_c")).alias("_share"))
    ok = ok.where(F.col("_two") & (F.col("_share") >= 0.4)).select(*keys)
    data = body.where(~(F.col("_u") & (F.col("line") == 1))).join(ok, keys, "left_semi")
    cells = data.groupBy(*keys, "line", "col").agg(_ordered(["_cx", "ord"], F.col("text")).alias("_cell"), F.max(F.col("_u").cast("int")).alias("_u"))
    cells = cells.withColumn("text", _cell_text(F.col("_cell"))).where(F.col("text") != "")
    out = cells.join(head.select(*keys, "col", "header"), [*keys, "col"])
    return out.select(*keys, (F.col("line") - 1 - F.col("_u")).alias("row"), "col", "header", "text")


def _lines_of(lined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a line (keys, line, items): its items in order, dealt by ``keys``."""
    cell = F.struct("text", "x", "y", "w", "h")
    rows = lined.withColumn("_cx", G.box().cx).repartition(*keys)
    return rows.groupBy(*keys, "line").agg(_ordered(["_cx", "ord"], cell).alias("items"))


def _row_counts(lines: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Data rows of the table in every group of ``lines`` (as of ``_lines_of``), by the rules of
    ``reconstruct_table``: a row a line (keys, line, columns of ``carry``, n_columns, filled, _c, _u).

    Lines are dealt already, so one scan from either side gives each item its nearest header."""
    group, line, text = W.partitionBy(*keys), F.col("line"), F.transform("items", lambda e: e["text"])
    head = lambda c: F.max(F.when(line == 0, c)).over(group)
    names = F.size(F.array_distinct(F.filter(F.transform(text, comparable), lambda t: t != "")))
    rows = lines.withColumn("_c", head(F.size("items"))).withColumn("_names", head(names))
    rows = rows.withColumn("_wide", F.max(F.when(line > 0, F.size("items"))).over(group))
    table = (F.col("_c") >= 2) & (F.col("_names") >= F.col("_c") * 0.5) & (F.col("_wide") >= 2)
    rows = rows.withColumn("_table", F.coalesce(table, F.lit(False))).drop("_names", "_wide")
    # a group without a table needs one item a line only, for the columns to carry
    items = F.when(F.col("_table"), F.col("items")).otherwise(F.slice("items", 1, 1))
    rows = rows.select(*keys, "line", "_c", "_u", "_table", *carry, F.posexplode(items).alias("_pos", "_item"))
    first = lambda c: F.when(F.col("_pos") == 0, F.col(c)).alias(c)
    cx = F.when(F.col("_table"), F.col("_item.x") + F.col("_item.w") / 2)
    rows = rows.select(*keys, "line", "_c", "_u", "_table", *(first(c) for c in carry), "_pos", F.col("_item.text").alias("text"), cx.alias("_cx"))
    body = F.col("_table") & (line > 0)
    header = F.when(F.col("_table") & (line == 0) & F.col("_cx").isNotNull(), F.struct("_cx", F.col("_pos").alias("col")))
    # headers go before the items of their centre; of equal headers the leftmost is met last
    order = lambda end: [end, F.least(line, F.lit(1)), F.desc("_pos")]
    seen = lambda end: F.last(header, True).over(group.orderBy(*order(end)).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_below", seen(F.asc("_cx"))).withColumn("_above", seen(F.desc("_cx")))
    gap = lambda a: F.abs(F.col("_cx") - F.col(a)["_cx"])
    near = F.when(F.col("_above").isNull() | (gap("_below") <= gap("_above")), F.col("_below")).otherwise(F.col("_above"))
    rows = rows.withColumn("_col", F.when(body & F.col("_cx").isNotNull(), near["col"]))
    # a cell has a text if one of its texts is not empty, or if it joins two
    filled = F.col("_col").isNotNull() & (F.coalesce(F.max(F.col("text") != ""), F.lit(False)) | (F.count("text") > 1))
    kept = [F.max(c).alias(c) for c in (*carry, "_c", "_u")]
    cells = rows.groupBy(*keys, "line", "_col").agg(*kept, filled.alias("filled"))
    return cells.groupBy(*keys, "line").agg(*kept, F.count("_col").alias("n_columns"), F.max("filled").alias("filled"))


def key_content(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Structured content per region: kind (table / fields / text / empty), counts and the
    summary sentence, with the rank of the region (primary = 1).

    ``items``: image_id, ord, text, box.  ``regions``: image_id, region_id, confidence, box.

    The items of a region are dealt once for its lines and once more for all that is read off these."""
    keys = ["image_id", "region_id"]
    pairs = items_in_region(items.select("image_id", "ord", "text", "x", "y", "w", "h"), regions.select("image_id", "region_id", "x", "y", "w", "h"))
    inside = pairs.select("image_id", F.col("b_region_id").alias("region_id"), *(F.col("a_" + c).alias(c) for c in ("ord", "text", "x", "y", "w", "h")))
    lines = _lines_of(group_lines_fold(inside, keys), keys)
    text, line = F.transform("items", lambda e: e["text"]), F.col("line")
    known = F.filter(text, lambda t: t.isNotNull())
    units = F.when(F.size(known) > 0, F.forall(known, lambda t: t.rlike(UNIT)))
    unit = F.coalesce(F.max(F.when(line == 1, units)).over(W.partitionBy(*keys)), F.lit(False))
    lines = lines.withColumn("_text", F.array_join(text, " ")).withColumn("_pair", label_value(F.col("_text")))
    # every header counts, also of columns without a filled cell
    names = F.transform(text, lambda t: F.concat(t, F.when(F.col("_u"), "（元）").otherwise("")))
    lines = lines.select(
        *keys, "line", "items", _line_text(F.col("items")).alias("_unique"),
        F.concat("_pair.label", F.lit("="), "_pair.value").alias("_field"), unit.alias("_u"),
    ).withColumn("_columns", F.when(line == 0, F.array_join(names, "、")))
    rows = _row_counts(lines, keys, ["_unique", "_field", "_columns"])
    body = F.col("n_columns") > 0
    kept = lambda c, ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("line", c)))), lambda s: s[c])
    unique, fields = F.col("_unique") != "", F.col("_field").isNotNull()
    share = F.sum(F.when(body, F.col("n_columns"))) / F.sum(F.when(body, F.col("_c")))
    table = F.coalesce(F.max(body & (F.col("n_columns") >= 2)) & (share >= 0.4), F.lit(False))
    # a unit line belongs to the header
    data = F.count(F.when(body & F.col("filled") & ~(F.col("_u") & (line == 1)), 1))
    found = rows.groupBy(*keys).agg(
        F.when(table, data).otherwise(0).alias("n_rows"), F.max("_columns").alias("columns"),
        F.array_join(kept("_field", fields), "，").alias("fields"), F.count(F.when(fields, 1)).alias("n_fields"),
        F.array_join(kept("_unique", unique), "；").alias("body"), F.count(F.when(unique, 1)).alias("n_lines"),
    )
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("confidence"), "region_id"))
    out = regions.select("image_id", "region_id", "confidence").withColumn("rank", rank)
    # small files, many rows: never broadcast through the driver
    out = out.join(found.hint("merge"), keys, "left").fillna(0, ["n_rows", "n_fields", "n_lines"])
    kind = F.when(F.col("n_rows") > 0, "table").when(F.col("n_fields") > 0, "fields").when(F.col("n_lines") > 0, "text").otherwise("empty")
    summary = (
        F.when(F.col("n_rows") > 0, F.concat(F.lit("关键区域包含表格："), "columns", F.lit("，共 "), F.col("n_rows").cast("string"), F.lit(" 行。")))
        .when(F.col("n_fields") > 0, F.concat(F.lit("关键区域包含字段："), "fields", F.lit("。")))
        .when(F.col("n_lines") > 0, F.concat(F.lit("关键区域包含："), "body", F.lit("。"))).otherwise("关键区域未识别到明确文本。")
    )
    return out.select("image_id", "region_id", "rank", kind.alias("kind"), "n_rows", "n_fields", "n_lines", summary.alias("summary"))


def _line_text(items: Column) -> Column:
    """Text of one line from its ordered items (text and box): near duplicates of earlier
    texts are left out, and an amount takes the currency sign in the next cell."""
    unit = lambda t: F.when(t.rlike(UNIT), F.lit("（元）")).otherwise(t)

    def pairs(e: Column, i: Column) -> Column:
        n = F.get(items, i + 1)
        tall = F.greatest(e["h"], n["h"])
        near = (F.abs(e["y"] + e["h"] / 2 - n["y"] - n["h"] / 2) <= tall * 0.7) & (n["x"] >= e["x"])
        near = near & (n["x"] - e["x"] - e["w"] <= F.greatest(F.lit(8.0), e["w"] * 0.7, tall))
        money = n["text"].isin(CURRENCY) & e["text"].rlike(AMOUNT) & near
        return F.struct(e["text"].alias("text"), comparable(e["text"]).alias("bare"), F.coalesce(money, F.lit(False)).alias("money"))

    def shown(e: Column) -> Column:
        # the bare text is that of what is shown; it is not worked out again for each comparison
        text = F.when(e["money"], F.concat(e["text"], F.lit(" ¥"))).otherwise(unit(e["text"]))
        bare = F.when(e["money"], F.concat(e["bare"], F.lit("¥"))).when(e["text"].rlike(UNIT), F.lit("(元)")).otherwise(e["bare"])
        return F.struct(text.alias("text"), bare.alias("bare"))

    def step(acc: Column, e: Column) -> Column:
        a = e["bare"]

        def dup(p: Column) -> Column:
            b = p["bare"]
            held = lambda short, long: (F.length(short) >= 8) & F.contains(long, short)
            return (a != "") & (b != "") & ((a == b) | F.when(F.length(a) <= F.length(b), held(a, b)).otherwise(held(b, a)))

        keep = ~acc["skip"] & ~F.exists(acc["parts"], dup)
        return F.struct(
            F.when(keep, F.array_append(acc["parts"], shown(e))).otherwise(acc["parts"]).alias("parts"), (keep & e["money"]).alias("skip")
        )

    zero = F.struct(F.array().cast("array<struct<text:string,bare:string>>").alias("parts"), F.lit(False).alias("skip"))
    parts = F.aggregate(F.transform(items, pairs), zero, step)["parts"]
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), " ")
    # most lines are one item, which nothing can repeat
    alone = F.coalesce(unit(F.get(items, F.lit(0))["text"]), F.lit(""))
    return F.trim(F.when(F.size(items) == 1, alone).otherwise(joined))


def chart_metrics(items: DataFrame) -> DataFrame:
    """Label + number or standalone number texts, each value once per image (first wins);
    coordinate lists are no metrics."""
    t = F.trim("text")
    rows = items.withColumn("_t", t)
    label = F.trim(F.regexp_extract("_t", METRIC, 1))
    value = F.regexp_replace(F.regexp_extract("_t", METRIC, 2), r"\s+", "")
    paired = (label != "") & (value != "") & ~value.rlike(COORDINATES)
    alone = F.col("_t").rlike(STANDALONE) & ~F.col("_t").rlike(COORDINATES)
    rows = rows.withColumn("label", F.when(paired, label).when(alone, F.lit(""))).withColumn("value", F.when(paired, value).when(alone, F.col("_t")))
    rows = rows.where(F.col("value").isNotNull()).select("image_id", "value", "label", "ord")
    return keep_first(rows, ["image_id", "value"], ["ord"])


def chart_categories(items: DataFrame) -> DataFrame:
    """Axis labels: short texts that start in the bottom 30 % (all texts when none does)."""
    ext = items.groupBy("image_id").agg(F.max(F.col("y") + F.col("h")).alias("_m"))
    rows = items.join(ext, "image_id").withColumn("_axis", F.col("y") >= F.col("_m") * 0.7)
    rows = with_group(rows, ["image_id"], F.max(F.col("_axis").cast("int")).alias("_any"))
    rows = rows.where(F.col("_axis") | (F.col("_any") == 0)).withColumn("label", F.trim("text"))
    ok = (F.length("label") > 0) & (F.length("label") <= 12) & ~F.col("label").rlike(r"^\d+$")
    return keep_first(rows.where(ok).select("image_id", "label", "ord"), ["image_id", "label"], ["ord"])


def chart_title(items: DataFrame) -> DataFrame:
    return items.groupBy("image_id").agg(F.min_by(F.trim("text"), F.struct("y", "ord")).alias("title"))


def code_lines(items: DataFrame) -> DataFrame:
    """Code lines with indentation from the left edge over the upper median character
    width; a line-number gutter is stripped when at least 60 % of the lines have one."""
    rows = group_lines_gap(items, "code").withColumn("_cw", F.col("w") / F.greatest(F.lit(1), F.length("text")))
    stats = rows.groupBy("image_id").agg(F.min("x").alias("_x0"), upper_median("_cw").alias("_m"))
    lines = rows.groupBy("image_id", "line").agg(F.min("x").alias("_x"), _ordered(["x", "ord"], F.col("text")).alias("_ts"))
    lines = lines.join(stats, "image_id")
    indent = F.greatest(F.lit(0.0), js_round((F.col("_x") - F.col("_x0")) / F.greatest(F.lit(2.0), F.col("_m")))).cast("int")
    text = F.trim(F.regexp_replace(F.array_join("_ts", " "), r"\s+", " "))
    lines = lines.withColumn("text", F.concat(F.repeat(F.lit(" "), indent), text))
    numbered = F.col("text").rlike(r"^\s*\d{1,4}\s+\S")
    lines = with_group(lines.select("image_id", "line", "text"), ["image_id"], F.count(F.lit(1)).alias("_n"), F.count(F.when(numbered, 1)).alias("_k"))
    gutter = (F.col("_n") >= 3) & (F.col("_k") >= F.col("_n") * 0.6)
    return lines.select(
        "image_id", "line", F.when(gutter, F.regexp_replace("text", r"^\s*\d{1,4}\s+", "")).otherwise(F.col("text")).alias("text"), gutter.alias("has_line_numbers")
    )
