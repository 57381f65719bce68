"""OCR payloads to item rows (SRC-5, SRC-6, SRC-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from screenlake.functions import geometry as G
from screenlake.functions.semantics import js_round

CORNERS = ("x1", "y1", "x2", "y2")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _all(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c)
    return ok


def _corners(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct x1..y2, NULL unless all four are numbers."""
    return F.when(_all(a, b, c, d), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def parse_position(text: Column) -> Column:
    """``"x1,y1,x2,y2"`` as a corner struct, NULL when it is not four numbers."""
    parts = F.split(text, ",")
    nums = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    at = lambda i: F.get(nums, F.lit(i))
    return F.when(F.size(parts) == 4, _corners(at(0), at(1), at(2), at(3)))


def _item_array(v: Column, text: Column) -> Column:
    """The item array of a payload: the array itself, ``texts``, ``items``, or the same
    inside ``ocr``, at any depth."""
    kind = "array<variant>"
    here = lambda p: F.coalesce(F.try_variant_get(p, "$", kind), _get(p, "texts", kind), _get(p, "items", kind))
    # no more levels than keys that spell ocr, plainly or with an escape
    levels = F.array_repeat(F.lit(0), F.regexp_count(text, F.lit(r'"ocr"|\\u')))
    return here(F.reduce(levels, v, lambda p, _: F.when(here(p).isNotNull(), p).otherwise(_get(p, "ocr", "variant"))))


def _item_box(v: Column) -> Column:
    """box {x1..}, else a position text, else boundingBox / bbox as corners, array of four
    or x / y / width / height."""
    num = lambda p: _get(v, p, "double")
    exact = lambda name: _corners(*(num(f"{name}.{c}") for c in CORNERS))
    array = lambda name: F.when(F.size(_get(v, name, "array<variant>")) == 4, _corners(*(num(f"{name}[{i}]") for i in range(4))))
    x = lambda name: num(f"{name}.x")
    y = lambda name: num(f"{name}.y")
    rect = lambda name: _corners(x(name), y(name), x(name) + num(f"{name}.width"), y(name) + num(f"{name}.height"))
    position = _get(v, "position", "string")
    loose = F.coalesce(*(f(name) for name in ("boundingBox", "bbox") for f in (exact, array, rect)))
    return F.coalesce(exact("box"), F.when(position.isNotNull(), parse_position(position)).otherwise(loose))


def ocr_items_from_json(df: DataFrame, json_col: str, key: str = "image_id", source: str = "full") -> DataFrame:
    """One row per OCR item of a JSON payload (key, ord, text, box or NULLs, confidence);
    string items are texts, empty texts are dropped.  Pure JVM, no Python parser."""
    v = F.try_parse_json(json_col)
    rows = df.select(key, F.posexplode(_item_array(v, F.col(json_col))).alias("ord", "_v"))
    kind = F.schema_of_variant("_v")
    text = F.when(kind == "STRING", F.try_variant_get("_v", "$", "string")).when(kind.startswith("OBJECT"), _get(F.col("_v"), "text", "string"))
    rows = rows.withColumn("text", F.trim(text)).where(F.coalesce(F.col("text") != "", F.lit(False)))
    rows = rows.withColumn("_b", F.when(kind.startswith("OBJECT"), _item_box(F.col("_v"))))
    conf = F.when(F.col("_b").isNotNull(), _get(F.col("_v"), "confidence", "double"))
    return rows.select(
        key, "ord", "text", F.col("_b.x1").alias("x"), F.col("_b.y1").alias("y"), (F.col("_b.x2") - F.col("_b.x1")).alias("w"), (F.col("_b.y2") - F.col("_b.y1")).alias("h"),
        conf.alias("confidence"), F.lit(source).alias("source"),
    )


def language_tag(text: Column) -> Column:
    return F.when(text.rlike("[一-鿿]"), "zh").when(text.rlike("[A-Za-z]"), "en").otherwise("unknown")


def normalize_raw_ocr(df: DataFrame) -> DataFrame:
    """Raw engine boxes: polygons (ARRAY<ARRAY<DOUBLE>>) become bounding boxes, rectangles
    stay; one-character texts under 0.5 confidence are noise.

    ``df``: image_id, ord, text, score, polygon, rx, ry, rw, rh."""
    text = F.trim("text")
    xs, ys = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    rows = df.withColumn("text", text).where(F.coalesce(F.col("text") != "", F.lit(False)))
    rows = rows.where(~F.coalesce((F.col("score") < 0.5) & (F.length("text") <= 1), F.lit(False)))
    has = F.col("polygon").isNotNull()
    x0, y0 = js_round(F.when(has, F.array_min(xs)).otherwise(F.col("rx"))), js_round(F.when(has, F.array_min(ys)).otherwise(F.col("ry")))
    x1 = js_round(F.when(has, F.array_max(xs)).otherwise(F.col("rx") + F.col("rw")))
    y1 = js_round(F.when(has, F.array_max(ys)).otherwise(F.col("ry") + F.col("rh")))
    return rows.select("image_id", "ord", "text", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"), F.col("score").alias("confidence"), language_tag(F.col("text")).alias("language"))


def document_language(items: DataFrame) -> DataFrame:
    """zh when any item has CJK, en when any has Latin letters, per image."""
    t = F.col("text")
    s = items.groupBy("image_id").agg(F.max(t.rlike("[一-鿿]").cast("int")).alias("z"), F.max(t.rlike("[A-Za-z]").cast("int")).alias("e"))
    return s.select("image_id", F.when(F.col("z") == 1, "zh").when(F.col("e") == 1, "en").otherwise("unknown").alias("language"))


def valid_ocr(items: DataFrame) -> DataFrame:
    """Items with a finite, non-empty box and a confidence in [0, 1] (1 when absent)."""
    conf = F.coalesce("confidence", F.lit(1.0))
    return items.withColumn("confidence", conf).where(G.valid_box(G.box()) & F.col("confidence").between(0.0, 1.0))
