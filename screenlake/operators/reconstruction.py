"""Projections into and checks of the nested per-image result (PRJ-1, PRJ-5..7, SET-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from screenlake.functions import geometry as G


def apply_detect_toggles(df: DataFrame, flags: DataFrame, kind: str) -> DataFrame:
    """Keep, blank or drop rows by request flags (request_id, detect_component,
    detect_text, detect_icon, detect_layout; NULL means on).

    ``kind``: ``components`` / ``media`` lose their text with detect_text off, ``texts`` and
    the others are dropped as a whole."""
    on = lambda c: F.coalesce(F.col(c), F.lit(True))
    rows = df.join(flags, "request_id")
    gate = {"components": "detect_component", "texts": "detect_text", "media": "detect_icon", "regions": "detect_layout"}[kind]
    rows = rows.where(on(gate))
    if kind == "components":
        rows = rows.withColumn("text", F.when(on("detect_text"), F.col("text")).otherwise(""))
    elif kind == "media":
        rows = rows.withColumn("nearby_text", F.when(on("detect_text"), F.col("nearby_text")))
    return rows.select(*df.columns)


def evidence_from_layout(components: DataFrame, regions: DataFrame, texts: DataFrame) -> DataFrame:
    """Evidence candidates from layout tables with the default scores 0.7 / 0.6 / 0.9;
    invalid boxes are dropped."""
    def tagged(df: DataFrame, prefix: str, kind: Column, score: float, source: str, text: Column) -> DataFrame:
        return df.where(G.valid_box(G.box())).select(
            "image_id", F.concat(F.lit(prefix), F.col("ord").cast("string")).alias("cand_id"), kind.alias("type"), "x", "y", "w", "h", F.lit(score).alias("score"),
            F.lit(source).alias("source"), text.alias("text"),
        )

    none = F.lit(None).cast("string")
    return (
        tagged(components, "cv-", F.col("type"), 0.7, "cv", F.col("text"))
        .unionByName(tagged(regions, "cv-region-", F.col("type"), 0.6, "cv", none))
        .unionByName(tagged(texts, "ocr-", F.lit("text"), 0.9, "ocr", F.col("text")))
    )


def layout_block(pages: DataFrame, layouts: DataFrame, spacing: DataFrame, media: DataFrame) -> DataFrame:
    """Layout columns of the parse view per image."""
    m = media.groupBy("image_id").agg(F.count(F.lit(1)).alias("media_area_count"))
    rows = layouts.join(pages, "image_id", "left").join(spacing, "image_id", "left").join(m, "image_id", "left")
    return rows.select(
        "image_id", F.col("page_class").alias("page_type"), "layout_type", "average_gap", F.col("scale").alias("spacing_scale"),
        F.coalesce("media_area_count", F.lit(0)).alias("media_area_count"),
    )


def design_block(theme: DataFrame, palette: DataFrame, k: int | None = None) -> DataFrame:
    """Theme columns plus the palette colours of the image, all or the ``k`` most frequent."""
    from screenlake.operators.layout import top_k_per_group

    hexa = F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(c), 2, "0") for c in "rgb")))
    top = top_k_per_group(palette, ["image_id"], [F.desc("n"), "r", "g", "b"], k)
    cols = top.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", hexa.alias("hex"), "role", "frequency"))).alias("palette"))
    return theme.join(cols, "image_id", "left")


def assemble_reconstruction(nodes: DataFrame, constraints: DataFrame, repeats: DataFrame, media: DataFrame, layouts: DataFrame) -> DataFrame:
    """One nested row per image: page, tree (adjacency list in node order), constraints,
    repeats, slots, images and component counts.  The row is the result itself, so each
    list is as long as the image has rows of its kind; use the flat tables where an image
    may be too large for one row."""
    keys = "image_id"

    def gather(df: DataFrame, order: str, cols: list[str], name: str) -> DataFrame:
        return df.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias(name))

    tree = gather(nodes, "ord", ["node_id", "parent_id", "type", "x", "y", "w", "h"], "tree")
    counts = nodes.groupBy(keys, "type").agg(F.count(F.lit(1)).alias("n")).groupBy(keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("component_counts"), F.sum("n").alias("node_count")
    )
    cons = gather(constraints, "target_id", ["direction", "gap", "align"], "constraints")
    reps = gather(repeats, "target_id", ["count", "template_id", "template_type"], "repeats")
    slot = repeats.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct(F.col("template_id").alias("id"), F.concat("template_type", F.lit("Template")).alias("name")))).alias("slots"))
    imgs = gather(media, "ord", ["type", "alt_text"], "images")
    out = tree.join(counts, keys)
    for df in (cons, reps, slot, imgs, layouts):
        out = out.join(df, keys, "left")
    return out


def summary_only(spec: DataFrame) -> DataFrame:
    """Root-only trim: the counts stay, the lists are emptied."""
    root = F.filter("tree", lambda n: n["parent_id"].isNull())
    empty = {c: F.expr(f"slice({c}, 1, 0)") for c in ("constraints", "repeats", "slots", "images")}
    return spec.withColumns({"tree": root, **empty})


def markdown(nodes: DataFrame, version: str = "1") -> DataFrame:
    """Markdown outline per image: one document is one row by definition.  ``nodes``:
    image_id, path (sorts in pre-order), depth, node_id, type, text, box."""
    pad = F.repeat(F.lit("  "), F.col("depth"))
    text = F.when(F.col("text").isNotNull(), F.concat(F.lit(' text: "'), "text", F.lit('"'))).otherwise("")
    num = lambda c: F.format_string("%s", F.when(F.col(c) == F.floor(c), F.col(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string")))
    fence = F.concat(pad, F.lit("  ```"))
    block = F.concat_ws(
        "\n", F.concat(pad, F.lit("- **"), "node_id", F.lit("** - `"), "type", F.lit("`"), text), fence, F.concat(pad, F.lit("  type: "), "type"),
        F.concat(pad, F.lit("  bbox: { x: "), num("x"), F.lit(", y: "), num("y"), F.lit(", w: "), num("w"), F.lit(", h: "), num("h"), F.lit(" }")), fence,
    )
    rows = nodes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("path", block.alias("b")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda s: s["b"]), "\n")
    return rows.select("image_id", F.concat(F.lit(f"# UI Semantic AST (v{version})\n\n"), body).alias("markdown"))


def spec_consistency(nodes: DataFrame, declared: DataFrame, refs: DataFrame) -> DataFrame:
    """Contradictions of a reconstruction: declared against actual counts, duplicate or
    empty ids, bad boxes, references to missing nodes.

    ``declared``: image_id, type, n.  ``refs``: image_id, kind, target_id."""
    none = F.lit(None).cast("string")

    def err(df: DataFrame, code: str, detail: Column) -> DataFrame:
        return df.select("image_id", F.lit(code).alias("code"), detail.alias("detail"))

    actual = nodes.groupBy("image_id", "type").agg(F.count(F.lit(1)).alias("actual"))
    both = actual.join(declared.withColumnRenamed("n", "declared"), ["image_id", "type"], "full")
    counts = both.where(F.coalesce("actual", F.lit(0)) != F.coalesce("declared", F.lit(0)))
    dup = nodes.groupBy("image_id", "node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    big = 1.7976931348623157e308
    finite = F.lit(True)
    for c in "xywh":
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) <= big), F.lit(False))
    ids = nodes.select("image_id", F.col("node_id").alias("target_id")).distinct()
    parts = [
        err(counts, "count-mismatch", F.col("type")), err(dup, "duplicate-node-id", F.col("node_id")),
        err(nodes.where(F.coalesce(F.col("node_id") == "", F.lit(True))), "missing-node-id", none),
        err(nodes.where(~finite), "invalid-bbox", F.col("node_id")), err(nodes.where(finite & ((F.col("w") < 0) | (F.col("h") < 0))), "negative-bbox", F.col("node_id")),
        err(declared.where("n < 0"), "invalid-count", F.col("type")),
        err(refs.join(ids, ["image_id", "target_id"], "left_anti"), "missing-target", F.concat_ws(":", "kind", "target_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
