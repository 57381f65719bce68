"""Image bytes (SRC-3, SRC-4) and detector output (SRC-8, SRC-9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from screenlake.functions import geometry as G

MAX_BYTES = 10 * 1024 * 1024


def mime_type(content: Column) -> Column:
    """MIME type from magic numbers, NULL for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def scan_images(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(images, rejects).  The size limit is a filter on the file listing, so oversize
    files are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("image_id")
    small = files.where(F.col("length") <= max_bytes).withColumn("mime", mime_type(F.col("content")))
    ok = small.where(F.col("mime").isNotNull()).select(name, "path", "content", "mime", "length")
    bad = small.where(F.col("mime").isNull()).select("path", F.lit("unrecognized image format").alias("reason"))
    large = files.where(F.col("length") > max_bytes).select("path", F.concat(F.lit("image size "), F.col("length").cast("string"), F.lit(f" exceeds limit {max_bytes}")).alias("reason"))
    return ok, bad.unionByName(large)


def decode_inline_images(df: DataFrame, col: str) -> DataFrame:
    """Bytes of data URIs and long base64 texts; ``source`` tells which, or ``path`` for
    anything else (left to ``scan_images``)."""
    c = F.col(col)
    uri = F.regexp_extract(c, r"^data:image/[\w+]+;base64,(.+)$", 1)
    plain = c.rlike(r"^[A-Za-z0-9+/=\r\n]+$") & (F.length(c) > 100)
    source = F.when(c.startswith("data:image/"), "data-uri").when(plain, "base64").otherwise("path")
    body = F.when(c.startswith("data:image/"), F.when(uri != "", uri)).when(plain, F.regexp_replace(c, r"[\r\n]", ""))
    rows = df.withColumn("source", source).withColumn("content", F.try_to_binary(body, F.lit("base64")))
    rows = rows.withColumn("mime", mime_type(F.col("content"))).withColumn("size", F.octet_length("content"))
    error = F.when((F.col("source") == "data-uri") & F.col("content").isNull(), "invalid data URI").when(F.col("content").isNotNull() & F.col("mime").isNull(), "unrecognized image format")
    return rows.withColumn("error", error)


def detections_from_scores(rows: DataFrame, labels: Sequence[str], min_conf: float, meta: DataFrame) -> DataFrame:
    """Detector rows (image_id, ord, cx, cy, w, h normalised, scores ARRAY<DOUBLE>) to
    candidates: best class (first of equals), confidence cut, pixel box."""
    best = F.array_max("scores")
    cls = F.when(best > 0, F.array_position("scores", best) - 1).otherwise(0)
    label = F.coalesce(F.get(F.array(*map(F.lit, labels)), cls.cast("int")), F.lit("unknown"))
    out = rows.withColumn("score", F.greatest(best, F.lit(0.0))).withColumn("type", label).where(F.col("score") >= min_conf)
    out = out.join(meta.select("image_id", "width", "height"), "image_id")
    iw, ih = F.col("width"), F.col("height")
    return out.select(
        "image_id", "ord", "type", ((F.col("cx") - F.col("w") / 2) * iw).alias("x"), ((F.col("cy") - F.col("h") / 2) * ih).alias("y"), (F.col("w") * iw).alias("w"),
        (F.col("h") * ih).alias("h"), "score", F.lit("ui-detector").alias("source"),
    )


def content_type(content: Column, interactive: Column) -> Column:
    """Type of a caption-style detection from its text and interactivity flag."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return F.when(low.contains("icon") | low.contains("图标"), "icon").when(F.coalesce(interactive, F.lit(False)), "button").otherwise("text")


def detections_from_normalized(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Boxes x1, y1, x2, y2 in [0, 1] times the image size; empty boxes are dropped."""
    out = rows.join(meta.select("image_id", "width", "height"), "image_id")
    iw, ih = F.col("width"), F.col("height")
    b = G.from_corners(F.col("x1") * iw, F.col("y1") * ih, F.col("x1") * iw + (F.col("x2") - F.col("x1")) * iw, F.col("y1") * ih + (F.col("y2") - F.col("y1")) * ih)
    w, h = (F.col("x2") - F.col("x1")) * iw, (F.col("y2") - F.col("y1")) * ih
    return out.select(
        "image_id", "ord", content_type(F.col("content"), F.col("interactivity")).alias("type"), b.x.alias("x"), b.y.alias("y"), w.alias("w"), h.alias("h"),
        F.lit(1.0).alias("score"), F.lit("omniparser").alias("source"), F.col("content").alias("text"),
    ).where((F.col("w") > 0) & (F.col("h") > 0))
