"""Annotation files: scan, validation of the shape, trees, reports (SRC-1, SRC-2, SRC-10, SNK-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Companion files of an annotation.
SIDECARS = (".prediction.json", ".review.json", ".ai-review.json", ".session.json", ".bak")

_NUM = "DOUBLE"
ELEMENT = (
    f"STRUCT<id: STRING, type: STRING, semanticRole: STRING, bbox: STRUCT<x: {_NUM}, y: {_NUM}, w: {_NUM}, h: {_NUM}>, render: STRING, "
    "text: STRING, variant: STRING, control: STRUCT<family: STRING, state: STRING, shape: STRING>, labelNodeId: STRING, children: ARRAY<STRING>>"
)
SCHEMA = (
    "image STRING, imageSize STRUCT<width: DOUBLE, height: DOUBLE>, platform STRING, theme STRING, language STRING, dpi STRING, "
    f"elements ARRAY<{ELEMENT}>, relations ARRAY<STRUCT<`from`: STRING, `to`: STRING, type: STRING, source: STRING, confidence: DOUBLE, reviewStatus: STRING>>, "
    "zOrder ARRAY<STRUCT<id: STRING, z: INT>>, warnings ARRAY<STRING>, _corrupt_record STRING"
)
PACK = "file STRING, content STRING"


def _is_sidecar(path: Column) -> Column:
    out = F.lit(False)
    for suffix in SIDECARS:
        out = out | path.endswith(suffix)
    return out


def read_annotations(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The annotations under ``folder`` (recursive) with their ``file``, sidecars among them.

    A ``.json`` file is one annotation.  Millions of such files cost more to list and open than to
    read, so they may also lie in packs: Parquet files with the columns file (a relative path) and
    content (its text), written by ``pack_annotations``.  A member of a pack goes by the path of the
    pack and its own."""
    def reader(schema: str, pattern: str):
        source = spark.readStream if stream else spark.read
        return source.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)

    raw = reader(SCHEMA, "*.json").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    loose = raw.json(folder).withColumn("file", F.col("_metadata.file_path"))
    packs = reader(PACK, "*.parquet").parquet(folder)
    members = packs.select(F.concat_ws("/", "_metadata.file_path", "file").alias("file"), F.coalesce("content", F.lit("[no content")).alias("content"))
    return loose.unionByName(parse_annotations(members, "content").drop("content"))


def pack_annotations(files: DataFrame, folder: str) -> None:
    """Write (file, content) rows as packs."""
    files.select("file", "content").write.parquet(folder)


def scan_annotations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Annotation files under ``folder`` (recursive, loose or in packs), one row per file with its
    path, and the list of sidecar files that were skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    packs = spark.read.schema(PACK).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    # content is pruned from both scans
    paths = files.select("path").unionByName(packs.select(F.concat_ws("/", "_metadata.file_path", "file").alias("path")))
    skipped = paths.where(_is_sidecar(F.col("path"))).select(F.col("path").alias("file"), F.lit("sidecar").alias("reason"))
    return read_annotations(spark, folder).where(~_is_sidecar(F.col("file"))), skipped


def parse_annotations(df: DataFrame, json_col: str) -> DataFrame:
    """The same shape from a JSON text column."""
    parsed = F.from_json(json_col, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return df.withColumn("_a", parsed).select(*df.columns, "_a.*")


def invalid_reason(df: DataFrame) -> Column:
    """Why an annotation is unusable, NULL when it is fine."""
    def lacks(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.lit(f"annotation missing required field: {name}"))

    bad_id = F.exists("elements", lambda e: e["id"].isNull() | e["type"].isNull())
    box = lambda e: e["bbox"].isNull() | e["bbox"]["x"].isNull() | e["bbox"]["y"].isNull() | e["bbox"]["w"].isNull() | e["bbox"]["h"].isNull()
    first_box = F.get(F.filter("elements", box), F.lit(0))["id"]
    first_render = F.get(F.filter("elements", lambda e: e["render"].isNull()), F.lit(0))["id"]
    corrupt = F.col("_corrupt_record").isNotNull() & F.col("image").isNull() & F.col("elements").isNull()
    size = F.col("imageSize.width").isNull() | F.col("imageSize.height").isNull()
    return F.coalesce(
        F.when(corrupt, F.lit("annotation root must be an object")), lacks("image"), lacks("imageSize"), lacks("platform"), lacks("theme"), lacks("language"), lacks("dpi"),
        lacks("elements"), F.when(size, "annotation imageSize must have numeric width and height"), F.when(bad_id, "annotation element missing id or type"),
        F.when(first_box.isNotNull(), F.concat(F.lit("annotation element "), first_box, F.lit(" has invalid bbox"))),
        F.when(first_render.isNotNull(), F.concat(F.lit("annotation element "), first_render, F.lit(" missing render field"))),
    )


def judge(df: DataFrame) -> DataFrame:
    """Annotations with ``reason``, why they are unusable, NULL for the valid ones."""
    return df.withColumn("reason", F.concat(F.lit("invalid: "), invalid_reason(df)))


def reject_invalid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid annotations, rejects with ``reason``)."""
    rows = judge(df)
    return rows.where(F.col("reason").isNull()).drop("reason", "_corrupt_record"), rows.where(F.col("reason").isNotNull())


def elements_of(annotations: DataFrame, key: str = "image_id") -> DataFrame:
    """Elements of annotations, one row each, with their position as ``ord``."""
    rows = annotations.select(key, F.posexplode("elements").alias("ord", "e"))
    return rows.select(
        key, "ord", F.col("e.id").alias("element_id"), "e.type", F.col("e.semanticRole").alias("semantic_role"), F.col("e.bbox.x").alias("x"), F.col("e.bbox.y").alias("y"),
        F.col("e.bbox.w").alias("w"), F.col("e.bbox.h").alias("h"), "e.render", "e.text", "e.variant", "e.children",
    )


def relations_of(annotations: DataFrame, key: str = "image_id") -> DataFrame:
    rows = annotations.select(key, F.posexplode("relations").alias("ord", "r"))
    return rows.select(
        key, "ord", F.col("r.from").alias("src"), F.col("r.to").alias("dst"), "r.type", "r.source", "r.confidence", F.col("r.reviewStatus").alias("review_status")
    )


def ground_truth(elements: DataFrame) -> DataFrame:
    return elements.select("image_id", "ord", F.col("element_id").alias("box_id"), "type", "x", "y", "w", "h")


def flatten_tree(df: DataFrame, key: str, json_col: str, exclude_semantic_only: bool = False) -> DataFrame:
    """Node rows (key, node_id, parent_id, depth, path, type, box, text) of a nested JSON tree.

    Level by level over VARIANT values: a round parses the trees once and opens ``LEVELS``
    levels of them row by row, and only trees that are deeper go on to another round.  ``path``
    holds zero-padded child positions, its order is the pre-order walk.  The page root and, if
    asked, semantic-only nodes are left out of the result but walked through."""
    from screenlake.operators.trees import LEVELS
    from screenlake.session import cut_lineage

    get = lambda p, t: F.try_variant_get("_v", f"$.{p}", t)
    level = df.select(key, F.col(json_col).alias("_tree"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit("").alias("path"))
    level = level.where(F.try_parse_json("_tree").isNotNull())
    found = {
        "node_id": get("id", "string"), "type": get("type", "string"), **{c: get(f"bbox.{c}", "double") for c in "xywh"},
        "text": get("text", "string"), "render_mode": get("props.render.mode", "string"),
    }
    places = ["parent_id", "depth", "path"]
    # ten digits hold every position, so the order of paths is the order of positions
    child = lambda c, i: F.struct(
        F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), F.lpad(i.cast("string"), 10, "0")).alias("path"), c.alias("_v"),
        F.lit(True).alias("_open"), *(F.lit(None).cast("double" if n in "xywh" else "string").alias(n) for n in found),
    )
    own = F.struct(*places, F.lit(None).cast("variant").alias("_v"), F.lit(False).alias("_open"), *found)
    out = None
    while True:
        rows = level.select(key, *places, F.try_parse_json("_tree").alias("_v"), F.lit(True).alias("_open"), *(F.lit(None).cast("double" if n in "xywh" else "string").alias(n) for n in found))
        for _ in range(LEVELS):
            # a node that is still shut gives itself, read, and its children, shut
            rows = rows.select(key, *places, "_open", F.when(F.col("_open"), get("children", "array<variant>")).alias("_c"), *(F.when(F.col("_open"), v).otherwise(F.col(n)).alias(n) for n, v in found.items()))
            rows = rows.select(key, F.explode(F.when(F.col("_c").isNull(), F.array(own)).otherwise(F.concat(F.array(own), F.transform("_c", child)))).alias("_e")).select(key, "_e.*")
        # what travels between rounds is JSON text, which every file format can hold
        rows = cut_lineage(rows.withColumn("_tree", F.to_json("_v")).drop("_v"))
        done = rows.where("NOT _open").select(key, *places, *found)
        out = done if out is None else out.unionByName(done)
        level = rows.where("_open").select(key, "_tree", *places)
        if level.isEmpty():
            break
    keep = F.coalesce(F.col("type") != "page", F.lit(True))
    if exclude_semantic_only:
        keep = keep & F.coalesce(F.col("render_mode") != "semantic-only", F.lit(True))
    return out.where(keep)


def write_samples(samples: DataFrame, path: str) -> None:
    """Exported samples, one folder per split."""
    samples.withColumn("split", F.coalesce("split", F.lit("none"))).write.mode("overwrite").partitionBy("split").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Metrics or calibration rows as JSON lines."""
    df.write.mode("overwrite").json(path)
