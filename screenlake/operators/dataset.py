"""Dataset lifecycle: manifest, families, splits, priorities (DS-10..13, SRC-11, AGG-8, AGG-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from screenlake.functions.semantics import js_round, round_half_up
from screenlake.operators.matching import annotation_diff
from screenlake.operators.review import DRAFT_WARNING


def build_manifest(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """One row per annotation with content hashes.

    ``annotations``: annotation_file, image_file, warnings.  ``files``: path, content
    (annotation, image and sidecar files).  Hashes are taken before the joins, so file
    bytes never cross the network."""
    hashed = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))

    def with_hash(df: DataFrame, key: Column, name: str) -> DataFrame:
        return df.withColumn("path", key).join(hashed.withColumnRenamed("hash", name), "path", "left").drop("path")

    out = annotations
    note = F.col("annotation_file")
    out = with_hash(out, F.col("image_file"), "image_hash")
    out = with_hash(out, note, "annotation_hash")
    out = with_hash(out, F.concat(note, F.lit(".prediction.json")), "prediction_hash")
    out = with_hash(out, F.concat(note, F.lit(".ai-review.json")), "ai_review_hash")
    out = with_hash(out, F.concat(note, F.lit(".session.json")), "review_actions_hash")
    base = F.regexp_replace(F.regexp_extract(note, r"([^/]+)$", 1), r"\.[^.]*$", "")
    draft = F.array_contains(F.coalesce("warnings", F.array().cast("array<string>")), DRAFT_WARNING)
    return out.select(
        base.alias("sample_id"), "image_file", "annotation_file", "image_hash", "annotation_hash", "prediction_hash",
        "ai_review_hash", "review_actions_hash", (~draft).alias("reviewed"), F.lit(None).cast("string").alias("split"),
    )


def export_samples(manifest: DataFrame, human: DataFrame, prediction: DataFrame, ai_review: DataFrame, actions: DataFrame) -> DataFrame:
    """Reviewed samples with their four payloads side by side (each: sample_id, body)."""
    out = manifest.where("reviewed")
    for df, name in ((human, "human_final"), (prediction, "pipeline_prediction"), (ai_review, "ai_pre_review"), (actions, "review_actions")):
        how = "inner" if name == "human_final" else "left"
        out = out.join(df.select("sample_id", F.col("body").alias(name)), "sample_id", how)
    return out


def family_key(annotation_file: Column, sample_id: Column) -> Column:
    """First run of 12 digits in the file name, else the sample id."""
    stamp = F.regexp_extract(annotation_file, r"(\d{12})", 1)
    return F.when(stamp != "", stamp).otherwise(sample_id)


def hash_rank(keys: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """Exact 0-based rank of distinct keys ordered by ``md5(seed || key)``.

    Keys are split by the first four hex digits: a rank is the number of keys in smaller
    buckets (a table of at most 65 536 rows) plus the position inside the bucket, so no
    task ever sorts all keys."""
    hashed = keys.select(name).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(name)).cast("binary")))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, 4))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = hashed.withColumn("_k", F.row_number().over(W.partitionBy("_b").orderBy("_h", name)) - 1)
    return inside.join(F.broadcast(before), "_b").select(name, (F.col("_before") + F.col("_k")).alias("rank"))


def assign_splits(manifest: DataFrame, train: float = 0.7, validation: float = 0.15, seed: int = 0) -> DataFrame:
    """Whole families go to train / validation / test in seeded hash order; the counts
    are the rounded ratios of the number of families; a single family is train."""
    fam = manifest.select("sample_id", family_key(F.col("annotation_file"), F.col("sample_id")).alias("family"))
    ranks = hash_rank(fam, "family", seed)
    total = fam.agg(F.countDistinct("family").alias("_total"))
    cuts = total.select("_total", js_round(F.col("_total") * train).alias("_train"), js_round(F.col("_total") * validation).alias("_val"))
    rows = ranks.join(F.broadcast(cuts), F.lit(True))  # cuts is one row
    split = (
        F.when(F.col("_total") == 1, "train").when(F.col("rank") < F.col("_train"), "train")
        .when(F.col("rank") < F.col("_train") + F.col("_val"), "validation").otherwise("test")
    )
    return fam.join(rows.select("family", split.alias("split")), "family").select("sample_id", "family", "split")


def split_leakage(assigned: DataFrame) -> DataFrame:
    """Families in more than one split (at most three names per family are kept)."""
    seen = assigned.where(F.col("split").isNotNull()).select("family", "split").distinct()
    return seen.groupBy("family").agg(F.count(F.lit(1)).alias("n_splits")).where("n_splits > 1")


def baseline_from_predictions(pred: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A draft annotation that equals the prediction, the prediction, and their (empty)
    difference report."""
    draft = pred.withColumn("warning", F.lit(DRAFT_WARNING))
    return draft, pred, annotation_diff(pred, pred)


def type_frequency(elements: DataFrame, threshold: int = 30) -> DataFrame:
    counts = elements.where(F.col("type") != "page").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("meets_threshold", F.col("n") >= threshold)


def priority_queue(elements: DataFrame, frequency: DataFrame) -> DataFrame:
    """Images by the summed rarity (1 / count) of their under-represented types.

    The type table has one row per component type."""
    seen = elements.where(F.col("type") != "page").groupBy("image_id", "type").agg(F.count(F.lit(1)).alias("_c")).drop("_c")
    rare = frequency.where(~F.col("meets_threshold")).select("type", (1.0 / F.col("n")).alias("weight"))
    scored = seen.join(rare, "type").groupBy("image_id").agg(
        F.sum("weight").alias("s"), F.array_join(F.array_sort(F.collect_list("type")), ",").alias("types")
    )
    out = elements.select("image_id").distinct().join(scored, "image_id", "left")
    return out.select(
        "image_id", round_half_up(F.coalesce("s", F.lit(0.0)), 3).alias("score"), F.coalesce("types", F.lit("")).alias("types")
    )
