"""Near-duplicate vectors by counting collisions of projections.

Vectors are projected on many random directions and the values are sorted.  Two vectors collide
on a direction if one lies in the window around the other.  Pairs are counted by their
collisions, and pairs with enough of them are verified by their cosine in double precision.

A window alone holds a constant share of all pairs, which grows with the square of the input, so
each window is confined to the vectors that agree in the signs of some further projections; their
number grows with the logarithm of the input.  The number of windows and the count that a pair
needs are set so that a pair exactly at the threshold passes with probability ``recall``.

Equal vectors are compared once.  Defined cases: vectors that are null, empty, zero or hold null
or non-finite components link with nothing, and vectors of different length don't link; rows
with a null id count as partners but are in no component id other than as null; repeated rows
link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm import graph
from screenlake.llm.arrow import parts
from screenlake.session import cut_lineage

#: Vectors that share the signs of a window on average; windows in standard deviations of a pair
#: at the threshold; collisions that a pair needs; chance that a pair at the threshold has them.
PER_CELL, WIDTH, NEEDED, RECALL = 64, 1.5, 2, 0.975


def calibrated(n: int, threshold: float, recall: float = RECALL, needed: int = NEEDED) -> tuple[int, int, float]:
    """(sign bits, number of windows, half width) for ``n`` vectors."""
    bits = max(0, round(math.log2(max(1, n) / PER_CELL)))
    half = WIDTH * math.sqrt(2 - 2 * threshold)
    p = (1 - math.acos(threshold) / math.pi) ** bits * math.erf(WIDTH / math.sqrt(2))
    windows = needed
    while sum(math.comb(windows, k) * p**k * (1 - p) ** (windows - k) for k in range(needed)) > 1 - recall:
        windows += 1
    return bits, windows, half


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, in double precision."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _windows(vectors: DataFrame, bits: int, windows: int, half: float) -> DataFrame:
    """(w, signs, cell, v, id): each vector's place in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in parts(batches, 1024):
            lengths = np.asarray(batch.column(1).value_lengths())
            for d in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == d))
                if d not in directions:
                    directions[d] = np.random.default_rng([d, 11]).standard_normal((d, windows * (bits + 1)))
                x = _matrix(some.column(1))
                x /= np.abs(x).max(1, keepdims=True)
                p = (x / np.linalg.norm(x, axis=1, keepdims=True) @ directions[d]).reshape(len(x), windows, bits + 1)
                signs = ((p[:, :, :bits] > 0) * (1 << np.arange(bits, dtype=np.int64))).sum(2, dtype=np.int64)
                v = p[:, :, bits]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(windows, dtype=np.int32), len(x))),
                        pa.array((signs ^ (d << 40)).ravel()),
                        pa.array(np.floor(v / half).astype(np.int64).ravel()),
                        pa.array(v.ravel()),
                        pa.array(np.repeat(np.asarray(some.column(0)), windows)),
                    ],
                    names=["w", "signs", "cell", "v", "id"],
                )

    return vectors.mapInArrow(run, "w int, signs long, cell long, v double, id long")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            lengths = np.asarray(batch.column(2).value_lengths())
            for d in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == d))
                x, y = _matrix(some.column(2)), _matrix(some.column(3))
                # scaled, so that squares of large or small components stay finite
                x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                cosine = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                yield some.select(["a", "b"]).filter(pa.array(cosine >= threshold))

    return pairs.mapInArrow(run, "a long, b long")


def linked_pairs(vectors: DataFrame, threshold: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(a, b), a < b, of ``vectors(id, embedding)``: distinct valid vectors with distinct ids."""
    bits, windows, half = calibrated(vectors.count(), threshold, recall)
    rows = cut_lineage(_windows(vectors, bits, windows, half))
    near = rows.select("w", "signs", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"), F.col("cell").alias("own"), F.col("v").alias("v2"), F.col("id").alias("id2"))
    met = rows.join(near, ["w", "signs", "cell"]).where((F.abs(F.col("v") - F.col("v2")) <= half) & ((F.col("own") < F.col("cell")) | (F.col("id") < F.col("id2"))))
    counted = met.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).count().where(F.col("count") >= NEEDED)
    left, right = vectors.select(F.col("id").alias("a"), F.col("embedding").alias("x")), vectors.select(F.col("id").alias("b"), F.col("embedding").alias("y"))
    pairs = counted.select("a", "b").join(left, "a").join(right, "b").where(F.size("x") == F.size("y"))
    return _verified(pairs.select("a", "b", "x", "y"), threshold)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``vectors`` without the embedding, with ``n_links``, ``component_id`` and ``kept``."""
    e = F.col(embedding)
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    valid = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("bigint").alias("vec"), e.alias("embedding"))
    # equal vectors: one stands for all; nulls among the ids only count
    classes = cut_lineage(valid.groupBy("embedding").agg(F.min("vec").alias("first"), F.count("*").alias("n")).withColumn("id", F.coalesce("first", F.xxhash64("embedding"))))
    pairs = cut_lineage(linked_pairs(classes.select("id", "embedding"), threshold, recall))
    sizes = classes.select(F.col("id").alias("b"), "n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    roots = graph.components(pairs).withColumnRenamed("node", "id")
    rooted = classes.join(others, "id", "left").join(roots, "id", "left").select(
        "embedding", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(smallest, "root").select(F.col("embedding").alias("__e"), F.col("n_links").alias("__links"), F.col("component_id").alias("__component"))
    kept = [c for c in vectors.columns if c not in (embedding, "n_links", "component_id", "kept")]
    asked = vectors.withColumn("__key", F.when(F.coalesce(usable, F.lit(False)), e))
    component = F.coalesce("__component", F.col(vec_id).cast("bigint"))
    return asked.join(found, F.col("__key") == F.col("__e"), "left").select(
        *[F.col(f"`{c}`") for c in kept], F.coalesce("__links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(vec_id) == component, F.lit(False)).alias("kept")
    )
