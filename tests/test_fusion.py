"""Fusion deals its candidates once, and its index finds the same boxes whether they are few or many."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from screenlake.operators import folds, fusion as U

CANDS = "image_id long, cand_id string, type string, x double, y double, w double, h double, score double, source string"


def test_candidates_are_dealt_once(spark):
    draw = random.Random(4)
    rows = [(i, f"c{n}", "a", float(draw.randrange(90)), float(draw.randrange(4000)), 60.0, 20.0, draw.random(), "cv") for i in (1, 2) for n in range(300)]
    # no place, no score
    rows += [(1, "n1", "a", 0.0, None, 5.0, 5.0, 0.5, "cv"), (1, "n2", "a", 0.0, 0.0, 60.0, 20.0, None, "cv")]
    df = spark.createDataFrame(rows, CANDS)
    for out in (U.fuse_candidates(df), U.dedupe_boxes(df.withColumn("ord", F.lit(1)), "type")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    parts = U._parts(df, ["image_id", "type"]).where("y IS NOT NULL").groupBy("image_id", "_part").agg(F.min("y").alias("lo"), F.max(F.col("y") + F.col("h")).alias("hi"))
    spans = sorted((r.image_id, r.lo, r.hi, r._part) for r in parts.collect())
    assert len(spans) > 10 and all(a[0] != b[0] or a[2] < b[1] and a[3] < b[3] for a, b in zip(spans, spans[1:]))
    kept = {(r.cand_id, r.image_id) for r in U.fuse_candidates(df, 0.5, None).collect()}
    want = set()
    for i in (1, 2):
        clusters = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (r[7] is not None, -(r[7] or 0), r[1])):
            if None in r or not any(folds.iou(c, r[3:7]) >= 0.5 for c in clusters):
                want.add((r[1], i))
                if None not in r:
                    clusters.append(r[3:7])
    assert kept == want


def test_index_of_few_and_many_boxes(monkeypatch):
    draw = random.Random(6)
    box = lambda: (draw.uniform(-50, 90), draw.uniform(0, 90), draw.choice([0.0, 8.0, draw.uniform(1, 60)]), draw.uniform(1, 60))
    few, many = folds.BoxIndex(0.3), folds.BoxIndex(0.3)
    few.FEW, many.FEW = 10**9, 0
    for n in range(400):
        probe = box()
        assert few.first(probe) == many.first(probe)
        few.put(n // 2, probe)
        many.put(n // 2, probe)
    assert few.cells is None and many.cells


def test_values_of_columns():
    for column in (pa.array([1, 2]), pa.array([1, None]), pa.array([0.5, float("inf")]), pa.array(["a", "é"]), pa.array(["a", None]), pa.array([True, False]), pa.array([{"a": 1}, None]), pa.array([], pa.string())):
        got = folds._values(column)
        assert got == column.to_pylist() and [type(v) for v in got] == [type(v) for v in column.to_pylist()]
