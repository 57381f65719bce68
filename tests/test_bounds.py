"""Sums of doubles that lie on a bound: the order of the rows must not decide."""

import itertools

from pyspark.sql import functions as F

from screenlake.operators import layout as Y, spatial as S


def test_ocr_mean_on_a_half_rounds_up_in_any_order(spark):
    values = [0.6, 0.7, 0.8, 0.92]  # the mean less 0.05 is 0.705
    for image, order in enumerate(itertools.permutations(values)):
        items = spark.createDataFrame([(image, c) for c in order], "image_id long, confidence double").coalesce(1)
        meta = spark.createDataFrame([(image, 420, "low")], "image_id long, width int, complexity string")
        assert Y.ocr_quality(items, meta).head().ocr_confidence == 0.71


def test_ocr_mean_on_the_bound_is_not_low(spark):
    items = spark.createDataFrame([(1, c) for c in (0.3, 0.6, 0.45)], "image_id long, confidence double").coalesce(1)
    meta = spark.createDataFrame([(1, 420, "low")], "image_id long, width int, complexity string")
    assert [r.issues for r in Y.ocr_quality(items, meta).select(F.col("issues")).collect()] == [""]


def test_text_share_on_the_bound_is_vetoed_in_any_order(spark):
    """Strips of 87, 52, 30 and 31 of a height of 1000: 0.2 in all."""
    cands = spark.createDataFrame([(1, "c", 0.0, 0.0, 100.0, 1000.0)], "image_id long, cand_id string, x double, y double, w double, h double")
    for order in itertools.permutations([(0, 87), (100, 52), (200, 30), (300, 31)]):
        # facts are widened by 2 on every side
        facts = [(1, "t", 0.95, 2.0, y + 2.0, 96.0, h - 4.0) for y, h in order]
        ocr = spark.createDataFrame(facts, "image_id long, text string, confidence double, x double, y double, w double, h double").coalesce(1)
        assert S.text_veto(cands, ocr).count() == 0
