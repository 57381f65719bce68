"""The benchmark from annotations to means."""

from screenlake.operators import benchmark as B
from screenlake.sources import annotations as A

BOX = "x double, y double, w double, h double"


def test_benchmark_parses_annotations_once(spark):
    """What is read off the annotations comes from one table of them."""
    note = '{"image": "i", "imageSize": {"width": 9, "height": 9}, "platform": "a", "theme": "l", "language": "e", "dpi": "h", "elements": [{"id": "e", "type": "row", "bbox": {"x": 0, "y": 0, "w": 4, "h": 4}, "render": "n"}]}'
    notes = A.parse_annotations(spark.createDataFrame([(1, note), (2, "[broken"), (4, note)], "image_id long, json string"), "json")
    pred = spark.createDataFrame([(i, "q", "q", "row", 0.0, 0.0, 4.0, 4.0) for i in (1, 2, 3)], f"image_id long, ord string, box_id string, type string, {BOX}")
    meta = spark.createDataFrame([(i, 9, 9) for i in (1, 2, 3)], "image_id long, width int, height int")
    for chosen in (None, spark.createDataFrame([(1,), (2,), (3,), (3,)], "image_id long")):
        images, kinds = B.image_results(notes, pred, meta, chosen)
        got = {(r.image_id, r.gt_count, r.pred_count, r.matched, r.error, r.scored) for r in images.collect()}
        want = {(1, 1, 1, 1, None, True), (2, 0, 0, 0, "invalid: annotation root must be an object", False), (3, 0, 1, 0, None, True)}
        assert got == want | ({(4, 1, 0, 0, None, True)} if chosen is None else set())
        for df in (images, kinds):
            assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
