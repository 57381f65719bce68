"""Queries that deal their inputs by image: no shuffle of theirs is by more than the image."""

import random
import re

import pytest
from pyspark.sql import functions as F

from screenlake.operators import documents as D, lines as L, review as R, spatial as S
from screenlake.session import ALL_KEYS, cut_lineage
from screenlake.sources import fixtures

BOX = "x double, y double, w double, h double"


@pytest.fixture
def shuffled(spark, monkeypatch):
    """The keys of all shuffles of the tables that an operator writes."""
    keys = []

    def spy(df, dealt=False):
        settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", ALL_KEYS: str(not dealt).lower()}
        before = {k: spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        keys.extend(re.sub(r"#\d+L?", "", k) for k in re.findall(r"(?<!Reused)Exchange hashpartitioning\((.*?), \d+\)", plan))
        return cut_lineage(df, dealt)

    for module in (S, R, fixtures):
        monkeypatch.setattr(module, "cut_lineage", spy)
    return keys


def test_nearest_downstream(spark, shuffled):
    nodes = spark.createDataFrame([(1, "a", 0.0, 0.0, 2.0, 2.0), (1, "b", 0.0, 40.0, 2.0, 2.0), (1, "c", 0.0, 900.0, 2.0, 2.0), (2, "a", 5.0, 5.0, 1.0, 1.0)], f"image_id long, ord string, {BOX}")
    directions = spark.createDataFrame([(1, "top-down"), (2, "top-down")], "image_id long, direction string")
    got = {(r.image_id, r.src, r.dst, r.dist) for r in S.nearest_downstream(nodes, directions).collect()}
    assert got == {(1, "a", "b", 40.0), (1, "b", "c", 860.0)}
    assert set(shuffled) == {"image_id"}


def test_nodes_of_one_id_have_one_nearest(spark):
    """Two places of ``a``: the nearer of their hits counts, whatever the ring of the other."""
    nodes = spark.createDataFrame([(1, "a", 0.0, 0.0, 2.0, 2.0), (1, "a", 0.0, 35.0, 2.0, 2.0), (1, "b", 0.0, 60.0, 2.0, 2.0)], f"image_id long, ord string, {BOX}")
    directions = spark.createDataFrame([(1, "top-down")], "image_id long, direction string")
    assert [(r.src, r.dst, r.dist) for r in S.nearest_downstream(nodes, directions).collect()] == [("a", "b", 25.0)]


def test_project_evidence(spark, shuffled):
    nodes = spark.createDataFrame([(1, "n", "row", 0.0, 0.0, 10.0, 10.0)], f"image_id long, node_id string, type string, {BOX}")
    cands = spark.createDataFrame([(1, "c1", "row", 0.0, 0.0, 10.0, 5.0), (1, "c2", "card", 0.0, 0.0, 10.0, 10.0), (1, "c3", "row", 50.0, 0.0, 10.0, 10.0)], f"image_id long, cand_id string, type string, {BOX}")
    assert {(r.cand_id, r.iou, r.rank) for r in S.project_evidence(nodes, cands).collect()} == {("c1", 0.5, 1), ("c2", 1.0, 2)}
    assert shuffled and set(shuffled) == {"image_id"}


def test_normalize_tree(spark, shuffled):
    elements = spark.createDataFrame([(1, "p", 0.0, 0.0, 50.0, 50.0), (1, "q", 0.0, 0.0, 20.0, 20.0), (1, "c", 1.0, 1.0, 5.0, 5.0)], f"image_id long, element_id string, {BOX}")
    relations = spark.createDataFrame([(1, 1, "p", "c", "contains", "human", None), (1, 2, "z", "c", "contains", "human", None)], "image_id long, ord long, src string, dst string, type string, source string, review_status string")
    got = {(r.element_id, r.parent_id, r.source) for r in R.normalize_tree(elements, relations).collect()}
    assert got == {("q", "p", "derived"), ("c", "p", "human")}
    assert shuffled and set(shuffled) == {"image_id"}


def test_validate_annotations(spark, shuffled):
    """Ends are looked up by image; ids, roots and boxes are judged in one pass, also with null ids and sizes given twice."""
    elements = spark.createDataFrame([
        (1, "a", "page", 0.0, 0.0, 50.0, 50.0), (1, "a", "page", 0.0, 0.0, 90.0, 50.0), (1, "b", "page", 0.0, float("nan"), 1.0, 1.0),
        (1, None, "row", 0.0, 0.0, 0.0, 1.0), (1, None, "row", 0.0, 0.0, 1.0, 1.0), (2, "a", None, 0.0, 0.0, 5.0, 5.0),
    ], f"image_id long, element_id string, type string, {BOX}")
    relations = spark.createDataFrame([
        (1, "a", "b", "contains"), (1, "b", "a", "contains"), (1, "a", "b", "contains"), (1, "x", "y", "flow"), (2, "a", "z", "contains"), (2, None, "a", "flow"),
    ], "image_id long, src string, dst string, type string")
    children = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "a", None)], "image_id long, parent_id string, child_id string")
    meta = spark.createDataFrame([(1, 80, 80), (1, 80, 80)], "image_id long, width int, height int")
    got = sorted((tuple(r) for r in R.validate_annotations(elements, relations, children, meta).collect()), key=str)
    assert got == sorted([
        (1, "duplicate-id", "a", None), (1, "duplicate-id", None, None), (1, "multiple-page-roots", None, None), *2 * [(1, "bbox-out-of-bounds", "a", None)],
        *2 * [(1, "bbox-invalid", "b", None)], *2 * [(1, "bbox-invalid-size", None, None)], (1, "relation-endpoint-missing", None, "x"),
        (2, "relation-endpoint-missing", None, "z"), (2, "relation-endpoint-missing", None, None), (1, "multiple-parents", "b", None), (1, "containment-cycle", None, None),
        (1, "contains-not-in-children", "b", "a"), (2, "contains-not-in-children", "a", "z"), (2, "child-not-in-contains", "a", None),
    ], key=str)
    # the ends, and the first edges of the search for cycles
    assert set(shuffled[:2]) == {"image_id"}


def test_view_of_nodes(spark, shuffled, monkeypatch):
    """``promote_badge``, ``distribution``, ``overlay_geometry`` and ``export_with`` cost little beside it."""
    monkeypatch.setattr(fixtures, "_written", {})
    assert fixtures.view(spark, "/root/testdata/sf0.001", "nodes").count() == fixtures.view(spark, "/root/testdata/sf0.001", "boxes").count()
    assert shuffled and set(shuffled) == {"image_id"}


def test_key_content(spark):
    """Items of a region are dealt once for its lines and once for what is read off them; data rows are those of ``reconstruct_table``."""
    draw = random.Random(3)
    words = ["Tea", "Cup", "(元)", "12", "¥", "12.5", "City: Rome", "Zip：1", "hello world", "Hello, world", "", " ", "x-1"]
    items = [(i % 3, f"{n:03d}", draw.choice(words), float(draw.randrange(0, 300, 20)), float(draw.randrange(0, 200, 8)), 18.0, 10.0) for i in range(3) for n in range(80)]
    regions = [(i, f"r{n}", float(draw.randrange(0, 200)), float(draw.randrange(0, 150)), 130.0, 70.0, 0.5) for i in range(3) for n in range(25)]
    items = spark.createDataFrame(items, f"image_id long, ord string, text string, {BOX}")
    regions = spark.createDataFrame(regions, f"image_id long, region_id string, {BOX}, confidence double")
    got = D.key_content(items, regions)
    keys = ["image_id", "region_id"]
    inside = S.items_in_region(items, regions.drop("confidence")).select("image_id", F.col("b_region_id").alias("region_id"), *(F.col("a_" + c).alias(c) for c in ("ord", "text", "x", "y", "w", "h")))
    table = D.reconstruct_table(inside, keys).groupBy(*keys).agg(F.countDistinct("row").alias("n"))
    want = {(r.image_id, r.region_id, r.n) for r in table.collect()}
    assert want and {(r.image_id, r.region_id, r.n_rows) for r in got.where("n_rows > 0").collect()} == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # items and regions to their tiles, pairs to their regions, lines to theirs, and the ranked regions to the result
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)) <= 6 and plan.count("MapInArrow") == 1


def test_lines_of_equal_centres(spark):
    """Centres that come more than once are added to the mean of a line together; NaN and null as before."""
    nan = float("nan")
    rows = [(1, f"{n}", 0.0, y, 4.0, 10.0) for n, y in enumerate([0.1, 0.1, 0.1, 9.0, 9.0, 25.0, nan, nan, None, 14.0])]
    got = {r.ord: r.line for r in L.group_lines_fold(spark.createDataFrame(rows, f"image_id long, ord string, {BOX}")).collect()}
    # the first line has its mean at 8.66, more than 10 from 19; 30 is more than 10 from that
    assert got == {"0": 0, "1": 0, "2": 0, "3": 0, "4": 0, "9": 1, "5": 2, "6": 3, "7": 3}


def test_sibling_size_of_dealt_tables(spark, shuffled):
    """Elements and children are dealt by image once, and not at all if their tables are; their medians take no join."""
    elements = spark.createDataFrame([(i, f"c{n}", "row", 0.0, 0.0, w, 10.0) for i in (1, 2) for n, w in enumerate([10.0, 10.0, 30.0])] + [(1, "z", None, 0.0, 0.0, 90.0, 90.0)], f"image_id long, element_id string, type string, {BOX}")
    children = spark.createDataFrame([(i, "p", f"c{n}") for i in (1, 2) for n in range(3)] + [(1, "p", "z"), (2, None, "c0")], "image_id long, parent_id string, child_id string")
    got = R.rule_sibling_size(elements, children)
    assert sorted((r.image_id, r.element_id, r.evidence_pct) for r in got.collect()) == [(1, "c2", 200), (2, "c2", 200)]
    assert shuffled and set(shuffled) == {"image_id"}
    shuffled.clear()
    tables = [cut_lineage(df.repartition("image_id"), dealt=True) for df in (elements, children)]
    assert R.rule_sibling_size(*tables, dealt=True).count() == 2 and shuffled == []


def test_findings_and_review_of_dealt_tables(spark, shuffled):
    """From the given tables to the decisions, inputs that are dealt by image are not shuffled again."""
    elements = spark.createDataFrame([
        (i, e, n, kind, text, x, 0.0, w, 10.0) for i in (1, 2)
        for n, (e, kind, text, x, w) in enumerate([("p", "page", None, 0.0, 100.0), ("a", "text", "a longer text", 0.0, 10.0), ("b", "text", "x", 20.0, 10.0), ("c", "card", None, 40.0, 30.0), ("d", "row", None, 0.0, 10.0), ("e", "row", None, 1.0, 10.0)])
    ], f"image_id long, element_id string, ord int, type string, text string, {BOX}")
    # a: the last relation is of the page; b: the last known one is of the card; c is no content
    relations = spark.createDataFrame([
        (1, 1, "c", "a", "contains"), (1, 2, "p", "a", "contains"), (1, 1, "p", "b", "contains"), (1, 2, "c", "b", "contains"), (1, 3, "zz", "b", "contains"), (1, 9, "p", "b", "flow"), (1, 1, "p", "c", "contains"),
    ], "image_id long, ord int, src string, dst string, type string")
    # 2: the list of the page comes before that of the card; a relation of 1 goes before its list
    children = spark.createDataFrame([(1, "c", "a"), (2, "c", "a"), (2, "p", "a"), (2, "c", "d"), (2, "c", "e")], "image_id long, parent_id string, child_id string")
    actions = spark.createDataFrame([(2, "2:isolated-content:a:0,0,10,10:text")], "image_id long, signature string")
    tables = [cut_lineage(df.repartition("image_id"), dealt=True) for df in (elements, relations, children, actions)]
    for dealt, (el, rel, kids, acts) in ((False, (elements, relations, children, actions)), (True, tables)):
        shuffled.clear()
        found = R.structure_findings(el, rel, kids, dealt=dealt)
        got = sorted((r.image_id, r.code, r.element_id, r.parent_id, r.evidence_pct) for r in found.collect())
        assert got == [(1, "isolated-content", "a", "p", 0), (2, "isolated-content", "a", "p", 0), (2, "sibling-overlap", "d", "c", 82)]
        review = R.auto_review(found, el, acts, dealt=dealt)
        assert sorted((r.image_id, r.code, r.action) for r in review.collect()) == [(1, "isolated-content", "confirmed"), (2, "sibling-overlap", "confirmed")]
        assert set(shuffled) == (set() if dealt else {"image_id"})


def test_field_labels(spark, shuffled):
    """Texts and sizes of images are dealt by image once, and not at all if their tables are."""
    texts = spark.createDataFrame([
        (i, p, n, text, x, y, 30.0, 10.0) for i in (1, 2)
        for p, n, text, x, y in [("p", "label", "Name", 10.0, 50.0), ("p", "value", "a value of some length", 60.0, 52.0), ("p", "far", "Far", 10.0, 90.0), ("q", "other", "Other", 10.0, 50.0), ("p", "top", "Top", 10.0, 3.0), ("p", "title", "Title", 50.0, 3.0)]
    ], f"image_id long, parent_id string, node_id string, text string, {BOX}")
    meta = spark.createDataFrame([(1, 200, 100), (2, 90, 100)], "image_id long, width int, height int")
    tables = [cut_lineage(df.repartition("image_id"), dealt=True) for df in (texts, meta)]
    for dealt, inputs in ((False, (texts, meta)), (True, tables)):
        shuffled.clear()
        assert [tuple(r) for r in S.field_labels(*inputs, dealt=dealt).collect()] == [(1, "label")]
        assert set(shuffled) == (set() if dealt else {"image_id"})
