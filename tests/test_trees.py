"""Walks over trees: few tables are written whatever the depth, and deep trees and cycles come out right."""

import os

from screenlake.operators import review as R, typing_rules as T
from screenlake.session import shared_folder
from screenlake.sources import annotations as A

SHAPE = "image_id long, node_id string, parent_id string, x double, y double, w double, h double, type string, role string, separable boolean"


def written(spark):
    folder = shared_folder(spark)
    return {f for f in os.listdir(folder) if f.startswith("round-")}


def chain(spark, depth, out=None, banners=(), cycle=False):
    """Node 0 is the root, node i hangs under i - 1; node ``out`` lies off the page."""
    rows = [(1, str(i), str(i - 1) if i else None, 900.0 if i == out else 0.0, 0.0, 10.0, 10.0, "row", "banner" if i in banners else None, False) for i in range(depth)]
    if cycle:
        rows += [(1, "c1", "c2", 0.0, 0.0, 1.0, 1.0, "row", "banner", False), (1, "c2", "c1", 0.0, 0.0, 1.0, 1.0, "row", "banner", False), (1, "lost", "nowhere", 0.0, 0.0, 1.0, 1.0, "row", None, False)]
    return spark.createDataFrame(rows, SHAPE)


def meta(spark):
    return spark.createDataFrame([(1, 420, 820)], "image_id long, width int, height int")


def test_pruned_levels_are_not_written_one_by_one(spark):
    before = written(spark)
    kept = T.prune_outside(chain(spark, 6, out=1), meta(spark))
    assert [r.node_id for r in kept.collect()] == ["0"]
    assert len(written(spark) - before) == 1


def test_pruning_below_many_levels_and_beside_a_cycle(spark):
    kept = {r.node_id for r in T.prune_outside(chain(spark, 30, out=2, cycle=True), meta(spark)).collect()}
    assert kept == {"0", "1", "c1", "c2", "lost"}


def test_depths_of_a_flat_tree_are_one_table(spark):
    before = written(spark)
    assert {r.node_id: r.depth for r in R.tree_depths(chain(spark, 5)).collect()} == {str(i): i for i in range(5)}
    assert len(written(spark) - before) == 1


def test_depths_of_a_deep_tree_leave_cycles_out(spark):
    got = {r.node_id: (r.depth, r.w) for r in R.tree_depths(chain(spark, 30, cycle=True), ["w"]).collect()}
    assert got == {str(i): (i, 10.0) for i in range(30)}


def test_runs_of_banners(spark):
    runs = lambda n: {r.node_id: r.render_mode for r in T.render_modes(chain(spark, n, banners=range(1, n), cycle=True)).collect()}
    want = lambda n: {"0": "native"} | {str(i): "asset" if i % 2 else "semantic-only" for i in range(1, n)} | {"c1": "asset", "c2": "asset", "lost": "native"}
    assert runs(5) == want(5)
    assert runs(30) == want(30)
    before = written(spark)
    assert T.render_modes(chain(spark, 5, banners=range(1, 5))).count() == 5
    assert len(written(spark) - before) == 1


def test_a_round_opens_several_levels(spark):
    tree = '{"id":"p","type":"page","children":[{"id":"a","type":"row","children":[{"id":"b","type":"row","children":[{"id":"c","type":"text"},null]}]}]}'
    before = written(spark)
    got = A.flatten_tree(spark.createDataFrame([(1, tree)], "k long, tree string"), "k", "tree").select("node_id", "parent_id", "depth")
    assert {tuple(r) for r in got.collect()} == {("a", "p", 1), ("b", "a", 2), ("c", "b", 3), (None, "b", 3)}
    assert len(written(spark) - before) == 1
