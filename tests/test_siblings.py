"""Sibling groups against plain first-fit models."""

import random

from pyspark.sql import functions as F

from screenlake.operators import layout as L

NODES = "image_id long, parent_id string, node_id string, ord long, type string, x double, y double, w double, h double"


def differ(a, b):
    return max(a, b) > 0 and abs(a - b) / max(a, b) > 0.15


def children(n, seed, kinds):
    r = random.Random(seed)
    return [(1, f"p{r.randrange(3)}", f"c{i:05d}", i, r.choice(kinds), 10.0 + r.randrange(4), 20.0 * i, float(r.choice([0, 20, 22, 24, 30, 33, 60, 66])), float(r.randrange(10, 60))) for i in range(n)]


def test_repeats_of_many_siblings(spark):
    rows = children(3000, 1, ["card", "button"])
    got = {r.target_id: (r.count_, r.template_id) for r in L.detect_repeats(spark.createDataFrame(rows, NODES)).withColumnRenamed("count", "count_").collect()}
    want = {}
    for p in {r[1] for r in rows}:
        cells = {}
        for r in (r for r in rows if r[1] == p and r[4] in L.REPEATABLE):
            key, order = (r[4], r[7], r[8]), (r[6], r[5], r[2])
            n, first = cells.get(key, (0, order))
            cells[key] = n + 1, min(first, order)
        groups = []
        for (kind, w, h), (n, first) in sorted(cells.items()):
            for g in groups:
                if g[0] == kind and not any(differ(a, b) for a, b in ((g[1], w), (g[2], w), (g[3], h), (g[4], h))):
                    g[1:6] = min(g[1], w), max(g[2], w), min(g[3], h), max(g[4], h), g[5] + n
                    break
            else:
                groups.append([kind, w, w, h, h, n, first[2]])
        best = max(groups, key=lambda g: g[5], default=None)
        if best and best[5] >= 2:
            want[p] = best[5], best[6]
    assert got == want


def test_lists_of_many_siblings(spark):
    rows = children(3000, 2, ["card", "row", "container", "text"])
    parents = [(1, None, f"p{k}", -1 - k, "container", 0.0, 0.0, 900.0, 900.0) for k in range(3)]
    out = L.promote_lists(spark.createDataFrame(rows + parents, NODES).repartition(3))
    got = {r.node_id: r.new_type for r in out.where(F.col("new_type") != F.col("type")).collect()}
    want = {}
    for p in {r[1] for r in rows}:
        seeds = []
        for r in sorted((r for r in rows if r[1] == p), key=lambda r: r[3]):
            for g in seeds:
                if g[0][4] == r[4] and not differ(g[0][7], r[7]) and not differ(g[0][8], r[8]):
                    g.append(r)
                    break
            else:
                seeds.append([r])
        fits = [g for g in seeds if len(g) >= 3 and g[0][4] in L.LIST_ITEMS]
        best = max(fits, key=len, default=None)
        if best is None:
            continue
        cx, cy = [r[5] + r[7] / 2 for r in best], [r[6] + r[8] / 2 for r in best]
        dx, dy, mw, mh = max(cx) - min(cx), max(cy) - min(cy), sum(r[7] for r in best) / len(best), sum(r[8] for r in best) / len(best)
        if dx < mw * 0.5 and (not dy < mh * 0.5 or dx <= dy):
            want |= {r[2]: "listItem" for r in best} | {p: "list"}
    assert got == {k: v for k, v in want.items()} and got
