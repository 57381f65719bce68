"""One-to-one matching: literal cases, and folds against a plain model."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from screenlake.operators import fusion as U, matching as M, spatial as S

COLS = "image_id long, ord string, box_id string, type string, x double, y double, w double, h double"


def iou(a, b):
    iw = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
    ih = max(0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]))
    union = a[6] * a[7] + b[6] * b[7] - iw * ih
    return iw * ih / union if union > 0 else 0


def crowd(seed, prefix, n=48):
    """Few images, many near-copies: long conflict chains."""
    rng = random.Random(seed)
    return [
        (rng.randrange(2), f"{i:04d}", f"{prefix}{i:04d}", rng.choice("ab"), 10.0 * rng.randrange(4) + rng.randrange(3), 10.0 * rng.randrange(3) + rng.randrange(3),
         20.0 + rng.randrange(3), 20.0 + rng.randrange(3))
        for i in range(n)
    ]


def model_gt(gt, pred, t=0.5):
    out, used = set(), set()
    for g in sorted(gt, key=lambda r: r[1]):
        best, who = 0, None
        for p in sorted(pred, key=lambda r: r[1]):
            if p[0] == g[0] and p[3] == g[3] and p[2] not in used:
                v = iou(g, p)
                if v >= t and v > best:
                    best, who = v, p[2]
        if who:
            used.add(who)
            out.add((g[2], who))
    return out


def model_global(pred, human, t=0.5):
    edges = sorted((-iou(p, h), p[2], h[2]) for p in pred for h in human if p[0] == h[0] and iou(p, h) >= t)
    up, uh, out = set(), set(), set()
    for _, p, h in edges:
        if p not in up and h not in uh:
            up.add(p), uh.add(h), out.add((p, h))
    return out


def test_literal_best_overlap_wins(spark):
    gt = spark.createDataFrame([(1, "0", "g", "button", 0.0, 0.0, 10.0, 10.0)], COLS)
    pred = spark.createDataFrame(
        [(1, "0", "far", "button", 4.0, 0.0, 10.0, 10.0), (1, "1", "near", "button", 1.0, 0.0, 10.0, 10.0), (1, "2", "other", "icon", 0.0, 0.0, 10.0, 10.0)], COLS
    )
    rows = M.match_greedy_gt(gt, pred).collect()
    assert [(r.gt_id, r.pred_id) for r in rows] == [("g", "near")]


def test_in_order_matching(spark):
    gt, pred = crowd(1, "g"), crowd(2, "p")
    a, b = spark.createDataFrame(gt, COLS), spark.createDataFrame(pred, COLS)
    want = model_gt(gt, pred)
    assert {(r.gt_id, r.pred_id) for r in M.match_greedy_gt(a, b).collect()} == want


def test_global_matching(spark):
    pred, human = crowd(3, "p"), crowd(4, "h")
    a, b = spark.createDataFrame(pred, COLS), spark.createDataFrame(human, COLS)
    want = model_global(pred, human)
    assert {(r.pred_id, r.human_id) for r in M.match_greedy_global(a, b).collect()} == want


def test_tile_join_finds_every_pair_once(spark):
    rows = crowd(5, "b", 60) + [(0, "x", "big", "a", -50.0, -20.0, 900.0, 700.0)]
    df = spark.createDataFrame(rows, COLS)
    for tile in (8.0, 128.0):
        got = [(r.a_box_id, r.b_box_id) for r in S.touching_pairs(df, df, tile=tile).select("a_box_id", "b_box_id").collect()]
        want = {
            (a[2], b[2]) for a in rows for b in rows
            if a[0] == b[0] and min(a[4] + a[6], b[4] + b[6]) >= max(a[4], b[4]) and min(a[5] + a[7], b[5] + b[7]) >= max(a[5], b[5])
        }
        assert len(got) == len(set(got)) and set(got) == want


def fused_model(rows, t=0.5, wbf=0.7):
    out = []
    for key in {(r[0], r[3]) for r in rows}:
        clusters = []
        for r in sorted((r for r in rows if (r[0], r[3]) == key), key=lambda r: (-r[8], r[2])):
            for c in clusters:
                v = iou(c, r)
                if v >= t:
                    if v >= wbf:
                        total = c[8] + r[8]
                        c[9] = r[9] if r[8] > c[8] else c[9]
                        for i in (4, 5, 6, 7):
                            c[i] = c[i] * (c[8] / total) + r[i] * (r[8] / total)
                        c[8] = total / 2
                    break
            else:
                clusters.append(list(r))
        out += [(c[2], round(c[4], 6), round(c[8], 6), c[9] or "") for c in clusters]
    return sorted(out)


def test_fusion(spark):
    rng = random.Random(9)
    rows = [(*r, rng.randrange(30, 99) / 100, rng.choice(["one", "two", None])) for r in crowd(6, "c", 300)]
    df = spark.createDataFrame([(r[0], r[2], r[3], *r[4:8], r[8], "cv", r[9]) for r in rows], "image_id long, cand_id string, type string, x double, y double, w double, h double, score double, source string, text string")
    got = sorted((r.cand_id, round(r.x, 6), round(r.score, 6), r.text or "") for r in U.fuse_candidates(df).collect())
    assert got == fused_model(rows)


def page(n, seed, side=44):
    """One image with ``n`` boxes in overlapping runs, so that hardly any gap cuts it."""
    rng = random.Random(seed)
    wide = int(n**0.5)
    return [(7, i, f"{i:07d}", "a", (i % wide) * 24.0 + rng.randrange(14), (i // wide) * 24.0 + rng.randrange(14), float(side + rng.randrange(3)), float(side + rng.randrange(3)), rng.randrange(1, 99) / 100) for i in range(n)]


PAGE = "image_id long, ord long, box_id string, type string, x double, y double, w double, h double, score double"


@pytest.fixture
def compiled(spark):
    """Code generation on, as users run it."""
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_image_of_many_boxes(compiled):
    """200 000 boxes of one image and type against one-pass models with a plain grid."""
    from screenlake.operators import lines as L

    spark, rows = compiled, page(200_000, 1)
    df = spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE.split(", ")]), PAGE).repartition(8).cache()

    def neighbours(boxes):
        cells = {}
        for i, r in enumerate(boxes):
            cells.setdefault((r[4] // 48, r[5] // 48), []).append(i)
        return lambda r: (j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((r[4] // 48 + dx, r[5] // 48 + dy), ()))

    # de-duplication: the holder of a slot moves to the better box
    got = U.dedupe_boxes(df, "type", 0.5)
    assert got.agg(F.count("*"), F.sum("slot"), F.sum("ord")).head() == deduped(rows, 0.5)
    fused = U.fuse_candidates(df.withColumnRenamed("box_id", "cand_id").withColumn("source", F.lit("cv")), 0.5, None)
    near, kept = neighbours(rows), set()
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][8], rows[i][2])):
        if not any(j in kept and iou(rows[j], rows[i]) >= 0.5 for j in near(rows[i])):
            kept.add(i)
    assert fused.agg(F.count("*"), F.sum(F.col("cand_id").cast("long"))).head() == (len(kept), sum(kept))
    shifted = [(*r[:4], r[4] + 9, r[5], *r[6:]) for r in rows]
    near, want, used_h = neighbours(shifted), [], set()
    edges = sorted((-iou(r, shifted[j]), r[2], shifted[j][2]) for r in rows for j in near(r) if iou(r, shifted[j]) >= 0.5)
    used_p = set()
    for _, p, h in edges:
        if p not in used_p and h not in used_h:
            used_p.add(p), used_h.add(h), want.append((int(p), int(h)))
    met = M.match_greedy_global(df, df.withColumn("x", F.col("x") + 9))
    assert met.agg(F.count("*"), F.sum(F.col("pred_id").cast("long") * F.col("human_id").cast("long"))).head() == (len(want), sum(p * h for p, h in want))
    centres, opened, live, tol = {}, 0, None, max(10, 0.6 * sorted(r[7] for r in rows)[len(rows) // 2])
    for r in rows:
        centres[r[5] + r[7] / 2] = centres.get(r[5] + r[7] / 2, 0) + 1
    for y, n in sorted(centres.items()):
        if live is not None and abs(live[0] - y) <= tol:
            live = ((live[0] * live[1] + y * n) / (live[1] + n), live[1] + n)
        else:
            live, opened = (y, n), opened + 1
    assert L.group_lines_fold(df).agg(F.count("*"), F.max("line")).head() == (len(rows), opened - 1)


def deduped(rows, limit):
    """(count, sum of slots, sum of kept ords)"""
    slots, at = [], {}
    for r in rows:
        cell = (r[4] // 48, r[5] // 48)
        hit = min((k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in at.get((cell[0] + dx, cell[1] + dy), ()) if iou(slots[k][1], r) >= limit), default=None)
        if hit is None:
            at.setdefault(cell, set()).add(len(slots))
            slots.append((r[1], r))
        elif r[8] > slots[hit][1][8]:
            old = slots[hit][1]
            at[old[4] // 48, old[5] // 48].discard(hit)
            at.setdefault(cell, set()).add(hit)
            slots[hit] = (slots[hit][0], r)
    return len(slots), sum(s for s, _ in slots), sum(r[1] for _, r in slots)


def test_fusion_of_repeated_ids_goes_by_place(spark):
    """Of two rows with one id and score the left one is first, however they are dealt."""
    rows = [(1, "c1", "a", 10.0 * i, 0.0, 100.0, 50.0, 0.5, "cv") for i in (3, 0, 6)]
    df = lambda r: spark.createDataFrame(r, "image_id long, cand_id string, type string, x double, y double, w double, h double, score double, source string")
    for order in ([0, 1, 2], [1, 0, 2], [2, 1, 0]):
        got = U.fuse_candidates(df([rows[i] for i in order]).coalesce(1), 0.5, None).collect()
        assert [(r.x, r.members) for r in got] == [(0.0, 1), (60.0, 1)]


def test_seeds_are_settled_in_one_pass(spark, monkeypatch):
    """A chain in which every box clashes with the one before it: every third stays, in one pass whatever its length."""
    from screenlake import session

    written, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df, dealt=False: written.append(dealt) or cut(df, dealt))
    chain = [(i, f"s{k:03d}", True, 10.0 * k, 0.0, 100.0 + 0.001 * k, 20.0) for i in (1, 2) for k in range(24)]
    seeds = spark.createDataFrame(chain, "image_id long, cand_id string, anchored boolean, x double, y double, w double, h double")
    assert sorted((r.image_id, r.cand_id) for r in U.dedupe_seeds(seeds).collect()) == [(i, f"s{k:03d}") for i in (1, 2) for k in range(0, 24, 3)]
    assert written == [True]


def test_text_is_bound_where_its_image_lies(spark, monkeypatch):
    """Items and nodes are shuffled by image only; no join or minimum of the binding has a second key."""
    plans, cut = [], S.cut_lineage

    def watch(df, dealt=False):
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false" if dealt else "true")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        return cut(df, dealt)

    monkeypatch.setattr(S, "cut_lineage", watch)
    nodes = spark.createDataFrame([(1, "b", 1, "control", None, 0.0, 0.0, 50.0, 20.0), (1, "r", 2, "region", None, 0.0, 0.0, 200.0, 200.0)], "image_id long, node_id string, ord long, kind string, text string, x double, y double, w double, h double")
    ocr = spark.createDataFrame([(1, "1", "Save", 5.0, 5.0, 20.0, 10.0), (1, "2", "note", 100.0, 100.0, 20.0, 10.0)], "image_id long, ord string, text string, x double, y double, w double, h double")
    assert sorted((r.ord, r.action, r.target_id) for r in S.bind_text(nodes, ocr).collect()) == [("1", "control-text", "b"), ("2", "text-child", "r")]
    dealt = [line.split("hashpartitioning(")[1].split(")")[0].split(", ")[:-1] for plan in plans for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and all(len(keys) == 1 for keys in dealt)


def test_differences_join_where_their_image_lies(spark, monkeypatch):
    """Under the table of differences no shuffle has a second key, and repeated ids keep their rows."""
    plans, cut = [], M.cut_lineage

    def watch(df, dealt=False):
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false" if dealt else "true")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        return cut(df, dealt)

    monkeypatch.setattr(M, "cut_lineage", watch)
    schema = "image_id long, box_id string, type string, text string, semantic_role string, children array<string>, x double, y double, w double, h double"
    row = lambda i, x, kind="text": (1, i, kind, "t", None, None, x, 0.0, 20.0, 20.0)
    pred = spark.createDataFrame([row("p1", 0.0, "icon"), row("p2", 100.0), row("p2", 100.0), row(None, 300.0)], schema)
    human = spark.createDataFrame([row("h1", 0.0), row("h3", 200.0), row("h3", 200.0)], schema)
    got = M.annotation_diff(pred, human).collect()
    assert sorted((r.category, str(r.pred_id), str(r.human_id)) for r in got) == [
        ("false_positive", "None", "None"), *[("false_positive", "p2", "None")] * 2, *[("missed", "None", "h3")] * 2, ("wrong_type", "p1", "h1")]
    dealt = [line.split("hashpartitioning(")[1].split(")")[0].split(", ")[:-1] for line in plans[-1].splitlines() if "hashpartitioning(" in line]
    assert len(plans) == 2 and dealt and all(len(keys) == 1 for keys in dealt)


def test_colours_are_read_once_for_each_node(spark):
    """The channels of a colour are columns, not spelled out again for each use."""
    from screenlake.operators import typing_rules as T

    schema = "image_id long, parent_id string, node_id string, type string, text string, bg_color string, x double, y double, w double, h double"
    nodes = spark.createDataFrame([(1, None, c or "none", "container", None, c, 0.0, 0.0, 20.0, 20.0) for c in ("#f00", "2266cc", "#808080", "red", None)], schema)
    ocr = spark.createDataFrame([], "image_id long, text string, x double, y double, w double, h double")
    meta = spark.createDataFrame([(1, 420, 820)], "image_id long, width int, height int")
    out = T.correct_types(nodes, ocr, meta)
    assert sorted((r.node_id, r.new_type) for r in out.collect()) == [("#808080", "container"), ("#f00", "button"), ("2266cc", "button"), ("none", "container"), ("red", "container")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("conv(") == 3
