"""Sources, sinks, cache, streaming, extension points and properties."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from screenlake.operators import cache as C, dataset as D, documents as T, extension as X
from screenlake.sources import annotations as A, images as I
from screenlake.streaming import jobs as J

NOTE = {
    "image": "a.png", "imageSize": {"width": 10, "height": 10}, "platform": "app", "theme": "light", "language": "en", "dpi": "high",
    "elements": [{"id": "e1", "type": "button", "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}, "render": "native"}],
}


def annotation_folder(tmp_path):
    sub = tmp_path / "sub"
    sub.mkdir()
    (tmp_path / "a.json").write_text(json.dumps(NOTE, indent=1))
    (sub / "b.json").write_text(json.dumps({**NOTE, "theme": None}))
    (sub / "c.json").write_text("[not json")
    (tmp_path / "a.json.session.json").write_text("{}")
    return str(tmp_path)


def test_scan_annotations(spark, tmp_path):
    notes, skipped = A.scan_annotations(spark, annotation_folder(tmp_path))
    ok, bad = A.reject_invalid(notes)
    assert [r.image for r in ok.collect()] == ["a.png"]
    reasons = {r.file.rsplit("/", 1)[1]: r.reason for r in bad.collect()}
    assert reasons == {"b.json": "invalid: annotation missing required field: theme", "c.json": "invalid: annotation root must be an object"}
    assert skipped.count() == 1
    assert [(r.element_id, r.x) for r in A.elements_of(ok.withColumnRenamed("file", "image_id")).collect()] == [("e1", 1.0)]


def test_stream_ingest(spark, tmp_path):
    src, out, rej, ck = (str(tmp_path / d) for d in ("in", "out", "rej", "ck"))
    (tmp_path / "in").mkdir()
    annotation_folder(tmp_path / "in")
    J.stream_ingest_annotations(spark, src, out, rej, ck).awaitTermination()
    assert spark.read.parquet(out).select("element_id").collect()[0][0] == "e1"
    # sidecars are not annotations: they land with the rejects
    assert spark.read.parquet(rej).count() == 3


def test_packs_hold_annotation_files(spark, tmp_path):
    """Loose files and members of a pack give the same rows, and one pack is one file to list."""
    src, out, rej, ck = (str(tmp_path / d) for d in ("in", "out", "rej", "ck"))
    (tmp_path / "in").mkdir()
    annotation_folder(tmp_path / "in")
    loose = {p.name: p.read_text() for p in (tmp_path / "in").rglob("*.json")}
    rows = [(f"p/{name}", text) for name, text in loose.items()] + [("p/none.json", None)]
    A.pack_annotations(spark.createDataFrame(rows, "file string, content string").coalesce(1), f"{src}/pack")
    notes, skipped = A.scan_annotations(spark, src)
    ok, bad = A.reject_invalid(notes)
    assert [r.image for r in ok.collect()] == ["a.png"] * 2
    broken, theme = "annotation root must be an object", "annotation missing required field: theme"
    assert sorted((r.file.rsplit("/", 1)[1], r.reason.removeprefix("invalid: ")) for r in bad.collect()) == [
        ("b.json", theme), ("b.json", theme), ("c.json", broken), ("c.json", broken), ("none.json", broken)]
    assert sorted(".parquet/p/" in r.file for r in skipped.collect()) == [False, True]
    J.stream_ingest_annotations(spark, src, out, rej, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert spark.read.parquet(rej).count() == 7


def test_scan_images(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(bytes.fromhex("89504E470D0A1A0A"))
    (tmp_path / "j.jpg").write_bytes(bytes.fromhex("FFD8FFE000"))
    (tmp_path / "w.webp").write_bytes(b"RIFF1234WEBPVP8 ")
    (tmp_path / "t.txt").write_bytes(b"hello")
    (tmp_path / "big.png").write_bytes(bytes.fromhex("89504E47") + b"0" * 100)
    ok, bad = I.scan_images(spark, str(tmp_path), max_bytes=50)
    assert {r.image_id: r.mime for r in ok.collect()} == {"p.png": "image/png", "j.jpg": "image/jpeg", "w.webp": "image/webp"}
    assert sorted(r.reason.split(" ")[0] for r in bad.collect()) == ["image", "unrecognized"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", "train"), ("s2", None)], "sample_id string, split string")
    A.write_samples(df, str(tmp_path / "samples"))
    assert {(r.sample_id, r.split) for r in spark.read.parquet(str(tmp_path / "samples")).collect()} == {("s1", "train"), ("s2", "none")}
    A.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def model_hits(rows, ttl):
    last, out = {}, {}
    for rid, ts, key in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if key in last and (ts - last[key]).total_seconds() < ttl:
            out[rid] = True
        else:
            out[rid], last[key] = False, ts
    return out


def requests(n=120, seed=3):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(i, start + dt.timedelta(seconds=rng.randrange(40_000)), rng.choice("aaab")) for i in range(n)]


def test_cache_hits(spark):
    rows = requests()
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, cache_key string")
    for ttl in (60, 3600, 20_000):
        assert {r.request_id: r.hit for r in C.cache_hits(df, ttl).collect()} == model_hits(rows, ttl)


def test_covered_area():
    from screenlake.operators.metrics import covered_area

    rng = random.Random(3)
    for n in (1, 2, 5, 40):
        boxes = [(x, x + rng.randint(1, 9), y, y + rng.randint(1, 9)) for x, y in ((rng.randrange(30), rng.randrange(30)) for _ in range(n))]
        assert covered_area(boxes) == len({(x, y) for a, b, c, d in boxes for x in range(a, b) for y in range(c, d)})


def test_union_area_of_one_crowded_tile(spark):
    """100 000 boxes on one tile: a staircase, whose area is known."""
    from screenlake.operators.metrics import union_area

    n = 100_000
    i = F.col("id") / n
    boxes = spark.range(n).select(F.lit(1).alias("image_id"), (i * 100).alias("x"), (i * 100).alias("y"), (100 - i * 100).alias("w"), (i * 50 + 1).alias("h"))
    # column at x: boxes start at t <= x and reach from t to 1.5 t + 1
    want = sum(1.5 * (k / n * 100) + 1 for k in range(n)) * 100 / n
    got = union_area(boxes, tile=1000.0).head()["union_area"]
    assert abs(got - want) < 1e-6 * want


def test_one_key_with_a_million_rows_in_a_batch(spark, tmp_path):
    n, ttl = 1_000_000, 600
    rows = spark.range(n).select(F.col("id").alias("request_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 100_003).alias("ts"), F.lit("hot").alias("cache_key"))
    rows.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src"))
    out = J.run_available(J.stream_cache_hits(stream, ttl), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.groupBy("hit").count().orderBy("hit").collect() == [(False, 100_003 // ttl + 1), (True, n - 100_003 // ttl - 1)]


def test_stream_in_many_batches_equals_one(spark, tmp_path):
    rows = sorted(requests(), key=lambda r: r[1])
    src = str(tmp_path / "src")
    schema = "request_id long, ts timestamp, cache_key string"
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = J.run_available(J.stream_cache_hits(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    assert {r.request_id: r.hit for r in out.collect()} == model_hits(rows, 3600)
    acts = stream.select(F.lit(1).alias("image_id"), F.lit("k").alias("subject_kind"), F.col("cache_key").alias("subject_id"), F.col("request_id").alias("action_id"), F.col("ts").alias("created_at"))
    last = J.run_available(J.stream_latest_actions(acts), str(tmp_path / "o2"), str(tmp_path / "c2"), "update", ("image_id", "subject_kind", "subject_id"))
    want = {k: max((r for r in rows if r[2] == k), key=lambda r: (r[1], r[0]))[0] for k in "ab"}
    assert {r.subject_id: r.action_id for r in last.collect()} == want
    few = J.run_available(J.stream_distinct_requests(stream), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert 2 <= few.count() < len(rows)


def test_sessions_are_closed_by_the_watermark(spark, tmp_path):
    """State falls as sessions close; a row behind the watermark is counted and changes nothing."""
    start = dt.datetime(2024, 1, 1)
    at = lambda *minutes: [(m, start + dt.timedelta(minutes=m), "a", 1.0) for m in minutes]
    schema, src = "request_id long, ts timestamp, provider string, duration_ms double", str(tmp_path / "src")
    for rows in (at(0, 5, 300), at(301, 600), at(1, 2, 900)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    out = J.run_available(J.idle_sessions(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted((r.started.hour * 60 + r.started.minute, r.n) for r in out.collect()) == [(0, 2), (300, 2), (600, 1)]
    late = spark.read.parquet(str(tmp_path / "o-late")).orderBy("batch").collect()
    assert sum(r.late_rows for r in late) == 2 and late[-1].state_rows == 1 < max(r.state_rows for r in late)


def test_ingest_findings_are_replay_safe(spark, tmp_path):
    src, out, rej, found, ck = (str(tmp_path / d) for d in ("in", "out", "rej", "found", "ck"))
    (tmp_path / "in").mkdir()
    twice = {**NOTE, "elements": NOTE["elements"] * 2 + [{"id": "far", "type": "icon", "bbox": {"x": 9, "y": 9, "w": 9, "h": 9}, "render": "native", "children": ["e1"]}]}
    (tmp_path / "in" / "d.json").write_text(json.dumps(twice))
    want = [("bbox-out-of-bounds", "far", None), ("child-not-in-contains", "far", "e1"), ("duplicate-id", "e1", None)]
    for _ in range(2):  # the checkpoint is lost: the batch comes again
        J.stream_ingest_annotations(spark, src, out, rej, ck, found).awaitTermination()
        assert sorted((r.code, r.element_id, r.detail) for r in spark.read.parquet(found).collect()) == want
        assert spark.read.parquet(out).count() == 3
        ck += "2"


def test_failed_prompts_are_isolated_and_answers_kept(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def factory():
        import pathlib
        import uuid

        def ask(prompts):
            pathlib.Path(calls).mkdir(exist_ok=True)
            (pathlib.Path(calls) / uuid.uuid4().hex).write_text("\n".join(prompts))
            if any("bad" in p for p in prompts):
                raise ValueError("refused")
            return ['{"summary": "fine", "page": 1}'] * len(prompts)

        return ask

    rows = [(i, "describe", "bad" if i % 7 == 3 else f"prompt {i % 5}") for i in range(20)]
    prompts = spark.createDataFrame(rows, "request_id long, skill string, prompt string").coalesce(1)
    for _ in range(2):
        got = X.infer_with(prompts, factory, 0, str(tmp_path / "answers")).collect()
        assert {r.request_id for r in got if r.raw_text} == {i for i, _, p in rows if p != "bad"}
        assert {r.error for r in got if not r.raw_text} == {"ValueError: refused"}
    asked = [p for f in (tmp_path / "calls").iterdir() for p in f.read_text().split("\n")]
    before = len(asked)
    X.infer_with(prompts.where("prompt <> 'bad'"), factory, 0, str(tmp_path / "answers")).collect()
    assert sum(len(f.read_text().split("\n")) for f in (tmp_path / "calls").iterdir()) == before


def test_table_function_equals_levels(spark):
    tree = {"id": "p", "type": "page", "children": [{"id": "a", "type": "card", "bbox": {"x": 1, "y": 2.5, "w": 3, "h": 4}, "text": "t", "props": {"render": {"mode": "semantic-only"}}, "children": [{"id": 7, "type": "icon"}, {"type": "text", "children": []}]}, {"id": "b", "type": "row", "children": None}]}
    deep = {"id": "d0", "type": "page"}
    for i in range(1, 40):
        deep = {"id": f"d{i}", "type": "row", "children": [deep]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps(deep)), (3, "[broken"), (4, None), (5, "5")], "k long, tree string")
    cols = ["k", "node_id", "parent_id", "depth", "path", "type", "x", "y", "w", "h", "text", "render_mode"]
    for exclude in (False, True):
        rows = lambda d: sorted((tuple(r) for r in d.select(*cols).collect()), key=repr)
        assert rows(X.flatten_tree_rows(df, "k", "tree", exclude)) == rows(A.flatten_tree(df, "k", "tree", exclude))


def test_splits_keep_families_together(spark):
    rows = [(f"s{i}", f"screen_{202401010000 + i % 17}_{i}.json") for i in range(200)]
    got = D.assign_splits(spark.createDataFrame(rows, "sample_id string, annotation_file string"), seed=5).collect()
    fam = {}
    for r in got:
        fam.setdefault(r.family, set()).add(r.split)
    assert len(got) == 200 and all(len(s) == 1 for s in fam.values())
    sizes = [sum(1 for s in fam.values() if s == {n}) for n in ("train", "validation", "test")]
    assert sizes == [12, 3, 2]
    one = D.assign_splits(spark.createDataFrame(rows[:1], "sample_id string, annotation_file string"))
    assert one.collect()[0].split == "train"


def item(o, text, x, y):
    return (1, o, text, float(x), float(y), 30.0, 10.0)


def test_key_content_table_fields_text(spark):
    items = [
        item("0", "Name", 0, 0), item("1", "Price", 100, 1), item("2", "Tea", 0, 30), item("3", "5", 100, 30), item("4", "¥", 131, 30), item("5", "Cake", 2, 60), item("6", "7.5", 101, 60),
        item("7", "City: Rome", 300, 0), item("8", "Zip: 12", 300, 40), item("9", "hello world", 600, 0), item("a", "hello world", 640, 0),
    ]
    regions = [(1, "t", 0.0, 0.0, 170.0, 80.0, 0.9), (1, "f", 290.0, 0.0, 60.0, 60.0, 0.8), (1, "p", 590.0, 0.0, 90.0, 20.0, 0.7), (1, "e", 900.0, 0.0, 9.0, 9.0, 0.1)]
    i = spark.createDataFrame(items, "image_id long, ord string, text string, x double, y double, w double, h double")
    r = spark.createDataFrame(regions, "image_id long, region_id string, x double, y double, w double, h double, confidence double")
    got = {x.region_id: (x.rank, x.kind, x.summary) for x in T.key_content(i, r).collect()}
    assert got == {
        "t": (1, "table", "关键区域包含表格：Name、Price，共 2 行。"), "f": (2, "fields", "关键区域包含字段：City=Rome，Zip=12。"),
        "p": (3, "text", "关键区域包含：hello world。"), "e": (4, "empty", "关键区域未识别到明确文本。"),
    }
    cells = {(c.row, c.col): c.text for c in T.reconstruct_table(i.where("x < 200")).collect()}
    assert cells == {(0, 0): "Tea", (0, 1): "5 ¥", (1, 0): "Cake", (1, 1): "7.5"}


def test_key_content_names_the_unit_line_of_a_header(spark):
    items = [item("0", "Name", 0, 0), item("1", "Cost", 100, 1), item("2", "(元)", 40, 30), item("3", "Tea", 49, 60), item("4", "5", 90, 60), item("5", "Cup", 51, 90)]
    i = spark.createDataFrame(items, "image_id long, ord string, text string, x double, y double, w double, h double")
    r = spark.createDataFrame([(1, "t", -50.0, -50.0, 400.0, 300.0, 0.9)], "image_id long, region_id string, x double, y double, w double, h double, confidence double")
    got = T.key_content(i, r).first()
    assert (got.kind, got.n_rows, got.summary) == ("table", 2, "关键区域包含表格：Name（元）、Cost（元），共 2 行。")
    cells = {(c.row, c.col): (c.header, c.text) for c in T.reconstruct_table(i).collect()}
    assert cells == {(0, 0): ("Name（元）", "Tea"), (0, 1): ("Cost（元）", "5"), (1, 1): ("Cost（元）", "Cup")}


def test_nearest_anchor_equals_brute_force(spark):
    from screenlake.operators.ordered import nearest

    draw = random.Random(5)
    rows = [(g, n, draw.choice([draw.uniform(-4000, 4000), float(draw.randrange(-9, 9) * 128), None])) for g in range(4) for n in range(150)]
    # repeated centres, bands without an anchor, a group without any, and 3000 anchors of one group
    anchors = [(g, c, draw.choice([draw.uniform(-2000, 2000), float(draw.randrange(-5, 5) * 256)])) for g in range(1, 4) for c in range(3000 if g == 3 else 5 * g)]
    df = spark.createDataFrame(rows, "g long, n long, at double")
    got = {(r.g, r.n): r.near and tuple(r.near) for r in nearest(df, spark.createDataFrame(anchors, "g long, c long, at double"), ["g"], "at", ["c"]).collect()}
    best = lambda g, at: min(((abs(a - at), a, c) for h, c, a in anchors if h == g), default=None) if at is not None else None
    want = {(g, n): b and b[1:] for g, n, at in rows for b in [best(g, at)]}
    assert got == want


def test_detector_errors_become_rows(spark):
    def factory():
        def run(row):
            if row["image_id"] == 2:
                raise ValueError("bad")
            return [{"label": "x"}] * row["image_id"]

        return run

    df = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    rows = X.detect_with(df, factory, "label string").collect()
    assert sorted((r.image_id, r.ord, r.error) for r in rows) == [(1, 0, None), (2, 0, "ValueError: bad"), (3, 0, None), (3, 1, None), (3, 2, None)]


def test_ocr_items_inside_any_number_of_ocr_levels(spark):
    from screenlake.sources.ocr import ocr_items_from_json

    items = '[{"text": "a \\"ocr\\" b", "position": "1,2,3,4"}]'
    wrap = lambda inner, n, key="ocr": (f'{{"{key}": ' * n) + inner + "}" * n
    nested = [(f"{n}{k}", wrap(body, n)) for n in (0, 1, 3, 4, 9, 60) for k, body in (("array", items), ("texts", '{"texts": %s}' % items), ("items", '{"texts": 1, "items": %s}' % items))]
    nested += [("escaped", wrap('{"items": %s}' % items, 6, "\\u006fcr"))]
    empty = [("none", wrap("{}", 7)), ("number", wrap("5", 5)), ("null", None), ("broken", '{"ocr": ['), ("nearer", '{"texts": [], "ocr": %s}' % items)]
    df = spark.createDataFrame(nested + empty, "k string, json string")
    got = {(r["k"], r["ord"], r["text"], r["x"], r["h"]) for r in ocr_items_from_json(df, "json", "k").collect()}
    assert got == {(k, 0, 'a "ocr" b', 1.0, 2.0) for k, _ in nested}


def test_findings_deal_their_inputs_by_image_once(spark, tmp_path):
    """The rules join where the inputs lie: under the table of findings no shuffle has a second key."""
    from pyspark.sql import DataFrame

    from screenlake.operators import review as R
    from screenlake.plans.q_review import elements, relations
    from screenlake.plans.registry import Tables

    t, plans = Tables(spark, "/root/testdata/sf0.001"), []
    cut, name = R.cut_lineage, "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)

    def spy(df: DataFrame, dealt: bool = False) -> DataFrame:
        spark.conf.set(name, str(not dealt).lower())
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        spark.conf.set(name, before)
        return cut(df, dealt)

    R.cut_lineage = spy
    try:
        R.structure_findings(elements(t), relations(t), t.kids)
    finally:
        R.cut_lineage = cut
    keys = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(" in line]
    assert keys and all(line.split("hashpartitioning(")[1].startswith("image_id") and line.split("hashpartitioning(")[1].split(",")[1].strip().isdigit() or line.split("hashpartitioning(")[1].split(")")[0].count(",") == 1 for line in keys)
    assert spark.conf.get(name) == before


def test_tree_levels_are_never_broadcast(spark):
    from screenlake.operators import review as R
    from screenlake.plans.catalog import QUERIES

    plans, cut = [], R.cut_lineage
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    R.cut_lineage = lambda df, dealt=False: seen(df) or cut(df, dealt)
    try:
        seen(QUERIES["markdown"](spark, "/root/testdata/sf0.001"))
    finally:
        R.cut_lineage = cut
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)
