"""Composed results: merged summaries, corrected categories, page evidence, kept originals."""

import json

from screenlake.operators import entities as E, outputs as O

PHONE = ["12:30", "商品详情", "详情", "双拼A", "双拼B", "比萨C", "配料", "保存", "z"]


def answers(spark, rows):
    return spark.createDataFrame(rows, "request_id long, skill string, json string, error string")


def composed(spark, requests, outputs, **more):
    req = spark.createDataFrame(requests, "request_id long, ocr_text string, key_content string, scenario string")
    return {r.request_id: r for r in O.compose_result(req, answers(spark, outputs), **more).collect()}


def test_category_is_corrected_and_the_original_kept(spark):
    drawn = "In this image we can see a sword with glowing runes and a red dragon."
    got = composed(
        spark, [(1, None, None, None), (2, None, None, None)],
        [(1, "classify", '{"category":"document","confidence":0.7,"x":1}', None), (1, "summary", json.dumps({"description": drawn}), None),
         (2, "classify", '{"category":"chart","confidence":0.9}', None), (2, "summary", '{"description":"A bar chart showing sales by quarter."}', None)],
    )
    assert (got[1].category, got[1].confidence, got[1].final_summary, got[1].summary_grounded) == ("illustration", 0.75, drawn, None)
    assert json.loads(got[1].result["classify"]) == {"x": 1, "category": "illustration", "confidence": 0.75, "originalCategory": "document", "originalConfidence": 0.7}
    assert (got[2].category, got[2].confidence) == ("chart", 0.9)
    assert json.loads(got[2].result["classify"]) == {"category": "chart", "confidence": 0.9}


def test_short_summaries_take_the_other_fields(spark):
    data = {"description": "short", "navigation": ["a", "b", {"k": 1}, 4, "e", "f"], "title": "long title", "tiny": "abc", "n": 3, "none": None, "empty": [], "o": {"z": 1, "a": "b"}}
    got = composed(
        spark, [(1, None, "KC", "【文档】标题：A；明细共 3 行；"), (2, None, None, None), (3, None, None, None)],
        [(1, "summary", json.dumps(data, separators=(",", ":")), None), (1, "ocr", None, "boom"), (2, "summary", json.dumps({"a": "b" * 3000}), None), (3, "layout", '{"description":"two columns"}', None)],
    )
    merged = 'short. navigation: a, b, {"k":1}, 4, e. title: long title. o: {"z":1,"a":"b"}'
    # text that should have been read but was not: unverified
    assert (got[1].summary, got[1].final_summary, got[1].summary_grounded) == (merged, merged + "KC 标题为A。共3行明细。", False)
    assert json.loads(got[1].result["ocr"]) == {"error": "boom", "partial": True} and got[1].skills == ["summary"]
    assert got[2].summary == ("a: " + "b" * 997) + "..."
    assert (got[3].category, got[3].summary, got[3].final_summary) == ("unknown", "", "two columns")


def test_page_evidence_names_the_title_and_replaces_weak_summaries(spark):
    lines = [(3, f"{i:02}", t) for i, t in enumerate(PHONE)] + [(4, f"{i:02}", t) for i, t in enumerate(["菜单中心", "编辑", "保存", "价格", "0.00", "a", "b", "c"])]
    evidence = E.ui_evidence(spark.createDataFrame(lines, "image_id long, ord string, text string"))
    assert [r.text for r in evidence.where("field = 'title'").collect()] == ["详情"]
    got = composed(
        spark, [(3, "\n".join(PHONE), None, None), (4, "菜单中心", None, None), (5, "Alpha one Alpha", None, None), (6, "", None, None)],
        [(3, "classify", '{"category":"document","confidence":0.6}', None), (3, "summary", '{"description":"x"}', None)], evidence=evidence,
    )
    assert (got[3].category, got[3].confidence, got[3].page_type, got[3].summary_grounded) == ("ui", 0.75, "mobile-ui", True)
    assert got[3].final_summary == "这是一个移动端应用页面。页面标题为详情。页面模块包括双拼A、双拼B、比萨C。可见内容包括双拼A、双拼B、比萨C、配料。操作按钮有保存。"
    assert got[4].final_summary == "这是一个中文后台管理系统页面。系统模块包括菜单中心。导航包含菜单中心。表格列包括价格。可执行操作包括编辑、保存。"
    assert got[5].final_summary == 'This image contains text content.Main title: "Alpha one Alpha".Topics include: Alpha.'
    assert (got[6].final_summary, got[6].result) == ("", None)
