"""Checks and repairs of model output, and composed results (TXT-13..15, TXT-25, TXT-28)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from screenlake.functions import rulebook as RB
from screenlake.functions.semantics import ascii_words
from screenlake.operators.entities import CJK, key_topics, ui_summary
from screenlake.operators.rules import correct_category

STRINGS = "array<string>"


def text_lines(text: Column) -> Column:
    """Trimmed non-empty lines."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def _most_repeats(values: Column) -> Column:
    """Highest number of equal entries: runs in the sorted array, no all-pairs count."""
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, v: Column) -> Column:
        run = F.when(acc["last"] == v, acc["run"] + 1).otherwise(1)
        return F.struct(v.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(values), zero, step)["best"]


def has_repetition(text: Column) -> Column:
    """At least six lines, and a line occurs more than three times or the first block of
    four lines (over 20 characters) comes back."""
    lines = text_lines(text)
    block = F.array_join(F.slice(lines, 1, 4), "\n")
    rest = F.array_join(F.slice(lines, 5, 1_000_000_000), "\n")
    again = (F.length(block) > 20) & F.contains(rest, block)
    return (F.size(lines) >= 6) & ((_most_repeats(lines) > 3) | again)


def repetition_flag(docs: DataFrame, text: str, name: str = "repetitive") -> DataFrame:
    return docs.withColumn(name, F.coalesce(has_repetition(F.col(text)), F.lit(False)))


def list_repetition(values: Column) -> Column:
    """Short-list variant: any item more than twice in a list of at least three."""
    return (F.size(values) >= 3) & (_most_repeats(F.transform(values, lambda v: F.lower(v))) > 2)


def grounding_share(summary: Column, source: Column) -> Column:
    """Share of the summary's terms (CJK runs of two or more, Latin runs of three or more)
    that occur in the source; NULL when there is nothing to check."""
    cjk = F.regexp_extract_all(summary, F.lit(CJK + "{2,}"), F.lit(0))
    latin = F.regexp_extract_all(F.lower(summary), F.lit("[a-z]{3,}"), F.lit(0))
    terms = F.array_distinct(F.concat(cjk, latin))
    found = F.filter(terms, lambda t: F.contains(F.lower(source), t))
    ok = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(summary, F.lit("")) != "") & (F.size(terms) > 0)
    return F.when(ok, F.size(found) / F.size(terms))


def grounding(outputs: DataFrame, summary: str, source: str, threshold: float = 0.15) -> DataFrame:
    rows = outputs.withColumn("grounded_share", grounding_share(F.col(summary), F.col(source)))
    return rows.withColumn("grounded", F.coalesce(F.col("grounded_share") >= threshold, F.lit(True)))


def prefer_source_text(outputs: DataFrame, summary: str, source: str) -> DataFrame:
    """Whether the text-driven summary should replace the model's: empty, repetitive,
    ungrounded (unless long and CJK), short (< 40), copied, or > 60 % copied lines.
    Needs ``grounded``; adds ``prefer_source`` and ``prefer_reason``."""
    s, src = F.coalesce(F.col(summary), F.lit("")), F.coalesce(F.col(source), F.lit(""))
    lines = text_lines(s)
    squeeze = lambda c: F.regexp_replace(c, r"\s", "")
    copied = F.size(F.filter(lines, lambda ln: F.contains(src, ln) | F.contains(squeeze(src), squeeze(ln))))
    long_cjk = (F.length(s) > 100) & s.rlike(CJK)
    reason = (
        F.when(F.trim(s) == "", "empty").when(has_repetition(s), "repetitive")
        .when(~F.col("grounded"), F.when(long_cjk, F.lit(None).cast("string")).otherwise("ungrounded")).when(src == "", F.lit(None).cast("string"))
        .when(F.length(s) < 40, "short").when(F.contains(src, F.trim(s)), "copy").when((F.size(lines) >= 3) & (copied / F.size(lines) > 0.6), "copied-lines")
    )
    return outputs.withColumn("prefer_reason", reason).withColumn("prefer_source", reason.isNotNull())


# --- parsing of model output ------------------------------------------------------------
REQUIRED = {
    "classify": ["category"], "summary": ["description"], "ocr": ["texts"], "layout": ["description"], "table": ["description", "rowCount", "columnCount"],
    "document": ["description"], "poster": ["description"], "moderation": ["description", "safe"],
}


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _wrapped(text: Column, skill: Column) -> Column:
    """Prose as the JSON a skill would have produced."""
    clean = F.regexp_replace(F.trim(text), "^[\"']|[\"']$", "")
    low = F.regexp_replace(F.lower(clean), "[.'\"]", "")
    found = None
    for c in RB.WRAP_CATEGORIES:
        found = (F if found is None else found).when(low.rlike(ascii_words(rf"\b{c}\b")), F.lit(c))
    desc = lambda default: F.when(F.length(clean) > 0, clean).otherwise(default)
    lines = text_lines(clean)
    texts = F.transform(lines, lambda ln: F.struct(ln.alias("text"), F.lit("center").alias("position"), F.lit(0.7).alias("confidence")))
    lang = F.when(clean.rlike("[一-鿿぀-ゟ゠-ヿ]"), "zh").otherwise("en")
    nothing = (F.length(clean) == 0) | (F.upper(clean) == "NONE")
    return (
        F.when(skill == "classify", F.when(found.isNotNull(), _json(category=found, confidence=F.lit(0.7))).otherwise(_json(category=F.lit("other"), confidence=F.lit(0.3))))
        .when(skill == "summary", _json(description=desc("Unable to describe image.")))
        .when(skill == "layout", _json(description=desc("Layout analysis unavailable."), layoutType=F.lit("other")))
        .when(skill == "document", _json(description=desc("Document analysis unavailable."), documentType=F.lit("other")))
        .when(skill == "poster", _json(description=desc("Poster analysis unavailable."), theme=F.when(F.length(clean) > 0, F.substring(clean, 1, 50)).otherwise("Unknown")))
        .when(skill == "table", _json(description=desc("Table analysis unavailable."), rowCount=F.lit(0), columnCount=F.lit(0)))
        .when(skill == "moderation", _json(description=desc("Safe"), safe=F.lit(True)))
        .when(skill == "ocr", F.when(nothing, F.lit('{"texts":[],"language":"unknown"}')).otherwise(_json(texts=texts, language=lang)))
        .when(F.length(clean) > 0, _json(result=clean))
    )


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _has(obj: str, field: str) -> Column:
    value = F.try_variant_get(F.col(obj), f"$.{field}", "variant")
    return F.coalesce(value.isNotNull() & (F.schema_of_variant(value) != "VOID"), F.lit(False))


def parse_model_output(outputs: DataFrame, raw: str = "raw_text", skill: str = "skill") -> DataFrame:
    """Strip fences, cut out the object, parse; else fix commas and quotes, close braces,
    or wrap the prose; then recover required fields and defaults.

    Adds ``json`` (NULL when invalid), ``repairs`` and ``error``.  A cascade of JVM JSON
    expressions: each step is a column, so the rows never leave the scan."""
    t0 = F.trim(raw)
    fenced = F.contains(t0, F.lit("```"))
    t1 = F.when(fenced, F.regexp_replace(F.regexp_replace(t0, r"```(?:json)?\s*", ""), "```", "")).otherwise(t0)
    rows = outputs.withColumn("_t1", t1).withColumn("_fence", fenced)
    obj = F.regexp_extract("_t1", r"(?s)\{.*\}", 0)
    rows = rows.withColumn("_cut", (obj != "") & (obj != F.col("_t1"))).withColumn("_t", F.when(obj != "", obj).otherwise(F.col("_t1")))
    t = F.col("_t")
    kind = F.schema_of_variant(F.try_parse_json(t))
    scalar = F.coalesce(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"), F.lit(False))
    rows = rows.withColumn("_ok", _is_json(t)).withColumn("_scalar", F.col("_ok") & scalar)
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r",\s*\}", "}"), r",\s*\]", "]"), "'", '"')
    opens, closes = F.regexp_count(t, F.lit(r"\{")), F.regexp_count(t, F.lit(r"\}"))
    closed = F.when((opens > closes) & (opens - closes < 5), F.concat(t, F.repeat(F.lit("}"), opens - closes)))
    starts = t.startswith("{")
    rows = rows.withColumn("_fixed", F.when(~F.col("_ok") & starts, fixed)).withColumn("_closed", F.when(~F.col("_ok") & starts, closed))
    rows = rows.withColumn("_w", _wrapped(t, F.col(skill)))
    step = (
        F.when(F.col("_ok") & ~F.col("_scalar"), F.struct(t.alias("j"), F.lit(None).cast("string").alias("r")))
        .when(F.col("_scalar"), F.struct(F.coalesce("_w", t).alias("j"), F.when(F.col("_w").isNotNull(), "wrapped-natural-language").alias("r")))
        .when(_is_json(F.col("_fixed")), F.struct(F.col("_fixed").alias("j"), F.lit("fixed-syntax").alias("r")))
        .when(_is_json(F.col("_closed")), F.struct(F.col("_closed").alias("j"), F.lit("auto-closed-braces").alias("r")))
        .when(F.col("_w").isNotNull(), F.struct(F.col("_w").alias("j"), F.lit("wrapped-natural-language").alias("r")))
    )
    rows = rows.withColumn("_s", step).withColumn("_v", F.try_parse_json(F.col("_s.j")))
    get = lambda f, typ="string": F.try_variant_get("_v", f"$.{f}", typ)
    # required fields with a recovery, and defaults, become additions to the object
    need = lambda f: F.col(skill).isin([s for s, req in REQUIRED.items() if f in req]) & ~_has("_v", f)
    fields = F.from_json(F.col("_s.j"), "map<string,string>")
    others = F.filter(F.map_entries(fields), lambda e: (e["key"] != "description") & F.coalesce(e["value"] != "", F.lit(False)))
    plain = F.filter(others, lambda e: ~e["value"].rlike(r"^[\[{]") & ~e["value"].rlike(r"^(true|false|null|-?\d+(\.\d+)?)$"))
    joined = F.array_join(F.transform(plain, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    result = get("result")
    rows = rows.withColumn("_desc", F.when(need("description"), F.when(result != "", F.struct(result.alias("v"), F.lit("recovered-description-from-result").alias("r"))).when(
        F.coalesce(joined, F.lit("")) != "", F.struct(joined.alias("v"), F.lit("synthesized-description").alias("r"))).otherwise(F.struct(F.lit("Analysis unavailable.").alias("v"), F.lit("default-description").alias("r")))))
    adds = [
        (F.col("_desc").isNotNull(), F.concat(F.lit('"description":'), F.to_json(F.array("_desc.v"))), F.col("_desc.r")),
        (need("safe"), F.lit('"safe":true'), F.lit("default-safe")), (need("rowCount"), F.lit('"rowCount":0'), F.lit("default-rowCount")),
        (need("columnCount"), F.lit('"columnCount":0'), F.lit("default-columnCount")),
        ((F.col(skill) == "classify") & ~_has("_v", "confidence"), F.lit('"confidence":0.5'), F.lit("default-confidence")),
        ((F.col(skill) == "ocr") & ~_has("_v", "language"), F.lit('"language":"unknown"'), F.lit("default-language")),
    ]
    missing = F.when(need("category"), "category").when(need("texts"), "texts")
    error = F.when(F.col("_v").isNull(), "JSON parse failed").when(missing.isNotNull(), F.concat(F.lit("missing required field: "), missing))
    rows = rows.withColumn("error", error)
    extra = F.array_compact(F.array(*(F.when(c, text) for c, text, _ in adds)))
    extra = F.transform(extra, lambda s: F.regexp_replace(s, r'^("description":)\[(?s)(.*)\]$', "$1$2"))
    # a null entry of the same name makes room for the addition
    body = F.regexp_replace(F.col("_s.j"), r'"(description|safe|rowCount|columnCount)"\s*:\s*null\s*,?', "")
    body = F.regexp_replace(F.regexp_replace(body, r"\}\s*$", ""), r",\s*$", "")
    empty = F.regexp_replace(body, r"\s", "") == "{"
    merged = F.when(F.size(extra) == 0, F.col("_s.j")).otherwise(F.concat(body, F.when(empty, "").otherwise(","), F.array_join(extra, ","), F.lit("}")))
    repairs = F.array_compact(F.array(
        F.when(F.col("_fence"), "stripped-markdown"), F.when(F.col("_cut"), "extracted-json"), F.col("_s.r"), *(F.when(c & error.isNull(), r) for c, _, r in adds)
    ))
    return rows.select(*outputs.columns, F.when(F.col("error").isNull(), merged).alias("json"), repairs.alias("repairs"), "error")


def parse_reasoning(outputs: DataFrame, raw: str = "raw_text", most: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Insights, risks and next actions of a reasoning answer, of each all or the first
    ``most`` that are not longer than ``max_chars``; NULL when nothing usable or a phrase repeats too often."""
    t = F.regexp_replace(F.regexp_replace(F.trim(raw), r"```(?:json)?\s*", ""), "```", "")
    obj = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    v = F.from_json(F.when(obj != "", obj).otherwise(t), "insights array<string>, risks array<string>, next_actions array<string>")
    rows = outputs.withColumn("_v", v)

    def strings(name: str) -> Column:
        clean = F.transform(F.col(f"_v.{name}"), lambda s: F.trim(s))
        fits = F.filter(F.coalesce(clean, F.array().cast(STRINGS)), lambda s: (F.length(s) > 0) & (F.lit(True) if max_chars is None else F.length(s) <= max_chars))
        return fits if most is None else F.slice(fits, 1, most)

    names = ("insights", "risks", "next_actions")
    for n in names:
        rows = rows.withColumn(n, strings(n))
    every = F.concat(*names)
    ok = (F.size(every) > 0) & ~list_repetition(every)
    return rows.select(*outputs.columns, *(F.when(ok, F.col(n)).alias(n) for n in names))


def general_summary(text: Column, topics: Column) -> Column:
    """Text-driven summary sentence: language, title (first line under 30 characters),
    topics and a note on long texts.  ``topics``: up to five words."""
    lines = text_lines(text)
    n, first, cjk = F.size(lines), F.get(lines, F.lit(0)), text.rlike(CJK)
    title = F.when(F.length(first) < 30, first)
    has = F.size(F.coalesce(topics, F.array().cast(STRINGS))) > 0
    zh = F.concat(
        F.lit("这是一张包含中文内容的图片。"), F.when(title.isNotNull(), F.concat(F.lit("主要标题为「"), title, F.lit("」。"))).otherwise(""),
        F.when(has, F.concat(F.lit("内容涉及"), F.array_join(topics, "、"), F.lit("等方面。"))).otherwise(""),
        F.when(n > 20, F.concat(F.lit("图片包含较多文本内容（共"), n.cast("string"), F.lit("条）。"))).otherwise(""),
    )
    en = F.concat(
        F.lit("This image contains text content."), F.when(title.isNotNull(), F.concat(F.lit('Main title: "'), title, F.lit('".'))).otherwise(""),
        F.when(has, F.concat(F.lit("Topics include: "), F.array_join(topics, ", "), F.lit("."))).otherwise(""),
        F.when(n > 20, F.concat(F.lit("Image contains substantial text ("), n.cast("string"), F.lit(" lines)."))).otherwise(""),
    )
    return F.when(n > 0, F.when(cjk, zh).otherwise(en))


def rich_summary(json: Column, short: int = 30, most: int = 1000) -> Column:
    """Summary of a parsed answer: its description; one under ``short`` characters is followed by
    the other fields (texts over five characters, first five entries of lists, nested objects), and
    a merged text is cut at ``most`` characters."""
    text, kind = F.from_json(json, "map<string,string>"), F.from_json(json, "map<string,variant>")
    said = F.coalesce(F.try_element_at(text, F.lit("description")), F.try_element_at(text, F.lit("summary")), F.lit(""))

    def shown(e: Column) -> Column:
        value, typ = e["value"], F.schema_of_variant(F.try_element_at(kind, e["key"]))
        listed = F.from_json(value, "array<string>")
        body = (
            F.when((typ == "STRING") & (F.length(value) > 5), value).when(typ.startswith("ARRAY") & (F.size(listed) > 0), F.array_join(F.slice(listed, 1, 5), ", ", "null"))
            .when(typ.startswith("OBJECT"), F.substring(value, 1, 200))
        )
        return F.concat(e["key"], F.lit(": "), body)

    others = F.filter(F.map_entries(text), lambda e: ~e["key"].isin("description", "summary") & e["value"].isNotNull())
    extra = F.array_join(F.array_compact(F.transform(others, shown)), ". ")
    merged = F.concat(said, F.when(said != "", ". ").otherwise(""), extra)
    merged = F.when(F.length(merged) > most, F.concat(F.substring(merged, 1, most), F.lit("..."))).otherwise(merged)
    return F.when((F.length(said) < short) & (F.coalesce(extra, F.lit("")) != ""), merged).otherwise(said)


# Marks of a scenario summary and what they become.
SCENARIO_MARKS = [("【[^】]*】\\s*", ""), ("标题：([^；]*)；?", "标题为$1。"), ("字段：([^；]*)；?", "字段包括$1。"), (r"明细共\s*(\d+)\s*行；?", "共$1行明细。"), ("；$", "。")]


def scenario_sentence(text: Column) -> Column:
    """Scenario summary as a sentence, without the marks of its template."""
    out = F.trim(text)
    for pattern, words in SCENARIO_MARKS:
        out = F.regexp_replace(out, pattern, words)
    return F.when((out == "") | out.endswith("。") | out.endswith("."), out).otherwise(F.concat(out, F.lit("。")))


def compose_result(requests: DataFrame, outputs: DataFrame, tables: Mapping[str, DataFrame] | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """One wide row per request: parsed skill results as a map, the skills that succeeded, category
    and confidence after correction by the evidence (the classifier's own stay as ``original_*`` and
    in its map entry), ``summary`` as answered and ``final_summary``, plus extra per-request columns.

    ``requests``: request_id, ocr_text (NULL: none), and optionally key_content and scenario, which
    are added to the summary.  ``outputs``: one row per (request, skill) as given by
    ``parse_model_output``.  ``evidence``: rows of ``ui_evidence`` with request_id as image_id.
    ``tables``: name -> DataFrame with request_id.

    An empty, repetitive, ungrounded, short or copied summary gives way to one of the page evidence
    or else of the text with its topics; without any, the layout skill's description stands."""
    ok = F.col("error").isNull()
    pick = lambda sk, field, typ="string": F.max(F.when(ok & (F.col("skill") == sk), F.try_variant_get(F.try_parse_json("json"), f"$.{field}", typ)))
    wide = outputs.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("skill", F.when(ok, F.col("json")).alias("json"), "error"))).alias("_all"),
        F.array_sort(F.collect_list(F.when(ok, F.col("skill")))).alias("skills"),
        pick("classify", "category").alias("original_category"), pick("classify", "confidence", "double").alias("original_confidence"),
        F.coalesce(F.max(F.when(ok & (F.col("skill") == "summary"), rich_summary(F.col("json")))), F.lit("")).alias("summary"),
        pick("layout", "description").alias("_layout"), F.coalesce(F.bool_or(~ok & (F.col("skill") == "ocr")), F.lit(False)).alias("_ocr_failed"),
    )
    rows = requests.join(wide, "request_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    if evidence is None:
        rows = rows.withColumn("page_type", F.lit(None).cast("string")).withColumn("_ui", F.lit(None).cast("string"))
    else:
        pages = ui_summary(evidence).select(F.col("image_id").alias("request_id"), "page_type", F.col("ui_summary").alias("_ui"))
        rows = rows.join(pages, "request_id", "left")
    words = key_topics(requests.where(F.col("ocr_text").isNotNull()), "request_id", "ocr_text")
    words = words.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("_topics"))
    rows = rows.join(words, "request_id", "left")
    rows = rows.withColumn("category", F.coalesce("original_category", F.lit("unknown"))).withColumn("confidence", F.coalesce("original_confidence", F.lit(0.0)))
    rows = correct_category(rows.withColumn("has_ui", F.col("page_type").isNotNull())).drop("category", "confidence")
    rows = rows.withColumnsRenamed({"new_category": "category", "new_confidence": "confidence"})
    rows = grounding(rows, "summary", "ocr_text")
    # no text to compare with: unknown, or unverified where it should have been read
    unread = F.when(F.col("_ocr_failed"), F.lit(False))
    seen = F.when(F.col("summary") != "", F.when(F.col("ocr_text").isNotNull(), F.col("grounded")).otherwise(unread))
    rows = prefer_source_text(rows.withColumn("grounded", F.coalesce(seen, F.lit(True))), "summary", "ocr_text")
    source = F.coalesce("_ui", general_summary(F.col("ocr_text"), F.col("_topics")))
    swap = F.col("prefer_source") & source.isNotNull()
    text = F.when(swap, source).otherwise(F.col("summary"))
    if "key_content" in requests.columns:
        text = F.concat(text, F.coalesce("key_content", F.lit("")))
    if "scenario" in requests.columns:
        added = scenario_sentence(F.col("scenario"))
        text = F.when(F.coalesce("scenario", F.lit("")) == "", text).when(text == "", added).otherwise(F.concat(text, F.lit(" "), added))
    text = F.when(text == "", F.coalesce("_layout", F.lit(""))).otherwise(text)
    changed = lambda new, old: F.when(F.col(new) != F.col(old), F.col(old))
    over = F.to_json(F.struct("category", "confidence", changed("category", "original_category").alias("originalCategory"), changed("confidence", "original_confidence").alias("originalConfidence")))
    over = F.from_json(over, "map<string,variant>")

    def entry(e: Column) -> Column:
        own = F.map_filter(F.from_json(e["json"], "map<string,variant>"), lambda k, _: ~F.array_contains(F.map_keys(over), k))
        value = F.when(e["skill"] == "classify", F.to_json(F.map_concat(own, over))).otherwise(e["json"])
        return F.struct(e["skill"], F.coalesce(value, F.to_json(F.struct(e["error"].alias("error"), F.lit(True).alias("partial")))))

    rows = rows.withColumn("final_summary", text).withColumn("summary_grounded", F.when(swap, True).otherwise(seen))
    rows = rows.withColumn("result", F.map_from_entries(F.transform("_all", entry)))
    for df in (tables or {}).values():
        rows = rows.join(df, "request_id", "left")
    return rows.drop("_all", "_layout", "_ocr_failed", "_ui", "_topics", "has_ui")
