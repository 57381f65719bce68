"""Rule tables over requests and texts (PRJ-2..4, JOIN-16, JOIN-17, TXT-1..6, TXT-26, TXT-27, WIN-22).

Rule lists are small fixed tables.  They are compiled into one CASE expression, so a
corpus is tagged in the scan itself: no join, no shuffle, no Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from screenlake.functions import rulebook as RB
from screenlake.functions.semantics import ascii_words, round_half_up


def words(values: Sequence[str]) -> str:
    """Alternation that matches any of the literal words."""
    return "|".join(re.escape(v).replace(r"\ ", " ") for v in values)


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule whose pattern occurs in ``text``."""
    out = None
    for label, pattern in rules:
        out = (F if out is None else out).when(text.rlike(ascii_words(pattern)), F.lit(label))
    return out.otherwise(F.lit(default).cast("string"))


def tag_first_match(df: DataFrame, text: str, rules: Sequence[tuple[str, str]], default: str | None, name: str = "tag") -> DataFrame:
    return df.withColumn(name, first_match(F.lower(text), rules, default))


def tag_groups(items: DataFrame, keys: Sequence[str], text: str, rules: Sequence[tuple[str, str]], default: str | None, name: str = "tag") -> DataFrame:
    """The best rule hit by any item of a group.  Each item yields the priority of its
    first hit and the group takes the minimum, so it combines map-side and no text of a
    group is ever put together."""
    level = None
    for i, (_, pattern) in enumerate(rules):
        level = (F if level is None else level).when(F.lower(text).rlike(ascii_words(pattern)), F.lit(i))
    best = items.groupBy(*keys).agg(F.min(level).alias("_p"))
    label = None
    for i, (tag, _) in enumerate(rules):
        label = (F if label is None else label).when(F.col("_p") == i, F.lit(tag))
    return best.select(*keys, label.otherwise(F.lit(default).cast("string")).alias(name))


# --- requests -----------------------------------------------------------------------
def intent_skills(intent: Column) -> Column:
    lower, out = F.lower(intent), None
    for keys, skills in RB.INTENT_SKILLS:
        out = (F if out is None else out).when(lower.rlike(words(keys)), F.array(*map(F.lit, skills)))
    return out.otherwise(F.array(*map(F.lit, RB.DEFAULT_SKILLS)))


def route_intent(requests: DataFrame) -> DataFrame:
    """Skills of a request: the requested known ones, else from the intent; intents about
    a target drop the summary and add OCR; a remaining summary needs OCR.

    ``requests``: request_id, intent, requested (ARRAY<STRING> or NULL), has_target."""
    lower = F.lower("intent")
    known = F.filter("requested", lambda s: s.isin(RB.KNOWN_SKILLS))
    base = F.when(F.size(F.coalesce("requested", F.array().cast("array<string>"))) > 0, F.array(*map(F.lit, RB.DEFAULT_SKILLS))).otherwise(intent_skills(F.col("intent")))
    skip = F.col("has_target") | lower.rlike(words(RB.SKIP_SUMMARY_WORDS))
    need = F.col("has_target") | lower.rlike(words(RB.NEED_OCR_WORDS))
    trimmed = F.when(skip, F.array_remove(base, "summary")).otherwise(base)
    grown = F.when(need & ~F.array_contains(trimmed, "ocr"), F.array_append(trimmed, "ocr")).otherwise(trimmed)
    skills = F.when(F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0, known).otherwise(grown)
    rows = requests.withColumn("skills", skills)
    final = F.when(F.array_contains("skills", "summary") & ~F.array_contains("skills", "ocr"), F.array_append("skills", "ocr"))
    return rows.withColumn("skills", final.otherwise(F.col("skills")))


def detect_scenario(requests: DataFrame) -> DataFrame:
    """First scenario whose words or categories fit; annotations or a target mean
    requirement, else general.  Needs intent, category, has_boxes, has_target."""
    lower, out, label = F.lower("intent"), None, None
    for name, text, keys, cats in RB.SCENARIOS:
        hit = lower.rlike(words(keys)) | F.coalesce(F.col("category").isin(cats), F.lit(False))
        out = (F if out is None else out).when(hit, F.lit(name))
        label = (F if label is None else label).when(hit, F.lit(text))
    marked = F.col("has_boxes") | F.col("has_target")
    out = out.when(marked, F.lit("requirement")).otherwise(F.lit("general"))
    label = label.when(marked, F.lit("需求分析")).otherwise(F.lit("通用分析"))
    rows = requests.withColumn("scenario", out).withColumn("scenario_label", label)
    return rows.withColumn("skip_summary", F.col("scenario") != "general")


def wants_key_content(requests: DataFrame) -> DataFrame:
    """A target, marker words in the intent, or boxes together with OCR or summary."""
    content = F.arrays_overlap("skills", F.array(F.lit("ocr"), F.lit("summary")))
    want = F.col("has_target") | F.col("intent").rlike(RB.MARKED_INTENT) | (F.col("has_boxes") & content)
    return requests.withColumn("wants_key_content", want)


def requested_color(requests: DataFrame) -> DataFrame:
    """The alias of the target colour, else the colour named in the intent."""
    alias, lower = None, F.lower("target_color")
    for name, values in RB.COLOR_ALIASES:
        alias = (F if alias is None else alias).when(lower.isin(values), F.lit(name))
    return requests.withColumn("color", F.coalesce(alias, first_match(F.lower("intent"), RB.COLOR_INTENT)))


def refine_scene(text: Column) -> Column:
    return first_match(F.lower(text), RB.SCENE_WORDS)


def document_type(text: Column, category: Column) -> Column:
    lower = F.lower(text)
    more = F.when(category == "document", first_match(lower, RB.DOCUMENT_TYPES_IF_DOCUMENT))
    return F.coalesce(first_match(lower, RB.DOCUMENT_TYPES), more, F.lit("generic"))


def chart_type(text: Column, category: Column) -> Column:
    lower = F.lower(text)
    fallback = F.when(category == "chart", F.when(lower.rlike("%|百分比|占比"), "pie").otherwise("bar"))
    return F.coalesce(
        F.when(category.isin("dashboard", "table"), category), first_match(lower, RB.CHART_TYPES), fallback, F.lit("unknown")
    )


def code_language(text: Column) -> Column:
    return first_match(F.lower(text), RB.CODE_LANGUAGES, "unknown")


def scene_vote(requests: DataFrame) -> DataFrame:
    """Signals classify 0.7, scenario 0.9, hint 0.8, keyword 0.9; the best confidence per
    scene counts; the top scene wins, earlier signals first.

    ``requests``: request_id, category, scenario, scene_hint, text.  The four signals of a
    request are an array in its own row, so no rows are spread or regrouped."""
    def lookup(key: Column, table: Sequence[tuple[str, str]]) -> Column:
        out = None
        for k, v in table:
            out = (F if out is None else out).when(key == k, F.lit(v))
        return out

    hint = F.lower(F.trim("scene_hint"))
    hint_scene = None
    for s in RB.HINT_SCENES:
        hint_scene = (F if hint_scene is None else hint_scene).when(hint.contains(s), F.lit(s))
    word = refine_scene(F.col("text"))

    def signal(i: int, scene: Column, conf: float, reason: Column) -> Column:
        return F.struct(F.lit(-conf).alias("o"), F.lit(i).alias("i"), scene.alias("scene"), F.lit(conf).alias("confidence"), reason.alias("reason"))

    # the order of equal confidences: the position at which a scene was first voted for
    signals = F.array(
        signal(0, lookup(F.col("category"), RB.CLASS_SCENE), 0.7, F.concat(F.lit("classify="), "category")),
        signal(1, lookup(F.col("scenario"), RB.SCENARIO_SCENE), 0.9, F.concat(F.lit("scenario="), "scenario")),
        signal(2, F.when(hint != "", hint_scene), 0.8, F.concat(F.lit("scene-hint="), "scene_hint")),
        signal(3, word, 0.9, F.concat(word, F.lit(" keywords"))),
    )
    rows = requests.withColumn("_s", F.filter(signals, lambda s: s["scene"].isNotNull()))

    def first_seen(s: Column) -> Column:
        same = F.filter("_s", lambda o: o["scene"] == s["scene"])
        best = F.element_at(F.array_sort(same), 1)
        return F.struct(best["o"].alias("o"), F.array_min(F.transform(same, lambda o: o["i"])).alias("i"), s["scene"].alias("scene"), best["confidence"].alias("confidence"), best["reason"].alias("reason"))

    ranked = F.array_sort(F.array_distinct(F.transform("_s", first_seen)))
    rows = rows.withColumn("_r", ranked)
    top = F.when(F.size("_r") > 0, F.element_at("_r", 1))
    return rows.select(
        *requests.columns, F.coalesce(top["scene"], F.lit("other")).alias("scene"),
        F.coalesce(top["confidence"], F.lit(0.0)).alias("scene_confidence"),
        F.coalesce(top["reason"], F.lit("no signal")).alias("scene_reason"),
        F.array_join(F.transform("_r", lambda r: r["scene"]), ",").alias("detected"),
    )


def next_actions(scene: Column) -> Column:
    out = None
    for name, acts in RB.NEXT_ACTIONS:
        out = (F if out is None else out).when(scene == name, F.array(*map(F.lit, acts)))
    return out.otherwise(F.array(*map(F.lit, RB.DEFAULT_ACTIONS)))


def _condition(df: DataFrame, field: str, cond: str) -> Column:
    m = re.match(r"^(>=|<=|>|<|==|!=)\s*(.+)$", str(cond).strip())
    actual = F.col(field)
    if not m:
        return F.coalesce(actual.cast("string") == str(cond).strip(), F.lit(False))
    op, raw = m.groups()
    number = float(raw) if re.match(r"^-?\d+(\.\d+)?$", raw.strip()) else None
    value = F.expr(f"try_cast(`{field}` AS DOUBLE)")
    if op in (">", "<", ">=", "<="):
        if number is None:
            return F.lit(False)
        test = {">": value > number, "<": value < number, ">=": value >= number, "<=": value <= number}[op]
        return F.coalesce(test, F.lit(False))
    same = F.coalesce(actual.cast("string") == raw.strip(), F.lit(False))
    if number is not None:
        same = same | F.coalesce(value == number, F.lit(False))
    return same if op == "==" else actual.isNotNull() & ~same


def apply_rule_table(df: DataFrame, rules: Sequence[tuple] = RB.POLICIES) -> DataFrame:
    """Decision table (name, priority, {field: condition}, action, override): the rule of
    highest priority whose conditions all hold decides; no rule means allow.  A field
    that does not exist never holds."""
    name = action = override = None
    for rule, _, when, act, over in sorted(rules, key=lambda r: -r[1]):
        hit = F.lit(True)
        for field, cond in when.items():
            hit = hit & (_condition(df, field, cond) if field in df.columns else F.lit(False))
        name = (F if name is None else name).when(hit, F.lit(rule))
        action = (F if action is None else action).when(hit, F.lit(act))
        override = (F if override is None else override).when(hit, F.lit(over))
    return df.withColumn("rule", name).withColumn("action", F.coalesce(action, F.lit("allow"))).withColumn("override", override)


@dataclass(frozen=True)
class Provider:
    name: str
    runtime: str
    quality: str
    min_memory_mb: int
    gpu: bool
    skills: tuple[str, ...]


def choose_candidate(requests: DataFrame, providers: Sequence[Provider]) -> DataFrame:
    """Pick a provider: feasible ones (memory, GPU, all skills) in the given order, then
    the explicit one, the high-quality one if asked, an exact skill fit, a fast one, the
    first.  ``requests``: skills, quality, provider, memory_mb, has_gpu."""
    table = F.array(*(
        F.struct(
            F.lit(p.name).alias("name"), F.lit(p.runtime).alias("runtime"), F.lit(p.quality).alias("quality"),
            F.lit(p.min_memory_mb).alias("mem"), F.lit(p.gpu).alias("gpu"), F.array(*map(F.lit, p.skills)).alias("skills"),
        )
        for p in providers
    ))
    fits = F.filter(
        table,
        lambda p: (F.col("memory_mb") >= p["mem"]) & (~p["gpu"] | F.col("has_gpu")) & (F.size(F.array_except("skills", p["skills"])) == 0),
    )
    rows = requests.withColumn("_f", fits)

    def first(cond) -> Column:
        return F.get(F.filter("_f", cond), F.lit(0))

    exact = first(lambda p: (F.size("skills") > 0) & (F.size(p["skills"]) == F.size("skills")) & (F.size(F.array_except("skills", p["skills"])) == 0))
    high = F.when(F.col("quality") == "high", first(lambda p: p["quality"] == "high"))
    pick = F.when(F.col("provider").isNotNull(), first(lambda p: p["name"] == F.col("provider"))).otherwise(
        F.coalesce(high, exact, first(lambda p: p["quality"] == "fast"), F.get("_f", F.lit(0)))
    )
    rows = rows.withColumn("_p", pick)
    error = F.when(F.size("_f") == 0, "no provider satisfies the requested skills and resources").when(
        F.col("_p").isNull(), F.concat(F.lit("requested provider is unavailable or infeasible: "), "provider")
    )
    return rows.select(*requests.columns, F.col("_p.name").alias("chosen"), F.col("_p.runtime").alias("chosen_runtime"), error.alias("error"))


# --- prompts ------------------------------------------------------------------------
def build_prompts(requests: DataFrame, templates: Mapping[str, str], ocr_chars: int | None = None) -> DataFrame:
    """Prompt per (request, skill): ``{{name}}`` substitution, focus, clipped OCR context for
    the summary and a hint when the last attempt failed.

    ``requests``: request_id, skill, intent, focus, width, height, format, complexity,
    ocr_text, last_error.  With ``ocr_chars``, longer OCR text is
    clipped in the prompt, with a note of its length."""
    prompt = None
    for skill, text in templates.items():
        prompt = (F if prompt is None else prompt).when(F.col("skill") == skill, F.lit(text))
    focus = F.coalesce("focus", F.lit(""))
    for mark, value in (
        ("{{intent}}", F.col("intent")), ("{{focus}}", focus), ("{{metadata.width}}", F.col("width").cast("string")),
        ("{{metadata.height}}", F.col("height").cast("string")), ("{{metadata.format}}", F.col("format")),
        ("{{metadata.complexity}}", F.col("complexity")),
    ):
        prompt = F.replace(prompt, F.lit(mark), value)
    rows = requests.withColumn("_p", prompt)
    with_focus = F.when((focus != "") & ~F.col("_p").contains(focus), F.concat("_p", F.lit("\n\nFocus on: "), focus)).otherwise(F.col("_p"))
    ocr = clipped = F.coalesce("ocr_text", F.lit(""))
    if ocr_chars is not None:
        note = F.concat(F.substring(ocr, 1, ocr_chars), F.lit("\n...[truncated, OCR total "), F.length(ocr).cast("string"), F.lit(" chars]"))
        clipped = F.when(F.length(ocr) > ocr_chars, note).otherwise(ocr)
    context = F.when((F.col("skill") == "summary") & (ocr != ""), F.concat(F.lit("\n\nOCR context from a dedicated OCR provider:\n"), clipped)).otherwise("")
    err = F.col("last_error")
    hint = (
        F.when(err.isNull(), "")
        .when(err.contains("JSON parse failed"), "\n\nIMPORTANT: Your previous response was not valid JSON. Output ONLY raw JSON, no markdown, no explanation.")
        .when(
            err.contains("missing required field"),
            F.concat(
                F.lit('\n\nIMPORTANT: Your previous response was missing the required field "'),
                F.replace(err, F.lit("missing required field: "), F.lit("")), F.lit('". Include ALL required fields.'),
            ),
        )
        .otherwise("\n\nIMPORTANT: Your previous response was invalid. Please output valid JSON only.")
    )
    return rows.select("request_id", "skill", F.concat(with_focus, context, hint).alias("prompt"))


def quality_suggestion(requests: DataFrame) -> DataFrame:
    """Advise a high-quality retry for dense text (> 1500 chars) or > 2 MP images."""
    dense = F.when(F.length("ocr_text") > 1500, "text-dense")
    large = F.when(F.col("width").cast("double") * F.col("height") > 2_000_000, "large-image")
    signals = F.array_compact(F.array(dense, large))
    text = F.concat(F.lit("Complex image detected ("), F.array_join(signals, ", "), F.lit(').'))
    ask = F.coalesce(F.col("quality") != "high", F.lit(True)) & (F.size(signals) > 0)
    return requests.withColumn("suggestion", F.when(ask, F.concat(text, F.lit(' Retry with options.quality="high" for more accurate results.'))))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(ascii_words(pattern)))


def infer_category(text: Column) -> Column:
    """Category named by evidence text with its confidence (NULL without evidence).

    Counts follow a non-global match: the whole match plus its groups."""
    lower = F.lower(text)
    mood, figure = _count(lower, RB.MOOD_WORDS), _count(lower, RB.FIGURE_WORDS)
    out = F.when(
        (mood > 0) & (figure > 0),
        F.struct(F.lit("illustration").alias("category"), F.least(F.lit(0.65), 0.5 + F.least((mood + figure) * 0.03, F.lit(0.15))).alias("confidence")),
    )
    n = len(RB.CATEGORY_WORDS)
    for i, (name, pattern) in enumerate(RB.CATEGORY_WORDS):
        groups = 1 + len(re.findall(r"(?<!\\)\((?!\?)", pattern))
        conf = min(0.5 + min(groups * 0.05, 0.2) + (n - i) * 0.02, 0.75)
        out = out.when(lower.rlike(ascii_words(pattern)), F.struct(F.lit(name).alias("category"), F.lit(conf).alias("confidence")))
    return out


def correct_category(outputs: DataFrame) -> DataFrame:
    """Classifier correction from evidence.

    ``outputs``: category, confidence, summary, ocr_text, has_ui (page evidence found).
    UI evidence turns vague classes into ui; else evidence that names an excluded class
    replaces the class; evidence for the same class keeps it; anything else demotes."""
    evidence = F.concat_ws("\n", F.when(F.col("summary") != "", F.col("summary")), F.when(F.col("ocr_text") != "", F.col("ocr_text")))
    rows = outputs.withColumn("_e", evidence).withColumn("_i", infer_category(F.col("_e")))
    cat, conf, inf = F.col("category"), F.col("confidence"), F.col("_i.category")
    excluded = hit = None
    for name, others in RB.EXCLUSIONS:
        excluded = (F if excluded is None else excluded).when(cat == name, F.lit(True))
        hit = (F if hit is None else hit).when(cat == name, F.coalesce(inf.isin(others), F.lit(False)))
    applies = F.coalesce(excluded, F.lit(False)) & (F.col("_e") != "")
    swap = applies & F.coalesce(hit, F.lit(False))
    ui = F.col("has_ui") & cat.isin("document", "other", "unknown", "screenshot")
    same = applies & F.coalesce(inf == cat, F.lit(False))
    new_cat = F.when(ui, "ui").when(swap, inf).otherwise(cat)
    new_conf = (
        F.when(ui, F.greatest(conf, F.lit(0.75))).when(swap, F.col("_i.confidence"))
        .when(same, F.when(conf == 0.7, 0.65).otherwise(conf))
        .when(applies & (conf >= 0.7), 0.5)
        .when(~applies & (cat == "document") & (F.col("summary") == "") & (conf >= 0.7), 0.5)
        .otherwise(conf)
    )
    return rows.select(*outputs.columns, new_cat.alias("new_category"), new_conf.alias("new_confidence"))


# --- colours ------------------------------------------------------------------------
def color_class(samples: DataFrame) -> DataFrame:
    """Colour preset of every sample (first preset wins, else ``none``)."""
    out = None
    for name, cond in RB.COLOR_PRESETS:
        out = (F if out is None else out).when(F.expr(cond), F.lit(name))
    return samples.withColumn("color", out.otherwise(F.lit("none")))


def annotation_stats(samples: DataFrame, boxes: DataFrame, border: int = 5) -> DataFrame:
    """Fill, hollow and border-density ratios and the confidence of coloured boxes.

    ``samples``: image_id, px, py, color.  ``boxes``: image_id, region_id, color, x1..y2."""
    from screenlake.operators.spatial import points_in_boxes

    shape = boxes.select("image_id", "region_id", "color", "x1", "y1", "x2", "y2", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    pairs = points_in_boxes(samples.where(F.col("color") != "none"), shape, F.col("px"), F.col("py"), ["image_id", "color"])
    px, py = F.col("a_px"), F.col("a_py")
    inside = (px >= F.col("b_x1")) & (px < F.col("b_x2")) & (py >= F.col("b_y1")) & (py < F.col("b_y2"))
    edge = (px - F.col("b_x1") < border) | (F.col("b_x2") - px <= border) | (py - F.col("b_y1") < border) | (F.col("b_y2") - py <= border)
    n = pairs.where(inside).groupBy("image_id", F.col("b_region_id").alias("region_id")).agg(
        F.count(F.lit(1)).alias("colored"), F.count(F.when(edge, 1)).alias("edge_colored")
    )
    rows = boxes.join(n, ["image_id", "region_id"], "left").fillna(0, ["colored", "edge_colored"])
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area = w * h
    inner = F.greatest(F.lit(0), w - 2 * border) * F.greatest(F.lit(0), h - 2 * border)
    rows = rows.withColumn("fill", F.when(area > 0, F.col("colored") / area).otherwise(1.0))
    rows = rows.withColumn("hollow", F.when(F.col("colored") > 0, F.col("edge_colored") / F.col("colored")).otherwise(0.0))
    rows = rows.withColumn("density", F.when(area - inner > 0, F.col("edge_colored") / (area - inner)).otherwise(0.0))
    score = F.greatest(F.lit(0.0), 1 - F.col("fill") * 4) * 0.4 + F.col("hollow") * 0.4 + F.least(F.col("density") / 0.5, F.lit(1.0)) * 0.2
    keep = (w >= 80) & (h >= 60) & (F.col("density") >= 0.12) & (F.col("fill") <= 0.25) & (F.col("hollow") >= 0.45)
    return rows.withColumn("confidence", F.least(score, F.lit(0.99))).withColumn("likely", keep)


def overall_confidence(confidence: Column, ocr: Column) -> Column:
    return round_half_up(F.when(confidence > 0, F.least(F.lit(1.0), (confidence + ocr) / 2)).otherwise(ocr), 2)
