"""Plug-in points for user functions (UDF-1..4): the only places with Python workers.

A user function sees one Arrow batch of rows at a time; loading a model is left to a
factory that runs once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from screenlake.operators.outputs import parse_model_output
from screenlake.session import cut_lineage


def detect_with(images: DataFrame, factory: Callable[[], Callable[[dict], list[dict]]], schema: str, key: str = "image_id") -> DataFrame:
    """Run a detector or OCR function over an image table.

    ``factory()`` returns ``fn(row) -> list of result dicts``.  A row whose call raises
    becomes one row with ``error``; the others carry the result columns of ``schema``."""
    # parse the result schema once, on the driver
    fields = images.sparkSession.createDataFrame([], schema).schema.fields
    key_field = images.schema[key]
    out_schema = T.StructType([key_field, T.StructField("ord", T.IntegerType()), *fields, T.StructField("error", T.StringType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                try:
                    for i, result in enumerate(fn(record)):
                        rows.append((record[key], i, *(result.get(n) for n in names), None))
                except Exception as e:  # one bad image must not fail the job
                    rows.append((record[key], 0, *(None for _ in names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "ord", *names, "error"])

    return images.mapInPandas(run, out_schema)


def answers_of(fn: Callable[[list[str]], list[str]], asked: list[str]) -> Iterator[tuple[str, str | None, str | None]]:
    """(prompt, answer, error) of each prompt; a failed call is halved until single prompts fail."""
    try:
        texts = fn(asked)
        if len(texts) != len(asked):
            raise ValueError(f"{len(texts)} answers to {len(asked)} prompts")
    except Exception as e:  # one bad prompt must not fail its batch
        if len(asked) == 1:
            yield asked[0], None, f"{type(e).__name__}: {e}"
            return
        yield from answers_of(fn, asked[: len(asked) // 2])
        yield from answers_of(fn, asked[len(asked) // 2 :])
        return
    yield from zip(asked, texts, [None] * len(asked), strict=True)


def _stored(prompts: DataFrame, folder: str | None) -> DataFrame | None:
    """Answers of earlier runs (prompt_hash, raw_text), or None."""
    if folder is None:
        return None
    try:
        rows = prompts.sparkSession.read.schema("prompt_hash string, raw_text string").parquet(folder)
    except AnalysisException:  # nothing stored yet
        return None
    # a task that ran twice may have stored two answers
    return rows.groupBy("prompt_hash").agg(F.min("raw_text").alias("raw_text"))


def infer_with(prompts: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]], max_retry: int = 1, answers: str | None = None) -> DataFrame:
    """Batch model calls with repair and re-prompting of failures only.

    ``prompts``: request_id, skill, prompt.  ``factory()`` returns ``fn(list of prompts) ->
    list of texts``.  Equal prompts are sent once.  A call that raises is halved, so only the
    prompts that fail on their own get its error.  With ``answers``, a folder, answers are kept
    under the hash of their prompt and a repeated run asks only what has none.  Returns request_id,
    skill, raw_text, json, repairs, error, attempt."""
    hint = {
        "JSON parse failed": "\n\nIMPORTANT: Your previous response was not valid JSON. Output ONLY raw JSON, no markdown, no explanation.",
    }
    ask_schema = "prompt string, raw_text string, call_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for batch in batches:
            yield pd.DataFrame(list(answers_of(fn, batch["prompt"].tolist())) if len(batch) else [], columns=["prompt", "raw_text", "call_error"])

    def ask(todo: DataFrame) -> DataFrame:
        asked = todo.select("prompt", F.sha2("prompt", 256).alias("prompt_hash")).distinct()
        known = _stored(prompts, answers)
        if known is None:
            fresh = cut_lineage(asked.select("prompt").mapInPandas(run, ask_schema))
            rows = fresh
        else:
            known = cut_lineage(asked.join(known, "prompt_hash"))
            fresh = cut_lineage(asked.join(known, "prompt_hash", "left_anti").select("prompt").mapInPandas(run, ask_schema))
            rows = fresh.unionByName(known.select("prompt", "raw_text", F.lit(None).cast("string").alias("call_error")))
        if answers is not None:
            fresh.where("call_error IS NULL").select(F.sha2("prompt", 256).alias("prompt_hash"), "raw_text").write.mode("append").parquet(answers)
        return rows

    todo, done = prompts.select("request_id", "skill", "prompt"), None
    for attempt in range(max_retry + 1):
        raw = todo.join(ask(todo), "prompt")
        parsed = parse_model_output(raw.withColumn("raw_text", F.coalesce("raw_text", F.lit("")))).withColumn("attempt", F.lit(attempt))
        parsed = parsed.withColumn("error", F.coalesce("call_error", "error")).withColumn("json", F.when(F.col("error").isNull(), F.col("json")))
        parsed = cut_lineage(parsed.drop("call_error"))
        last = attempt == max_retry
        good = parsed if last else parsed.where(F.col("error").isNull())
        part = good.drop("prompt")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        failed = parsed.where(F.col("error").isNotNull())
        if failed.isEmpty():
            break
        field = F.concat(
            F.lit('\n\nIMPORTANT: Your previous response was missing the required field "'), F.replace("error", F.lit("missing required field: "), F.lit("")),
            F.lit('". Include ALL required fields.'),
        )
        more = (
            F.when(F.col("error").contains("JSON parse failed"), F.lit(hint["JSON parse failed"])).when(F.col("error").contains("missing required field"), field)
            .otherwise("\n\nIMPORTANT: Your previous response was invalid. Please output valid JSON only.")
        )
        todo = failed.select("request_id", "skill", F.concat("prompt", more).alias("prompt"))
    return done


def export_with(nodes: DataFrame, fn: Callable[[pd.DataFrame], str], key: str = "image_id") -> DataFrame:
    """A user exporter: the nodes of one image in, one document out.  The document is one
    row by definition, so an image has to fit a task here."""
    field = nodes.schema[key]
    schema = T.StructType([field, T.StructField("document", T.StringType()), T.StructField("error", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return pd.DataFrame({key: [pdf[key].iloc[0]], "document": [fn(pdf)], "error": [None]})
        except Exception as e:
            return pd.DataFrame({key: [pdf[key].iloc[0]], "document": [None], "error": [f"{type(e).__name__}: {e}"]})

    return nodes.groupBy(key).applyInPandas(run, schema)


def _text(value) -> str | None:
    """A JSON value as the text that a variant gives."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _number(value) -> float | None:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


class TreeNodes:
    """Table function: the nodes of one nested JSON tree in pre-order.  A stack of the nodes still
    to visit is all that it holds beside the tree; rows leave as they are reached."""

    exclude = False  # nodes that are semantic-only

    def eval(self, tree: str | None):
        try:
            root = json.loads(tree or "")
        except ValueError:
            return
        stack = [(root, None, 0, "")]
        while stack:
            node, parent, depth, path = stack.pop()
            node = node if isinstance(node, dict) else {}
            box, props = node.get("bbox"), node.get("props")
            box, render = box if isinstance(box, dict) else {}, props.get("render") if isinstance(props, dict) else None
            mode = _text(render.get("mode")) if isinstance(render, dict) else None
            name, kind = _text(node.get("id")), _text(node.get("type"))
            if kind != "page" and not (self.exclude and mode == "semantic-only"):
                yield name, parent, depth, path, kind, *(_number(box.get(c)) for c in "xywh"), _text(node.get("text")), mode
            children = node.get("children")
            if isinstance(children, list):
                stack += [(c, name, depth + 1, f"{path}/{i:010d}") for i, c in reversed(list(enumerate(children)))]


class RenderedNodes(TreeNodes):
    exclude = True


TREE_ROWS = "node_id string, parent_id string, depth int, path string, type string, x double, y double, w double, h double, text string, render_mode string"


def flatten_tree_rows(df: DataFrame, key: str, json_col: str, exclude_semantic_only: bool = False) -> DataFrame:
    """Node rows of nested JSON trees, as ``annotations.flatten_tree`` gives them level by level,
    from a table function that walks each tree once: for trees that fit a task, in one pass."""
    function = F.udtf(RenderedNodes if exclude_semantic_only else TreeNodes, returnType=TREE_ROWS)
    return df.select(key, F.col(json_col).alias("_tree")).lateralJoin(function(F.col("_tree").outer())).drop("_tree")
