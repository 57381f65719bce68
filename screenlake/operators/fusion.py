"""Union, fusion and de-duplication of detector evidence (SET-1, WIN-3..6)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from screenlake.functions import geometry as G
from screenlake.functions.semantics import constant_table
from screenlake.operators.folds import BoxIndex, fold_sorted
from screenlake.operators.spatial import touching_pairs


def union_sources(spark, sources: Mapping[str, DataFrame | None]) -> DataFrame:
    """Concatenate detector outputs; a source that failed (None) contributes nothing."""
    out = None
    for name, df in sources.items():
        if df is not None:
            tagged = df.withColumn("source", F.lit(name))
            out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source available")
    return out


def source_diagnostics(cands: DataFrame, expected: list[str]) -> DataFrame:
    """Candidate count per expected source; missing sources show as ``skipped``."""
    want = constant_table(cands.sparkSession, ["source"], [(s,) for s in expected])
    n = cands.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rows = want.join(n, "source", "left")
    return rows.select("source", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "skipped").otherwise("ok").alias("status"))


#: Optional columns of a candidate that a merge takes from its better scored side.
CARRIED = ("text", "state", "variant")


def fuse_candidates(cands: DataFrame, iou: float = 0.5, wbf: float | None = 0.7) -> DataFrame:
    """Fuse the candidates of each (image, type) in score order (ties: candidate id, then place
    and size, as ids may repeat).

    A candidate goes to the first cluster it overlaps: IoU >= ``wbf`` merges it (boxes
    weighted by score, score averaged; text, state and variant, where the input has them, of
    the better scored side), IoU >= ``iou`` only suppresses it.  A later
    cluster never changes what an earlier one absorbs, so one ordered pass is the same
    as the pairwise loop.

    Candidates are dealt by group once.  Each part of a group (see ``_parts``) is one pass; clusters
    are found through an index by place and size, so the work does not grow with the square of the part."""
    keys = ["image_id", "type"]
    limit = min(iou, wbf) if wbf is not None else iou
    carried = [c for c in CARRIED if c in cands.columns]
    rows = _parts(cands.select(*keys, "cand_id", "x", "y", "w", "h", "score", "source", *(F.col(c).cast("string").alias(c) for c in carried)), keys)
    rows = rows.select(*keys, "_part", "cand_id", "x", "y", "w", "h", "score", "source", *carried)
    vote = T.StructType([T.StructField("source", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType(
        [cands.schema[k] for k in (*keys, "cand_id")] + [T.StructField(c, T.DoubleType()) for c in (*"xywh", "score")] + [T.StructField("members", T.IntegerType())]
        + [T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("votes", T.ArrayType(vote))] + [T.StructField(c, T.StringType()) for c in carried]
    )

    def fuse(group: Iterator[tuple]) -> Iterator[tuple]:
        clusters: list[list] = []
        index = BoxIndex(limit)
        for image, kind, _, cand, x, y, w, h, score, source, *extra in group:
            box, usable = (x, y, w, h), None not in (x, y, w, h, score)
            hit = index.first(box) if usable else None
            if hit is None:
                if usable:
                    index.put(len(clusters), box)
                clusters.append([image, kind, cand, box, score, 1, {source: score}, extra])
            elif wbf is not None and hit[1] >= wbf:
                c = clusters[hit[0]]
                total = c[4] + score
                # a zero score sum has no weights; both boxes count the same then
                wa, wb = (c[4] / total, score / total) if total != 0 else (0.5, 0.5)
                c[3] = tuple(u * wa + v * wb for u, v in zip(c[3], box, strict=True))
                if score > c[4]:
                    c[7] = extra
                c[4], c[5] = total / 2, c[5] + 1
                c[6][source] = max(score, c[6].get(source, score))
                index.put(hit[0], c[3])
        for image, kind, cand, box, score, members, votes, extra in clusters:
            best = sorted(votes.items(), key=lambda v: (v[0] is None, v[0] or ""))
            yield (image, kind, cand, *box, score, members, [s for s, _ in best], best, *extra)

    return fold_sorted(rows, [*keys, "_part"], [-F.col("score"), "cand_id", "x", "y", "w", "h"], schema, fuse, dealt=True)


def _parts(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates, dealt by group, with ``_part``: groups are cut where extents are separated along y.
    A merged box stays within the hull of its members, so parts never meet."""
    group = W.partitionBy(*keys).orderBy("y")
    reach = F.max(F.greatest("y", G.box().bottom)).over(group.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(F.col("y") > F.col("_reach"), 1).otherwise(0).cast("long")
    rows = cands.repartition(*keys).withColumn("_reach", reach)
    return rows.withColumn("_part", F.sum(starts).over(group.rowsBetween(W.unboundedPreceding, 0))).drop("_reach")


def flag_conflicts(fused: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mark fused boxes that overlap a box of another type; the reason names the type of
    the first such box in result order (``ord``), nothing is dropped."""
    pairs = touching_pairs(fused.select("image_id", "ord", "type", "x", "y", "w", "h"), fused.select("image_id", "ord", "type", "x", "y", "w", "h"))
    hit = (F.col("a_type") != F.col("b_type")) & (G.iou(G.box("a_"), G.box("b_")) >= threshold)
    first = pairs.where(hit).groupBy("image_id", F.col("a_ord").alias("ord")).agg(F.min_by("b_type", "b_ord").alias("_t"))
    rows = fused.join(first, ["image_id", "ord"], "left")
    return rows.withColumn("conflict_reason", F.when(F.col("_t").isNotNull(), F.concat(F.lit("cross-type-overlap:"), "_t"))).drop("_t")


def dedupe_boxes(df: DataFrame, group: str, min_iou: float = 0.8) -> DataFrame:
    """Per (image, ``group``) in ``ord`` order: an item that overlaps the current holder of
    an earlier slot with IoU >= ``min_iou`` replaces it if its score is higher, and is
    dropped otherwise.  Keeps the slot order in ``slot``."""
    keys = ["image_id", group]
    ok = G.valid_box(G.box()) & F.col("score").isNotNull() & ~F.isnan("score")
    parts = _parts(df.where(ok), keys)
    # the whole row travels through the fold: a join back on ord would multiply repeated rows
    rows = parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "_part"))), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(df.columns)))
    schema = T.StructType([*df.schema.fields, T.StructField("slot", df.schema["ord"].dataType)])
    at = {c: 3 + i for i, c in enumerate(df.columns)}
    order = [f"_v{at[c] - 3}" for c in ("ord", "x", "y", "w", "h")]

    def keep(group: Iterator[tuple]) -> Iterator[tuple]:
        slots: list[list] = []
        index = BoxIndex(min_iou)
        for row in group:
            box, score = tuple(row[at[c]] for c in "xywh"), row[at["score"]]
            hit = index.first(box)
            if hit is None:
                index.put(len(slots), box)
                slots.append([score, row, row[at["ord"]]])
            elif score > slots[hit[0]][0]:
                slots[hit[0]][:2] = score, row
                index.put(hit[0], box)
        for _, row, slot in slots:
            yield (*row[3:], slot)

    return fold_sorted(rows, ["_k0", "_k1", "_k2"], order, schema, keep, dealt=True)


def dedupe_seeds(seeds: DataFrame) -> DataFrame:
    """Keep seeds anchored first, then smallest first; drop a seed that has IoU >= 0.8
    with a kept one or is 80 % contained at a similar scale (area ratio >= 0.2).

    ``seeds``: image_id, cand_id, anchored, box; rows are told apart by their rank, as ids may
    repeat.  Kept seeds never change, so one pass over the clashes of an image in the order of
    their later seed settles them: by then it is known which of the earlier ones were dropped.
    Seeds are dealt by image once and joined there; the pass holds the dropped seeds of an image."""
    from screenlake.session import cut_lineage

    rank = F.struct((~F.col("anchored")).alias("a"), G.box().area.alias("b"), F.col("cand_id").alias("c"))
    rows = seeds.select("image_id", "cand_id", "anchored", "x", "y", "w", "h").repartition("image_id")
    rows = rows.select("image_id", "x", "y", "w", "h", rank.alias("o"))
    pairs = touching_pairs(rows, rows).where(F.col("b_o") < F.col("a_o"))
    a, b = G.box("a_"), G.box("b_")
    small, large = F.least(a.area, b.area), F.greatest(a.area, b.area)
    clash = (G.iou(a, b) >= 0.8) | ((small > 0) & (small / large >= 0.2) & (G.intersection_area(a, b) / small >= 0.8))
    edges = cut_lineage(pairs.where(clash).select("image_id", F.col("a_o").alias("later"), F.col("b_o").alias("earlier")), dealt=True)
    schema = T.StructType([edges.schema["image_id"], edges.schema["later"]])

    def place(o: dict) -> tuple:
        return o["a"], None if o["b"] != o["b"] else o["b"], o["c"]

    def settle(group: Iterator[tuple]) -> Iterator[tuple]:
        gone: set[tuple] = set()
        for image, later, earlier in group:
            at = place(later)
            if at not in gone and place(earlier) not in gone:
                gone.add(at)
                yield image, later

    dropped = fold_sorted(edges, ["image_id"], ["later", "earlier"], schema, settle)
    return seeds.withColumn("later", rank).join(dropped, ["image_id", "later"], "left_anti").drop("later")
