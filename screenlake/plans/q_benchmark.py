"""The benchmark as a user runs it: annotations, findings, eligibility, matching, means."""

from pyspark.sql import functions as F

from screenlake.operators import benchmark as B, review as R
from screenlake.plans.q_geometry import GT_FOLD, pred_of, r6
from screenlake.plans.q_review import ELIG, FINDINGS, actions, findings, headers
from screenlake.plans.q_sources import REASONS, SIZES, annotation_json
from screenlake.plans.registry import query
from screenlake.session import cut_lineage

# images: those of the boxes, and one without boxes for each user; every tenth has no annotation
IMAGES = "(SELECT image_id FROM pages_meta UNION ALL SELECT DISTINCT 10000000 + user_id FROM events)"
FLOW = (
    "WITH RECURSIVE " + (FINDINGS + ELIG).strip().removeprefix("WITH ") + f""",
notes AS (SELECT m.image_id, {REASONS} AS error FROM {SIZES} m WHERE m.image_id % 10 <> 3),
imgs AS (SELECT i.image_id, n.image_id IS NOT NULL AS annotated, n.error FROM {IMAGES} i LEFT JOIN notes n ON n.image_id = i.image_id
  {{join}}),
fgt AS (SELECT b.image_id, b.node_id AS box_id, b.n, b.type, b.x, b.y, b.w, b.h FROM tree_nodes b JOIN imgs i ON i.image_id = b.image_id WHERE i.annotated AND i.error IS NULL),
fpr AS (SELECT b.*, i.annotated FROM preds b JOIN imgs i ON i.image_id = b.image_id WHERE i.error IS NULL)"""
    + ",\n" + GT_FOLD.strip().removeprefix("WITH RECURSIVE ").replace("FROM boxes a JOIN preds b ON", "FROM fgt a JOIN fpr b ON b.annotated AND").replace("ORDER BY gt_id, iou", "ORDER BY gt_n, iou")
    .replace("a.box_id AS gt_id,", "a.box_id AS gt_id, a.n AS gt_n,").replace("SELECT image_id, type, gt_id, pred_id, iou, row_number()", "SELECT image_id, type, gt_id, gt_n, pred_id, iou, row_number()")
    + """,
fc AS (SELECT i.image_id, i.error, i.annotated, (SELECT count(*) FROM fgt g WHERE g.image_id = i.image_id) AS gt_count, (SELECT count(*) FROM fpr p WHERE p.image_id = i.image_id) AS pred_count,
    (SELECT count(*) FROM matches m WHERE m.image_id = i.image_id) AS matched, (SELECT coalesce(sum(w * h), 0) FROM fpr p WHERE p.image_id = i.image_id) AS area FROM imgs i),
fr AS (SELECT *, CASE WHEN gt_count > 0 THEN matched / CAST(gt_count AS DOUBLE) ELSE 0 END AS recall, CASE WHEN pred_count > 0 THEN matched / CAST(pred_count AS DOUBLE) ELSE 0 END AS prec,
    least(1.0, area / (420 * 820)) AS coverage, error IS NULL AND (annotated OR area > 0) AS scored FROM fc),
fs AS (SELECT *, CASE WHEN recall + prec > 0 THEN 2 * recall * prec / (recall + prec) ELSE 0 END AS f1 FROM fr),
ft AS (SELECT type, avg(CASE WHEN m > 0 THEN 2.0 * m / (g + p) ELSE 0 END) AS f1 FROM (
    SELECT image_id, type, sum(g) AS g, sum(p) AS p, sum(m) AS m FROM (
      SELECT image_id, type, 1 AS g, 0 AS p, 0 AS m FROM fgt UNION ALL SELECT image_id, type, 0, 1, 0 FROM fpr WHERE annotated UNION ALL SELECT image_id, type, 0, 0, 1 FROM matches) u GROUP BY image_id, type) v GROUP BY type)"""
)
ALL, ELIGIBLE = FLOW.format(join=""), FLOW.format(join="JOIN elig e ON e.image_id = i.image_id AND e.reason IS NULL")


def meta(t):
    more = t.events.select((F.col("user_id") + 10_000_000).alias("image_id")).distinct()
    return t.pages_meta.unionByName(more.select("image_id", F.lit(420).alias("width"), F.lit(820).alias("height")))


def annotations(t, images=None):
    return annotation_json(t, images).where("image_id % 10 <> 3")


@query("benchmark_images", ALL + """
SELECT image_id, gt_count, pred_count, matched, round(recall, 6) AS recall, round(prec, 6) AS "precision", round(f1, 6) AS f1, round(coverage, 6) AS coverage, error, scored FROM fs""")
def _(t):
    m, _ = B.image_results(annotations(t), pred_of(t), meta(t))
    return m.select("image_id", "gt_count", "pred_count", "matched", *(r6(F.col(c), c) for c in ("recall", "precision", "f1", "coverage")), "error", "scored")


@query("benchmark_coverage", """
SELECT m.image_id, count(p.box_id) AS pred_count, round(least(1.0, coalesce(sum(p.w * p.h), 0) / (420 * 820)), 6) AS coverage FROM """ + IMAGES + """ m LEFT JOIN preds p ON p.image_id = m.image_id GROUP BY m.image_id""")
def _(t):
    m, _ = B.image_results(None, pred_of(t), meta(t))
    return m.select("image_id", "pred_count", r6(F.col("coverage"), "coverage"))


@query("benchmark_flow", ELIGIBLE + """
SELECT round(coalesce(avg(CASE WHEN scored THEN recall END), 0), 6) AS mean_recall, round(coalesce(avg(CASE WHEN scored THEN prec END), 0), 6) AS mean_precision, round(coalesce(avg(CASE WHEN scored THEN f1 END), 0), 6) AS mean_f1, round(avg(coverage), 6) AS mean_coverage,
  count(*) AS total_images, CAST(sum(pred_count) AS BIGINT) AS total_predictions, CAST(sum(gt_count) AS BIGINT) AS total_gt, (SELECT round(coalesce(avg(f1), 0), 6) FROM ft) AS macro_f1, count(error) AS errors FROM fs""")
def _(t):
    d = t.dealt
    # known before the documents are put together, so that only those of eligible images are
    eligible = cut_lineage(R.eligibility(headers(d), R.review_status(findings(d), actions(d))).where("eligible").select("image_id"), dealt=True)
    s = B.flow_summary(*B.image_results(annotations(d, eligible), pred_of(d), meta(d), eligible))
    return s.select(*(r6(F.col(c), c) if c.startswith(("mean", "macro")) else c for c in s.columns))
