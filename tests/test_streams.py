"""Streamed tables: one file or a folder, no rows at all, exact quantiles, sessions still open."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from screenlake.plans.catalog import QUERIES
from screenlake.streaming import jobs as J


@pytest.fixture
def table(spark, tmp_path):
    """Writes a table to ``tmp_path``, as a folder of files or as one file."""

    def write(name, rows, schema, folder):
        df, path = spark.createDataFrame(rows, schema), tmp_path / f"{name}.parquet"
        if folder:
            df.repartition(2).write.parquet(str(path))
        else:
            df.toPandas().to_parquet(path)

    return write


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("folder", [True, False])
def test_stream_reads_a_folder_and_a_file(spark, tmp_path, table, folder):
    table("documents", [(i, "some text", "en", "s", 9) for i in range(4)], DOCUMENTS, folder)
    found = QUERIES["stream_entities"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {0, 1, 2, 3}
    assert sorted(found) == sorted(QUERIES["extract_entities"](spark, str(tmp_path)).collect())


def test_stream_without_rows_is_an_empty_table(spark, tmp_path):
    docs = spark.readStream.schema("doc_id long, text string").parquet(str((tmp_path / "in").mkdir() or tmp_path / "in"))
    out = J.run_available(J.stream_entities(docs), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.collect() == [] and "value" in out.columns


def test_latency_quantiles_are_exact(spark, tmp_path):
    """More values in a window than a sketch of 10 000 would keep apart."""
    n, at = 60_000, dt.datetime(2024, 1, 1)
    rows = spark.range(n).select(F.lit("a").alias("provider"), F.lit(at).alias("ts"), ((F.col("id") * 7919) % n).cast("double").alias("duration_ms"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = J.run_available(J.stream_latency(stream), str(tmp_path / "o"), str(tmp_path / "c"), "update", ("provider", "started")).collect()
    assert [(r.n, r.median_ms, r.p90_ms) for r in out] == [(n, n / 2 - 1, n * 0.9 - 1)]


def test_sessions_open_at_the_end_are_in_the_result(spark, tmp_path, table):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=m), 1, kind, 2.0, "p") for i, (m, kind) in enumerate([(0, "a"), (5, "a"), (100, "a"), (109, "a"), (0, "b"), (108, "b"), (109, None)])]
    table("events", rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string", True)
    got = QUERIES["idle_sessions"](spark, str(tmp_path)).collect()
    assert sorted((r.provider or "", r.started[11:16], r.n) for r in got) == [("", "01:49", 1), ("a", "00:00", 2), ("a", "01:40", 2), ("b", "00:00", 1), ("b", "01:48", 1)]
