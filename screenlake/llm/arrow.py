"""Arrow batches in small parts, so that a worker holds few texts at a time."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession


#: Rows of long texts that Spark hands to a worker at once; Spark's own default is 10000.
ROWS_PER_BATCH = 1000


def prepare(spark: SparkSession) -> None:
    """Let workers find this package where they share its folder, and take smaller Arrow batches
    for this session, unless it has a setting of its own."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, ROWS_PER_BATCH)


def parts(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
