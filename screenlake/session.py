"""Session helpers: local test session and lineage cutting that survives executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "screenlake", cpus: str | None = None) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


#: What tables are dealt by.
IMAGE = "image_id"
# joins whose inputs are dealt by some of the join keys keep that deal
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only a local session without one gets a
    folder of its own: on a cluster a machine-local folder dies with its machine."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spark-tables-", dir="/tmp")
    return _local_folder


def cut_lineage(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Iterative operators use this between rounds: the plan stays short, nothing is computed
    twice, and the rows outlive any executor.  The cluster owns and clears the folder.

    ``dealt``: inputs that are dealt by some of a join's keys, such as the image alone, are joined
    where they are, in place of one more shuffle for each set of keys.  The table is kept in buckets
    of the image, so what reads it finds it dealt by image and need not shuffle it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    # the table holds the result, so the shuffle files of the plan can go as soon as it is written
    settings = {SHUFFLE_CLEANUP: "true"} | ({ALL_KEYS: "false"} if dealt else {})
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    table = f"dealt_{uuid.uuid4().hex}" if dealt and IMAGE in df.columns else None
    try:
        if table:
            # a name in the session's catalog only; the files lie in the shared folder
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.format("parquet").bucketBy(buckets, IMAGE).option("path", path).saveAsTable(table)
        else:
            df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.table(table) if table else spark.read.schema(df.schema).parquet(path)
