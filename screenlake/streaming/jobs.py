"""Streaming forms of the review, cache, session, latency, ingest and entity jobs (STR-*).

Each function maps a streaming DataFrame to a streaming DataFrame (the same code runs on
a batch DataFrame); ``run_available`` drains a source into a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from screenlake.operators.cache import TTL_SECONDS
from screenlake.operators.entities import extract_entities
from screenlake.operators.review import validate_annotations
from screenlake.session import cut_lineage
from screenlake.sources.annotations import elements_of, read_annotations, reject_invalid, relations_of


STORE = "spark.sql.streaming.stateStore.providerClass"
CHUNK = 100_000  # rows of one key that are sent on at once


def stream_latest_actions(actions: DataFrame) -> DataFrame:
    """Last action per (image, kind, subject), kept as aggregation state (update mode); an
    action older than the state does not replace it."""
    keys = ["image_id", "subject_kind", "subject_id"]
    rest = [c for c in actions.columns if c not in keys]
    last = actions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "action_id")).alias("r"))
    return last.select(*keys, *(F.col("r")[c].alias(c) for c in rest))


class CacheChain(StatefulProcessor):
    """The time of the last computed result of a key, dropped by a timer ``ttl`` after it."""

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # 16 bytes a row are held: numbers of the chunks, not their frames
        chunks = [(c["t"].to_numpy(np.int64), c["request_id"].to_numpy(np.int64)) for c in rows]
        t, request = (np.concatenate(c) for c in zip(*chunks, strict=True))
        order = np.lexsort((request, t))
        t, request = t[order], request[order]
        last = self.last.get()[0] if self.last.exists() else None
        hit = np.ones(len(t), bool)
        # from one computed request to the next: the first at least ttl later
        at = 0 if last is None else int(np.searchsorted(t, last + self.ttl))
        while at < len(t):
            hit[at], last = False, int(t[at])
            at = int(np.searchsorted(t, last + self.ttl))
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((last + self.ttl) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        for start in range(0, len(t), CHUNK):
            part = slice(start, start + CHUNK)
            yield pd.DataFrame({"cache_key": key[0], "request_id": request[part], "ts": pd.to_datetime(t[part], unit="us"), "hit": hit[part]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_cache_hits(requests: DataFrame, ttl: int = TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Hit flag per request against the last computed result of its key.

    The state of a key is one timestamp that a timer drops ``ttl`` after it; the rows of a key
    are taken in time order within a micro-batch, from one computed request to the next.
    Needs a state store that supports timers; the session's default provider is replaced."""
    spark = requests.sparkSession
    if spark.conf.get(STORE).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = requests.select("cache_key", "request_id", "ts").withWatermark("ts", delay).withColumn("t", F.unix_micros("ts"))
    schema = "cache_key string, request_id long, ts timestamp, hit boolean"
    return keyed.groupBy("cache_key").transformWithStateInPandas(CacheChain(ttl), schema, "Append", "EventTime")


def stream_distinct_requests(requests: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The cheap form: drops repeats of a key within the watermark instead of flagging."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["cache_key"])


def idle_sessions(requests: DataFrame, gap: str = "10 minutes", keys: tuple[str, ...] = ("provider",), delay: str = "10 minutes") -> DataFrame:
    """Busy sessions per key that an idle gap closes.  In append mode a session is one row, written
    and forgotten once the watermark passes its end; rows later than that are counted, not kept."""
    base = requests.withWatermark("ts", delay)
    s = base.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("busy_ms"))
    return s.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "busy_ms")


def open_sessions(requests: DataFrame, closed: DataFrame, gap: str = "10 minutes", keys: tuple[str, ...] = ("provider",)) -> DataFrame:
    """The sessions that no idle gap has closed yet, once a source is drained: those of the rows
    (a batch) from the end of the last closed session of their key on."""
    last = closed.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("ended").alias("_end"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rest = requests.join(last, same, "left").where(F.col("_end").isNull() | (F.col("ts") >= F.col("_end")))
    return idle_sessions(rest.select(requests.columns), gap, keys)


def stream_latency(requests: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Latency profile per provider and tumbling (or sliding) window.  The quantiles are exact:
    the state of a window is the count of each distinct value."""
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    s = requests.withWatermark("ts", delay).groupBy("provider", win.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
        *(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY duration_ms)").alias(name) for q, name in ((0.5, "median_ms"), (0.9, "p90_ms"))),
    )
    return s.select("provider", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "mean_ms", "max_ms", "median_ms", "p90_ms")


def stream_entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Entities as documents arrive; stateless."""
    return extract_entities(docs, key, text)


def stream_ingest_annotations(spark: SparkSession, folder: str, out: str, rejects: str, checkpoint: str, findings: str | None = None):
    """Ingest annotation files, loose or in packs, as they arrive: valid elements to ``out``, rejects with their
    reason to ``rejects`` and, if asked, the errors inside valid annotations (repeated ids, boxes
    out of the page, relation ends, cycles) to ``findings``.  Every micro-batch writes its own
    folders, so a replayed batch overwrites itself."""
    raw = read_annotations(spark, folder, stream=True)

    def write(batch: DataFrame, epoch: int) -> None:
        ok, bad = reject_invalid(batch)
        ok = ok.withColumnRenamed("file", "image_id")
        elements = elements_of(ok)
        elements.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        bad.select("file", "reason").write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")
        if findings is not None:
            # an image is a file, so all its rows are in this batch
            elements = batch.sparkSession.read.schema(elements.schema).parquet(f"{out}/epoch={epoch}")
            children = elements.select("image_id", F.col("element_id").alias("parent_id"), F.explode("children").alias("child_id"))
            meta = ok.select("image_id", F.col("imageSize.width").alias("width"), F.col("imageSize.height").alias("height"))
            found = validate_annotations(elements, cut_lineage(relations_of(ok)), children, cut_lineage(meta))
            found.write.mode("overwrite").parquet(f"{findings}/epoch={epoch}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Process what the source holds and return the table: appended micro-batches, in update
    mode the last row written for each of ``keys``, in complete mode the last state.  Rows that
    came too late for their state are counted for each batch in the table ``path``-late."""
    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    sink = replace if mode == "complete" else append
    # a source without rows gives an empty table
    df.sparkSession.createDataFrame([], df.schema).write.mode("ignore").parquet(path if mode == "complete" else f"{path}/epoch=-1")
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    late = [(p["batchId"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]), sum(o["numRowsTotal"] for o in p["stateOperators"])) for p in q.recentProgress]
    df.sparkSession.createDataFrame(late, "batch long, late_rows long, state_rows long").write.mode("overwrite").parquet(f"{path}-late")
    if mode != "update":
        return df.sparkSession.read.schema(df.schema).parquet(path)
    rows = df.sparkSession.read.schema(T.StructType(df.schema.fields + [T.StructField("epoch", T.LongType())])).parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "epoch").alias("r"))
    return last.select("r.*")
