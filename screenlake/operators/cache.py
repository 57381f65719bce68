"""Result-cache analysis over request logs (WIN-24)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from screenlake.operators.folds import fold_sorted
from screenlake.operators.ordered import islands

TTL_SECONDS = 3600


def cache_key(image: Column, prompt: Column, max_tokens: Column, temperature: Column) -> Column:
    """Key of image bytes, prompt and parameters, from truncated SHA-256 digests."""
    params = F.concat_ws(":", max_tokens.cast("string"), temperature.cast("string"))
    part = lambda c, n: F.substring(F.sha2(c.cast("binary"), 256), 1, n)
    return F.concat_ws(":", part(image, 32), part(prompt, 16), part(params, 8))


def cache_hits(requests: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Adds ``hit``: answered from a result that was *computed* less than ``ttl`` seconds
    before.  Hits do not extend the life of a result, so the computed requests of a key
    form a chain: each is the first one at least ``ttl`` after the one before.

    ``requests``: request_id, ts, cache_key.  A request that comes ``ttl`` after the one before
    it starts a chain anew whatever came earlier, so a busy key is cut there; each part is one
    pass that remembers one time."""
    step = ttl * 1_000_000
    rows = requests.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    # requests of one key at the same instant share their fate except for the first
    times = rows.groupBy("cache_key", "_t").agg(F.min("request_id").alias("request_id"))
    parts = islands(times, ["cache_key"], F.col("_t"), ["_t"], ["_t"], lambda p: F.col("_t") - p["_t"] >= step, "_part", band=float(64 * step))

    def chain(group: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for key, _, t, request in group:
            if last is None or t - last >= step:
                last = t
                yield key, t, request, True

    schema = T.StructType([times.schema["cache_key"], times.schema["_t"], times.schema["request_id"], T.StructField("_computed", T.BooleanType())])
    computed = fold_sorted(parts.select("cache_key", "_part", "_t", "request_id"), ["cache_key", "_part"], ["_t"], schema, chain)
    rows = rows.join(computed, ["cache_key", "_t", "request_id"], "left")
    return rows.withColumn("hit", F.col("_computed").isNull()).drop("_t", "_computed").select(*requests.columns, "hit")
