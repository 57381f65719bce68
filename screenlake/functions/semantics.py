"""Number, order and fold semantics that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def js_round(v: Column) -> Column:
    """Half rounds toward plus infinity (-0.5 -> 0), not away from zero."""
    return F.floor(v + 0.5).cast("double")


def round_half_up(v: Column, digits: int) -> Column:
    factor = float(10**digits)
    return F.floor(v * factor + 0.5) / factor


def upper_median(name: str) -> Column:
    """Aggregate: element ``floor(n/2)`` of the sorted values of column ``name``.

    ``percentile_disc`` keeps a value -> count map, so it combines map-side and never
    holds the rows of a group; over the descending order its middle is the upper one.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def mean_median(name: str) -> Column:
    """Aggregate: the median that averages the two middle values."""
    return F.expr(f"percentile({name}, 0.5D)")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by ``order``.  A ``min_by`` over the whole row combines
    map-side, so a key that holds most of the rows costs one row per map task."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def with_group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates to the rows: aggregate (with map-side combine) and join
    back.  Unlike a window it does not send a whole group to one task, and the join side
    of a hot key is a single row that AQE can replicate."""
    stats = df.groupBy(*keys).agg(*aggs)
    return df.join(stats, list(keys), "left")


def fold_array(rows: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Ordered fold over an array that is already sorted; stays in the JVM."""
    return F.aggregate(rows, zero, step)


def constant_table(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small fixed table as JVM literals (no Python worker, no escaping of patterns)."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    """Spell out ``\\b`` as an ASCII word boundary.  Some JVMs count CJK and accented
    letters as word characters there, although ``\\w`` does not."""
    return pattern.replace(r"\b", _EDGE)
