"""Walks over the trees of images, dealt by image once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from screenlake.session import cut_lineage

#: Levels that one plan climbs; trees that are deeper go on in rounds of twice the reach.
LEVELS = 6


def climb(rows: DataFrame, merge: dict[str, Column], only: Column | None = None, dropped: bool = False) -> DataFrame:
    """Every row climbs from node to parent and gathers values on its way.

    ``rows``, dealt by image: image_id, node_id, ``_up`` (the next ancestor to visit, null at an
    end), the values of the node itself and any other columns.  ``merge`` gives each value from
    the row's own (its name) and the ancestor's (``_u`` and its name).  A row ends at an ancestor
    that is unknown or not one of ``only``; if ``dropped``, it is no row of the result then.
    ``_up`` stays set for rows that never end, as they climb on a cycle.

    All steps of a plan meet the same dealt rows, so no level is shuffled or written for itself."""

    def step(state: DataFrame, known: DataFrame) -> DataFrame:
        known = known if only is None else known.where(only)
        up = known.select("image_id", F.col("node_id").alias("_up"), F.col("_up").alias("_next"), F.lit(True).alias("_met"), *(F.col(c).alias("_u" + c) for c in merge))
        # a level is a small file and many rows: never broadcast one through the driver
        met = state.join(up.hint("merge"), ["image_id", "_up"], "left")
        if dropped:
            met = met.where("_up IS NULL OR _met")
        values = (F.when(F.col("_met"), merge[c]).otherwise(F.col(c)).alias(c) if c in merge else F.col(c) for c in state.columns if c != "_up")
        return met.select(*values, F.col("_next").alias("_up"))

    state = rows
    for _ in range(LEVELS):
        state = step(state, rows)
    state = cut_lineage(state, dealt=True)
    still, reach = state.where("_up IS NOT NULL"), LEVELS
    left = still.count()
    # an ancestor below the first levels is such a row itself: more steps than these are a cycle
    end, done = LEVELS + left, state.where("_up IS NULL")
    while left and reach <= end:
        state = cut_lineage(step(still, done.unionByName(still)))
        done, still = done.unionByName(state.where("_up IS NULL")), state.where("_up IS NOT NULL")
        left, reach = still.count(), reach * 2
    return done.unionByName(still) if left else done
