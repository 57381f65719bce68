"""A bitmap of fixed size over 64-bit fingerprints, as a filter in front of a shuffle.

A bit may stand for several fingerprints: what passes still has to be checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bitmap has 2^27 bits (16 MB), made in blocks of 2^19 (64 KB).
BITS, BLOCK_BITS = 27, 19


def marked(bitmap: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Whether the bits of unsigned fingerprints are set."""
    bit = fps >> np.uint64(64 - BITS)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def build(fps: DataFrame) -> bytes:
    """The bits of ``fps(fp)``.  Each block comes from one task; what reaches the driver is the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = np.asarray(batch.column(1)).astype(np.int64).view(np.uint64) >> np.uint64(64 - BITS)
            block = (bit >> np.uint64(BLOCK_BITS)).astype(np.int64)
            for b in np.unique(block).tolist():
                bits = held.setdefault(b, np.zeros(1 << BLOCK_BITS, bool))
                bits[(bit[block == b] & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)] = True
        for b, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    block = F.shiftrightunsigned("fp", 64 - BITS + BLOCK_BITS).alias("block")
    made = fps.select(block, "fp").repartition("block").mapInArrow(run, "block long, bits binary")
    out = [bytes(1 << BLOCK_BITS - 3)] * (1 << BITS - BLOCK_BITS)
    for r in made.collect():
        out[r["block"]] = bytes(r["bits"])
    return b"".join(out)
