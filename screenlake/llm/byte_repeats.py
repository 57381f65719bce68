"""Removal of byte strings that also start in an earlier document, by window anchors.

Every string of ``window`` bytes that also starts in a document with a smaller id is removed.
This replaces prefix doubling: names of short blocks are doubled inside the tasks, the block with
the least name in each window is its anchor, and Spark sorts the anchor rows once by that name
(see ``repeats``).  No rank pairs are sorted and re-ranked by Spark: rows for every place and
every doubling would be many times the input.

Defined cases: a null text counts as empty; texts shorter than the window lose nothing; rows with
a null id neither remove nor lose anything; rows that share an id do not remove each other's
bytes; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.llm import repeats
from screenlake.llm.arrow import parts


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed``
    and ``n_spans``, the number of removed runs."""
    if window < 9:
        raise ValueError("a window has at least 9 bytes")
    plan = repeats.Plan(repeats.ByteUnits, window, 1 << (window // 3).bit_length() - 1, 1)
    dealt, spans = repeats.repeated_spans(docs, plan, doc_id, text)
    added = [("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType())]
    names = [c for c in docs.columns if c not in (text, *(n for n, _ in added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            kept, totals, removed, runs = [], [], [], []
            for value, found in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                data = (value or "").encode()
                start, end = repeats.covered(found, window)
                left, at = [], 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                kept.append(b"".join(left))
                totals.append(len(data))
                removed.append(int((end - start).sum()))
                runs.append(len(start))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (totals, removed, runs))], names=[*names, *(n for n, _ in added)]
            )

    joined = repeats.joined(dealt, spans, doc_id)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(n, t) for n, t in added])
    return joined.select(*[F.col(f"`{c}`") for c in names], F.col(text), "__spans").mapInArrow(run, schema)
