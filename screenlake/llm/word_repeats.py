"""Removal of passages of words that also start in an earlier document, by fixed blocks.

Non-overlapping blocks of each document are indexed, every rolling window of a block's length is
a probe, and hits are extended to all windows that the two documents share (see ``repeats``).
Of the 9 or 10 whole blocks inside a window only the one with the least name is looked up.

Defined cases: a null text has no words; texts with fewer words than the window lose nothing;
rows with a null id neither remove nor lose anything; rows that share an id do not remove each
other's words; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.llm import repeats
from screenlake.llm.arrow import parts

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def remove_repeats(docs: DataFrame, window: int = 50, block: int = 5, doc_id: str = "doc_id", text: str = "text", joined: bool = True) -> DataFrame:
    """``docs`` without the text, with ``kept`` (the remaining words joined by one space),
    ``n_words`` and ``n_removed``.  Without ``joined``, a text that loses nothing is kept as it is."""
    if not 0 < 3 * block <= window:
        raise ValueError("a window holds at least three blocks")
    plan = repeats.Plan(repeats.WordUnits, window, block, block)
    dealt, spans = repeats.repeated_spans(docs, plan, doc_id, text)
    added = [("kept", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType())]
    names = [c for c in docs.columns if c not in (text, *(n for n, _ in added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            kept, totals, removed = [], [], []
            for value, found in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                data = (value or "").encode()
                words = _WORD.findall(data)
                start, end = repeats.covered(found, window)
                left, at = [], 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    left += words[at:a]
                    at = b
                kept.append(b" ".join([*left, *words[at:]]).decode() if joined or len(start) else value or "")
                totals.append(len(words))
                removed.append(int((end - start).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(kept, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=[*names, *(n for n, _ in added)])

    with_spans = repeats.joined(dealt, spans, doc_id)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(n, t) for n, t in added])
    return with_spans.select(*[F.col(f"`{c}`") for c in names], F.col(text), "__spans").mapInArrow(run, schema)
