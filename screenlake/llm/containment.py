"""Benchmark decontamination: short test items inside long documents, by MinHash containment.

The sketch of an item holds its smallest shingle hashes.  An item with n distinct shingles of
which a share of ``threshold`` lies in a document misses at most (1 - threshold) n of them, so one
more than that many sketch hashes must hold a hit: candidates are complete.  Items are split by
size, and each part has the sketch length that its largest items need; hashes of whole documents
are looked up in the sketches, and every candidate is verified by its exact shingles.

Items go through in blocks of at most ``block_bytes`` of text, one pass over the documents each;
only such a block is ever held by the driver and the tasks.  An item above this size is a block
of its own.

Texts are compared by words with A-Z lower-cased.  Defined cases: null and empty texts and items
match nothing; an item with fewer words than a shingle is one shingle, and so is such a document,
so they match only as a whole; rows with a null id are reported with that null; repeated items
and documents are reported each; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.llm import words
from screenlake.llm.arrow import parts
from screenlake.llm.repeats import BASE, BYTE_NAMES, _mixed, _powers

SHINGLE, THRESHOLD = 5, 0.8
BLOCK_BYTES = 8 << 20
#: Upper ends of the item sizes, in shingles, that share a sketch length: each twice the one before.
SIZES = [2**i for i in range(3, 40)]


def _hashes(part: bytes, size: int) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hash of each shingle, the text they lie in, and their bounds."""
    norm, starts, ends = words.normalised(part)
    a, b = words.shingle_bounds(starts, ends, size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_NAMES[norm] * _powers(len(norm), BASE), dtype=np.uint64)])
    return _mixed((sums[b] - sums[a]) * _powers(len(norm) + 1, pow(BASE, -1, 1 << 64))[a] + (b - a).astype(np.uint64)), norm.tobytes(), a, b


def shingles(text: str | None, size: int = SHINGLE) -> dict[bytes, int]:
    """Distinct shingles of a text and their hashes."""
    out: dict[bytes, int] = {}
    many = False
    for part in words.segments((text or "").encode().lower(), size):
        hashed, norm, a, b = _hashes(part, size)
        if many and norm.count(b" ") < size - 1:
            continue
        many = True
        out.update(zip((norm[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)), hashed.tolist(), strict=True))
    return out


def least_hits(n: int, threshold: float) -> int:
    """Shingles that an item of ``n`` has at least in common with a document."""
    return max(1, math.ceil(threshold * n - 1e-9))


class Sketches:
    """Sketch hashes of a block of items, and their shingles for verification."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, threshold: float):
        self.size, self.threshold, self.ids = size, threshold, [i for i, _ in items]
        self.sets = [shingles(t, size) for _, t in items]
        pairs: list[tuple[int, int]] = []
        largest: dict[int, int] = {}
        part = [next(i for i, top in enumerate(SIZES) if len(s) <= top) for s in self.sets]
        for p, s in zip(part, self.sets, strict=True):
            largest[p] = max(largest.get(p, 0), len(s))
        for k, (p, s) in enumerate(zip(part, self.sets, strict=True)):
            most_missed = largest[p] - least_hits(largest[p], threshold)
            pairs += [(h, k) for h in sorted(s.values())[: most_missed + 1]]
        pairs.sort()
        self.keys = np.array([h for h, _ in pairs], np.uint64)
        self.items = np.array([k for _, k in pairs], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True

    def search(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item, shingles in common, shingles of the item) of the items that the text holds."""
        candidates: set[int] = set()
        data, many = (text or "").encode().lower(), False
        for part in words.segments(data, self.size):
            hashed, norm, _, _ = _hashes(part, self.size)
            if many and norm.count(b" ") < self.size - 1:
                continue
            many = True
            hashed = np.unique(hashed[self.filter[hashed >> np.uint64(44)]])
            low, high = np.searchsorted(self.keys, hashed), np.searchsorted(self.keys, hashed, "right")
            for i, j in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True):
                candidates.update(self.items[i:j].tolist())
        if not candidates:
            return []
        own = shingles(text, self.size).keys()
        common = ((k, len(own & self.sets[k].keys())) for k in sorted(candidates))
        return [(self.ids[k], n, len(self.sets[k])) for k, n in common if n >= least_hits(len(self.sets[k]), self.threshold)]


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of bounded size, chosen by hash."""
    total = items.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))))).head()[0] or 0
    # twice as many blocks as needed, so that chance leaves none above the bound
    blocks = 1 if total <= block_bytes else math.ceil(2 * total / block_bytes)
    block_of = F.pmod(F.xxhash64(item_id, text), F.lit(blocks))
    for block in range(blocks):
        yield [(r[0], r[1]) for r in items.where(block_of == block).select(item_id, text).collect()]


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item that a document holds."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType())])
    found = None
    for some in _blocks(items, item_id, text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(some, size, threshold)
            for batch in parts(batches):
                hits = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in sketches.search(t)]
                if hits:
                    columns = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(0).type if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=schema.names)

        part = docs.select(doc_id, text).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, in one pass for each block of items."""
    at = docs.columns.index(text)
    for some in _blocks(items, item_id, text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(some, size, threshold)
            for batch in parts(batches):
                yield batch.filter(pa.array([not sketches.search(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
