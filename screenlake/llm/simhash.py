"""SimHash near-duplicates through an inverted index over byte positions.

Two 64-bit fingerprints that differ in at most 4 bits share at least 4 of their 8 bytes in
place.  A posting of the index is therefore a set of 4 byte positions with their values: the
least number of positional matches that a linked pair is sure to have.  Pairs meet in a posting,
and the differing bits are counted; shared bytes are not tallied.  Single bytes as postings
would let each fingerprint meet one in 256 of all others, which grows with the square.

A posting with more members than ``fold`` is not compared; its members go on to postings over
half of the bits still free, cell by cell, by the same rule.  After three levels a posting has at
most 256 members, so the result is exact at every size and no task holds more than ``fold``.
Inside a posting a search from member to member gives a spanning forest instead of all pairs.

Defined cases: null and empty texts and texts without words have fingerprint 0 and link like any
other; fewer words than a shingle count as one shingle; copies share their fingerprint and are
compared once; rows with a null id get the smallest id of their group, or null if it has none;
repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.llm import graph, words
from screenlake.llm.arrow import parts
from screenlake.session import cut_lineage

MAX_BITS, CELLS, SHARED = 4, 8, 4
FOLD = 20_000


def fingerprint(text: str | None, size: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    data = (text or "").encode().lower()
    ones, total = np.zeros(64, np.int64), 0
    many = False
    for part in words.segments(data, size):
        norm, starts, ends = words.normalised(part)
        if many and len(starts) < size:
            continue
        many = True
        flat, h = norm.tobytes(), xxhash.xxh64_intdigest
        begins, stops = words.shingle_bounds(starts, ends, size)
        for i in range(0, len(begins), 1 << 16):
            hashed = np.array([h(flat[a:b], 42) for a, b in zip(begins[i : i + (1 << 16)].tolist(), stops[i : i + (1 << 16)].tolist(), strict=True)], np.uint64)
            ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashed)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4) -> DataFrame:
    """``docs`` without the text, with ``fingerprint`` as a signed 64-bit integer."""
    kept = [c for c in docs.columns if c not in (text, "fingerprint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            values = np.array([fingerprint(t, size) for t in batch.column(len(kept)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(values.view(np.int64))], names=[*kept, "fingerprint"])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fingerprint", T.LongType())])
    return docs.select(*[f"`{c}`" for c in kept], text).mapInArrow(run, schema)


@lru_cache(maxsize=8192)
def _finer(mask: int) -> np.ndarray:
    """The masks that fix half of the bits that ``mask`` leaves free: 4 of 8 equal cells of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    width = len(free) // CELLS
    cells = [sum(1 << b for b in free[i * width : (i + 1) * width]) for i in range(CELLS)]
    return np.array([mask | sum(chosen) for chosen in combinations(cells, SHARED)], np.uint64)


def _spread(rows: DataFrame) -> DataFrame:
    """Each (mask, fp) under every finer mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, fps = (np.asarray(batch.column(i)).astype(np.int64).view(np.uint64) for i in (0, 1))
            for mask in np.unique(masks):
                finer, members = _finer(int(mask)), fps[masks == mask]
                for i in range(0, len(members), 1000):
                    some = members[i : i + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(finer, len(some)).view(np.int64)), pa.array(np.tile(some, len(finer)).view(np.int64))], names=["mask", "fp"])

    return rows.mapInArrow(run, "mask long, fp long")


def _forest(members: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Edges (from, to...) of a spanning forest of the linked members."""
    left = members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                yield at, found


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where postings start in sorted (masks, fingerprints)."""
    changed = (rows[0, 1:] != rows[0, :-1]) | ((rows[1, 1:] ^ rows[1, :-1]) & rows[0, 1:] != 0)
    return np.flatnonzero(np.concatenate([[True], changed]))


def _compare(rows: DataFrame, max_bits: int, fold: int) -> DataFrame:
    """(a, b, mask): links with null mask; members of postings above ``fold`` with theirs, a = b."""
    key = F.col("fp").bitwiseAND(F.col("mask"))

    def out(a, b, mask=None) -> pa.RecordBatch:
        a, b = (np.asarray(x, np.uint64).view(np.int64) for x in (a, b))
        masks = pa.nulls(len(a), pa.int64()) if mask is None else pa.array(np.asarray(mask, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), masks], names=["a", "b", "mask"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Whole postings, several at a time, and parts of postings above ``fold``, marked so."""
        held, hot = np.empty((2, 0), np.uint64), None
        for batch in batches:
            now = np.hstack([held, np.array([np.asarray(batch.column(i)).astype(np.int64).view(np.uint64) for i in (0, 1)])])
            if hot is not None:
                same = (now[0] == hot[0]) & (now[1] & now[0] == hot[1])
                if same.any():
                    yield now[0, same], now[1, same], True
                now = now[:, ~same]
            if not now.shape[1]:
                held = now
                continue
            last = _starts(now)[-1]
            if last:
                yield now[0, :last], now[1, :last], False
            held = now[:, last:]
            if held.shape[1] > fold and np.bitwise_count(held[0, 0]) < 56:
                hot = held[0, 0], held[0, 0] & held[1, 0]
                yield held[0], held[1], True
                held = held[:, :0]
        if held.shape[1]:
            yield held[0], held[1], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for masks, fps, above in runs(batches):
            if above:
                yield out(fps, fps, masks)
                continue
            starts = _starts(np.array([masks, fps]))
            sizes = np.diff(np.append(starts, len(fps)))
            two = starts[sizes == 2]
            a, b = fps[two], fps[two + 1]
            near = np.bitwise_count(a ^ b) <= max_bits
            if near.any():
                yield out(a[near], b[near])
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                members = fps[start : start + size]
                if size > fold and np.bitwise_count(masks[start]) < 56:
                    yield out(members, members, masks[start : start + size])
                    continue
                for at, found in _forest(members, max_bits):
                    yield out(np.full(len(found), at, np.uint64), found)

    return rows.repartition("mask", key).sortWithinPartitions("mask", key).mapInArrow(run, "a long, b long, mask long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, fold: int = FOLD) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fps(fp)`` as all links do."""
    if not 0 <= max_bits <= CELLS - SHARED:
        raise ValueError(f"at most {CELLS - SHARED} differing bits leave {SHARED} cells alike")
    rows, found = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), None
    for _ in range(3):
        met = cut_lineage(_compare(_spread(rows), max_bits, fold).distinct())
        some = met.where(F.col("mask").isNull()).select("a", "b")
        found = some if found is None else found.unionByName(some)
        rows = met.where(F.col("mask").isNotNull()).select("mask", F.col("a").alias("fp"))
        if rows.isEmpty():
            break
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, max_bits: int = MAX_BITS, fold: int = FOLD) -> DataFrame:
    """``docs`` without the text, with ``fingerprint`` (hexadecimal) and ``component_id``, the
    smallest id that links reach."""
    marked = cut_lineage(fingerprints(docs, text, size))
    firsts = marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(doc_id).alias("first"))
    roots = graph.components(links(firsts.select("fp"), max_bits, fold))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select(F.col("fp").alias("fingerprint"), F.col("component_id").alias("__component"))
    kept = [c for c in marked.columns if c not in ("fingerprint", "component_id")]
    return marked.join(classes, "fingerprint").select(*[F.col(f"`{c}`") for c in kept], F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("__component").alias("component_id"))
