"""Removal of passages that also start in an earlier document: the part that bytes and words share.

A document is a sequence of units (bytes or words); a window is ``window`` units in a row.  A
unit goes if a window over it also starts in a document with a smaller id.  Four steps:

1. *Anchors.*  Names of runs grow by doubling: the name of 2n units is made from the names of n
   units at two offsets.  Of the blocks of ``block`` units that lie ``stride`` apart inside a
   window the one with the least name is its anchor, so equal windows have equal anchors.
   Neighbouring windows share theirs: one row (block name, name of all their text) stands for
   them.  Before the shuffle a task keeps the smallest document of equal rows and settles the rest.
2. *Ranks.*  Spark sorts the rows by block and text name.  A block that is unique drops out;
   equal text settles all windows of the row; unequal text leaves them open.
3. *Windows.*  Open windows are named in full from the documents; blocks with many different
   texts send every window under its own name, the others send one list per block.
4. *Cutting.*  The windows to remove are gathered by document and cut out of it.

With ``stride`` 1 and blocks at every place this is prefix doubling over sampled places.  With
``stride`` = ``block`` the index holds the blocks at multiples of ``block`` of each document, every
rolling block of the others is a probe, and blocks without an indexed row drop out.

Names are 64 bits; rows are compared by 96 bits, open windows by 64 bits under their block.
No group is larger than a small multiple of the number of tasks: what is frequent has been
settled, or merged, before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm import words
from screenlake.llm.arrow import parts as slices
from screenlake.session import cut_lineage

#: Odd multiplier of the names; units of one piece; units gathered before a task sends rows.
BASE = 0x9E3779B97F4A7C15
PIECE, CHUNK, FLUSH = 1 << 20, 1 << 18, 1 << 23
#: A block with so many different texts in one task is settled window by window.
MANY = 64
_48 = np.uint64((1 << 48) - 1)

Piece = tuple[int, int, bytes]  # row, first unit, content


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


#: A random-looking name of each byte.
BYTE_NAMES = _mixed(_mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE)))


class ByteUnits:
    """Bytes of the UTF-8 text."""

    @staticmethod
    def payload(content: bytes, names: np.ndarray, low: int, high: int, window: int) -> bytes:
        """What tells the windows low to high: here their text, which is shorter than their names."""
        return content[low : high + window]

    @staticmethod
    def window_names(payloads: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
        starts = np.cumsum([0, *map(len, payloads[:-1])])
        place = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return run_names(BYTE_NAMES[np.frombuffer(b"".join(payloads), np.uint8)], window)[place]

    @staticmethod
    def pieces(row: int, data: bytes, window: int) -> Iterator[Piece]:
        for at in range(0, max(0, len(data) - window + 1), PIECE):
            yield row, at, data[at : at + PIECE + window - 1]

    @staticmethod
    def names(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Names of all units, and the number of units of each piece."""
        return BYTE_NAMES[np.frombuffer(b"".join(contents), np.uint8)], np.array([len(c) for c in contents], np.int64)


class WordUnits:
    """Runs of bytes other than 0x20 and 0x09 to 0x0D."""

    @staticmethod
    def payload(content: bytes, names: np.ndarray, low: int, high: int, window: int) -> bytes:
        return names[low : high + 1].tobytes()

    @staticmethod
    def window_names(payloads: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
        return np.frombuffer(b"".join(payloads), np.uint64)

    @staticmethod
    def pieces(row: int, data: bytes, window: int) -> Iterator[Piece]:
        at = 0
        for part in words.segments(data, window, PIECE):
            yield row, at, part
            if len(part) < len(data):
                at += len(words.normalised(part)[1]) - window + 1

    @staticmethod
    def names(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"\n".join(contents), np.uint8)
        norm, starts, ends = words.normalised(codes)
        if not len(starts):
            return np.empty(0, np.uint64), np.zeros(len(contents), np.int64)
        space = words._SPACE[codes]
        begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        offsets = np.cumsum([0, *(len(c) + 1 for c in contents)])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_NAMES[norm] * _powers(len(norm), BASE), dtype=np.uint64)])
        named = (sums[ends] - sums[starts]) * _powers(len(norm), pow(BASE, -1, 1 << 64))[starts]
        return _mixed(named + (ends - starts).astype(np.uint64)), np.diff(np.searchsorted(begins, offsets))


_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 ... base^(n-1), modulo 2^64."""
    if base not in _tables or len(_tables[base]) < n:
        out, size = np.ones(1, np.uint64), max(n, 1 << 16)
        while len(out) < size:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        _tables[base] = out
    return _tables[base][:n]


def run_names(units: np.ndarray, length: int) -> np.ndarray:
    """Name of the run of ``length`` units at each place, by doubling."""
    got, have, level, size = None, 0, units, 1
    while size <= length:
        if length & size:
            # what is there already stands behind this level
            got = level if got is None else level[: len(units) - have - size + 1] * _power(have) + got[size:]
            have += size
        if size * 2 <= length:
            level = level[:-size] * _power(size) + level[size:]
        size *= 2
    return got


@dataclass(frozen=True)
class Plan:
    units: type
    window: int
    block: int
    stride: int

    def __post_init__(self):
        if not 8 < self.window < 1 << LENGTH_BITS - 1:
            raise ValueError("a window has 9 to 1023 units")

    @property
    def blocks(self) -> int:
        return (self.window - self.block - (self.stride - 1)) // self.stride + 1

    def anchors(self, pieces: list[Piece]) -> tuple[np.ndarray, ...]:
        """(piece, block name, text name, first window, last window, is indexed) of each anchor."""
        units, sizes = self.units.names([p[2] for p in pieces])
        ends = np.cumsum(sizes)
        starts, last = ends - sizes, ends - self.window
        empty = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, bool))
        if len(units) < self.window:
            return empty
        block, whole = run_names(units, self.block), run_names(units, self.window)
        bits = np.uint64((1 << max(1, int(len(units)).bit_length())) - 1)
        least = (_mixed(block) & ~bits) | np.arange(len(block), dtype=np.uint64)
        # the least of the blocks at i, i + stride, ...
        first, have, size, level = None, 0, 1, least
        while size <= self.blocks:
            if self.blocks & size:
                first = level if first is None else np.minimum(level[: len(first) - self.stride * size], first[self.stride * size :])
                have += size
            if size * 2 <= self.blocks:
                level = np.minimum(level[: -self.stride * size], level[self.stride * size :])
            size *= 2
        offsets = np.array([p[1] for p in pieces], np.int64)
        found = []
        for phase in range(self.stride):
            place = np.arange(phase, len(first), self.stride)
            piece = np.searchsorted(ends, place, side="right")
            low, high = np.maximum(place - self.stride + 1, starts[piece]), np.minimum(place, last[piece])
            ok = low <= high
            place, piece, low, high = place[ok], piece[ok], low[ok], high[ok]
            at = (first[place] & bits).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])) if len(at) else np.empty(0, np.int64)
            until = np.append(new[1:], len(at)) - 1 if len(new) else new
            piece, at, low, high = piece[new], at[new], low[new], high[until]
            text = _mixed(whole[low] * np.uint64(BASE) + _mixed(whole[high]) + ((high - low) * 4096 + at - low).astype(np.uint64))
            shift = offsets[piece] - starts[piece]
            found.append((piece, _mixed(block[at]) & _48, text & _48, low + shift, high + shift, (at + shift) % self.stride == 0))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _merged(doc: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows of each row, joined where they touch."""
    if not len(doc):
        return doc, tag, low, high
    order = np.lexsort((low, tag, doc) if tag.any() else (low, doc))
    doc, tag, low, high = doc[order], tag[order], low[order], high[order]
    change = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    group = np.cumsum(change)
    span = np.int64(high.max() - low.min() + 2)
    reach = np.maximum.accumulate(high - low.min() + group * span) - group * span + low.min()
    new = np.flatnonzero(change | np.concatenate([[True], low[1:] > reach[:-1] + 1]))
    return doc[new], tag[new], low[new], reach[np.append(new[1:], len(doc)) - 1]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each sorted row is in."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(c) for c in batch.columns]


def _own_key(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Negative keys for rows that only pass through, spread by document."""
    return -1 - (_mixed(doc.view(np.uint64) ^ tag.view(np.uint64)) & _48).astype(np.int64)


#: Low bits of a packed anchor row: the number of windows, and whether the block is indexed.
LENGTH_BITS = 11


SETTLED, OPEN, APART = -1, -2, -3  # what is known of the windows of a row


def _passing(doc: np.ndarray, tag: np.ndarray, says: int, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Rows that are only handed on: what they say and their length stand in place of a text name."""
    return _batch(h=_own_key(doc, tag), c=-1 - ((high - low) * 2 + (says == APART)), doc=doc, tag=tag, at=low << LENGTH_BITS)


def _packed(low: np.ndarray, high: np.ndarray, index: np.ndarray) -> np.ndarray:
    return low << LENGTH_BITS | (high - low) << 1 | index


def _anchor_rows(plan: Plan) -> Callable:
    def send(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, tag, block, text, low, high, index = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((doc, text, block))
        doc, tag, block, text, low, high, index = (x[order] for x in (doc, tag, block.astype(np.int64), text.astype(np.int64), low, high, index))
        same = _groups(block, text)
        begin = np.searchsorted(same, np.arange(same[-1] + 1))
        later = doc > doc[begin][same]
        of = _groups(block)
        texts = np.bincount(of[begin])[of]
        many = (texts >= MANY) & ~later
        one = ~later & ~many
        yield _batch(h=block[one], c=text[one], doc=doc[one], tag=tag[one], at=_packed(low[one], high[one], index[one]))
        # a witness for each block that is settled window by window
        witness = np.flatnonzero(many & np.concatenate([[True], of[1:] != of[:-1]]))
        known = np.zeros(of[-1] + 1, bool)
        np.logical_or.at(known, of, index)
        yield _batch(h=block[witness], c=np.full(len(witness), APART), doc=doc[witness], tag=tag[witness], at=known[of[witness]].astype(np.int64))
        for rows, says in ((later, SETTLED), (many, APART)):
            d, t, a, b = _merged(doc[rows], tag[rows], low[rows], high[rows])
            yield _passing(d, t, says, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, size, total = [], [], 0, 0

        def work(pieces: list[tuple[int, int, Piece]]):
            piece, block, text, low, high, index = plan.anchors([p for _, _, p in pieces])
            ids, tags = np.array([d for d, _, _ in pieces], np.int64), np.array([t for _, t, _ in pieces], np.int64)
            parts.append((ids[piece], tags[piece], block, text, low, high, index))

        for batch in slices(batches):
            for doc, text, tag in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if doc is None or not text:
                    continue
                data = text.encode()
                for piece in plan.units.pieces(0, data, plan.window):
                    waiting.append((doc, tag, piece))
                    size += len(piece[2])
                    total += len(piece[2])
                    if size >= CHUNK:
                        work(waiting)
                        waiting, size = [], 0
                    if total >= FLUSH:
                        if parts and sum(len(p[0]) for p in parts):
                            yield from send(parts)
                        parts.clear()
                        total = 0
        if waiting:
            work(waiting)
        if parts and sum(len(p[0]) for p in parts):
            yield from send(parts)

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first column, cut only where it changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and np.asarray(held[-1].column(0))[-1] != key[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, says, h, low, high) from sorted anchor rows."""
    for batch in _whole_groups(batches):
        h, c, doc, tag, at = _numbers(batch)
        order = np.lexsort((doc, c, h))
        h, c, doc, tag, at = (x[order] for x in (h, c, doc, tag, at))
        low = at >> LENGTH_BITS
        passing = h < 0
        if passing.any():
            says = -1 - c[passing]
            yield _batch(doc=doc[passing], tag=tag[passing], says=np.where(says & 1, APART, SETTLED).astype(np.int8), h=np.zeros(len(says), np.int64), low=low[passing], high=low[passing] + (says >> 1))
        h, c, doc, tag, at, low = (x[~passing] for x in (h, c, doc, tag, at, low))
        i, high = (at & 1).astype(bool), low + ((at & (1 << LENGTH_BITS) - 1) >> 1)
        if not len(h):
            continue
        of, same = _groups(h), _groups(h, c)
        begin = np.searchsorted(same, np.arange(same[-1] + 1))
        later = (doc > doc[begin][same]) & (c >= 0)
        texts, indexed, apart = np.bincount(of[begin]), np.zeros(of[-1] + 1, bool), np.zeros(of[-1] + 1, bool)
        np.logical_or.at(indexed, of, i)
        np.logical_or.at(apart, of, c == APART)
        opened = ~later & (c >= 0) & ((texts > 1) & indexed | apart)[of]
        d, t, a, b = _merged(doc[later], tag[later], low[later], high[later])
        yield _batch(doc=d, tag=t, says=np.full(len(d), SETTLED, np.int8), h=np.zeros(len(d), np.int64), low=a, high=b)
        says = np.where(apart[of[opened]], APART, OPEN).astype(np.int8)
        yield _batch(doc=doc[opened], tag=tag[opened], says=says, h=h[opened], low=low[opened], high=high[opened])


def _window_rows(plan: Plan) -> Callable:
    """(key, doc, tag, low, high, names) of open windows, from (doc, text, tag, spans)."""

    def send(lists: list[tuple], single: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if lists:
            key, doc, tag, low, high, names = zip(*lists, strict=True)
            yield _batch(key=np.array(key, np.int64), doc=np.array(doc, np.int64), tag=np.array(tag, np.int64), low=np.array(low, np.int64), high=np.array(high, np.int64), names=pa.array(names, pa.binary()))
        if single:
            doc, tag, low, name = (np.concatenate(c) for c in zip(*single, strict=True))
            order = np.lexsort((doc, name))
            doc, tag, low, name = doc[order], tag[order], low[order], name[order]
            same = _groups(name)
            later = doc > doc[np.searchsorted(same, np.arange(same[-1] + 1))][same]
            d, t, a, b = _merged(doc[later], tag[later], low[later], low[later])
            yield _batch(key=_own_key(d, t), doc=d, tag=t, low=a, high=b, names=pa.nulls(len(d), pa.binary()))
            doc, tag, low, name = doc[~later], tag[~later], low[~later], name[~later]
            yield _batch(key=(_mixed(name) >> np.uint64(1)).astype(np.int64), doc=doc, tag=tag, low=low, high=low, names=pa.array([x.tobytes() for x in name], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, single, size = [], [], 0
        for batch in slices(batches):
            for doc, text, tag, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if doc is None or not text or not spans:
                    continue
                data = text.encode()
                for piece in plan.units.pieces(0, data, plan.window):
                    names = run_names(plan.units.names([piece[2]])[0], plan.window)
                    from_, upto = piece[1], piece[1] + len(names) - 1
                    places = []
                    for span in spans:
                        low, high = max(span["low"], from_), min(span["high"], upto)
                        if low > high:
                            continue
                        if span["says"] == OPEN:
                            got = plan.units.payload(piece[2], names, low - from_, high - from_, plan.window)
                            lists.append((span["h"], doc, tag, low, high, got))
                            size += len(got) + 40
                        else:
                            places.append(np.arange(low, high + 1))
                    if places:
                        places = np.unique(np.concatenate(places))
                        single.append((np.full(len(places), doc), np.full(len(places), tag), places, names[places - from_]))
                        size += 40 * len(places)
                    if size >= FLUSH * 4:
                        yield from send(lists, single)
                        lists, single, size = [], [], 0
        yield from send(lists, single)

    return run


def _settle(plan: Plan) -> Callable:
    """(doc, tag, low, high) of the windows that an earlier document has, from rows sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            passing = pa.compute.is_null(batch.column(5))
            aside = batch.filter(passing)
            if aside.num_rows:
                yield _batch(doc=np.asarray(aside.column(1)), tag=np.asarray(aside.column(2)), low=np.asarray(aside.column(3)), high=np.asarray(aside.column(4)))
            rows = batch.filter(pa.compute.invert(passing))
            if rows.num_rows:
                yield from settle(rows)

    def settle(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # 8 bytes are the name of one window, sent alone or as a list of one: both meet the lists of their key
        one = pa.compute.equal(pa.compute.binary_length(rows.column(5)), 8)
        ones = pa.compute.sum(one).as_py()
        rows = pa.Table.from_batches([rows.filter(one), rows.filter(pa.compute.invert(one))]).combine_chunks()
        key, doc, tag, low, high = (np.asarray(rows.column(k)) for k in range(5))
        n = high - low + 1
        payloads = rows.column(5).to_pylist()
        name = np.frombuffer(b"".join(payloads[:ones]), np.uint64) if ones else np.empty(0, np.uint64)
        if ones < len(payloads):
            name = np.concatenate([name, plan.units.window_names(payloads[ones:], n[ones:], plan.window)])
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - (np.cumsum(n) - n)[row] + low[row]
        key, doc, tag = key[row], doc[row], tag[row]
        order = np.lexsort((doc, name, key))
        key, doc, tag, name, place = key[order], doc[order], tag[order], name[order], place[order]
        same = _groups(key, name)
        later = doc > doc[np.searchsorted(same, np.arange(same[-1] + 1))][same]
        d, t, a, b = _merged(doc[later], tag[later], place[later], place[later])
        yield _batch(doc=d, tag=t, low=a, high=b)

    return run


def repeated_spans(docs: DataFrame, plan: Plan, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Documents dealt out by id with a ``__tag`` that tells rows of one id apart, and the ranges
    of windows to remove by ``__doc`` and ``__of``, the id and tag."""
    ids = docs.groupBy(F.col(doc_id).alias("doc")).count()
    repeats = not ids.where("doc IS NOT NULL AND count > 1").isEmpty()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id with equal texts lose the same; rows without an id are only dealt by it
    tag = F.xxhash64(text) if repeats else F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    tagged = docs.withColumn("__tag", tag)
    body = tagged.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"), "__tag")
    anchors = body.mapInArrow(_anchor_rows(plan), "h long, c long, doc long, tag long, at long")
    ranked = cut_lineage(anchors.repartition("h").sortWithinPartitions("h").mapInArrow(_rank, "doc long, tag long, says byte, h long, low long, high long"))
    dealt = tagged.repartition(n, F.col(doc_id), F.col("__tag"))
    row = [F.col("doc").alias("__doc"), F.col("tag").alias("__of")]
    opened = ranked.where(F.col("says") != SETTLED).groupBy(*row).agg(F.collect_list(F.struct("says", "h", "low", "high")).alias("__spans"))
    # a left join and no filter: so both uses of the dealt documents are one exchange
    asked = joined(dealt, opened, doc_id).select(F.col(doc_id).cast("bigint").alias("doc"), F.when(F.col("__spans").isNotNull(), F.col(text)).alias("text"), "__tag", F.col("__spans").alias("spans"))
    windows = asked.mapInArrow(_window_rows(plan), "key long, doc long, tag long, low long, high long, names binary")
    settled = windows.repartition("key").sortWithinPartitions("key").mapInArrow(_settle(plan), "doc long, tag long, low long, high long")
    spans = ranked.where(F.col("says") == SETTLED).select("doc", "tag", "low", "high").unionByName(settled)
    return dealt, spans.groupBy(*row).agg(F.collect_list(F.struct("low", "high")).alias("__spans"))


def joined(dealt: DataFrame, spans: DataFrame, doc_id: str) -> DataFrame:
    """Every dealt document with its spans, if it has any."""
    return dealt.join(spans, (F.col(doc_id) == F.col("__doc")) & (F.col("__tag") == F.col("__of")), "left")


def covered(spans: list[dict] | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of units under the windows of one row."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = np.array([(s["low"], s["high"]) for s in spans], np.int64).T
    same = np.zeros(len(low), np.int64)
    _, _, a, b = _merged(same, same, low, high + window - 1)
    return a, b + 1
