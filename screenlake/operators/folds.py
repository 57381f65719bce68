"""Ordered folds whose memory is their state, not their group.

``fold_sorted`` deals rows by group, lets Spark sort them (on disk if need be) and runs one pass over
each group's rows as they stream by.  There is one path for groups of every size.  Callers cut groups
into parts that cannot influence each other first, so that a large group is many folds.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 8192  # rows of a batch that goes back to Spark


def _values(column: pa.Array) -> list:
    """The values of a column as Python objects; plain ones without nulls by the shorter way."""
    kind = column.type
    plain = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind)
    return column.to_numpy(zero_copy_only=False).tolist() if plain and not column.null_count else column.to_pylist()


def fold_sorted(rows: DataFrame, keys: Sequence[str], order: Sequence, schema: T.StructType, fold: Callable[[Iterator[tuple]], Iterator[tuple]], dealt: bool = False) -> DataFrame:
    """``fold`` gets the rows of one group in order, as tuples of the columns of ``rows``, and
    yields rows of ``schema``; ``keys`` are the first columns of ``rows``.  ``dealt``: the rows are
    dealt by some of the keys already and are only sorted."""
    n, fields = len(keys), to_arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*map(_values, batch.columns), strict=True)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, group in groupby(stream(batches), key=lambda r: r[:n]):
            for row in fold(group):
                out.append(row)
                if len(out) == ROWS:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    return (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fold_beside(rows: DataFrame, keys: Sequence[str], order: Sequence[str], uses: Sequence[str], field: T.StructField, fold: Callable[[Iterator[tuple]], Iterator]) -> DataFrame:
    """``rows``, dealt by ``keys`` already, with one more column: ``fold`` gets the keys and the
    columns ``uses`` of one group in order, as tuples, and yields one value for each.  The other
    columns pass by as they came."""
    n, kind = len(keys), to_arrow_schema(T.StructType([field])).field(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def stream() -> Iterator[tuple]:
            for batch in batches:
                waiting.append(batch)
                yield from zip(*(_values(batch.column(c)) for c in (*keys, *uses)), strict=True)

        out = []
        for _, group in groupby(stream(), key=lambda r: r[:n]):
            for value in fold(group):
                out.append(value)
                while waiting and len(out) >= waiting[0].num_rows:
                    batch = waiting.popleft()
                    column, out = pa.array(out[: batch.num_rows], kind.type), out[batch.num_rows :]
                    yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=batch.schema.append(kind))

    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, T.StructType([*rows.schema.fields, field]))


def iou(a: Sequence[float], b: Sequence[float]) -> float:
    """Intersection over union of (x, y, w, h), with the arithmetic of ``geometry.iou``."""
    iw = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    ih = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if iw <= 0 or ih <= 0:
        return 0.0
    inter = iw * ih
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0.0


class BoxIndex:
    """Boxes by number, found by IoU: boxes with IoU >= t have sides within a factor of 1/t, so
    each is kept on the grid of its own size and looked for on the neighbouring grids.  As long as
    they are few, boxes are compared one by one, which costs less than the grids."""

    FEW = 24

    def __init__(self, min_iou: float):
        self.min_iou, self.near = min_iou, math.ceil(math.log2(1 / min_iou))
        self.cells: dict[tuple[int, int, int], set[int]] | None = None
        self.levels: dict[int, int] = defaultdict(int)
        # x, y, w, h and the far edges
        self.boxes: dict[int, tuple[float, ...]] = {}

    @staticmethod
    def _level(box: Sequence[float]) -> int:
        return max(0, math.ceil(math.log2(max(box[2], box[3], 1.0))))

    @staticmethod
    def _cells(box: Sequence[float], level: int) -> Iterator[tuple[int, int, int]]:
        size = 2.0**level
        for cx in range(math.floor(box[0] / size), math.floor((box[0] + box[2]) / size) + 1):
            for cy in range(math.floor(box[1] / size), math.floor((box[1] + box[3]) / size) + 1):
                yield level, cx, cy

    def put(self, number: int, box: Sequence[float]) -> None:
        """Adds a box, or moves the one of this number."""
        old = self.boxes.get(number)
        self.boxes[number] = (*box, box[0] + box[2], box[1] + box[3])
        if self.cells is None:
            if len(self.boxes) > self.FEW:
                self.cells = defaultdict(set)
                for n, b in self.boxes.items():
                    self._enter(n, b)
            return
        if old is not None:
            self.levels[self._level(old)] -= 1
            for cell in self._cells(old, self._level(old)):
                self.cells[cell].discard(number)
        self._enter(number, box)

    def _enter(self, number: int, box: Sequence[float]) -> None:
        self.levels[self._level(box)] += 1
        for cell in self._cells(box, self._level(box)):
            self.cells[cell].add(number)

    def first(self, box: Sequence[float]) -> tuple[int, float] | None:
        """The smallest number with IoU >= ``min_iou``, and that IoU."""
        if self.cells is None:
            x, y, w, h = box
            right, bottom, best = x + w, y + h, None
            for number, other in self.boxes.items():
                # boxes that lie apart have no IoU
                if other[4] > x and right > other[0] and other[5] > y and bottom > other[1] and (best is None or number < best[0]):
                    value = iou(other, box)
                    if value >= self.min_iou:
                        best = number, value
            return best
        own, found = self._level(box), set()
        for level in range(max(0, own - self.near), own + self.near + 1):
            if self.levels.get(level):
                for cell in self._cells(box, level):
                    found |= self.cells.get(cell, set())
        for number in sorted(found):
            value = iou(self.boxes[number], box)
            if value >= self.min_iou:
                return number, value
        return None
