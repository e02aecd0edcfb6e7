"""Running a Python text function over a column in Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship

#: A piece of work holds at most so many bytes of text, or one text.
BATCH_BYTES = 4 << 20


def by_bytes(batches: Iterable[pa.RecordBatch], text: str,
             budget: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has at most ``budget`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + budget, side="right")))
            yield b.slice(at, to - at)
            at = to


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted batches cut where a key begins: tables of about ``rows`` rows, or of one group."""
    held, n, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k) for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = last is not None and last != [c[0].as_py() for c in cols]
        for c in cols:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        last, at = [c[len(c) - 1].as_py() for c in cols], 0
        for s in np.flatnonzero(new).tolist():
            if n + s - at >= rows:
                yield pa.Table.from_batches([*held, b.slice(at, s - at)])
                held, n, at = [], 0, s
        held.append(b.slice(at))
        n += b.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


#: What clears the things a module keeps in a worker process from task to task.
FORGET: list[Callable[[], None]] = []


def forget():
    """Drop what earlier stages keep in this worker process: it serves all stages of a pipeline."""
    for clear in FORGET:
        clear()


def give_back():
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):       # a C library without it
        pass


def _given_back(fn):
    """``fn`` that ends by giving free memory back: a worker process serves many tasks."""
    def run(batches):
        yield from fn(batches)
        give_back()
    return run


def grouped(fn):
    """``fn`` of ``applyInArrow`` that gives free memory back after each group."""
    def run(t: pa.Table) -> pa.Table:
        out = fn(t)
        give_back()
        return out
    return run


def cogrouped(fn):
    """The same for two tables."""
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = fn(a, b)
        give_back()
        return out
    return run


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with a function of this package, which the workers are sent first."""
    ship(df.sparkSession)
    return df.mapInArrow(_given_back(fn), schema)


def with_columns(docs: DataFrame, text: str, keep: list[str], fields: str,
                 make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``keep`` columns of ``docs`` plus the columns ``fields`` that a function gives.

    ``make()`` runs once per task and returns the function: a list of texts (str or
    None) to one list per field. Rows go through one by one in their partition;
    nothing is shuffled.
    """
    out = T.StructType([docs.schema[k] for k in keep] + T.StructType.fromDDL(fields).fields)
    names = [f.name for f in out.fields]
    types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(),
             "int": pa.int32(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()),
             "binary": pa.binary()}
    kinds = [types[f.dataType.simpleString()] for f in T.StructType.fromDDL(fields).fields]

    name = names[keep.index(text)] if text in keep else "__text"

    def run(batches):
        fn = None
        for b in by_bytes(batches, name):
            fn = fn or make()
            made = fn(b.column(name).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))]
                + [pa.array(m, type=k) for m, k in zip(made, kinds)], names=names)

    more = [] if text in keep else [F.col(text).alias(name)]
    return arrow_map(docs.select(*keep, *more), run, out)


class Memo(dict):
    """A cache that is emptied when it holds ``limit`` entries: bounded memory."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self):
        if len(self) > self.limit:
            self.clear()
