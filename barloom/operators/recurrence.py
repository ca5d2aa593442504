"""Recurrences along an ordered series.

Windows cannot express a value that depends on its own past, and a higher-order
aggregate that appends to an array measured 5-10x slower than an Arrow batch per
instrument (its interpreted lambdas cost about 100 us per row). So everything a window
can make is made by windows first, and only the remaining state machine runs in Arrow.

`scan_blocks` steps through time once for a block of many instruments: a recipe sees one
matrix per column, a row per bar and a column per instrument, and NaN where a value is
missing. `scan` hands a recipe the lists of one instrument. An instrument has at most one
row per trading day (see `sources.views`), so either is bounded by the calendar whatever
the skew of the ticks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Series = list  # floats and None
Recipe = Callable[[dict[str, Series]], dict[str, Series]]
BlockRecipe = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]
BLOCK = 1 << 17  # rows of a block
LENGTHS = ""  # a block's numbers of bars stand under this name


def by_instrument(df: DataFrame, key: str = "code") -> DataFrame:
    """Hash-partition by instrument once, at the session's shuffle width.

    The width is given explicitly because coalescing by bytes would put compute-heavy
    scans of small rows into a few tasks. Windows and `scan` on the same key reuse it.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, key)


def scan(
    df: DataFrame,
    recipe: Recipe,
    inputs: Sequence[str],
    outputs: Sequence[str],
    key: str = "code",
    order: str = "day",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Apply a recipe to each instrument's series; returns key, order, carry and the outputs as doubles."""
    types = dict(df.dtypes)
    cols = list(dict.fromkeys([key, order, *carry, *inputs]))
    kept = [key, order, *carry]
    schema = ", ".join([f"`{n}` {types[n]}" for n in kept] + [f"`{n}` double" for n in outputs])
    used, made = list(inputs), list(outputs)

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by(order)
        got = recipe({n: batch.column(n).to_pylist() for n in used})
        arrays = [batch.column(n) for n in kept] + [pa.array(got[n], type=pa.float64()) for n in made]
        return pa.table(dict(zip([*kept, *made], arrays)))

    return df.select(*cols).groupBy(key).applyInArrow(run, schema)


def similar(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the lengths in groups, none below half of its group's longest unless all are short: padding stays small."""
    order = np.argsort(-lengths, kind="stable")
    falling = -lengths[order]
    at = 0
    while at < len(order):
        top = -falling[at]
        end = len(order) if top <= 64 else int(np.searchsorted(falling, -(top // 2), side="right"))
        yield order[at:end]
        at = end


def in_blocks(table: pa.Table, recipe: BlockRecipe, key: str, used: Sequence[str], made: Sequence[str]) -> list[pa.Array]:
    """The outputs for a table of whole instruments, each in time order."""
    ends = pc.run_end_encode(table.column(key).combine_chunks()).run_ends.to_numpy()
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    values = {n: table.column(n).cast(pa.float64()).to_numpy() for n in used}
    out = {n: np.full(table.num_rows, np.nan) for n in made}
    for group in similar(lengths):
        many = lengths[group]
        column = np.repeat(np.arange(len(group)), many)
        bar = np.arange(len(column)) - np.repeat(np.cumsum(many) - many, many)
        rows = np.repeat(starts[group], many) + bar
        block = {LENGTHS: many}
        for n in used:
            block[n] = np.full((int(many.max()), len(group)), np.nan)
            block[n][bar, column] = values[n][rows]
        with np.errstate(all="ignore"):
            got = recipe(block)
        for n in made:
            out[n][rows] = got[n][bar, column]
    return [pa.array(out[n], mask=np.isnan(out[n])) for n in made]


def scan_blocks(df: DataFrame, recipe: BlockRecipe, inputs: Sequence[str], outputs: Sequence[str], key: str = "code", order: str = "day", carry: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """`scan` for a recipe over blocks. All rows of an instrument must be in one partition, as after `by_instrument` or a
    window by key; a task holds one block and the start of the next. `ordered` rows stand as another such pass left them."""
    types = dict(df.dtypes)
    cols = list(dict.fromkeys([key, order, *carry, *inputs]))
    kept = [key, order, *carry]
    schema = ", ".join([f"`{n}` {types[n]}" for n in kept] + [f"`{n}` double" for n in outputs])
    used, made = list(inputs), list(outputs)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        arrays = [table.column(n) for n in kept] + in_blocks(table, recipe, key, used, made)
        yield from pa.table(dict(zip([*kept, *made], arrays))).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                ends = pc.run_end_encode(table.column(key).combine_chunks()).run_ends
                whole = ends[-2].as_py() if len(ends) > 1 else 0
                if whole:
                    yield from done(table.slice(0, whole).combine_chunks())
                held, rows = table.slice(whole).to_batches(), rows - whole
        if rows:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    df = df.select(*cols)
    return (df if ordered else df.sortWithinPartitions(key, order)).mapInArrow(run, schema)


# --- building blocks: matrices of bars by instruments, NaN where a value is missing ------------------


def _lists_too(fn):
    """Let a building block take the list of one series, with None for missing values, and return one."""

    @wraps(fn)
    def either(x, *args, **kwargs):
        if isinstance(x, np.ndarray):
            return fn(x, *args, **kwargs)
        with np.errstate(all="ignore"):
            got = fn(np.array(x, dtype=float).reshape(-1, 1), *args, **kwargs)
        return [None if v != v else v for v in got[:, 0].tolist()]

    return either


def _seeded(x: np.ndarray, period: int, step: Callable, restart: bool, hold: bool) -> np.ndarray:
    """A smoothing that starts from the mean of the first `period` values; `restart` asks for consecutive ones.

    A missing input holds the state; its output is the held value or missing.
    """
    value, total, count = np.full(x.shape[1], np.nan), np.zeros(x.shape[1]), np.zeros(x.shape[1], dtype=int)
    out = np.empty_like(x)
    for t, v in enumerate(x):
        there, seeding = ~np.isnan(v), np.isnan(value)
        value = np.where(there & ~seeding, step(value, v), value)
        if seeding.any():
            add = there & seeding
            if restart:
                total, count = np.where(there, total, 0.0), np.where(there, count, 0)
            total, count = np.where(add, total + v, total), count + add
            value = np.where(add & (count == period), total / period, value)
        out[t] = value if hold else np.where(there, value, np.nan)
    return out


@_lists_too
def ema(x, period: int, leading: bool = False):
    """EMA seeded with the mean of the first `period` values.

    A missing input yields a missing output and holds the state. The seed needs
    consecutive values unless `leading` is set.
    """
    k = 2.0 / (period + 1)
    return _seeded(x, period, lambda value, v: v * k + value * (1 - k), restart=not leading, hold=False)


@_lists_too
def ema_from(x, period: int, start: float | None = None):
    """EMA that starts from a given value, or from the first input."""
    k, value, out = 2.0 / (period + 1), start, np.empty_like(x)
    for t, v in enumerate(x):
        value = v if value is None else v * k + value * (1 - k)
        out[t] = value
    return out


@_lists_too
def rma(x, period: int):
    """Wilder smoothing: mean of the first `period` values, then (prev * (p - 1) + x) / p."""
    return _seeded(x, period, lambda value, v: (value * (period - 1) + v) / period, restart=False, hold=True)


@_lists_too
def wilder_sum(x, period: int):
    """Wilder running sum: sum of the first `period` values, then s - s / p + x."""
    value, total, out = None, 0.0, np.full_like(x, np.nan)
    for t, v in enumerate(x):
        if value is None:
            total = total + v
            value = total if t + 1 == period else None
        else:
            value = value - value / period + v
        if value is not None:
            out[t] = value
    return out


@_lists_too
def blend(x, start: float):
    """Two thirds of the past and one third of the input, from `start`; missing inputs are skipped."""
    value, out = np.full(x.shape[1], start), np.empty_like(x)
    for t, v in enumerate(x):
        there = ~np.isnan(v)
        value = np.where(there, (2 * value + v) / 3, value)
        out[t] = np.where(there, value, np.nan)
    return out


def before(x: np.ndarray) -> np.ndarray:
    """The previous bar's value."""
    out = np.full_like(x, np.nan)
    out[1:] = x[:-1]
    return out


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the last n bars, oldest first; missing until n bars are there and where one of them has no value."""
    out = np.full_like(x, np.nan)
    if len(x) >= n:
        out[n - 1 :] = 0.0
        for j in range(n):
            out[n - 1 :] += x[j : len(x) - n + 1 + j]
    return out


def rolling_std(x: np.ndarray, n: int) -> np.ndarray:
    """Population deviation of the last n bars."""
    out, mean = np.full_like(x, np.nan), rolling(x, n)[n - 1 :] / n
    if len(x) >= n:
        total = np.zeros_like(mean)
        for j in range(n):
            total += (x[j : len(x) - n + 1 + j] - mean) ** 2
        out[n - 1 :] = np.sqrt(total / n)
    return out


def extreme(x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """np.maximum or np.minimum of the last n bars, missing as in `rolling`."""
    out = np.full_like(x, np.nan)
    if len(x) >= n:
        out[n - 1 :] = x[: len(x) - n + 1]
        for j in range(1, n):
            out[n - 1 :] = of(out[n - 1 :], x[j : len(x) - n + 1 + j])
    return out


def partial(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values among the last n bars, fewer at the start; missing without any."""
    there, total, count = ~np.isnan(x), np.zeros_like(x), np.zeros(x.shape, dtype=int)
    x = np.where(there, x, 0.0)
    for j in range(min(n, len(x)) - 1, -1, -1):
        total[j:] += x[: len(x) - j]
        count[j:] += there[: len(x) - j]
    return np.where(count > 0, total, np.nan)
