"""Recurrences over ordered rows, each in one pass over its input.

Rows are dealt by their keys, sorted, and read in Arrow batches; what a recurrence carries from
row to row is kept between batches for the key at hand, so a task holds one batch and one state,
and a plan evaluates its input once however many recurrences are chained.  ``linear_scan`` solves
y = a * y(before) + b, ``ewm`` chains of exponential means with their seeds, ``matrix_scan``
recurrences of vectors, ``clamp_scan`` y = min(max(y(before), low), high), and ``scan_state`` walks
any other state row by row.  Matrices and clamps are solved in blocks: all blocks of a batch are
walked side by side by arrays, each keeps what its steps amount to as one step, and the carries are
put in afterwards.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block that is walked from zero.
BLOCK = 64


def _blocks(x: np.ndarray, fill: float) -> np.ndarray:
    """``x`` cut along its first axis into rows of ``BLOCK``, filled up at the end."""
    n = -(-len(x) // BLOCK)
    out = np.full((n * BLOCK, *x.shape[1:]), fill)
    out[: len(x)] = x
    return out.reshape(n, BLOCK, *x.shape[1:])


def solve(a: np.ndarray, b: np.ndarray, start: np.ndarray | float = 0.0) -> np.ndarray:
    """y = a * y(before) + b down the rows, for each column, with ``start`` before the first row.

    Each column runs on plain floats in the order of the rows, so that its digits are those of the recurrence itself.
    """
    y = np.empty(b.shape)
    for k, first in enumerate(np.broadcast_to(start, b.shape[1:]).tolist()):
        steps = zip(a[:, k].tolist(), b[:, k].tolist(), strict=True)
        y[:, k] = list(itertools.accumulate(steps, lambda before, step: step[0] * before + step[1], initial=first))[1:]
    return y


def solve_matrix(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """y = a @ y(before) + b down the rows for vectors y, with ``start`` before the first row."""
    n, d = b.shape
    if not n:
        return b.astype(float)
    ab, bb = _blocks(a, 0.0), _blocks(b, 0.0)
    y, p = bb.copy(), ab.copy()
    for j in range(1, BLOCK):
        y[:, j] += np.einsum("kxy,ky->kx", ab[:, j], y[:, j - 1])
        p[:, j] = ab[:, j] @ p[:, j - 1]
    carry = np.empty((len(y), d))
    carry[0] = start
    for k in range(1, len(y)):
        carry[k] = p[k - 1, -1] @ carry[k - 1] + y[k - 1, -1]
    y += np.einsum("kjxy,ky->kjx", p, carry)
    return y.reshape(-1, d)[:n]


def solve_clamps(low: np.ndarray, high: np.ndarray, start: float) -> np.ndarray:
    """y = min(max(y(before), low), high) down the rows; two clamps one after the other are again a clamp."""
    n = len(low)
    if not n:
        return low.astype(float)
    lows, highs = _blocks(low, -np.inf), _blocks(high, np.inf)
    for j in range(1, BLOCK):
        before = lows[:, j - 1], highs[:, j - 1]
        lo, hi = lows[:, j].copy(), highs[:, j].copy()
        lows[:, j] = np.minimum(np.maximum(before[0], lo), hi)
        highs[:, j] = np.minimum(np.maximum(before[1], lo), hi)
    carry = np.empty(len(lows))
    carry[0] = start
    for k in range(1, len(lows)):
        carry[k] = min(max(carry[k - 1], lows[k - 1, -1]), highs[k - 1, -1])
    return np.minimum(np.maximum(carry[:, None], lows), highs).reshape(-1)[:n]


def walk(df: DataFrame, made: T.StructType, start: Callable[[], object], run: Callable[[pd.DataFrame, object], tuple[dict[str, np.ndarray], object]], keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``df`` with the columns ``made`` that ``run(rows of one key in order, state)`` gives, batch by batch."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), *made.fields])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, start()
        for batch in batches:
            if not len(batch):
                continue
            fresh = np.zeros(len(batch), bool)
            for k in keys:
                column = batch[k]
                same = (column == column.shift()) | (column.isna() & column.shift().isna())
                fresh |= ~same.to_numpy(bool)
            fresh[0] = True
            starts = np.flatnonzero(fresh)
            outs: dict[str, list[np.ndarray]] = {f.name: [] for f in made.fields}
            for lo, hi in zip(starts, [*starts[1:], len(batch)], strict=True):
                part = batch.iloc[lo:hi]
                key = tuple(None if pd.isna(v) else v for v in (part[k].iloc[0] for k in keys))
                if key != at:
                    at, state = key, start()
                found, state = run(part, state)
                for name, column in found.items():
                    outs[name].append(column)
            for f in made.fields:
                column = np.concatenate(outs[f.name])
                batch[f.name] = column if isinstance(f.dataType, T.DoubleType) else pd.array(column, dtype="Int64")
            yield batch

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(go, schema)


def _doubles(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def linear_scan(df: DataFrame, terms: dict[str, tuple[Column, Column]], keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """``df`` with a column y for each ``name: (a, b)``, where y = a * y(before) + b and y before the first row is 0.

    A null b repeats y; a null a counts as 0.
    """
    names, given = list(terms), df.columns
    for k, name in enumerate(names):
        a, b = terms[name]
        df = df.withColumns({f"_a{k}": F.when(b.isNull(), 1.0).otherwise(F.coalesce(a, F.lit(0.0))).cast("double"), f"_b{k}": F.coalesce(b, F.lit(0.0)).cast("double")})
    a_names, b_names = ([f"_{x}{k}" for k in range(len(names))] for x in "ab")

    def run(part: pd.DataFrame, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        y = solve(part[a_names].to_numpy(float), part[b_names].to_numpy(float), state)
        return {name: y[:, k] for k, name in enumerate(names)}, y[-1]

    out = walk(df, _doubles(names), lambda: np.zeros(len(names)), run, keys, (order,))
    return out.select(*(f"`{c}`" for c in given), *(f"`{n}`" for n in names))


def matrix_scan(df: DataFrame, names: list[str], matrix: list[list[Column | float]], vector: list[Column | float], keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """``df`` with the columns ``names`` of y = matrix @ y(before) + vector; y before the first row is zero.

    A recurrence with lags 1 to d is its companion matrix: the first row holds the factors, and
    each further row passes the value before on.
    """
    given, d = df.columns, len(names)
    cells = {f"_m{i}_{j}": x for i, row in enumerate(matrix) for j, x in enumerate(row)} | {f"_v{i}": x for i, x in enumerate(vector)}
    varied = {k: x.cast("double") for k, x in cells.items() if isinstance(x, Column)}
    fixed = {k: float(x) for k, x in cells.items() if not isinstance(x, Column)}  # the others are read from the batch

    def run(part: pd.DataFrame, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        get = lambda k: np.full(len(part), fixed[k]) if k in fixed else part[k].to_numpy(float)
        a = np.stack([np.stack([get(f"_m{i}_{j}") for j in range(d)], 1) for i in range(d)], 1)
        y = solve_matrix(a, np.stack([get(f"_v{i}") for i in range(d)], 1), state)
        return {name: y[:, k] for k, name in enumerate(names)}, y[-1]

    out = walk(df.withColumns(varied), _doubles(names), lambda: np.zeros(d), run, keys, (order,))
    return out.select(*(f"`{c}`" for c in given), *(f"`{n}`" for n in names))


def clamp_scan(df: DataFrame, name: str, low: Column, high: Column, keys: tuple[str, ...] = ("symbol",), order: str = "ts", start: float = 0.0) -> DataFrame:
    """``df`` with y = min(max(y(before), low), high); a null bound doesn't bind, y before the first row is ``start``."""
    given = df.columns
    df = df.withColumns({"_lo": F.coalesce(low, F.lit(float("-inf"))).cast("double"), "_hi": F.coalesce(high, F.lit(float("inf"))).cast("double")})

    def run(part: pd.DataFrame, state: float) -> tuple[dict[str, np.ndarray], float]:
        y = solve_clamps(part["_lo"].to_numpy(float), part["_hi"].to_numpy(float), state)
        return {name: y}, float(y[-1])

    return walk(df, _doubles([name]), lambda: start, run, keys, (order,)).select(*(f"`{c}`" for c in given), f"`{name}`")


def mean_of(x: np.ndarray, alpha: float, n: int, seed: str, state: tuple) -> tuple[np.ndarray, tuple]:
    """One exponential mean over rows that follow those that ``state`` has seen: rows, values, their sum, and y."""
    rows, seen, total, before = state
    there = ~np.isnan(x)
    i, c = rows + 1 + np.arange(len(x)), seen + np.cumsum(there)
    plain = np.where(there, x, 0.0)
    sums = total + np.cumsum(plain)
    a, b = np.where(there, 1.0 - alpha, 1.0), alpha * plain
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = sums / c
    if seed == "sma":
        late = (i > n) & (c == 1) & there  # no value among the first n rows: it starts with the first one
        at, begun = (i == n) & (c > 0), i > n
        a = np.where(begun & ~late, a, 0.0)
        b = np.where(at, mean, np.where(late, plain, np.where(begun, b, 0.0)))
        shown = (i >= n) & (c > 0)
    elif seed == "counted":
        at, begun = (c == n) & there, c > n
        a, b = np.where(at | (c < n), 0.0, a), np.where(at, mean, np.where(begun, b, 0.0))
        shown = c >= n
        if n > 1:
            a = np.where((c == n) & ~there, 1.0, a)
    else:
        at = (c == 1) & there
        a, b = np.where(at | (c == 0), 0.0, a), np.where(at, plain, np.where(c > 1, b, 0.0))
        a = np.where((c == 1) & ~there, 1.0, a)
        shown = (c >= n) & (c > 0)
    y = solve(a[:, None], b[:, None], np.array([before]))[:, 0]
    return np.where(shown, y, np.nan), (rows + len(x), int(c[-1]), float(sums[-1]), float(y[-1]))


def ewm(df: DataFrame, specs: list[tuple[str, str | tuple[str, str], float | str, int | str, str]], keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """Exponential means ``(name, column, alpha, n, seed)`` in one pass; a column may be a mean named before, or the difference of two.

    Seed ``sma``: row n holds the mean of the values among the first n rows, nothing stands
    before it; without any value there it starts with the first one.  Seed ``counted``: the n-th
    value holds the mean of the first n ones.  Seed ``first``: it starts with the first value and is
    shown from the n-th on.  Nulls repeat the mean.  Alpha and n may be names of columns that are
    the same in all rows of a key.
    """
    given, names = df.columns, [s[0] for s in specs]
    inputs = {x for s in specs for x in (s[1] if isinstance(s[1], tuple) else (s[1],)) if x not in names}
    wide = df.withColumns({f"_x{k}": F.col(x).cast("double") for k, x in enumerate(sorted(inputs))})
    at = {x: f"_x{k}" for k, x in enumerate(sorted(inputs))}

    def run(part: pd.DataFrame, state: dict) -> tuple[dict[str, np.ndarray], dict]:
        known = {x: part[name].to_numpy(float) for x, name in at.items()}
        for name, x, alpha, n, seed in specs:
            alpha, n = (part[v].iloc[0] if isinstance(v, str) else v for v in (alpha, n))
            values = known[x[0]] - known[x[1]] if isinstance(x, tuple) else known[x]
            known[name], state[name] = mean_of(values, float(alpha), int(n), seed, state.get(name, (0, 0, 0.0, 0.0)))
        return {name: known[name] for name in names}, state

    out = walk(wide, _doubles(names), dict, run, keys, (order,))
    null = lambda n: F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")).alias(n)
    return out.select(*(f"`{c}`" for c in given if c not in names), *map(null, names))


def scan_state(df: DataFrame, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple | None]], columns: list[str], made: T.StructType, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """``df`` with the columns ``made`` that ``step(state, values of columns)`` gives row by row, in order within each key."""
    given = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    schema = T.StructType([*given.fields, *made.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, start()
        for batch in batches:
            outs = []
            for key, values in zip(batch[list(keys)].itertuples(index=False, name=None), batch[columns].itertuples(index=False, name=None), strict=True):
                if key != at:
                    at, state = key, start()
                state, out = step(state, values)
                outs.append(out)
            for j, f in enumerate(made.fields):
                column = [o[j] for o in outs]
                batch[f.name] = pd.Series(column, index=batch.index, dtype="float64" if isinstance(f.dataType, T.DoubleType) else "Int64")
            yield batch

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
