"""Structured Streaming jobs: bars, de-duplication, running profiles and carried state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.operators.resample import ohlcv


def _timed(ticks: DataFrame, delay: str) -> DataFrame:
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stream_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Bars of tumbling (or sliding) windows; rows later than the delay are dropped."""
    rows = _timed(ticks, delay)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy("symbol", window.alias("w")).agg(*ohlcv()).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    rows = _timed(ticks, delay)
    return rows.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("ticks"), F.sum("volume").alias("volume")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks", "volume")


def stream_dedup(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    return _timed(ticks, delay).dropDuplicatesWithinWatermark(["symbol", "seq"])


def stream_profile(ticks: DataFrame) -> DataFrame:
    """Running counters for each symbol, in update or complete mode."""
    return ticks.groupBy("symbol").agg(F.count("*").alias("rows"), F.count("price").alias("prices"), F.min("price").alias("least"), F.max("price").alias("greatest"), F.sum("volume").alias("volume"))


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def stream_state(rows: DataFrame, made: str, kept: str, start: tuple, step, columns: tuple[str, ...] = ("ts", "seq", "price"), delay: str | None = None, expire: int | None = None) -> DataFrame:
    """``symbol`` and the columns ``made`` of each row by ``step(state, values) -> (state, out)``, with the state ``kept`` for each symbol.

    The same step functions run in batch under ``scan_state``.  Without ``delay`` the rows of a
    micro-batch are walked at once, in order of their first columns; its size is the source's to
    bound, and a row that comes in a later micro-batch than its successors is walked after them.
    With ``delay`` rows wait in the state until the watermark has passed them, so they are walked in
    order whatever micro-batches bring them, and later ones are dropped; a row more than ``expire``
    seconds after its symbol's last one starts anew, and the state of such a symbol leaves.  A null ``ts`` has no place
    in the order: with ``delay`` its row is dropped, without it comes last.
    """
    if expire is not None and delay is None:
        raise ValueError("a symbol can only expire by a watermark: give a delay")
    names = [field.strip().split(" ")[0] for field in made.split(",")]
    columns = list(columns)
    if delay is not None:
        rows = _timed(rows, delay).where("ts is not null")
    rows = rows.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, last, waiting = state.get if state.exists else (*start, None, None)
        parts = [b[[*columns, "_us"]] for b in batches if len(b)]
        if waiting:
            parts.insert(0, pa.ipc.open_stream(waiting).read_pandas())
        out, waits, held = [], None, tuple(held)
        if parts:
            found = pd.concat(parts, ignore_index=True).sort_values(columns[:2], kind="stable")
            if delay is not None:
                passed = found["_us"] <= state.getCurrentWatermarkMs() * 1000
                found, waits = found[passed], found[~passed]
            for us, values in zip(found["_us"].tolist(), found[columns].itertuples(index=False, name=None), strict=True):
                if expire is not None and last is not None and us - last > expire * 1_000_000:
                    held = start
                last = us if expire is not None else None
                held, row = step(held, values)
                out.append((key[0], values[0], *row))
        elif delay is not None and state.hasTimedOut:
            state.remove()
            return
        if delay is None:
            state.update((*held, last, None))
        else:
            state.update((*held, last, _packed(waits) if waits is not None and len(waits) else None))
            if waits is not None and len(waits):
                state.setTimeoutTimestamp(-(-int(waits["_us"].iloc[0]) // 1000))
            elif expire is not None and last is not None:
                state.setTimeoutTimestamp(max(last // 1000 + expire * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["symbol", "ts", *names])

    timeout = GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("symbol").applyInPandasWithState(run, f"symbol string, ts timestamp, {made}", f"{kept}, last bigint, waiting binary", "append", timeout)


def stream_trailing_stop(ticks: DataFrame, pct: float = 0.05, delay: str | None = None) -> DataFrame:
    """A live trailing stop for each symbol: the highest price so far and whether the last one is through the stop."""

    def step(state: tuple, values: tuple) -> tuple[tuple, tuple]:
        (top,), price = state, values[2]
        top = max(top, price)
        return (top,), (price, top, price <= top * (1 - pct))

    return stream_state(ticks, "price double, top double, stopped boolean", "top double", (float("-inf"),), step, delay=delay)


def stream_renko(ticks: DataFrame, brick: float, delay: str | None = None) -> DataFrame:
    """Live bricks: how many (signed) each tick adds, and the last brick's close."""

    def step(state: tuple, values: tuple) -> tuple[tuple, tuple]:
        (base,), price = state, values[2]
        if base != base:
            return (price,), (0, price)
        n = int(abs(price - base) / brick) * (1 if price > base else -1)
        return (base + n * brick,), (n, base + n * brick)

    return stream_state(ticks, "bricks long, base double", "base double", (float("nan"),), step, delay=delay)


def stream_latest_signal(signals: DataFrame, delay: str | None = None) -> DataFrame:
    """Live signals: the action that each new signal asks for after the one before."""

    def step(state: tuple, values: tuple) -> tuple[tuple, tuple]:
        (held,), now = state, int(values[2])
        action = "CLOSE" if now == 0 and held != 0 else "BUY" if now > 0 >= held else "SELL_SHORT" if now < 0 <= held else "HOLD"
        return (now,), (now, action)

    return stream_state(signals, "signal long, action string", "held long", (0,), step, ("ts", "seq", "signal"), delay)
