"""Correlations of all or many pairs of series at many lags, as products of blocks.

Returns are packed once into blocks of a tile of symbols by a chunk of times, the only shuffle of the
rows.  Each pair of tiles that holds a wanted pair gets the two blocks of a chunk in one group
of bounded size, where all lags of all its pairs are matrix products of values, squares and
presence; what leaves are six sums for each pair, lag and chunk, which add up to the correlation.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.windows import ratio

c = F.col
#: Symbols of a tile on average, and times of a chunk: a block takes some 64 * 2,048 * 8 bytes.
TILE, CHUNK = 64, 2048
#: Variances under this share of the mean square are taken for nought: a constant series.
_FLAT = 1e-12


class Packed(NamedTuple):
    """Blocks, the number of tiles, how far a chunk reaches into its neighbours, and its times."""

    blocks: DataFrame
    tiles: int
    reach: int
    chunk: int


def pack(rows: DataFrame, reach: int, symbols: int | None = None, chunk: int = CHUNK, tile: int = TILE) -> Packed:
    """Blocks to be used for lags up to ``reach``; ``symbols`` is about their number, which else takes a job over the rows."""
    tiles = max(1, -(-(rows.select("symbol").distinct().count() if symbols is None else symbols) // tile))
    return Packed(blocks(rows, tiles, reach, chunk), tiles, reach, chunk)


def blocks(rows: DataFrame, tiles: int, reach: int, chunk: int = CHUNK) -> DataFrame:
    """``tile, chunk, symbols, width, data``: the returns ``symbol, i, ret`` of a chunk and of ``reach`` times on both sides, nan where there are none.

    Returns are taken from their symbol's mean, which leaves correlations alone and keeps their digits.
    """
    rows = rows.where(c("ret").isNotNull() & ~F.isnan("ret")).withColumn("x", c("ret") - F.avg("ret").over(Window.partitionBy("symbol")))
    first, last = (F.floor((c("i") + d) / chunk) for d in (-reach, reach))
    rows = rows.select("symbol", "i", "x", F.pmod(F.xxhash64("symbol"), F.lit(tiles)).cast("int").alias("tile"), F.explode(F.sequence(first, last)).alias("chunk"))
    width = chunk + 2 * reach

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        codes, symbols = pd.factorize(part["symbol"])
        data = np.full((len(symbols), width), np.nan)
        data[codes, part["i"].to_numpy() - key[1] * chunk + reach] = part["x"]
        return pd.DataFrame({"tile": [key[0]], "chunk": [key[1]], "symbols": [list(symbols)], "width": [width], "data": [data.tobytes()]})

    return rows.groupBy("tile", "chunk").applyInPandas(pack, "tile int, chunk bigint, symbols array<string>, width int, data binary")


def _read(row: pd.Series, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, squares and presence of the symbols that are wanted, in their order; those without rows are absent."""
    data = np.frombuffer(row["data"]).reshape(len(row["symbols"]), row["width"])
    at = {s: k for k, s in enumerate(row["symbols"])}
    out = np.full((len(names), row["width"]), np.nan)
    for k, name in enumerate(names):
        if name in at:
            out[k] = data[at[name]]
    there = ~np.isnan(out)
    x = np.where(there, out, 0.0)
    return x, x * x, there.astype(float)


def lag_sums(packed: Packed, pairs: DataFrame | None, lags: int) -> DataFrame:
    """``a, b, lag, n, sx, sy, sxx, syy, sxy`` of the pairs (None: every two symbols, ``a < b``) at the lags from -lags to lags.

    At a lag the return of ``a`` at i meets that of ``b`` at i + lag, where both are there.
    """
    cut, tiles, reach, chunk = packed
    if lags > reach:
        raise ValueError(f"packed for lags up to {reach}, not {lags}")
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(tiles)).cast("int")
    if pairs is None:
        each = cut.sparkSession.range(tiles).select(c("id").cast("int").alias("p"))  # a row for each two tiles
        wanted = each.select("p", F.explode(F.sequence("p", F.lit(tiles - 1))).alias("q"), F.lit(None).cast("array<struct<a:string,b:string>>").alias("pairs"))
    else:
        # a pair belongs to its lower tile first; at most tile * tile pairs are gathered for two tiles
        p, q = place("a"), place("b")
        wanted = pairs.select("a", "b", F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).distinct().groupBy("p", "q").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    sides = F.explode(F.array_distinct(F.array(c("p"), c("q")))).alias("tile")
    sent = cut.join(wanted.select("p", "q", "pairs", sides), "tile")

    def products(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        p, q, _ = key
        left, right = part[part["tile"] == p], part[part["tile"] == q]
        if not len(left) or not len(right):
            return empty()
        left, right = left.iloc[0], right.iloc[0]
        names = sorted(left["symbols"]), sorted(right["symbols"])
        if left["pairs"] is not None:
            asked = {(x["a"], x["b"]) for x in left["pairs"]}
            used = {n for pair in asked for n in pair}
            names = tuple([n for n in side if n in used] for side in names)
        (x, xx, mx), (y, yy, my) = _read(left, names[0]), _read(right, names[1])
        core = slice(reach, reach + chunk)
        x, xx, mx = x[:, core], xx[:, core], mx[:, core]
        order = np.array(names[0], object)[:, None] < np.array(names[1], object)[None, :]
        if left["pairs"] is None:
            keep = order if p == q else np.ones_like(order)
        else:
            keep = np.array([[(min(u, v), max(u, v)) in asked and (p != q or u < v) for v in names[1]] for u in names[0]], bool).reshape(order.shape)
        i, j = np.nonzero(keep)
        ahead = order[i, j]  # the left one is the pair's first
        u, v = np.array(names[0], object)[i], np.array(names[1], object)[j]
        out = []
        for k in range(-lags, lags + 1):
            at = slice(reach + k, reach + k + chunk)
            z, zz, mz = y[:, at], yy[:, at], my[:, at]
            n = (mx @ mz.T)[i, j]
            if not n.any():
                continue
            sums = [(s @ t.T)[i, j] for s, t in ((x, mz), (mx, z), (xx, mz), (mx, zz), (x, z))]
            swap = lambda s, t: np.where(ahead, s, t)
            frame = pd.DataFrame({"a": swap(u, v), "b": swap(v, u), "lag": np.where(ahead, k, -k).astype("int32"), "n": n.astype("int64"), "sx": swap(sums[0], sums[1]), "sy": swap(sums[1], sums[0]), "sxx": swap(sums[2], sums[3]), "syy": swap(sums[3], sums[2]), "sxy": sums[4]})
            out.append(frame[n > 0])
        return pd.concat(out) if out else empty()

    def empty() -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series(dtype=t) for n, t in zip(("a", "b", "lag", "n", "sx", "sy", "sxx", "syy", "sxy"), ("object", "object", "int32", "int64", *["float64"] * 5), strict=True)})

    made = sent.groupBy("p", "q", "chunk").applyInPandas(products, "a string, b string, lag int, n bigint, sx double, sy double, sxx double, syy double, sxy double")
    return made.groupBy("a", "b", "lag").agg(*(F.sum(x).alias(x) for x in ("n", "sx", "sy", "sxx", "syy", "sxy")))


def correlation() -> Column:
    """The correlation from the six sums; null where one of the two does not vary."""
    n = c("n").cast("double")
    vx, vy = (c(f"s{x}{x}") - c(f"s{x}") * c(f"s{x}") / n for x in "xy")
    varies = (vx > _FLAT * c("sxx")) & (vy > _FLAT * c("syy"))
    r = ratio(c("sxy") - c("sx") * c("sy") / n, F.sqrt(vx * vy))
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
