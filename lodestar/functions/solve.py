"""Least squares by group from sums of products; only the small systems are solved outside the sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_FIT = T.StructType([T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("t", T.ArrayType(T.DoubleType())), T.StructField("r2", T.DoubleType())])


@F.pandas_udf(_FIT)
def _solve(moments: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Slopes, their t values and R squared from the sample covariances of y, x1, x2, ... (rows one after another)."""
    out = []
    for flat, rows in zip(moments, n, strict=True):
        s = np.array(flat, float) * (rows - 1)
        k = int(round(len(s) ** 0.5))
        s = s.reshape(k, k)
        xx, xy, yy = s[1:, 1:], s[1:, 0], s[0, 0]
        if rows <= k or np.isnan(s).any() or np.linalg.matrix_rank(xx) < k - 1 or yy <= 0:
            out.append((None, None, None))
            continue
        inverse = np.linalg.inv(xx)
        beta = inverse @ xy
        rest = max(0.0, yy - beta @ xy)
        error = np.sqrt(rest / (rows - k) * np.diag(inverse))
        out.append((beta.tolist(), [b / e if e > 0 else None for b, e in zip(beta, error, strict=True)], 1 - rest / yy))
    return pd.DataFrame(out, columns=["beta", "t", "r2"])


def least_squares(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """``by..., n, beta, t, r2`` of the regression of y on a constant and xs, over rows where all are given."""
    names = [y, *xs]
    rows = df.dropna(subset=names)
    pairs = [F.covar_samp(a, b) if a <= b else F.covar_samp(b, a) for a in names for b in names]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*pairs).alias("moments"))
    return sums.select(*by, "n", _solve("moments", F.col("n").cast("double")).alias("fit")).select(*by, "n", "fit.*")
