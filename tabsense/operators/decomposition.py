"""Correlation and PCA from one Gram-matrix scan.

Every task sums, over its Arrow batches, the products of all pairs of
columns at once (matrix products over centred values, nulls masked), and
hands out one row per pair; the rows are added up by pair.  The plan has one
node whatever the number of columns, and only p x p sums reach the driver,
where PCA takes the eigenvalues.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.numeric import col

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_sums(df: DataFrame, cols: list[str]) -> dict[str, np.ndarray]:
    """p x p matrices over the rows where both columns of a pair hold a value
    (null and NaN do not count): ``n``, and the sums of x, y, x^2, y^2 and xy
    of values centred at their column's mean (x: the matrix row's column)."""
    p = len(cols)
    data = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    means = data.agg(*[F.avg(f"c{i}") for i in range(p)]).first()
    centre = np.array([m or 0.0 for m in means])
    sums = _SUMS
    i, j = np.triu_indices(p)

    def run(batches):
        total = np.zeros((6, p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())] + [pa.array(t[i, j]) for t in total],
                                         names=["i", "j", *sums])

    rows = (data.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
            .groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums]).collect())
    out = {s: np.zeros((p, p)) for s in sums}
    swapped = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
    for r in rows:
        for s in sums:
            out[s][r["i"], r["j"]] = r[s]
            out[swapped.get(s, s)][r["j"], r["i"]] = r[s]
    return out


def correlations(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Pearson r of every pair on its complete rows; NaN where a side is
    constant or no row is complete."""
    g = pair_sums(df, cols)
    with np.errstate(all="ignore"):
        n = g["n"]
        cov = g["sxy"] - g["sx"] * g["sy"] / n
        vx, vy = g["sxx"] - g["sx"] ** 2 / n, g["syy"] - g["sy"] ** 2 / n
        # what rounding leaves of a constant column's variance is no variance
        flat = (vx <= 1e-12 * g["sxx"]) | (vy <= 1e-12 * g["syy"]) | (vx <= 0) | (vy <= 0)
        r = np.where(flat | (n == 0), np.nan, cov / np.sqrt(vx * vy))
    return np.clip(r, -1.0, 1.0)


def covariance_matrix(df: DataFrame, cols: list[str], standardize: bool) -> tuple[np.ndarray, int]:
    """Sample covariance (of columns divided by their population deviation
    when ``standardize``; constant columns stay 0) and the number of rows;
    every row is complete."""
    g = pair_sums(df, cols)
    n = int(g["n"].max()) if len(cols) else 0
    if n < 2:
        return np.zeros((len(cols), len(cols))), n
    cov = (g["sxy"] - g["sx"] * g["sy"] / n) / (n - 1)
    if standardize:
        scale = np.sqrt(np.clip(np.diag(cov) * (n - 1) / n, 0, None))
        scale[scale == 0] = 1.0
        cov = cov / scale[:, None] / scale[None, :]
    return cov, n


def pca_table(df: DataFrame, cols: list[str], standardize: bool) -> DataFrame:
    """component, eigenvalue, explained_pct, cumulative_pct (sklearn PCA
    ``explained_variance_`` semantics: sample covariance)."""
    spark = df.sparkSession
    schema = "component string, eigenvalue double, explained_pct double, cumulative_pct double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    cov, n = covariance_matrix(df, cols, standardize)
    if n < 2:
        return spark.createDataFrame([], schema)
    eig = np.sort(np.linalg.eigvalsh(cov))[::-1]
    eig = np.clip(eig, 0.0, None)
    k = min(len(cols), n)
    eig = eig[:k]
    total = float(cov.trace())
    ratio = eig / total * 100.0 if total > 0 else np.zeros_like(eig)
    cum = np.cumsum(ratio)
    rows = [(f"PC{i + 1}", float(eig[i]), float(ratio[i]), float(cum[i])) for i in range(k)]
    return spark.createDataFrame(rows, schema)
