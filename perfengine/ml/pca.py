"""Principal components of standardised columns.

PCA of standardised columns is the eigen-decomposition of their correlation
matrix. The matrix is one distributed aggregate (``corr_matrix``: means, then
centred cross-product sums); only the k x k eigen problem runs on the driver,
and the projection is a linear combination with literal coefficients inside
whole-stage codegen. No row ever leaves the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfengine.operators.correlation import corr_matrix


def components(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and unit eigenvectors (columns) of the correlation matrix.

    Each eigenvector's largest-magnitude entry is made positive (a fixed sign).
    """
    k = len(cols)
    c = np.eye(k)
    for r in corr_matrix(df, cols).collect():
        c[r["i"], r["j"]] = r["r"] if r["r"] is not None else 0.0
    w, v = np.linalg.eigh(c)
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    for j in range(k):
        if v[np.argmax(np.abs(v[:, j])), j] < 0:
            v[:, j] = -v[:, j]
    return w, v


def pca(df: DataFrame, cols: list[str], k: int | None = None) -> DataFrame:
    """Explained-variance ratio per component and its cumulative sum."""
    w, _ = components(df, cols)
    w = np.clip(w, 0.0, None)
    ratios = w / w.sum()
    k = k or len(cols)
    cum = np.cumsum(ratios)
    rows = [(i + 1, float(ratios[i]), float(cum[i])) for i in range(k)]
    return df.sparkSession.createDataFrame(rows, "component long, explained_variance_ratio double, cumulative double")


def pca_project(df: DataFrame, cols: list[str], k: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Rows projected on the first k components (PC1..PCk), population-std standardisation."""
    _, v = components(df, cols)
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    z = [(F.col(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, c in enumerate(cols)]
    pcs = []
    for j in range(k):
        e = None
        for i in range(len(cols)):
            term = z[i] * F.lit(float(v[i, j]))
            e = term if e is None else e + term
        pcs.append(e.alias(f"PC{j + 1}"))
    return df.select(*(keep or []), *pcs)
