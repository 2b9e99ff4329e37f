"""Vector columns as numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that can be compared.

    Left out: null ids; vectors that are null, empty, zero or hold null or non-finite components.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    limit = F.lit(float("inf"))
    good = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (x != limit) & (x != -limit), F.lit(False)))
    return rows.filter("vec_id is not null and embedding is not null and size(embedding) > 0").filter(good).filter(F.exists("embedding", lambda x: x != 0))


def by_length(rows: DataFrame) -> list[DataFrame]:
    """Rows of each vector length, which alone can be compared; a table without rows is its own one part."""
    lengths = sorted(r.n for r in rows.select(F.size("embedding").alias("n")).distinct().collect())  # a row a length
    return [rows.filter(F.size("embedding") == n) for n in lengths] or [rows]


def element_type(table: DataFrame, embedding: str = "embedding") -> str:
    """How the components are kept in blobs: as they are."""
    return "<f4" if table.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"


def matrix(rows, kind: str) -> np.ndarray:
    """Rows of equal length as a matrix of the column's own type.

    Rows of doubles whose squares would leave the type's range are multiplied by a power of two, which changes no cosine.
    """
    if not len(rows):
        return np.zeros((0, 0), kind)
    x = np.stack([np.asarray(r, dtype=kind) for r in rows])
    if kind == "<f8":
        top = np.abs(x).max(axis=1)
        far = np.flatnonzero((top > 1e100) | (top < 1e-100))
        x[far] = np.ldexp(x[far], -np.frexp(top[far])[1][:, None])
    return x


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths in double precision; the same for equal rows wherever they stand."""
    x = x.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, in double precision and independent of the rows around."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.einsum("ij,ij->i", x, y) / (norms(x) * norms(y))
