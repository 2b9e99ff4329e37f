"""Whitening of embeddings with distributed block matrices (operator 11).

Entries become whole numbers, so that sums over all rows are exact. Centred rows, numbered from 0, are cut into
the blocks of an MLlib BlockMatrix; the product of its transpose with it is the scatter matrix, whose middle dimension is split, so that partial
products are summed in the tasks that hold the rows. The driver decomposes that one matrix, which has the size of a vector squared,
and a second product with the whitening matrix projects all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of one block; with 1,000 dimensions a block has 16 MB.
BLOCK_ROWS = 2048
#: Blocks whose products one task adds up.
BLOCKS_A_TASK = 16
#: Entries beyond this size stand for it, so that sums of squares stay finite.
LARGEST = 1 << 62


def whole_entries(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x) of the rows with a vector of finite entries; x holds floor(scale * entry) + shift as long."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("entries"))
    limit = F.lit(float("inf"))
    finite = F.forall("entries", lambda c: F.coalesce(~F.isnan(c) & (c != limit) & (c != -limit), F.lit(False)))
    near = lambda c: F.least(F.greatest(c.cast("double") * float(scale), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return rows.filter("entries is not null and size(entries) > 0").filter(finite).select("vec_id", F.transform("entries", lambda c: F.floor(near(c)) + F.lit(shift).cast("long")).alias("x"))


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` written with ``row``, 0 to n - 1, and n: a row's place in its task is stored with it, tasks' counts are summed up before it."""
    stored = materialize(rows.withColumn("spot", F.monotonically_increasing_id()), name)
    place = F.col("spot").bitwiseAND((1 << 33) - 1)
    parts = materialize(stored.groupBy(F.shiftright("spot", 33).alias("part")).agg(F.count("*").alias("n")), f"{name}-parts")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    bases = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    joined = stored.withColumn("part", F.shiftright("spot", 33)).join(bases, "part")
    return joined.withColumn("row", F.col("base") + place).drop("part", "base", "spot"), total


def exact_sums(rows: DataFrame, size: int) -> list[int]:
    """Sums of the entries by dimension, in integers of any size."""

    def task(batches):
        total = [0] * size
        for batch in batches:
            x = _longs(batch.column("x"), size)
            high, low = x >> 32, x & 0xFFFFFFFF  # neither sum can leave 64 bits
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
        from decimal import Decimal

        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["dim", "total"])

    sums = rows.select("x").mapInArrow(task, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    found = {r.dim: int(r.total) for r in sums.collect()}  # a row a dimension
    return [found.get(d, 0) for d in range(size)]


def _longs(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, size)


def _centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(row, deviation, centred): n * x - S exactly, the sum of its squares, and its quotient by n as doubles."""
    size = len(sums)
    middle = np.array([s // n for s in sums], object)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], object)

    def task(batches):
        for batch in batches:
            x = _longs(batch.column("x"), size)
            far = max((abs(int(v) - int(m)) for v, m in zip([*x.max(axis=0), *x.min(axis=0)], [*middle, *middle], strict=True)), default=0) if len(x) else 0
            kind = np.int64 if size * (n * (far + 1)) ** 2 < 1 << 62 else object
            y = n * (x.astype(kind) - middle.astype(kind)) - rest.astype(kind)
            squares = [int(v) for v in (y * y).sum(axis=1)]
            flat = pa.array((y / n).astype(np.float64).ravel())
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([v if v < 1 << 63 else None for v in squares], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), flat),
            ], ["row", "deviation", "centred"])

    return rows.select("row", "x").mapInArrow(task, "row long, deviation long, centred array<double>")


def _blocks(rows: DataFrame, n: int, size: int, column: str) -> BlockMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector(column).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, size).toBlockMatrix(BLOCK_ROWS, size)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product with its middle dimension in ``splits`` parts, which are added up where they are made."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _scatter(matrix: BlockMatrix, n: int) -> np.ndarray:
    """Transpose times matrix: as large as one vector squared, for the driver."""
    splits = max(1, math.ceil(n / BLOCK_ROWS / BLOCKS_A_TASK))
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def _rows(matrix: BlockMatrix, size: int, column: str) -> DataFrame:
    """(row, column) of a matrix with one column of blocks; row numbers are 64 bits."""
    blocks = callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model).toDF("place", "block")

    def task(batches):
        for batch in batches:
            for place, block in zip(batch.column("place").to_pylist(), batch.column("block").to_pylist(), strict=True):
                shape = (block["numRows"], block["numCols"])
                values = np.asarray(block["values"], float)
                values = values.reshape(shape) if block["isTransposed"] else values.reshape(shape[::-1]).T
                yield pa.RecordBatch.from_arrays([
                    pa.array(place["_1"] * BLOCK_ROWS + np.arange(shape[0]), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(shape[0] + 1) * size, pa.int32()), pa.array(np.ascontiguousarray(values).ravel())),
                ], ["row", column])

    return blocks.select(F.col("place"), F.col("block")).mapInArrow(task, f"row long, {column} array<double>")


def _whitened(rows: DataFrame, size: int, most: int) -> DataFrame:
    """Whitened rows of vectors of one length."""
    stored, n = numbered(rows, "whitening-rows")
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([], names)
    sums = exact_sums(stored, size)
    centred = materialize(_centred(stored, n, sums), "whitening-centred")
    matrix = _blocks(centred, n, size, "centred")
    covariance = _scatter(matrix, n) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
    real = values > max(size * np.finfo(float).eps * max(values[0], 0.0), 0.0)
    kept = len(order)
    project = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    local = spark.sparkContext.parallelize([((0, 0), DenseMatrix(size, kept, project.ravel(order="F").tolist()))], 1)
    splits = 1  # the middle dimension is one block; the rows' blocks are spread by themselves
    projected = materialize(_rows(_product(matrix, BlockMatrix(local, size, kept), splits), kept, "projected"), "whitening-projected")

    means = projected.select(F.posexplode("projected")).groupBy("pos").agg(F.avg("col").alias("mean"))
    means = {r.pos: r["mean"] for r in means.collect()}  # a row a component
    shift = F.array(*[F.lit(float(means[j])) for j in range(kept)])
    again = projected.select("row", F.zip_with("projected", shift, lambda a, b: a - b).alias("centred"))
    identity = _scatter(_blocks(again, n, kept, "centred"), n) / n
    error = float(np.abs(identity - np.eye(kept))[np.ix_(real, real)].max(initial=0.0))

    explained = values / trace if trace > 0 else np.zeros(kept)
    share, has = (F.array(*[F.lit(v.item()) for v in a]) for a in (explained, real))
    parts = stored.select("row", "vec_id").join(centred.select("row", "deviation"), "row").join(projected, "row")
    out = parts.select("vec_id", "deviation", F.posexplode("projected").alias("j", "y"))
    return out.select(
        "vec_id", (F.col("j") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.get(has, F.col("j")), F.col("y")).alias("whitened"), F.get(share, F.col("j")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def whiten(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 32) -> DataFrame:
    """A row a vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry are left out; zero vectors stay. Repeated rows and ids, and a null
    id, are rows like any other. Vectors of each length are fitted and whitened among themselves. A component without variance (fewer vectors
    than dimensions, or equal vectors) has no whitened value (null) and stays out of identity_error. ``deviation`` is null where it passes 64 bits.
    Equal eigenvalues are numbered as the decomposition gives them. An empty table gives an empty result. Further columns are ignored,
    whatever their names.
    """
    rows = whole_entries(table, vec_id, embedding)
    lengths = sorted(r.n for r in rows.select(F.size("x").alias("n")).distinct().collect())  # a row a vector length
    parts = [_whitened(rows.filter(F.size("x") == size), size, min(components, size)) for size in lengths] or [_whitened(rows, 1, 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
