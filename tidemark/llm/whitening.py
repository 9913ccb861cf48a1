"""Whitening of embeddings: a RowMatrix over exactly centred rows gives the covariance, its eigenvectors whiten every row.

Entries become whole numbers x (``floor(SCALE * c) + OFFSET``), so the sums S over the n distinct vectors are exact and
so is ``n * x - S``; only its quotient by n is rounded. MLlib's ``computeGramianMatrix`` over these centred rows, divided by
n, is the covariance; its eigenvectors are found on the driver (a matrix of dimension squared) and broadcast, and
``mapInPandas`` projects the rows. The covariance of the whitened distinct vectors, which are centred as a linear image of
centred ones, is computed the same way and held against the identity.

Rows only move to find the distinct vectors, equal ones reduced before they do; sums are one row for each
dimension and partition.

Defined cases: rows whose vector is null or empty or has null or non-finite entries are dropped, as are vectors whose
length is not the table's most frequent one (the smaller of equally frequent ones), which have no place in its space; x
stops at the ends of 64 bits; components whose eigenvalue is 0 up to rounding do not exist, so a table of one distinct
vector gives no rows; a deviation beyond 64 bits is null; a null id passes through; repeated rows have repeated results and
count once in the fit; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
SAFE = 1 << 62


def whole_numbers(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, x) of the rows with a whole vector."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry))
    top = F.lit((1 << 63) - 1 - OFFSET)
    return usable.select(vec_id, F.transform(vector, lambda c: F.least(F.floor(c.cast("double") * SCALE), top) + OFFSET).alias("x"))


def _rows(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def _sums(size: int):
    """(dim, total, n): each batch's exact sums."""

    def run(batches):
        for batch in batches:
            x = _rows(batch.column("x"), size)
            if len(x):
                small = int(np.abs(x.astype(np.float64)).max()) * len(x) < SAFE
                total = [Decimal(int(t)) for t in (x.sum(0) if small else x.astype(object).sum(0))]
                yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total, pa.decimal128(38, 0)), pa.array([len(x)] * size)], ["dim", "total", "n"])

    return run


def exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` without rounding, in 64 bits where all of it fits and in Python's integers elsewhere."""
    most = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums))
    return n * x - np.array(sums, np.int64) if most < SAFE else n * x.astype(object) - np.array(sums, object)


def squares(y: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row, None beyond 64 bits."""
    if y.dtype != object and float(np.abs(y.astype(np.float64)).max(initial=0)) ** 2 * y.shape[1] < SAFE:
        return (y * y).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in y)]


def _matrix(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """The Gramian matrix of a column of arrays, divided by n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("row").alias("row")), "row")
    return RowMatrix(vectors, n, size).computeGramianMatrix().toArray() / n


def whiten(vectors: DataFrame, k: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component up to ``k``."""
    kind = dict(vectors.dtypes)[vec_id]
    schema = f"`{vec_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    every = whole_numbers(vectors, vector, vec_id)
    size = every.groupBy(F.size("x").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    if size is None:
        return spark.createDataFrame([], schema)
    size = size["size"]
    every = every.where(F.size("x") == size)
    fit = written(every.select("x").distinct(), "fit")
    found = fit.mapInArrow(_sums(size), "dim int, total decimal(38,0), n long").groupBy("dim").agg(F.sum("total"), F.sum("n")).orderBy("dim").collect()
    n, sums = int(found[0][2]), [int(r[1]) for r in found]  # one row for each dimension

    def centred(batches):
        for batch in batches:
            y = exact(_rows(batch.column("x"), size), n, sums).astype(np.float64) / n
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * size, pa.int32()), pa.array(y.reshape(-1)))], ["row"])

    covariance = _matrix(fit.mapInArrow(centred, "row array<double>"), n, size)
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    k = int((values[:k] > max(values[0], 0) * size * np.finfo(float).eps).sum())
    if not k:
        return spark.createDataFrame([], schema)
    explained = values[:k] / np.trace(covariance)
    shared = spark.sparkContext.broadcast(directions[:, :k] / np.sqrt(values[:k]))

    def white(batches):
        for batch in batches:
            w = exact(_rows(batch.column("x"), size), n, sums).astype(np.float64) / n @ shared.value
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.reshape(-1)))], ["row"])

    off = _matrix(fit.mapInArrow(white, "row array<double>"), n, k) - np.eye(k)
    error = float(np.abs(off).max())

    def project(frames):
        for frame in frames:
            x = np.stack(frame["x"]) if len(frame) else np.zeros((0, size), np.int64)
            y = exact(x, n, sums)
            w = y.astype(np.float64) / n @ shared.value
            yield pd.DataFrame({
                vec_id: frame[vec_id].repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(frame)), "n": n,
                "deviation": pd.array(squares(y), "Int64").repeat(k), "whitened": w.reshape(-1), "explained": np.tile(explained, len(frame)), "identity_error": error,
            })

    return every.mapInPandas(project, schema)


def op13_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
