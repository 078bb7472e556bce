"""Arrow kernels in Python workers: import path and array columns as matrices."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark


def matrix(column: pa.Array, width: int, dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the good arrays, which rows they are); good: ``width`` elements, none null."""
    size = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    bad = np.cumsum(np.concatenate(([0], np.asarray(flat.is_null()))))
    end = np.cumsum(size)
    good = np.flatnonzero((size == width) & (bad[end] == bad[end - size]))
    at = (end - size)[good][:, None] + np.arange(width)
    return np.asarray(flat.fill_null(0)).astype(dtype)[at], good


def map_array(rows: DataFrame, column: str, width: int, kernel, element: DataType | None = None, name: str | None = None) -> DataFrame:
    """``rows`` with the array ``column`` put through ``kernel`` (n, width) -> (n, m),
    under its own or a new name. Null arrays, those of another length and those
    with a null element become null."""
    ready(rows.sparkSession)
    k = rows.columns.index(column)
    field = StructField(name or column, ArrayType(element or LongType()))
    fields = rows.schema.fields
    schema = StructType([*fields[:k], field, *fields[k + 1 :]] if name is None else [*fields, field])

    def run(batches):
        for b in batches:
            x, good = matrix(b.column(k), width)
            y = kernel(x)
            size = np.zeros(b.num_rows, np.int64)
            size[good] = y.shape[1]
            absent = np.ones(b.num_rows + 1, bool)
            absent[good] = absent[-1] = False
            ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32), mask=np.append(absent[:-1], False))
            out = pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1)))
            columns = [*b.columns[:k], out, *b.columns[k + 1 :]] if name is None else [*b.columns, out]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
