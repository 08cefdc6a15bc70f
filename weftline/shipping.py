"""The package on the executors, which may know neither the driver's folder nor its sys.path."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of strings that a function turns into Python objects at a time; a larger one stands alone.
SLICE_BYTES = 2 << 20

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application; Spark's file server hands it out."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        home = os.path.dirname(os.path.abspath(__file__))
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "weftline"), "zip", os.path.dirname(home), os.path.basename(home)))
        _sent.add(sc.applicationId)


def slices(columns: tuple[pa.Array, ...], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of parts with at most `most` bytes of strings; a row of more is a part."""
    sizes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, end - at
        at = end


def sliced(f):
    """f of a batch of Arrow columns, slice by slice: Spark's batches are counted in rows, so long texts make them large."""

    @wraps(f)
    def run(*columns: pa.Array) -> pa.Array:
        parts = [f(*(c.slice(at, n) for c in columns)) for at, n in slices(columns)]
        return pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else f(*columns)

    return run


def arrow_udf(kind):
    """F.arrow_udf for functions of the package: the package is sent before the function is used."""

    def wrap(f):
        udf = F.arrow_udf(kind)(f)

        @wraps(f)
        def call(*columns):
            spark = SparkSession.getActiveSession()
            if spark is not None:
                ship(spark)
            return udf(*columns)

        return call

    return wrap


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
