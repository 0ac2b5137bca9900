"""What the operators share: scratch tables, Arrow steps over rows, text hashing."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.session import bound_batches, scratch_path

SLICE_BYTES = 2 << 20

# Constants of the hashes; any odd multipliers would do.
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: later steps start from files that outlive executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that ``stored`` made, once whatever reads them has been stored itself."""
    for df in tables:
        path = _written.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Shipped:
    """A value that every task may read, with the code of its class: a broadcast of bytes.

    A plain broadcast names the class and leaves it to the worker to import it, which
    only works where the package is installed. Of one kind of value a worker keeps the last.
    """

    def __init__(self, spark: SparkSession, value: object):
        self.kind, self.key = type(value).__name__, uuid.uuid4().hex
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        loaded = vars(sys).setdefault("_shipped_values", {})
        key, held = loaded.get(self.kind, (None, None))
        if key != self.key:
            held = cloudpickle.loads(self.data.value)
            loaded[self.kind] = self.key, held
        return held

    def unpersist(self) -> None:
        self.data.unpersist()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; a null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes, at least one row."""
    rows = batch.num_rows
    if not rows:
        return
    each = np.full(rows, 16, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + rows + 1]
            each += np.diff(ends)
    at = np.cumsum(each) // limit
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_rows(
    df: DataFrame,
    inputs: Sequence[str],
    keep: Sequence[str],
    fields: str,
    step: Callable[..., list],
) -> DataFrame:
    """Row for row: the ``keep`` columns and what ``step(*input arrays)`` returns as ``fields``.

    A kept column with the name of a new field is replaced by it.
    """
    new = T.StructType.fromDDL(fields)
    taken = {n.lower() for n in new.names}
    kept = [c for c in keep if c.lower() not in taken]
    source = df.select(
        *(col(c).alias(f"k{i}") for i, c in enumerate(kept)),
        *(col(c).alias(f"i{i}") for i, c in enumerate(inputs)),
    )
    plain = T.StructType(
        [T.StructField(f"k{i}", source.schema[f"k{i}"].dataType) for i in range(len(kept))]
        + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(new.fields)]
    )
    n_keep = len(kept)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(plain)
        for batch in batches:
            for part in slices(batch):
                made = step(*part.columns[n_keep:])
                columns = [
                    v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type)
                    for v, f in zip([*part.columns[:n_keep], *made], schema)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        # The worker lives on; what it no longer needs goes back.
        pa.default_memory_pool().release_unused()

    out = source.mapInArrow(run, plain)
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)),
        *(F.col(f"o{i}").alias(n) for i, n in enumerate(new.names)),
    )


# -- vectorised hashes ------------------------------------------------------------

_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), np.uint64)
        have[0], have[1:] = 1, np.uint64(base)
        have = np.cumprod(have)
        _powers[base] = have
    return have[:n]


INVERSE = pow(_ODD, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value times power, so that any stretch can be hashed from two of them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), _ODD), out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end), whatever their place."""
    return mixed((sums[end] - sums[start]) * powers(len(sums), INVERSE)[start] + (end - start).astype(np.uint64))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE[data])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, which white space of ASCII separates."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return stretch_hash(byte_sums(data), starts, ends)
