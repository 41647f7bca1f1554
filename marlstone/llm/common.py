"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions.store import fresh_path, written  # noqa: F401  the operators take both from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """A column name that isn't taken."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """The text with A-Z alone in lower case."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Rows and bytes of text of a batch that are worked on at once: what a task holds goes by them, and by its longest text.
ROWS, BYTES = 1_000, 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold at most ``ROWS`` rows and about ``BYTES`` bytes, unless it asks for less: such buffers come from a pool of both sides, where larger ones would scatter over the executor's memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        held = spark.conf.get(key)
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, total[at] + BYTES, "right")) - 1
        end = min(max(end, at + 1), at + ROWS)
        yield batch.slice(at, end - at)
        at = end


def map_columns(df: DataFrame, columns: list[str], schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Run ``fn`` on slices of ``columns`` of at most ``ROWS`` rows and ``BYTES`` bytes of text, or of one longer row;
    empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield fn(part)
            del batch
            pa.default_memory_pool().release_unused()

    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


_held: dict[tuple, object] = {}


def only(key: tuple, make: Callable[[], object]) -> object:
    """The object of ``key``, kept for the worker's next tasks. A worker keeps one such object: workers serve one
    operator after the other, and what the last one remembered would only fill the executor."""
    if key not in _held:
        _held.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # glibc keeps freed memory until it is told to hand it back
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _held[key] = make()
    return _held[key]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of ``df``, by one aggregation: a size check before a broadcast."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    sums = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)).alias(f"b{k}") for k, c in enumerate(texts)]
    row = df.agg(F.count("*").alias("n"), *sums).first()
    return row["n"], sum(row[1:]) + 16 * len(df.columns) * row["n"]


def broadcast_if_small(df: DataFrame, limit: int, most_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``limit`` rows and ``most_bytes`` bytes; larger tables keep the shuffled
    join."""
    rows, size = size_of(df)
    return F.broadcast(df) if rows <= limit and size <= most_bytes else df


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Join where one key may hold a third of ``big``: its rows are dealt over ``salts`` by a hash of ``spread``,
    and each row of ``small`` (one for each key) is repeated for every salt."""
    big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(small, [*keys, "_salt"], how).drop("_salt")
