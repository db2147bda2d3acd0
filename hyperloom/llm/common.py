"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path, shared_dir, stored

__all__ = ["bounded_batches", "free", "hot_values", "mix", "new_path", "powers", "remainder", "runs", "shared_dir", "slices", "split_join", "stored", "utf8_parts"]

#: Bytes of text that a Python task handles at a time.
SLICE_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int | None = None) -> None:
    """Arrow batches of at most ``rows`` rows, and of about ``size`` bytes, so that long texts don't pile up in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


#: Values that make up more than 1 / HOT of all rows are broadcast; there are HOT of them at most.
HOT = 1000


def hot_values(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The values of ``key`` that make up more than 1 / HOT of the rows counted in ``n``: at most HOT of them, whatever the table."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * HOT > total).select(key)


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of rows and ``table`` by ``keys``; rows with a ``hot`` value, which are few values, never move.

    ``hot``: values of one of the keys, of which ``table`` holds few rows each.
    """
    (key,) = hot.columns
    values = F.broadcast(hot)
    cold = rows.join(values, key, "left_anti").join(table.join(values, key, "left_anti"), keys)
    return cold.unionByName(rows.join(F.broadcast(table.join(values, key, "left_semi")), keys))


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of an id's decimal text modulo ``modulus``; null ids give null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % modulus


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES):
    """Consecutive slices of a batch whose texts take about ``size`` bytes (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    while start < batch.num_rows:
        total = np.cumsum(lengths[start:])
        n = max(1, int(np.searchsorted(total, size, side="right")))
        yield batch.slice(start, n)
        start += n


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; kept for the next slice."""
    if base not in _tables or len(_tables[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _tables[base] = np.multiply.accumulate(out)
    return _tables[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        values = list(zip(*(batch.column(c).to_pylist() for c in keys)))
        begin = 0
        for i, v in enumerate(values):
            if v != at:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, begin = [], v, i
        if begin < len(values):
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)
