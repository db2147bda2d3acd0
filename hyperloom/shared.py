"""Tables in the folder that driver and executors share, to cut lineage; groups of rows within tasks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (``local`` masters, as in tests) a temporary folder is set and removed at exit. On a
    cluster each executor would write to a disk of its own there, and rows would be lost; so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="hyperloom-")
        atexit.register(shutil.rmtree, local, True)
        spark.sparkContext.setCheckpointDir(f"file://{local}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: an executor lost later costs a re-read of Parquet, not the work that made the rows.
    """
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, or one group if that is longer, from batches sorted by ``keys``; no group is in two of them. Each batch is looked at once."""
    done: list[pa.RecordBatch] = []
    current: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        last = tuple(batch.column(k)[-1].as_py() for k in keys)
        same = np.logical_and.reduce([pc.equal(batch.column(k), v).to_numpy(zero_copy_only=False) for k, v in zip(keys, last)])
        begin = int(np.argmax(same))
        if begin or last != at:
            done += current + ([batch.slice(0, begin)] if begin else [])
            current = []
            if sum(b.num_rows for b in done) >= rows:
                yield pa.Table.from_batches(done)
                done = []
        current.append(batch.slice(begin))
        at = last
    if done or current:
        yield pa.Table.from_batches(done + current)
