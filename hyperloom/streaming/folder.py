"""A watched folder: each new cube is processed once both of its files are there, and its spectra are appended to a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import BatchOptions
from ..plans.pipelines import PROBLEMS, extract_all
from ..sources.envi import EXTENSIONS

ARRIVED = "header string, problem string"
NO_DATA = "no data file within the deadline"


class Arrivals(StatefulProcessor):
    """Pairs a cube's header with its data file, whichever comes first.

    A header is given out once, when both are there; one whose data file doesn't come within ``deadline`` seconds is given out with a problem. A data file without a header is forgotten after as long.
    """

    def __init__(self, deadline: float):
        self.wait = int(deadline * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "header string, data boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        header, data = self.held.get() if self.held.exists() else (None, False)
        for r in rows:
            if r["is_header"]:
                header = r["path"]
            else:
                data = True
        if header is not None and data:
            self._forget()
            yield Row(header=header, problem=None)
            return
        if not self.held.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        self.held.update((header, data))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        header = self.held.get()[0] if self.held.exists() else None
        self._forget()
        if header is not None:
            yield Row(header=header, problem=NO_DATA)

    def _forget(self) -> None:
        self.held.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def arrivals(spark: SparkSession, folder: str, deadline: float, files: int) -> DataFrame:
    """Stream of ``header, problem``. Files are told by their names' endings alone; none is read."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    endings = ",".join(e[1:] for ext in (".hdr", *EXTENSIONS) for e in (ext, ext.upper()))
    # binaryFile leaves the content unread where it isn't selected
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files).load(f"{folder}/*.{{{endings}}}").select("path")
    ours = found.select("path", F.lower(F.substring("path", -4, 4)).eqNullSafe(".hdr").alias("is_header"), F.regexp_replace("path", r"\.[^./]*$", "").alias("cube"))
    return ours.groupBy("cube").transformWithState(statefulProcessor=Arrivals(deadline), outputStructType=ARRIVED, outputMode="Append", timeMode="ProcessingTime")


def watch(
    spark: SparkSession, folder: str, out: str, checkpoint: str, options: BatchOptions, files: int = 1000, deadline: float = 3600.0, problems: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Starts a query that takes the cubes that arrive in ``folder``, ``files`` files at most at a time, and adds their spectra to the Parquet table ``out``.

    A header waits for its data file (which should be moved into the folder as a whole) up to ``deadline`` seconds, also over restarts. Cubes left out go to the table ``problems``, if it is
    given. A batch is one job for each shape of its cubes and is written under its own number, so that one that is repeated after a failure replaces what it wrote
    before. ``trigger``: arguments of the writer's trigger. By default the query takes what is there now and ends; deadlines are then looked at whenever new files are there, and with a
    ``processingTime`` at each of its times.
    """
    trigger = trigger or {"availableNow": True}

    def process(rows: DataFrame, batch_id: int) -> None:
        found = rows.distinct().collect()  # ``files`` at most, and those whose time is up
        plain = lambda path: path.removeprefix("file://").removeprefix("file:")
        spectra, left_out = extract_all(spark, sorted(plain(r["header"]) for r in found if r["problem"] is None), options)
        spectra.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if problems is not None:
            late = spark.createDataFrame([(plain(r["header"]), r["problem"]) for r in found if r["problem"] is not None], PROBLEMS)
            left_out.union(late).write.mode("overwrite").parquet(f"{problems}/batch={batch_id}")

    writer = arrivals(spark, folder, deadline, files).writeStream.outputMode("append").foreachBatch(process).option("checkpointLocation", checkpoint)
    # a query of what is there now would go on without data as long as any header waits
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false" if trigger.get("availableNow") else before)
    try:
        return writer.trigger(**trigger).start()
    finally:
        spark.conf.set(key, before)
