"""Folds over streams in event time: rows wait for the watermark, and timers close what no further row will.

Each key holds three states: the machine's value, a list of rows that are not yet complete, and the time of its one timer. A row is
given to the machine once the watermark has passed it, in the order of all rows of its key, so rows may arrive out of order by as
much as the delay. Rows that come later than that are dropped, as everywhere behind a watermark. A key whose last row lies more than
`close` back is closed by its timer: the machine gives out what it still holds, although the key never speaks again.
"""

import json
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import FractionalType, IntegralType, StringType, StructType

from ..sources.sinks import work_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NOBODY = -(1 << 62)                                                # first key of ticks; first keys are numbers
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Timed(StatefulProcessor):
    """A machine of operators.machines behind the watermark. State that is closed keeps only what the machine keeps after `finish`."""

    def __init__(self, machine, keys: Sequence[str], schema: StructType, order: Sequence[str], time: str, close: int):
        self.machine, self.keys, self.span, self.schema = machine, list(keys), close, schema
        self.names = [f.name for f in schema]
        self.order = [self.names.index(c) for c in order]
        self.time = self.names.index(time)
        self.out = [f.strip().split()[0] for f in machine.schema.split(",")]

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")
        self.pending = handle.getListState("pending", self.schema)
        self.timer = handle.getValueState("timer", "at long")
        self.row = namedtuple("Row", [*self.keys, *self.names])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == NOBODY:
            return iter(())
        new = [tuple(self._plain(r)) for pdf in rows for r in pdf[self.names].astype(object).itertuples(index=False)]
        return self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def _plain(self, row):
        """Cells as Spark has them: pandas makes floats of integers next to a null."""
        for f, v in zip(self.schema, row):
            null = v is None or v != v
            yield None if null and not isinstance(f.dataType, FractionalType) else int(v) if isinstance(f.dataType, IntegralType) else v

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.timer.exists() and self.timer.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.timer.clear()
        return self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, new: list, watermark: int) -> Iterator[pd.DataFrame]:
        held = sorted([*(self.pending.get() if self.pending.exists() else []), *new], key=lambda r: [r[i] for i in self.order])
        due, rest = [r for r in held if r[self.time] <= watermark], [r for r in held if r[self.time] > watermark]
        said = json.loads(self.state.get()[0]) if self.state.exists() else {"machine": self.machine.new(), "last": None}
        out = []
        for r in due:
            if said["last"] is not None and r[self.time] - said["last"] > self.span:
                out.extend(self.machine.finish(said["machine"]))
            out.extend(self.machine.step(said["machine"], self.row(*key, *r)))
            said["last"] = int(r[self.time])
        if said["last"] is not None and said["last"] + self.span < min([watermark, *[r[self.time] for r in rest[:1]]]):
            out.extend(self.machine.finish(said["machine"]))
            said["last"] = None
        if rest:
            self.pending.put(rest)
        elif self.pending.exists():
            self.pending.clear()
        self.state.update((json.dumps(said),))
        self._wait(rest[0][self.time] if rest else None if said["last"] is None else said["last"] + self.span + 1)
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def _wait(self, at: int | None) -> None:
        """Keeps one timer, at the next time that matters."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(int(at))
            self.timer.update((int(at),))

    def close(self) -> None:
        """Nothing to free."""


def timed_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], machine, time: str, delay: str, close: int) -> DataFrame:
    """The machine over a stream, key by key in event time; `time` is a column of milliseconds and first in `order`."""
    value = StructType([f for f in df.schema if f.name not in keys])
    marked = df.withColumn("_at", F.timestamp_millis(time)).withWatermark("_at", delay)
    return marked.groupBy(*keys).transformWithStateInPandas(Timed(machine, keys, value, order, time, close), machine.schema, "Append", "EventTime")


def ending(spark: SparkSession, df: DataFrame, keys: Sequence[str], time: str, at: int = 4_102_444_800_000) -> tuple[DataFrame, Callable[[], None]]:
    """df joined by a source of ticks, and what makes one tick: a row later than all, of the key NOBODY, which tells the watermark that
    the source has ended. That key reaches no machine."""
    path = work_dir(spark, "tick")
    value = lambda f: at if f.name == time else NOBODY if f.name == keys[0] else "" if isinstance(f.dataType, StringType) else 0
    cells = [F.lit(value(f)).cast(f.dataType).alias(f.name) for f in df.schema]
    spark.range(0).select(*cells).write.parquet(path)
    return df.unionByName(spark.readStream.schema(df.schema).parquet(path)), lambda: spark.range(1).select(*cells).write.mode("append").parquet(path)


def drain(df: DataFrame, name: str, end: Callable[[], None] | None = None) -> DataFrame:
    """Runs a timed stream until its source is dry, into a parquet sink, and reads that. With `end`, a tick follows and the stream
    goes on from its checkpoint until all timers have fired."""
    spark = df.sparkSession
    root, old = work_dir(spark, name), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for then in (end, None) if end else (None,):
            sink = df.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/offsets")
            sink.trigger(availableNow=True).start().awaitTermination()
            if then:
                then()
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)
    return spark.read.schema(df.schema).parquet(f"{root}/rows")
