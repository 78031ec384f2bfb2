"""Structured Streaming twins of the batch folds."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import work_dir


def stream_fold(df: DataFrame, keys: list[str], order: list[str], machine) -> DataFrame:
    """Runs a machine of `operators.machines` over a stream; its state is one JSON string.

    Rows of a key are ordered inside each micro-batch, so the source must deliver them
    in order across batches (a log does). Undecided rows wait in the state until `run_available` closes it.
    """
    names = [f.strip().split()[0] for f in machine.schema.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        st = json.loads(state.get[0]) if state.exists else machine.new()
        out = []
        for row in pd.concat(batches).sort_values(order, kind="stable").itertuples(index=False):
            out.extend(machine.step(st, row))
        state.update((json.dumps(st),))
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.groupBy(*keys).applyInPandasWithState(run, machine.schema, "state string", "append", GroupStateTimeout.NoTimeout)


def events_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over parquet files of the events schema."""
    schema = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def run_available(df: DataFrame, name: str, machine=None) -> DataFrame:
    """Drains what the source holds now into a parquet sink with a checkpoint, and reads it.

    File sink plus checkpoint make the result exactly-once across restarts. With a machine, the rows that its
    states still hold when the source is drained are closed by its `finish` and follow."""
    spark = df.sparkSession
    root = work_dir(spark, name)
    out, ckpt = f"{root}/rows", f"{root}/offsets"
    q = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(df.schema).parquet(out)
    return rows if machine is None else rows.unionByName(_closed(spark, ckpt, machine))


def _closed(spark: SparkSession, ckpt: str, machine) -> DataFrame:
    """What `finish` gives for every state of a drained stream; the stream itself is left as it is."""
    names = [f.strip().split()[0] for f in machine.schema.split(",")]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [row for text in pdf["state"] for row in machine.finish(json.loads(text))]
            if out:
                yield pd.DataFrame(out, columns=names)

    return spark.read.format("statestore").load(ckpt).select("value.groupState.state").mapInPandas(finish, machine.schema)
