"""Adapters: the driver tables as tracks, sequences, dialogues and triage rows."""

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slices import one_slice, row_slices
from ..presets import COURT_L, COURT_W, HOUR, TRACK
from ..session import cut_lineage

SLICE_ROWS = TRACK.slice_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread_scan(df: DataFrame) -> DataFrame:
    """Gives per-row heavy work all cores when the scan has fewer splits than cores.

    A large table has far more splits than that and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def millis(ts) -> Column:
    """Milliseconds since the epoch of a zone-free timestamp (the session zone is UTC)."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def track(spark: SparkSession, sf_dir: str, extra: tuple = ()) -> DataFrame:
    """One row per sample of an entity; `cx`, `cy` are its court position (metres)."""
    ev = table(spark, sf_dir, "events")
    x = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("double")
    cols = [(F.col("user_id") % 8).alias("group_id"), F.col("user_id").alias("entity_id"),
            millis("ts").alias("seq"), F.col("event_id"), F.col("event_type").alias("kind"),
            F.col("value").alias("y")]
    out = ev.select(*cols, x.alias("x")).withColumns(
        {"cx": F.col("x") / 100 * F.lit(COURT_W), "cy": F.col("y") / 100 * F.lit(COURT_L)})
    return out.select("group_id", "entity_id", "seq", "event_id", "kind", "y", "x", "cx", "cy", *extra)


def sliced_track(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    return row_slices(track(spark, sf_dir), rows or SLICE_ROWS, HOUR)


def written_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliced track, written in order for queries that look at it many times: their groups and windows take no shuffle where entities are short."""
    df = sliced_track(spark, sf_dir)
    by = ["entity_id"] if one_slice(df) else ["entity_id", "slice"]
    return cut_lineage(df.repartition(*by).sortWithinPartitions("entity_id", "slice", "seq", "event_id"))


# The same track for the oracle.
TRACK_SQL = f"""t AS (
  SELECT user_id % 8 AS group_id, user_id AS entity_id, epoch_us(ts) // 1000 AS seq, event_id,
         event_type AS kind, value AS y,
         CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS DOUBLE) AS x,
         CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS DOUBLE) / 100 * {COURT_W} AS cx,
         value / 100 * {COURT_L} AS cy
  FROM events)"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all orders with the token of each line."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                                   F.concat("l_returnflag", "l_linestatus").alias("token"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, entity_id, truth and draft: two orderings of one order's tokens, whole."""
    li = order_lines(spark, sf_dir)
    rest = ["l_partkey", "l_suppkey", "token"]
    pick = lambda c: F.transform(F.array_sort(c), lambda s: s["token"])
    seq = (li.groupBy("l_orderkey")
           .agg(pick(F.collect_list(F.struct("l_linenumber", *rest))).alias("truth"),
                pick(F.collect_list(F.struct("l_shipdate", *rest))).alias("draft")))
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return (seq.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_orderpriority").alias("group_id"), F.col("l_orderkey").alias("entity_id"),
                    "truth", "draft"))


SEQUENCE_SQL = """q AS (
  SELECT o_orderpriority AS group_id, l_orderkey AS entity_id,
         list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus) AS truth,
         list(l_returnflag || l_linestatus ORDER BY l_shipdate, l_partkey, l_suppkey, l_returnflag || l_linestatus) AS draft
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
