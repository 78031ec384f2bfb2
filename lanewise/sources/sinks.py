"""Sinks: partitioned tables, refusal to overwrite, append-only logs, fingerprints."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/lanewise/{name}-{uuid.uuid4().hex}"


def write_new(df: DataFrame, path: str, force: bool = False, dry_run: bool = False) -> str:
    """Writes unless something is there; says what it did or would do."""
    if dry_run:
        return "would write"
    try:
        df.write.mode("overwrite" if force else "errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return "refused"
    return "written"


def write_entities(df: DataFrame, path: str, *by: str) -> None:
    """One folder per entity value. The shuffle spreads a hot value over a random salt."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    salted.repartition(*by, "_salt").drop("_salt").write.partitionBy(*by).mode("errorifexists").option("header", True).csv(path)


def append_log(df: DataFrame, path: str, session: str, mode: str) -> None:
    """Append-only JSON lines stamped with session, mode and server time."""
    stamped = df.withColumns({"session": F.lit(session), "mode": F.lit(mode), "server_ts_ms": F.unix_millis(F.current_timestamp())})
    stamped.write.mode("append").json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: one row, combined map-side. A cell goes in with its length, so no text can pass for two cells; nulls count too."""
    text = lambda c: F.col(c).cast("string")
    cells = [F.coalesce(F.concat(F.char_length(text(c)).cast("string"), F.lit("="), text(c)), F.lit("~")) for c in sorted(df.columns)]
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("digest"))


def assert_unchanged(df: DataFrame, frozen: tuple) -> None:
    now = tuple(fingerprint(df).first())
    if now != frozen:
        raise ValueError(f"snapshot changed: frozen {frozen}, now {now}")
