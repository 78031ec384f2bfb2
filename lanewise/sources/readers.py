"""Typed readers: CSV with a schema, tolerant JSON lines, pruned partitions, two shapes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_entities(spark: SparkSession, path: str, schema: str, pattern: str = r"group_id=(\d+)") -> DataFrame:
    """All files below a folder; the entity comes from the file path."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    return df.withColumn("entity", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("long"))


def parse_json_lines(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Adds `j` (parsed) and `bad`; blank lines are dropped, corrupt ones are kept and marked."""
    full = f"{schema}, _corrupt_record STRING"
    j = F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = df.filter(F.trim(line) != "").withColumn("j", j)
    return df.withColumn("bad", F.col("j._corrupt_record").isNotNull())


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path), "value", schema)


def read_points(df: DataFrame) -> DataFrame:
    """Rows of either shape, told apart by their columns: `shape` and a valid window or none."""
    if "pt" in df.columns:
        out = df.withColumn("shape", F.lit("export"))
    elif "first" in df.columns:
        out = df.withColumn("shape", F.lit("session"))
    else:
        raise ValueError(f"unrecognised columns {df.columns}")
    if {"start_s", "end_s"} <= set(df.columns):
        ok = F.col("start_s") < F.col("end_s")
        return out.withColumn("start_s", F.when(ok, F.col("start_s"))).withColumn("end_s", F.when(ok, F.col("end_s")))
    return out
