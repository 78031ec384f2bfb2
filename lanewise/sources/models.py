"""Saved models: versioned JSON records in a folder, written once, read by version or the newest."""

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("features", "mu", "sd", "weights", "intercept", "t_high", "n_train")


def save_model(spark: SparkSession, folder: str, model: dict) -> int:
    """Writes a model as the next version of a folder and returns its number. A version is never written over."""
    missing = [f for f in FIELDS if f not in model]
    if missing or not len(model["features"]) == len(model["mu"]) == len(model["sd"]) == len(model["weights"]):
        raise ValueError(f"a model has {', '.join(FIELDS)}, and as many means, deviations and weights as features")
    version = max(versions(spark, folder), default=0) + 1
    record = {k: v for k, v in model.items()} | {"t_high": None if model["t_high"] == float("inf") else model["t_high"]}
    spark.createDataFrame([(json.dumps(record),)], "model string").coalesce(1).write.mode("errorifexists").text(f"{folder}/version={version}")
    return version


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions in a folder, oldest first; none if it is not there."""
    try:
        rows = spark.read.text(folder).select("version").distinct().collect()               # one row a version
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(int(r.version) for r in rows)


def load_model(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    known = versions(spark, folder)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no version {version or ''} of a model in {folder}")
    model = json.loads(spark.read.text(f"{folder}/version={version or known[-1]}").first()[0])
    return model | {"t_high": float("inf") if model["t_high"] is None else model["t_high"]}


def logit(model: dict, features: Sequence[str] | None = None):
    """The model's score before the link, as a column; the table needs the model's features."""
    if features is not None and list(features) != list(model["features"]):
        raise ValueError("the model was fit on other features")
    return sum((w * ((F.col(f) - m) / s) for f, m, s, w in zip(model["features"], model["mu"], model["sd"], model["weights"])), F.lit(model["intercept"]))


def apply_model(df: DataFrame, model: dict, digits: int = 9) -> DataFrame:
    """df with p, rounded, and above: whether p reaches the model's threshold."""
    df = df.withColumn("p", F.bround(1 / (1 + F.exp(-logit(model))), digits))
    return df.withColumn("above", F.col("p") >= F.lit(float(model["t_high"])))
