"""Exact quantiles of groups of any size."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import slices as S


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              width: float = 1.0, weight: str | None = None) -> DataFrame:
    """One row per key: interpolated quantiles and the count `n`.

    Values are counted before the shuffle, ranked by prefix sums over value slices of
    `width`, and the two order statistics of each quantile are picked by an aggregate:
    no task ever sees a whole group. A row of `weight` k counts k times.
    """
    c = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_q"))
         .agg((F.sum(weight) if weight else F.count("*")).alias("_c")))
    c = cut_lineage(c)          # counts per distinct value, used three times below
    tot = c.groupBy(*keys).agg(F.sum("_c").alias("n"))
    c = S.running_sum(S.add_slice(c, width, "_q"), {"_cum": F.col("_c")}, keys, ("_q",))
    c = c.join(tot, list(keys))
    aggs = [F.max("n").alias("n")]
    pos = lambda p: (F.col("n") - 1) * F.lit(float(p))
    for name, p in probs.items():
        aggs.append(F.min(F.when(F.col("_cum") > F.floor(pos(p)), F.col("_q"))).alias(f"_lo_{name}"))
        aggs.append(F.min(F.when(F.col("_cum") > F.ceil(pos(p)), F.col("_q"))).alias(f"_hi_{name}"))
    out = c.groupBy(*keys).agg(*aggs)
    for name, p in probs.items():
        frac = pos(p) - F.floor(pos(p))
        out = out.withColumn(name, F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * frac)
    return out.select(*keys, "n", *probs)
