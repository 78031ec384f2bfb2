"""Connected components of an edge table by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def _stars(e: DataFrame, both: bool) -> DataFrame:
    """Joins each node's neighbours to the smallest of them; `both` sees edges from either end."""
    e = e.union(e.select("b", "a")) if both else e
    low = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = e.join(low, "a")
    if both:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges(a, b); comp is the smallest node reachable.

    A round costs a few shuffles of the edges; the number of rounds is logarithmic in the longest
    path. Each round is a written table, so no round is recomputed.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark.n == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select("b", "b").distinct())
        seen = mark
        e = saved(_stars(_stars(e, True), False), "edges")
