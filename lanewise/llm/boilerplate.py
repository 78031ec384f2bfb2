"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host if it is on more than `ratio` of the host's pages and on `min_pages`
pages at least. Lines are counted once a page, under their MD5 digest, so the shuffle carries 16
bytes a line and common lines collapse before it. Pages of at least `min_sizes` different lengths (modulo 64) must have
the line, so that copies of one page do not make its text boilerplate. No host can have more than 1 / ratio times
its mean number of lines a page as boilerplate, so the list to drop is short for each host.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import columns, saved, unused

BROADCAST_BYTES = 32 << 20


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _plain(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate_lines(pages: DataFrame, ratio: float = 0.1, min_pages: int = 5, min_sizes: int = 1) -> DataFrame:
    """host, digest, n_pages, host_pages of the boilerplate lines of pages(host, text)."""
    lines = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), _plain), lambda x: x != ""), _digest))
    if not 1 <= min_sizes <= 64:
        raise ValueError("min_sizes is from 1 to 64")
    size = [F.call_function("shiftleft", F.lit(1).cast("long"), (F.char_length("text") % 64).cast("int")).alias("size")] if min_sizes > 1 else []
    each = pages.select("host", *size, F.explode(lines).alias("digest")).groupBy("host", "digest")
    if size:
        counted = each.agg(F.count("*").alias("n_pages"), F.bit_count(F.bit_or("size")).alias("sizes")).where(F.col("sizes") >= min_sizes).drop("sizes")
    else:
        counted = each.agg(F.count("*").alias("n_pages"))
    counted = counted.where(F.col("n_pages") >= min_pages)
    hosts = pages.groupBy("host").agg(F.count("*").alias("host_pages")).withColumnRenamed("host", "h")
    return (counted.join(hosts, F.col("host").eqNullSafe(F.col("h")))
            .where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages")).select("host", "digest", "n_pages", "host_pages"))


def drop_boilerplate(pages: DataFrame, host: str, ratio: float = 0.1, min_pages: int = 5, min_sizes: int = 1) -> DataFrame:
    """The rows of pages(text, <host>, ...) with boilerplate lines taken out of text; all columns stay.

    New columns n_lines and n_dropped, in front of which any equally named column gives way. Lines are
    split at \\n and compared without spaces, tabs and returns at either end; blank lines are kept.
    Rows with a null host are a host of their own. A null text stays null with 0 lines; a text that is
    all boilerplate becomes empty. Rows that repeat count as pages of their own. An empty table stays empty.
    """
    pages = pages.drop("n_lines", "n_dropped")
    named = columns(pages, host, "text").toDF("host", "text")
    found = saved(boilerplate_lines(named, ratio, min_pages, min_sizes), "boilerplate")
    other, drop, kept = unused(pages, "__host", "__drop", "__kept")
    lists = found.groupBy("host").agg(F.collect_set("digest").alias(drop)).withColumnRenamed("host", other)
    size = found.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + 40).alias("b")).first()
    small = (size.b or 0) <= BROADCAST_BYTES                       # else a shuffle join, which the adaptive plan splits at hot hosts
    met = pages.join(F.broadcast(lists) if small else lists, F.col(f"`{host}`").eqNullSafe(F.col(other)), "left")
    lines = _lines(F.col("text"))
    out = met.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(drop), _digest(_plain(x))), F.lit(False)))))
    return out.select(*[F.array_join(kept, "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in pages.columns],
                      F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                      F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"))
