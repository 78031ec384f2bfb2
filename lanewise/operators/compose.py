"""Folds of long keys in many tasks: slices run from a guessed state, and runs are composed until all starts agree.

A slice does not know the state it starts from. Every slice of a long key is run from the state of a new key, or from where the
slice before it ended the last time, and reports the state it ends in. Slices whose start turns out to differ from the end
before them are run again, no others. Machines that forget (a level settles anew, a gate resets) agree after a few rounds. Where
ROUNDS rounds do not suffice, a state reaches too far for slices to be of use, and what is still open of each key is run through in
one task, as a fold would. A last pass then gives the rows, with every slice started from its true state, so the result is that of
one fold over the key.

A machine has, beside `new`, `step` and `finish`, `core(state)`: the JSON value of all that later rows depend on, without what
only counts up, and `restored(core, count)`: a state with it. Counts of slices add up.
"""

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import cut_lineage
from .slices import one_slice

BROADCAST_BYTES, ROUNDS = 32 << 20, 8


def composed_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], machine, report: list | None = None) -> DataFrame:
    """Rows of `machine` over each key of df, whose column `slice` cuts keys in order. report takes the number of slices run in each round."""
    keys = list(keys)
    if one_slice(df):
        return _run(_with_heads(df, None), keys, order, machine, True).withMetadata("entity_id", df.schema["entity_id"].metadata)
    per = df.groupBy(*keys, "slice").agg(F.count("*").alias("_n"))
    long_ = per.groupBy(*keys).agg(F.count("*").alias("_s")).where("_s > 1").select(*keys)
    long_ = cut_lineage(long_)
    if long_.isEmpty():
        return _run(_with_heads(df, None), keys, order, machine, True)
    held = cut_lineage(df.join(_small(long_), keys, "left_semi"))
    ends = cut_lineage(_run(_with_heads(held, None), keys, order, machine, False))
    report = [] if report is None else report
    report.append(ends.count())
    while True:
        chain = _chained(ends, keys)
        wrong = cut_lineage(chain.where(~F.col("start").eqNullSafe(F.col("want"))))
        n = wrong.count()
        if not n:
            break
        report.append(n)
        through = len(report) > ROUNDS
        first = wrong.groupBy(*keys).agg(F.min("slice").alias("_first"))
        slices = _small(ends.join(_small(first), keys).where("slice >= _first").select(*keys, "slice") if through else wrong.select(*keys, "slice"))
        rows = held.join(slices, [*keys, "slice"], "left_semi")
        heads = wrong.join(first, keys).where("slice = _first") if through else wrong
        heads = heads.select(*keys, "slice", F.to_json(F.struct(F.col("want").alias("core"))).alias("_start"))
        again = _run(_with_heads(rows, heads), keys, order, machine, False, through)
        ends = cut_lineage(ends.join(slices, [*keys, "slice"], "left_anti").union(again))
    w = Window.partitionBy(*keys).orderBy("slice")
    true = chain.select(*keys, "slice", F.to_json(F.struct(
        F.col("want").alias("core"), F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("count"),
        (F.lead("slice").over(w).isNotNull()).alias("more"))).alias("_start"))
    return _run(_with_heads(df, true), keys, order, machine, True)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its rows, of less than 64 bytes each, are few."""
    return F.broadcast(df) if df.count() * 64 <= BROADCAST_BYTES else df


def _chained(ends: DataFrame, keys: list[str]) -> DataFrame:
    """Each slice with the start it should have had: where the one before it ended. One row a slice."""
    return ends.withColumn("want", F.lag("end").over(Window.partitionBy(*keys).orderBy("slice")))


def _with_heads(df: DataFrame, heads: DataFrame | None) -> DataFrame:
    """df with column _start, and a row for each head that carries it; other columns of a head hold no nulls, which would turn integers into floats."""
    rows = df.withColumn("_start", F.lit(None).cast("string"))
    if heads is None:
        return rows
    blank = [F.col(f.name) if f.name in heads.columns else F.lit("" if isinstance(f.dataType, StringType) else 0).cast(f.dataType).alias(f.name) for f in df.schema]
    return rows.union(heads.select(*blank, "_start"))


def _run(df: DataFrame, keys: list[str], order: Sequence[str], machine, give: bool, through: bool = False) -> DataFrame:
    """The machine's rows (give), or per slice its start, its end and what it counted. through: a key's slices go on from each other, in one task."""
    ordered = df.repartition(*keys, *([] if through else ["slice"])).sortWithinPartitions(*keys, "slice", F.col("_start").isNull(), *order)
    at = [df.columns.index(k) for k in (*keys, "slice")]
    head = df.columns.index("_start")
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = machine.schema if give else ", ".join(f"{k} {types[k]}" for k in keys) + ", slice long, start string, end string, count long"
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, told = None, None, {}

        def close():
            if key is None:
                return []
            if give:
                return machine.finish(state) if hasattr(machine, "finish") and not told.get("more") else []
            core, count = machine.core(state)
            return [(*key, told.get("core"), json.dumps(core, sort_keys=True), count)]

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = tuple(row[i] for i in at)
                if k != key:
                    out.extend(close())
                    told = json.loads(row[head]) if row[head] else {"core": out[-1][-2]} if through and key and key[:-1] == k[:-1] else {}
                    key = k
                    core = told.get("core")
                    state = machine.restored(json.loads(core), told.get("count", 0)) if core else machine.new()
                if row[head]:
                    continue
                made = machine.step(state, row)
                if give:
                    out.extend(made)
            if out:
                yield pd.DataFrame(out, columns=names)
        out = list(close())
        if out:
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, schema)
