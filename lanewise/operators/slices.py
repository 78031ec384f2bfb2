"""Ordered per-entity operators that never hold one entity in one task.

A window partitioned by entity puts a hot entity (which may own a third of all
rows) into a single task. Here every entity is cut into slices of a bounded number of
rows (or, for derived tables, of bounded time width) and each window runs per (entity, slice). What a slice needs from its
neighbours is carried by a summary with one row per slice: the few rows at its
edges, the sum of a column, or the last non-null value. The summaries are orders
of magnitude smaller than the data, so ordering them per entity is cheap; they
come back by a join on (entity, slice), on which the data is partitioned already.

All helpers expect columns `slice` (see `row_slices`, `add_slice`), the key columns and a total
order.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

KEYS = ("entity_id",)
ORDER = ("seq", "event_id")
ONE = {"one_slice": True}           # metadata of a column `slice` that holds 0 only, and of an `entity_id` whose rows are few enough for that


def add_slice(df: DataFrame, width, seq: str = "seq") -> DataFrame:
    return df.withColumn("slice", F.floor(F.col(seq) / F.lit(width)).cast("long"))


def derived_slice(df: DataFrame, width, seq: str = "seq") -> DataFrame:
    """Slices of rows taken from a track, at most one or two for each of its rows: one slice where `row_slices` found no long entity."""
    return _one(df) if short_keys(df) else add_slice(df, width, seq)


def short_keys(df: DataFrame) -> bool:
    """Whether the rows stem from a track in which no entity has more rows than a task may hold."""
    return bool(df.schema["entity_id"].metadata.get("one_slice"))


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("slice", F.lit(0).cast("long")).withMetadata("slice", ONE)


def row_slices(df: DataFrame, rows: int, grid: int, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """Adds `slice`: consecutive stretches of an entity of about `rows` rows each.

    Where an entity has more than `rows` rows, they are counted per grid cell; a slice ends at the first cell edge after
    `rows` rows, so however dense or long an entity is, a task gets at most `rows` rows and one cell. Other entities are one
    slice, which takes no shuffle of their rows. There is one edge for every `rows` rows, so the edges are broadcast. Rows are counted
    here and now: where no entity is long, `slice` is known to be one (`one_slice`), and nothing is carried between slices.
    """
    cell = F.floor(F.col(seq) / F.lit(grid)).cast("long")
    df = df.dropna(subset=[*keys, seq])
    long_ = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(*keys))
    if long_.isEmpty():
        return _one(df).withMetadata("entity_id", ONE) if "entity_id" in keys else _one(df)
    counted = df.select(*keys, cell.alias("_cell")).join(F.broadcast(long_), [*keys], "left_semi").groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.select(*keys, "_cell", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows).cast("long").alias("slice"))
    edges = cells.groupBy(*keys, "slice").agg(F.min("_cell").alias("_cell")).groupBy(*keys).agg(F.collect_list(F.struct("_cell", "slice")).alias("_edges"))
    edges = cut_lineage(edges)
    of = F.array_max(F.transform(F.filter("_edges", lambda e: e["_cell"] <= F.col("_at")), lambda e: e["slice"]))
    return (df.withColumn("_at", cell).join(F.broadcast(edges), [*keys], "left")
            .withColumn("slice", F.when(F.col("_edges").isNull(), F.lit(0).cast("long")).otherwise(of)).drop("_at", "_edges"))


def one_slice(df: DataFrame) -> bool:
    """Whether `row_slices` found no entity of several slices."""
    return bool(df.schema["slice"].metadata.get("one_slice"))


def slice_window(keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, one: bool = False):
    return Window.partitionBy(*keys, *([] if one else ["slice"])).orderBy(*order)


def _across(keys):
    return Window.partitionBy(*keys).orderBy("slice")


def adjacent(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS,
             order: Sequence[str] = ORDER) -> DataFrame:
    """Adds structs `prev` and `next` (null at the two ends of the entity)."""
    item, rank = F.struct(*cols), F.struct(*order)
    w = slice_window(keys, order, one_slice(df))
    base = df.withColumn("prev", F.lag(item).over(w)).withColumn("next", F.lead(item).over(w))
    if one_slice(df):
        return base
    edges = (base.groupBy(*keys, "slice")
             .agg(F.min_by(item, rank).alias("_head"), F.max_by(item, rank).alias("_tail")))
    a = _across(keys)
    edges = edges.select(*keys, "slice", F.lag("_tail").over(a).alias("_before"),
                         F.lead("_head").over(a).alias("_after"))
    return (base.join(edges, [*keys, "slice"])
            .withColumn("prev", F.coalesce("prev", "_before"))
            .withColumn("next", F.coalesce("next", "_after"))
            .drop("_before", "_after"))


def context(df: DataFrame, cols: Sequence[str], k: int, keys: Sequence[str] = KEYS,
            order: Sequence[str] = ORDER) -> DataFrame:
    """Adds arrays `before` and `after`: up to k neighbouring rows, oldest first."""
    item = F.struct(*cols)
    w = slice_window(keys, order, one_slice(df))
    base = (df.withColumn("before", F.collect_list(item).over(w.rowsBetween(-k, -1)))
            .withColumn("after", F.collect_list(item).over(w.rowsBetween(1, k))))
    if one_slice(df):
        return base
    rim = base.filter((F.size("before") < k) | (F.size("after") < k))
    e = Window.partitionBy(*keys).orderBy("slice", *order)
    rim = rim.select(*keys, "slice", F.size("before").alias("_nb"), F.size("after").alias("_na"),
                     F.collect_list(item).over(e.rowsBetween(-k, -1)).alias("_pb"),
                     F.collect_list(item).over(e.rowsBetween(1, k)).alias("_pa"))
    ext = (rim.groupBy(*keys, "slice")
           .agg(F.max(F.when(F.col("_nb") == 0, F.col("_pb"))).alias("_xb"),
                F.max(F.when(F.col("_na") == 0, F.col("_pa"))).alias("_xa")))
    out = base.join(ext, [*keys, "slice"])
    full = F.concat("_xb", "before")
    return (out.withColumn("before", F.slice(full, F.greatest(F.size(full) - k + 1, F.lit(1)), k))
            .withColumn("after", F.slice(F.concat("after", "_xa"), 1, k))
            .drop("_xb", "_xa"))


def running_sum(df: DataFrame, sums: dict[str, Column], keys: Sequence[str] = KEYS,
                order: Sequence[str] = ORDER) -> DataFrame:
    """Adds inclusive prefix sums over the whole entity."""
    w = slice_window(keys, order, one_slice(df)).rowsBetween(Window.unboundedPreceding, 0)
    tmp = {f"_v_{n}": c for n, c in sums.items()}
    base = df.withColumns(tmp)
    for n in sums:
        base = base.withColumn(n, F.sum(f"_v_{n}").over(w))
    if one_slice(df):
        return base.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums}).drop(*tmp)
    tot = base.groupBy(*keys, "slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    a = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*keys, "slice", *[F.coalesce(F.sum(f"_t_{n}").over(a), F.lit(0)).alias(f"_o_{n}") for n in sums])
    out = base.join(offs, [*keys, "slice"])
    return (out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"_o_{n}") for n in sums})
            .drop(*tmp, *[f"_o_{n}" for n in sums]))


def carry(df: DataFrame, values: dict[str, Column], forward: bool = True, inclusive: bool = True,
          keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds the nearest non-null value before (or after) each row."""
    edge = 0 if inclusive else -1
    # backwards in reverse order: a frame that runs on to the end would be gone through again for every row
    w = slice_window(keys, order if forward else [F.desc(c) for c in order], one_slice(df)).rowsBetween(Window.unboundedPreceding, edge)
    pick = F.last
    tmp = {f"_v_{n}": c for n, c in values.items()}
    base = df.withColumns(tmp)
    for n in values:
        base = base.withColumn(n, pick(f"_v_{n}", True).over(w))
    if one_slice(df):
        return base.drop(*tmp)
    rank = F.struct(*order)
    agg = F.max_by if forward else F.min_by
    summ = base.groupBy(*keys, "slice").agg(
        *[agg(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), rank)).alias(f"_s_{n}") for n in values])
    a = (_across(keys) if forward else Window.partitionBy(*keys).orderBy(F.desc("slice"))).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*keys, "slice", *[pick(f"_s_{n}", True).over(a).alias(f"_c_{n}") for n in values])
    out = base.join(summ, [*keys, "slice"])
    return (out.withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in values})
            .drop(*tmp, *[f"_c_{n}" for n in values]))


def islands(df: DataFrame, is_break: Column, name: str = "island", keys: Sequence[str] = KEYS,
            order: Sequence[str] = ORDER) -> DataFrame:
    """Adds a run id that grows by one at every row where `is_break` holds."""
    return running_sum(df, {name: F.when(is_break, 1).otherwise(0)}, keys, order)


def spread(df: DataFrame, horizon, width, seq: str = "seq") -> DataFrame:
    """Copies rows lying within `horizon` of a slice edge into the next slice too.

    With `own` marking the original, any window of at most `horizon` either way is
    exact for the owned rows. Needs horizon < width, so a row has at most 3 copies.
    """
    assert horizon < width
    lo = F.floor((F.col(seq) - F.lit(horizon)) / F.lit(width)).cast("long")
    hi = F.floor((F.col(seq) + F.lit(horizon)) / F.lit(width)).cast("long")
    home = F.floor(F.col(seq) / F.lit(width)).cast("long")
    return (df.withColumn("slice", F.explode(F.sequence(lo, hi)))
            .withColumn("own", F.col("slice") == home))


def bucket_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str,
                right_lo: Column, right_hi: Column, reach, condition: Column, how: str = "inner",
                left_alias: str = "l", right_alias: str = "r") -> DataFrame:
    """Range join: `left_at` meets an interval of `right` no wider than a few `reach`.

    Both sides are bucketed on floor(x / reach); the right side is copied into each
    bucket its interval touches, then an equi-join on (keys, bucket) and the exact
    predicate. A hot key is spread over its buckets.
    """
    le = left.withColumn("_b", F.floor(F.col(left_at) / F.lit(reach)).cast("long")).alias(left_alias)
    ri = right.withColumn("_b", F.explode(F.sequence(F.floor(right_lo / F.lit(reach)).cast("long"),
                                                     F.floor(right_hi / F.lit(reach)).cast("long")))).alias(right_alias)
    on = F.col(f"{left_alias}._b") == F.col(f"{right_alias}._b")
    for k in keys:
        on = on & (F.col(f"{left_alias}.{k}") == F.col(f"{right_alias}.{k}"))
    return le.join(ri, on & condition, how)
