"""Neighbourhoods of rows as array arithmetic on sorted Arrow batches.

`stencil` sorts each (key, slice) once and gives stretches of rows to a small numpy function, which sees k rows before and after each
row it answers for. The k rows beyond a slice's edges are copied in from its neighbours, for keys of several slices only. A column is a
pair (values, valid): a null is not a NaN. A task holds one stretch of rows, whatever the length of a key.
"""

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage
from .slices import KEYS, ORDER, one_slice, slice_window

STRETCH = 1 << 16           # rows answered for at a time


def pair(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and where there are any."""
    valid = column.is_valid().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.is_valid().to_numpy()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(0, column.type))
    return column.to_numpy(), valid


def ge(a, b):
    """a >= b, NaN being the largest number."""
    return (a >= b) | np.isnan(a)


def gt(a, b):
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True at the first row of each stretch of equal keys."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).combine_chunks()
        if len(v) > 1:
            new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
    return new


class Rows:
    """Sorted rows of some slices: `first` and `end` bound the held rows of each row's slice, `mine` are those to answer for."""

    def __init__(self, table: pa.Table, keys: Sequence[str], a: int, b: int, state: dict, final: bool):
        self.table, self.n, self.i, self.state = table, table.num_rows, np.arange(table.num_rows), state
        starts = np.flatnonzero(changes(table, keys))
        ends = np.append(starts[1:], self.n)
        self.first, self.end = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
        own = table.column("_own").to_numpy()
        self.mine = own & (self.i >= a) & (self.i < b)
        self.seq = table.column("seq").to_numpy() if "seq" in table.column_names else None
        self._keys, self._torn = keys, None
        # slices of which a stretch or a neighbouring slice holds a part
        torn = np.logical_or.reduceat(~own, starts) if self.n else own
        torn[:1] |= a > 0 or "key" in state
        torn[-1:] |= not final
        self._torn = starts[torn]

    def col(self, name: str):
        return pair(self.table.column(name))

    def at(self, x, d: int):
        """The pair of the row d further on, and whether there is such a row in the slice."""
        j = self.i + d
        there = (j >= self.first) & (j < self.end)
        j = np.where(there, j, self.i)
        return (x[0][j], x[1][j] & there), there

    def mean3(self, x):
        """Three-row mean, end rows replicated."""
        (p, okp), _ = self.at(x, -1)
        (q, okq), _ = self.at(x, 1)
        return (np.where(okp, p, x[0]) + x[0] + np.where(okq, q, x[0])) / 3, x[1]

    def slope(self, x, unit: int):
        """Derivative on irregular spacing; one-sided where a neighbour is missing."""
        f, ok = x
        (fm, okm), before = self.at(x, -1)
        (fp, okp), after = self.at(x, 1)
        hs = (self.seq - self.seq[np.where(before, self.i - 1, self.i)]) / unit
        hd = (self.seq[np.where(after, self.i + 1, self.i)] - self.seq) / unit
        with np.errstate(all="ignore"):
            den = hs * hd * (hs + hd)
            inner = (hs * hs * fp + (hd * hd - hs * hs) * f - hd * hd * fm) / den
            head, tail = (fp - f) / hd, (f - fm) / hs
        v = np.where(~before, head, np.where(~after, tail, inner))
        return v, np.where(~before, ok & okp & (hd != 0), np.where(~after, ok & okm & (hs != 0), okm & ok & okp & (den != 0)))

    def median(self, x, at: np.ndarray, d0: int, d1: int):
        """Median of x over the rows at + d0 ... at + d1 that there are, and their number."""
        j = at[:, None] + np.arange(d0, d1 + 1)
        there = (j >= self.first[at][:, None]) & (j < self.end[at][:, None])
        j = np.where(there, j, at[:, None])
        n = there.sum(1)
        return (*sorted_median(x[0][j], x[1][j] & there, n), n)

    def sums(self, **values: np.ndarray) -> dict[str, np.ndarray]:
        """Inclusive prefix sums over the slice's own rows; `stencil` adds what earlier slices hold."""
        keep, out, self.deltas = self.state, {}, {}
        mine = np.flatnonzero(self.mine)
        if not len(mine):
            return {n: np.zeros(self.n, np.int64) for n in values}
        key = lambda r: tuple(self.table.column(k)[r].as_py() for k in self._keys)
        head, last = self.first[mine[0]], mine[-1]
        goes_on = keep.get("key") == key(int(mine[0]))
        for name, v in values.items():
            v = np.where(self.mine, v, 0).astype(np.int64)
            c = np.cumsum(v)
            local = c - (c - v)[self.first]
            self.deltas[name] = local[self.end - 1]
            if goes_on:
                local = local + np.where(self.first == head, keep[name], 0)
            out[name] = local
        keep.update({n: int(v[last]) for n, v in out.items()}, key=key(int(last)))
        return out

    def torn(self) -> np.ndarray:
        """A row of each slice whose sums others need."""
        return self._torn


def sorted_median(v: np.ndarray, ok: np.ndarray, n: np.ndarray):
    """Interpolating median of the n first of each row's numbers once they are sorted, NaN after numbers, nulls last."""
    v = np.sort(np.where(ok, v, np.nan), axis=1)
    mid, r = n // 2, np.arange(len(v))
    hi = v[r, np.minimum(mid, v.shape[1] - 1)]
    lo = v[r, np.maximum(mid - 1, 0)]
    with np.errstate(all="ignore"):
        return np.where(n % 2 == 1, hi, (lo + hi) / 2), (n > 0) & (mid < ok.sum(1))


def _rim(df: DataFrame, k: int, keys, order) -> DataFrame | None:
    """The k rows before and after each slice of keys that have several, under the number of that slice."""
    if one_slice(df):
        return None
    many = df.groupBy(*keys).agg(F.min("slice").alias("_a"), F.max("slice").alias("_b")).where("_a < _b").select(*keys)
    many = cut_lineage(many)
    if many.isEmpty():
        return None
    rows = df.join(many, [*keys], "left_semi")
    n = F.count("*").over(Window.partitionBy(*keys, "slice"))
    rows = rows.select("*", F.struct(*df.drop("slice").columns).alias("_r"), F.row_number().over(slice_window(keys, order)).alias("_i"), n.alias("_n"))
    rim = rows.where((F.col("_i") <= k) | (F.col("_n") - F.col("_i") < k))
    e = Window.partitionBy(*keys).orderBy("slice", *order)
    rim = rim.select("slice", "_i", "_n", F.collect_list("_r").over(e.rowsBetween(-k, -1)).alias("_p"), F.collect_list("_r").over(e.rowsBetween(1, k)).alias("_f"))
    put = rim.where("_i = 1").select("slice", F.explode("_p").alias("_r")).union(rim.where("_i = _n").select("slice", F.explode("_f").alias("_r")))
    return put.select("slice", "_r.*").select(*df.columns)


class Find(NamedTuple):
    """What looks at rows: `fn(rows) -> (indices, {column: pair})` keeps some of them, sees k rows before and after each, and adds columns (types in `adds`).

    prefix names the added columns that are sums of `rows.sums` and from which: sums of earlier slices are added to them."""
    k: int
    fn: Callable
    adds: dict[str, str]
    prefix: dict[str, str] | None = None


def stencil(df: DataFrame, k: int, fn: Callable, adds: dict[str, str], prefix: dict[str, str] | None = None,
            keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows of df that a `Find` of these parts keeps, with the columns it adds."""
    out = _answers(df, k, fn, adds, prefix, keys, order)
    return _shifted(cut_lineage(out), prefix, keys) if prefix else out.drop("_sum")


def several(df: DataFrame, finds: Sequence[Find], keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> list[DataFrame]:
    """What each of `finds` keeps, of one pass over the rows, written once. One of them may have sums."""
    adds = {"_what": "integer"} | {c: t for f in finds for c, t in f.adds.items()}
    summed = [f.prefix for f in finds if f.prefix]
    assert len(summed) <= 1

    def fn(r: Rows):
        found = [f.fn(r) for f in finds]
        new = {"_what": _filled([(np.full(len(at), i, np.int32), np.ones(len(at), bool)) for i, (at, _) in enumerate(found)], found)}
        for c in list(adds)[1:]:
            new[c] = _filled([cols.get(c) for _, cols in found], found)
        return np.concatenate([at for at, _ in found]), new

    out = cut_lineage(_answers(df, max(f.k for f in finds), fn, adds, summed[0] if summed else None, keys, order))
    parts = [out.where((F.col("_what") == i) | F.col("_sum")).select(*df.columns, *f.adds, "_sum") for i, f in enumerate(finds)]
    return [_shifted(part, f.prefix, keys) if f.prefix else part.where("NOT _sum").drop("_sum") for part, f in zip(parts, finds)]


def _filled(parts, found):
    """One pair out of those of several finds, null where a find has none."""
    like = next(p[0] for p in parts if p is not None).dtype
    none = [(np.zeros(len(at), like), np.zeros(len(at), bool)) for at, _ in found]
    return tuple(np.concatenate([(p or n)[side] for p, n in zip(parts, none)]) for side in (0, 1))


def _answers(df: DataFrame, k: int, fn: Callable, adds: dict[str, str], prefix: dict[str, str] | None, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    at = [*keys, "slice"]
    df = df.dropna(subset=at)
    rim = _rim(df, k, keys, order)
    rows = df.withColumn("_own", F.lit(True))
    if rim is not None:
        rows = rows.unionByName(rim.withColumn("_own", F.lit(False)))
    rows = rows.repartition(*(keys if one_slice(df) else at)).sortWithinPartitions(*at, *order)
    names, schema = df.columns, StructType(list(df.schema.fields))
    for name, kind in adds.items():
        schema = schema.add(name, kind)
    schema = schema.add("_sum", "boolean")

    def answer(table, a, b, state, final):
        r = Rows(table, at, a, b, state, final)
        idx, new = fn(r)
        out = table.select(names).take(pa.array(idx))
        for name in adds:
            v, ok = new[name]
            out = out.append_column(name, pa.array(v, mask=~ok))
        out = out.append_column("_sum", pa.array(np.zeros(len(idx), bool)))
        yield from out.to_batches()
        if prefix and r.mine.any():
            t = r.torn()
            some = table.select(names).take(pa.array(t))
            for name in adds:
                like = out.column(name).type
                some = some.append_column(name, pa.array(r.deltas[prefix[name]][t]).cast(like) if name in prefix else pa.nulls(len(t), like))
            yield from some.append_column("_sum", pa.array(np.ones(len(t), bool))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, a, state = [], 0, 0, {}
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n - a >= STRETCH + k:
                table = pa.Table.from_batches(held).combine_chunks()
                b = n - k
                yield from answer(table, a, b, state, False)
                cut = max(0, b - k)
                held, n, a = table.slice(cut).to_batches(), n - cut, b - cut
        if n:
            yield from answer(pa.Table.from_batches(held).combine_chunks(), a, n, state, True)

    return rows.mapInArrow(run, schema)


def _shifted(out: DataFrame, prefix: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Written rows of `_answers`, with what earlier slices hold added to the sums."""
    at = [*keys, "slice"]
    if one_slice(out):          # its stretches add up already
        return out.where("NOT _sum").drop("_sum")
    w = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = out.where("_sum").groupBy(*at).agg(*[F.sum(c).alias(f"_o_{c}") for c in prefix])
    offs = per.select(*at, *[F.coalesce(F.sum(f"_o_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in prefix])
    out = out.where("NOT _sum").join(offs, at, "left")
    return out.withColumns({c: F.col(c) + F.coalesce(F.col(f"_o_{c}"), F.lit(0)) for c in prefix}).drop("_sum", *[f"_o_{c}" for c in prefix])


def whole(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """`fn(table, starts, ends) -> pa.Table` over sorted rows of whole groups; the keys bound the rows of a group."""
    rows = df.dropna(subset=list(keys)).repartition(*keys).sortWithinPartitions(*keys, *order)

    def answer(table):
        starts = np.flatnonzero(changes(table, keys))
        return fn(table, starts, np.append(starts[1:], table.num_rows)).to_batches()

    def run(batches):
        held, n, ask = [], 0, STRETCH
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ask:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.flatnonzero(changes(table, keys))[-1])
                if cut:
                    yield from answer(table.slice(0, cut).combine_chunks())
                held, n = table.slice(cut).to_batches(), n - cut
                ask = max(STRETCH, 2 * n)                  # a long group is looked through a few times only
        if n:
            yield from answer(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, schema)
