"""Best-fit packing of documents into sequences, with certified bin counts.

Pieces go to hashed partitions of bounded size, and each is packed by best-fit decreasing. Dual-feasible
functions of its length histogram bound the bins any packing of the partition needs; where the
packing meets the bound it is optimal and stays. Partitions with a gap give the documents of their
unfilled sequences to a common pool, which is dealt and packed anew, until no round saves a sequence, the
whole is certified, or ROUNDS rounds are done.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import columns, saved
from .workers import frugal

PART_ITEMS, ROUNDS = 1 << 15, 6
PIECE = "doc_id long, piece long, start long, length long, ids_crc32 long"
PACKED = PIECE + ", row long, part long, sequence_id long, offset long, fill long"


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that `histogram[l]` items of each length l need at least: the best of three families of dual-feasible functions."""
    l, h = np.arange(len(histogram)), histogram.astype(np.int64)
    l, h = l[h > 0], h[h > 0]
    if not len(l):
        return 0
    best = -(-int((l * h).sum()) // capacity)
    half = range(1, capacity // 2 + 1)
    for e in half:                                                 # long items count whole, short ones not at all
        value = np.where(l > capacity - e, capacity, np.where(l >= e, l, 0))
        best = max(best, -(-int((value * h).sum()) // capacity))
    for k in range(1, 33):                                         # shares of k + 1 round down to shares of k
        value = np.where((k + 1) * l % capacity == 0, k * l, (k + 1) * l // capacity * capacity)
        best = max(best, -(-int((value * h).sum()) // (k * capacity)))
    for e in half:                                                 # steps of e, short items down, long items up
        q = capacity // e
        value = np.where(2 * l > capacity, 2 * (q - (capacity - l) // e), np.where(2 * l == capacity, q, 2 * (l // e)))
        best = max(best, -(-int((value * h).sum()) // (2 * q)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item by best-fit decreasing, and the fill of each bin. Ties by position."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_, mask = [[] for _ in range(capacity + 1)], 0             # open bins by room left; a bit for each room that occurs
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, capacity - room
        fills[b] += n
        if room > n:
            if not open_[room - n]:
                mask |= 1 << (room - n)
            open_[room - n].append(b)
    return bins, offsets, np.array(fills, np.int64)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of docs(doc_id, text): ids and end id, cut only if longer than capacity, the first piece being the short one."""
    @frugal("tokens")
    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some, out = batch.slice(a, 256), []
                for d, ids in zip(some.column("doc_id").to_pylist(), tokens.encode(some.column("text"), path)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    at = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                    out += [(d, p, s, e - s, zlib.crc32(ids[s:e].tobytes())) for p, (s, e) in enumerate(zip(at, at[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return columns(docs, "doc_id", "text").mapInArrow(cut, PIECE)


def _pack(items: DataFrame, count: int, first_part: int, capacity: int, salt: int) -> tuple[DataFrame, int]:
    """Deals items to parts of about PART_ITEMS rows and packs each; parts are numbered from first_part."""
    parts = max(1, -(-count // PART_ITEMS))
    names = [f.split()[0] for f in PACKED.split(", ")]

    @frugal()
    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("row").to_numpy(), kind="stable")
        table = table.take(order)                                  # the same rows give the same packing
        part = table.column("part")[0].as_py()
        bins, offsets, fills = best_fit(table.column("length").to_numpy(), capacity)
        if len(fills) > 1 << 20:
            raise ValueError("a part has more than 2**20 sequences; their numbers would repeat")
        cols = {"sequence_id": (part << 20) + bins, "offset": offsets, "fill": fills[bins]}
        return pa.Table.from_arrays([pa.array(cols[c]) if c in cols else table.column(c).combine_chunks() for c in names], names)

    dealt = items.select(*[f.split()[0] for f in PIECE.split(", ")], "row",
                         (F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)) + first_part).cast("long").alias("part"))
    return dealt.groupBy("part").applyInArrow(pack, PACKED), first_part + parts


def _bounds(packed: DataFrame, capacity: int) -> DataFrame:
    """part, bins, bound of each part, from its length histogram (one row a part)."""
    @frugal()
    def bound(table: pa.Table) -> pa.Table:
        h = np.bincount(table.column("length").to_numpy(), weights=table.column("n").to_numpy(), minlength=capacity + 1)
        return pa.table({"part": [table.column("part")[0].as_py()], "bins": [sum(table.column("bins").to_pylist())],
                         "bound": [lower_bound(h.round().astype(np.int64), capacity)]})

    begins = F.sum(F.when(F.col("offset") == 0, 1).otherwise(0))
    return packed.groupBy("part", "length").agg(F.count("*").alias("n"), begins.alias("bins")).groupBy("part").applyInArrow(bound, "part long, bins long, bound long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text, ...).

    A null text is empty and is its end id alone. Rows that repeat are packed each; null doc_ids are kept. Ties go by
    the rows' order in the table. Extra columns are ignored; no rows give no pieces. A partition holds PART_ITEMS
    pieces on average, however rows are distributed, and no more than 2**20 sequences.
    """
    cut = saved(pieces(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    done, top = _pack(rest, rest.count(), 0, capacity, 0)
    done = saved(done, "packed")
    rows = done.groupBy("length").count().toPandas()               # one row a length
    need = lower_bound(np.bincount(rows["length"].to_numpy(np.int64), weights=rows["count"], minlength=capacity + 1).round().astype(np.int64), capacity)
    bins = done.where("offset = 0").count()
    for r in range(1, ROUNDS + 1):
        if bins <= need:
            break
        gaps = _bounds(done, capacity).where("bins > bound").select("part")
        pool = saved(done.join(F.broadcast(gaps), "part").where(F.col("fill") < capacity).drop("part"), "pool")   # one row a part
        count, held = pool.count(), pool.where("offset = 0").count()
        if not count:
            break
        again, top = _pack(pool, count, top, capacity, r)
        again = saved(again, "repacked")
        won = held - again.where("offset = 0").count()
        if won <= 0:
            break
        bins -= won
        kept = done.join(F.broadcast(gaps.withColumn("gap", F.lit(True))), "part", "left").where((F.col("fill") == capacity) | F.col("gap").isNull()).drop("gap")
        done = saved(kept.select(again.columns).union(again), "packed")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return done.select(out).union(full).withColumn("piece", F.col("piece").cast("int"))


def certificate(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """(sequences used, lower bound for any packing) of a packing."""
    rows = packed.groupBy("length").count().toPandas()
    bound = lower_bound(np.bincount(rows["length"].to_numpy(np.int64), weights=rows["count"], minlength=capacity + 1).round().astype(np.int64), capacity)
    return packed.where(F.col("offset") == 0).count(), bound
