"""Exact top-k search in Hamming space by incremental multi-index hashing.

Codes of 64 bits are cut into four segments of 16. A code within distance d of a query agrees with it up to
floor(d / 4) bits in at least one segment, so searching segments in turn at growing radii covers ever larger whole distances;
a query stops when the distance of its k-th verified neighbour is covered. The codes are dealt to shards
of bounded size; every block of queries searches every shard and keeps k ids of it, however many codes an id has.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

SEGMENTS, WIDTH, SHARD_CODES, QUERY_BLOCK = 4, 16, 1 << 19, 1 << 12
FOUND = "query_id long, neighbor_id long, distance long"


def sign_code(vector: Column, dims: int = 64) -> Column:
    """64-bit code of a vector: bit i is 1 where component i is above 0 (NaN is). Null unless the vector has `dims` known components."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    whole = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull())
    return F.when(whole, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _masks() -> list[np.ndarray]:
    """All 16-bit flips with r bits set, for each r."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), r)], np.int64) for r in range(WIDTH + 1)]


class MultiIndex:
    """Distinct 64-bit codes, sorted once for each segment."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.masks = codes.view(np.uint64), _masks()
        self.order, self.edges = [], []
        for s in range(SEGMENTS):
            key = self._segment(self.codes, s)
            order = np.argsort(key, kind="stable")
            self.order.append(order)
            self.edges.append(np.searchsorted(key[order], np.arange((1 << WIDTH) + 1)))

    @staticmethod
    def _segment(codes, s: int):
        return ((codes >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) of all codes as near as the k-th nearest; fewer if there are fewer codes."""
        q = np.array([query], np.int64).view(np.uint64)
        seen = np.zeros(len(self.codes), bool)
        pos, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = min(k, len(self.codes))
        for r in range(WIDTH + 1):
            for s in range(SEGMENTS):
                probe = self.masks[r] ^ self._segment(q, s)[0]
                lo, hi = self.edges[s][probe], self.edges[s][probe + 1]
                n = hi - lo
                if n.any():
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    new = self.order[s][at]
                    new = new[~seen[new]]
                    seen[new] = True
                    pos = np.append(pos, new)
                    dist = np.append(dist, np.bitwise_count(self.codes[new] ^ q[0]).astype(np.int64))
                # segments up to s are searched to radius r, the others to r - 1
                covered = SEGMENTS * r + s
                if len(dist) >= k and (not k or np.partition(dist, k - 1)[k - 1] <= covered):
                    keep = dist <= (np.partition(dist, k - 1)[k - 1] if k else -1)
                    return pos[keep], dist[keep]
        return pos, dist


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64) -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k nearest other rows of vectors(id, vector) for each of queries(id, vector).

    Nearness is the Hamming distance of sign codes, ties go to the smaller id, and the query's own id is no neighbour. Rows
    without an id or with a vector that is null, of another length or has a null component are not searched
    and ask nothing. Rows with equal id and code count once; an id with several codes may be found by each. Extra
    columns are ignored; empty tables give no rows.
    """
    coded = saved(vectors.select(F.col("id").alias("id"), sign_code(F.col("vector"), dims).alias("code")).where("id is not null and code is not null").distinct(), "codes")
    asked = saved(queries.select(F.col("id").alias("query_id"), sign_code(F.col("vector"), dims).alias("query_code"))
                  .where("query_id is not null and query_code is not null").distinct(), "asked")
    # copies of a code stand as one code with its k + 1 smallest ids: k of them are not the query's, and no id left out ranks before those
    named = saved(coded.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1).drop("n"), "named")
    shards = max(1, -(-named.count() // SHARD_CODES))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    left = (named.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query_code"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def search(codes_in: pa.Table, asked_in: pa.Table) -> pa.Table:
        code, ids = [codes_in.column(c).to_numpy() if codes_in.num_rows else np.zeros(0, np.int64) for c in ("code", "id")]
        order = np.argsort(code, kind="stable")
        held, first, n = np.unique(code[order], return_index=True, return_counts=True)
        index, ids, every = MultiIndex(held), ids[order], np.unique(ids)
        parts = [[], [], []]
        for qid, q in zip(asked_in.column("query_id").to_pylist(), asked_in.column("query_code").to_pylist()):
            at = np.searchsorted(every, qid)
            want = min(k, len(every) - int(at < len(every) and every[at] == qid))
            near = k + 1                                           # one more: the query's own row may be among them
            while True:
                pos, dist = index.search(q, near)
                row = np.repeat(first[pos] - (np.cumsum(n[pos]) - n[pos]), n[pos]) + np.arange(n[pos].sum())
                other, far = ids[row], np.repeat(dist, n[pos])
                other, far = other[other != qid], far[other != qid]
                rank = np.lexsort((other, far))
                rank = rank[np.sort(np.unique(other[rank], return_index=True)[1])]     # each id where it is nearest
                if len(rank) >= want:
                    break
                near *= 2                                          # ids with several codes took up places
            rank = rank[:k]
            for p, v in zip(parts, (np.full(len(rank), qid), other[rank], far[rank])):
                p.append(v)
        return pa.table([pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64()) for p in parts], [f.split()[0] for f in FOUND.split(", ")])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (found.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "distance"))
