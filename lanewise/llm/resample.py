"""Importance resampling towards a target distribution, ranked by parallel sorting by regular sampling.

1. Word n-grams of each text fall into hashed buckets; counts of all documents and of all target texts give each bucket a
   gain, a fixed-size array that travels with the scoring tasks. A document's weight is the mean gain of its n-grams.
2. A score is the weight plus Gumbel noise from a hash of the id, so the highest scores are a draw without replacement.
3. Rows are dealt to p sorted runs. Each run gives p keys at regular places, and the sorted sample gives p - 1 splitters at regular
   places too, so a segment between two splitters has at most about two shares of the rows, whatever the keys. A row's place among the runs is
   the last part of its key, so equal rows are split like others.
4. Rows go to their segments, where pieces of sorted runs are merged. A row's rank is its place there plus the rows of
   all segments before. Segments past the number of rows to draw are counted, not moved.
"""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import columns, partitions, saved
from .words import MARKS, flat

BUCKETS, SEED, MIN_WORDS, SHARE = 10_000, 2024, 20, 10
SEGMENT_ROWS, MOST_SEGMENTS = 1 << 18, 2048
_CHUNK, _TABLE_BYTES = 1 << 20, 40
SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to the CRC-32 of a word that goes on for d bytes after it, and the CRC-32 of d zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> np.uint32(1)) ^ np.uint32(0xEDB88320), byte >> np.uint32(1))
    rows = [byte]
    for _ in range(_TABLE_BYTES - 1):
        rows.append(byte[rows[-1] & 255] ^ (rows[-1] >> np.uint32(8)))
    return np.stack(rows), np.array([zlib.crc32(bytes(d)) for d in range(_TABLE_BYTES + 1)], np.uint32)


_ADD, _ZEROS = _crc_tables()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _crcs(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range, by one table lookup a byte; CRC-32 is linear, so a range is the exclusive or of its bytes' parts."""
    size = ends - starts
    reach = np.repeat(ends, size) - 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    parts = _ADD[np.minimum(reach - at, _TABLE_BYTES - 1), b[at]]
    out = np.bitwise_xor.reduceat(parts, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint32)
    out = out ^ _ZEROS[np.minimum(size, _TABLE_BYTES)]
    for i in np.flatnonzero(size > _TABLE_BYTES):
        out[i] = zlib.crc32(b[starts[i]:ends[i]].tobytes())
    return out


def features(texts, ngrams: int = 1, buckets: int = BUCKETS):
    """(first text, end, number of words and of n-grams of each, bucket of every n-gram, its text) for runs of texts of about 1 MB.

    A word is a run of letters a-z after lower-casing A-Z, digits and characters past ASCII.
    """
    offsets, data = flat(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        b, begins = _FOLD[data[lo:hi]], offsets[i:j] - lo
        inside = ~MARKS[b]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        edge[begins[begins < len(b)]] |= inside[begins[begins < len(b)]]   # a word of one text does not go on in the next
        starts = np.flatnonzero(edge)
        stop = ~inside
        stop[starts] = True
        gaps = np.append(np.flatnonzero(stop), len(b))
        ends = gaps[np.searchsorted(gaps, starts, "right")]
        text = np.searchsorted(begins, starts, "right") - 1
        words = np.bincount(text, minlength=j - i)
        hashed, of = [_crcs(b, starts, ends).astype(np.int64) % buckets], [text]
        for k in range(2, ngrams + 1):                             # longer n-grams are joined by one space and hashed whole
            first = np.flatnonzero(text[:len(text) - k + 1] == text[k - 1:])
            each = [b[starts[w]:ends[w]].tobytes() for w in range(len(starts))]
            hashed.append(np.array([zlib.crc32(b" ".join(each[w:w + k])) % buckets for w in first], np.int64))
            of.append(text[first])
        hashed, of = np.concatenate(hashed), np.concatenate(of)
        yield i, j, words, np.bincount(of, minlength=j - i), hashed, of
        i = j


def bucket_counts(texts: DataFrame, ngrams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """N-grams in each bucket over all rows of texts(text); tasks count first, so at most `buckets` rows a task are shuffled."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, hashed, _ in features(batch.column("text"), ngrams, buckets):
                total += np.bincount(hashed, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = columns(texts, "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()   # at most `buckets`
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source frequency in each bucket, one added to every count, rounded down."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from a hash of the id; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, ngrams: int = 1, seed: int = SEED) -> DataFrame:
    """SCORED columns of every row of docs(doc_id, text)."""
    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, words, n, hashed, of in features(batch.column("text"), ngrams, len(gain)):
                total = np.zeros(j - i, np.int64)
                np.add.at(total, of, gain[hashed])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                drawn = np.array([noise(d, seed) for d in ids[i:j]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), *map(pa.array, (n, words, weight, weight + drawn))], [f.split()[0] for f in SCORED.split(", ")])

    return columns(docs, "doc_id", "text").mapInArrow(work, SCORED)


def _order() -> list:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def _keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Key columns, the last one first: high scores come first, then small ids (null last), then the place among the runs."""
    n = [batch.column(c) for c in ("score", "doc_id", "run", "place")]
    score, doc, run, place = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in n)
    return [place, run, doc, n[1].is_null().to_numpy(zero_copy_only=False).astype(np.int64), -score]


def _segments(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """Number of splitters at or before each key: both are sorted together, a splitter before a key that equals it."""
    k = len(splitters[0])
    both = [np.concatenate([s, x]) for s, x in zip(splitters, keys)]
    order = np.lexsort([np.arange(len(both[0])) >= k, *both])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(order < k)
    return out[k:]


def _splitters(runs: DataFrame, parts: int) -> list[np.ndarray]:
    """Keys of the parts - 1 splitters. Each run gives `parts` keys at regular places; of those, sorted in one task, every parts-th is taken."""
    sizes = runs.groupBy("run").agg(F.count("*").alias("n"))       # one row a run
    share = lambda p: F.floor(p * parts / F.col("n"))
    sample = runs.join(F.broadcast(sizes), "run").where((F.col("place") == 0) | (share(F.col("place")) > share(F.col("place") - 1)))
    step = max(1, int(sizes.agg(F.sum(F.least("n", F.lit(parts)))).first()[0] or 0) // parts)

    def pick(batches):
        at = 0
        for batch in batches:
            keep = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield batch.filter(pa.array((keep > 0) & (keep % step == 0)))

    sample = sample.select("score", "doc_id", "run", "place")
    got = sample.repartition(1).sortWithinPartitions(*_order(), "run", "place").mapInArrow(pick, sample.schema).limit(parts - 1).toArrow()
    return _keys(got.combine_chunks().to_batches()[0]) if got.num_rows else [np.zeros(0, np.int64)] * 5


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows(score, doc_id, n_features, weight), all long, with rank: 1, 2, 3, ... by falling score, then rising doc_id (null last); null past `most`.

    Rows alike in both get different ranks. The driver sees numbers of rows and MOST_SEGMENTS keys at most.
    """
    spark = rows.sparkSession
    rows = columns(rows, "score", "doc_id", "n_features", "weight")
    total = rows.count()
    most = total if most is None else min(most, total)
    parts = min(MOST_SEGMENTS, max(1, partitions(spark), -(-total // SEGMENT_ROWS)))
    place = F.monotonically_increasing_id()                        # the partition, then the place in it
    sorted_runs = rows.repartition(parts).sortWithinPartitions(*_order()).select("*", place.alias("m"))
    runs = saved(sorted_runs.select("score", "doc_id", "n_features", "weight", F.shiftright("m", 33).alias("run"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "runs")
    splitters = _splitters(runs, parts)

    def deal(batches):
        for batch in batches:
            yield batch.append_column("segment", pa.array(_segments(_keys(batch), splitters)))

    dealt = runs.mapInArrow(deal, "score long, doc_id long, n_features long, weight long, run long, place long, segment long")
    per = {r[0]: r[1] for r in dealt.groupBy("segment").agg(F.count("*")).collect()}        # one row a segment
    ends = np.cumsum([per.get(s, 0) for s in range(len(splitters[0]) + 1)])
    bases = np.concatenate([[0], ends[:-1]])
    needed = int(np.searchsorted(bases, most, "left"))             # the segments that begin before the last row to draw

    def number(batches):
        now, at = -1, 0
        for batch in batches:                                      # a partition has its segments one after the other
            s = batch.column("segment").to_numpy()
            first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else s
            before = np.where(begin == 0, at if len(s) and s[0] == now else 0, 0)
            nth = np.arange(len(s)) - begin + before
            if len(s):
                now, at = int(s[-1]), int(nth[-1]) + 1
            rank = bases[s] + 1 + nth
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("score", "doc_id", "n_features", "weight")], pa.array(rank, pa.int64(), mask=rank > most)],
                                             ["score", "doc_id", "n_features", "weight", "rank"])

    # rows of a segment arrive as pieces of sorted runs, which the sort merges; it spills if a segment is large
    met = dealt.where(F.col("segment") < needed).repartition(parts, "segment").sortWithinPartitions("segment", *_order(), "run", "place")
    past = dealt.where(F.col("segment") >= needed).select("score", "doc_id", "n_features", "weight", F.lit(None).cast("long").alias("rank"))
    return met.mapInArrow(number, "score long, doc_id long, n_features long, weight long, rank long").union(past)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, ngrams: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs(doc_id, text); rank is null where it is not drawn.

    Drawn are floor(share * N / 100) of the N rows with min_words words or more, as target(text) has words. A null or empty text has no
    features and weight 0. A null doc_id draws noise like an empty one and comes last among equal scores. Rows that repeat are ranked each, one after the other.
    An empty target leaves all gains to the source's counts. Extra columns are ignored; no rows give no rows.
    """
    docs, target = columns(docs, "doc_id", "text"), columns(target, "text")
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    rows = saved(scored(docs, gain, ngrams, seed), "scored")
    fit = F.col("n_words") >= min_words
    drawn = ranked(rows.where(fit).select("score", "doc_id", "n_features", "weight"), rows.where(fit).count() * share // 100)
    out = drawn.select("doc_id", "n_features", "weight", "score", "rank")
    return out.union(rows.where(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
