"""Spelling variants of a corpus's words by search schemes on an FM-index that runs in either direction.

1. Words are counted in Arrow batches, by task first.
2. Two words that differ by one edit agree on the left or the right half of either. A word is therefore looked up twice:
   among words that begin with its left half and among those that end with its right half. Halves are the keys that deal words to
   shards; a shard's index has its words only, and a word stands in at most two groups on either side.
3. A shard's words, each between delimiters, make one text. Its suffixes are ranked by prefix doubling; the characters before them, sorted by
   (character, rank), answer every step of a search by bisection. Right halves are searched in the text, which goes on to the
   left; left halves in the text of reversed words, which goes on to the right.
4. All words of a shard step together as intervals of suffix ranks: exact over the half, then with one character inserted, deleted or
   replaced at any place of the other half, up to the delimiter.
5. A group under one half that has more than GROUP_WORDS words is indexed in several shards, and its words are looked up in each.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import columns, partitions, saved

MIN_LENGTH, MIN_COUNT, FACTOR, DIVISOR = 7, 2, 10, 31
KEPT_WORDS, SHARD_WORDS, GROUP_WORDS, QUERIES = 100_000, 1 << 15, 1 << 15, 1 << 12
_END = 1                                                           # the delimiter, below all letters


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, divisor: int | None = DIVISOR) -> DataFrame:
    """word, n of the runs of letters (A-Z, a-z, U+00C0 to U+00FF) in docs(doc_id, text), after lower-casing A-Z.

    Where divisor divides the CRC-32 h of <doc_id>:<run>, the run loses its code point h % length; None leaves runs as they are.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")       # shorter runs never reach min_length

    def count(batches):
        kept = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])
            kept.clear()
            return rows

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                if not text.is_valid:
                    continue
                found = Counter(run.findall(text.as_buffer().to_pybytes().lower().decode()))    # bytes.lower folds A-Z only
                if divisor:
                    head = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                    for w in list(found):
                        h = zlib.crc32(w.encode(), head)
                        if h % divisor == 0:
                            n, at = found.pop(w), h % len(w)
                            if len(w) > min_length:
                                kept[w[:at] + w[at + 1:]] += n
                kept.update(found)
                if len(kept) > KEPT_WORDS:
                    yield flush()
        yield flush()

    counted = columns(docs, "doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _half(size, side: int):
    """Length of the half that agrees: the right one on side 0, the left one on side 1."""
    return size - F.floor(size / 2) if side == 0 else F.floor(size / 2)


def halves(words: DataFrame) -> DataFrame:
    """side, key, text, n, query, entry: each word under every half that a word one edit away may have (entry) and under its own (query too).

    Side 1 holds reversed words, so keys end the texts on either side.
    """
    size = F.char_length("word")

    def under(side: int):
        own = _half(size, side)
        return F.transform(F.array_distinct(F.array(*[_half(size + k, side).cast("int") for k in (-1, 0, 1)])),
                           lambda e: F.struct(F.lit(side).alias("side"), e.alias("e"), (e == own).alias("query")))

    rows = words.select("word", "n", F.inline(F.concat(under(0), under(1)))).withColumn("text", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))
    return rows.select("side", F.expr("right(text, e)").alias("key"), "text", "n", "query", F.lit(True).alias("entry"))


def sharded(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of halves with their shard. A key of more than GROUP_WORDS words is dealt to several, and its queries go to each."""
    large = rows.groupBy("side", "key").agg(F.count("*").alias("size")).where(F.col("size") > GROUP_WORDS)
    large = saved(large.withColumn("blocks", F.ceil(F.col("size") / GROUP_WORDS).cast("int")).drop("size"), "large-groups")
    if not large.isEmpty():                                        # one row for each GROUP_WORDS words at most
        rows = rows.join(F.broadcast(large) if large.count() <= 1 << 16 else large, ["side", "key"], "left")
    else:
        rows = rows.withColumn("blocks", F.lit(None).cast("int"))
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("text"), F.col("blocks"))).cast("int")
    rows = rows.withColumn("block", own)
    others = (rows.where("blocks > 1 and query").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("at <> block")
              .withColumns({"block": F.col("at"), "entry": F.lit(False)}).drop("at"))
    return rows.unionByName(others).withColumn("shard", F.pmod(F.xxhash64("side", "key", "block"), F.lit(shards)).cast("int"))


class Index:
    """Suffix ranks of words (sorted, distinct, as latin-1 bytes), each between delimiters; a search goes to the left."""

    def __init__(self, words: list[bytes]):
        end = bytes([_END])
        t = np.frombuffer(end + b"".join(w + end for w in words), np.uint8)
        self.starts = np.cumsum([0, *[len(w) + 1 for w in words]])  # the delimiter before each word
        self.n = len(t)
        # Prefix doubling up to the first delimiter; beyond it the order of words decides, as words are sorted.
        word_of = np.cumsum(t == _END)
        word_of[-1] = 0                                            # the last delimiter is the least suffix
        rank = t.astype(np.int64)
        width, longest = 1, max((len(w) for w in words), default=0) + 1
        stop = np.append(np.flatnonzero(t == _END), self.n)
        left = stop[np.searchsorted(stop, np.arange(self.n), "left")] - np.arange(self.n)   # characters up to the delimiter
        while width <= longest:
            ahead = np.zeros(self.n, np.int64)
            more = left >= width
            ahead[more] = rank[np.flatnonzero(more) + width] + 1
            pair = rank * (int(rank.max()) + 2) + ahead
            _, rank = np.unique(pair, return_inverse=True)
            width *= 2
        self.suffix = np.lexsort((word_of, rank))
        before = t[self.suffix - 1].astype(np.int64)               # the first suffix has the last delimiter before it
        keys = before * (self.n + 1) + np.arange(self.n)
        self.keys = np.sort(keys)
        self.before = before
        self.letters = np.unique(t)

    def step(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with c and go on like those of lo..hi-1."""
        base = c.astype(np.int64) * (self.n + 1)
        return np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)

    def choices(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, character): the letters that stand before the suffixes of each interval, each once."""
        wide = hi - lo > 4 * len(self.letters)
        w = np.flatnonzero(~wide)
        size = (hi - lo)[w]
        state = np.repeat(w, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[w], size)
        pair = np.unique(state * 256 + self.before[at])
        state, c = pair >> 8, pair & 255
        if wide.any():
            every = np.flatnonzero(wide)
            state, c = np.concatenate([state, np.repeat(every, len(self.letters))]), np.concatenate([c, np.tile(self.letters, len(every)).astype(np.int64)])
        real = c != _END
        return state[real], c[real]


def search(index: Index, queries: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of all words of the index that differ from the query by one edit before its last `exact` characters."""
    raw = np.frombuffer(b"".join(queries), np.uint8).astype(np.int64)
    size = np.array([len(q) for q in queries], np.int64)
    ends = np.cumsum(size)
    at = lambda q, i: raw[ends[q] - size[q] + i]
    q, lo, hi = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), index.n, np.int64)
    # the delimiter and the half that agrees
    lo, hi = index.step(lo, hi, np.full(len(q), _END, np.int64))
    for d in range(int(exact.max(initial=0))):
        on = np.flatnonzero(exact[q] > d)
        lo[on], hi[on] = index.step(lo[on], hi[on], at(q[on], size[q[on]] - 1 - d))
    left = size - exact                                            # characters still to match
    found_q, found_w = [], []
    edited = [np.zeros(0, np.int64)] * 4                           # query, lo, hi, characters left, with the edit made
    while len(q) or len(edited[0]):
        live = hi > lo
        q, lo, hi, left = q[live], lo[live], hi[live], left[live]
        # states whose edit is made: one exact step, or the delimiter
        eq, elo, ehi, eleft = edited
        done = eleft == 0
        nlo, nhi = index.step(elo, ehi, np.where(done, _END, at(eq, np.maximum(eleft - 1, 0))) if len(eq) else elo)
        good = nhi > nlo
        hit = good & done
        if hit.any():
            found_q.append(eq[hit])
            found_w.append(np.searchsorted(index.starts, index.suffix[nlo[hit]]))
        go = good & ~done
        parts = [[eq[go]], [nlo[go]], [nhi[go]], [eleft[go] - 1]]
        if len(q):
            some = left > 0
            state, c = index.choices(lo, hi)
            slo, shi = index.step(lo[state], hi[state], c)
            own = np.where(left[state] > 0, at(q[state], np.maximum(left[state] - 1, 0)), -1)
            for keep, back in (((left[state] > 0) & (c != own), 1), (c != own, 0)):          # replaced; inserted
                for p, v in zip(parts, (q[state], slo, shi, left[state] - back)):
                    p.append(v[keep])
            for p, v in zip(parts, (q, lo, hi, left - 1)):         # deleted
                p.append(v[some])
            q, lo, hi, left = q[some], lo[some], hi[some], left[some]
            lo, hi = index.step(lo, hi, at(q, left - 1)) if len(q) else (lo, hi)
            left = left - 1
        edited = [np.concatenate(p) for p in parts]
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.concatenate(found_q) * (len(index.starts) + 1) + np.concatenate(found_w))
    return pair // (len(index.starts) + 1), pair % (len(index.starts) + 1)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs of words(word, n) that differ by exactly one inserted, deleted or replaced character, from either end."""
    rows = halves(words)
    shards = max(partitions(words.sparkSession), -(-6 * words.count() // SHARD_WORDS))

    def look_up(table: pa.Table) -> pa.Table:
        side = table.column("side")[0].as_py()
        text = [w.encode("latin-1") for w in table.column("text").to_pylist()]
        entry, query = (table.column(c).to_numpy() for c in ("entry", "query"))
        n = dict(zip(text, table.column("n").to_pylist()))
        words_ = sorted({w for w, e in zip(text, entry) if e})
        index = Index(words_)
        asked = sorted(((w[::-1], w) for w, q in zip(text, query) if q))   # words with one ending stand together
        asked = [w for _, w in asked]
        half = np.array([len(w) - len(w) // 2 if side == 0 else len(w) // 2 for w in asked], np.int64)
        plain = lambda w: (w if side == 0 else w[::-1]).decode("latin-1")
        out = [[], [], []]
        for a in range(0, len(asked), QUERIES):
            for q, w in zip(*(x.tolist() for x in search(index, asked[a:a + QUERIES], half[a:a + QUERIES]))):
                for c, v in zip(out, (plain(asked[a + q]), plain(words_[w]), n[words_[w]])):
                    c.append(v)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    found = sharded(rows, shards).drop("key", "blocks", "block").groupBy("side", "shard").applyInArrow(look_up, "word string, near string, near_n long")
    return found.repartition("word").distinct()                    # a pair can be found from either end


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): forms followed to the last. A form is FACTOR times as frequent, so chains are short; each round halves them."""
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = at.select(F.col("word").alias("w"), F.col("root").alias("r"))
        if at.join(next_, F.col("root") == F.col("w"), "left_semi").isEmpty():
            return at
        at = saved(at.join(next_, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR, divisor: int | None = DIVISOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs(doc_id, text) with min_length characters or more and min_count occurrences or more.

    form is the most frequent word one edit away (ties: the least by code point), if it is factor times as frequent as the word; else it and
    form_n are null. root is the last word that forms lead to, the word itself if none. A null text has no words, a null doc_id
    reads as an empty one. Rows that repeat count each. Extra columns are ignored; no rows give no words. min_length is 4 at least, so that halves are not empty.
    """
    if min_length < 4:
        raise ValueError("min_length is 4 at least")
    words = saved(word_counts(docs, min_length, min_count, divisor), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    met = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best.near", (-F.col("best.less")).alias("near_n"))
    leads = F.coalesce(F.col("near_n") >= factor * F.col("n"), F.lit(False))
    met = saved(met.select("word", F.when(leads, F.col("near")).alias("form"), "n", "n_near", F.when(leads, F.col("near_n")).alias("form_n")), "near")
    root = roots(met.where("form is not null"))
    return met.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
