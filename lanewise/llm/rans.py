"""Token ids in files of static range asymmetric numeral systems.

A file holds the ids of some documents in order. One frequency table, made from all ids of the file, is shared by
its blocks. A block is a fixed number of ids dealt to LANES interleaved coders; it ends in its own states, so
blocks decode independently and a whole file decodes as one array operation over all lanes of all blocks.
Each block has a checkpoint: byte offset, first id, CRC-32 of its ids; each document its place.

State x is in [2**16, 2**32); words of 16 bits move in and out; a frequency is out of 2**16.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .store import attempt_name, columns, filesystem, partitions, saved, shared_dir
from .workers import frugal

MAGIC, BLOCK, LANES, BITS, FILE_IDS = b"RANSIDS1", 1 << 14, 32, 16, 1 << 21
U, LOW = np.uint64, np.uint64(1 << 16)
_HEAD = struct.Struct("<8sQIIQQ")                                  # magic, ids, symbols, blocks, documents, words


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols present, their frequencies (at least 1 each, adding up to 2**16), and the place of each id among the symbols."""
    total = 1 << BITS
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if int(ids.max()) < 1 << 22:                                   # a vocabulary: count by table, without sorting
        count = np.bincount(ids)
        symbols = np.flatnonzero(count)
        count = count[symbols]
        place = np.zeros(int(symbols[-1]) + 1, np.int64)
        place[symbols] = np.arange(len(symbols))
        index = place[ids]
    else:
        symbols, index, count = np.unique(ids, return_inverse=True, return_counts=True)
    if len(symbols) > total:
        raise ValueError(f"a file can hold at most {total} different ids")
    freq = 1 + (count * (total - len(symbols)) // len(ids))
    freq[np.argmax(count)] += total - freq.sum()
    return symbols.astype(np.uint32), freq.astype(np.uint32), index


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The bytes of a file with these documents."""
    symbols, freq, index = frequencies(ids)
    cum = np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)[:-1]]).astype(U) if len(freq) else np.zeros(0, U)
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.int64)
    padded[:len(ids)] = index
    valid = np.arange(blocks * BLOCK) < len(ids)
    grid = padded.reshape(blocks, BLOCK // LANES, LANES).transpose(1, 0, 2).reshape(BLOCK // LANES, blocks * LANES)
    real = valid.reshape(blocks, BLOCK // LANES, LANES).transpose(1, 0, 2).reshape(BLOCK // LANES, blocks * LANES)
    f64, full = freq.astype(U), bool(valid.all())
    x = np.full(blocks * LANES, LOW, U)
    word = np.empty(grid.shape, np.uint16)
    moved = np.zeros(grid.shape, bool)
    for t in range(len(grid) - 1, -1, -1):
        f, c = f64[grid[t]], cum[grid[t]]
        out = x >= (f << U(16))
        if not full:
            out &= real[t]
        word[t], moved[t] = x.astype(np.uint16), out
        y = np.where(out, x >> U(16), x)
        q = y // f
        y = (q << U(BITS)) + (y - q * f) + c
        x = y if full else np.where(real[t], y, x)
    by_block = moved.reshape(BLOCK // LANES, blocks, LANES).transpose(1, 0, 2)
    words = word.reshape(BLOCK // LANES, blocks, LANES).transpose(1, 0, 2)[by_block]
    per = by_block.sum((1, 2), dtype=np.int64)
    little = ids.astype("<u4")
    crc = np.array([zlib.crc32(little[b * BLOCK:(b + 1) * BLOCK].tobytes()) for b in range(blocks)], "<u4")
    null = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [_HEAD.pack(MAGIC, len(ids), len(symbols), blocks, len(doc_ids), len(words)), symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(),
             names.tobytes(), null.tobytes(), np.asarray(lengths, "<i8").tobytes(), (np.cumsum(per) - per).astype("<i8").tobytes(), crc.tobytes(),
             x.astype("<u4").tobytes(), words.astype("<u2").tobytes()]
    return b"".join(parts)


class RansFile:
    """A file's table, documents and checkpoints; ids are decoded on request."""

    def __init__(self, raw: bytes):
        magic, self.n, symbols, blocks, docs, words = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(raw, kind, n, at)
            at += a.nbytes
            return a

        self.symbols, self.freq = take("<u4", symbols), take("<u4", symbols).astype(U)
        names, null, self.lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
        self.doc_ids = [None if z else d for d, z in zip(names.tolist(), null)]
        self.first_word, self.crc = take("<i8", blocks), take("<u4", blocks)
        self.states = take("<u4", blocks * LANES).reshape(blocks, LANES)
        self.words = take("<u2", words)
        self.cum = np.cumsum(self.freq, dtype=U) - self.freq
        self.slot = np.repeat(np.arange(symbols), self.freq.astype(np.int64))

    def blocks(self, first: int, end: int) -> np.ndarray:
        """The ids of blocks first..end-1; each block is held against its checksum."""
        n = end - first
        if n <= 0:
            return np.zeros(0, "<u4")
        total = min(self.n, end * BLOCK) - first * BLOCK
        x = self.states[first:end].astype(U).ravel()
        at = self.first_word[first:end].copy()
        index = np.empty((BLOCK // LANES, n * LANES), np.int64)
        whole = total == n * BLOCK
        real = (np.arange(n * BLOCK) < total).reshape(n, BLOCK // LANES, LANES).transpose(1, 0, 2).reshape(BLOCK // LANES, n * LANES)
        words = np.append(self.words, np.uint16(0)).astype(U)
        for t in range(len(index)):
            low = x & (LOW - U(1))
            s = self.slot[low.astype(np.int64)]
            index[t] = s
            y = self.freq[s] * (x >> U(BITS)) + low - self.cum[s]
            need = y < LOW
            if not whole:
                y = np.where(real[t], y, x)
                need &= real[t]
            grid = need.reshape(n, LANES)
            rank = np.cumsum(grid, 1)
            where = np.minimum((at[:, None] + rank - 1).ravel(), len(words) - 1)
            x = np.where(need, (y << U(16)) | words[where], y)
            at += rank[:, -1]
        ids = self.symbols[index.reshape(BLOCK // LANES, n, LANES).transpose(1, 0, 2).reshape(-1)[:total]]
        for b in range(n):
            if zlib.crc32(ids[b * BLOCK:(b + 1) * BLOCK].astype("<u4").tobytes()) != self.crc[first + b]:
                raise ValueError(f"block {first + b} is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the file, from the checkpoints around them."""
        first, end = start // BLOCK, -(-stop // BLOCK)
        return self.blocks(first, end)[start - first * BLOCK:stop - first * BLOCK]

    def documents(self):
        """(doc_id, first id in the file, ids) of every document, decoding once."""
        ids, at = self.blocks(0, len(self.crc)), 0
        for d, n in zip(self.doc_ids, self.lengths.tolist()):
            yield d, at, ids[at:at + n]
            at += n


def write_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the ids of docs(doc_id, text) and returns the table of files: file, part, seq, docs, ids.

    Documents go to files by ascending doc_id (null first, ties by text): part, then seq, is their order. A null text
    has the end id only. Rows that repeat are written each. No rows give no file. Extra columns are ignored.
    """
    root = shared_dir(docs.sparkSession, "rans")
    dealt = (columns(docs, "doc_id", "text").repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))

    @frugal("tokens")
    def write(batches):
        from pyspark import TaskContext
        part, seq, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal seq, held, names, size
            file = f"{root}/{attempt_name('ids', '.rans')}"
            fs, at = filesystem(file)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at, compression=None) as out:
                out.write(encode_file(np.concatenate(held), names, np.array([len(h) for h in held], np.int64)))
            row = pa.RecordBatch.from_arrays([pa.array([v]) for v in (file, part, seq, len(names), size)], ["file", "part", "seq", "docs", "ids"])
            seq, held, names, size = seq + 1, [], [], 0
            return row

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                for d, ids in zip(some.column("doc_id").to_pylist(), tokens.encode(some.column("text"), path)):
                    held.append(np.append(ids, np.uint32(end_id)))
                    names.append(d)
                    size += len(held[-1])
                    if size >= FILE_IDS:
                        yield flush()
        if held:
            yield flush()

    return saved(dealt.mapInArrow(write, "file string, part long, seq long, docs long, ids long"), "rans-files")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. A file is decoded by one task, all blocks at once."""
    rows = files.count()
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0))).repartition(max(1, rows), "file")   # one small row a file

    @frugal()
    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                fs, at = filesystem(file)
                with fs.open_input_stream(at, compression=None) as f:
                    held = RansFile(f.read())
                out = [(d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in held.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_report(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes all ids and reads them back; see write_ids for nulls, ties and repeated rows."""
    return read_ids(write_ids(docs, path, end_id))
