"""Words and shingles of whole Arrow text columns as 64-bit hashes, without a Python step per word.

A word is a run of bytes other than space and \\x09-\\x0D. Its hash is a polynomial over per-byte
constants modulo 2**64, mixed at the end; the inverse power makes it independent of the position.
Two different words share a hash with chance 2**-64.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .workers import remembered

U = np.uint64
_P, _CHUNK = 0x9E3779B97F4A7C15, 1 << 20
_STEPS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
          0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(_STEPS[0])
    h = (h ^ (h >> U(27))) * U(_STEPS[1])
    return h ^ (h >> U(31))


def _separators(alnum: bool) -> np.ndarray:
    b = np.arange(256)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    if not alnum:
        return space
    word = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    return ~word


def _byte_table(sep: np.ndarray) -> np.ndarray:
    fold = np.arange(256)
    fold[65:91] += 32                                             # A-Z only
    table = mix((np.arange(1, 257, dtype=np.uint64)) * U(_P)) | U(1)
    return np.where(sep, U(0), table[fold])


SPACES, MARKS = _separators(False), _separators(True)
_TABLE = {False: (SPACES, _byte_table(SPACES)), True: (MARKS, _byte_table(MARKS))}
_powers: list[np.ndarray] = []
remembered("words", _powers.clear)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK)
        inverse = U(pow(_P, -1, 1 << 64))
        _powers[:] = [np.concatenate([[U(1)], np.cumprod(np.full(size, k, np.uint64))]) for k in (U(_P), inverse)]
    return _powers[0], _powers[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def word_hashes(offsets: np.ndarray, data: np.ndarray, alnum: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, text number of each word, hash of each word) for runs of texts of about 1 MB.

    alnum: any ASCII mark separates words too. A-Z fold to a-z.
    """
    sep, table = _TABLE[alnum]
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        b = data[lo:hi]
        begins = offsets[i:j] - lo
        if len(b):
            inside = ~sep[b]
            first = np.empty(len(b), bool)
            first[0], first[1:] = True, ~inside[:-1]
            first[begins[begins < len(b)]] = True
            starts = np.flatnonzero(inside & first)
        else:
            starts = np.zeros(0, np.int64)
        if len(starts):
            power, inverse = _power(len(b))
            h = np.add.reduceat(table[b] * power[:len(b)], starts) * inverse[starts]
            yield i, j, i + np.searchsorted(begins, starts, "right") - 1, mix(h)
        else:
            yield i, j, starts, np.zeros(0, np.uint64)
        i = j


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, in order; shorter texts have one."""
    steps = np.array([_STEPS[m % len(_STEPS)] + 2 * (m // len(_STEPS)) for m in range(k)], np.uint64)
    for i, j, text, h in word_hashes(offsets, data):
        per = np.bincount(text - i, minlength=j - i)
        ends = np.cumsum(per)
        acc = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for m in range(k):
            acc += h[m:m + len(acc)] * steps[m]
        acc = mix(acc + U(k))
        for t in range(j - i):
            e, c = ends[t], per[t]
            if c >= k:
                s = np.sort(acc[e - c:e - k + 1])
                if len(s) > 1:
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
                yield s
            elif c:
                yield mix(np.array([(h[e - c:e] * steps[:c]).sum(dtype=np.uint64) + U(c)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
