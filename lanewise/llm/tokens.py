"""Token ids of whole texts by a public tokenizer file, in Arrow batches.

A byte-level tokenizer of this family always starts a new piece at a single space between two
visible characters. Texts are cut there, each distinct piece is encoded once by the library, and its
ids are kept in a bounded memory of the worker (see `pieces`); the ids of a text are those of its pieces in order. A mark after
a letter starts a piece of its own too, so a new piece that ends so is put together from what stands before it.
"""

import functools
import os
from collections.abc import Iterator

import numpy as np

from .pieces import Hashes, Memory, taken
from .words import flat
from .workers import remembered

GENERATION, RUN_BYTES, CHUNK = 1_500_000, 1 << 20, 1 << 16
MARKS = b",.;:!?"
# White space beyond ASCII, in UTF-8.
_WIDE = [bytes(c, "utf-8") for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@functools.cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True                               # their strings in a text are ordinary text
    kind = type(tok.pre_tokenizer).__name__
    if kind != "ByteLevel":
        raise ValueError(f"a byte-level tokenizer is needed, not {kind}")
    size = tok.get_vocab_size()
    width = np.array([len(tok.id_to_token(i) or "") for i in range(size)], np.int64)   # one character stands for one byte
    marks = {m: np.array(tok.encode(chr(m), add_special_tokens=False).ids, np.uint32) for m in MARKS}
    return tok, width, Memory(GENERATION), marks


remembered("tokens", _tokenizer.cache_clear)


def _cuts(b: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of single spaces between two visible characters of one text."""
    white = _WHITE[b]
    for lead in sorted({w[0] for w in _WIDE}):
        begin = np.flatnonzero(b == lead)                          # texts are whole, so the bytes after it are there
        for w in _WIDE if len(begin) else ():
            at = begin if w[0] == lead else begin[:0]
            for k in range(1, len(w)):
                at = at[b[at + k] == w[k]]
            for k in range(len(w)):
                white[at + k] = True
    inner = np.zeros(len(b), bool)
    inner[1:-1] = (b[1:-1] == 32) & ~white[:-2] & ~white[2:]
    some = begins < ends
    inner[begins[some]] = inner[ends[some] - 1] = False
    return np.flatnonzero(inner)


def _together(tok, width: np.ndarray, words: list[str]) -> list[np.ndarray]:
    """Ids of many pieces at once: pieces that end in a visible character do not change each other."""
    ids = np.array(tok.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
    bytes_upto = np.cumsum([len(w.encode()) + 1 for w in words])
    ends = (np.searchsorted(np.cumsum(width[ids]), bytes_upto) + 1).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _encoded(tok, width: np.ndarray, words: list[str]) -> list[np.ndarray]:
    """Ids of pieces after a space, each encoded by the library."""
    out: list = [None] * len(words)
    plain = [i for i, w in enumerate(words) if w and not w[-1].isspace()]
    if plain:
        for i, v in zip(plain, _together(tok, width, [words[i] for i in plain])):
            out[i] = v
    apart = [i for i, v in enumerate(out) if v is None]
    for i, e in zip(apart, tok.encode_batch_fast([" " + words[i] for i in apart], add_special_tokens=False)):
        out[i] = np.array(e.ids, np.uint32)
    return out


def _new(path: str, b: np.ndarray, hashes: Hashes, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ids of pieces that the memory does not hold."""
    tok, width, memory, marks = _tokenizer(path)
    word = lambda s, e: b[s:e].tobytes().decode()
    marked = np.flatnonzero((ends - starts > 1) & _MARK[b[ends - 1]] & _LETTER[b[np.maximum(ends - 2, 0)]])
    bases = memory.known(*hashes.of(starts[marked], ends[marked] - 1))
    words = {word(starts[i], ends[i] - 1): None for i, v in zip(marked.tolist(), bases) if v is None}
    rest = np.ones(len(starts), bool)
    rest[marked] = False
    rest = np.flatnonzero(rest).tolist()
    mine = [word(starts[i], ends[i]) for i in rest]
    words.update(dict.fromkeys(mine))
    words = dict(zip(words, _encoded(tok, width, list(words))))
    out: list = [None] * len(starts)
    for i, w in zip(rest, mine):
        out[i] = words[w]
    for i, v in zip(marked.tolist(), bases):
        out[i] = np.concatenate([words[word(starts[i], ends[i] - 1)] if v is None else v, marks[int(b[ends[i] - 1])]])
    return out


def _ids(path: str, b: np.ndarray, hashes: Hashes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each piece, and all ids in order."""
    memory = _tokenizer(path)[2]
    key, check = hashes.of(starts, ends)
    row = memory.young.find(key, check)
    gaps = np.flatnonzero(row < 0)
    if len(gaps):
        fresh, first, place = np.unique(key[gaps], return_index=True, return_inverse=True)
        first = gaps[first]
        before = memory.young
        memory.make_room(len(fresh))
        if memory.young is not before:                             # all pieces of this chunk are new to the young table
            return _ids(path, b, hashes, starts, ends)
        old = memory.old.find(fresh, check[first]) if memory.old is not None else np.full(len(fresh), -1)
        new = np.flatnonzero(old < 0)
        made = _new(path, b, hashes, starts[first[new]], ends[first[new]])
        sizes = np.empty(len(fresh), np.int64)
        sizes[new] = [len(m) for m in made]
        was = np.flatnonzero(old >= 0)
        parts = [np.concatenate(made) if made else np.zeros(0, np.uint32)]
        if len(was):
            begin = memory.old.start[old[was]]
            sizes[was] = memory.old.start[old[was] + 1] - begin
            parts.append(taken(memory.old.ids, begin, sizes[was]))
        order = np.concatenate([new, was])
        row[gaps] = memory.young.n + np.argsort(order)[place]
        memory.young.add(fresh[order], check[first[order]], sizes[order], np.concatenate(parts))
    begin = memory.young.start[row]
    sizes = memory.young.start[row + 1] - begin
    return sizes, taken(memory.young.ids, begin, sizes)


def encode(texts, path: str) -> Iterator[np.ndarray]:
    """Ids (unsigned 32-bit) of each text of an Arrow column; a null text has none."""
    tok = _tokenizer(path)[0]
    offsets, data = flat(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, "right")) - 1))
        lo = int(offsets[i])
        b, begins, stops = data[lo:int(offsets[j])], offsets[i:j] - lo, offsets[i + 1:j + 1] - lo
        cuts = _cuts(b, begins, stops)
        text = np.searchsorted(begins, cuts, "right") - 1          # the last text that begins before, so never an empty one
        per = np.bincount(text, minlength=j - i)
        ends = np.append(cuts[1:], len(b))                         # a piece ends at the next cut, or with its text
        ends = np.minimum(ends, stops[text])
        firsts = stops.copy()
        has = np.flatnonzero(per)
        firsts[has] = cuts[(np.cumsum(per) - per)[has]]
        hashes, sizes, ids = Hashes(b), [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a in range(0, len(cuts), CHUNK):
            s, x = _ids(path, b, hashes, cuts[a:a + CHUNK] + 1, ends[a:a + CHUNK])
            sizes.append(s)
            ids.append(x)
        ids, upto = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        upto = upto[np.concatenate([[0], np.cumsum(per)])]
        heads = tok.encode_batch_fast([b[s:e].tobytes().decode() for s, e in zip(begins.tolist(), firsts.tolist())], add_special_tokens=False)
        for k, h in enumerate(heads):
            yield np.concatenate([np.array(h.ids, np.uint32), ids[upto[k]:upto[k + 1]]])
        i = j
