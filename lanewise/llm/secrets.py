"""Secret scan: keywords by an Aho-Corasick automaton, anchored expressions at their hits only, checksums last.

Base kinds are assign, access and hex; github and npm tokens are added where the checksum inside them
holds. Runs of hexadecimal digits have no keyword; they are found as long runs in the bytes of a batch.
Positions are code points of the whole text, ends exclusive.
"""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import columns
from .words import flat

KINDS = ("assign", "access", "hex", "github", "npm")
# The forms of the kinds.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",),
            "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_github long, n_npm long"


def checksum(body: bytes) -> bytes:
    """The six base-62 digits of the CRC-32 that such tokens end in."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r:r + 1] + out
    return out


def automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def keyword_spans(raw: bytes, auto) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of all kinds but hex. A kind's matches do not overlap; the leftmost goes first."""
    out, done = [], dict.fromkeys(KEYWORDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in auto.iter(raw.lower().decode("latin-1")))   # bytes.lower folds A-Z only
    for at, kind in hits:
        if at < done[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(raw, at)
            good = m and len(m[2]) >= MIN_VALUE
        elif kind == "access":
            m = ACCESS.match(raw, at)
            good = m and len(m[0]) >= MIN_ACCESS
        else:
            m = (GITHUB if kind == "github" else NPM).match(raw, at)
            good = m and checksum(m[1]) == m[2]
        if m:
            done[kind] = m.end()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def hex_spans(offsets: np.ndarray, data: np.ndarray) -> list[list[tuple[int, int]]]:
    """Byte spans of the maximal runs of MIN_HEX or more lower-case hexadecimal digits of each text."""
    found = [[] for _ in range(len(offsets) - 1)]
    if not len(found):
        return found
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = np.zeros(hi - lo + 2, np.int8)
    inside[1:-1] = _HEX[data[lo:hi]]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo
    keep = ends - starts >= MIN_HEX
    for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
        t = int(np.searchsorted(offsets, s, "right")) - 1
        while s < e:                                               # a run may go on into the next text
            stop = min(e, int(offsets[t + 1]))
            if stop - s >= MIN_HEX:
                found[t].append((s - int(offsets[t]), stop - int(offsets[t])))
            s, t = stop, t + 1
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_github, n_npm for every row of docs(doc_id, text, ...).

    base_sha256 is the digest of the base spans, kind:start:end, by start, then kind as listed, joined by commas;
    spans has all kinds, likewise. A null or empty text has no spans. Rows that repeat give a row each, null doc_ids
    are kept, extra columns are ignored and no rows give no rows.
    """
    def work(batches):
        auto = automaton()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                offsets, data = flat(some.column("text"))
                rows = []
                for i, (d, hexes) in enumerate(zip(some.column("doc_id").to_pylist(), hex_spans(offsets, data))):
                    raw = data[offsets[i]:offsets[i + 1]].tobytes()
                    spans = keyword_spans(raw, auto) + [("hex", s, e) for s, e in hexes]
                    if spans and not raw.isascii():
                        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                        spans = [(k, int(points[s]), int(points[e])) for k, s, e in spans]
                    spans.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                    count = {k: sum(s[0] == k for s in spans) for k in KINDS}
                    said = [f"{k}:{s}:{e}" for k, s, e in spans]
                    base = ",".join(x for x, s in zip(said, spans) if s[0] in KINDS[:3])
                    rows.append((d, count["assign"], count["access"], count["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(said),
                                 count["github"], count["npm"]))
                types = [pa.string() if f.endswith("string") else pa.int64() for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in SCHEMA.split(", ")])

    return columns(docs, "doc_id", "text").mapInArrow(work, SCHEMA)
