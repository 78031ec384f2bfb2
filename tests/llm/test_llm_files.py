"""Archives, id files and packing: exact round trips with all edges."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.llm import packing, rans, tokens, warc
from lanewise.llm.queries import tokenizer_path

from .brute import ordered, plain

PAGES = "page_id long, url string, html string, sha string, file string, offset long"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i % 7}", "same body" if i % 3 == 0 else f"<p>body {i}\r\n\r\nWARC/1.1\r\n</p>") for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (None, "v", "é" * 9), (None, None, None), (5, "http://h/5", "x\ny"), (5, "http://h/5", "x\ny"), (102, "a\r\nb", "same body"),
             (103, "long", "z" * 300_000)]
    return rows, spark.createDataFrame([r + ("s", "f", 1) for r in rows], PAGES).repartition(4)


def _b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_roundtrip(pages):
    rows, df = pages
    got = warc.archive_report(df).collect()
    want = [(p, len((h or "").encode()), _b32(h)) for p, _, h in rows]
    assert ordered((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == ordered(want)
    top = defaultdict(list)
    for p, _, h in rows:
        top[_b32(h)].append(p)
    for digest, n in Counter(r.payload_digest for r in got).items():
        same = [r for r in got if r.payload_digest == digest]
        heads = [r for r in same if r.record_type == "response"]
        best = max((p for p in top[digest] if p is not None), default=None)
        assert len(heads) == 1 and heads[0].page_id == best and heads[0].refers_to is None
        assert all(r.refers_to == best for r in same if r.record_type == "revisit") and len(same) == n


def test_warc_selected_records(pages):
    rows, df = pages
    index = warc.write_archives(df)
    some = index.where("page_id % 10 = 4 and record_type = 'response'")
    got = warc.read_records(some).collect()
    want = {p: h for p, _, h in rows if p is not None and p % 10 == 4 and p % 3}
    assert {r.page_id: r.payload.decode() for r in got} == want and all(r.intact for r in got)
    first = index.orderBy("file", "offset").first()
    with open(first.file.removeprefix("file://"), "rb") as f:
        assert zlib.decompress(f.read()[first.offset:first.offset + first.length], 31).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_warc_empty(spark):
    assert warc.archive_report(spark.createDataFrame([], PAGES)).count() == 0


def _tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abD1 '.,;!?\n\té日́‍\x1c\x85 　<|>") | st.just(" "), max_size=40), max_size=30))
def test_pieces_encode_as_the_whole(texts):
    whole = [list(e.ids) for e in _tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in tokens.encode(pa.array(texts, pa.string()), tokenizer_path())] == whole


@pytest.mark.parametrize("most,run,chunk", [(1_500_000, 1 << 20, 1 << 16), (400, 300, 64), (70, 5000, 64)])
def test_small_memories_change_nothing(sf, edge_rows, most, run, chunk, monkeypatch):
    """Tables that overflow at every turn, runs that cut between any two texts, pieces beside every kind of white space."""
    import pyarrow.parquet as pq
    for name, v in (("GENERATION", most), ("RUN_BYTES", run), ("CHUNK", chunk)):
        monkeypatch.setattr(tokens, name, v)
    tokens._tokenizer.cache_clear()
    texts = [t for _, t, *_ in edge_rows] + pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()
    texts += [f"a{c}b é{c}é {c} x{c}" for c in map(chr, (*range(1, 33), 0x85, 0xa0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000))]
    texts += [None, "", "word, word word. word.. wörd, é. ,, 1, a", "", "  lead", "trail ", " ", "😀 😀"]
    whole = [np.array(e.ids, np.uint32) for e in _tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for part in (pa.array(texts, pa.string()), pa.array([None, "x y", *texts], pa.large_string()).slice(2)):
        got = list(tokens.encode(part, tokenizer_path()))
        assert len(got) == len(whole) and all(np.array_equal(a, b) for a, b in zip(got, whole))
    tokens._tokenizer.cache_clear()


def test_table_of_pieces():
    """Keys that share slots, wrap around and differ only in the check."""
    from lanewise.llm.pieces import Table
    rng = np.random.default_rng(1)
    keys = np.concatenate([np.arange(60, dtype=np.uint64) * np.uint64(256) + np.uint64(255), rng.integers(0, 1 << 63, 60).astype(np.uint64)])
    check = rng.integers(0, 1 << 31, 120).astype(np.uint32)
    t, held = Table(128), []
    for a in range(0, 120, 40):
        ids = [rng.integers(0, 9, int(n)).astype(np.uint32) for n in rng.integers(0, 30, 40)]
        t.add(keys[a:a + 40], check[a:a + 40], np.array([len(i) for i in ids]), np.concatenate(ids))
        held += ids
    rows = t.find(keys, check)
    assert rows.tolist() == list(range(120)) and all(np.array_equal(t.ids[t.start[r]:t.start[r + 1]], h) for r, h in zip(rows, held))
    assert (t.find(keys, check + np.uint32(1)) == -1).all() and t.find(np.array([3], np.uint64), np.array([0], np.uint32)).tolist() == [-1]


def _ids(edge_rows):
    texts = [t or "" for _, t, *_ in edge_rows]
    return [np.array([*e.ids, 2], "<u4") for e in _tokenizer().encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("size", [None, 500])
def test_rans_report(edge_docs, edge_rows, size, monkeypatch):
    if size:
        monkeypatch.setattr(rans, "FILE_IDS", size)
    rows = sorted(zip(edge_rows, _ids(edge_rows)), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] is not None, (x[0][1] or "").encode()))
    want, at = [], 0
    for r, ids in rows:
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert plain(rans.ids_report(edge_docs, tokenizer_path()), "doc_id", "start", "n_tokens", "ids_crc32") == ordered(want)


def test_rans_empty(no_docs):
    assert rans.ids_report(no_docs, tokenizer_path()).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 70_000), st.integers(1, 60_000), st.floats(1.05, 3), st.integers(0, 99))
def test_rans_file(n, kinds, skew, seed):
    ids = (np.random.default_rng(seed).zipf(skew, n) % kinds).astype(np.uint32)
    raw = rans.encode_file(ids, [None, 7], np.array([n // 3, n - n // 3]))
    file = rans.RansFile(raw)
    assert (np.concatenate([i for _, _, i in file.documents()]) == ids).all()
    a, b = n // 4, n - n // 5
    assert (file.ids(a, b) == ids[a:b]).all()
    if n:
        bad = bytearray(raw)
        bad[-1] ^= 1
        try:
            assert (rans.RansFile(bytes(bad)).blocks(0, len(file.crc)) == ids).all()
        except ValueError:
            pass


def _packing_holds(got, edge_rows, capacity):
    want = []
    for (d, *_), ids in zip(edge_rows, _ids(edge_rows)):
        at = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
        want += [(d, p, s, e - s, zlib.crc32(ids[s:e].tobytes())) for p, (s, e) in enumerate(zip(at, at[1:]))]
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ordered(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("items", [None, 4])
def test_packing(edge_docs, edge_rows, items, monkeypatch):
    if items:
        monkeypatch.setattr(packing, "PART_ITEMS", items)           # many parts, so that rounds exchange
    df = packing.pack(edge_docs, tokenizer_path(), 256)
    used = _packing_holds(df.collect(), edge_rows, 256)
    count, bound = packing.certificate(df, 256)
    assert count == used and bound <= used <= bound + 2


def test_packing_empty(no_docs):
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def _least_bins(items, capacity):
    """Exact bin count by trying every placement."""
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= capacity:
                put(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1:])
        put(i + 1, bins + [items[i]])

    put(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_bounds_are_below_the_optimum(items):
    items = sorted(items, reverse=True)
    bound = packing.lower_bound(np.bincount(np.array(items, np.int64), minlength=13), 12)
    bins, offsets, fills = packing.best_fit(np.array(items, np.int64), 12)
    assert bound <= (_least_bins(items, 12) if items else 0) <= len(fills)
    assert sum(fills) == sum(items) and all(f <= 12 for f in fills)
