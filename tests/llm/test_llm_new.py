"""Quality rules, importance resampling and spelling variants against plain versions, with all edges."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.llm import quality, resample, spelling

from .brute import WORD, ordered, plain

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIXTURES = ["edges", "sf"]


@pytest.fixture
def docs(request, spark, sf, edge_docs):
    return edge_docs if request.param == "edges" else spark.read.parquet(f"{sf}/documents.parquet")


def _measures(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(lines)


def _quality(rows):
    """[(doc_id, counts, base_failed, kept)] of (doc_id, text, lang, source): thresholds from sorted values of each group."""
    out, groups = [], defaultdict(list)
    log = lambda a, b: math.floor(100.0 * math.log(1.0 + 100.0 * a / b))
    for d, t, lang, source in rows:
        n, chars, symbols, dup, again, lines = _measures(t)
        failed = n < 50 or 100 * again > 50 * n
        values = None if failed else [log(chars, n), log(symbols, n), log(again, n), log(dup, lines)]
        out.append((d, n, chars, symbols, dup, again, failed, values, lang, source))
        if not failed:
            for key in (("g", lang, source), ("l", lang), ("a",)):
                groups[key].append(values)
    kept = []
    for *row, values, lang, source in out:
        ok = values is not None
        if ok:
            group = next((groups[k] for k in (("g", lang, source), ("l", lang)) if len(groups[k]) >= quality.MIN_GROUP), groups[("a",)])
            for m, v in enumerate(values):
                s = sorted(g[m] for g in group)
                q1, q3 = s[math.ceil(len(s) / 4) - 1], s[math.ceil(3 * len(s) / 4) - 1]
                reach = quality.FENCE * max(quality.MIN_SPREAD, q3 - q1)
                ok &= v <= q3 + reach and (m > 0 or v >= q1 - reach)
        kept.append((*row, ok))
    return kept


@pytest.mark.parametrize("docs", FIXTURES, indirect=True)
@pytest.mark.parametrize("group,bytes_", [(500, 1 << 20), (40, -1), (2, 1 << 20)])
def test_quality(spark, docs, group, bytes_, monkeypatch):
    monkeypatch.setattr(quality, "MIN_GROUP", group)
    monkeypatch.setattr(quality, "BROADCAST_BYTES", bytes_)
    want = ordered(_quality([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]))
    assert plain(quality.quality(docs), "doc_id", *quality.COUNTS, "base_failed", "kept") == want
    assert {r[-1] for r in want} == {True, False}


def test_quality_windows_and_thresholds(spark):
    words = [" ".join(f"w{(7 * i * i + d) % 997}x" for i in range(60)) for d in range(200)]
    rows = [(d, words[d % 200] + (" #### $$$$" * 20 if d == 7 else "") + "\nsame line here" * (30 if d == 9 else 0), "en", "s") for d in range(600)]
    rows += [(1000, "a b c a b c " + " ".join(f"u{i}" for i in range(60)), "en", "s"), (1001, "a a a a", "en", None), (1002, "a a a a " * 20, "en", None)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1000].n_repeat_words == 6 and got[1001].n_repeat_words == 4 and got[1002].n_repeat_words == 80 and got[1002].base_failed
    assert "symbols" in got[7].failed
    assert not got[9].kept and sum(r.kept for r in got.values()) == 599


def test_sketches_merge(spark, sf):
    rows = quality.measured(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    parts = [quality.sketches(rows.where(f"doc_id % 3 = {k}")) for k in range(3)]
    merged = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert plain(merged, "lang", "source", "measure", "bucket", "n") == plain(quality.sketches(rows), "lang", "source", "measure", "bucket", "n")


def test_quality_empty(no_docs):
    assert quality.quality(no_docs).count() == 0


_TOKEN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _grams(text, most):
    w = _TOKEN.findall((text or "").translate(_LOW))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def _resample(rows, target, share=10, least=20, most=1, buckets=10000, seed=2024):
    code = lambda x: zlib.crc32(x.encode()) % buckets
    grams = [_grams(t, most) for _, t in rows]
    s, t = Counter(code(x) for _, g in grams for x in g), Counter(code(x) for y in target for x in _grams(y, most)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for (d, _), (n, g) in zip(rows, grams):
        weight = sum(gain(code(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {i: k + 1 for k, i in enumerate(map(id, fit[:share * len(fit) // 100]))}
    return [(*r[:4], drawn.get(id(r))) for r in out]


@pytest.mark.parametrize("docs", FIXTURES, indirect=True)
@pytest.mark.parametrize("share,most,segment", [(10, 1, 1 << 18), (100, 1, 7), (35, 3, 20)])
def test_resample(spark, sf, docs, share, most, segment, monkeypatch):
    monkeypatch.setattr(resample, "SEGMENT_ROWS", segment)
    target = spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("score", F.lit(1))
    rows, texts = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    want = _resample(rows, texts, share, most=most)
    got = resample.resample(docs, target, share, ngrams=most)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if docs.columns[0] == "doc_id" and len(docs.columns) > 5:       # edges: equal rows may exchange ranks
        assert plain(got, *columns[:4]) == ordered(r[:4] for r in want) and plain(got, "rank") == ordered((r[4],) for r in want)
        key = lambda r: (-r[3], r[0] is None, r[0] or 0)
        drawn = sorted((tuple(r) for r in got.where("rank is not null").select(columns).collect()), key=lambda r: r[4])
        assert [key(r) for r in drawn] == sorted(map(key, drawn))
    else:
        assert plain(got, *columns) == ordered(want)


def test_resample_splits_equal_keys(spark, monkeypatch):
    """Rows that are all alike still go to many segments of at most two shares, and get ranks 1 to n."""
    monkeypatch.setattr(resample, "SEGMENT_ROWS", 50)
    rows = spark.range(2000).select(F.lit(5).cast("long").alias("score"), F.when(F.col("id") % 3 > 0, 7).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.col("id").alias("weight"))
    got = resample.ranked(rows).collect()
    assert sorted(r.rank for r in got) == list(range(1, 2001)) and {r.weight for r in got} == set(range(2000))
    assert max(r.rank for r in got if r.doc_id == 7) < min(r.rank for r in got if r.doc_id is None)
    some = resample.ranked(rows, 100).where("rank is not null")
    assert sorted(r.rank for r in some.collect()) == list(range(1, 101))
    runs = rows.repartition(40).sortWithinPartitions("doc_id").withColumn("m", F.monotonically_increasing_id()).select("score", "doc_id", F.shiftright("m", 33).alias("run"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")).cache()
    cuts = resample._splitters(runs, 40)
    keys = resample._keys(runs.toArrow().combine_chunks().to_batches()[0])
    assert len(cuts[0]) == 39 and np.bincount(resample._segments(keys, cuts)).max() <= 2 * 2000 / 40 + 1


def test_crcs_of_long_and_short_words():
    text = " ".join(["a", "é" * 30, "x" * 200, "ab1", "ü"])
    _, _, words, n, hashed, _ = next(resample.features(pa.array([text, None, "", "zz"]), 1, 1 << 32))
    assert words.tolist() == [5, 0, 0, 1] and hashed.tolist() == [zlib.crc32(w.encode()) for w in [*text.split(), "zz"]]


def test_resample_empty(spark, no_docs, edge_docs):
    assert resample.resample(no_docs, edge_docs).count() == 0
    assert resample.resample(edge_docs, no_docs).count() == edge_docs.count()


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows, length=7, least=2, factor=10, divisor=31):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(_LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if divisor and h % divisor == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    near, form = {}, {}
    for w in n:
        near[w] = [x for x in n if _near(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return [(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n]


SPELLED = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("docs", FIXTURES, indirect=True)
@pytest.mark.parametrize("shard,group", [(1 << 15, 1 << 15), (64, 3)])
def test_spelling(docs, shard, group, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "GROUP_WORDS", group)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = plain(spelling.spelling_variants(docs), *SPELLED)
    assert got == ordered(_variants(rows))
    assert len(got) > 10 or len(docs.columns) > 5


def test_spelling_chains_and_runs_of_one_letter(spark):
    words = {"aaaaaaa": 2000, "aaaaaaaa": 150, "aaaaaaaaa": 12, "aaaaaaaab": 2, "baaaaaaa": 2, "aaaabaaa": 3, "aaaacaaa": 3, "ÀÉ×÷ÿßaa": 40, "ÀÉ×÷ÿßab": 4, "abcdefghij": 50,
             "abcdefghi": 5, "bcdefghij": 5, "abcdfghij": 5, "abcdeefghij": 5, "xabcdefghij": 4, "abcdefghijx": 4, "abcdefghix": 2, "xbcdefghij": 2, "abcd": 90}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())] + [(99, "ABCDEFGHIJ 1abcdefghij2"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (7, 4):
        got = plain(spelling.spelling_variants(docs, length, divisor=None), *SPELLED)
        assert got == ordered(_variants(rows, length, divisor=None))
    assert ("aaaaaaaab", "aaaaaaaa", "aaaaaaa", 2) in {r[:4] for r in got}


def test_search_finds_every_edit():
    """All words within one edit of random words over three letters, by the two searches together."""
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(4, 9))) for _ in range(900)})
    found = set()
    for side in (0, 1):
        text = sorted((w if side == 0 else w[::-1]).encode("latin-1") for w in words)
        index = spelling.Index(text)
        half = np.array([len(w) - len(w) // 2 if side == 0 else len(w) // 2 for w in text])
        word = lambda i: (text[i] if side == 0 else text[i][::-1]).decode("latin-1")
        for q, w in zip(*(x.tolist() for x in spelling.search(index, text, half))):
            assert _near(word(q), word(w))
            found.add((word(q), word(w)))
    assert found == {(a, b) for a in words for b in words if _near(a, b)}


def test_spelling_empty(spark, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(no_docs, 3)
