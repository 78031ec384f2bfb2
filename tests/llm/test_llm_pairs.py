"""Near duplicates, fingerprints and line dedup against plain versions, with all edges."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanewise.llm import boilerplate, components, jaccard, spotsigs

from .brute import near_groups, ordered, plain


def test_near_duplicates_edges(edge_docs, edge_rows):
    got = plain(jaccard.near_duplicates(edge_docs), "doc_id", "n_shingles", "component_id")
    assert got == ordered(near_groups([r[:2] for r in edge_rows]))


def test_near_duplicates_empty(no_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = near_groups([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert plain(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == ordered(want)


def test_many_near_copies(spark, monkeypatch):
    """A chain of edits around a common text: components need more than one pivot, hot shingles come last."""
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(120):
        w = list(base)
        for j in range(d % 6):
            w[(d * 7 + j * 23) % 150] = f"e{d}x{j}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join(base[:20] + [f"own{d}x{i}" for i in range(100)])) for d in range(60)]
    rows += [(2000 + d, " ".join(f"c{i}" for i in range(d * 3, d * 3 + 100))) for d in range(30)]      # each overlaps the next
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == ordered(near_groups(rows))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 100), (7, 7)]
    got = plain(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "comp")
    assert got == [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 104)]


def _line_dedup(rows, ratio, least):
    lines = lambda t: (t or "").split("\n") if t is not None else []
    pages, on = Counter(r[3] for r in rows), Counter()
    for r in rows:
        on.update((r[3], x) for x in {x.strip(" \t\r") for x in lines(r[1])} - {""})
    bad = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for d, t, _, s, _ in rows:
        kept = [x for x in lines(t) if (s, x.strip(" \t\r")) not in bad]
        out.append((d, None if t is None else "\n".join(kept), len(lines(t)), len(lines(t)) - len(kept)))
    return out


@pytest.mark.parametrize("limit", [None, -1])
def test_line_dedup(spark, edge_rows, limit, monkeypatch):
    if limit is not None:
        monkeypatch.setattr(boilerplate, "BROADCAST_BYTES", limit)         # the way beyond the broadcast bound
    rows = edge_rows + [(100 + i, f"  head line \nbody {i}\n\nfoot\t", "en", (None, "s0")[i % 2], 1) for i in range(24)]
    docs = spark.createDataFrame([r + (1,) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines int")
    got = boilerplate.drop_boilerplate(docs, "source", 0.2, 5)
    assert plain(got, "doc_id", "text", "n_lines", "n_dropped") == ordered(_line_dedup(rows, 0.2, 5))
    assert got.where("text like '%head line%'").count() == 0


def test_line_dedup_empty(no_docs):
    assert boilerplate.drop_boilerplate(no_docs, "source").count() == 0


def _edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        out.append((r[0], len(t), hashlib.sha256((t[:len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return out


def test_spotsigs_edges(edge_docs, edge_rows):
    report = spotsigs.edited_report(edge_docs).cache()
    assert plain(report, "doc_id", "n_chars", "edited_sha256") == ordered(_edited(edge_rows))
    rows = report.join(edge_docs.select(F.col("doc_id").alias("d"), "text"), F.col("d") == F.col("doc_id")).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    one = {r.doc_id: r.fingerprint for r in rows if r.doc_id in (5, 6)}
    assert one[5] == one[6] and all(len(v) == 1 for k, v in by_text.items() if k[0] == 1)
    assert next(r.near_next for r in rows if r.doc_id == 5) == 1.0


def test_spotsigs_one_row_and_none(spark, no_docs):
    assert spotsigs.edited_report(no_docs).count() == 0
    r = spotsigs.edited_report(spark.createDataFrame([(1, "the cat sat on the mat of a dog")], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.n_chars == 31


def test_signatures_are_chains_after_anchors(spark):
    df = spark.createDataFrame([("At a rally to kick off a weeklong campaign for the south",)], "text string")
    got = set(spotsigs.with_signatures(df, "text", "s").first().s)
    chains = ["rally kick ", "kick off ", "weeklong campaign "]
    assert got == {spark.sql(f"select xxhash64('{c}')").first()[0] for c in chains}


def test_similar_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {}
    for r in spotsigs.fingerprint_classes(docs).collect():
        sets.setdefault(frozenset(r.sigs), []).append(r.doc_id)
    reps = sorted((min(d), s) for s, d in sets.items())
    want = {(a, b): len(x & y) / len(x | y) for i, (b, y) in enumerate(reps) for a, x in reps[:i] if len(x & y) >= 0.5 * len(x | y)}
    got = {(r.a, r.b): r.likeness for r in spotsigs.similar_fingerprints(docs, 0.5).collect()}
    assert got == pytest.approx(want) and want
