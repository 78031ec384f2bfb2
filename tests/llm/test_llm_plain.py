"""SpotSigs report and toxicity model against plain versions; pipeline stages with clashing columns and against their operators."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import boilerplate, mixture, spotsigs, toxicity
from lanewise.llm.queries import tokenizer_path
from lanewise.llm.words import U, mix

from .brute import WORD, ordered, plain


def _chains(text, chain=2):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            after = [x for x in words[i + 1:] if x not in spotsigs.ANCHORS][:chain]
            if len(after) == chain:
                out.add(tuple(after))
    return frozenset(out) or frozenset([("whole", text)])


def _alike(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("table", ["edges", "sf"])
def test_spotsigs_report(spark, sf, edge_docs, table):
    docs = edge_docs if table == "edges" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, prints = [], {}
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, e, n = _chains(t), _chains(edited), _chains(after)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(_alike(a, e), 12), round(_alike(a, n), 12)))
        prints.setdefault(hashlib.sha256(edited.encode()).hexdigest(), (a, e))
    got = spotsigs.edited_report(docs).cache()
    assert plain(got.withColumns({c: F.round(c, 12) for c in ("near_edited", "near_next")}), "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next") == ordered(want)
    sets = {}
    for r in got.collect():
        a, e = prints[r.edited_sha256]
        cut = lambda p: {p[i:i + 16] for i in range(0, len(p), 16)}
        x, y = cut(r.fingerprint), cut(r.edited_fingerprint)
        assert len(x) == len(a) and len(y) == len(e) and abs(len(x & y) / len(x | y) - r.near_edited) < 1e-12   # likeness can be told from prints
        assert sets.setdefault(r.edited_fingerprint, e) == e       # equal prints, equal sets


def _words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def _hash(word):
    """The word hash from its definition: a polynomial over byte constants modulo 2**64."""
    m, p = (1 << 64) - 1, 0x9E3779B97F4A7C15
    const = lambda b: int(mix(np.array([((b + 1) * p) & m], U))[0]) | 1
    return int(mix(np.array([sum(const(b) * pow(p, k, 1 << 64) for k, b in enumerate(word)) & m], U))[0])


def _grams(text):
    h = np.array([_hash(w) for w in _words(text)], U)
    far = lambda k, gap: [int(mix(np.array([h[i] * U(k) + h[i + gap]], U))[0]) for i in range(len(h) - gap)]
    return sorted({v >> (64 - toxicity.BITS) for v in [*map(int, h), *far(3, 1), *far(5, 2)]})


@pytest.mark.filterwarnings("ignore:overflow")
def test_features_from_their_definition():
    texts = ["You IDIOT, you idiot!", "one", "", None, "é-è a_b c9", "a b c d e"]
    assert [f.tolist() for f in toxicity.features(pa.array(texts))] == [_grams(t) for t in texts]


def _plain_ftrl(rows, labels, epochs, seed):
    """One coordinate at a time, with dictionaries."""
    z, n, zb, nb, bias = Counter(), Counter(), 0.0, 0.0, 0.0
    a, b, l1 = toxicity.ALPHA, toxicity.BETA, toxicity.L1
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) * a / (b + math.sqrt(n[i]))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)).tolist():
            w = {i: weight(i) for i in rows[r]}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()) + bias)))) - labels[r]
            for i, x in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * x
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / a * bias
            nb += g * g
            bias = -zb * a / (b + math.sqrt(nb))
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_from_its_definition():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(300)]
    labels = np.array([int(3 in r or 7 in r) for r in map(set, (x.tolist() for x in rows))])
    w, bias = toxicity.ftrl(rows, labels)
    want, plain_bias = _plain_ftrl([r.tolist() for r in rows], labels.tolist(), toxicity.EPOCHS, 0)
    assert {i: round(float(w[i]), 9) for i in np.flatnonzero(w).tolist()} == {i: round(v, 9) for i, v in want.items()} and abs(bias - plain_bias) < 1e-9
    assert w[3] > 0 and w[7] > 0
    best = toxicity.best_margin(np.array([3.0, 1.0, 2.0, -1.0, 0.5]), np.array([1, 0, 1, 0, 1]))
    assert best == 1.5                                             # two of three found, none wrong, as good as any cut


CLASHES = ["__kept", "__host", "__drop", "__w", "__k1", "__whole", "__pieces", "__text", "__score", "__cls", "row", "r", "doc"]


def test_clashing_columns_stay(spark, edge_docs, sf):
    docs = edge_docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in CLASHES])
    carried = lambda df: all(r[c] == f"{c}:{r.doc_id}" for r in df.collect() for c in CLASHES)
    assert carried(boilerplate.drop_boilerplate(docs, "source"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and carried(out) and out.count(), name
    assert mixture.mixed_documents(docs).columns == docs.columns


def test_toxic_stage_is_the_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0").select("doc_id")
    got = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert plain(got, *docs.columns) == plain(docs.join(good, "doc_id"), *docs.columns) and 0 < got.count() < docs.count()


def test_run_keeps_all_that_its_stages_keep(spark, sf):
    """Every word that stage 4 takes is packed in stage 5: the same documents, as often, with all their ids."""
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == want and sum(len(WORD.findall(r.text)) for r in docs.collect()) > 0
