"""Near-duplicate documents by a grouped prefix join over word shingles.

1. Shingle sets are made per block of documents in Arrow batches. Shingles found in a large share of
   the documents (a list of bounded length) come last in the global order; all others are counted
   exactly, each hash range of the shingles by its own task, and ordered by (frequency, hash).
2. Documents with equal sets form one class. A class whose rare shingles alone fill its prefix
   cannot link with anything and drops out of the join, not out of the result.
3. Classes with identical prefixes and size form one group. Groups meet on prefix shingles; size and
   position filters prune pairs of groups; what remains is expanded to members and verified on whole sets.
4. A star round compares each group with one pivot per shingle; further ones, where components still meet
   under a shingle, with pivots of random deals, as long as they find links. Then all pairs whose members are still in different
   components are enumerated, so thousands of near copies cost a linear number of pairs and no link
   that could change a component is left out.
"""

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import columns, partitions, saved
from .workers import frugal, give_back
from .words import U, flat, mix, shingle_sets

BLOCK_SHINGLES, RANGE_SHINGLES, HOT_SHARE, HOT_FLOOR, HOT_MOST, DEALS = 1 << 19, 1 << 21, 64, 8, 1 << 16, 1
BROADCAST_BYTES = 32 << 20


def prefix_length(n, percent: int):
    """Shingles of the ordered set that must meet those of any linked set."""
    return n - (percent * n + 99) // 100 + 1


def _blocks(batches, k: int):
    """(ids, sets) of about half a million shingles each."""
    ids, sets, size = [], [], 0
    for batch in batches:
        offsets, data = flat(batch.column("text"))
        for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(offsets, data, k)):
            ids.append(i)
            sets.append(s)
            size += len(s)
            if size >= BLOCK_SHINGLES or len(ids) == 65535:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _digests(tok: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit digest of each set, from the concatenation of all: two sums of its hashes, each mixed another way."""
    ends, out = np.cumsum(sizes), []
    for salt in (1, 2):
        total = np.concatenate([[U(0)], np.cumsum(mix(tok ^ mix(np.array([salt], U))), dtype=U)])
        out.append(total[ends] - total[ends - sizes])
    return np.stack(out, 1)


def _hot_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Shingles in more than 1/32 of the documents (and perhaps some of over 1/64), commonest first.

    A shingle of over 1/32 of all documents has at least 1/64 of them inside blocks in which it reaches
    1/64. There are at most 64 times as many such shingles as a document has on average; the list keeps
    HOT_MOST at most, which only changes the order of shingles, never a result. Also the number of all shingles of all sets.
    """
    @frugal("words")
    def count(batches):
        for ids, sets in _blocks(batches, k):
            tok, n = np.unique(np.concatenate(sets), return_counts=True)
            keep = n >= max(HOT_FLOOR, len(ids) // HOT_SHARE)
            none = np.zeros(keep.sum(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(tok[keep], U(0)).view(np.int64)), pa.array(np.append(n[keep], 0)),
                                              pa.array(np.append(none, len(ids))), pa.array(np.append(none, int(n.sum())))], ["tok", "n", "docs", "size"])

    sums = saved(docs.mapInArrow(count, "tok long, n long, docs long, size long").groupBy("tok").agg(*[F.sum(c).alias(c) for c in ("n", "docs", "size")]), "hot")
    total, size = (x or 0 for x in sums.agg(F.sum("docs"), F.sum("size")).first())
    least = max(HOT_FLOOR, total // HOT_SHARE)
    rows = sums.where(F.col("n") >= least).orderBy(F.desc("n"), "tok").limit(HOT_MOST).select("tok").toPandas()
    return rows.tok.to_numpy(np.int64).view(U), size


def _shuffled_bytes(sorted_tokens: np.ndarray) -> bytes:
    """Deltas as byte planes; the upper planes are nearly all zero, which the shuffle's codec folds."""
    return np.diff(sorted_tokens, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _tokens(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(U).ravel(), dtype=U)


def ordered_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document: its set's size and digest `cls`; if a link is possible, its shared shingles in global order.

    Columns doc_id, n, cls, lone (shingles that no other document has), tokens, prefix.
    """
    hot, size = _hot_shingles(docs, k)
    hot_sorted, parts = np.sort(hot), max(2 * partitions(docs.sparkSession), -(-size // RANGE_SHINGLES))   # a hash range is one task's, in memory
    rank = {int(t): r for r, t in enumerate(hot[::-1])}

    @frugal("words")
    def cut(batches):
        for ids, sets in _blocks(batches, k):
            sizes = np.array([len(s) for s in sets], np.int64)
            tok = np.concatenate(sets)
            doc = np.repeat(np.arange(len(ids)), sizes)
            digests = _digests(tok, sizes)
            common = np.isin(tok, hot_sorted)
            block = hashlib.blake2b(str(ids).encode() + digests.tobytes(), digest_size=16).digest()
            rows = [(-1 - int(block[0]) % parts, pickle.dumps((ids, sizes, digests, tok[common], doc[common].astype(np.uint16))))]
            tok, doc = tok[~common], doc[~common].astype(np.uint16)
            order = np.argsort(tok, kind="stable")
            tok, doc = tok[order], doc[order]
            part = ((tok >> U(40)) * U(parts)) >> U(24)
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=U))
            rows += [(p, pickle.dumps((_shuffled_bytes(tok[a:b]), doc[a:b].tobytes()))) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            for at in range(0, len(rows), 256):
                some = rows[at:at + 256]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([block] * len(some), pa.binary()),
                                                  pa.array([r[1] for r in some], pa.binary())], ["part", "block", "body"])

    @frugal()
    def count(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return table
        read = [pickle.loads(x) for x in table.column("body").to_pylist()]
        toks = [_tokens(t) for t, _ in read]
        tok = np.concatenate(toks)
        order = np.argsort(tok, kind="stable")
        change = np.flatnonzero(np.concatenate([[True], np.diff(tok[order]) != 0, [True]]))
        df = np.empty(len(tok), np.int64)
        df[order] = np.repeat(np.diff(change), np.diff(change))
        body, at = [], 0
        for t, (_, d) in zip(toks, read):
            n = df[at:at + len(t)]
            at += len(t)
            keep = n > 1
            body.append(pickle.dumps((t[keep], np.frombuffer(d, np.uint16)[keep], n[keep])) if keep.any() else None)
        out = table.set_column(2, "body", pa.array(body, pa.binary()))
        return out.filter(out.column("body").is_valid())

    @frugal()
    def assemble(table: pa.Table) -> pa.Table:
        heads, shared = [], {}                                        # equal blocks have equal parts
        for part, raw in zip(table.column("part").to_pylist(), table.column("body").to_pylist()):
            if part < 0:
                heads.append(raw)
            else:
                shared[part] = raw
        ids, sizes, digests, hot_tok, hot_doc = pickle.loads(heads[0])
        last = np.array([(1 << 48) + rank[int(t)] for t in hot_tok], np.int64)
        tok, doc, n = (np.concatenate(x) for x in zip((hot_tok, hot_doc, last), *map(pickle.loads, shared.values())))
        order = np.lexsort((tok, n, doc))
        tok, doc = tok[order].view(np.int64), doc[order]
        per = np.bincount(doc, minlength=len(ids))
        lone = sizes - per
        need = prefix_length(sizes, percent) - lone
        live = (need > 0) & (sizes > 0)
        ends = np.cumsum(per)
        tokens = [tok[e - c:e] if ok else tok[:0] for e, c, ok in zip(ends, per, live)]
        cols = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(lone),
                pa.array(tokens, pa.list_(pa.int64())), pa.array([t[:max(0, w)] for t, w in zip(tokens, need)], pa.list_(pa.int64()))]
        return pa.concat_tables([pa.Table.from_arrays(cols, ["doc_id", "n", "cls", "lone", "tokens", "prefix"])] * len(heads))

    return (docs.mapInArrow(cut, "part int, block binary, body binary")
            .groupBy("part").applyInArrow(count, "part int, block binary, body binary")
            .groupBy("block").applyInArrow(assemble, "doc_id long, n long, cls binary, lone long, tokens array<long>, prefix array<long>"))


def _bound(a: str, b: str, percent: int):
    """Size filter and position filter of two groups that share the shingle at positions a.pos and b.pos."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    best = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) + 1
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & (best * (100 + percent) >= percent * (na + nb)))


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets reach the threshold. Only shared shingles can intersect.

    Only the sets of classes that a pair names are shuffled.
    """
    pairs = saved(pairs, "pairs")
    ends = saved(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "ends")
    named = F.broadcast(ends) if ends.count() * 32 <= BROADCAST_BYTES else ends
    sets = classes.join(named, "cls", "left_semi").select("cls", "n", "tokens")
    both = (pairs.join(sets.toDF("a", "na", "ta"), "a").join(sets.toDF("b", "nb", "tb"), "b")
            .select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("inter")))
    return both.where(F.expr(f"100L * inter >= {percent}L * (na + nb - inter)")).select("a", "b")


def _same(a: str, b: str):
    """All members of both groups are in one component."""
    lo, hi = F.col(f"{a}.lo"), F.col(f"{a}.hi")
    return (lo == hi) & (hi == F.col(f"{b}.lo")) & (F.col(f"{b}.lo") == F.col(f"{b}.hi"))


def _stars(index: DataFrame, percent: int, salts: list[int], members: int | None) -> DataFrame:
    """Pairs (a, b) of group heads: under every shingle and size band, each group with one pivot.

    The pivot is the group with the smallest share of shingles of its own, which of near copies is the nearest to all.
    members: about so many groups share a pivot, dealt anew for each shingle and salt; None: all do.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.col("salt") / 2)
    keyed = index.withColumn("salt", F.explode(F.array(*map(F.lit, salts)))).withColumn("band", band)
    deal = F.lit(0)
    if members:
        size = keyed.groupBy("tok", "band", "salt").agg(F.count("*").alias("c")).where("c > 1")
        keyed = keyed.join(size, ["tok", "band", "salt"])
        deal = F.pmod(F.xxhash64("grp", "tok", "salt"), F.ceil(F.col("c") / members))
    keyed = keyed.withColumn("deal", deal)
    keys = ["tok", "band", "salt", "deal"]
    pivot = (keyed.groupBy(*keys).agg(F.min(F.struct("own", F.xxhash64("grp", "salt").alias("h"), "grp", "head", "n", "pos", "lo", "hi")).alias("p"), F.count("*").alias("k"))
             .where("k > 1").select(*keys, "p.*"))
    met = keyed.alias("x").join(pivot.alias("y"), keys).where((F.col("x.grp") != F.col("y.grp")) & ~_same("x", "y")).where(_bound("x", "y", percent))
    return met.select(F.least("x.head", "y.head").alias("a"), F.greatest("x.head", "y.head").alias("b")).distinct()


def _placed(index: DataFrame, classes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, grp, comp) under the links found, and the index rows of shingles whose groups are not yet in one component."""
    node = components(found).withColumnRenamed("node", "cls")
    comp = saved(classes.select("cls", "grp").join(node, "cls", "left").select("cls", "grp", F.coalesce("comp", "cls").alias("comp")), "comp")
    spread = comp.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    rows = index.drop("lo", "hi").join(spread, "grp")
    live = rows.groupBy("tok").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("tok")
    return comp, saved(rows.join(live, "tok"), "open")


def links(classes: DataFrame, percent: int) -> DataFrame:
    """Verified links among classes(cls, n, lone, tokens, prefix) that have the components of all links."""
    grouped = F.when(F.col("lone") == 0, F.md5(F.concat_ws(",", "n", F.col("prefix").cast("array<string>"))).cast("binary")).otherwise(F.col("cls"))
    classes = saved(classes.withColumn("grp", grouped), "classes")
    groups = classes.groupBy("grp").agg(F.min("cls").alias("head"), F.min_by(F.struct("n", "lone", "prefix"), "cls").alias("s")).select("grp", "head", "s.*")
    index = saved(groups.select("grp", "head", "n", "lone", F.posexplode("prefix").alias("i", "tok"))
                  .select("grp", "head", "n", "tok", (F.col("lone") / F.col("n")).alias("own"), (F.col("lone") + F.col("i") + 1).alias("pos"), F.col("head").alias("lo"), F.col("head").alias("hi")), "index")
    inside = classes.join(groups.select("grp", "head"), "grp").where("cls <> head").select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b"))
    found = saved(_verified(_stars(index, percent, [0], None).union(inside), classes, percent).distinct(), "links")
    comp, open_ = _placed(index, classes, found)
    for r in range(1, DEALS + 1):                                  # only what they leave open is enumerated below
        more = saved(_verified(_stars(open_, percent, [2 * r, 2 * r + 1], 16), classes, percent), "links")
        if more.isEmpty():
            break
        found = saved(found.union(more).distinct(), "links")
        comp, open_ = _placed(open_, classes, found)
    x, y = open_.alias("x"), open_.alias("y")
    met = (x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.grp") < F.col("y.grp")) & ~_same("x", "y") & _bound("x", "y", percent))
           .select(F.col("x.grp").alias("gx"), F.col("y.grp").alias("gy")).distinct())
    spread = comp.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    own = spread.where("lo <> hi").select(F.col("grp").alias("gx"), F.col("grp").alias("gy"))
    rest = (met.union(own).join(comp.toDF("a", "gx", "ca"), "gx").join(comp.toDF("b", "gy", "cb"), "gy").where("ca <> cb")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return saved(found.union(_verified(rest, classes, percent)).distinct(), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, cls (digest of the set) for every row of docs(doc_id, text, ...).

    Words are runs of characters other than space and \\x09-\\x0D after lower-casing A-Z. Null or empty
    texts and texts without words have the empty set, link with nothing and keep their own doc_id as
    component. Rows that repeat, with the same doc_id or another, are one class when their sets agree;
    a null doc_id is never a component's name unless nothing else is in it. Extra columns are ignored;
    an empty table gives an empty result. Shingles are 64-bit hashes, sets 128-bit digests with a size.
    """
    sets = saved(ordered_sets(columns(docs, "doc_id", "text"), k, percent), "sets")
    live = sets.where("size(prefix) > 0")
    classes = live.dropDuplicates(["cls"]).select("cls", "n", "lone", "tokens", "prefix")
    node = components(links(classes, percent))
    known = live.groupBy("cls").agg(F.min("doc_id").alias("first")).join(node.withColumnRenamed("node", "cls"), "cls", "left") \
        .select("cls", "first", F.coalesce("comp", "cls").alias("comp"))
    known = saved(known, "known")
    name = known.groupBy("comp").agg(F.min("first").alias("component_id"))
    label = known.join(name, "comp").select("cls", "component_id")
    linked = live.select("doc_id", "n", "cls").join(label, "cls")
    lone = sets.where("size(prefix) = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "cls")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "cls").union(lone)


def set_digest(text: Column, k: int = 5) -> Column:
    """The cls that near_duplicates gives a text."""
    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        give_back("words")
        sets = list(shingle_sets(*flat(texts), k))
        tok = np.concatenate([*sets, np.zeros(0, U)])
        return pa.array([d.tobytes() for d in _digests(tok, np.array([len(s) for s in sets], np.int64))], pa.binary())
    return digest(text)
