"""Mixing sources to target weights, in DataFrame functions only.

1. Words of a source, document after document, are cut into blocks of `block` words. Documents get
   their place by prefix sums over hashed chunks of bounded size, so a hot source is many tasks.
2. Each output shard draws the source of each of its slots at random by weight, which gives it
   multinomial source counts. A source is drawn up to its quota of blocks exactly; what the random draws
   leave open, further shards deal out.
3. The j-th draw of a source in pass e takes the block that a pseudorandom permutation of its block
   numbers (a Feistel network on a grid just large enough, walked until it is back in range) gives for j.
4. Slots and blocks join on (source, block number): equal keys on both sides are rare, hot sources spread.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import columns, partitions, row_key, saved

CHUNK_ROWS, CELLS, WALK, ROUNDS = 100_000, 1024, 40, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: int = 3, most: float = 3.0) -> DataFrame:
    """sizes(source, source_size) with weight, target. One row a source; the window is over sources only.

    Sources by code point, null last, weigh 1..weights, repeating. Take the sources in order of their cap
    for each unit of weight and share what earlier caps leave among the rest: that level rises while caps
    lie below it and falls from the first one above it, so its maximum is the level to which targets fill.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % weights + 1).cast("double"))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("top", F.max("level").over(every))
    return s.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("top") * F.col("weight")).alias("target"))


def _uniform(*keys: Column) -> Column:
    """[0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(1 << 53)


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Pseudorandom permutation of 0..n-1 chosen by key, at i.

    Rounds alternate on a grid a * b >= n > a * (b - 1). Values past n walk on; fewer than a values are
    past n, so below 1600 blocks WALK steps always end, and above it a longer walk has no chance in practice; should one occur, the job
    stops rather than lose the value.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def rounds(x):
        turn = lambda s, r: F.struct(
            F.when(r % 2 == 0, F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], r, key), a), a)).otherwise(s["l"]).alias("l"),
            F.when(r % 2 == 1, F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], r, key), b), b)).otherwise(s["r"]).alias("r"))
        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])

    first = rounds(i)
    found = lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a permutation walked on too long")).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(rounds(x)), found)


def placed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) as (doc_id, source, size, __k1, __k2, row, start).

    row numbers the source's rows, start is the word offset in the source's stream, __k1 and __k2 digest the row.
    """
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *row_key("doc_id", "source", "text")), "sizes")
    chunks = max(1, -(-sized.count() // CHUNK_ROWS)) * 4
    sized = sized.withColumn("chunk", F.pmod(F.col("__k1"), F.lit(chunks)))
    sums = sized.groupBy("source", "chunk").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    run = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("chunk").alias("c"), F.col("source").alias("s"), F.coalesce(F.sum("words").over(run), F.lit(0)).alias("base"),
                       F.coalesce(F.sum("rows").over(run), F.lit(0)).alias("base_row"))
    inner = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", "__k1", "__k2")
    return saved(sized.withColumn("nth", F.row_number().over(inner))
                 .withColumn("upto", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
                 .join(base, (F.col("chunk") == F.col("c")) & F.col("source").eqNullSafe(F.col("s")))
                 .select("doc_id", "source", "size", "__k1", "__k2", (F.col("base_row") + F.col("nth")).alias("row"),
                         (F.col("base") + F.col("upto") - F.col("size")).alias("start")), "placed")


def quotas(stream: DataFrame, block: int, weights: int, most: float) -> DataFrame:
    """Per source: its target, blocks and quota of block draws (whole passes plus the rest in blocks)."""
    sizes = stream.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes, weights, most).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(most))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.col("target") - whole * F.col("source_size"))
    part = F.least(F.round(rest / block).cast("long"), F.col("blocks"))
    return saved(t.withColumn("quota", F.least(whole * F.col("blocks") + part, F.lit(int(most)) * F.col("blocks")).cast("long")), "quotas")


def drawn(q: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source, first, n): each shard's number of draws of each source, numbered on through the shards."""
    spark = q.sparkSession
    total = q.agg(F.sum("quota")).first()[0] or 0
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    share = (q.where("quota > 0").withColumn("hi", F.sum("quota").over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("lo", F.col("hi") - F.col("quota")).withColumn("total", F.sum("quota").over(Window.partitionBy())))
    cell = lambda c: F.least(F.floor(c * CELLS / F.col("total")), F.lit(CELLS - 1))
    cells = share.select("source", "quota", "blocks", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1e-9))).alias("cell"))
    slots = (spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), (_uniform(F.col("id"), F.lit(seed)) * total).alias("u"))
             .withColumn("cell", F.least(F.floor(F.col("u") * CELLS / total), F.lit(CELLS - 1))))
    counts = (slots.join(cells, "cell").where("u >= lo and u < hi").groupBy("shard", "source", "quota", "blocks").agg(F.count("*").alias("n")))
    run = Window.partitionBy("source").orderBy("shard")
    upto = counts.withColumn("first", F.sum("n").over(run) - F.col("n"))
    upto = saved(upto.select("shard", "source", "quota", "blocks", "first", F.least("n", F.greatest(F.lit(0), F.col("quota") - F.col("first"))).alias("n")), "draws")
    got = upto.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("had"))
    short = (q.where("quota > 0").join(got, F.col("source").eqNullSafe(F.col("s")), "left")
             .select((F.lit(-(-total // shard_slots)) + F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(max(1, total // shard_slots)))).alias("shard"),
                     "source", "quota", "blocks", F.coalesce("had", F.lit(0)).alias("first"), (F.col("quota") - F.coalesce("had", F.lit(0))).alias("n")))
    return upto.union(short.select(upto.columns)).where("n > 0")


def slots(draws: DataFrame, seed: int) -> DataFrame:
    """(shard, source, draw, pass, block) of every slot."""
    s = draws.repartition(partitions(draws.sparkSession), "shard", "source").select("shard", "source", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    s = s.withColumn("pass", F.floor(F.col("draw") / F.col("blocks")))
    return s.withColumn("block", permuted(F.col("draw") % F.col("blocks"), F.col("blocks"), F.xxhash64("source", "pass", F.lit(seed))))


def spans(stream: DataFrame, block: int) -> DataFrame:
    """(row, source, doc_id, size, block, at, words) of every piece that a document has in a block; a row without words has one null block."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    s = stream.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return s.select("row", "source", "doc_id", "size", "block", (lo - F.col("start")).alias("at"), (hi - lo).alias("words"))


def mixed(docs: DataFrame, block: int = 64, weights: int = 3, most: float = 3.0, shard_slots: int = 1 << 16, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of docs(doc_id, text, source): (stream, quotas, picks).

    picks(shard, pass, draw, row, source, doc_id, at, words): every slot's pieces of documents, by word offset.
    A null or blank text has size 0 and is never picked; a null source is a source, the last one; rows
    that repeat, or share a doc_id, are documents of their own. Ties in order go by size and are equal in
    every result. The same rows give the same mix. Extra columns are ignored; no rows give no rows.
    """
    stream = placed(columns(docs, "doc_id", "text", "source"))
    q = quotas(stream, block, weights, most)
    s = slots(drawn(q, shard_slots, seed), seed).withColumnRenamed("source", "src")
    pieces = spans(stream, block)
    # slots are made by explosion, so their size shows too late: never broadcast them
    picks = (pieces.join(s.hint("merge"), (pieces["block"] == s["block"]) & pieces["source"].eqNullSafe(s["src"]))
             .select("shard", "pass", "draw", "row", "source", "doc_id", "at", "words"))
    return stream, q, picks


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of docs."""
    stream, q, picks = mixed(docs, **how)
    taken = picks.groupBy(F.col("row").alias("r"), F.col("source").alias("s")).agg(F.sum("words").alias("taken"))
    small = q.select(F.col("source").alias("q"), "source_size", "target")
    return (stream.join(taken, (F.col("row") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")), "left")
            .join(small, F.col("source").eqNullSafe(F.col("q")))
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, once a pass, with the words that the pass takes.

    A pass that takes all words keeps the text as it is. n_chars follows the text. Rows alike in doc_id,
    source and text are taken for one another. A document's pieces are as many as its text has blocks.
    """
    stream, _, picks = mixed(docs, **how)
    taken = (picks.groupBy("source", "row", "pass").agg(F.sum("words").alias("n"), F.sort_array(F.collect_list(F.struct("at", "words"))).alias("pieces"))
             .withColumnsRenamed({"source": "s", "row": "r"}))
    rows = (stream.join(taken, (F.col("row") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
            .select("__k1", "__k2", (F.col("n") == F.col("size")).alias("__whole"), F.col("pieces").alias("__pieces")))
    text = F.col("doc")["text"]                                    # the input travels as one column, whatever its columns are called
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.flatten(F.transform("__pieces", lambda p: F.slice(F.col("__w"), p["at"].cast("int") + 1, p["words"].cast("int")))), "")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    once = docs.select(doc, *row_key("doc_id", "source", "text")).dropDuplicates(["__k1", "__k2"])
    met = once.join(rows, ["__k1", "__k2"]).withColumn("__w", F.when(~F.col("__whole"), words))
    met = met.withColumn("__text", F.when(F.col("__whole"), text).otherwise(F.rtrim(part)))
    made = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    return met.select(*[(made[c] if c in made else F.col("doc")[c]).alias(c) for c in docs.columns])
