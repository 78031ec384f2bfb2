"""Quality rules with adaptive thresholds, in DataFrame functions only.

1. Measures of each whole text: word length, symbols and repeated words for each word, repeated lines for each line.
2. A quantile sketch of each measure for each language and source: counts per bucket, where bucket b of a value v is
   floor(100 * ln(1 + 100 * v)), so a quantile is right to a hundredth, or to 0.0001 near 0. Sketches are counts, so they merge by
   adding up, in any order, and the same rows give the same thresholds. The shuffle carries at most one row a bucket and task.
3. A group of fewer than MIN_GROUP documents takes the merged sketch of its language, or that of all documents.
4. The threshold of a measure lies FENCE times the distance of its quartiles beyond them; that distance counts as MIN_SPREAD buckets
   at least, so that a group in which nearly all values agree does not reject small departures. Thresholds join the documents.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import once
from .store import columns, saved

MIN_WORDS, MAX_REPEAT = 50, 50
MIN_GROUP, FENCE, MIN_SPREAD = 500, 3, 110
#: Measures: the two columns they divide, and whether small values are rejected too.
MEASURES = {"word_length": ("word_chars", "n_words", True), "symbols": ("n_symbols", "n_words", False),
            "repeats": ("n_repeat_words", "n_words", False), "dup_lines": ("n_dup_lines", "n_lines", False)}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BROADCAST_BYTES, SALTS = 32 << 20, 64
_BLANKS, _SYMBOLS = " \t\n\x0b\f\r", "[#*$%&|<>]"


def _places(n: Column, first: int, less: int) -> Column:
    """first .. n - less, or nothing."""
    return F.when(n - less >= first, F.sequence(F.lit(first), n - less)).otherwise(F.array().cast("array<int>"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source of docs(doc_id, text, lang, source), with COUNTS, n_lines and base_failed.

    Windows of three words are compared within a text by 64-bit hashes; two different ones agree with odds of 2**-64.
    """
    blank = F.lit(_BLANKS)
    d = columns(docs, "doc_id", "lang", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = F.btrim("text", blank)
    d = once(d, w=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
             lines=F.filter(F.split("text", "\n"), lambda x: F.btrim(x, blank) != ""))
    d = d.select("doc_id", "lang", "source", "w", F.size("w").alias("n_words"), F.char_length(F.array_join("w", "")).alias("word_chars"),
                 (F.size(F.split("text", _SYMBOLS)) - 1).alias("n_symbols"), F.size("lines").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    keep = [c for c in d.columns if c != "w"]
    d = once(d, h=F.transform(_places(F.size("w"), 1, 2), lambda i: F.xxhash64(*[F.get("w", i + k) for k in (-1, 0, 1)]))).select(*keep, "h")
    # windows in the order of (hash, place), only where a hash occurs twice
    some = F.size(F.array_distinct("h")) < F.size("h")
    d = once(d, s=F.when(some, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).select(*keep, "s")
    hash_at = lambda i: F.get("s", i)["h"]
    twice = F.filter(_places(F.size("s"), 0, 1), lambda i: F.coalesce(hash_at(i) == hash_at(i - 1), F.lit(False)) | F.coalesce(hash_at(i) == hash_at(i + 1), F.lit(False)))
    d = once(d, p=F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda i: F.get("s", i)["i"])))).select(*keep, "p")
    # a repeated window adds the words that the one before it has not
    fresh = lambda acc, i: acc + F.least(F.lit(3), F.get("p", i) - F.get("p", i - 1))
    d = d.withColumn("n_repeat_words", F.when(F.col("p").isNull(), 0).otherwise(F.lit(3) + F.aggregate(_places(F.size("p"), 1, 1), F.lit(0), fresh)))
    d = d.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in [*COUNTS, "n_lines"]])
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def bucket(measure: str) -> Column:
    part, whole, _ = MEASURES[measure]
    return F.floor(F.lit(100.0) * F.log(F.lit(1.0) + F.lit(100.0) * F.col(part) / F.col(whole))).cast("int")


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the sketches of measured rows that pass the base rules. Those of several tables merge by summing n."""
    cells = rows.where("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in MEASURES])).alias("c"))
    return cells.select("lang", "source", "c.*").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, docs, lo, hi from bucket counts; a window sees one sketch, which has a few thousand buckets at most."""
    whole = Window.partitionBy(*keys, "measure")
    run = whole.orderBy("bucket")
    counted = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(run)).withColumn("docs", F.sum("n").over(whole))
    q = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("docs"), F.col("bucket")))
    edge = counted.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), q(1).alias("q1"), q(3).alias("q3"))
    reach = FENCE * F.greatest(F.lit(MIN_SPREAD), F.col("q3") - F.col("q1"))
    return edge.select(*keys, "measure", "docs", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and for each measure m its buckets lo_m, hi_m: of the group, or if it is small of its language, or of all."""
    fine, middle, top = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch, [])
    met = (fine.alias("f").join(middle.alias("m"), F.col("f.lang").eqNullSafe(F.col("m.lang")) & (F.col("f.measure") == F.col("m.measure")))
           .join(F.broadcast(top).alias("t"), F.col("f.measure") == F.col("t.measure")))                  # one row a measure
    pick = lambda c: F.when(F.col("f.docs") >= MIN_GROUP, F.col(f"f.{c}")).when(F.col("m.docs") >= MIN_GROUP, F.col(f"m.{c}")).otherwise(F.col(f"t.{c}"))
    flat = met.select("f.lang", "f.source", "f.measure", pick("lo").alias("lo"), pick("hi").alias("hi"))
    return flat.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in MEASURES for c in ("lo", "hi")])


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, failed (names of the adaptive rules broken), kept for every row of docs(doc_id, text, lang, source).

    A null or blank text has no words and fails the base rules. Null languages and sources are groups of their own. Rows that repeat
    count each. Extra columns, however called, are ignored; no rows give no rows.
    """
    rows = saved(measured(docs), "measured")
    found = saved(thresholds(sketches(rows)), "thresholds").withColumnsRenamed({"lang": "tl", "source": "ts"})
    size = found.agg(F.sum(F.coalesce(F.octet_length("tl"), F.lit(0)) + F.coalesce(F.octet_length("ts"), F.lit(0)) + 64).alias("b")).first().b or 0
    same = F.col("lang").eqNullSafe(F.col("tl")) & F.col("source").eqNullSafe(F.col("ts"))
    if size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(found), same, "left")
    else:                                                          # a hot group is dealt to SALTS keys
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)))
        copies = found.withColumn("ts_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.join(copies, same & (F.col("salt") == F.col("ts_salt")), "left")
    broken = [F.when((bucket(m) > F.col(f"hi_{m}")) | ((bucket(m) < F.col(f"lo_{m}")) if low else F.lit(False)), F.lit(m)) for m, (_, _, low) in MEASURES.items()]
    met = met.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*broken))))
    return met.select("doc_id", "lang", "source", *COUNTS, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
