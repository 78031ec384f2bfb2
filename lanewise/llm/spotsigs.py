"""SpotSigs fingerprints, in DataFrame functions only.

Common words are anchors. A signature is the chain of the next content words (words that are no
anchors) after an anchor; a text's fingerprint is the set of its signatures. Texts without any full chain have one
signature, the whole text, so that short texts differ. Similar texts have sets of similar length,
so the search cuts lengths into partitions and compares a text with its own and the next partition only.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import once
from .store import columns, partitions, saved

# The commonest words of English, French, German and Spanish.
ANCHORS = "the a an is was of and to le la les des du un et de que der die das und ist nicht von el los las y en".split()
_MARK = "§"
_ANCHOR = r"(?<![^ ])(?:" + "|".join(sorted(ANCHORS)) + r")(?![^ ])"


def with_signatures(df: DataFrame, text: str, name: str, chain: int = 2) -> DataFrame:
    """df with the sorted distinct 64-bit signatures of a text column; null counts as empty. Letters fold, marks separate."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    marked = F.concat(F.regexp_replace(plain, _ANCHOR, _MARK), F.lit(" "))
    word = f"[^ {_MARK}]+ "
    spots = F.regexp_extract_all(marked, F.lit(f"{_MARK} (?=((?:(?:{_MARK} )*{word}){{{chain}}}))"), F.lit(1))
    df = once(df, __spots=F.sort_array(F.array_distinct(F.transform(spots, lambda s: F.xxhash64(F.replace(s, F.lit(_MARK + " "), F.lit("")))))))
    whole = F.array(F.xxhash64(F.lit("whole"), F.coalesce(text, F.lit(""))))
    return df.withColumn(name, F.when(F.size("__spots") > 0, F.col("__spots")).otherwise(whole)).drop("__spots")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("double")


def printed(sigs: Column) -> Column:
    """A signature set as text: 16 hexadecimal digits for each signature, in order, so that equal texts mean equal sets and likeness can be told from it."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), "")


def with_next(docs: DataFrame, derive) -> DataFrame:
    """derive(docs) for docs(doc_id, text), with columns next_<c> of the next row by ascending doc_id; after the last row, the first.

    Rows go to ranges of doc_id of about equal numbers of rows, once; the first row of each range is
    looked up apart, by its doc_id. Null ids come first; rows with equal ids go by text.
    """
    n = partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    dealt = docs.withColumn("__part", F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))))
    ids = [r[0] for r in dealt.groupBy("__part").agg(F.min("doc_id")).select("min(doc_id)").collect() if r[0] is not None]   # one a range
    order = Window.partitionBy("__part").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    heads = dealt.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()).withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    heads, rows = derive(heads), derive(dealt)
    payload = [c for c in rows.columns if c not in ("doc_id", "__part")]
    item = F.struct(*payload)
    first = heads.select("__part", item.alias("__head"))
    edge = first.select("__part", F.coalesce(F.lead("__head").over(Window.orderBy("__part")),
                                             F.min_by("__head", "__part").over(Window.partitionBy())).alias("__edge"))
    led = rows.withColumn("__next", F.lead(item).over(order))
    out = led.join(F.broadcast(edge), "__part", "left")                # one row a range: as many as shuffle partitions
    return out.select("doc_id", *payload, *[F.coalesce(F.col("__next"), F.col("__edge"))[p].alias(f"next_{p}") for p in payload])


def edited_report(docs: DataFrame, chain: int = 2) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs(doc_id, text).

    The edited text has the last floor(n_chars / 2) code points replaced by as many of the next document's
    first, or all it has. A null text is empty. Rows that repeat are documents of their own; rows with equal doc_id
    follow each other by text. A single row is its own next. Extra columns are ignored; no rows give no rows.
    """
    d = columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    d = with_next(d, lambda rows: with_signatures(rows, "text", "sigs", chain))
    half = F.floor(F.char_length("text") / 2).cast("int")
    d = once(d, edited=F.concat(F.expr("left(text, cast(char_length(text) - floor(char_length(text) / 2) as int))"),
                                F.when(half > 0, F.substring(F.col("next_text"), F.lit(1), half)).otherwise(F.lit(""))))
    d = with_signatures(d, "edited", "esigs", chain)
    return d.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                    printed(F.col("sigs")).alias("fingerprint"), printed(F.col("esigs")).alias("edited_fingerprint"),
                    likeness(F.col("sigs"), F.col("esigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def similar_fingerprints(docs: DataFrame, tau: float = 0.8, chain: int = 2) -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints whose Jaccard coefficient is tau or more; a and b are the smallest doc_id of all texts with that fingerprint; membership is
    by `fingerprint_classes`. Length partitions grow by 1 / tau, so a pair lies in one partition or in two
    neighbours; of a set of n only the rarest n - ceil(tau * n) + 1 signatures are looked up, and pairs
    that their lengths rule out are pruned before the sets meet.
    """
    c = saved(fingerprint_classes(docs, chain).groupBy("sigs").agg(F.min("doc_id").alias("rep")).withColumn("n", F.size("sigs")), "spot")
    seen = c.select("rep", "n", F.explode("sigs").alias("s"))
    freq = seen.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = seen.join(freq, "s", "left").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("o"))
    head = (ranked.withColumn("o", F.slice("o", 1, F.col("n") - F.ceil(F.lit(tau) * F.col("n")).cast("int") + 1))
            .select("rep", "n", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / tau)).alias("part"), F.explode("o").alias("e"))
            .where("e.df > 1").select("rep", "n", "part", F.col("e.s").alias("s")))
    here = head.select("rep", "n", "s", "part").withColumn("own", F.lit(True))
    ahead = head.select("rep", "n", "s", (F.col("part") + 1).alias("part")).withColumn("own", F.lit(False))
    x, y = here.alias("x"), here.union(ahead).alias("y")
    met = (x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.part") == F.col("y.part")))
           .where((~F.col("y.own") & (F.col("x.rep") != F.col("y.rep"))) | (F.col("x.rep") < F.col("y.rep")))
           .where(F.least("x.n", "y.n") >= tau * F.greatest("x.n", "y.n"))
           .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())
    sets = c.select("rep", "sigs")
    return (met.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
            .select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= tau))


def fingerprint_classes(docs: DataFrame, chain: int = 2) -> DataFrame:
    """(doc_id, sigs): which signature set each document has; rows with a null doc_id are left out of searches."""
    d = columns(docs, "doc_id", "text").where("doc_id is not null")
    return with_signatures(d, "text", "sigs", chain).select("doc_id", "sigs")
