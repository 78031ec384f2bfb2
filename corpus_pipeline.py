"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
docs. run() writes each stage's rows to the shared folder and rereads them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import boilerplate, jaccard, mixture, packing, toxicity
from lanewise.llm.queries import tokenizer_path
from lanewise.llm.store import saved, unused

#: Most bytes of document ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 32 << 20
#: Boilerplate is on more than this share of a source's documents, on so many at least and on so many different lengths. By
#: counts on the given tables (README): sources are broad, so the share is a tenth of that of op9's SQL.
LINE_RATIO, LINE_PAGES, LINE_SIZES = 0.01, 5, 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of op7, learned from labels, does not call toxic. Null and empty texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; n_chars follows the text."""
    cleaned = boilerplate.drop_boilerplate(docs, "source", LINE_RATIO, LINE_PAGES, LINE_SIZES).drop("n_lines", "n_dropped")
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; others all stay.

    A repeated doc_id is told apart by its shingle set; of its rows with equal text one stays. Rows without doc_id stay.
    """
    found = saved(jaccard.near_duplicates(docs).select("doc_id", "component_id", "cls").where("doc_id is not null"), "groups")
    twice = saved(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    small = lambda ids: F.broadcast(ids) if ids.count() * 40 <= BROADCAST_IDS else ids
    repeated = small(twice)
    gone = saved(found.where("doc_id <> component_id").join(repeated, "doc_id", "left_anti").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return kept
    cls, = unused(docs, "__cls")
    pairs = found.where("doc_id <> component_id").join(repeated, "doc_id", "left_semi").select("doc_id", F.col("cls").alias(cls)).distinct()
    again = docs.join(repeated, "doc_id", "left_semi").withColumn(cls, jaccard.set_digest(F.col("text")))
    again = again.join(pairs, ["doc_id", cls], "left_anti").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them: a row for each pass that takes words of one."""
    return mixture.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("ngram_jaccard", drop_near_duplicates),
          ("mixture", mix_sources), ("best_fit_packing", pack_sequences)]

#: SQL knows neither the tokenizer nor the model; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
