"""The operators over the given tables, each next to SQL where SQL can say the same."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, hamming, jaccard, mixture, packing, quality, rans, resample, secrets, spelling, spotsigs, toxicity, warc

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
""")
def op1(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("cls")


@query("op9_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line, trim(string_split(text, chr(10))[i], E' \t\r') AS plain
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
per_line AS (SELECT source, plain, count(DISTINCT doc_id) AS n_pages FROM lines WHERE plain <> '' GROUP BY source, plain),
hosts AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
bad AS (SELECT l.source, l.plain FROM per_line l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
        WHERE n_pages >= 5 AND n_pages > 0.1::DOUBLE * host_pages),
marked AS (SELECT l.*, b.plain IS NOT NULL AS drop_it FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.plain = b.plain)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE NOT m.drop_it), '') END AS text,
       d.source, count(m.i) AS n_lines, count(m.i) FILTER (WHERE m.drop_it) AS n_dropped
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.text, d.source
""")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return boilerplate.drop_boilerplate(docs, "source")


@query("op3_mixture")
def op3(spark, sf_dir):
    return mixture.mix_report(table(spark, sf_dir, "documents"))


@query("op4_spotsigs")
def op4(spark, sf_dir):
    return spotsigs.edited_report(table(spark, sf_dir, "documents"))


@query("op2_warc")
def op2(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


@query("op5_rans_ids")
def op5(spark, sf_dir):
    return rans.ids_report(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_secrets")
def op8(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op10_exact_topk", r"""
WITH codes AS (
  SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT AS lo,
         list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 33)) ELSE 0 END))::BIGINT AS hi
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, (bit_count(xor(q.lo, c.lo)) + bit_count(xor(q.hi, c.hi)))::BIGINT AS distance
  FROM codes q JOIN codes c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, neighbor_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM near) WHERE rank <= 10
""")
def op10(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return hamming.nearest(rows, rows.where("id % 50 = 0"))


@query("op7_toxicity")
def op7(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_quality_rules", r"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM words, unnest(range(1, len(w) - 1)) AS u(i)),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, lang, source, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
m AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
  FROM lines LEFT JOIN cover USING (doc_id)),
b AS (
  SELECT doc_id, lang, source, measure, low, floor(100::DOUBLE * ln(1::DOUBLE + 100::DOUBLE * part / whole))::BIGINT AS bucket
  FROM m, (VALUES ('word_length', true), ('symbols', false), ('repeats', false), ('dup_lines', false)) v(measure, low),
    LATERAL (SELECT CASE measure WHEN 'word_length' THEN word_chars WHEN 'symbols' THEN n_symbols WHEN 'repeats' THEN n_repeat_words ELSE n_dup_lines END AS part,
                    CASE measure WHEN 'dup_lines' THEN n_lines ELSE n_words END AS whole) x
  WHERE NOT base_failed),
levels AS (SELECT 1 AS level, lang, source, measure, bucket FROM b UNION ALL SELECT 2, lang, NULL, measure, bucket FROM b UNION ALL SELECT 3, NULL, NULL, measure, bucket FROM b),
runs AS (
  SELECT level, lang, source, measure, bucket, sum(count(*)) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
         sum(count(*)) OVER (PARTITION BY level, lang, source, measure) AS docs FROM levels GROUP BY level, lang, source, measure, bucket),
edges AS (SELECT level, lang, source, measure, max(docs) AS docs, min(bucket) FILTER (WHERE 4 * upto >= docs) AS q1, min(bucket) FILTER (WHERE 4 * upto >= 3 * docs) AS q3
          FROM runs GROUP BY level, lang, source, measure),
fences AS (SELECT level, lang, source, measure, docs, q1 - 3 * greatest(110, q3 - q1) AS lo, q3 + 3 * greatest(110, q3 - q1) AS hi FROM edges),
bad AS (
  SELECT b.doc_id FROM b
  JOIN fences f ON f.level = 1 AND f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source AND f.measure = b.measure
  JOIN fences g ON g.level = 2 AND g.lang IS NOT DISTINCT FROM b.lang AND g.measure = b.measure
  JOIN fences a ON a.level = 3 AND a.measure = b.measure
  WHERE bucket > CASE WHEN f.docs >= 500 THEN f.hi WHEN g.docs >= 500 THEN g.hi ELSE a.hi END
     OR (low AND bucket < CASE WHEN f.docs >= 500 THEN f.lo WHEN g.docs >= 500 THEN g.lo ELSE a.lo END))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
""")
def op11(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept")


#: CRC-32 of UTF-8 strings in SQL: the table of byte remainders, then one lookup a byte.
_CRC_TABLE = """tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i))"""


def _crc(value: str) -> str:
    code = f"hex(encode({value}))"
    return (f"xor(list_reduce(list_transform(range(1, length({code}), 2), lambda i: ('0x' || substr({code}, i, 2))::BIGINT), "
            "lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op12_importance_resampling", r"""
WITH """ + _CRC_TABLE + r""",
d AS (SELECT doc_id, regexp_extract_all(""" + _LOWER + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT unnest(regexp_extract_all(""" + _LOWER + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
dw AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x),
codes AS (SELECT x, """ + _crc("x") + r""" % 10000 AS bucket FROM (SELECT x FROM dw UNION SELECT x FROM t), tab),
s_in AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN codes USING (x) GROUP BY bucket),
t_in AS (SELECT bucket, count(*) AS t FROM t JOIN codes USING (x) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s_in)::DOUBLE + 10000)
                                 / ((s::DOUBLE + 1) * ((SELECT count(*) FROM t)::DOUBLE + 10000))))::BIGINT AS gain FROM s_in LEFT JOIN t_in USING (bucket)),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM dw JOIN codes USING (x) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM d LEFT JOIN sums USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS most FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= most THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)
""")
def op12(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_spelling_variants", r"""
WITH RECURSIVE """ + _CRC_TABLE + r""",
runs AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(""" + _LOWER + r""", '[a-z\x{00C0}-\x{00FF}]+')) AS x FROM documents) GROUP BY doc_id, x),
coded AS (SELECT x, n, """ + _crc("doc_id || ':' || x") + r""" AS h FROM runs, tab WHERE length(x) >= 7),
made AS (SELECT CASE WHEN h % 31 = 0 THEN left(x, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word, n FROM coded),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS less FROM words, unnest(range(1, length(word) + 1)) AS u(p)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.less = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.less = words.word),
best AS (SELECT near.word, near.other, words.n, row_number() OVER (PARTITION BY near.word ORDER BY words.n DESC, other) AS r, count(*) OVER (PARTITION BY near.word) AS n_near
         FROM near JOIN words ON words.word = other),
met AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * words.n THEN other END AS form, CASE WHEN best.n >= 10 * words.n THEN best.n END AS form_n
        FROM words LEFT JOIN best ON best.word = words.word AND r = 1),
follow(word, z) AS (SELECT word, word FROM met UNION ALL SELECT f.word, m.form FROM follow f JOIN met m ON m.word = f.z WHERE m.form IS NOT NULL)
SELECT met.word, met.form, z AS root, met.n, met.n_near, met.form_n FROM met JOIN follow USING (word) JOIN met last ON last.word = z AND last.form IS NULL
""")
def op13(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
