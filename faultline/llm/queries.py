"""One query per training-data operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import bpe, conversations, decontaminate, language, neighbours, phrases, privacy, repair, sharding, simhash, substring, toxicity, warc
from faultline.llm.common import folder_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring.drop_repeats(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    model = language.train(_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    found = language.identify(_table(spark, folder, "pages"), model)
    return found.select("page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "host")


@query
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, _table(spark, folder, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


WORDS = "word_bpe_49k.json"
END_ID = 1


@query
def op3_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = _table(spark, folder, "documents"), folder_for(spark, "token-shards")
    files = repair.write_shards(docs, target, public_tokenizers.path(WORDS), END_ID)
    return repair.read_shards(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


RANKS = "byte_bpe_multi_50k.tiktoken"


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.col("bpe_n").alias("n_tokens"),
        F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2("bpe_text", 256).alias("decoded_sha256"),
    )


PRIVACY_KEY = "corpus-2024"


@query
def op8_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return privacy.pseudonymize(docs, PRIVACY_KEY, counted="n_replaced")


@query
def op9_block_join(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


SQL["op9_block_join"] = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), ranked AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, x.e) DESC, x.vec_id) AS rank
  FROM good q JOIN good x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id AND len(q.e) = len(x.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    files = warc.write_archives(_table(spark, folder, "pages"), folder_for(spark, "warc"))
    return warc.read_archives(files).select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


SQL["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), h AS (SELECT html, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN holder IS NULL OR holder IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN holder IS NULL OR holder IS NOT DISTINCT FROM p.page_id THEN NULL ELSE holder END AS refers_to
FROM p LEFT JOIN h ON p.n >= 1000 AND p.html = h.html
"""


@query
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"), least=100, top=2000)


SQL["op11_phrases"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), totals AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS gram
  FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), counts AS (
  SELECT lang, k, gram, array_to_string(gram, ' ') AS phrase, count(*) AS f FROM grams GROUP BY lang, k, gram HAVING count(*) >= 100
), cuts AS (
  SELECT lang, k, gram, phrase, f AS a, unnest(range(1, k)) AS cut FROM counts WHERE k >= 2
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, t.n,
    (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.gram[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.gram[c.cut + 1:c.k], ' ')
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
  SELECT * FROM least s WHERE NOT EXISTS (
    SELECT 1 FROM counts longer WHERE longer.lang = s.lang AND longer.f >= s.a AND longer.phrase <> s.phrase
      AND contains(' ' || longer.phrase || ' ', ' ' || s.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query
def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    return conversations.repaired(rows, conversations.damage(rows))


SHARDS = 40


@query
def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    shards = sharding.write_shards(docs, folder_for(spark, "shards"), [1.0] * SHARDS)
    text = F.coalesce("text", F.lit(""))
    return sharding.with_slots(shards).select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )
