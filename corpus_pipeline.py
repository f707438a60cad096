"""From raw documents to token ids: the stages of a training corpus, each written before the next reads it.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; `docs` has the columns of `documents`
(doc_id, text, lang, source, n_chars, and any others), and so has the result of all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import bpe, decontaminate, privacy, simhash, toxicity
from faultline.llm.common import Stages, unused
from faultline.llm.queries import PRIVACY_KEY, RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half. Null and empty texts score as having no features; all
    columns and repeated rows stay; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    name = unused(docs, "_toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the least id. Texts without words are one component;
    repeated rows count as copies of each other. Shingles and radius are those of op2."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: less than a twentieth of their words lie in windows of 13 words
    of `benchmark`. Null and empty texts have no words and stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    prefix = unused(docs, "_benchmark_n_words").removesuffix("n_words")
    marked = decontaminate.mark(docs, benchmark, prefix=prefix)
    return marked.where(~decontaminate.is_contaminated(f"{prefix}n_words", f"{prefix}n_hit")).select(*docs.columns)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the text replaced by pseudonyms; `n_chars`, where there is one, follows."""
    hidden = privacy.pseudonymize(docs, PRIVACY_KEY)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        hidden = hidden.withColumn("n_chars", F.length("text").cast(kind))
    return hidden.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids: doc_id, lang, source, `ids`, `n_tokens`, `text_sha256` of the decoded bytes."""
    coded = bpe.encode_decode(docs, "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    ids = F.sha2("bpe_text", 256).alias("text_sha256")
    return coded.select("doc_id", "lang", "source", F.col("bpe_ids").alias("ids"), F.col("bpe_n").alias("n_tokens"), ids)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("pii_pseudonyms", hide_personal),
    ("byte_bpe", encode),
]
#: A trained classifier, hashes of shingles and merges are beyond SQL; see tests/llm for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage is written to the shared folder and read again."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stages.keep(apply(spark, docs, sf_dir), name)
    return docs
