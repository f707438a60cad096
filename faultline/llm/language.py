"""Language of web pages by Bayesian evidence fusion.

Four sources are combined as log-probabilities per language:

* text: a multinomial model of character n-grams of the visible text, trained on labelled documents;
* markup: the declared language, with P(declared | language) counted over all pages;
* address suffix and host: a prior per host, smoothed towards its domain, that towards its suffix, and that
  towards all pages, from sums of the text posteriors by grouped aggregation. A page's own share is taken
  out of its host's and domain's sums, so it does not confirm itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.common import Stages, grouped, mix, task, text_slices
from faultline.llm.grams import Lookup, characters, hashes

SIZES = range(1, 4)
SLICE_BYTES = 1 << 19
#: Labelled documents per language that training reads, in expectation: the sample's bound.
LANGUAGE_ROWS = 1500
FEATURES, BUCKETS, SAMPLE_TASKS = 20_000, 64, 8
#: n-grams overlap, so their evidence counts this much.
TEXT_WEIGHT = 1 / len(SIZES)
#: Pseudo-pages that a parent adds to a host's, domain's or suffix's own, and to a declared value's.
PARENT, DECLARED = 10.0, 5.0
LEAST = 1e-9


@dataclass
class TextModel:
    """Log-probability of each chosen n-gram in each language."""

    languages: list[str]
    chosen: np.ndarray
    logs: np.ndarray


def _sums(batches: Iterator[pa.RecordBatch], languages: int) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, languages))
    for whole in batches:
        for batch in text_slices(whole, "text", SLICE_BYTES):
            codes, borders = characters(batch.column(1))
            label = np.repeat(batch.column(0).to_numpy(), np.diff(borders))
            found = list(hashes(codes, borders, SIZES))
            if not found:
                continue
            at, h = (np.concatenate(x) for x in zip(*found))
            keys, code = np.unique(np.concatenate([keys, h]), return_inverse=True)
            old, new = code[: len(counts)], code[len(counts) :]
            total = np.bincount(new * languages + label[at], minlength=len(keys) * languages).astype(float).reshape(-1, languages)
            total[old] += counts
            counts = total
    bucket = (mix(keys.copy()) >> np.uint64(58)).astype(np.int64)
    for b in np.unique(bucket):
        at = bucket == b
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array([b], pa.int32()), "keys": [keys[at].tobytes()], "counts": [counts[at].tobytes()]}
        )


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> TextModel:
    """The text model of a bounded sample of the labelled documents, chosen and dealt out by a hash of id and
    text, so that of a text's copies some are chosen like of any others."""
    c = F.col
    labelled = docs.select(c(lang).alias("lang"), c(text).cast("string").alias("text"), F.xxhash64(c(doc_id).cast("string"), c(text)).alias("draw")).where(c("lang").isNotNull() & c("text").isNotNull())
    # One row per language.
    size = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(size)
    if not languages:
        return TextModel([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    share, number = F.lit(0.0), F.lit(0)
    for k, name in enumerate(languages):
        share = F.when(c("lang") == name, min(1.0, LANGUAGE_ROWS / size[name])).otherwise(share)
        number = F.when(c("lang") == name, k).otherwise(number)
    chosen = labelled.where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30))
    rows = chosen.select(number.alias("label"), "text", "draw").repartition(SAMPLE_TASKS, "draw").drop("draw")
    n = len(languages)

    def choose(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys").combine_chunks()])
        counts = np.concatenate([np.frombuffer(x.as_buffer()).reshape(-1, n) for x in table.column("counts").combine_chunks()])
        keys, code = np.unique(keys, return_inverse=True)
        total = np.zeros((len(keys), n))
        np.add.at(total, code, counts)
        best = np.argsort(-total.sum(axis=1), kind="stable")[:FEATURES]
        return pa.table(
            [pa.array(keys[best].view(np.int64)), pa.array(total[best].sum(axis=1)), pa.array(list(total[best]), pa.list_(pa.float64()))],
            names=["key", "n", "counts"],
        )

    counted = rows.mapInArrow(task(lambda batches: _sums(batches, n)), "bucket int, keys binary, counts binary")
    best = counted.groupBy("bucket").applyInArrow(grouped(choose), "key bigint, n double, counts array<double>")
    table = best.orderBy(F.desc("n"), "key").limit(FEATURES).toPandas()
    counts = np.array(table["counts"].tolist()).reshape(-1, n)
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(counts))))
    return TextModel(languages, table["key"].to_numpy().view(np.uint64), logs)


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments, tags and entities."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"<[^>]*>", " "), r"&[A-Za-z0-9#]{1,10};", " ")


def declared_language(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, lower case; null if there is none of 2 or 3 letters."""
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return F.when(tag.rlike("^[A-Za-z]{2,3}$"), F.lower(tag))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def text_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """`pages` with column `text` replaced by `logs`: the text's weighted log-likelihood in each language."""
    kept = [f for f in pages.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    find, logs, n = Lookup(model.chosen), model.logs, len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE_BYTES):
                i = batch.schema.get_field_index("text")
                codes, borders = characters(batch.column(i))
                row = np.repeat(np.arange(batch.num_rows), np.diff(borders))
                sums = np.zeros((batch.num_rows, n))
                for at, h in hashes(codes, borders, SIZES):
                    k, feature = find.find(h)
                    for lang in range(n):
                        sums[:, lang] += np.bincount(row[at[k]], logs[feature, lang], batch.num_rows)
                columns = [x for j, x in enumerate(batch.columns) if j != i]
                values = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel() * TEXT_WEIGHT), n).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*columns, values], names=[f.name for f in kept] + ["logs"])

    return pages.select(*[f.name for f in kept], "text").mapInArrow(task(run), f"{schema}, logs array<double>")


def _posterior(logs: Column) -> Column:
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda w: w / total)


def _smoothed(own: Column, parent: Column, most: float = PARENT) -> Column:
    """Shares of each language: own sums, with `most` pages spread as the parent's shares."""
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(own, parent, lambda x, p: (F.greatest(x, F.lit(0.0)) + most * p) / (F.greatest(total, F.lit(0.0)) + most))


def _summed(df: DataFrame, key: list[str], n: int, name: str) -> DataFrame:
    sums = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)]
    return df.groupBy(*key).agg(*sums).select(*key, F.array(*[f"s{k}" for k in range(n)]).alias(name))


def identify(
    pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """A row per row of `pages`: the id, `lang` and `confidence` (the largest posterior; ties to the first
    language by name), `posterior` (map), `text_lang` (by text alone; null without text), `declared`, `host`.

    Null or empty html has no text and no declaration, so its host's prior decides; a null or unreadable
    address counts as the host with the empty name. Repeated rows are judged each. Other columns are not read.
    Without any language in the model `lang` and `confidence` are null.
    """
    spark, n, names = pages.sparkSession, len(model.languages), model.languages
    c = F.col
    rows = pages.select(
        c(page_id).alias("id"), host_of(c(url)).alias("host"), declared_language(c(html)).alias("declared"),
        visible(F.coalesce(c(html), F.lit(""))).alias("text"),
    )
    if not n:
        nothing = F.lit(None)
        return rows.select(
            c("id").alias(page_id), nothing.cast("string").alias("lang"), nothing.cast("double").alias("confidence"),
            nothing.cast("map<string,double>").alias("posterior"), nothing.cast("string").alias("text_lang"), "declared", "host",
        )
    stages = Stages(spark, "language")
    seen = text_evidence(rows.withColumn("has_text", F.length(F.trim("text")) > 0), model)
    seen = stages.keep(seen.withColumn("p", _posterior(c("logs"))), "text")

    # All counts are sums over all pages; each level's table has a row per name at that level.
    hosts = stages.keep(_summed(seen, ["host"], n, "in_host"), "hosts")
    tree = hosts.withColumn("domain", domain_of(c("host"))).withColumn("suffix", F.substring_index("host", ".", -1))
    up = tree.withColumnRenamed("in_host", "p")
    domains = _summed(up, ["domain"], n, "in_domain")
    suffixes = _summed(up, ["suffix"], n, "in_suffix")
    whole = _summed(up, [], n, "in_all").first()
    whole = np.array(whole["in_all"] if whole["in_all"][0] is not None else [0.0] * n)
    base = (whole + 1) / (whole.sum() + n)
    everywhere = F.array(*[F.lit(float(x)) for x in base])
    suffixes = suffixes.select("suffix", _smoothed(c("in_suffix"), everywhere).alias("by_suffix"))
    priors = tree.join(domains, "domain").join(suffixes, "suffix").select("host", "in_host", "in_domain", "by_suffix")

    # P(declared | language): at most one row per word of two or three letters, so it fits every task.
    said = _summed(seen.where(c("declared").isNotNull()), ["declared"], n, "in_declared")
    spoken = np.array([sum(x) for x in zip(*(r.in_declared for r in said.collect()))] or [0.0] * n)
    share = F.aggregate("in_declared", F.lit(0.0), lambda s, x: s + x) / float(max(spoken.sum(), 1e-300))
    total = F.array(*[F.lit(float(x)) for x in spoken])
    said = said.select("declared", F.zip_with("in_declared", total, lambda x, t: F.log((x + DECLARED * share) / (t + DECLARED))).alias("by_declared"))

    judged = seen.join(priors, "host").join(F.broadcast(said), "declared", "left")
    others = lambda name: F.zip_with(name, "p", lambda s, p: s - p)
    prior = _smoothed(others("in_host"), _smoothed(others("in_domain"), c("by_suffix")))
    quiet = F.array(*[F.lit(0.0)] * n)
    fused = F.zip_with(
        F.zip_with("logs", prior, lambda x, y: x + F.log(F.greatest(y, F.lit(LEAST)))),
        F.coalesce("by_declared", quiet),
        lambda x, y: x + F.greatest(y, F.lit(float(np.log(LEAST)))),
    )
    judged = judged.withColumn("fused", fused).withColumn("posterior", _posterior(c("fused")))
    named = F.array(*[F.lit(x) for x in names])
    first = lambda values: F.get(named, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
    return judged.select(
        c("id").alias(page_id),
        first(c("posterior")).alias("lang"),
        F.array_max("posterior").alias("confidence"),
        F.map_from_arrays(named, "posterior").alias("posterior"),
        F.when(c("has_text"), first(c("p"))).alias("text_lang"),
        "declared",
        "host",
    )
