"""Each stage of the pipeline against plain versions on its own input, and odd tables."""

import base64
import re
import shutil

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from plain import contamination, groups, sha, simhash

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from faultline.llm import toxicity
from faultline.llm.queries import RANKS


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The input and output rows of every stage, by name."""
    base, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, apply in pipeline.STAGES:
        before = docs
        apply(spark, docs, folder).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out[name] = ({r.doc_id: r for r in before.collect()}, docs.collect(), before.columns, docs.columns)
    return out


def test_columns_stay_and_ids_are_unique(stages):
    for name, (before, after, had, has) in stages.items():
        assert len({r.doc_id for r in after}) == len(after)
        assert has == had or name == "byte_bpe"


def test_toxicity(stages, spark, folder):
    before, after, *_ = stages["toxicity"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert {r.doc_id for r in after} == {r.doc_id for r in scores if r.toxicity < 0.5}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()} & before.keys()
    assert len(toxic & {r.doc_id for r in after}) <= 0.2 * len(toxic)


def test_near_copies(stages):
    before, after, *_ = stages["simhash_near_dedup"]
    root = groups({i: simhash(r.text) for i, r in before.items()})
    assert {r.doc_id for r in after} == set(root.values()) and all(before[r.doc_id] == r for r in after)


def test_benchmark(stages, spark, folder):
    before, after, *_ = stages["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = contamination({i: r.text for i, r in before.items()}, items)
    assert {r.doc_id for r in after} == {i for i, (n, hit, _) in want.items() if not (hit and 20 * hit >= n)}


def test_personal_data(stages):
    before, after, *_ = stages["pii_pseudonyms"]
    assert len(after) == len(before)
    mail = re.compile(r"[\w.]+@[\w.]+\.\w+")
    for r in after:
        old = before[r.doc_id]
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (old.lang, old.source)
        assert not set(mail.findall(r.text)) & set(mail.findall(old.text))
    assert any(before[r.doc_id].text != r.text for r in after)


def test_token_ids(stages):
    before, after, *_ = stages["byte_bpe"]
    with open(P.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(after) == len(before)
    for r in after:
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(before[r.doc_id].text)
        assert r.text_sha256 == sha(before[r.doc_id].text)


def test_run_gives_the_last_stage(spark, folder, stages):
    want = {(r.doc_id, r.text_sha256) for r in stages["byte_bpe"][1]}
    assert {(r.doc_id, r.text_sha256) for r in pipeline.run(spark, folder).collect()} == want
    assert entry.queries()["pipeline"] is pipeline.run


def test_odd_rows_pass_every_stage(spark, folder, make_docs):
    names = ["toxicity", "_toxicity", "_fingerprint", "_key", "_matches", "_pseudonyms", "_benchmark_n_words", "n_hit", "bpe_n", "label"]
    texts = [(1, None), (1, None), (None, ""), (None, "only text without an id stands here"), (2, ""), (3, "word " * 60_000), (3, "word " * 60_000), (4, "mail me: a.b@c.org")]
    docs = make_docs(texts)
    for k, name in enumerate(names):
        docs = docs.selectExpr("*", f"{k} AS `{name}`")
    for stage, apply in pipeline.STAGES:
        out = apply(spark, docs, folder)
        rows = out.collect()
        if stage != "byte_bpe":
            assert out.columns == docs.columns and all(r[n] == k for r in rows for k, n in enumerate(names))
        assert apply(spark, docs.limit(0), folder).collect() == []
        # Five components: without words, and three texts; the second 60,000-word row is a copy.
        assert len(rows) == (4 if stage == "simhash_near_dedup" else 8)


def test_empty_corpus(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{folder}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
