"""Text model accuracy, the fusion by hand, and odd pages."""

from collections import defaultdict

import numpy as np
import pytest

from faultline.llm import language as op

PAGES = "page_id bigint, url string, html string, lang string"


@pytest.fixture(scope="module")
def model(spark):
    return op.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_text_alone_finds_the_documents_language(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 200")
    rows = op.text_evidence(docs.select("doc_id", "lang", "text"), model).collect()
    right = sum(model.languages[int(np.argmax(r.logs))] == r.lang for r in rows)
    assert right >= 0.95 * len(rows)


def test_fusion_equals_the_sums_by_hand(spark, model):
    words = {"en": "the and of", "de": "und der die", "fr": "les des et", "es": "los las de"}
    rows = []
    for i in range(60):
        lang = ["en", "de", "fr", "es"][i % 7 % 4]
        text = " ".join(words[lang].split()[: i % 4])
        declared = ["", ' lang="de-AT"', " lang='EN'", " lang=x"][i % 4]
        host = ["a.x.de", "b.x.de", "y.fr", "z.com", ""][i % 5]
        rows.append((i, f"http://{host}/p" if host else None, f"<html{declared}><script>the</script><p>{text}</p></html>", "own"))
    pages = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r for r in op.identify(pages, model).collect()}

    shown = pages.select("page_id", op.visible(pages.html).alias("text"), op.declared_language(pages.html).alias("d"), op.host_of(pages.url).alias("h"))
    seen = {r.page_id: r for r in op.text_evidence(shown, model).collect()}
    n = len(model.languages)
    p, sums = {}, defaultdict(lambda: np.zeros(n))
    for i, r in seen.items():
        e = np.exp(np.array(r.logs) - max(r.logs))
        p[i] = e / e.sum()
        domain, suffix = ".".join(r.h.split(".")[-2:]), r.h.split(".")[-1]
        for key in [("h", r.h), ("m", domain), ("s", suffix), ("all",)] + ([("d", r.d), ("spoken",)] if r.d else []):
            sums[key] += p[i]
    smooth = lambda own, parent: (np.maximum(own, 0) + op.PARENT * parent) / (max(own.sum(), 0) + op.PARENT)
    base = (sums[("all",)] + 1) / (sums[("all",)].sum() + n)
    for i, r in seen.items():
        domain, suffix = ".".join(r.h.split(".")[-2:]), r.h.split(".")[-1]
        prior = smooth(sums[("h", r.h)] - p[i], smooth(sums[("m", domain)] - p[i], smooth(sums[("s", suffix)], base)))
        logs = np.array(r.logs) + np.log(np.maximum(prior, op.LEAST))
        if r.d:
            share = sums[("d", r.d)].sum() / sums[("spoken",)].sum()
            logs += np.maximum(np.log((sums[("d", r.d)] + op.DECLARED * share) / (sums[("spoken",)] + op.DECLARED)), np.log(op.LEAST))
        e = np.exp(logs - logs.max())
        want = dict(zip(model.languages, e / e.sum()))
        assert got[i].declared == r.d and got[i].host == r.h
        assert all(abs(got[i].posterior[k] - v) < 1e-9 for k, v in want.items())
        assert abs(got[i].confidence - max(want.values())) < 1e-9


def test_evidence_other_than_text_decides_where_text_is_missing(spark, model):
    german = "<html lang='de'><p>" + "und der die das ist nicht ein eine mit auf für " * 3 + "</p></html>"
    rows = [(i, "https://u:p@Blog.Zeitung.de:80/a", german, None) for i in range(40)]
    rows += [(100, "https://blog.zeitung.de", None, None), (101, "https://neu.zeitung.de", "", None), (102, None, '<html lang="de"></html>', None), (102, None, '<html lang="de"></html>', None)]
    got = {r.page_id: r for r in op.identify(spark.createDataFrame(rows, PAGES), model).collect()}
    assert {got[i].lang for i in (100, 101, 102)} == {"de"} and got[100].text_lang is None
    assert got[100].confidence > got[101].confidence * 0.99 and got[100].host == "blog.zeitung.de"


def test_empty_tables(spark, model, make_docs):
    assert op.identify(spark.createDataFrame([], PAGES), model).collect() == []
    none = op.train(make_docs([]))
    (row,) = op.identify(spark.createDataFrame([(1, "http://a.de", "x", None)], PAGES), none).collect()
    assert row.lang is None and row.confidence is None and row.host == "a.de"


def test_long_and_unclosed_markup(spark, model):
    rows = [(1, "http://a.fr", "<html lang=fr><p>" + "les des et que " * 60_000, None), (2, "x", "<script>" + "a<b " * 50_000, None), (3, "http://a.fr", "<" * 50_000, None)]
    assert {r.page_id: r.lang for r in op.identify(spark.createDataFrame(rows, PAGES), model).collect()}[1] == "fr"
