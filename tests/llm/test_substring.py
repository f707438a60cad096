"""Substring deduplication against all windows of all documents."""

import random

import pytest
from plain import SPACE_WORD, without_repeats

from faultline.llm import substring


def check(df, docs, window=20):
    got = {r.doc_id: r for r in substring.drop_repeats(df, window=window).collect()}
    want = without_repeats(docs, window)
    assert got.keys() == want.keys()
    for i, (n, kept) in want.items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (n, n - len(kept), " ".join(kept))
        words = SPACE_WORD.findall(docs[i] or "")
        for a, b in got[i].removed:
            words[a:b] = [None] * (b - a)
        assert [w for w in words if w is not None] == kept
    return got


def test_whole_table(documents, rows_of):
    got = check(documents, rows_of)
    assert sum(r.n_removed for r in got.values()) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_short_alphabet_overlaps_and_runs(make_docs, seed):
    pick = random.Random(seed)
    texts = [" ".join(pick.choice("ab") for _ in range(pick.randint(0, 60))) for _ in range(40)]
    texts += ["a " * 90, "\ta\x0b" * 40, "", "   ", None, "é " * 25 + "日本 " * 25, "é " * 25]
    df = make_docs(texts)
    check(df, dict(enumerate(texts)), window=4)
    check(df, dict(enumerate(texts)), window=20)


def test_one_passage_in_a_third_of_all_documents_and_one_long_document(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"own{i} start {passage} own{i} end" if i % 3 == 0 else f"text {i} " * 9 for i in range(90)]
    texts.append(" ".join(f"w{i % 5000}" for i in range(60_000)))
    check(make_docs(texts), dict(enumerate(texts)))


def test_repeated_rows_null_ids_and_other_columns(make_docs, spark):
    passage = " ".join(f"p{i}" for i in range(30))
    df = make_docs([(5, passage), (5, passage), (None, passage), (2, None)]).withColumnRenamed("source", "words")
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in substring.drop_repeats(df).collect())
    # The null id comes first and keeps its words.
    assert rows == [(False, 0, 0), (True, 2, 0), (True, 5, 30), (True, 5, 30)]
    again = substring.drop_repeats(make_docs([(5, passage), (5, passage)])).collect()
    assert sorted(r.n_removed for r in again) == [0, 30]


def test_empty_table_and_bad_window(make_docs):
    assert substring.drop_repeats(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        substring.drop_repeats(make_docs([]), window=5)
