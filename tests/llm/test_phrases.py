"""Collocations against counts of every phrase, cut and containment by hand."""

import random
import re
from collections import Counter

import numpy as np
from plain import LOWER
from pyspark.sql import functions as F

from faultline.llm import phrases, queries


def plain_counts(rows):
    """{lang: (n, {words: f})} for (text, lang) rows."""
    found = {}
    for text, lang in rows:
        n, counts = found.setdefault("und" if lang is None else lang, [0, Counter()])
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            found["und" if lang is None else lang][0] += len(words)
            for size in range(1, 6):
                counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return found


def plain_ranked(found, least, top, absorb=100):
    out = []
    for lang, (n, counts) in found.items():
        picked = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        rows = []
        for p, a in picked.items():
            inside = (
                100 * f >= absorb * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, f in picked.items()
                if len(q) > len(p)
            )
            if any(inside):
                continue
            cuts = [(1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def check(spark, rows, least, top=2000, **more):
    got = rows_of(phrases.collocations(table(spark, rows), least=least, top=top, **more))
    want = plain_ranked(plain_counts(rows), least, top, more.get("absorb", 100))
    assert got == want
    return got


def noise(seed, n):
    """Short texts over few words, in three languages and none, with separators, blanks and capitals."""
    pick = random.Random(seed)
    vocabulary = ["a", "B", "cc", "de", "en", "É", "日本", "x'y", "-", "\x00q"]
    marks = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "?!", "\x0b", " ; "]
    return [
        ("".join(pick.choice(vocabulary) + pick.choice(marks) for _ in range(pick.randint(0, 30))), pick.choice(["de", "en", None, "und"]))
        for _ in range(n)
    ]


def test_random_texts(spark):
    rows = noise(1, 150)
    assert len(check(spark, rows, least=3)) > 100
    check(spark, rows, least=2, top=7)
    check(spark, rows, least=4, absorb=60)
    check(spark, rows, least=1, top=100_000)


def test_a_filter_that_lets_everything_through_changes_nothing(spark, monkeypatch):
    rows = noise(2, 80)
    assert check(spark, rows, least=3) == check(spark, rows, least=3, filter_bits=1 << 15)
    monkeypatch.setattr(phrases, "_passes", lambda bits, hashes: np.ones(len(hashes), bool))
    check(spark, rows, least=3)
    full = phrases._Filter(spark, [(page, b"\xf0" * 4096) for page in range(2)] + [(0, b"\x0f" * 4096)], 1 << 16)
    assert (full._unpacked()[:4096].min(), full._unpacked()[4096:].max()) == (255, 0xF0)


def test_runs_of_one_word_a_passage_in_a_third_of_the_texts_and_a_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(f"own{i} {passage} {'go ' * (i % 9 + 2)}" if i % 3 == 0 else f"text {i}, ok ok", "en") for i in range(90)]
    rows.append((" ".join(f"w{i % 700}" for i in range(400_000)) + " ha" * 50_000, "en"))
    got = check(spark, rows, least=25)
    assert ("go go go go go" in {r[2] for r in got}) and ("ha ha ha ha ha" in {r[2] for r in got})


def test_slices_do_not_change_counts(spark, monkeypatch):
    rows = noise(3, 60)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 50)
    check(spark, rows, least=3)


def test_products_beyond_64_bits_and_a_tie_after_flooring(spark):
    huge = 3 * 10**15
    rows = [
        ("en", [], 0, 10**16 + 7),
        ("en", ["a"], 1, huge + 1), ("en", ["b"], 1, huge), ("en", ["c"], 1, huge + 2),
        ("en", ["a", "b"], 2, huge - 5), ("en", ["b", "c"], 2, huge - 5), ("en", ["a", "b", "c"], 3, huge - 6),
    ]
    got = rows_of(phrases.ranked(spark.createDataFrame(rows, "lang string, words array<string>, size int, f bigint")))
    found = {"en": [10**16 + 7, {tuple(w): f for _, w, k, f in rows if k}]}
    assert got == plain_ranked(found, 100, 2000) and len(got) == 3
    # Both cuts of the triple floor to the same score: the first counts.
    (triple,) = [r for r in got if r[2] == "a b c"]
    assert triple[4:6] == (huge + 1, huge - 5)


def test_nulls_empties_repeated_rows_empty_table_and_clashing_names(spark):
    rows = [(None, "en"), ("", None), ("One two", None), ("one two", "und"), ("one TWO", None), (" \t.\n", "xx")]
    got = check(spark, rows, least=2)
    assert got == [("und", 1, "one two", 3, 3, 3, 6, 2000)]
    clashing = table(spark, rows).withColumns({"w1": F.lit(1), "n": F.lit(2), "words": F.lit("z"), "F": F.lit(3)})
    assert rows_of(phrases.collocations(clashing, least=2)) == got
    assert check(spark, [], least=1) == []
    assert check(spark, [(None, None)], least=1) == []


def test_query_has_its_types(spark, folder):
    df = queries.QUERIES["op11_phrases"](spark, folder)
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5


def test_no_phrase_is_counted_by_two_passes(spark, monkeypatch):
    """Every word and pair comes from the first pass, longer phrases of frequent pairs and triples from one pass each."""
    rows = noise(4, 100) + [("a B cc de en", "de")] * 5
    texts = table(spark, rows).fillna("und", "lang")
    passes, given_out = [], type(texts).mapInArrow
    monkeypatch.setattr(type(texts), "mapInArrow", lambda df, *more, **named: passes.append(given_out(df, *more, **named)) or passes[-1])
    check(spark, rows, least=3)
    found = [
        {r.lang + "|" + r.phrase: r.n for r in p.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).collect()}
        for p in passes if p.columns == ["lang", "phrase", "n"]
    ]
    counts = {f"{lang}|{' '.join(p)}": f for lang, (_, c) in plain_counts(rows).items() for p, f in c.items()}
    sizes = [{len(k.split("|", 1)[1].split(" ")) for k in part if not k.endswith("|")} for part in found]
    assert sizes == [{1, 2}, {3}, {4, 5}]
    assert {k: f for k, f in found[0].items() if not k.endswith("|")} == {k: f for k, f in counts.items() if k.count(" ") < 2}
    assert all(counts[k] == f for part in found[1:] for k, f in part.items())
