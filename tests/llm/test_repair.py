"""Token shards against whole-text encoding, and exact round trips."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from faultline.llm import repair
from faultline.llm.common import folder_for
from faultline.llm.queries import END_ID, WORDS


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path(WORDS))


def test_words_encode_like_whole_texts(tokenizer):
    pick = random.Random(3)
    parts = list("aAzZ09'’s tT|<>.,;≠é́ÀÏ×÷İßΣς 　…\n\t\x85\x1c") + ["'s", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "👍", "ﬁ"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(30_000)] + ["", None]
    ids, borders = repair.encode_words(pa.array(texts), P.path(WORDS), END_ID)
    for k, (t, e) in enumerate(zip(texts, tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False))):
        assert ids[borders[k] : borders[k + 1]].tolist() == e.ids + [END_ID]


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_ranges(tmp_path, seed):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.4, 30_000).clip(0, 40_000 if seed else 70_000).astype(np.uint32)
    ids[500:900] = 7  # a run of one id
    base, rules, symbols = repair.compress(ids)
    assert len(rules) and len(symbols) < len(ids)
    assert (repair.expand(symbols, base, rules) == ids).all()
    sizes = repair.rule_sizes(base, rules)
    assert [len(repair.expand(np.array([base + k]), base, rules)) for k in range(len(rules))] == sizes.tolist()
    path = str(tmp_path / "one.ids")
    repair.write_shard(path, pa.array([4, None, 9], pa.int64()), ids, np.array([0, 10, 10, len(ids)]))
    shard = repair.Shard(path)
    assert shard.doc_ids.to_pylist() == [4, None, 9] and (shard.ids() == ids).all()
    for a, b in [(0, 0), (0, 1), (499, 901), (12_345, 12_346), (29_000, 40_000), *rng.integers(0, 30_000, (50, 2)).tolist()]:
        assert (shard.range(a, b) == ids[a:b]).all()


def test_no_ids_and_damaged_files(tmp_path):
    path = str(tmp_path / "none.ids")
    repair.write_shard(path, pa.array([], pa.int64()), np.zeros(0, np.uint32), np.zeros(1, np.int64))
    assert len(repair.Shard(path).ids()) == 0
    (tmp_path / "cut.ids").write_bytes((tmp_path / "none.ids").read_bytes()[:-3])
    with pytest.raises(ValueError):
        repair.Shard(str(tmp_path / "cut.ids"))


def test_table(spark, make_docs, tokenizer, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_BYTES", 200)
    rows = [(9, "nine " * 60), (2, None), (None, "first"), (5, ""), (5, ""), (7, "Seven, SEVEN's"), (-3, "minus")]
    files = repair.write_shards(make_docs(rows).withColumnRenamed("source", "ids"), folder_for(spark, "t"), P.path(WORDS), END_ID)
    got = sorted(repair.read_shards(files).collect(), key=lambda r: (r.start, r.doc_id))
    assert [r.doc_id for r in got] == [None, -3, 2, 5, 5, 7, 9]
    texts, at = dict(rows), 0
    for r in got:
        want = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [END_ID]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    empty = repair.write_shards(make_docs([]), folder_for(spark, "t"), P.path(WORDS), END_ID)
    assert repair.read_shards(empty).collect() == []
