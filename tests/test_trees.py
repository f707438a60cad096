"""The tree learner against a plain recursive one, however its nodes are dealt over tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.models import trees
from faultline.models.trees import Settings

NAMES = ["a", "b", "c", "d"]
BY = ["round", "fold"]


@pytest.fixture(scope="module")
def table(spark):
    """Noisy labels, few distinct values in one feature, a constant one, missing values; two folds of two rounds."""
    rng = np.random.default_rng(11)
    n = 500
    x = rng.normal(size=(n, 4))
    x[:, 1] = rng.integers(0, 3, n)
    x[:, 2] = 7.0
    x[rng.random(n) < 0.05, 3] = np.nan
    label = (x[:, 0] + 0.7 * x[:, 1] + rng.normal(size=n) > 0.7).astype("int32")
    pdf = pd.DataFrame(x, columns=NAMES).assign(label=label, w=np.arange(n), own=rng.integers(0, 3, n))
    df = spark.createDataFrame(pdf.astype({"own": "int32"}))
    df = df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in NAMES})
    rows = trees.binned(df, NAMES, ["w"])
    cells = rows.withColumn("round", F.explode(F.lit([1, 2]))).withColumn("fold", F.explode(F.lit([0, 1])))
    return cells.withColumn("split", F.when(F.col("own") == F.col("fold"), "valid").otherwise("train"))


def plain_tree(bins, label, w, rows, asked, path, depth, choice, out):
    """One node: a leaf's value for what is asked of it, or the two below."""
    total, ones = w[rows].sum(), (w[rows] * label[rows]).sum()
    best = None
    stop = choice.max_depth is not None and depth >= choice.max_depth
    if len(rows) >= choice.min_samples_split and 0 < ones < total and not stop:
        width = bins.shape[1]
        order = trees.tried(np.array([path]), width, choice.features)[0]
        for turn, f in enumerate(order):
            if turn >= (choice.features or width) and best is not None:
                break
            there = np.unique(bins[rows, f])
            if choice.splitter == "random":
                share = trees._even(trees._mix(np.array([path]) ^ trees._mix(np.array([f + 1], np.uint64) * trees._ODD)))[0]
                cuts = [int(there[0]) + int(share * (int(there[-1]) - int(there[0])))] if len(there) > 1 else []
            else:
                cuts = [(int(a) + int(b)) // 2 for a, b in zip(there, there[1:])]
            for cut in cuts:
                left = rows[bins[rows, f] <= cut]
                lw, lp = w[left].sum(), (w[left] * label[left]).sum()
                rw, rp = total - lw, ones - lp
                purity = trees._purity(choice.criterion, lw, lp, rw, rp)
                if best is None or purity > best[0]:
                    best = (purity, f, cut)
    if best is None:
        out[asked] = ones / max(total, 1e-300)
        return
    _, f, cut = best
    for low, below in zip((True, False), trees.children(np.array([path]))):
        plain_tree(bins, label, w, rows[(bins[rows, f] <= cut) == low], asked[(bins[asked, f] <= cut) == low], below, depth + 1, choice, out)


def plain_values(part, choice, seed):
    """The mean value over all trees of the rows of one cell that do not train."""
    part = part.sort_values("w").reset_index(drop=True)
    bins = np.array([list(b) for b in part["bins"]], np.int64)
    label, trains = part["label"].to_numpy(float), (part["split"] == "train").to_numpy()
    key = part["key"].to_numpy(np.int64).view(np.uint64)
    asked, values = np.flatnonzero(~trains), np.zeros(len(part))
    for root in trees.roots(seed, np.arange(choice.trees)):
        w = trees.drawn(key, root) if choice.bootstrap else np.ones(len(part))
        out = np.zeros(len(part))
        plain_tree(bins, label, w, np.flatnonzero(trains & (w > 0)), asked, root, 0, choice, out)
        values += out
    return part.loc[asked].assign(value=values[asked] / choice.trees)


CHOICES = {
    "whole": Settings(),
    "entropy": Settings(criterion="entropy", min_samples_split=9),
    "random": Settings(splitter="random", max_depth=4),
    "forest": Settings(trees=20, features=1, bootstrap=True),
    "shallow": Settings(trees=3, features=2, bootstrap=True, max_depth=3),
    "stump": Settings(max_depth=0),
}


@pytest.mark.parametrize("name", CHOICES)
@pytest.mark.parametrize("local", [50_000, 40])
def test_against_a_plain_learner(table, name, local, monkeypatch):
    """With 40 rows a task the tops of all trees are grown by passes, a few open nodes at a time."""
    choice = CHOICES[name]
    monkeypatch.setattr(trees, "OPEN_NODES", 7)
    if local == 40 and choice.trees > 3:
        choice = Settings(trees=4, features=1, bootstrap=True)
    got = trees.fit_predict(table, ["w"], choice, BY, local_rows=local).toPandas().set_index([*BY, "w"]).sort_index()
    pdf = table.toPandas()
    assert len(got) == (pdf["split"] != "train").sum() and (got["train_seconds"] >= 0).all()
    for cell, part in pdf.groupby(BY):
        want = plain_values(part, choice, int(cell[0]))
        mine = got.loc[cell].loc[want["w"]]
        assert (mine["p"].to_numpy() == (want["value"] > 0.5 + 1e-9)).all()
        assert (mine["y"].to_numpy() == want["label"]).all()


def test_a_cell_that_a_task_can_hold_is_not_written_per_tree(table, monkeypatch):
    choice = Settings(trees=5, features=2, bootstrap=True)
    whole = trees.fit_predict(table, ["w"], choice, BY).toPandas().set_index(["w", *BY])["p"].sort_index()

    def top(*_):
        raise AssertionError("rows are written once per tree")

    monkeypatch.setattr(trees, "_Top", top)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 40)
    got = trees.fit_predict(table, ["w"], choice, BY).toPandas().set_index(["w", *BY])["p"].sort_index()
    assert got.equals(whole)


def test_rounds_draw_other_forests_and_rows_do_not_depend_on_order(table):
    choice = Settings(trees=5, features=2, bootstrap=True)
    got = trees.fit_predict(table, ["w"], choice, BY).toPandas().set_index(["w", *BY])["p"].sort_index()
    again = trees.fit_predict(table.repartition(5, "c" if "c" in table.columns else "w"), ["w"], choice, BY)
    assert got.equals(again.toPandas().set_index(["w", *BY])["p"].sort_index())
    one, two = (got.xs(r, level="round") for r in (1, 2))
    assert (one != two).any()


def plain_boost(bins, label, trains, choice, seed):
    odds = np.full(len(label), np.log(label[trains].mean() / (1 - label[trains].mean())))

    def node(left, rows, everyone, depth, step, curve):
        best = None
        if depth < choice.max_depth and np.ptp(left[rows]) > 1e-9:
            for f in range(bins.shape[1]):
                there = np.unique(bins[rows, f])
                for cut in [(int(a) + int(b)) // 2 for a, b in zip(there, there[1:])]:
                    low = left[rows[bins[rows, f] <= cut]]
                    high = left[rows[bins[rows, f] > cut]]
                    gain = low.sum() ** 2 / len(low) + high.sum() ** 2 / len(high)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, cut)
        if best is None:
            step[everyone] = left[rows].sum() / curve[rows].sum()
            return
        _, f, cut = best
        for low in (True, False):
            node(left, rows[(bins[rows, f] <= cut) == low], everyone[(bins[everyone, f] <= cut) == low], depth + 1, step, curve)

    for _ in range(choice.trees):
        chance = 1 / (1 + np.exp(-odds))
        step = np.zeros(len(label))
        node(label - chance, np.flatnonzero(trains), np.arange(len(label)), 0, step, chance * (1 - chance))
        odds = odds + choice.rate * step
    return odds


def test_boosting_against_a_plain_one(table):
    choice = Settings(trees=15, max_depth=2, boosted=True)
    got = trees.fit_predict(table, ["w"], choice, BY).toPandas().set_index([*BY, "w"])
    for cell, part in table.toPandas().groupby(BY):
        part = part.sort_values("w")
        bins = np.array([list(b) for b in part["bins"]], np.int64)
        trains = (part["split"] == "train").to_numpy()
        odds = plain_boost(bins, part["label"].to_numpy(float), trains, choice, 1)
        sure = ~trains & (np.abs(odds) > 1e-6)
        assert (got.loc[cell].loc[part["w"][sure], "p"].to_numpy() == (odds[sure] > 0)).all()
        # Better than the larger label alone.
        y = part["label"][~trains]
        assert (got.loc[cell].loc[part["w"][~trains], "p"].to_numpy() == y).mean() > max(y.mean(), 1 - y.mean()) + 0.05


def test_a_cell_of_one_label_an_empty_training_side_and_an_empty_table(spark, table):
    one = table.where("label = 1 or split != 'train'")
    for choice in (Settings(), Settings(trees=2, bootstrap=True), Settings(trees=3, boosted=True, max_depth=2)):
        assert set(trees.fit_predict(one, ["w"], choice, BY).toPandas()["p"]) == {1}
        assert set(trees.fit_predict(table.where("split != 'train'"), ["w"], choice, BY).toPandas()["p"]) == {0}
        assert trees.fit_predict(table.where("w < 0"), ["w"], choice, BY).collect() == []
    empty = spark.createDataFrame([], "a double, label int, w bigint")
    assert trees.binned(empty, ["a"], ["w"]).collect() == []


def test_settings():
    assert trees.settings("RF", {"n_estimators": 100, "max_depth": None}, 30) == Settings(trees=100, features=5, bootstrap=True)
    deep = trees.settings("DT", {"criterion": "gini", "splitter": "random", "max_depth": 50, "min_samples_split": 5}, 30)
    assert (deep.max_depth, deep.min_samples_split, deep.splitter) == (50, 5, "random")
    with pytest.raises(ValueError):
        trees.settings("SVM", {}, 30)


def test_a_line_of_rows_gives_a_tree_deeper_than_any_bound(spark):
    """Alternating labels along one feature: sixty levels where cuts peel off one row at a time."""
    n = 120
    pdf = pd.DataFrame({"a": np.arange(n, dtype=float), "label": (np.arange(n) % 2).astype("int32"), "w": np.arange(n)})
    rows = trees.binned(spark.createDataFrame(pdf), ["a"], ["w"]).withColumns({"round": F.lit(1), "fold": F.lit(0), "split": F.lit("train")})
    both = rows.unionByName(rows.withColumn("split", F.lit("valid")))
    got = trees.fit_predict(both, ["w"], Settings(), BY).toPandas().sort_values("w")
    assert (got["p"].to_numpy() == np.arange(n) % 2).all()


def test_cuts_lie_in_the_middle_of_values_not_of_bins(spark):
    """Rows to predict on both sides of a wide gap, one bin to the right of those that train or eight to its left."""
    own = [(1.0, 0, "train"), (9.0, 0, "valid"), (1041.0, 1, "valid"), (1045.0, 1, "train"), (None, 0, "valid")]
    own += [(2.0 + k, 0, "valid") for k in range(7)]
    for sign in (1, -1):
        rows = [(sign * a if a is not None else None, label, w, split) for w, (a, label, split) in enumerate(own)]
        df = spark.createDataFrame(rows, "a double, label int, w bigint, split string")
        tops = trees.bin_tops(df, ["a"])
        cells = trees.binned(df, ["a"], ["w"], tops).withColumns({"round": F.lit(1), "fold": F.lit(0)})
        for config in ("DT", {"criterion": "gini"}), ("GBOOST", {"n_estimators": 2, "max_depth": 1}):
            choice = trees.settings(*config, 1, tops)
            for local in (None, 1):
                if choice.boosted and local:
                    continue
                got = trees.fit_predict(cells, ["w"], choice, BY, local_rows=local).where("w != 4").toPandas()
                assert len(got) == 9 and (got["p"] == got["y"]).all()


def test_middle_of_values_among_bins():
    tops = np.array([[1.0, 2.0, 3.0, 10.0, 11.0, np.inf], [-np.inf, 0.0, 5.0, 6.0, np.inf, np.inf]])
    feature, low, high = np.array([0, 0, 0, 1, 1]), np.array([0, 2, 3, 0, 1]), np.array([4, 4, 5, 5, 3])
    assert trees._middle(tops, feature, low, high).tolist() == [2, 2, 4, 0, 1]


@pytest.mark.parametrize("choice", [trees.Settings(features=3), trees.Settings(criterion="entropy", min_samples_split=7), trees.Settings(max_depth=4, features=2)])
def test_labels_are_cut_without_wide_sums_and_part_by_part(monkeypatch, choice):
    """Drawn rows of labels grow by short sorts, in parts of a level; the leaves are those of the plain way."""
    rng = np.random.default_rng(5)
    bins = rng.integers(0, [3, 40, 256, 256, 7], (4000, 5)).astype(np.uint8)
    label = (rng.random(4000) < 0.2 + 0.6 * (bins[:, 2] > 90)).astype(float)
    row, asked = np.tile(np.arange(3000), 2), np.tile(np.arange(3000, 4000), 2)
    node, asked_node, w = np.repeat([0, 1], 3000), np.repeat([0, 1], 1000), rng.integers(1, 4, 6000).astype(float)
    args = bins, label, row, node, w, asked, asked_node, trees.roots(3, np.arange(2)), 0, choice
    plain = trees.finish(*args, share=w)
    parts = []
    cut = trees._Part.cut
    monkeypatch.setattr(trees, "_sums", None)
    monkeypatch.setattr(trees, "NEAR", 300)
    monkeypatch.setattr(trees._Part, "cut", lambda self, width: parts.append(cut(self, width)) or parts[-1])
    np.testing.assert_array_equal(trees.finish(*args), plain)
    assert max(map(len, parts)) > 1
