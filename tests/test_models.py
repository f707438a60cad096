"""Scaling, correlation and classifiers against numpy and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.models import adaboost, discriminant, grid, mllib, neighbours
from faultline.operators import correlation, metrics, report, scaling
from faultline.plans import queries, workflow
from faultline.plans.scenarios import SCENARIOS, Job
from faultline.schema import WINDOW
from faultline.session import stage

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """Two shifted classes in three features, one constant feature, two folds."""
    rng = np.random.default_rng(5)
    label = np.arange(240) % 2
    x = rng.normal(size=(240, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.3], [0, 0, 1]])
    x += label[:, None] * np.array([2.0, -1.0, 1.5])
    pdf = pd.DataFrame(x * [1, 10, 0.1] + [0, 1e6, 5], columns=NAMES)
    pdf["flat"] = 0.1
    pdf["label"] = label.astype("int32")
    pdf["round"] = 1
    pdf["fold"] = (np.arange(240) // 2 % 3).astype("int32")
    pdf["class_id"], pdf["instance_id"], pdf["w"] = 4 * label, np.arange(240), 0
    pdf["case"] = "t"
    df = spark.createDataFrame(pdf)
    return pdf, stage(df.withColumn("fold", F.when(F.col("fold") < 2, F.col("fold"))))


def sides(pdf, fold):
    return pdf[pdf["fold"] != fold], pdf[pdf["fold"] == fold]


def test_scaler(table):
    pdf, df = table
    got = scaling.scaler_fit(df, [*NAMES, "flat"], 2).toPandas().set_index(["fold", "feature"])
    for fold in (0, 1):
        train, _ = sides(pdf, fold)
        for c in NAMES:
            assert got.loc[(fold, c), "mean"] == pytest.approx(train[c].mean())
            assert got.loc[(fold, c), "scale"] == pytest.approx(train[c].std(ddof=0))
        assert got.loc[(fold, "flat"), "scale"] == 1.0


def test_scaled_train_has_mean_0_and_deviation_1(table):
    _, df = table
    got = workflow.scaled_sides(df, NAMES, 2).where("split = 'train'").toPandas()
    for _, part in got.groupby("fold"):
        assert np.allclose(part[NAMES].mean(), 0, atol=1e-9)
        assert np.allclose(part[NAMES].std(ddof=0), 1)


def test_correlation(table):
    pdf, df = table
    got = correlation.pearson_matrix(df, [*NAMES, "flat"], 2).toPandas()
    assert len(got) == 2 * 2 * 6
    for row in got.itertuples():
        part = sides(pdf, row.fold)[row.split == "valid"]
        want = 0.0 if row.b == "flat" else np.corrcoef(part[row.a], part[row.b])[0, 1]
        assert row.r == pytest.approx(want, abs=1e-9) and row.n == len(part)


def test_p_values(spark):
    """Against a fine sum over the density of r under independence, (1 - r^2)^((n - 4) / 2), and at its ends."""
    cases = [(0.1, 20), (-0.5, 12), (0.9, 8), (0.02, 5000), (0.2, 5000), (0.3, 3), (1e-5, 10**10), (1.0, 9), (-1.0, 9), (0.0, 50), (0.7, 2)]
    df = spark.createDataFrame(cases, "r double, n bigint")
    for row in correlation.pearson_p(df).collect():
        if row.n == 2 or row.r == 0 or abs(row.r) == 1:
            want = float(row.n == 2 or row.r == 0)
        elif row.n == 10**10:  # r sqrt(n) is normal by then
            want = math.erfc(row.r * math.sqrt(row.n) / math.sqrt(2))
        else:
            t = np.linspace(0, math.pi / 2, 400_001)
            density = np.exp((row.n - 3) * np.log(np.maximum(np.cos(t), 1e-300)))
            want = np.trapezoid(np.where(t >= math.asin(abs(row.r)), density, 0), t) / np.trapezoid(density, t)
        assert row.p_value == pytest.approx(want, rel=2e-3, abs=1e-5), row


def numpy_discriminants(train, test):
    x, y, q = train[NAMES].to_numpy(), train["label"].to_numpy(), test[NAMES].to_numpy()
    part = {k: x[y == k] for k in (0, 1)}
    mean = {k: part[k].mean(axis=0) for k in part}
    cov = {k: np.cov(part[k].T) for k in part}
    pooled = sum((len(part[k]) - 1) * cov[k] for k in part) / (len(x) - 2)
    inverse = np.linalg.inv(pooled)
    linear, square = {}, {}
    for k in part:
        prior = math.log(len(part[k]) / len(x))
        linear[k] = q @ inverse @ mean[k] - 0.5 * mean[k] @ inverse @ mean[k] + prior
        gap = q - mean[k]
        form = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov[k]), gap)
        square[k] = prior - 0.5 * (np.linalg.slogdet(cov[k])[1] + form)
    return (linear[1] > linear[0]).astype(int), (square[1] > square[0]).astype(int)


def test_discriminants(table):
    pdf, df = table
    valid = df.where("fold is not null")
    keys = ["instance_id"]
    linear = discriminant.fit_linear(df, NAMES, 2)
    square = discriminant.fit_quadratic(df, NAMES, 2)
    got = [
        discriminant.predict_linear(valid, linear, NAMES, keys).toPandas(),
        discriminant.predict_quadratic(valid, square, NAMES, keys).toPandas(),
    ]
    for fold in (0, 1):
        train, test = sides(pdf, fold)
        for found, want in zip(got, numpy_discriminants(train, test)):
            own = found[found["fold"] == fold].sort_values("instance_id")
            assert (own["p"].to_numpy() == want).all()


def test_discriminants_survive_collinear_features(spark, table):
    _, df = table
    wide = df.withColumn("copy", F.col("a") * 2)
    names = [*NAMES, "copy", "flat"]
    valid = wide.where("fold is not null")
    for fit, predict in (
        (discriminant.fit_linear, discriminant.predict_linear),
        (discriminant.fit_quadratic, discriminant.predict_quadratic),
    ):
        plain = predict(valid, fit(df, NAMES, 2), NAMES, ["instance_id"]).toPandas()
        extra = predict(valid, fit(wide, names, 2), names, ["instance_id"]).toPandas()
        both = plain.merge(extra, on=["fold", "instance_id"])
        assert (both["p_x"] == both["p_y"]).all()


def cloud(spark, n=600, copies=200, seed=3):
    """Clustered points; one point repeated many times under both labels."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(scale=4, size=(6, 3))
    x = centre[rng.integers(0, 6, n)] + rng.normal(size=(n, 3))
    x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    pdf = pd.DataFrame(x, columns=NAMES)
    pdf["label"] = rng.integers(0, 2, len(x)).astype("int32")
    pdf["g"] = (np.arange(len(x)) % 2).astype("int32")
    pdf["id"] = np.arange(len(x))
    return pdf, spark.createDataFrame(pdf)


def brute_near(train, query, k):
    out = {}
    for q in query.itertuples():
        own = train[train["g"] == q.g]
        d = np.sqrt(((own[NAMES].to_numpy() - [q.a, q.b, q.c]) ** 2).sum(axis=1))
        out[q.id] = sorted(zip(np.round(d, 9), own["label"]))[:k]
    return out


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("blocked", [False, True])
def test_neighbours_against_brute_force(spark, k, blocked):
    pdf, df = cloud(spark)
    train, query = pdf[pdf["id"] % 3 > 0], pdf[pdf["id"] % 3 == 0]
    found = neighbours.neighbours(
        df.where("id % 3 > 0"),
        df.where("id % 3 = 0"),
        NAMES,
        ["id"],
        k,
        ["g"],
        point_rows=60 if blocked else neighbours.POINT_ROWS,
        query_rows=25 if blocked else neighbours.QUERY_ROWS,
    ).toPandas()
    got = {}
    for at, part in found.sort_values(["d", "label"]).groupby("id"):
        flat = [(round(r.d, 9), r.label) for r in part.itertuples() for _ in range(r.copies)]
        got[at] = flat[:k]
    assert got == brute_near(train, query, k)


def test_neighbours_in_thirty_dimensions(spark):
    rng = np.random.default_rng(8)
    names = [f"f{i}" for i in range(30)]
    pdf = pd.DataFrame(rng.normal(size=(500, 30)).round(2), columns=names)
    pdf["label"], pdf["id"] = rng.integers(0, 2, 500).astype("int32"), np.arange(500)
    pdf["g"] = 0
    df = spark.createDataFrame(pdf)
    found = neighbours.neighbours(
        df.where("id >= 100"), df.where("id < 100"), names, ["id"], 3, ["g"], point_rows=70, query_rows=30
    ).toPandas()
    x = pdf[names].to_numpy()
    d = np.sqrt(((x[:100, None] - x[None, 100:]) ** 2).sum(axis=2))
    for at, part in found.groupby("id"):
        assert np.allclose(np.sort(part["d"])[:3], np.sort(d[at])[:3])
    fewer = neighbours.neighbours(
        df.where("id >= 100"), df.where("id < 100"), names, ["id"], 1, ["g"], max_train_rows=50
    )
    assert fewer.select("id").distinct().count() == 100


def test_blocks_go_by_cores_not_by_shuffle_partitions(spark):
    sizes = spark.createDataFrame([(0, 500_000, 90_000), (1, 2_000_000, 10)], "g int, points long, queries long")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1000")
        rows = neighbours._block_counts(sizes, ["g"], 600_000, 50_000).orderBy("g").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    each = -(-neighbours.TURNS * spark.sparkContext.defaultParallelism // 2)
    assert [(r.point_blocks, r.query_blocks) for r in rows] == [(1, max(2, each)), (4, max(1, each))]


def test_blocks_are_read_not_copied_and_answers_are_a_row_per_query(spark):
    """However many blocks of points there are, the queries are exchanged once and nothing is multiplied before the search."""
    _, df = cloud(spark)
    train, query = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    found = neighbours.neighbours(train, query, NAMES, ["id"], 5, ["g"], point_rows=60, query_rows=25)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CoGroup" not in plan and "Window" not in plan
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    assert "Generate" not in below
    lists = neighbours.nearest(train, query, NAMES, ["id"], 5, ["g"], point_rows=60, query_rows=25)
    assert lists.count() == query.count()
    for ks in ([1, 3, 5],):
        a, b = (neighbours.vote_uniform(near, ks, ["id"], ["g"]) for near in (found, lists))
        assert sorted(a.collect()) == sorted(b.collect())
    a, b = (neighbours.vote_distance(near, 5, ["id"], ["g"]) for near in (found, lists))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == query.count()


def test_queries_of_equal_or_missing_keys_are_answered_together(spark):
    points = spark.createDataFrame([(0, 1, float(v)) for v in range(6)], "g int, label int, x double")
    rows = [(0, 1, 7, 0.0), (0, 1, 7, 5.0), (0, 0, 7, 2.0), (0, 1, None, 3.0), (1, 1, 8, 3.0), (None, 1, 9, 3.0)]
    asked = spark.createDataFrame(rows, "g int, label int, id int, x double")
    found = neighbours.neighbours(points, asked, ["x"], ["id"], 2, ["g"]).toPandas()
    got = {key: sorted(part["d"]) for key, part in found.groupby(["g", "id", "y"], dropna=False)}
    assert {(g, None if i != i else i, y): d for (g, i, y), d in got.items()} == {
        (0, 7, 1): [0.0, 0.0], (0, 7, 0): [0.0, 1.0], (0, None, 1): [0.0, 1.0],
    }


def test_votes(spark):
    rows = [
        (1, 0, 0.0, 1, 1), (1, 0, 0.1, 0, 5),
        (2, 1, 1.0, 1, 1), (2, 1, 2.0, 0, 2),
        (3, 1, 1.0, 0, 1), (3, 1, 1.0, 1, 1),
        (4, 1, 1.0, 0, 1), (4, 1, 1.1, 1, 9),
    ]
    near = spark.createDataFrame(rows, "id int, y int, d double, label int, copies long")
    voted = neighbours.vote_distance(near, 3, ["id"], []).toPandas().set_index("id")["p"]
    assert voted.to_dict() == {1: 1, 2: 0, 3: 0, 4: 1}
    plain = neighbours.vote_uniform(near, [1, 3], ["id"], []).toPandas()
    plain = plain.set_index(["id", "k"])["p"]
    assert plain.to_dict() == {
        (1, 1): 1, (1, 3): 0, (2, 1): 1, (2, 3): 0, (3, 1): 0, (3, 3): 0, (4, 1): 0, (4, 3): 1,
    }


@pytest.mark.parametrize("name", sorted(workflow.CLASSIFIERS))
def test_classifiers_beat_the_zero_rule_on_shifted_classes(table, name):
    if name == "ZERORULE":
        return
    _, df = table
    small = {"n_estimators": 5, "hidden_layer_sizes": 4, "max_iter": 40}
    known = grid.DEFAULTS.get(name, {})
    data = workflow.Folds(df, NAMES, Job(k=2))
    found = workflow.predictions(data, name, {c: v for c, v in small.items() if c in known})
    scored = metrics.scores(found, ["fold"]).toPandas()
    assert len(scored) == 2 and (scored["f1macro"] > 0.75).all()


def test_boosting_adds_stumps_until_it_fits(table):
    _, df = table
    scaled = stage(workflow.scaled_sides(df, NAMES, 2))
    by = ["round", "fold"]
    few = metrics.scores(adaboost.fit_predict(scaled, NAMES, WINDOW, 1, by), by).toPandas()
    many = metrics.scores(adaboost.fit_predict(scaled, NAMES, WINDOW, 30, by), by).toPandas()
    assert many["accuracy"].mean() >= few["accuracy"].mean()


def test_metrics_without_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "y int, p int")
    row = metrics.scores(df, []).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (2, 0, 1, 0)
    assert row.precision == 0 and row.recall == 0 and row.f1binp == 0
    assert row.f1macro == pytest.approx(0.4) and row.f1micro == pytest.approx(2 / 3)


def test_metrics_with_one_label_only(spark):
    row = metrics.scores(spark.createDataFrame([(0, 0), (0, 0)], "y int, p int"), []).first()
    assert row.f1macro == 1.0 and row.f1weighted == 1.0


def test_grid_combinations(spark):
    assert len(grid.combinations(grid.GRIDS["RF"])) == 20
    assert len(grid.combinations(grid.GRIDS["GBOOST"])) == 27
    assert grid.combinations({"a": [1, 2], "b": [3, 4]}, {"c": 5})[1] == {"a": 1, "b": 4, "c": 5}
    assert grid.configurations("1NN") == [{}]
    table = grid.param_grid(spark, ["KNN"]).toPandas()
    assert list(table["value"]) == ["1", "3", "5", "7", "10", "15"]


def test_library_grid_search(table):
    _, df = table
    data = workflow.Folds(df, NAMES, Job(k=2))
    configs = [{"max_depth": 1}, {"max_depth": 4}]
    summary = workflow.search_library(data, "DT", configs, inner=2)
    best = report.best_config(stage(summary), workflow.FOLD).toPandas()
    assert len(best) == 2 and best["mean_f1macro"].between(0.5, 1).all()


def test_depth_is_limited():
    assert mllib._depth(None) == mllib._depth(50) == 30 and mllib._depth(5) == 5


def test_results_with_search_fall_back_on_defaults(spark, folder):
    job = Job(size=20, step=20, classifiers=("ZERORULE", "KNN"), grid_search=True)
    made = queries._features(spark, folder)
    results = workflow.experiment_results(made, [SCENARIOS["1a"]], job).toPandas()
    assert set(results["classifier"]) == {"ZERORULE", "KNN"} and len(results) == 10
    assert (results["tp"] + results["fn"] == results["test_pos"]).all()
