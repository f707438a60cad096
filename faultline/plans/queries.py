"""One query per operator, each over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.functions import names
from faultline.models import grid, neighbours
from faultline.operators import (
    clean,
    correlation,
    entropy,
    fill,
    folds,
    metrics,
    ordering,
    report,
    scaling,
    windows,
)
from faultline.plans import workflow
from faultline.plans.scenarios import SCENARIOS, Job
from faultline.schema import RECORDING, TEST_WELLS, VARIABLES, WINDOW
from faultline.session import new_folder, stage
from faultline.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

JOB = Job(size=20, step=20, classifiers=("ZERORULE", "1NN", "GNB"))
SLIDE = 5
K = 5
SKIPPED = [3, 6]
ENTROPY_M = 2
TOLERANCE = {"v1": 10.0, "v2": 10.0, "v3": 0.0201, "v4": 0.0201, "v5": 1.0}
FEATURES = windows.feature_names()
#: Features that no rounding of a sum touches; the others are shown to fewer digits.
EXACT = [c for c in FEATURES if c.endswith(("_max", "_min", "_median"))]
FOLD = ["round", "fold"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- shared inputs -------------------------------------------------------------------------------


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return tables.lineitem_readings(spark, folder)


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return workflow.clean_readings(_raw(spark, folder), VARIABLES)


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return stage(workflow.features_of(_clean(spark, folder), JOB))


def _folded(spark: SparkSession, folder: str, case: str = "1a", job: Job = JOB) -> DataFrame:
    return stage(workflow.folds_of(_features(spark, folder), SCENARIOS[case], job))


def _data(spark: SparkSession, folder: str, case: str = "1a", job: Job = JOB) -> workflow.Folds:
    folded = workflow.folds_of(_features(spark, folder), SCENARIOS[case], job)
    return workflow.Folds(folded, FEATURES, job)


def _line_keys() -> list:
    return [
        *RECORDING,
        F.col("seq.l_orderkey"),
        F.col("seq.l_linenumber"),
        F.col("seq.l_partkey"),
        F.col("seq.l_extendedprice"),
    ]


def _rounded(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Features in fixed digits: 4 for deviations and variances, 7 for the rest."""
    own = columns or [c for c in df.columns if c not in keys]
    digits = {c: 4 if c.endswith(("_std", "_var")) else 7 for c in own}
    return df.select(*keys, *(F.round(c, d).alias(c) for c, d in digits.items()))


def _predicted(found: DataFrame) -> DataFrame:
    return found.select(*FOLD, *WINDOW, "y", "p")


def _round_scores(df: DataFrame) -> DataFrame:
    measured = [
        "precision", "recall", "f1binp", "f1binn", "f1micro", "f1macro", "f1weighted", "accuracy",
    ]
    return df.withColumns({c: F.round(c, 6) for c in measured if c in df.columns})


# ---- readings ------------------------------------------------------------------------------------


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with recording names: even suppliers real, odd ones simulated."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    prefix = F.when(F.col("l_suppkey") % 2 == 0, "WELL-").otherwise("SIMULATED-")
    number = F.lpad(F.col("l_suppkey").cast("string"), 5, "0")
    stamp = F.date_format("l_shipdate", "yyyyMMddHHmmss")
    name = F.concat(prefix, number, F.lit("_"), stamp)
    return lines.select("l_orderkey", "l_linenumber", "l_shipdate", name.alias("instance_id"))


@query
def real_recordings(spark, folder):
    return (
        _named(spark, folder)
        .where(names.is_real(F.col("instance_id")))
        .groupBy("instance_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def name_parts(spark, folder):
    real = _named(spark, folder).where(names.is_real(F.col("instance_id")))
    name = F.col("instance_id")
    return real.groupBy(
        names.well_key(name).alias("well_key"), names.well_number(name).alias("well_id")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def epoch_seconds(spark, folder):
    text = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", names.epoch_seconds(text).alias("seconds"))


@query
def session_stamp(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select("event_id", names.session_stamp(F.col("ts")).alias("stamp"))


@query
def one_hot(spark, folder):
    hot = names.one_hot(F.col("class_id"), 9)
    per_class = _raw(spark, folder).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return per_class.withColumn("hot", hot).select(
        "class_id", "n", *(F.col("hot")[i].alias(f"h{i}") for i in range(9))
    )


@query
def one_hot_inverse(spark, folder):
    hot = names.one_hot(F.col("class_id"), 9)
    back = names.one_hot_inverse(hot).alias("class_back")
    return _raw(spark, folder).groupBy("class_id", back).agg(F.count(F.lit(1)).alias("n"))


@query
def rows_per_instance(spark, folder):
    return _raw(spark, folder).groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n"))


@query
def rows_per_well(spark, folder):
    return _raw(spark, folder).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"))


@query
def drop_incomplete(spark, folder):
    return _clean(spark, folder).select(*_line_keys(), *VARIABLES)


@query
def clean_readings(spark, folder):
    kept = _clean(spark, folder)
    return kept.groupBy(*RECORDING, "well_id").agg(
        F.count(F.lit(1)).alias("n"), *(F.round(F.avg(v), 7).alias(f"{v}_mean") for v in VARIABLES)
    )


@query
def labelled(spark, folder):
    s = SCENARIOS["1b"]
    rows = clean.labelled(_clean(spark, folder), s.positive, s.negative)
    return rows.groupBy("class_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def union_labelled(spark, folder):
    rows = _clean(spark, folder)
    both = clean.union_labelled(rows.where("class_id = 0"), rows.where("class_id = 4"))
    return both.select(*_line_keys(), "label", *VARIABLES)


@query
def cast_float(spark, folder):
    narrow = clean.cast_float(_clean(spark, folder), VARIABLES)
    return narrow.select(*_line_keys(), *(F.col(v).cast("double").alias(v) for v in VARIABLES))


@query
def cast_float_features(spark, folder):
    """Every feature through float32, shown to 5 significant digits, those that hang on sums to 3 decimals."""
    made = clean.cast_float(_features(spark, folder), FEATURES)

    def shown(c: str):
        wide = F.col(c).cast("double")
        return F.format_string("%.4e", wide).cast("double") if c in EXACT else F.round(wide, 3)

    return made.select(*WINDOW, *(shown(c).alias(c) for c in FEATURES))


def _dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with missing, NaN, infinite and oversized cells."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    q, tax, discount = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    a = F.when(q == 1, nan).when(q == 2, inf).when(q == 3, -inf).when(q == 4, 4e38).otherwise(q)
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        a.alias("a"),
        F.nullif(discount, F.lit(0.0)).alias("b"),
        F.when(tax == 0, -4e38).otherwise(tax).alias("c"),
    )


@query
def mask_nonfinite(spark, folder):
    return clean.mask_nonfinite(_dirty(spark, folder), ["a", "b", "c"])


@query
def nonfinite_flag(spark, folder):
    flagged = clean.flag_nonfinite(_dirty(spark, folder), ["a", "b", "c"])
    return flagged.groupBy("l_suppkey", "bad").agg(F.count(F.lit(1)).alias("n"))


@query
def quality_audit(spark, folder):
    return clean.quality_audit(_dirty(spark, folder), ["a", "b", "c"])


@query
def forward_fill(spark, folder):
    return fill.forward_fill(_raw(spark, folder)).select(*_line_keys(), *VARIABLES)


@query
def row_positions(spark, folder):
    return ordering.positions(_clean(spark, folder)).select(*_line_keys(), "pos", "n_rows")


@query
def clean_table(spark, folder):
    """Write the clean readings with their positions, partitioned by class, and read them back."""
    path = new_folder(spark, "clean")
    tables.write_partitioned(workflow.clean_table(_raw(spark, folder), VARIABLES), path, ["class_id"])
    return spark.read.parquet(path).select(*_line_keys(), "well_id", "pos", "n_rows", *VARIABLES)


@query
def instance_offsets(spark, folder):
    s = SCENARIOS["1b"]
    rows = clean.labelled(_clean(spark, folder), s.positive, s.negative)
    sizes = rows.groupBy("label", *RECORDING).agg(F.count(F.lit(1)).alias("n"))
    return ordering.exclusive_sum(sizes, ["label"], RECORDING, "n", "offset_rows")


# ---- windows -------------------------------------------------------------------------------------


@query
def window_count(spark, folder):
    sizes = _clean(spark, folder).groupBy(*RECORDING).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return sizes.select(
        *RECORDING,
        "n",
        windows.window_count(n, JOB.size, JOB.step).alias("tumbling"),
        windows.window_count(n, JOB.size, SLIDE).alias("sliding"),
        windows.window_count(n, JOB.size, SLIDE, drop_last=False).alias("sliding_all"),
    )


@query
def window_features_tumbling(spark, folder):
    made = windows.window_features(_clean(spark, folder), JOB.size, JOB.step)
    return _rounded(made, [*RECORDING, "well_id", "w"])


@query
def window_features_dense(spark, folder):
    """Windows of 900 rows at every row, each class one long recording."""
    rows = _clean(spark, folder).withColumn("instance_id", F.col("class_id").cast("bigint"))
    made = windows.window_features(rows, 900, 1, ["v1", "v2"], keep=())
    return _rounded(made, WINDOW)


@query
def window_features_sliding(spark, folder):
    made = windows.window_features(_clean(spark, folder), JOB.size, SLIDE)
    return _rounded(made, [*RECORDING, "well_id", "w"])


@query
def window_features_events(spark, folder):
    readings = tables.event_readings(spark, folder)
    made = windows.window_features(readings, JOB.size, SLIDE, ["v1"], keep=())
    return _rounded(made, WINDOW)


@query
def window_features_concat(spark, folder):
    s = SCENARIOS["1b"]
    rows = clean.labelled(_clean(spark, folder), s.positive, s.negative)
    return _rounded(
        windows.window_features_concat(rows, JOB.size, JOB.step, ["label"]), ["label", "w"]
    )


@query
def window_features_concat_wells(spark, folder):
    made = workflow.concat_well_folds(_clean(spark, folder), SCENARIOS["2a"], JOB)
    return _rounded(made, ["fold", "split", "label", "w"])


@query
def feature_subset(spark, folder):
    made = windows.window_features(_clean(spark, folder), JOB.size, JOB.step)
    return _rounded(windows.select_variables(made, WINDOW, ["v1", "v3"]), WINDOW)


@query
def stat_subset(spark, folder):
    made = windows.window_features(_clean(spark, folder), JOB.size, JOB.step)
    return _rounded(windows.select_statistics(made, WINDOW, ["mean", "std", "var"]), WINDOW)


@query
def sample_entropy(spark, folder):
    made = entropy.sample_entropy(
        _clean(spark, folder), JOB.size, JOB.step, ENTROPY_M, TOLERANCE
    )
    return made.withColumns({f"{v}_entropy": F.round(f"{v}_entropy", 6) for v in VARIABLES})


# ---- folds ---------------------------------------------------------------------------------------


def _labelled_windows(spark: SparkSession, folder: str, case: str = "1a") -> DataFrame:
    s = SCENARIOS[case]
    made = _features(spark, folder).select(*RECORDING, "well_id", "w")
    return clean.labelled(made, s.positive, s.negative)


@query
def kfold_shuffled(spark, folder):
    return folds.kfold_shuffled(_labelled_windows(spark, folder), K)


@query
def kfold_rounds(spark, folder):
    drawn = folds.kfold_shuffled(_labelled_windows(spark, folder), K, rounds=3)
    return drawn.select("round", *WINDOW, "label", "fold")


@query
def kfold_contiguous(spark, folder):
    return folds.kfold_contiguous(_labelled_windows(spark, folder, "1b"), K)


@query
def ceil_blocks(spark, folder):
    return folds.ceil_blocks(_labelled_windows(spark, folder, "1b"), K)


def _labelled_recordings(spark: SparkSession, folder: str) -> DataFrame:
    s = SCENARIOS["1b"]
    rows = clean.labelled(_clean(spark, folder), s.positive, s.negative)
    return rows.groupBy(*RECORDING, "label").agg(F.count(F.lit(1)).alias("n"))


@query
def kfold_sessions(spark, folder):
    return folds.kfold_recordings(_labelled_recordings(spark, folder), K, rounds=2)


@query
def kfold_sessions_contiguous(spark, folder):
    return folds.kfold_recordings(_labelled_recordings(spark, folder), K, shuffle=False)


def _first_fold(spark: SparkSession, folder: str) -> DataFrame:
    drawn = folds.kfold_recordings(_labelled_recordings(spark, folder), K)
    return drawn.where("fold = 0")


@query
def session_semi(spark, folder):
    made = _labelled_windows(spark, folder, "1b")
    return folds.on_recordings(made, _first_fold(spark, folder), inside=True)


@query
def session_anti(spark, folder):
    made = _labelled_windows(spark, folder, "1b")
    return folds.on_recordings(made, _first_fold(spark, folder), inside=False)


@query
def leave_one_well_out(spark, folder):
    drawn = folds.leave_one_well_out(_labelled_windows(spark, folder, "2b"))
    return folds.expand_folds(drawn, len(TEST_WELLS))


@query
def fold_expand(spark, folder):
    drawn = folds.kfold_shuffled(_labelled_windows(spark, folder), K)
    return folds.expand_folds(drawn, K).select(*FOLD, *WINDOW, "label", "split")


@query
def inner_folds(spark, folder):
    drawn = folds.kfold_shuffled(_labelled_windows(spark, folder), K)
    return folds.inner_folds(drawn, K).select(*FOLD, *WINDOW, "label", "inner")


@query
def skip_wells(spark, folder):
    return folds.skip_wells(_labelled_windows(spark, folder, "1b"), SKIPPED)


@query
def fold_health(spark, folder):
    made = _labelled_windows(spark, folder, "2b")
    wells = [1, 2, 4, 5, 17]
    return folds.fold_health(folds.leave_one_well_out(made, wells), len(wells)).withColumns(
        {c: F.col(c).cast("int") for c in ("empty_test", "more_positives")}
    )


@query
def sample_order(spark, folder):
    return folds.sample_order(_labelled_windows(spark, folder), seed=1)


@query
def fold_slice(spark, folder):
    """Write a fold table, partitioned, then read one fold of it back."""
    path = new_folder(spark, "folds")
    both = folds.expand_folds(workflow.folds_of(_features(spark, folder), SCENARIOS["1a"], JOB), K)
    tables.write_partitioned(both, path, ["case", *FOLD])
    part = tables.read_fold(spark, path, "1a", 1, 2)
    return _rounded(part, ["case", *FOLD, "split", *RECORDING, "well_id", "w", "label"], FEATURES)


@query
def folds_1a(spark, folder):
    return _fold_rows(spark, folder, "1a")


@query
def folds_1b(spark, folder):
    return _fold_rows(spark, folder, "1b")


@query
def folds_2a(spark, folder):
    return _fold_rows(spark, folder, "2a")


@query
def folds_2b(spark, folder):
    return _fold_rows(spark, folder, "2b")


def _fold_rows(spark: SparkSession, folder: str, case: str) -> DataFrame:
    folded = workflow.folds_of(_features(spark, folder), SCENARIOS[case], JOB)
    both = folds.expand_folds(folded, SCENARIOS[case].folds(JOB))
    return _rounded(both, [*FOLD, "split", *WINDOW, "label"], FEATURES)


# ---- scaling and correlation ---------------------------------------------------------------------


@query
def scaler_fit(spark, folder):
    fitted = scaling.scaler_fit(_folded(spark, folder), FEATURES, K)
    # Means end by the eighth digit, so at nine no tie is left to the order of summing.
    return fitted.withColumns({"mean": F.round("mean", 9), "scale": F.round("scale", 6)})


@query
def standardize(spark, folder):
    scaled = workflow.scaled_sides(_folded(spark, folder), FEATURES, K)
    keys = [*FOLD, "split", *WINDOW, "label"]
    return scaled.select(*keys, *(F.round(c, 4).alias(c) for c in FEATURES))


@query
def pearson_matrix(spark, folder):
    pairs = correlation.pearson_matrix(_folded(spark, folder), FEATURES, K)
    return pairs.withColumn("r", F.round("r", 6))


@query
def pearson_f(spark, folder):
    pairs = correlation.pearson_f(
        correlation.pearson_matrix(_folded(spark, folder), FEATURES, K)
    )
    return pairs.select(*FOLD, "split", "a", "b", F.round("f_stat", 4).alias("f_stat"))


@query
def pearson_p(spark, folder):
    pairs = correlation.pearson_matrix(_folded(spark, folder), FEATURES, K)
    return correlation.pearson_p(pairs).withColumns(
        {c: F.round(c, 6) for c in ("r", "p_value")}
    )


# ---- classifiers ---------------------------------------------------------------------------------


def _classified(classifier: str) -> Query:
    def run(spark, folder):
        return _predicted(workflow.predictions(_data(spark, folder), classifier))

    return run


for _name, _classifier in {
    "zero_rule": "ZERORULE",
    "knn1_predict": "1NN",
    "knn3_predict": "3NN",
    "knn5_predict": "5NN",
    "gnb_predict": "GNB",
    "lda_predict": "LDA",
    "qda_predict": "QDA",
}.items():
    QUERIES[_name] = _classified(_classifier)


@query
def knn_uniform(spark, folder):
    data = _data(spark, folder)
    ks = [c["n_neighbors"] for c in grid.configurations("KNN")]
    voted = neighbours.vote_uniform(
        workflow.near(data, max(ks)), ks, workflow.KEYS, workflow.FOLD
    )
    return voted.select(*FOLD, *WINDOW, "config", "k", "y", "p")


for _name, _classifier in {
    "tree_predict": "DT",
    "forest_predict": "RF",
    "gbt_predict": "GBOOST",
    "adaboost_predict": "ADA",
    "mlp_predict": "MLP",
    "svc_linear_predict": "SVM",
}.items():
    QUERIES[_name] = _classified(_classifier)


def _separable(spark: SparkSession, folder: str) -> DataFrame:
    """The readings with all variables of the fault class raised: every window can be told apart."""
    raised = F.when(F.col("class_id") == 4, 1000.0).otherwise(0.0)
    rows = _raw(spark, folder).withColumns({v: F.col(v) + raised for v in VARIABLES})
    return workflow.features_of(workflow.clean_readings(rows, VARIABLES), JOB)


def _told_apart(classifier: str) -> Query:
    def run(spark, folder):
        folded = workflow.folds_of(_separable(spark, folder), SCENARIOS["1a"], JOB)
        return _predicted(workflow.predictions(workflow.Folds(folded, FEATURES, JOB), classifier))

    return run


SEPARABLE = {
    "tree_separable": "DT",
    "forest_separable": "RF",
    "gbt_separable": "GBOOST",
    "adaboost_separable": "ADA",
    "mlp_separable": "MLP",
    "svc_linear_separable": "SVM",
    "lda_separable": "LDA",
    "qda_separable": "QDA",
}
for _name, _classifier in SEPARABLE.items():
    QUERIES[_name] = _told_apart(_classifier)


def _scored(classifier: str) -> Query:
    def run(spark, folder):
        found = workflow.predictions(_data(spark, folder), classifier)
        return _round_scores(metrics.scores(found, FOLD))

    return run


for _name, _classifier in {
    "score_zero_rule": "ZERORULE",
    "score_knn1": "1NN",
    "score_gnb": "GNB",
    "score_lda": "LDA",
    "score_qda": "QDA",
}.items():
    QUERIES[_name] = _scored(_classifier)


# ---- measures ------------------------------------------------------------------------------------


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a binary prediction problem, one group per supplier."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.select(
        "l_suppkey",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_quantity") > 40).cast("int").alias("p"),
    )


@query
def confusion(spark, folder):
    return metrics.confusion(_judged(spark, folder), ["l_suppkey"])


@query
def binary_prf(spark, folder):
    counts = metrics.confusion(_judged(spark, folder), ["l_suppkey"])
    return _round_scores(metrics.binary_prf(counts))


@query
def f1_averages(spark, folder):
    counts = metrics.confusion(_judged(spark, folder), ["l_suppkey"])
    return _round_scores(metrics.f1_averages(counts))


@query
def accuracy(spark, folder):
    counts = metrics.confusion(_judged(spark, folder), ["l_suppkey"])
    return _round_scores(metrics.accuracy(counts))


# ---- results -------------------------------------------------------------------------------------

_RESULT_COLUMNS = [
    "experiment", "case", "round", "fold", "classifier", "config", "f1binp", "f1binn", "f1micro",
    "f1macro", "f1weighted", "precision", "recall", "accuracy", "train_neg", "train_pos",
    "test_neg", "test_pos", "pred_neg", "pred_pos", "tp", "tn", "fp", "fn",
]


@query
def fold_scores_1a(spark, folder):
    made = _features(spark, folder)
    results = workflow.experiment_results(made, [SCENARIOS["1a"]], JOB)
    return _round_scores(results.select("classifier", *FOLD, "f1macro", "accuracy"))


@query
def experiment_results(spark, folder):
    made = _features(spark, folder)
    results = workflow.experiment_results(made, [SCENARIOS["1a"]], JOB)
    return _round_scores(results.select(*_RESULT_COLUMNS))


@query
def experiment_absent_well(spark, folder):
    """A well that is validated in one fold has no readings: the fold still has its rows."""
    job = Job(size=20, step=20, classifiers=("ZERORULE", "GNB"))
    made = _features(spark, folder).where(F.col("well_id") != 7)
    results = workflow.experiment_results(made, [SCENARIOS["2a"]], job)
    return _round_scores(results.select(*_RESULT_COLUMNS, "empty_test", "empty_train"))


def _all_results(spark: SparkSession, folder: str, rounds: int = 1) -> DataFrame:
    job = Job(size=20, step=20, rounds=rounds, classifiers=("ZERORULE", "GNB"))
    made = _features(spark, folder)
    return workflow.experiment_results(made, list(SCENARIOS.values()), job)


def _round_pivot(df: DataFrame) -> DataFrame:
    measured = [c for c in df.columns if "f1macro" in c]
    return df.withColumns({c: F.round(c, 6) for c in measured})


@query
def pivot_report(spark, folder):
    return _round_pivot(report.pivot_report(report.outer_results(_all_results(spark, folder, 2))))


@query
def pivot_round1(spark, folder):
    return _round_pivot(report.pivot_report(report.round_results(_all_results(spark, folder, 2))))


@query
def default_report(spark, folder):
    """The report of a run that nothing else is said for: six classifiers over all four cases."""
    made = _features(spark, folder)
    results = workflow.experiment_results(made, list(SCENARIOS.values()), Job(size=20, step=20))
    return _round_pivot(report.pivot_report(report.outer_results(results)))


@query
def merge_results(spark, folder):
    job = Job(size=20, step=20, classifiers=("ZERORULE",))
    made = _features(spark, folder)
    parts = [
        workflow.experiment_results(made, [SCENARIOS[c]], job).drop("case", "train_seconds", "empty_test", "empty_train")
        for c in ("1a", "2b")
    ]
    merged = report.merge_results(*parts)
    columns = [c for c in _RESULT_COLUMNS if c != "case"]
    return _round_scores(merged.select(*columns, "case", "scenario", "welltest"))


@query
def stored_results(spark, folder):
    """Write the results of two cases one after the other, one of them twice, and read all back."""
    path, made = new_folder(spark, "results"), _features(spark, folder)
    job = Job(size=20, step=20, classifiers=("ZERORULE",))
    for case in ("1a", "2b", "2b"):
        results = workflow.experiment_results(made, [SCENARIOS[case]], job)
        tables.write_partitioned(results, path, ["case"])
    stored = spark.read.parquet(path)
    return _round_scores(stored.select(*_RESULT_COLUMNS))


@query
def default_run(spark, folder):
    """The six classifiers that a run takes if nothing else is said."""
    results = workflow.experiment_results(_features(spark, folder), [SCENARIOS["1a"]], Job(size=20, step=20))
    return _round_scores(results.select(*_RESULT_COLUMNS))


@query
def score_holdout(spark, folder):
    job = Job(size=20, step=20, classifiers=("ZERORULE", "1NN"), skip_wells=tuple(SKIPPED))
    made = _features(spark, folder)
    results = workflow.experiment_results(made, [SCENARIOS["1a"]], job)
    held = report.holdout_results(results)
    return _round_scores(
        held.select(
            "classifier", "round", "fold", "model_fold", "f1macro", "accuracy", "test_neg",
            "test_pos", "tp", "tn", "fp", "fn",
        )
    )


# ---- grid search ---------------------------------------------------------------------------------


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    ks = [c["n_neighbors"] for c in grid.configurations("KNN")]
    return workflow.search_neighbours(_data(spark, folder), ks)


@query
def grid_summary(spark, folder):
    means = _summary(spark, folder).drop("case")
    return means.withColumn("mean_f1macro", F.round("mean_f1macro", 6))


@query
def best_config(spark, folder):
    """Best of the configurations by rounded mean, so that equal means tie alike everywhere."""
    means = _summary(spark, folder).drop("case")
    means = means.withColumn("mean_f1macro", F.round("mean_f1macro", 6))
    return report.best_config(means, FOLD)


@query
def grid_search_knn(spark, folder):
    data = _data(spark, folder)
    found = workflow.searched_predictions(data, "KNN")
    return _predicted(found)
