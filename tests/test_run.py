"""A whole run from CSV files, and what its results say about themselves."""

import json
import random

import pytest

from faultline.plans import workflow
from faultline.plans.scenarios import SCENARIOS, Job


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Twelve recordings of two classes with 60 rows each, some incomplete, and a simulated one."""
    root, pick = tmp_path_factory.mktemp("csv"), random.Random(4)
    for label in ("0", "4"):
        (root / label).mkdir()
        for n in range(6):
            lines = ["timestamp,P-PDG,P-TPT,T-TPT,P-MON-CKP,T-JUS-CKP,P-JUS-CKGL,T-JUS-CKGL,QGL,class"]
            for t in range(60):
                values = [f"{pick.gauss(10 if label == '4' else 0, 1):.4f}" for _ in range(5)]
                if t % 20 == 7:
                    values[1] = ""
                lines.append(f"2017-02-0{n + 1} 02:{t:02}:00," + ",".join(values) + f",,,,{label}")
            (root / label / f"WELL-0000{n + 1}_2017020{n + 1}0200.csv").write_text("\n".join(lines) + "\n")
    (root / "4" / "SIMULATED_00001.csv").write_text("\n".join(lines) + "\n")
    return root


def test_every_stage_is_a_table_and_every_result_row_is_complete(spark, tree, tmp_path):
    names = ("ZERORULE", "1NN", "GNB", "LDA", "DT", "ADA")
    job = Job(size=10, step=10, k=2, classifiers=names, configs={"ADA": {"n_estimators": 3}, "DT": {"max_depth": 4}})
    out = str(tmp_path / "out")
    results = workflow.run(spark, str(tree), out, [SCENARIOS["1a"]], job).collect()
    tables = {t: spark.read.parquet(f"{out}/{t}") for t in ("recordings", "clean", "features", "folds")}
    assert tables["recordings"].count() == 12 * 60 and tables["clean"].count() == 12 * 57
    assert tables["features"].count() == 12 * 4 == tables["folds"].count()
    assert {r["classifier"] for r in results} == set(names) and len(results) == 2 * len(names)
    for r in results:
        assert r["train_seconds"] is not None and r["train_seconds"] >= 0 and r["seed"] == r["round"] == 1
        assert r["timestamp"] is not None and isinstance(json.loads(r["config_text"]), dict)
        if r["classifier"] not in ("ZERORULE",):
            assert r["f1macro"] > (0.8 if r["classifier"] == "ADA" else 0.9), r
    assert json.loads(next(r["config_text"] for r in results if r["classifier"] == "ADA")) == {"n_estimators": 3}
    # Run again from the tables: the same rows in the same places.
    again = workflow.run(spark, str(tree), out, [SCENARIOS["1a"]], job)
    assert again.count() == len(results)


def test_configuration_texts_of_a_search(spark):
    job = Job(classifiers=("KNN", "GNB"), grid_search=True)
    rows = spark.createDataFrame([("KNN", 2), ("GNB", 0), ("KNN", 99)], "classifier string, config int")
    assert [r[0] for r in rows.select(workflow.config_texts(job)).collect()] == ['{"n_neighbors": 5}', "{}", None]
