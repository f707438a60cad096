"""CSV recordings, partitioned tables, stages."""

from pyspark.sql import functions as F

from faultline.operators import clean
from faultline.session import shared_folder, stage
from faultline.sources import recordings, tables

HEADER = "when,one,two,three,four,five,six,seven,eight,kind\n"


def write_tree(root):
    def put(folder, name, lines):
        (root / folder).mkdir(exist_ok=True)
        (root / folder / name).write_text(HEADER + "\n".join(lines) + "\n")

    put("0", "WELL-00001_20170201.csv", [
        "2017-02-01 02:00:00,1,2,3,4,5,,,,0", "2017-02-01 02:00:01,1,NaN,3,4,5,,,,0",
    ])
    put("4", "WELL-00014_20170202.csv", ["2017-02-02 00:00:00,9,8,7,6,5,4,3,2,4"])
    put("4", "SIMULATED_00001.csv", ["2018-01-01 00:00:00,1,1,1,1,1,1,1,1,4"])
    put("4", ".WELL-hidden.csv", ["2018-01-01 00:00:00,1,1,1,1,1,1,1,1,4"])


def test_scan_csv(spark, tmp_path):
    write_tree(tmp_path)
    rows = recordings.scan_csv(spark, str(tmp_path)).orderBy("class_id", "ts").collect()
    assert [(r.class_id, r.well_id) for r in rows] == [(0, 1), (0, 1), (4, 14)]
    assert rows[0].instance_id == "WELL-00001_20170201"
    assert rows[1].v2 is None and rows[0].v6 is None and rows[2].v8 == 2.0
    assert rows[2].row_class == 4.0


def test_simulated_recordings_on_request(spark, tmp_path):
    write_tree(tmp_path)
    rows = recordings.scan_csv(spark, str(tmp_path), include_simulated=True)
    assert rows.count() == 4
    assert recordings.real_recordings(rows).count() == 3
    assert clean.drop_incomplete(rows).count() == 3
    assert rows.where("well_id is null").count() == 1


def test_writing_twice_leaves_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "folds")
    df = spark.range(20).select(
        F.lit("1a").alias("case"), (F.col("id") % 2 + 1).cast("int").alias("round"),
        (F.col("id") % 5).cast("int").alias("fold"), "id",
    )
    for _ in range(2):
        tables.write_partitioned(df, path, ["case", "round"])
    tables.write_partitioned(df.where("round = 2"), path, ["case", "round"])
    assert spark.read.parquet(path).count() == 20
    assert tables.read_fold(spark, path, "1a", 2, 3).count() == 2


def test_fold_read_prunes_partitions(spark, tmp_path, capsys):
    path = str(tmp_path / "folds")
    df = spark.range(4).select(
        F.lit("1a").alias("case"), F.lit(1).alias("round"), F.lit(0).alias("fold"), "id"
    )
    tables.write_partitioned(df, path, ["case", "round"])
    tables.read_fold(spark, path, "1a", 1, 0).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(case" in plan and "EqualTo(fold,0)" in plan


def test_stage_lies_in_the_shared_folder(spark):
    staged = stage(spark.range(5))
    assert staged.count() == 5
    assert shared_folder(spark) in staged.inputFiles()[0]


def test_complete_rows_are_filtered_in_the_scan(spark, folder, capsys):
    clean.drop_incomplete(tables.lineitem_readings(spark, folder)).select("v1").explain("formatted")
    plan = capsys.readouterr().out
    assert "IsNotNull(l_quantity)" in plan and "l_orderkey" not in plan.split("ReadSchema")[1]


def test_mask_and_flag(spark):
    nan, inf = float("nan"), float("inf")
    values = [1.0, None, nan, inf, -inf, 3.5e38, -3.5e38]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.x for r in clean.mask_nonfinite(df, ["x"]).collect()] == [1.0, -3.5e38]
    assert clean.flag_nonfinite(df, ["x"]).where("bad").count() == 5
    audit = clean.quality_audit(df, ["x"]).first()
    assert (audit.missing, audit.plus_infinite, audit.minus_infinite, audit.over_float32) == (2, 1, 1, 1)
    assert audit.overlapping_total == 1 + 1 + 2 * 2 + 4 * 2
