from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bedside.functions.time import age_in_years, elapsed_days, parse_timestamp
from bedside.sources import readers, sinks
from bedside.sources.schemas import FILES, column_names


def test_both_time_layouts(frame, rows):
    df = frame("s string", [("2040/7/9 08:05:06",), ("2041-11-3 06:30:00",), ("soon",), (None,)])
    assert [r[0] for r in rows(df.select(parse_timestamp("s")))] == [None, None, datetime(2040, 7, 9, 8, 5, 6), datetime(2041, 11, 3, 6, 30)]


def test_wide_csv(spark, tmp_path):
    names = column_names(FILES["wide_vitals"])
    path = tmp_path / "ce.csv"
    path.write_text(
        ",".join(f'"{n}"' for n in names) + "\n"
        '"3","5","2","0","2040/7/9 08:05:06","2040/7/12 10:00:00","2040/7/10 09:30:00","25.41",,"111","66","81",,,\n'
    )
    row = readers.read_wide_csv(spark, str(path), FILES["wide_vitals"]).first()
    assert row["charttime"] == datetime(2040, 7, 10, 9, 30) and row["heartrate"] is None and row["sysbp"] == 111.0
    path.write_text(",".join(f'"{n}"' for n in names) + "\n" + '"x"' + ',"1"' * (len(names) - 1) + "\n")
    with pytest.raises(Exception):
        readers.read_wide_csv(spark, str(path), FILES["wide_vitals"]).collect()


def test_importance_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",feature,gain,split\n3,alpha_max,4.5,11\n8,beta_min,2.25,7\n")
    (tmp_path / "old.csv").write_text("1,30\n2,12\n")
    new = readers.read_importance(spark, str(tmp_path / "a.csv"), FILES["importance"])
    assert [tuple(r)[:4] for r in new.collect()] == [(3, "alpha_max", 4.5, 11), (8, "beta_min", 2.25, 7)]
    old = readers.read_importance(spark, str(tmp_path / "old.csv"), FILES["importance_oldest"], header=False)
    assert old.agg(F.sum("split")).first()[0] == 42


def test_materialize(spark, tmp_path):
    path = str(tmp_path / "t")
    first = sinks.materialize(spark.range(5).toDF("a"), path)
    assert first.count() == 5 and sinks.materialize(spark.range(3).toDF("a"), path).count() == 3
    kept = sinks.keep_in(str(tmp_path))("x", spark.range(2).toDF("a"))
    assert kept.count() == 2
    table = sinks.materialize_table(spark.range(10).toDF("a"), "bucketed_ids", ["a"], 4)
    assert table.count() == 10
    spark.sql("DROP TABLE bucketed_ids")


@pytest.mark.parametrize("max_rows", [3, 10**6])
def test_row_ids(frame, rows, max_rows):
    df = frame("label int, k bigint", [(1, 5), (0, 9), (0, 3), (1, 2), (0, 4), (0, 8), (0, 7)])
    out = sinks.with_row_id(df, "label", "k", max_rows=max_rows)
    assert rows(out) == [(0, 0, 3), (1, 0, 4), (2, 0, 7), (3, 0, 8), (4, 0, 9), (5, 1, 2), (6, 1, 5)]


def test_feature_and_importance_sinks(spark, frame, tmp_path):
    df = frame("label int, k bigint", [(1, 5), (0, 9)])
    sinks.write_features(df, str(tmp_path / "f"), "id", ("label", "k"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "f"), header=True).collect())) == [("0", "0", "9"), ("1", "1", "5")]
    table = frame("feature string, gain double, split bigint", [("x", 60.0, 3), ("y", 40.0, 2)])
    for fold in (0, 1, 1):  # a repeated fold replaces itself
        sinks.write_importance(table, str(tmp_path / "imp"), "r1", fold)
    back = spark.read.csv(str(tmp_path / "imp"), header=True, inferSchema=True)
    assert back.count() == 4 and set(back.columns) == {"feature", "gain", "split", "run", "fold"}


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = sinks.shared_folder(spark)
    assert folder == named if named else folder


def test_elapsed(frame):
    df = frame("a timestamp_ntz, b timestamp_ntz", [("2000-02-29 00:00:00", "2024-02-29 12:00:00")])
    row = df.select(elapsed_days("a", "b").alias("d"), age_in_years("a", "b").alias("y")).first()
    assert row["d"] == 8766.5 and row["y"] == 24.0
