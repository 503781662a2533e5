"""Typed sources and sinks."""

import datetime as dt
import os
import tempfile

import pytest

from panelcast.sources import files


def test_missing_input_lists_folder(spark):
    d = tempfile.mkdtemp(prefix="pc-files-", dir="/tmp")
    open(os.path.join(d, "calendar.csv"), "w").write("x\n")
    with pytest.raises(FileNotFoundError) as e:
        files.require_path(spark, os.path.join(d, "sell_prices.csv"))
    assert "calendar.csv" in str(e.value)


def test_wide_sales_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="pc-files-", dir="/tmp")
    p = os.path.join(d, "sales.csv")
    with open(p, "w") as f:
        f.write("id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\n")
        f.write("A_S,A,D,C,S,T,3,0\n")
    df = files.load_sales(spark, p)
    assert [t for _, t in df.dtypes][-2:] == ["int", "int"]
    assert df.first()["d_1"] == 3


def test_calendar_snap_to_bool(spark):
    d = tempfile.mkdtemp(prefix="pc-files-", dir="/tmp")
    p = os.path.join(d, "calendar.csv")
    with open(p, "w") as f:
        f.write("date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,"
                "event_name_2,event_type_2,snap_CA\n")
        f.write("2011-01-29,11101,Saturday,1,1,2011,d_1,,,,,1\n")
    r = files.load_calendar(spark, p).first()
    assert r["date"] == dt.date(2011, 1, 29) and r["snap_CA"] is True and r["event_name_1"] is None


def test_bad_csv_fails_fast(spark):
    d = tempfile.mkdtemp(prefix="pc-files-", dir="/tmp")
    p = os.path.join(d, "sell_prices.csv")
    with open(p, "w") as f:
        f.write("store_id,item_id,wm_yr_wk,sell_price\nS,A,notanint,1.0\n")
    with pytest.raises(Exception):
        files.load_prices(spark, p).collect()


def test_metrics_json_model_from_folder(spark):
    d = tempfile.mkdtemp(prefix="pc-files-", dir="/tmp")
    board = spark.createDataFrame([("m1", 1.0, 1.0, 1.0, 1.0, 1.0, 2.0)],
                                  "Model string, RMSE double, MAE double, MAPE double, sMAPE double, "
                                  "WRMSSE double, train_seconds double")
    files.save_metrics_json(board, os.path.join(d, "metrics"))
    out = files.load_metrics(spark, json_dir=os.path.join(d, "metrics")).first()
    assert out["Model"] == "m1" and out["train_seconds"] == 2.0
