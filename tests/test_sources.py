import datetime as dt

from pyspark.sql import functions as F

from hourloom.config import MEASURES
from hourloom.sources import meter_text, tables

TEXT = """Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3
16/12/2006;17:25:00;5.360;0.436;233.630;23.000;0.000;1.000;16.000
16/12/2006;17:24:00;4.216;0.418;234.840;18.400;0.000;1.000;17.000
1/1/2007;00:00:00;?;?;?;?;?;?;
31/02/2007;00:00:00;1.0;1;1;1;1;1;1
bad;00:01:00;x;1;1;1;1;1;1
12/1/2010;00:01;1;1;1;1;1;1;1
12/1/2010;00:02:00;nan;1;1;1;1;1;1
"""


def write(tmp_path):
    path = tmp_path / "home_1.txt"
    path.write_text(TEXT)
    return str(path)


def test_text_file(spark, tmp_path):
    readings = meter_text.read_meter_text(spark, write(tmp_path))
    rows = {r["ts"]: r for r in readings.where(F.col("ts").isNotNull()).collect()}
    assert set(rows) == {
        dt.datetime(2006, 12, 16, 17, 25),
        dt.datetime(2006, 12, 16, 17, 24),
        dt.datetime(2007, 1, 1),
        dt.datetime(2010, 1, 12, 0, 2),
    }
    assert rows[dt.datetime(2006, 12, 16, 17, 24)]["Sub_metering_3"] == 17.0
    assert all(rows[dt.datetime(2007, 1, 1)][m] is None for m in MEASURES)
    assert rows[dt.datetime(2010, 1, 12, 0, 2)]["Global_active_power"] is None
    assert readings.count() == 7
    assert {r["series_id"] for r in readings.collect()} == {"home_1"}
    assert dict(readings.dtypes)["ts"] == "timestamp_ntz"


def test_load_report(spark, tmp_path):
    report = meter_text.load_report(meter_text.read_meter_text(spark, write(tmp_path), F.lit("m"))).first()
    assert report["series_id"] == "m" and report["n_rows"] == 7
    assert report["first_ts"] == dt.datetime(2006, 12, 16, 17, 24)
    assert report["missing_values"] == 7 + 1 + 1


def test_prepared_tables_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.5), ("b", dt.date(2020, 1, 2), None)], "series_id string, date date, x double")
    tables.write_prepared({"daily": df}, str(tmp_path))
    tables.write_prepared({"daily": df}, str(tmp_path))
    assert sorted(tables.read_prepared(spark, str(tmp_path), "daily").collect()) == sorted(df.collect())
    tables.export_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "out"))
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_columns_are_read_by_name(spark, tmp_path):
    lines = [line.split(";") for line in TEXT.strip().splitlines()]
    order = [8, 3, 1, 0, 2, 4, 5, 6, 7]
    path = tmp_path / "shuffled.txt"
    path.write_text("\n".join(";".join(line[i] for i in order) for line in lines))
    plain = meter_text.read_meter_text(spark, write(tmp_path)).drop("series_id")
    assert sorted(map(str, meter_text.read_meter_text(spark, str(path)).drop("series_id").collect())) == sorted(map(str, plain.collect()))
