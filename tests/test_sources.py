import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorloom.functions import columns as fn
from sensorloom.operators import reshape
from sensorloom.sources import files


def test_long_csv(spark, tmp_path):
    folder = tmp_path / "long"
    folder.mkdir()
    (folder / "a.csv").write_text("asset,variable,date,time,value\nA001,x,2024-12-30,00:00:01,1.5\nA001,x,2024-12-31,23:59:59,NaN\n")
    (folder / "b.csv").write_text("asset,variable,date,time,value\nA002,y,2025-01-01,12:00:00,\n")
    rows = {r.asset + str(r.timestamp): r.value for r in files.read_long_csv(spark, str(folder)).collect()}
    assert rows == {"A0012024-12-30 00:00:01": 1.5, "A0012024-12-31 23:59:59": None, "A0022025-01-01 12:00:00": None}


def test_lenient_times(spark, tmp_path):
    (tmp_path / "a.csv").write_text("asset,variable,date,time,value\nA001,x,2024-12-30,bad,1.5\n")
    assert files.read_long_csv(spark, str(tmp_path), lenient=True).first().timestamp is None


def test_inferred_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("asset,value\nA001,1.5\n")
    assert [f.dataType.simpleString() for f in files.infer_schema(spark, str(tmp_path))] == ["string", "double"]


def test_union_follows_names_not_positions(spark, tmp_path):
    (tmp_path / "one.csv").write_text("asset,a,b\nA001,1,2\n")
    (tmp_path / "two.csv").write_text("b,asset,a\n20,A002,10\n")
    (tmp_path / "three.csv").write_text("asset,a,c\nA003,100,300\n")
    out = files.read_csv_by_name(spark, str(tmp_path), {"asset": "string"})
    rows = {r.asset: (r.a, r.b, r.c) for r in out.collect()}
    assert rows == {"A001": (1, 2, None), "A002": (10, 20, None), "A003": (100, None, 300)}
    with pytest.raises(FileNotFoundError):
        files.read_csv_by_name(spark, str(tmp_path), {}, suffix=".tsv")


XML = "<assets>{}</assets>"
PAIR = "<translation><src>{}</src><dest>{}</dest></translation>"


def test_translations(spark, tmp_path):
    good = tmp_path / "good.xml"
    good.write_text(XML.format(PAIR.format("x", "WindSpeed") + PAIR.format("y", "Power") + PAIR.format("x", "WindSpeed")))
    assert sorted(map(tuple, files.read_translations(spark, str(good)).collect())) == [("x", "WindSpeed"), ("y", "Power")]
    bad = tmp_path / "bad.xml"
    bad.write_text(XML.format(PAIR.format("x", "WindSpeed") + PAIR.format("x", "Power")))
    with pytest.raises(Exception, match="conflicting translations of x"):
        files.read_translations(spark, str(bad)).collect()


def test_translate_leaves_unknown_names_missing(spark):
    df = spark.createDataFrame([("A001", "x"), ("A001", "z")], "asset string, variable string")
    pairs = spark.createDataFrame([("x", "WindSpeed")], "src string, dest string")
    for named in (reshape.translate(df, pairs), reshape.translate_with_map(df, {"x": "WindSpeed"})):
        ids = {r.variable: r.id for r in reshape.with_series_id(named).collect()}
        assert ids == {"x": "WindSpeed_A001", "z": None}
        assert [tuple(r) for r in reshape.untranslated(named).collect()] == [("z", 1)]


def test_wide_csv_round_trip(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "P_A001", 1.0), ("2024-01-01 00:10:00", "P_A002", 2.0), ("2024-01-01 00:10:00", None, 9.0)]
    long = spark.createDataFrame(rows, "timestamp string, id string, value double")
    wide = reshape.pivot_wide(long, "timestamp", "id", "value")
    assert wide.columns == ["timestamp", "P_A001", "P_A002"]
    files.write_csv(wide.orderBy("timestamp"), str(tmp_path / "wide"), single_file=True)
    assert len(list((tmp_path / "wide").glob("part-*.csv"))) == 1
    back = files.read_wide_csv(spark, str(tmp_path / "wide"))
    cells = reshape.wide_to_long(back, "timestamp").filter("value is not null").collect()
    found = {(r.timestamp, r.asset, r.variable, r.value) for r in cells}
    assert found == {(dt.datetime(2024, 1, 1), "A001", "P", 1.0), (dt.datetime(2024, 1, 1, 0, 10), "A002", "P", 2.0)}


def test_daily_csv(spark, tmp_path):
    rows = [("A001", dt.date(2024, 1, d), 600 * i, float(i)) for d in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "asset string, fcast_day date, range bigint, pred_WTURPower double")
    files.write_daily_csv(df, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("fcast_day=*/*.csv"))
    assert [p.parent.name for p in parts] == ["fcast_day=2024-01-01", "fcast_day=2024-01-02"]
    assert parts[0].read_text().splitlines()[0] == "asset,range,pred_WTURPower"
    with pytest.raises(Exception):
        files.write_daily_csv(df, str(tmp_path / "out"))


def test_pivot_refuses_too_many_columns(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("name"))
    assert len(reshape.column_values(df, "name", 5)) == 5
    with pytest.raises(ValueError):
        reshape.column_values(df, "name", 4)


def test_drop_missing(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 3.0)], "a int, b double, c double")
    assert reshape.drop_missing_rows(df).count() == 1
    assert reshape.drop_null_columns(df).columns == ["a", "c"]


def test_tag_filter_and_text_functions(spark):
    df = spark.createDataFrame([("WindSpeed_A001",), ("Power_A002",)], "id string")
    out = df.select(fn.asset_of(F.col("id")).alias("asset"), fn.variable_of(F.col("id")).alias("variable"))
    assert sorted(map(tuple, out.collect())) == [("A001", "WindSpeed"), ("A002", "Power")]
    assert reshape.variables_tagged(out, "Speed").count() == 1


def test_right_closed_bucket(spark):
    times = [dt.datetime(2024, 1, 1, 0, 10), dt.datetime(2024, 1, 1, 0, 10, 0, 1), dt.datetime(2024, 1, 1, 0, 19, 59)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz").select(fn.right_closed_bucket(F.col("ts"), 600).alias("b"))
    assert [r.b.minute for r in df.collect()] == [10, 20, 20]


def test_safe_corr_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(fn.safe_corr(F.col("a"), F.col("b")).alias("c")).first().c is None


def test_headers_of_many_files_in_one_pass(spark, tmp_path):
    """Two layouts over many files, quoted names, an empty file and one without rows; jobs do not follow the files."""
    want = []
    for i in range(40):
        columns = ["asset", "a,b", "c"] if i % 2 else ["c", "asset"]
        row = {"asset": f"A{i:03d}", "a,b": i + 0.5, "c": float(i)}
        quoted = ",".join(f'"{c}"' if "," in c else c for c in columns)
        (tmp_path / f"f{i:02d}.csv").write_text(quoted + "\n" + ("" if i == 39 else ",".join(str(row[c]) for c in columns) + "\n"))
        if i < 39:
            want.append((row["asset"], row["a,b"] if i % 2 else None, row["c"]))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "notes.txt").write_text("not,a,table\n")
    assert files.file_headers(spark, str(tmp_path)).count() == 40
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "")
    back = files.read_csv_by_name(spark, str(tmp_path), {"asset": "string"})
    jobs = len(tracker.getJobIdsForGroup("headers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, back.select("asset", "`a,b`", "c").collect())) == sorted(want) and jobs <= 6
    with pytest.raises(FileNotFoundError):
        files.read_csv_by_name(spark, str(tmp_path), {}, ".tsv")


def test_a_large_day_is_several_files(spark, tmp_path):
    rows = [(f"A{i % 7}", dt.date(2024, 1, 2 if i % 10 else 3), i, float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "asset string, fcast_day date, range long, pred_WTURPower double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_daily_csv(df, str(tmp_path / "days"), rows_per_file=200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = {d.name: len(list(d.glob("*.csv"))) for d in (tmp_path / "days").iterdir() if d.is_dir()}
    tasks = {f.name.split("-")[1] for f in (tmp_path / "days/fcast_day=2024-01-02").glob("*.csv")}
    assert len(tasks) > 1 and parts["fcast_day=2024-01-02"] >= 5 and parts["fcast_day=2024-01-03"] == 1
    back = files.read_daily_csv(spark, str(tmp_path / "days"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows)


def test_evaluation_needs_its_features(spark, tmp_path):
    from sensorloom.plans import flows

    table = spark.createDataFrame([], "asset string, timestamp timestamp_ntz, fcast_day date, range long, a double, true_WTURPower double")
    with pytest.raises(ValueError, match="has no a"):
        flows.evaluate_to_daily_files(table, table.drop("a"), ["a"], 1.0, str(tmp_path / "out"))
