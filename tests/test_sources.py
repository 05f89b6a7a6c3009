"""Files that differ in their headers."""

import datetime

from panelspark.sources import tables

DAY = datetime.date(2024, 2, 1)


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Station export\n\nsome,thing\nDate,Time,NO2,WSP\n01/02/2024,01:00,9.0,1.5\n31/02/2024,24:00,x,2\n\n")
    (tmp_path / "b.csv").write_text("Date,Time,WSP,NO2\n1/2/2024,02:00,1.5,9.0\n")  # the same columns in another order
    (tmp_path / "c.csv").write_text('"time","Ozone CO","no2, hourly",date\n03:00,4,7,01/02/2024\n')  # no wind, a quoted name
    (tmp_path / "d.csv").write_text("no header here\n01/02/2024,04:00,1,2\n")
    (tmp_path / "e.csv").write_text("Date,Time\n01/02/2024,05:00\n")
    (tmp_path / "f.csv").write_text("")
    found = tables.read_monitor_table(spark, str(tmp_path), {"target": ["NO2"], "wind": ["WSP"], "co": ["CO"], "ozone": ["ozone"]}, {"co": ["OZONE"]})
    rows = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[1], repr(r)))
    assert rows == [
        (DAY, 1, 9.0, 1.5, None, None), (DAY, 2, 9.0, 1.5, None, None), (DAY, 3, 7.0, None, None, 4.0), (DAY, 5, None, None, None, None), (None, 24, None, 2.0, None, None),
    ]


def test_the_first_header_of_a_file_counts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Time,NO2,WSP\n" + "".join(f"{d:02d}/01/2024,01:00,{d},0\n" for d in range(1, 29)) + "Date,Time,WSP,NO2\n29/01/2024,01:00,29,0\n")
    found = tables.read_monitor_table(spark, str(tmp_path), {"target": ["NO2"]})
    assert [r["target"] for r in found.orderBy("date").collect()] == [float(d) for d in range(1, 30)]
    assert tables.read_monitor_table(spark, [str(tmp_path / "a.csv")], {"target": ["none"]}).filter("target IS NOT NULL").count() == 0


def test_lines_with_quotes_and_a_plan_that_parses_each_line_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Time,"NO2, ""1h""",WSP\n01/02/2024,01:00,"9.0",1.5\n"02/02/2024",02:00,8,\n')
    found = tables.read_monitor_table(spark, str(tmp_path), {"target": ["NO2"], "wind": ["WSP"]})
    assert sorted((tuple(r) for r in found.collect()), key=repr) == [(DAY, 1, 9.0, 1.5), (DAY + datetime.timedelta(1), 2, 8.0, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") <= 2 and "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()


def test_names_are_taken_apart_once_a_file(spark, tmp_path):
    for stage in ("default", "tuned"):
        spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/stage={stage}")
    found = tables.index_prediction_files(spark, f"{tmp_path}/*/*.parquet", r"^stage=(\w+)/(part)-(\d+)", ["stage", "kind", "number"], 1)
    assert found.columns == ["stage", "kind", "number", "id"]
    assert {tuple(r) for r in found.groupBy("stage", "kind", "number").count().collect()} == {("default", "part", "00000", 5), ("tuned", "part", "00000", 5)}
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
