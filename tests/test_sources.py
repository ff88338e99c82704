from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import governance as G
from tidemark.sources import reports as R
from tidemark.sources import tables as T

# Reports of an invented authority, written from the layouts' rules: codes 7100000xx, own sectors and figures.
CLASSIC = """Sector Wise Details
S.No  Works  Sanctioned  Cost  Date of opening
HARBOURS
 11 OUTER MOLE 7/2013 80.25 91.75 36.70 9/2016 2/2018
    (710000021) PORT TRUST,KERALA
 12 GRAIN BERTH 1/2014 64.00 0.00 16.00 5/2017 -
    (710000022)
LIGHTHOUSES AND BUOYS
\f 13 FOG SIGNALS 12/2014 1,907.50 2,384.38 596.10 - 11/2019
    [Q71000023]COAST OFFICE
Total of all works
"""
LEGACY = """SECTOR-WISE ANALYSIS OF PROJECTS
Date of opening [Anticipated]
FERRIES
4 TWIN HULL BOATS 9/1998 72.50 3.10 30.45 8/2001 14 2/5
  for the Islands
  (BOAT YARD) [87.00] [10/2002]
5. LANDING STAGE 2/1999 18.00 0.00 9.00 4/2000 - 1/1
  [18.00] [4/2000]
  (DOCK SHOP)
  Total of ferries
WEIRS
6 EEL PASS 3/1999 6.40 -0.15 6.25 6/1999 0 3/3
"""
RECENT = """Project List: Ongoing Projects as of 31st August 2022
   HARBOURS     21   DEEP FAIRWAY             4-2017           10-2020          1,240.00         868.00          61.5
                                              (Feb-23)         (1,240.00)
                                              {2/2024}         {1,395.00}
                                              (DREDGE BOARD)
                                              (Q71000041)
   HARBOURS     22   TIDE GAUGES              2/2018           /                45.00            9.00            -
                                              (Q71000042 )
   NOT A ROW    23   WITHOUT CODE             3/2018           6/2020           10.00            1.00            5
"""
REDESIGNED = """Detail of ongoing Projects
Original / amount
Revised / amount
Anticipated
TRAMWAYS
 31 HILL LOOP 6/2012 3/2016 512.00 614.40 5 / 8
    WITH DEPOT - Q71000051
    [768.00] [12/2017]
    (Q71000051) TRAM CO,GOA
 32 SHORT SPUR 1/2013 - 40.00 10.00 0/4
    (Q71000052)
"""


def frame(spark, *texts):
    rows = [(str(i), t, dt.date(2017, 10, 31), "2017-18", f"r{i}.pdf", "u") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "report_id string, text string, snapshot_date date, financial_year string, source_report string, source_url string")


def parsed(spark, text):
    """The rows of one report by name."""
    return {r["project_name"]: r for r in R.parse_reports(frame(spark, text)).collect()}


def test_classic_rows(spark):
    got = parsed(spark, CLASSIC)
    assert set(got) == {"OUTER MOLE", "GRAIN BERTH", "FOG SIGNALS"}
    mole, berth, fog = got["OUTER MOLE"], got["GRAIN BERTH"], got["FOG SIGNALS"]
    assert (mole["project_id"], mole["sector"], mole["implementing_agency"], mole["state"]) == ("710000021", "Harbours", "PORT TRUST", "KERALA")
    assert (mole["approved_cost_cr"], mole["revised_cost_cr"], mole["cumulative_expenditure_cr"], mole["financial_progress"]) == (80.25, 91.75, 36.7, 40.0)
    assert (mole["approval_date"], mole["planned_completion_date"], mole["revised_completion_date"]) == (dt.date(2013, 7, 1), dt.date(2016, 9, 1), dt.date(2018, 2, 1))
    assert mole["report_month"] == "October" and mole["physical_progress"] is None and mole["source_page"] == 1
    assert berth["revised_cost_cr"] == 0.0 and berth["revised_completion_date"] is None and berth["financial_progress"] is None
    assert (fog["project_id"], fog["sector"], fog["source_page"], fog["financial_progress"]) == ("Q71000023", "Lighthouses And Buoys", 2, 25.0002)
    assert fog["planned_completion_date"] is None and fog["implementing_agency"] == "COAST OFFICE"


def test_legacy_rows_keep_missing_ids(spark):
    got = parsed(spark, LEGACY)
    boats, stage, eels = got["TWIN HULL BOATS for the Islands"], got["LANDING STAGE"], got["EEL PASS"]
    assert {r["project_id"] for r in got.values()} == {None}
    assert (boats["approved_cost_cr"], boats["revised_cost_cr"], boats["milestone_status"], boats["current_schedule_status"]) == (72.5, 87.0, "2/5", "delayed")
    assert boats["implementing_agency"] == "BOAT YARD" and boats["revised_completion_date"] == dt.date(2002, 10, 1) and boats["financial_progress"] == 35.0
    assert (stage["sector"], stage["current_schedule_status"], stage["financial_progress"]) == ("Ferries", None, 50.0)
    assert (eels["sector"], eels["revised_cost_cr"], eels["current_schedule_status"]) == ("Weirs", None, None)


def test_recent_rows(spark):
    got = parsed(spark, RECENT)
    assert set(got) == {"DEEP FAIRWAY", "TIDE GAUGES"}
    deep, tide = got["DEEP FAIRWAY"], got["TIDE GAUGES"]
    assert (deep["project_id"], deep["implementing_agency"], deep["physical_progress"]) == ("Q71000041", "DREDGE BOARD", 61.5)
    assert (deep["approved_cost_cr"], deep["revised_cost_cr"], deep["cumulative_expenditure_cr"]) == (1240.0, 1395.0, 868.0)
    assert deep["revised_completion_date"] == dt.date(2024, 2, 1) and deep["financial_progress"] == pytest.approx(62.2222)
    assert (tide["project_id"], tide["planned_completion_date"], tide["physical_progress"], tide["financial_progress"]) == ("Q71000042", None, None, 20.0)


def test_redesigned_rows(spark):
    got = {r["project_id"]: r for r in R.parse_reports(frame(spark, REDESIGNED)).collect()}
    hill, spur = got["Q71000051"], got["Q71000052"]
    assert (hill["revised_cost_cr"], hill["milestone_status"], hill["sector"], hill["financial_progress"]) == (768.0, "5/8", "Tramways", 80.0)
    assert hill["revised_completion_date"] == dt.date(2017, 12, 1) and (hill["implementing_agency"], hill["state"]) == ("TRAM CO", "GOA")
    assert (spur["planned_completion_date"], spur["revised_cost_cr"], spur["financial_progress"]) == (None, None, 25.0)


def test_unknown_texts_are_reported(spark):
    df = frame(spark, "a letter without any table", CLASSIC, None)
    assert sorted(r["report_id"] for r in R.unrecognised(df).collect()) == ["0", "2"]
    assert {r["report_id"] for r in R.parse_reports(df).collect()} == {"1"}


def test_completed_lists_of_both_ages(spark):
    old = """Month wise List of Completed Projects
September 2016
FOOT BRIDGES
1. STONE ARCH WITH 14.20 11/2015 17.75
   STEPS (BRIDGE OFFICE) - [Q71000061]
2 ROPE BRIDGE 3 02/2016 2.5
October, 2016
3. COVERED BRIDGE 41.0 07/2016 44.0
Detail of ongoing
4 LATER BRIDGE 5 01/2017 6
"""
    new = """Table:-3. Project List: Completed during November 2021
WIND PUMPS
 1  MARSH PUMP         2,150.00      8/2020        1,935.00
    (PUMP UNION)
    (Q71000071 )
 2  DYKE PUMP          310.00        9/2020        341.00
    (Q71000072)
Table:-4. Project List: Added
 3  NEW PUMP           1.00          9/2020        1.00
"""
    got = {r["project_name"]: r for r in R.parse_completed(frame(spark, old, new)).collect()}
    assert set(got) == {"STONE ARCH WITH", "ROPE BRIDGE", "COVERED BRIDGE", "MARSH PUMP", "DYKE PUMP"}
    arch, marsh = got["STONE ARCH WITH"], got["MARSH PUMP"]
    assert (arch["project_id"], arch["implementing_agency"], arch["sector"]) == ("Q71000061", "BRIDGE OFFICE", "Foot Bridges")
    assert (arch["approved_cost_cr"], arch["reported_completion_expenditure_cr"]) == (14.2, 17.75)
    assert arch["completion_date"] == dt.date(2016, 9, 30) and got["COVERED BRIDGE"]["completion_date"] == dt.date(2016, 10, 31)
    assert (marsh["project_id"], marsh["approved_cost_cr"], marsh["completion_date"]) == ("Q71000071", 2150.0, dt.date(2021, 11, 30))
    assert (got["DYKE PUMP"]["planned_commissioning_date"], got["DYKE PUMP"]["sector"]) == (dt.date(2020, 9, 1), "Wind Pumps")


def test_archive_index(spark):
    html = """<h1>Reports</h1><table><thead><tr><th>Year</th><th>Report</th></tr></thead>
    <tr><td>2018-19</td><td>March</td><td><a href="get?n=3&amp;v=1">open</a></td></tr>
    <tr><td>2018-19</td><td>December (Part II)</td><td><a href="get?n=2">open</a></td></tr>
    <tr><td>2017-18</td><td>June</td><td>missing</td></tr></table>"""
    rows = R.archive_index(spark.createDataFrame([(html,)], "html string")).collect()
    got = {r["link"]: (r["financial_year"], r["report_month"], r["part_number"], r["calendar_year"]) for r in rows}
    assert got == {"get?n=3&v=1": ("2018-19", "March", 1, 2019), "get?n=2": ("2018-19", "December", 2, 2018)}


def test_csv_with_gz_fallback_and_coercion(spark, tmp_path):
    body = "project_id,approved_cost_cr,snapshot_date,extra\n007,12.5,2020-01-31,x\nA1,n/a,bad,y\n"
    (tmp_path / "a.csv").write_text(body)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(body)
    for name in ("a.csv", "b.csv"):
        rows = {r["project_id"]: r for r in T.read_snapshots(spark, f"{tmp_path}/{name}").collect()}
        assert rows["007"]["approved_cost_cr"] == 12.5 and rows["007"]["snapshot_date"] == dt.date(2020, 1, 31)
        assert rows["A1"]["approved_cost_cr"] is None and rows["A1"]["snapshot_date"] is None
    with pytest.raises(FileNotFoundError):
        T.read_snapshots(spark, f"{tmp_path}/none.csv")


def test_manifest_files_catalog_and_increments(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"fy": "2019-20", "status": "ok"}, {"fy": "2020-21", "status": None}]))
    m = T.read_manifest(spark, f"{tmp_path}/m.json")
    now = m.select("fy").withColumn("status", F.lit(None).cast("string"))
    assert {r["fy"]: r["status"] for r in T.merged_manifest(m, now, ["fy"], ["status"]).collect()} == {"2019-20": "ok", "2020-21": None}
    assert [r["fy"] for r in T.new_only(m, m.where("status = 'ok'"), ["fy"]).collect()] == ["2020-21"]
    runs = tmp_path / "runs"
    for run, files in {"a": ["manifest.json", "x"], "b": [".training"], "c": ["x"]}.items():
        (runs / run).mkdir(parents=True)
        for f in files:
            (runs / run / f).write_text("%PDF")
    assert {r["run"]: r["status"] for r in T.catalog(spark, str(runs)).collect()}["a"] == "ready"
    (f,) = T.read_files(spark, f"{runs}/c/x").collect()
    assert f["is_pdf"] and f["length"] == 4


def test_synthetic_series_and_strict_json(spark):
    df = T.synthetic_histories(spark, 3, 5)
    assert df.count() == 15 and df.where("physical_progress_percentage between 0 and 100").count() == 15
    odd = spark.createDataFrame([(float("nan"), 1), (2.0, None)], "x double, y int")
    assert sorted(r["json"] for r in T.strict_json(odd).collect()) == ['{"x":2.0,"y":null}', '{"x":null,"y":1}']


def test_writers_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    T.write_table(df, f"{tmp_path}/t")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        T.write_table(df, f"{tmp_path}/t")
    T.write_csv(df, f"{tmp_path}/c")
    T.write_csv(spark.range(9), f"{tmp_path}/c", only_if_absent=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 3


def test_histories_keep_ids_and_coerce_dates(spark, tmp_path):
    (tmp_path / "h.csv").write_text("project_code,snapshot_date,revised_completion_date,spent\n0012,2024-01-31,soon,1.5\n0013,2024-02-29 00:00:00,2025-01-01,\n")
    rows = sorted(T.read_history(spark, f"{tmp_path}/h.csv").collect(), key=lambda r: r["project_code"])
    assert [(r["project_code"], str(r["snapshot_date"]), str(r["revised_completion_date"]), r["spent"]) for r in rows] == [
        ("0012", "2024-01-31", "None", 1.5), ("0013", "2024-02-29", "2025-01-01", None),
    ]
    (tmp_path / "d.csv").write_text("project_id,month,start_date,planned_completion_date,revised_completion_date,actual_completion_date,x\n7,2024-01-01,bad,,2024-02-01,2024-03-01,3\n")
    row = T.read_demo_history(spark, f"{tmp_path}/d.csv").first()
    assert (row["project_id"], str(row["month"]), row["start_date"], row["planned_completion_date"], str(row["actual_completion_date"]), row["x"]) == ("7", "2024-01-01", None, None, "2024-03-01", 3)
    with pytest.raises(ValueError, match="lacks"):
        T.read_demo_history(spark, f"{tmp_path}/h.csv")


def test_artifacts_of_runs(spark, tmp_path):
    for run, text in (("r1", '{"mae": 1.5, "by": {"a": 1}}'), ("r2", '{"mae": null}'), ("r3", "[1]")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.json").write_text(text)
        (tmp_path / run / "other.json").write_text('{"mae": 9}')
    found = {(r["run"], r["key"]): r["value"] for r in T.read_artifacts(spark, str(tmp_path), "metrics.json").collect()}
    assert found == {("r1", "mae"): "1.5", ("r1", "by"): '{"a":1}', ("r2", "mae"): None}


def test_validation_rows_by_precedence(spark, tmp_path):
    folder = tmp_path / "2001_2021"
    folder.mkdir()
    (tmp_path / "legacy.csv").write_text("project_id,actual_cost_overrun\n01,5\n")
    with pytest.raises(FileNotFoundError):
        T.read_validation(spark, str(folder))
    assert T.read_validation(spark, str(folder), f"{tmp_path}/legacy.csv").first()["actual_cost_overrun"] == 5.0
    (folder / "evaluation_results.csv").write_text("project_id,actual_cost_overrun\n02,6\n")
    assert T.read_validation(spark, str(folder), f"{tmp_path}/legacy.csv").first()["project_id"] == "02"
    (folder / "prediction_validation.csv").write_text("canonical_project_id,actual_cost_overrun_percentage,predicted_cost_p10,stage\n03,oops,1.5,late\n")
    row = T.read_validation(spark, str(folder)).first()
    assert (row["project_id"], row["actual_cost_overrun"], row["predicted_cost_p10"], row["predicted_delay_p90"], row["stage"]) == ("03", None, 1.5, None, "late")


def test_a_parser_added_from_outside_is_used_and_told(spark):
    """A layout that none of the module's parsers knows is read once a parser for it is registered."""
    text = "ONE-LINE LIST\nR9000001;Lower Gate;120.5"
    df = spark.createDataFrame([("r1", text, None, "2024", "s", "u"), ("r2", "nothing known", None, "2024", "s", "u")], "report_id string, text string, snapshot_date date, financial_year string, source_report string, source_url string")
    assert R.parse_reports(df).count() == 0 and R.unrecognised(df).count() == 2

    class OneLine:
        version = "7"

        def matches(self, text):
            return text.startswith("ONE-LINE")

        def parse(self, reports):
            line = F.split(F.split("text", "\n")[1], ";")
            return reports.select("report_id", line[0].alias("project_id"), line[1].alias("project_name"), line[2].cast("double").alias("approved_cost_cr"))

    registry = R.parsers()
    registry.add("one-line", OneLine())
    row = R.parse_reports(df, registry, told=True).collect()
    assert [(r["report_id"], r["project_id"], r["project_name"], r["approved_cost_cr"], r["parser"], r["parser_version"]) for r in row] == [("r1", "R9000001", "Lower Gate", 120.5, "one-line", "7")]
    assert {r["report_id"]: r["parser"] for r in R.assigned(df, registry).collect()} == {"r1": "one-line", "r2": None}
    with pytest.raises(TypeError):
        registry.add("broken", object())


def test_extensions_opt_in_and_loaders_are_allowed(tmp_path, monkeypatch):
    import sys

    package = tmp_path / "extras"
    package.mkdir()
    (package / "__init__.py").write_text("")
    for name, text in (("adapter_b", "NAME='b'\nSEQUENCE=2\nON=True\ndef run(): return 'b'"), ("adapter_a", "NAME='a'\nSEQUENCE=1\nON=True\ndef run(x=3, *, y): return x + y"),
                       ("adapter_shy", "NAME='shy'\ndef run(): pass"), ("other", "NAME='other'\nON=True\ndef run(): pass")):
        (package / f"{name}.py").write_text(text)
    monkeypatch.setattr(sys, "path", [str(tmp_path), *sys.path])
    registry = G.Registry("run")
    assert registry.discover("extras", "adapter_", "ON") == ["a", "b"] and [n for n, _ in registry] == ["a", "b"]
    run = G.load_callable("extras.adapter_a:run", ("extras",))
    assert G.invoke(run, {"y": 4, "z": 5}) == 7 and G.invoke(run, {"x": 1, "y": 4}) == 5
    with pytest.raises(ValueError, match="needs y"):
        G.invoke(run, {"x": 1})
    for bad in ("os:system", "extras_evil.x:run", "extras.adapter_a:NAME", "extras.adapter_a:none", "extras.adapter_a", "extras.adapter_a:__class__"):
        with pytest.raises(ValueError):
            G.load_callable(bad, ("extras",))
