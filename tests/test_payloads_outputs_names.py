import pathlib
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceshift.functions.scalars import clean_names, cleaned_names
from paceshift.plans import cleaning
from paceshift.sources import files, landing, outputs, payloads

REQUIRED = '"game_pk": 1, "game_date": "2022-04-01", "startTime": "2022-04-01T10:00:00Z", "isPitch": true, "about.inning": 1, "matchup.pitcher.fullName": "P"'


def land(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    return [str(folder / f"{name}.json") for name in texts]


def test_fields_of_all_files_are_kept_by_name(spark, tmp_path):
    paths = land(
        tmp_path,
        a='{"id": 1, "n": 1, "flag": true, "only a": "x"}\n{"id": 2, "n": 2, "void": null}\n\n',
        b='{"n": 2.5, "id": 3, "nested": {"k": [1, 2]}, "void": null, "text": "7"}\n',
        c='{"id": 4, "n": 12345678901234567890123, "day": "2022-04-01", "e": 1e3, "text": null}\n',
    )
    declared = T.StructType([T.StructField("day", T.DateType()), T.StructField("absent", T.LongType())])
    got = payloads.read_payloads(spark, paths, declared, ["id", "day"])
    types = {f.name: f.dataType.simpleString() for f in got.schema}
    assert types == {"day": "date", "absent": "bigint", "e": "double", "flag": "boolean", "id": "bigint", "n": "double", "nested": "string", "only a": "string", "text": "string", "void": "string"}
    rows = {r.id: r.asDict() for r in got.collect()}
    assert rows[1]["only a"] == "x" and rows[2]["n"] == 2.0 and rows[3]["nested"] == '{"k": [1, 2]}' and rows[3]["text"] == "7"
    assert rows[4]["n"] == pytest.approx(1.2345678901234568e22) and str(rows[4]["day"]) == "2022-04-01" and rows[4]["e"] == 1000.0
    counts = {(r.name, r.kind): r.n for r in payloads.found_fields(spark, paths).collect()}
    assert counts["id", "BIGINT"] == 4 and counts["n", "DOUBLE"] == 2 and counts["void", "VOID"] == 2


def test_conflicts_and_missing_fields_are_errors(spark, tmp_path):
    paths = land(tmp_path, a='{"id": 1, "x": 5}\n', b='{"id": 2, "x": "five"}\n')
    with pytest.raises(ValueError, match="field x .*BIGINT in .*a.json, STRING in .*b.json"):
        payloads.read_payloads(spark, paths)
    assert payloads.read_payloads(spark, paths, T.StructType([T.StructField("x", T.StringType())])).where("x = 'five'").count() == 1
    with pytest.raises(ValueError, match="lack the fields .'y'"):
        payloads.read_payloads(spark, paths[:1], required=["y"])
    with pytest.raises(Exception):
        payloads.read_payloads(spark, land(tmp_path, c="no json\n"))


def test_landed_events_with_unknown_fields(spark, tmp_path):
    paths = land(tmp_path, a="{" + REQUIRED + ', "hitData.launchSpeed": 99.5}\n', b='{"details.type": "clash", "start_speed": "x", ' + REQUIRED + ', "hitData.launchSpeed": 90}\n')
    strict = landing.landed_events(spark, paths)
    kept = landing.landed_events(spark, paths, unknown="keep")
    assert kept.columns[: len(strict.columns)] == strict.columns
    assert kept.columns[len(strict.columns) :] == ["details_type", "hit_data_launch_speed", "start_speed_2"]
    assert sorted(r.hit_data_launch_speed for r in kept.collect()) == [90.0, 99.5]
    assert kept.select(strict.columns).exceptAll(strict).count() == 0
    with pytest.raises(ValueError):
        landing.landed_events(spark, paths, fmt="csv", unknown="keep")


def test_outputs_are_written_once_and_compared(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a", i) for i in range(5)] + [("b", 1), (None, 9)]
    df = spark.createDataFrame(rows, "kind string, n long")

    def status(frame):
        return {r.kind: (r.n_rows, r.status) for r in outputs.write_outputs(frame, path, "kind").collect()}

    def written():
        return {f.parent.name: f.stat().st_mtime_ns for f in pathlib.Path(path, "outputs").rglob("*.parquet")}

    assert status(df) == {"a": (5, "written"), "b": (1, "written"), None: (1, "written")}
    first = written()
    assert status(df.orderBy(F.desc("n"))) == {"a": (5, "unchanged"), "b": (1, "unchanged"), None: (1, "unchanged")}
    assert written() == first
    # One output changes with as many rows as before, one is new, and one is not given this time.
    assert status(spark.createDataFrame([*rows[:5], ("b", 2), ("c", 3)], "kind string, n long")) == {"a": (5, "unchanged"), "b": (1, "written"), "c": (1, "written")}
    later = written()
    assert {k for k, v in later.items() if first.get(k) != v} == {"kind=b", "kind=c"}
    got = outputs.read_outputs(spark, path, df.schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*rows[:5], ("b", 2), ("c", 3), (None, 9)], key=str)
    assert outputs.read_manifest(spark, path, outputs.manifest_of(df, "kind").schema).count() == 4
    assert status(spark.createDataFrame([], "kind string, n long")) == {}


def test_cleaned_names():
    names = ["a", "A", "a_2", "A ", "2nd try", "% of #", "--", "", "pitchData.startSpeed", "x", "PARKID"]
    got = cleaned_names(names)
    assert list(got.values()) == ["a", "a_3", "a_2", "a_4", "x2nd_try", "percent_of_number", "x", "x_2", "pitch_data_start_speed", "x_3", "parkid"]
    assert len(set(got.values())) == len(names)
    with pytest.raises(ValueError):
        cleaned_names(["a", "a"])


def test_park_reader_has_clean_names(spark, tmp_path):
    path = tmp_path / "parks.csv"
    path.write_text("PARKID,NAME,CITY,STATE,START,END,LEAGUE,NOTES,AKA,Exact,Latitude,Longitude,Altitude\nONE01,Coors Field,Denver,CO,19950426,,NL,,,Y,39.75,-104.99,5197\n")
    parks = files.read_parks(spark, str(path))
    assert parks.columns == "parkid name city state start end league notes aka exact latitude longitude altitude".split()
    assert cleaning.park_dimension(parks, cleaning.home_teams(spark), None).first().home_team == "Colorado Rockies"
    assert clean_names(spark.createDataFrame([(1, 2)], "`a b` long, a_b long")).first().asDict() == {"a_b": 1, "a_b_2": 2}


def test_fields_are_counted_by_hash_and_not_sorted(spark, tmp_path):
    """A sort of all fields of a task would grow with its lines."""
    for i, line in enumerate(['{"a": 1, "b": null}\n{"a": 2}\n', '{"a": 3, "c": "x"}\n']):
        (tmp_path / f"{i}.json").write_text(line)
    found = payloads.found_fields(spark, [str(tmp_path)])
    rows = {(r["name"], r["kind"]): (r["n"], r["file"].rpartition("/")[2]) for r in found.collect()}
    assert rows == {("a", "BIGINT"): (3, "0.json"), ("b", "VOID"): (1, "0.json"), ("c", "STRING"): (1, "1.json")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w*Aggregate)\(", plan)[-1] == "HashAggregate"  # the lowest in the plan, which reads the fields
