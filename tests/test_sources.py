import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceshift.plans import altitude, cleaning
from paceshift.sources import files, landing
from paceshift.sources.schemas import ENRICHED, EVENTS, LEADERBOARD, PARKS, PARKS_RAW, SCHEDULE

PARKS_TEXT = """PARKID,NAME,CITY,STATE,START,END,LEAGUE,NOTES,AKA,Exact,Latitude,Longitude,Altitude
ONE01,Coors Field,Denver,CO,19950426,,NL,,,Y,39.75,-104.99,5197
TWO01,Old Grounds,Baltimore,MD,18710708,18710708,NA,WS3,,Y,39.30,-76.63,167
TRE01,No Start Park,Nowhere,XX,,,NA,,,N,NaN,2.5,10
FOU01,Abroad Stadium,London,EN,20190629,,AL,,"",Y,51.53,-0.01,206
"""


def test_csv_rules_for_missing_text(spark, tmp_path):
    path = tmp_path / "parks.csv"
    path.write_text(PARKS_TEXT)
    merged = files.read_csv(spark, str(path), PARKS_RAW)
    kept = files.read_csv(spark, str(path), PARKS_RAW, null_value=None)
    assert merged.where("LEAGUE IS NULL").count() == 2 and kept.where("LEAGUE = 'NA'").count() == 2
    assert kept.where("END IS NULL").count() == 3 and kept.where("AKA IS NULL").count() == 4
    assert kept.schema["Altitude"].dataType == T.IntegerType() and kept.where("Latitude IS NULL").count() == 1


def test_bad_rows_fail_or_are_kept(spark, tmp_path):
    path = tmp_path / "board.csv"
    path.write_text("entity_name,entity_id\n\"Doe, Jo\",1\n\"Roe, Al\",x\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(path), LEADERBOARD).collect()
    rows = files.read_csv(spark, str(path), LEADERBOARD, fail_on_bad_rows=False).collect()
    assert [(r.entity_name, r.entity_id) for r in rows] == [("Doe, Jo", 1), ("Roe, Al", None)]
    assert "x" in rows[1]._corrupt_record


def test_park_dimension(spark, tmp_path):
    path = tmp_path / "parks.csv"
    path.write_text(PARKS_TEXT)
    parks = cleaning.park_dimension(
        files.read_csv(spark, str(path), PARKS_RAW, null_value=None), cleaning.home_teams(spark)
    )
    assert [f.dataType for f in parks.schema] == [f.dataType for f in PARKS]
    got = {r.park_name: (r.altitude, r.home_team, r.abbr) for r in parks.collect()}
    assert got == {
        "Coors Field": (5197, "Colorado Rockies", "COL"),
        "Abroad Stadium": (206, None, None),
        "Globe Life Park": (541, "Texas Rangers", "TEX"),
    }
    ranked = altitude.altitude_ranking(parks).collect()
    assert [(r.position, r.label, r.band) for r in ranked] == [
        (1, "Coors Field (COL)", "above_1000"),
        (2, "Globe Life Park (TEX)", None),
    ]
    assert len(cleaning.HOME_TEAMS) == 29


#: The 31 parks in use with altitude, home team and abbreviation.
PARKS_IN_USE = """Angel Stadium of Anaheim,154,Los Angeles Angels,LAA
SunTrust Park,981,Atlanta Braves,ATL
Oriole Park at Camden Yards,35,Baltimore Orioles,BAL
Fenway Park,16,Boston Red Sox,BOS
Wrigley Field,599,Chicago Cubs,CHC
Guarantee Rate Park,594,Chicago White Sox,CHW
Great American Ballpark,489,Cincinnati Reds,CIN
Progressive Field,673,Cleveland Guardians,CLE
Coors Field,5197,Colorado Rockies,COL
Comerica Park,602,Detroit Tigers,DET
Minute Maid Park,20,Houston Astros,HOU
Kauffman Stadium,886,Kansas City Royals,KCR
Olympic Stadium,206,,
Dodger Stadium,501,Los Angeles Dodgers,LAD
Marlins Park,6,Miami Marlins,MIA
Miller Park,602,Milwaukee Brewers,MIL
Target Field,840,Minnesota Twins,MIN
Citi Field,13,New York Mets,NYM
New Yankee Stadium,11,New York Yankees,NYY
Oakland-Alameda County Coliseum,0,Oakland Athletics,OAK
Citizens Bank Park,19,Philadelphia Phillies,PHI
Chase Field,1059,Arizona Diamondbacks,ARI
PNC Park,724,Pittsburgh Pirates,PIT
Petco Park,14,San Diego Padres,SDP
T-Mobile Park,17,Seattle Mariners,SEA
Oracle Park,8,San Francisco Giants,SFG
Busch Stadium III,438,St. Louis Cardinals,STL
Tropicana Field,41,Tampa Bay Rays,TBR
Rogers Centre,268,Toronto Blue Jays,TOR
Nationals Park,23,Washington Nationals,WSN
Globe Life Park,541,Texas Rangers,TEX"""


def test_all_parks_in_use(spark, tmp_path):
    want = [tuple(x or None for x in line.split(",")) for line in PARKS_IN_USE.split("\n")]
    lines = [f"P{i},{name},c,s,19900401,,NL,,,Y,1.5,2.5,{altitude}" for i, (name, altitude, *_) in enumerate(want[:-1])]
    lines += ["P90,Old Grounds,c,s,18710708,18710708,NA,,,Y,1,2,3", "P91,No Start,c,s,,,NA,,,Y,1,2,3"]
    path = tmp_path / "parks.csv"
    path.write_text("\n".join([PARKS_TEXT.split("\n")[0], *lines]) + "\n")
    parks = cleaning.park_dimension(files.read_csv(spark, str(path), PARKS_RAW, null_value=None), cleaning.home_teams(spark))
    got = {(r.park_name, str(r.altitude), r.home_team, r.abbr) for r in parks.collect()}
    assert len(want) == 31 and got == set(want)
    labels = {r.home_team: (r.label, r.abbr) for r in altitude.altitude_ranking(parks).collect()}
    assert len(labels) == 30 and labels["Arizona Diamondbacks"] == ("Chase Field (ARI)", "AZ")


def test_bands_are_open(spark):
    values = [1001, 1000, 950, 900, 899, 751, 750]
    out = spark.createDataFrame([(v,) for v in values], "altitude INT").select(altitude.altitude_band())
    assert [r[0] for r in out.collect()] == [
        "above_1000", None, "900_to_1000", None, "750_to_900", "750_to_900", None,
    ]


def test_abbreviations(spark):
    out = spark.createDataFrame([("CHW",), ("NYM",), (None,)], "abbr STRING").select(altitude.clean_abbr())
    assert [r[0] for r in out.collect()] == ["CWS", "NYM", None]


RAW = ["game_pk", "game_date", "startTime", "isPitch", "about.inning", "matchup.pitcher.fullName", "details.type.code", "unused", "pitchData.startSpeed"]


def test_raw_events_of_two_seasons_with_their_own_headers(spark, tmp_path):
    old, new = tmp_path / "old.csv", tmp_path / "new.csv"
    old.write_text(",".join(RAW) + "\n1,2022-04-01,2022-04-01T19:00:00.000Z,TRUE,1,A,FF,zzz,95.5\n1,2022-04-01,NA,FALSE,1,NA,NA,,NA\n")
    header = ["details.violation.type", *reversed(RAW)]  # another order, and a column that the old season lacks
    new.write_text(",".join(header) + "\nclock,90.25,x,SL,B,2,TRUE,2023-04-01T19:00:00.000Z,2023-04-01,2\n")
    df = files.read_raw_events(spark, [str(old), str(new)])
    assert df.columns == [*EVENTS.names, "ingest_seq"]
    assert df.schema["violation_player_id"].dataType == T.LongType()
    rows = {(r.game_pk, r.pitch_code): r for r in df.collect()}
    first, empty, other = rows[1, "FF"], rows[1, None], rows[2, "SL"]
    assert (first.is_pitch, first.start_speed, first.pitcher_name, first.violation_type) == (True, 95.5, "A", None)
    assert (empty.start_time, empty.pitcher_name, empty.start_speed) == (None, None, None)
    assert (other.is_pitch, other.start_speed, other.pitcher_name, other.inning, other.violation_type) == (True, 90.25, "B", 2, "clock")


def test_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("entity_id,entity_name\n1,x\n")
    (tmp_path / "b.csv").write_text("entity_name,entity_id\ny,2\n")
    rows = files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], LEADERBOARD).collect()
    assert sorted((r.entity_name, r.entity_id) for r in rows) == [("x", 1), ("y", 2)]
    with pytest.raises(Exception):  # a folder with two headers
        files.read_csv(spark, str(tmp_path), LEADERBOARD).collect()
    (tmp_path / "c.csv").write_text("entity_name\nz\n")
    with pytest.raises(ValueError, match="entity_id"):
        files.read_csv(spark, str(tmp_path / "c.csv"), LEADERBOARD)
    rows = files.read_csv(spark, str(tmp_path / "c.csv"), LEADERBOARD, optional=["entity_id"]).collect()
    assert [(r.entity_name, r.entity_id) for r in rows] == [("z", None)]


def test_kept_columns_of_a_raw_table(spark):
    header = [
        "game_pk", "startTime", "details.event", "dropped.a", "about.atBatIndex", "about.inning", "matchup.batter.id",
        "matchup.pitcher.fullName", "matchup.pitchHand.description", "home_team", "away_team", "batting_team",
        "fielding_team", "details.type.code", "details.violation.description", "details.violation.type",
        "pitchData.typeConfidence", "dropped.b", "pitchData.breaks.breakAngle", "pitchData.breaks.spinDirection",
        "matchup.splits.menOnBase",
    ]
    raw = spark.createDataFrame([tuple(range(len(header)))], header)
    kept = cleaning.select_event_columns(raw)
    assert set(header) - set(kept.columns) == {"dropped.a", "dropped.b"} and len(kept.columns) == len(header) - 2


def test_seasons_from_files_to_partitioned_table(spark, tmp_path):
    def season(rows, extra=False):
        df = spark.createDataFrame(rows, "ingest_seq BIGINT, game_pk BIGINT, game_date STRING, start_time STRING, is_pitch BOOLEAN, inning INT, pitcher_name STRING")
        df = df.withColumns({"game_date": F.to_date("game_date"), "start_time": F.to_timestamp("start_time")})
        return df.withColumn("violation_type", F.lit("clock")) if extra else df

    old = season([(0, 1, "2022-04-01", "2022-04-01 10:00:00", True, 1, "A"), (1, 1, "2022-04-01", "2022-04-01 10:00:30", True, 1, "A")])
    new = season([(0, 2, "2023-04-01", "2023-04-01 10:00:00", True, 1, "A"), (1, 2, "2023-04-01", "2023-04-01 10:00:19", True, 1, "A")], True)
    events = cleaning.enriched_events({2022: old, 2023: new})
    files.write_partitioned(events, str(tmp_path / "out"), "year")
    back = files.read_enriched(spark, str(tmp_path / "out"))
    assert back.columns == ENRICHED.names or set(back.columns) == set(ENRICHED.names)
    got = {(r.year, r.season_count): (r.pitch_tempo, r.violation_type) for r in back.collect()}
    assert got == {(2022, 1): (None, None), (2022, 2): (30.0, None), (2023, 1): (None, "clock"), (2023, 2): (19.0, "clock")}
    plan = back.where("year = 2023")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    files.write_csv(events.select("game_pk", "violation_type"), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "NA" in text and "game_pk,violation_type" in text


def test_landing_and_manifest(spark, tmp_path):
    pitch = {"game_pk": 1, "game_date": "2022-04-01", "startTime": "2022-04-01T19:00:00.000Z", "isPitch": True, "about.inning": 1, "matchup.pitcher.fullName": "A", "other": 1}
    (tmp_path / "a.json").write_text(json.dumps(pitch) + "\n" + json.dumps({"game_pk": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"game_pk": 2, "details.violation.type": "clock"}))
    paths = [str(tmp_path / "a.json"), str(tmp_path / "b.json")]
    events = landing.landed_events(spark, paths)
    assert events.columns == EVENTS.names and events.count() == 3
    full = events.where("is_pitch").collect()[0]
    assert (full.game_pk, full.inning, full.pitcher_name, str(full.game_date), full.start_time is None) == (1, 1, "A", "2022-04-01", False)
    assert events.where("violation_type = 'clock'").count() == 1
    with pytest.raises(ValueError, match="isPitch"):
        landing.landed_events(spark, paths[1:])
    (tmp_path / "a.csv").write_text(",".join(RAW) + "\n7,2022-04-01,NA,TRUE,1,A,FF,,1\n")
    assert [(r.game_pk, r.pitcher_name) for r in landing.landed_events(spark, [str(tmp_path / "a.csv")], "csv").collect()] == [(7, "A")]
    schedule = spark.createDataFrame(
        [(1, "2022-04-01", "F", "R"), (1, "2022-04-01", "F", "R"), (2, "2022-04-02", "F", "S"), (3, "2023-04-02", "F", "R")],
        SCHEDULE,
    )
    games = landing.season_games(schedule, 2022, F.col("status_ind") == "F", F.col("game_type") == "R")
    assert [tuple(r) for r in games.collect()] == [(1, 2)]
    assert landing.ingest(events, games).count() == 2
    days = landing.calendar_between(spark, "2023-03-30", "2023-10-01")
    assert days.count() == 186
    assert [r.game_pk for r in landing.games_on_days(schedule, days).collect()] == [3]
    assert landing.season_games(schedule, 2022).count() == 2
