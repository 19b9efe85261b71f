"""Declared schemas. Nothing is inferred: a column empty for a whole season has no type to guess."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}


def _schema(text: str) -> T.StructType:
    """A schema from ``name TYPE`` pairs; unlike Spark's own DDL reader it needs no session."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


EVENTS = _schema(
    """
    game_pk BIGINT, game_date DATE, start_time TIMESTAMP, play_id STRING, is_pitch BOOLEAN, pitch_number INT,
    details_description STRING, details_event STRING, pitch_code STRING, pitch_desc STRING,
    violation_description STRING, violation_player_name STRING, violation_player_id BIGINT,
    violation_type STRING, at_bat_index INT, inning INT, batter_id BIGINT, pitcher_name STRING,
    pitch_hand STRING, men_on_base STRING, home_team STRING, away_team STRING, batting_team STRING,
    fielding_team STRING, start_speed DOUBLE, type_confidence DOUBLE, break_angle DOUBLE,
    spin_rate DOUBLE, spin_direction DOUBLE
    """
)

# Header names of the raw event files and the columns they become.
EVENT_HEADER = {
    "game_pk": "game_pk",
    "game_date": "game_date",
    "startTime": "start_time",
    "playId": "play_id",
    "isPitch": "is_pitch",
    "pitchNumber": "pitch_number",
    "details.description": "details_description",
    "details.event": "details_event",
    "details.type.code": "pitch_code",
    "details.type.description": "pitch_desc",
    "details.violation.description": "violation_description",
    "details.violation.player.fullName": "violation_player_name",
    "details.violation.player.id": "violation_player_id",
    "details.violation.type": "violation_type",
    "about.atBatIndex": "at_bat_index",
    "about.inning": "inning",
    "matchup.batter.id": "batter_id",
    "matchup.pitcher.fullName": "pitcher_name",
    "matchup.pitchHand.description": "pitch_hand",
    "matchup.splits.menOnBase": "men_on_base",
    "home_team": "home_team",
    "away_team": "away_team",
    "batting_team": "batting_team",
    "fielding_team": "fielding_team",
    "pitchData.startSpeed": "start_speed",
    "pitchData.typeConfidence": "type_confidence",
    "pitchData.breaks.breakAngle": "break_angle",
    "pitchData.breaks.spinRate": "spin_rate",
    "pitchData.breaks.spinDirection": "spin_direction",
}

#: Raw fields without which a file is not one of events.
REQUIRED = ("game_pk", "game_date", "startTime", "isPitch", "about.inning", "matchup.pitcher.fullName")

# Columns and column ranges of the raw files that the analysis keeps.
EVENT_RANGES = [
    ("game_pk", "details.event"),
    ("about.atBatIndex", "about.inning"),
    ("matchup.batter.id", "matchup.pitchHand.description"),
    "home_team",
    "away_team",
    "batting_team",
    "fielding_team",
    ("details.type.code", "pitchData.typeConfidence"),
    ("pitchData.breaks.breakAngle", "pitchData.breaks.spinDirection"),
    "matchup.splits.menOnBase",
    ("details.violation.description", "details.violation.type"),
]

ENRICHED = T.StructType(
    EVENTS.fields
    + _schema(
        "ingest_seq BIGINT, year INT, season_count BIGINT, game_count BIGINT, inning_count BIGINT, pitch_tempo DOUBLE"
    ).fields
)

PARKS_RAW = _schema(
    """
    PARKID STRING, NAME STRING, CITY STRING, STATE STRING, START STRING, END STRING, LEAGUE STRING,
    NOTES STRING, AKA STRING, Exact STRING, Latitude DOUBLE, Longitude DOUBLE, Altitude INT
    """
)

PARKS = _schema(
    """
    park_name STRING, city STRING, state STRING, latitude DOUBLE, longitude DOUBLE, altitude INT,
    home_team STRING, abbr STRING
    """
)

LEADERBOARD = _schema("entity_name STRING, entity_id BIGINT")

SCHEDULE = _schema("game_pk BIGINT, game_date STRING, status_ind STRING, game_type STRING")
