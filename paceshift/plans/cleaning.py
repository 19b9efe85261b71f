"""From raw seasons, parks and leaderboards to the analysis tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import full_name
from ..operators.reshape import all_fields, append_row, select_ranges, split_name, union_seasons
from ..operators.sequence import EventColumns, enrich
from ..sources.schemas import EVENT_RANGES, PARKS

# Home team and abbreviation of each park in use, by park name.
HOME_TEAMS = [
    ("Angel Stadium of Anaheim", "Los Angeles Angels", "LAA"),
    ("SunTrust Park", "Atlanta Braves", "ATL"),
    ("Oriole Park at Camden Yards", "Baltimore Orioles", "BAL"),
    ("Fenway Park", "Boston Red Sox", "BOS"),
    ("Wrigley Field", "Chicago Cubs", "CHC"),
    ("Guarantee Rate Park", "Chicago White Sox", "CHW"),
    ("Great American Ballpark", "Cincinnati Reds", "CIN"),
    ("Progressive Field", "Cleveland Guardians", "CLE"),
    ("Coors Field", "Colorado Rockies", "COL"),
    ("Comerica Park", "Detroit Tigers", "DET"),
    ("Minute Maid Park", "Houston Astros", "HOU"),
    ("Kauffman Stadium", "Kansas City Royals", "KCR"),
    ("Dodger Stadium", "Los Angeles Dodgers", "LAD"),
    ("Marlins Park", "Miami Marlins", "MIA"),
    ("Miller Park", "Milwaukee Brewers", "MIL"),
    ("Target Field", "Minnesota Twins", "MIN"),
    ("Citi Field", "New York Mets", "NYM"),
    ("New Yankee Stadium", "New York Yankees", "NYY"),
    ("Oakland-Alameda County Coliseum", "Oakland Athletics", "OAK"),
    ("Citizens Bank Park", "Philadelphia Phillies", "PHI"),
    ("Chase Field", "Arizona Diamondbacks", "ARI"),
    ("PNC Park", "Pittsburgh Pirates", "PIT"),
    ("Petco Park", "San Diego Padres", "SDP"),
    ("T-Mobile Park", "Seattle Mariners", "SEA"),
    ("Oracle Park", "San Francisco Giants", "SFG"),
    ("Busch Stadium III", "St. Louis Cardinals", "STL"),
    ("Tropicana Field", "Tampa Bay Rays", "TBR"),
    ("Rogers Centre", "Toronto Blue Jays", "TOR"),
    ("Nationals Park", "Washington Nationals", "WSN"),
]

# The park opened after the list of parks was published.
LATE_PARK = {
    "park_name": "Globe Life Park",
    "city": "Arlington",
    "state": "TX",
    "latitude": 32.7512802,
    "longitude": -97.082504,
    "altitude": 541,
    "home_team": "Texas Rangers",
    "abbr": "TEX",
}


def select_event_columns(raw: DataFrame, ranges: Sequence = EVENT_RANGES) -> DataFrame:
    """The kept columns of a raw season table that still has its original header."""
    return select_ranges(raw, *ranges)


def enriched_events(seasons: Mapping[int, DataFrame], columns: EventColumns = EventColumns()) -> DataFrame:
    """Append the seasons, then add counts and tempo: the season is a key of every window, so one pass
    serves them all. Columns that a season lacks become typed nulls; one name with two types is an error."""
    tagged = [s.withColumn(columns.season, F.lit(y)) for y, s in seasons.items()]
    return enrich(union_seasons(tagged, all_fields(tagged)), columns)


def home_teams(spark, teams: Sequence[tuple[str, str, str]] = HOME_TEAMS) -> DataFrame:
    names = ("park_name", "home_team", "abbr")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, team, strict=True)]) for team in teams])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.*")


def park_dimension(
    parks_raw: DataFrame, teams: DataFrame, late_park: Mapping | None = LATE_PARK
) -> DataFrame:
    """Parks in use with their home team, found by park name; a park without a team is kept."""
    in_use = parks_raw.where(F.col("END").isNull() & F.col("START").isNotNull())
    named = in_use.select(
        F.col("NAME").alias("park_name"),
        F.col("CITY").alias("city"),
        F.col("STATE").alias("state"),
        F.col("Latitude").alias("latitude"),
        F.col("Longitude").alias("longitude"),
        F.col("Altitude").alias("altitude"),
    )
    parks = named.join(teams, "park_name", "left").select(
        *[F.col(f.name).cast(f.dataType) for f in PARKS.fields]
    )
    return append_row(parks, **late_park) if late_park else parks


def two_season_entities(
    leaderboard: DataFrame, name: str = "entity_name", entity: str = "entity_id"
) -> DataFrame:
    """Entities listed more than once, with 'Last, First' turned into 'First Last'."""
    listed = leaderboard.groupBy(name, entity).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    parts = split_name(listed, name, ["last_name", "first_name"])
    return parts.select(full_name("first_name", "last_name").alias("pitcher_name"), entity)
