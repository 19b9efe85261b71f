"""How the given tables play the parts of the event table and its dimensions.

``lineitem`` is the season star: supplier = pitcher, ship year = season, quantity = tempo, price = velocity,
discount = spin, return flag = pitch type. ``events`` is the event sequence, for which counts and tempo are
derived. A few derived nulls exercise the rules for missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import in_years
from ..operators.sequence import EventColumns
from ..plans.cleaning import park_dimension

P0, P1 = 1998, 1999
PERIODS = (P0, P1)
CAP = 45.0
EVENT_PERIODS = (1, 2)

EVENT_COLUMNS = EventColumns()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STAR = {
    "year": "year(l_shipdate)",
    "game_date": "to_date(l_shipdate)",
    "game_pk": "l_orderkey",
    "pitcher_name": "nullif(l_suppkey, 7)",
    "pitch_code": "l_returnflag",
    "pitch_desc": "if(l_returnflag = 'N' and l_linestatus = 'F', null, concat('type_', l_returnflag))",
    "is_pitch": "l_tax < 0.08",
    "pitch_number": "l_linenumber",
    "inning_count": "l_partkey % 6 + 1",
    "men_on_base": "if(l_linestatus = 'O', 'Empty', 'RISP')",
    "pitch_tempo": "nullif(l_quantity, 13.0D)",
    "start_speed": "l_extendedprice",
    "spin_rate": "l_discount",
}


def seasons(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The rows of the two periods, with bounds that reach the scan; or the whole table, where periods are not the point."""
    rows = table(spark, sf_dir, "lineitem")
    return rows if whole else rows.where(in_years(rows, "l_shipdate", P0, P1))


def star(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return seasons(spark, sf_dir, whole).selectExpr(*[f"{e} AS {name}" for name, e in STAR.items()])


def star_with_fielding_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitcher's team: supplier and its nation."""
    teams = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    rows = seasons(spark, sf_dir).join(teams, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.selectExpr(*[f"{e} AS {name}" for name, e in STAR.items()], "n_name AS fielding_team")


def star_with_home_team(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The place of the game: nation of the order's customer, so it varies within a pitcher."""
    places = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "n_name")
    )
    rows = seasons(spark, sf_dir, whole).join(places, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.selectExpr(*[f"{e} AS {name}" for name, e in STAR.items()], "n_name AS home_team")


def nation_parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name AS home_team",
        "concat('Park ', n_nationkey) AS park_name",
        "n_nationkey * 100 AS altitude",
        "concat('N', n_nationkey) AS abbr",
    )


def at_flagged_park() -> Column:
    return F.col("abbr") == "N0"


def parks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey AS string) AS PARKID",
        "s_name AS NAME",
        "concat('city_', s_nationkey) AS CITY",
        "concat('state_', s_nationkey % 5) AS STATE",
        "if(s_nationkey = 3, null, '19900401') AS START",
        "if(s_acctbal < 0, '20001001', null) AS END",
        "s_acctbal / 100 AS Latitude",
        "s_acctbal / -200 AS Longitude",
        "cast(abs(floor(s_acctbal)) % 1300 AS int) AS Altitude",
    )


def park_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home team of each park; parks in one nation have none."""
    return (
        table(spark, sf_dir, "supplier")
        .where("s_nationkey <> 9")
        .selectExpr("s_name AS park_name", "concat('Team ', s_suppkey) AS home_team", "concat('T', s_suppkey) AS abbr")
    )


EXTRA_PARK = {
    "park_name": "Late Park",
    "city": "city_0",
    "state": "state_0",
    "latitude": 32.75,
    "longitude": -97.125,
    "altitude": 541,
    "home_team": "Late Team",
    "abbr": "LATE",
}


def supplier_parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return park_dimension(parks_raw(spark, sf_dir), park_teams(spark, sf_dir), EXTRA_PARK)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before enrichment. Three games a day, four innings a game, nine named pitchers."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS ingest_seq",
        "if(day(ts) <= 15, 1, 2) AS year",
        "to_date(ts) AS game_date",
        "cast(datediff(to_date(ts), date'2024-01-01') * 3 + user_id % 3 AS bigint) AS game_pk",
        "cast(floor(hour(ts) / 6) + 1 AS int) AS inning",
        "if(event_id % 97 = 0, null, cast(ts AS timestamp)) AS start_time",
        "nullif(user_id % 10, 0) AS pitcher_name",
        "event_type <> 'error' AS is_pitch",
        "cast(event_id % 5 + 1 AS int) AS pitch_number",
        "concat('p', event_id) AS play_id",
        "event_type AS pitch_code",
        "concat('type_', event_type) AS pitch_desc",
        "if(event_id % 3 = 0, null, concat('action_', user_id % 4)) AS details_event",
        "concat('about_', user_id % 5) AS details_description",
        "if(user_id % 4 = 0, 'Empty', 'Men') AS men_on_base",
        "value AS start_speed",
    )
