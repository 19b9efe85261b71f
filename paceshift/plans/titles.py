"""Display names for report columns; ``{0}`` and ``{1}`` stand for the two periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from .tempo import PERIODS

# Column titles of the printed tables.
TITLES = {
    "runners": "Baserunner State",
    "pitch_of_at_bat": "Pitch number of at-bat",
    "fielding_team": "Team",
    "home_team": "Team",
    "pitcher_name": "Pitcher",
    "pitch_desc": "Pitch Type",
    "pitch_code": "Pitch Code",
    "park_name": "Ballpark",
    "altitude": "Altitude",
    "avg_tempo_{0}": "Average pitch tempo in {0}",
    "avg_tempo_{1}": "Average pitch tempo in {1}",
    "change_text": "Change in pitch tempo",
    "tempo_change": "Change in pitch tempo",
    "avg_velo_{0}": "Average Pitch Velocity in {0}",
    "avg_velo_{1}": "Average Pitch Velocity in {1}",
    "velo_change": "Change in Average Velocity",
    "avg_spin_rate_{0}": "Average Spin Rate in {0}",
    "avg_spin_rate_{1}": "Average Spin Rate in {1}",
    "spin_rate_change": "Change in Spin Rate",
    "velo": "Average Velocity (mph)",
    "spin_rate": "Average Spin Rate (rpm)",
    "n": "Number of Pitches Thrown",
}


def titled(
    report: DataFrame, periods: Sequence = PERIODS, titles: Mapping[str, str] = TITLES
) -> DataFrame:
    """A report under its display names; other columns keep their own."""
    names = {k.format(*periods): v.format(*periods) for k, v in titles.items()}
    return report.toDF(*[names.get(c, c) for c in report.columns])
