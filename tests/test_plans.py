"""The reports with their default parameters on a small two-season table, against pandas and numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paceshift.plans import altitude, cleaning, quality, tempo
from paceshift.plans.titles import titled
from paceshift.sources.schemas import PARKS

TEAMS = ["Colorado Rockies", "New York Mets", "Texas Rangers"]
SCHEMA = (
    "ingest_seq BIGINT, game_pk BIGINT, game_date DATE, start_time TIMESTAMP, play_id STRING, is_pitch BOOLEAN, "
    "pitch_number INT, inning INT, pitcher_name STRING, pitch_code STRING, pitch_desc STRING, men_on_base STRING, "
    "home_team STRING, fielding_team STRING, start_speed DOUBLE, spin_rate DOUBLE, details_event STRING, details_description STRING"
)
NAMES = {"FF": "Four-Seam Fastball", "SL": "Slider", "XX": None}
PITCHERS = ["Ana", "Bo", "Cy", "Di", None]


def season(year, seed):
    rng = random.Random(seed)
    rows, seq = [], 0
    for game in range(24):
        day = dt.date(year, 4, 1) + dt.timedelta(days=game // 2)
        clock = dt.datetime(year, 4, 1, 18) + dt.timedelta(days=game // 2)
        for inning in (1, 2, 3):
            pitcher = rng.choice(PITCHERS + (["Ed"] if year == 2022 else []))
            for i in range(20):
                clock += dt.timedelta(seconds=rng.choice([12, 15, 18.5, 20, 21, 30, 150]) - (year - 2022) * 2)
                code = rng.choice(["FF", "FF", "SL", "XX", None])
                pitch = rng.random() > 0.08
                rows.append(
                    (
                        seq, year * 100 + game, day, clock if rng.random() > 0.02 else None, f"{year}-{seq}", pitch,
                        i % 4 + 1 if pitch else None, inning, pitcher, code if pitch else None,
                        NAMES.get(code) if pitch else None, rng.choice(["Empty", "RISP", "Loaded", None]),
                        TEAMS[game % 3], TEAMS[(game + 1) % 3],
                        round(rng.gauss(93 if code == "FF" else 85, 2), 1) if rng.random() > 0.03 else None,
                        float(rng.randrange(2000, 2600)),
                        None if pitch or rng.random() < 0.5 else "Pickoff", "note" if not pitch else None,
                    )
                )
                seq += 1
    return rows


@pytest.fixture(scope="module")
def events(spark):
    raw = {y: spark.createDataFrame(season(y, y), SCHEMA) for y in (2022, 2023)}
    out = cleaning.enriched_events(raw).cache()
    yield out
    out.unpersist()


@pytest.fixture(scope="module")
def parks(spark):
    rows = [
        ("Coors Field", "Denver", "CO", 39.7, -104.9, 5197, "Colorado Rockies", "COL"),
        ("Citi Field", "New York", "NY", 40.7, -73.8, 13, "New York Mets", "NYM"),
        ("Globe Life Park", "Arlington", "TX", 32.7, -97.0, 541, "Texas Rangers", "TEX"),
        ("Abroad Stadium", "London", "EN", 51.5, 0.0, 206, None, None),
    ]
    return spark.createDataFrame(rows, PARKS)


@pytest.fixture(scope="module")
def pdf(events):
    out = events.toPandas()
    out["is_pitch"] = out.is_pitch.astype(bool)
    return out


def later(pdf, cap=True):
    kept = pdf[pdf.is_pitch & (pdf.pitch_number != 1) & pdf.pitch_number.notna()]
    return kept[kept.pitch_tempo < 120] if cap else kept


def wide(frame, key, value, fn="mean"):
    return frame.groupby([key, "year"], dropna=False)[value].agg(fn).unstack("year")


def test_tempo_by_runners(events, pdf):
    kept = later(pdf)
    kept = kept.assign(runners=np.where(kept.men_on_base == "Empty", "Empty", np.where(kept.men_on_base.isna(), None, "Men_On")))
    want = wide(kept, "runners", "pitch_tempo")
    for r in tempo.tempo_by_runners(events).where("runners IS NOT NULL").collect():
        a, b = want.loc[r.runners]
        assert (r.avg_tempo_2022, r.avg_tempo_2023) == (pytest.approx(a), pytest.approx(b))
        assert r.relative_change == pytest.approx((b - a) / a) and r.change_text == f"{(b - a) / a:.1%}"
    rounded = tempo.tempo_by_runners_rounded(events)
    assert rounded.count() == 3
    assert titled(rounded).columns == [
        "Baserunner State", "Average pitch tempo in 2022", "Average pitch tempo in 2023", "Change in pitch tempo",
    ]


def test_tempo_by_first_pitch_is_sorted(events, pdf):
    rows = tempo.tempo_by_first_pitch(events).collect()
    assert [r.pitch_of_at_bat for r in rows][:2] in (["1st pitch", "2nd+ pitch"], ["2nd+ pitch", "1st pitch"])
    assert rows[0].avg_tempo_2022 >= rows[1].avg_tempo_2022
    first = pdf[pdf.is_pitch & (pdf.pitch_number == 1) & (pdf.pitch_tempo > 0) & (pdf.pitch_tempo < 120)]
    got = {r.pitch_of_at_bat: r.avg_tempo_2023 for r in rows}
    assert got["1st pitch"] == pytest.approx(first[first.year == 2023].pitch_tempo.mean())


def test_team_change(events, pdf):
    want = wide(later(pdf), "fielding_team", "pitch_tempo").round(2)
    rows = tempo.team_change(events).collect()
    assert [r.tempo_change for r in rows] == sorted((r.tempo_change for r in rows), reverse=True)
    for r in rows:
        assert [r.avg_tempo_2022, r.avg_tempo_2023] == pytest.approx(list(want.loc[r.fielding_team]), abs=0.0051)


def test_median_leaders(events, pdf):
    want = wide(later(pdf, cap=False), "pitcher_name", "pitch_tempo", "median").dropna()
    want = want[want.index.notna()]
    got = tempo.pitcher_medians(events, 1).collect()
    assert {r.pitcher_name: (r.median_tempo_2022, r.median_tempo_2023) for r in got} == {
        name: tuple(row) for name, row in zip(want.index, want.values)
    }
    assert "Ed" not in {r.pitcher_name for r in got}
    slow = tempo.median_leaders(events, "median_tempo_2022", 1, k=1, largest=True).collect()
    assert {r.median_tempo_2022 for r in slow} == {want[2022].max()}
    change = tempo.median_leaders(events, "tempo_change", 1, k=2).collect()
    assert len(change) >= 2 and max(r.tempo_change for r in change) <= sorted(want[2023] - want[2022])[1] + 1e-9


def test_cohort_by_condition_or_population(events):
    by_type = tempo.pitcher_medians(events, 20, condition=F.col("pitch_code") == "SL")
    everyone = tempo.pitcher_medians(events, 1)
    assert by_type.count() <= everyone.count()
    assert tempo.pitcher_medians(events, 1, population=events.where("pitcher_name = 'Bo'")).count() == 1


def test_mean_leaders_and_changes(events, pdf):
    want = wide(later(pdf), "pitcher_name", "pitch_tempo").dropna()
    want = want[want.index.notna()]
    board = tempo.pitcher_change(events, 1).collect()
    assert len(board) == len(want)
    assert [r.tempo_change for r in board] == sorted(r.tempo_change for r in board)
    fast = tempo.mean_leaders(events, k=1).collect()
    assert fast[0].pitcher_name == want[2022].idxmin()
    assert tempo.mean_leaders(events, k=1, largest=True).collect()[0].pitcher_name == want[2022].idxmax()


def test_pitch_codes_need_both_labels(events, pdf):
    rows = quality.pitch_codes(events, 10).collect()
    assert [r.pitch_code for r in rows] == ["FF", "SL"]
    assert rows[0].n == len(pdf[pdf.is_pitch & (pdf.pitch_code == "FF")])
    assert quality.pitch_codes(events).count() == 0


def test_leaderboards(events, pdf):
    types = quality.pitch_codes(events, 10)
    rows = quality.leaderboards(events, types, 20).collect()
    assert {r.pitch_code for r in rows} == {"FF", "SL"}
    for r in rows:
        own = pdf[(pdf.pitch_code == r.pitch_code) & (pdf.pitcher_name.isna() if r.pitcher_name is None else pdf.pitcher_name == r.pitcher_name)]
        assert r.n == len(own) > 20
        assert r.velo == pytest.approx(own.start_speed.mean(), abs=0.0051)
        assert r.spin_rate == pytest.approx(own.spin_rate.mean(), abs=0.51)
    velo = [r.velo for r in rows if r.pitch_code == "FF"]
    assert velo == sorted(velo, reverse=True)
    one = quality.leaderboard(events, "SL", "spin_rate", 20)
    assert titled(one).columns == ["Pitcher", "Average Velocity (mph)", "Average Spin Rate (rpm)", "Number of Pitches Thrown"]
    spin = [r.spin_rate for r in one.collect()]
    assert spin == sorted(spin, reverse=True) and len(spin) == len([r for r in rows if r.pitch_code == "SL"])
    only = quality.leaderboards(events, types, 20, metric="spin_rate", periods=(2023,)).collect()
    assert {r.pitcher_name for r in only}.isdisjoint({"Ed"})
    assert quality.velo_spin_fit(quality.leaderboards(events, types, 20)).count() == 160


def test_by_type(events, pdf):
    pitches = pdf[pdf.is_pitch]
    n = pitches.groupby(["pitcher_name", "year"], dropna=False).size().unstack("year").fillna(0)
    cohort = [k for k in n.index if (n.loc[k] > 100).all()]
    inside = pitches[pitches.pitcher_name.isin([c for c in cohort if isinstance(c, str)]) | (pitches.pitcher_name.isna() & any(not isinstance(c, str) for c in cohort))]
    want = wide(inside[inside.pitch_desc.notna()], "pitch_desc", "start_speed")
    rows = quality.by_type(events, ["velo"], 100, 10).collect()
    assert {r.pitch_desc for r in rows} == set(want.index)
    for r in rows:
        assert [r.avg_velo_2022, r.avg_velo_2023] == pytest.approx(list(want.loc[r.pitch_desc]))
        assert r.velo_change == pytest.approx(want.loc[r.pitch_desc][2023] - want.loc[r.pitch_desc][2022])
    both = quality.by_type(events, min_type_rows=10, rounded=True)
    assert both.columns == ["pitch_desc", "avg_velo_2022", "avg_velo_2023", "avg_spin_rate_2022", "avg_spin_rate_2023", "velo_change", "spin_rate_change"]
    assert quality.by_type(events, ["velo"], None, None).count() == 2


def test_change_models_and_the_published_label(events, pdf):
    rows = pdf[pdf.is_pitch & (pdf.pitch_tempo < 120) & (pdf.pitch_code == "FF")]
    grouped = rows.groupby(["pitcher_name", "year"], dropna=False)
    v, t, n = (grouped[c].mean().unstack("year") for c in ("start_speed", "pitch_tempo", "ingest_seq"))
    n = grouped.size().unstack("year")
    keep = (n > 5).all(axis=1)
    x, y = (t[2023] - t[2022])[keep], (v[2023] - v[2022])[keep]
    slope, intercept = np.polyfit(x, y, 1)
    models = quality.change_models(events, "velo", min_rows=5)
    r = models.where("pitch_code = 'FF'").collect()[0]
    assert (r.n, r.slope, r.intercept) == (len(x), pytest.approx(slope), pytest.approx(intercept))
    fixed = quality.change_table(models).where("pitch_code = 'FF'").collect()[0]
    compat = quality.change_table(models, compat=True).where("pitch_code = 'FF'").collect()[0]
    assert fixed.diff_tempo_coefficient == pytest.approx(slope)
    assert compat.diff_tempo_coefficient == pytest.approx(intercept)
    assert compat.diff_tempo_p_value == r.intercept_p
    variant = quality.change_points(events, "spin_rate", 5, where=F.col("inning_count") != 1)
    assert variant.columns == ["pitch_code", "pitcher_name", "diff_spin_rate", "diff_tempo"]
    assert quality.change_fit(events, "velo", min_rows=5).where("pitch_code = 'FF'").count() == 80


def test_park_tempo_and_flag_summary(events, parks, pdf):
    want = wide(later(pdf), "home_team", "pitch_tempo")
    rows = altitude.park_tempo(events, parks).collect()
    assert [r.avg_tempo_2023 for r in rows] == sorted((r.avg_tempo_2023 for r in rows), reverse=True)
    for r in rows:
        assert [r.avg_tempo_2022, r.avg_tempo_2023] == pytest.approx(list(want.loc[r.home_team]))
    kept = later(pdf, cap=False)
    kept = kept.assign(place=np.where(kept.home_team == "Colorado Rockies", "flagged", "elsewhere"))
    mean, median = wide(kept, "place", "pitch_tempo"), wide(kept, "place", "pitch_tempo", "median")
    for r in altitude.flag_summary(events, parks, F.col("abbr") == "COL").collect():
        assert [r.mean_2022, r.mean_2023] == pytest.approx(list(mean.loc[r.place]))
        assert [r.median_2022, r.median_2023] == pytest.approx(list(median.loc[r.place]))
    assert altitude.flag_density(events, parks, F.col("abbr") == "COL").count() == 4 * 512


def dense(rows, moderator):
    rows = rows.dropna(subset=["start_speed", "pitch_tempo", "pitcher_name"])
    dummies = pd.get_dummies(rows.pitcher_name).astype(float)
    design = np.column_stack([rows.pitch_tempo, rows.pitch_tempo * moderator(rows), dummies])
    beta = np.linalg.lstsq(design, rows.start_speed, rcond=None)[0]
    return beta, len(rows) - design.shape[1], dict(zip(dummies.columns, beta[2:]))


@pytest.mark.parametrize("row_scope", ["type", "all"])
def test_fixed_effects_grid(events, parks, pdf, row_scope):
    flag = F.col("abbr") == "COL"
    options = dict(min_pitches=20, min_type_rows=10, row_scope=row_scope)
    models = sorted(altitude.fixed_effects_grid(events, parks, flag, **options).collect(), key=lambda m: (m.pitch_code, m.year))
    assert {(r.pitch_code, r.year) for r in models} == {(c, y) for c in ("FF", "SL") for y in (2022, 2023)}
    for r in models:
        n = pdf[pdf.pitch_code == r.pitch_code].groupby(["pitcher_name", "year"]).size().unstack("year").fillna(0)
        cohort = n.index[(n > 20).all(axis=1)]
        rows = later(pdf)
        rows = rows[(rows.year == r.year) & rows.pitcher_name.isin(cohort)]
        if row_scope == "type":
            rows = rows[rows.pitch_code == r.pitch_code]
        beta, dof, own = dense(rows, lambda f: (f.home_team == "Colorado Rockies").astype(float))
        assert r.df == dof
        assert [r.b_t, r.b_z] == pytest.approx(list(beta[:2]))
    effects = altitude.fixed_effects_grid(events, parks, flag, types=["SL"], model_years=(2023,), effects=True, **options)
    assert {e.pitcher_name: e.effect for e in effects.collect()} == pytest.approx(own)


def test_altitude_model_includes_first_pitches(events, parks, pdf):
    r = altitude.altitude_model(events, parks, min_pitches=20).collect()
    assert [(x.pitch_code, x.year) for x in r] == [("FF", 2022)]
    n = pdf[pdf.pitch_code == "FF"].groupby(["pitcher_name", "year"]).size().unstack("year").fillna(0)
    rows = pdf[pdf.is_pitch & (pdf.pitch_tempo < 120) & (pdf.year == 2022) & (pdf.pitch_code == "FF")]
    rows = rows[rows.pitcher_name.isin(n.index[(n > 20).all(axis=1)])]
    feet = {"Colorado Rockies": 5197.0, "New York Mets": 13.0, "Texas Rangers": 541.0}
    beta, dof, _ = dense(rows, lambda f: f.home_team.map(feet))
    assert r[0].df == dof and [r[0].b_t, r[0].b_z] == pytest.approx(list(beta[:2]), rel=1e-6)
    with pytest.raises(ValueError):
        altitude.altitude_model(events, parks, row_scope="some")


def test_inspection(events, pdf):
    top = tempo.longest_tempos(events, 5).collect()
    kept = pdf[pdf.is_pitch & (pdf.inning_count != 1)].pitch_tempo
    assert len(top) >= 5 and min(r.pitch_tempo for r in top) == kept.nlargest(5).min()
    assert min(r.pitch_tempo for r in tempo.shortest_tempos(events, 3).collect()) == pdf.pitch_tempo.min()
    assert tempo.game_rows(events, 202203).count() == 60
    by_event = {r.details_event: r.n for r in tempo.action_counts(events, 2022).collect()}
    actions = pdf[~pdf.is_pitch & (pdf.year == 2022)]
    assert by_event == {"Pickoff": (actions.details_event == "Pickoff").sum(), None: actions.details_event.isna().sum()}
    assert {r.details_description for r in tempo.unlabelled_action_counts(events, 2023).collect()} == {"note"}


def test_distributions(events, pdf):
    bins = tempo.tempo_histogram(events)
    inside = pdf[pdf.is_pitch & pdf.pitch_tempo.between(0, 120)]
    assert sum(r.n for r in bins.collect()) == len(inside)
    assert tempo.tempo_density(events).count() == 2 * 512
    assert tempo.tempo_density(events, where=F.col("inning_count") != 1).count() == 2 * 512
    by_runners = tempo.tempo_density_by(events, tempo.runners(), where=tempo.pitches(first=False))
    assert {r.facet for r in by_runners.collect()} == {"Empty", "Men_On", None}
