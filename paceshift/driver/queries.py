"""One callable per operator and report, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import profile, reshape
from ..operators.cohort import qualify
from ..operators.distribution import histogram, kernel_density
from ..operators.numbering import group_numbers, rank_descending, split_order
from ..operators.reuse import shared_folder, written_once
from ..operators.sequence import add_gap, attach_by_id, enrich, running_counts
from ..operators.topk import bottom_k, top_k
from ..plans import altitude, cleaning, quality, tempo
from ..sources import landing, outputs, payloads
from . import roles as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PER = {"periods": R.PERIODS}
MIN_PITCHES = 60
MIN_TYPE_PITCHES = 22
MIN_TYPE_ROWS = 500


def comparable(x: str) -> Column:
    """Six digits, after nine: noise in the last bits of a distributed sum can't put a value on either side of a tie.

    Multiplied, rounded and divided as the checking SQL does; all of it in doubles, so large values stay as they are.
    """
    number = F.nanvl(F.col(x), F.lit(None).cast("double"))
    for scale in (1e9, 1e6):
        number = F.round(number * F.lit(scale)) / F.lit(scale)
    return number


def finish(df: DataFrame) -> DataFrame:
    """Make results comparable: doubles rounded, so that the order of distributed additions cannot show;
    dates and times as text, so that no client time zone can."""
    shown = {
        T.DoubleType: comparable,
        T.DateType: lambda c: F.col(c).cast("string"),
        T.TimestampType: lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    }
    columns = {f.name: shown[type(f.dataType)](f.name) for f in df.schema.fields if type(f.dataType) in shown}
    return df.withColumns(columns) if columns else df


def register(name: str, fn: Query) -> None:
    QUERIES[f"q_{name}"] = lambda spark, sf_dir: finish(fn(spark, sf_dir))


def query(fn: Query) -> Query:
    register(fn.__name__.rstrip("_"), fn)
    return fn


# Sources, inspection, reshaping


@query
def manifest_ingest(spark, sf_dir):
    schedule = R.table(spark, sf_dir, "orders")
    finished, regular = F.col("o_orderstatus") == "F", F.col("o_orderpriority") != "5-LOW"
    games = landing.season_games(schedule, R.P0, finished, regular, "o_orderkey", "o_orderdate")
    rows = R.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    kept = landing.ingest(rows, games, "o_orderkey")
    return kept.groupBy("o_orderkey").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("quantity"))


@query
def calendar(spark, sf_dir):
    orders = R.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    bounds = orders.agg(F.min("day").alias("start"), F.max("day").alias("end"))
    per_day = orders.groupBy("day").agg(F.count("*").alias("n"))
    return (
        landing.calendar(bounds)
        .join(per_day, F.col("date") == F.col("day"), "left")
        .select("date", F.coalesce("n", F.lit(0).cast("long")).alias("n_games"))
    )


@query
def games_on_days(spark, sf_dir):
    orders = R.table(spark, sf_dir, "orders")
    season = R.star(spark, sf_dir).agg(F.min("game_date").alias("start"), F.max("game_date").alias("end"))
    return landing.games_on_days(orders, landing.calendar(season), "o_custkey", "o_orderdate")


@query
def dedupe_keys(spark, sf_dir):
    return reshape.distinct_keys(R.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query
def schema_diff(spark, sf_dir):
    a = R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    b = R.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS l_orderkey", "cast(o_custkey AS int) AS l_suppkey", "o_totalprice",
        "nullif(o_orderstatus, 'P') AS l_returnflag",
    )
    return profile.schema_diff(a, b, filled=True)


@query
def sample_n(spark, sf_dir):
    return profile.sample_rows(R.table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")), 20, ["l_orderkey", "l_linenumber", "l_partkey"], seed=42)


def _with_gaps(spark, sf_dir):
    return R.event_rows(spark, sf_dir).select(
        "ingest_seq", "start_time", "pitcher_name", "details_event", "start_speed", "is_pitch",
        F.lit(None).cast("string").alias("violation_type"),
    )


@query
def missing_profile(spark, sf_dir):
    return profile.missing_profile(_with_gaps(spark, sf_dir))


@query
def missing_summary(spark, sf_dir):
    return profile.missing_summary(
        _with_gaps(spark, sf_dir), F.col("is_pitch"), ["start_time", "pitcher_name"]
    )


@query
def select_ranges(spark, sf_dir):
    rows = R.table(spark, sf_dir, "orders")
    picked = reshape.select_ranges(rows, ("o_orderkey", "o_orderstatus"), "o_orderpriority")
    return reshape.relocate(reshape.drop_ranges(picked, ("o_custkey", "o_custkey")), ["o_orderpriority"], before="o_orderstatus")


@query
def union_seasons(spark, sf_dir):
    orders = R.table(spark, sf_dir, "orders")
    old = orders.where(S.in_years(orders, "o_orderdate", R.P0, R.P0)).select(
        "o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("old_only")
    )
    new = orders.where(S.in_years(orders, "o_orderdate", R.P1, R.P1)).select(
        "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("violation_type")
    )
    both = [s.withColumn("year", F.lit(y)) for s, y in ((old, R.P0), (new, R.P1))]
    return reshape.union_seasons(both, reshape.all_fields(both))


def _payload_files(spark, sf_dir):
    """Orders landed as JSON lines: those of one period with one set of fields, the others with other fields, in another order and with wider numbers."""
    orders = R.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))
    old = S.in_years(orders, "o_orderdate", R.P0, R.P0)
    folder = shared_folder(spark)
    paths = [f"{folder}/old", f"{folder}/new"]
    orders.where(old).select("o_orderkey", F.floor("o_totalprice").alias("amount"), "o_orderstatus", F.lit(None).cast("string").alias("note")).write.json(paths[0])
    later = F.struct(F.col("o_custkey").alias("customer"), F.array(F.lit(1), F.lit(2)).alias("list"))
    extra = [F.col("o_totalprice").alias("amount"), (F.col("o_custkey") % 2 == 0).alias("isEven"), F.concat(F.lit("note "), "o_orderpriority").alias("note"), later.alias("nested.detail")]
    orders.where(~old).select(*extra, "o_orderkey", "o_orderdate").write.json(paths[1])
    return paths


@query
def landed_payloads(spark, sf_dir):
    declared = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.DateType())])
    return S.clean_names(payloads.read_payloads(spark, _payload_files(spark, sf_dir), declared, ["o_orderkey"]))


@query
def ingest_order(spark, sf_dir):
    """Rows of files that hold the orders sorted by key, numbered in file order."""
    folder = shared_folder(spark)
    orders = R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey")
    orders.write.csv(folder)
    rows = spark.read.schema("o_orderkey long, o_custkey long").csv(folder)
    return split_order(rows.select("*", "_metadata.file_path", "_metadata.file_block_start"), "file_path", "file_block_start").drop("file_path", "file_block_start")


@query
def clean_names(spark, sf_dir):
    messy = {"o_orderkey": "Order Key", "o_custkey": "order_key", "o_totalprice": "orderKey", "o_orderdate": "1st.Date", "o_orderstatus": "% done#", "o_orderpriority": "--"}
    orders = R.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return S.clean_names(orders.select(*[F.col(a).alias(b) for a, b in messy.items()]))


@query
def split_name(spark, sf_dir):
    listed = R.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_mktsegment", F.lit(", "), "c_name").alias("entity_name")
    )
    parts = reshape.split_name(listed, "entity_name", ["last_name", "first_name"])
    return parts.withColumn("full_name", S.full_name("first_name", "last_name"))


@query
def two_season_entities(spark, sf_dir):
    board = R.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Last"), "o_custkey", F.lit(", First"), "o_custkey").alias("entity_name"),
        F.col("o_custkey").alias("entity_id"),
    )
    return cleaning.two_season_entities(board)


@query
def dropna(spark, sf_dir):
    rows = R.star(spark, sf_dir, whole=True).select("game_pk", "pitch_number", "pitcher_name", "pitch_desc", "pitch_tempo")
    return reshape.complete_rows(reshape.complete_rows(rows, ["pitch_desc"]))


@query
def scalar_suite(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("string")
    urgent = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority") == "1-URGENT")
    before, after = F.col("o_custkey").cast("double"), F.col("o_totalprice")
    late = (F.col("o_orderdate") + F.expr("interval 90 seconds 250 milliseconds")).cast("timestamp")
    return o.select(
        "o_orderkey",
        S.recode(urgent, "urgent", "other").alias("recoded"),
        (after - before).alias("difference"),
        S.relative_change(before, after).alias("relative"),
        S.percent_text(F.col("o_custkey") / F.lit(1000.0)).alias("percent"),
        S.round_to(after / 7, 2).alias("rounded"),
        S.gap_seconds(late, F.col("o_orderdate").cast("timestamp")).alias("gap"),
        F.to_date(F.substring(day, 1, 10)).alias("parsed"),
        F.substring(day, 1, 4).cast("int").alias("year_text"),
        F.concat(F.lit("Order "), "o_orderstatus", F.lit("-"), F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("label"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("as_number"),
        F.year("o_orderdate").cast("string").alias("as_category"),
        F.nullif("o_orderstatus", F.lit("P")).isNull().alias("is_missing"),
    )


# Event sequence


def _enriched(spark, sf_dir):
    return enrich(R.event_rows(spark, sf_dir), R.EVENT_COLUMNS)


def _kept_tempos(spark, sf_dir):
    """What the densities read of the enriched table. The analysis stores that table; here it is kept, as a density reads its rows three times."""
    return written_once(_enriched(spark, sf_dir).select("year", "is_pitch", "inning_count", "men_on_base", "pitch_tempo"))


COUNT_COLUMNS = ["ingest_seq", "season_count", "game_count", "inning_count"]


@query
def running_counts_(spark, sf_dir):
    return running_counts(R.event_rows(spark, sf_dir), R.EVENT_COLUMNS).select(*COUNT_COLUMNS)


@query
def tempo_(spark, sf_dir):
    rows = R.event_rows(spark, sf_dir).withColumn(
        "inning_count", F.when(F.col("is_pitch"), F.col("pitch_number")).cast("long")
    )
    return add_gap(rows, R.EVENT_COLUMNS).select("ingest_seq", "pitch_tempo")


@query
def enriched(spark, sf_dir):
    return _enriched(spark, sf_dir)


@query
def enrich_selfjoin(spark, sf_dir):
    rows = R.event_rows(spark, sf_dir)
    derived = _enriched(spark, sf_dir).where("is_pitch").select("play_id", *COUNT_COLUMNS[1:], "pitch_tempo")
    out = attach_by_id(rows.select("ingest_seq", F.when(F.col("is_pitch"), F.col("play_id")).alias("play_id")), derived, "play_id")
    return out.drop("play_id")


@query
def attach_null_ids(spark, sf_dir):
    """Event ids are missing on some rows of both sides, and match each other."""
    seq = F.col("ingest_seq")
    rows = R.event_rows(spark, sf_dir).select("ingest_seq", F.when(seq % 40 != 0, F.col("play_id")).alias("play_id"))
    derived = R.event_rows(spark, sf_dir).where((seq % 3 == 0) | (seq % 4999 == 1)).select(F.when(seq % 4999 != 1, F.col("play_id")).alias("play_id"), seq.alias("derived_seq"))
    return attach_by_id(rows, derived, "play_id", null_ids="match", rows_per_task=2000)


def _resumed_games(spark, sf_dir):
    """Games that go on on the next date, in the same innings."""
    rows = R.event_rows(spark, sf_dir)
    return rows.withColumn("game_pk", F.expr("cast(datediff(game_date, date'2024-01-01') div 2 * 3 + game_pk % 3 AS bigint)"))


@query
def tempo_resumed(spark, sf_dir):
    return enrich(_resumed_games(spark, sf_dir), R.EVENT_COLUMNS).select("ingest_seq", "inning_count", "pitch_tempo")


@query
def tempo_season_lag(spark, sf_dir):
    return enrich(_resumed_games(spark, sf_dir), R.EVENT_COLUMNS, lag_scope="season").select("ingest_seq", "inning_count", "pitch_tempo")


@query
def group_number(spark, sf_dir):
    rows = R.event_rows(spark, sf_dir).where("is_pitch").select("ingest_seq", "pitcher_name", "game_pk", "inning")
    return group_numbers(rows, ["pitcher_name", "game_pk", "inning"])


@query
def group_number_hot(spark, sf_dir):
    """One key holds a third of the rows, some have none, and numbers are joined by a shuffle."""
    part = F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.nullif("l_partkey", F.lit(7)))
    rows = R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", part.cast("long").alias("part"))
    return group_numbers(rows, ["part"], broadcast_rows=10)


@query
def topk_ties(spark, sf_dir):
    return tempo.longest_tempos(_enriched(spark, sf_dir), 50).select("ingest_seq", "game_pk", "pitch_tempo")


@query
def bottomk_ties(spark, sf_dir):
    return tempo.shortest_tempos(_enriched(spark, sf_dir), 100).select("ingest_seq", "game_pk", "pitch_tempo")


@query
def topk_many_ties(spark, sf_dir):
    rows = R.star(spark, sf_dir, whole=True).select("game_pk", "pitch_number", "pitch_tempo")
    return top_k(rows, "pitch_tempo", 15).unionByName(bottom_k(rows, "pitch_tempo", 15))


@query
def filter_suite(spark, sf_dir):
    rows = _enriched(spark, sf_dir)
    kept = tempo.pitches(first=False, cap=3600.0, floor=0.0) & (F.col("inning_count") != 1)
    members = F.col("pitch_code").isin("click", "view")
    return rows.where(kept & members & F.col("pitcher_name").isNotNull()).select(
        "ingest_seq", "pitch_code", "pitch_number", "pitch_tempo"
    )


@query
def point_lookup(spark, sf_dir):
    return tempo.game_rows(R.event_rows(spark, sf_dir), 40).select("ingest_seq", "game_date", "inning", "start_speed")


@query
def count_actions(spark, sf_dir):
    return tempo.action_counts(R.event_rows(spark, sf_dir), R.EVENT_PERIODS[0])


@query
def count_unlabelled(spark, sf_dir):
    return tempo.unlabelled_action_counts(R.event_rows(spark, sf_dir), R.EVENT_PERIODS[1])


@query
def count_types(spark, sf_dir):
    return reshape.count_groups(R.star(spark, sf_dir, whole=True), "pitch_desc", "pitch_code", "year")


# Distributions


@query
def histogram_(spark, sf_dir):
    return histogram(_enriched(spark, sf_dir).where("is_pitch"), "pitch_tempo", 0.0, 7200.0, width=60.0)


@query
def histogram_unit(spark, sf_dir):
    return histogram(R.event_rows(spark, sf_dir).where("is_pitch"), "start_speed", 0.0, 120.0)


@query
def density(spark, sf_dir):
    return tempo.tempo_density(_kept_tempos(spark, sf_dir), high=3600.0)


@query
def density_not_first(spark, sf_dir):
    return tempo.tempo_density(R.star(spark, sf_dir, whole=True), where=F.col("inning_count") != 1)


@query
def density_facet(spark, sf_dir):
    return tempo.tempo_density_by(
        _kept_tempos(spark, sf_dir), tempo.runners(), where=F.col("is_pitch") & (F.col("inning_count") != 1), high=3600.0
    )


@query
def density_facet_first(spark, sf_dir):
    return tempo.tempo_density_by(
        R.star(spark, sf_dir, whole=True), tempo.first_pitch(), where=tempo.pitches(floor=0.0, cap=R.CAP)
    )


@query
def density_velocity(spark, sf_dir):
    return kernel_density(R.event_rows(spark, sf_dir), "start_speed", 0.0, 100.0, ["pitch_code"])


@query
def density_flag(spark, sf_dir):
    # Two joins find the places; kept, as a density reads its rows three times.
    places = R.star_with_home_team(spark, sf_dir, whole=True).select("year", "is_pitch", "pitch_number", "pitch_tempo", "home_team")
    return altitude.flag_density(
        written_once(places), R.nation_parks(spark, sf_dir), R.at_flagged_park()
    )


# Period comparisons and leaderboards


@query
def season_runners(spark, sf_dir):
    return tempo.tempo_by_runners(R.star(spark, sf_dir), cap=R.CAP, **PER)


@query
def season_runners_rounded(spark, sf_dir):
    return tempo.tempo_by_runners_rounded(R.star(spark, sf_dir), **PER)


@query
def season_runners_uncapped(spark, sf_dir):
    return tempo.tempo_by_runners(R.star(spark, sf_dir), cap=None, **PER)


@query
def season_first_pitch_uncapped(spark, sf_dir):
    return tempo.tempo_by_first_pitch(R.star(spark, sf_dir), floor=None, cap=None, **PER)


@query
def season_first_pitch(spark, sf_dir):
    return tempo.tempo_by_first_pitch(R.star(spark, sf_dir), cap=R.CAP, **PER)


@query
def team_change(spark, sf_dir):
    return tempo.team_change(R.star_with_fielding_team(spark, sf_dir), cap=R.CAP, **PER)


@query
def team_change_uncapped(spark, sf_dir):
    return tempo.team_change(R.star_with_fielding_team(spark, sf_dir), cap=None, digits=None, **PER)


@query
def cohort_both_seasons(spark, sf_dir):
    rows = R.star(spark, sf_dir)
    return qualify(rows, "pitcher_name", R.PERIODS, MIN_PITCHES, F.col("is_pitch")).select(
        "pitcher_name", "year", "game_pk", "pitch_number"
    )


@query
def cohort_pitch_type(spark, sf_dir):
    rows = R.star(spark, sf_dir)
    kept = rows.where(F.col("pitch_number") != 1)
    return qualify(
        kept, "pitcher_name", R.PERIODS, MIN_TYPE_PITCHES, F.col("pitch_code") == "A", population=rows
    ).select("pitcher_name", "year", "game_pk", "pitch_number")


def _median_board(metric, min_pitches, largest):
    def run(spark, sf_dir):
        return tempo.median_leaders(R.star(spark, sf_dir), metric, min_pitches, 15, largest, R.PERIODS)

    return run


for _name, _metric, _min, _largest in (
    ("leader_median_slow", f"median_tempo_{R.P0}", 1, True),
    ("leader_median_fast", f"median_tempo_{R.P1}", 1, False),
    ("leader_change_min", "tempo_change", MIN_PITCHES, False),
    ("leader_change_max", "tempo_change", MIN_PITCHES, True),
):
    register(_name, _median_board(_metric, _min, _largest))


@query
def leader_mean_fast(spark, sf_dir):
    return tempo.mean_leaders(R.star(spark, sf_dir), cap=R.CAP, **PER)


@query
def leader_mean_slow(spark, sf_dir):
    return tempo.mean_leaders(R.star(spark, sf_dir), cap=R.CAP, largest=True, **PER)


@query
def pitcher_change(spark, sf_dir):
    return tempo.pitcher_change(R.star(spark, sf_dir), MIN_PITCHES, cap=R.CAP, **PER)


@query
def pitch_codes(spark, sf_dir):
    return quality.pitch_codes(R.star(spark, sf_dir, whole=True), MIN_TYPE_ROWS)


@query
def pitch_leaderboards(spark, sf_dir):
    rows = R.star(spark, sf_dir)
    return quality.leaderboards(rows, quality.pitch_codes(rows, MIN_TYPE_ROWS), 50, **PER)


def _coarse(band):
    """Three digits: the checking SQL finds its t quantile by numerical integration."""
    return band.withColumns({c: S.round_to(c, 3) for c in ("fit", "lower", "upper")})


@query
def pitch_leaderboard_one(spark, sf_dir):
    return quality.leaderboard(R.star(spark, sf_dir), "R", "spin_rate", 25, (R.P1,))


@query
def fit_line(spark, sf_dir):
    return _coarse(quality.velo_spin_fit(quality.leaderboards(R.star(spark, sf_dir), None, 50, **PER)))


@query
def leaderboard_outputs(spark, sf_dir):
    """One output per pitch type, written twice and read back with the status of the second run."""
    board = written_once(quality.leaderboards(R.star(spark, sf_dir), None, 25, **PER))
    folder = shared_folder(spark)
    outputs.write_outputs(board, folder, "pitch_code")
    again = outputs.write_outputs(board, folder, "pitch_code").select("pitch_code", "n_rows", "status")
    return outputs.read_outputs(spark, folder, board.schema).join(again, "pitch_code")


@query
def season_velo(spark, sf_dir):
    return quality.by_type(R.star(spark, sf_dir), ["velo"], MIN_PITCHES, MIN_TYPE_ROWS, **PER)


@query
def season_spin(spark, sf_dir):
    return quality.by_type(R.star(spark, sf_dir), ["spin_rate"], MIN_PITCHES, MIN_TYPE_ROWS, **PER)


@query
def season_velo_all(spark, sf_dir):
    return quality.by_type(R.star(spark, sf_dir), ["velo"], None, None, rounded=True, **PER)


@query
def season_spin_all(spark, sf_dir):
    return quality.by_type(R.star(spark, sf_dir), ["spin_rate"], None, None, rounded=True, **PER)


@query
def season_by_type(spark, sf_dir):
    return quality.by_type(
        R.star(spark, sf_dir), ("velo", "spin_rate"), MIN_PITCHES, MIN_TYPE_ROWS, rounded=True, **PER
    )


def _delta():
    return {"min_rows": 15, "periods": R.PERIODS, "where": F.col("pitch_tempo") < R.CAP}


@query
def season_delta_velo(spark, sf_dir):
    return quality.change_points(R.star(spark, sf_dir), "velo", **_delta())


@query
def season_delta_spin(spark, sf_dir):
    return quality.change_points(R.star(spark, sf_dir), "spin_rate", **_delta())


def _without_sums(df):
    return df.drop("sxx", "mean_x", "sigma2")


@query
def ols_velo(spark, sf_dir):
    return _without_sums(quality.change_models(R.star(spark, sf_dir), "velo", **_delta()))


@query
def ols_spin(spark, sf_dir):
    return _without_sums(quality.change_models(R.star(spark, sf_dir), "spin_rate", **_delta()))


@query
def ols_variant(spark, sf_dir):
    rows = R.star(spark, sf_dir).where(F.col("pitch_code") == "A")
    options = {**_delta(), "where": F.col("inning_count") != 1}
    return _without_sums(quality.change_models(rows, "velo", **options))


@query
def ols_summary(spark, sf_dir):
    return quality.change_summary(R.star(spark, sf_dir), "velo", **_delta())


@query
def ols_summary_spin(spark, sf_dir):
    return quality.change_summary(R.star(spark, sf_dir), "spin_rate", **_delta())


@query
def ols_summary_variant(spark, sf_dir):
    rows = R.star(spark, sf_dir).where(F.col("pitch_code") == "A")
    return quality.change_summary(rows, "velo", **{**_delta(), "where": F.col("inning_count") != 1})


def _variant(spark, sf_dir, measure):
    rows = R.star(spark, sf_dir).where(F.col("pitch_code") == "A")
    return quality.change_points(rows, measure, **{**_delta(), "where": F.col("inning_count") != 1})


@query
def season_delta_velo_variant(spark, sf_dir):
    return _variant(spark, sf_dir, "velo")


@query
def season_delta_spin_variant(spark, sf_dir):
    return _variant(spark, sf_dir, "spin_rate")


@query
def ols_table(spark, sf_dir):
    return quality.change_table(quality.change_models(R.star(spark, sf_dir), "velo", **_delta()))


@query
def ols_table_compat(spark, sf_dir):
    return quality.change_table(quality.change_models(R.star(spark, sf_dir), "velo", **_delta()), compat=True)


@query
def ols_table_published(spark, sf_dir):
    rows = R.star(spark, sf_dir)
    codes = quality.pitch_codes(rows, MIN_TYPE_ROWS)
    return quality.published_change_table(quality.change_models(rows, "velo", types=codes, **_delta()), codes)


@query
def ols_table_spin(spark, sf_dir):
    rows = R.star(spark, sf_dir)
    codes = quality.pitch_codes(rows, MIN_TYPE_ROWS)
    return quality.published_change_table(quality.change_models(rows, "spin_rate", types=codes, **_delta()), codes)


@query
def fit_change(spark, sf_dir):
    return _coarse(quality.change_fit(R.star(spark, sf_dir), "velo", **_delta()))


# Parks and fixed effects


@query
def park_dim(spark, sf_dir):
    return R.supplier_parks(spark, sf_dir)


@query
def altitude_rank(spark, sf_dir):
    return altitude.altitude_ranking(R.supplier_parks(spark, sf_dir))


@query
def rank_many(spark, sf_dir):
    """Orders by price from the top, too many for one window."""
    price = F.floor(F.col("o_totalprice") / 100).alias("price")
    return rank_descending(R.table(spark, sf_dir, "orders").select("o_orderkey", price), "price", window_rows=100)


@query
def altitude_bands(spark, sf_dir):
    return altitude.band_counts(R.supplier_parks(spark, sf_dir))


@query
def park_tempo(spark, sf_dir):
    return altitude.park_tempo(
        R.star_with_home_team(spark, sf_dir), R.nation_parks(spark, sf_dir), cap=R.CAP, **PER
    )


@query
def flag_summary(spark, sf_dir):
    return altitude.flag_summary(
        R.star_with_home_team(spark, sf_dir), R.nation_parks(spark, sf_dir), R.at_flagged_park(), **PER
    )


def _grid(spark, sf_dir, row_scope, **options):
    return altitude.fixed_effects_grid(
        R.star_with_home_team(spark, sf_dir),
        R.nation_parks(spark, sf_dir),
        R.at_flagged_park(),
        MIN_TYPE_PITCHES,
        MIN_TYPE_ROWS,
        row_scope=row_scope,
        kept=tempo.pitches(first=False, cap=R.CAP),
        **PER,
        **options,
    )


@query
def fe_flag(spark, sf_dir):
    return _grid(spark, sf_dir, "type")


@query
def fe_flag_all_rows(spark, sf_dir):
    return _grid(spark, sf_dir, "all")


@query
def fe_flag_table(spark, sf_dir):
    return altitude.flag_table(_grid(spark, sf_dir, "all"), quality.pitch_codes(R.star(spark, sf_dir), MIN_TYPE_ROWS))


@query
def fe_altitude(spark, sf_dir):
    return altitude.altitude_model(
        R.star_with_home_team(spark, sf_dir),
        R.nation_parks(spark, sf_dir),
        ("A",),
        MIN_TYPE_PITCHES,
        kept=tempo.pitches(cap=R.CAP),
        **PER,
    )


@query
def fe_effects(spark, sf_dir):
    return _grid(spark, sf_dir, "all", types=("A",), model_years=(R.P1,), effects=True)


@query
def fe_coefficients(spark, sf_dir):
    return _grid(spark, sf_dir, "type", effects="table")
