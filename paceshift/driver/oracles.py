"""Independent SQL for each query, over the same tables."""

from __future__ import annotations

from .queries import MIN_PITCHES, MIN_TYPE_PITCHES, MIN_TYPE_ROWS
from .roles import CAP, P0, P1

STAR_ROWS = """
        SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(l_shipdate AS DATE) AS game_date,
               l_orderkey AS game_pk, nullif(l_suppkey, 7) AS pitcher_name, l_returnflag AS pitch_code,
               CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL ELSE 'type_' || l_returnflag END AS pitch_desc,
               l_tax < 0.08 AS is_pitch, l_linenumber AS pitch_number, l_partkey % 6 + 1 AS inning_count,
               CASE WHEN l_linestatus = 'O' THEN 'Empty' ELSE 'RISP' END AS men_on_base,
               nullif(l_quantity, 13.0) AS pitch_tempo, l_extendedprice AS start_speed, l_discount AS spin_rate,
               l_suppkey
        FROM lineitem"""
HOME_ROWS = """
        SELECT star.*, n_name AS home_team, 'Park ' || n_nationkey AS park_name, n_nationkey * 100 AS altitude,
               CASE WHEN n_nationkey = 0 THEN 1.0 ELSE 0.0 END AS flag
        FROM {star} AS star JOIN orders ON o_orderkey = game_pk JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey"""
VIEWS = {
    "star": f"{STAR_ROWS} WHERE year(l_shipdate) BETWEEN {P0} AND {P1}",
    "star_all": STAR_ROWS,
    "star_fielding": """
        SELECT star.*, n_name AS fielding_team FROM star
        LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "star_home": HOME_ROWS.format(star="star"),
    "star_home_all": HOME_ROWS.format(star="star_all"),
    "parks": """
        SELECT s_name AS park_name, 'city_' || s_nationkey AS city, 'state_' || (s_nationkey % 5) AS state,
               s_acctbal / 100 AS latitude, s_acctbal / -200 AS longitude,
               CAST(abs(floor(s_acctbal)) % 1300 AS INTEGER) AS altitude,
               CASE WHEN s_nationkey <> 9 THEN 'Team ' || s_suppkey END AS home_team,
               CASE WHEN s_nationkey <> 9 THEN 'T' || s_suppkey END AS abbr
        FROM supplier WHERE s_acctbal >= 0 AND s_nationkey <> 3
        UNION ALL
        SELECT 'Late Park', 'city_0', 'state_0', 32.75, -97.125, 541, 'Late Team', 'LATE'""",
    "ev": """
        SELECT event_id AS ingest_seq, CAST(CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS INTEGER) AS year,
               CAST(ts AS DATE) AS game_date,
               CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 3 + user_id % 3 AS BIGINT) AS game_pk,
               CAST(hour(ts) // 6 + 1 AS INTEGER) AS inning,
               CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS start_time,
               nullif(user_id % 10, 0) AS pitcher_name, event_type <> 'error' AS is_pitch,
               CAST(event_id % 5 + 1 AS INTEGER) AS pitch_number, 'p' || event_id AS play_id,
               event_type AS pitch_code, 'type_' || event_type AS pitch_desc,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'action_' || (user_id % 4) END AS details_event,
               'about_' || (user_id % 5) AS details_description,
               CASE WHEN user_id % 4 = 0 THEN 'Empty' ELSE 'Men' END AS men_on_base, value AS start_speed
        FROM events""",
    "pitch_windows": """
        SELECT *,
          CASE WHEN pitcher_name IS NOT NULL THEN row_number() OVER (PARTITION BY year, pitcher_name
            ORDER BY game_date, game_pk, start_time NULLS LAST, ingest_seq) END AS season_count,
          row_number() OVER (PARTITION BY year, pitcher_name, game_pk
            ORDER BY game_date, start_time NULLS LAST, ingest_seq) AS game_count,
          row_number() OVER (PARTITION BY year, pitcher_name, game_pk, inning
            ORDER BY game_date, start_time NULLS LAST, ingest_seq) AS inning_count,
          epoch_us(start_time) - lag(epoch_us(start_time)) OVER (PARTITION BY year, game_pk
            ORDER BY game_date, start_time NULLS LAST, ingest_seq) AS gap_us
        FROM ev WHERE is_pitch""",
    "enriched": """
        SELECT * EXCLUDE (gap_us), CASE WHEN inning_count <> 1 THEN gap_us / 1e6 END AS pitch_tempo
        FROM pitch_windows
        UNION ALL BY NAME
        SELECT * FROM ev WHERE NOT is_pitch""",
}
NEEDS = {
    "star_fielding": ["star"],
    "star_home": ["star"],
    "star_home_all": ["star_all"],
    "pitch_windows": ["ev"],
    "enriched": ["ev", "pitch_windows"],
}

ORACLES: dict[str, str] = {}


def r(expression: str, digits: int = 6) -> str:
    """Plain rounding; to six digits, as results are compared, after rounding to nine."""
    if digits < 6:
        return f"round({expression}, {digits})"
    return f"round(round(({expression}) * 1e9::DOUBLE) / 1e9::DOUBLE * 1e6::DOUBLE) / 1e6::DOUBLE"


def add(name: str, views: list[str], sql: str, **steps: str) -> None:
    """Register a query as its views, further named steps, and a final select."""
    named: dict[str, str] = {}
    for v in views:
        for need in [*NEEDS.get(v, []), v]:
            named[need] = VIEWS[need]
    named.update(steps)
    prefix = ", ".join(f"{k} AS ({v})" for k, v in named.items())
    ORACLES[f"q_{name}"] = f"WITH {prefix} {sql}" if named else sql


def per(fn: str, value: str, when: str = "TRUE") -> list[str]:
    return [f"{fn}({value}) FILTER (WHERE year = {p} AND {when})" for p in (P0, P1)]


# Sources, inspection, reshaping

add(
    "manifest_ingest",
    [],
    f"""SELECT l_orderkey AS o_orderkey, count(*) AS n_rows, {r('sum(l_quantity)')} AS quantity FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = {P0} AND o_orderstatus = 'F'
                         AND o_orderpriority <> '5-LOW') GROUP BY 1""",
)
add(
    "calendar",
    [],
    """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date, count(o_orderkey) AS n_games
    FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) days
    LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1""",
)
add(
    "games_on_days",
    ["star"],
    """SELECT o_custkey, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN
    (SELECT min(game_date) FROM star) AND (SELECT max(game_date) FROM star) GROUP BY 1""",
)
add("dedupe_keys", [], "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
add(
    "schema_diff",
    [],
    """SELECT * FROM (
    SELECT 'l_orderkey' AS column_name, 'bigint' AS type_a, 'bigint' AS type_b, 'same' AS status,
           (SELECT count(l_orderkey) FROM lineitem) AS n_a, (SELECT count(o_orderkey) FROM orders) AS n_b
    UNION ALL SELECT 'l_suppkey', 'bigint', 'int', 'differs', (SELECT count(l_suppkey) FROM lineitem),
           (SELECT count(o_custkey) FROM orders)
    UNION ALL SELECT 'l_quantity', 'double', NULL, 'only_a', (SELECT count(l_quantity) FROM lineitem), NULL
    UNION ALL SELECT 'o_totalprice', NULL, 'double', 'only_b', NULL, (SELECT count(o_totalprice) FROM orders)
    UNION ALL SELECT 'l_returnflag', 'string', 'string', 'same', (SELECT count(l_returnflag) FROM lineitem),
           (SELECT count(nullif(o_orderstatus, 'P')) FROM orders))""",
)
add(
    "sample_n",
    [],
    f"""SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate, {', '.join(f"{r(c)} AS {c}" for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))})
    FROM (SELECT * FROM lineitem ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey LIMIT 20)""",
)
add(
    "missing_profile",
    ["ev"],
    f"""SELECT variable, n_miss, {r('100.0 * n_miss / n')} AS pct_miss FROM c, LATERAL (VALUES
    ('ingest_seq', CAST(0 AS BIGINT)), ('start_time', m1), ('pitcher_name', m2), ('details_event', m3),
    ('start_speed', m4), ('is_pitch', m5), ('violation_type', n)) v(variable, n_miss)""",
    c="""SELECT count(*) AS n, count(*) - count(start_time) AS m1, count(*) - count(pitcher_name) AS m2,
    count(*) - count(details_event) AS m3, count(*) - count(start_speed) AS m4, count(*) - count(is_pitch) AS m5 FROM ev""",
)
add(
    "missing_summary",
    ["ev"],
    f"""SELECT count(*) AS n_rows, CAST(7 AS INTEGER) AS n_columns, CAST(1 AS INTEGER) AS n_empty_columns,
    CAST(1 + CAST(count(start_time) = count(*) AS INTEGER) + CAST(count(pitcher_name) = count(*) AS INTEGER)
      + CAST(count(details_event) = count(*) AS INTEGER) + CAST(count(start_speed) = count(*) AS INTEGER)
      + CAST(count(is_pitch) = count(*) AS INTEGER) AS INTEGER) AS n_complete_columns,
    {r('100.0 * count(*) FILTER (WHERE is_pitch AND (start_time IS NULL OR pitcher_name IS NULL)) / count(*) FILTER (WHERE is_pitch)')} AS pct_lacking
    FROM ev""",
)
add("select_ranges", [], "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders")
add(
    "union_seasons",
    [],
    f"""SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE WHEN year(o_orderdate) = {P0} THEN o_orderpriority END AS old_only,
    CASE WHEN year(o_orderdate) = {P1} THEN o_orderstatus END AS violation_type
    FROM orders WHERE year(o_orderdate) IN ({P0}, {P1})""",
)
add(
    "split_name",
    [],
    """SELECT c_custkey, c_mktsegment AS last_name, c_name AS first_name, c_name || ' ' || c_mktsegment AS full_name
    FROM customer""",
)
add(
    "two_season_entities",
    [],
    """SELECT 'First' || o_custkey || ' Last' || o_custkey AS pitcher_name, o_custkey AS entity_id
    FROM orders GROUP BY o_custkey HAVING count(*) > 1""",
)
add(
    "dropna",
    ["star_all"],
    f"""SELECT game_pk, pitch_number, pitcher_name, pitch_desc, {r('pitch_tempo')} AS pitch_tempo FROM star_all
    WHERE pitcher_name IS NOT NULL AND pitch_desc IS NOT NULL AND pitch_tempo IS NOT NULL""",
)
add(
    "scalar_suite",
    [],
    f"""SELECT o_orderkey,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'other' END AS recoded,
    {r('o_totalprice - o_custkey')} AS difference,
    {r('(o_totalprice - o_custkey) / nullif(o_custkey, 0)')} AS relative,
    printf('%.1f%%', o_custkey / 1000.0 * 100.0) AS percent,
    {r(r('o_totalprice / 7', 2))} AS rounded, CAST(90.25 AS DOUBLE) AS gap, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed,
    CAST(year(o_orderdate) AS INTEGER) AS year_text,
    'Order ' || o_orderstatus || '-' || nullif(o_orderpriority, '5-LOW') AS label,
    CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS as_number, CAST(year(o_orderdate) AS VARCHAR) AS as_category,
    o_orderstatus = 'P' AS is_missing FROM orders""",
)

# Event sequence

add("running_counts", ["enriched"], "SELECT ingest_seq, season_count, game_count, inning_count FROM enriched")
add(
    "tempo",
    ["pitch_windows"],
    f"""SELECT ingest_seq, {r('CASE WHEN pitch_number <> 1 THEN gap_us / 1e6 END')} AS pitch_tempo FROM pitch_windows
    UNION ALL SELECT ingest_seq, NULL FROM ev WHERE NOT is_pitch""",
)
add(
    "enriched",
    ["enriched"],
    f"""SELECT * REPLACE (CAST(game_date AS VARCHAR) AS game_date, strftime(start_time, '%Y-%m-%d %H:%M:%S.%f') AS start_time,
    {r('pitch_tempo')} AS pitch_tempo, {r('start_speed')} AS start_speed) FROM enriched""",
)
add(
    "enrich_selfjoin",
    ["enriched"],
    f"SELECT ingest_seq, season_count, game_count, inning_count, {r('pitch_tempo')} AS pitch_tempo FROM enriched",
)
add(
    "topk_ties",
    ["enriched"],
    f"""SELECT ingest_seq, game_pk, {r('pitch_tempo')} AS pitch_tempo FROM
    (SELECT *, rank() OVER (ORDER BY pitch_tempo DESC NULLS LAST) AS k FROM enriched WHERE is_pitch AND inning_count <> 1)
    WHERE k <= 50""",
)
add(
    "bottomk_ties",
    ["enriched"],
    f"""SELECT ingest_seq, game_pk, {r('pitch_tempo')} AS pitch_tempo FROM
    (SELECT *, rank() OVER (ORDER BY pitch_tempo NULLS LAST) AS k FROM enriched) WHERE k <= 100""",
)
add(
    "topk_many_ties",
    ["star_all"],
    f"""SELECT game_pk, pitch_number, {r('pitch_tempo')} AS pitch_tempo FROM
    (SELECT *, rank() OVER (ORDER BY pitch_tempo DESC NULLS LAST) AS a, rank() OVER (ORDER BY pitch_tempo NULLS LAST) AS b
     FROM star_all) WHERE a <= 15 OR b <= 15""",
)
add(
    "filter_suite",
    ["enriched"],
    f"""SELECT ingest_seq, pitch_code, pitch_number, {r('pitch_tempo')} AS pitch_tempo FROM enriched
    WHERE is_pitch AND pitch_number <> 1 AND pitch_tempo > 0 AND pitch_tempo < 3600 AND inning_count <> 1
    AND pitch_code IN ('click', 'view') AND pitcher_name IS NOT NULL""",
)
add(
    "point_lookup",
    ["ev"],
    f"SELECT ingest_seq, CAST(game_date AS VARCHAR) AS game_date, inning, {r('start_speed')} AS start_speed FROM ev WHERE game_pk = 40",
)
add("count_actions", ["ev"], "SELECT details_event, count(*) AS n FROM ev WHERE NOT is_pitch AND year = 1 GROUP BY 1")
add(
    "count_unlabelled",
    ["ev"],
    """SELECT details_description, count(*) AS n FROM ev
    WHERE NOT is_pitch AND year = 2 AND details_event IS NULL GROUP BY 1""",
)
add("count_types", ["star_all"], "SELECT pitch_desc, pitch_code, year, count(*) AS n FROM star_all GROUP BY ALL")

# Distributions


def histogram(view: str, value: str, high: int, width: int) -> str:
    w, half = f"CAST({width} AS DOUBLE)", width / 2
    return f"""SELECT bin, n, bin - {half} < 0 OR bin + {half} > {high} AS is_edge FROM (
    SELECT {r(f'ceil({value} / {w} - 0.5) * {w}')} AS bin, count(*) AS n FROM {view}
    WHERE is_pitch AND {value} BETWEEN 0 AND {high} GROUP BY 1)"""


add("histogram", ["enriched"], histogram("enriched", "pitch_tempo", 7200, 60))
add("histogram_unit", ["ev"], histogram("ev", "start_speed", 120, 1))


def add_density(name: str, views: list[str], rows: str, keys: list[str], high: int) -> None:
    """Kernel density over `rows`, which yields the keys and `v`."""
    k = ", ".join(keys)
    on = " AND ".join("{a}.%s IS NOT DISTINCT FROM {b}.%s" % (x, x) for x in keys)
    add(
        name,
        views,
        f"""SELECT {', '.join('o.' + x for x in keys)}, CAST(o.i AS INTEGER) AS i, {r('o.x')} AS x,
        {r('a.y + (o.pos - o.k) * (b.y - a.y)')} AS density, o.n, {r('o.bw')} AS bw
        FROM o JOIN curve a ON {on.format(a='a', b='o')} AND a.k = o.k
        JOIN curve b ON {on.format(a='b', b='o')} AND b.k = o.k + 1""",
        kept=f"SELECT {k}, v FROM ({rows}) WHERE v BETWEEN 0 AND {high}",
        s=f"""SELECT {k}, n, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw FROM (SELECT {k}, count(*) AS n,
        stddev_samp(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM kept GROUP BY {k})""",
        g=f"SELECT *, -4.0 * bw AS lo, ({high} + 8.0 * bw) / 511 AS step FROM s",
        placed=f"""SELECT g.*, (kept.v - lo) / step AS pos FROM kept JOIN g ON {on.format(a='kept', b='g')}""",
        cells=f"""SELECT {k}, n, bw, step, j, sum(w) AS w FROM (
        SELECT *, floor(pos) AS j, (1 - (pos - floor(pos))) / n AS w FROM placed
        UNION ALL SELECT *, floor(pos) + 1, (pos - floor(pos)) / n FROM placed) GROUP BY ALL""",
        curve=f"""SELECT {k}, q.k, sum(w * exp(-0.5 * pow((q.k - j) * step / bw, 2))) / any_value(bw) / sqrt(2 * pi()) AS y
        FROM cells, (SELECT CAST(range AS INTEGER) AS k FROM range(512)) q GROUP BY {k}, q.k""",
        o=f"""SELECT *, least(floor(pos), 510) AS k FROM (
        SELECT {k}, n, bw, i, i * ({high} / 511.0) AS x, (i * ({high} / 511.0) - lo) / step AS pos
        FROM g, (SELECT range AS i FROM range(512)) p)""",
    )


RUNNERS = "CASE WHEN men_on_base = 'Empty' THEN 'Empty' WHEN men_on_base <> 'Empty' THEN 'Men_On' END"
FIRST = "CASE WHEN pitch_number = 1 THEN '1st pitch' WHEN pitch_number <> 1 THEN '2nd+ pitch' END"

add_density("density", ["enriched"], "SELECT year, pitch_tempo AS v FROM enriched WHERE is_pitch", ["year"], 3600)
add_density(
    "density_not_first", ["star_all"],
    "SELECT year, pitch_tempo AS v FROM star_all WHERE is_pitch AND inning_count <> 1", ["year"], 60,
)
add_density(
    "density_facet", ["enriched"],
    f"SELECT {RUNNERS} AS facet, year, pitch_tempo AS v FROM enriched WHERE is_pitch AND inning_count <> 1",
    ["facet", "year"], 3600,
)
add_density(
    "density_facet_first", ["star_all"],
    f"SELECT {FIRST} AS facet, year, pitch_tempo AS v FROM star_all WHERE is_pitch AND pitch_tempo > 0 AND pitch_tempo < {CAP}",
    ["facet", "year"], 60,
)
add_density("density_velocity", ["ev"], "SELECT pitch_code, start_speed AS v FROM ev", ["pitch_code"], 100)
add_density(
    "density_flag", ["star_home_all"],
    """SELECT CASE WHEN flag = 1 THEN 'flagged' ELSE 'elsewhere' END AS place, year, pitch_tempo AS v FROM star_home_all
    WHERE is_pitch AND pitch_number <> 1""",
    ["place", "year"], 60,
)

# Period comparisons and leaderboards


def two_means(key: str, where: str, view: str = "star", digits: int | None = None) -> str:
    a, b = (r(e, digits) if digits is not None else e for e in per("avg", "pitch_tempo"))
    return f"SELECT {key}, {a} AS a, {b} AS b FROM {view} WHERE {where} GROUP BY 1"


RELATIVE = f"""{r('a')} AS avg_tempo_{P0}, {r('b')} AS avg_tempo_{P1}, {r('(b - a) / a')} AS relative_change,
    printf('%.1f%%', (b - a) / a * 100) AS change_text"""
MEANS = f"{r('a')} AS avg_tempo_{P0}, {r('b')} AS avg_tempo_{P1}"
LATER = "is_pitch AND pitch_number <> 1"

add("season_runners", ["star"], f"SELECT runners, {RELATIVE} FROM w",
    w=two_means(f"{RUNNERS} AS runners", f"{LATER} AND pitch_tempo < {CAP}"))
add("season_runners_uncapped", ["star"], f"SELECT runners, {RELATIVE} FROM w", w=two_means(f"{RUNNERS} AS runners", LATER))
add("season_first_pitch_uncapped", ["star"], f"SELECT pitch_of_at_bat, {RELATIVE} FROM w",
    w=two_means(f"{FIRST} AS pitch_of_at_bat", "is_pitch"))
add("season_runners_rounded", ["star"], f"SELECT runners, {MEANS}, {r('b - a')} AS tempo_change FROM w",
    w=two_means(f"{RUNNERS} AS runners", LATER, digits=2))
add("season_first_pitch", ["star"], f"SELECT pitch_of_at_bat, {RELATIVE} FROM w",
    w=two_means(f"{FIRST} AS pitch_of_at_bat", f"is_pitch AND pitch_tempo > 0 AND pitch_tempo < {CAP}"))
add("team_change", ["star_fielding"],
    f"SELECT fielding_team, {MEANS}, {r(r('b - a', 2))} AS tempo_change FROM w WHERE fielding_team IS NOT NULL AND b - a IS NOT NULL",
    w=two_means("fielding_team", f"{LATER} AND pitch_tempo < {CAP}", "star_fielding", 2))

add("team_change_uncapped", ["star_fielding"],
    f"SELECT fielding_team, {MEANS}, {r('b - a')} AS tempo_change FROM w WHERE fielding_team IS NOT NULL AND b - a IS NOT NULL",
    w=two_means("fielding_team", LATER, "star_fielding"))


def cohort(threshold: int, condition: str = "is_pitch") -> str:
    a, b = per("count", "*", condition)
    return f"SELECT pitcher_name FROM star GROUP BY 1 HAVING {a} > {threshold} AND {b} > {threshold}"


QUALIFIED = "EXISTS (SELECT 1 FROM q WHERE q.pitcher_name IS NOT DISTINCT FROM star.pitcher_name)"
add("cohort_both_seasons", ["star"], f"SELECT pitcher_name, year, game_pk, pitch_number FROM star WHERE {QUALIFIED}",
    q=cohort(MIN_PITCHES))
add("cohort_pitch_type", ["star"],
    f"SELECT pitcher_name, year, game_pk, pitch_number FROM star WHERE pitch_number <> 1 AND {QUALIFIED}",
    q=cohort(MIN_TYPE_PITCHES, "pitch_code = 'A'"))


def add_medians(name: str, metric: str, threshold: int, direction: str) -> None:
    a, b = per("median", "pitch_tempo")
    add(name, ["star"],
        f"""SELECT pitcher_name, {r('a')} AS median_tempo_{P0}, {r('b')} AS median_tempo_{P1}, {r('d')} AS tempo_change
        FROM (SELECT *, rank() OVER (ORDER BY {metric} {direction}) AS k FROM w WHERE d IS NOT NULL) WHERE k <= 15""",
        q=cohort(threshold),
        w=f"""SELECT *, b - a AS d FROM (SELECT pitcher_name, {a} AS a, {b} AS b FROM star
        WHERE {LATER} AND pitcher_name IN (SELECT pitcher_name FROM q) GROUP BY 1)""")


add_medians("leader_median_slow", "a", 1, "DESC")
add_medians("leader_median_fast", "b", 1, "ASC")
add_medians("leader_change_min", "d", MIN_PITCHES, "ASC")
add_medians("leader_change_max", "d", MIN_PITCHES, "DESC")

for _name, _direction in (("leader_mean_fast", "ASC"), ("leader_mean_slow", "DESC")):
    add(_name, ["star"],
        f"""SELECT pitcher_name, {MEANS} FROM (SELECT *, rank() OVER (ORDER BY a {_direction}) AS k FROM w
        WHERE a IS NOT NULL AND b IS NOT NULL) WHERE k <= 10""",
        q=cohort(1),
        w=two_means("pitcher_name", f"{LATER} AND pitch_tempo < {CAP} AND pitcher_name IN (SELECT pitcher_name FROM q)", digits=2))
add("pitcher_change", ["star"],
    f"SELECT pitcher_name, {MEANS}, {r(r('b - a', 2))} AS tempo_change FROM w WHERE b - a IS NOT NULL",
    q=cohort(MIN_PITCHES),
    w=two_means("pitcher_name", f"{LATER} AND pitch_tempo < {CAP} AND pitcher_name IN (SELECT pitcher_name FROM q)", digits=2))

CODES = f"""SELECT pitch_desc, pitch_code, count(*) AS n FROM star
    WHERE is_pitch AND pitch_desc IS NOT NULL AND pitch_code IS NOT NULL GROUP BY ALL HAVING count(*) > {MIN_TYPE_ROWS}"""
BOARD = f"""SELECT pitch_code, pitcher_name, {r('avg(start_speed)', 2)} AS velo, {r('avg(spin_rate)', 0)} AS spin_rate,
    count(*) AS n FROM star WHERE pitch_code IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 50"""
add("pitch_codes", ["star_all"], "SELECT * FROM codes", codes=CODES.replace("FROM star", "FROM star_all"))
add("pitch_leaderboards", ["star"],
    f"""SELECT pitch_code, pitcher_name, {r('velo')} AS velo, {r('spin_rate')} AS spin_rate, n FROM board
    WHERE pitch_code IN (SELECT pitch_code FROM codes)""", codes=CODES, board=BOARD)

add("pitch_leaderboard_one", ["star"],
    f"""SELECT pitcher_name, {r(r('avg(start_speed)', 2))} AS velo, {r(r('avg(spin_rate)', 0))} AS spin_rate, count(*) AS n
    FROM star WHERE pitch_code = 'R' AND year = {P1} GROUP BY 1 HAVING count(*) > 25""")

T975 = """z + (pow(z,3) + z) / (4*df) + (5*pow(z,5) + 16*pow(z,3) + 3*z) / (96*pow(df,2))
    + (3*pow(z,7) + 19*pow(z,5) + 17*pow(z,3) - 15*z) / (384*pow(df,3))
    + (79*pow(z,9) + 776*pow(z,7) + 1482*pow(z,5) - 1920*pow(z,3) - 945*z) / (92160*pow(df,4))"""


def p_value(t: str, df: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule on 2000 intervals."""
    return f"""(1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * abs({t}) / 6000.0 *
    list_sum(list_transform(range(2001), lambda s: (CASE WHEN s = 0 OR s = 2000 THEN 1.0 WHEN s % 2 = 1 THEN 4.0 ELSE 2.0 END)
    * pow(1 + pow(abs({t}) * s / 2000.0, 2) / {df}, -({df} + 1) / 2.0))))"""


def t_step(df: str) -> str:
    """One Newton step of `t` towards the two-sided 5 % point."""
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * pow(1 + t * t / {df}, -({df} + 1) / 2.0)"
    return f"t + ({p_value('t', df)} - 0.05) / (2 * {density})"


def add_fit(name: str, source: str, y: str, x: str, **steps: str) -> None:
    add(name, ["star"],
        f"""SELECT pitch_code, CAST(i AS INTEGER) AS point, {r('px')} AS x, {r(r('fit', 3))} AS fit,
        {r(r('fit - half', 3))} AS lower, {r(r('fit + half', 3))} AS upper FROM (
        SELECT *, b0 + b1 * px AS fit, t * sqrt(s2 * (1.0 / n + pow(px - mx, 2) / sxx)) AS half FROM (
        SELECT *, lo + i * (hi - lo) / 79.0 AS px FROM line, (SELECT range AS i FROM range(80)) p))""",
        **steps,
        line=f"""SELECT * REPLACE ({t_step('df')} AS t) FROM (SELECT * REPLACE ({t_step('df')} AS t) FROM (
        SELECT * REPLACE ({t_step('df')} AS t) FROM (SELECT *, {T975} AS t FROM (SELECT *, (syy - b1 * sxy) / df AS s2, CAST(1.959963984540054 AS DOUBLE) AS z FROM (
        SELECT pitch_code, regr_intercept({y}, {x}) AS b0, regr_slope({y}, {x}) AS b1, CAST(count(*) AS DOUBLE) AS n,
        CAST(count(*) - 2 AS DOUBLE) AS df, avg({x}) AS mx, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy,
        regr_sxy({y}, {x}) AS sxy, min({x}) AS lo, max({x}) AS hi FROM {source}
        WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1)))))""")


add_fit("fit_line", "board", "spin_rate", "velo", board=BOARD)


def add_by_type(name: str, measures: dict[str, str], with_cohort: bool, rounded: bool, known: bool) -> None:
    digits = {"velo": 2, "spin_rate": 0}
    inner, outer, complete = [], [], ["pitch_desc IS NOT NULL"]
    for m, column in measures.items():
        for tag, p, e in zip("ab", (P0, P1), per("avg", column)):
            inner.append(f"{r(e, digits[m]) if rounded else e} AS {m}_{tag}")
            outer.append(f"{r(f'{m}_{tag}')} AS avg_{m}_{p}")
            complete.append(f"{m}_{tag} IS NOT NULL")
        diff = f"{m}_b - {m}_a"
        outer.append(f"{r(r(diff, digits[m]) if rounded else diff)} AS {m}_change")
    if known:
        complete.append("pitch_desc IN (SELECT pitch_desc FROM codes)")
    where = f"is_pitch AND {QUALIFIED}" if with_cohort else "is_pitch"
    add(name, ["star"], f"SELECT pitch_desc, {', '.join(outer)} FROM w WHERE {' AND '.join(complete)}",
        q=cohort(MIN_PITCHES), codes=CODES, w=f"SELECT pitch_desc, {', '.join(inner)} FROM star WHERE {where} GROUP BY 1")


VELO, SPIN = {"velo": "start_speed"}, {"spin_rate": "spin_rate"}
add_by_type("season_velo", VELO, True, False, True)
add_by_type("season_spin", SPIN, True, False, True)
add_by_type("season_velo_all", VELO, False, True, False)
add_by_type("season_spin_all", SPIN, False, True, False)
add_by_type("season_by_type", {**VELO, **SPIN}, True, True, True)


def delta(measure: str, column: str, where: str) -> str:
    (v0, v1), (t0, t1), (n0, n1) = per("avg", column), per("avg", "pitch_tempo"), per("count", "*")
    return f"""SELECT pitch_code, pitcher_name, {v1} - {v0} AS diff_{measure}, {t1} - {t0} AS diff_tempo
    FROM star WHERE is_pitch AND {where} GROUP BY 1, 2 HAVING {n0} > 15 AND {n1} > 15"""


def add_ols_summary(name: str, measure: str, points: str) -> None:
    """The whole summary of a line per type; F is the square of the slope's t, so their tails are one."""
    y, x = f"diff_{measure}", "diff_tempo"
    quartiles = ", ".join(f"quantile_cont(y - (b0 + b1 * x), {p}) AS residual_{tag}" for tag, p in (("min", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1)))
    rounded = ", ".join(f"{r(f'residual_{tag}')} AS residual_{tag}" for tag in ("min", "q1", "median", "q3", "max"))
    add(name, ["star"],
        f"""SELECT pitch_code, n, {r('b0')} AS intercept, {r('b1')} AS slope, {r('r2')} AS r_squared, df, {r('se0')} AS intercept_se, {r('se1')} AS slope_se,
        {r('b0 / se0')} AS intercept_t, {r(p_value('(b0 / se0)', 'df'))} AS intercept_p, {r('b1 / se1')} AS slope_t, {r(p_value('(b1 / se1)', 'df'))} AS slope_p, {rounded},
        {r('sqrt(s2)')} AS residual_error, {r('1 - (1 - r2) * (n - 1) / df')} AS adjusted_r_squared, {r('pow(b1 / se1, 2)')} AS f_statistic, CAST(1 AS BIGINT) AS f_df1, df AS f_df2,
        {r(p_value('(b1 / se1)', 'df'))} AS f_p FROM fitted JOIN residuals USING (pitch_code)""",
        points=points,
        fitted=f"""SELECT *, sqrt(s2 / sxx) AS se1, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se0 FROM (SELECT *, (syy - b1 * sxy) / df AS s2 FROM (
        SELECT pitch_code, CAST(regr_count({y}, {x}) AS BIGINT) AS n, CAST(regr_count({y}, {x}) AS BIGINT) - 2 AS df, regr_intercept({y}, {x}) AS b0, regr_slope({y}, {x}) AS b1,
        regr_r2({y}, {x}) AS r2, regr_avgx({y}, {x}) AS mx, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy FROM points GROUP BY 1))""",
        residuals=f"""SELECT pitch_code, {quartiles} FROM (SELECT points.pitch_code, {y} AS y, {x} AS x, b0, b1 FROM points JOIN fitted ON fitted.pitch_code = points.pitch_code
        WHERE {y} IS NOT NULL AND {x} IS NOT NULL) GROUP BY 1""")


def add_ols(name: str, measure: str, points: str, table: int | None = None, published: bool = False) -> None:
    """Line per type; ``table`` asks for the short table with the intercept (0) or the slope (1), ``published`` for the rounded one of named types."""
    y, x = f"diff_{measure}", "diff_tempo"
    columns = f"""n, {r('b0')} AS intercept, {r('b1')} AS slope, {r('r2')} AS r_squared, df,
        {r('se0')} AS intercept_se, {r('se1')} AS slope_se, {r('b0 / se0')} AS intercept_t, {r(p_value('(b0 / se0)', 'df'))} AS intercept_p,
        {r('b1 / se1')} AS slope_t, {r(p_value('(b1 / se1)', 'df'))} AS slope_p"""
    if table is not None:
        columns = f"""{r(f'b{table}')} AS diff_tempo_coefficient,
        {r(p_value(f'(b{table} / se{table})', 'df'))} AS diff_tempo_p_value, {r('r2')} AS r_squared"""
    key, types, codes = "pitch_code", "", {}
    if published:
        columns = f"""{r('b1', 3)} AS diff_tempo_coefficient, {r(p_value('(b1 / se1)', 'df'), 3)} AS diff_tempo_p_value, {r('r2', 3)} AS r_squared"""
        key, types, codes = "pitch_desc AS pitch_type", "JOIN codes USING (pitch_code)", {"codes": CODES.replace("count(*) AS n", "count(*) AS n_rows")}
    add(name, ["star"],
        f"""SELECT {key}, {columns} FROM (
        SELECT *, sqrt(s2 / sxx) AS se1, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se0 FROM (
        SELECT *, (syy - b1 * sxy) / df AS s2 FROM (
        SELECT pitch_code, CAST(regr_count({y}, {x}) AS BIGINT) AS n, CAST(regr_count({y}, {x}) AS BIGINT) - 2 AS df,
        regr_intercept({y}, {x}) AS b0, regr_slope({y}, {x}) AS b1, regr_r2({y}, {x}) AS r2, regr_avgx({y}, {x}) AS mx,
        regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy FROM points GROUP BY 1))) {types}""",
        **codes, points=points)


CAPPED = f"pitch_tempo < {CAP}"
for _m, _c, _tag in (("velo", "start_speed", "velo"), ("spin_rate", "spin_rate", "spin")):
    add(f"season_delta_{_tag}", ["star"],
        f"SELECT pitch_code, pitcher_name, {r(f'diff_{_m}')} AS diff_{_m}, {r('diff_tempo')} AS diff_tempo FROM points",
        points=delta(_m, _c, CAPPED))
    add_ols(f"ols_{_tag}", _m, delta(_m, _c, CAPPED))
add_ols_summary("ols_summary", "velo", delta("velo", "start_speed", CAPPED))
add_ols_summary("ols_summary_spin", "spin_rate", delta("spin_rate", "spin_rate", CAPPED))
add_ols("ols_table", "velo", delta("velo", "start_speed", CAPPED), 1)
add_ols("ols_table_compat", "velo", delta("velo", "start_speed", CAPPED), 0)
add_ols("ols_table_published", "velo", delta("velo", "start_speed", CAPPED), 1, published=True)
add_ols("ols_table_spin", "spin_rate", delta("spin_rate", "spin_rate", CAPPED), 1, published=True)
VARIANT = "pitch_code = 'A' AND inning_count <> 1"
for _m, _c, _tag in (("velo", "start_speed", "velo"), ("spin_rate", "spin_rate", "spin")):
    add(f"season_delta_{_tag}_variant", ["star"],
        f"SELECT pitch_code, pitcher_name, {r(f'diff_{_m}')} AS diff_{_m}, {r('diff_tempo')} AS diff_tempo FROM points",
        points=delta(_m, _c, VARIANT))
add_ols("ols_variant", "velo", delta("velo", "start_speed", VARIANT))
add_ols_summary("ols_summary_variant", "velo", delta("velo", "start_speed", VARIANT))
add_fit("fit_change", "points", "diff_velo", "diff_tempo", points=delta("velo", "start_speed", CAPPED))

# Parks and fixed effects

add("park_dim", ["parks"],
    f"SELECT * REPLACE ({r('latitude')} AS latitude, {r('longitude')} AS longitude) FROM parks")
BAND = """CASE WHEN altitude > 1000 THEN 'above_1000' WHEN altitude > 900 AND altitude < 1000 THEN '900_to_1000'
    WHEN altitude < 900 AND altitude > 750 THEN '750_to_900' END"""
add("altitude_rank", ["parks"],
    f"""SELECT rank() OVER (ORDER BY altitude DESC) AS position, home_team, park_name, abbr, altitude, {BAND} AS band,
    park_name || ' (' || abbr || ')' AS label FROM parks WHERE home_team IS NOT NULL AND abbr IS NOT NULL""")
add("altitude_bands", ["parks"],
    f"SELECT {BAND} AS band, count(*) AS n, min(altitude) AS lowest, max(altitude) AS highest FROM parks GROUP BY 1")
add("park_tempo", ["star_home"],
    f"SELECT home_team, park_name, CAST(altitude AS INTEGER) AS altitude, {MEANS} FROM w WHERE a IS NOT NULL AND b IS NOT NULL",
    w=f"""SELECT home_team, park_name, altitude, {per('avg', 'pitch_tempo')[0]} AS a, {per('avg', 'pitch_tempo')[1]} AS b
    FROM star_home WHERE {LATER} AND {CAPPED} GROUP BY 1, 2, 3""")
add("flag_summary", ["star_home"],
    "SELECT CASE WHEN flag = 1 THEN 'flagged' ELSE 'elsewhere' END AS place, "
    + ", ".join(
        f"{r(e)} AS {fn_name}_{p}"
        for fn_name, fn in (("mean", "avg"), ("median", "median"))
        for p, e in zip((P0, P1), per(fn, "pitch_tempo"))
    )
    + f" FROM star_home WHERE {LATER} GROUP BY 1")


def add_fixed_effects(name: str, moderator: str, where: str, scope: str, only: str = "TRUE", effects: bool = False, table: bool = False, coefficients: bool = False) -> None:
    a, b = per("count", "*")
    by_type = scope == "type"
    demeaned = ", ".join(f"{v} - avg({v}) OVER g AS d{v}" for v in "tzy")
    final = f"""SELECT pitch_code, year, {r('b_t')} AS b_t, {r('se_t')} AS se_t, {r('b_t / se_t')} AS t_t,
        {r(p_value('(b_t / se_t)', 'df'))} AS p_t, {r('b_z')} AS b_z, {r('se_z')} AS se_z, {r('b_z / se_z')} AS t_z,
        {r(p_value('(b_z / se_z)', 'df'))} AS p_z, df, n_groups, n, {r('1 - rss / y2')} AS r2_uncentered,
        {r('1 - rss / yy')} AS r2_within, {r('1 - rss / (y2 - y1 * y1 / n)')} AS r2_centered FROM fitted"""
    if table:
        final = f"""SELECT pitch_desc AS pitch_type, year, {r('b_t', 3)} AS pitch_tempo_coefficient, {r(p_value('(b_t / se_t)', 'df'), 3)} AS pitch_tempo_p_value,
        {r('b_z', 4)} AS pitch_tempo_abbr_coefficient, {r(p_value('(b_z / se_z)', 'df'), 3)} AS pitch_tempo_abbr_p_value, {r('1 - rss / y2', 3)} AS r_squared
        FROM fitted JOIN (SELECT DISTINCT pitch_code, pitch_desc FROM star WHERE is_pitch AND pitch_desc IS NOT NULL) named USING (pitch_code)"""
    if effects:
        final = f"""SELECT pitch_code, year, pitcher_name, n, {r('effect')} AS effect, {r('se')} AS effect_se, {r('effect / se')} AS effect_t,
        {r(f"greatest({p_value('(effect / se)', 'df')}, 0.0)")} AS effect_p FROM effects"""
    if coefficients:
        final = " UNION ALL ".join(
            f"""SELECT pitch_code, year, {term} AS term, {r(b)} AS estimate, {r(se)} AS std_error, {r(f'{b} / {se}')} AS t, {r(f"greatest({p_value(f'({b} / {se})', 'df')}, 0.0)")} AS p FROM {source}"""
            for term, b, se, source in (("'pitch_tempo'", "b_t", "se_t", "fitted"), ("'pitch_tempo:moderator'", "b_z", "se_z", "fitted"), ("'pitcher_name:' || pitcher_name", "effect", "se", "effects")))
    add(name, ["star_home"], final,
        codes=f"SELECT pitch_code FROM star WHERE is_pitch AND pitch_desc IS NOT NULL GROUP BY 1 HAVING count(*) > {MIN_TYPE_ROWS}",
        q=f"""SELECT pitcher_name, pitch_code FROM star GROUP BY 1, 2 HAVING {a} > {MIN_TYPE_PITCHES} AND {b} > {MIN_TYPE_PITCHES}
        AND pitch_code IN (SELECT pitch_code FROM codes)""",
        rows=f"""SELECT q.pitch_code, s.year, s.pitcher_name, s.pitch_tempo AS t, s.pitch_tempo * {moderator} AS z, s.start_speed AS y
        FROM star_home s JOIN q ON q.pitcher_name = s.pitcher_name {'AND q.pitch_code = s.pitch_code' if by_type else ''}
        WHERE {where} AND {only} AND s.pitch_tempo IS NOT NULL""",
        d=f"SELECT *, {demeaned} FROM rows WINDOW g AS (PARTITION BY pitch_code, year, pitcher_name)",
        sums="""SELECT pitch_code, year, sum(dt * dt) AS tt, sum(dt * dz) AS tz, sum(dz * dz) AS zz, sum(dt * dy) AS ty,
        sum(dz * dy) AS zy, sum(dy * dy) AS yy, sum(y * y) AS y2, sum(y) AS y1, count(*) AS n,
        count(DISTINCT pitcher_name) AS n_groups FROM d GROUP BY 1, 2""",
        solved="""SELECT *, (zz * ty - tz * zy) / (tt * zz - tz * tz) AS b_t, (tt * zy - tz * ty) / (tt * zz - tz * tz) AS b_z,
        n - n_groups - 2 AS df FROM sums""",
        fitted="""SELECT *, sqrt(rss / df * zz / (tt * zz - tz * tz)) AS se_t, sqrt(rss / df * tt / (tt * zz - tz * tz)) AS se_z
        FROM (SELECT *, yy - b_t * ty - b_z * zy AS rss FROM solved)""",
        effects="""SELECT *, my - b_t * mt - b_z * mz AS effect,
        sqrt(rss / df * (1.0 / n + (mt * mt * zz - 2 * mt * mz * tz + mz * mz * tt) / (tt * zz - tz * tz))) AS se
        FROM (SELECT pitch_code, year, pitcher_name, count(*) AS n, avg(y) AS my, avg(t) AS mt, avg(z) AS mz FROM rows GROUP BY 1, 2, 3) means
        JOIN (SELECT * EXCLUDE (n) FROM fitted) f USING (pitch_code, year)""")


KEPT = f"is_pitch AND pitch_number <> 1 AND pitch_tempo < {CAP}"
add_fixed_effects("fe_flag", "flag", KEPT, "type")
add_fixed_effects("fe_flag_all_rows", "flag", KEPT, "all")
add_fixed_effects("fe_flag_table", "flag", KEPT, "all", table=True)
add_fixed_effects("fe_altitude", "altitude", f"is_pitch AND pitch_tempo < {CAP}", "type", f"q.pitch_code = 'A' AND s.year = {P0}")
add_fixed_effects("fe_effects", "flag", KEPT, "all", f"q.pitch_code = 'A' AND s.year = {P1}", effects=True)
add_fixed_effects("fe_coefficients", "flag", KEPT, "type", coefficients=True)

# Files, names, numbers, joins on missing ids

add("landed_payloads", [],
    f"""SELECT o_orderkey, CASE WHEN o_orderdate NOT BETWEEN DATE '{P0}-01-01' AND DATE '{P0}-12-31' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS o_orderdate,
    CASE WHEN old THEN floor(o_totalprice) ELSE {r('o_totalprice')} END AS amount, CASE WHEN NOT old THEN o_custkey % 2 = 0 END AS is_even,
    CASE WHEN NOT old THEN '{{"customer":' || o_custkey || ',"list":[1,2]}}' END AS nested_detail, CASE WHEN NOT old THEN 'note ' || o_orderpriority END AS note,
    CASE WHEN old THEN o_orderstatus END AS o_orderstatus FROM (SELECT *, year(o_orderdate) = {P0} AS old FROM orders)""")
add("ingest_order", [], "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ingest_seq FROM orders")
add("clean_names", [],
    f"""SELECT o_orderkey AS order_key, o_custkey AS order_key_2, {r('o_totalprice')} AS order_key_3, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS x1st_date,
    o_orderstatus AS percent_done_number, o_orderpriority AS x FROM orders""")
add("attach_null_ids", ["ev"],
    """SELECT ingest_seq, a.play_id, derived_seq FROM (SELECT ingest_seq, CASE WHEN ingest_seq % 40 <> 0 THEN play_id END AS play_id FROM ev) a
    LEFT JOIN (SELECT CASE WHEN ingest_seq % 4999 <> 1 THEN play_id END AS play_id, ingest_seq AS derived_seq FROM ev WHERE ingest_seq % 3 = 0 OR ingest_seq % 4999 = 1) b
    ON a.play_id IS NOT DISTINCT FROM b.play_id""")
RESUMED = "SELECT * REPLACE (CAST(datediff('day', DATE '2024-01-01', game_date) // 2 * 3 + game_pk % 3 AS BIGINT) AS game_pk) FROM ev"
for _name, _scope in (("tempo_resumed", "year, game_pk"), ("tempo_season_lag", "year")):
    add(_name, ["ev"],
        f"""SELECT ingest_seq, inning_count, {r('CASE WHEN inning_count <> 1 THEN gap_us / 1e6 END')} AS pitch_tempo FROM (SELECT ingest_seq,
        row_number() OVER (PARTITION BY year, pitcher_name, game_pk, inning ORDER BY game_date, start_time NULLS LAST, ingest_seq) AS inning_count,
        epoch_us(start_time) - lag(epoch_us(start_time)) OVER (PARTITION BY {_scope} ORDER BY game_date, game_pk, start_time NULLS LAST, ingest_seq) AS gap_us
        FROM resumed WHERE is_pitch) UNION ALL BY NAME SELECT ingest_seq, NULL::BIGINT AS inning_count, NULL::DOUBLE AS pitch_tempo FROM resumed WHERE NOT is_pitch""",
        resumed=RESUMED)
add("group_number", ["ev"],
    """SELECT ingest_seq, pitcher_name, game_pk, inning, dense_rank() OVER (ORDER BY pitcher_name NULLS LAST, game_pk, inning) AS group_number FROM ev WHERE is_pitch""")
add("group_number_hot", [],
    """SELECT l_orderkey, l_linenumber, part, dense_rank() OVER (ORDER BY part NULLS LAST) AS group_number
    FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE nullif(l_partkey, 7) END AS part FROM lineitem)""")
add("rank_many", [],
    """SELECT o_orderkey, price, rank() OVER (ORDER BY price DESC) AS position FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS price FROM orders)""")
add("leaderboard_outputs", ["star"],
    f"""SELECT *, count(*) OVER (PARTITION BY pitch_code) AS n_rows, 'unchanged' AS status FROM ({BOARD.replace("> 50", "> 25")})""")
