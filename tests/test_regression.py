import os
import pathlib
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceshift.functions.student_t import f_tail_value, t_quantile_value, two_sided_p_value
from paceshift.operators.regression import (
    coefficient_table,
    entity_effects,
    entity_sums,
    fit_band,
    line_summary,
    merge_sums,
    simple_ols,
    solve_fixed_effects,
)
from paceshift.operators.reuse import written_once

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_student_t_against_printed_tables():
    # Critical values of t for a two-sided 5 % test, and one for 1 %.
    for df, critical, p in ((1, 12.706205, 0.05), (10, 2.228139, 0.05), (30, 2.042272, 0.05), (120, 2.617421, 0.01)):
        assert two_sided_p_value(critical, df) == pytest.approx(p, abs=1e-6)
        assert two_sided_p_value(-critical, df) == pytest.approx(p, abs=1e-6)
        assert t_quantile_value(1 - p / 2, df) == pytest.approx(critical, abs=1e-5)
    assert two_sided_p_value(0.0, 5) == pytest.approx(1.0)
    assert two_sided_p_value(None, 5) is None and two_sided_p_value(1.0, 0) is None
    assert two_sided_p_value(1.959964, 1e6) == pytest.approx(0.05, abs=1e-5)


def least_squares(design, y):
    design, y = np.asarray(design, float), np.asarray(y, float)
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    rss = float(((y - design @ beta) ** 2).sum())
    df = len(y) - design.shape[1]
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss / df)
    return beta, se, rss, df


def test_line_per_group(spark):
    rng = random.Random(1)
    rows = [(g, x, 2.0 + 0.5 * x + rng.gauss(0, 1)) for g in "ab" for x in (rng.uniform(-5, 5) for _ in range(40))]
    df = spark.createDataFrame(rows + [("a", None, 1.0), ("b", 1.0, None)], "g STRING, x DOUBLE, y DOUBLE")
    for r in simple_ols(df, ["g"], "y", "x").collect():
        x = [a for g, a, _ in rows if g == r.g]
        y = [b for g, _, b in rows if g == r.g]
        beta, se, rss, dof = least_squares([[1, v] for v in x], y)
        assert (r.n, r.df) == (40, dof)
        assert [r.intercept, r.slope] == pytest.approx(list(beta))
        assert [r.intercept_se, r.slope_se] == pytest.approx(list(se))
        assert r.r_squared == pytest.approx(1 - rss / np.var(y) / 40)
        assert r.slope_p == pytest.approx(two_sided_p_value(beta[1] / se[1], dof))


def test_band_passes_through_the_line_and_widens(spark):
    rows = [(1, float(x), 3.0 * x + (-1) ** x) for x in range(20)]
    out = fit_band(spark.createDataFrame(rows, "g INT, x DOUBLE, y DOUBLE"), ["g"], "y", "x").orderBy("point").collect()
    assert len(out) == 80 and out[0].x == 0.0 and out[-1].x == 19.0
    width = [r.upper - r.lower for r in out]
    assert width[0] > width[40] < width[-1]
    beta, _, rss, dof = least_squares([[1, r[1]] for r in rows], [r[2] for r in rows])
    xs = np.arange(20)
    half = t_quantile_value(0.975, dof) * np.sqrt(rss / dof * (1 / 20 + xs.mean() ** 2 / ((xs - xs.mean()) ** 2).sum()))
    assert out[0].fit == pytest.approx(beta[0]) and width[0] / 2 == pytest.approx(half)


def panel(seed, pitchers=6, n=240, flagged=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = "hot" if i % 3 == 0 else f"p{rng.randrange(pitchers)}"
        t = rng.uniform(5, 40)
        flag = float(rng.random() < 0.2) if flagged else 0.0
        y = 90 + len(p) + 0.02 * t - 0.05 * t * flag + rng.gauss(0, 1)
        rows.append((p, rng.choice(["FF", "SL"]), t, flag, y))
    return rows + [("alone", "FF", 12.0, 0.0, 95.0), ("gap", "FF", None, 0.0, 90.0)]


def dense(rows):
    rows = [r for r in rows if r[2] is not None]
    names = sorted({r[0] for r in rows})
    design = [[t, t * f, *[1.0 * (p == q) for q in names]] for p, _, t, f, _ in rows]
    return names, design, [r[4] for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "p STRING, code STRING, t DOUBLE, flag DOUBLE, y DOUBLE").repartition(4)


@pytest.mark.parametrize("merged", [False, True])
def test_fixed_effects_match_a_dense_fit(spark, merged):
    rows = panel(7)
    keys = ["p", "code"] if merged else ["p"]
    sums = entity_sums(frame(spark, rows), keys, F.col("y"), F.col("t"), F.col("t") * F.col("flag"))
    if merged:
        sums = merge_sums(sums, ["p"])
    sums = sums.withColumn("model", F.lit(1))
    model = solve_fixed_effects(sums, ["model"], covariance=True)
    r = model.collect()[0]
    names, design, y = dense(rows)
    beta, se, rss, dof = least_squares(design, y)
    assert (r.n, r.n_groups, r.df) == (len(y), len(names), dof)
    assert [r.b_t, r.b_z] == pytest.approx(list(beta[:2]))
    assert [r.se_t, r.se_z] == pytest.approx(list(se[:2]))
    assert r.r2_uncentered == pytest.approx(1 - rss / np.square(y).sum())
    assert r.r2_centered == pytest.approx(1 - rss / (np.var(y) * len(y)))
    assert r.p_z == pytest.approx(two_sided_p_value(beta[1] / se[1], dof))
    effects = {e.p: e.effect for e in entity_effects(sums, model, ["model"], "p").collect()}
    assert effects == pytest.approx(dict(zip(names, beta[2:])))


def test_moderator_that_never_varies_is_left_out(spark):
    rows = panel(8, flagged=False)
    sums = entity_sums(frame(spark, rows), ["p"], F.col("y"), F.col("t"), F.col("t") * F.col("flag"))
    r = solve_fixed_effects(sums.withColumn("model", F.lit(1)), ["model"], covariance=True).collect()[0]
    names, design, y = dense(rows)
    beta, se, _, dof = least_squares([[d[0], *d[2:]] for d in design], y)
    assert r.b_z is None and r.p_z is None and r.df == dof
    assert (r.b_t, r.se_t) == (pytest.approx(beta[0]), pytest.approx(se[0]))


def test_models_run_from_a_folder_without_the_package(tmp_path):
    """The t distribution travels with the plan; the workers need not find this package."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "from paceshift.session import local_session\n"
        "from paceshift.functions.student_t import two_sided_p\n"
        "spark = local_session(1, '1g')\n"
        "from pyspark.sql import functions as F\n"
        "p = spark.range(1).select(two_sided_p(F.lit(2.0), F.lit(10.0))).first()[0]\n"
        "assert abs(p - 0.07339) < 1e-4, p\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-800:]


def test_intermediates_use_the_sessions_folder_or_are_kept(spark, tmp_path):
    context = spark.sparkContext
    df = spark.range(10)
    before = context.getCheckpointDir()
    kept = written_once(df)
    assert context.getCheckpointDir() == before
    if before is None:
        assert kept.is_cached
        kept.unpersist()
        context.setCheckpointDir(str(tmp_path))
        written = written_once(df)
        assert not written.is_cached and written.count() == 10


@pytest.mark.parametrize("flagged", [True, False])
def test_whole_coefficient_table_matches_a_dense_fit(spark, flagged):
    """Estimate, standard error, t and p of the slopes and of each entity's intercept, against the whole model matrix."""
    rows = panel(5, flagged=flagged)
    sums = entity_sums(frame(spark, rows).withColumn("m", F.lit(1)), ["m", "p"], F.col("y"), F.col("t"), F.col("t") * F.col("flag"))
    model = solve_fixed_effects(sums, ["m"], covariance=True)
    table = {r.term: r for r in coefficient_table(sums, model, ["m"], "p").collect()}
    names, design, y = dense(rows)
    terms = ["tempo", "moderator", *[f"p:{n}" for n in names]]
    if not flagged:
        terms, design = [t for t in terms if t != "moderator"], [[r[0], *r[2:]] for r in design]
    design, y = np.array(design), np.array(y)
    inverse = np.linalg.inv(design.T @ design)
    b = inverse @ design.T @ y
    df = len(y) - design.shape[1]
    se = np.sqrt(np.diag(inverse) * ((y - design @ b) ** 2).sum() / df)
    assert set(table) == set(terms)
    for k, term in enumerate(terms):
        row = table[term]
        assert (row.estimate, row.std_error, row.t) == pytest.approx((b[k], se[k], b[k] / se[k]), rel=1e-7)
        assert row.p == pytest.approx(two_sided_p_value(b[k] / se[k], df), abs=1e-12)


def test_line_summary_against_a_dense_fit(spark):
    r = random.Random(11)
    rows = [(g, x, 3 + 0.5 * x + r.gauss(0, 1)) for g in "ab" for x in [r.uniform(0, 9) for _ in range(50 if g == "a" else 7)]]
    rows += [("a", None, 1.0), ("b", 2.0, None), ("c", 1.0, 2.0), ("d", None, None)]
    got = {x.g: x for x in line_summary(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "y", "x").collect()}
    assert set(got) == {"a", "b", "c"}
    for g in "ab":
        x, y = np.array([(a, b) for k, a, b in rows if k == g and a is not None and b is not None]).T
        design = np.column_stack([np.ones(len(x)), x])
        b, n = np.linalg.lstsq(design, y, rcond=None)[0], len(x)
        e = y - design @ b
        rss, tss = (e**2).sum(), ((y - y.mean()) ** 2).sum()
        f = (tss - rss) / (rss / (n - 2))
        quartiles = [getattr(got[g], f"residual_{q}") for q in ("min", "q1", "median", "q3", "max")]
        assert quartiles == pytest.approx(np.quantile(e, [0, 0.25, 0.5, 0.75, 1]).tolist(), abs=1e-9)
        row = got[g]
        assert (row.residual_error, row.r_squared, row.f_statistic) == pytest.approx((np.sqrt(rss / (n - 2)), 1 - rss / tss, f))
        assert row.adjusted_r_squared == pytest.approx(1 - rss / (n - 2) / (tss / (n - 1)))
        assert (row.f_df1, row.f_df2) == (1, n - 2) and row.f_p == pytest.approx(row.slope_p)
    assert got["c"].residual_error is None and got["c"].f_p is None and got["c"].n == 1


def test_f_tail_against_printed_tables():
    # Upper 5 % points of F.
    for f, df1, df2 in ((4.965, 1, 10), (3.490, 3, 12), (2.711, 5, 20), (161.448, 1, 1)):
        assert f_tail_value(f, df1, df2) == pytest.approx(0.05, abs=2e-5)
    assert f_tail_value(0.0, 2, 9) == 1.0 and f_tail_value(None, 1, 2) is None and f_tail_value(1.0, 1, 0) is None
