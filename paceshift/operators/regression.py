"""Linear models from distributed sufficient statistics.

No model matrix is built. A line per group comes from the built-in regression aggregates; a model with one
intercept per entity comes from sums of squares and products centred within each entity, which combine on
the map side, add across entities and leave a two-by-two system per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.student_t import f_tail, t_quantile, two_sided_p
from .ordered import exact_quantiles
from .reuse import join_small, written_once


def _positive(x: Column) -> Column:
    return F.nullif(F.greatest(x, F.lit(0.0)), F.lit(0.0))


def _lines(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    fitted = df.groupBy(*keys).agg(
        F.regr_count(y, x).cast("long").alias("n"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_r2(y, x).alias("r_squared"),
        F.regr_avgx(y, x).alias("mean_x"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.min(F.when(both, F.col(x))).alias("min_x"),
        F.max(F.when(both, F.col(x))).alias("max_x"),
    )
    df_resid = F.col("n") - 2
    sxx = F.nullif(F.col("sxx"), F.lit(0.0))
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    out = fitted.where(F.col("n") > 0).withColumn(
        "sigma2", F.when(df_resid > 0, rss / F.nullif(df_resid, F.lit(0)))
    )
    slope_se = F.sqrt(F.col("sigma2") / sxx)
    intercept_se = F.sqrt(F.col("sigma2") * (1.0 / F.col("n") + F.col("mean_x") * F.col("mean_x") / sxx))
    return out.withColumns({"df": df_resid, "intercept_se": intercept_se, "slope_se": slope_se})


def simple_ols(df: DataFrame, keys: Sequence[str], y: str, x: str, p_values: bool = True) -> DataFrame:
    """Least-squares line per group: coefficients with standard error, t and p, and R squared.

    Rows lacking y or x are ignored.
    """
    out = _lines(df, keys, y, x)
    for name in ("intercept", "slope"):
        out = out.withColumn(f"{name}_t", F.col(name) / F.nullif(F.col(f"{name}_se"), F.lit(0.0)))
        if p_values:
            out = out.withColumn(f"{name}_p", two_sided_p(f"{name}_t", "df"))
    return out.drop("sxy", "syy", "min_x", "max_x")


def line_summary(df: DataFrame, keys: Sequence[str], y: str, x: str, p_values: bool = True) -> DataFrame:
    """The whole printed summary of a line per group: coefficients, the least, greatest and quartiles of the residuals, residual
    error, both forms of R squared, and F with its degrees of freedom and tail.

    Residuals take a second pass, in which the fitted lines (a row for each group) join the points; the quartiles are exact, found through
    cell counts, so that a group of any size is neither sorted nor gathered as a whole. Rows lacking y or x are ignored.
    """
    lines = written_once(simple_ols(df, keys, y, x, p_values))
    points = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fitted = join_small(points, lines.select(*keys, F.col("intercept").alias("__b0"), F.col("slope").alias("__b1")), list(keys), F.xxhash64(y, x))
    residuals = fitted.select(*keys, (F.col(y) - (F.col("__b0") + F.col("__b1") * F.col(x))).alias("residual"))
    probs = {"residual_min": 0.0, "residual_q1": 0.25, "residual_median": 0.5, "residual_q3": 0.75, "residual_max": 1.0}
    quartiles = exact_quantiles(residuals, keys, "residual", probs).drop("n").withColumnsRenamed({k: f"__q_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__q_{k}"))
    out = lines.join(quartiles, match, "left").drop(*[f"__q_{k}" for k in keys])
    df_resid = F.when(F.col("df") > 0, F.col("df"))
    out = out.withColumns(
        {
            "residual_error": F.sqrt("sigma2"),
            "adjusted_r_squared": 1.0 - (1.0 - F.col("r_squared")) * (F.col("n") - 1) / df_resid,
            "f_statistic": F.col("slope") * F.col("slope") * F.col("sxx") / F.nullif(F.col("sigma2"), F.lit(0.0)),
            "f_df1": F.when(F.col("slope").isNotNull(), F.lit(1).cast("long")),
            "f_df2": F.col("df"),
        }
    )
    if p_values:
        out = out.withColumn("f_p", f_tail("f_statistic", "f_df1", "f_df2"))
    return out.drop("sxx", "mean_x", "sigma2")


def fit_band(
    df: DataFrame, keys: Sequence[str], y: str, x: str, points: int = 80, level: float = 0.95
) -> DataFrame:
    """Fitted line with its confidence band on ``points`` positions across the range of x, per group."""
    model = _lines(df, keys, y, x).withColumn("t_band", t_quantile(0.5 + level / 2.0, "df"))
    at = model.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = at.withColumn(
        "x", F.col("min_x") + F.col("point") * (F.col("max_x") - F.col("min_x")) / F.lit(float(points - 1))
    )
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    away = F.col("x") - F.col("mean_x")
    half = F.col("t_band") * F.sqrt(
        F.col("sigma2") * (1.0 / F.col("n") + away * away / F.nullif(F.col("sxx"), F.lit(0.0)))
    )
    return at.select(
        *keys, "point", "x", fit.alias("fit"), (fit - half).alias("lower"), (fit + half).alias("upper")
    )


PRODUCTS = {"tt": ("t", "t"), "tz": ("t", "z"), "zz": ("z", "z"), "ty": ("t", "y"), "zy": ("z", "y"), "yy": ("y", "y")}


def entity_sums(
    df: DataFrame,
    keys: Sequence[str],
    y: Column,
    t: Column,
    z: Column,
    where: Column | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Size, means and centred sums of products of (t, z, y) per group, over rows complete in all three.

    ``where`` restricts the sums only; ``totals`` are other aggregates of the same groups, so that one
    scan also serves the counts a cohort needs.
    """
    complete = t.isNotNull() & z.isNotNull() & y.isNotNull()
    if where is not None:
        complete = complete & where
    prepared = df.withColumns(
        {"__" + name: F.when(complete, c.cast("double")) for name, c in (("t", t), ("z", z), ("y", y))}
    )
    size = F.count("__y")
    return prepared.groupBy(*keys).agg(
        size.alias("n"),
        *[F.avg(f"__{v}").alias(f"mean_{v}") for v in "tzy"],
        *[(F.covar_pop(f"__{a}", f"__{b}") * size).alias(f"s_{name}") for name, (a, b) in PRODUCTS.items()],
        *[c.alias(name) for name, c in (totals or {}).items()],
    )


def merge_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine groups into coarser ones, re-centring each on the common mean."""
    sums = sums.where(F.col("n") > 0)
    whole = W.partitionBy(*keys)
    centred = sums.withColumns(
        {f"__m_{v}": F.sum(F.col("n") * F.col(f"mean_{v}")).over(whole) / F.sum("n").over(whole) for v in "tzy"}
    )

    def shift(v: str) -> Column:
        return F.col(f"mean_{v}") - F.col(f"__m_{v}")

    return centred.groupBy(*keys).agg(
        *[F.max(f"__m_{v}").alias(f"mean_{v}") for v in "tzy"],
        *[
            F.sum(F.col(f"s_{name}") + F.col("n") * shift(a) * shift(b)).alias(f"s_{name}")
            for name, (a, b) in PRODUCTS.items()
        ],
        F.sum("n").alias("n"),
    )


COVARIANCE = ["sigma2", "v_tt", "v_tz", "v_zz"]


def solve_fixed_effects(sums: DataFrame, keys: Sequence[str], p_values: bool = True, covariance: bool = False) -> DataFrame:
    """Fit ``y ~ t + z + one intercept per entity`` per model, from one row of sums per (model, entity).

    Where the moderator never varies within an entity, only t is fitted and the z columns are null.
    R squared comes in three forms: against zero, as for any model without a common intercept; within
    entities; and against the common mean. ``covariance=True`` adds the residual variance and the variances and covariance of the two coefficients.
    """
    size = F.col("n")
    model = (
        sums.where(size > 0)
        .groupBy(*keys)
        .agg(
            *[F.sum(f"s_{name}").alias(name) for name in PRODUCTS],
            F.sum(F.col("s_yy") + size * F.col("mean_y") * F.col("mean_y")).alias("y2"),
            F.sum(size * F.col("mean_y")).alias("y1"),
            F.count("*").alias("n_groups"),
            F.sum("n").alias("n"),
        )
    )
    c = F.col
    det = c("tt") * c("zz") - c("tz") * c("tz")
    both = det > F.lit(1e-12) * c("tt") * c("zz")
    solvable = F.when(both, det)
    model = model.withColumns(
        {
            "b_t": F.when(both, (c("zz") * c("ty") - c("tz") * c("zy")) / solvable).otherwise(
                c("ty") / _positive(c("tt"))
            ),
            "b_z": (c("tt") * c("zy") - c("tz") * c("ty")) / solvable,
            "df": size - c("n_groups") - F.when(both, 2).otherwise(1),
        }
    )
    rss = F.greatest(
        c("yy") - c("b_t") * c("ty") - F.coalesce(c("b_z") * c("zy"), F.lit(0.0)), F.lit(0.0)
    )
    model = model.withColumn("rss", rss)
    sigma2 = c("rss") / F.when(c("df") > 0, c("df"))
    model = model.withColumns(
        {
            "se_t": F.sqrt(F.when(both, sigma2 * c("zz") / solvable).otherwise(sigma2 / _positive(c("tt")))),
            "se_z": F.sqrt(sigma2 * c("tt") / solvable),
            "r2_uncentered": 1.0 - c("rss") / _positive(c("y2")),
            "r2_within": 1.0 - c("rss") / _positive(c("yy")),
            "r2_centered": 1.0 - c("rss") / _positive(c("y2") - c("y1") * c("y1") / size),
        }
    )
    inverse = {"v_tt": F.when(both, sigma2 * c("zz") / solvable).otherwise(sigma2 / _positive(c("tt"))), "v_tz": -sigma2 * c("tz") / solvable, "v_zz": sigma2 * c("tt") / solvable}
    model = model.withColumns({"sigma2": sigma2, **inverse})
    columns = []
    for v in "tz":
        model = model.withColumn(f"t_{v}", c(f"b_{v}") / F.nullif(c(f"se_{v}"), F.lit(0.0)))
        columns += [f"b_{v}", f"se_{v}", f"t_{v}"]
        if p_values:
            model = model.withColumn(f"p_{v}", two_sided_p(f"t_{v}", "df"))
            columns.append(f"p_{v}")
    return model.select(
        *keys, *columns, "df", "n_groups", "n", "r2_uncentered", "r2_within", "r2_centered", *(COVARIANCE if covariance else [])
    )


def entity_effects(sums: DataFrame, model: DataFrame, keys: Sequence[str], entity: str, p_values: bool = True) -> DataFrame:
    """The intercept of each entity in its model, with standard error, t and p. ``model`` was solved with ``covariance=True``.

    An intercept is the entity's mean of y less the coefficients times its means, so its variance is that of the mean plus that
    of the coefficients seen from there: no model matrix with a column for each entity is needed.
    """
    coefficients = model.select(*[F.col(k).alias(f"__{k}") for k in keys], "b_t", "b_z", "df", *COVARIANCE)
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"__{k}"))
    c, none = F.col, F.lit(0.0)
    effect = c("mean_y") - c("b_t") * c("mean_t") - F.coalesce(c("b_z") * c("mean_z"), none)
    slopes = c("mean_t") * c("mean_t") * c("v_tt") + F.coalesce(2.0 * c("mean_t") * c("mean_z") * c("v_tz") + c("mean_z") * c("mean_z") * c("v_zz"), none)
    out = sums.where(c("n") > 0).join(coefficients, match)
    out = out.withColumns({"effect": effect, "effect_se": F.sqrt(c("sigma2") / c("n") + slopes)})
    out = out.withColumn("effect_t", c("effect") / F.nullif(c("effect_se"), none))
    columns = ["n", "effect", "effect_se", "effect_t"]
    if p_values:
        out = out.withColumn("effect_p", two_sided_p("effect_t", "df"))
        columns.append("effect_p")
    return out.select(*keys, entity, *columns)


def coefficient_table(
    sums: DataFrame, model: DataFrame, keys: Sequence[str], entity: str, terms: tuple[str, str] = ("tempo", "moderator")
) -> DataFrame:
    """All coefficients of each model as rows: term, estimate, std_error, t and p; the term of an entity's intercept is its name after ``entity:``.

    A moderator that cannot be fitted has no row.
    """
    columns = ["estimate", "std_error", "t", "p"]
    parts = [
        model.where(F.col(f"b_{v}").isNotNull()).select(
            *keys, F.lit(term).alias("term"), *[F.col(f"{a}_{v}").alias(name) for a, name in zip(("b", "se", "t", "p"), columns, strict=True)]
        )
        for v, term in zip("tz", terms, strict=True)
    ]
    effects = entity_effects(sums, model, keys, entity)
    named = F.concat(F.lit(f"{entity}:"), F.col(entity).cast("string")).alias("term")
    parts.append(effects.select(*keys, named, *[F.col(a).alias(name) for a, name in zip(("effect", "effect_se", "effect_t", "effect_p"), columns, strict=True)]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
