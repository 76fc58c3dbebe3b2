"""Two-sample statistics as column expressions; no Python code runs in the tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .columns import ratio

# Nodes of the double-exponential rule: x from -_LAST * _STEP to _LAST * _STEP. The rule packs its points towards both
# ends of a range, so neither an infinite slope there nor a narrow peak costs digits.
_STEP, _LAST = 0.025, 160
_PI = 3.141592653589793


def _sum_over_nodes(term) -> Column:
    """Sum of ``term(x)`` over the nodes, times the step."""
    terms = F.transform(F.sequence(F.lit(-_LAST), F.lit(_LAST)), lambda k: term(k * F.lit(_STEP)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) * F.lit(_STEP)


def _sine_power_integral(upper: Column, power: Column) -> Column:
    """Integral of (sin(y) / sin(upper)) ^ power for y from 0 to ``upper``, for powers above -1."""
    def term(x):
        share = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-_PI) * F.sinh(x)))
        other = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(_PI) * F.sinh(x)))
        return F.exp(power * F.log(F.sin(upper * share) / F.sin(upper))) * share * other * F.lit(_PI) * F.cosh(x)
    return upper * _sum_over_nodes(term)


def student_t_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t.

    With t = sqrt(df) / tan(y) the density is proportional to sin(y)^(df-1), and the tail is the integral from 0 to
    the angle of t: far tails keep their digits, for nothing is taken from 1.
    """
    quarter = F.lit(_PI / 2)
    angle = F.atan2(F.sqrt(df), F.abs(t))
    scale = F.exp((df - 1) * F.log(F.sin(angle)))
    return scale * _sine_power_integral(angle, df - 1) / _sine_power_integral(quarter, df - 1)


def student_t_quantile(alpha: float, df: Column) -> Column:
    """The t with two-sided p-value ``alpha`` for df of at least 1, by bisection of its angle.

    The quantile falls as df grows, so that of df 1, cot(pi * alpha / 2), is an upper bracket.
    """
    top = F.lit(1 / math.tan(_PI * alpha / 2))
    middle = lambda acc: (acc["lo"] + acc["hi"]) / 2
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.lit(0.0).alias("lo"), top.alias("hi")),
        lambda acc, _: F.when(
            student_t_p(middle(acc), df) > F.lit(alpha),
            F.struct(middle(acc).alias("lo"), acc["hi"].alias("hi")),
        ).otherwise(F.struct(acc["lo"].alias("lo"), middle(acc).alias("hi"))),
    )
    return F.when(df == 1, top).otherwise(middle(halved))


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a normal deviate: the density at z times the integral of exp(-z u - u^2 / 2) over u > 0."""
    def term(x):
        u = F.exp(F.lit(_PI / 2) * F.sinh(x))
        return F.exp(-F.abs(z) * u - u * u / 2) * u * F.lit(_PI / 2) * F.cosh(x)
    return F.least(F.exp(-z * z / 2) * F.lit(math.sqrt(2 / _PI)) * _sum_over_nodes(term), F.lit(1.0))


def welch(df: DataFrame, value: str, by: Sequence[str] = (), group: str = "variant",
          control: str = "CONTROL", treatment: str = "TREATMENT") -> DataFrame:
    """Welch's t-test of treatment against control: one row, or one per ``by``.

    Statistics that need two values in each arm are null when an arm has fewer.
    """
    def arm(label: str) -> Column:
        return F.when(F.col(group) == F.lit(label), F.col(value))

    sides = df.groupBy(*by).agg(
        F.count(arm(control)).alias("n_control"), F.count(arm(treatment)).alias("n_treatment"),
        F.avg(arm(control)).alias("mean_control"), F.avg(arm(treatment)).alias("mean_treatment"),
        F.var_samp(arm(control)).alias("_var_c"), F.var_samp(arm(treatment)).alias("_var_t"),
    )
    part_c, part_t = F.col("_var_c") / F.col("n_control"), F.col("_var_t") / F.col("n_treatment")
    enough = (F.col("n_control") > 1) & (F.col("n_treatment") > 1)
    freedom = ratio(
        F.pow(part_c + part_t, F.lit(2.0)),
        F.pow(part_c, F.lit(2.0)) / (F.col("n_control") - 1) + F.pow(part_t, F.lit(2.0)) / (F.col("n_treatment") - 1),
    )
    return (
        sides.withColumn("diff_abs", F.col("mean_treatment") - F.col("mean_control"))
        .withColumn("lift_pct", ratio(F.col("diff_abs"), F.col("mean_control")) * 100)
        .withColumn("se", F.when(enough, F.sqrt(part_c + part_t)))
        .withColumn("t_stat", F.when(enough, ratio(F.col("diff_abs"), F.col("se"))))
        .withColumn("df", F.when(enough, freedom))
        .withColumn("p_value", F.when(enough & F.col("df").isNotNull(), student_t_p(F.col("t_stat"), F.col("df"))))
        .drop("_var_c", "_var_t")
    )
