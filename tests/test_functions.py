import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from shelfline.functions import relational as rel
from shelfline.functions.columns import line_total, month_offset, total, week_start
from shelfline.functions.stats import normal_p, student_t_p, student_t_quantile, welch


@pytest.mark.parametrize("t, df, p", [
    (2.085963, 20.0, 0.05), (12.7062047, 1.0, 0.05), (-1.18865, 35.75, 0.2424), (-1.19156, 36.0, 0.24123),
    (0.0, 5.0, 1.0), (1.959964, 1e6, 0.05), (1.96, 1e9, 0.0499958)])
def test_student_p_values(spark, t, df, p):
    got = spark.range(1).select(student_t_p(F.lit(t), F.lit(df))).first()[0]
    assert got == pytest.approx(p, abs=2e-5)


def test_student_quantile_inverts_the_p_value(spark):
    got = spark.range(1).select(student_t_quantile(0.05, F.lit(20.0)), student_t_quantile(0.05, F.lit(1.0))).first()
    assert got[0] == pytest.approx(2.0859634473, abs=1e-8) and got[1] == pytest.approx(12.7062047362, abs=1e-8)


@pytest.mark.parametrize("t, df, p", [
    (2.0, 1.0, 1 - 2 / math.pi * math.atan(2.0)), (2.0, 2.0, 1 - 2 / math.sqrt(6)), (2.0, 1.1, 0.2771059),
    (1e6, 1.0, 2 / math.pi * math.atan(1e-6)), (1e4, 2.0, 1 - 1e4 / math.sqrt(2 + 1e8)), (0.0, 1.5, 1.0)])
def test_student_closed_forms(spark, t, df, p):
    got = spark.range(1).select(student_t_p(F.lit(t), F.lit(df))).first()[0]
    assert got == pytest.approx(p, rel=2e-7 if df == 1.1 else 1e-7 if t == 1e4 else 1e-9)


@pytest.mark.parametrize("df", [1.0, 1.1, 1.5, 2.0, 35.75])
@pytest.mark.parametrize("alpha", [0.05, 0.0001])
def test_student_quantile_has_no_ceiling(spark, alpha, df):
    q, back = spark.range(1).select(student_t_quantile(alpha, F.lit(df)).alias("q")).select(
        "q", student_t_p(F.col("q"), F.lit(df))).first()
    assert back == pytest.approx(alpha, rel=1e-9)
    exact = {1.0: 1 / math.tan(math.pi * alpha / 2), 2.0: (1 - alpha) * math.sqrt(2 / (1 - (1 - alpha) ** 2))}.get(df)
    assert exact is None or q == pytest.approx(exact, rel=1e-9)


def test_normal_far_tail(spark):
    got = spark.range(1).select(*[normal_p(F.lit(z)) for z in (1.0, 6.0, 20.0)]).first()
    for z, p in zip((1.0, 6.0, 20.0), got):
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_normal_p(spark):
    got = spark.range(1).select(normal_p(F.lit(1.959964)), normal_p(F.lit(0.0)), normal_p(F.lit(40.0))).first()
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] == 1.0 and got[2] == pytest.approx(0.0, abs=1e-12)


def test_welch_of_tiny_groups(spark):
    one = spark.createDataFrame([("CONTROL", 1.0), ("TREATMENT", 2.0), ("TREATMENT", 4.0)], "variant string, x double")
    row = welch(one, "x").first()
    assert (row.n_control, row.n_treatment, row.diff_abs) == (1, 2, 2.0)
    assert row.p_value is None and row.se is None


@pytest.mark.parametrize("p", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile_against_sorting(spark, p):
    rnd = random.Random(7)
    data = [("hot" if rnd.random() < 0.5 else "b", rnd.choice([-5.0, 0.0, 3.25, rnd.uniform(-1e4, 1e6)]))
            for _ in range(3000)] + [("one", 4.0), ("b", None)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {r.k: r.q for r in rel.exact_quantile(rel.value_counts(df, "x", ["k"]), "x", p, ["k"], "q").collect()}
    for k in ("hot", "b", "one"):
        xs = sorted(x for g, x in data if g == k and x is not None)
        pos = p * (len(xs) - 1)
        lo, hi = xs[int(pos)], xs[min(int(pos) + (pos > int(pos)), len(xs) - 1)]
        assert got[k] == pytest.approx(lo + (hi - lo) * (pos - int(pos)), abs=1e-6)
    assert statistics.median(x for g, x in data if g == "one") == 4.0


def test_exact_quantile_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "x double")
    assert rel.exact_quantile(rel.value_counts(df, "x"), "x", 0.5).first()[0] is None


def test_gaps_and_islands(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-06", "2024-01-14", "2024-01-30"]
    df = spark.createDataFrame([("a", day(d)) for d in days + days] + [("b", day("2024-01-01"))], "k string, d date")
    assert [r[-1] for r in rows(rel.gaps(df, ["k"], "d").orderBy("prev_day"), "prev_day", "idle_days")] == [3, 7, 15]
    runs = rows(rel.islands(df.distinct(), ["k"], "d"), "k", "run_start", "run_days")
    assert runs[0] == ("a", day("2024-01-01"), 2) and len(runs) == 5


def test_first_row_breaks_ties_by_the_other_columns(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 9, "z"), (None, 1, "n")], "k int, o int, v string")
    assert rows(rel.first_row(df, ["k"], ["o"])) == [(1, 5, "a"), (None, 1, "n")]
    assert rows(rel.first_row(df, ["k"], ["o"], last=True)) == [(1, 9, "z"), (None, 1, "n")]


def test_dense_periods_fill_with_zero(spark):
    df = spark.createDataFrame([("a", day("2024-01-01"), 5.0), ("a", day("2024-04-01"), 7.0)], "k string, m date, v double")
    assert [r[2] for r in rows(rel.dense_periods(df, ["k"], "m", ["v"], "1 month"))] == [5.0, 0.0, 0.0, 7.0]


def test_percentile_label_is_strict(spark):
    df = spark.createDataFrame([("f", float(x)) for x in (1, 2, 3, 4, 5)], "fmt string, x double")
    got = rel.below_percentile_flag(df, "fmt", "x", 0.25)
    assert [r.x for r in got.filter("estado = 'BAJO_RENDIMIENTO'").collect()] == [1.0]


def test_any_flag_ignores_nulls(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, False), (3, None)], "k int, f boolean")
    assert rows(rel.any_flag_per_group(df, ["k"], "f", "any")) == [(1, 1), (2, 0), (3, None)]


def test_month_offsets(spark):
    df = spark.createDataFrame([(day("2024-02-01"), day("2024-03-01")), (day("2025-01-01"), day("2025-03-01"))], "a date, b date")
    assert rows(df.select(month_offset("b", "a"), month_offset("b", "a", "days30"))) == [(1, 0), (2, 1)]


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame([(day("2024-09-01"),), (day("2024-09-02"),)], "d date")
    assert rows(df.select(week_start("d"))) == [(day("2024-08-26"),), (day("2024-09-02"),)]


def test_large_whole_quantities_do_not_overflow(spark):
    df = spark.createDataFrame([(2_000_000_000,)] * 3, "q int")
    assert df.agg(line_total("q")).first()[0] == 6e9


def test_sums_do_not_depend_on_order(spark):
    values = [0.1, 1e11, -1e11, 0.2, 12345.6789] * 50
    one = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).agg(total("v"), line_total("v")).first()
    many = spark.createDataFrame([(v,) for v in reversed(values)], "v double").repartition(16).agg(
        total("v"), line_total("v")).first()
    assert one == many and one[0] == one[1] == pytest.approx(sum([0.3, 12345.6789]) * 50)
