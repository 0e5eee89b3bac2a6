"""Published statistic/p-value pairs and properties of the tests and scores."""

import math
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from tidewatch.functions.tdist import two_sided_p
from tidewatch.operators.diagnostics import change_correlation, two_fold_skill
from tidewatch.operators.scoring import dm_by_group, leakage_inflation, score, verdicts


@pytest.mark.parametrize(
    "t, df, p",
    [
        (-1.4905347034806553, 496, 0.13671933872798703),
        (8.016426670115015, 496, 7.771561172376096e-15),
        (12.513099184327876, 496, 0.0),
        (0.05618981102657626 * math.sqrt(494 / (1 - 0.05618981102657626**2)), 494, 0.2115786851896754),
        (1.0, 1, 0.5),
        (1.0, 2, 1 - 1 / math.sqrt(3)),
        (0.0, 7, 1.0),
    ],
)
def test_p_values(spark, t, df, p):
    row = spark.range(1).select(F.lit(t).alias("t"), F.lit(df).alias("df"))
    got = row.select(two_sided_p(F.col("t"), F.col("df"))).first()[0]
    assert got == pytest.approx(p, abs=2e-13)


def test_p_values_over_a_grid_of_degrees(spark):
    cases = [(t, df) for t in (0.3, 1.7, 2.5, 4.0) for df in (3, 4, 9, 57, 999, 1000, 1001, 5000, 10**6)]
    df = spark.createDataFrame(cases, "t double, df int")
    for r in df.withColumn("p", two_sided_p(F.col("t"), F.col("df"))).collect():
        assert r.p == pytest.approx(brute.t_two_sided(r.t, r.df), abs=1e-8)
    extremes = spark.createDataFrame([(50.0, 3), (50.0, 5000), (None, 10), (1.0, 0)], "t double, df int")
    got = [r.p for r in extremes.withColumn("p", two_sided_p(F.col("t"), F.col("df"))).collect()]
    assert 0 < got[0] < 1e-4 and got[1] == 0.0 and got[2] is None and got[3] is None


def _exact_tail(t, df):
    """The tail for an even number of degrees, in 90 digits."""
    with localcontext() as exact:
        exact.prec = 90
        t, df = Decimal(t), Decimal(df)
        cos2, term, total = df / (df + t * t), Decimal(1), Decimal(1)
        for k in range(2, int(df) - 1, 2):
            term *= cos2 * (k - 1) / k
            total += term
        return float(1 - t / (df + t * t).sqrt() * total)


def test_tails_keep_their_digits(spark):
    cases = [(t, df) for t in (0.5, 1.7, 1.75, 2.0, 3.0, 8.0, 12.5, 40.0) for df in (2, 4, 10, 60, 200, 998, 1000, 1002, 20_000)]
    df = spark.createDataFrame(cases, "t double, df int")
    for r in df.withColumn("p", two_sided_p(F.col("t"), F.col("df"))).collect():
        exact = _exact_tail(r.t, r.df)
        assert r.p == pytest.approx(exact, rel=2e-12, abs=1e-80), (r.t, r.df)
    one = spark.createDataFrame([(t,) for t in (0.3, 1.8, 8.0, 1e3, 1e9)], "t double").withColumn("p", two_sided_p(F.col("t"), F.lit(1)))
    assert all(r.p == pytest.approx(2 / math.pi * math.atan(1 / r.t), rel=1e-12) for r in one.collect())


def test_tails_have_no_step_between_degrees(spark):
    cases = [(t, df) for t in (1.72, 1.74, 8.0, 20.0, 37.0) for df in (*range(996, 1006), 10**6 - 1, 10**6)]
    found = {}
    for r in spark.createDataFrame(cases, "t double, df int").withColumn("p", two_sided_p(F.col("t"), F.col("df"))).collect():
        found[r.t, r.df] = r.p
    for t in (1.72, 1.74, 8.0, 20.0, 37.0):
        steps = [found[t, df] / found[t, df + 1] for df in range(996, 1005)]
        assert all(1 < a < 2 for a in steps) and max(steps) - min(steps) < 0.05
        assert 0 < found[t, 10**6] < found[t, 10**6 - 1] < found[t, 1005]


def test_equal_forecasts_have_no_statistic(spark):
    df = spark.range(50).select(F.lit("s").alias("series_id"), F.col("id").cast("double").alias("y"))
    df = df.withColumn("p", F.col("y") + 1)
    row = dm_by_group(df, ["series_id"], "y", "p", "p").select("*", *verdicts()).first()
    assert (row.dm, row.p, row.sig_196, row.sig_p05, row.model_worse) == (None, None, False, False, None)
    flat = score(df.withColumn("y", F.lit(2.0)), ["series_id"], pred="p").first()
    assert flat.r2 is None and flat.n == 50


def test_leakage_ratio_and_overlap(spark):
    """Published pair of errors and date ranges."""
    rows = []
    for i in range(2015, 2512):
        rows.append(("s", "full_series", "m", i, 100.0, 100.0 + 5.831065202788091))
    for i in range(2016, 2513):
        rows.append(("s", "walk_forward", "m", i, 100.0, 100.0 - 60.65678020719744))
    df = spark.createDataFrame(rows, "series_id string, protocol string, model string, idx int, y double, y_pred double")
    r = leakage_inflation(df).first()
    assert (r.common_dates, r.full_only, r.walk_only) == (496, 1, 1)
    assert r.inflation_ratio == pytest.approx(10.402349844792464, rel=1e-12)


def test_geometric_mean_of_published_ratios():
    ratios = [10.402349844792464, 8.33524686455915, 9.103405160143243]
    assert math.exp(sum(map(math.log, ratios)) / 3) == pytest.approx(math.prod(ratios) ** (1 / 3))


def test_two_fold_skill_against_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 101
    f = rng.normal(size=(n, 3))
    y = f @ [0.5, -1.0, 0.2] + rng.normal(size=n) * 0.5
    rows = [("s", "p", 40 + i, *map(float, f[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, protocol string, idx int, hf double, d_hf double, d_mid double, dx double")
    halves = (np.arange(n // 2), np.arange(n // 2, n))
    fit_sse = sum(
        np.sum((y[b] - np.column_stack([f[b], np.ones(len(b))]) @ np.linalg.lstsq(np.column_stack([f[a], np.ones(len(a))]), y[a], rcond=None)[0]) ** 2)
        for a, b in (halves, halves[::-1])
    )
    got = two_fold_skill(df, block_rows=16).first()
    assert got.n == n and got.skill == pytest.approx(1 - fit_sse / np.sum(y**2), rel=1e-9)
    r = change_correlation(df).first()
    assert r.r == pytest.approx(np.corrcoef(f[:, 0], y)[0, 1], rel=1e-9)
