"""Blocked operators against brute force, with blocks small enough that every edge is hit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from tidewatch.operators.baselines import benchmark_forecasts
from tidewatch.operators.blocks import index_rows, running, with_totals
from tidewatch.operators.centred import decompose_centred
from tidewatch.operators.forecast import assemble, assembly_gaps, bias_corrected, complete, component_forecasts
from tidewatch.operators.prepare import history_summary, origin_tail, sliding_windows
from tidewatch.operators.protocols import full_series_windows, walk_forward_windows
from tidewatch.operators.quality import recover_index, zero_crossings
from tidewatch.operators.scoring import dm_by_group_h
from tidewatch.operators.sift import linear_envelopes, sift_decompose

LENGTHS = (150, 61, 97)
BLOCK = 13


@pytest.fixture(scope="module")
def data(spark):
    df, pdf = brute.make_series(spark, LENGTHS)
    return df.cache(), {s: g.sort_values("idx")["x"].to_numpy() for s, g in pdf.groupby("series_id")}


def split(n):
    return 30 + int(0.8 * (n - 30))


def table(df, column):
    return {(r["series_id"], r["idx"]): r[column] for r in df.select("series_id", "idx", column).collect()}


def test_running_and_totals(data):
    df, xs = data
    out = running(df, {"s": ("sum", "x"), "lo": ("min", "x"), "hi": ("max", "x")}, block_rows=BLOCK)
    for r in out.collect():
        seen = xs[r.series_id][: r.idx + 1]
        assert (r.s, r.lo, r.hi) == (seen.sum(), seen.min(), seen.max())
    for r in with_totals(df, [F.sum("x").alias("total")], block_rows=BLOCK).collect():
        assert r.total == xs[r.series_id].sum()


def test_index_spans_buckets(spark):
    rows = [("a", i * 3) for i in range(200)] + [("b", i) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, k int").withColumn("day", F.date_add(F.lit("2001-05-17"), F.col("k")))
    out = index_rows(df.withColumn("v", F.col("k").cast("double")), ["symbol"], "day", ["v"], days_per_bucket=11)
    for r in out.collect():
        step = 3 if r.symbol == "a" else 1
        assert r.idx == r.k // step and r.n == (200 if r.symbol == "a" else 5)
        assert r.v_run == step * r.idx * (r.idx + 1) / 2


def test_windows_and_histories(data):
    df, xs = data
    for r in sliding_windows(df, block_rows=BLOCK).collect():
        assert r.w == list(xs[r.series_id][r.idx - 30 : r.idx]) and r.y == xs[r.series_id][r.idx]
    for r in history_summary(df, block_rows=BLOCK).collect():
        past = xs[r.series_id][: r.origin]
        assert (r.hist_rows, r.hist_sum, r.hist_min, r.hist_max) == (len(past), past.sum(), past.min(), past.max())
    tail = origin_tail(df, 30).collect()
    assert len(tail) == 30 * sum(n - split(n) for n in LENGTHS)
    assert all(r.x == xs[r.series_id][r.idx] and r.idx == r.origin - 30 + r.pos for r in tail)


@pytest.mark.parametrize("span", [2, 10, 60])
def test_benchmarks(data, span):
    df, xs = data
    out = benchmark_forecasts(df, span=span, block_rows=BLOCK).collect()
    assert len(out) == sum(n - split(n) for n in LENGTHS)
    for s, x in xs.items():
        te = split(len(x))
        smooth = brute.ewma(x, te, span)
        rows = sorted((r for r in out if r.series_id == s), key=lambda r: r.idx)
        for j, r in enumerate(rows):
            t = te + j
            assert r.persistence == x[t - 1]
            assert r.drift == pytest.approx(x[t - 1] + (x[te - 1] - x[0]) / (te - 1))
            assert r.ma5 == pytest.approx(x[t - 5 : t].mean()) and r.ma20 == pytest.approx(x[t - 20 : t].mean())
            assert r[f"ewma{span}"] == pytest.approx(smooth[j], rel=1e-12)


@pytest.mark.parametrize("block_rows", [7, 64, 1024])
def test_smoothing_forgets_nothing(spark, block_rows):
    """A first value of 1e15 fades as in the recursion, far beyond any fixed memory, whatever the block."""
    n, te = 900, 60
    x = np.array([100.0 + (k * 7919) % 13 for k in range(n)])
    x[te - 1] = 1e15
    rows = [("a", k, float(v), n, te) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, idx int, x double, n int, train_end int")
    got = {r.idx: r.ewma10 for r in benchmark_forecasts(df, block_rows=block_rows).collect()}
    smooth = brute.ewma(x, te)
    assert len(got) == n - te
    assert all(got[te + j] == pytest.approx(v, rel=1e-11) for j, v in enumerate(smooth))


def test_centred_components_sum_to_the_series(data):
    df, xs = data
    out = decompose_centred(df, block_rows=BLOCK).collect()
    for s, x in xs.items():
        expected = brute.centred(x)
        for r in (r for r in out if r.series_id == s):
            got = [r[f"c{j}"] for j in range(6)]
            assert got == pytest.approx(list(expected[r.idx]), abs=1e-9)
            assert sum(got) == pytest.approx(x[r.idx], abs=1e-9)


def test_full_series_windows(data):
    df, xs = data
    out = full_series_windows(df, trim_newest=1, block_rows=BLOCK).collect()
    decomposed = {s: brute.centred(x[:-1]) for s, x in xs.items()}
    assert len(out) == 6 * sum(n - 31 for n in LENGTHS)
    for r in out:
        c = decomposed[r.series_id][:, r.comp]
        assert r.w == pytest.approx(list(c[r.idx - 30 : r.idx]), abs=1e-9) and r.y == pytest.approx(c[r.idx], abs=1e-9)
        assert r.split == ("train" if r.idx < split(len(xs[r.series_id])) - 1 else "test")


@pytest.mark.parametrize("faulty", [False, True])
def test_walk_forward_windows(data, faulty):
    df, xs = data
    out = walk_forward_windows(df, trim_end_to_even=faulty, block_rows=BLOCK).collect()
    assert len(out) == 6 * sum(n - 30 for n in LENGTHS)
    for s, x in xs.items():
        te = split(len(x))
        early = brute.centred(x[:te])
        for r in (r for r in out if r.series_id == s):
            t = r.idx
            if t < te:
                c = early[:, r.comp]
                assert r.w == pytest.approx(list(c[t - 30 : t]), abs=1e-9) and r.y == pytest.approx(c[t], abs=1e-9)
            else:
                end, last = (t - t % 2, t + 1 - (t + 1) % 2) if faulty else (t, t + 1)
                assert r.w == pytest.approx(list(brute.centred(x[:end])[-30:, r.comp]), abs=1e-9)
                assert r.y == pytest.approx(brute.centred(x[:last])[-1, r.comp], abs=1e-9)


def test_walk_forward_is_causal_and_full_series_is_not(spark, data):
    df, _ = data
    cut = 130
    moved = df.withColumn("x", F.when(F.col("idx") >= cut, F.col("x") + 500).otherwise(F.col("x")))

    def windows(rows, build):
        found = build(rows.where("series_id = 's0'"), block_rows=BLOCK).where("split = 'test'")
        return {(r.comp, r.idx): r.w for r in found.collect()}

    before, after = windows(df, walk_forward_windows), windows(moved, walk_forward_windows)
    assert all(before[k] == pytest.approx(after[k], abs=1e-9) for k in before if k[1] <= cut)
    assert any(before[k] != pytest.approx(after[k], abs=1e-9) for k in before if k[1] > cut)
    before, after = windows(df, full_series_windows), windows(moved, full_series_windows)
    assert any(before[k] != pytest.approx(after[k], abs=1e-9) for k in before if k[1] <= cut)


def test_envelopes_carry_across_blocks(spark):
    x = np.concatenate([np.arange(40.0), 40 - np.arange(40.0), np.sin(np.arange(60)) * 30, np.linspace(0, 9, 50)])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, idx int, x double")
    up, low = brute.envelopes(x)
    for r in linear_envelopes(df, block_rows=7).collect():
        assert r.upper == pytest.approx(up[r.idx], abs=1e-9) and r.lower == pytest.approx(low[r.idx], abs=1e-9)


def test_sift_decompose(data):
    df, xs = data
    out = sift_decompose(df, levels=2, passes=2, block_rows=BLOCK).collect()
    for s, x in xs.items():
        rest, comps = x, []
        for _ in range(2):
            h = rest
            for _ in range(2):
                up, low = brute.envelopes(h)
                h = h - (up + low) / 2
            comps.append(h)
            rest = rest - h
        for r in (r for r in out if r.series_id == s):
            assert [r.c0, r.c1, r.c2] == pytest.approx([comps[0][r.idx], comps[1][r.idx], rest[r.idx]], abs=1e-7)


@pytest.mark.parametrize("h", [1, 2, 4])
def test_dm_with_lags(data, h):
    df, xs = data
    wide = benchmark_forecasts(df).cache()
    got = {r.series_id: r.dm for r in dm_by_group_h(wide, ["series_id"], "y", "ma5", "persistence", h, block_rows=5).collect()}
    for s, x in xs.items():
        te = split(len(x))
        ma = np.array([x[t - 5 : t].mean() for t in range(te, len(x))])
        assert got[s] == pytest.approx(brute.dm(x[te:], ma, x[te - 1 : -1], h), rel=1e-9)


def test_zero_crossings(data):
    df, xs = data
    got = zero_crossings(decompose_centred(df, block_rows=BLOCK), 6, BLOCK).collect()
    for r in got:
        c = brute.centred(xs[r.series_id])[:, r.comp]
        assert r.crossings == int(np.sum(np.diff(np.sign(c - c.mean())) != 0))


def test_linear_forecasts(data):
    df, xs = data
    parts = component_forecasts(walk_forward_windows(df, block_rows=BLOCK), block_rows=BLOCK).cache()
    rows = {(r.series_id, r.comp, r.model, r.idx): r for r in parts.collect()}
    x = xs["s0"]
    te = split(len(x))
    early = brute.centred(x[:te])
    for comp in (0, 3, 5):
        c = early[:, comp]
        t = np.arange(30, te)
        f = np.column_stack([c[t - 2] - c[t - 1], c[t - 3] - c[t - 1], np.ones(len(t))])
        coef, *_ = np.linalg.lstsq(f, c[t] - c[t - 1], rcond=None)
        for i in (te, te + 3):
            tail = brute.centred(x[:i])[:, comp]
            expected = tail[-1] + coef @ [tail[-2] - tail[-1], tail[-3] - tail[-1], 1.0]
            assert rows[("s0", comp, "lag2", i)].p == pytest.approx(expected, abs=1e-6)
    whole = complete(assemble(parts, 6)).cache()
    assert whole.count() == 2 * sum(n - 30 for n in LENGTHS)
    lacking = assemble(parts.where("not (comp = 2 and series_id = 's1')"), 6)
    assert complete(lacking).where("series_id = 's1'").count() == 0
    assert {(r.series_id, r.n_incomplete == r.n_rows, r.fewest_parts) for r in assembly_gaps(lacking).collect()} == {("s0", False, 6), ("s1", True, 5), ("s2", False, 6)}
    fixed = bias_corrected(whole, block_rows=BLOCK).where("series_id = 's0' and model = 'lag1'").collect()
    train = sorted((r for r in whole.where("series_id = 's0' and model = 'lag1' and split = 'train'").collect()), key=lambda r: r.idx)
    k = max(10, int(0.1 * len(train)))
    a, b = np.polyfit([r.y_pred for r in train[-k:]], [r.y for r in train[-k:]], 1)
    assert all(r.y_corrected == pytest.approx(a * r.y_pred + b, rel=1e-9) for r in fixed)


def test_recover_index_with_repeated_values(spark):
    x = [5.0] * 40 + [1.0, 2.0, 3.0] + [5.0] * 40
    series = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "series_id string, idx int, x double")
    run = [("a", "p", j, v) for j, v in enumerate(x[35:48])] + [("a", "q", j, 7.0) for j in range(4)]
    lost = spark.createDataFrame(run, "series_id string, protocol string, row int, y double")
    got = recover_index(lost, series, ["series_id", "protocol"], block_rows=9).collect()
    assert [(r.protocol, r.n, r.first_index, r.last_index) for r in got] == [("p", 13, 35, 47)]


def test_recover_index_of_a_thousand_runs(spark):
    """Runs of many lengths in one series, overlapping, some repeated in it, some altered in one value."""
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.integers(0, 10**6, n).astype(float)
    x[2000:2100] = x[100:200]  # a stretch that occurs twice
    x[2500:2560] = 7.0
    series = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, idx int, x double")
    rows, want = [], []
    for k in range(1000):
        m = int(rng.integers(1, 90))
        s = int(rng.integers(0, n - m))
        y = x[s : s + m].copy()
        if k % 10 == 0:
            y[m // 2] += 0.5
        rows += [("a", f"r{k}", j, float(v)) for j, v in enumerate(y)]
        places = np.lib.stride_tricks.sliding_window_view(x, m)
        want += [(f"r{k}", m, int(p), int(p) + m - 1) for p in np.flatnonzero((places == y).all(1))]
    targets = spark.createDataFrame(rows, "series_id string, run string, row int, y double")
    got = recover_index(targets, series, ["series_id", "run"], block_rows=64)
    assert sorted(map(tuple, got.drop("series_id").collect())) == sorted(want)
