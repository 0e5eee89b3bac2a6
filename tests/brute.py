"""Plain NumPy counterparts used to check the Spark operators on small inputs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

WINDOW = 30
HALF_WIDTHS = (1, 2, 4, 8, 16)


def make_series(spark, lengths, seed=0, start=1000.0):
    """Integer-valued random walks, so sums are exact."""
    rng = np.random.default_rng(seed)
    frames = []
    for k, n in enumerate(lengths):
        frames.append(
            pd.DataFrame(
                {
                    "series_id": f"s{k}",
                    "idx": np.arange(n, dtype=np.int32),
                    "x": start + np.cumsum(rng.integers(-9, 10, n)).astype(float),
                    "n": np.int32(n),
                    "train_end": np.int32(WINDOW + math.floor(0.8 * (n - WINDOW))),
                }
            )
        )
    pdf = pd.concat(frames)
    return spark.createDataFrame(pdf), pdf


def centred(x, half_widths=HALF_WIDTHS):
    levels = [x]
    for h in half_widths:
        levels.append(np.array([x[max(0, i - h) : i + h + 1].mean() for i in range(len(x))]))
    return np.column_stack([*[a - b for a, b in zip(levels, levels[1:])], levels[-1]])


def envelopes(h):
    def one(points):
        if len(points) < 4:
            return np.full(len(h), h.mean())
        return np.interp(np.arange(len(h)), points, h[points])

    inner = range(1, len(h) - 1)
    top = [i for i in inner if h[i - 1] < h[i] > h[i + 1]]
    low = [i for i in inner if h[i - 1] > h[i] < h[i + 1]]
    return one(top), one(low)


def ewma(x, start, span=10):
    a = 2.0 / (span + 1.0)
    level = x[max(0, start - span) : start].mean()
    out = []
    for t in range(start, len(x)):
        level = a * x[t - 1] + (1 - a) * level
        out.append(level)
    return np.array(out)


def dm(y, a, b, h=1):
    d = (y - a) ** 2 - (y - b) ** 2
    t, m = len(d), d.mean()
    gamma = [np.mean((d[k:] - m) * (d[: t - k] - m)) for k in range(h)]
    v = (gamma[0] + 2 * sum(gamma[1:])) / t
    return m / math.sqrt(v) * math.sqrt((t + 1 - 2 * h + h * (h - 1) / t) / t)


def t_two_sided(t, df, steps=400_001):
    """Student-t tail by the trapezoid rule on the angle."""
    theta = np.linspace(0.0, math.atan(abs(t) / math.sqrt(df)), steps)
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    f = np.exp(log_c + (df - 1) * np.log(np.cos(theta)))
    return 1 - 2 * np.trapezoid(f, theta)
