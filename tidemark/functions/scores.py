"""Scores and small geometry as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of what two intervals share, 0 if nothing."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def trapezoid(d: Column, lo: float, best_lo: float, best_hi: float, hi: float) -> Column:
    """1 between the best ends, 0 outside lo and hi, from 0.4 to 1 on the slopes."""
    return (
        F.when((d < lo) | (d > hi), 0.0)
        .when((d >= best_lo) & (d <= best_hi), 1.0)
        .when(d < best_lo, 0.4 + 0.6 * (d - lo) / (best_lo - lo))
        .otherwise(0.4 + 0.6 * (hi - d) / (hi - best_hi))
    )


def fit(ratio: Column, lo: float, hi: float, slope: float = 0.55) -> Column:
    """1 within the dead band, falling to 0 over `slope` outside it."""
    return F.when(ratio.between(lo, hi), 1.0).when(ratio < lo, F.greatest(F.lit(0.0), 1 - (lo - ratio) / slope)).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - hi) / slope))


def alpha(t: Column, t_in: Column, d_in: Column, t_out: Column, d_out: Column) -> Column:
    """Opacity at t of a card that fades in from t_in and out from t_out."""
    return F.when((t < t_in) | (t > t_out + d_out), 0.0).when(t < t_in + d_in, (t - t_in) / d_in).when(t > t_out, 1 - (t - t_out) / d_out).otherwise(1.0)


def boxes_overlap(a: Column, b: Column) -> Column:
    """Whether two boxes (x, y, w, h) share an area."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def box_union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"), (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"))


def nearest_rank(values: Column, p: float) -> Column:
    """The level at rank int(p * n), at most the last, of an array: neither a discrete nor an interpolated percentile."""
    return F.get(F.array_sort(values), F.least(F.size(values) - 1, F.floor(F.lit(p) * F.size(values)).cast("int")))
