"""Time-series statistics: stream health, noise, clock offsets, jitter and sampled sizes."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lcg import mixed
from ..session import checkpointed
from .ordered import HOUR_NS, beside, carried, exact_quantiles
from .timejoin import bracket, time_chunk


def stream_stats(
    stamps: DataFrame, keys: Sequence[str], time: str = "t_ns", ties: Sequence[str] = (), chunk_ns: int = HOUR_NS, gap_factor: float = 1.5
) -> DataFrame:
    """Samples, mean rate, median and longest interval, and gaps over 1.5 medians; keys under two stamps vanish."""
    keys = list(keys)
    steps = carried(stamps.select(*keys, time, *ties), keys, [time, *ties], time_chunk(time, chunk_ns), lag={"_prev": time})
    steps = steps.withColumn("_gap", F.col(time) - F.col("_prev")).where("_gap is not null")
    medians = exact_quantiles(steps, keys, "_gap", {"_median": 0.5}, count="_size")
    joined = beside(steps, medians, keys, "_size")
    return joined.groupBy(*keys).agg(
        (F.count("*") + 1).alias("samples"), (1e9 / F.avg("_gap")).alias("rate_hz"),
        (F.first("_median") / 1e6).alias("median_interval_ms"), (F.max("_gap") / 1e6).alias("max_interval_ms"),
        F.count(F.when(F.col("_gap") > gap_factor * F.col("_median"), 1)).alias("gaps_over_1_5x"),
    )


def allan_deviation(
    rows: DataFrame, keys: Sequence[str], ordinal: str, rate: str, dt: float, points: int = 60, chunk: int = 65_536
) -> DataFrame:
    """Overlapping Allan deviation at log-spaced cluster sizes; `ordinal` counts samples from 0.

    Second differences of the integrated angle come from two equi-joins on the ordinal.
    """
    keys = list(keys)
    summed = carried(rows.select(*keys, ordinal, rate), keys, [ordinal], F.floor(F.col(ordinal) / chunk), running={"_sum": rate})
    angle = summed.select(*keys, (F.col(ordinal) + 1).alias("_i"), (F.col("_sum") * dt).alias("_a"))
    start = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("_i"), F.lit(0.0).alias("_a"))
    angle = angle.unionByName(start)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = F.log10(F.greatest(F.expr("_n div 10"), F.lit(1)).cast("double"))
    # the tiny shift keeps exact powers from being cut to the number below
    spaced = F.floor(F.pow(F.lit(10.0), F.col("_p") / (points - 1) * most) + 1e-9)
    sizes = sizes.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        *keys, spaced.cast("long").alias("m")
    ).distinct()
    first = angle.join(sizes, keys)
    once = angle.select(*keys, F.col("_i").alias("_j"), F.col("_a").alias("_b"))
    twice = angle.select(*keys, F.col("_i").alias("_k"), F.col("_a").alias("_c"))
    both = first.withColumns({"_j": F.col("_i") + F.col("m"), "_k": F.col("_i") + 2 * F.col("m")}).join(
        once, [*keys, "_j"]
    ).join(twice, [*keys, "_k"])
    d = F.col("_c") - 2 * F.col("_b") + F.col("_a")
    return both.groupBy(*keys, "m").agg(F.sum(d * d).alias("_ss"), F.count("*").alias("_n")).select(
        *keys, (F.col("m") * dt).alias("tau_s"),
        F.sqrt(F.col("_ss") / (2 * (F.col("m") * dt) * (F.col("m") * dt) * F.col("_n"))).alias("deviation"),
    )


def read_slope_line(curve: DataFrame, keys: Sequence[str], slope: float, tau_read: float, tolerance: float = 0.15) -> DataFrame:
    """Value at `tau_read` of the fixed-slope line through the curve points whose local slope matches it.

    A curve has at most 60 points per key, so the window is small.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("_x")
    rows = curve.where("deviation > 0").select(*keys, F.log("tau_s").alias("_x"), F.log("deviation").alias("_y"))
    rows = rows.withColumns({
        "_x0": F.lag("_x").over(w), "_y0": F.lag("_y").over(w), "_x1": F.lead("_x").over(w), "_y1": F.lead("_y").over(w)
    })
    left, right = (F.col("_y") - F.col("_y0")) / (F.col("_x") - F.col("_x0")), (F.col("_y1") - F.col("_y")) / (F.col("_x1") - F.col("_x"))
    hs, hd = F.col("_x") - F.col("_x0"), F.col("_x1") - F.col("_x")
    local = F.when(F.col("_x0").isNull(), right).when(F.col("_x1").isNull(), left).otherwise((hd * left + hs * right) / (hs + hd))
    on = rows.where(F.abs(local - slope) < tolerance)
    return on.groupBy(*keys).agg(
        F.count("*").alias("points"), F.exp(F.avg(F.col("_y") - slope * F.col("_x")) + slope * F.log(F.lit(tau_read))).alias("_v")
    ).select(*keys, "points", F.when(F.col("points") >= 3, F.col("_v")).alias("value"))


def resampled(grid: DataFrame, signal: DataFrame, keys: Sequence[str], time: str, value: str, chunk_ns: int) -> DataFrame:
    """Linear interpolation at grid times, flat beyond the ends."""
    both = bracket(grid, signal, keys, time, [value], chunk_ns)
    t, t0, t1 = F.col(time), F.col(f"prev.{time}"), F.col(f"next.{time}")
    v0, v1 = F.col(f"prev.{value}"), F.col(f"next.{value}")
    inside = v0 + (v1 - v0) * ((t - t0) / (t1 - t0))
    return both.select(
        *grid.columns, F.when(v1.isNull(), v0).when(v0.isNull() | (t1 == t), v1).otherwise(inside).alias(value)
    )


def lag_moments(a: DataFrame, b: DataFrame, keys: Sequence[str], ordinal: str, max_lag: int, block: int = 4096) -> DataFrame:
    """Pair statistics of a[i] and b[i + lag] for every whole lag up to `max_lag` either way, as (keys, lag, n, sa, sb,
    aa, bb, ab, a_low, a_high, b_low, b_high): counts, sums, sums of products and extremes.

    A block of `a` meets its own stretch of `b`, longer by `max_lag` at both ends, in one group of bounded size that
    scores all lags by vector sums, so rows are never repeated per lag; blocks add up in a small aggregate. A pair with a null or NaN counts in no lag.
    `a` and `b` hold (keys, ordinal, value), each ordinal once.
    """
    keys = list(keys)
    block = max(block, 4 * max_lag)
    names = ["n", "sa", "sb", "aa", "bb", "ab", "a_low", "a_high", "b_low", "b_high"]

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=[*keys, "lag", *names], dtype=object)
        start = int(key[-1]) * block
        x, y = np.full(block, np.nan), np.full(block + 2 * max_lag, np.nan)
        x[left["_at"].to_numpy() - start] = left["_v"].to_numpy(dtype=float)
        y[right["_at"].to_numpy() - start + max_lag] = right["_v"].to_numpy(dtype=float)
        held = np.nonzero(~np.isnan(x))[0]
        first, size = (held[0], held[-1] + 1 - held[0]) if len(held) else (0, 0)
        u, near = x[first: first + size], y[first: first + size + 2 * max_lag]
        if size and len(held) == size and not np.isnan(near).any():
            # nothing is missing: every lag sees the same stretch of `a`
            seen, squares = (np.lib.stride_tricks.sliding_window_view(v, size) for v in (near, near * near))
            return pd.DataFrame({
                **dict(zip(keys, key)), "lag": np.arange(-max_lag, max_lag + 1), "n": float(size), "sa": u.sum(), "sb": seen.sum(1), "aa": u @ u, "bb": squares.sum(1),
                "ab": np.correlate(near, u, "valid"), "a_low": u.min(), "a_high": u.max(), "b_low": seen.min(1), "b_high": seen.max(1),
            })
        out = []
        for lag in range(-max_lag, max_lag + 1):
            z = y[lag + max_lag: lag + max_lag + block]
            both = ~(np.isnan(x) | np.isnan(z))
            u, v = x[both], z[both]
            if len(u):
                out.append((*key[:-1], lag, float(len(u)), u.sum(), v.sum(), u @ u, v @ v, u @ v, u.min(), u.max(), v.min(), v.max()))
        return pd.DataFrame(out, columns=[*keys, "lag", *names]).astype({k: object for k in keys})

    at, value = F.col(ordinal).cast("long"), [c for c in a.columns if c not in (*keys, ordinal)][0]
    left = a.select(*keys, at.alias("_at"), F.col(value).alias("_v"), F.floor(at / block).alias("_block"))
    other = [c for c in b.columns if c not in (*keys, ordinal)][0]
    right = b.select(
        *[F.col(k).alias(f"_{k}") for k in keys], at.alias("_at"), F.col(other).alias("_v"),
        F.explode(F.sequence(F.floor((at - max_lag) / block), F.floor((at + max_lag) / block))).alias("_block"),
    )
    schema = T.StructType([
        *[T.StructField(k, a.schema[k].dataType) for k in keys], T.StructField("lag", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names],
    ])
    parts = left.groupBy(*keys, "_block").cogroup(right.groupBy(*[f"_{k}" for k in keys], "_block")).applyInPandas(score, schema)
    return parts.groupBy(*keys, "lag").agg(
        *[F.sum(c).alias(c) for c in names[:6]], F.min("a_low").alias("a_low"), F.max("a_high").alias("a_high"), F.min("b_low").alias("b_low"), F.max("b_high").alias("b_high"),
    )


def clock_offset(
    reference: DataFrame, moving: DataFrame, keys: Sequence[str], time: str, value: str, step: int, max_steps: int, chunk_ns: int = HOUR_NS
) -> DataFrame:
    """Lag of `moving` behind `reference` by normalised cross-correlation with a parabolic peak.

    Both signals are resampled on one grid of whole steps, so a lag is a shift of the grid index; all lags of a
    block are scored together. A flat reference gives no row, a flat stretch of `moving` the score -1. Sums are of
    deviations from the signal's mean, so a large constant level costs no digits.
    """
    keys = list(keys)
    ends = lambda df, p: df.groupBy(*keys).agg(F.min(time).alias(f"_{p}0"), F.max(time).alias(f"_{p}1"), F.avg(value).alias(f"_{p}m"))
    reach = max_steps * step
    spans = ends(reference, "a").join(ends(moving, "b"), keys).select(
        *keys, F.greatest(F.col("_a0"), F.col("_b0") + reach).alias("_from"), F.least(F.col("_a1"), F.col("_b1") - reach).alias("_to"), "_am", "_bm"
    )
    count = F.ceil((F.col("_to") - F.col("_from")) / step)
    spans = spans.withColumn("_n", count.cast("long")).where("_n >= 3")
    grid = spans.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    wide = spans.withColumn("_i", F.explode(F.sequence(F.lit(-max_steps).cast("long"), F.col("_n") - 1 + max_steps)))
    at = (F.col("_from") + F.col("_i") * step).alias(time)
    a = resampled(grid.select(*keys, "_i", "_am", at), reference, keys, time, value, chunk_ns).select(*keys, "_i", (F.col(value) - F.col("_am")).alias("_a"))
    b = resampled(wide.select(*keys, "_i", "_bm", at), moving, keys, time, value, chunk_ns).select(*keys, "_i", (F.col(value) - F.col("_bm")).alias("_b"))
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    corr = (F.col("ab") - sa * sb / n) / F.sqrt((F.col("aa") - sa * sa / n) * (F.col("bb") - sb * sb / n))
    scored = lag_moments(a, b, keys, "_i", max_steps).where("a_high > a_low").select(
        *keys, "lag", F.when(F.col("b_high") > F.col("b_low"), corr).otherwise(-1.0).alias("score")
    )
    # a key holds 2 max_steps + 1 scores
    w = Window.partitionBy(*keys).orderBy("lag")
    near = scored.withColumns({"_before": F.lag("score").over(w), "_after": F.lead("score").over(w)})
    best = near.groupBy(*keys).agg(F.max_by(F.struct("lag", "score", "_before", "_after"), F.struct(F.col("score"), -F.col("lag"))).alias("_p"))
    bend = F.col("_p._before") - 2 * F.col("_p.score") + F.col("_p._after")
    shift = 0.5 * (F.col("_p._before") - F.col("_p._after")) / F.when(bend != 0, bend)
    return best.select(
        *keys, ((F.col("_p.lag") + F.coalesce(shift, F.lit(0.0))) * step).alias("offset"), F.col("_p.score").alias("peak")
    )


def centred_mean(rows: DataFrame, keys: Sequence[str], ordinal: str, value: str, width: int, chunk: int = 65_536) -> DataFrame:
    """Moving mean over `width` samples, centred as a same-length convolution, zeros beyond the ends."""
    keys = list(keys)
    summed = carried(rows, keys, [ordinal], F.floor(F.col(ordinal) / chunk), running={"_s": value})
    ahead, behind = (width - 1) // 2, width // 2
    ends = summed.groupBy(*keys).agg(F.max(ordinal).alias("_last"), F.max_by("_s", ordinal).alias("_total"))
    upto = summed.select(*keys, F.col(ordinal).alias("_j"), F.col("_s").alias("_hi"))
    past = summed.select(*keys, F.col(ordinal).alias("_k"), F.col("_s").alias("_lo"))
    placed = rows.join(ends, keys).withColumns({"_j": F.least(F.col(ordinal) + ahead, F.col("_last")), "_k": F.col(ordinal) - behind - 1})
    joined = placed.join(upto, [*keys, "_j"]).join(past, [*keys, "_k"], "left")
    return joined.select(*rows.columns, ((F.col("_hi") - F.coalesce("_lo", F.lit(0.0))) / width).alias("mean"))


def windowed_residuals(rows: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], half: int = 5, chunk: int = 4096) -> DataFrame:
    """Each value minus the median of its neighbours within `half` frame indices.

    Chunks of frame indices carry `half` rows of the next and previous chunk with them, so no track
    has to sit in one task.
    """
    keys = list(keys)
    home = F.floor(F.col(index) / chunk)
    touched = F.array_distinct(F.array(home, F.floor((F.col(index) - half) / chunk), F.floor((F.col(index) + half) / chunk)))
    spread = rows.withColumn("_home", home).withColumn("_chunk", F.explode(touched))
    near = Window.partitionBy(*keys, "_chunk").orderBy(index).rangeBetween(-half, half)
    out = spread.withColumns({f"_m_{v}": F.percentile(v, F.lit(0.5)).over(near) for v in values})
    return out.where("_home = _chunk").withColumns({f"{v}_residual": F.col(v) - F.col(f"_m_{v}") for v in values}).drop(
        "_home", "_chunk", *[f"_m_{v}" for v in values]
    )


def track_jitter(rows: DataFrame, keys: Sequence[str], index: str, a: str, b: str, half: int = 5, minimum: int = 5, chunk: int = 4096) -> DataFrame:
    """Per track: spread of residuals to the local median, of consecutive residuals, and lag-1 correlation."""
    keys = list(keys)
    local = windowed_residuals(rows, keys, index, [a, b], half, chunk)
    windowed = local.groupBy(*keys).agg(
        F.count("*").alias("n"), F.stddev_samp(f"{a}_residual").alias("_sx"), F.stddev_samp(f"{b}_residual").alias("_sy"),
        F.sqrt(F.var_pop(f"{a}_residual") + F.var_pop(f"{b}_residual")).alias("_rms"),
    )
    steps = carried(rows, keys, [index], F.floor(F.col(index) / chunk), lag={"_prev": F.struct(index, a, b)})
    steps = steps.where(F.col(index) == F.col(f"_prev.{index}") + 1).select(
        *keys, index, (F.col(a) - F.col(f"_prev.{a}")).alias("_dx"), (F.col(b) - F.col(f"_prev.{b}")).alias("_dy")
    )
    again = carried(steps, keys, [index], F.floor(F.col(index) / chunk), lag={"_dx0": "_dx", "_dy0": "_dy"})
    pairwise = again.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.stddev_samp("_dx").alias("_px"), F.corr("_dx0", "_dx").alias("_lx"), F.stddev_pop("_dx").alias("_flat"),
    )
    enough, paired = F.col("n") >= minimum, F.col("pairs") >= minimum - 1
    return windowed.join(pairwise, keys, "left").select(
        *keys, "n", F.coalesce("pairs", F.lit(0)).alias("pairs"),
        *[F.when(enough, F.col(c)).alias(o) for c, o in (("_sx", "sx"), ("_sy", "sy"), ("_rms", "radial_rms"))],
        F.when(paired, F.col("_px") / sqrt(2)).alias("pair_sx"),
        F.when(paired & (F.col("pairs") >= 3) & (F.col("_flat") > 0), F.col("_lx")).alias("lag1_x"),
    )


def relative_spread(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Sample deviation of a value relative to its key's median."""
    middle = exact_quantiles(rows, keys, value, {"_mid": 0.5}, count="_size")
    return beside(rows, middle, keys, "_size").groupBy(*keys).agg(F.stddev_samp(F.col(value) / F.col("_mid") - 1).alias(name))


def noise_floor(rows: DataFrame, keys: Sequence[str], a: str, b: str, mads: float = 5.0, minimum: int = 30) -> DataFrame:
    """Residual noise without outliers beyond 5 median deviations on either axis; null under `minimum`."""
    keys = list(keys)
    both = lambda df, x, y, p, q: exact_quantiles(df, keys, x, {p: 0.5}, count="_size").join(exact_quantiles(df, keys, y, {q: 0.5}), keys)
    off = beside(rows, both(rows, a, b, "_ma", "_mb"), keys, "_size").withColumns({"_da": F.abs(F.col(a) - F.col("_ma")), "_db": F.abs(F.col(b) - F.col("_mb"))})
    far = lambda d, s: (F.col(s) > 0) & (F.col(d) > mads * F.col(s))
    marked = beside(off, both(off, "_da", "_db", "_sa", "_sb"), keys, "_size").withColumn("_in", ~(far("_da", "_sa") | far("_db", "_sb")))
    mine = lambda c: F.stddev_samp(F.when(F.col("_in"), F.col(c))) / sqrt(2)
    sums = marked.groupBy(*keys).agg(
        F.count(F.when(F.col("_in"), 1)).alias("n"), F.count(F.when(~F.col("_in"), 1)).alias("outliers"), mine(a).alias("_x"), mine(b).alias("_y")
    )
    enough = F.col("n") >= minimum
    return sums.select(*keys, "n", "outliers", F.when(enough, F.col("_x")).alias("sx"), F.when(enough, F.col("_y")).alias("sy"))


def tertile(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds `band` 0-2 by the key's thirds; a value on an inner edge goes up."""
    edges = exact_quantiles(rows, keys, value, {"_e1": 1 / 3, "_e2": 2 / 3}, count="_size")
    joined = beside(rows, edges, keys, "_size") if keys else rows.crossJoin(F.broadcast(checkpointed(edges.drop("_size"))))
    return joined.withColumn("band", (F.col(value) >= F.col("_e1")).cast("int") + (F.col(value) >= F.col("_e2")).cast("int")).drop("_e1", "_e2")


def seeded_choice(rows: DataFrame, keys: Sequence[str], row_id: str, count: int, seeds: Sequence[int]) -> DataFrame:
    """`count` rows per key and seed without replacement: the smallest seeded hashes.

    A hash threshold drops rows that cannot be chosen before any ranking happens.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    tries = rows.join(sizes, keys).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    hashed = tries.withColumn("_h", mixed(F.col(row_id), F.col("seed")))
    limit = 2_147_483_647 * F.least(F.lit(1.0), (2.0 * count + 40) / F.col("_n"))
    order = Window.partitionBy(*keys, "seed").orderBy("_h", row_id)
    near = hashed.where(F.col("_h") <= limit)
    return near.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= count).drop("_h", "_n", "draw")


def sampled_size(rows: DataFrame, keys: Sequence[str], row_id: str, ratio: str, count: int, seeds: Sequence[int]) -> DataFrame:
    """Median ratio of each seeded draw, then the middle, least and greatest over the draws."""
    drawn = seeded_choice(rows, keys, row_id, count, seeds)
    per_seed = drawn.groupBy(*keys, "seed").agg(F.percentile(ratio, F.lit(0.5)).alias("_s"))
    return per_seed.groupBy(*keys).agg(
        F.percentile("_s", F.lit(0.5)).alias("size"), F.min("_s").alias("low"), F.max("_s").alias("high")
    )


def framed_size(rows: DataFrame, run: Sequence[str], frame: Sequence[str], ratio: str) -> DataFrame:
    """Median over frames of per-frame medians, with the 10-90 percent spread of the frames."""
    frames = exact_quantiles(rows, [*run, *frame], ratio, {"_f": 0.5})
    return exact_quantiles(frames, run, "_f", {"frame_size": 0.5, "p10": 0.1, "p90": 0.9}, count="frames")


def causal_median(rows: DataFrame, keys: Sequence[str], index: str, value: str, width: int, chunk: int = 4096) -> DataFrame:
    """Median of the last `width` values, then divided by the run's median of those medians."""
    keys = list(keys)
    home = F.floor(F.col(index) / chunk)
    # rows close before a chunk's start ride along with it
    spread = rows.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.array_distinct(F.array(home, F.floor((F.col(index) + width - 1) / chunk))))
    )
    past = Window.partitionBy(*keys, "_chunk").orderBy(index).rowsBetween(-(width - 1), 0)
    smooth = spread.withColumn("smoothed", F.percentile(value, F.lit(0.5)).over(past)).where("_home = _chunk").drop("_home", "_chunk")
    typical = exact_quantiles(smooth, keys, "smoothed", {"_typical": 0.5}, count="_size")
    return beside(smooth, typical, keys, "_size").withColumn("relative", F.col("smoothed") / F.col("_typical")).drop("_typical")


def stage_timing(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames per second of each stage's successes; frames are null when any success lacks them.

    samples(keys, stage, frames, elapsed_seconds, status).
    """
    done = F.col("status") == "ok"
    return samples.groupBy(*keys, "stage").agg(
        F.count("*").alias("attempts"), F.count(F.when(done, 1)).alias("successes"),
        F.sum(F.when(done, F.col("elapsed_seconds"))).alias("elapsed_seconds"),
        F.sum(F.when(done, F.col("frames"))).alias("_frames"), F.count(F.when(done & F.col("frames").isNull(), 1)).alias("_unknown"),
    ).withColumn("frames", F.when(F.col("_unknown") == 0, F.col("_frames"))).select(
        *keys, "stage", "attempts", "successes", "elapsed_seconds", "frames",
        (F.col("frames") / F.when(F.col("elapsed_seconds") > 0, F.col("elapsed_seconds"))).alias("fps"),
    )


def update_pace(updates: DataFrame, keys: Sequence[str], order: str, finished: str, stages: str, source: str, chunk: int = 4096) -> DataFrame:
    """Updates per second, gaps over 1 s, and how many updates each source sized."""
    keys = list(keys)
    steps = carried(updates, keys, [order], F.floor(F.col(order) / chunk), lag={"_prev": finished})
    gap = F.col(finished) - F.col("_prev")
    return steps.groupBy(*keys).agg(
        F.count("*").alias("updates"), (F.count(gap) / F.sum(gap)).alias("updates_per_s"), F.count(F.when(gap > 1.0, 1)).alias("gaps_over_1s"),
        F.max(gap).alias("longest_gap_s"), F.count(F.when(F.col(source) == "previous", 1)).alias("previous_scale"),
    )


def stage_medians(updates: DataFrame, keys: Sequence[str], stages: str) -> DataFrame:
    """Median milliseconds per stage, from one map of stage times per update."""
    long = updates.select(*keys, F.explode(stages).alias("stage", "ms"))
    return exact_quantiles(long, [*keys, "stage"], "ms", {"median_ms": 0.5}, count="updates")


def repeat_table(runs: DataFrame, settings: Sequence[str], values: Sequence[str], complete: Column) -> DataFrame:
    """Median, least and greatest of each value per setting; incomplete runs are left out."""
    kept = runs.where(complete)
    long = kept.withColumn("_m", F.explode(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values
    ]))).select(*settings, "_m.measure", "_m.value")
    keys = [*settings, "measure"]
    ends = long.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return exact_quantiles(long, keys, "value", {"median": 0.5}, count="runs").join(ends, keys)
