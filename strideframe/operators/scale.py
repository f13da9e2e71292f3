"""Depth targets and the scale fits that size a learned depth map."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import checkpointed
from .ordered import carried, exact_quantiles, value_slices

FRAME = ("recording", "frame")
CELLS_X, CELLS_Y = 8, 6
MAX_SLOPE, MIN_LOG_SPAN, PAIRED_POINTS = 0.5, float(np.log(1.5)), 300
MAD_LIMIT = 3 * 1.4826


def target_weight(metres: Column, sigma_m: Column, learned_log_sigma: float = 0.05) -> Column:
    share = sigma_m / metres
    return 1 / (learned_log_sigma**2 + share * share)


def depth_targets(
    pixels: DataFrame, depth: str, raw: Sequence[Column], colour: Sequence[Column], width: int, height: int,
    min_confidence: int = 128,
) -> DataFrame:
    """Confident measured depth at the colour image's pixels: adds u, v."""
    kept = pixels.where((F.col(depth) > 0) & (F.col("confidence") >= min_confidence))
    u = colour[2] + colour[0] * (F.col("pcol") - raw[2]) / raw[0]
    v = colour[3] + colour[1] * (F.col("prow") - raw[3]) / raw[1]
    return kept.withColumns({"u": u, "v": v}).where(
        (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)
    )


def point_targets(rows: DataFrame) -> DataFrame:
    """Camera-plane metres of world points x, y, z ahead of `pose`; rows without a pose vanish."""
    metres = g.into_camera(F.col("pose"), g.columns("x", "y", "z"))[2]
    return rows.where("pose is not null").withColumn("metres", metres).where("metres > 0")


def is_fresh(depth_t_ns: Column, camera_t_ns: Column, max_age_s: float = 0.1) -> Column:
    return camera_t_ns - depth_t_ns <= max_age_s * 1e9


def usable(rows: DataFrame, learned: str = "learned", target: str = "target") -> DataFrame:
    """Positive, finite depth pairs."""
    ok = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c)
    return rows.where(ok(learned) & ok(target))


def median_ratio(rows: DataFrame, keys: Sequence[str] = FRAME, minimum: int = 2) -> DataFrame:
    """Median of target / learned per key; null with fewer than `minimum` pairs."""
    ratios = usable(rows).withColumn("_ratio", F.col("target") / F.col("learned"))
    fitted = exact_quantiles(ratios, keys, "_ratio", {"scale": 0.5}, count="pairs")
    return fitted.withColumn("scale", F.when(F.col("pairs") >= max(minimum, 2), F.col("scale")))


def first_source(targets: DataFrame, frames: DataFrame, minimum: Mapping[str, int], chunk: int = 4096) -> DataFrame:
    """Per frame the first source, in the mapping's order, that has enough targets; else the last size."""
    order = {name: i for i, name in enumerate(minimum)}
    fits = median_ratio(targets, [*FRAME, "source"])
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("source")]
    enough = fits.where(F.col("pairs") >= table(minimum)).withColumn("_order", table(order))
    best = enough.groupBy(*FRAME).agg(F.min_by(F.struct("source", "scale"), "_order").alias("_best"))
    rows = frames.join(best, list(FRAME), "left").select(*FRAME, "_best.source", "_best.scale")
    rows = carried(rows, ["recording"], ["frame"], F.floor(F.col("frame") / chunk), before={"_carried": "scale"})
    return rows.select(
        *FRAME,
        F.when(F.col("source").isNotNull(), F.col("source"))
        .when(F.col("_carried").isNotNull(), "previous").otherwise("none").alias("source"),
        F.col("_carried").alias("scale"),
    )


def supported_pixels(
    pixels: DataFrame, height: int, width: int, minimum: int = 20, targets: DataFrame | None = None
) -> DataFrame:
    """Pixels of grid cells that hold at least `minimum` targets."""
    cell = g.cell_of(F.col("prow"), F.col("pcol"), height, width, CELLS_Y, CELLS_X)
    counted = (targets if targets is not None else pixels).groupBy(*FRAME, cell.alias("cell")).agg(F.count("*").alias("_n"))
    return pixels.withColumn("cell", cell).join(
        counted.where(F.col("_n") >= minimum).select(*FRAME, "cell"), [*FRAME, "cell"], "left_semi"
    )


def weighted_median(rows: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """First sorted value whose running weight reaches half of the key's total weight."""
    merged = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    total = merged.groupBy(*keys).agg((0.5 * F.sum("_w")).alias("_half"))
    running = carried(
        value_slices(merged, keys, value), keys, [value], F.col("_slice"), running={"_upto": "_w"}
    )
    return running.join(total, list(keys)).where(F.col("_upto") >= F.col("_half")).groupBy(*keys).agg(
        F.min(value).alias("weighted_median")
    )


def grid_scale(
    pixels: DataFrame, height: int, width: int, minimum: int = 50, min_cell: int = 20,
    fallback: DataFrame | None = None, log: Callable[[Column], Column] = F.log, exp: Callable[[Column], Column] = F.exp,
) -> DataFrame:
    """Per-pixel scale blended between the cell medians of the log ratio.

    A frame's 48 cell values travel as one small array, so a pixel needs one join for its four cells.
    `fallback` holds keys and a log scale used instead of the frame median in unsupported cells. `log` and `exp` are
    those of `libm` where later steps compare depths that may lie just on an edge.
    """
    cell = g.cell_of(F.col("prow"), F.col("pcol"), height, width, CELLS_Y, CELLS_X)
    # a frame's pixels, bounded by its image, meet once for the medians of the frame and of its cells
    ratios = usable(pixels).select(*FRAME, cell.alias("_cell"), (F.col("target") / F.col("learned")).alias("_ratio")).repartition(*FRAME)
    logs = ratios.withColumn("_log", log(F.col("_ratio")))
    known = F.when(F.col("_log").isNotNull(), F.col("_cell"))  # keeps the cell where only the frame counts, so that both read one shuffle
    middle = lambda keys, name, size: logs.groupBy(*keys).agg(F.count(known).alias(size), F.percentile("_log", F.lit(0.5)).alias(name))
    frame = middle(FRAME, "_frame", "_pairs").where(F.col("_pairs") >= minimum)
    if fallback is not None:
        frame = frame.join(fallback.select(*FRAME, F.col("log_scale").alias("_given")), list(FRAME), "left")
        frame = frame.withColumn("_frame", F.coalesce("_given", "_frame")).drop("_given")
    cells = middle([*FRAME, "_cell"], "_value", "_n").where(F.col("_n") >= min_cell)
    held = cells.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_value"))).alias("_held"))
    grid = frame.join(held, list(FRAME), "left").select(
        *FRAME,
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(CELLS_X * CELLS_Y - 1).cast("long")),
            lambda i: F.coalesce(F.col("_held")[i], F.col("_frame")),
        ).alias("_grid"),
    )
    rows = pixels.join(grid, list(FRAME))
    at_x = g.clamp((F.col("pcol") + 0.5) * CELLS_X / width - 0.5, 0.0, CELLS_X - 1.0)
    at_y = g.clamp((F.col("prow") + 0.5) * CELLS_Y / height - 0.5, 0.0, CELLS_Y - 1.0)
    rows = rows.withColumns({"_ax": at_x, "_ay": at_y}).withColumns({
        "_x0": F.floor("_ax").cast("int"), "_y0": F.floor("_ay").cast("int"),
    })
    wx, wy = F.col("_ax") - F.col("_x0"), F.col("_ay") - F.col("_y0")
    x1, y1 = F.least(F.col("_x0") + 1, F.lit(CELLS_X - 1)), F.least(F.col("_y0") + 1, F.lit(CELLS_Y - 1))
    value = lambda y, x: F.get("_grid", y * CELLS_X + x)
    top = (1 - wx) * value(F.col("_y0"), F.col("_x0")) + wx * value(F.col("_y0"), x1)
    low = (1 - wx) * value(y1, F.col("_x0")) + wx * value(y1, x1)
    return rows.withColumn("scale", exp((1 - wy) * top + wy * low)).drop(
        "_grid", "_ax", "_ay", "_x0", "_y0"
    )


def _robust_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Theil-Sen line of each frame's at most 300 sampled points."""
    for batch in frames:
        slopes, levels = [], []
        for xs, ys in zip(batch["_xs"], batch["_ys"]):
            x, y = np.asarray(xs, float), np.asarray(ys, float)
            if np.ptp(x) < 1e-9:
                slopes.append(0.0)
                levels.append(np.nan)
                continue
            first, second = np.triu_indices(len(x), 1)  # each pair once; its slope has no direction
            dx, dy = x[first] - x[second], y[first] - y[second]
            slope = float(np.median(dy[dx != 0] / dx[dx != 0]))
            slopes.append(slope)
            levels.append(float(np.median(y) - slope * np.median(x)))
        yield batch[["recording", "frame"]].assign(_slope=slopes, _level=levels)


def power_fit(
    rows: DataFrame, order: str, chunk: Column, weight: str | None = None, minimum: int = 20
) -> DataFrame:
    """Per frame: log scale `level` + `slope` x log learned, fitted to targets near a robust line.

    Only the stride sample (at most 300 points) of a frame is gathered; residuals, medians and the
    weighted line run on rows. Pixels beyond the inliers take the scale at `low` or `high`.
    """
    points = usable(rows).select(
        *FRAME, F.col(order).alias("_order"), chunk.alias("_part"), F.log("learned").alias("_x"),
        (F.log("target") - F.log("learned")).alias("_y"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"),
    )
    numbered = carried(points, FRAME, ["_order"], F.col("_part"), running={"_i": F.lit(1).cast("long")})
    sizes = points.groupBy(*FRAME).agg(F.count("*").alias("targets")).where(F.col("targets") >= minimum)
    numbered = numbered.join(sizes, list(FRAME))
    stride = F.greatest(F.ceil(F.col("targets") / PAIRED_POINTS), F.lit(1))
    sampled = numbered.where((F.col("_i") - 1) % stride == 0).groupBy(*FRAME).agg(
        F.collect_list("_x").alias("_xs"), F.collect_list("_y").alias("_ys")
    )
    lines = sampled.mapInPandas(_robust_lines, "recording long, frame long, _slope double, _level double")
    flat = exact_quantiles(points, FRAME, "_y", {"_flat": 0.5})
    lines = lines.join(flat, list(FRAME)).select(
        *FRAME, "_slope", F.when(F.isnan("_level"), F.col("_flat")).otherwise(F.col("_level")).alias("_level")
    )
    left = checkpointed(numbered.join(lines, list(FRAME)).select(
        *FRAME, "_x", "_y", "_w", "targets", (F.col("_y") - (F.col("_level") + F.col("_slope") * F.col("_x"))).alias("_r")
    ))
    middle = exact_quantiles(left, FRAME, "_r", {"_mid": 0.5})
    left = left.join(middle, list(FRAME)).withColumn("_spread", F.abs(F.col("_r") - F.col("_mid")))
    reach = exact_quantiles(left, FRAME, "_spread", {"_reach": 0.5})
    inliers = left.join(reach, list(FRAME)).where(F.col("_spread") <= MAD_LIMIT * F.col("_reach") + 1e-12)
    w, x, y = F.col("_w"), F.col("_x"), F.col("_y")
    sums = inliers.groupBy(*FRAME).agg(
        F.first("targets").alias("targets"), F.count("*").alias("inliers"), F.min("_x").alias("low"),
        F.max("_x").alias("high"), F.sum(w).alias("_sw"), F.sum(w * x).alias("_sx"), F.sum(w * y).alias("_sy"),
        F.sum(w * x * x).alias("_sxx"), F.sum(w * x * y).alias("_sxy"),
    )
    centre, mean = F.col("_sx") / F.col("_sw"), F.col("_sy") / F.col("_sw")
    spread = F.col("_sxx") / F.col("_sw") - centre * centre
    raw = (F.col("_sxy") / F.col("_sw") - centre * mean) / F.when(spread != 0, spread)
    slope = F.when(F.col("high") - F.col("low") >= MIN_LOG_SPAN, g.clamp(raw, -MAX_SLOPE, MAX_SLOPE)).otherwise(F.lit(0.0))
    return sums.withColumn("slope", slope).select(
        *FRAME, "targets", "inliers", "slope", (mean - F.col("slope") * centre).alias("level"), "low", "high"
    )


def apply_power(pixels: DataFrame, fits: DataFrame) -> DataFrame:
    clipped = F.least(F.greatest(F.log("learned"), F.col("low")), F.col("high"))
    return pixels.join(fits, list(FRAME)).withColumn("scale", F.exp(F.col("level") + F.col("slope") * clipped))


def line_fit(rows: DataFrame, keys: Sequence[str], source: Column, target: Column, through_zero: bool = False) -> DataFrame:
    """Least-squares factor and shift from `source` to `target` per key; null under two pairs."""
    pairs = rows.select(*keys, source.alias("_s"), target.alias("_t"))
    if through_zero:
        sums = pairs.groupBy(*keys).agg(
            F.count("*").alias("pairs"), (F.sum(F.col("_s") * F.col("_t")) / F.sum(F.col("_s") * F.col("_s"))).alias("factor")
        ).withColumn("shift", F.lit(0.0))
    else:
        sums = pairs.groupBy(*keys).agg(
            F.count("*").alias("pairs"), F.regr_slope("_t", "_s").alias("factor"), F.regr_intercept("_t", "_s").alias("shift")
        )
    enough = F.col("pairs") >= 2
    return sums.select(
        *keys, "pairs", F.when(enough, F.col("factor")).alias("factor"), F.when(enough, F.col("shift")).alias("shift")
    )


NATIVE = {
    "metric": (lambda m: m, lambda m: m),
    "inverse": (lambda m: 1 / m, lambda m: 1 / m),
    "log": (F.log, F.exp),
}


def native_fit(rows: DataFrame, keys: Sequence[str], space: str, through_zero: bool = False) -> DataFrame:
    """Scale and shift in the prediction's own space: metres, inverse metres or log metres."""
    forward, _ = NATIVE[space]
    return line_fit(usable(rows), keys, F.col("learned"), forward(F.col("target")), through_zero)


def native_metres(space: str, value: Column, factor: Column, shift: Column) -> Column:
    _, back = NATIVE[space]
    return back(factor * value + shift)


def trimmed_fit(rows: DataFrame, keys: Sequence[str], drop_fraction: float = 0.1) -> DataFrame:
    """Line fit refitted without the largest residuals of a first fit."""
    pairs = usable(rows)
    first = line_fit(pairs, keys, F.col("learned"), F.col("target"))
    left = pairs.join(first.select(*keys, "factor", "shift"), list(keys)).withColumn(
        "_r", F.abs(F.col("factor") * F.col("learned") + F.col("shift") - F.col("target"))
    )
    limit = exact_quantiles(left, keys, "_r", {"_limit": 1 - drop_fraction})
    kept = left.join(limit, list(keys)).where(
        F.col("_r") <= F.col("_limit") * (1 + 1e-12)  # the limit may be a residual itself
    ).drop("factor", "shift")
    return line_fit(kept, keys, F.col("learned"), F.col("target"))


def inverse_variance(rows: DataFrame, keys: Sequence[str], value: str, sigma: str) -> DataFrame:
    weight = 1 / (F.col(sigma) * F.col(sigma))
    return rows.groupBy(*keys).agg(
        (F.sum(F.col(value) * weight) / F.sum(weight)).alias("depth_m"), (1 / F.sqrt(F.sum(weight))).alias("sigma_m"),
        F.count("*").alias("measures"),
    )


def fallback_scale(
    tracked: DataFrame, measured: DataFrame, height: int, width: int, minimum: int = 5, min_cell: int = 20,
    keys: Sequence[str] = FRAME,
) -> DataFrame:
    """Median log size of tracked points in cells the measured depth does not support."""
    cell = g.cell_of(F.col("prow"), F.col("pcol"), height, width, CELLS_Y, CELLS_X)
    filled = measured.groupBy(*FRAME, cell.alias("cell")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_cell)
    lone = usable(tracked).withColumn("cell", cell).join(filled, [*FRAME, "cell"], "left_anti")
    logs = lone.withColumn("_log", F.log(F.col("target") / F.col("learned")))
    return exact_quantiles(logs, keys, "_log", {"log_scale": 0.5}, count="points").where(F.col("points") >= minimum)


def far_only(learned: Column, near: Column, far: Column, from_m: float = 2.5) -> Column:
    """The far size only where depth at the near size reaches `from_m`."""
    return F.when(learned * near >= from_m, far).otherwise(near)


def anchored_scale(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consistent scales times the run's median metric / consistent ratio over measured frames."""
    measured = rows.where(~F.col("interpolated")).withColumn("_ratio", F.col("metric") / F.col("consistent"))
    anchor = exact_quantiles(measured, keys, "_ratio", {"anchor": 0.5})
    return rows.join(anchor, list(keys), "left").withColumn("scale", F.col("consistent") * F.col("anchor"))
