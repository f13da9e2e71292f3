"""Joins between frames, keyframes, features and reference depth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.pin import pinned
from .ordered import carried, exact_quantiles
from .pixels import project_into, world_points

FRAME = ("recording", "frame")
BLOCK = 512


def keyframe_references(
    frames: DataFrame, is_keyframe: Column, window: int = 8, count: int = 3, baseline_m: float | None = None,
    nearest: float = 0.05, farthest: float = 1.0, max_angle_deg: float = 30.0, chunk: int = 4096,
) -> DataFrame:
    """Usable keyframes before each frame: newest first, or nearest a wanted baseline first.

    The window is eight keyframe ordinals, so every frame meets at most eight rows through an equi-join.
    """
    marked = frames.withColumn("_key", F.when(is_keyframe, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    counted = carried(
        marked, ["recording"], ["seq"], F.floor(F.col("seq") / chunk), running={"_upto": "_key"}
    ).withColumn("_before", F.col("_upto") - F.col("_key"))
    keys = counted.where("_key = 1").select(
        "recording", F.col("_upto").alias("_ord"), F.col("seq").alias("keyframe"), F.col("pose").alias("_kpose")
    )
    wanted = counted.withColumn("_ord", F.explode(F.sequence(F.col("_before") - (window - 1), F.col("_before"))))
    # poses are made after the scan, so its size says little about a table of keyframes: never broadcast
    pairs = wanted.join(keys.hint("merge"), ["recording", "_ord"])
    gap = g.length(g.minus(g.translation_of(F.col("pose")), g.translation_of(F.col("_kpose"))))
    pairs = pinned(pairs, {"baseline": gap, "_angle": g.view_angle_deg(F.col("pose"), F.col("_kpose"))})
    usable = pairs.where(F.col("baseline").between(nearest, farthest) & (F.col("_angle") <= max_angle_deg))
    first = F.col("_before") - F.col("_ord") if baseline_m is None else F.abs(F.col("baseline") - baseline_m)
    order = Window.partitionBy("recording", "seq").orderBy(first, F.col("keyframe").desc())
    return usable.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= count)


def _blocks(rows: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Features packed into blocks of about `BLOCK`, so that no frame has to fit in one row."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    spread = rows.join(sizes, list(keys)).withColumn(
        "_block", F.pmod(F.xxhash64("feature"), F.ceil(F.col("_n") / BLOCK))
    )
    return spread.groupBy(*keys, "_block").agg(F.collect_list(F.struct("feature", "vector")).alias("_f")).select(
        *keys, F.col("_f.feature").alias(f"ids_{suffix}"), F.col("_f.vector").alias(f"vectors_{suffix}")
    )


def _distances(a: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "hamming":
        return np.bitwise_count(a[:, None, :] ^ c[None, :, :]).sum(2).astype(float)
    squared = (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * a @ c.T
    return np.sqrt(np.maximum(squared, 0.0))


def mutual_matches(
    first: DataFrame, second: DataFrame, keys: Sequence[str], ratio: float = 0.8, metric: str = "l2", two_sided: bool = False
) -> DataFrame:
    """Mutually best feature matches of each frame pair whose distance beats the second best by `ratio`.

    Tables hold keys, feature and vector (doubles, or 64-bit words for "hamming"). Blocks of features
    meet in tasks; only the best two per feature and block pair leave a task, never the pairs.
    """
    keys = list(keys)
    schema = first.select(*keys).schema
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    kind = np.int64 if metric == "hamming" else float

    def best_two(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for record in batch.itertuples(index=False):
                record = record._asdict()
                ids = [np.asarray(record[f"ids_{s}"], np.int64) for s in "ab"]
                vectors = [np.stack([np.asarray(v, kind) for v in record[f"vectors_{s}"]]) for s in "ab"]
                matrix = _distances(vectors[0], vectors[1], metric)
                for side, table, mine, other in ((0, matrix, ids[0], ids[1]), (1, matrix.T, ids[1], ids[0])):
                    order = np.lexsort((np.broadcast_to(other, table.shape), table))[:, :2]
                    out = pd.DataFrame({
                        "side": side, "me": np.repeat(mine, order.shape[1]), "other": other[order].ravel(),
                        "d": np.take_along_axis(table, order, 1).ravel(),
                    })
                    yield out.assign(**{k: record[k] for k in keys})[[*keys, "side", "me", "other", "d"]]

    pairs = _blocks(first, keys, "a").join(_blocks(second, keys, "b"), keys)
    candidates = pairs.mapInPandas(best_two, f"{columns}, side int, me long, other long, d double")
    top = candidates.groupBy(*keys, "side", "me").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, 2).alias("_t")
    )
    beats = F.col("_t")[0]["d"] < ratio * F.get("_t", F.lit(1))["d"]
    top = top.select(
        *keys, "side", "me", F.col("_t")[0]["other"].alias("other"), F.col("_t")[0]["d"].alias("distance"),
        F.coalesce(beats, F.lit(False)).alias("clear"),
    )
    there = top.where("side = 0 and clear").select(*keys, F.col("me").alias("i"), F.col("other").alias("j"), "distance")
    back = top.where("side = 1").select(*keys, F.col("me").alias("j"), F.col("other").alias("i"), F.col("clear").alias("_clear"))
    both = there.join(back, [*keys, "i", "j"])
    return (both.where("_clear") if two_sided else both).drop("_clear")


def largest_model(
    frames: DataFrame, placed: DataFrame, points: DataFrame, min_track: float = 3, max_error_px: float = 2.0
) -> DataFrame:
    """Each frame's largest model (most frames, lowest id on ties) and its reliable point count."""
    sizes = placed.groupBy("recording", "model").agg(F.count("*").alias("_n"))
    best = placed.join(sizes, ["recording", "model"]).groupBy("frame").agg(
        F.min_by("model", F.struct(-F.col("_n"), F.col("model"))).alias("model")
    )
    solid = points.where((F.col("track_length") >= min_track) & (F.col("error_px") <= max_error_px)).groupBy("frame").agg(
        F.count("*").alias("points")
    )
    return frames.join(best, "frame", "left").join(solid, "frame", "left").fillna(0, ["points"])


def window_depth(maps: DataFrame, depth: str, half: int, max_range: float = 0.10) -> DataFrame:
    """Median depth of the square window around each pixel; pixels on a depth edge are left out."""
    spread = maps.withColumn("_d", F.explode(F.array(*[F.lit(i) for i in range(-half, half + 1)])))
    spread = spread.withColumn("_row", F.col("prow") + F.col("_d"))
    # a window row holds at most (2 half + 1) x image width rows
    near = Window.partitionBy(*FRAME, "_row").orderBy("pcol").rangeBetween(-half, half)
    stats = spread.withColumns({
        "depth_m": F.percentile(depth, F.lit(0.5)).over(near), "_hi": F.max(depth).over(near), "_lo": F.min(depth).over(near),
    }).where("_d = 0")
    return stats.where(F.col("_hi") - F.col("_lo") <= max_range * F.col("depth_m")).select(*FRAME, "prow", "pcol", "depth_m")


def pair_residuals(corners: DataFrame, views: DataFrame, k: Sequence[Column]) -> DataFrame:
    """Observed minus predicted pixel of corners matched at the same place in the next frame."""
    world = world_points(corners, views, "depth_m", k).select(*FRAME, "prow", "pcol", "depth_m", "wx", "wy", "wz")
    later = views.select("recording", (F.col("frame") - 1).alias("frame"), "pose")
    seen = project_into(world.join(later, list(FRAME)), k)
    return seen.withColumns({"dx": F.col("pcol") - F.col("u"), "dy": F.col("prow") - F.col("v")})


def grid_nearest(
    points: DataFrame, value: str, tie: str, image: tuple[int, int], grid: tuple[int, int], minimum: int = 4
) -> DataFrame:
    """Each coarse cell takes the value of the point nearest its centre; null under `minimum` points.

    Every point meets the grid's few cells once and the minimum merges on the map side.
    """
    (height, width), (rows, cols) = image, grid
    cells = F.array(*[F.struct(F.lit(r).cast("long").alias("r"), F.lit(c).cast("long").alias("c")) for r in range(rows) for c in range(cols)])
    spread = points.withColumn("_g", F.explode(cells))
    dx = F.col("pcol") - (F.col("_g.c") + 0.5) * width / cols
    dy = F.col("prow") - (F.col("_g.r") + 0.5) * height / rows
    return spread.groupBy(*FRAME, F.col("_g.r").alias("grid_row"), F.col("_g.c").alias("grid_col")).agg(
        F.count("*").alias("_n"), F.min_by(value, F.struct(dx * dx + dy * dy, F.col(tie))).alias("_v")
    ).withColumn("depth_m", F.when(F.col("_n") >= minimum, F.col("_v"))).drop("_n", "_v")


def surface_gaps(
    pixels: DataFrame, maps: DataFrame, views: DataFrame, depth: str, k: Sequence[Column], height: int, width: int,
    lags: Sequence[int] = (1,), min_depth: float = 0.05,
) -> DataFrame:
    """Per frame and lag: how far the later frame's nearest points lie from the earlier frame's depth.

    Only frames of the same recording (one origin) meet. No overlap gives null gaps and overlap 0.
    """
    lag = F.explode(F.array(*[F.lit(int(n)) for n in lags]))
    # frames learn the earlier poses first, so pixels are joined once whatever the number of lags
    wanted = views.select("recording", F.col("frame").alias("_later"), lag.alias("lag")).withColumn("frame", F.col("_later") - F.col("lag"))
    held = wanted.join(views, list(FRAME)).groupBy("recording", F.col("_later").alias("frame")).agg(
        F.collect_list(F.struct("lag", "pose")).alias("_earlier")
    )
    world = world_points(pixels, views.join(held, list(FRAME)).hint("merge"), depth, k).select(*FRAME, "wx", "wy", "wz", "_earlier")
    world = pinned(world, {c: F.col(c) for c in ("wx", "wy", "wz")}).withColumn("_e", F.explode("_earlier"))
    earlier = world.select("recording", (F.col("frame") - F.col("_e.lag")).alias("frame"), "wx", "wy", "wz", F.col("_e.lag").alias("lag"), F.col("_e.pose").alias("pose"))
    local = g.into_camera(F.col("pose"), g.columns("wx", "wy", "wz"))
    seen = pinned(earlier, dict(zip(("_x", "_y", "z"), local))).where(F.col("z") > min_depth)
    u, v, _ = g.project(g.columns("_x", "_y", "z"), k)
    spots = pinned(seen, {"pcol": F.rint(u).cast("long"), "prow": F.rint(v).cast("long")}).where(
        F.col("pcol").between(0, width - 1) & F.col("prow").between(0, height - 1)
    )
    nearest = spots.groupBy(*FRAME, "lag", "prow", "pcol").agg(F.min("z").alias("z"))
    gaps = nearest.join(maps.select(*FRAME, "prow", "pcol", F.col(depth).alias("_m")), [*FRAME, "prow", "pcol"])
    gaps = gaps.withColumns({"gap": F.col("z") - F.col("_m"), "abs_gap": F.abs(F.col("z") - F.col("_m"))})
    keys = [*FRAME, "lag"]
    # a frame holds at most height x width gaps, one per pixel
    medians = gaps.groupBy(*keys).agg(
        F.count("gap").alias("overlap_pixels"), F.percentile("gap", F.lit(0.5)).alias("signed_m"), F.percentile("abs_gap", F.lit(0.5)).alias("abs_m")
    )
    totals = pixels.groupBy(*FRAME).agg(F.count("*").alias("_total")).withColumn("lag", lag).withColumn(
        "frame", F.col("frame") - F.col("lag")
    ).join(views.select(*FRAME), list(FRAME), "left_semi")
    return totals.join(medians, keys, "left").fillna(0, ["overlap_pixels"]).withColumn(
        "overlap", F.col("overlap_pixels") / F.col("_total")
    )


def assemble_observations(
    detections: DataFrame, poses: DataFrame, support: DataFrame, descriptors: DataFrame, k: Sequence[Column],
    has_pose: Column,
) -> DataFrame:
    """Detections beside their pose, depth support and descriptor; every missing part stays null."""
    depth = exact_quantiles(support, ["frame"], "target", {"depth_m": 0.5}, count="support_pixels")
    rows = detections.join(poses, "frame", "left").join(depth, "frame", "left").join(descriptors, "point", "left")
    u, v = (F.col("x1") + F.col("x2")) / 2 / 10, (F.col("y1") + F.col("y2")) / 2 / 10
    local = g.back_project(u, v, F.col("depth_m"), k)
    world = g.transform(F.when(has_pose, F.col("pose")), local)
    return rows.withColumns(dict(zip(("wx", "wy", "wz"), world)))
