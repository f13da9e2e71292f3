"""Planes, footprints and top-down maps from surface points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions.lcg import MODULUS, mixed
from ..session import checkpointed

AXES = ("x", "y", "z")
PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def moments(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean and covariance per key from ten mergeable sums; under three points gives a reason."""
    sums = points.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in AXES],
        *[F.avg(F.col(p[0]) * F.col(p[1])).alias(f"_{p}") for p in PAIRS],
    )
    enough = F.col("n") >= 3
    return sums.select(
        *keys, "n", *[f"m{a}" for a in AXES],
        *[F.when(enough, F.col(f"_{p}") - F.col(f"m{p[0]}") * F.col(f"m{p[1]}")).alias(f"c{p}") for p in PAIRS],
        F.when(~enough, "fewer than 3 points").alias("reason"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def principal(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """Three eigenvalues (largest first), then their axes row by row, from one covariance per row."""
    table = np.stack([c.to_numpy(float) for c in (xx, xy, xz, xy, yy, yz, xz, yz, zz)], 1).reshape(-1, 3, 3)
    ok = np.isfinite(table).all((1, 2))
    values, vectors = np.linalg.eigh(np.where(ok[:, None, None], table, np.eye(3)))
    packed = np.concatenate([values[:, ::-1], vectors[:, :, ::-1].transpose(0, 2, 1).reshape(-1, 9)], 1)
    return pd.Series([row.tolist() if good else None for row, good in zip(packed, ok)])


def principal_axes(table: DataFrame) -> DataFrame:
    """Adds `axes`: eigenvalues and axes of each key's covariance row."""
    return table.withColumn("axes", principal(*[F.col(f"c{p}") for p in PAIRS]))


HASH_SLICES, CHUNK_POINTS = 1 << 12, 1 << 16


def ranked_points(points: DataFrame, key: str, point_id: str, ranks: DataFrame, seed: int = 0) -> DataFrame:
    """ranks(key, rank, ...) with the point of that rank, in order of (seeded hash, point id), of its key.

    Points are counted by slices of the hash; only the slices that hold a wanted rank are put in order, each by itself.
    """
    hashed = points.select(key, F.col(point_id).alias("_id"), *AXES, mixed(F.col(point_id), seed).alias("_h"))
    hashed = hashed.withColumn("_slice", F.floor(F.col("_h") * HASH_SLICES / MODULUS))
    counts = hashed.groupBy(key, "_slice").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most HASH_SLICES rows
    starts = counts.select(key, "_slice", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("rank"))
    upto = Window.partitionBy(key).orderBy("rank", F.col("_slice").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = starts.withColumn("_start", F.col("rank")).unionByName(ranks, allowMissingColumns=True)
    placed = both.withColumn("_in", F.last(F.when(F.col("_slice").isNotNull(), F.struct("_slice", "_start")), ignorenulls=True).over(upto))
    wanted = placed.where("_slice IS NULL").select(*ranks.columns, F.col("_in._slice").alias("_slice"), (F.col("rank") - F.col("_in._start")).alias("_at"))
    wanted = checkpointed(wanted)
    order = Window.partitionBy(key, "_slice").orderBy("_h", "_id")
    near = hashed.join(wanted.select(key, "_slice").distinct(), [key, "_slice"], "left_semi").withColumn("_at", F.row_number().over(order) - 1)
    return wanted.join(near.select(key, "_slice", "_at", *AXES), [key, "_slice", "_at"]).select(*ranks.columns, *AXES)


def _inliers(reach: float, key: str):
    """Points of a chunk near each hypothesis of its key."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in (key, "hypothesis", "inliers")])

    def count(points: pd.DataFrame, planes: pd.DataFrame) -> pd.DataFrame:
        if points.empty or planes.empty:
            return pd.DataFrame(columns=schema.names)
        place, normal = points[list(AXES)].to_numpy(float), planes[["nx", "ny", "nz"]].to_numpy(float)
        offset = (planes[["px", "py", "pz"]].to_numpy(float) * normal).sum(1)
        found = np.zeros(len(normal), np.int64)
        for start in range(0, len(place), 8192):
            found += (np.abs(place[start:start + 8192] @ normal.T - offset) <= reach).sum(0)
        return pd.DataFrame({key: points[key].iloc[0], "hypothesis": planes["hypothesis"].to_numpy(), "inliers": found})

    return count, schema


def dominant_plane(points: DataFrame, key: str, point_id: str, reach: float = 0.02, iterations: int = 500, seed: int = 0) -> DataFrame:
    """The plane through three seeded draws that has the most points within `reach`, the earliest of equals, refitted
    from the moments of its inliers.

    Every point counts for every hypothesis: points are scored in chunks of some CHUNK_POINTS, so that a key is spread
    over tasks, and a chunk sends one number per hypothesis on.
    """
    sizes = points.groupBy(key).agg(F.count("*").alias("_n")).where("_n >= 3")
    number = F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))
    tries = sizes.withColumn("hypothesis", F.explode(number)).select(
        key, "hypothesis", F.posexplode(F.array(*[mixed(F.col("hypothesis") * 3 + j, seed + 1) % F.col("_n") for j in range(3)])).alias("corner", "rank"),
    )
    drawn = ranked_points(points, key, point_id, tries, seed).groupBy(key, "hypothesis").agg(
        *[F.max(F.when(F.col("corner") == j, F.col(a))).alias(f"{a}{j}") for j in range(3) for a in AXES], F.countDistinct("rank").alias("_d"),
    ).where("_d = 3")
    corner = [g.columns(*[f"{a}{j}" for a in AXES]) for j in range(3)]
    planes = drawn.withColumn("_normal", F.array(*g.cross(g.minus(corner[1], corner[0]), g.minus(corner[2], corner[0]))))
    size = F.sqrt(sum((F.col("_normal")[k] * F.col("_normal")[k] for k in (1, 2)), F.col("_normal")[0] * F.col("_normal")[0]))
    planes = checkpointed(planes.withColumn("_size", size).where("_size >= 1e-12").select(
        key, "hypothesis", *[F.col(f"{a}0").alias(f"p{a}") for a in AXES], *[(F.col("_normal")[k] / F.col("_size")).alias(f"n{a}") for k, a in enumerate(AXES)],
    ))
    chunks = F.ceil(F.col("_n") / CHUNK_POINTS).cast("long")
    dealt = points.join(sizes, key).select(key, F.pmod(F.xxhash64(point_id), chunks).alias("_chunk"), *AXES)
    copies = planes.join(sizes.select(key, F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("_chunk")), key).withColumnRenamed(key, "_key")
    count, schema = _inliers(reach, key)
    partial = dealt.groupBy(key, "_chunk").cogroup(copies.groupBy("_key", "_chunk")).applyInPandas(count, schema)
    scored = partial.groupBy(key, "hypothesis").agg(F.sum("inliers").alias("_found"))
    chosen = scored.groupBy(key).agg(F.max_by("hypothesis", F.struct("_found", -F.col("hypothesis"))).alias("hypothesis"))
    best = checkpointed(planes.join(chosen, [key, "hypothesis"]))
    height = g.dot(g.minus(g.columns(*AXES), g.columns("px", "py", "pz")), g.columns("nx", "ny", "nz"))
    marked = points.select(key, *AXES).join(best, key).withColumn("_on", F.abs(height) <= reach)
    totals = marked.groupBy(key).agg(
        F.count("*").alias("points"), F.count(F.when(F.col("_on"), 1)).alias("inliers"),
        *[F.first(n).alias(n) for n in ("hypothesis", "px", "py", "pz", "nx", "ny", "nz")],
    )
    refit = principal_axes(moments(marked.where("_on"), [key]).drop("n", "reason"))
    return totals.join(refit.select(key, "mx", "my", "mz", "axes"), key, "left").withColumn(
        "inlier_share", F.col("inliers") / F.col("points")
    )


def _in_plane(normal: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """Two unit vectors spanning a plane, from the world axis least along its normal."""
    n = normal
    helper = [F.when(F.abs(n[0]) <= 0.9, F.lit(1.0)).otherwise(F.lit(0.0)), F.when(F.abs(n[0]) <= 0.9, F.lit(0.0)).otherwise(F.lit(1.0)), F.lit(0.0)]
    first = g.unit(g.cross(n, helper))
    return first, g.cross(n, first)


def footprint(
    points: DataFrame, planes: DataFrame, key: str, cell: float = 0.05, band: float = 0.02, min_points: int = 1000,
) -> DataFrame:
    """Area, extents and heights of each origin on its plane, or the reason they are missing.

    planes(key, px, py, pz, nx, ny, nz) with the normal pointing to the cameras. Axes are the
    principal directions of the in-band points inside the plane (closed form of a 2 x 2 problem).
    """
    from ..functions.pin import pinned

    n, origin = g.columns("nx", "ny", "nz"), g.columns("px", "py", "pz")
    flat = pinned(planes, {"_e1": F.array(*_in_plane(n)[0]), "_e2": F.array(*_in_plane(n)[1])})
    e1, e2 = ([F.col(name)[i] for i in range(3)] for name in ("_e1", "_e2"))
    offset = g.minus(g.columns(*AXES), origin)
    rows = pinned(points.select(key, *AXES).join(flat, key), {"_h": g.dot(offset, n), "_a": g.dot(offset, e1), "_b": g.dot(offset, e2)})
    on = F.abs("_h") <= band
    stats = rows.groupBy(key).agg(
        F.count("*").alias("points"), F.count(F.when(on, 1)).alias("_n"),
        # a spread of none is exactly zero here; means of squares less squared means leave noise, which then turns the axes
        *[F.covar_pop(F.when(on, F.col(f"_{p}")), F.when(on, F.col(f"_{q}"))).alias(f"_s{p}{q}") for p, q in ("aa", "ab", "bb")],
    )
    saa, sab, sbb = g.columns("_saa", "_sab", "_sbb")
    reason = F.when(F.col("points") < min_points, F.concat(F.lit(f"fewer than {min_points} surface points"))).when(
        F.col("_n") < 3, F.lit("fewer than 3 points lie on the plane")
    )
    axes = pinned(stats.join(flat, key), {"reason": reason, "_angle": 0.5 * F.atan2(2 * sab, saa - sbb)})
    c, s = F.cos("_angle"), F.sin("_angle")
    major, minor = [c * p + s * q for p, q in zip(e1, e2)], [-s * p + c * q for p, q in zip(e1, e2)]
    signed = {}
    for name, axis in (("_u", major), ("_w", minor)):
        size = [F.abs(v) for v in axis]
        lead = F.when((size[0] >= size[1]) & (size[0] >= size[2]), axis[0]).when(size[1] >= size[2], axis[1]).otherwise(axis[2])
        signed[name] = F.array(*[F.when(lead < 0, -v).otherwise(v) for v in axis])
    axes = pinned(axes, signed).select(key, "points", "reason", "_u", "_w")
    u, w = ([F.col(name)[i] for i in range(3)] for name in ("_u", "_w"))
    usable = rows.join(axes.where("reason is null"), key)
    foot = [v - F.col("_h") * m for v, m in zip(g.columns(*AXES), n)]
    spots = pinned(usable, {"_s": g.dot(foot, u), "_t": g.dot(foot, w)}).select(key, "_h", "_s", "_t")
    spans = spots.groupBy(key).agg(*[f(c).alias(f"{n}{c}") for c in ("_s", "_t") for n, f in (("lo", F.min), ("hi", F.max))])
    spans = spans.select(
        key, "lo_s", "lo_t", (F.floor((F.col("hi_s") - F.col("lo_s")) / cell) + 1).alias("grid_rows"),
        (F.floor((F.col("hi_t") - F.col("lo_t")) / cell) + 1).alias("grid_columns"),
    )
    cells = spots.join(spans, key).groupBy(
        key, F.floor((F.col("_s") - F.col("lo_s")) / cell).alias("_i"), F.floor((F.col("_t") - F.col("lo_t")) / cell).alias("_j")
    ).agg(F.max("_h").alias("_top"), F.max((F.abs("_h") <= band).cast("int")).alias("_on"))
    area = cells.groupBy(key).agg(
        F.count("*").alias("observed_cells"), F.sum("_on").alias("plane_cells"), F.max("_top").alias("highest_m"), F.min("_top").alias("lowest_m")
    )
    out = axes.select(key, "points", "reason").join(spans, key, "left").join(area, key, "left")
    square = cell * cell
    return out.select(
        key, "points", "reason", (F.col("observed_cells") * square).alias("observed_area_m2"), (F.col("plane_cells") * square).alias("plane_area_m2"),
        (F.col("grid_rows") * cell).alias("length_m"), (F.col("grid_columns") * cell).alias("width_m"),
        ((F.col("grid_rows") * F.col("grid_columns") - F.col("observed_cells")) * square).alias("unknown_area_m2"),
        "highest_m", "lowest_m",
    )


def top_down(
    points: DataFrame, keys: Sequence[str], ground: tuple[str, str], up: str, cell: float, low: float, high: float, colour: str, tie: str
) -> DataFrame:
    """Highest point of each ground cell inside a height range, with its colour and the sample count."""
    kept = points.where(F.col(up).between(low, high))
    lows = kept.groupBy(*keys).agg(*[F.min(a).alias(f"_{a}") for a in ground])
    placed = kept.join(lows, list(keys))
    index = [F.floor((F.col(a) - F.col(f"_{a}")) / cell).cast("long").alias(n) for a, n in zip(ground, ("column", "line"))]
    return placed.groupBy(*keys, *index).agg(
        F.max(up).alias("height"), F.max_by(colour, F.struct(up, tie)).alias("colour"), F.count("*").alias("samples")
    )
