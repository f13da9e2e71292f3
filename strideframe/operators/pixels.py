"""Row-wise and stencil operators on pixel tables, boxes and outlines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import boxes as b
from ..functions import geometry as g
from ..functions.pin import pinned
from .ordered import carried
from .timejoin import HOUR_NS, time_chunk

FRAME = ("recording", "frame")

# repeat weights of the near-first depth bands, fixed values
NEAR_FIRST = ((1.0, 16), (2.0, 4), (3.0, 2), (float("inf"), 1))


def decode_depth(encoded: Column, units_per_metre: float) -> Column:
    """Metres, or null where the code is missing, not a number or not positive."""
    ok = encoded.isNotNull() & ~F.isnan(encoded) & (encoded > 0) & (F.abs(encoded) != float("inf"))
    return F.when(ok, encoded / units_per_metre)


def world_points(
    pixels: DataFrame, views: DataFrame, depth: str, k: Sequence[Column], keys: Sequence[str] = FRAME
) -> DataFrame:
    """Pixels with depth back-projected through their frame's pose: adds wx, wy, wz."""
    rows = pixels.join(views, list(keys))
    local = g.back_project(F.col("pcol"), F.col("prow"), F.col(depth), k)
    world = g.transform(F.col("pose"), local)
    return rows.withColumns(dict(zip(("wx", "wy", "wz"), world)))


def project_into(rows: DataFrame, k: Sequence[Column]) -> DataFrame:
    """World points wx, wy, wz seen from `pose`: adds u, v, z."""
    local = g.into_camera(F.col("pose"), g.columns("wx", "wy", "wz"))
    rows = rows.withColumns(dict(zip(("_x", "_y", "z"), local)))
    u, v, _ = g.project(g.columns("_x", "_y", "z"), k)
    return rows.withColumns({"u": u, "v": v}).drop("_x", "_y")


TRIANGULATED = ("depth_m", "depth_b_m", "error_a_px", "error_b_px", "sigma_m", "epipolar_px", "parallax_rad", "wx", "wy", "wz")


def triangulate(pairs: DataFrame, k: Sequence[Column], sigma_px: float = 1.0, parallel: float = 1e-6) -> DataFrame:
    """Two-view points of matched pixels (u1, v1, pose_a) and (u2, v2, pose_b), with their errors.

    Rays closer than `parallel` in squared sine have no crossing and are dropped. Two views from one place have no
    baseline: their errors are NaN, as divisions by zero are outside Spark's checked arithmetic.
    """
    given = ("u1", "v1", "u2", "v2", "pose_a", "pose_b")
    whole = reduce(and_, [F.col(c).isNotNull() for c in given])
    rows = pairs.where(whole).withColumn("_k", F.array(*[c.cast("double") for c in k]))
    kept = pairs.columns
    schema = StructType([*pairs.schema.fields, *[StructField(n, DoubleType()) for n in TRIANGULATED]])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists = [table[n].combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in ("pose_a", "pose_b", "_k")]
            a, c, cameras = lists[0].reshape(-1, 12).T, lists[1].reshape(-1, 12).T, lists[2].reshape(-1, 4).T
            pixels = [table[n].to_numpy().astype(float) for n in ("u1", "v1", "u2", "v2")]
            with np.errstate(all="ignore"):
                crossing, found, masks = _two_views(a, c, pixels, cameras, sigma_px, parallel)
            rest = table.select(kept)
            for name in TRIANGULATED:
                rest = rest.append_column(name, pa.array(found[name], pa.float64(), mask=masks.get(name)))
            yield from rest.filter(pa.array(crossing)).combine_chunks().to_batches()

    return rows.mapInArrow(solve, schema)


def _two_views(a, c, pixels, camera, sigma_px, parallel) -> tuple[np.ndarray, dict, dict]:
    """Whether the rays cross, the measures of each match, and where a pixel error is unknown."""
    u1, v1, u2, v2 = pixels
    fx, fy = camera[0], camera[1]
    one = np.ones_like(u1)
    turn_a, turn_c, at_a, at_c = g.rotation_of(a), g.rotation_of(c), g.translation_of(a), g.translation_of(c)
    size = lambda v: np.sqrt(g.dot(v, v))
    unit = lambda v: [x / size(v) for x in v]
    into = lambda turn, at, v: g.rotate(g.transposed(turn), g.minus(v, at))
    ray = lambda u, v: [(u - camera[2]) / fx, (v - camera[3]) / fy, one]
    ray_a, ray_c = ray(u1, v1), ray(u2, v2)
    toward_a, toward_c = unit(g.rotate(turn_a, ray_a)), unit(g.rotate(turn_c, ray_c))
    cosine, between = g.dot(toward_a, toward_c), g.minus(at_a, at_c)
    along_a, along_c = g.dot(toward_a, between), g.dot(toward_c, between)
    spread = 1 - cosine * cosine
    s, t = (cosine * along_c - along_a) / spread, (along_c - cosine * along_a) / spread
    p = [0.5 * (pa_ + s * va + pc + t * vc) for pa_, va, pc, vc in zip(at_a, toward_a, at_c, toward_c)]
    back = g.transposed(turn_c)
    # the first view in the second one's axes
    shift = [x + y for x, y in zip(g.rotate(back, at_a), [-x for x in g.rotate(back, at_c)])]
    relative = [g.dot(back[3 * i:3 * i + 3], [turn_a[j], turn_a[3 + j], turn_a[6 + j]]) for i in range(3) for j in range(3)]
    line = g.cross(shift, g.rotate(relative, ray_a))
    local_a, local_c = into(turn_a, at_a, p), into(turn_c, at_c, p)
    to_a, to_c = g.minus(at_a, p), g.minus(at_c, p)
    bend = g.dot(to_a, to_c) / (size(to_a) * size(to_c))
    parallax = np.arccos(np.where(np.isnan(bend), 1.0, np.clip(bend, -1.0, 1.0)))

    def error(local, u, v):
        return np.hypot(fx * local[0] / local[2] + camera[2] - u, fy * local[1] / local[2] + camera[3] - v)

    found = {
        "depth_m": local_a[2], "depth_b_m": local_c[2], "error_a_px": error(local_a, u1, v1), "error_b_px": error(local_c, u2, v2),
        "sigma_m": local_a[2] * sigma_px / (fx * np.sin(parallax)),
        "epipolar_px": np.abs(g.dot(line, ray_c)) / np.hypot(line[0] / fx, line[1] / fy),
        "parallax_rad": parallax, "wx": p[0], "wy": p[1], "wz": p[2],
    }
    return spread > parallel, found, {"error_a_px": local_a[2] == 0, "error_b_px": local_c[2] == 0}


def gate_matches(
    rows: DataFrame, max_epipolar_px: float = 4.0, max_reprojection_px: float = 2.0,
    min_parallax_deg: float = 1.0, max_relative_sigma: float = 0.1,
) -> DataFrame:
    return rows.where(
        (F.col("epipolar_px") <= max_epipolar_px) & (F.col("depth_m") > 0) & (F.col("depth_b_m") > 0)
        & (F.col("error_a_px") <= max_reprojection_px) & (F.col("error_b_px") <= max_reprojection_px)
        & (F.col("parallax_rad") >= min_parallax_deg / g.DEGREES)
        & (F.col("sigma_m") <= max_relative_sigma * F.col("depth_m"))
    )


def quarter_turns(pose: Column) -> Column:
    """Clockwise turns bringing image down closest to world down; the first best wins."""
    scores = F.array(-pose[5], -pose[4], pose[5], pose[4])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")


def onto_plane(p: Sequence[Column], origin: Sequence[Column], normal: Sequence[Column]) -> tuple[Column, list[Column]]:
    height = g.dot(g.minus(p, origin), normal)
    return height, [c - height * n for c, n in zip(p, normal)]


def ray_split(offset: Sequence[Column], ray: Sequence[Column]) -> tuple[Column, Column]:
    """Length of an offset along a unit ray, and across it."""
    along = g.dot(offset, ray)
    return along, F.sqrt(F.greatest(g.dot(offset, offset) - along * along, F.lit(0.0)))


def placement(p: Sequence[Column], r: Sequence[Column]) -> dict[str, Column]:
    """Signed centre and edge errors of a box against its reference, in pixels."""
    dx, dy = (p[0] + p[2]) / 2 - (r[0] + r[2]) / 2, (p[1] + p[3]) / 2 - (r[1] + r[3]) / 2
    offset = F.sqrt(dx * dx + dy * dy)
    wide, high = r[2] - r[0], r[3] - r[1]
    return {
        "iou": b.iou(p, r), "centre_dx": dx, "centre_dy": dy, "centre_offset": offset,
        "centre_offset_fraction": offset / F.sqrt(wide * wide + high * high),
        "edge_left": p[0] - r[0], "edge_top": p[1] - r[1], "edge_right": p[2] - r[2], "edge_bottom": p[3] - r[3],
        "width_ratio": (p[2] - p[0]) / wide, "height_ratio": (p[3] - p[1]) / high,
    }


def zncc(maps: DataFrame, value: str, minimum: int = 16) -> DataFrame:
    """Correlation of each frame's pixels with the next frame's at the same places."""
    later = maps.select(
        "recording", (F.col("frame") - 1).alias("frame"), "prow", "pcol", F.col(value).alias("_later")
    )
    both = maps.join(later, [*FRAME, "prow", "pcol"])
    return both.groupBy(*FRAME).agg(
        F.count("*").alias("support"), F.when(F.count("*") >= minimum, F.corr(value, "_later")).alias("zncc")
    )


def angular_speed(poses: DataFrame, keys: Sequence[str], chunk_ns: int = HOUR_NS) -> DataFrame:
    """Rotation angle between consecutive poses over their step, placed at the step's midpoint."""
    q = ("qx", "qy", "qz", "qw")
    rows = carried(poses, keys, ["t_ns"], time_chunk("t_ns", chunk_ns), lag={"_prev": F.struct("t_ns", *q)})
    rows = rows.where("_prev is not null")
    angle = g.rotation_angle([F.col(f"_prev.{n}") for n in q], g.columns(*q))
    return rows.withColumns({
        "mid_s": (F.col("_prev.t_ns") + F.col("t_ns")) / 2e9,
        "angle": angle, "speed": angle / ((F.col("t_ns") - F.col("_prev.t_ns")) * 1e-9),
    }).drop("_prev")


def _row_stencil(maps: DataFrame, step: int) -> tuple[DataFrame, Window]:
    """Every pixel repeated on the rows it can influence, and the window of one image row.

    An image row holds at most 3 x width rows, so the window's group is bounded by the sensor.
    """
    spread = maps.withColumn("_d", F.explode(F.array(F.lit(-step), F.lit(0), F.lit(step))))
    spread = spread.withColumn("_row", F.col("prow") + F.col("_d"))
    return spread, Window.partitionBy(*FRAME, "_row").orderBy("pcol")


def edge_masks(maps: DataFrame, depth: str, jump: float = 0.05) -> DataFrame:
    """Per pixel: `edge` by the 3 x 3 depth range, `jump` by 4-neighbour differences."""
    spread, line = _row_stencil(maps, 1)
    z = F.col(depth)
    around, here = line.rangeBetween(-1, 1), line.rangeBetween(0, 0)
    neighbours = [
        F.max(F.when(F.col("_d") == 1, z)).over(here), F.max(F.when(F.col("_d") == -1, z)).over(here),
        F.max(F.when(F.col("_d") == 0, z)).over(line.rangeBetween(-1, -1)),
        F.max(F.when(F.col("_d") == 0, z)).over(line.rangeBetween(1, 1)),
    ]
    flagged = spread.withColumns({
        "_hi": F.max(z).over(around), "_lo": F.min(z).over(around),
        **{f"_n{i}": n for i, n in enumerate(neighbours)},
    }).where("_d = 0")
    jumps = F.lit(False)
    for i in range(4):
        other = F.col(f"_n{i}")
        jumps = jumps | F.coalesce(F.abs(z - other) > jump * F.greatest(z, other), F.lit(False))
    return flagged.select(
        *FRAME, "prow", "pcol", (F.col("_hi") - F.col("_lo") > jump * z).alias("edge"), jumps.alias("jump")
    )


def normals(
    maps: DataFrame, depth: str, k: Sequence[Column], step: int = 1, max_angle_deg: float = 75.0
) -> DataFrame:
    """Camera-facing normals of pixels whose four neighbours exist, and whether each is seen side-on."""
    point = F.struct(*[c.alias(n) for n, c in zip("xyz", g.back_project(F.col("pcol"), F.col("prow"), F.col(depth), k))])
    spread, line = _row_stencil(maps.withColumn("_p", point), step)
    pick = lambda d, lo, hi: F.max(F.when(F.col("_d") == d, F.col("_p"))).over(line.rangeBetween(lo, hi))
    rows = spread.withColumns({
        "_left": pick(0, -step, -step), "_right": pick(0, step, step),
        "_up": pick(step, 0, 0), "_down": pick(-step, 0, 0),
    }).where("_d = 0 and _left is not null and _right is not null and _up is not null and _down is not null")
    part = lambda name: [F.col(f"{name}.{a}") for a in "xyz"]
    across, down = g.minus(part("_right"), part("_left")), g.minus(part("_down"), part("_up"))
    rows = rows.withColumn("_n", F.array(*g.cross(across, down)))
    n = [F.col("_n")[i] for i in range(3)]
    rows = rows.withColumns({"_s": g.length(n), "_f": g.dot(n, part("_p"))}).where("_s > 0")
    turned = F.when(F.col("_f") > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    cosine = F.abs("_f") / (F.col("_s") * g.length(part("_p")) + 1e-12)
    return rows.withColumns({
        **{name: turned * c / F.col("_s") for name, c in zip(("nx", "ny", "nz"), n)},
        "side_on": cosine < F.cos(F.radians(F.lit(max_angle_deg))),
    }).drop("_d", "_row", "_left", "_right", "_up", "_down", "_n", "_s", "_f", "_p")


def near_first(pixels: DataFrame, depth: str, bands=NEAR_FIRST) -> DataFrame:
    """Weight of each pixel's depth band; stands for repeating near pixels."""
    weight = None
    for upper, repeats in bands:
        inside = F.col(depth) < upper
        weight = F.when(inside, repeats) if weight is None else weight.when(inside, repeats)
    return pixels.where(F.col(depth) > 0).withColumn("weight", weight)


def polygon_pixels(shapes: DataFrame, keys: Sequence[str], ring: str, height: int, width: int) -> DataFrame:
    """Pixels whose centres lie inside an outline, scan line by scan line.

    Each edge is crossed with the rows it spans; pixels are generated only between crossings, so no
    pixel outside the outline is ever a row. `ring` is array<struct<x, y>>.
    """
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = shapes.select(*keys, F.explode(F.arrays_zip(F.col(ring).alias("a"), turned.alias("b"))).alias("e"))
    x, y, x2, y2 = F.col("e.a.x"), F.col("e.a.y"), F.col("e.b.x"), F.col("e.b.y")
    low, high = F.least(y, y2), F.greatest(y, y2)
    first = F.greatest(F.ceil(low - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(high - 0.5) - 1, F.lit(height - 1)).cast("int")
    lines = edges.withColumn("prow", F.explode(F.when(first <= last, F.sequence(first, last))))
    centre = F.col("prow") + 0.5
    crossing = (x2 - x) * (centre - y) / (y2 - y) + x
    crossed = lines.select(*keys, "prow", crossing.alias("_x")).groupBy(*keys, "prow").agg(
        F.array_sort(F.collect_list("_x")).alias("_xs")
    )
    spans = crossed.withColumn(
        "_i", F.explode(F.sequence(F.lit(0), (F.size("_xs") / 2).cast("int") - 1))
    )
    start = F.greatest(F.ceil(F.get("_xs", 2 * F.col("_i")) - 0.5), F.lit(0)).cast("long")
    stop = F.least(F.ceil(F.get("_xs", 2 * F.col("_i") + 1) - 0.5) - 1, F.lit(width - 1)).cast("long")
    return spans.select(
        *keys, F.col("prow").cast("long").alias("prow"),
        F.explode(F.when(start <= stop, F.sequence(start, stop))).alias("pcol"),
    )


def decode_runs(runs: DataFrame, keys: Sequence[str], order: str, count: str, height: int, chunk: int = 4096) -> DataFrame:
    """Column-major run lengths (empty, filled, empty, ...) to filled pixels."""
    placed = carried(runs, keys, [order], F.floor(F.col(order) / chunk), running={"_stop": count})
    filled = placed.where((F.col(order) % 2 == 1) & (F.col(count) > 0))
    position = F.explode(F.sequence(F.col("_stop") - F.col(count), F.col("_stop") - 1))
    return filled.select(*keys, position.alias("_at")).select(
        *keys, (F.col("_at") % height).alias("prow"), F.expr(f"_at div {height}").alias("pcol")
    )


def fault_points(pixels: DataFrame, views: DataFrame, depth: str, k: Sequence[Column]) -> DataFrame:
    """World points of clean rows and of two deliberate faults, side by side in one pass."""
    faults = F.array(*[F.lit(n) for n in ("clean", "double_depth", "inverse_pose")])
    rows = pixels.join(views, list(FRAME)).withColumn("fault", F.explode(faults))
    used = F.when(F.col("fault") == "double_depth", 2 * F.col(depth)).otherwise(F.col(depth))
    rows = rows.withColumn("_c", F.array(*g.back_project(F.col("pcol"), F.col("prow"), used, k)))
    c = [F.col("_c")[i] for i in range(3)]
    right, wrong = g.transform(F.col("pose"), c), g.into_camera(F.col("pose"), c)
    return rows.withColumns({
        n: F.when(F.col("fault") == "inverse_pose", bad).otherwise(good)
        for n, good, bad in zip(("wx", "wy", "wz"), right, wrong)
    }).drop("_c")


def variant_matrix(
    pixels: DataFrame, variants: Sequence[tuple[str, float, float, int]], depth: str, voxel: float
) -> DataFrame:
    """Every (name, near, far, confidence) setting scored over the same rows in one pass."""
    settings = F.array(*[
        F.struct(F.lit(n).alias("variant"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(c).alias("conf"))
        for n, lo, hi, c in variants
    ])
    rows = pixels.withColumn("_v", F.explode(settings))
    kept = F.col(depth).between(F.col("_v.lo"), F.col("_v.hi")) & (F.col("confidence") >= F.col("_v.conf"))
    return rows.withColumns({"kept": kept, "_cell": F.floor(F.col(depth) / voxel)}).groupBy(
        F.col("_v.variant").alias("variant"), "recording"
    ).agg(
        F.count("*").alias("before_n"), F.count(F.when(F.col("kept"), 1)).alias("after_n"),
        F.count_distinct(F.when(F.col("kept"), F.col("_cell"))).alias("cells"),
    )
