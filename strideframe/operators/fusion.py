"""Voxel fusion, signed-distance fusion and surface extraction on keyed cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import geometry as g
from .spatial import voxel

AXES = ("x", "y", "z")
INDEX = ("ix", "iy", "iz")


def voxel_fuse(
    points: DataFrame, keys: Sequence[str], cell: float, colours: Sequence[str] = (), normals: Sequence[str] = (),
    min_count: int = 1,
) -> DataFrame:
    """Mean position, colour and unit normal per voxel; sums merge before the shuffle."""
    binned = points.withColumns(voxel(cell))
    fused = binned.groupBy(*keys, *INDEX).agg(
        F.count("*").alias("samples"), *[F.avg(c).alias(c) for c in (*AXES, *colours)],
        *[F.sum(c).alias(f"_{c}") for c in normals],
    ).where(F.col("samples") >= min_count)
    if not normals:
        return fused
    sums = [F.col(f"_{c}") for c in normals]
    size = g.length(sums)
    up = (0.0, 0.0, 1.0)
    return fused.withColumns({
        c: F.when(size > 1e-9, s / size).otherwise(F.lit(u)) for c, s, u in zip(normals, sums, up)
    }).drop(*[f"_{c}" for c in normals])


def voxel_thin(points: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Mean position per voxel on a grid that starts half a voxel below each key's minimum."""
    lows = points.groupBy(*keys).agg(*[(F.min(c) - cell / 2).alias(f"_{c}") for c in AXES])
    placed = points.join(lows, list(keys)).withColumns(voxel(cell, g.columns("_x", "_y", "_z")))
    return placed.groupBy(*keys, *INDEX).agg(
        F.count("*").alias("samples"), *[F.avg(c).alias(c) for c in AXES]
    )


def fragment_of(keyframe: Column, per_fragment: int = 10) -> Column:
    return F.floor(keyframe / per_fragment).cast("long")


def fragment_anchor(rows: DataFrame, anchors: DataFrame, per_fragment: int = 10) -> DataFrame:
    """The anchor that places each fragment: its first keyframe if known, else the first one fused."""
    keyed = rows.withColumn("fragment", fragment_of(F.col("keyframe"), per_fragment))
    first = keyed.groupBy("recording", "fragment").agg(F.min("seq").alias("_at"), F.min_by("keyframe", "seq").alias("_seen"))
    first = first.withColumn("_first", F.col("fragment") * per_fragment)
    known = anchors.select("recording", F.col("anchor_id").alias("_first"), F.lit(True).alias("_known")).distinct()
    return first.join(known, ["recording", "_first"], "left").select(
        "recording", "fragment", F.when(F.col("_known"), F.col("_first")).otherwise(F.col("_seen")).alias("anchor_id")
    )


def signed_distance(
    pixels: DataFrame, views: DataFrame, maps: DataFrame, fragment: Column, depth: str, k: Sequence[float],
    height: int, width: int, cell: float, band_voxels: int = 4, colours: Sequence[str] = (),
) -> DataFrame:
    """Running-average truncated distance per (recording, fragment, voxel).

    Voxels worth storing lie along pixel rays inside the truncation band. Each is projected into the frames of its
    own fragment, a number bounded by the keyframes a fragment holds. The pixels of a fragment meet in one group;
    neither rays nor projected voxels are shuffled. Maps hold one row per pixel of a frame.
    """
    frames = views.select("recording", "frame", fragment.alias("fragment"), "pose")
    marks = [F.lit(None).cast("double").alias(c) for c in (depth, *colours)]
    # a frame row brings the pose, ray rows are back-projected, map rows are looked up
    place = ["recording", "fragment", "frame", "kind", "prow", "pcol", "pose", depth, *colours]
    none, bare = F.lit(None).cast("long"), F.lit(None).cast("array<double>")
    whole = lambda c: F.col(c).cast("long").alias(c)
    value = lambda c: F.col(c).cast("double").alias(c)
    posed = frames.select("recording", "fragment", "frame", F.lit(0).alias("kind"), none.alias("prow"), none.alias("pcol"), "pose", *marks)
    spots = lambda df, kind, more: df.where(F.col(depth).isNotNull()).select(
        "recording", fragment.alias("fragment"), "frame", F.lit(kind).alias("kind"), whole("prow"), whole("pcol"), bare.alias("pose"), value(depth), *more
    )
    shown = [value(c) for c in colours]
    if maps is pixels:
        rows = posed.unionByName(spots(maps, 3, shown))
    else:
        rows = posed.unionByName(spots(pixels, 1, marks[1:])).unionByName(spots(maps, 2, shown))
    cut = band_voxels * cell
    schema = StructType([
        *rows.select("recording", "fragment").schema.fields, *[StructField(n, LongType()) for n in INDEX],
        StructField("tsdf", DoubleType()), StructField("weight", LongType()), *[StructField(c, DoubleType()) for c in colours],
    ])

    def fuse(pdf: pd.DataFrame) -> pd.DataFrame:
        poses = dict(zip(pdf["frame"][pdf["kind"] == 0], pdf["pose"][pdf["kind"] == 0]))
        poses = {f: np.asarray(p, float) for f, p in poses.items()}
        here = pdf[pdf["frame"].isin(poses.keys()) & (pdf["kind"] > 0)]
        by_frame = {f: part for f, part in here.groupby("frame")}
        touched = [np.empty((0, 3), np.int64)]
        for f, part in by_frame.items():
            part = part[(part["kind"] & 1) > 0]
            row, col, seen = (part[c].to_numpy(float) for c in ("prow", "pcol", depth))
            for step in range(-band_voxels, band_voxels + 1):
                d = seen + step * cell
                world = g.transform(poses[f], g.back_project(col, row, d, k))
                index = np.floor(np.stack(world, 1)[d > 0] / cell).astype(np.int64)
                touched.append(index)
        voxels = np.concatenate(touched)
        voxels = voxels[np.lexsort(voxels.T)]
        voxels = voxels[np.r_[True, (voxels[1:] != voxels[:-1]).any(1)][:len(voxels)]]
        total, weight = np.zeros(len(voxels)), np.zeros(len(voxels), np.int64)
        shades = {c: (np.zeros(len(voxels)), np.zeros(len(voxels), np.int64)) for c in colours}
        centres = list((voxels + 0.5).T * cell)
        for f, part in by_frame.items():
            part = part[(part["kind"] & 2) > 0]
            part = part[part["prow"].between(0, height - 1) & part["pcol"].between(0, width - 1)]
            # position in `part` of every pixel of the image
            at = np.full(height * width, -1)
            at[(part["prow"] * width + part["pcol"]).to_numpy(np.int64)] = np.arange(len(part))
            cx, cy, cz = g.into_camera(poses[f], centres)
            front = np.nonzero(cz > 0)[0]
            col = np.rint(cx[front] / cz[front] * k[0] + k[2])
            row = np.rint(cy[front] / cz[front] * k[1] + k[3])
            inside = (col >= 0) & (col <= width - 1) & (row >= 0) & (row <= height - 1)
            front, spot = front[inside], at[(row[inside] * width + col[inside]).astype(np.int64)]
            front, spot = front[spot >= 0], spot[spot >= 0]
            gap = part[depth].to_numpy(float)[spot] - cz[front]
            front, spot, gap = front[gap > -cut], spot[gap > -cut], gap[gap > -cut]
            total[front] += np.minimum(gap / cut, 1.0)
            weight[front] += 1
            for c, (sums, counts) in shades.items():
                shade = part[c].to_numpy(float)[spot]
                sums[front] += np.where(np.isnan(shade), 0.0, shade)
                counts[front] += ~np.isnan(shade)
        hit = weight > 0
        out = {"recording": pdf["recording"].iloc[0], "fragment": pdf["fragment"].iloc[0], **dict(zip(INDEX, voxels[hit].T))}
        out = pd.DataFrame({**out, "tsdf": total[hit] / weight[hit], "weight": weight[hit]})
        for c, (sums, counts) in shades.items():
            out[c] = np.divide(sums[hit], counts[hit], out=np.full(hit.sum(), np.nan), where=counts[hit] > 0)
        return out

    return rows.select(place).groupBy("recording", "fragment").applyInPandas(fuse, schema)


def zero_crossings(volume: DataFrame, cell: float, keys: Sequence[str] = ("recording", "fragment")) -> DataFrame:
    """Surface points where the distance changes sign between a voxel and its next neighbour on an axis.

    Neighbours stand next to each other in a window along each axis, all on one partitioning by the keys.
    """
    rows = volume.repartition(*keys).select(*keys, *INDEX, "tsdf")
    for n in INDEX:
        line = Window.partitionBy(*keys, *[m for m in INDEX if m != n]).orderBy(n)
        ahead = F.lead(n).over(line) == F.col(n) + 1
        rows = rows.withColumn(f"_{n}", F.when(ahead, F.lead("tsdf").over(line)))
    nexts = F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(f"_{n}").alias("next")) for axis, n in enumerate(INDEX)])
    pairs = rows.where((F.col("tsdf") != 0) & (F.abs("tsdf") < 1)).select(*keys, *INDEX, "tsdf", F.inline(nexts)).where(
        (F.abs("next") < 1) & (F.signum("tsdf") * F.signum("next") <= 0)
    )
    share = F.col("tsdf") / (F.col("tsdf") - F.col("next"))
    place = {
        a: (F.col(n) + 0.5 + F.when(F.col("axis") == axis, share).otherwise(0.0)) * cell for axis, (a, n) in enumerate(zip(AXES, INDEX))
    }
    return pairs.select(*keys, *INDEX, "axis", *[c.alias(a) for a, c in place.items()])


def replaced(points: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anchor-frame points moved into the world by the anchor's current pose; nothing is fused again."""
    rows = points.join(anchors, list(keys))
    return rows.withColumns(dict(zip(AXES, g.transform(F.col("anchor_pose"), g.columns(*AXES)))))
