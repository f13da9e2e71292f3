"""Ordered decisions over a recording: resets, accepted-only history, windows and picks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import acos, degrees, sqrt
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import carried

CHUNK = 4096


def fold_sorted(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], make_fold: Callable[[], Callable], outputs: str
) -> DataFrame:
    """Visit each key's rows in order with a small carried state; adds the fold's outputs.

    A row's result depends on every row before it, so a key is walked in sequence: rows stream
    through Arrow batches out of a disk-backed sort and only the fold's state is held. Keep the input to
    key columns of frames, never pixels. `make_fold()` returns step(*values) -> tuple of outputs.
    """
    keys, order, values = list(keys), list(order), list(values)
    picked = rows.select(*keys, *order, *[c for c in values if c not in (*keys, *order)])
    names = [part.split()[0] for part in outputs.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*keys, *order).schema), outputs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = object(), None
        for batch in batches:
            marks = list(zip(*[batch[k].tolist() for k in keys]))
            results = []
            for mark, record in zip(marks, zip(*[batch[v].tolist() for v in values])):
                if mark != current:
                    current, step = mark, make_fold()
                results.append(step(*record))
            out = batch[[*keys, *order]].copy()
            for i, name in enumerate(names):
                out[name] = pd.Series([r[i] for r in results], index=out.index, dtype=object)
            yield out

    return picked.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def anchor_every(frames: DataFrame, keys: Sequence[str], order: str, time: str, posed: str, every_ns: float = 1e9) -> DataFrame:
    """A new anchor on every posed frame at least `every_ns` after the last one: adds anchor, created."""

    def make():
        last, number = None, -1

        def step(t, ok):
            nonlocal last, number
            created = bool(ok) and (last is None or t - last >= every_ns)
            if created:
                last, number = t, number + 1
            return (number if ok and number >= 0 else None), created

        return step

    return fold_sorted(frames, keys, [order], [time, posed], make, "anchor bigint, created boolean")


def keyframe_steps(
    frames: DataFrame, keys: Sequence[str], order: str, move_m: float = 0.1, turn_deg: float = 15.0
) -> DataFrame:
    """Frames that moved or turned enough since the last keyframe; x, y, z and the viewing axis ax, ay, az."""

    def make():
        last = None

        def step(x, y, z, ax, ay, az):
            nonlocal last
            if last is not None:
                moved = sqrt((x - last[0]) ** 2 + (y - last[1]) ** 2 + (z - last[2]) ** 2)
                facing = max(-1.0, min(1.0, ax * last[3] + ay * last[4] + az * last[5]))
                if moved < move_m and degrees(acos(facing)) < turn_deg:
                    return (False,)
            last = (x, y, z, ax, ay, az)
            return (True,)

        return step

    return fold_sorted(frames, keys, [order], ["x", "y", "z", "ax", "ay", "az"], make, "keyframe boolean")


def scale_jumps(rows: DataFrame, keys: Sequence[str], order: str, scale: str, limit: float, history: int = 15, needed: int = 5) -> DataFrame:
    """Drops scales over `limit` times off the median of the last accepted ones; a dropped one leaves no trace."""

    def make():
        kept: list[float] = []

        def step(value):
            if len(kept) >= needed:
                ratio = value / median(kept[-history:])
                if not 1 / limit <= ratio <= limit:
                    return (False,)
            kept.append(value)
            del kept[:-history]
            return (True,)

        return step

    return fold_sorted(rows, keys, [order], [scale], make, "accepted boolean")


def gap_segments(frames: DataFrame, keys: Sequence[str], order: str, time: str, valid: str, success: str, motion: str, max_gap_s: float = 0.1) -> DataFrame:
    """Frame status, segment and chained pose. A segment opens after a gap or a failed frame.

    `motion` is the 12-entry transform from the previous frame's camera to this one; the pose is
    multiplied by its inverse. Rotations drifting from orthogonal by over 1e-5 count as failures.
    """
    eye = np.eye(4)

    def proper(m: np.ndarray) -> bool:
        r = m[:3, :3]
        return bool(np.isfinite(m).all() and np.allclose(r @ r.T, np.eye(3), atol=1e-5) and abs(np.linalg.det(r) - 1) <= 1e-5)

    def make():
        previous, pose, segment, first = None, eye, -1, True

        def step(t, has_depth, ok, m):
            nonlocal previous, pose, segment, first
            if not has_depth:
                status, previous, first = "failed", None, False
                return status, None, None
            if previous is None or (t - previous) / 1e9 > max_gap_s:
                segment, pose, previous = segment + 1, eye, t
                status, first = ("initialized" if first else "reset"), False
                return status, segment, pose[:3].ravel().tolist()
            first = False
            matrix = eye.copy()
            if ok and m is not None:
                matrix[:3] = np.asarray(m, float).reshape(3, 4)
            if not ok or m is None or not proper(matrix):
                previous = None
                return "failed", None, None
            pose, previous = pose @ np.linalg.inv(matrix), t
            return "tracked", segment, pose[:3].ravel().tolist()

        return step

    return fold_sorted(
        frames, keys, [order], [time, valid, success, motion], make, "status string, segment bigint, pose array<double>"
    )


def numbered(rows: DataFrame, keys: Sequence[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """Adds `position` from 0 and the key's `total`."""
    keys = list(keys)
    placed = carried(rows, keys, [order], F.floor(F.col(order) / chunk), running={"_up": F.lit(1).cast("long")})
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    return placed.withColumn("position", F.col("_up") - 1).drop("_up").join(totals, keys)


def every_nth(rows: DataFrame, keys: Sequence[str], order: str, every: int) -> DataFrame:
    return numbered(rows, keys, order).where(F.col("position") % every == 0).drop("position", "total")


def evenly_spaced(rows: DataFrame, keys: Sequence[str], order: str, limit: int) -> DataFrame:
    """At most `limit` rows per key, evenly spaced, first and last included; halves round to even."""
    placed = numbered(rows, keys, order)
    totals = placed.select(*keys, "total").distinct()
    spots = totals.withColumn("_j", F.explode(F.sequence(F.lit(0), F.least(F.col("total"), F.lit(limit)) - 1)))
    spots = spots.select(
        *keys, F.when(F.col("total") <= limit, F.col("_j")).otherwise(
            F.rint(F.col("_j") * ((F.col("total") - 1) / F.lit(limit - 1)))
        ).cast("long").alias("position"),
    ).distinct()
    return placed.join(spots, [*keys, "position"]).drop("total")


def time_clip(rows: DataFrame, keys: Sequence[str], order: str, time: str, start_s: float, span_s: float, cap: int, max_gap_s: float) -> DataFrame:
    """A capped time span of each key, with `gap` marking spans that hold a hole over `max_gap_s`."""
    keys = list(keys)
    first = rows.groupBy(*keys).agg(F.min(time).alias("_t0"))
    inside = rows.join(first, keys).where(
        (F.col(time) - F.col("_t0") >= start_s * 1e9) & (F.col(time) - F.col("_t0") < (start_s + span_s) * 1e9)
    ).drop("_t0")
    kept = numbered(inside, keys, order).where(F.col("position") < cap)
    steps = carried(kept, keys, [order], F.floor(F.col(order) / CHUNK), lag={"_prev": time})
    holes = steps.groupBy(*keys).agg(F.coalesce(F.max(F.col(time) - F.col("_prev")), F.lit(0)).alias("_hole"))
    return kept.join(holes, keys).withColumn("gap", F.col("_hole") > max_gap_s * 1e9).drop("_hole", "total")


def frame_windows(rows: DataFrame, keys: Sequence[str], order: str, size: int, stride: int = 1) -> DataFrame:
    """Window membership rows (window, member position, kept). The short last window moves back to full size;
    each frame is kept by the first window that holds it."""
    keys = list(keys)
    placed = numbered(rows, keys, order)
    n, p = F.col("total"), F.col("position")
    spread = n >= size * stride  # shorter runs are cut without a stride
    block, step = F.when(spread, size * stride).otherwise(size), F.when(spread, stride).otherwise(1)
    covered = F.floor(n / block) * block
    start, moved = F.floor(p / block) * block, n - block
    in_main = (n < block) | (p < covered)
    first = F.struct((start + (p - start) % step).cast("long").alias("window"), F.lit(True).alias("kept"))
    second = F.struct((moved + (p - moved) % step).cast("long").alias("window"), (p >= covered).alias("kept"))
    # a moved window that holds no frame of its own is left out
    fresh = F.pmod(p - covered, step) < n - covered
    tail = (n > block) & (p >= moved) & fresh
    members = F.array_compact(F.array(F.when(in_main, first), F.when(tail, second)))
    return placed.withColumn("_m", F.explode(members)).select(*keys, order, "position", "_m.window", "_m.kept")


def newest_pending(frames: DataFrame, keys: Sequence[str], order: str, has_depth: str, payload: Sequence[str]) -> DataFrame:
    """The frame an update should take: the newest with depth, else the newest before any came.

    A later frame without depth never displaces one with depth.
    """
    rank = F.struct(F.col(has_depth).cast("int"), F.col(order))
    best = frames.groupBy(*keys).agg(F.max_by(F.struct(order, *payload), rank).alias("_b"), F.count("*").alias("received"))
    return best.select(*keys, "_b.*", "received")


def event_stream(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor and frame events of a recording in one ordered stream: creation, corrections, then the frame."""
    rank = F.when(F.col("kind") == "created", 0).otherwise(1)
    events = anchors.select("recording", "seq", rank.alias("rank"), "kind", "anchor_id").unionByName(
        frames.select("recording", "seq", F.lit(2).alias("rank"), F.lit("frame").alias("kind"), F.lit(None).cast("long").alias("anchor_id"))
    )
    return events.orderBy("recording", "seq", "rank", "anchor_id")


def method_inputs(manifest: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the columns a method may see; evaluator labels never travel with them."""
    return manifest.select(*[c for c in manifest.columns if c in set(allowed)])


def depth_layers(samples: DataFrame, keys: Sequence[str], depth: str, tie: str, gap_m: float = 0.08) -> DataFrame:
    """Adds `layer`: samples of one box split where sorted camera depth jumps by more than `gap_m`.

    A box holds at most one sample per image pixel, so the window is bounded by the sensor.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(depth, tie)
    jump = (F.col(depth) - F.lag(depth).over(order) > gap_m).cast("long")
    marked = samples.withColumn("_jump", F.coalesce(jump, F.lit(0)))
    return marked.withColumn("layer", F.sum("_jump").over(order)).drop("_jump")


def support_summary(samples: DataFrame, keys: Sequence[str], regularisation: float = 1e-6) -> DataFrame:
    """Count, mean, regularised sample covariance, visible extent and raw covariance of 3D samples per key."""
    axes = ("x", "y", "z")
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    sums = samples.groupBy(*keys).agg(
        F.count("*").alias("samples"), *[F.avg(a).alias(f"m{a}") for a in axes],
        *[F.coalesce(F.covar_samp(p[0], p[1]), F.lit(0.0)).alias(f"_{p}") for p in pairs],
        *[(F.max(a) - F.min(a)).alias(f"extent_{a}") for a in axes],
    )
    return sums.select(
        *keys, "samples", *[f"m{a}" for a in axes],
        *[(F.col(f"_{p}") + (regularisation if p[0] == p[1] else 0.0)).alias(f"c{p}") for p in pairs],
        *[f"extent_{a}" for a in axes],
        # full rank shows as a determinant that does not vanish against the spread
        _determinant({p: F.col(f"_{p}") for p in pairs}).alias("determinant"),
    )


def _determinant(c: dict[str, Column]) -> Column:
    return (
        c["xx"] * (c["yy"] * c["zz"] - c["yz"] * c["yz"]) - c["xy"] * (c["xy"] * c["zz"] - c["yz"] * c["xz"])
        + c["xz"] * (c["xy"] * c["yz"] - c["yy"] * c["xz"])
    )


def squared_mahalanobis(x: Column, y: Column, z: Column, minimum: int = 4, tiny: float = 1e-24) -> Column:
    """Squared distance to a support_summary row by the closed 3 x 3 inverse; null with too few samples or flat support."""
    c = {p: F.col(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")}
    d = (x - F.col("mx"), y - F.col("my"), z - F.col("mz"))
    det = _determinant(c)
    inverse = {
        "xx": c["yy"] * c["zz"] - c["yz"] * c["yz"], "xy": c["xz"] * c["yz"] - c["xy"] * c["zz"],
        "xz": c["xy"] * c["yz"] - c["xz"] * c["yy"], "yy": c["xx"] * c["zz"] - c["xz"] * c["xz"],
        "yz": c["xy"] * c["xz"] - c["xx"] * c["yz"], "zz": c["xx"] * c["yy"] - c["xy"] * c["xy"],
    }
    form = (
        d[0] * d[0] * inverse["xx"] + d[1] * d[1] * inverse["yy"] + d[2] * d[2] * inverse["zz"]
        + 2 * (d[0] * d[1] * inverse["xy"] + d[0] * d[2] * inverse["xz"] + d[1] * d[2] * inverse["yz"])
    )
    return F.when((F.col("samples") >= minimum) & (F.col("determinant") > tiny), F.greatest(form / det, F.lit(0.0)))
