"""Path accuracy: alignments, best fits, motion errors and rotation averages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions.pin import pinned
from .timejoin import nearest_within

AXES = ("x", "y", "z")
MIN_SPREAD_M = 1e-9


def first_pose_errors(matched: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Position error of each matched frame after aligning its segment at the first matched pose.

    matched(keys, order, est, ref, tracked) with 12-entry poses; segments under two matches or without a
    tracked frame have no rows.
    """
    keys = list(keys)
    first = matched.groupBy(*keys).agg(
        F.min_by(F.struct("est", "ref"), order).alias("_f"), F.count("*").alias("_n"), F.max(F.col("tracked").cast("int")).alias("_t")
    ).where("_n >= 2 and _t = 1").select(*keys, F.col("_f.est").alias("_e0"), F.col("_f.ref").alias("_r0"))
    first = pinned(first, {"_i": g.inverse(F.col("_e0"))})
    first = pinned(first, {"_align": g.compose(F.col("_r0"), F.col("_i"))}).select(*keys, "_align")
    moved = g.transform(F.col("_align"), g.translation_of(F.col("est")))
    return matched.join(first, keys).withColumn("error_m", g.length(g.minus(moved, g.translation_of(F.col("ref"))))).drop("_align")


_FIT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("rigid_rmse_m", "sized_rmse_m", "size")])


@F.pandas_udf(_FIT)
def _fit(n: pd.Series, ve: pd.Series, vr: pd.Series, cross: pd.Series, scatter: pd.Series) -> pd.DataFrame:
    """Best rigid and sized fit of each row's segment from its cross-covariance (closed-form residuals)."""
    out = []
    for count, e, r, c, s in zip(n, ve, vr, cross, scatter):
        spread = np.linalg.eigvalsh(np.asarray(s, float).reshape(3, 3))
        if count < 3 or e <= 0 or np.sqrt(max(spread[1], 0.0) * count) <= MIN_SPREAD_M:
            out.append((None, None, None))
            continue
        u, d, vt = np.linalg.svd(np.asarray(c, float).reshape(3, 3))
        trace = d[0] + d[1] + d[2] * np.sign(np.linalg.det(u) * np.linalg.det(vt))
        size = trace / e
        rigid, sized = r + e - 2 * trace, r - trace * trace / e
        out.append((float(np.sqrt(max(rigid, 0.0))), float(np.sqrt(max(sized, 0.0))), float(size)))
    return pd.DataFrame(out, columns=["rigid_rmse_m", "sized_rmse_m", "size"])


def best_fits(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE after the best rotation and shift, and after one with size, per segment.

    Everything but a 3 x 3 decomposition of one row per segment is a mergeable sum.
    """
    rows = matched.select(
        *keys, *[c.alias(f"e{a}") for a, c in zip(AXES, g.translation_of(F.col("est")))],
        *[c.alias(f"r{a}") for a, c in zip(AXES, g.translation_of(F.col("ref")))],
    )
    cov = lambda p, q: F.covar_pop(p, q)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), sum((F.var_pop(f"e{a}") for a in AXES[1:]), F.var_pop("ex")).alias("_ve"),
        sum((F.var_pop(f"r{a}") for a in AXES[1:]), F.var_pop("rx")).alias("_vr"),
        F.array(*[cov(f"r{a}", f"e{b}") for a in AXES for b in AXES]).alias("_c"), F.array(*[cov(f"r{a}", f"r{b}") for a in AXES for b in AXES]).alias("_s"),
    )
    fitted = sums.withColumn("_f", _fit(F.col("n").cast("double"), "_ve", "_vr", "_c", "_s"))
    return fitted.select(*keys, "n", "_f.*")


def pooled_path(errors: DataFrame, fits: DataFrame, run: Sequence[str], frames: DataFrame) -> DataFrame:
    """Run-level errors pooled over samples; one overall size only when one segment was fitted."""
    run = list(run)
    weight = lambda c: F.sum(F.col(c) * F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
    position = errors.groupBy(*run).agg(F.sqrt(F.avg(F.col("error_m") * F.col("error_m"))).alias("position_rmse_m"), F.count("*").alias("samples"))
    pooled = fits.groupBy(*run).agg(
        F.sqrt(weight("rigid_rmse_m")).alias("rigid_rmse_m"), F.sqrt(weight("sized_rmse_m")).alias("sized_rmse_m"),
        F.when(F.count("size") == 1, F.max("size")).alias("size"), F.count("*").alias("segments"),
    )
    tracked = frames.groupBy(*run).agg(
        (F.count(F.when(F.col("tracked"), 1)) / F.when(F.count("*") > 1, F.count("*") - 1)).alias("tracked_fraction")
    )
    return tracked.join(position, run, "left").join(pooled, run, "left")


def relative_motion(matched: DataFrame, keys: Sequence[str], order: str, time: str, window_ns: int = 1_000_000_000, slack_ns: int = 100_000_000) -> DataFrame:
    """Motion error over the frame nearest one second later, if it lies within 0.1 s of that."""
    keys = list(keys)
    ahead = matched.select(*keys, order, "est", "ref", (F.col(time) + window_ns).alias(time))
    near = nearest_within(ahead, matched, keys, time, ["est", "ref"], slack_ns)
    rows = near.where("match is not null").select(
        *keys, order, "est", "ref", F.col("match.est").alias("_e"), F.col("match.ref").alias("_r")
    )
    return motion_residual(rows)


def motion_residual(rows: DataFrame) -> DataFrame:
    """Translation and rotation left between estimated and reference motion from (est, ref) to (_e, _r)."""
    rows = pinned(rows, {"_ie": g.inverse(F.col("est")), "_ir": g.inverse(F.col("ref"))})
    rows = pinned(rows, {"_de": g.compose(F.col("_ie"), F.col("_e")), "_dr": g.compose(F.col("_ir"), F.col("_r"))})
    rows = pinned(rows, {"_idr": g.inverse(F.col("_dr"))})
    rows = pinned(rows, {"_left": g.compose(F.col("_idr"), F.col("_de"))})
    left = F.col("_left")
    cosine = g.clamp((left[0] + left[5] + left[10] - 1) / 2, -1.0, 1.0)
    return rows.withColumns({"translation_m": g.length(g.translation_of(left)), "rotation_rad": F.acos(cosine)}).drop(
        "_ie", "_ir", "_de", "_dr", "_idr", "_left", "_e", "_r"
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _leading(sums: pd.Series) -> pd.Series:
    """Leading eigenvector of each row's 4 x 4 sum: the mean unit quaternion."""
    out = []
    for s in sums:
        v = np.linalg.eigh(np.asarray(s, float).reshape(4, 4))[1][:, -1]
        out.append((v if v[3] >= 0 else -v).tolist())
    return pd.Series(out)


def mean_rotation(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean unit quaternion of qx, qy, qz, qw per key and the widest angle to it."""
    keys = list(keys)
    q = ("qx", "qy", "qz", "qw")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in q for b in q]).alias("_s")
    ).withColumn("mean", _leading("_s")).drop("_s")
    mean = [F.col("mean")[i] for i in range(4)]
    angle = g.rotation_angle(g.columns(*q), mean)
    spread = rows.join(sums.select(*keys, "mean"), keys).groupBy(*keys).agg((F.max(angle) * g.DEGREES).alias("spread_deg"))
    return sums.join(spread, keys)


def nearest_rotation(rotation: pd.Series) -> pd.Series:
    """Closest true rotation of nearly orthonormal 9-entry matrices."""
    table = np.stack([np.asarray(r, float).reshape(3, 3) for r in rotation])
    u, _, vt = np.linalg.svd(table)
    return pd.Series((u @ vt).reshape(len(table), 9).tolist())
