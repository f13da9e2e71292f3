"""Joins on time: bracketing, nearest, last-known, greedy one-to-one, borrowed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.pin import pinned
from ..session import checkpointed
from .ordered import HOUR_NS, carried


def time_chunk(time: str, width: int) -> Column:
    return F.floor(F.col(time) / width)


def bracket(
    samples: DataFrame, references: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str],
    chunk_ns: int = HOUR_NS,
) -> DataFrame:
    """Each sample with `prev`, the reference strictly before it, and `next`, the one at or after it.

    Both sides travel in one union through chunked windows: one shuffle, no pairs.
    """
    left = samples.withColumn("_side", F.lit(0))
    right = references.select(
        *keys, time, F.lit(1).alias("_side"), F.struct(time, *fields).alias("_ref")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    ready = carried(
        both, keys, [time, "_side"], time_chunk(time, chunk_ns),
        before={"prev": "_ref"}, after={"next": "_ref"},
    )
    return ready.where("_side = 0").select(*samples.columns, "prev", "next")


def nearest_within(
    samples: DataFrame, references: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str],
    tolerance: float, chunk_ns: int = HOUR_NS,
) -> DataFrame:
    """Many-to-one nearest reference inside an inclusive tolerance; the earlier one on ties."""
    both = bracket(samples, references, keys, time, fields, chunk_ns)
    back, ahead = F.col(time) - F.col(f"prev.{time}"), F.col(f"next.{time}") - F.col(time)
    chosen = F.when(ahead.isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    gap = F.least(back, ahead)
    return both.withColumn("match", F.when(gap <= tolerance, chosen)).withColumn(
        "gap", F.when(gap <= tolerance, gap)
    ).drop("prev", "next")


def interpolate_poses(
    samples: DataFrame, poses: DataFrame, keys: Sequence[str], time: str,
    max_gap_ns: float = 1e8, same_ns: int = g.SAME_TIME_NS, chunk_ns: int = HOUR_NS,
) -> DataFrame:
    """Poses at sample times: as is within a microsecond, else blended between close neighbours.

    poses: keys, time, x, y, z, qx, qy, qz, qw. Adds p_x .. p_qw and `how` (exact, between, null).
    """
    position, turn = ("x", "y", "z"), ("qx", "qy", "qz", "qw")
    both = bracket(samples, poses, keys, time, [*position, *turn], chunk_ns)
    both = both.select(
        *samples.columns, *[F.col(f"{end}.{n}").alias(f"_{end}_{n}") for end in ("prev", "next") for n in (time, *position, *turn)]
    )
    ends = lambda end, names: g.columns(*[f"_{end}_{n}" for n in names])
    t, t0, t1 = F.col(time), F.col(f"_prev_{time}"), F.col(f"_next_{time}")
    how = (
        F.when(t - t0 <= same_ns, "before").when(t1 - t <= same_ns, "after")
        .when((t1 - t0) <= max_gap_ns, "between")
    )
    product = g.dot(ends("prev", turn), ends("next", turn))
    both = pinned(both, {"_how": how, "_w": (t - t0) / (t1 - t0), "_dot": product})
    first, second = g.slerp_weights(F.abs("_dot"), F.col("_w"))
    both = pinned(both, {"_first": first, "_second": F.when(F.col("_dot") < 0, -second).otherwise(second)})
    raw = [F.col("_first") * a + F.col("_second") * b for a, b in zip(ends("prev", turn), ends("next", turn))]
    both = pinned(both, {f"_raw{i}": c for i, c in enumerate(raw)})
    blends = [(1 - F.col("_w")) * a + F.col("_w") * b for a, b in zip(ends("prev", position), ends("next", position))]
    blends += g.unit([F.col(f"_raw{i}") for i in range(4)])
    out = [
        F.when(F.col("_how") == "before", F.col(f"_prev_{n}"))
        .when(F.col("_how") == "after", F.col(f"_next_{n}"))
        .when(F.col("_how") == "between", blend).alias(f"p_{n}")
        for n, blend in zip((*position, *turn), blends)
    ]
    return both.select(
        *samples.columns, *out,
        F.when(F.col("_how") == "between", "between").when(F.col("_how").isNotNull(), "exact").alias("how"),
    )


def exact_matches(samples: DataFrame, references: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Samples with `matched`: whether a reference has the very same time."""
    marks = references.select(*keys, time).distinct().withColumn("matched", F.lit(True))
    return samples.join(marks, [*keys, time], "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    )


def associate_times(
    first: DataFrame, second: DataFrame, keys: Sequence[str], time: str, ids: tuple[str, str],
    tolerance: float, chunk_ns: int = HOUR_NS,
) -> DataFrame:
    """Greedy one-to-one nearest-time pairs, smallest (gap, first, second) taken first.

    Taking every mutually best pair at once gives the same result as walking the sorted candidates.
    Each round looks only at the nearest free row before and after, so dense streams emit no
    candidate pairs. Rows whose nearest free partner is out of reach leave the game; rounds go on until
    none finds a pair.
    """
    keys = list(keys)
    a = first.select(*keys, F.col(time).alias("_t"), F.col(ids[0]).alias("_id"), F.lit(0).alias("_side"))
    b = second.select(*keys, F.col(time).alias("_t"), F.col(ids[1]).alias("_id"), F.lit(1).alias("_side"))
    free = a.unionByName(b)
    pairs: DataFrame | None = None
    while True:
        mine = F.struct(F.col("_t").alias("t"), F.col("_id").alias("id"))
        seen = carried(
            free, keys, ["_t", "_side"], time_chunk("_t", chunk_ns),
            before={"_a0": F.when(F.col("_side") == 0, mine), "_b0": F.when(F.col("_side") == 1, mine)},
            after={"_a1": F.when(F.col("_side") == 0, mine), "_b1": F.when(F.col("_side") == 1, mine)},
        )
        other0 = F.when(F.col("_side") == 0, F.col("_b0")).otherwise(F.col("_a0"))
        other1 = F.when(F.col("_side") == 0, F.col("_b1")).otherwise(F.col("_a1"))
        back, ahead = F.col("_t") - other0["t"], other1["t"] - F.col("_t")
        best = F.when(ahead.isNull() | (back <= ahead), other0).otherwise(other1)
        seen = seen.select(*keys, "_t", "_id", "_side", best.alias("_best")).where(
            F.abs(F.col("_best.t") - F.col("_t")) <= tolerance
        )
        seen = checkpointed(seen)
        wishes = seen.where("_side = 1").select(
            *keys, F.col("_id").alias("_j"), F.col("_best.id").alias("_i"), F.col("_t").alias("_tj")
        )
        mutual = seen.where("_side = 0").select(
            *keys, F.col("_id").alias("_i"), F.col("_best.id").alias("_j"), F.col("_t").alias("_ti")
        ).join(wishes, [*keys, "_i", "_j"])
        mutual = checkpointed(mutual)
        if mutual.isEmpty():
            break
        pairs = mutual if pairs is None else pairs.unionByName(mutual)
        taken = mutual.select(*keys, F.col("_i").alias("_id"), F.lit(0).alias("_side")).unionByName(
            mutual.select(*keys, F.col("_j").alias("_id"), F.lit(1).alias("_side"))
        )
        free = seen.drop("_best").join(taken, [*keys, "_id", "_side"], "left_anti")
    if pairs is None:
        pairs = mutual
    return pairs.select(
        *keys, F.col("_i").alias(ids[0]), F.col("_j").alias(ids[1]),
        F.abs(F.col("_ti") - F.col("_tj")).alias("gap"),
    )


def last_anchor(
    frames: DataFrame, anchors: DataFrame, keys: Sequence[str], seq: str, chunk: int = 4096
) -> DataFrame:
    """Each frame with `keyframe`, the newest anchor created at or before it."""
    created = anchors.where("kind = 'created'").select(
        *keys, seq, F.lit(0).alias("_side"), F.col("anchor_id").alias("_anchor")
    )
    both = frames.withColumn("_side", F.lit(1)).unionByName(created, allowMissingColumns=True)
    ready = carried(
        both, keys, [seq, "_side"], F.floor(F.col(seq) / chunk), before={"keyframe": "_anchor"}
    )
    return ready.where("_side = 1").drop("_side", "_anchor")


def latest_anchor_poses(anchors: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The newest pose of every anchor that was created; corrections of unknown anchors are ignored."""
    known = anchors.where("kind = 'created'").select(*keys, "anchor_id", F.col(seq).alias("_born"))
    latest = anchors.join(known, [*keys, "anchor_id"]).where(F.col(seq) >= F.col("_born"))
    order = F.struct(F.col(seq), F.when(F.col("kind") == "created", 0).otherwise(1))
    return latest.groupBy(*keys, "anchor_id").agg(
        F.max_by("pose", order).alias("pose_now"), F.count("*").alias("events")
    )


def borrow_nearest(
    rows: DataFrame, keys: Sequence[str], index: str, value: str, chunk: int = 4096
) -> DataFrame:
    """Fill null values from the nearest indexed row that has one; the lower index on ties."""
    boxed = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    both = carried(
        rows, keys, [index], F.floor(F.col(index) / chunk), before={"_prev": boxed}, after={"_next": boxed}
    )
    back, ahead = F.col(index) - F.col("_prev.i"), F.col("_next.i") - F.col(index)
    chosen = F.when(ahead.isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    return both.withColumn("borrowed", chosen["v"]).withColumn("from_index", chosen["i"]).drop("_prev", "_next")


def interpolate_missing(
    rows: DataFrame, keys: Sequence[str], index: str, value: str, chunk: int = 4096
) -> DataFrame:
    """Fill null values linearly between the neighbours that have one, flat beyond the ends."""
    boxed = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    both = carried(
        rows, keys, [index], F.floor(F.col(index) / chunk), before={"_prev": boxed}, after={"_next": boxed}
    )
    span = F.col("_next.i") - F.col("_prev.i")
    weight = (F.col(index) - F.col("_prev.i")) / F.when(span != 0, span)
    between = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * F.coalesce(weight, F.lit(0.0))
    return both.withColumn(
        "filled", F.coalesce(F.when(F.col("_prev").isNull(), F.col("_next.v")), F.when(F.col("_next").isNull(), F.col("_prev.v")), between)
    ).drop("_prev", "_next")


def lag_pairs(frames: DataFrame, keys: Sequence[str], ordinal: str, lags: Sequence[int], fields: Sequence[str]) -> DataFrame:
    """Each frame beside the frame `lag` places earlier in the same origin keys; null when there is none."""
    earlier = frames.select(
        *keys, F.col(ordinal).alias("_o"), F.struct(*fields).alias("earlier")
    )
    wanted = frames.withColumn("lag", F.explode(F.array(*[F.lit(int(n)) for n in lags])))
    wanted = wanted.withColumn("_o", F.col(ordinal) - F.col("lag"))
    return wanted.join(earlier, [*keys, "_o"], "left").drop("_o")
