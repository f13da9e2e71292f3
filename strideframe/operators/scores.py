"""Scores against reference depth, distances, masks and pooled reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lcg import mixed_values
from .ordered import carried, exact_quantiles, value_slices
from .scale import line_fit, usable

# distance bands in metres, fixed values; the last band is closed
BANDS = (("0-1m", 0.0, 1.0), ("1-2m", 1.0, 2.0), ("2-4m", 2.0, 4.0))
LAST_BAND_END = 4.0
METRICS = ("abs_rel", "rmse_m", "delta1")


def distance_totals(rows: DataFrame, keys: Sequence[str], distance: str, within: float) -> DataFrame:
    """Mergeable totals: count, mean, rmse, max and the share inside a threshold."""
    d = F.col(distance)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.avg(d).alias("mean_m"), F.sqrt(F.avg(d * d)).alias("rmse_m"),
        F.max(d).alias("max_m"), F.avg((d <= within).cast("double")).alias("within_share"),
    )


def _regions(reference: Column) -> Column:
    named = [F.when((reference >= lo) & ((reference < hi) if hi < LAST_BAND_END else (reference <= hi)), name) for name, lo, hi in BANDS]
    return F.array_compact(F.array(F.lit("overall"), *named))


def depth_scores(rows: DataFrame, keys: Sequence[str], predicted: str, reference: str) -> DataFrame:
    """Relative error, RMSE, share within 1.25 and coverage, overall and per distance band.

    A reference pixel without a valid prediction lowers coverage only.
    """
    p, r = F.col(predicted), F.col(reference)
    known = rows.where((r > 0) & ~F.isnan(r)).withColumn("region", F.explode(_regions(r)))
    ok = (p > 0) & ~F.isnan(p)
    error, ratio = F.when(ok, F.abs(p - r)), F.when(ok, F.greatest(p / r, r / p))
    return known.groupBy(*keys, "region").agg(
        F.count("*").alias("reference_pixels"), F.count(error).alias("scored_pixels"),
        F.avg(error / r).alias("abs_rel"), F.sqrt(F.avg(error * error)).alias("rmse_m"),
        F.avg((ratio < 1.25).cast("double")).alias("delta1"),
    ).withColumn("valid_coverage", F.col("scored_pixels") / F.col("reference_pixels"))


def pooled_scores(per_frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frame scores pooled by scored pixels, RMSE as a root of pooled squares, coverage by sums."""
    w = F.col("scored_pixels")
    mean = lambda c: F.sum(c * w) / F.sum(F.when(c.isNotNull(), w))
    return per_frame.groupBy(*keys).agg(
        F.sum("reference_pixels").alias("reference_pixels"), F.sum(w).alias("scored_pixels"),
        (F.sum(w) / F.sum("reference_pixels")).alias("valid_coverage"),
        mean(F.col("abs_rel")).alias("abs_rel"), F.sqrt(mean(F.col("rmse_m") * F.col("rmse_m"))).alias("rmse_m"),
        mean(F.col("delta1")).alias("delta1"),
    )


def ratio_quantiles(rows: DataFrame, keys: Sequence[str], ratio: Column, distance: Column, bins: Sequence[float]) -> DataFrame:
    """Quartiles of a ratio per key and half-open distance bin; empty groups do not appear."""
    low = None
    for lo, hi in zip(bins, bins[1:]):
        inside = (distance >= lo) & (distance < hi)
        low = F.when(inside, F.lit(lo)) if low is None else low.when(inside, F.lit(lo))
    binned = rows.withColumns({"from_m": low, "_ratio": ratio}).where("from_m is not null")
    return exact_quantiles(binned, [*keys, "from_m"], "_ratio", {"p25": 0.25, "median_ratio": 0.5, "p75": 0.75}, count="samples")


def scale_report(rows: DataFrame, frame_keys: Sequence[str]) -> DataFrame:
    """Per frame: median predicted / reference ratio, metric fit, and the error that fit leaves."""
    pairs = usable(rows).withColumn("_ratio", F.col("learned") / F.col("target"))
    ratio = exact_quantiles(pairs, frame_keys, "_ratio", {"scale_ratio": 0.5}, count="pairs")
    fit = line_fit(pairs, frame_keys, F.col("learned"), F.col("target")).drop("pairs")
    left = pairs.join(fit, list(frame_keys)).withColumn("_fit", F.col("factor") * F.col("learned") + F.col("shift"))
    error = left.where("_fit > 0").groupBy(*frame_keys).agg(
        F.avg(F.abs(F.col("_fit") - F.col("target")) / F.col("target")).alias("fitted_abs_rel")
    )
    enough = F.col("pairs") >= 2
    return ratio.join(fit, list(frame_keys)).join(error, list(frame_keys), "left").select(
        *frame_keys, "pairs", *[F.when(enough, F.col(c)).alias(c) for c in ("scale_ratio", "factor", "shift", "fitted_abs_rel")]
    )


def run_scale_summary(frames: DataFrame, keys: Sequence[str], index: str, chunk: int = 4096) -> DataFrame:
    """Smallest, median and largest frame ratio of a run and its median frame-to-frame log change."""
    known = frames.where("scale_ratio is not null").withColumn("_log", F.log("scale_ratio"))
    steps = carried(known, keys, [index], F.floor(F.col(index) / chunk), lag={"_prev": "_log"})
    steps = steps.withColumn("_change", F.abs(F.col("_log") - F.col("_prev")))
    ends = known.groupBy(*keys).agg(F.min("scale_ratio").alias("min_ratio"), F.max("scale_ratio").alias("max_ratio"))
    middle = exact_quantiles(known, keys, "scale_ratio", {"median_ratio": 0.5}, count="frames")
    change = exact_quantiles(steps, keys, "_change", {"median_frame_change": 0.5})
    return ends.join(middle, list(keys)).join(change, list(keys), "left")


def average_rank(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank with ties averaged, spread over value slices."""
    distinct = rows.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    placed = carried(value_slices(distinct, keys, value), keys, [value], F.col("_slice"), running={"_upto": "_ties"})
    ranks = placed.select(*keys, value, (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(name))
    return rows.join(ranks, [*keys, value])


def spearman(rows: DataFrame, keys: Sequence[str], a: str, b: str, minimum: int = 3) -> DataFrame:
    """Rank correlation per key; null under `minimum` pairs or for a constant series."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank(average_rank(pairs, keys, a, "_ra"), keys, b, "_rb")
    flat = (F.min("_ra") == F.max("_ra")) | (F.min("_rb") == F.max("_rb"))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.when((F.count("*") >= minimum) & ~flat, F.corr("_ra", "_rb")).alias("spearman")
    )


def jump_correlation(frames: DataFrame, keys: Sequence[str], index: str, scale: str, error: str, chunk: int = 4096) -> DataFrame:
    """Rank correlation of |log scale change| with |error change| between consecutive frames."""
    rows = frames.where(F.col(scale).isNotNull() & F.col(error).isNotNull()).withColumn("_log", F.log(scale))
    steps = carried(rows, keys, [index], F.floor(F.col(index) / chunk), lag={"_s": "_log", "_e": error})
    steps = steps.where("_s is not null").withColumns({
        "scale_change": F.abs(F.col("_log") - F.col("_s")), "error_change": F.abs(F.col(error) - F.col("_e")),
    })
    return spearman(steps, keys, "scale_change", "error_change")


def band_shares(rows: DataFrame, keys: Sequence[str], depth: str, bands: Sequence[float], flags: Sequence[str]) -> DataFrame:
    """Share of fused pixels per distance band, flagged shares inside it, and the share beyond the last band."""
    far = bands[-1]
    d = F.col(depth)
    valid = rows.where(d > 0)
    out = None
    for lo, hi in zip(bands, bands[1:]):
        inside = (d >= lo) & (d < hi)
        out = F.when(inside, F.lit(lo)) if out is None else out.when(inside, F.lit(lo))
    counted = valid.groupBy(*keys, out.alias("from_m")).agg(
        F.count("*").alias("pixels"), *[F.avg(F.col(f).cast("double")).alias(f"{f}_share") for f in flags]
    )
    totals = valid.groupBy(*keys).agg(
        F.count(F.when(d < far, 1)).alias("_fused"), F.count("*").alias("_valid")
    )
    return counted.where("from_m is not null").join(totals, list(keys)).select(
        *keys, "from_m", "pixels", (F.col("pixels") / F.col("_fused")).alias("fused_share"),
        *[f"{f}_share" for f in flags], (1 - F.col("_fused") / F.col("_valid")).alias("beyond_share"),
    )


def quantile_groups(rows: DataFrame, groups: Column, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """n, median, p10 and p90 of each measure per overlapping group (a row may belong to several)."""
    names = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    long = rows.withColumn("group", F.explode(groups)).withColumn("_m", F.explode(names)).select(
        *keys, "group", "_m.measure", "_m.value"
    )
    return exact_quantiles(long, [*keys, "group", "measure"], "value", {"median": 0.5, "p10": 0.1, "p90": 0.9}, count="n")


def mask_boundary(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask pixels with at least one 4-neighbour outside the mask."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    shown = mask.select(*keys, "prow", "pcol").withColumn("_s", F.explode(steps)).select(
        *keys, (F.col("prow") + F.col("_s.r")).alias("prow"), (F.col("pcol") + F.col("_s.c")).alias("pcol")
    ).groupBy(*keys, "prow", "pcol").agg(F.count("*").alias("_n"))
    return mask.select(*keys, "prow", "pcol").join(shown, [*keys, "prow", "pcol"], "left").where(
        F.coalesce("_n", F.lit(0)) < 4
    ).drop("_n")


def _grown(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    near = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    return pixels.withColumn("_s", F.explode(near)).select(
        *keys, (F.col("prow") + F.col("_s.r")).alias("prow"), (F.col("pcol") + F.col("_s.c")).alias("pcol")
    ).distinct()


def mask_scores(predicted: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask IoU and boundary F1 at one pixel of tolerance."""
    at = [*keys, "prow", "pcol"]
    both = predicted.select(*at, F.lit(1).alias("_p")).join(reference.select(*at, F.lit(1).alias("_r")), at, "full_outer")
    overlap = both.groupBy(*keys).agg(
        (F.count(F.when(F.col("_p").isNotNull() & F.col("_r").isNotNull(), 1)) / F.count("*")).alias("iou")
    )
    edge_p, edge_r = mask_boundary(predicted, keys), mask_boundary(reference, keys)
    share = lambda edge, other, name: edge.join(_grown(other, keys).withColumn("_hit", F.lit(1)), at, "left").groupBy(*keys).agg(
        (F.count("_hit") / F.count("*")).alias(name)
    )
    rows = overlap.join(share(edge_p, edge_r, "_precision"), list(keys), "left").join(share(edge_r, edge_p, "_recall"), list(keys), "left")
    p, r = F.coalesce("_precision", F.lit(0.0)), F.coalesce("_recall", F.lit(0.0))
    return rows.select(*keys, "iou", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("boundary_f1"))


def instance_events(predicted: DataFrame, reference: DataFrame, keys: Sequence[str], minimum: int = 1) -> DataFrame:
    """Predicted masks that cover several references (merges) and references cut into several masks (splits)."""
    at = [*keys, "prow", "pcol"]
    touching = predicted.select(*at, F.col("instance").alias("_p")).join(
        reference.select(*at, F.col("instance").alias("_r")), at
    ).groupBy(*keys, "_p", "_r").agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum)
    merges = touching.groupBy(*keys, "_p").agg(F.count("*").alias("_k")).groupBy(*keys).agg(
        F.count(F.when(F.col("_k") > 1, 1)).alias("merges")
    )
    splits = touching.groupBy(*keys, "_r").agg(F.count("*").alias("_k")).groupBy(*keys).agg(
        F.count(F.when(F.col("_k") > 1, 1)).alias("splits")
    )
    return merges.join(splits, list(keys), "full_outer").fillna(0, ["merges", "splits"])


def bootstrap_interval(
    rows: DataFrame, keys: Sequence[str], value: str, ordinal: str, replicates: int = 1000, seed: int = 0, draws: int = 1 << 20, block: int = 1 << 14
) -> DataFrame:
    """2.5 and 97.5 percent points of the mean over seeded resamples with replacement.

    A draw is a hash of its number, so spans of at most `draws` numbers are drawn without any rows. Their picks leave as
    two-byte places within blocks of `block` ordinals and meet the values of a block in one group; a group holds about
    `replicates` picks per value, whatever the size of its key. `ordinal` counts the rows of a key from 0.
    """
    keys = list(keys)
    rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(value).alias("mean"))
    spans = sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") * replicates - 1) / draws))).alias("_span"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *key, n, span in zip(*[batch[c].tolist() for c in (*keys, "_n", "_span")]):
                number = np.arange(span * draws, min((span + 1) * draws, n * replicates), dtype=np.int64)
                at = mixed_values(number, seed) % n
                home = at // block
                order = np.argsort(home, kind="stable")
                home, at, replicate = home[order], (at[order] % block).astype(np.uint16), number[order] // n
                edges = [0, *(np.nonzero(np.diff(home))[0] + 1).tolist(), len(home)]
                for start, end in zip(edges, edges[1:]):
                    first = int(replicate[start])
                    times = np.bincount(replicate[start:end] - first).astype(np.int32)
                    yield pd.DataFrame([(*key, int(home[start]), first, times.tobytes(), at[start:end].tobytes())], columns=[*keys, "_block", "_first", "_times", "_at"])

    def score(key: tuple, picked: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        x, here = np.zeros(block), np.zeros(block)
        x[values["_at"]], here[values["_at"]] = values["_v"].where(values["_here"], 0.0), values["_here"]
        total, count = np.zeros(replicates), np.zeros(replicates)
        for first, times, places in zip(picked["_first"], picked["_times"], picked["_at"]):
            times, at = np.frombuffer(times, np.int32), np.frombuffer(places, np.uint16)
            owner = np.repeat(np.arange(len(times)), times)
            stretch = slice(first, first + len(times))
            total[stretch] += np.bincount(owner, x[at], len(times))
            count[stretch] += np.bincount(owner, here[at], len(times))
        out = pd.DataFrame({"replicate": np.arange(replicates), "_total": total, "_count": count})
        return out.assign(**dict(zip(keys, key)))[[*keys, "replicate", "_total", "_count"]]

    picked = spans.repartition(tasks, *keys, "_span").mapInPandas(draw, f"{head}, _block long, _first long, _times binary, _at binary")
    place = F.col(ordinal).cast("long")
    values = rows.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.floor(place / block).alias("_block"), (place % block).alias("_at"),
        F.col(value).cast("double").alias("_v"), F.col(value).isNotNull().alias("_here"),
    )
    parts = picked.groupBy(*keys, "_block").cogroup(values.groupBy(*[f"_{k}" for k in keys], "_block")).applyInPandas(
        score, f"{head}, replicate long, _total double, _count double"
    )
    means = parts.groupBy(*keys, "replicate").agg((F.sum("_total") / F.expr("nullif(sum(_count), 0)")).alias("_m"))
    # one row per replicate: a fixed, small number per key
    ends = means.groupBy(*keys).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return sizes.select(*keys, "mean").join(ends, keys)


def gallery_rank(pairs: DataFrame, query: str, method: str, tie: float = 1e-6) -> DataFrame:
    """Per query and method: the top score, and whether its ties all agree on one identity.

    pairs(query, method, gallery, identity, score); a null score is an unavailable pair.
    """
    keys = [query, method]
    top = pairs.groupBy(*keys).agg(
        F.max("score").alias("top_score"), F.count(F.when(F.col("score").isNull(), 1)).alias("unavailable"), F.count("*").alias("gallery_size")
    )
    tied = pairs.join(top, keys).where(F.col("score") >= F.col("top_score") - tie)
    best = tied.groupBy(*keys).agg(
        F.count_distinct("identity").alias("_ids"), F.min("identity").alias("_id"), F.min("gallery").alias("_gallery")
    )
    return top.join(best, keys, "left").select(
        *keys, "top_score", "unavailable", "gallery_size",
        F.when(F.col("_ids") == 1, F.col("_id")).alias("identity"), F.coalesce(F.col("_ids") > 1, F.lit(False)).alias("ambiguous"),
    )


def identity_score(
    decisions: DataFrame, truth: DataFrame, keys: Sequence[str], order: str, chunk: int = 4096
) -> DataFrame:
    """Wrong merges (an object with several instances), wrong splits (an instance with several objects),
    correct associations, and movement between consecutive sightings of an instance.

    decisions(keys, observation_id, order, object_id, x, y, z); truth(observation_id, instance_id).
    """
    keys = list(keys)
    labelled = decisions.join(truth, "observation_id")
    pairs = labelled.where("object_id is not null").groupBy(*keys, "object_id", "instance_id").agg(F.count("*").alias("_n"))
    objects = pairs.groupBy(*keys, "object_id").agg(F.count("*").alias("_k"), F.sum("_n").alias("_rows"))
    merged = objects.groupBy(*keys).agg(
        F.sum("_rows").alias("matched"), F.count(F.when(F.col("_k") > 1, 1)).alias("wrong_merges"),
        F.sum(F.when(F.col("_k") == 1, F.col("_rows")).otherwise(0)).alias("correct"),
    )
    split = pairs.groupBy(*keys, "instance_id").agg(F.count("*").alias("_k")).groupBy(*keys).agg(
        F.count(F.when(F.col("_k") > 1, 1)).alias("wrong_splits")
    )
    placed = labelled.where("x is not null")
    steps = carried(
        placed, [*keys, "instance_id"], [order], F.floor(F.col(order) / chunk), lag={"_prev": F.struct("object_id", "x", "y", "z")}
    ).where("_prev is not null")
    moved = F.sqrt(sum(((F.col(c) - F.col(f"_prev.{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("_prev.x")) ** 2))
    same = F.col("_prev.object_id") == F.col("object_id")
    sightings = steps.groupBy(*keys).agg(
        F.count("*").alias("comparisons"), F.count(F.when(same, 1)).alias("same_object"), F.avg(moved).alias("mean_delta_m")
    )
    return merged.join(split, keys).join(sightings, keys, "left")
