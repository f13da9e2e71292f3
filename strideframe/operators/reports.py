"""Run reports: session summaries, stage measures, comparisons and walk accuracy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import carried

# facts two measures must share before their values may be compared, fixed order
COMPARED = ("dataset", "input_mode", "scope_sha", "reference_sha", "coverage", "unit", "better")


def session_summary(frames: DataFrame, hellos: DataFrame, stops: DataFrame) -> DataFrame:
    """Counts, bytes and rate of what each recording stored, one aggregate per log.

    frames(recording, seq, t_ns, has_tracker, tracking, bytes); hellos(recording, seq, offset_ms);
    stops(recording, stop_ns) only for recordings that stopped cleanly.
    """
    flag = lambda c: F.count(F.when(F.col(c), 1))
    per_number = frames.groupBy("recording", "seq").agg(
        F.count("*").alias("_n"), flag("has_tracker").alias("_h"), flag("tracking").alias("_t"), F.sum("bytes").alias("_b"),
        F.min("t_ns").alias("_lo"), F.max("t_ns").alias("_hi"),
    )
    stored = per_number.groupBy("recording").agg(
        F.sum("_n").alias("frames_n"), F.sum("_h").alias("with_tracker"), F.sum("_t").alias("tracking"),
        (F.max("seq") + 1 - F.count("*")).alias("missing"), F.min("_lo").alias("_t0"), F.max("_hi").alias("_t1"), F.sum("_b").alias("_bytes"),
    )
    greeted = hellos.groupBy("recording").agg(F.count("*").alias("connections"), F.max_by("offset_ms", "seq").alias("offset_ms"))
    span = (F.col("_t1") - F.col("_t0")) / 1e9
    return stored.join(greeted, "recording", "left").join(stops, "recording", "left").select(
        "recording", "frames_n", "with_tracker", "tracking", "missing", F.coalesce("connections", F.lit(0)).alias("connections"),
        (F.col("_bytes") / 1e6).alias("megabytes"), F.when(span > 0, F.col("_bytes") / 1e6 / span).otherwise(0.0).alias("megabytes_per_second"),
        "offset_ms", ((F.col("_t1") - F.col("stop_ns")) / 1e9).alias("after_stop_s"),
    )


def compare_measures(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str] = ("stage", "method", "name")) -> DataFrame:
    """Two measure tables side by side with a verdict, or the reasons they cannot be compared."""
    keys = list(keys)
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("value", *COMPARED)], F.lit(True).alias(f"_{p}"))
    rows = side(baseline, "a").join(side(candidate, "b"), keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differing = [F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in COMPARED]
    absent = [
        F.when(F.col("_a").isNull(), "not in baseline"), F.when(F.col("_b").isNull(), "not in candidate"),
        F.when(both & F.col("a_value").isNull(), "no baseline value"), F.when(both & F.col("b_value").isNull(), "no candidate value"),
    ]
    rows = rows.withColumn("reasons", F.concat_ws(", ", *absent, *differing))
    change = F.col("b_value") - F.col("a_value")
    better = ((F.col("a_better") == "lower") & (change < 0)) | ((F.col("a_better") == "higher") & (change > 0))
    verdict = (
        F.when(F.col("reasons") != "", "not comparable").when(change == 0, "same")
        .when(F.col("a_better") == "neither", "changed").when(better, "better").otherwise("worse")
    )
    return rows.select(*keys, "a_value", "b_value", F.when(F.col("reasons") == "", change).alias("change"), verdict.alias("verdict"), "reasons")


def stage_measures(
    scores: DataFrame, keys: Sequence[str], units: Mapping[str, str], stages: Sequence[str], reason: Column
) -> DataFrame:
    """Scores as long measures with units; a null value carries a reason, a stage without any is listed as unavailable."""
    keys = list(keys)
    entries = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), F.lit(u).alias("unit")) for n, u in units.items()
    ])
    long = scores.withColumn("_e", F.explode(entries)).select(
        *keys, "stage", "_e.name", "_e.value", "_e.unit", F.when(F.col("_e.value").isNull(), reason).alias("reason")
    )
    runs = scores.select(*keys).distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    return runs.join(long, [*keys, "stage"], "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("name").isNull(), "stage unavailable"))
    )


def repeated_measures(measures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measure names that are not unique in their section."""
    return measures.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def walk_accuracy(frames: DataFrame, measured: DataFrame, key: str = "recording", chunk: int = 4096) -> DataFrame:
    """Tracking facts of each walk: path, lost events, corrections, missing numbers and longest gap.

    frames(key, seq, t_ns, x, y, z, posed, corrections); measured is joined by `loop_closure`.
    """
    place = F.when(F.col("posed"), F.struct("x", "y", "z"))
    steps = carried(
        frames.withColumn("_p", place), [key], ["seq"], F.floor(F.col("seq") / chunk),
        lag={"_prev": "_p", "_seq": "seq", "_t": "t_ns"},
    )
    step = F.sqrt(sum(((F.col(c) - F.col(f"_prev.{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("_prev.x")) ** 2))
    return steps.groupBy(key).agg(
        F.count("*").alias("frames_n"), F.avg(F.col("posed").cast("double")).alias("tracked_fraction"),
        F.count(F.when(~F.col("posed") & F.col("_prev").isNotNull(), 1)).alias("lost_events"),
        F.sum(F.when(F.col("posed"), step)).alias("path_m"), F.sum("corrections").alias("corrections"),
        F.sum(F.col("seq") - F.col("_seq") - 1).alias("missing_numbers"), (F.max(F.col("t_ns") - F.col("_t")) / 1e9).alias("longest_gap_s"),
    )


def loop_closure(frames: DataFrame, loops: DataFrame, key: str = "recording") -> DataFrame:
    """Distance and turn left between a loop's first and last posed frame, against its taped length.

    loops(key, start_seq, end_seq, tape_m); frames(key, seq, x, y, z, qx, qy, qz, qw, posed).
    """
    turn = ("qx", "qy", "qz", "qw")
    end = lambda name: frames.where("posed").select(
        key, F.col("seq").alias(f"{name}_seq"), F.struct("x", "y", "z", *turn).alias(f"_{name}")
    )
    rows = loops.join(end("start"), [key, "start_seq"], "left").join(end("end"), [key, "end_seq"], "left")
    gap = F.sqrt(sum(((F.col(f"_end.{c}") - F.col(f"_start.{c}")) ** 2 for c in "yz"), (F.col("_end.x") - F.col("_start.x")) ** 2))
    product = sum((F.col(f"_end.{c}") * F.col(f"_start.{c}") for c in turn[1:]), F.col("_end.qx") * F.col("_start.qx"))
    angle = F.degrees(2 * F.acos(F.least(F.abs(product), F.lit(1.0))))
    return rows.select(
        key, (gap * 1000).alias("closure_mm"), (gap / F.col("tape_m") * 100).alias("closure_percent"), angle.alias("turn_error_deg"),
        F.when(F.col("_start").isNull() | F.col("_end").isNull(), "checkpoint not tracked").alias("reason"),
    )


def tape_distances(frames: DataFrame, tapes: DataFrame, key: str = "recording") -> DataFrame:
    """Estimated against taped distance between two posed frames."""
    end = lambda name: frames.where("posed").select(key, F.col("seq").alias(f"{name}_seq"), F.struct("x", "y", "z").alias(f"_{name}"))
    rows = tapes.join(end("from"), [key, "from_seq"]).join(end("to"), [key, "to_seq"])
    gap = F.sqrt(sum(((F.col(f"_to.{c}") - F.col(f"_from.{c}")) ** 2 for c in "yz"), (F.col("_to.x") - F.col("_from.x")) ** 2))
    return rows.select(
        *tapes.columns, gap.alias("estimated_m"), ((gap - F.col("tape_m")) * 1000).alias("signed_error_mm"),
        (F.abs(gap - F.col("tape_m")) / F.col("tape_m") * 100).alias("absolute_error_percent"),
    )


def distance_bin(nearest: Column) -> Column:
    """Bins of the distance to the nearest same-class object, fixed values."""
    return F.when(nearest.isNull(), "none").when(nearest < 0.7, "0.35-0.7 m").when(nearest < 1.5, "0.7-1.5 m").otherwise("over 1.5 m")


def count_report(rows: DataFrame, run: str) -> DataFrame:
    """Why a run counted what it did: new identities by distance and confidence, identities by sightings.

    rows(run, label, confidence, outcome, object_id, nearest_same_class_m). Output rows are (run, table, bucket, n).
    """
    new = F.col("outcome") == "new"
    bucket = F.array_compact(F.array(
        F.struct(F.lit("detections").alias("table"), F.lit("all").alias("bucket")),
        F.when(F.col("outcome").startswith("unresolved"), F.struct(F.lit("detections").alias("table"), F.lit("unresolved").alias("bucket"))),
        F.when(new, F.struct(F.lit("new_by_distance").alias("table"), distance_bin(F.col("nearest_same_class_m")).alias("bucket"))),
        F.when(new, F.struct(
            F.lit("new_by_confidence").alias("table"), F.when(F.col("confidence") < 0.5, "under 0.5").otherwise("0.5 and over").alias("bucket"))),
        F.when(new, F.struct(F.lit("counts").alias("table"), F.col("label").alias("bucket"))),
    ))
    direct = rows.select(run, F.explode(bucket).alias("_b")).groupBy(run, "_b.table", "_b.bucket").agg(F.count("*").alias("n"))
    seen = rows.where("object_id is not null").groupBy(run, "object_id").agg(
        F.count("*").alias("_n"), F.min(F.when(new, F.col("label"))).alias("_label")
    )
    times = F.when(F.col("_n") >= 3, "3 or more").otherwise(F.col("_n").cast("string"))
    sightings = seen.groupBy(run, F.lit("identities_by_sightings").alias("table"), times.alias("bucket")).agg(F.count("*").alias("n"))
    steady = seen.where("_n >= 3 and _label is not null").groupBy(run, F.lit("counts_seen_3_or_more").alias("table"), F.col("_label").alias("bucket")).agg(F.count("*").alias("n"))
    return direct.unionByName(sightings).unionByName(steady)
