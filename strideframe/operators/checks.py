"""Data-quality and lineage checks: every broken rule is a row, nothing stops the job."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as b
from ..session import checkpointed
from .ordered import carried
from .timejoin import exact_matches


def violations(rows: DataFrame, keys: Sequence[str], rules: Mapping[str, Column], name: str = "rule") -> DataFrame:
    """One row per broken rule; a rule that evaluates to null counts as kept."""
    broken = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(label)) for label, rule in rules.items()])
    return rows.select(*keys, F.explode(F.array_compact(broken)).alias(name))


def frame_rules(quaternion: Sequence[Column]) -> dict[str, Column]:
    """Rules of a frame row with tracking, has_pose, fx, fy, point_count, depth_bytes, width and height."""
    norm = F.sqrt(sum((c * c for c in quaternion[1:]), quaternion[0] * quaternion[0]))
    return {
        "pose_tracking": F.col("has_pose") != (F.col("tracking") == "TRACKING"),
        "quaternion": F.col("has_pose") & (F.abs(norm - 1) > 1e-3),
        "intrinsics": (F.col("fx") <= 0) | (F.col("fy") <= 0),
        "points_without_pose": (F.col("point_count") > 0) & ~F.col("has_pose"),
        "depth_size": F.col("depth_bytes") != F.col("width") * F.col("height") * 3,
    }


def point_rule(u: Column, v: Column, seen_u: Column, seen_v: Column, limit_px: float = 0.5) -> dict[str, Column]:
    return {"projection": F.hypot(u - seen_u, v - seen_v) > limit_px}


def missing_numbers(rows: DataFrame, keys: Sequence[str], seq: str, chunk: int = 4096) -> DataFrame:
    """Numbers absent between 0 and the largest one present."""
    present = rows.select(*keys, seq).distinct()
    steps = carried(present, keys, [seq], F.floor(F.col(seq) / chunk), lag={"_prev": seq})
    first, last = F.coalesce(F.col("_prev"), F.lit(-1)) + 1, F.col(seq) - 1
    return steps.where(first <= last).select(*keys, F.explode(F.sequence(first, last)).alias("missing"))


def sequence_summary(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    # one row per (key, number) first, so a hot recording is counted in parallel
    numbers = rows.groupBy(*keys, seq).agg(F.count("*").alias("_n"))
    return numbers.groupBy(*keys).agg(
        F.sum("_n").alias("frames"), (F.max(seq) + 1 - F.count("*")).alias("missing"),
        (F.sum("_n") - F.count("*")).alias("repeated"),
    )


def acknowledged(rows: DataFrame, keys: Sequence[str], n: str, arrival: str, ends: Column | None = None) -> DataFrame:
    """Each message as stored, resend or gap by what was stored when it came; nothing new is stored after one that `ends`.

    Whether a number is stored depends on every arrival before it, so a recording's messages stream through one
    task in that order; it holds the last stored number only. A message without a number is a gap.
    """
    keys = list(keys)
    columns = rows.columns
    marked = rows.withColumn("_ends", F.lit(False) if ends is None else F.coalesce(ends, F.lit(False)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recording, through, ended = None, -1, False
        for batch in batches:
            owners = zip(*[batch.column(k).to_pylist() for k in keys])
            states = []
            for owner, number, last in zip(owners, batch.column(n).to_pylist(), batch.column("_ends").to_pylist()):
                if owner != recording:
                    recording, through, ended = owner, -1, False
                if number is not None and number <= through:
                    states.append("resend")
                elif number == through + 1 and not ended:
                    through, ended = number, last
                    states.append("stored")
                else:
                    states.append("gap")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(states, pa.string())], [*columns, "state"])

    ordered = marked.repartition(*keys).sortWithinPartitions(*keys, arrival, n)
    return ordered.mapInArrow(walk, T.StructType([*rows.schema.fields, T.StructField("state", T.StringType())]))


def time_reversals(
    rows: DataFrame, keys: Sequence[str], arrival: str, time: str, sensors: Sequence[str], chunk: int = 1_000_000
) -> DataFrame:
    """Samples earlier than the one before them, and samples of an unknown sensor."""
    steps = carried(rows, keys, [arrival], F.floor(F.col(arrival) / chunk), lag={"_prev": time})
    return violations(
        steps, [*keys, arrival],
        {"reversal": F.col(time) < F.col("_prev"), "sensor": ~F.col("sensor").isin(*sensors)},
    )


def recording_problems(
    recordings: DataFrame, stamps: DataFrame, settings: DataFrame, tracked: DataFrame,
    seq: str = "seq", time: str = "t_ns", tolerance_ns: float = 1e9, minimum_match: float = 0.5, chunk: int = 4096,
) -> DataFrame:
    """Everything that keeps a recording from being used as it is, with an amount per problem.

    recordings(recording, start_ns, end_ns); stamps(recording, stream, seq, t_ns);
    settings(recording, t_ns) and tracked(recording, t_ns) must match camera stamps exactly.
    """
    no_end = recordings.where("end_ns is null").select("recording", F.lit("no_end").alias("problem"), F.lit(1.0).alias("amount"))
    steps = carried(
        stamps, ["recording", "stream"], [seq], F.floor(F.col(seq) / chunk), lag={"_prev": time}
    ).where(F.col(time) <= F.col("_prev"))
    order = steps.groupBy("recording", "stream").agg(F.count("*").cast("double").alias("amount")).select(
        "recording", F.concat(F.col("stream"), F.lit("_order")).alias("problem"), "amount"
    )
    firsts = stamps.groupBy("recording", "stream").agg(F.min_by(time, seq).alias("_first")).join(recordings, "recording")
    off = F.col("_first") - F.col("start_ns")
    base = firsts.where(F.abs(off) > tolerance_ns).select(
        "recording", F.concat(F.col("stream"), F.lit("_clock")).alias("problem"), (off / 1e9).alias("amount")
    )
    images = stamps.where("stream = 'camera'").select("recording", time)
    bare = exact_matches(images, settings, ["recording"], time).where("not matched").groupBy("recording").agg(
        F.count("*").cast("double").alias("amount")
    ).select("recording", F.lit("no_settings").alias("problem"), "amount")
    share = exact_matches(tracked, images, ["recording"], time).groupBy("recording").agg(
        F.avg(F.col("matched").cast("double")).alias("amount")
    ).where(F.col("amount") < minimum_match).select("recording", F.lit("tracker_match").alias("problem"), "amount")
    return no_end.unionByName(order).unionByName(base).unionByName(bare).unionByName(share)


def membership_diff(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Keys present on one side only."""
    a, c = left.select(key).distinct(), right.select(key).distinct()
    return a.join(c, key, "left_anti").withColumn("only_in", F.lit(names[0])).unionByName(
        c.join(a, key, "left_anti").withColumn("only_in", F.lit(names[1]))
    )


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def revision_problems(revisions: DataFrame, origin: Sequence[str], node: str, parent: str, group: int = 4096) -> DataFrame:
    """Origins without exactly one root, parents outside the origin, and chains that never reach a root.

    Chains stay in their origin. Origins of at most `group` revisions pass by in order and are followed in arrays, many at
    a time; a larger origin is followed by rounds of joins. Either way pointers double, so that after k rounds one spans
    2^k revisions, and no chain without a cycle outlasts the revisions of its origin.
    """
    origin = list(origin)
    nodes = revisions.select(*origin, F.col(node).alias("_node"), F.col(parent).alias("_parent"))
    sizes = nodes.groupBy(*origin).agg(F.count(F.when(F.col("_parent").isNull(), 1)).alias("_roots"), F.count("*").alias("_n"))
    wrong_roots = sizes.where("_roots <> 1").select(*origin, F.lit(None).cast("long").alias(node), F.lit("roots").alias("problem"))
    large = checkpointed(sizes.where(F.col("_n") > group).select(*origin, "_n"))
    ordered = nodes if large.isEmpty() else nodes.join(large.select(*origin), origin, "left_anti")
    # numbers stay whole only where no null makes doubles of them
    ordered = ordered.select(*origin, "_node", F.col("_parent").isNotNull().alias("_held"), F.coalesce("_parent", F.lit(0)).alias("_parent"))
    ordered = ordered.repartition(*origin).sortWithinPartitions(*origin)
    schema = T.StructType([*nodes.select(*origin, "_node").schema, T.StructField("problem", T.StringType())])
    found = ordered.mapInPandas(_chain_walker(origin), schema).withColumnRenamed("_node", node)
    if large.isEmpty():
        return wrong_roots.unionByName(found)
    return wrong_roots.unionByName(found).unionByName(_chains_in_rounds(nodes.join(large.select(*origin), origin, "left_semi"), origin, node, large))


def _chain_walker(origin: Sequence[str]):
    """Problems of origins that pass by in order; the last origin of a batch waits for the next batch."""

    def problems(rows: pd.DataFrame) -> pd.DataFrame:
        owner = rows.groupby(list(origin), sort=False, dropna=False).ngroup().to_numpy()
        held = rows["_held"].to_numpy()
        place, known = pd.factorize(pd.MultiIndex.from_arrays([owner, rows["_node"]]))
        at = known.get_indexer(pd.MultiIndex.from_arrays([owner, rows["_parent"]]))
        at[~held | rows[list(origin)].isna().any(axis=1).to_numpy()] = -1
        if len(known) == len(rows):
            to = np.append(np.where(at < 0, len(rows), at), len(rows))
            for _ in range(int(np.bincount(owner).max()).bit_length() + 1):
                to = to[to]
            endless = to[:-1] < len(rows)
        else:
            # a repeated revision is grounded by any of its rows
            grounded = np.zeros(len(known) + 1, bool)
            grounded[-1], before = True, -1
            while grounded.sum() != before:
                before = grounded.sum()
                grounded[place[grounded[at]]] = True
            endless = ~grounded[place]
        found = ((held & (at < 0), "missing_parent"), (endless, "cycle"))
        return pd.concat([rows.loc[mask, [*origin, "_node"]].assign(problem=name) for mask, name in found])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending = None
        for batch in batches:
            batch = pd.concat([pending, batch], ignore_index=True) if pending is not None else batch.reset_index(drop=True)
            if not len(batch):
                continue
            last = pd.Series(True, batch.index)
            for k in origin:
                last &= (batch[k] == batch[k].iloc[-1]) | (batch[k].isna() & pd.isna(batch[k].iloc[-1]))
            pending = batch[last]
            if not last.all():
                yield problems(batch[~last].reset_index(drop=True))
        if pending is not None and len(pending):
            yield problems(pending.reset_index(drop=True))

    return walk


def _chains_in_rounds(nodes: DataFrame, origin: Sequence[str], node: str, sizes: DataFrame) -> DataFrame:
    """Missing parents and cycles of large origins by pointer doubling."""
    known = nodes.select(*origin, F.col("_node").alias("_parent"))
    lost = nodes.where("_parent is not null").join(known, [*origin, "_parent"], "left_anti")
    missing = lost.select(*origin, F.col("_node").alias(node), F.lit("missing_parent").alias("problem"))
    jumps = checkpointed(nodes.join(known, [*origin, "_parent"], "left_semi").select(*origin, "_node", F.col("_parent").alias("_to")))
    longest = sizes.agg(F.max("_n")).first()[0]
    for _ in range(ceil(log2(longest + 2)) + 1):
        onward = jumps.select(*origin, F.col("_node").alias("_to"), F.col("_to").alias("_next"))
        jumps = checkpointed(jumps.join(onward, [*origin, "_to"]).select(*origin, "_node", F.col("_next").alias("_to")))
        if jumps.isEmpty():
            break
    cycles = jumps.select(*origin, F.col("_node").alias(node), F.lit("cycle").alias("problem"))
    return missing.unionByName(cycles)


def split_leaks(rows: DataFrame, key: str, partition: str) -> DataFrame:
    """Keys that appear in more than one partition."""
    seen = rows.groupBy(key, partition).agg(F.count("*").alias("_n"))
    return seen.groupBy(key).agg(F.count("*").alias("partitions"), F.sum("_n").alias("rows")).where("partitions > 1")


def derived_leaks(rows: DataFrame, node: str, parent: str, partition: str) -> DataFrame:
    """Derived rows whose source is absent, in another partition, or themselves."""
    sources = rows.select(F.col(node).alias("_p"), F.col(partition).alias("_pp"))
    derived = rows.where(F.col(parent).isNotNull()).join(sources, F.col(parent) == F.col("_p"), "left")
    reason = (
        F.when(F.col(parent) == F.col(node), "itself").when(F.col("_p").isNull(), "absent")
        .when(F.col("_pp") != F.col(partition), "partition")
    )
    return derived.withColumn("problem", reason).where("problem is not null").select(node, parent, "problem")


def revisit_problems(revisits: DataFrame, frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Revisit rows with the first rule they break, or null.

    revisits(session, instance, before_seq, gap_seq, return_seq); frames(session, seq, t_ns, complete);
    labels(session, seq, instance).
    """
    rows = revisits
    for name in ("before", "gap", "return"):
        found = frames.select(
            "session", F.col("seq").alias(f"{name}_seq"), F.col("t_ns").alias(f"_{name}_t"),
            F.col("complete").alias(f"_{name}_complete"),
        )
        marked = labels.select("session", F.col("seq").alias(f"{name}_seq"), "instance").distinct().withColumn(
            f"_{name}_label", F.lit(True)
        )
        rows = rows.join(found, ["session", f"{name}_seq"], "left").join(
            marked, ["session", f"{name}_seq", "instance"], "left"
        )
    has = lambda n: F.coalesce(F.col(f"_{n}_label"), F.lit(False))
    present = F.col("_before_t").isNotNull() & F.col("_gap_t").isNotNull() & F.col("_return_t").isNotNull()
    return rows.withColumn(
        "problem",
        F.when(~present, "frames")
        .when(~((F.col("_before_t") < F.col("_gap_t")) & (F.col("_gap_t") < F.col("_return_t"))), "order")
        .when(~has("before") | ~has("return") | has("gap"), "labels")
        .when(~F.col("_gap_complete"), "coverage"),
    ).select(*revisits.columns, "problem")


def inventory_diff(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Files against a manifest of (key, bytes, sha256): missing, extra or changed."""
    a = files.select(key, F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    m = manifest.select(key, F.col("bytes").alias("_mb"), F.col("sha256").alias("_ms"))
    return a.join(m, key, "full_outer").withColumn(
        "problem",
        F.when(F.col("_s").isNull(), "missing").when(F.col("_ms").isNull(), "extra")
        .when((F.col("_s") != F.col("_ms")) | (F.col("_b") != F.col("_mb")), "changed"),
    ).where("problem is not null").select(key, "problem")


def status_report(checks: DataFrame, keys: Sequence[str], statuses: Sequence[str] = ("PASS", "FAIL", "SKIPPED")) -> DataFrame:
    """Counts per status with the number of checks that break the report rules."""
    unknown = ~F.col("status").isin(*statuses)
    silent = (F.col("status") != "PASS") & (F.coalesce(F.col("reason"), F.lit("")) == "")
    return checks.groupBy(*keys, "status").agg(
        F.count("*").alias("checks"), F.count(F.when(unknown, 1)).alias("unknown_status"),
        F.count(F.when(silent & ~unknown, 1)).alias("without_reason"),
    )


def fingerprint(rows: DataFrame, keys: Sequence[str], position: str, text: Column) -> DataFrame:
    """Order-aware fingerprint of a group's items as a sum of item digests.

    A sum merges on the map side, so no task ever holds a group's items. The position is part of
    each digest, which makes the order count.
    """
    digest = F.sha2(F.concat_ws(":", F.col(position).cast("string"), text), 256)
    part = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(*keys, part.alias("_d")).groupBy(*keys).agg(
        F.count("*").alias("items"), F.sum("_d").alias("_sum")
    ).select(
        *keys, "items",
        F.sha2(F.concat_ws(":", F.col("items").cast("string"), F.col("_sum").cast("decimal(38,0)").cast("string")), 256).alias("fingerprint"),
    )


def table_differences(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Rows, with repeats, held by one table only."""
    columns = left.columns
    return left.exceptAll(right.select(columns)).withColumn("only_in", F.lit(names[0])).unionByName(
        right.select(columns).exceptAll(left).withColumn("only_in", F.lit(names[1]))
    )


def ledger_problems(observations: DataFrame, owners: DataFrame, session: Sequence[str]) -> DataFrame:
    """Replays that changed their payload, and matches to an object unknown in their session.

    observations(observation_id, *session, payload, outcome, object_id); owners(*session, object_id).
    """
    digests = observations.select("observation_id", F.sha2("payload", 256).alias("_sha")).distinct()
    changed = digests.groupBy("observation_id").agg(F.count("*").alias("_n")).where("_n > 1").select(
        "observation_id", F.lit("payload").alias("problem")
    )
    matched = observations.where("outcome = 'matched'").select("observation_id", *session, "object_id").distinct()
    stray = matched.join(owners.select(*session, "object_id").distinct(), [*session, "object_id"], "left_anti").select(
        "observation_id", F.lit("owner").alias("problem")
    )
    return changed.unionByName(stray)


def proposal_counts(boxes: DataFrame, keys: Sequence[str], width: float, height: float, classes: Sequence[str]) -> DataFrame:
    """Proposals kept and rejected per image, by reason; none is hidden."""
    reason = (
        F.when(~b.valid(b.box(), width, height), "box").when(~F.col("cls").isin(*classes), "class")
        .when(~F.col("confidence").between(0.0, 1.0), "score").otherwise("kept")
    )
    return boxes.groupBy(*keys, reason.alias("verdict")).agg(F.count("*").alias("proposals"))


def camera_matches(captures: DataFrame, records: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """Each capture with its one camera record, or the reason its geometry is unusable.

    records(key, x1, y1, x2, y2): the sensor rectangle must lie inside the full one.
    """
    tallied = records.groupBy(key).agg(
        F.count("*").alias("records"), *[F.max(n).alias(n) for n in ("x1", "y1", "x2", "y2")]
    )
    return captures.join(tallied, key, "left").withColumn(
        "reason",
        F.when(F.col("records").isNull(), "no_record").when(F.col("records") > 1, "many_records")
        .when(~b.valid(b.box(), width, height), "rectangle"),
    ).withColumn("records", F.coalesce("records", F.lit(0)))
