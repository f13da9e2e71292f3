"""Counted objects across frames, association policies, and optimal box matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.assignment import best_pairs, near_equal, with_abstention
from ..session import checkpointed
from .graph import components
from .ordered import carried

MAX_DISTANCE_M, MARGIN_M = 0.35, 0.05
APPEARANCE_MIN, AMBIGUITY_GAP = 0.80, 0.05
VIEW_M, VIEW_DEG = 0.05, 10.0
GROUP_EDGES = 4096
CONDITIONS = ("geometry-last", "geometry-viewmedian", "appearance", "combined-last", "combined-viewmedian")


def optimal_pairs(
    edges: DataFrame, keys: Sequence[str], left: str, right: str, score: str, maximise: bool = True, group: int = GROUP_EDGES
) -> DataFrame:
    """Most pairs, then best total score, one-to-one per key.

    A key of at most `group` edges falls apart into components of mutually overlapping boxes where it is solved; those
    of a larger key are found by rounds of joins. Only a component is solved in one piece, keys and components pass by in order.
    """
    keys = list(keys)
    scored = checkpointed(edges.select(*keys, F.col(left).alias("_l"), F.col(right).alias("_r"), F.col(score).alias("_s")))
    large = checkpointed(scored.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > group).select(*keys))
    rows = scored.withColumn("_c", F.lit(""))
    if not large.isEmpty():
        crowded = checkpointed(scored.join(large, keys, "left_semi"))
        owner = F.struct(*keys)
        node = lambda side, tag: F.struct(owner.alias("g"), F.lit(tag).alias("t"), F.col(side).alias("v"))
        nodes = crowded.select(node("_l", 0).alias("id")).distinct().unionByName(crowded.select(node("_r", 1).alias("id")).distinct())
        links = components(nodes, crowded.select(node("_l", 0).alias("a"), node("_r", 1).alias("b")))
        tagged = crowded.withColumn("id", node("_l", 0)).join(links, "id").select(*keys, "_l", "_r", "_s", F.to_json("component").alias("_c"))
        rows = rows.join(large, keys, "left_anti").unionByName(tagged)
    run = [*keys, "_c"]
    ordered = rows.repartition(*run).sortWithinPartitions(*run)
    solved = ordered.mapInPandas(_solver(run, -1.0 if maximise else 1.0), scored.schema)
    return solved.select(*keys, F.col("_l").alias(left), F.col("_r").alias(right), F.col("_s").alias(score))


def _solver(run: Sequence[str], sign: float):
    """Best pairs of every stretch of rows that agree in `run`; a stretch may go on in the next batch."""

    def solve(rows: list[tuple]) -> list[tuple]:
        kept = []
        for part in _pieces(rows):
            if len(part) == 1:
                kept += part
                continue
            pairs, _ = best_pairs([(row[-3], row[-2], sign * row[-1]) for row in part])
            kept += [row for row in part if pairs.get(row[-3]) == row[-2]]
        return kept

    def walk(batches):
        mark, pending = None, []
        for batch in batches:
            done = []
            names = [c for c in batch.columns if c != "_c"]
            for key, row in zip(zip(*[batch[c].tolist() for c in run]), zip(*[batch[c].tolist() for c in names])):
                if key != mark:
                    done += solve(pending)
                    mark, pending = key, []
                pending.append(row)
            yield pd.DataFrame(done, columns=names)
        if pending:
            yield pd.DataFrame(solve(pending), columns=names)

    return walk


def _pieces(rows: list[tuple]) -> list[list[tuple]]:
    """Edges (..., left, right, score) by connected component."""
    up: dict[tuple, tuple] = {}

    def top(node: tuple) -> tuple:
        up.setdefault(node, node)
        while up[node] != node:
            up[node] = node = up[up[node]]
        return node

    for row in rows:
        up[top((0, row[-3]))] = top((1, row[-2]))
    parts: dict[tuple, list[tuple]] = {}
    for row in rows:
        parts.setdefault(top((0, row[-3])), []).append(row)
    return list(parts.values())


def detection_counts(
    pairs: DataFrame, found: DataFrame, known: DataFrame, absorbed: DataFrame, keys: Sequence[str], thresholds: Sequence[float], complete: Column
) -> DataFrame:
    """Matched, missed, false and crowd-ignored detections per key and threshold; precision and recall.

    pairs(keys, item, ref, iou) hold every candidate over the least threshold; `absorbed` lists detections
    inside a crowd. False detections, precision and recall need complete label coverage.
    """
    keys = list(keys)
    steps = F.array(*[F.lit(float(x)) for x in thresholds])
    wide = [*keys, "threshold"]
    levels = pairs.withColumn("threshold", F.explode(steps)).where(F.col("iou") >= F.col("threshold"))
    matched = optimal_pairs(levels, wide, "item", "ref", "iou")
    hits = matched.groupBy(*wide).agg(F.count("*").alias("matched"), F.sum("iou").alias("iou_sum"))
    lone = absorbed.withColumn("threshold", F.explode(steps)).join(matched.select(*wide, "item"), [*wide, "item"], "left_anti")
    ignored = lone.groupBy(*wide).agg(F.count("*").alias("ignored_crowd"))
    seen = found.groupBy(*keys).agg(F.count("*").alias("detections"))
    wanted = known.groupBy(*keys).agg(F.count("*").alias("references"))
    rows = seen.join(wanted, keys, "full_outer").withColumn("threshold", F.explode(steps))
    rows = rows.join(hits, wide, "left").join(ignored, wide, "left").fillna(0, ["detections", "references", "matched", "ignored_crowd", "iou_sum"])
    false = F.col("detections") - F.col("matched") - F.col("ignored_crowd")
    return rows.select(
        *wide, "detections", "references", "matched", "iou_sum", (F.col("references") - F.col("matched")).alias("missed"), "ignored_crowd",
        F.when(complete, false).alias("false_detections"),
        F.when(complete & (F.col("matched") + false > 0), F.col("matched") / (F.col("matched") + false)).alias("precision"),
        F.when(complete & (F.col("references") > 0), F.col("matched") / F.col("references")).alias("recall"),
    )


class ObjectCounter:
    """One class of one recording: tracks with their anchored positions, advanced frame by frame."""

    def __init__(self, max_distance: float = MAX_DISTANCE_M, margin: float = MARGIN_M):
        self.max_distance, self.margin = max_distance, margin
        self.anchors: dict[int, np.ndarray] = {}
        self.tracks: dict[int, tuple[int, np.ndarray]] = {}
        self.born = 0

    def set_anchor(self, anchor: int, pose: Sequence[float]) -> None:
        self.anchors[anchor] = np.asarray(pose, float).reshape(3, 4)

    def _place(self, anchor: int, local: np.ndarray) -> np.ndarray:
        m = self.anchors.get(anchor)
        return local if m is None else m[:, :3] @ local + m[:, 3]

    def _store(self, anchor: int, world: np.ndarray) -> tuple[int, np.ndarray]:
        m = self.anchors.get(anchor)
        return anchor, (world if m is None else m[:, :3].T @ (world - m[:, 3]))

    def frame(self, keyframe: int, positions: list[np.ndarray | None]) -> list[tuple[str, int | None, float | None]]:
        """(outcome, object number within the class, nearest same-class distance) per detection, in order."""
        now = {n: self._place(*held) for n, held in self.tracks.items()}
        numbers = sorted(now)
        places = np.array([now[n] for n in numbers]).reshape(-1, 3)
        near: dict[int, list[int]] = {}
        edges, nearest = [], []
        for i, p in enumerate(positions):
            if p is None or not len(numbers):
                nearest.append(None)
                continue
            d = np.sqrt(((places - p) ** 2).sum(1))
            nearest.append(round(float(d.min()), 3))
            close = np.nonzero(d <= self.max_distance)[0]
            if len(close):
                near[i] = close.tolist()
                edges += [(i, numbers[c], float(d[c])) for c in close]
        decided = with_abstention(edges, self.margin)
        out = []
        for i, p in enumerate(positions):
            if p is None:
                out.append(("unresolved_no_position", None, None))
            elif i in decided and decided[i] is None:
                out.append(("unresolved_ambiguous", None, nearest[i]))
            elif i in decided:
                self.tracks[decided[i]] = self._store(keyframe, p)
                out.append(("matched", decided[i], nearest[i]))
            elif i in near:
                out.append(("unresolved_track_already_assigned", None, nearest[i]))
            else:
                self.tracks[self.born] = self._store(keyframe, p)
                out.append(("new", self.born, nearest[i]))
                self.born += 1
        return out


EVENT_COLUMNS = ("seq", "rank", "item", "keyframe", "x", "y", "z", "anchor_id", "pose")
DECISIONS = "seq bigint, item bigint, outcome string, local_id bigint, nearest_m double"


def advance(counter: ObjectCounter, events: list[tuple]) -> list[tuple]:
    """Feed one frame's events (anchors first, then detections in order) to a counter."""
    rows, places, keyframe = [], [], None
    for seq, rank, item, key, x, y, z, anchor, pose in events:
        if rank < 2:
            counter.set_anchor(int(anchor), pose)
            continue
        rows.append((seq, item))
        keyframe = key
        places.append(None if x is None or x != x else np.array([x, y, z], float))
    if not rows:
        return []
    return [(*row, *result) for row, result in zip(rows, counter.frame(keyframe, places))]


def count_objects(
    detections: DataFrame, keys: Sequence[str], cls: str, anchors: DataFrame | None = None,
    max_distance: float = MAX_DISTANCE_M, margin: float = MARGIN_M, chunk: int = 4096,
) -> DataFrame:
    """Outcome, object id and nearest same-class distance of every detection.

    detections(keys, cls, seq, item, keyframe, x, y, z); anchors(keys, seq, rank, anchor_id, pose).
    Classes never compete, so a class of a recording is its own stream; object numbers, which run
    over all classes in detection order, are given afterwards by a running count of births.
    """
    keys = list(keys)
    events = detections.select(
        *keys, cls, "seq", F.lit(2).alias("rank"), "item", "keyframe", "x", "y", "z",
        F.lit(None).cast("long").alias("anchor_id"), F.lit(None).cast("array<double>").alias("pose"),
    )
    if anchors is not None:
        classes = detections.select(*keys, cls).distinct()
        moved = anchors.join(classes, keys).select(
            *keys, cls, "seq", "rank", F.lit(-1).cast("long").alias("item"), F.lit(None).cast("long").alias("keyframe"),
            *[F.lit(None).cast("double").alias(c) for c in "xyz"], "anchor_id", "pose",
        )
        events = events.unionByName(moved)
    streams = [*keys, cls]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*streams).schema)

    def run(batches):
        mark, counter, pending, at = None, None, [], None
        for batch in batches:
            done = []
            groups = list(zip(*[batch[k].tolist() for k in streams]))
            for group, event in zip(groups, zip(*[batch[c].tolist() for c in EVENT_COLUMNS])):
                if (group, event[0]) != at:
                    if pending:
                        done += [(*mark, *row) for row in advance(counter, pending)]
                    pending, at = [], (group, event[0])
                if group != mark:
                    mark, counter = group, ObjectCounter(max_distance, margin)
                pending.append(event)
            yield pd.DataFrame(done, columns=[*streams, "seq", "item", "outcome", "local_id", "nearest_m"], dtype=object)
        if pending:
            done = [(*mark, *row) for row in advance(counter, pending)]
            yield pd.DataFrame(done, columns=[*streams, "seq", "item", "outcome", "local_id", "nearest_m"], dtype=object)

    ordered = _spread(events, streams).sortWithinPartitions(*streams, "seq", "rank", "item")
    decided = checkpointed(ordered.mapInPandas(run, f"{head}, {DECISIONS}"))
    births = decided.where("outcome = 'new'").select(*streams, "seq", "item", "local_id")
    numbered = carried(
        births, keys, ["seq", "item"], F.floor(F.col("seq") / chunk), running={"number": F.lit(1).cast("long")}
    ).select(*streams, "local_id", F.format_string("object-%04d", F.col("number")).alias("object_id"))
    return decided.join(numbered, [*streams, "local_id"], "left")


class PolicyTracks:
    """One category of one session under one association condition."""

    def __init__(self, condition: str):
        self.condition = condition
        self.looks, self.combined = condition.startswith("appearance"), condition.startswith("combined")
        self.latest = condition.endswith("last")
        self.tracks: dict[str, dict] = {}

    def _estimate(self, track: dict) -> tuple:
        if self.latest:
            return track["last"]
        # views are only ever added
        if track.get("estimate", (0, None))[0] != len(track["views"]):
            track["estimate"] = len(track["views"]), tuple(np.median(np.array([v[0] for v in track["views"]]), axis=0).tolist())
        return track["estimate"][1]

    def _edges(self, row: dict, known: list[tuple]) -> Iterator[tuple[str, float]]:
        """(name, cost) of the tracks (name, estimate, anchor, gallery) that a row may belong to."""
        place, vector = row["at"], row["vector"]
        if not self.looks and place is None or (self.looks or self.combined) and vector is None:
            return
        alike, far = row["alike"], 0.0
        for name, estimate, anchor, gallery in known:
            if not self.looks:
                far = _gap(place, estimate)
                if far > MAX_DISTANCE_M or _gap(place, anchor) > MAX_DISTANCE_M:
                    continue
                if not self.combined:
                    yield name, far / MAX_DISTANCE_M
                    continue
            if not gallery:
                continue
            similarity = -2.0
            for other in gallery:
                # the other conditions meet the same vectors
                mine = alike.get(other["id"])
                if mine is None:
                    mine = alike[other["id"]] = _cosine(vector, other["vector"], row["size"], other["size"])
                similarity = max(similarity, mine)
            if similarity >= APPEARANCE_MIN:
                yield name, (1 - similarity) / 2 if self.looks else 0.5 * far / MAX_DISTANCE_M + 0.25 * (1 - similarity)

    def _accept(self, track: dict, row: dict) -> None:
        if row["at"] is None:
            return
        fresh = all(not _same_view(view[1], row["pose"]) for view in track["views"])
        track["last"] = row["at"]
        if fresh:
            track["views"].append((row["at"], row["pose"]))
            if row["vector"] is not None:
                track["gallery"].append(row)

    def frame(self, rows: list[dict], suspects: set[int] | None = None) -> list[tuple[str, str, str | None]]:
        """(decision, reason, object id) per row of one frame, rows in observation order; `suspects` are the same under every condition."""
        out: dict[int, tuple[str, str, str | None]] = {}
        rows = [_prepared(row) for row in rows]
        suspects = _duplicates(rows) if suspects is None else suspects
        for i in suspects:
            out[i] = ("unresolved", "same-class overlapping duplicate suspect", None)
        open_rows = [i for i in range(len(rows)) if i not in suspects]
        if not self.tracks:
            for i in open_rows:
                if rows[i]["position"] is None:
                    out[i] = ("unresolved", "no safe assignment", None)
                    continue
                name = f"{self.condition}:{rows[i]['id']}"
                out[i] = ("new", "first usable same-class frame", name)
                self.tracks[name] = {"anchor": rows[i]["at"], "last": None, "views": [], "gallery": []}
                self._accept(self.tracks[name], rows[i])
            return [out[i] for i in range(len(rows))]
        known = [(n, None if self.looks else self._estimate(t), t["anchor"], t["gallery"]) for n, t in sorted(self.tracks.items())]
        options, tried = [], []
        for i in open_rows:
            options += [(len(tried), n, c) for n, c in self._edges(rows[i], known)]
            tried.append(i)
        best, unclear = near_equal(options, AMBIGUITY_GAP + 1e-12)
        chosen = []
        for k, i in enumerate(open_rows):
            if k in unclear:
                out[i] = ("unresolved", "near-equal full-cardinality assignment", None)
            elif k in best:
                out[i] = ("matched", "one-to-one identity assignment", best[k])
                chosen.append((best[k], rows[i]))
            else:
                out[i] = ("unresolved", "unmatched same-class birth/moved candidate", None)
        for name, row in chosen:
            self._accept(self.tracks[name], row)
        return [out[i] for i in range(len(rows))]


def _prepared(row: dict) -> dict:
    """A row with its place as plain numbers, the size of its vector and the likenesses met so far, made once."""
    if "alike" not in row:
        row["at"] = None if row["position"] is None else tuple(row["position"].tolist())
        row["size"] = None if row["vector"] is None else _size(row["vector"])
        row["alike"] = {}
    return row


def _gap(a: Sequence[float], b: Sequence[float]) -> float:
    x, y, z = a[0] - b[0], a[1] - b[1], a[2] - b[2]
    return sqrt(x * x + y * y + z * z)


def _size(a: np.ndarray) -> float:
    return float(np.linalg.norm(a))


def _cosine(a: np.ndarray, b: np.ndarray, size_a: float, size_b: float) -> float:
    size = size_a * size_b
    return float(a @ b) / size if size else 0.0


def _same_view(a: np.ndarray, b: np.ndarray) -> bool:
    """Camera poses within 5 cm and 10 degrees of each other."""
    if _gap(a[:, 3].tolist(), b[:, 3].tolist()) > VIEW_M:
        return False
    turn = np.clip((np.trace(a[:, :3].T @ b[:, :3]) - 1) / 2, -1.0, 1.0)
    return float(np.degrees(np.arccos(turn))) <= VIEW_DEG


def _spread(rows: DataFrame, streams: Sequence[str]) -> DataFrame:
    """Streams dealt to a fixed number of tasks: Python steps cost more than the few bytes by which tasks would be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *streams)


def _duplicates(rows: list[dict]) -> set[int]:
    found: set[int] = set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if a["at"] is None or b["at"] is None or _gap(a["at"], b["at"]) > 0.02:
                continue
            (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a["box"], b["box"]
            shared = max(0.0, min(ax2, bx2) - max(ax1, bx1)) * max(0.0, min(ay2, by2) - max(ay1, by1))
            union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - shared
            if union > 0 and shared / union >= 0.90:
                found |= {i, j}
    return found


POLICY_COLUMNS = ("seq", "observation_id", "x", "y", "z", "x1", "y1", "x2", "y2", "pose", "appearance")


def associate_policies(observations: DataFrame, keys: Sequence[str], category: str, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """Decisions of every association condition over the same observations, side by side.

    observations(keys, category, seq, observation_id, x, y, z, x1..y2, pose, appearance); keys carry the
    session and its origin, so tracks of different origins never meet.
    """
    streams = [*keys, category]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in observations.select(*streams).schema)
    names = [*streams, "condition", "seq", "observation_id", "decision", "reason", "object_id"]

    def record(values: tuple) -> dict:
        _, key, x, y, z, x1, y1, x2, y2, pose, vector = values
        return {
            "id": key, "position": None if x is None or x != x else np.array([x, y, z], float), "box": (x1, y1, x2, y2),
            "pose": np.asarray(pose, float).reshape(3, 4), "vector": None if vector is None else np.asarray(vector, float),
        }

    def run(batches):
        mark, tracks, pending, at = None, None, [], None

        def flush():
            if not pending:
                return []
            rows = [_prepared(record(v)) for v in pending]
            suspects = _duplicates(rows)
            return [(*mark, t.condition, v[0], v[1], *d) for t in tracks for v, d in zip(pending, t.frame(rows, suspects))]

        for batch in batches:
            done = []
            groups = list(zip(*[batch[k].tolist() for k in streams]))
            for group, values in zip(groups, zip(*[batch[c].tolist() for c in POLICY_COLUMNS])):
                if (group, values[0]) != at:
                    done += flush()
                    pending, at = [], (group, values[0])
                if group != mark:
                    mark, tracks = group, [PolicyTracks(c) for c in conditions]
                pending.append(values)
            yield pd.DataFrame(done, columns=names, dtype=object)
        yield pd.DataFrame(flush(), columns=names, dtype=object)

    ordered = _spread(observations.select(*streams, *POLICY_COLUMNS), streams).sortWithinPartitions(*streams, "seq", "observation_id")
    return ordered.mapInPandas(run, f"{head}, condition string, seq bigint, observation_id bigint, decision string, reason string, object_id string")


def replay_policy(ledger: DataFrame, recomputed: DataFrame, key: str, frozen: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Before / after counts of a recomputed ledger, and rows whose frozen columns changed (must be none)."""
    pair = ledger.select(key, F.col("outcome").alias("before")).join(recomputed.select(key, F.col("outcome").alias("after")), key)
    summary = pair.groupBy("before", "after").agg(F.count("*").alias("rows"))
    columns = [key, *frozen]
    changed = ledger.select(columns).exceptAll(recomputed.select(columns))
    return summary, changed


def capped_views(sightings: DataFrame, object_id: str, order: str) -> DataFrame:
    """Marks the sightings that vote: not within 5 cm and 10 degrees of an earlier representative view.

    Representatives are chosen in order, so an object's sightings stream through one fold that holds
    only its representatives.
    """
    from .sequences import fold_sorted

    def make():
        held: list[np.ndarray] = []

        def step(pose):
            mine = np.asarray(pose, float).reshape(3, 4)
            if any(_same_view(view, mine) for view in held):
                return (False,)
            held.append(mine)
            return (True,)

        return step

    return fold_sorted(sightings, [object_id], [order], ["pose"], make, "representative boolean")


def view_locations(sightings: DataFrame, object_id: str, order: str) -> DataFrame:
    """Median, spread and counts of each object's representative views, with its last and first position."""
    from .ordered import exact_quantiles

    # read by every quantile: the fold runs once
    marked = checkpointed(sightings.join(capped_views(sightings, object_id, order), [object_id, order]))
    votes = marked.where("representative")
    out = marked.groupBy(object_id).agg(
        F.count("*").alias("accepted"), F.count(F.when(F.col("representative"), 1)).alias("representatives"),
        F.max_by(F.struct("x", "y", "z"), order).alias("last"), F.min_by(F.struct("x", "y", "z"), order).alias("anchor"),
    )
    for axis in "xyz":
        q = exact_quantiles(votes, [object_id], axis, {f"median_{axis}": 0.5, "_q1": 0.25, "_q3": 0.75})
        out = out.join(q.select(object_id, f"median_{axis}", (F.col("_q3") - F.col("_q1")).alias(f"iqr_{axis}")), object_id)
    return out


def revised_positions(observations: DataFrame, revision: DataFrame, keys: Sequence[str]) -> DataFrame:
    """World positions under a new pose revision, decisions untouched; a run with a partial map is refused as a whole.

    observations(keys, frame_id, observation_id, cx, cy, cz, object_id); revision(keys, frame_id, pose).
    """
    from ..functions import geometry as g

    keys = list(keys)
    frames = observations.select(*keys, "frame_id").distinct()
    partial = frames.join(revision.select(*keys, "frame_id"), [*keys, "frame_id"], "left_anti").select(*keys).distinct()
    usable = observations.join(partial, keys, "left_anti")
    placed = usable.join(revision, [*keys, "frame_id"])
    world = g.transform(F.col("pose"), g.columns("cx", "cy", "cz"))
    done = placed.select(*observations.columns, *[c.alias(n) for n, c in zip(("wx", "wy", "wz"), world)], F.lit(None).cast("string").alias("reason"))
    refused = observations.join(partial, keys, "left_semi").select(
        *observations.columns, *[F.lit(None).cast("double").alias(n) for n in ("wx", "wy", "wz")], F.lit("partial revision").alias("reason")
    )
    return done.unionByName(refused)
