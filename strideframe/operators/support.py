"""Association by surface supports: depth layers as candidates, abstention where they compete."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf, isfinite, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.assignment import with_abstention
from .identity import _spread

COLUMNS = ("seq", "observation_id", "x1", "y1", "x2", "y2", "samples")
FEW_PAIRS = 64
SLACK = 1e-9

Layer = list[tuple[float, float, float]]


def layers_of(samples: Sequence[tuple], gap: float) -> list[Layer]:
    """World samples split where sorted camera depth (last field) jumps by more than `gap`."""
    layers: list[Layer] = []
    before = None
    for x, y, z, depth in sorted(samples, key=lambda s: (s[3] != s[3], s[3])):
        if before is None or depth - before > gap:
            layers.append([])
        layers[-1].append((x, y, z))
        before = depth
    return layers


def support_gap(a: Layer, b: Layer) -> float:
    """Larger of the two median nearest-sample distances; a few pairs are cheaper without arrays."""
    if len(a) * len(b) <= FEW_PAIRS:
        there, back, total = [], [inf] * len(b), 0.0
        for x, y, z in a:
            least = inf
            for j, (u, v, w) in enumerate(b):
                dx, dy, dz = x - u, y - v, z - w
                squared = dx * dx + dy * dy + dz * dz
                total += squared
                if squared < least:
                    least = squared
                if squared < back[j]:
                    back[j] = squared
            there.append(least)
        if isfinite(total):
            return max(_middle_root(there), _middle_root(back))
    p, q = np.array(a), np.array(b)
    table = np.sqrt(((p[:, None, :] - q[None, :, :]) ** 2).sum(2))
    return float(max(np.median(table.min(1)), np.median(table.min(0))))


def _middle_root(squares: list[float]) -> float:
    """Median of the roots."""
    squares.sort()
    half = len(squares) // 2
    return sqrt(squares[half]) if len(squares) % 2 else (sqrt(squares[half - 1]) + sqrt(squares[half])) / 2


def ball_of(samples: Layer) -> tuple[float, float, float, float]:
    """Mean of the samples and the radius around it that holds them all."""
    n = len(samples)
    x, y, z = (sum(c) / n for c in zip(*samples))
    return x, y, z, sqrt(max((u - x) ** 2 + (v - y) ** 2 + (w - z) ** 2 for u, v, w in samples))


class SupportTracks:
    """One class of one origin: the last support of every object."""

    def __init__(self, reach: float, margin: float, gap: float):
        self.reach, self.margin, self.gap = reach, margin, gap
        self.supports: dict[int, Layer] = {}
        self.balls = np.empty((64, 4))
        self.born = 0

    def frame(self, rows: list[dict]) -> list[tuple[str, str, int | None]]:
        """(decision, reason, object number) per observation of one frame."""
        parts = [layers_of(r["samples"], self.gap) for r in rows]
        silent = self._duplicates(rows, parts)
        options: dict[int, dict[int, tuple[float, int]]] = {}
        for i, k, n in self._near(parts):
            cost = support_gap(parts[i][k], self.supports[n])
            if cost <= min(self.reach, options.get(i, {}).get(n, (inf, 0))[0]):
                options.setdefault(i, {}).setdefault(n, (cost, k))
                options[i][n] = min(options[i][n], (cost, k))
        edges = [(i, n, cost) for i, near in options.items() if i not in silent for n, (cost, _) in near.items()]
        decided = with_abstention(edges, self.margin)
        out, moved = [], {}
        for i, layers in enumerate(parts):
            if i in silent:
                out.append(("unresolved", "unresolved_duplicate_box", None))
            elif i in decided and decided[i] is None:
                out.append(("unresolved", "unresolved_ambiguous", None))
            elif i in decided:
                n = decided[i]
                moved[n] = layers[options[i][n][1]]
                out.append(("matched", "support_assignment", n))
            elif not layers:
                out.append(("unresolved", "unresolved_no_support", None))
            elif len(layers) > 1:
                out.append(("unresolved", "unresolved_competing_support", None))
            elif i in options:
                out.append(("unresolved", "unresolved_track_already_assigned", None))
            else:
                moved[self.born] = layers[0]
                out.append(("new", "late_or_unmatched_provisional_birth", self.born))
                self.born += 1
        for n, part in moved.items():
            if n >= len(self.balls):
                self.balls = np.concatenate([self.balls, np.empty_like(self.balls)])
            self.supports[n], self.balls[n] = part, ball_of(part)
        return out

    def _near(self, parts: list[list[Layer]]) -> list[tuple[int, int, int]]:
        """(row, layer, object) whose enclosing balls are within the reach; others cannot hold near samples."""
        at = [(i, k) for i, layers in enumerate(parts) for k in range(len(layers))]
        if not at or not self.born:
            return []
        mine, balls = np.array([ball_of(parts[i][k]) for i, k in at]), self.balls[:self.born]
        apart = np.sqrt(((mine[:, None, :3] - balls[None, :, :3]) ** 2).sum(2)) - balls[None, :, 3] - mine[:, None, 3]
        return [(*at[j], n) for j, n in zip(*(found.tolist() for found in np.nonzero(apart <= self.reach + SLACK)))]

    @staticmethod
    def _duplicates(rows: list[dict], parts: list[list[Layer]]) -> set[int]:
        """All but the lowest index of boxes that overlap by 0.9 with supports within 2 cm."""
        silent: set[int] = set()
        boxes = np.array([r["box"] for r in rows], float).reshape(-1, 4)
        low, high = boxes[:, None, :2], boxes[:, None, 2:]
        shared = np.clip(np.minimum(high, high.swapaxes(0, 1)) - np.maximum(low, low.swapaxes(0, 1)), 0.0, None).prod(2)
        area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        union = area[:, None] + area[None, :] - shared
        alike = (union > 0) & (shared >= 0.90 * union - SLACK)
        for i, j in zip(*(found.tolist() for found in np.nonzero(np.triu(alike, 1)))):
            if i in silent or j in silent or not parts[i] or not parts[j] or shared[i, j] / union[i, j] < 0.90:
                continue
            if min(support_gap(a, b) for a in parts[i] for b in parts[j]) <= 0.02:
                silent.add(j)
        return silent


def associate_supports(
    observations: DataFrame, keys: Sequence[str], cls: str, reach: float = 0.35, margin: float = 0.05, gap: float = 0.08
) -> DataFrame:
    """Decision, reason and class-level object number of each observation.

    observations(keys, cls, seq, observation_id, x1..y2, samples array<struct<x, y, z, depth>>), where keys hold
    session and origin, so supports of different origins never meet. Classes are separate streams.
    """
    streams = [*keys, cls]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in observations.select(*streams).schema)
    names = [*streams, "seq", "observation_id", "decision", "reason", "local_id"]

    def packed(done: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        kinds = [*kinds, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        columns = zip(*done) if done else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    def samples_of(column: pa.ListArray) -> list[list[tuple]]:
        fields = dict(zip([f.name for f in column.type.value_type], column.flatten().flatten()))
        flat = list(zip(*[fields[c].to_numpy(zero_copy_only=False).astype(float).tolist() for c in ("x", "y", "z", "depth")]))
        ends = np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy()).tolist()
        return [flat[start:end] for start, end in zip([0, *ends], ends)]

    def run(batches):
        mark, tracks, pending, at, kinds = None, None, [], None, None

        def flush():
            decided = tracks.frame([{"box": v[2:6], "samples": v[6]} for v in pending]) if pending else []
            return [(*mark, v[0], v[1], *d) for v, d in zip(pending, decided)]

        for batch in batches:
            done, kinds = [], [batch.schema.field(k).type for k in streams]
            groups = zip(*[batch.column(k).to_pylist() for k in streams])
            fields = [batch.column(c).to_pylist() for c in COLUMNS[:-1]]
            for group, values in zip(groups, zip(*fields, samples_of(batch.column("samples")))):
                if (group, values[0]) != at:
                    done += flush()
                    pending, at = [], (group, values[0])
                if group != mark:
                    mark, tracks = group, SupportTracks(reach, margin, gap)
                pending.append(values)
            yield packed(done, kinds)
        if pending:
            yield packed(flush(), kinds)

    ordered = _spread(observations.select(*streams, *COLUMNS), streams).sortWithinPartitions(*streams, "seq", "observation_id")
    return ordered.mapInArrow(run, f"{head}, seq bigint, observation_id bigint, decision string, reason string, local_id bigint")
