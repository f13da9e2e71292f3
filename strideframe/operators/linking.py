"""Greedy one-to-one links by cost, in rounds of mutually best edges, and chains built from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpointed
from .graph import components

JUMP_DIAGONALS = 2.0
WHOLE_PAIRS = 1 << 20


def greedy_pairs(edges: DataFrame, keys: Sequence[str], left: str, right: str, cost: str, group: int = 4096) -> DataFrame:
    """Pairs taken in order of (cost, left, right) while both ends are free.

    Edges of a key with at most `group` pass by in that order once. Larger keys go through rounds, each of which takes the
    cheapest edge left at least.
    """
    keys = list(keys)
    edges = checkpointed(edges.select(*keys, left, right, cost))
    large = checkpointed(edges.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > group).select(*keys))
    if large.isEmpty():
        return _taken_in_order(edges, keys, left, right, cost)
    small = _taken_in_order(edges.join(large, keys, "left_anti"), keys, left, right, cost)
    return small.unionByName(_taken_in_rounds(edges.join(large, keys, "left_semi"), keys, left, right, cost))


def _taken_in_order(edges: DataFrame, keys: Sequence[str], left: str, right: str, cost: str) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, lefts, rights = None, set(), set()
        for batch in batches:
            kept = []
            columns = [batch.column(c).to_pylist() for c in (left, right)]
            for i, (key, a, b) in enumerate(zip(zip(*[batch.column(k).to_pylist() for k in keys]), *columns)):
                if key != mark:
                    mark, lefts, rights = key, set(), set()
                if a not in lefts and b not in rights:
                    lefts.add(a)
                    rights.add(b)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    ordered = edges.repartition(*keys).sortWithinPartitions(*keys, cost, left, right)
    return ordered.mapInArrow(walk, edges.schema)


def _taken_in_rounds(edges: DataFrame, keys: Sequence[str], left: str, right: str, cost: str) -> DataFrame:
    rest = checkpointed(edges)
    out = None
    while True:
        rank = F.struct(cost, left, right)
        by_left = rest.groupBy(*keys, left).agg(F.min(rank).alias("_a"))
        by_right = rest.groupBy(*keys, right).agg(F.min(rank).alias("_b"))
        taken = checkpointed(
            rest.join(by_left, [*keys, left]).join(by_right, [*keys, right]).where((rank == F.col("_a")) & (rank == F.col("_b"))).select(*keys, left, right, cost)
        )
        if taken.isEmpty():
            return taken if out is None else out
        out = taken if out is None else out.unionByName(taken)
        rest = checkpointed(
            rest.join(taken.select(*keys, left), [*keys, left], "left_anti").join(taken.select(*keys, right), [*keys, right], "left_anti")
        )


def link_frames(
    previous: DataFrame, current: DataFrame, keys: Sequence[str], gate: float = 0.5, most: int = WHOLE_PAIRS
) -> tuple[DataFrame, DataFrame]:
    """Links from each frame to the next, and the outcome of every detection left unlinked.

    previous(keys, label, i, u, v, diagonal): predicted centres; current(keys, label, j, u, v, linkable).
    Only candidates within two diagonals are ever paired. The detections of a key with at most `most` pairs pass by
    together once; larger keys go through joins.
    """
    keys = list(keys)
    rows = previous.withColumn("_before", F.lit(True)).unionByName(current.withColumn("_before", F.lit(False)), allowMissingColumns=True)
    pairs = F.count(F.when(F.col("_before"), 1)) * F.count(F.when(~F.col("_before"), 1))
    large = checkpointed(rows.groupBy(*keys).agg(pairs.alias("_n")).where(F.col("_n") > most).select(*keys))
    crowded = not large.isEmpty()
    met = checkpointed(_linked_in_passing(rows.join(large, keys, "left_anti") if crowded else rows, keys, gate))
    links, unlinked = met.where("outcome IS NULL").select(*keys, "i", "j", "distance"), met.where("outcome IS NOT NULL").select(*keys, "i", F.col("distance").alias("nearest_px"), "outcome")
    if not crowded:
        return links, unlinked
    more = _linked_by_joins(previous.join(large, keys, "left_semi"), current.join(large, keys, "left_semi"), keys, gate)
    return links.unionByName(more[0]), unlinked.unionByName(more[1])


def _in_order(near: np.ndarray, gaps: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Cells of `near` taken in order of (gap, left id, right id) while both ids are free."""
    a, b = np.nonzero(near)
    order = np.lexsort((right[b], left[a], gaps[a, b]))
    lefts, rights, taken = set(), set(), []
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if left[x] not in lefts and right[y] not in rights:
            lefts.add(left[x])
            rights.add(right[y])
            taken.append((x, y))
    return taken


def _outcomes(before: dict, after: dict, gate: float) -> list[tuple]:
    """(i, j, distance, outcome) of one key: its links, then what became of the others."""
    i, j = before["i"], after["j"]
    with np.errstate(invalid="ignore"):
        gaps = np.hypot(before["u"][:, None] - after["u"], before["v"][:, None] - after["v"])
        near = (gaps <= JUMP_DIAGONALS * before["diagonal"][:, None]) & (before["label"][:, None] == after["label"])
        inside = near & (gaps <= gate * before["diagonal"][:, None])
    linked = _in_order(inside & after["linkable"], gaps, i, j)
    out = [(i[x], j[y], gaps[x, y], None) for x, y in linked]
    sources, targets = {i[x] for x, _ in linked}, {j[y] for _, y in linked}
    far = []
    for x in range(len(i)):
        if i[x] in sources:
            continue
        mine = np.nonzero(near[x])[0]
        if not len(mine):
            out.append((i[x], None, None, "gone"))
            continue
        y = mine[np.lexsort((j[mine], gaps[x, mine]))[0]]
        if not inside[x, y]:
            far.append((x, y))
        else:
            out.append((i[x], None, gaps[x, y], "no_depth" if not after["linkable"][y] else "claimed" if j[y] in targets else "gone"))
    if far:
        at = np.array([x for x, _ in far])
        free = near[at] & ~np.isin(np.arange(len(j)), [y for y in range(len(j)) if j[y] in targets])
        jumps = {x: gaps[at[x], y] for x, y in _in_order(free, gaps[at], i[at], j)}
        out += [(i[x], None, jumps.get(n, gaps[x, y]), "jump" if n in jumps else "gone") for n, (x, y) in enumerate(far)]
    return out


def _linked_in_passing(rows: DataFrame, keys: list[str], gate: float) -> DataFrame:
    """Links (outcome null) and unlinked detections of every key, from its detections of both frames."""
    held = [rows.schema[k] for k in keys]
    schema = T.StructType([*held, rows.schema["i"], rows.schema["j"], T.StructField("distance", T.DoubleType()), T.StructField("outcome", T.StringType())])

    def solve(key: tuple, part: pa.Table) -> list[tuple]:
        before = np.array(part.column("_before").to_pylist(), bool)
        number = lambda name: np.array([np.nan if v is None else v for v in part.column(name).to_pylist()], float)
        # detections without a label meet nobody
        names: dict = {None: -1}
        label = np.array([names.setdefault(v, len(names)) for v in part.column("label").to_pylist()], np.int64)
        label[(label < 0) & ~before] = -2
        u, v, diagonal = number("u"), number("v"), number("diagonal")
        linkable = np.array([bool(x) for x in part.column("linkable").to_pylist()], bool)
        side = lambda mask, name: {"u": u[mask], "v": v[mask], "label": label[mask], name: np.array(part.column(name).filter(pa.array(mask)).to_pylist())}
        found = _outcomes(side(before, "i") | {"diagonal": diagonal[before]}, side(~before, "j") | {"linkable": linkable[~before]}, gate)
        return [(*key, *[x.item() if isinstance(x, np.generic) else x for x in row]) for row in found]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rest = to_arrow_schema(schema), None

        def said(table: pa.Table, names: list[tuple], edges: list[int]) -> pa.RecordBatch:
            found = [row for a, b in zip(edges, edges[1:]) for row in solve(names[a], table.slice(a, b - a))]
            return pa.RecordBatch.from_arrays([pa.array([row[c] for row in found], f.type) for c, f in enumerate(kinds)], schema=kinds)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            names = list(zip(*[table.column(k).to_pylist() for k in keys]))
            edges = [0, *[n for n in range(1, len(names)) if names[n] != names[n - 1]]]
            # the last key may go on in the next batch
            rest = table.slice(edges[-1])
            if len(edges) > 1:
                yield said(table, names, edges)
        if rest is not None and len(rest):
            names = list(zip(*[rest.column(k).to_pylist() for k in keys]))
            yield said(rest, names, [0, len(rest)])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk, schema)


def _linked_by_joins(previous: DataFrame, current: DataFrame, keys: list[str], gate: float) -> tuple[DataFrame, DataFrame]:
    """The same for keys of any size, by joins on the keys and the label."""
    there = current.select(*keys, "label", "j", F.col("u").alias("_u"), F.col("v").alias("_v"), "linkable")
    d = F.hypot(F.col("u") - F.col("_u"), F.col("v") - F.col("_v"))
    near = checkpointed(
        previous.join(there, [*keys, "label"]).withColumn("distance", d).where(F.col("distance") <= JUMP_DIAGONALS * F.col("diagonal"))
        .select(*keys, "i", "j", "diagonal", "linkable", "distance")
    )
    links = checkpointed(greedy_pairs(near.where(F.col("linkable") & (F.col("distance") <= gate * F.col("diagonal"))), keys, "i", "j", "distance"))
    open_rows = previous.join(links.select(*keys, "i"), [*keys, "i"], "left_anti").select(*keys, "i", "diagonal")
    nearest = near.groupBy(*keys, "i").agg(F.min(F.struct("distance", "j", "linkable")).alias("_n"))
    claimed = links.select(*keys, F.col("j").alias("_j")).withColumn("_taken", F.lit(True))
    rows = open_rows.join(nearest, [*keys, "i"], "left").withColumn("_j", F.col("_n.j")).join(claimed, [*keys, "_j"], "left")
    inside = F.col("_n.distance") <= gate * F.col("diagonal")
    first = (
        F.when(F.col("_n").isNull(), "gone").when(inside & ~F.col("_n.linkable"), "no_depth")
        .when(inside & F.col("_taken").isNotNull(), "claimed").when(inside, "gone").otherwise("far")
    )
    rows = checkpointed(rows.select(*keys, "i", F.col("_n.distance").alias("nearest_px"), first.alias("_first")))
    free = near.join(rows.where("_first = 'far'").select(*keys, "i"), [*keys, "i"], "left_semi").join(
        links.select(*keys, "j"), [*keys, "j"], "left_anti"
    )
    jumps = greedy_pairs(free, keys, "i", "j", "distance").select(*keys, "i", F.col("distance").alias("_jump"))
    unlinked = rows.join(jumps, [*keys, "i"], "left").select(
        *keys, "i", F.coalesce("_jump", "nearest_px").alias("nearest_px"),
        F.when(F.col("_jump").isNotNull(), "jump").when(F.col("_first") == "far", "gone").otherwise(F.col("_first")).alias("outcome"),
    )
    return links, unlinked


def chains(detections: DataFrame, links: DataFrame) -> DataFrame:
    """Track id (lowest member) of every detection(id) given link rows (a, b)."""
    return components(detections.select("id"), links.select("a", "b")).withColumnRenamed("component", "track")
