"""Exact 3D proximity without pair explosions, and tile joins in the image plane.

References are cut into blocks, the leaves of a k-d tree. A query is sent to the blocks that can still matter, by
the bounds of their boxes, and compared with the points of a block in a group of bounded size on either side. A
dense spot makes the tree deeper there, and a stray point widens one leaf; neither makes a group larger.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as b
from ..session import checkpointed

BRANCH = 16              # children of a node; a leaf is named by one letter per level
LEAF_POINTS = 32
BLOCK_POINTS = 2048      # points of a block that queries are compared with in one group
CHUNK_ASKS = 8192        # queries of a group, at most some so many
PAIR_ASKS = 1024         # of a group that says all its pairs
ASK_ROWS = 32            # queries compared with a block at once
ROUTED_ROWS = 1024       # queries compared with the boxes of blocks at once
BUCKET_POINTS = 65_536   # nodes up to this size are cut by exact ranks inside one window
XYZ = ("x", "y", "z")
BOX = ("x0", "y0", "z0", "x1", "y1", "z1")


def _finite() -> Column:
    """Null, NaN and infinite coordinates are neither found nor looked for."""
    size = F.greatest(*[F.when(F.col(c).isNotNull(), F.abs(c)).otherwise(float("inf")) for c in XYZ])
    return size < float("inf")


class KdTree:
    """Leaves of at most `leaf` distinct reference points of a key, with counts and tight boxes of every node.

    Nodes above `bucket` points are cut at sketched quantiles of the axis that spreads most between its
    outer sixteenths, all nodes of all keys in one aggregate a round. Points are distinct, so some axis
    always has such a spread and each side keeps about a sixteenth at least: rounds grow with the logarithm
    of the points, wherever they lie. Smaller nodes are cut by rank, all levels after one shuffle.
    """

    def __init__(self, refs: DataFrame, keys: Sequence[str], ref_id: str, leaf: int = LEAF_POINTS, bucket: int = BUCKET_POINTS):
        self.keys = list(keys)
        points = _known(refs, self.keys).select(*keys, F.col(ref_id).alias("_rid"), *XYZ).groupBy(*keys, *XYZ).agg(
            F.min("_rid").alias("_rid"), F.count("*").alias("_m")
        )
        points, coarse, most = self._sketched_cuts(points.withColumns({"_path": F.lit(""), "_open": F.lit(True)}), bucket)
        fine = 0
        while leaf * BRANCH**fine < most:
            fine += 1
        self.depth = coarse + fine
        self.points = checkpointed(self._ranked_cuts(points, fine, leaf))

    def _sketched_cuts(self, points: DataFrame, bucket: int) -> tuple[DataFrame, int, int]:
        """Points with the path of their bucket, the rounds it took and the size of the largest bucket."""
        node = [*self.keys, "_path"]
        shares = [i / BRANCH for i in range(1, BRANCH)]
        rounds = most = 0
        while True:
            sizes = points.where("_open").groupBy(*node).agg(F.count("*").alias("_n"))
            largest = sizes.agg(F.max("_n").alias("all"), F.max(F.when(F.col("_n") <= bucket, F.col("_n"))).alias("done")).first()
            most = max(most, largest["done"] or 0)
            if (largest["all"] or 0) <= bucket:
                return points.drop("_open"), rounds, most
            cuts = points.where("_open").groupBy(*node).agg(
                F.count("*").alias("_n"), *[F.percentile_approx(c, shares, 1000).alias(f"_q{c}") for c in XYZ]
            ).where(F.col("_n") > bucket)
            spread = {c: F.element_at(f"_q{c}", -1) - F.element_at(f"_q{c}", 1) for c in XYZ}
            widest = F.greatest(*spread.values())
            axis = F.when(spread["x"] == widest, "x").when(spread["y"] == widest, "y").otherwise("z")
            at = F.when(axis == "x", F.col("_qx")).when(axis == "y", F.col("_qy")).otherwise(F.col("_qz"))
            cuts = cuts.select(*node, axis.alias("_axis"), F.array_distinct(at).alias("_cuts"))
            value = F.when(F.col("_axis") == "x", F.col("x")).when(F.col("_axis") == "y", F.col("y")).otherwise(F.col("z"))
            child = F.size(F.filter("_cuts", lambda cut: cut < F.col("_along")))
            points = points.join(cuts, node, "left").withColumn("_along", value).withColumns({
                "_path": F.when(F.col("_axis").isNull(), F.col("_path")).otherwise(F.concat("_path", _letter(child))),
                "_open": F.col("_axis").isNotNull(),
            }).drop("_axis", "_cuts", "_along")
            points = checkpointed(points)
            rounds += 1

    def _ranked_cuts(self, points: DataFrame, levels: int, leaf: int) -> DataFrame:
        """Buckets cut into equal parts along their longest side; windows refine one partitioning, so it is one shuffle."""
        digits: list[str] = []
        for level in range(levels):
            node = Window.partitionBy(*self.keys, "_path", *digits)
            sides = {c: F.max(c).over(node) - F.min(c).over(node) for c in XYZ}
            points = points.withColumns({"_n": F.count("*").over(node), **{f"_s{c}": side for c, side in sides.items()}})
            widest = F.greatest("_sx", "_sy", "_sz")
            along = F.when(F.col("_sx") == widest, F.col("x")).when(F.col("_sy") == widest, F.col("y")).otherwise(F.col("z"))
            points = points.withColumn("_along", along)
            rank = F.row_number().over(node.orderBy("_along", *XYZ)) - 1
            parts = F.least(F.lit(BRANCH), F.ceil(F.col("_n") / leaf))
            digit = F.when(F.col("_n") > leaf, F.floor(rank * parts / F.col("_n")))
            points = points.withColumn(f"_d{level}", digit).drop("_n", "_sx", "_sy", "_sz", "_along")
            digits.append(f"_d{level}")
        letters = [F.coalesce(_letter(F.col(d)), F.lit("")) for d in digits]
        return points.withColumn("_node", F.concat("_path", *letters)).drop("_path", *digits)

    def blocks(self) -> DataFrame:
        """Count and tight box of every leaf."""
        lows, highs = list(zip(XYZ, BOX[:3])), list(zip(XYZ, BOX[3:]))
        return self.points.groupBy(*self.keys, "_node").agg(
            F.sum("_m").alias("_count"), *[F.min(c).alias(n) for c, n in lows], *[F.max(c).alias(n) for c, n in highs]
        )


def _letter(digit: Column) -> Column:
    return F.char(digit.cast("long") + 97)


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with three finite coordinates and no null key."""
    return df.where(reduce(and_, [F.col(k).isNotNull() for k in keys], _finite()))


def _place(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy() for n in names]).astype(float)


def _length(gaps: Sequence[np.ndarray]) -> np.ndarray:
    return np.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def _apart(asked: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Distances of queries and points row by row."""
    return _length([asked[:, i] - there[:, i] for i in range(3)])


def _squares(asked: np.ndarray, there: np.ndarray):
    """Slices of queries with their squared distances to all points, by a matrix product, and how far those may be off."""
    centre = there.mean(0)
    a, b = asked - centre, there - centre
    with np.errstate(over="ignore", invalid="ignore"):
        sizes, most = (a * a).sum(1), (b * b).sum(1)
        slack = 64 * np.finfo(float).eps * (sizes + most.max())
    left, right = np.column_stack([a, sizes, np.ones(len(a))]), np.vstack([-2 * b.T, np.ones(len(b)), most])
    for part in _slices(len(a), ASK_ROWS):
        if np.isfinite(slack[part]).all():
            yield part, left[part] @ right, slack[part]
        else:
            # squares beyond the range of doubles: nothing is known before the distances themselves
            yield part, np.zeros((len(a[part]), len(b))), np.full(len(a[part]), np.inf)


def _within(asked: np.ndarray, there: np.ndarray, radius: float):
    """Slices of queries with a mask of the points within `radius`; only those near the edge are measured one by one."""
    for part, squares, slack in _squares(asked, there):
        edge = radius * radius
        slack = (slack + 4 * np.finfo(float).eps * edge)[:, None]
        mask = squares <= edge - slack
        rows, at = np.nonzero((squares <= edge + slack) & ~mask)
        mask[rows, at] = _apart(asked[part][rows], there[at]) <= radius
        yield part, mask


def _box_bounds(asked: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible distance of every query to the points of every box; rounding keeps their order."""
    below = [boxes[None, :, i] - asked[:, i, None] for i in range(3)]
    above = [asked[:, i, None] - boxes[None, :, 3 + i] for i in range(3)]
    near = [np.maximum(np.maximum(lo, hi), 0.0) for lo, hi in zip(below, above)]
    return _length(near), _length([np.maximum(np.abs(lo), np.abs(hi)) for lo, hi in zip(below, above)])


def _slices(count: int, size: int):
    return (slice(at, min(at + size, count)) for at in range(0, count, size))


def _met(df: DataFrame, keys: Sequence[str], query_id: str, more: Sequence[str] = ()) -> DataFrame:
    """Queries as (keys, _qid, x, y, z, more), known ones only, dealt by their id into groups of some CHUNK_ASKS of a key."""
    asked = _known(df, keys).select(*keys, F.col(query_id).alias("_qid"), *XYZ, *more)
    sizes = asked.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK_ASKS).alias("_chunks"))
    dealt = asked.join(sizes, list(keys)) if keys else asked.crossJoin(F.broadcast(sizes))
    return dealt.withColumn("_chunk", F.pmod(F.xxhash64("_qid"), F.col("_chunks"))).drop("_chunks")


def _routed(dealt: DataFrame, tree: KdTree, route, columns: Sequence[str], added: str) -> DataFrame:
    """`columns` of the queries beside what `route` says about the blocks of their key; a group holds one chunk and the boxes of its key."""
    keys = tree.keys
    chunks = dealt.select(*keys, "_chunk").distinct()
    boxes = chunks.join(tree.blocks(), keys) if keys else chunks.crossJoin(tree.blocks())
    schema = T.StructType([*[dealt.schema[c] for c in columns], *T._parse_datatype_string(added).fields])

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not len(asked) or not len(found):
            return _arrow([], schema)
        found = found.sort_by("_node")
        place, box, count = _place(asked, XYZ), _place(found, BOX), found.column("_count").to_numpy()
        names, out = found.column("_node"), []
        for part in _slices(len(asked), ROUTED_ROWS):
            rows, nodes, values = route(asked.slice(part.start, ROUTED_ROWS), *_box_bounds(place[part], box), count, names)
            own = asked.slice(part.start, ROUTED_ROWS).select(columns).take(pa.array(rows))
            out.append([*own.columns, names.take(pa.array(nodes)), *[pa.array(v) for v in values]])
        return _arrow(out, schema)

    return _beside(dealt, boxes, [*keys, "_chunk"]).applyInArrow(run, schema)


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Groups of two tables that may share their origin, so the keys of the right one are named anew."""
    return left.groupBy(*keys).cogroup(right.withColumnsRenamed({k: f"k_{k}" for k in keys}).groupBy(*[f"k_{k}" for k in keys]))


def _arrow(parts: list[list], schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pa.concat_tables([kinds.empty_table(), *[pa.table([whole(c).cast(f.type) for c, f in zip(cs, kinds)], schema=kinds) for cs in parts]])


def _opened(routed: DataFrame, tree: KdTree, refs: DataFrame, solve, schema: T.StructType, asks: int = CHUNK_ASKS) -> DataFrame:
    """`solve` on every block and the queries sent to it, at most some `asks` of them in a group."""
    keys = [*tree.keys, "_node"]
    parts = routed.groupBy(*keys).agg(F.ceil(F.count("*") / asks).alias("_parts"))
    asked = routed.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64("_qid"), F.col("_parts"))).drop("_parts")
    copies = refs.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _arrow(solve(left, right) if len(left) and len(right) else [], schema)

    return _beside(asked, copies, [*keys, "_part"]).applyInArrow(run, schema)


def nearest_k(
    queries: DataFrame, refs: DataFrame, query_id: str, ref_id: str, k: int = 1, keys: Sequence[str] = (),
    max_distance: float | None = None, leaf: int = BLOCK_POINTS, bucket: int = BUCKET_POINTS,
) -> DataFrame:
    """The k nearest references of each query inside the same keys: keys, query id, rank, ref id, distance.

    A query first meets the block it lies in or next to; what it finds there bounds the other blocks it has to meet.
    Repeated coordinates count as often as they occur and share their lowest id. A query without three finite
    coordinates gets no row.
    """
    keys = list(keys)
    tree = KdTree(refs, keys, ref_id, leaf, bucket)
    most = float("inf") if max_distance is None else max_distance
    asked = _met(queries, keys, query_id)
    own = [*keys, "_qid", *XYZ]

    def home(part, near, far, count, names):
        first = np.lexsort((far, near), axis=1)[:, 0]
        rows = np.nonzero(near[np.arange(len(first)), first] <= most)[0]
        return rows, first[rows], []

    def rest(part, near, far, count, names):
        reach = part.column("_reach").to_numpy()
        known = np.asarray(names.to_pylist(), dtype=object)[None, :] == np.asarray(part.column("_home").to_pylist(), dtype=object)[:, None]
        rows, nodes = np.nonzero((near <= reach[:, None]) & ~known)
        return rows, nodes, []

    found = T.StructType([
        *asked.select(*own).schema.fields, T.StructField("_node", T.StringType()), T.StructField("_reach", T.DoubleType()), T.StructField("_first", T.BooleanType()),
        tree.points.schema["_rid"], T.StructField("_m", T.LongType()), T.StructField("distance", T.DoubleType()),
    ])

    def solve(left: pa.Table, right: pa.Table) -> list[list]:
        right = right.sort_by("_rid")
        there, place, out = _place(right, XYZ), _place(left, XYZ), []
        for part, squares, slack in _squares(place, there):
            upto = np.partition(squares, k - 1, axis=1)[:, k - 1] if k <= len(there) else np.full(len(squares), np.inf)
            rows, at = np.nonzero(squares <= (upto + 2 * slack)[:, None])
            gaps = _apart(place[part][rows], there[at])
            # in order of (distance, id), the first k of every query
            order = np.lexsort((at, gaps, rows))
            rows, at, gaps = rows[order], at[order], gaps[order]
            turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, at, gaps, turn = (a[turn < k] for a in (rows, at, gaps, turn))
            reach = np.full(len(squares), most)
            reach[rows[turn == k - 1]] = np.minimum(gaps[turn == k - 1], most)
            asked_rows, hits = left.slice(part.start, ASK_ROWS).take(pa.array(rows)), right.take(pa.array(at))
            out.append([
                *[asked_rows.column(c) for c in (*own, "_node")], pa.array(reach[rows]), pa.array(turn == 0),
                hits.column("_rid"), hits.column("_m"), pa.array(gaps),
            ])
        return out

    points = tree.points.select(*keys, "_node", "_rid", "_m", *XYZ)
    inside = checkpointed(_opened(checkpointed(_routed(asked, tree, home, own, "_node string")), tree, points, solve, found))
    again = _met(inside.where("_first").withColumnRenamed("_node", "_home"), keys, "_qid", ["_reach", "_home"])
    outside = _opened(checkpointed(_routed(again, tree, rest, own, "_node string")), tree, points, solve, found)
    final = inside.unionByName(outside).select(*keys, "_qid", "_rid", "_m", "distance")
    if max_distance is not None:
        final = final.where(F.col("distance") <= max_distance)
    if k == 1:
        best = final.groupBy(*keys, "_qid").agg(F.min(F.struct("distance", "_rid")).alias("_b"))
        return best.select(
            *keys, F.col("_qid").alias(query_id), F.lit(1).alias("rank"), F.col("_b._rid").alias(ref_id), F.col("_b.distance").alias("distance")
        )
    mine = Window.partitionBy(*keys, "_qid")
    copies = final.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("_m"), F.lit(k)).cast("int"))))
    ranked = copies.withColumn("rank", F.row_number().over(mine.orderBy("distance", "_rid", "_copy"))).where(F.col("rank") <= k)
    return ranked.select(*keys, F.col("_qid").alias(query_id), "rank", F.col("_rid").alias(ref_id), "distance")


def _crossing(radius: float, whole: bool):
    """Route of every query to the blocks that its ball of `radius` cuts; `whole` opens the blocks inside it too."""

    def route(part, near, far, count, names):
        rows, nodes = np.nonzero((near <= radius) if whole else (near <= radius) & (far > radius))
        return rows, nodes, []

    return route


def _enclosed(radius: float):
    """References in blocks that lie whole inside a query's ball, on the row of its first block."""

    def route(part, near, far, count, names):
        held = ((far <= radius) * count[None, :]).sum(1)
        rows = np.nonzero(held > 0)[0]
        return rows, np.zeros(len(rows), np.int64), [held[rows]]

    return route


def count_within(
    queries: DataFrame, refs: DataFrame, query_id: str, ref_id: str, radius: float, keys: Sequence[str] = (),
    leaf: int = BLOCK_POINTS, bucket: int = BUCKET_POINTS,
) -> DataFrame:
    """Number of references within `radius` of each query; blocks wholly inside are counted, not opened."""
    keys = list(keys)
    tree = KdTree(refs, keys, ref_id, leaf, bucket)
    asked = _met(queries, keys, query_id)
    own = [*keys, "_qid"]
    counted = T.StructType([*asked.select(*own).schema.fields, T.StructField("_n", T.LongType())])

    def solve(left: pa.Table, right: pa.Table) -> list[list]:
        there, place, copies = _place(right, XYZ), _place(left, XYZ), right.column("_m").to_numpy()
        count = (lambda mask: np.count_nonzero(mask, axis=1)) if (copies == 1).all() else (lambda mask: mask @ copies)
        return [[*[left.column(c) for c in own], pa.array(np.concatenate([count(mask) for _, mask in _within(place, there, radius)]))]]

    cut = checkpointed(_routed(asked, tree, _crossing(radius, False), [*own, *XYZ], "_node string"))
    total = _opened(cut, tree, tree.points.select(*keys, "_node", "_m", *XYZ), solve, counted).unionByName(
        _routed(asked, tree, _enclosed(radius), own, "_node string, _n long").drop("_node")
    )
    total = total.groupBy(*keys, "_qid").agg(F.sum("_n").alias("neighbours"))
    ids = queries.select(*keys, F.col(query_id).alias("_qid"))
    return ids.join(total, [*keys, "_qid"], "left").select(
        *keys, F.col("_qid").alias(query_id), F.coalesce("neighbours", F.lit(0)).alias("neighbours")
    )


def pairs_within(
    queries: DataFrame, refs: DataFrame, query_id: str, ref_id: str, radius: float, keys: Sequence[str] = (),
    leaf: int = BLOCK_POINTS, bucket: int = BUCKET_POINTS,
) -> DataFrame:
    """Every reference within `radius` of each query: keys, query id, ref id, distance.

    A block says its pairs for at most some PAIR_ASKS queries in a group. Rows grow with the pairs there are.
    """
    keys = list(keys)
    tree = KdTree(refs, keys, ref_id, leaf, bucket)
    asked = _met(queries, keys, query_id)
    own = [*keys, "_qid"]
    # the tree knows one id of a place; all ids that lie there are met by it
    every = _known(refs, keys).select(*keys, F.col(ref_id).alias("_every"), *XYZ)
    held = tree.points.select(*keys, "_node", *XYZ).join(every, [*keys, *XYZ])
    found = T.StructType([*asked.select(*own).schema.fields, held.schema["_every"], T.StructField("distance", T.DoubleType())])

    def solve(left: pa.Table, right: pa.Table) -> list[list]:
        there, place, out = _place(right, XYZ), _place(left, XYZ), []
        for part, mask in _within(place, there, radius):
            rows, at = np.nonzero(mask)
            near = left.slice(part.start, ASK_ROWS).select(own).take(pa.array(rows))
            out.append([*near.columns, right.column("_every").take(pa.array(at)), pa.array(_apart(place[part][rows], there[at]))])
        return out

    cut = checkpointed(_routed(asked, tree, _crossing(radius, True), [*own, *XYZ], "_node string"))
    pairs = _opened(cut, tree, held, solve, found, PAIR_ASKS)
    return pairs.select(*keys, F.col("_qid").alias(query_id), F.col("_every").alias(ref_id), "distance")


def cells_within(points: DataFrame, point_id: str, cell: Sequence[str], radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of cells (keys, a, b) of whole-numbered indices `cell` of which some two points lie within `radius`.

    A block says each pair of cells once for the queries it meets, so rows grow with cells, not with pairs of points.
    """
    keys, cell = list(keys), list(cell)
    index = F.struct(*cell)
    named = points.withColumn("_at", index)
    tree = KdTree(named, keys, point_id)
    homes = named.select(*keys, F.col(point_id).alias("_rid"), *cell)
    refs = tree.points.select(*keys, "_node", "_rid", *XYZ).join(homes, [*keys, "_rid"])
    asked = _met(refs.withColumnRenamed("_rid", point_id), keys, point_id, cell)
    ends = [T.StructField(f"{side}{i}", T.LongType()) for side in "ab" for i in range(len(cell))]
    pairs = T.StructType([*[asked.schema[k] for k in keys], *ends])

    def numbered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The table ordered by cell, the cells and where each of them starts."""
        table = table.sort_by([(c, "ascending") for c in cell])
        at = _place(table, cell).astype(np.int64)
        starts = np.nonzero(np.r_[True, (np.diff(at, axis=0) != 0).any(1)])[0]
        return table, at[starts], starts

    def solve(left: pa.Table, right: pa.Table) -> list[list]:
        left, asks, begins = numbered(left)
        right, there, starts = numbered(right)
        place, spots = _place(left, XYZ), _place(right, XYZ)
        near = [np.logical_or.reduceat(mask, starts, axis=1) for _, mask in _within(place, spots, radius)]
        a, b = np.nonzero(np.logical_or.reduceat(np.concatenate(near), begins, axis=0))
        same = left.slice(0, 1).take(pa.array(np.zeros(len(a), np.int64)))
        return [[*[same.column(k) for k in keys], *[pa.array(asks[a, i]) for i in range(len(cell))], *[pa.array(there[b, i]) for i in range(len(cell))]]]

    cut = checkpointed(_routed(asked, tree, _crossing(radius, True), [*keys, "_qid", *XYZ, *cell], "_node string"))
    met = _opened(cut, tree, refs.select(*keys, "_node", *XYZ, *cell), solve, pairs).distinct()
    side = lambda s: F.struct(*[F.col(f"{s}{i}").alias(c) for i, c in enumerate(cell)]).alias(s)
    return met.select(*keys, side("a"), side("b")).where("a <> b")


def voxel(cell: float, origin: Sequence[Column] | None = None, names: Sequence[str] = ("ix", "iy", "iz")) -> dict[str, Column]:
    origin = origin or [F.lit(0.0)] * 3
    return {n: F.floor((F.col(c) - o) / cell).cast("long") for n, c, o in zip(names, XYZ, origin)}


def support_distance(a: DataFrame, c: DataFrame, keys: Sequence[str], a_id: str, c_id: str) -> DataFrame:
    """Larger of the two median nearest-sample distances between two supports of each key."""
    from .ordered import exact_quantiles

    there = exact_quantiles(nearest_k(a, c, a_id, c_id, keys=keys), keys, "distance", {"_there": 0.5})
    back = exact_quantiles(nearest_k(c, a, c_id, a_id, keys=keys), keys, "distance", {"_back": 0.5})
    return there.join(back, list(keys)).select(*keys, F.greatest("_there", "_back").alias("support_distance"))


def sight_samples(
    lines: DataFrame, line_id: str, start_m: float = 0.3, step_m: float = 0.04, end_margin: tuple[float, float] = (0.15, 0.05),
    behind_m: float | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """Samples along camera-to-point lines (ox, oy, oz) -> (x, y, z), short of the point or behind it, with the lines' keys."""
    size = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in XYZ[1:]), (F.col("x") - F.col("ox")) ** 2))
    rows = lines.withColumn("_len", size).where("_len > 0")
    margin = F.greatest(F.lit(end_margin[0]), end_margin[1] * F.col("_len"))
    first, last = (F.lit(start_m), F.col("_len") - margin) if behind_m is None else (margin, F.lit(behind_m))
    count = F.ceil((last - first) / step_m).cast("int")
    rows = rows.withColumn("_i", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))))
    along = first + F.col("_i") * step_m + (F.lit(0.0) if behind_m is None else F.col("_len"))
    rows = rows.withColumn("_along", along)
    return rows.select(
        *keys, F.struct(F.col(line_id).alias("line"), F.col("_i").alias("i")).alias("sample"), F.col(line_id),
        *[(F.col(f"o{c}") + F.col("_along") * (F.col(c) - F.col(f"o{c}")) / F.col("_len")).alias(c) for c in XYZ],
    )


def sight_line_hits(
    lines: DataFrame, surface: DataFrame, line_id: str, surface_id: str, radius: float = 0.04, keys: Sequence[str] = (), **sampling
) -> DataFrame:
    """Samples per line, and how many have surface of the same keys within `radius`; line ids count inside their keys."""
    keys = list(keys)
    samples = sight_samples(lines, line_id, keys=keys, **sampling)
    near = nearest_k(samples, surface, "sample", surface_id, keys=keys, max_distance=radius)
    hits = near.groupBy(*keys, F.col("sample.line").alias(line_id)).agg(F.count("*").alias("blocked"))
    totals = samples.groupBy(*keys, line_id).agg(F.count("*").alias("samples"))
    own = [*keys, line_id]
    return lines.select(*own).join(totals, own, "left").join(hits, own, "left").select(
        *own, F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("blocked", F.lit(0)).alias("blocked")
    )


def turned_to_cameras(points: DataFrame, cameras: DataFrame, point_id: str, camera_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """Points with the nearest camera of their keys and their normal (nx, ny, nz) turned to it."""
    keys = list(keys)
    near = nearest_k(points, cameras, point_id, camera_id, keys=keys).select(*keys, point_id, camera_id)
    places = cameras.select(*keys, camera_id, *[F.col(c).alias(f"_c{c}") for c in XYZ])
    rows = points.join(near, [*keys, point_id]).join(places, [*keys, camera_id])
    facing = sum((F.col(f"n{c}") * (F.col(f"_c{c}") - F.col(c)) for c in XYZ[1:]), F.col("nx") * (F.col("_cx") - F.col("x")))
    turn = F.when(facing < 0, -1.0).otherwise(1.0)
    return rows.withColumns({f"n{c}": turn * F.col(f"n{c}") for c in XYZ}).drop(*[f"_c{c}" for c in XYZ])


# ---- image-plane joins ----

def tiled(boxes: DataFrame, tile: float, prefix: str = "") -> DataFrame:
    """Every box once per image tile it touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(prefix + lo) / tile), F.floor(F.col(prefix + hi) / tile))
    return boxes.withColumn("_tx", F.explode(span("x1", "x2"))).withColumn("_ty", F.explode(span("y1", "y2")))


def box_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], right_id: str, tile: float = 64.0) -> DataFrame:
    """Overlapping boxes of the same keys; each pair is found only at the tile of its overlap's corner.

    Right columns come back with an `r_` prefix.
    """
    other = right.select(*keys, F.col(right_id).alias(f"r_{right_id}"), *[F.col(n).alias(f"r_{n}") for n in right.columns if n not in (*keys, right_id)])
    pairs = tiled(left, tile).join(tiled(other, tile, "r_"), [*keys, "_tx", "_ty"])
    corner_x, corner_y = F.greatest(F.col("x1"), F.col("r_x1")), F.greatest(F.col("y1"), F.col("r_y1"))
    return pairs.where(
        (b.intersection(b.box(), b.box("r_")) > 0)
        & (F.floor(corner_x / tile) == F.col("_tx")) & (F.floor(corner_y / tile) == F.col("_ty"))
    ).drop("_tx", "_ty")


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: Sequence[str], u: str, v: str, tile: float = 8.0) -> DataFrame:
    """Pixels whose centre lies in a box of the same frame, met through image tiles."""
    placed = points.withColumns({"_tx": F.floor((F.col(u) + 0.5) / tile), "_ty": F.floor((F.col(v) + 0.5) / tile)})
    return placed.join(tiled(boxes, tile), [*keys, "_tx", "_ty"]).where(
        b.holds_pixel(b.box(), F.col(v), F.col(u))
    ).drop("_tx", "_ty")
