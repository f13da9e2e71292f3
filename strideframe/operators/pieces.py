"""Touching pieces of occupied cells, density filters and what survives them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import checkpointed
from .graph import components
from .ordered import ranked_by
from .spatial import cells_within, count_within, nearest_k, sight_line_hits, voxel

INDEX = ("ix", "iy", "iz")
AXES = ("x", "y", "z")
BITS = 20


def packed(names: Sequence[str] = INDEX) -> Column:
    """One long per cell and group: three 20-bit indices; the group travels in `_g`."""
    x, y, z = (F.col(n) for n in names)
    return (x * (1 << BITS) + y) * (1 << BITS) + z


def _offsets(forward: bool) -> list[tuple[int, int, int]]:
    every = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return [o for o in every if (o > (0, 0, 0) if forward else o != (0, 0, 0))]


def occupied_cells(points: DataFrame, key: str, cell: float) -> tuple[DataFrame, DataFrame]:
    """Points with cell indices from each group's minimum, and the distinct cells with point counts."""
    lows = points.groupBy(key).agg(*[F.min(c).alias(f"_{c}") for c in AXES])
    placed = points.join(lows, key).withColumns(voxel(cell, g.columns("_x", "_y", "_z"))).drop("_x", "_y", "_z")
    return placed, placed.groupBy(key, *INDEX).agg(F.count("*").alias("points"))


def neighbour_pairs(cells: DataFrame, key: str, forward: bool) -> DataFrame:
    """Touching occupied cells: (key, indices) beside (n_ix, n_iy, n_iz)."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", o)]) for o in _offsets(forward)])
    spread = cells.select(key, *INDEX).withColumn("_o", F.explode(steps))
    aimed = spread.select(key, *INDEX, *[(F.col(n) + F.col(f"_o.{a}")).alias(f"n_{n}") for n, a in zip(INDEX, "abc")])
    there = cells.select(key, *[F.col(n).alias(f"n_{n}") for n in INDEX])
    return aimed.join(there, [key, *[f"n_{n}" for n in INDEX]])


def _labelled(cells: DataFrame, key: str) -> DataFrame:
    """Cells with the component they touch; node ids combine the group and the cell."""
    node = F.struct(F.col(key).alias("g"), packed().alias("c"))
    edges = neighbour_pairs(cells, key, True).select(
        node.alias("a"), F.struct(F.col(key).alias("g"), packed([f"n_{n}" for n in INDEX]).alias("c")).alias("b")
    )
    found = components(cells.select(node.alias("id")), edges)
    return cells.withColumn("id", node).join(found, "id").select(*cells.columns, F.col("component.c").alias("component"))


def piece_labels(cells: DataFrame, key: str, neighbours: int = 0) -> DataFrame:
    """Component per occupied cell. With `neighbours`, only cells with that many filled neighbours extend a
    chain; other cells join a chain cell they touch (the highest label wins) or form their own pieces."""
    if not neighbours:
        return _labelled(cells, key)
    around = neighbour_pairs(cells, key, False).groupBy(key, *INDEX).agg(F.count("*").alias("_filled"))
    marked = checkpointed(cells.join(around, [key, *INDEX], "left").fillna(0, ["_filled"]))
    chain = checkpointed(_labelled(marked.where(F.col("_filled") >= neighbours).drop("_filled"), key))
    loose = marked.where(F.col("_filled") < neighbours).drop("_filled")
    touching = neighbour_pairs(marked.drop("_filled"), key, False)
    chained = chain.select(key, *[F.col(n).alias(f"n_{n}") for n in INDEX], F.col("component").alias("_c"))
    adopted = touching.join(chained, [key, *[f"n_{n}" for n in INDEX]]).groupBy(key, *INDEX).agg(F.max("_c").alias("component"))
    taken = loose.join(adopted, [key, *INDEX])
    rest = _labelled(checkpointed(loose.join(adopted, [key, *INDEX], "left_anti")), key)
    # pieces of the rest never share a label with a chain: they are shifted past every packed cell
    rest = rest.withColumn("component", F.col("component") + F.lit(1 << (3 * BITS)))
    columns = chain.columns
    return chain.unionByName(taken.select(columns)).unionByName(rest.select(columns))


def piece_ranks(labelled: DataFrame, key: str) -> DataFrame:
    """Size and rank (0 is the largest, lower label first on ties) of every piece."""
    sizes = labelled.groupBy(key, "component").agg(F.sum("points").alias("piece_points"))
    ranked = ranked_by(sizes.withColumn("_neg", -F.col("piece_points")), [key], "_neg", ["component"], "rank")
    return ranked.select(key, "component", "piece_points", (F.col("rank") - 1).alias("rank"))


def largest_pieces(points: DataFrame, key: str, cell: float = 0.02, keep: int = 50, min_points: int = 5000, neighbours: int = 0) -> DataFrame:
    """Points with their piece's size and rank, and `kept`: among the largest and big enough."""
    placed, cells = occupied_cells(points, key, cell)
    labelled = checkpointed(piece_labels(checkpointed(cells), key, neighbours))
    ranks = piece_ranks(labelled, key)
    rows = placed.join(labelled.select(key, *INDEX, "component"), [key, *INDEX]).join(ranks, [key, "component"])
    return rows.withColumn("kept", (F.col("rank") < keep) & (F.col("piece_points") >= min_points)).drop(*INDEX)


def radius_keep(points: DataFrame, key: str, point: str, radius: float = 0.05, minimum: int = 16) -> DataFrame:
    """Points with more than `minimum` neighbours (itself included) inside a radius."""
    return count_within(points, points, point, point, radius, keys=[key]).withColumn("kept", F.col("neighbours") > minimum)


def statistical_keep(points: DataFrame, key: str, point: str, neighbours: int = 20, ratio: float = 2.0) -> DataFrame:
    """Points whose mean distance to their neighbours stays under mean + ratio x deviation of the group."""
    near = nearest_k(points, points.withColumnRenamed(point, "_ref"), point, "_ref", k=neighbours, keys=[key])
    means = near.groupBy(key, point).agg(F.avg("distance").alias("mean_m"))
    limits = means.where("mean_m > 0").groupBy(key).agg(F.avg("mean_m").alias("_avg"), F.stddev_samp("mean_m").alias("_std"))
    return means.join(limits, key, "left").withColumn(
        "kept", F.coalesce((F.col("mean_m") > 0) & (F.col("mean_m") < F.col("_avg") + ratio * F.col("_std")), F.lit(False))
    ).drop("_avg", "_std")


def density_clusters(points: DataFrame, key: str, point: str, eps: float = 0.05, min_points: int = 10) -> DataFrame:
    """Density clusters: core points within `eps` chain together; border points join their nearest core point.

    Cells of side eps / sqrt(3) hold only mutual neighbours, so a cell's core points belong together,
    and two cells need one link if any two of their core points are near enough.
    """
    counts = count_within(points, points, point, point, eps, keys=[key])
    core = checkpointed(points.join(counts.where(F.col("neighbours") >= min_points).select(key, point), [key, point]))
    side = eps / 3**0.5
    celled = core.withColumns(voxel(side))
    home = F.struct(F.col(key).alias("g"), *[F.col(n).alias(n) for n in INDEX])
    cells = celled.select(home.alias("cell")).distinct()
    node = lambda end: F.struct(F.col(key).alias("g"), *[F.col(f"{end}.{n}").alias(n) for n in INDEX]).alias(end)
    edges = cells_within(celled, point, INDEX, eps, keys=[key]).select(node("a"), node("b"))
    labels = components(cells.select(F.col("cell").alias("id")), edges)
    cored = celled.withColumn("id", home).join(labels, "id").select(key, point, *AXES, "component")
    border = points.join(core.select(key, point), [key, point], "left_anti")
    near = nearest_k(border, core.withColumnRenamed(point, "_ref"), point, "_ref", keys=[key], max_distance=eps)
    adopted = near.join(cored.select(key, F.col(point).alias("_ref"), "component"), [key, "_ref"]).select(key, point, "component")
    whole = cored.select(key, point, "component").unionByName(adopted)
    names = cored.groupBy("component").agg(F.min(point).alias("cluster"))
    return points.select(key, point).join(whole.join(names, "component").select(key, point, "cluster"), [key, point], "left")


def cluster_keep(clusters: DataFrame, key: str, minimum: int = 1000) -> DataFrame:
    sizes = clusters.where("cluster is not null").groupBy(key, "cluster").agg(F.count("*").alias("cluster_points"))
    return clusters.join(sizes, [key, "cluster"], "left").withColumn(
        "kept", F.coalesce(F.col("cluster_points") >= minimum, F.lit(False))
    )


def piece_majority(points: DataFrame, key: str, point: str, eps: float = 0.03, max_angle_deg: float = 30.0) -> DataFrame:
    """Points linked by nearness and aligned normals; a piece mostly suspect goes, and so do suspects.

    The surface holds one point per voxel, so a 27-cell neighbourhood of side `eps` is small.
    """
    celled = points.withColumns(voxel(eps))
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", o)]) for o in [(0, 0, 0), *_offsets(False)]])
    shown = celled.withColumn("_o", F.explode(steps)).select(
        key, *[(F.col(n) + F.col(f"_o.{a}")).alias(n) for n, a in zip(INDEX, "abc")],
        F.col(point).alias("_p"), *[F.col(c).alias(f"_{c}") for c in (*AXES, "nx", "ny", "nz")],
    )
    pairs = celled.join(shown, [key, *INDEX]).where(F.col("_p") < F.col(point))
    gap = g.length(g.minus(g.columns(*AXES), g.columns("_x", "_y", "_z")))
    aligned = F.abs(g.dot(g.columns("nx", "ny", "nz"), g.columns("_nx", "_ny", "_nz"))) >= F.cos(F.radians(F.lit(max_angle_deg)))
    edges = pairs.where((gap <= eps) & aligned).select(F.col(point).alias("a"), F.col("_p").alias("b"))
    labels = components(points.select(F.col(point).alias("id")), edges)
    rows = points.join(labels.withColumnRenamed("id", point), point)
    share = rows.groupBy("component").agg(F.avg(F.col("suspect").cast("double")).alias("suspect_share"))
    return rows.join(share, "component").withColumn("kept", ~F.col("suspect") & (F.col("suspect_share") <= 0.5))


def survivors(points: DataFrame, raw: DataFrame, kept: DataFrame, point: str, raw_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """Whether each point's nearest raw point of the same keys is among the kept ones."""
    keys = list(keys)
    near = nearest_k(points, raw, point, raw_id, keys=keys)
    shown = kept.select(*keys, raw_id).distinct().withColumn("shown", F.lit(True))
    return near.join(shown, [*keys, raw_id], "left").select(*keys, point, raw_id, F.coalesce("shown", F.lit(False)).alias("shown"))


def removed_cells(original: DataFrame, key: str, cell: float, gone: Column) -> DataFrame:
    """Display cells in which most original points are missing, on the half-cell thinning grid."""
    lows = original.groupBy(key).agg(*[(F.min(c) - cell / 2).alias(f"_{c}") for c in AXES])
    placed = original.join(lows, key).withColumns(voxel(cell, g.columns("_x", "_y", "_z")))
    return placed.groupBy(key, *INDEX).agg(
        F.count("*").alias("points"), F.count(F.when(gone, 1)).alias("gone")
    ).withColumn("removed", F.col("gone") > F.col("points") / 2)


def trial_score(
    surface: DataFrame, lines: DataFrame, measured: DataFrame, floor_y: float, far_from: float = 2.5, radius: float = 0.04, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per keys and distance side: blocked sight lines, distance to tracked points, coverage and floor counts.

    surface(point, x, y, z); lines(line, ox, oy, oz, x, y, z, depth); measured(sample, x, y, z), all with `keys`.
    """
    from .ordered import exact_quantiles

    keys = list(keys)
    side = F.when(F.col("depth") < far_from, "near").otherwise("far")
    hits = sight_line_hits(lines, surface, "line", "point", radius=radius, keys=keys)
    sides = lines.select(*keys, "line", side.alias("side"))
    blocked = hits.join(sides, [*keys, "line"]).groupBy(*keys, "side").agg(
        (F.sum("blocked") / F.greatest(F.sum("samples"), F.lit(1))).alias("blocked_share")
    )
    gaps = nearest_k(lines, surface, "line", "point", keys=keys).join(sides, [*keys, "line"])
    typical = exact_quantiles(gaps, [*keys, "side"], "distance", {"median_m": 0.5}).join(
        gaps.groupBy(*keys, "side").agg(F.avg((F.col("distance") <= 0.10).cast("double")).alias("within_10cm")), [*keys, "side"]
    )
    covered = nearest_k(measured, surface, "sample", "point", keys=keys, max_distance=0.05).groupBy(*keys).agg(F.count("*").alias("_near"))
    total = measured.groupBy(*keys).agg(F.count("*").alias("_all"))
    floor = surface.groupBy(*keys).agg(
        F.count("*").alias("surface_points"), F.count(F.when(F.col("y") < floor_y - 0.10, 1)).alias("below_floor"),
        F.count(F.when(F.abs(F.col("y") - floor_y) <= 0.05, 1)).alias("near_floor"),
    )
    if keys:
        rows = blocked.join(typical, [*keys, "side"]).join(floor, keys).join(total, keys).join(covered, keys, "left")
    else:
        # three one-row aggregates beside two rows
        rows = blocked.join(typical, "side").crossJoin(F.broadcast(floor.crossJoin(covered).crossJoin(total)))
    return rows.withColumn("covered", F.coalesce("_near", F.lit(0)) / F.col("_all")).drop("_near", "_all")
