"""Order-aware building blocks that never send one whole key to one task.

A window over `partitionBy(recording)` puts a recording in one task. Here the order column is cut
into chunks of bounded width; windows run inside (key, chunk), and what has to cross a chunk edge
travels through one summary row per chunk. Group quantiles are exact, but only the few values around
the wanted rank are ever sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

HOUR_NS = 3_600_000_000_000
WHOLE = 1 << 18
FEW_KEYS = 4096


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def carried(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    lag: Mapping | None = None,
    lead: Mapping | None = None,
    before: Mapping | None = None,
    after: Mapping | None = None,
    running: Mapping | None = None,
) -> DataFrame:
    """Add ordered columns per key, chunk by chunk.

    lag / lead: value on the previous / next row. before / after: last / next non-null value, the
    row itself included. running: sum up to and including the row. `chunk` must not decrease along
    `order`; rows of one (key, chunk) are the only rows that share a task.
    """
    lag, lead, before, after, running = (m or {} for m in (lag, lead, before, after, running))
    keys, order = list(keys), list(order)
    groups = [("lag", lag), ("lead", lead), ("before", before), ("after", after), ("running", running)]
    base = df.withColumn("_chunk", chunk)
    for kind, wanted in groups:
        for name, source in wanted.items():
            base = base.withColumn(f"_{kind}_{name}", as_column(source))

    stamp = F.struct(*order)
    summaries = []
    for kind, wanted in groups:
        for name in wanted:
            source = F.col(f"_{kind}_{name}")
            boxed = F.struct(source.alias("v"))
            if kind == "lag":
                summary = F.max_by(boxed, stamp)
            elif kind == "lead":
                summary = F.min_by(boxed, stamp)
            elif kind == "before":
                summary = F.max_by(boxed, F.when(source.isNotNull(), stamp))
            elif kind == "after":
                summary = F.min_by(boxed, F.when(source.isNotNull(), stamp))
            else:
                summary = F.sum(source)
            summaries.append(summary.alias(f"_s_{kind}_{name}"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    totals = base.groupBy(*keys, "_chunk").agg(*summaries)
    carries = []
    for kind, wanted in groups:
        for name in wanted:
            summary = F.col(f"_s_{kind}_{name}")
            carry = {
                "lag": F.lag(summary).over(across),
                "lead": F.lead(summary).over(across),
                "before": F.last(summary, ignorenulls=True).over(earlier),
                "after": F.first(summary, ignorenulls=True).over(later),
                "running": F.sum(summary).over(earlier),
            }[kind]
            carries.append(carry.alias(f"_c_{kind}_{name}"))
    totals = totals.select(*keys, "_chunk", *carries)

    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    onward = inside.rowsBetween(0, Window.unboundedFollowing)
    local = {}
    for kind, wanted in groups:
        for name in wanted:
            source = F.col(f"_{kind}_{name}")
            boxed = F.struct(source.alias("v"))
            present = F.when(source.isNotNull(), boxed)
            local[f"_l_{kind}_{name}"] = {
                "lag": F.lag(boxed).over(inside),
                "lead": F.lead(boxed).over(inside),
                "before": F.last(present, ignorenulls=True).over(upto),
                "after": F.first(present, ignorenulls=True).over(onward),
                "running": F.sum(source).over(upto),
            }[kind]
    # rows are partitioned for the windows already; by its estimate either side might be broadcast, rows included
    joined = base.withColumns(local).join(totals.hint("merge"), [*keys, "_chunk"])
    out = {}
    for kind, wanted in groups:
        for name in wanted:
            own, carry = F.col(f"_l_{kind}_{name}"), F.col(f"_c_{kind}_{name}")
            if kind == "running":
                # own stays null only while every value of the chunk so far is null
                out[name] = F.when(own.isNull() & carry.isNull(), F.lit(None)).otherwise(
                    F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0))
                )
            else:
                out[name] = F.coalesce(own, carry)["v"]
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[value.alias(name) for name, value in out.items()])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value,
    probs: Mapping[str, float],
    *,
    count: str | None = None,
    accuracy: int = 20_000,
    whole: int = WHOLE,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, without gathering a key's values anywhere.

    A mergeable sketch brackets each wanted rank of a key of `WHOLE` rows or more; the brackets of these few keys go to
    every task, rows outside are counted on the map side and only distinct values inside (an 8 / accuracy share of the
    key) are ranked. Smaller keys are ranked whole.
    """
    keys, names = list(keys), list(probs)
    rows = df.select(*keys, as_column(value).cast("double").alias("_v")).where(_present([*keys, "_v"]))
    margin = 4.0 / accuracy
    edges = []
    for p in probs.values():
        edges += [max(0.0, p - margin), min(1.0, p + margin)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"))
    large = F.broadcast(sketch.where(F.col("_n") >= whole).select(*keys, "_e"))
    bracketed = rows.join(large, keys, "left") if keys else rows.join(large, F.lit(True), "left")
    # names of its own: a key may be called side, j or v
    mark = lambda j, side, v: F.struct(F.lit(j).alias("_j"), F.lit(side).alias("_side"), v.alias("_at"))
    nothing = F.lit(None).cast("double")
    marks = []
    for j in range(len(names)):
        low, high = F.col("_e")[2 * j], F.col("_e")[2 * j + 1]
        marks.append(
            F.when(F.col("_v") < low, mark(j, -1, nothing)).when(F.col("_v") <= high, mark(j, 0, F.col("_v"))).otherwise(mark(j, 1, nothing))
        )
    # a key ranked whole needs one ranking for all its ranks
    chosen = F.when(F.col("_e").isNull(), F.array(mark(-1, 0, F.col("_v")))).otherwise(F.array(*marks))
    counted = (
        bracketed.select(*keys, F.explode(chosen).alias("_m"))
        .groupBy(*keys, "_m._j", "_m._side", "_m._at")
        .agg(F.count("*").alias("_c"))
    )
    ranking = Window.partitionBy(*keys, "_j")
    ranked = counted.withColumns({
        "_cum": F.sum("_c").over(ranking.orderBy("_side", "_at").rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.sum("_c").over(ranking),
    })
    picks = []
    for j, (name, p) in enumerate(probs.items()):
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        mine = F.col("_j").isin(j, -1) & (F.col("_side") == 0)
        picks.append(F.min(F.when(mine & (F.col("_cum") > F.floor(spot)), F.col("_at"))).alias(f"_lo{j}"))
        picks.append(F.min(F.when(mine & (F.col("_cum") > F.ceil(spot)), F.col("_at"))).alias(f"_hi{j}"))
    picked = ranked.groupBy(*keys, "_n").agg(*picks)
    out = []
    for j, (name, p) in enumerate(probs.items()):
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        part = spot - F.floor(spot)
        # weights of both ends, as quantile_cont has them: half of a sum and half of a difference round differently
        out.append((F.col(f"_lo{j}") * (1 - part) + F.col(f"_hi{j}") * part).alias(name))
    extra = [F.col("_n").alias(count)] if count else []
    return picked.select(*keys, *extra, *out)


def _present(names: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in names])


def beside(rows: DataFrame, summary: DataFrame, keys: Sequence[str], size: str, whole: int = WHOLE) -> DataFrame:
    """Rows joined with the summary row of their key, `size` rows to a key, so that no key lies in one task.

    A summary of at most `FEW_KEYS` rows goes to every task. Of a longer one only the rows of keys of `whole` rows or
    more do; their rows are dealt over all tasks of the join by which the others meet theirs.
    """
    keys, own = list(keys), rows.columns
    added = [c for c in summary.columns if c not in (*keys, size)]
    summary = checkpointed(summary)
    if summary.count() <= FEW_KEYS:
        return rows.join(F.broadcast(summary.select(*keys, *added)), keys).select(*own, *added)
    boxed = summary.select(*keys, F.col(size).alias("_size"), F.struct(*added).alias("_s"))
    large = F.broadcast(boxed.where(F.col("_size") >= whole).select(*keys, F.col("_s").alias("_big")))
    dealt = rows.join(large, keys, "left").withColumn(
        "_deal", F.when(F.col("_big").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*own), F.lit(4096)))
    )
    met = dealt.join(boxed.select(*keys, F.lit(0).cast("long").alias("_deal"), "_s"), [*keys, "_deal"], "left")
    met = met.withColumn("_s", F.coalesce("_big", "_s")).where("_s is not null")
    return met.select(*own, *[F.col("_s")[c].alias(c) for c in added])


def value_slices(df: DataFrame, keys: Sequence[str], value: str, slices: int = 64) -> DataFrame:
    """Add `_slice`, a per-key slice of `value` cut at sketched quantiles, usable as a `carried` chunk."""
    edges = [i / slices for i in range(1, slices)]
    sketch = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(value, edges, 10_000).alias("_edges"))
    joined = beside(df, sketch, keys, "_n") if keys else df.crossJoin(F.broadcast(sketch.drop("_n")))
    return joined.withColumn(
        "_slice", F.size(F.filter("_edges", lambda e: e < F.col(value)))
    ).drop("_edges")


def ranked_by(
    df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], name: str = "ordinal"
) -> DataFrame:
    """Add a 1-based rank by (value, ties) per key, spread over value slices instead of one task per key."""
    sliced = value_slices(df, keys, value)
    return carried(
        sliced, keys, [value, *ties], F.col("_slice"), running={name: F.lit(1).cast("long")}
    ).drop("_slice")
