"""Mixing sources to target weights with a splitting tree of exact block quotas.

Documents are hashed into blocks of about `block_words` words within their source. A source's target says
how many whole passes over its blocks the mix makes and how far a last, partial pass goes; that gives an
exact quota of blocks per source. A binary tree deals the quotas to output shards: a node hands half of
its blocks to its left child, and how many of them come from each source is a multivariate hypergeometric
draw, made source by source, so every node's children add up to it exactly. A shard then takes the next
blocks of each source's permuted sequence, disjoint by construction, and is shuffled by itself.

DataFrame functions only. Draws come from hashes, so reruns agree.

Defined cases: a null text has no words; sources are ordered by code point, null last and a source of its
own; documents without words are taken zero times; rows with one doc_id share their block, each counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
CHUNK = 64
TREE_STEPS = 6
FITTING = 4
SWAPS = 40


def uniform(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def permuted(place: Column, n: Column, *key: Column) -> Column:
    """Where a permutation of 0 .. n - 1, told by `key`, sends `place`: in every round a place and its mirror image
    about a hashed point change places or not, as a hash of the greater of the two says."""

    def swapped(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(r, *key, F.greatest(x, mirror)), F.lit(2)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SWAPS)), place.cast("long"), swapped)


def sized_column(name: str) -> Column:
    """doc_id and source as they are; size is the number of words."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") if name == "size" else F.col(name)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of every row."""
    return docs.select(*[sized_column(c).alias(c) for c in ("doc_id", "source", "size")])


def targets(rows: DataFrame, block_words: int) -> DataFrame:
    """Per source: number, words, weight, target, blocks, whole passes and the words of the last pass.

    Targets share the total by weight and stop at MOST_PASSES times the source. Sources reach that limit
    in the order of limit / weight, so the level at which the rest share is found with running sums.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("source_id", F.lit(len(WEIGHTS))) + 1)
    by = by.withColumn("source_id", number).withColumn("weight", weight).withColumn("most", MOST_PASSES * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = Window.orderBy(F.col("most") / F.col("weight"), "source_id").rowsBetween(Window.unboundedPreceding, -1)
    by = (
        by.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
        .withColumn("spent", F.coalesce(F.sum("most").over(ordered), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(ordered), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("spent")) / (F.col("weights") - F.col("gone")))
    )
    # the first source, in that order, that its share doesn't fill sets the level of all after it
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "source_id", "level"))).over(everything)
    by = by.withColumn("target", F.least(F.col("most").cast("double"), free["level"] * F.col("weight")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return by.select(
        "source", "source_id", "source_size", "target",
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long").alias("blocks"), passes.cast("long").alias("passes"),
    ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))


def last_pass(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: `reach`, the blocks that the last pass enters, and the words left for the last of these.

    Running sums go by chunks of blocks, then over the chunks, so a source is never in one task.
    """
    words = rows.groupBy("source_id", "block").agg(F.sum("size").alias("words")).withColumn("chunk", F.floor(F.col("block") / CHUNK))
    chunks = words.groupBy("source_id", "chunk").agg(F.sum("words").alias("chunk_words"))
    before = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("earlier", F.coalesce(F.sum("chunk_words").over(before), F.lit(0)))
    inside = Window.partitionBy("source_id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("earlier") + F.coalesce(F.sum("words").over(inside), F.lit(0))
    found = words.join(chunks, ["source_id", "chunk"]).withColumn("start", start).join(sources.select("source_id", "rest"), "source_id")
    found = found.where("start < rest").groupBy("source_id").agg(F.max(F.struct("block", (F.col("rest") - F.col("start")).alias("left"))).alias("last"))
    return sources.join(found, "source_id", "left").select(
        sources["*"], F.coalesce(F.col("last.block") + 1, F.lit(0)).alias("reach"), F.coalesce("last.left", F.lit(0.0)).alias("left_words"),
    )


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` blocks out of `total` are among the `good` ones, by inversion from the mode.

    The chances of mode + k and mode - k follow from their neighbours; twelve deviations to either side
    hold all of the mass that a double can tell.
    """
    total, good, drawn = (x.cast("double") for x in (total, good, drawn))
    mode = F.floor((drawn + 1) * (good + 1) / (total + 2)).cast("double")
    variance = drawn * good * (total - good) * (total - drawn) / (total * total * F.greatest(total - 1, F.lit(1.0)))
    steps = F.sequence(F.lit(1), (F.ceil(12 * F.sqrt(F.greatest(variance, F.lit(0.0)))) + 8).cast("int"))

    def higher(weight, x):  # from x - 1 to x
        return weight * F.coalesce(F.try_divide((good - x + 1) * (drawn - x + 1), x * (total - good - drawn + x)), F.lit(0.0))

    def lower(weight, x):  # from x + 1 to x
        return weight * F.coalesce(F.try_divide((x + 1) * (total - good - drawn + x + 1), (good - x) * (drawn - x)), F.lit(0.0))

    def step(state, k):
        return F.struct(higher(state["up"], mode + k).alias("up"), lower(state["down"], mode - k).alias("down"))

    def add(state, k):
        next_ = step(state, k)
        return F.struct(next_["up"].alias("up"), next_["down"].alias("down"), (state["sum"] + next_["up"] + next_["down"]).alias("sum"))

    one = F.lit(1.0)
    mass = F.aggregate(steps, F.struct(one.alias("up"), one.alias("down"), one.alias("sum")), add)["sum"]
    wanted = u * mass

    def walk(state, k):
        next_ = step(state, k)
        above = state["sum"] + next_["up"]
        below = above + next_["down"]
        found = F.coalesce(state["found"], F.when(wanted < above, mode + k), F.when(wanted < below, mode - k))
        return F.struct(next_["up"].alias("up"), next_["down"].alias("down"), below.alias("sum"), found.alias("found"))

    first = F.struct(one.alias("up"), one.alias("down"), one.alias("sum"), F.when(wanted < 1, mode).alias("found"))
    drawn_good = F.coalesce(F.aggregate(steps, first, walk)["found"], mode)
    return F.when((total <= 0) | (drawn <= 0) | (good <= 0), 0.0).otherwise(drawn_good).cast("long")


def dealt(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(shard, source_id, k): the quotas(source_id, k) split among 2 ** depth shards."""
    parts = F.sort_array(F.collect_list(F.struct("source_id", "k")))
    tree = quotas.agg(parts.alias("parts")).select(F.lit(1).cast("long").alias("node"), "parts")
    sum_ = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["k"])

    def draw(state, part):
        u = uniform(F.lit(seed), F.col("node"), part["source_id"])  # nodes are numbered as in a heap
        x = hypergeometric(state["total"], part["k"], state["drawn"], u)
        own = F.struct(part["source_id"].alias("source_id"), x.alias("k"))
        return F.struct(
            (state["total"] - part["k"]).alias("total"), (state["drawn"] - x).alias("drawn"), F.concat(state["out"], F.array(own)).alias("out"),
        )

    half = F.struct(sum_.alias("total"), F.floor(sum_ / 2).alias("drawn"), F.slice("parts", 1, 0).alias("out"))
    right = F.zip_with("parts", "left", lambda p, q: F.struct(p["source_id"].alias("source_id"), (p["k"] - q["k"]).alias("k")))
    children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("parts")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("parts")))
    for level in range(depth):  # every level has the same small plan, and is written before the next is laid out
        tree = checkpointed(tree.withColumn("left", F.aggregate("parts", half, draw)["out"]).select(F.explode(children).alias("c")).select("c.node", "c.parts"))
        if level % TREE_STEPS == TREE_STEPS - 1:
            tree = tree.repartition("node")
    return tree.select((F.col("node") - (1 << depth)).alias("shard"), F.explode("parts").alias("p")).select("shard", "p.source_id", "p.k")


def mix(docs: DataFrame, seed: int = 7, block_words: int = 1 << 15, blocks_per_shard: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows, draws). rows: doc_id, source, size, source_size, target, source_id, block, tail (in the part of the
    block where the last pass ends). draws: shard, source_id, block, pass, partial, place - one row per block of
    the mix, `place` in shuffled order inside its shard; a partial draw holds the rows of its block with `tail`."""
    rows = checkpointed(sized(docs))
    sources = checkpointed(targets(rows, block_words))
    rows = rows.join(sources.drop("passes", "rest"), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    plan = checkpointed(last_pass(rows, sources))
    quota = F.col("passes") * F.col("blocks") + F.col("reach")
    total = plan.agg(F.sum(quota)).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, total / blocks_per_shard))))

    shares = dealt(plan.select("source_id", quota.alias("k")), depth, seed)
    earlier = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("first", F.coalesce(F.sum("k").over(earlier), F.lit(0))).where("k > 0")
    draws = shares.select("shard", "source_id", F.explode(F.sequence("first", F.col("first") + F.col("k") - 1)).alias("at"))
    draws = draws.join(plan.select("source_id", "blocks", "passes", "reach", "left_words"), "source_id")
    turn = F.floor(F.col("at") / F.col("blocks"))
    within = F.when(F.col("pass") < F.col("passes"), permuted(F.pmod("at", F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("source_id"), F.col("pass")))
    within = within.otherwise(F.col("at") - F.col("passes") * F.col("blocks"))
    draws = draws.withColumn("pass", turn).withColumn("pass", F.least("pass", "passes")).withColumn("block", within)
    draws = draws.select(
        "shard", "source_id", "block", "pass", ((F.col("pass") == F.col("passes")) & (F.col("block") == F.col("reach") - 1)).alias("partial"),
        uniform(F.lit(seed), "shard", "source_id", "block", "pass").alias("place"),
    )
    # only the rows of one block per source are ordered, those whose block the last pass ends in
    rows = rows.join(plan.select("source_id", "reach", "left_words"), "source_id")
    edge = (F.col("block") == F.col("reach") - 1) & (F.col("size") > 0)
    ends = rows.where(edge).withColumn("tail", F.lit(False))
    for _ in range(FITTING):  # what still fits, in hashed order, then what fits into the rest
        fits = ~F.col("tail") & (F.col("size") <= F.col("left_words"))
        order = Window.partitionBy("source_id", "fits").orderBy(F.xxhash64("doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        ends = ends.withColumn("fits", fits).withColumn("new", F.col("fits") & (F.sum("size").over(order) <= F.col("left_words")))
        spent = F.sum(F.when(F.col("new"), F.col("size")).otherwise(0)).over(Window.partitionBy("source_id"))
        ends = ends.withColumn("left_words", F.col("left_words") - spent).withColumn("tail", F.col("tail") | F.col("new")).drop("fits", "new")
    rows = rows.where(~edge).withColumn("tail", F.lit(False)).unionByName(checkpointed(ends))
    return rows.drop("blocks", "reach", "left_words"), checkpointed(draws)


def taken(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each row, repeats counted."""
    times = draws.groupBy("source_id", "block").agg(F.sum((~F.col("partial")).cast("long")).alias("whole"), F.max("partial").alias("part"))
    count = F.coalesce("whole", F.lit(0)) + F.when(F.coalesce("part", F.lit(False)) & F.col("tail"), 1).otherwise(0)
    return rows.join(times, ["source_id", "block"], "left").select("doc_id", "size", "source_size", "target", (F.col("size") * count).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, once per time taken, in shards `_shard` with shuffled order `_place`.

    Rows are told by doc_id, source and size; if rows agree in all three and only some of them fit into the last
    pass, all are taken. Columns named `_shard` or `_place` are replaced.
    """
    rows, draws = mix(docs, **options)
    same = ["doc_id", "source", "size"]
    picks = rows.groupBy(*same, "source_id", "block").agg(F.max("tail").alias("tail")).join(draws, ["source_id", "block"]).where("NOT partial OR tail")
    picks = picks.select(*[F.col(c).alias(f"p_{c}") for c in same], "shard", F.struct("place", F.xxhash64("doc_id", "shard")).alias("place"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, *[sized_column(c).alias(c) for c in same])
    out = keyed.join(picks, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in same])
    given = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("_shard", "_place")]
    return out.select(*given, F.col("shard").alias("_shard"), F.col("place").alias("_place")).repartition("_shard").sortWithinPartitions("_shard", "_place")
