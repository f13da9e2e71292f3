"""Repeated runs of lines, cut where the lines themselves say so.

A rolling hash over the hashes of the last `WINDOW` lines ends a chunk wherever it is 0 modulo `EVERY`, so
equal runs of lines are cut alike wherever they stand, and an inserted line moves the cuts near it only.
A chunk of two lines or more that occurs again, in any document or further on in its own, is removed there;
its first occurrence by (doc_id, chunk) stays. Hashes only nominate: a chunk goes when its bytes equal
those of the occurrence that stays.

`without_runs` takes more: every repeated run of lines with `LEAST_WORDS` words or more, single lines too,
wherever the cuts fall. The shortest runs of that many words that begin or end at each line cover every longer
run from its first line to its last; each that occurred before goes. Blank lines do not count, and go only
inside a run. Runs are told apart by SHA-256 of their lines. What goes has an equal line further ahead, so the
first of all equal lines stays.

DataFrame functions only. Line hashes are digits of md5, which other engines have too.

Defined cases: a null text stays null and an empty one empty; `deduplicated` never removes single
lines, however common; rows that repeat a doc_id with other texts are documents of their own, and rows that
repeat both count as one document and get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phases import settled

WINDOW, EVERY, LEAST_LINES = 2, 3, 2
LEAST_WORDS = 50


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def with_chunks(docs: DataFrame) -> DataFrame:
    """docs and `_chunks`, the texts of the chunks in order, with their numbers of lines and hashes."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    ends = F.filter(
        F.sequence(F.lit(1), F.size("_lines")),
        lambda i: (i == F.size("_lines"))
        | ((F.element_at("_hashes", i) + 31 * F.when(i > 1, F.element_at("_hashes", F.greatest(i - 1, F.lit(1)))).otherwise(0)) % EVERY == 0),
    )

    def chunk(end: Column, k: Column) -> Column:
        start = F.when(k > 0, F.element_at("_ends", F.greatest(k, F.lit(1)))).otherwise(0)
        own = F.slice("_lines", start + 1, end - start)
        return F.struct(F.array_join(own, "\n").alias("body"), (end - start).alias("lines"), F.xxhash64(F.slice("_hashes", start + 1, end - start)).alias("h"))

    return (
        docs.withColumn("_lines", lines).withColumn("_hashes", F.transform("_lines", line_hash)).withColumn("_ends", ends)
        .withColumn("_chunks", F.transform("_ends", chunk)).drop("_lines", "_hashes", "_ends")
    )


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, `gone`, the numbers of the chunks that repeat an earlier one, and `all`, how many chunks there are, for documents that have any."""
    own = docs.select("doc_id", "text")
    light = with_chunks(own).select("doc_id", F.posexplode(F.transform("_chunks", lambda c: F.struct(c["lines"], c["h"]))).alias("i", "c"))
    light = light.where(F.col("c.lines") >= LEAST_LINES).select("doc_id", "i", F.col("c.h").alias("h"))
    twice = light.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "i")).alias("a"), F.max(F.struct("doc_id", "i")).alias("b"))
    twice = twice.where("n > 1 AND NOT (a <=> b)").select("h")
    nominated = light.join(twice, "h").groupBy("doc_id").agg(F.collect_set("i").alias("some"))
    texts = with_chunks(own.join(nominated, "doc_id")).select("doc_id", F.size("_chunks").alias("all"), F.explode(F.transform("some", lambda i: F.struct(i.alias("i"), F.element_at("_chunks", i + 1).alias("c")))).alias("x"))
    texts = texts.select("doc_id", "all", "x.i", "x.c.h", "x.c.body")
    first = texts.groupBy("h", "body").agg(F.min(F.struct("doc_id", "i")).alias("keep"))
    again = texts.join(first, ["h", "body"]).where(F.struct("doc_id", "i") > F.col("keep"))
    return again.groupBy("doc_id").agg(F.collect_set("i").alias("gone"), F.max("all").alias("all"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the repeated chunks taken out of `text`, `_removed_lines`, `_removed_chunks`, `_n_chunks` and `_emptied`.

    `_emptied` (every chunk is removed) comes from counts alone, so a filter on it does not cut texts again. Columns
    of these four names are replaced.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("v"))
    gone = repeated(docs.select(key.alias("doc_id"), "text")).select(
        F.col("doc_id").alias("key"), F.col("gone").alias("_gone"), F.coalesce(F.size("gone") >= F.col("all"), F.lit(False)).alias("emptied"),
    )
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    out = with_chunks(own.join(gone, "key", "left").withColumn("text", F.col("row.text")))
    out = out.withColumn("_tagged", F.transform("_chunks", lambda c, k: F.struct(c["body"].alias("body"), c["lines"].alias("lines"), F.coalesce(F.array_contains("_gone", k), F.lit(False)).alias("out"))))
    kept = F.array_join(F.transform(F.filter("_tagged", lambda c: ~c["out"]), lambda c: c["body"]), "\n")
    lines = F.aggregate("_tagged", F.lit(0), lambda a, c: a + F.when(c["out"], c["lines"]).otherwise(0))
    made = {
        "_removed_lines": lines.cast("long"), "_removed_chunks": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
        "_n_chunks": F.size("_chunks").cast("long"), "_emptied": F.coalesce("emptied", F.lit(False)),
    }
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)
    given = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return out.select(*given, *[column.alias(name) for name, column in made.items()])


def run_ends(places: Column) -> Column:
    """How many of the solid lines `places`, from the first on, make up LEAST_WORDS words; null if all do not."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    more = lambda a, s: F.when(a["words"] >= LEAST_WORDS, a).otherwise(F.struct((a["words"] + s["w"]).alias("words"), (a["n"] + 1).alias("n")))
    return F.aggregate(places, start, more, lambda a: F.when(a["words"] >= LEAST_WORDS, a["n"]))


def shortest_runs(own: DataFrame) -> DataFrame:
    """doc_id, `first` and `last` line and `digest` of the shortest runs of LEAST_WORDS words that begin or end at a line.

    A solid line holds a word or more, so LEAST_WORDS of them are enough to look at.
    """
    solid = F.filter(
        F.transform("_lines", lambda line, i: F.struct(i.alias("i"), F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))), lambda s: s["w"] > 0,
    )
    places = F.when(F.size("_solid") > 0, F.sequence(F.lit(1), F.size("_solid"))).otherwise(F.array().cast("array<int>"))

    def ahead(k: Column) -> Column:
        return F.struct(k.alias("a"), (k + run_ends(F.slice("_solid", k, F.lit(LEAST_WORDS))) - 1).alias("b"))

    def back(k: Column) -> Column:
        low = F.greatest(k - (LEAST_WORDS - 1), F.lit(1))
        return F.struct((k - run_ends(F.reverse(F.slice("_solid", low, k - low + 1))) + 1).alias("a"), k.alias("b"))

    runs = F.array_distinct(F.filter(F.concat(F.transform("_places", ahead), F.transform("_places", back)), lambda r: r["a"].isNotNull() & r["b"].isNotNull()))
    rows = own.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn("_solid", solid).withColumn("_places", places)
    rows = rows.select("doc_id", "_lines", "_solid", F.explode(runs).alias("r"))
    body = F.array_join(F.transform(F.slice("_solid", F.col("r.a"), F.col("r.b") - F.col("r.a") + 1), lambda s: F.get("_lines", s["i"])), "\n")
    return rows.select(
        "doc_id", F.element_at("_solid", F.col("r.a"))["i"].alias("first"), F.element_at("_solid", F.col("r.b"))["i"].alias("last"), F.unhex(F.sha2(body, 256)).alias("digest"),
    )


def repeated_lines(own: DataFrame) -> DataFrame:
    """doc_id and `lines`, the numbers of the lines in chunks or runs that occurred before."""
    gone = settled(repeated(own).select("doc_id", "gone"))
    flags = F.flatten(F.transform("_chunks", lambda c, k: F.array_repeat(F.array_contains("gone", k), c["lines"])))
    cut = with_chunks(own.join(gone, "doc_id")).withColumn("_flags", flags)
    cut = settled(cut.select("doc_id", F.filter(F.transform("_flags", lambda f, i: F.when(f, i)), lambda i: i.isNotNull()).alias("lines")))
    runs = shortest_runs(own)
    place = F.struct("doc_id", "first", "last")
    kept = runs.groupBy("digest").agg(F.min(place).alias("keep"), F.max(place).alias("other")).where("keep <> other").select("digest", "keep")
    again = runs.join(kept, "digest").where(place > F.col("keep"))
    again = settled(again.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last")))).alias("lines")))
    return settled(cut.unionByName(again).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines")))


def without_runs(docs: DataFrame) -> DataFrame:
    """docs without the lines of repeated chunks and runs; documents of which no solid line is left go."""
    key = F.struct("doc_id", F.xxhash64("text").alias("v"))
    gone = repeated_lines(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("lines").alias("gone"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key")).join(gone, "key", "left")
    out = out.withColumn("text", F.col("row.text"))
    lines = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i))
    out = out.withColumn("kept", F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n")))
    out = out.where(F.col("kept").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.coalesce("kept", "text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS v FROM l
), e AS (
  SELECT *, (v + 31 * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {EVERY} = 0 AS ends FROM h
), c AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e
), chunk AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines FROM c GROUP BY doc_id, k
), marked AS (
  SELECT *, lines >= {LEAST_LINES} AND row_number() OVER (PARTITION BY body, lines >= {LEAST_LINES} ORDER BY doc_id, k) > 1 AS gone FROM chunk
)
SELECT doc_id, count(*) AS n_chunks, sum(gone::INT)::BIGINT AS removed_chunks, coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS removed_lines,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
