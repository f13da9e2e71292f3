"""License texts in documents: MinHash bands over overlapping windows retrieve, exact containment verifies.

A template of `length` words defines windows an eighth longer than itself, which leaves room for inserted words,
that start every eighth of its length (every word for short ones). A document holds a template when some window,
wherever it starts, holds at least `least` of the template's shingles. A window's signature has BANDS bands of
ROWS minima over its word shingles. Two sets of similarity s meet in some band with probability
1 - (1 - s ** ROWS) ** BANDS. Of a window that holds 0.8 of the template, the nearest strided one loses at most a
sixteenth, so s is at least 0.73 / (1 + 1.125 - 0.73) = 0.52 and the probability over 0.9999. Bands only retrieve:
around a retrieved window every start within one step on either side is verified.

A window that shares no shingle with any template cannot share a minimum either; only documents and
windows around shared shingles are signed, which loses nothing. Shingles have five words, or all words of
a shorter template. Words are lower-cased runs of letters, digits, dots and plus signs between them.

DataFrame functions only. Defined cases: null and empty texts match nothing; templates without words are
left out; rows that repeat a doc_id are one document; equal templates match alike; of equal containments the
earliest start is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, BANDS, ROWS = 5, 32, 2
BLOCK = 4096

#: Notices as they stand in texts, by licence.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
     "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation"),
    ("mit-full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
     "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall "
     "be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
     "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
     "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
     "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
     "IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND "
     "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
     "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
     "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
     "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
     "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
     "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}.+]+|\.(?![\p{L}\p{N}])"), lambda w: w != "")


def shingles(tokens: Column, size: int) -> Column:
    """A hash for every run of `size` words."""
    count = F.size(tokens) - size + 1
    places = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.element_at(tokens, i + k) for k in range(size)]))


def bands(window: Column) -> Column:
    """The band hashes of a set of shingles."""
    def minimum(k: int) -> Column:
        return F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*[F.xxhash64(F.lit(b), *[minimum(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def builtin_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id string, text string")


def scan(docs: DataFrame, templates: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, template_id, windows (unlike best starts around accepted windows), first_word (of the best, from 0) and containment (its)."""
    known = templates.where("template_id IS NOT NULL").select("template_id", F.explode(F.array(words(F.col("text")))).alias("t")).where(F.size("t") > 0).distinct()
    rows = known.collect()  # the templates: a given list of short texts, taken in blocks below
    out = None
    for size in sorted({min(SHINGLE, len(r["t"])) for r in rows}):
        own = known.where(F.least(F.lit(SHINGLE), F.size("t")) == size).select(
            "template_id", F.size("t").alias("length"), F.array_distinct(shingles(F.col("t"), size)).alias("set"),
        )
        lengths = sorted({len(r["t"]) for r in rows if min(SHINGLE, len(r["t"])) == size})
        hashes = sorted({r["h"] for r in own.select(F.explode("set").alias("h")).collect()})
        for k in range(0, len(hashes), BLOCK):
            part = _scan(docs, own, hashes[k: k + BLOCK], size, lengths, least)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "'' template_id", "0L windows", "0 first_word", "0D containment")
    return out.groupBy("doc_id", "template_id", "start").agg(F.max("containment").alias("containment")).groupBy("doc_id", "template_id").agg(
        F.count("*").alias("windows"), F.max_by("start", F.struct("containment", -F.col("start"))).cast("int").alias("first_word"), F.max("containment").alias("containment"),
    )


def _scan(docs: DataFrame, own: DataFrame, shared: list[int], size: int, lengths: list[int], least: float) -> DataFrame:
    # explode(array(x)) makes x once; a plain column would be copied into every expression, lambdas included
    base = docs.select("doc_id", F.explode(F.array(words(F.col("text")))).alias("t"))
    base = base.select("doc_id", F.explode(F.array(shingles(F.col("t"), size))).alias("all"))
    places = F.filter(F.transform("all", lambda h, i: F.when(h.isin(shared), i)), lambda i: i.isNotNull())

    def around(length: int) -> Column:
        """The strided windows that hold a shared shingle, each with the shingles one step further on either side."""
        step, held = max(1, length // 8), length + length // 8 - size + 1
        starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(
            F.sequence(F.greatest(F.lit(0), F.ceil((p - held + 1) / step)).cast("int"), F.greatest(F.floor(p / step), F.ceil((p - held + 1) / step)).cast("int")),
            lambda s: s * step,
        ))))

        def window(s: Column) -> Column:
            first = F.greatest(F.lit(0), s - step)
            return F.struct(
                F.lit(length).alias("length"), F.lit(held).alias("held"), (s - first + step).alias("last"), first.alias("first"),
                F.array_distinct(F.slice("all", s + 1, held)).alias("window"), F.slice("all", first + 1, s - first + step + held).alias("region"),
            )

        return F.transform(starts, window)

    every = F.concat(*[around(n) for n in lengths])
    windows = base.select("doc_id", "all", F.explode(F.array(places)).alias("places")).where(F.size("places") > 0)
    windows = windows.select("doc_id", F.explode(every).alias("w")).select("doc_id", "w.*").distinct()
    signed = windows.select("*", F.posexplode(bands(F.col("window"))).alias("band", "key")).drop("window")
    wanted = own.select("template_id", "length", "set", F.posexplode(bands(F.col("set"))).alias("band", "key"))
    met = signed.join(wanted, ["length", "band", "key"]).drop("band", "key").distinct()

    def share(found: Column) -> Column:
        return F.size(F.array_intersect(found, F.col("set"))) / F.size("set")

    # no window of the region holds more than the region does
    met = met.where(share(F.col("region")) >= least)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("last")), lambda j: F.struct(
        share(F.slice("region", j + 1, F.col("held"))).alias("containment"), (-(F.col("first") + j)).alias("back"),
    )))
    found = met.select("doc_id", "template_id", F.explode(F.array(best)).alias("best")).where(F.col("best.containment") >= least)
    return found.select("doc_id", "template_id", (-F.col("best.back")).alias("start"), "best.containment")
