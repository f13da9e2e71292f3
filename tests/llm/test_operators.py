"""Each operator against a brute-force version on small rows with nulls, ties, repeats and clashing columns."""

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_rows import passage, rows

from strideframe.llm import (
    decontaminate, jaccard_join, licenses, line_dedup, mixing, neighbours, quality, secrets, suffix_dedup, toxicity,
)

SMALL = "/root/testdata/sf0.001"


def test_suffix_dedup(docs, nothing):
    raw = [(r[0], (r[1] or "").encode()) for r in rows()]
    count = Counter(b[i: i + 200] for _, b in raw for i in range(len(b) - 199))
    want = []
    for k, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i: i + 200]] > 1:
                gone[i: i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((k, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.deduplicated(docs).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert suffix_dedup.deduplicated(nothing).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    x[7] = x[3]
    data = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [1.0], "x"), (950, [None] * 16, "x")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, c string")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 300, 50):
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(300), -score))[:5]
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in got[q])
        hit += len(set(best) & {v for _, v, _ in got[q]})
    assert set(got) == set(range(0, 300, 50)) and hit / 30 >= 0.9
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbour_graph_settles(spark):
    """From few and poor first links four rounds are not enough; rounds go on until links have settled."""
    x = np.random.default_rng(5).standard_normal((3000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "c long, embedding array<double>")
    sketches = neighbours.settled(neighbours.sketched(frame, 2))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    similar = unit @ unit.T
    np.fill_diagonal(similar, -2)
    best = np.argsort(-similar, axis=1)[:, :5]

    def recall(**given):
        links = {r["c"]: {e["id"] for e in r["links"]} for r in neighbours.neighbour_graph(sketches, 8, 2, **given).collect()}
        return np.mean([len(links.get(i, set()) & set(b.tolist())) / 5 for i, b in enumerate(best)])

    four, settled = recall(rounds=4), recall()
    assert settled > four + 0.02
    assert neighbours.grown(10_000) == (40, 4) and neighbours.grown(40_000) == (56, 6)


def test_decontamination(spark, docs, nothing):
    items = [(1, passage(30)), (2, "one two"), (3, passage(9, 5)), (4, None), (5, "zz yy"), (6, "!!"), (11, passage(30)), (12, passage(40, 4))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for r in rows():
        w, hit, found = words(r[1]), set(), set()
        for k, t in items:
            v = words(t)
            m = min(10, len(v))
            for s in range(len(v) - m + 1) if m else ():
                for i in range(len(w) - m + 1):
                    if w[i: i + m] == v[s: s + m]:
                        hit |= set(range(i, i + m))
                        found.add(k)
        want.append((r[0], len(w), len(hit), tuple(sorted(found))))

    def seen(found):
        return sorted((r["doc_id"], r["f"]["n_words"], sum(b - a for a, b in zip(r["f"]["ranges"][::2], r["f"]["ranges"][1::2])), tuple(sorted(set(r["f"]["items"])))) for r in found.select("doc_id", "f").collect())

    assert seen(decontaminate.scanned(docs, benchmark, name="f")) == sorted(want)
    own = decontaminate.blocks
    decontaminate.blocks = lambda b, w: own(b, w, 100)  # several blocks, one after the other
    try:
        assert seen(decontaminate.scanned(docs, benchmark, name="f")) == sorted(want)
    finally:
        decontaminate.blocks = own
    assert decontaminate.decontaminated(nothing, benchmark).count() == 0
    assert decontaminate.scanned(docs, benchmark.limit(0), name="f").where("size(f.items) > 0").count() == 0


def test_jaccard_join(docs, nothing):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i: i + 3]) for i in range(len(w) - 2)])

    sets = [(r[0], shingles(r[1])) for r in rows()]
    least = {k: k for k, _ in sets}
    for _ in sets:
        for a, s in sets:
            for b, t in sets:
                if s and t and 100 * len(s & t) >= 90 * len(s | t):
                    least[a] = least[b] = min(least[a], least[b])
    got = jaccard_join.joined(docs).collect()
    assert sorted(map(tuple, got)) == sorted((k, len(s), least[k]) for k, s in sets)
    assert jaccard_join.joined(nothing).count() == 0
    assert jaccard_join.representatives(docs).columns == docs.columns


def test_linked_sets_share_a_block_key():
    rng = np.random.default_rng(5)
    seen = 0
    for _ in range(400):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(9, 400)), dtype=np.uint64))
        lost, new = rng.integers(0, max(2, len(x) // 12), 2)
        y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        common, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if common == union or 100 * common < 90 * union:
            continue
        row, token, n = np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), np.array([len(x), len(y)])
        own, above = jaccard_join.bands(n, 90)
        keys = [set(), set()]
        for band, chosen in ((own, n > 0), (own + 1, above)):
            rows_, found = jaccard_join.block_keys(row, token, token, np.where(chosen, jaccard_join.blocks_in(band, 90), 0), band)
            for r, k in zip(rows_, found):
                keys[r].add(int(k))
        assert keys[0] & keys[1]
        seen += 1
    assert seen > 100


def test_variants_of_one_text_are_not_all_compared(spark, monkeypatch):
    """Forty texts, each some 20 percent off one original, and a near copy of every fourth."""
    import random

    draw, words = random.Random(4), passage(400, 900).split()

    def changed(base, k):
        out = list(base)
        for at in draw.sample(range(len(out)), k):
            out[at] = f"x{draw.randrange(10**9)}"
        return out

    variants = [changed(words, 25) for _ in range(40)]
    texts = dict(enumerate([words, *variants, *[changed(v, 2) for v in variants[::4]]]))
    sets = {k: {tuple(w[i: i + 3]) for i in range(len(w) - 2)} for k, w in texts.items()}
    want = {k: k for k in sets}
    for _ in sets:
        for a, s in sets.items():
            for b, t in sets.items():
                if 100 * len(s & t) >= 90 * len(s | t):
                    want[a] = want[b] = min(want[a], want[b])
    plain, read = jaccard_join.compared, []

    def counted(pairs, *rest):
        read.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "compared", counted)
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.joined(frame).collect()} == want
    assert len(set(want.values())) < len(want) and sum(read) < 200, read


def test_line_dedup_equals_its_sql(spark, docs, nothing):
    import compare
    import duckdb

    from strideframe.llm import queries

    got = queries.op9_line_dedup(spark, SMALL).toPandas()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert compare.differences(compare.plain(got), compare.plain(connection.execute(line_dedup.ORACLE).df())) is None
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    assert kept[3] is None and kept[4] == "" and kept[6] == "One two"
    assert line_dedup.deduplicated(nothing).count() == 0


def test_near_copies_of_the_pipeline(spark):
    """Pairs on either side of both rules, against a brute-force run."""
    import corpus_pipeline

    base = {k: passage(100, 300 + k).split() for k in range(4)}
    changed = lambda k, at: " ".join("new" if i in at else w for i, w in enumerate(base[k]))
    texts = {10 * k: " ".join(w) for k, w in base.items()}
    # within 5 words and 0.8 but not 3 words and 0.9; outside both; within both; equal sets
    texts |= {1: changed(0, {50, 53}), 11: changed(1, {20, 50, 80}), 21: changed(2, {0}), 31: texts[30].upper()}

    def jaccard(a, b, n):
        s, t = ({tuple(x.lower().split()[i: i + n]) for i in range(len(x.split()) - n + 1)} for x in (a, b))
        return len(s & t) / len(s | t)

    assert jaccard(texts[0], texts[1], 5) >= 0.8 and jaccard(texts[0], texts[1], 3) < 0.9 and jaccard(texts[10], texts[11], 5) < 0.8
    want = [k for k, t in texts.items() if not any(j < k and jaccard(t, u, 5) >= 0.8 for j, u in texts.items())]
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, frame, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want) == [0, 10, 11, 20, 30]


def test_repeated_runs_of_lines(spark):
    """Passages of 1 to 10 lines, 54 words in all, in unlike contexts, against a brute-force run over all pairs of places."""
    texts, planted = {}, {}
    for n in range(1, 11):
        words = passage(54, 100 + n).split()
        cuts = [k * 54 // n for k in range(n + 1)]
        planted[n] = [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]
        for copy in range(3):
            around = [passage(7 + copy, 1000 * n + 10 * copy + k) for k in range(6)]
            inside = planted[n] if copy < 2 else [x for p in planted[n] for x in (p, " ")]
            texts[10 * n + copy] = "\n".join([*around[: 1 + copy], *inside, *around[1 + copy:]])
    texts |= {200: passage(49, 7), 201: passage(3, 8) + "\n" + passage(49, 7), 202: "a\n\nb", 203: None, 204: "", 205: planted[4][0]}
    texts[206] = "\n".join(planted[3])
    frame = spark.createDataFrame([*texts.items(), (202, "other\n" + planted[1][0]), (206, texts[206])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.without_runs(frame).collect() if r["doc_id"] != 202)
    solid = {k: [x for x in (t or "").split("\n") if x.strip()] for k, t in texts.items()}
    want, seen = [], []
    for k in sorted(texts):
        gone, own = set(), solid[k]
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                part = own[a:b]
                if len(" ".join(part).split()) >= 50 and any(part == old[i: i + len(part)] for old in seen for i in range(len(old))):
                    gone |= set(range(a, b))
        want.append((k, [x for i, x in enumerate(own) if i not in gone]))
        seen.append(own)
    assert [(k, [x for x in (t or "").split("\n") if x.strip()]) for k, t in got] == [(k, w) for k, w in want if k != 202 and (w or not solid[k])]
    assert all(not set(planted[n]) & set(dict(got)[10 * n + 1].split("\n")) for n in planted) and 206 not in dict(got)
    assert dict(got)[203] is None and dict(got)[204] == "" and dict(got)[205] == planted[4][0]
    assert sorted(r["text"] for r in line_dedup.without_runs(frame).where("doc_id = 202").collect()) == ["a\n\nb", "other"]
    assert line_dedup.without_runs(frame.limit(0)).count() == 0


def test_mixing(docs, nothing):
    plan, draws = mixing.mix(docs, block_words=200, blocks_per_shard=2)
    got = mixing.taken(plan, draws).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], size(r[1])) for r in rows())
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by = {r["target"]: r["source_size"] for r in got}
    assert abs(sum(by) - sum(size(r[1]) for r in rows())) < 1e-6 and all(t <= 3 * s + 1e-9 for t, s in by.items())
    again = mixing.taken(*mixing.mix(docs, block_words=200, blocks_per_shard=2)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.taken(*mixing.mix(nothing)).count() == 0


def test_rows_with_one_doc_id_and_clashing_columns(spark):
    """Repeated doc_ids with unlike texts, and columns named like the operators' own, lose and break nothing."""
    lines = [f"line {k} of a passage" for k in range(12)]
    a, b = "\n".join(lines), "\n".join([*lines, "one more"])
    frame = spark.createDataFrame(
        [(1, a, 1, "k", 5, True), (2, a, 2, "k", 5, True), (2, "unlike " + passage(80), 3, "k", 5, None), (2, "unlike " + passage(80), 3, "k", 5, None), (3, b, 4, None, 5, None)],
        "doc_id long, text string, _found int, _key string, _gone int, row boolean",
    )
    out = line_dedup.deduplicated(frame)
    assert out.columns[:6] == frame.columns and out.count() == 5
    assert {r["_found"] for r in line_dedup.without_runs(frame).collect()} >= {1, 3}
    assert line_dedup.without_runs(frame).columns == frame.columns
    kept = jaccard_join.representatives(frame, 5, 80)
    assert kept.columns == frame.columns and sorted((r["doc_id"], r["_found"]) for r in kept.collect()) == [(1, 1), (2, 3)]
    clean = decontaminate.decontaminated(frame, spark.createDataFrame([(9, passage(80))], "item_id long, text string"))
    assert clean.columns == frame.columns and sorted(r["_found"] for r in clean.collect()) == [1, 2, 4]


def test_the_mix_itself(spark, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    texts = [(k, " ".join(["w"] * (5 + k % 40)), "abc"[k % 7 % 3], "x") for k in range(3000)] + [(1, "w w w", "c", "x"), (1, "w w", "a", "x")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string, _shard string")
    plan, draws = mixing.mix(frame, block_words=300, blocks_per_shard=4)
    rows_ = mixing.taken(plan, draws).join(frame.select("doc_id", "source"), "doc_id").collect()
    by_id = {r[0]: r[2] for r in texts[:3000]}
    taken, target = Counter(), {}
    for r in mixing.taken(plan, draws).collect():
        target[r["source_size"]] = r["target"]
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items()) and len(rows_) >= 3002 and by_id[0] == "a"
    out = mixing.mixed(frame, block_words=300, blocks_per_shard=4)
    assert out.columns == ["doc_id", "text", "source", "_shard", "_place"]
    got = out.collect()
    assert sum(size(r["text"]) for r in got) == sum(taken.values())
    shards = {r["_shard"]: [] for r in got}
    for r in got:
        shards[r["_shard"]].append(r["source"])
    assert len(shards) > 4 and sum(len(set(s)) > 1 for s in shards.values()) > len(shards) / 2
    places = spark.range(97).select(mixing.permuted(F.col("id"), F.lit(97), F.lit(3)).alias("p")).collect()
    order = [r["p"] for r in places]
    assert sorted(order) == list(range(97)) and len({(y - x) % 97 for x, y in zip(order, order[1:])}) > 30


def test_hypergeometric_draws(spark):
    frame = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), mixing.uniform("id")).alias("x"))
    x = np.array([r["x"] for r in frame.collect()])
    assert 0 <= x.min() and x.max() <= 10 and abs(x.mean() - 4) < 0.1 and abs(x.var() - 10 * 0.4 * 0.6 * 40 / 49) < 0.2


def test_secrets(docs, nothing):
    models = secrets.learn(docs)
    for r in docs.select("doc_id", "text", secrets.spans(F.col("text"), models).alias("s")).collect():
        base = [(x["kind"], x["start"], x["end"]) for x in r["s"] if x["base"]]
        assert base == [(k, a, b) for k, a, b, _ in secrets.base_spans(r["text"] or "")]
        if r["doc_id"] == 14:
            assert [k for k, _, _ in base] == ["assign", "access", "hex"]
    assert secrets.learn(nothing) == {}
    hex_like = secrets.Automaton(["0123456789abcdef01234567", "ffe0912bc7a4410d5e6f7788"] * 40)
    assert hex_like.score("a0b1c2d3e4f5a6b7c8d9") > hex_like.score("ordinarywordsonlyhere") + 1


def test_licences(spark, docs, nothing):
    got = {(r["doc_id"], r["template_id"]) for r in licenses.scan(docs, licenses.builtin_templates(spark)).collect()}
    assert got == {(15, "all-rights-reserved"), (15, "mit")}
    long = dict(licenses.TEMPLATES)["mit-grant"]
    changed = spark.createDataFrame([(1, "x " * 33 + long.replace("restriction", "limits") + " y" * 50), (2, long[:60])], "doc_id long, text string")
    assert [(r["doc_id"], r["template_id"]) for r in licenses.scan(changed, licenses.builtin_templates(spark)).collect()] == [(1, "mit-grant")]
    assert licenses.scan(nothing, licenses.builtin_templates(spark)).count() == 0


def test_learned_models_on_held_out_rows(spark, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    teach = labels.where(toxicity.learning(F.col("doc_id")))
    model = quality.fit(docs, quality.grades_of(teach))
    assert (np.diff(model.thresholds) > 0).all()
    got = docs.select("doc_id", model.tail(model.score(F.col("text")), 1).alias("p")).join(labels, "doc_id").where(~toxicity.learning(F.col("doc_id"))).toPandas()
    assert ((got.p >= 0.5) == (got.quality > 0)).mean() > 0.95
    toxic = toxicity.fit(docs, labels)
    got = docs.select("doc_id", toxic.score(F.col("text")).alias("p")).join(labels, "doc_id").where(~toxicity.learning(F.col("doc_id"))).toPandas()
    assert (got.p[got.toxic == 0] < 0.3).mean() > 0.95 and (got.p[got.toxic > 0] >= 0.3).mean() >= 0.5
    assert quality.select(nothing, quality.fit(nothing, quality.grades_of(labels))).count() == 0
    empty = toxicity.fit(nothing, labels.limit(0))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert all(0 <= r["p"] <= 1 for r in odd.select(empty.score(F.col("text")).alias("p")).collect())


def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()


if __name__ == "__main__":
    pytest.main([__file__])
