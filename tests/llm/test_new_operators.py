"""Ranked search, fingerprints and tokenizer alignment against plain versions on small rows."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from text_rows import passage, rows

from strideframe.llm import alignment, fingerprints, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    held = [h for h in held if h[2]]
    big, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for name, text in items:
        scored = []
        for d, c, n in held:
            m = 25 + 75 * n * big // total
            s = sum(
                times * math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in Counter(terms(text)).items() if c[t]
            )
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(name, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark, docs, nothing):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)] + ["É", "Ab9", "x-y"]
    texts = [(k, " ".join(rng.choice(words, rng.integers(0, 40)).tolist())) for k in range(400)] + [(None, "w1 w1 w2"), (7, "w1 w2"), (8, None), (9, "")]
    items = [(k, " ".join(rng.choice(words, rng.integers(0, 12)).tolist())) for k in range(25)] + [(90, None), (91, ""), (92, "absent"), (93, "w1 W1 w1 w2")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items + items[:2], "item_id long, text string")
    want = plain_ranking(texts, items)
    # ties without a doc_id order are settled by doc_id; here all scores of one item and doc_id differ or rows are equal
    for options in ({}, {"shard": 50}, {"block": 60}):
        got = sorted((tuple(r) for r in ranked_search.ranked(frame, asked, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)
        assert got == want
    assert ranked_search.ranked(nothing, asked).count() == 0 and ranked_search.ranked(docs, asked.limit(0)).count() == 0
    own = [(r[0], r[1]) for r in rows()]
    items = [(1, passage(20)), (2, "one two")]
    got = sorted((tuple(r) for r in ranked_search.ranked(docs, spark.createDataFrame(items, "item_id long, text string")).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain_ranking(own, items)


def test_reading_stops_before_the_lists_end():
    n = 40_000
    rng = np.random.default_rng(1)
    tf = np.where(np.arange(n) < 20, 500, 1) + rng.integers(0, 2, n)  # twenty documents stand out in both lists
    ends = pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (np.tile([0, 1], n).astype(np.int32), np.repeat(tf, 2))]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, 600)), *lists], ["doc_id", "n", "terms", "tf"])
    shard = ranked_search.Shard([batch], np.array([700, 300]), n, 600 * n)
    full = np.bincount(shard.doc, shard.impact, minlength=n).astype(np.int64)
    best = np.lexsort((np.arange(n), -full))[:10]
    doc, score = shard.best(np.array([0, 1]), np.array([1, 1]), 10)
    assert doc.tolist() == best.tolist() and score.tolist() == full[best].tolist()
    assert shard.read < 2 * n


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i: i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))}


def test_fingerprints(spark, docs, nothing):
    given = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: r[0])
    got = fingerprints.compared_to_edits(docs).collect()
    assert len(got) == len(given)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    # repeated rows are equal here, so the order within a doc_id does not matter
    for (doc_id, text), (_, following) in zip(given, [*given[1:], given[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        mine = next(r for r in by_id[doc_id] if r["edited_sha256"] == digest)
        by_id[doc_id].remove(mine)
        assert mine["n_chars"] == len(text)
        x, y = (np.frombuffer(base64.b64decode(mine[c]), "<u4") for c in ("fingerprint", "edited_fingerprint"))
        assert mine["near_edited"] == pytest.approx((x == y).mean())
    prints = defaultdict(set)
    for r in fingerprints.fingerprinted(docs).collect():
        prints[dict(given)[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.compared_to_edits(nothing).count() == 0
    one = fingerprints.compared_to_edits(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 15
    mixed = spark.createDataFrame([(None, "n one two three four five"), (3, "x"), (3, "y y"), (1, None)], "doc_id long, text string")
    assert fingerprints.compared_to_edits(mixed).count() == 4


def test_likeness_estimates_the_similarity():
    words = [f"w{k}" for k in range(1200)]
    for kept in (300, 600, 1000):
        x, y = " ".join(words[:1000]), " ".join(words[1000 - kept: 2000 - kept] if kept > 800 else words[:kept] + [f"v{k}" for k in range(1000 - kept)])
        a, b = sets_of(x), sets_of(y)
        s = fingerprints.signatures(pa.array([x, y]))
        assert abs(fingerprints.likeness(s[:1], s[1:])[0] - len(a & b) / len(a | b)) < 0.15


def test_near_copies(spark, nothing):
    base = [passage(150, s) for s in range(4)]
    texts = [(0, base[0]), (1, base[0]), (2, base[1]), (3, None), (4, ""), (5, "a b"), (6, "A  b")]
    for k in range(40):  # a chain of small edits around base[2], and copies of base[3]
        w = base[2].split()
        w[k % 20] = f"edit{k}"
        texts.append((100 + k, " ".join(w)))
        texts.append((200 + k, base[3]))
    frame = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, n string").repartition(3)
    parent = {d: d for d, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: sets_of(t) for d, t in texts}
    for x, y in combinations(sets, 2):
        if sets[x] and sets[y] and len(sets[x] & sets[y]) * 100 >= 80 * len(sets[x] | sets[y]):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    got = {r["doc_id"]: r["component_id"] for r in fingerprints.near_copies(frame).collect()}
    assert got == {d: root(d) for d, _ in texts}
    assert fingerprints.near_copies(nothing).count() == 0


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")
    letters = alignment.byte_letters()
    of_b = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    every, count = [], Counter()
    for _, text in texts:
        links, groups, ta, tb = [], [], [], []
        if text:
            ta, tb = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba, bb = [bytes(letters[c] for c in a.id_to_token(k)) for k in ta], [of_b(k) for k in tb]
            if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ta, tb = [], []
            else:
                sa, sb = ([0, *np.cumsum([len(x) for x in side]).tolist()] for side in (ba, bb))
                owner = [[k for k, (x, y) in enumerate(zip(s, s[1:])) for _ in range(y - x)] for s in (sa, sb)]  # of every byte
                links = [(ta[i], tb[j]) for i, j in sorted(set(zip(*owner)))]
                cuts = [0, *sorted(set(sa[1:]) & set(sb[1:]))]
                at = [{e: k for k, e in enumerate(s)} for s in (sa, sb)]
                for x, y in zip(cuts, cuts[1:]):
                    groups.append("|".join(",".join(map(str, ids[w[x]: w[y]])) for ids, w in zip((ta, tb), at)))
        every.append((ta, tb, groups, links))
        count.update(set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [
        (d, len(ta), len(tb), len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if ta else "")
        for (d, _), (ta, tb, groups, links) in zip(texts, every)
    ]


ODD = [
    "  two  blanks  here ", "tab\tand\nlines \n x\r\n y", "a▁b", "日本語のテキスト これ は", "naïve café — “quotes” 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x0A>", "\x00\x01 z", " ",
    "don't 12345 3.14 x=y;", "　wide   nbsp em", "é ´a", "ﬁ ① ½", "x" * 700, " lead", "trail ", "\n", "A  B   C", "мир и война", "שלום עולם", "a b \x1c c \x85d",
]


def test_alignment(spark, docs, nothing):
    texts = [(r[0], r[1]) for r in rows()] + [(100 + k, t) for k, t in enumerate(ODD)] + [(900, ODD[0])]
    frame = spark.createDataFrame([(*t, "x", "y") for t in texts], "doc_id long, text string, keys string, block string").repartition(3)
    want = sorted(plain_alignment(texts))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, alignment.aligned(frame).select(columns).collect())) == want
    assert sorted(map(tuple, alignment.aligned(frame, within=0).select(columns).collect())) == want
    assert alignment.aligned(nothing).count() == 0


def test_hash_is_minimal_perfect_and_verified():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**31, n))
        made = alignment.Hashed.of(*alignment.Hashed.build(keys).packed())
        assert sorted(made.slot(keys).tolist()) == list(range(len(keys)))
        assert (made.keys[made.verified(keys)] == keys).all()
        others = np.setdiff1d(rng.integers(0, 2**31, 1000), keys)
        assert (made.verified(others) == -1).all()
