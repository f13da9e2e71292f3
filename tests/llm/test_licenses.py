"""License scans against every window of every text."""

import random

import regex

from strideframe.llm import licenses

SPLIT = regex.compile(r"[^\p{L}\p{N}.+]+|\.(?![\p{L}\p{N}])")


def words(text):
    return [w for w in SPLIT.split((text or "").lower()) if w]


def plain_scan(docs, least=0.8):
    """The best containment and its first start over all starts, by brute force."""
    out = {}
    for doc, text in set(docs):
        found = words(text)
        for name, template in licenses.TEMPLATES:
            t = words(template)
            size = min(5, len(t))
            grams = lambda w: [tuple(w[i: i + size]) for i in range(len(w) - size + 1)]
            wanted, every = set(grams(t)), grams(found)
            held = len(t) + len(t) // 8 - size + 1
            for start in range(len(every)):
                share = len(wanted & set(every[start: start + held])) / len(wanted)
                if share >= least and share > out.get((doc, name), (0, 0))[0]:
                    out[doc, name] = (share, start)
    return out


def texts():
    """Altered copies at every offset of a step, inserted words, several licences in one text, a long text."""
    rng, out = random.Random(5), []
    filler = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    notices = dict(licenses.TEMPLATES)
    for offset in range(24):
        t = notices["mit-grant"].split()
        t[1], t[30] = "changed", "other"
        out.append(f"{filler(offset)} {' '.join(t)} {filler(30)}")
    for name in notices:
        for changes in (0, 1, 2, 3):
            t = notices[name].split()
            for _ in range(changes):
                t[rng.randrange(len(t))] = "altered"
            for _ in range(rng.randrange(1 + len(t) // 12)):
                t.insert(rng.randrange(len(t)), "inserted")
            out.append(f"{filler(rng.randrange(40))} {' '.join(t)} {filler(rng.randrange(40))}")
    out.append(" ".join(f"{filler(7)} {t}" for t in notices.values()))
    out.append(f"{filler(20000)} {notices['zlib']}")
    out.append(f"{notices['isc']} {filler(60)} {notices['isc']}")
    return [*enumerate(out), (900, None), (901, ""), (902, filler(300)), (0, out[0])]


def test_scan_equals_all_windows(spark):
    rows = texts()
    want = plain_scan(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["template_id"]): (r["containment"], r["first_word"]) for r in licenses.scan(docs, licenses.builtin_templates(spark)).collect()}
    assert all((k, "mit-grant") in want for k in range(24))
    assert all((k, "mit-grant") in want for k in range(24))
    assert got == want
