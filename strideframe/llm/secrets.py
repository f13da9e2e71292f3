"""Secrets in texts: three fixed formats, and probabilistic automata learned from what these find.

The automata are inferred as ALERGIA does: credentials found by the fixed formats are labelled examples;
their prefix tree's states are merged while their next-symbol and stop frequencies agree within a
Hoeffding bound. One automaton per kind, one for ordinary runs of the same characters. Every other run of
`LEAST` or more credential characters is a candidate; it becomes a span of the kind whose automaton
explains it best, if that beats the ordinary one by `MARGIN` nats a character.

Defined cases: null is an empty text and has no spans; a kind without examples adds no span; the examples
are a bounded sample (`examples` per kind), chosen by a hash of doc_id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phases import settled

#: The three formats, in the order in which their kinds are listed, and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is maximal, so the least length may stand in the pattern
LEAST_VALUE, LEAST_ACCESS = 6, 20

LEAST, MARGIN = 16, 0.35
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, value: string>>"


def symbols() -> dict[int, str]:
    """Characters fall into digits, hex letters, other lower, upper, and each mark by itself."""
    table = {}
    for c in map(chr, range(33, 127)):
        table[ord(c)] = "0" if c.isdigit() else "a" if c in "abcdef" else "m" if c.islower() else "A" if c.isupper() else c
    return table


SYMBOLS = symbols()


class Automaton:
    """A probabilistic automaton over symbol classes, learned from example strings."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.stop: list[int] = [0]
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        for text in examples:
            state = 0
            for s in text.translate(SYMBOLS):
                self.seen[state][s] = self.seen[state].get(s, 0) + 1
                if s not in self.next[state]:
                    self.next[state][s] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.stop.append(0)
                state = self.next[state][s]
            self.stop[state] += 1
        self._merge_states()
        self.logs = self._logs()

    def visits(self, state: int) -> int:
        return self.stop[state] + sum(self.seen[state].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 and n2 and abs(f1 / n1 - f2 / n2) > self.alpha * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.visits(a), self.visits(b)
            if self._differ(self.stop[a], n, self.stop[b], m):
                return False
            for s in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a].get(s, 0), n, self.seen[b].get(s, 0), m):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    pairs.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree of b to a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.stop[a] += self.stop[b]
            for s, k in self.seen[b].items():
                self.seen[a][s] = self.seen[a].get(s, 0) + k
            for s, child in self.next[b].items():
                if s in self.next[a]:
                    pairs.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    def _merge_states(self) -> None:
        settled, waiting = [0], [(0, s) for s in sorted(self.next[0])]
        while waiting:
            parent, s = waiting.pop(0)
            state = self.next[parent][s]
            if state in settled:
                continue
            for kept in settled:
                if self._compatible(kept, state):
                    self.next[parent][s] = kept
                    self._fold(kept, state)
                    break
            else:
                settled.append(state)
            known = set(settled)
            waiting = [(p, t) for p in settled for t in sorted(self.next[p]) if self.next[p][t] not in known]

    def _logs(self) -> list[tuple[dict[str, tuple[float, int]], float, float]]:
        """Per state: log chance and target by symbol, of stopping, and of any symbol not seen there."""
        out = []
        for state in range(len(self.next)):
            total = self.visits(state) + 8
            out.append((
                {s: (math.log((k + 0.1) / total), self.next[state][s]) for s, k in self.seen[state].items()},
                math.log((self.stop[state] + 0.1) / total), math.log(0.1 / total),
            ))
        return out

    def score(self, text: str) -> float:
        """Log likelihood per character. An unseen symbol costs its chance and leaves the state as it is."""
        state, total = 0, 0.0
        for s in text.translate(SYMBOLS):
            known, _, rare = self.logs[state]
            step = known.get(s)
            if step:
                total, state = total + step[0], step[1]
            else:
                total += rare
        return (total + self.logs[state][1]) / (len(text) + 1)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the fixed formats, by start, then kind as listed."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b, value) for a, k, b, value in sorted(found)]


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> Iterator[re.Match]:
    """Runs of credential characters that no fixed format has touched."""
    taken = sorted((a, b) for _, a, b, _ in base)
    k = 0
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            yield m


Models = dict[str, Automaton]


def spans(text: Column, models: Models | None) -> Column:
    """All spans of each text (start and end in code points); without models, only those of the fixed formats."""
    credential = {k: m for k, m in (models or {}).items() if k != "ordinary"}
    ordinary = (models or {}).get("ordinary")

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())]))
        for texts in batches:
            out = []
            for item in texts:
                t = item.as_py() or ""
                base = base_spans(t)
                rows = [(a, KINDS.index(k), b, True, v) for k, a, b, v in base]
                if models is None:
                    rows += [(m.start(), len(KINDS), m.end(), False, m[0]) for m in candidates(t, base)]
                elif credential and ordinary:
                    for m in candidates(t, base):
                        best, k = max((model.score(m[0]), -KINDS.index(k)) for k, model in credential.items())
                        if best - ordinary.score(m[0]) >= MARGIN:
                            rows.append((m.start(), -k, m.end(), False, m[0]))
                out.append([
                    {"kind": (*KINDS, "ordinary")[k], "start": a, "end": b, "base": own, "value": v} for a, k, b, own, v in sorted(rows)
                ])
            yield pa.array(out, kind)

    return find(text)


def learn(docs: DataFrame, examples: int = 400) -> Models:
    """An automaton per kind from at most `examples` credentials, one from as many ordinary runs.

    An ordinary example is a run that holds no digit: the labels come from the fixed formats only, and
    what else holds digits may be a secret that they miss.
    """
    seen = docs.select("doc_id", F.explode(spans(F.col("text"), None)).alias("s")).select("doc_id", "s.kind", "s.value", "s.start")
    seen = seen.where("kind <> 'ordinary' OR NOT value RLIKE '[0-9]'")
    seen = settled(seen)  # texts are searched once, not once per kind
    order = [F.xxhash64("doc_id", "start"), "doc_id", "start"]
    chosen = None
    for kind in (*KINDS, "ordinary"):
        part = seen.where(F.col("kind") == kind).orderBy(*order).limit(examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    found: dict[str, list[str]] = {}
    for r in chosen.collect():  # at most 4 * examples short strings
        found.setdefault(r["kind"], []).append(r["value"])
    return {kind: Automaton(sorted(values)) for kind, values in found.items()}
