"""Secret scan of whole texts by one deterministic automaton for all rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import getitem
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from courseloom.llm.common import query, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``head`` is the part of ``pattern`` before the value; a match whose value
    (without a head: the whole match) is shorter than ``least`` is taken, then dropped. ``met`` is
    in every match that is kept, and is what the combined automaton looks for: the rule itself, or
    as much of it that the rules don't multiply each other's counters."""

    kind: str
    pattern: str
    met: str
    head: str | None = None
    least: int = 0


KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", KEY + "[A-Za-z0-9+/_.=-]+", KEY + "[A-Za-z0-9+/_.=-]", KEY, 6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", least=20),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24}", least=24),
)
# published shapes of credentials
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]"),
    Rule("cloud_key", "AIza[A-Za-z0-9_-]{35}", "AIza[A-Za-z0-9_-]"),
    Rule("url_password", r"(?:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[^\s:@/]+:[^\s:@/]+@",
         r"(?:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[^\s:@/]+:[^\s:@/]+@"),
)
RULES = BASE + MORE


class Nfa:
    """Thompson's automaton of parsed expressions over bytes; sets of bytes are 256-bit numbers."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, pattern: str, start: int) -> int:
        return self._chain(_parser.parse(pattern), start, False)

    def _chain(self, parsed, at: int, fold: bool) -> int:
        for op, arg in parsed:
            at = self._one(op, arg, at, fold)
        return at

    def _one(self, op, arg, at: int, fold: bool) -> int:
        if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN):
            via, end = self.state(), self.state()
            self.free[at].append(via)
            self.moves[via] = (_bytes_of(op, arg, fold), end)
            return end
        if op is sre.SUBPATTERN:
            _, on, _, inner = arg
            return self._chain(inner, at, fold or bool(on & re.I))
        if op is sre.BRANCH:
            end = self.state()
            for way in arg[1]:
                self.free[self._chain(way, at, fold)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                at = self._chain(inner, at, fold)
            if high is sre.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.free[at].append(loop)
                self.free[self._chain(inner, loop, fold)].append(loop)
                self.free[loop].append(end)
                return end
            end = self.state()
            self.free[at].append(end)
            for _ in range(high - low):
                at = self._chain(inner, at, fold)
                self.free[at].append(end)
            return end
        raise ValueError(f"not supported in a rule: {op}")

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _bytes_of(op, arg, fold: bool) -> int:
    def one(code: int) -> int:
        if code > 127:
            raise ValueError("rules are over ASCII")
        c = chr(code)
        return (1 << ord(c.lower()) | 1 << ord(c.upper())) if fold else 1 << code

    if op is sre.LITERAL:
        return one(arg)
    if op is sre.NOT_LITERAL:
        return ALL & ~one(arg)
    found, negate = 0, False
    for kind, value in arg:
        if kind is sre.NEGATE:
            negate = True
        elif kind is sre.LITERAL:
            found |= one(value)
        elif kind is sre.RANGE:
            for code in range(value[0], value[1] + 1):
                found |= one(code)
        elif kind is sre.CATEGORY and value is sre.CATEGORY_SPACE:
            found |= sum(1 << c for c in b" \t\n\r\x0b\x0c")
        else:
            raise ValueError(f"not supported in a rule: {kind} {value}")
    return ALL & ~found if negate else found


ALL = (1 << 256) - 1


@dataclass
class Dfa:
    """Transition array of a minimal automaton: ``next[state, class of byte]``; 0 is the start."""

    next: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    dead: int               # the state from which nothing is accepted, -1 if there is none


def compile_rules(patterns: list[str], anywhere: bool) -> Dfa:
    """Subset construction and minimisation of all patterns together. ``anywhere``: a match may
    begin at every byte, and the first byte that ends one leads to a state that is never left;
    otherwise the match begins at the first byte."""
    nfa = Nfa()
    start = nfa.state()
    ends = {nfa.add(p, start) for p in patterns}
    masks = {m[0] for m in nfa.moves if m}
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.argmax(classes == k)) for k in range(len(kinds))]

    first = nfa.closed([start])
    hit = frozenset([-1])
    ids, order, rows = {first: 0}, [first], []
    for states in order:
        row = []
        for byte in sample:
            if states == hit:
                to = hit
            else:
                to = nfa.closed([m[1] for s in states if (m := nfa.moves[s]) and m[0] >> byte & 1])
                if anywhere:
                    to = hit if to & ends else to | first
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    return _minimal(np.array(rows, np.int32), np.array([s == hit or bool(s & ends) for s in order]), classes)


def _minimal(moves: np.ndarray, accepts: np.ndarray, classes: np.ndarray) -> Dfa:
    """Merge states that no input tells apart: refine blocks until their moves agree."""
    block, n = accepts.astype(np.int64), 0
    while True:
        _, new = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() + 1 == n:
            break
        block, n = new, new.max() + 1
    _, first = np.unique(block, return_index=True)
    number = np.empty(n, np.int32)                      # the start's block becomes 0
    number[[block[0], *[k for k in range(n) if k != block[0]]]] = np.arange(n)
    out, ok = np.empty((n, moves.shape[1]), np.int32), np.empty(n, bool)
    out[number[block[first]]] = number[block[moves[first]]]
    ok[number[block[first]]] = accepts[first]
    stuck = np.nonzero((out == np.arange(n)[:, None]).all(axis=1) & ~ok)[0]
    return Dfa(out, classes, ok, int(stuck[0]) if len(stuck) else -1)


class Scanner:
    """All rules over one text. The rows of the combined array are lists that hold each other, so
    the pass over a line's bytes is one reduction without a branch. No rule matches a line break,
    so lines are independent; those in which the automaton has met a rule are read again, by each
    rule's own automaton, for the spans."""

    def __init__(self, compiled: tuple[Dfa, list[tuple[Rule, Dfa, Dfa | None]]]):
        whole, self.rules = compiled
        rows = [[] for _ in whole.next]
        for row, to in zip(rows, whole.next[:, whole.classes]):
            row.extend(rows[k] for k in to)
        self.start, self.hit = rows[0], rows[int(np.nonzero(whole.accepts)[0][0])]
        self.own = [(r, _lists(d), _lists(h) if h else None) for r, d, h in self.rules]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) in code points, sorted."""
        data, found, at, seen, points = text.encode(), [], 0, 0, 0
        for line in data.split(b"\n"):
            if reduce(getitem, line, self.start) is self.hit:
                points, seen = points + len(data[seen:at].decode()), at
                for k, (rule, dfa, head) in enumerate(self.own):
                    for a, b in matches(line, dfa):
                        if b - (longest(line, a, head) if head else a) >= rule.least:
                            a, b = (a, b) if line.isascii() else (len(line[:a].decode()), len(line[:b].decode()))
                            found.append((points + a, k, points + b))
            at += len(line) + 1
        return sorted(found)


def _lists(dfa: Dfa) -> tuple:
    return dfa.next[:, dfa.classes].tolist(), dfa.accepts.tolist(), dfa.dead


def longest(line: bytes, at: int, dfa: tuple) -> int:
    """End of the longest match that begins at ``at``; -1 if none does."""
    rows, accepts, dead = dfa
    state, end = 0, -1
    for k in range(at, len(line)):
        state = rows[state][line[k]]
        if state == dead:
            break
        if accepts[state]:
            end = k + 1
    return end


def matches(line: bytes, dfa: tuple) -> Iterator[tuple[int, int]]:
    """Leftmost longest matches which don't overlap."""
    rows, _, dead = dfa
    begins, at = [to != dead for to in rows[0]], 0
    while at < len(line):
        if begins[line[at]] and (end := longest(line, at, dfa)) > at:
            yield at, end
            at = end
        else:
            at += 1


def compiled(rules: tuple[Rule, ...] = RULES) -> tuple[Dfa, list[tuple[Rule, Dfa, Dfa | None]]]:
    """The combined automaton of what must be met, and each rule's own two."""
    return (compile_rules([r.met for r in rules], True),
            [(r, compile_rules([r.pattern], False), compile_rules([r.head], False) if r.head else None) for r in rules])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row's secrets: doc_id and spans, an array of (kind, start, end) by start, then by the
    order of the rules; code points, the end exclusive.

    The rules' expressions become one minimal automaton, compiled on the driver and sent as
    transition arrays whose size depends on the rules alone. A task reads each whole text once, byte
    by byte; nothing is shuffled. Null and empty texts have no spans, repeated rows and null ids are
    scanned like any other, extra columns aren't read. Matches of a kind are leftmost and don't
    overlap; those shorter than the rule asks for are dropped after they were taken.
    """
    ready = compiled(rules)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ready)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in scanner.spans(t.as_py() or "")]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(
        find, f"doc_id {id_type}, spans array<struct<kind: string, start: long, end: long>>")


@query()
def op10_secret_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = [r.kind for r in BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base),
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
