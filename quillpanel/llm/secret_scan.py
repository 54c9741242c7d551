"""Operator 10: secret scans by one combined deterministic automaton.

Rules are regular expressions over bytes.  ``compile_rules`` parses them, builds
one nondeterministic automaton for all rules, makes it deterministic by subset
construction over byte classes, minimises it by partition refinement, and stores
it as transition arrays; every state knows the set of rules that accept in it.
A text is scanned for all rules in one pass over its bytes: bytes that lead from
every state to the start (no rule can match across them) cut texts into
segments, and all segments of a chunk advance together, one array step per byte,
collecting the rules that they meet.  The last few long segments are finished
one by one.

Only in segments that meet a rule - few - its spans are placed: the automaton of
the reversed rule, run backwards once, marks every byte at which a match begins;
from the leftmost mark the rule's own automaton runs to the longest end, and so
on from there.  Both directions read a byte once, so a segment costs its length
however many beginnings it has (a rule whose longest match needs look-ahead past
its end reads that again).  Spans are leftmost, longest, non-overlapping per
kind; matches that fail the rule's length check are dropped, not retried.

Cases: null and empty texts have no spans; offsets are code points, end
exclusive; very long texts and runs cost their length; null and repeated ids and
repeated rows are rows of their own with equal results; ties (spans of several
kinds at one start) are ordered by kind as listed; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .vectext import chunks, released

#: Segments that advance together at least; fewer are read one by one.
LANES = 40

# --- regular expressions -> automata


class _Parser:
    """A regular expression as nested tuples: set, cat, alt, rep."""

    def __init__(self, text: str):
        self.t, self.i = text, 0

    def parse(self):
        node = self.alt()
        if self.i != len(self.t):
            raise ValueError(f"unexpected {self.t[self.i]!r} at {self.i} in {self.t!r}")
        return node

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def alt(self):
        out = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            out.append(self.cat())
        return out[0] if len(out) == 1 else ("alt", out)

    def cat(self):
        out = []
        while self.peek() not in ("", "|", ")"):
            out.append(self.repeat())
        return ("cat", out)

    def repeat(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.peek()
            if c == "{":
                end = self.t.index("}", self.i)
                lo, _, hi = self.t[self.i + 1 : end].partition(",")
                bounds = (int(lo), int(lo) if "," not in self.t[self.i : end] else int(hi) if hi else None)
                self.i = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                self.i += 1
            node = ("rep", node, *bounds)
        return node

    def escape(self) -> int:
        c = self.t[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.t[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def atom(self):
        c = self.t[self.i]
        self.i += 1
        if c == "(":
            if self.t.startswith("?:", self.i):
                self.i += 2
            node = self.alt()
            self.i += 1
            return node
        if c == "[":
            return self.charset()
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset([self.escape() if c == "\\" else ord(c)]))

    def charset(self):
        negated = self.peek() == "^"
        self.i += negated
        got: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            lo = self._one()
            if self.peek() == "-" and self.t[self.i + 1] != "]":
                self.i += 1
                got.update(range(lo, self._one() + 1))
            else:
                got.add(lo)
        self.i += 1
        return ("set", frozenset(range(256)) - got if negated else frozenset(got))

    def _one(self) -> int:
        c = self.t[self.i]
        self.i += 1
        return self.escape() if c == "\\" else ord(c)


def any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, node, at: int) -> int:
        """Add node behind state at; its last state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[at].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                at = self.build(part, at)
            return at
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self.build(part, begin)].append(end)
            return end
        _, part, lo, hi = node
        for _ in range(lo):
            at = self.build(part, at)
        if hi is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.build(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[at].append(end)
        for _ in range(hi - lo):
            at = self.build(part, at)
            self.empty[at].append(end)
        return end


class Dfa:
    """Minimal automaton: next state = table[state, classes[byte]]; state 0 starts."""

    def __init__(self, classes: np.ndarray, table: np.ndarray, accepts: np.ndarray, dead: int):
        self.classes, self.table, self.accepts, self.dead = classes, table, accepts, dead
        self.flat = np.ascontiguousarray(table).ravel().astype(np.int32)
        self.rows, self.marks = table.tolist(), accepts.tolist()

    @property
    def width(self) -> int:
        return self.table.shape[1]


def _byte_classes(sets: list[frozenset]) -> tuple[np.ndarray, list[int]]:
    marks = np.zeros((256, max(1, len(sets))), bool)
    for k, s in enumerate(sets):
        marks[list(s), k] = True
    _, first, inverse = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    return inverse.ravel().astype(np.int32), first.tolist()


def _minimise(table: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement (Moore); the block of each state and one state of each block."""
    block = np.unique(labels, return_inverse=True)[1].ravel()
    while True:
        key = np.column_stack([block, block[table]])
        _, first, new = np.unique(key, axis=0, return_index=True, return_inverse=True)
        new = new.ravel()
        if new.max() == block.max():
            return new, first
        block = new


def _reversed(node):
    """The tree of the reversed expression."""
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", _reversed(node[1]), *node[2:])
    parts = [_reversed(x) for x in node[1]]
    return (node[0], parts[::-1] if node[0] == "cat" else parts)


def compile_rules(patterns: list[str], search: bool, backwards: bool = False) -> Dfa:
    """search: in a state, accept the patterns of which a match ends here, wherever it began; else
    anchored at the start.  backwards: for texts read from their end.  accepts has a bit per pattern."""
    nfa = _Nfa()
    start = nfa.state()
    if search:
        nfa.moves[start].append((frozenset(range(256)), start))
    ends = {}
    for k, p in enumerate(patterns):
        begin = nfa.state()
        nfa.empty[start].append(begin)
        tree = _Parser(p).parse()
        ends[nfa.build(_reversed(tree) if backwards else tree, begin)] = 1 << k

    def close(states: set[int]) -> frozenset:
        stack, seen = list(states), set(states)
        while stack:
            for x in nfa.empty[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(seen)

    classes, samples = _byte_classes(sorted({s for m in nfa.moves for s, _ in m}, key=sorted))
    after = [[frozenset().union(*(close({t}) for s, t in moves if byte in s)) for byte in samples] for moves in nfa.moves]
    first = close({start})
    number, rows, queue = {first: 0}, [], [first]
    met = lambda states: sum(ends[x] for x in states & ends.keys())
    hits = [met(first)]
    for now in queue:
        row = []
        for c in range(len(samples)):
            to = frozenset().union(*(after[x][c] for x in now if after[x][c]))
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
                hits.append(met(to))
            row.append(number[to])
        rows.append(row)
    block, first_of = _minimise(np.array(rows), np.array(hits))
    order = np.concatenate([[block[0]], np.setdiff1d(np.arange(block.max() + 1), [block[0]])])
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    table = rank[block[np.array(rows)[first_of[order]]]]
    accepts = np.array(hits)[first_of[order]]
    stuck = np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & (accepts == 0))
    return Dfa(classes, table, accepts, int(stuck[0]) if len(stuck) else -1)


# --- rules

_VALUE = "[A-Za-z0-9+/_.=-]"
_KEY = "(?:" + "|".join(any_case(k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = _KEY + r"[\"']?\x20*[:=]\x20*[\"']?"


def _assigned(match: bytes) -> bool:
    sep = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[sep + 1 :].lstrip(b" ")
    if value[:1] in (b'"', b"'"):
        value = value[1:]
    return len(value) >= 8


def _access_passes(match: bytes) -> bool:
    return len(match) >= 16


def _hex_passes(match: bytes) -> bool:
    return len(match) >= 32


class Rule:
    """kind, the pattern of a match, a pattern that every passing match contains, and the check.

    Long counted runs of several rules multiply in a combined automaton, so the
    contained pattern counts no further than needed to make a hit rare.
    """

    def __init__(self, kind: str, pattern: str, needs: str | None = None, check: Callable[[bytes], bool] | None = None):
        self.kind, self.pattern, self.needs, self.check = kind, pattern, needs or pattern, check


BASE_RULES = (
    Rule("assign", _ASSIGN + _VALUE + "+", _ASSIGN + _VALUE + "{8}", _assigned),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{12}", _access_passes),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32}", _hex_passes),
)
#: Further public token formats; their spans come besides the base ones.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{4}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{4}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", "AIza[A-Za-z0-9_-]{4}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", "[rs]k_live_[A-Za-z0-9]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", r"\.eyJ[A-Za-z0-9_-]{4}"),
    Rule("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%-]+@", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%-]+@"),
)


class Scanner:
    """Compiled rules; made once on the driver and sent to the tasks."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.kinds = [r.kind for r in rules]
        self.search = compile_rules([r.needs for r in rules], search=True)
        self.exact = [compile_rules([r.pattern], search=False) for r in rules]
        self.begins = [compile_rules([r.pattern], search=True, backwards=True) for r in rules]
        self.checks = [r.check for r in rules]
        self.resets = (self.search.table == 0).all(0)[self.search.classes]
        self.least = self._shortest()

    def _shortest(self) -> int:
        seen, depth, front = {0}, 0, {0}
        while front and not self.search.accepts[list(front)].any():
            front = {int(t) for s in front for t in self.search.table[s]} - seen
            seen |= front
            depth += 1
        return depth

    def flagged(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte bounds of the segments that meet a rule, and the bits of those rules."""
        stop = self.resets[data]
        begin = np.concatenate([offs[:-1], np.flatnonzero(stop) + 1])
        end = np.concatenate([offs[1:], np.flatnonzero(stop)])
        begin.sort()
        end.sort()
        size = end - begin
        keep = np.flatnonzero(size >= self.least)
        keep = keep[np.argsort(-size[keep], kind="stable")]
        begin, end, size = begin[keep], end[keep], size[keep]
        met = np.zeros(len(size), np.int64)
        if not len(size):
            return begin, end, met
        state = np.zeros(len(size), np.int32)
        symbols = self.search.classes[data]
        flat, width, accepts = self.search.flat, self.search.width, self.search.accepts
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        together = int(np.searchsorted(-live, -LANES, "left"))
        for step, n in enumerate(live[:together].tolist()):
            state[:n] = flat[state[:n] * width + symbols[begin[:n] + step]]
            met[:n] |= accepts[state[:n]]
        for i in range(live[together] if together < len(live) else 0):
            met[i] |= self._alone(symbols[begin[i] + together : end[i]], int(state[i]))
        hit = np.flatnonzero(met)
        hit = hit[np.argsort(begin[hit])]
        return begin[hit], end[hit], met[hit]

    def _alone(self, symbols: np.ndarray, state: int) -> int:
        """Bits of the rules met on the rest of one segment."""
        table, accepts, met = self.search.rows, self.search.marks, 0
        for c in symbols.tolist():
            state = table[state][c]
            met |= accepts[state]
        return met

    def spans(self, segment: bytes, met: int) -> Iterator[tuple[int, int, int]]:
        """(start, rule, end) in bytes of the rules in met: leftmost, longest, non-overlapping per rule."""
        raw = np.frombuffer(segment, np.uint8)
        for k, (dfa, back) in enumerate(zip(self.exact, self.begins)):
            if not met >> k & 1:
                continue
            marks, state, table, accepts = bytearray(len(segment)), 0, back.rows, back.marks
            for i, c in zip(range(len(segment) - 1, -1, -1), back.classes[raw[::-1]].tolist()):
                state = table[state][c]
                if accepts[state]:
                    marks[i] = 1
            symbols, table, accepts, dead = dfa.classes[raw].tolist(), dfa.rows, dfa.marks, dfa.dead
            at = marks.find(1)
            while at >= 0:
                state, found = 0, at + 1
                for i in range(at, len(segment)):
                    state = table[state][symbols[i]]
                    if state == dead:
                        break
                    if accepts[state]:
                        found = i + 1
                if self.checks[k] is None or self.checks[k](segment[at:found]):
                    yield at, k, found
                at = marks.find(1, found)


@lru_cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _scan(shared, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Scanner = shared.value
        for batch in batches:
            for a, b, data, offs in chunks(batch.column(1)):
                begin, end, met = automaton.flagged(data, offs)
                rows: list[list[tuple[int, int, int]]] = [[] for _ in range(b - a)]
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(begin) else None
                owner = np.searchsorted(offs, begin, "right") - 1
                for x, y, r, m in zip(begin.tolist(), end.tolist(), owner.tolist(), met.tolist()):
                    zero = points[offs[r]]
                    rows[r] += [(int(points[x + s] - zero), k, int(points[x + e] - zero)) for s, k, e in automaton.spans(data[x:y].tobytes(), m)]
                spans, digests, counts = [], [], [[] for _ in range(base)]
                for row in rows:
                    row.sort()
                    spans.append(",".join(f"{automaton.kinds[k]}:{s}:{e}" for s, k, e in row))
                    digests.append(hashlib.sha256(",".join(f"{automaton.kinds[k]}:{s}:{e}" for s, k, e in row if k < base).encode()).hexdigest())
                    for k in range(base):
                        counts[k].append(sum(j == k for _, j, _ in row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                    ["doc", *(f"n_{k}" for k in automaton.kinds[:base]), "base_sha256", "spans"],
                )

    return run


def scan(documents: DataFrame, base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, a count per base kind, base_sha256, spans (kind:start:end, by start)."""
    shared = runtime.ship(documents.sparkSession).sparkContext.broadcast(scanner(base + more))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{r.kind} bigint" for r in base)
    out = rows.mapInArrow(released(_scan(shared, len(base))), f"doc bigint, {counts}, base_sha256 string, spans string")
    return out.withColumnRenamed("doc", id_col)
