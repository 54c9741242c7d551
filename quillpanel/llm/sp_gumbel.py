"""Operator 6: SentencePiece segmentations sampled without replacement (Gumbel top-k).

A text, normalised by the model, is a chain of units (blanks and the word after
them); pieces never cross units, so its lattice is the chain of unit lattices
and p(segmentation) is the product over units of normalised piece weights

    weight(piece) = (OFFSET + rank(piece)) ** -alpha,

where the rank is the merge rank that the model stores.  Unit masses come from
forward sums, so the mass of any region of the lattice is exact.

Top-down perturbed A* search: the root region holds all segmentations and its
greatest perturbed log-probability is a Gumbel variable.  A region's best
segmentation is a draw from p within the region.  When it is emitted, what is
left of the region is split by the first unit that differs; each part's best
value is a Gumbel variable of its log mass, truncated at the emitted value.
The heap yields segmentations in exact Gumbel order: distinct, and distributed
as sampling without replacement.  With the next value ``t`` in the heap, the
inclusion score of a segmentation is ``1 - exp(-exp(log p - t))`` (1 if nothing
is left).  All draws of a row come from its key and the seed.

Lattices are built once per unit type (a trie walk over all positions of the new
types of a chunk) and kept as flat arrays; the draws of all units of a chunk
advance together, one piece at a time.  What is left beside a draw is summed
along its path in logarithms, edge by edge, so no part is lost to rounding.
Only the one unit in which a region differs is drawn alone: the draw leaves the
paths that are taken at some edge, chosen by the mass behind it.

Decoding joins pieces, turns byte pieces into their bytes and blanks marks into
spaces; any sampled segmentation decodes to the same text as the plain encoding.

Cases: null and empty texts have one empty segmentation with inclusion 1; texts
with fewer segmentations than asked for give all of them; repeated keys give
equal draws for equal texts; null keys are a key like others; equal perturbed
values (ties) have probability zero and go by order of discovery; texts of any
length, blanks only included, cost time in proportion; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .vectext import U64, byte_names, mix, ragged, released

OFFSET = 10.0
#: Characters of text that a worker samples at once (a longer text is one chunk).
CHUNK = 1 << 19
#: Edges of lattices that a worker remembers; beyond, those of the types met in most chunks stay, with KEEP edges at most.
REMEMBER = 4_000_000
KEEP = REMEMBER // 2
#: Edges that a worker keeps between tasks.
IDLE = 500_000
#: Below this share the edges beside the greatest one are summed anew.
CLOSE = 1e-6
MARK = "▁"
_STEP, _PLACE, _DRAW, _NOISE, _ROOT = (U64(int(x, 16)) for x in ("9E3779B97F4A7C15", "C2B2AE3D27D4EB4F", "165667B19E3779F9", "27D4EB2F165667C5", "85EBCA77C2B2AE63"))
_models: dict[tuple[str, float], Model] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _times(x: np.uint64, n: int) -> np.uint64:
    return U64(int(x) * n & (1 << 64) - 1)


def _uniform(noise: np.ndarray) -> np.ndarray:
    return (mix(noise) >> U64(11)) * 2.0**-53


def _gumbels(log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of the given log masses."""
    with np.errstate(divide="ignore"):
        return log_mass - np.log(-np.log(np.maximum(u, 1e-300)))


def _below(bound: float, value: float) -> float:
    """A Gumbel value truncated at bound; greater values stay greater."""
    high, low = max(-bound, -value), min(-bound, -value)
    return -(high + math.log1p(math.exp(low - high)))


_MASK = (1 << 20) - 1


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(U64) * _STEP >> U64(44)).astype(np.int64)


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table of non-negative keys (-1: free) and their values."""
    slots, out = np.full(_MASK + 1, -1, np.int64), np.zeros(_MASK + 1, np.int64)
    at, left = _slot(keys), np.arange(len(keys))
    while len(left):
        free = slots[at[left]] < 0
        slots[at[left[free]]] = keys[left[free]]  # of several one stays
        done = slots[at[left]] == keys[left]
        out[at[left[done]]] = values[left[done]]
        left = left[~done]
        at[left] = at[left] + 1 & _MASK
    return slots, out


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by the last key, then the one before it, and so on."""
    order = None
    for k in keys:
        top = 0 if k.dtype == bool else k.max(initial=0)
        k = k if k.dtype == bool or top >= 1 << 16 else k.astype(np.uint8 if top < 1 << 8 else np.uint16)
        order = np.argsort(k, kind="stable") if order is None else order[np.argsort(k[order], kind="stable")]
    return order


class Draw:
    """One segmentation of each of a row of units."""

    def __init__(self, lp: np.ndarray, left: np.ndarray, edges: np.ndarray, at: np.ndarray):
        #: per unit: its log-probability, log of what it leaves; edges in order and their offsets by unit
        self.lp, self.left, self.edges, self.at = lp, left, edges, at

    def part(self, a: int, b: int) -> Draw:
        x, y = self.at[a], self.at[b]
        return Draw(self.lp[a:b], self.left[a:b], self.edges[x:y], self.at[a : b + 1] - x)


class Model:
    """Weighted pieces as a trie, and the lattices of the unit types met, as flat arrays."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes, self.raw = {}, {}, []
        for i in range(self.sp.get_piece_size()):
            p = self.sp.id_to_piece(i)
            self.raw.append(p.replace(MARK, " ").encode())
            if self.sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                self.pieces[p] = (i, -alpha * math.log(OFFSET - self.sp.get_score(i)))
        #: the bytes of pieces as an array, from which many are taken at once
        self.spelled = np.array(self.raw, object)
        self.rare = -alpha * math.log(OFFSET + len(self.raw))
        self.unknown = self.sp.unk_id()
        child: dict[tuple[int, int], int] = {}
        ends, weights = [-1], [0.0]
        for p, (i, w) in self.pieces.items():
            node = 0
            for c in map(ord, p):
                node = child.setdefault((node, c), len(child) + 1)
                if node == len(ends):
                    ends.append(-1)
                    weights.append(0.0)
            ends[node], weights[node] = i, w
        self.slots, self.to = _table(np.array([n << 21 | c for n, c in child], np.int64), np.fromiter(child.values(), np.int64, len(child)))
        self.ends, self.weights = np.array(ends), np.array(weights)
        #: by id: its width and start in ``flat``; ids beyond the pieces stand for characters without one
        self.odd: dict[int, int] = {}
        self.width, self.start, self.flat = np.ones(len(self.raw), np.int64), np.arange(len(self.raw)), np.arange(len(self.raw))
        self.clear()

    def clear(self) -> None:
        #: sorted names of the known types and their numbers
        self.names, self.number = np.zeros(0, U64), np.zeros(0, np.int64)
        #: by type: first node and length; by node: first edge; by edge: its id, and (cumulative share, the other shares, log share, start)
        self.node, self.size, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.used, self.id, self.edge = 0, np.empty(0, np.int32), np.empty((0, 4))
        #: by type: chunks that held it, and the edges of its lattice
        self.met, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def shrink(self, most: int) -> None:
        """Forget lattices until at most so many edges are left: types met in the fewest chunks go first, of these the long ones."""
        order = np.lexsort((self.count, -self.met))
        keep = order[np.cumsum(self.count[order]) <= most]  # what most draws read stands together
        number = np.full(len(self.size), -1)
        number[keep] = np.arange(len(keep))
        now = number[self.number]
        self.names, self.number = self.names[now >= 0], now[now >= 0]
        nodes = ragged(self.node[keep], self.size[keep] + 1)
        edges = ragged(self.first[self.node[keep]], self.count[keep])
        self.first = np.concatenate([[0], np.cumsum(self.first[nodes + 1] - self.first[nodes])])
        self.size, self.count, self.met = self.size[keep], self.count[keep], self.met[keep] // 2
        self.node = np.cumsum(self.size + 1) - self.size - 1
        self.used, self.id, self.edge = len(edges), self.id.take(edges), self.edge.take(edges, axis=0)

    def _spell(self, cps: np.ndarray) -> np.ndarray:
        """Ids that stand for the byte pieces of characters."""
        chars, inverse = np.unique(cps, return_inverse=True)
        for c in chars.tolist():
            if c not in self.odd:
                ids = [self.bytes.get(b, self.unknown) for b in chr(c).encode("utf-8", "replace")]
                self.odd[c] = len(self.width)
                self.width, self.start = np.append(self.width, len(ids)), np.append(self.start, len(self.flat))
                self.flat = np.append(self.flat, ids)
        return np.array([self.odd[c] for c in chars.tolist()], np.int64)[inverse.ravel()]

    def _edges(self, cps: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """(type, start, end, id, weight) of all pieces that lie in the units [begin, begin + size)."""
        kind, start = np.repeat(np.arange(len(size)), size), ragged(np.zeros_like(size), size)
        place, stop = begin[kind] + start, size[kind]
        out, single = [], np.zeros(len(kind), bool)
        live, node = np.arange(len(kind)), np.zeros(len(kind), np.int64)
        here, room = place, stop - start  # the next character and how many there are
        depth = 0
        while len(live):
            key = node << 21 | cps.take(here)
            i = _slot(key)
            got = self.slots.take(i)
            while (on := np.flatnonzero((got != key) & (got >= 0))).size:
                at = i.take(on) + 1 & _MASK
                i[on] = at
                got[on] = self.slots.take(at)
            ok = np.flatnonzero(got == key)
            depth += 1
            live, node, here, room = live.take(ok), self.to.take(i.take(ok)), here.take(ok) + 1, room.take(ok)
            ends = self.ends.take(node)
            hit = np.flatnonzero(ends >= 0)
            x = live.take(hit)
            if depth == 1:
                single[x] = True
            frm = start.take(x)
            out.append((kind.take(x), frm, frm + depth, ends.take(hit), self.weights.take(node.take(hit))))
            more = np.flatnonzero(room > depth)
            live, node, here, room = (c.take(more) for c in (live, node, here, room))
        x = np.flatnonzero(~single)
        c = cps[place[x]]
        width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        out.append((kind[x], start[x], start[x] + 1, self._spell(c), self.rare * width))
        return (np.concatenate(c) for c in zip(*out))

    def _learn(self, cps: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Lattices of new unit types."""
        kind, frm, at, ids, weight = self._edges(cps, begin, size)
        order = _order(kind, at)
        kind, frm, at, ids, weight = (x.take(order) for x in (kind, frm, at, ids, weight))
        base = np.concatenate([[0], np.cumsum(size + 1)])
        nodes = base.take(kind)
        source = nodes + frm
        nodes += at
        total = np.zeros(base[-1])
        made = np.empty((len(kind), 4))  # (share, the other shares, log share, start)
        heads = np.flatnonzero(np.diff(nodes, prepend=-1))
        ends, sizes = nodes.take(heads), np.diff(heads, append=len(nodes))
        run, tops = np.repeat(np.arange(len(heads)), sizes), np.empty(len(heads), np.int64)
        for a, b in self._levels(at, size):
            x, y = np.searchsorted(heads, (a, b)).tolist()
            score = total.take(source[a:b]) + weight[a:b]
            head, mine = heads[x:y] - a, run[a:b] - x
            top = np.maximum.reduceat(score, head)
            over = score - top.take(mine)
            greatest = np.flatnonzero(over == 0.0)
            best = greatest[np.flatnonzero(np.diff(mine.take(greatest), prepend=-1))]  # one of each node
            mass = np.exp(over)
            whole = np.add.reduceat(mass, head)
            log = np.log(whole)
            total[ends[x:y]] = top + log
            over -= log.take(mine)
            mass /= whole.take(mine)
            others = 1.0 - mass
            close = np.flatnonzero((others.take(best) < CLOSE) & (sizes[x:y] > 1))
            if len(close):  # what the others have is lost beside the greatest: summed without it
                alone = mass.copy()
                alone[best] = 0.0
                others[best[close]] = np.add.reduceat(alone, head)[close]
                over[best[close]] = np.log1p(-others[best[close]])
            made[a:b, 0], made[a:b, 1], made[a:b, 2], made[a:b, 3] = mass, others, over, frm[a:b]
            tops[x:y] = best + a
        # by type and node; the greatest edge of a node first, as most draws take it
        count = np.zeros(base[-1], np.int64)
        count[ends] = sizes
        first = np.cumsum(count) - count
        place = np.arange(len(nodes)) + (first.take(ends) - heads).take(run)
        place[heads], place[tops] = place[tops], place[heads]
        order = np.empty(len(nodes), np.int64)
        order[place] = np.arange(len(nodes))
        made, cum = made.take(order, axis=0), made[:, 0].take(order)
        x = first.take(np.flatnonzero(count))
        last = x + count[count > 0] - 1
        more = np.flatnonzero(last > x)
        x, till = x[more], last[more]
        while len(x):
            x = x + 1
            cum[x] += cum[x - 1]
            more = np.flatnonzero(till > x)
            x, till = x[more], till[more]
        cum[last] = 2.0
        made[:, 0] = cum
        self.node = np.concatenate([self.node, len(self.first) - 1 + base[:-1]])
        self.size = np.concatenate([self.size, size])
        old, self.used = self.used, self.used + len(nodes)
        self.first = np.concatenate([self.first[:-1], old + first, [self.used]])
        self.count = np.concatenate([self.count, np.add.reduceat(count, base[:-1])])
        self.met = np.concatenate([self.met, np.zeros_like(size)])
        if self.used > len(self.id):  # room for all that is remembered; pages count once they are written
            room = max(REMEMBER + REMEMBER // 4, self.used * 2)
            held = self.id[:old], self.edge[:old]
            self.id, self.edge = np.empty(room, np.int32), np.empty((room, 4))
            self.id[:old], self.edge[:old] = held
        self.id[old : self.used] = ids[order]
        self.edge[old : self.used] = made

    @staticmethod
    def _levels(at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where edges sorted by their end have one end each."""
        bounds = np.searchsorted(at, np.arange(1, int(size.max(initial=0)) + 2)).tolist()
        return zip(bounds[:-1], bounds[1:])

    def kinds(self, cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The type of each unit."""
        raw = cps.astype("<u4").view(np.uint8)
        names = byte_names(raw, 4 * begin, 4 * end)
        order = np.argsort(names)  # any unit of a type stands for it, so the order of equals does not matter
        names = names.take(order)
        head = np.append(True, names[1:] != names[:-1])[: len(names)]
        names, first, inverse = names[head], order[head], np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(head) - 1
        if self.used > REMEMBER:
            self.shrink(KEEP)
        at = np.searchsorted(self.names, names)
        if len(self.names):
            new = self.names[np.minimum(at, len(self.names) - 1)] != names
        else:
            new = np.ones(len(names), bool)
        if new.any():
            fresh = first[new]
            self._learn(cps, begin[fresh], (end - begin)[fresh])
            self.number = np.insert(self.number, at[new], len(self.names) + np.arange(len(fresh)))
            self.names = np.insert(self.names, at[new], names[new])
            at = np.searchsorted(self.names, names)
        found = self.number[at]
        self.met[found] += 1
        return found.take(inverse)

    def draw(self, kinds: np.ndarray, noise: np.ndarray) -> Draw:
        """One segmentation of each unit, from the unit's noise."""
        lp, left, count = np.zeros(len(kinds)), np.zeros(len(kinds)), np.zeros(len(kinds), np.int64)
        # of the units that are not at their start yet: place, first node, characters left, noise, log-probability, what is left aside
        unit, base, at, noise, p, aside = np.arange(len(kinds)), self.node[kinds], self.size[kinds], noise, lp, left
        steps = []
        while len(unit):
            e = self.first.take(base + at)
            row = self.edge.take(e, axis=0)  # several times as fast as an index of rows
            u = _uniform(noise + _times(_STEP, len(steps) + 1))
            todo = np.flatnonzero(u >= row[:, 0])
            while len(todo):
                on = e[todo] + 1
                e[todo] = on
                on = self.edge.take(on, axis=0)
                row[todo] = on
                todo = todo[u[todo] >= on[:, 0]]
            # what the other edges of this node hold, times what led here
            aside = aside + np.exp(p) * row[:, 1]
            p = p + row[:, 2]
            at = row[:, 3].astype(np.int64)
            steps.append((unit, e))
            over = np.flatnonzero(at == 0)
            lp[unit[over]], left[unit[over]], count[unit[over]] = p[over], aside[over], len(steps)
            more = np.flatnonzero(at)
            unit, base, at, noise, p, aside = (x.take(more) for x in (unit, base, at, noise, p, aside))
        with np.errstate(divide="ignore"):
            left = np.log(left)
        offsets = np.concatenate([[0], np.cumsum(count)])
        edges = np.empty(int(offsets[-1]), np.int64)
        for k, (unit, e) in enumerate(steps):
            edges[offsets[unit + 1] - 1 - k] = e
        return Draw(lp, left, edges, offsets)

    def branches(self, kind: int, taken: list[tuple[int, ...]]) -> list[tuple[float, int, tuple[int, ...]]]:
        """How segmentations of a unit leave the taken ones: (log mass, characters before the edge, the edges from there)."""
        out, todo, base = [], [(int(self.size[kind]), 0.0, [(p, len(p)) for p in taken])], int(self.node[kind])
        while todo:
            at, lp, held = todo.pop()
            for e in range(int(self.first[base + at]), int(self.first[base + at + 1])):
                same = [(p, n - 1) for p, n in held if p[n - 1] == e]
                frm, mass = int(self.edge[e, 3]), lp + float(self.edge[e, 2])
                if not same:
                    out.append((mass, frm, (e, *held[0][0][held[0][1] :])))
                elif frm:
                    todo.append((frm, mass, same))
        return out

    def other(self, kind: int, taken: list[tuple[int, ...]], rng: random.Random) -> tuple[tuple[int, ...], float]:
        """(edges, log-probability) of a draw that is not taken."""
        ways = self.branches(kind, taken)
        top = max(w[0] for w in ways)
        lp, at, tail = rng.choices(ways, [math.exp(w[0] - top) for w in ways])[0]
        head, base = [], int(self.node[kind])
        while at:
            u, e = rng.random(), int(self.first[base + at])
            while u >= self.edge[e, 0]:
                e += 1
            head.append(e)
            lp += float(self.edge[e, 2])
            at = int(self.edge[e, 3])
        return (*reversed(head), *tail), lp

    def left(self, kind: int, taken: list[tuple[int, ...]]) -> float:
        """Log of the share of a unit's segmentations that are not taken."""
        ways = [w[0] for w in self.branches(kind, taken)]
        top = max(ways, default=-math.inf)
        return top if top == -math.inf else top + math.log(math.fsum(math.exp(w - top) for w in ways))

    def top_k(self, kinds: np.ndarray, draws: list[Draw], root: float, values: np.ndarray, seed: int) -> list[tuple[np.ndarray, float, float]]:
        """Up to len(draws) distinct segmentations (edges, log p, inclusion score) in Gumbel order, from independent
        draws of the units, the value of the first and (not truncated) those of the regions that it leaves open."""
        if not len(kinds):
            return [(np.zeros(0, np.int64), 0.0, 1.0)]
        rng, places = random.Random(seed), np.arange(len(kinds)).astype(U64) * _PLACE
        heap: list[tuple[float, int, int]] = []
        held = []  # (segmentation, taken paths of its first open unit, that unit, values of the regions)

        def opened(found: Draw, j: int, taken: list[tuple[int, ...]], value: float) -> None:
            """Push the regions that found leaves open from unit j on."""
            left = found.left[j:].copy()
            left[0] = self.left(int(kinds[j]), taken)
            u = _uniform(places[j:] + U64(seed & (1 << 64) - 1) + _times(_NOISE, len(held) + 1))
            own = found.lp[j:]
            held.append((found, taken, j, _gumbels(float(found.lp[:j].sum()) + np.cumsum(own) - own + left, u), value))
            best(len(held) - 1)

        def best(i: int) -> None:
            first, values, bound = held[i][2:]
            j = int(values.argmax())
            if values[j] > -np.inf:  # the truncation keeps the order, so only the greatest needs it
                heapq.heappush(heap, (-_below(bound, float(values[j])), i, first + j))

        held.append((draws[0], [], 0, values.copy(), root))
        best(0)
        while heap and len(held) < len(draws):
            minus, i, j = heapq.heappop(heap)
            was, taken, first, values, _ = held[i]
            values[j - first] = -np.inf
            best(i)
            gone = taken if j == first and taken else [tuple(was.part(j, j + 1).edges.tolist())]
            path, lp = self.other(int(kinds[j]), gone, rng)
            head, tail = was.part(0, j), draws[len(held)].part(j + 1, len(kinds))
            own = np.array(path, np.int64)
            at = np.concatenate([head.at, head.at[-1] + len(own) + tail.at])
            found = Draw(np.concatenate([head.lp, [lp], tail.lp]), np.concatenate([head.left, [-np.inf], tail.left]), np.concatenate([head.edges, own, tail.edges]), at)
            opened(found, j, [*gone, path], -minus)
        limit = -heap[0][0] if heap else None
        out = []
        for found, *_ in held:
            lp = float(found.lp.sum())
            out.append((found.edges, lp, 1.0 if limit is None else -math.expm1(-math.exp(min(lp - limit, 700.0)))))
        return out

    def ids(self, edges: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of rows of edges; characters without a piece become byte pieces."""
        out = self.id.take(np.concatenate([*edges, np.zeros(0, np.int64)]))
        bounds = np.cumsum([0, *map(len, edges)])
        if out.max(initial=0) >= len(self.raw):
            bounds = np.concatenate([[0], np.cumsum(self.width.take(out))]).take(bounds)
            out = self.flat.take(ragged(self.start.take(out), self.width.take(out)))
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def sample(self, texts: list[str | None], seeds: list[int], k: int) -> Iterator[tuple[str, list[tuple[np.ndarray, float, float]]]]:
        """Per text: its normalised form and up to k segmentations (ids, log p, inclusion score)."""
        plain = [self.sp.normalize(t) if t else "" for t in texts]
        cps = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        bound = np.concatenate([[0], np.cumsum([len(p) for p in plain])])
        mark = cps == ord(MARK)
        head = mark & ~np.concatenate([[False], mark[:-1]])
        head[bound[:-1][np.diff(bound) > 0]] = True
        begin = np.flatnonzero(head)
        kinds = self.kinds(cps, begin, np.append(begin[1:], len(cps)).astype(np.int64)[: len(begin)])
        unit = np.searchsorted(begin, bound)
        places = ragged(np.zeros(len(texts), np.int64), np.diff(unit)).astype(U64) * _PLACE
        noise = mix(np.repeat(np.array([s & (1 << 64) - 1 for s in seeds], U64), np.diff(unit)) + places)
        draws = [self.draw(kinds, mix(noise + _times(_DRAW, r + 1))) for r in range(k)]
        # the root's value is a Gumbel variable; the regions beside the first draw lie below it
        count = np.diff(unit)
        root = np.array([s & (1 << 64) - 1 for s in seeds], U64)
        root = -np.log(-np.log(np.maximum(_uniform(mix(root + _ROOT)), 1e-300)))
        before = np.cumsum(draws[0].lp) - draws[0].lp
        before -= np.repeat(np.append(before, 0.0)[unit[:-1]], count)
        values = _gumbels(before + draws[0].left, _uniform(mix(noise + _ROOT)))
        found = [self.top_k(kinds[a:b], [d.part(a, b) for d in draws], float(root[i]), values[a:b], seeds[i]) for i, (a, b) in enumerate(zip(unit[:-1].tolist(), unit[1:].tolist()))]
        ids = iter(self.ids([edges for f in found for edges, *_ in f]))  # laid out for the whole chunk
        for text, f in zip(plain, found):
            yield text, [(next(ids), lp, score) for _, lp, score in f]

    def bytes_of(self, ids: np.ndarray | list[int]) -> bytes:
        """The text of ids in UTF-8, as its pieces and byte pieces have it."""
        return b"".join(self.spelled.take(np.asarray(ids, np.int64)).tolist()).removeprefix(b" ")

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")


def shown(normalised: str) -> str:
    """The text that a normalised text's pieces decode to."""
    text = normalised.replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def model(path: str, alpha: float) -> Model:
    if (path, alpha) not in _models:
        _models[path, alpha] = Model(path, alpha)
    return _models[path, alpha]


def row_seed(seed: int, *key) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest(), "little")


def _sampled(path: str, alpha: float, k: int, seed: int, names: list[str], with_ids: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, alpha)

        def rows(keys: list[tuple], texts: list[str | None]) -> pa.RecordBatch:
            out = []
            for key, (plain, found) in zip(keys, m.sample(texts, [row_seed(seed, *key) for key in keys], k)):
                want = shown(plain).encode("utf-8", "replace")
                for rank, (ids, lp, score) in enumerate(found, 1):
                    data = ids.astype("<u4")
                    back = m.bytes_of(ids)
                    out.append((*key, rank, len(ids), zlib.crc32(data), lp, score, zlib.crc32(back), back == want, data, back.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*out)) or [()] * (len(names) + 9)
            n = len(names)
            kinds = [pa.int64()] * n + [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            labels = [*names, "rank", "n_pieces", "ids_crc32", "log_prob", "inclusion", "decoded_crc32", "round_trip"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in columns[n + 7]])]).astype(np.int32)
                flat = np.concatenate(columns[n + 7]).astype(np.int32) if out else np.zeros(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
                labels.append("ids")
            if with_text:
                arrays.append(pa.array(columns[n + 8], pa.string()))
                labels.append("decoded")
            return pa.RecordBatch.from_arrays(arrays, labels)

        for batch in batches:
            keys, texts, held = [], [], 0
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(tuple(key))
                texts.append(text)
                held += len(text or "")
                if held > CHUNK:
                    yield rows(keys, texts)
                    keys, texts, held = [], [], 0
            yield rows(keys, texts)
        m.shrink(IDLE)

    return run


def sample(rows: DataFrame, key_cols: list[str], text_col: str = "text", k: int = 2, alpha: float = 1.0, seed: int = 1, path: str | None = None, with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """Rows (keys, rank, n_pieces, ids_crc32, log_prob, inclusion, decoded_crc32, round_trip) and, with_ids, the ids; with_text, the text decoded from them.

    round_trip says whether the ids decode to what the plain encoding of the text decodes to.
    """
    runtime.ship(rows.sparkSession)
    names = [f"k{i}" for i in range(len(key_cols))]
    inner = rows.select(*(F.col(c).cast("bigint").alias(n) for c, n in zip(key_cols, names)), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{n} bigint" for n in names) + ", rank int, n_pieces bigint, ids_crc32 bigint, log_prob double, inclusion double, decoded_crc32 bigint, round_trip boolean"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text
    out = inner.mapInArrow(released(_sampled(path or default_path(), alpha, k, seed, names, with_ids, with_text)), schema)
    return out.withColumnsRenamed(dict(zip(names, key_cols)))


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of a column of ids (null stays null)."""
    runtime.ship(rows.sparkSession)
    path = path or default_path()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = model(path, 1.0)
        return ids.map(lambda x: None if x is None else m.decode([int(i) for i in x]))

    return rows.withColumn(out_col, text(F.col(ids_col)))
