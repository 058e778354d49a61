"""SentencePiece segmentations: Gumbel top-k without replacement over the piece lattice, and decoding.

A text's lattice is cut between characters that no piece of the model has next to each other, so that it is a chain of
small lattices (units) without losing a segmentation, and equal ones are solved once. The perturbed search walks the tree of choices (units in order, each from its
end): since the mass below every node is known, the best leaf of a set of branches is a truncated Gumbel of its mass,
and the search opens exactly one set of branches for each further segmentation.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, kept_names, mix64, powers, prefix_hash, restored, span_hash, text_slices

SAMPLES = 2
#: log weight of a piece: -RANK_COST * its rank, -PIECE_COST; of a fallback byte
RANK_COST, PIECE_COST, BYTE_COST = 2e-4, 1.5, 8.0
SLICE = 512 << 10
#: branches of a path that are kept one by one; those behind them are one set until it is opened
NEAR = 64
#: nodes that a worker's store of solved units holds (more if a slice of text needs them)
NODES = 1_500_000
#: where so few units are left, because they are long, they are solved one node at a time
FEW = 3
MASK = (1 << 64) - 1
FILTER_BITS = 17
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def scrambled(key: int, *counters: int) -> int:
    """64 bits that depend on the key and the counters (splitmix64 steps on plain integers)."""
    h = key
    for c in counters:
        h = (h ^ (c * 0x9E3779B97F4A7C15 + 0x51ED2701)) & MASK
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
        h ^= h >> 31
    return h


def uniform(key: int, *counters: int) -> float:
    """A number in (0, 1)."""
    return min((scrambled(key, *counters) >> 11) * 2.0**-53 + 2.0**-54, 1 - 2.0**-53)


def uniforms(seeds: np.ndarray, counter: int = 0) -> np.ndarray:
    u = (mix64(seeds + np.uint64((counter + 1) * 0x9E3779B97F4A7C15 & MASK)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    return np.minimum(u, 1 - 2.0**-53)


def truncated_gumbel(loc: np.ndarray | float, bound: float, u: np.ndarray | float) -> np.ndarray:
    """Gumbel of location loc given that it lies below bound."""
    g = loc - np.log(-np.log(u))
    return -np.logaddexp(-bound, -g)


def plain_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As span_hash without the final mixing, for look-ups by one length."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


class Pieces:
    """The pieces of a model by byte length, with U+2581 as a space."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        by_length: dict[int, list[tuple[bytes, int, float]]] = {}
        first = None
        self.byte_id = np.zeros(256, np.int64)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_id[b] = i
                self.bytes.append(bytes([b]))
                continue
            if sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
                continue
            p = sp.id_to_piece(i).replace("▁", " ").encode()
            self.bytes.append(p)
            first = i if first is None else first
            by_length.setdefault(len(p), []).append((p, i, -RANK_COST * (i - first) - PIECE_COST))
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        #: whether some piece holds a character that ends with the one byte and, right behind, one that begins with the other
        self.joined = np.zeros((256, 256), bool)
        self.score = np.full(sp.get_piece_size(), -BYTE_COST)
        for n, rows in by_length.items():
            flat = np.frombuffer(b"".join(p for p, _, _ in rows), np.uint8)
            at = np.arange(len(rows)) * n
            inner = np.flatnonzero((np.arange(len(flat)) % n > 0) & ((flat & 0xC0) != 0x80))
            self.joined[flat[inner - 1], flat[inner]] = True
            h = plain_hash(prefix_hash(flat), at, at + n)
            order = np.argsort(h)
            ids = np.array([i for _, i, _ in rows])
            self.score[ids] = [s for _, _, s in rows]
            maybe = np.zeros(1 << FILTER_BITS, bool)  # most strings are no piece: this tells without a search
            maybe[(h * _SPREAD) >> np.uint64(64 - FILTER_BITS)] = True
            self.tables[n] = (h[order], ids[order], maybe)
        size = np.array([len(x) for x in self.bytes])
        self.size, self.place, self.flat = size, np.concatenate([[0], np.cumsum(size)[:-1]]), np.frombuffer(b"".join(self.bytes), np.uint8)

    def find(self, h: np.ndarray, n: int) -> np.ndarray:
        """The id, or -1, of strings of n bytes by their hashes."""
        out = np.full(len(h), -1)
        if n in self.tables:
            keys, ids, maybe = self.tables[n]
            some = np.flatnonzero(maybe[(h * _SPREAD) >> np.uint64(64 - FILTER_BITS)])
            at = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
            hit = keys[at] == h[some]
            out[some[hit]] = ids[at[hit]]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the pieces, without the space that encoding puts before the text."""
        n = self.size[ids]
        out = np.concatenate([[0], np.cumsum(n)])
        raw = self.flat[np.arange(out[-1]) + np.repeat(self.place[ids] - out[:-1], n)].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


class Units:
    """Solved units of a worker. Each node (place in a unit) has its log mass and its choices: the pieces that can end
    there, shortest first, with the chance of this one or a shorter one. When the store is full it is emptied.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._allot(NODES)
        self.id, self.width, self.cum = (np.zeros(4 * NODES, t) for t in (np.int32, np.int32, np.float64))
        self.clear()

    def _allot(self, nodes: int) -> None:
        self.mass, self.first, self.count = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int32)

    def clear(self) -> None:
        self.used, self.choices, self.keys, self.ends = 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The end node of each unit, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ends[at], -1)

    def solve(self, keys: np.ndarray, data: np.ndarray, prefix: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """End nodes of the sorted units, solving those that are new."""
        ends = self.find(keys)
        if self.used + int((n[ends < 0] + 1).sum()) > len(self.mass):
            self.clear()
            ends = np.full(len(keys), -1)
            need = int((n + 1).sum())
            if need > len(self.mass):
                self._allot(need)
        new = np.flatnonzero(ends < 0)
        if len(new):
            ends[new] = self._solve(data, prefix, start[new], n[new])
            order = np.argsort(np.concatenate([self.keys, keys[new]]), kind="stable")
            self.keys = np.concatenate([self.keys, keys[new]])[order]
            self.ends = np.concatenate([self.ends, ends[new]])[order]
        return ends

    def _solve(self, data: np.ndarray, prefix: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        base = np.concatenate([[0], np.cumsum(n + 1)])
        nodes = int(base[-1])
        at = np.repeat(start - base[:-1], n + 1) + np.arange(nodes)  # byte of each node
        pos = np.arange(nodes) - np.repeat(base[:-1], n + 1)
        raw = np.flatnonzero((pos >= 1) & ~known_bytes(self.pieces, data, prefix, start, n))
        ends, widths, ids = [raw], [np.ones(len(raw), np.int64)], [self.pieces.byte_id[data[at[raw] - 1]]]
        long_enough = np.flatnonzero(pos >= 1)
        for k in sorted(self.pieces.tables):
            long_enough = long_enough[pos[long_enough] >= k]
            if not len(long_enough):
                break
            i = self.pieces.find(plain_hash(prefix, at[long_enough] - k, at[long_enough]), k)
            hit = np.flatnonzero(i >= 0)
            ends.append(long_enough[hit])
            widths.append(np.full(len(hit), k))
            ids.append(i[hit])
        end, width, piece = np.concatenate(ends), np.concatenate(widths), np.concatenate(ids)
        by_pos = np.argsort(pos, kind="stable")
        turn = np.empty(nodes, np.int64)
        turn[by_pos] = np.arange(nodes)
        order = np.lexsort((width, turn[end]))
        end, width, piece = end[order], width[order], piece[order]
        score = self.pieces.score[piece]
        here = slice(self.used, self.used + nodes)
        mass, first, count = self.mass[here], self.first[here], self.count[here]
        mass[:] = np.where(pos == 0, 0.0, -np.inf)
        count[:] = np.bincount(end, minlength=nodes)
        begin = np.concatenate([[0], np.cumsum(count[by_pos])])  # of the choices of each node, in order of places
        first[by_pos] = begin[:-1] + self.choices
        cum = np.zeros(len(end))
        longest = int(n.max())
        bounds = np.searchsorted(pos[by_pos], np.arange(longest + 2))
        few = int(np.argmax(np.append(np.diff(bounds)[1:] <= FEW, True))) + 1  # from this place on
        for j in range(1, few):
            e = by_pos[bounds[j] : bounds[j + 1]]
            e = e[count[e] > 0]
            if not len(e):
                continue
            lo, hi = begin[bounds[j]], begin[bounds[j + 1]]
            seg = first[e] - self.choices - lo
            w = mass[end[lo:hi] - width[lo:hi]] + score[lo:hi]
            top = np.maximum.reduceat(w, seg)
            live = np.isfinite(top)
            x = np.exp(w - np.repeat(np.where(live, top, 0), count[e]))
            c = np.cumsum(x)
            c -= np.repeat((c - x)[seg], count[e])
            total = c[seg + count[e] - 1]
            mass[e] = np.where(live, top + np.log(np.where(live, total, 1)), -np.inf)
            cum[lo:hi] = c / np.repeat(np.where(live, total, 1), count[e])
        if few <= longest:
            self._solve_few(by_pos[bounds[few] :], begin[bounds[few] :], end, width, score, mass, cum)
        size = self.choices + len(end)
        if size > len(self.id):
            self.id, self.width, self.cum = (np.resize(x, 2 * size) for x in (self.id, self.width, self.cum))
        self.id[self.choices : size], self.width[self.choices : size], self.cum[self.choices : size] = piece, width, cum
        self.used, self.choices = self.used + nodes, size
        return self.used - nodes + base[:-1] + n

    @staticmethod
    def _solve_few(nodes: np.ndarray, begin: np.ndarray, end: np.ndarray, width: np.ndarray, score: np.ndarray, mass: np.ndarray, cum: np.ndarray) -> None:
        """The same for the given nodes in order of their places, one after the other."""
        lo = int(begin[0])
        source, cost = (end[lo:] - width[lo:]).tolist(), score[lo:].tolist()
        known: dict[int, float] = {}
        for node, i, j in zip(nodes.tolist(), (begin[:-1] - lo).tolist(), (begin[1:] - lo).tolist(), strict=True):
            w = [(known[s] if s in known else float(mass[s])) + c for s, c in zip(source[i:j], cost[i:j], strict=True)]
            top = max(w, default=-math.inf)
            known[node] = -math.inf
            if top > -math.inf:
                run, sums = 0.0, []
                for x in w:
                    run += math.exp(x - top)
                    sums.append(run)
                known[node] = top + math.log(run)
                cum[lo + i : lo + j] = [x / run for x in sums]
        mass[list(known)] = list(known.values())


def known_bytes(pieces: Pieces, data: np.ndarray, prefix: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each node of the units whether the character that ends there (or reaches over it) is a piece."""
    base = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.ones(base[-1], bool)
    at = np.repeat(start - base[:-1], n + 1) + np.arange(base[-1])
    inner = np.ones(base[-1], bool)
    inner[base[:-1]] = False  # first nodes have no byte before them
    byte = data[np.maximum(at - 1, 0)]
    node = np.flatnonzero(inner & ((byte & 0xC0) != 0x80))  # nodes right behind a leading byte
    size = np.where(data[at[node] - 1] < 0x80, 1, np.where(data[at[node] - 1] < 0xE0, 2, np.where(data[at[node] - 1] < 0xF0, 3, 4)))
    for k in np.unique(size):
        e = node[size == k]
        bad = e[pieces.find(plain_hash(prefix, at[e] - 1, at[e] - 1 + k), int(k)) < 0]
        for i in range(int(k)):
            out[bad + i] = False
    return out


_UNITS: dict[str, Units] = {}


def worker_units(path: str) -> Units:
    """A Python worker keeps its solved units for later tasks."""
    if path not in _UNITS:
        _UNITS.clear()
        _UNITS[path] = Units(Pieces(path))
    return _UNITS[path]


class Lattice:
    """The units of some texts and the nodes at which they end."""

    def __init__(self, solved: Units, data: np.ndarray, offs: np.ndarray):
        size = np.diff(offs)
        some = size > 0
        data = np.insert(data, offs[:-1][some], 32)  # the space before each text
        offs = np.concatenate([[0], np.cumsum(size + some)])
        cut = np.zeros(len(data), bool)
        cut[1:] = ((data[1:] & 0xC0) != 0x80) & ~solved.pieces.joined[data[:-1], data[1:]]
        cut[offs[:-1][some]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        self.first = np.searchsorted(start, offs)  # of each row's units
        self.solved = solved
        self.length = end - start
        if not len(start):
            self.end_node = np.zeros(0, np.int64)
            return
        prefix = prefix_hash(data)
        keys, one, inv = np.unique(span_hash(prefix, start, end), return_index=True, return_inverse=True)
        self.end_node = solved.solve(keys, data, prefix, start[one], self.length[one])[inv]

    def logp(self, node: np.ndarray | int, pick: np.ndarray) -> np.ndarray:
        """Log chances of the choices at their nodes."""
        s = self.solved
        return s.mass[node - s.width[pick]] + s.pieces.score[s.id[pick]] - s.mass[node]

    def chances(self, node: int) -> np.ndarray:
        """Of the node's choices, in their order."""
        s = self.solved
        return np.exp(self.logp(node, np.arange(s.first[node], s.first[node] + s.count[node])))

    def walk(self, key: np.ndarray, turn: int) -> Walk:
        """One segmentation of every unit, each piece drawn by its probability; key: of each unit's row."""
        s, units = self.solved, len(self.end_node)
        index = np.arange(units) - np.repeat(self.first[:-1], np.diff(self.first))
        seed = mix64(key ^ mix64(index.astype(np.uint64) + np.uint64(turn << 48)))
        node, left, live = self.end_node.copy(), self.length.copy(), np.arange(units)
        steps = []
        while len(live):
            u = uniforms(seed[live], len(steps))
            at = node[live]
            pick = s.first[at]
            todo = np.flatnonzero(s.cum[pick] <= u)
            while len(todo):
                pick[todo] += 1
                todo = todo[s.cum[pick[todo]] <= u[todo]]
            steps.append((live, at, pick))
            node[live] -= s.width[pick]
            left[live] -= s.width[pick]
            live = live[left[live] > 0]
        count = np.zeros(units, np.int64)
        for live, _, _ in steps:
            count[live] += 1
        off = np.concatenate([[0], np.cumsum(count)])
        at_node, picks = np.zeros(off[-1], np.int64), np.zeros(off[-1], np.int64)
        ids = np.zeros(off[-1], np.int64)
        for i, (live, nd, k) in enumerate(steps):
            at_node[off[live] + i], picks[off[live] + i] = nd, k
            ids[off[live + 1] - 1 - i] = s.id[k]
        return Walk(off, at_node, picks, self.logp(at_node, picks), ids)


class Walk:
    def __init__(self, off: np.ndarray, node: np.ndarray, pick: np.ndarray, logp: np.ndarray, ids: np.ndarray):
        self.off, self.node, self.pick, self.logp, self.ids = off, node, pick, logp, ids

    def rows(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """(unit boundaries, node, pick, logp, ids) of the units lo to hi."""
        a, b = self.off[lo], self.off[hi]
        return self.off[lo : hi + 1] - a, self.node[a:b], self.pick[a:b], self.logp[a:b], self.ids[a:b]


class Branches:
    """Best perturbed values of the branches off a path from choice `since` on, all below a bound.

    values holds them for choices up to `known`; rest is the best value of all further branches together.
    """

    def __init__(self, logp: np.ndarray, since: int, bound: float, key: int, number: int):
        self.logp, self.key, self.number = logp, key, number
        self.values = np.full(min(len(logp), since + NEAR), -np.inf)
        self.before = float(logp[:since].sum())
        self.values[since:] = self._draw(since, len(self.values), bound, self._masses(since, len(self.values)))
        self.rest = -math.inf
        if len(self.values) < len(logp):
            same = float(logp[len(self.values) :].sum())
            if same < -1e-12:
                mass = self.before + float(logp[since : len(self.values)].sum()) + math.log(-math.expm1(same))
                self.rest = float(truncated_gumbel(mass, bound, uniform(key, 6, number)))
        self.since = since

    def _masses(self, lo: int, hi: int) -> np.ndarray:
        x = self.logp[lo:hi]
        out = self.before + np.cumsum(x) - x
        off = -np.expm1(x)
        return np.where(off > 1e-12, out + np.log(np.maximum(off, 1e-300)), -np.inf)

    def _draw(self, lo: int, hi: int, bound: float, mass: np.ndarray) -> np.ndarray:
        some = mass > -np.inf
        return np.where(some, truncated_gumbel(np.where(some, mass, 0.0), bound, uniforms(np.arange(lo, hi, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) ^ np.uint64(scrambled(self.key, 2, self.number)))), -np.inf)

    def best(self) -> float:
        return max(float(self.values.max(initial=-np.inf)), self.rest)

    def open(self) -> int:
        """The choice whose branches hold the best value; opens the rest if that holds it."""
        if self.rest > self.values.max(initial=-np.inf):
            n = len(self.values)
            self.before += float(self.logp[self.since : n].sum())
            mass = self._masses(n, len(self.logp))
            more = self._draw(n, len(self.logp), self.rest, mass)
            w = np.cumsum(np.exp(mass - mass.max()))
            more[min(int(np.searchsorted(w, uniform(self.key, 7, self.number) * w[-1], side="right")), len(w) - 1)] = self.rest
            self.values = np.concatenate([self.values, more])
            self.rest = -math.inf
        return int(self.values.argmax())


def search(lat: Lattice, walks: list[Walk], row: int, key: int, samples: int) -> tuple[list[tuple[np.ndarray, float, float]], float]:
    """The segmentations of one text: ids, log probability, perturbed value, best first; and the best value left out.

    A further segmentation keeps the choices of an opened path before the branch, takes another piece there, and goes
    on with a walk of its own behind the unit.
    """
    lo, hi = int(lat.first[row]), int(lat.first[row + 1])
    if lo == hi:
        return [(np.zeros(0, np.int64), 0.0, 0.0)], -math.inf
    g = -math.log(-math.log(uniform(key, 1)))
    paths: list[tuple] = []
    branches: list[Branches] = []
    out = []

    def add(path: tuple, since: int, bound: float) -> None:
        branches.append(Branches(path[3], since, bound, key, len(paths)))
        paths.append(path)
        out.append((path[4], float(path[3].sum()), bound))

    add(walks[0].rows(lo, hi), 0, g)
    taken: dict[tuple[int, int], list[int]] = {}
    while True:
        best = max(range(len(paths)), key=lambda i: branches[i].best())
        value = branches[best].best()
        if len(out) == samples or value == -math.inf:
            return out, value
        t = branches[best].open()
        off, node, pick, logp, ids = paths[best]
        turn = len(paths)
        s, begin_at = lat.solved, int(lat.solved.first[node[t]])
        gone = taken.setdefault((best, t), [int(pick[t]) - begin_at])
        p = lat.chances(int(node[t]))
        p[gone] = 0
        k = int(min(np.searchsorted(np.cumsum(p), uniform(key, 3, turn) * p.sum(), side="right"), np.flatnonzero(p)[-1]))
        gone.append(k)
        left = p.sum() - p[k]
        mass = math.log(left) + float(logp[:t].sum()) if left > 1e-12 else -math.inf
        branches[best].values[t] = float(truncated_gumbel(mass, value, uniform(key, 4, turn, t))) if mass > -math.inf else -np.inf
        unit = int(np.searchsorted(off, t, side="right")) - 1
        # the rest of the unit behind the branch
        nd, begin = int(node[t]), int(lat.end_node[lo + unit] - lat.length[lo + unit])
        nodes, picks = [nd], [begin_at + k]
        nd -= int(s.width[picks[-1]])
        while nd > begin:
            i = int(s.first[nd])
            nodes.append(nd)
            picks.append(i + int(np.searchsorted(s.cum[i : i + int(s.count[nd])], uniform(key, 5, turn, nd - begin), side="right")))
            nd -= int(s.width[picks[-1]])
        w_off, w_node, w_pick, w_logp, w_ids = walks[turn].rows(lo + unit + 1, hi)
        mid_node, mid_pick = np.concatenate([node[off[unit] : t], nodes]), np.concatenate([pick[off[unit] : t], picks])
        head = off[unit]
        new = (
            np.concatenate([off[: unit + 1], head + len(mid_node) + w_off]),
            np.concatenate([node[:head], mid_node, w_node]),
            np.concatenate([pick[:head], mid_pick, w_pick]),
            np.concatenate([logp[:head], lat.logp(mid_node, mid_pick), w_logp]),
            np.concatenate([ids[:head], s.id[mid_pick][::-1], w_ids]),
        )
        add(new, t + 1, value)


def log_inclusion(logp: float, edge: float) -> float:
    """Log chance that a segmentation's perturbed value exceeds the best value left out."""
    if edge == -math.inf:
        return 0.0
    x = logp - edge
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700))))


def sample_pieces(df: DataFrame, keep: list[str], model_path: str, key: Column, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """The kept columns with sample (from 1), ids, log_prob, perturbed, log_inclusion and text_back for each segmentation.

    Distinct segmentations of a text, best perturbed value first; fewer if its lattice has fewer. key seeds a row: rows
    of equal key and text get equal results. Null and empty texts have one empty segmentation. text_back is what the
    ids decode to. An empty table gives no rows. A result column whose name a kept one has gets underscores.
    """
    added = "sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, text_back string"
    return _sampled(df, keep, model_path, key, text_col, samples, added, _full)


def sample_digests(df: DataFrame, keep: list[str], model_path: str, key: Column, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """As sample_pieces, but with n_pieces, ids_crc32 (little-endian 32-bit ids) and round_trip in place of ids and text."""
    added = "sample int, n_pieces bigint, ids_crc32 bigint, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
    return _sampled(df, keep, model_path, key, text_col, samples, added, _digest)


def _full(pieces: Pieces, ids: np.ndarray, _: bytes) -> tuple:
    return ids.astype(np.int32), pieces.decode(ids).decode()


def _digest(pieces: Pieces, ids: np.ndarray, text: bytes) -> tuple:
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), pieces.decode(ids) == text


def _sampled(df: DataFrame, keep: list[str], model_path: str, key: Column, text_col: str, samples: int, added: str, result) -> DataFrame:
    n = len(keep)
    src = df.select(*kept_columns(keep), F.col(f"`{text_col}`").cast("string").alias("sampled_text"), F.xxhash64(key).alias("text_key"))
    extra = T._parse_datatype_string(added).fields
    schema = T.StructType([*src.schema.fields[:n], *extra])
    names = [f.name for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_units(model_path)
        pieces = units.pieces
        types = {"ids": pa.list_(pa.int32()), "sample": pa.int32(), "log_prob": pa.float64(), "perturbed": pa.float64(), "log_inclusion": pa.float64(), "text_back": pa.string(), "round_trip": pa.bool_()}
        for b in batches:
            keys = b.column(n + 1).to_numpy().view(np.uint64)
            for lo, hi, data, offs in text_slices(b.column(n), SLICE):
                lat = Lattice(units, data, offs)
                unit_key = np.repeat(keys[lo:hi], np.diff(lat.first))
                walks = [lat.walk(unit_key, r) for r in range(samples)]
                rows: list[int] = []
                cols: dict[str, list] = {x: [] for x in names}
                for r in range(hi - lo):
                    found, edge = search(lat, walks, r, int(keys[lo + r]), samples)
                    text = data[offs[r] : offs[r + 1]].tobytes()
                    for i, (ids, logp, value) in enumerate(found):
                        rows.append(lo + r)
                        got = result(pieces, ids, text)
                        values = {"sample": i + 1, "log_prob": logp, "perturbed": value, "log_inclusion": log_inclusion(logp, edge)}
                        values |= {"ids": got[0], "text_back": got[1]} if len(got) == 2 else {"n_pieces": got[0], "ids_crc32": got[1], "round_trip": got[2]}
                        for x in names:
                            cols[x].append(values[x])
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:n]], *[pa.array(cols[x], types.get(x, pa.int64())) for x in names]], schema.names)

    return restored(src.mapInArrow(run, schema), keep, names)


def encode_pieces(df: DataFrame, keep: list[str], model_path: str, text_col: str = "text") -> DataFrame:
    """The kept columns with ids, the model's own (best) segmentation of the whole text by the sentencepiece library.

    Null and empty texts have no ids. Repeated rows get equal ids, an empty table gives no rows. A result column whose
    name a kept one has gets underscores.
    """
    return _by_model(df, keep, model_path, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), T.StructField("ids", T.ArrayType(T.IntegerType())), pa.list_(pa.int32()), lambda sp, x: sp.encode(x))


def decode_pieces(df: DataFrame, keep: list[str], model_path: str, ids_col: str = "ids") -> DataFrame:
    """The kept columns with text, what the ids (of encode_pieces or sample_pieces) stand for; null ids give an empty text."""

    def decode(sp, rows: list[list[int]]) -> list[str]:
        if model_path not in _PIECES:
            _PIECES.clear()
            _PIECES[model_path] = Pieces(model_path)
        return [_PIECES[model_path].decode(np.array(x or [], np.int64)).decode(errors="replace") for x in rows]

    return _by_model(df, keep, model_path, F.col(f"`{ids_col}`").cast("array<int>"), T.StructField("text", T.StringType()), pa.string(), decode)


_PIECES: dict[str, Pieces] = {}


def _by_model(df: DataFrame, keep: list[str], model_path: str, source: Column, field: T.StructField, kind: pa.DataType, apply) -> DataFrame:
    src = df.select(*kept_columns(keep), source.alias("source"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(apply(sp, b.column(n).to_pylist()), kind)], [*kept_names(keep), field.name])

    return restored(src.mapInArrow(run, T.StructType([*src.schema.fields[:n], field])), keep, [field.name])
