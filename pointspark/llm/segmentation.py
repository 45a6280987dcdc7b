"""SentencePiece segmentations sampled without replacement, and their decoding.

A text's lattice has an edge for each piece that matches at a character, and an
edge of byte pieces for a character that no piece covers.  A segmentation's
probability is proportional to the product of its pieces' weights.  Gumbel
top-k picks ``k`` distinct segmentations: every segmentation has its
log-probability plus Gumbel noise, and the k highest are taken, by A-star
search from the whole lattice down.  A search node is a prefix; its bound, the
largest perturbed value below it, has a Gumbel distribution around the prefix's
log-mass.  The node's path to that largest segmentation is drawn edge by edge
from the lattice, and the edges that leave the path become nodes whose bounds
are Gumbel values truncated at the node's own.  Those that leave it where the
prefix is less likely than exp(-``WINDOW``) wait together as one node with
their total mass, which is opened only if it is the best.

Inclusion scores are the probabilities of being among the highest k, given the
(k+1)-th perturbed value.  All noise is a hash of the row key, so it depends
neither on batches nor on partitions.

Pieces don't cross the start of a word, so the lattice of a text is a chain of
word lattices, which are made once a word and remembered.

Scores that are whole numbers are merge ranks (a BPE model); their log-weights
are ``-alpha * log(rank + 1)``.  Other scores are log-probabilities and are
multiplied by ``alpha``.

Defined results: a null or empty text has one segmentation, without pieces; a
text with fewer than k segmentations gives all of them, with inclusion 1; a null
id is a key of its own; repeated rows are repeated; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pointspark.llm.subwords import blocks

K = 2
ALPHA = 1.0
WINDOW = 12.0
#: Characters of texts that are searched side by side.
BLOCK = 500_000
#: Edges beyond which a worker forgets all words but those at hand; between tasks it holds none.
MEMO_EDGES = 4_000_000
SPACE = "▁"
_ALL = 2**64 - 1
_RUNS = re.compile(r" *[^ ]+| +\Z")


class Trie:
    """Pieces as a trie whose steps lie in a hash table, so that all characters of many words walk it together."""

    def __init__(self, pieces: dict[str, int]):
        steps: dict[int, int] = {}
        ends = [-1]
        for piece, number in pieces.items():
            node = 0
            for char in map(ord, piece):
                node = steps.setdefault(node << 21 | char, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = number
        self.ends = np.array(ends, np.int64)
        bits = len(steps).bit_length() + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        key, value = np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps))
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            settled = self.keys[slot] == key
            self.values[slot[settled]] = value[settled]
            key, value, slot = key[~settled], value[~settled], slot[~settled] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _step(self, key: np.ndarray) -> np.ndarray:
        """The node that each step leads to; -1: none."""
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], -1).astype(np.int64)
        rest = np.flatnonzero((held != key) & (held >= 0))
        slot = slot[rest]
        while len(rest):
            slot = slot + 1 & self.mask
            held, wanted = self.keys[slot], key[rest]
            met = held == wanted
            out[rest[met]] = self.values[slot[met]]
            on = ~met & (held >= 0)
            rest, slot = rest[on], slot[on]
        return out

    def matches(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(begin, piece) of all pieces of one character, of two and so on, in code points that end with one that no piece has."""
        at, node, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        found: list[tuple] = []
        while len(at):
            node = self._step(node << 21 | codes[at + depth])
            alive = np.flatnonzero(node >= 0)
            at, node, depth = at[alive], node[alive], depth + 1
            piece = self.ends[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], piece[hit]))
        return found


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of rows that begin at ``starts`` with ``sizes``, end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Lattices:
    """Word lattices of one model in flat arrays.

    Node n has the edges ``first[n]`` to ``first[n + 1] - 1``; an edge has a
    target node (-1: end of the word), a piece, the log of its probability
    given the node, and in ``share`` the probability of the node's edges up to
    it.  A piece number beyond the vocabulary stands for
    the bytes of a character.  The arrays have room to spare beyond the
    ``n_nodes`` nodes and ``n_edges`` edges.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        ranks = all(s == int(s) for s in scores.values())
        weight = {i: -alpha * math.log(1 - s) if ranks else alpha * s for i, s in scores.items()}
        pieces: dict[str, int] = {}
        text = [b""] * size
        self.byte_id = {}
        longest, self.weight = 0, np.zeros(size)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                text[i] = bytes([int(piece[1:-1], 16)])
            elif i in weight:
                pieces[piece] = i
                self.weight[i], longest = weight[i], max(longest, len(piece))
                text[i] = piece.replace(SPACE, " ").encode()
        self.joined = np.frombuffer(b"".join(text), np.uint8)
        self.sizes = np.fromiter(map(len, text), np.int64, size)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.least, self.longest = min(weight.values()), longest
        self.unknown = model.unk_id()
        self.ascii_id = np.array([self.byte_id.get(i, self.unknown) for i in range(128)], np.int32)
        self.size = size
        self.trie = Trie(pieces)
        self.forget()

    def forget(self) -> None:
        self.start: dict[str, int] = {}
        self.n_nodes = self.n_edges = 0
        self.first, self.target, self.piece, self.logp, self.share = [np.zeros(1, t) for t in (np.int64, np.int32, np.int32, float, np.float32)]

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values from ``at`` on, into an array half as large again where it is too short."""
        old = getattr(self, name)
        if at + len(values) > len(old):
            new = np.zeros(max(at + len(values), len(old) * 3 // 2), old.dtype)
            new[:at] = old[:at]
            setattr(self, name, new)
        getattr(self, name)[at : at + len(values)] = values

    def bytes_of(self, char: str) -> list[int]:
        found = [self.byte_id.get(b) for b in char.encode()]
        return [self.unknown] if None in found else found

    def _add(self, words: list[str]) -> None:
        """Make the lattices of words (without the space that they start with), all side by side.

        Each word is followed by a zero character, which no piece has and whose
        node has no edges.
        """
        text = f"{SPACE}{f'\0{SPACE}'.join(words)}\0".replace(" ", SPACE)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes) - 1
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found = self.trie.matches(codes)
        bare = np.ones(len(text), bool)
        bare[found[0][0]] = bare[ends] = False
        bare = np.flatnonzero(bare)
        number = np.zeros(len(text), np.int64)
        for at in (bare, *(x for x, _ in found)):
            number[at] += 1
        first = np.cumsum(number) - number
        # The edges of a node are in ascending order of their ends, as pieces are found by their lengths.
        codes, free, n_edges = codes[bare], first.copy(), int(number.sum())
        n_bytes = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        begin, end, piece, weight = np.repeat(np.arange(len(text)), number), np.zeros(n_edges, np.int64), np.zeros(n_edges, np.int32), np.zeros(n_edges)
        for depth, at, own, value in ((1, bare, self.size + codes, self.least * n_bytes), *((d, x, y, self.weight[y]) for d, (x, y) in enumerate(found, 1))):
            slot = free[at]
            end[slot], piece[slot], weight[slot], free[at] = at + depth, own, value, slot + 1
        # Log-masses from the words' ends backwards, all nodes at one distance together.
        inner = np.flatnonzero(number)
        stop = np.repeat(ends, sizes)  # where the word of each character ends
        far = stop[inner] - inner
        order = np.argsort(far.astype(np.uint16) if far.max() < 65_536 else far, kind="stable")
        inner, far = inner[order], far[order]
        number_of = number[inner]
        levels = np.append(np.flatnonzero(np.append(True, far[1:] != far[:-1])), len(far))
        group = np.append(0, np.cumsum(number_of))
        order = _places(first[inner], number_of)
        ordered, to = weight[order], end[order]
        mass = np.zeros(len(text))
        for low, high in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            own = slice(int(group[low]), int(group[high]))
            value, at = ordered[own] + mass[to[own]], group[low:high] - group[low]
            top = np.maximum.reduceat(value, at)
            mass[inner[low:high]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, number_of[low:high])), at))
        logp = np.where(number[begin] > 1, np.minimum(weight + mass[end] - mass[begin], 0.0), 0.0)
        sums = np.concatenate([[0.0], np.cumsum(np.exp(logp))])
        share = np.minimum(sums[1:] - sums[first[begin]], 1.0)
        share[np.append(begin[1:] != begin[:-1], True)] = 1.0
        nodes, edges = self.n_nodes, self.n_edges
        self._put("first", nodes, np.append(first, len(begin)) + edges)
        for name, values in (("target", np.where(end == stop[begin], -1, end + nodes)), ("piece", piece), ("logp", logp), ("share", share)):
            self._put(name, edges, values)
        self.n_nodes, self.n_edges = nodes + len(text), edges + len(begin)
        self.start.update(zip(words, (np.cumsum(sizes) - sizes + nodes).tolist(), strict=True))

    def shrink(self, words: list[str]) -> None:
        """Forget all words but these."""
        kept = {w: self.start[w] for w in set(words) if w in self.start}
        if not kept:
            return self.forget()
        old = np.fromiter(self.start.values(), np.int64, len(self.start))  # in ascending order, as words are added
        begin = np.sort(np.fromiter(kept.values(), np.int64, len(kept)))
        end = np.append(old, self.n_nodes)[np.searchsorted(old, begin) + 1]
        size, low, n = end - begin, self.first[begin], self.first[end] - self.first[begin]
        moved, shift = np.cumsum(size) - size, np.cumsum(n) - n
        node = np.arange(int(size.sum())) + np.repeat(begin - moved, size)
        edge = np.arange(int(n.sum())) + np.repeat(low - shift, n)
        target = self.target[edge]
        new = {"first": np.append(self.first[node] + np.repeat(shift - low, size), len(edge))}
        new["target"] = np.where(target < 0, -1, target + np.repeat(moved - begin, n)).astype(np.int32)
        for name in ("piece", "logp", "share"):
            new[name] = getattr(self, name)[edge]
        for name, values in new.items():
            setattr(self, name, values)
        self.n_nodes, self.n_edges = len(node), len(edge)
        at = dict(zip(begin.tolist(), moved.tolist(), strict=True))
        self.start = {w: at[x] for w, x in sorted(kept.items(), key=lambda item: item[1])}

    def nodes(self, words: list[str]) -> np.ndarray:
        """The first node of each word."""
        if self.n_edges > MEMO_EDGES:
            self.shrink(words)
        found = np.fromiter(map(self.start.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(found < 0)
        if len(missed):
            lacking = [words[i] for i in missed.tolist()]
            fresh = list(dict.fromkeys(lacking))
            for at in range(0, len(fresh), 8_000):
                self._add(fresh[at : at + 8_000])
            found[missed] = np.fromiter(map(self.start.__getitem__, lacking), np.int64, len(lacking))
        return found

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node whose share first exceeds u; the last one's is 1, and few nodes have many."""
        edge = self.first[node]
        rest = np.flatnonzero(self.share[edge] <= u)
        at, u = edge[rest], u[rest]
        while len(rest):
            at += 1
            edge[rest] = at
            on = np.flatnonzero(self.share[at] <= u)
            rest, at, u = rest[on], at[on], u[on]
        return edge

    def edges_of(self, node: int) -> tuple[int, int]:
        return int(self.first[node]), int(self.first[node + 1])

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path; characters without a piece become their byte pieces."""
        found = self.piece[edges]
        odd = np.flatnonzero(found >= self.size)
        if not len(odd):
            return found
        codes = found[odd] - self.size
        if codes.max() < 128:
            found[odd] = self.ascii_id[codes]
            return found
        parts, at = [], 0
        for i in odd.tolist():
            parts += [found[at:i], np.array(self.bytes_of(chr(int(found[i]) - self.size)), np.int64)]
            at = i + 1
        return np.concatenate([*parts, found[at:]])

    def decode(self, ids) -> str:
        """The text of piece ids, without the space that encoding puts first."""
        return self.raw(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of a text's pieces, without the space that encoding puts first."""
        raw = self.joined[_places(self.begins[ids], self.sizes[ids])].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


def words_of(text: str | None) -> list[str]:
    """Words without the space before them; further spaces before a word stay with it."""
    if not text:
        return []
    if "  " not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def absorb(state: np.ndarray, counter) -> np.ndarray:
    """The hash of a state and one more counter."""
    return _mix(state + np.uint64(0x9E3779B97F4A7C15) + np.asarray(counter).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def unit(state: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from each hash."""
    return ((state >> np.uint64(12)).astype(float) + 0.5) / 2**52


def uniform(key: np.ndarray, *counters) -> np.ndarray:
    """Numbers in (0, 1) from a hash of a key and counters."""
    x = np.asarray(key, np.uint64)
    for c in counters:
        x = absorb(x, c)
    return unit(x)


def truncated_gumbel(log_mass: float, bound: float, u: float) -> float:
    """A Gumbel value around ``log_mass`` given that it is at most ``bound``."""
    return log_mass - math.log(math.exp(min(log_mass - bound, 700)) - math.log(u))


def _draw(lattices: Lattices, keys: np.ndarray, places: np.ndarray, nodes: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, how many for each word): paths from nodes to the ends of their words; -1 has none."""
    taken, owners = [], []
    alive, at, step = np.flatnonzero(nodes >= 0), nodes[nodes >= 0], 0
    state = absorb(absorb(keys[alive], sample), places[alive])
    while len(alive):
        u = unit(absorb(state, step))
        edge = lattices.choose(at, u)
        taken.append(edge)
        owners.append(alive)
        at = lattices.target[edge]
        on = at >= 0
        alive, state, at, step = alive[on], state[on], at[on], step + 1
    number = np.bincount(np.concatenate(owners), minlength=len(nodes)) if owners else np.zeros(len(nodes), np.int64)
    begin = np.cumsum(number) - number
    edges = np.zeros(int(number.sum()), np.int64)
    for step, (edge, owner) in enumerate(zip(taken, owners, strict=True)):
        edges[begin[owner] + step] = edge
    return edges, number


class _Search:
    """The A-star search of one text: emitted paths, and the best nodes that wait."""

    def __init__(self, lattices: Lattices, key: int, starts: np.ndarray, k: int):
        self.lattices, self.key, self.k = lattices, key, k
        self.starts, self.words = starts, len(starts)  # the first node of each word
        self.paths: list[tuple] = []  # edges, word of each edge, log-probability, perturbed value
        self.heap: list[tuple] = []
        self.drawn = 0

    def noise(self) -> float:
        self.drawn += 1
        x = (self.key + self.drawn * 0x9E3779B97F4A7C15) & _ALL
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
        x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
        return (((x ^ x >> 31) >> 12) + 0.5) / 2**52

    def emit(self, edges: np.ndarray, word: np.ndarray, value: float) -> None:
        """Take a path; ``open_paths`` has to open it."""
        prefix = np.zeros(len(edges) + 1)
        np.cumsum(self.lattices.logp[edges], out=prefix[1:])
        self.paths.append((edges, word, float(prefix[-1]), value, prefix))

    def _leaving(self, path: int, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, node, edge) of the edges that leave a path at positions from ``begin`` to before ``stop``."""
        lattices, (edges, word) = self.lattices, self.paths[path][:2]
        taken = edges[begin:stop]
        # An edge leaves from where the one before it led, or from the start of its word.
        node = self.starts[word[begin:stop]]
        if begin < stop:
            led = lattices.target[edges[begin - 1 : stop - 1] if begin else edges[: stop - 1]]
            np.copyto(node if begin else node[1:], led, where=led >= 0)
        low = lattices.first[node]
        number = lattices.first[node + 1] - low
        other = _places(low, number)
        leave = other != np.repeat(taken, number)
        return np.repeat(np.arange(begin, stop), number)[leave], np.repeat(node, number)[leave], other[leave]

    def push(self, value: float, path: int, at: int, edge: int) -> None:
        heapq.heappush(self.heap, (-value, path, at, edge))

    def best(self) -> tuple | None:
        """The best waiting node (value, path, at, edge), opening joint nodes on the way."""
        while self.heap and self.heap[0][3] < 0:
            value, path, at, _ = heapq.heappop(self.heap)
            self.open_joint(path, at, -value)
        return self.heap[0] if self.heap else None

    def open_joint(self, path: int, begin: int, value: float) -> None:
        """Split a joint node: its largest member keeps the value, the others are truncated at it."""
        edges, _, _, _, prefix = self.paths[path]
        place, _, other = self._leaving(path, begin, len(edges))
        if not len(other):
            return
        mass = prefix[place] + self.lattices.logp[other]
        share = np.cumsum(np.exp(mass - mass.max()))
        chosen = int(np.searchsorted(share, self.noise() * share[-1]))
        for i, (m, at, edge) in enumerate(zip(mass.tolist(), place.tolist(), other.tolist(), strict=True)):
            self.push(value if i == chosen else truncated_gumbel(m, value, self.noise()), path, at, edge)


def open_paths(lattices: Lattices, searches: list[_Search], begins: list[int]) -> None:
    """Nodes for the edges that leave the last path of each search at ``begins`` or later, for all searches together.

    Of a path's, no more than the best ``k`` can be taken, so only they wait.
    """
    paths = [x.paths[-1] for x in searches]
    stops = [min(int((-p[4]).searchsorted(WINDOW - p[4][b], "right")), len(p[0])) for p, b in zip(paths, begins, strict=True)]
    begin, size = np.array(begins), np.array(stops) - np.array(begins)
    cut = [slice(b, e) for b, e in zip(begins, stops, strict=True)]
    of, start = np.repeat(np.arange(len(paths)), size), np.cumsum(size) - size
    taken = np.concatenate([p[0][c] for p, c in zip(paths, cut, strict=True)])
    node = np.concatenate([x.starts[p[1][c]] for x, p, c in zip(searches, paths, cut, strict=True)])
    ahead = np.concatenate([p[4][c] for p, c in zip(paths, cut, strict=True)])
    # An edge leaves from where the one before it led, or from the start of its word.
    before = np.append(-1, taken[:-1])
    before[start[size > 0]] = np.array([p[0][b - 1] if b else -1 for p, b in zip(paths, begins, strict=True)], np.int64)[size > 0]
    led = np.where(before >= 0, lattices.target[before], -1)
    node = np.where(led >= 0, led, node)
    low = lattices.first[node]
    number = lattices.first[node + 1] - low
    other = _places(low, number)
    leave = np.flatnonzero(other != np.repeat(taken, number))
    other, place = other[leave], np.repeat(np.arange(len(node)), number)[leave]
    mass, of = ahead[place] + lattices.logp[other], of[place]
    at = begin[of] + place - start[of]
    many = np.bincount(of, minlength=len(paths))
    for i in np.flatnonzero(many).tolist():
        searches[i].drawn += 1
    state = absorb(absorb(np.array([x.key for x in searches], np.uint64), 1 << 32), np.array([x.drawn for x in searches]))
    from_ = np.cumsum(many) - many
    u = unit(absorb(state[of], np.arange(len(of)) - from_[of]))
    value = mass - np.log(np.exp(np.minimum(mass - np.array([p[3] for p in paths])[of], 700)) - np.log(u))
    order = np.lexsort((-value, of))
    k = np.array([x.k for x in searches])
    order = order[np.arange(len(order)) - from_[of[order]] < k[of[order]]]
    for i, v, a, e in zip(of[order].tolist(), value[order].tolist(), at[order].tolist(), other[order].tolist(), strict=True):
        searches[i].push(v, len(searches[i].paths) - 1, a, e)
    # The mass of what leaves a path further on, whole.
    for search, (edges, _, total, bound, prefix), stop in zip(searches, paths, stops, strict=True):
        rest = -math.expm1(min(total - prefix[stop], 0.0)) if stop < len(edges) else 0.0
        if rest > 0:
            search.push(truncated_gumbel(float(prefix[stop]) + math.log(rest), bound, search.noise()), len(search.paths) - 1, stop, -1)


def sample(lattices: Lattices, texts: list[str | None], keys: list[int], k: int = K) -> list[list[tuple]]:
    """For each text its sampled segmentations (edges, log-probability, perturbed value, inclusion), best first.

    The searches of all texts go side by side, so that paths are drawn together.
    """
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    start = lattices.nodes([w for d in words for w in d])
    begin = np.cumsum(sizes) - sizes
    doc_of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(start)) - begin[doc_of]
    word_keys = np.array(keys, np.uint64)[doc_of]
    searches = [_Search(lattices, key, start[low : low + n], k) for key, low, n in zip(keys, begin.tolist(), sizes.tolist(), strict=True)]
    nodes = [None] * len(words)  # what each search draws next
    for i, search in enumerate(searches):
        if search.words:
            value = -math.log(-math.log(search.noise()))
            nodes[i] = (value, None, 0, None)
    for turn in range(k):
        own = np.fromiter((n is not None for n in nodes), bool, len(nodes))
        if not own.any():
            break
        ask = np.where(own[doc_of], start, -1)
        for i in np.flatnonzero(own).tolist():
            value, path, at, edge = nodes[i]
            if path is not None:
                word = int(searches[i].paths[path][1][at])
                ask[begin[i] : begin[i] + word] = -1
                ask[begin[i] + word] = lattices.target[edge]
        edges, number = _draw(lattices, word_keys, place, ask, turn)
        stops = np.concatenate([[0], np.cumsum(number)])
        owner = np.repeat(place, number)
        own = np.flatnonzero(own).tolist()
        for i in own:
            value, path, at, edge = nodes[i]
            low, high = stops[begin[i]], stops[begin[i] + sizes[i]]
            drawn, word = edges[low:high], owner[low:high]
            if path is not None:
                old, old_word = searches[i].paths[path][:2]
                drawn = np.concatenate([old[:at], [edge], drawn])
                word = np.concatenate([old_word[:at], [old_word[at]], word])
            searches[i].emit(drawn, word, value)
        open_paths(lattices, [searches[i] for i in own], [0 if nodes[i][1] is None else nodes[i][2] + 1 for i in own])
        for i in own:
            found = searches[i].best()
            if found is not None and turn + 1 < k:
                heapq.heappop(searches[i].heap)
            nodes[i] = None if found is None else (-found[0], *found[1:])
    out = []
    for search, node in zip(searches, nodes, strict=True):
        if not search.words:
            out.append([(np.zeros(0, np.int64), 0.0, 0.0, 1.0)])
            continue
        limit = -math.inf if node is None else node[0]
        score = [1.0 if limit == -math.inf else -math.expm1(-math.exp(min(p[2] - limit, 700))) for p in search.paths]
        out.append([(p[0], p[2], p[3], s) for p, s in zip(search.paths, score, strict=True)])
    return out


@lru_cache(maxsize=2)
def load(path: str, alpha: float = ALPHA) -> Lattices:
    return Lattices(path, alpha)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("string"), F.lit("segmentation")).alias("key"), F.col(text_col).alias("text"))


def _sampled(batches: Iterator[pa.RecordBatch], path: str, k: int, alpha: float) -> Iterator[list[tuple]]:
    """Lists of (doc_id, text, lattices, samples), a bounded number of characters at a time."""
    lattices = load(path, alpha)
    try:
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            for part in blocks(texts, BLOCK):
                own = slice(at, at + len(part))
                at += len(part)
                found = sample(lattices, part, [x & (2**64 - 1) for x in keys[own]], k)
                yield [(i, t or "", lattices, s) for i, t, s in zip(ids[own], part, found, strict=True)]
    finally:
        lattices.forget()  # a worker that waits for its next task holds no words


def sample_encodings(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, rank, log_prob, perturbed, inclusion, ids): up to k segmentations of each row, best first."""
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sampled(batches, model_path, k, alpha):
            out = [(i, r, p, g, s, lat.ids(e).astype(np.int32)) for i, _, lat, found in rows for r, (e, p, g, s) in enumerate(found, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "rank", "log_prob", "perturbed", "inclusion", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, rank int, log_prob double, perturbed double, inclusion double, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The input's columns and ``decoded``: the text of the ids."""

    at = encoded.columns.index(ids_col)
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = load(model_path)
        for batch in batches:
            texts = [None if x.as_py() is None else lattices.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, rank, n_tokens, ids_crc32, log_prob, inclusion, decoded): as ``sample_encodings``, with digests in place of ids.

    ids_crc32 is over little-endian unsigned 32-bit ids; decoded tells whether
    decoding the ids gives the text back.
    """
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sampled(batches, model_path, k, alpha):
            out = []
            for i, text, lat, found in rows:
                for r, (edges, p, _, s) in enumerate(found, 1):
                    ids = lat.ids(edges)
                    out.append((i, r, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), p, s, lat.raw(ids) == text.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "rank", "n_tokens", "ids_crc32", "log_prob", "inclusion", "decoded"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, rank int, n_tokens long, ids_crc32 long, log_prob double, inclusion double, decoded boolean")
