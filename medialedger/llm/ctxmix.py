"""Language-model scores by logistic context mixing, beside a unigram base score.

A token (a word, or the end of the text) is coded by a few bits, each predicted from several contexts:

* is it the token that followed the last two words when they stood together earlier in this text?
* is it the most frequent follower of the word before it, in the training texts?
* else it is drawn from the words of this text so far, by their counts, or from the whole vocabulary; which of the two is a bit
  that is never seen, so both ways are added up;
* in the vocabulary, is it frequent or rare? A known token then has its count's share. The share that is kept for new ones is the
  one that tokens seen once have; a new token is spelt, byte by byte, each byte along the bits of its Huffman path.

For each bit hashed contexts (the words before, what the text did so far, runs of right predictions, the last bytes, the word
so far ...) look up how often it was one and zero. Their log-odds are mixed by weights that a gate picks; the mixed probability
is refined by an adaptive map. Counts, weights and map are learnt online, in small steps, over all training tokens, in each
partition for itself; counts are then added up and weights averaged (for bytes, whose tables fill slowly, all is counted first). While learning, a token's own occurrence is taken out of
the counts of words and followers. All bits' probabilities together make a distribution over tokens.

What is known of words (counts, followers) is a table that grows with the corpus. Frequent words, a fixed number of bounded
length, are sent to the tasks; all others meet their rows in joins, by a hash. The contexts' tables have a fixed size.

Defined cases: a null text is empty and has the end as its only token; rows that repeat an id are scored each; a null id is
hashed as an empty text; with no training token all counts are 0 and scores stay finite.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, pieces, saved, table
from .langid import remainder

END = b""
#: Words that are sent to all tasks: how many, the longest, and how often they were seen at least.
FREQUENT, LONGEST, LEAST = 200_000, 64, 2
#: Tokens that a task counts before it passes them on, groups (as bits of the hash) in which words are dealt out, and bytes of
#: counts that are added up at once.
FLUSH, DEALT, HELD = 1_500_000, 12, 8_000_000
#: Cells of a context's table, for the bits of tokens and for those of bytes.
WORD_CELLS, BYTE_CELLS = 13, 18
MAP_STEPS = 24
#: Bits that are learnt from at once.
STEP = 20_000
SURE = 1e-5
#: How fast weights move, and the counts that split gates.
RATE, SEEN = 0.06, (0, 2, 8, 40, 300)
_M = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space, which separates words.
_WHITE = b"\t\n\x0b\x0c\r "


def hashes_of(tokens: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64 of binaries, signed."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(t, 42) for t in tokens]), ">i8").astype(np.int64)


def short(hashes: np.ndarray) -> np.ndarray:
    """Half of the hashes, by which a word is told from a follower."""
    return hashes.astype(np.int32)


def bytes_in(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls."""
    if not len(column):
        return []
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    whole = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes() if data else b""
    begin = ends[0]
    return [whole[a - begin : z - begin] for a, z in zip(ends, ends[1:], strict=False)]


def encoded(raw: list[bytes | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All tokens of the texts in a row, and how many each text has."""
    lower = b" ".join([*(t or b"" for t in raw), b""]).lower()
    buf = np.frombuffer(lower, np.uint8)
    inside = (buf - np.uint8(9) > 4) & (buf != 32)  # as unsigned, what is below 9 comes out large
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.r_[0, edge]
    last = np.cumsum([len(t or b"") + 1 for t in raw]) - 1
    size = np.diff(np.searchsorted(edge[::2], last), prepend=0) + 1
    length = np.zeros(size.sum(), np.int64)
    is_word = np.ones(len(length), bool)
    is_word[np.cumsum(size) - 1] = False
    length[is_word] = edge[1::2] - edge[::2]
    offsets = np.r_[0, np.cumsum(length)].astype(np.int32)
    letters = pa.py_buffer(lower.translate(None, _WHITE))
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), letters]).dictionary_encode(), size


def numbered(raw: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The numbers of all tokens of the texts, the tokens in the order of their numbers, and how many each text has."""
    found, size = encoded(raw)
    return np.asarray(found.indices).astype(np.int64), bytes_in(found.dictionary), size


def cells_of(contexts: list[np.ndarray], bits: int) -> np.ndarray:
    """The cell of each context's value, contexts x n; every context has a table of its own."""
    out = np.empty((len(contexts), len(contexts[0])), np.int64)
    for k, c in enumerate(contexts):
        h = c.astype(np.int64).view(np.uint64)
        h += np.uint64(k + 1)
        h *= _M
        h ^= h >> np.uint64(32)
        h *= _M
        h >>= np.uint64(64 - bits)
        np.add(h.view(np.int64), k << bits, out=out[k])
    return out


class Mix:
    """One kind of bit: its contexts' counts, mixing weights by gate, and the adaptive map.

    The gate that is asked for is split by how often one of the contexts, the one called `by`, was seen.
    """

    def __init__(self, contexts: int, bits: int, gates: int, by: int):
        gates *= len(SEEN) + 1
        self.contexts, self.gates, self.by = contexts, gates, by
        self.ones, self.zeros = (np.zeros(contexts << bits, np.float32) for _ in "10")
        self.weights = np.zeros((gates, contexts + 1))
        self.weights[:, :contexts] = 0.35
        self.squares = np.full_like(self.weights, 1e-3)
        # the map: sums of bits and their numbers, from a start that changes nothing
        grid = 1 / (1 + np.exp(-(np.arange(MAP_STEPS) / (MAP_STEPS - 1) * 16 - 8)))
        self.hits = np.full(gates * MAP_STEPS, 20.0)
        self.start = np.tile(grid, gates) * 20.0
        self.sums = self.start.copy()
        self.seen = 0.0

    def counts(self, cells: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ones and zeros of the cells; without the bits themselves if these are given."""
        ones, zeros = self.ones.take(cells), self.zeros.take(cells)
        if own is not None:
            own = own.astype(np.float32)
            ones, zeros = np.maximum(ones - own, 0), np.maximum(zeros - (1 - own), 0)
        return ones, zeros

    def gate(self, counts: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> np.ndarray:
        return asked * (len(SEEN) + 1) + np.searchsorted(SEEN, counts[0][self.by] + counts[1][self.by], "left")

    def inputs(self, counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        x = np.ones((self.contexts + 1, counts[0].shape[1]))
        x[:-1] = self.odds(*counts)
        return x

    def odds(self, ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        return np.clip(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))), -9, 9)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(x.shape[1])
        for k, w in enumerate(np.ascontiguousarray(self.weights.T)):
            z += x[k] * w.take(gate)
        return np.clip(z, -12, 12)

    def looked_up(self, cells: np.ndarray, asked: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gates); for many bits the log-odds of all cells are made first."""
        if own is not None or len(self.ones) > cells.size:
            counts = self.counts(cells, own)
            return self.inputs(counts), self.gate(counts, asked)
        own_cells = len(self.ones) // self.contexts
        by = slice(self.by * own_cells, (self.by + 1) * own_cells)
        seen = np.searchsorted(SEEN, self.ones[by] + self.zeros[by], "left")
        x = np.ones((self.contexts + 1, cells.shape[1]))
        x[:-1] = self.odds(self.ones, self.zeros).take(cells)
        return x, asked * (len(SEEN) + 1) + seen.take(cells[self.by] - by.start)

    def _place(self, z: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.clip(z, -8, 8) + 8) / 16 * (MAP_STEPS - 1)
        low = np.minimum(at.astype(np.int64), MAP_STEPS - 2)
        return gate * MAP_STEPS + low, at - low

    def probability(self, cells: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one."""
        x, gate = self.looked_up(cells, gate)
        z = self.mixed(x, gate)
        low, share = self._place(z, gate)
        known = self.sums / self.hits
        refined = known.take(low) * (1 - share) + known.take(low + 1) * share
        return np.clip((1 / (1 + np.exp(-z)) + refined) / 2, SURE, 1 - SURE)

    def count(self, cells: np.ndarray, bit: np.ndarray) -> None:
        """Bits, as integers, or the probabilities of hidden ones."""
        if bit.dtype.kind == "i":
            for counts, own in ((self.ones, bit == 1), (self.zeros, bit == 0)):
                np.add.at(counts, cells[:, own].ravel(), np.float32(1))
        elif len(self.ones) > cells.size:
            one = bit.astype(np.float32)
            for c in cells:
                np.add.at(self.ones, c, one)
                np.add.at(self.zeros, c, 1 - one)
        else:
            ones, all_ = np.bincount(cells.ravel(), np.tile(bit, len(cells)), len(self.ones)), np.bincount(cells.ravel(), minlength=len(self.ones))
            self.ones += ones.astype(np.float32)
            self.zeros += (all_ - ones).astype(np.float32)

    def learn(self, cells: np.ndarray, gate: np.ndarray, bit: np.ndarray, counted: bool = False, rate: float = RATE) -> None:
        """One step: bit is what was seen, or the probability with which a hidden one was a one. Where all bits are counted
        already, these are taken out, else they are counted after.
        """
        if not len(bit):
            return
        x, gate = self.looked_up(cells, gate, bit if counted else None)
        z = self.mixed(x, gate)
        low, share = self._place(z, gate)
        for at, s in ((low, 1 - share), (low + 1, share)):
            self.hits += np.bincount(at, s, len(self.hits))
            self.sums += np.bincount(at, s * bit, len(self.sums))
        error = bit - 1 / (1 + np.exp(-z))
        for k in range(len(x)):
            d = np.bincount(gate, error * x[k], self.gates) / len(bit)
            self.squares[:, k] += d * d
            self.weights[:, k] += rate * d / np.sqrt(self.squares[:, k])
        if not counted:
            self.count(cells, bit)
        self.seen += len(bit)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each slot, which add up over partitions."""
        n = np.full(self.weights.size, self.seen)
        return np.concatenate([self.ones, self.weights.ravel() * n, self.sums - self.start]), np.concatenate([self.zeros, n, self.hits - 20.0])

    def take(self, a: np.ndarray, b: np.ndarray) -> None:
        m, w = len(self.ones), self.weights.size
        self.ones, self.zeros = a[:m].astype(np.float32), b[:m].astype(np.float32)
        if b[m] > 0:
            self.weights = (a[m : m + w] / b[m : m + w]).reshape(self.weights.shape)
        self.sums, self.hits = self.start + a[m + w :], 20.0 + b[m + w :]


#: Bits of a token: repeats the text, follows the word, is drawn from the text, is rare. Contexts and gates of each.
REPEATS, FOLLOWS, DRAWN, RARE = range(4)
GATES, BY = (8, 16, 8, 8), (3, 1, 1, 2)


def new_mixes() -> list[Mix]:
    return [Mix(4, WORD_CELLS, g, by) for g, by in zip(GATES, BY, strict=True)]


def tokens_of(t: bytes | None) -> list[bytes]:
    return [*(t or b"").lower().split(), END]


class Words:
    """The frequent words: count, follower (its hash) and the follower's count, for each."""

    def __init__(self, rows: list[tuple[bytes, int, int | None, int | None]], total: int, once: int, twice: int):
        self.tokens = pa.array([r[0] for r in rows], pa.binary())
        hashes = hashes_of([r[0] for r in rows])
        self.order = np.argsort(hashes)
        self.ranked = hashes[self.order]
        self.count = np.array([r[1] for r in rows], np.int64)
        self.follower = np.array([r[2] or 0 for r in rows], np.int32)
        self.follows = np.array([r[3] or 0 for r in rows], np.int64)
        self.frequent = int(self.count.sum())
        # new tokens have the share of those seen once; seen once counts less than once, other rare ones half less
        self.new = max(1, once)
        self.once = min(0.9, max(0.05, 2 * twice / once)) if once else 0.5
        rare_kinds = total - self.frequent - once
        self.rare = self.new + self.once * once + max(0, rare_kinds)

    @cached_property
    def where(self) -> dict[bytes, int]:
        """The place of each word."""
        return {t: i for i, t in enumerate(bytes_in(self.tokens))}

    def places(self, tokens: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The places of tokens with these hashes, -1 for others; the tokens are compared themselves, too."""
        if not len(self.order) or not len(hashes):
            return np.full(len(hashes), -1)
        by_hash = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[by_hash] = np.searchsorted(self.ranked, hashes[by_hash])
        at = np.minimum(at, len(self.order) - 1)
        found = self.order[at]
        found[self.ranked[at] != hashes] = -1
        known = np.flatnonzero(found >= 0)
        same = pc.equal(tokens.take(pa.array(known)), self.tokens.take(pa.array(found[known])))
        found[known[~np.asarray(same)]] = -1
        return found


def _past(flag: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The flag k places earlier in the same text."""
    out = np.zeros(len(flag), np.int64)
    out[k:] = flag[:-k]
    return np.where(at >= k, out, 0)


def _share_before(flag: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    """Levels of the share of the flag among the places before, in the same text."""
    before = np.cumsum(flag) - flag
    before = before - before[np.arange(len(flag)) - at]
    return np.minimum(levels - 1, before * levels // np.maximum(1, at))


def _log(x: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(x, 1)).astype(np.int64)


def in_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places by key, equal keys in their order; whether a place is the first of its key)."""
    n = len(key)
    if n and int(key.max()) < (1 << 62) // n and int(key.min()) >= -1:
        both = np.sort((key + 1) * n + np.arange(n))
        key, order = np.divmod(both, n)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return order, np.r_[np.ones(min(n, 1), bool), key[1:] != key[:-1]]


class Places:
    """All tokens of a batch of texts in a row, with what precedes them in their text."""

    def __init__(self, raw: list[bytes | None], known: Words, own: int = 0):
        """own: 1 while learning, when a token's own occurrence does not count."""
        tokens, self.size = encoded(raw)
        ids, types = np.asarray(tokens.indices).astype(np.int64), tokens.dictionary
        hashes = hashes_of(bytes_in(types))
        frequent = known.places(types, hashes)
        if own and len(known.count):
            frequent[(frequent >= 0) & (known.count[frequent] - own < LEAST)] = -1
        n, v = len(ids), len(types)
        self.doc = np.repeat(np.arange(len(raw)), self.size)
        self.at = at = np.arange(n) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        one, two = (np.where(at >= k, np.r_[np.zeros(k, np.int64), ids[:-k]][:n], -1) for k in (1, 2))
        self.hash, self.frequent = hashes[ids], frequent[ids]
        self.word1, self.word2 = (np.where(x >= 0, hashes[x], 0) for x in (one, two))
        self.frequent1 = np.where(one >= 0, frequent[one], -1)
        # how often the token stands earlier in its text
        order, new = in_order(self.doc * v + ids)
        first = np.flatnonzero(new)
        earlier, kind = np.empty(n, np.int64), np.empty(n, np.int64)
        kind[order] = np.cumsum(new) - 1
        earlier[order] = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        self.cache = earlier / np.maximum(1, at)
        # the token after the same two words, earlier in the text
        key = np.zeros(n, np.int64)
        key[2:] = kind[:-2] * v + ids[1:-1]
        order, new = in_order(np.where(at >= 2, key, -1))
        before = np.full(n, -1)
        before[order[1:]] = np.where(new[1:], -1, order[:-1])
        before[at < 2] = -1
        self.repeats = before >= 0
        self.again = self.repeats & (ids[before] == ids)
        self.expected = np.where(self.repeats, self.hash[before], 0)
        self.short, self.not_again = short(self.hash), short(self.expected)
        last = np.maximum.accumulate(np.where(self.again, -1, np.arange(n)))
        self.run = np.where(at >= 1, np.arange(n) - 1 - np.r_[0, last[:-1]], 0)
        self.apart = np.where(self.repeats, np.arange(n) - before, 0)
        self.is_rare = (self.frequent < 0).astype(np.int64)
        self.seen = (earlier > 0).astype(np.int64)

    def repeat_bit(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, cells, gates) of the first bit."""
        i = np.flatnonzero(self.repeats)
        run = np.minimum(self.run[i], 15)
        return i, cells_of([run, _log(self.apart[i]) * 4 + np.minimum(run, 3), self.expected[i], self.word1[i]], WORD_CELLS), np.minimum(run, 7)

    def drawn_bit(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, seen, rare = self.at, self.seen, self.is_rare
        past = _past(seen, at, 1) * 4 + _past(seen, at, 2) * 2 + _past(seen, at, 3)
        share = _share_before(seen, at, 8)
        log, past, share = _log(at[i]), past[i], share[i]
        cells = cells_of([log * 4 + past // 2, self.word1[i], past * 4 + (_past(rare, at, 1) * 2 + _past(rare, at, 2))[i], log * 8 + share], WORD_CELLS)
        return cells, share

    def rare_bit(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, rare = self.at, self.is_rare
        past = _past(rare, at, 1) * 8 + _past(rare, at, 2) * 4 + _past(rare, at, 3) * 2 + _past(rare, at, 4)
        share = _share_before(rare, at, 16)
        past, share, word1 = past[i], share[i], self.word1[i]
        return cells_of([past, word1, word1 * 3 + self.word2[i], share * 2 + past // 8], WORD_CELLS), share // 2


def follow_bit(word1: np.ndarray, follower: np.ndarray, follows: np.ndarray, count: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, gates): whether a word's follower follows it; its share of the word's count is the gate."""
    share = np.minimum(15, 16 * follows // np.maximum(1, count))
    return cells_of([share * 16 + np.minimum(15, _log(follows)), word1, follower, share * 8 + state], WORD_CELLS), share


def steps(n: int) -> Iterator[slice]:
    for a in range(0, n, STEP):
        yield slice(a, a + STEP)


def learn_words(raw: list[bytes | None], known: Words, mixes: list[Mix]) -> None:
    """A step over a batch of training texts, each token without its own occurrence."""
    p = Places(raw, known, own=1)
    i, cells, gate = p.repeat_bit()
    for s in steps(len(i)):
        mixes[REPEATS].learn(cells[:, s], gate[s], p.again[i[s]].astype(float))
    left = ~p.again
    f = p.frequent1
    has = left & (f >= 0)
    if len(known.count):
        follower = known.follower.take(f)  # of any word where has is not set
        hit = has & (follower == p.short)
        follows = np.where(has, known.follows.take(f), 0) - hit
        i = np.flatnonzero(has & (follows > 0) & (follower != p.not_again))
        state = np.where(p.repeats[i], np.minimum(p.run[i] + 1, 7), 0)
        cells, gate = follow_bit(p.word1[i], follower[i], follows[i], known.count[f[i]] - 1, state)
        for s in steps(len(i)):
            mixes[FOLLOWS].learn(cells[:, s], gate[s], hit[i[s]].astype(float))
        left[i[hit[i]]] = False
    i = np.flatnonzero(left)
    cells, gate = p.rare_bit(i)
    for s in steps(len(i)):
        mixes[RARE].learn(cells[:, s], gate[s], p.is_rare[i[s]].astype(float))
    rare = mixes[RARE].probability(cells, gate)
    counts = known.count[p.frequent[i]] - 1 if len(known.count) else np.zeros(len(i))
    rest = np.where(p.is_rare[i] == 1, rare * known.once / known.rare, (1 - rare) * counts / max(1, known.frequent))
    far = p.at[i] > 0
    i, rest = i[far], rest[far]
    cells, gate = p.drawn_bit(i)
    for s in steps(len(i)):
        drawn = mixes[DRAWN].probability(cells[:, s], gate[s])
        own, other = drawn * p.cache[i[s]], (1 - drawn) * rest[s]
        mixes[DRAWN].learn(cells[:, s], gate[s], own / np.maximum(own + other, 1e-300))


@dataclass
class Codes:
    """The Huffman paths of all byte values, padded: nodes, bits, lengths."""

    nodes: np.ndarray
    bits: np.ndarray
    length: np.ndarray


def huffman(freq: np.ndarray) -> Codes:
    heap = [(float(f), s) for s, f in enumerate(freq)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    node = len(freq)
    while len(heap) > 1:
        (fa, a), (fb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (node, 0), (node, 1)
        heapq.heappush(heap, (fa + fb, node))
        node += 1
    paths = []
    for s in range(len(freq)):
        path = []
        while s in parent:
            s, bit = parent[s]
            path.append((s, bit))
        paths.append(path[::-1])
    deepest = max(map(len, paths))
    nodes, bits = np.zeros((len(freq), deepest), np.int64), np.zeros((len(freq), deepest), np.int8)
    for s, path in enumerate(paths):
        for k, (n, bit) in enumerate(path):
            nodes[s, k], bits[s, k] = n, bit
    return Codes(nodes, bits, np.array(list(map(len, paths))))


def byte_bits(tokens: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, cells, gate, bit) of each bit of all tokens, a closing blank after each."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    buf = np.frombuffer(b" ".join([*tokens, b""]), np.uint8)
    start = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(buf)) - start
    b = buf.astype(np.int64) + 1
    last = [np.where(at >= k, np.r_[np.zeros(k, np.int64), b[:-k]][: len(b)], 0) for k in (1, 2, 3, 4)]
    power = np.cumprod(np.full(int(size.max(initial=1)) + 1, 0x100000001B3, np.uint64))
    run = np.r_[np.uint64(0), np.cumsum(b.astype(np.uint64) * power[at], dtype=np.uint64)]
    so_far = (run[:-1] - run[start]).view(np.int64)
    n = codes.length[buf]
    which = np.repeat(np.arange(len(buf)), n)
    step = (buf.astype(np.int64) * codes.nodes.shape[1] - np.cumsum(n) + n).take(which) + np.arange(len(which))
    node, bit = codes.nodes.ravel().take(step), codes.bits.ravel().take(step)
    place = np.minimum(at, 7)
    l1, l2, l3, l4 = last
    two = l1 * 257 + l2
    three = two * 257 + l3
    contexts = [x.take(which) + node for x in (place * 512, l1 * 512, two * 512, three * 512, (three * 257 + l4) * 512, so_far * 31)]
    return np.repeat(np.arange(len(tokens)), size).take(which), cells_of(contexts, BYTE_CELLS), place.take(which), bit


def new_spelling() -> Mix:
    return Mix(6, BYTE_CELLS, 8, 2)


def spelt(tokens: list[bytes], codes: Codes, mix: Mix) -> np.ndarray:
    """log10 probability of the spelling of each token."""
    out = np.zeros(len(tokens))
    for a, z in pieces(map(len, tokens), 50_000):
        owner, cells, gate, bit = byte_bits(tokens[a:z], codes)
        p = mix.probability(cells, gate)
        out[a:z] = np.bincount(owner, np.log10(np.where(bit == 1, p, 1 - p)), z - a)
    return out


def dealt(tokens: pa.Array, c: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """Counts of tokens and of all their followers, as one row for each group of words: pairs has, for each place in a training
    text but its end, the token's number and that of the next (as its low 32 bits).
    """
    pairs = np.sort(pairs)
    first = np.flatnonzero(np.r_[np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1]])
    k = np.diff(np.r_[first, len(pairs)])
    word, follower = pairs[first] >> 32, pairs[first] & 0xFFFFFFFF
    h = hashes_of(bytes_in(tokens))
    group = (h.view(np.uint64) >> np.uint64(64 - DEALT)).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    n = np.bincount(word, minlength=len(tokens))
    begin = np.cumsum(n) - n
    n = n[order]
    ends = np.cumsum(n)
    own = np.repeat(begin[order] - (ends - n), n) + np.arange(len(k))  # the pairs in the order of their words
    size = pc.binary_length(tokens).to_numpy()[order]
    cut = np.r_[np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]), len(tokens)]
    at_pair, at_byte = np.r_[0, ends][cut], np.r_[0, np.cumsum(size)][cut]

    def cells(x: np.ndarray, kind: str, at: np.ndarray) -> pa.Array:
        data = x.astype(kind)
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * data.itemsize).astype(np.int32)), pa.py_buffer(data)])

    spelling = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(at_byte.astype(np.int32)), tokens.take(pa.array(order)).buffers()[2]])
    words = [cells(x, kind, cut) for x, kind in ((h[order], "<i8"), (c[order], "<i4"), (size, "<i4"), (n, "<i4"))]
    follows = [cells(x[own], "<i4", at_pair) for x in (short(h)[follower], k)]
    return pa.RecordBatch.from_arrays([pa.array(group[order][cut[:-1]].astype(np.int32)), *words, spelling, *follows], ["part", "h", "c", "size", "n", "token", "g", "k"])


@dataclass
class Counted:
    """Tokens by their hash (as unsigned), and pairs of a token's place here and a follower, with their counts."""

    h: np.ndarray
    c: np.ndarray
    token: pa.Array
    word: np.ndarray
    g: np.ndarray
    k: np.ndarray

    @staticmethod
    def read(batch: pa.RecordBatch) -> Counted:
        h, c, size, n, g, k = (np.frombuffer(b"".join(bytes_in(batch.column(x))), kind) for x, kind in (("h", "<u8"), ("c", "<i4"), ("size", "<i4"), ("n", "<i4"), ("g", "<i4"), ("k", "<i4")))
        ends = pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32))
        token = pa.Array.from_buffers(pa.binary(), len(h), [None, ends, pa.py_buffer(b"".join(bytes_in(batch.column("token"))))])
        return Counted(h, c.astype(np.int64), token, np.repeat(np.arange(len(h)), n), g.astype(np.int64), k.astype(np.int64))

    def with_(self, other: Counted) -> Counted:
        h, word = np.r_[self.h, other.h], np.r_[self.word, other.word + len(self.h)]
        order = np.argsort(h)
        ranked = h[order]
        new = np.r_[np.ones(min(len(h), 1), bool), ranked[1:] != ranked[:-1]]
        first = np.flatnonzero(new)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        c = np.add.reduceat(np.r_[self.c, other.c][order], first)
        token = pa.concat_arrays([self.token, other.token]).take(pa.array(order[first]))
        pair = (place[word] << 32) + np.r_[self.g, other.g] + (1 << 31)
        order = np.argsort(pair)
        pair = pair[order]
        start = np.flatnonzero(np.r_[np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1]])
        k = np.add.reduceat(np.r_[self.k, other.k][order], start) if len(start) else np.zeros(0, np.int64)
        pair = pair[start]
        return Counted(ranked[first], c, token, pair >> 32, (pair & 0xFFFFFFFF) - (1 << 31), k)

    def cut(self, words: int) -> tuple[Counted, Counted]:
        """The first so many words, and the others."""
        p = int(np.searchsorted(self.word, words))
        return (
            Counted(self.h[:words], self.c[:words], self.token.slice(0, words), self.word[:p], self.g[:p], self.k[:p]),
            Counted(self.h[words:], self.c[words:], self.token.slice(words), self.word[p:] - words, self.g[p:], self.k[p:]),
        )

    def best(self) -> pa.RecordBatch:
        """Each token with its most frequent follower; of several the one with the largest hash."""
        g, k = (np.zeros(len(self.h), np.int64) for _ in "gk")
        start = np.flatnonzero(np.r_[np.ones(min(len(self.word), 1), bool), self.word[1:] != self.word[:-1]])
        if len(start):
            k[self.word[start]] = np.maximum.reduceat(self.k, start)
            most = np.flatnonzero(self.k == k[self.word])
            most = most[np.r_[self.word[most][1:] != self.word[most][:-1], True]]  # followers ascend, so the last one
            g[self.word[most]] = self.g[most]
        columns = [self.token, pa.array(self.h.view(np.int64)), pa.array(self.c), pa.array(g.astype(np.int32), mask=k == 0), pa.array(k)]
        return pa.RecordBatch.from_arrays(columns, ["token", "h", "c", "g", "k"])


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token counts of a partition of `dealt` rows that is sorted by part. What is held are the distinct pairs of one part."""
    held = Counted.read(pa.RecordBatch.from_pydict({x: pa.array([], pa.binary()) for x in ("h", "c", "size", "n", "token", "g", "k")}))
    for batch in batches:
        size = sum(pc.binary_length(batch.column(x)).to_numpy(zero_copy_only=False) for x in ("h", "token", "g", "k"))
        for a, z in pieces(size.tolist(), HELD):
            held = held.with_(Counted.read(batch.slice(a, z - a)))
            last = np.uint64(batch.column("part")[z - 1].as_py()) << np.uint64(64 - DEALT)
            done, held = held.cut(int(np.searchsorted(held.h, last)))
            if len(done.h):
                yield done.best()
    if len(held.h):
        yield held.best()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, h, c, g, k): hash, occurrences in training texts, half of the hash of the most frequent follower, its count.

    Tokens that only other texts have are there with a count of 0. All followers of a word are counted, wherever they stand; of
    followers that are equally frequent the one with the largest half hash is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            found = pa.chunked_array(held).unify_dictionaries()
            ids = np.concatenate([np.asarray(x.indices) for x in found.chunks])
            train = np.concatenate(trained)
            c = np.bincount(ids[train], minlength=len(found.chunk(0).dictionary))
            train[np.cumsum(np.concatenate(sizes)) - 1] = False  # nothing follows the end
            at = np.flatnonzero(train)
            return dealt(found.chunk(0).dictionary, c, (ids[at].astype(np.int64) << 32) + ids[at + 1])

        held, trained, sizes, size = [], [], [], 0
        for batch, raw in byte_batches(batches):
            tokens, each = encoded(raw)
            held.append(tokens)
            trained.append(np.repeat(~np.asarray(batch.column("held_out")), each))
            sizes.append(each)
            size += len(tokens)
            if size > FLUSH:
                yield rows()
                held, trained, sizes, size = [], [], [], 0
        if size:
            yield rows()

    found = docs.select("text", "held_out").mapInArrow(run, "part int, h binary, c binary, size binary, n binary, token binary, g binary, k binary")
    return found.repartition("part").sortWithinPartitions("part").mapInArrow(added_up, "token binary, h long, c long, g int, k long")


def frequent(counts: DataFrame) -> list[tuple[bytes, int, int | None, int | None]]:
    """(token, count, follower, follower's count) of the most frequent words of bounded length, at most FREQUENT of them.

    A histogram of rounded logarithms of the counts gives the least count that keeps within the limit, so nothing is sorted.
    """
    short = counts.where((F.col("c") >= LEAST) & (F.length("token") <= LONGEST)).withColumn("_bin", F.floor(F.log2("c") * 8).cast("int"))
    bins = sorted(((r["_bin"], r["n"]) for r in short.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for b, n in bins:
        total += n
        if total > FREQUENT:
            break
        least = b
    if least is None:
        return []
    rows = short.where(F.col("_bin") >= least).select("token", "c", "g", "k").toArrow()
    return sorted(zip(*(rows.column(x).to_pylist() for x in ("token", "c", "g", "k")), strict=True), key=lambda x: (-x[1], x[0]))


def _gathered(rows: DataFrame, mixes: list[Mix]) -> None:
    """Adds up what partitions learnt, slot by slot; a fixed number of sums reaches the driver."""
    got = rows.groupBy("slot").agg(F.sum("a").cast("float").alias("a"), F.sum("b").cast("float").alias("b")).toArrow()
    slot = np.asarray(got.column("slot"))
    begin = 0
    for m in mixes:
        n = len(m.parts()[0])
        a, b = np.zeros(n), np.zeros(n)
        own = (slot >= begin) & (slot < begin + n)
        a[slot[own] - begin], b[slot[own] - begin] = np.asarray(got.column("a"))[own], np.asarray(got.column("b"))[own]
        m.take(a, b)
        begin += n


def _slots(mixes: list[Mix]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*(m.parts() for m in mixes), strict=True))
    at = np.flatnonzero((a != 0) | (b != 0))
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(a[at].astype(np.float32)), pa.array(b[at].astype(np.float32))], ["slot", "a", "b"])


SLOTS = "slot int, a float, b float"


def train_words(docs: DataFrame, known) -> list[Mix]:
    """The bits of tokens, learnt from all training texts; known is a broadcast of Words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixes = new_mixes()
        for _, raw in byte_batches(batches):
            learn_words(raw, known.value, mixes)
        yield _slots(mixes)

    out = new_mixes()
    _gathered(docs.where("not held_out").select("text").mapInArrow(run, SLOTS), out)
    return out


def train_bytes(counts: DataFrame) -> tuple[Codes, Mix]:
    """The bits of bytes, learnt from all words that training texts have once: new ones are like them."""

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            buf = np.frombuffer(b"".join(t + b" " for t in bytes_in(batch.column("token"))), np.uint8)
            total += np.bincount(buf, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total.astype(np.float32)), pa.array(total.astype(np.float32))], ["slot", "a", "b"])

    once = counts.where("c = 1").select("token")
    freq = np.full(256, 1e-3)
    for r in once.mapInArrow(bytes_of, SLOTS).groupBy("slot").agg(F.sum("a").alias("a")).collect():
        freq[r["slot"]] += r["a"]
    codes = huffman(freq)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            tokens = bytes_in(batch.column("token"))
            for a, z in pieces(map(len, tokens), 4000):
                yield byte_bits(tokens[a:z], codes)[1:]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = new_spelling()
        for cells, _, bit in bits(batches):
            mix.count(cells, bit)
        yield _slots([mix])

    mix = new_spelling()
    _gathered(once.mapInArrow(counted, SLOTS), [mix])
    both = counts.sparkSession.sparkContext.broadcast((mix.ones, mix.zeros))

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = new_spelling()
        mix.ones, mix.zeros = both.value
        for cells, gate, bit in bits(batches):
            mix.learn(cells, gate, bit.astype(float), counted=True)
        mix.ones, mix.zeros = np.zeros_like(mix.ones), np.zeros_like(mix.zeros)
        yield _slots([mix])

    _gathered(once.mapInArrow(learnt, SLOTS), [mix])
    mix.ones, mix.zeros = both.value
    return codes, mix


#: What a place is sent with: a frequent word after a rare one, a rare word, a rare word after a rare one. `a` and `b` are the
#: probability of drawing it from its text, and of its being rare.
NEEDS = {
    "after": "hp long, hw int, m int, state byte, pre float, other float",
    "itself": "hw long, a float, b float",
    "both": "hp long, hw long, m int, state byte, pre float, a float, b float",
}
KINDS = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "float": pa.float32()}


def scored_places(raw: list[bytes | None], known: Words, mixes: list[Mix], floor: float) -> tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, dict[str, np.ndarray]]]]:
    """(sums for each text of what can be told here, the texts and contents of the places that must look up a rare word)."""
    p = Places(raw, known)
    n = len(p.hash)
    pre, done = np.zeros(n), p.again.copy()
    i, cells, gate = p.repeat_bit()
    odds = mixes[REPEATS].probability(cells, gate)
    pre[i] = np.log10(np.where(p.again[i], odds, 1 - odds))
    state = np.where(p.repeats, np.minimum(p.run + 1, 7), 0)
    f = p.frequent1
    if len(known.count):
        i = np.flatnonzero(~done & (f >= 0))
        i = i[(known.follows[f[i]] > 0) & (known.follower[f[i]] != p.not_again[i])]
        follower = known.follower[f[i]]
        cells, gate = follow_bit(p.word1[i], follower, known.follows[f[i]], known.count[f[i]], state[i])
        odds = mixes[FOLLOWS].probability(cells, gate)
        hit = follower == p.short[i]
        pre[i] += np.log10(np.where(hit, odds, 1 - odds))
        done[i[hit]] = True
    rest, drawn = np.zeros(n), np.zeros(n)
    i = np.flatnonzero(~done)
    rare = mixes[RARE].probability(*p.rare_bit(i))
    counts = known.count[p.frequent[i]] if len(known.count) else np.zeros(len(i))
    rest[i] = np.where(p.is_rare[i] == 1, rare, (1 - rare) * counts / max(1, known.frequent))
    i = i[p.at[i] > 0]
    drawn[i] = mixes[DRAWN].probability(*p.drawn_bit(i))
    is_known = p.is_rare == 0
    after_rare = ~done & (p.at > 0) & (f < 0)
    a, b = drawn * p.cache, (1 - drawn) * rest
    here = np.where(done & is_known, pre, 0.0)
    i = np.flatnonzero(~done & is_known & ~after_rare)
    here[i] = pre[i] + np.log10(a[i] + b[i])
    count = np.where(is_known, known.count[p.frequent] if len(known.count) else 0, 0)
    per = lambda x: np.bincount(p.doc, x, len(raw))
    sums = {
        "n_tokens": p.size,
        "n_known": per(is_known).astype(np.int64),
        "base_score": per(np.where(is_known, np.log10(count + 1) - floor, 0.0)),
        "score": per(here),
    }
    own = {"hp": p.word1, "m": p.not_again, "state": state, "pre": pre}
    after, itself, both = (np.flatnonzero(x) for x in (after_rare & is_known, ~is_known & ~after_rare, ~is_known & after_rare))
    odds = 10.0**pre[itself]
    needs = {
        "after": (after, own | {"hw": p.short, "other": np.zeros(n)}),
        "itself": (itself, {"hw": p.hash, "a": a.copy(), "b": b.copy()}),
        "both": (both, own | {"hw": p.hash, "a": a, "b": b}),
    }
    needs["after"][1]["other"][after] = np.log10(np.maximum(a[after] + b[after], 1e-300))
    x = needs["itself"][1]
    x["a"][itself], x["b"][itself] = odds * np.where(done[itself], 1.0, a[itself]), odds * np.where(done[itself], 0.0, b[itself])
    return sums, {k: (p.doc[i], {c: v[i] for c, v in x.items()}) for k, (i, x) in needs.items()}


def after_rare_words(known, mixes):
    """(uid, known, base, score) of places after a rare word that was looked up: pc, g, k are its count, follower and that one's
    count; pre is what the first bit said, other the score without the follower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow = mixes.value[FOLLOWS]
        for batch in batches:
            pc, g, k = (np.asarray(batch.column(c).fill_null(0)) for c in ("pc", "g", "k"))
            hp, hw, m, state, pre, other = (np.asarray(batch.column(c)) for c in ("hp", "hw", "m", "state", "pre", "other"))
            score = pre.astype(float) + other
            i = np.flatnonzero((k > 0) & (g != m))
            cells, gate = follow_bit(hp[i], g[i], k[i], pc[i], state[i].astype(np.int64))
            odds = follow.probability(cells, gate)
            score[i] = pre[i] + np.where(g[i] == short(hw[i]), np.log10(odds), np.log10(1 - odds) + other[i])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("known"), batch.column("base"), pa.array(score)], ["uid", "known", "base", "score"])

    return run


@dataclass
class Model:
    """All that is sent to the tasks."""

    known: Words
    mixes: list[Mix]
    codes: Codes
    spelling: Mix
    tokens: int
    floor: float  # of the base score


def trained(docs: DataFrame, counts: DataFrame) -> Model:
    """From docs (text, held_out) and their token_counts."""
    n, v, once, twice = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    known = Words(frequent(counts), n, once, twice)
    codes, spelling = train_bytes(counts)
    mixes = train_words(docs, docs.sparkSession.sparkContext.broadcast(known))
    return Model(known, mixes, codes, spelling, n, math.log10(n + v + 1))


def scored(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of docs."""
    context = docs.sparkSession.sparkContext
    own = docs.select(F.col("doc_id"), F.col("text").cast("string"), (remainder(F.col("doc_id"), mod) == rest).alias("held_out"))
    counts = saved(token_counts(own), "token-counts")
    model = trained(own, counts)
    known, mixes, floor = context.broadcast(model.known), context.broadcast(model.mixes), model.floor
    letters = context.broadcast((model.codes, model.spelling))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = spelt(bytes_in(batch.column("token")), *letters.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "c", "g", "k")), pa.array(got.astype(np.float32))], ["h", "c", "g", "k", "spelling"])

    new = counts.where("c = 0").select("token", "h", "c", "g", "k").mapInArrow(spell, "h long, c long, g int, k long, spelling float")
    words = saved(new.unionByName(counts.where("c > 0").select("h", "c", "g", "k", F.lit(None).cast("float").alias("spelling"))), "words")

    fields = {kind: dict(f.split() for f in text.split(", ")) for kind, text in NEEDS.items()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in byte_batches(batches):
            sums, needs = scored_places(raw, known.value, mixes.value, floor)
            columns = {"n_bytes": pa.array([len(t or b"") for t in raw], pa.int64()), **{c: pa.array(x) for c, x in sums.items()}}
            for kind, (doc, values) in needs.items():
                ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(raw)))]
                parts = [pa.array(values[c].astype(KINDS[t].to_pandas_dtype())) for c, t in fields[kind].items()]
                columns[kind] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, list(fields[kind])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns.values()], ["doc_id", "held_out", *columns])

    kind = own.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{k} array<struct<{', '.join(f'{c}: {t}' for c, t in f.items())}>>" for k, f in fields.items())
    texts = own.mapInArrow(split, f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, {lists}")
    texts = saved(texts.withColumn("uid", F.monotonically_increasing_id()), "texts")

    places = lambda k: texts.select("uid", F.explode(k).alias("x")).select("uid", "x.*")
    before = words.select(F.col("h").alias("hp"), F.col("c").alias("pc"), "g", "k")
    itself = words.select(F.col("h").alias("hw"), "c", "spelling")
    # what a looked-up word's count or spelling makes of its place; a spelling may be too small for a power of ten
    w, c = model.known, F.col("c")
    share = F.when(c == 1, w.once).when(c > 1, c - 0.5) / F.lit(float(w.rare))
    new = math.log10(w.new / w.rare) + F.col("spelling").cast("double")
    both = F.col("a").cast("double") + F.col("b").cast("double") * F.coalesce(share, F.pow(F.lit(10.0), F.greatest(new, F.lit(-300.0))))
    score = F.when(both > 1e-250, F.log10(both)).otherwise(F.log10(F.col("b").cast("double")) + new)
    itself_known = {"known": (c > 0).cast("long"), "base": F.log10(c + 1.0) - floor, "other": score}
    alone = places("itself").join(itself, "hw").withColumns(itself_known).select("uid", "known", "base", F.col("other").alias("score"))
    follows = ["uid", "hp", "m", "state", "pre", "other", "known", "base", "hw", "pc", "g", "k"]
    after = places("after").join(before, "hp").withColumns({"known": F.lit(0).cast("long"), "base": F.lit(0.0), "hw": F.col("hw").cast("long")})
    twice = places("both").join(itself, "hw").withColumns(itself_known).join(before, "hp")
    found = after.withColumn("other", F.col("other").cast("double")).select(*follows).unionByName(twice.select(*follows))
    found = found.mapInArrow(after_rare_words(known, mixes), "uid long, known long, base double, score double").unionByName(alone)
    per = found.groupBy("uid").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("score").alias("s"))
    out = texts.drop(*NEEDS).join(per, "uid", "left")
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    out = out.select("doc_id", "held_out", "n_tokens", total("n_known", "k").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), total("base_score", "b").alias("base_score"), total("score", "s").alias("score"), "n_bytes")
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))).drop("n_bytes")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
