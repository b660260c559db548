"""Exact removal of repeated substrings: each byte under a string of `width` bytes that also starts earlier goes.

A suffix array of the whole corpus is neither needed nor held. Every window of `width` bytes names the rightmost smallest
hash among its `gram`-byte strings; equal windows name equal hashes at equal offsets. The windows that name the same place
are neighbours and form a run of at most width - gram + 1 windows. Runs therefore meet by hash:

1. Hashes that no other run has are dropped: their windows occur once.
2. Runs with the same hash and the same bytes repeat the first of them whole.
3. Runs with the same hash but different bytes repeat each other in part. Their bytes are the text of a shard, dealt by
   hash. A hash with many such runs is split: hashes of its windows tell in which run each repeated window stands first, and
   every shard has one such run and a bounded number of those that repeat it, so each window meets its first place. Each shard's suffix array is built by induced sorting (suffixes classified as smaller or larger than their right
   neighbour, leftmost-smaller substrings sorted and named, names refined in pairs as far as `width` goes, then larger and smaller
   suffixes induced bucket by bucket), and common prefixes, permuted to text order and cut at `width`, show equal windows.

Defined cases: doc_id only says which row is earlier, and null sorts first. Rows that share an id, or have none, are told
apart by a hash of their text and stand in its order; of rows with one id and one text, one is the first and the others
repeat it. Null and short texts have no window and keep all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, packed, pieces, saved, table, texts, unpacked

WIDTH, GRAM = 100, 40
#: Text that one pass holds; positions within it take 21 bits.
SLICE = 1 << 19
#: Shards are cut into suffix arrays of about so many bytes, never within a group.
SHARD_BYTES = 1_000_000
#: Most different runs of one hash that make a group as they are, and about so many that a group of a split hash has.
SPLIT_RUNS = 2000
NULL_ID = -(1 << 63)
#: A run's place and its number of windows in one long: p << N_BITS | n.
N_BITS = 7
_LOW = (1 << 21) - 1
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse, modulo 2 to the 64."""
    if base not in _POWERS:
        n = SLICE + 4 * WIDTH + 1
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _prefix(b: np.ndarray, base: int) -> np.ndarray:
    power, _ = _powers(base)
    out = np.zeros(len(b) + 1, np.uint64)
    np.multiply(b, power[: len(b)], out=out[1:])
    return np.cumsum(out, out=out)


def runs(buf: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows, hash of the bytes) of each run of windows in texts that end at `ends`."""
    none = (np.zeros(0, np.int64),) * 4
    windows = len(buf) - width + 1
    if windows <= 0:
        return none
    b = buf.astype(np.uint64) + np.uint64(1)
    _, inverse = _powers(_BASES[0])
    p = _prefix(b, _BASES[0])
    h = p[gram:] - p[:-gram]
    del p  # a pass holds few arrays of its text's length at once
    h *= inverse[: len(b) - gram + 1]
    h = _mixed(h)
    low = np.uint64(_LOW)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    span, have = width - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    key &= low
    at = (low - key).view(np.int64)
    del key
    # windows that lie in one text
    end = np.repeat(ends, np.diff(np.r_[0, ends]))[:windows]
    valid = np.arange(width, windows + width) <= end
    new = np.r_[True, (at[1:] != at[:-1]) | (end[1:] != end[:-1])] & valid
    del end
    first = np.flatnonzero(new)
    if not len(first):
        return none
    # a run ends where the next begins or windows stop being valid
    edge = np.flatnonzero(np.r_[new[1:] | ~valid[1:], True] & valid)
    count = edge - first + 1
    del new, valid, edge
    name = h[at[first]].view(np.int64)
    del h, at
    q = _prefix(b, _BASES[1])
    _, inverse2 = _powers(_BASES[1])
    ctx = _mixed((q[first + count + width - 1] - q[first]) * inverse2[first])
    return name, first, count, ctx.view(np.int64)


def _slices(raw: list[bytes | None], width: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """(rows, their offsets, bytes, ends): several short texts, or a part of a long one with all windows that start in it."""
    short = [0 if t is None or len(t) > SLICE else len(t) for t in raw]
    for a, z in pieces(short, SLICE):
        rows = [i for i in range(a, z) if short[i] >= width]
        if rows:
            yield rows, [0] * len(rows), np.frombuffer(b"".join(raw[i] for i in rows), np.uint8), np.cumsum([short[i] for i in rows])
    for i, t in enumerate(raw):
        if t is not None and len(t) > SLICE:
            for at in range(0, len(t) - width + 1, SLICE):
                part = np.frombuffer(t[at : at + SLICE + width - 1], np.uint8)
                yield [i], [at], part, np.array([len(part)])


def all_runs(width: int, gram: int, names: list[str]):
    """The runs of all texts: `h` alone where they are only counted, else with row (d, x), place and bytes' hash."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, doc, text = texts(batch.column("text")), np.asarray(batch.column("d")), np.asarray(batch.column("x"))
            for rows, offsets, buf, ends in _slices(raw, width):
                h, first, count, ctx = runs(buf, ends, width, gram)
                if not len(h):
                    continue
                which = np.searchsorted(ends, first, "right")
                base = np.r_[0, ends[:-1]][which]
                p, own = first - base + np.array(offsets)[which], np.array(rows)[which]
                cols = {"h": h, "d": doc[own], "x": text[own], "q": p << N_BITS | count, "ctx": ctx}
                yield pa.RecordBatch.from_arrays([pa.array(cols[c]) for c in names], names)

    return go


def _spread(j: np.ndarray, chars: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Appends each place to the queue of its character, keeping the order."""
    if not len(j):
        return
    order = np.argsort(chars, kind="stable")
    j, chars = j[order], chars[order]
    cut = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
    for a, z in zip(cut, np.r_[cut[1:], len(j)], strict=True):
        queues[chars[a]].append(j[a:z])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int64)


def induce(t: np.ndarray, larger: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in order. A bucket's run of equal characters is induced in waves."""
    top = int(t.max())
    seeds: list[list[np.ndarray]] = [[] for _ in range(top + 1)]
    _spread(lms, t[lms], seeds)
    queue: list[list[np.ndarray]] = [[] for _ in range(top + 1)]
    large: list[np.ndarray] = [np.zeros(0, np.int64)] * (top + 1)

    def predecessors(x: np.ndarray, want: bool) -> np.ndarray:
        j = x[x > 0] - 1
        return j[larger[j] == want]

    for c in range(top + 1):
        done, wave = [], _joined(queue[c])
        while len(wave):
            done.append(wave)
            j = predecessors(wave, True)
            same = t[j] == c
            _spread(j[~same], t[j[~same]], queue)
            wave = j[same]
        large[c] = _joined(done)
        j = predecessors(_joined(seeds[c]), True)
        _spread(j, t[j], queue)
    queue = [[] for _ in range(top + 1)]
    out: list[np.ndarray] = []
    for c in range(top, -1, -1):
        done, wave = [], _joined(queue[c])
        while len(wave):
            done.append(wave)
            j = predecessors(wave, False)
            same = t[j] == c
            _spread(j[~same], t[j[~same]], queue)
            wave = j[same]
        back = large[c][::-1]
        j = predecessors(back, False)
        _spread(j, t[j], queue)
        small = _joined(done)
        if c == 0 and not len(small):
            small = np.array([len(t) - 1])  # the end of the text
        out += [small, back]
    return np.concatenate(out)[::-1]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t in the order of their first `depth` characters at least; t ends with its only 0."""
    n = len(t)
    differs = t[:-1] != t[1:]
    diff = np.flatnonzero(differs)
    down = t[diff] > t[diff + 1]
    larger = np.zeros(n, bool)  # suffix i > suffix i + 1, as the next two characters that differ say
    larger[:-1] = down[np.cumsum(differs) - differs]
    lms = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    if len(lms) < 2:
        return induce(t, larger, lms)
    # sort leftmost-smaller substrings by inducing from their first characters, then name them
    order = induce(t, larger, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    place = np.cumsum(is_lms) - 1
    ranked = order[is_lms[order]]
    length = np.r_[lms[1:] - lms[:-1], 0] + 1
    k = place[ranked]
    a, b, la, lb = ranked[:-1], ranked[1:], length[k[:-1]], length[k[1:]]
    differ, todo, at = la != lb, np.flatnonzero(la == lb), 0
    while len(todo):
        todo = todo[at < la[todo]]
        x = t[a[todo] + at] != t[b[todo] + at]
        differ[todo[x]] = True
        todo, at = todo[~x], at + 1
    name = np.zeros(len(lms), np.int64)
    name[k] = np.r_[0, np.cumsum(differ)]
    # names refined in pairs: each round doubles what they tell apart, at least two characters a name
    reach = 1
    while name.max() + 1 < len(name) and reach <= depth:
        after = np.r_[name[reach:], np.full(min(reach, len(name)), -1)][: len(name)] + 1
        _, name = np.unique(name * (len(name) + 1) + after, return_inverse=True)
        reach *= 2
    return induce(t, larger, lms[np.argsort(name, kind="stable")])


def common_prefixes(t: np.ndarray, sa: np.ndarray, width: int) -> np.ndarray:
    """For each place of the text, the characters shared with the suffix before it in the order, cut at width."""
    n = len(t)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    padded = np.r_[t, np.zeros(width + 8, t.dtype)].astype(np.uint64)
    words = np.zeros(n + width + 1, np.uint64)  # seven characters of nine bits each
    for k in range(7):
        words = (words << np.uint64(9)) | padded[k : k + len(words)]
    plcp = np.zeros(n, np.int64)
    todo, at = np.flatnonzero(phi >= 0), 0
    while at < width and len(todo):
        x = words[todo + at] ^ words[phi[todo] + at]
        same = x == 0
        ended, left = todo[~same], x[~same]
        lead = np.full(len(left), at)
        for k in range(1, 7):
            lead += left < np.uint64(1 << (63 - 9 * k))
        plcp[ended] = np.minimum(width, lead)
        todo, at = todo[same], at + 7
        plcp[todo] = min(width, at)
    return plcp


def later_windows(width: int):
    """Windows of a shard that also stand earlier, as runs (d, x, p, n)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_group(batches, ["h", "part"], 4000):
            keys, parts = np.asarray(whole.column("h")), np.asarray(whole.column("part"))
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])])
            size = np.add.reduceat(np.asarray(whole.column("n")) + width, starts)
            for a, z in pieces(size, SHARD_BYTES):
                part = whole.slice(starts[a], (starts[z] if z < len(starts) else len(keys)) - starts[a])
                d, x, p = (np.asarray(part.column(c)) for c in ("d", "x", "p"))
                raw = part.column("bytes").to_pylist()
                t = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8).astype(np.uint16) + 2
                length = np.array([len(x) for x in raw])
                begin = np.r_[0, np.cumsum(length + 1)[:-1]]
                t[begin + length] = 1
                t = np.r_[t, np.uint16(0)]
                sa = suffix_array(t, width)
                plcp = common_prefixes(t, sa, width)
                like = plcp[sa] >= width
                group = np.cumsum(~like)
                shared = like | np.r_[like[1:], False]
                sa, group = sa[shared], group[shared]
                row = np.searchsorted(begin, sa, "right") - 1
                window = sa - begin[row] <= length[row] - width  # others run over the end of their bytes
                sa, group, row = sa[window], group[window], row[window]
                if not len(sa):
                    continue
                at = p[row] + sa - begin[row]
                order = np.lexsort((at, x[row], d[row], group))
                sa, group, row, at = sa[order], group[order], row[order], at[order]
                new = np.r_[True, group[1:] != group[:-1]]
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                # a run may stand in several groups of a split hash; it does not repeat itself
                again = sa[(d[row] != d[row[first]]) | (x[row] != x[row[first]]) | (at != at[first])]
                again.sort()
                if not len(again):
                    continue
                row = np.searchsorted(begin, again, "right") - 1
                cut = np.flatnonzero(np.r_[True, (again[1:] != again[:-1] + 1) | (row[1:] != row[:-1])])
                n = np.r_[cut[1:], len(again)] - cut
                row, at = row[cut], again[cut]
                yield pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array(x[row]), pa.array(p[row] + at - begin[row]), pa.array(n)], ["d", "x", "p", "n"])

    return go


def run_bytes(width: int):
    """The bytes of a document's listed runs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, d, x, listed in zip(texts(batch.column("text")), batch.column("d").to_pylist(), batch.column("x").to_pylist(), batch.column("listed").to_pylist(), strict=True):
                p, n = [y["q"] >> N_BITS for y in listed], [y["q"] & (1 << N_BITS) - 1 for y in listed]
                part = [t[a : a + k + width - 1] for a, k in zip(p, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([y["h"] for y in listed]), pa.array([d] * len(p)), pa.array([x] * len(p)), pa.array(p), pa.array(n), pa.array(part, pa.binary())],
                    ["h", "d", "x", "p", "n", "bytes"],
                )

    return go


def run_windows(width: int):
    """The hash of each window of the given runs, with its run's key and its place."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("bytes").to_pylist()
            for a, z in pieces(map(len, raw), SLICE // 4):
                b = np.frombuffer(b"".join(raw[a:z]), np.uint8).astype(np.uint64) + np.uint64(1)
                n = np.asarray(batch.column("n"))[a:z]
                size = n + width - 1
                own = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(np.cumsum(size) - size, n) + at
                q = _prefix(b, _BASES[1])
                w = _mixed((q[start + width] - q[start]) * _powers(_BASES[1])[1][start]).view(np.int64)
                h, d, x, p = (np.asarray(batch.column(c))[a:z][own] for c in ("h", "d", "x", "p"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, w, d, x, p, p + at)], ["h", "w", "d", "x", "p", "at"])

    return go


def split_shards(runs: DataFrame, width: int) -> DataFrame:
    """Groups (h, part) of a bounded number of runs, for hashes of many runs: in each, a run and some of those that repeat a
    window of it which stands nowhere earlier. A run without a repeated window is in none.
    """
    windows = saved(runs.mapInArrow(run_windows(width), "h long, w long, d long, x long, p long, at long"), "split-windows")
    place = F.struct("d", "x", "at", "p")
    firsts = windows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("f")).where("c > 1").drop("c")
    key = ["h", "d", "x", "p"]
    met = windows.join(firsts, ["h", "w"]).select(*key, F.col("f.d").alias("fd"), F.col("f.x").alias("fx"), F.col("f.p").alias("fp")).distinct()
    met = saved(met.where("d <> fd or x <> fx or p <> fp"), "split-runs")
    first = ["h", "fd", "fx", "fp"]
    parts = F.ceil(F.col("c") / SPLIT_RUNS).cast("int")
    many = met.groupBy(*first).agg(F.count(F.lit(1)).alias("c")).withColumns({"parts": parts, "base": F.xxhash64(*first)})
    dealt = met.join(many, first).select(*key, F.xxhash64("base", F.pmod(F.xxhash64("d", "x", "p"), F.col("parts"))).alias("part"))
    heads = many.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    heads = heads.select("h", F.col("fd").alias("d"), F.col("fx").alias("x"), F.col("fp").alias("p"), F.xxhash64("base", F.col("k").cast("long")).alias("part"))
    return dealt.unionByName(heads).join(runs, key).select("h", "part", "d", "x", "p", "n", "bytes")


def merged_spans(p: np.ndarray, n: np.ndarray, width: int, size: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges, from runs of windows."""
    order = np.argsort(p, kind="stable")
    a, z = p[order], np.minimum(p[order] + n[order] + width - 1, size)
    out: list[tuple[int, int]] = []
    for x, y in zip(a.tolist(), z.tolist(), strict=True):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        elif x < y:
            out.append((x, y))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of each row: `_d` from its id, `_x` from its text. Only rows with the same id and text share one."""
    return docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_x": F.xxhash64(F.col("text").cast("string"))})


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(d, x, spans): for each row key with something to remove, runs of windows (p, n) that also start earlier."""
    own = _keyed(docs).select(F.col("_d").alias("d"), F.col("_x").alias("x"), F.col("text").cast("string"))
    seen = own.mapInArrow(all_runs(width, gram, ["h"]), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    seen = saved(seen, "repeated-hashes")
    live = own.mapInArrow(all_runs(width, gram, ["h", "d", "x", "q", "ctx"]), "h long, d long, x long, q long, ctx long").join(seen, "h")
    live = saved(live, "repeated-runs")
    # the bytes' hash tells their length too, so runs of one class have one number of windows
    classes = live.groupBy("h", "ctx").agg(F.min(F.struct("d", "x", "q")).alias("first"))
    classes = saved(classes, "run-classes")
    # a run that is not the first of its class repeats that one whole
    later = live.join(classes, ["h", "ctx"]).where("first.d <> d or first.x <> x or first.q <> q")
    whole = later.select("d", "x", F.shiftright("q", N_BITS).alias("p"), F.col("q").bitwiseAND((1 << N_BITS) - 1).alias("n"))
    # firsts of different classes with one hash share windows in part
    mixed = saved(classes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "mixed-hashes")
    listed = classes.join(mixed.select("h"), "h").groupBy(F.col("first.d").alias("d"), F.col("first.x").alias("x")).agg(F.collect_list(F.struct("h", F.col("first.q").alias("q"))).alias("listed"))
    once = own.join(listed, ["d", "x"]).mapInArrow(run_bytes(width), "h long, d long, x long, p long, n long, bytes binary")
    shards = once.withColumn("part", F.lit(0).cast("long"))
    hot = mixed.where(F.col("c") > SPLIT_RUNS).select("h")
    if hot.limit(1).count():
        once = saved(once, "run-bytes")
        shards = once.join(hot, "h", "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(split_shards(once.join(hot, "h", "left_semi"), width))
    part = shards.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(later_windows(width), "d long, x long, p long, n long")
    return whole.unionByName(part).groupBy("d", "x").agg(F.collect_list(F.struct("p", "n")).alias("spans"))


def _spans_of(value: list[dict] | None, size: int, width: int) -> list[tuple[int, int]]:
    if not value:
        return []
    return merged_spans(np.array([x["p"] for x in value]), np.array([x["n"] for x in value]), width, size)


def with_spans(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """docs with `_spans`. Of rows with one key all but the first have all their windows in it."""
    columns, key = docs.columns, ["_d", "_x"]
    spans = repeated_spans(docs, width, gram).withColumnsRenamed({"d": "_d", "x": "_x", "spans": "_spans"})
    keyed = _keyed(docs)
    size = F.octet_length(F.col("text").cast("string")).cast("long")
    shared = saved(keyed.where(size >= width).groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(*key), "shared-keys")
    if not shared.limit(1).count():
        return keyed.join(spans, key, "left").drop(*key)
    rows = saved(keyed.join(shared, key, "left_semi").withColumn("_row", F.monotonically_increasing_id()), "rows-of-shared-keys")
    rows = rows.join(rows.groupBy(*key).agg(F.min("_row").alias("_first")), key)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("p"), (size - width + 1).alias("n")))
    later = rows.where("_row <> _first").select(*columns, all_of_it.alias("_spans"))
    first = keyed.join(shared, key, "left_anti").unionByName(rows.where("_row = _first").select(*columns, *key))
    return first.join(spans, key, "left").select(*columns, "_spans").unionByName(later)


def removal_report(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, listed in zip(texts(batch.column("text")), batch.column("_spans").to_pylist(), strict=True):
                t = t or b""
                spans, digest, at = _spans_of(listed, len(t), width), hashlib.sha256(), 0
                for a, z in spans:
                    digest.update(t[at:a])
                    at = z
                digest.update(t[at:])
                rows.append((len(t), sum(z - a for a, z in spans), len(spans), digest.hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ready = with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width, gram)
    return ready.mapInArrow(go, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes cut out of `text`; other columns may have any name. A character goes only if all of its
    bytes do; a null text stays null.
    """
    own = packed(docs, "doc_id", "text")
    columns = own.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, listed in zip(texts(batch.column("text")), batch.column("_spans").to_pylist(), strict=True):
                if not listed or t is None:
                    kept.append(t)
                    continue
                out, at = [], 0
                for a, z in _spans_of(listed, len(t), width):
                    while a < z and t[a] & 0xC0 == 0x80:
                        a += 1
                    while z < len(t) and z > a and t[z] & 0xC0 == 0x80:
                        z -= 1
                    out.append(t[at:a])
                    at = z
                kept.append(b"".join([*out, t[at:]]))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in columns], columns)

    return unpacked(with_spans(own, width, gram).mapInArrow(go, own.schema), docs.columns)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))
