"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance.

Links are found by the generalised pigeonhole principle. Bits that vary together are grouped into m partitions; a dynamic
programme gives each partition its own threshold, at least -1 (skipped) and together distance - m + 1, such that the
estimated probes and candidates are fewest. Two fingerprints within the distance then agree within the threshold of at
least one partition, so none is missed, whatever the estimates say. Probes that meet are verified on all 64 bits.

`near_duplicates` links fingerprints alone. `similar` asks for a least similarity of the word shingles (their sets' intersection
by their union), and joins all texts that reach each other over such pairs. Fingerprints come first: what meets within the
distance leaves each block as a forest of its closest pairs, so a large group never becomes all of its pairs, and each pair of
the forest is computed exactly from the whole texts. That leaves out pairs whose fingerprints are further apart, and pairs
that a forest has no place for. So the groups found are then held against each other exactly: in a fixed order of all
shingles, rare ones first, two similar sets share a known least number among their first ones (prefix filter). Pairs of different
groups that do are computed exactly as well, but for those which share a shingle of many texts: they are computed only if
sketches of the whole sets, which bound the similarity, allow it, and the closest pairs come first, so that groups which
join by them make no more pairs.

Defined cases: null and blank texts have fingerprint 0 and are linked like any other. Texts of fewer words than a shingle
hash the whole sequence. Rows with the same fingerprint are one node, so large groups of copies cost one row each. Rows
with a null id get a fingerprint and the component of their fingerprint, but a null id is never a component's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_group, byte_batches, components, dealt_blocks, local_roots, marked, packed, passing_tables, same_group_pairs, saved, spanning_pairs, unpacked

BITS = 64
#: Largest group of probes that one block compares; larger ones are dealt into pairs of parts.
BLOCK_ROWS = 512
#: A probe is a shuffled row; comparing two rows within a block costs this much less.
PROBE_COST = 250
#: Fingerprints from which candidate counts are estimated. Only the cost depends on them, never the result.
SAMPLE = 2000
#: Links that a block gathers before it thins them to a forest.
GATHERED = 2_000_000
#: Rows of a group that are compared in squares.
SQUARE = 48
#: A first shingle that no more texts have makes pairs without sketches.
FEW = 16
#: Bits of the longest sketch of a text's shingles. Only the cost depends on it.
SKETCH = 1 << 15
#: Texts from which frequent shingles are told, and how many of these are sent to tasks. Only the cost depends on them.
COMMON_TEXTS, COMMON = 10_000, 200_000


def shingles(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; of all its words where they are fewer, none where it has none."""
    w = (text or b"").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return np.array([digest(join(w), seed)] if w else [], "<u8")
    return np.array([digest(join(x), seed) for x in zip(*(w[k:] for k in range(words)), strict=False)], "<u8")


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    return majority(shingles(text, words, seed))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp as the signed 64-bit form of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in byte_batches(batches):
            fp = np.array([fingerprint(t, words, seed) for t in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_correlations(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and the correlation of each two bits over all of them; a fixed 64 x 64 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = np.asarray(batch.column("fp")).astype("<i8")
            b = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total, n = total + b.T @ b, n + len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])

    cells = fps.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(BITS * BITS + 1)
    for r in cells:
        sums[r["cell"]] = r["n"]
    n = max(1.0, sums[-1])
    both = sums[:-1].reshape(BITS, BITS) / n
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return int(sums[-1]), (both - np.outer(p, p)) / np.outer(sd, sd)


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each starts at the free bit that is most correlated and takes the bits that go with it."""
    strength, free, parts = np.abs(corr) - np.eye(len(corr)), set(range(len(corr))), []
    for k in range(m):
        width = len(free) // (m - k)
        order = sorted(free)
        part = [order[int(np.argmax(strength[np.ix_(order, order)].max(axis=1)))]]
        free.remove(part[0])
        while len(part) < width:
            order = sorted(free)
            part.append(order[int(np.argmax(strength[np.ix_(order, part)].sum(axis=1)))])
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def mask(part: list[int]) -> int:
    return sum(1 << b for b in part)


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t[i] >= -1 of sum `total` with the least sum of cost[i][t[i] + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in new or c + x < new[s + t][0]:
                    new[s + t] = (c + x, [*ts, t])
        best = new
    return best[total]


def plan(n: int, corr: np.ndarray, sample: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, for the number of partitions whose estimated cost is least."""
    plans = []
    i, j = np.triu_indices(len(sample), 1)
    xor = sample[i] ^ sample[j]
    for m in range(2, distance + 2) if distance else [1]:
        parts = group_bits(corr, m)
        cost = []
        for p in parts:
            near = np.bincount(np.bitwise_count(xor & np.uint64(mask(p))), minlength=BITS + 1) if len(xor) else np.zeros(BITS + 1)
            row = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(p), k) for k in range(t + 1))
                share = near[: t + 1].sum() / max(1, len(xor))
                least = probes / 2.0 ** len(p)  # what unrelated bits would give; the sample can't show rates this small
                row.append(PROBE_COST * max(1, n) * probes + n * n / 2 * max(share, least))
            cost.append(row)
        plans.append((*allocate(cost, distance - m + 1), parts))
    _, thresholds, parts = min(plans, key=lambda x: x[0])
    return [(p, t) for p, t in zip(parts, thresholds, strict=True) if t >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probes(nodes: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """One row for each node, partition and pattern of its bits within the partition's threshold."""
    flips = [F.struct(F.lit(k).alias("k"), F.lit(signed(mask(p))).cast("long").alias("m"), F.lit(signed(mask(list(c)))).cast("long").alias("x")) for k, (p, t) in enumerate(chosen) for d in range(t + 1) for c in combinations(p, d)]
    return nodes.withColumn("_f", F.explode(F.array(*flips))).select("fp", "rep", F.xxhash64("_f.k", F.col("fp").bitwiseAND(F.col("_f.m")).bitwiseXOR(F.col("_f.x"))).alias("key"))


def look(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent hashes made from one."""
    for _ in range(k):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h


def near_rows(fp: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, part: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of a group within the distance, i before j: of one part, or of its two parts with each other.

    Rows of small groups are paired by their distance in the order, those of large ones in squares.
    """
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    small = np.flatnonzero(np.repeat(size, size) < SQUARE)
    for i, j in same_group_pairs(group[small], SQUARE):
        i, j = small[i], small[j]
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & ((lo[i] == hi[i]) | (part[i] != part[j]))
        yield i[near], j[near]
    for a, n in zip(start[size >= SQUARE].tolist(), size[size >= SQUARE].tolist(), strict=True):
        at = np.arange(a, a + n)
        crossed = lo[a] != hi[a]
        left, right = (at[part[at] == lo[a]], at[part[at] == hi[a]]) if crossed else (at, at)
        for b in range(0, len(left), 256):
            i, j = np.nonzero(np.bitwise_count(fp[left[b : b + 256], None] ^ fp[right]) <= distance)
            i, j = left[b + i], right[j]
            keep = (i != j) if crossed else i < j
            yield np.minimum(i, j)[keep], np.maximum(i, j)[keep]


def linked(distance: int, closest: bool = False):
    """Links within each block, as a spanning forest: never more rows than the block has. With `closest`, each is a pair
    within the distance, and closer pairs come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["key", "lo", "hi"], 20_000):
            key, lo, hi, part, fp, rep = (np.asarray(t.column(c)) for c in ("key", "lo", "hi", "part", "fp", "rep"))
            fp = fp.view(np.uint64)  # bits of a negative number would be those of its absolute value
            group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
            more: list[tuple[np.ndarray, np.ndarray]] = []

            def thinned(n=len(fp), fp=fp):
                i, j = (np.concatenate([old, *new]) for old, new in zip((left, right), zip(*more, strict=True), strict=True))
                keep = spanning_pairs(n, i, j, np.bitwise_count(fp[i] ^ fp[j]) if closest else np.zeros(len(i)))
                more.clear()
                return i[keep], j[keep]

            held = 0
            for i, j in near_rows(fp, group, lo, hi, part, distance):
                other = rep[i] != rep[j]
                if other.any():
                    more.append((i[other], j[other]))
                    held += len(more[-1][0])
                if held > GATHERED:
                    left, right = thinned()
                    held = 0
            if more:
                left, right = thinned()
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(rep[left]), pa.array(rep[right])], ["a", "b"])

    return run


def links_within(nodes: DataFrame, distance: int, closest: bool = False) -> DataFrame:
    """(a, b): links of nodes (fp, rep) within the distance, as forests of the blocks in which their probes meet."""
    n, corr = bit_correlations(nodes)
    picked = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in picked], np.int64).view(np.uint64)
    chosen = plan(n, corr, sample, distance)
    blocks = dealt_blocks(probes(nodes, chosen), "key", "rep", BLOCK_ROWS)
    return blocks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(linked(distance, closest), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id that its links reach."""
    fps = saved(fingerprints(docs, words, seed), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-nodes")
    named = nodes.where("rep is not null")
    links = links_within(named, distance)
    roots = components(links)
    named_root = nodes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(named_root, "fp").select("doc_id", "fp", "component_id")


def _shingled(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in byte_batches(batches):
            sets = [np.unique(shingles(t, words, seed)).view(np.int64) for t in raw]
            ends = np.r_[0, np.cumsum([len(x) for x in sets])]
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["x", "set"])

    return run


def similar_links(docs: DataFrame, links: DataFrame, words: int, similarity: float, seed: int) -> DataFrame:
    """The links (a, b) between texts of docs (x, text) whose shingle sets are at least that similar; sets of no shingle are alike."""
    needed = saved(links.select(F.col("a").alias("x")).union(links.select("b")).distinct(), "linked-texts")
    # texts are long: those that no link has aren't shuffled
    found = marked(docs, needed, "x", "linked").where("linked").select("x", "text")
    sets = found.join(needed, "x").dropDuplicates(["x"]).mapInArrow(_shingled(words, seed), "x long, set array<long>")
    sets = saved(sets, "shingle-sets")
    a, b = (sets.select(F.col("x").alias(c), F.col("set").alias(f"{c}_set")) for c in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    either = F.size("a_set") + F.size("b_set") - both
    return links.join(a, "a").join(b, "b").where(both >= similarity * either).select("a", "b")


def common_shingles(docs: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of some texts of docs (x, text) have, ascending, and the logarithm of their number of texts."""
    step = max(1, -(-docs.count() // COMMON_TEXTS))
    sets = docs.where(F.pmod("x", F.lit(step)) == 0).dropDuplicates(["x"]).mapInArrow(_shingled(words, seed), "x long, set array<long>")
    found = sets.select(F.explode("set").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = found.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = np.asarray(got.column("h")).astype("<i8").view(np.uint64), np.asarray(got.column("n"))
    order = np.argsort(h)
    return h[order], np.minimum(15, np.log2(n[order])).astype(np.uint64)


def sketch(h: np.ndarray) -> bytes:
    """Parities of a set's members, dealt by their hash to four places or more for each, SKETCH at most. Two sets differ in no
    fewer members than their sketches in bits, and the halves of a sketch, xor-ed, are the sketch of half the length.
    """
    places = min(SKETCH, max(64, 1 << (4 * len(h) - 1).bit_length()))
    odd = np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(words: np.ndarray, begin: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of rows i and j differ, the longer one folded to the length of the shorter."""
    out, kind = np.zeros(len(i), np.int64), size[i] * SKETCH + size[j]
    for k in np.unique(kind).tolist():
        p, q = divmod(k, SKETCH)
        least, own = min(p, q), np.flatnonzero(kind == k)
        step = max(1, (1 << 17) // max(p, q))
        for a in range(0, len(own), step):
            at = own[a : a + step]
            one, two = (words[begin[r[at], None] + np.arange(w)].reshape(len(at), -1, least) for r, w in ((i, p), (j, q)))
            out[at] = np.bitwise_count(np.bitwise_xor.reduce(one, axis=1) ^ np.bitwise_xor.reduce(two, axis=1)).sum(axis=1, dtype=np.int64)
    return out


def first_shingles(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[int, np.ndarray, bytes]:
    """(number of different shingles, the first of them in the order of all shingles, the sketch of all): two sets of at least
    this similarity share one of the first. No shingle counts as one of its own.
    """
    h = np.unique(h) if len(h) else np.zeros(1, np.uint64)
    rank = h & np.uint64((1 << 58) - 1)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        rank |= np.where(common[0][at] == h, common[1][at], np.uint64(0)) << np.uint64(58)
    rank = np.unique(rank)
    n = len(rank)
    return n, rank[: n - int(np.ceil(similarity * n - 1e-9)) + 1].view(np.int64), sketch(rank)


def met(similarity: float, forest: bool):
    """(a, b): pairs of different groups that meet in a block, but for those whose sketches differ in too many bits. With
    `forest`, only pairs that join the same groups, closest first: never more rows than the blocks have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["key", "lo", "hi"], 5_000):
            key, lo, hi, part, x, root, n = (np.asarray(t.column(c)) for c in ("key", "lo", "hi", "part", "x", "root", "n"))
            raw = t.column("sketch").to_pylist()
            words, size = np.frombuffer(b"".join(raw), "<u8"), np.array([len(r) // 8 for r in raw])
            begin = np.cumsum(size) - size
            group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            names, place = np.unique(root, return_inverse=True)
            held = np.zeros((3, 0), np.int64)
            more: list[np.ndarray] = []

            def thinned(x=x, names=names, place=place, more=more):
                i, j, cost = all_ = np.concatenate([held, *more], axis=1)
                more.clear()
                if forest:
                    return all_[:, spanning_pairs(len(names), place[i], place[j], cost)]
                a, b = np.minimum(x[i], x[j]), np.maximum(x[i], x[j])
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                return all_[:, order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]]]

            for i, j in near_rows(np.zeros(len(x), np.uint64), group, lo, hi, part, BITS):
                keep = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                i, j = i[keep], j[keep]
                both = n[i] + n[j]
                most = both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9).astype(np.int64)
                apart = bits_apart(words, begin, size, i, j)
                near = apart <= most
                more.append(np.stack([i, j, 16 * apart // (most + 1)])[:, near])
                if sum(m.shape[1] for m in more) > GATHERED // 10:
                    held = thinned()
            if more:
                held = thinned()
            i, j, _ = held
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], x[j])), pa.array(np.maximum(x[i], x[j]))], ["a", "b"])

    return run


def met_by_few(similarity: float):
    """(a, b, need): pairs of different groups that share a key of few texts, and how many such keys similar ones share at least.

    Of two texts, take the one whose first shingles end earlier: all of them that the other text has are among that one's first
    ones, and at most n - overlap of them are missing there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["key"], 20_000):
            key, x, root, n, p, last = (np.asarray(t.column(c)) for c in ("key", "x", "root", "n", "p", "last"))
            for i, j in same_group_pairs(key, FEW + 1):
                keep = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                i, j = i[keep], j[keep]
                overlap = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9).astype(np.int64)
                early = np.where(last[i] <= last[j], i, j)
                need = p[early] - (n[early] - overlap)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], x[j])), pa.array(np.maximum(x[i], x[j])), pa.array(need)], ["a", "b", "need"])

    return run


def shared_shingles(texts: DataFrame) -> DataFrame:
    """(key, x): the first shingles that several different texts of the rows (x, first) have, and who has them."""
    own, each = texts.select("x", F.explode("first").alias("key")), W.partitionBy("key")
    return own.withColumns({"_low": F.min("x").over(each), "_high": F.max("x").over(each)}).where("_low < _high").select("key", "x").distinct()


def pairs_between(shared: DataFrame, texts: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """(a, b): pairs of texts (x, root, n, p, last, sketch) of different roots that share (key, x), among them all that have at
    least this similarity. Pairs that share a key of over FEW texts are told by their sketches, all others by how many keys
    they share. With `forest`, only of the former, and only some that join the same roots if they are similar.
    """
    each = W.partitionBy("key")
    own = shared.join(texts.drop("sketch"), "x").repartition("key")
    own = own.withColumns({"low": F.min("root").over(each), "high": F.max("root").over(each), "texts": F.count(F.lit(1)).over(each)}).where("low < high")
    dealt = dealt_blocks(own.where(F.col("texts") > FEW).select("key", "x", "root", "n"), "key", "x", BLOCK_ROWS).join(texts.select("x", "sketch"), "x")
    blocks = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = blocks.mapInArrow(met(similarity, forest), "a long, b long").distinct()
    if forest:
        return pairs
    few = own.where(F.col("texts") <= FEW).sortWithinPartitions("key").mapInArrow(met_by_few(similarity), "a long, b long, need long")
    few = few.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need")
    return few.select("a", "b").unionByName(pairs).distinct()


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 7, looks: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, x, row, group) for every row of docs (doc_id, text, rest): x and row are hashes of its text and of all of it,
    group is the same for rows whose texts reach each other over links of at least this similarity, and for no others. A text
    has as many fingerprints as `looks` says; texts of which two of the same look are within the distance are compared first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("x"), F.xxhash64("doc_id", "text", F.to_json("rest")).alias("row"))
    whole = keyed.select("x", "text")
    common = keyed.sparkSession.sparkContext.broadcast(common_shingles(whole, words, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in byte_batches(batches):
            h = [shingles(t, words, seed) for t in raw]
            fps = [pa.array(np.array([majority(look(x, k)) for x in h], np.uint64).view(np.int64)) for k in range(looks)]
            n, first, sketches = zip(*(first_shingles(x, common.value, similarity) for x in h), strict=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in first])], pa.int32()), pa.array(np.concatenate(first)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "x", "row")), *fps, pa.array(n, pa.int64()), lists, pa.array(sketches, pa.binary())], ["doc_id", "x", "row", *names, "n", "first", "sketch"])

    kind, names = docs.schema["doc_id"].dataType.simpleString(), [f"fp{k}" for k in range(looks)]
    rows = saved(keyed.mapInArrow(run, f"doc_id {kind}, x long, row long, {', '.join(f'{c} long' for c in names)}, n long, first array<long>, sketch binary"), "fingerprints")
    nodes = saved(rows.select(F.col("x").alias("rep"), *names).distinct(), "fingerprint-nodes")
    found = [links_within(nodes.select("rep", F.col(c).alias("fp")), distance, closest=True) for c in names]
    both = reduce(DataFrame.unionByName, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = saved(both.distinct(), "close-texts")
    near = saved(similar_links(whole, links, words, similarity, seed), "similar-texts")
    roots = components(near)
    shared = saved(shared_shingles(rows), "shared-shingles")
    own = saved(rows.select("x", "n", F.size("first").cast("long").alias("p"), F.element_at("first", -1).alias("last"), "sketch").join(shared.select("x").distinct(), "x", "left_semi").dropDuplicates(["x"]), "sketches")
    # first what joins groups at all, then, between groups that are left, every pair
    for forest in (True, False):
        grouped = own.join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
        pairs = saved(pairs_between(shared, grouped, similarity, forest), "other-pairs")
        more = saved(similar_links(whole, pairs, words, similarity, seed), "other-similar-texts")
        if more.head(1):
            near = near.unionByName(more)
            roots = components(near)
    return rows.join(roots, rows["x"] == roots["node"], "left").select("doc_id", "x", "row", F.coalesce("root", "x").alias("group"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 7, looks: int = 2) -> DataFrame:
    """docs with one row of each group of similar texts: the one with the smallest id, ids that are null last, then the one with
    the smallest hash. Of rows that are equal throughout one stays. Columns beside doc_id and text may have any name.
    """
    own = packed(docs, "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "x", "row"))
    with passing_tables(docs.sparkSession):
        groups = similar(own, words, similarity, distance, looks)
        groups = saved(groups, "groups")
        firsts = groups.groupBy("group").agg(first.alias("first"), F.count(F.lit(1)).alias("rows"))
        kept = saved(firsts.select("group", F.col("first.x").alias("x"), F.col("first.row").alias("row"), "rows"), "kept-rows", lasting=True)
        several = saved(groups.join(kept.where("rows > 1").select("group"), "group").select("x").distinct(), "texts-of-groups", lasting=True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = own.withColumns({"x": F.xxhash64(text), "row": F.xxhash64("doc_id", "text", F.to_json("rest"))})
    # a row that is alone in its group stays as it is, without a shuffle
    told = marked(keyed, several, "x", "several")
    chosen = told.where("several").join(kept.select("x", "row"), ["x", "row"]).dropDuplicates(["x", "row"])
    return unpacked(told.where("not several").unionByName(chosen), docs.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
