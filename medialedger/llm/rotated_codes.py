"""Near-duplicate embeddings by binary codes of randomly rotated vectors.

A unit vector is turned by seeded random rotations, and the signs of its coordinates are its code. The code's inner product
with the vector itself is kept as correction factor: dividing the code's inner product with another (turned, quantised)
vector by it estimates the two vectors' inner product without bias, with an error of at most
confidence * sqrt((1 - f^2) / f^2) / sqrt(dims - 1) per rotation. Codes, factors and quantised coordinates are made and
written once per vector, about a hundred bytes; only these travel to the places where vectors meet. Rows that have a pair
whose estimate plus the bound reaches the threshold fetch their vectors, and those pairs are computed again, exactly, in double
precision; so what is linked is never below the threshold.

Pairs are met through bands of code bits: vectors at the threshold agree in a bit with probability 1 - angle / pi, and there
are as many bands of as many bits as leave each pair at the threshold apart in all bands with at most the stated
probability MISS; closer pairs are missed far less. A band has a few bits over log2 of its label's vectors, so unrelated
vectors seldom meet, at any size. A pair counts in the first band that its two vectors share.

Vectors of a label that are equal throughout are one node with a count. A band's value that more than BLOCK_ROWS nodes have is
dealt into pairs of parts; what leaves a block is one row per vector, its number of links and its link to a forest, never the
pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link with
nothing; vectors of different lengths never link; an empty table gives an empty result. Rows are told apart by their vectors:
rows that share an id, or have none, count each, and a component is named by the smallest id in it (by the row's own if it has
no id at all).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, dealt_blocks, local_roots, same_group_pairs, saved, table

THRESHOLD = 0.93
MISS = 1e-4
#: Rotations whose codes give an estimate, the levels of a quantised coordinate, and the bound's confidence in deviations.
CODES, LEVELS, CONFIDENCE = 2, 16, 4.5
SPARE_BITS = 4
BLOCK_ROWS = 512
SEED = 20
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dims: int, r: int) -> np.ndarray:
    if (dims, r) not in _ROTATIONS:
        q, t = np.linalg.qr(np.random.default_rng([SEED, dims, r]).standard_normal((dims, dims)))
        _ROTATIONS[dims, r] = q * np.sign(np.diag(t))
    return _ROTATIONS[dims, r]


def bands_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a band, number of bands) for the largest label's number of vectors."""
    bits = min(32, max(8, math.ceil(math.log2(max(2, n))) + SPARE_BITS))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def band_values(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Rows x bands: each band's bits, from the signs of consecutive rotations' coordinates."""
    dims, need = x.shape[1], bits * bands
    signs = np.concatenate([x @ rotation(dims, CODES + r) > 0 for r in range(-(-need // dims))], axis=1)[:, :need]
    return (signs.reshape(len(x), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    short = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, short)))).view(np.uint64)


def codes_of(x: np.ndarray) -> np.ndarray:
    """What is stored of each vector, as rows of 64-bit words: for each rotation the signs, the coordinates' bit planes, and
    three numbers, the correction factor, the least coordinate and the step of the quantisation.
    """
    parts = []
    for r in range(CODES):
        y = x @ rotation(x.shape[1], r)
        low = y.min(axis=1)
        step = np.maximum((y.max(axis=1) - low) / (LEVELS - 1), 1e-12)
        q = np.rint((y - low[:, None]) / step[:, None]).astype(np.uint8)
        factor = np.abs(y).sum(axis=1) / math.sqrt(x.shape[1])
        parts += [_packed(y > 0), *(_packed((q >> b) & 1) for b in range(int(math.log2(LEVELS)))), np.stack([factor, low, step], axis=1).view(np.uint64)]
    return np.concatenate(parts, axis=1)


class Estimator:
    """Inner products of vectors from their stored codes."""

    def __init__(self, stored: np.ndarray, dims: int):
        self.dims, self.parts = dims, []
        words, planes = -(-dims // 64), int(math.log2(LEVELS))
        for own in np.split(stored, CODES, axis=1):
            bits = [np.ascontiguousarray(own[:, k * words : (k + 1) * words]) for k in range(planes + 1)]
            factor, low, step = np.ascontiguousarray(own[:, -3:]).view(np.float64).T
            q_sum = sum(np.bitwise_count(p).sum(axis=1, dtype=np.int64) << b for b, p in enumerate(bits[1:]))
            self.parts.append((bits[0], np.bitwise_count(bits[0]).sum(axis=1, dtype=np.int64), factor, low, step, q_sum, bits[1:]))

    def estimates(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of the inner products of rows i and j, and the bounds of their errors."""
        total, spread = np.zeros(len(i)), np.zeros(len(i))
        root = math.sqrt(self.dims)
        for code, ones, factor, low, step, q_sum, planes in self.parts:
            inside = sum((np.bitwise_count(code[i] & p[j]).sum(axis=1, dtype=np.int64) << b for b, p in enumerate(planes)), np.zeros(len(i), np.int64))
            on = low[j] * ones[i] + step[j] * inside
            everything = low[j] * self.dims + step[j] * q_sum[j]
            total += (2 * on - everything) / root / factor[i]
            f = np.minimum(factor[i], 1.0)
            # the code's error, and the rounding's
            spread += (1 - f * f) / (f * f) / max(1, self.dims - 1) + (step[j] / 2 / factor[i]) ** 2
        return total / CODES, CONFIDENCE * np.sqrt(spread) / CODES


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors; None for those that can't link."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = None
        if v and None not in v:
            y = np.array(v, np.float64)
            if np.isfinite(y).all() and y.any():
                y = y / np.abs(y).max()
                x = y / math.sqrt(y @ y)
        out.append(x)
    return out


def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, x): the unit vector, or null where the row can't link."""
    for batch in batches:
        rows = [x if known else None for x, known in zip(unit_rows(batch.column("embedding")), batch.column("label").is_valid().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "label", "x"])


def _by_dims(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(v) for v in vectors])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, np.array([vectors[k] for k in at])


def coded(threshold: float, miss: float):
    """(node, dims, bands, code): band values of the width that the label's size asks for, and the stored code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                sizes, n = np.asarray(part.column("size")), part.num_rows
                values, codes, dims = [[]] * n, [b""] * n, np.zeros(n, np.int64)
                for at, x in _by_dims(part.column("x").to_pylist()):
                    dims[at] = x.shape[1]
                    for k, c in zip(at, codes_of(x), strict=True):
                        codes[k] = c.tobytes()
                    for size in np.unique(sizes[at]):
                        mine = sizes[at] == size
                        for k, v in zip(at[mine], band_values(x[mine], *bands_for(int(size), threshold, miss)), strict=True):
                            values[k] = v
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(dims), pa.array(values, pa.list_(pa.int64())), pa.array(codes, pa.binary())], ["node", "dims", "bands", "code"])

    return run


def _block_pairs(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of the same block whose estimate may reach the threshold."""
    key, lo, hi, part, dims = (np.asarray(t.column(c)) for c in ("key", "lo", "hi", "part", "dims"))
    group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    raw = np.array(t.column("code").to_pylist(), object)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        e = Estimator(np.frombuffer(b"".join(raw[at]), np.uint64).reshape(len(at), -1), int(d))
        for i, j in same_group_pairs(group[at], len(at)):
            may = (lo[at[i]] == hi[at[i]]) | (part[at[i]] != part[at[j]])
            i, j = i[may], j[may]
            product, bound = e.estimates(i, j)
            may = product + bound >= threshold
            if may.any():
                yield at[i[may]], at[j[may]]


BLOCK = ["key", "lo", "hi"]


def promising(threshold: float):
    """Rows of a block that have a pair there whose estimate may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, BLOCK, 2000):
            has = np.zeros(t.num_rows, bool)
            for i, j in _block_pairs(t, threshold):
                has[i] = has[j] = True
            if has.any():
                yield from t.filter(pa.array(has)).to_batches()

    return run


def compared(threshold: float, miss: float):
    """For each vector of a block with links there: their number, and its link to the block's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, BLOCK, 2000):
            band, node, copies = (np.asarray(t.column(c)) for c in ("band", "node", "copies"))
            sizes, dims, raw = np.asarray(t.column("size")), np.asarray(t.column("dims")), t.column("x").to_pylist()
            place, x = np.zeros(t.num_rows, np.int64), {}
            for at, rows in _by_dims(raw):
                place[at], x[rows.shape[1]] = np.arange(len(at)), rows
            widths = {int(n): bands_for(int(n), threshold, miss) for n in np.unique(sizes)}
            values = np.repeat(-1 - np.arange(t.num_rows)[:, None], max(w[1] for w in widths.values()), axis=1)
            for size, (bits, bands) in widths.items():
                for d in x:
                    mine = np.flatnonzero((sizes == size) & (dims == d))
                    values[mine, :bands] = band_values(x[d][place[mine]], bits, bands)
            number = np.arange(values.shape[1])
            links, left, right = np.zeros(t.num_rows, np.int64), [], []
            for i, j in _block_pairs(t, threshold):
                # only in the first band that both share
                first = ~((values[i] == values[j]) & (number < band[i][:, None])).any(axis=1)
                i, j = i[first], j[first]
                if not len(i):
                    continue
                d = int(dims[i[0]])
                exact = np.einsum("nd,nd->n", x[d][place[i]], x[d][place[j]]) >= threshold
                i, j = i[exact], j[exact]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                left.append(i)
                right.append(j)
            if left:
                root = local_roots(t.num_rows, np.concatenate(left), np.concatenate(right))
                has = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(node[root[has]]), pa.array(links[has])], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of vectors (vec_id, label, embedding)."""
    own = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    rows = own.mapInArrow(prepared, "vec_id long, label string, x array<double>")
    rows = saved(rows.withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("label", "x"))), "unit-vectors")
    nodes = rows.where("node is not null").groupBy("node", "label", "x").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = saved(nodes, "vector-nodes")
    nodes = nodes.join(nodes.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label")
    codes = saved(nodes.select("node", "size", "x").mapInArrow(coded(threshold, miss), "node long, dims long, bands array<long>, code binary"), "vector-codes")
    keys = codes.join(nodes.select("node", "label"), "node").select("node", "label", "dims", F.posexplode("bands").alias("band", "value"))
    keys = keys.select("node", "band", F.xxhash64("label", "dims", "band", "value").alias("key"))
    blocks = dealt_blocks(keys, "key", "node", BLOCK_ROWS).join(codes.select("node", "dims", "code"), "node")
    kind = "node long, key long, band int, part int, lo int, hi int, dims long, code binary"
    blocks = blocks.select(*(x.split()[0] for x in kind.split(", "))).repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    near = saved(blocks.mapInArrow(promising(threshold), kind), "promising")
    near = near.join(nodes.select("node", "size", "x", "copies"), "node").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    found = saved(near.mapInArrow(compared(threshold, miss), "a long, b long, n long"), "vector-links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = nodes.join(components(found.select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    per = roots.join(names, "root").join(links, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(per, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
