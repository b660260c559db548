"""Quality rules: counts with fixed limits, and a logistic regression over hashed word and character n-grams.

The regression is fitted on labelled quality rows: at most `per_class` of each class, the ones with the smallest hash of their
id, read whole. A third of them is kept out of the fit and used to calibrate the probabilities (a logistic curve over the
scores, with the classes' shares among all labelled rows as weights). Every text is scored in Arrow batches; a text is kept
if its calibrated probability of being good is at least KEEP.

Defined cases: a null text has no words and fails the base rules; with labels of one class only, or none, the regression keeps
everything; labels without a document and null labels are ignored; rows that repeat an id are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, set_apart, table

BUCKETS = 1 << 15
CHAR_GRAMS = (2, 4)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Limits of the base rules, and the least probability that keeps a text.
LEAST_WORDS, MOST_REPEATED, KEEP = 10, 20, 0.5
WINDOW = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLANK_LINE = re.compile(rb"[\x20\x09-\x0D]*\Z")
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


@dataclass
class Words:
    """All words of a batch of texts in a row: their hashes, begins in the buffer, and each text's number of words."""

    buf: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    count: np.ndarray


def words_of(raw: list[bytes | None]) -> Words:
    """Texts are joined by line ends, so no word spans two of them."""
    buf = np.frombuffer(b"".join((t or b"") + b"\n" for t in raw), np.uint8)
    ends = np.cumsum([len(t or b"") + 1 for t in raw])
    inside = ~_SPACE[buf]
    begin = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    end = np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1
    # polynomial hash of each word, from running sums
    power = np.cumprod(np.full(len(buf) + 1, 0x100000001B3, np.uint64))
    inverse = np.cumprod(np.full(len(buf) + 1, pow(0x100000001B3, -1, 1 << 64), np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], dtype=np.uint64)]
    h = (sums[end] - sums[begin]) * inverse[begin]
    h = (h ^ (h >> np.uint64(31))) * _MULT
    h ^= h >> np.uint64(29)
    text = np.searchsorted(ends, begin, "right")
    return Words(buf, ends, h, np.bincount(text, minlength=len(raw)))


def _sums(per_byte: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.r_[0, np.cumsum(per_byte)]
    return c[ends] - c[np.r_[0, ends[:-1]]]


def repeated_words(w: Words) -> np.ndarray:
    """Words of each text that lie in a window of five which the text has twice or more."""
    n = len(w.hashes)
    out = np.zeros(len(w.count), np.int64)
    if n < WINDOW:
        return out
    text = np.repeat(np.arange(len(w.count)), w.count)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        h = (h + w.hashes[k : k + len(h)]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    ok = np.flatnonzero(text[: len(h)] == text[WINDOW - 1 :])
    h = h[ok] + text[ok].astype(np.uint64) * _MULT
    order = np.argsort(h, kind="stable")
    s = h[order]
    twin = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        twin[1:] |= eq
        twin[:-1] |= eq
    edge = np.zeros(n + 1, np.int64)
    start = ok[order[twin]]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + WINDOW, -1)
    covered = np.cumsum(edge[:n]) > 0
    return np.bincount(text[covered], minlength=len(w.count))


def base_counts(raw: list[bytes | None], w: Words) -> dict[str, np.ndarray]:
    points = (w.buf & 0xC0) != 0x80
    dup = []
    for t in raw:
        lines = [x for x in (t or b"").split(b"\n") if not BLANK_LINE.match(x)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": w.count,
        "word_chars": _sums(points & ~_SPACE[w.buf], w.ends),
        "n_symbols": _sums(SYMBOLS[w.buf], w.ends),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeated_words(w),
    }


def hashed(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every word, word pair and character n-gram, one kind at a time."""
    text = np.repeat(np.arange(len(w.count)), w.count)
    top = np.uint64(64 - 15)
    yield ((w.hashes * _MULT) >> top).astype(np.int64), text
    if len(w.hashes) > 1:
        pair = (w.hashes[:-1] * np.uint64(3) + w.hashes[1:]) * _MULT
        same = text[:-1] == text[1:]
        yield (pair[same] >> top).astype(np.int64), text[:-1][same]
    b = w.buf.astype(np.uint32)
    at = np.searchsorted(w.ends, np.arange(len(b)), "right").astype(np.int32)
    for n in CHAR_GRAMS:
        if len(b) >= n:
            h = np.zeros(len(b) - n + 1, np.uint32)
            for k in range(n):
                h = h * np.uint32(257) + b[k : k + len(h)]
            h = h * np.uint32(2654435761) + np.uint32(n)
            yield (h >> np.uint32(32 - 15)).astype(np.int64), at[: len(h)]


def raw_scores(w: Words, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's features, kind by kind."""
    out = np.zeros(len(w.count))
    for bucket, text in hashed(w):
        got = np.bincount(text, weights[bucket], len(w.count))
        out += got / np.maximum(1, np.bincount(text, minlength=len(w.count)))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[bytes, int]], share_good: float, rounds: int = 150) -> Model | None:
    """From (text, 0 or 1) rows; every third is kept for calibration."""
    y_all = np.array([y for _, y in rows], float)
    if len(set(y_all.tolist())) < 2:
        return None
    buckets, owners, shares = [], [], []
    for k, (t, _) in enumerate(rows):
        for b, _text in hashed(words_of([t])):
            u, c = np.unique(b, return_counts=True)
            buckets.append(u)
            owners.append(np.full(len(u), k))
            shares.append(c / max(1, len(b)))
    bucket, row, value, n = np.concatenate(buckets), np.concatenate(owners), np.concatenate(shares), len(rows)
    held = np.arange(n) % 3 == 2
    y, use = y_all, ~held
    balance = np.where(y == 1, 0.5 / max(1, (y[use] == 1).sum()), 0.5 / max(1, (y[use] == 0).sum())) * use
    weights, bias = np.zeros(BUCKETS), 0.0
    g, gb = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights[bucket] * value, n) + bias
        err = (sigmoid(z) - y) * balance
        d = np.bincount(bucket, err[row] * value, BUCKETS) + 1e-6 * weights
        g, gb = g + d * d, gb + err.sum() ** 2
        weights -= 1.0 * d / np.sqrt(g)
        bias -= 0.3 * err.sum() / np.sqrt(gb)
    z = np.bincount(row, weights[bucket] * value, n) + bias
    cal = held if len(set(y[held].tolist())) == 2 else use
    # a logistic curve over held-out scores; classes count with their shares among all labelled rows
    x, t = z[cal], y[cal]
    wt = np.where(t == 1, share_good / max(1, (t == 1).sum()), (1 - share_good) / max(1, (t == 0).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * x + shift)
        r, q = (p - t) * wt, np.maximum(p * (1 - p) * wt, 1e-9)
        grad = np.array([(r * x).sum() + 1e-4 * (slope - 1), r.sum()])
        hess = np.array([[(q * x * x).sum() + 1e-4, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-9]])
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        slope, shift = slope - move[0], shift - move[1]
    return Model(weights.astype(np.float32), bias, float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 800) -> Model | None:
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = known.where("quality = 0").orderBy(*order).limit(per_class).unionByName(known.where("quality = 1").orderBy(*order).limit(per_class))
    # twice per_class ids at most, so they are sent to the texts, not the texts to them; one text of each id
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows = sorted({(zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"], r["quality"]) for r in rows})
    return fit([(r[2].encode(), r[3]) for r in rows], shares.get(1, 0) / max(1, sum(shares.values())))


def assess(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with the base counts, base_failed, p_good (null without a model) and kept; own columns of these names get `_in`."""
    docs = set_apart(docs, *BASE_COLUMNS, "base_failed", "p_good", "kept")
    columns = docs.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # sent with the function: BUCKETS weights
        for batch, raw in byte_batches(batches):
            w = words_of(raw)
            c = base_counts(raw, w)
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
            p = sigmoid(m.slope * (raw_scores(w, m.weights) + m.bias) + m.shift) if m else np.full(len(raw), np.nan)
            kept = ~failed & ((p >= KEEP) | np.isnan(p))
            more = [*(pa.array(c[x].astype(np.int64)) for x in BASE_COLUMNS), pa.array(failed), pa.array(p, from_pandas=True), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in columns), *more], [*columns, *BASE_COLUMNS, "base_failed", "p_good", "kept"])

    more = [T.StructField(c, T.LongType()) for c in BASE_COLUMNS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("p_good", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return docs.mapInArrow(go, T.StructType([*docs.schema.fields, *more]))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").cast("string"))
    out = assess(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
