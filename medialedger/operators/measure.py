"""Measurements of pixels and embeddings, in Arrow batches where built-in functions can't express them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

CANVAS = 512
HIGH, LOW = 253, 2


@lru_cache(64)
def _kernel(source: int, target: int, kind: str) -> np.ndarray:
    """target x source weights of a separable resampling; the filter widens when it shrinks."""
    scale = source / target
    wide = max(1.0, scale)
    support = {"triangle": 1.0, "lanczos": 3.0}[kind] * wide
    center = (np.arange(target) + 0.5) * scale
    at = np.arange(source) + 0.5
    x = (at[None, :] - center[:, None]) / wide
    w = np.maximum(0.0, 1.0 - np.abs(x)) if kind == "triangle" else np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    w = np.where(np.abs(x) * wide < support, w, 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(plane: np.ndarray, height: int, width: int, kind: str = "lanczos") -> np.ndarray:
    out = _kernel(plane.shape[0], height, kind) @ plane @ _kernel(plane.shape[1], width, kind).T
    return np.clip(np.rint(out), 0, 255)


def luma(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114)


def canvas(rgb: np.ndarray) -> np.ndarray:
    """The picture with its long edge at CANVAS, whatever its size, so that resolution never moves a measurement."""
    h, w = rgb.shape[:2]
    s = CANVAS / max(h, w)
    size = (max(1, round(h * s)), max(1, round(w * s)))
    return rgb if size == (h, w) else np.stack([resized(rgb[..., c].astype(float), *size) for c in range(3)], axis=-1)


def sharpness(gray: np.ndarray) -> float:
    """Variance of the Laplacian inside a square."""
    g = resized(gray, CANVAS, CANVAS, "triangle")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def clipping(gray: np.ndarray) -> tuple[float, float]:
    return float((gray >= HIGH).mean()), float((gray <= LOW).mean())


def dhash64(gray: np.ndarray) -> str:
    small = resized(gray, 8, 9)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return f"{int(np.packbits(bits).view('>u8')[0]):016x}"


def measure_images(images: DataFrame, batch_rows: int = 8) -> DataFrame:
    """(path, width, height, sharpness, clip_hi, clip_lo, phash, error) of Spark's image source, in one pass.

    Pictures that could not be decoded come back with an error. Few rows go into a batch, as each may be large.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch_rows):
                rows = []
                for r in b.iloc[a : a + batch_rows].itertuples():
                    try:
                        if r.height <= 0 or r.width <= 0 or r.channels not in (1, 3, 4):
                            raise ValueError("not a picture")
                        px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                        rgb = np.repeat(px, 3, axis=2) if r.channels == 1 else px[..., 2::-1]  # stored as blue, green, red
                        gray = luma(canvas(rgb.astype(float)))
                        rows.append((r.path, r.width, r.height, sharpness(gray), *clipping(gray), dhash64(gray), None))
                    except ValueError as e:
                        rows.append((r.path, None, None, None, None, None, "0" * 16, str(e)))
                out = pd.DataFrame(rows, columns=["path", "width", "height", "sharpness", "clip_hi", "clip_lo", "phash", "error"])
                yield out.astype({"width": "Int32", "height": "Int32"})

    flat = images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, "path string, width int, height int, sharpness double, clip_hi double, clip_lo double, phash string, error string")


def checked(embedding: Column, dims: int) -> Column:
    """The embedding, or an error that stops the job: a wrong width must never become a score."""
    return F.when(embedding.isNull(), embedding).otherwise(F.when(F.size(embedding) == dims, embedding).otherwise(F.raise_error(F.concat(F.lit(f"embedding of {dims} values expected, got "), F.size(embedding).cast("string")))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(embedding: Column) -> Column:
    e = F.transform(embedding, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(e, lambda x: F.try_divide(x, norm))


def fold_layers(layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Linear layers without activations between them are one affine map."""
    w, b = layers[0]
    for w2, b2 in layers[1:]:
        w, b = w2 @ w, w2 @ b + b2
    return np.asarray(w).ravel(), float(np.asarray(b).ravel()[0])


def affine(embedding: Column, weights: np.ndarray, bias: float) -> Column:
    """The folded head over the normalised embedding; stays in the JVM."""
    return dot(normalized(embedding), F.array(*(F.lit(float(x)) for x in weights))) + F.lit(bias)


def subject_match(images: DataFrame, prompts: DataFrame, config: Config, dims: int) -> DataFrame:
    """images with subject_score, subject_label, subject_tier against prompts (prompt_id, tier, label, embedding).

    Cosines times 100, a softmax over all prompts; the best primary against a discounted best secondary, over those and the
    distractors' mass. A matrix product per batch; the prompts are a short list.
    """
    rows = prompts.orderBy("prompt_id").select("tier", "label", "embedding").collect()
    tiers, labels = np.array([r["tier"] for r in rows]), [r["label"] for r in rows]
    p = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), dims)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    first, second, away = (np.flatnonzero(tiers == t) for t in ("primary", "secondary", "distractor"))
    discount = config.secondary_discount
    columns = images.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["embedding"].tolist(), np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            z = 100 * (x @ p.T)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            prob = e / e.sum(axis=1, keepdims=True)
            best = lambda at: (prob[:, at].max(axis=1), at[prob[:, at].argmax(axis=1)]) if len(at) else (np.zeros(len(b)), np.zeros(len(b), int))
            (p1, i1), (p2, i2) = best(first), best(second)
            target, mass = p1 + discount * p2, prob[:, away].sum(axis=1)
            score = np.clip(100 * target / np.maximum(target + mass, 1e-6), 0, 100)
            use2 = discount * p2 > p1
            none = (p1 == 0) & (p2 == 0)
            label = [("" if n else labels[j if u else i]) for n, u, i, j in zip(none, use2, i1, i2, strict=True)]
            tier = np.where(none, "distractor", np.where(use2, "secondary", "primary"))
            yield b.assign(subject_score=score, subject_label=label, subject_tier=tier)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
    ready = images.where("embedding is not null").withColumn("embedding", checked(F.col("embedding"), dims)).select(*columns)
    return ready.mapInPandas(run, f"{kinds}, subject_score double, subject_label string, subject_tier string")


def dhash_of_rows(rows: Column) -> Column:
    """Hex hash of an array of 8 arrays of 9 values; all built in."""
    bits = F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.get(r, k + 1) > F.get(r, k), 1).otherwise(0))))
    nibble = lambda k: F.hex(reduce(lambda a, b: a + b, (F.get(bits, 4 * k + j) * (8 >> j) for j in range(4))).cast("long"))
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), nibble), ""))
