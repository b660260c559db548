"""Language of texts by a linear-chain conditional random field over their words.

A word's emission scores are the summed weights of its hashed features: the word itself (lexicon), its prefixes and suffixes
(affixes) and its byte n-grams. Learned transitions join neighbouring words, so a few borrowed words in a text don't carry a
switch, while a real change of language does. Forward-backward gives each word's marginals; a document's language is the one
with the largest sum over words that have a letter, its score that sum's share.

The field is fitted by gradient descent on the exact likelihood, on a bounded sample: at most `per_lang` labelled documents of
each language, the ones with the smallest hash of their id. Training words are whole texts cut into segments that are joined
in random order, so that switches are seen. The weights have a fixed size and are sent to the tasks.

Defined cases: null texts and texts without a letter are `und` with score 0; ids and labels are never features; a null id is
hashed as an empty text; with no labelled row at all every text is `und`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import byte_batches, set_apart, table

FEATURES = 1 << 15
AFFIX, GRAMS = 3, (1, 2, 3)
SEGMENT = 64
#: Gradient steps that even a small sample gets.
LEAST_STEPS = 200
LETTER = re.compile(r"[^\W\d_]")
#: Words whose emissions a task keeps.
KEPT_WORDS = 200_000
#: Parts of a language from which its sample is drawn.
PARTS = 16


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # languages x languages


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in a row, A-Z lower-cased, and where each word's begin."""
    size = np.array([len(w) for w in words])
    buf = np.frombuffer(b"".join(words).lower(), np.uint8).astype(np.uint64) + np.uint64(1)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    word = np.repeat(np.arange(len(words)), size)
    mult = np.uint64(0x9E3779B97F4A7C15)
    found, owner = [], []

    def add(h: np.ndarray, kind: int, who: np.ndarray) -> None:
        h = (h + np.uint64(kind)) * mult
        found.append(((h ^ (h >> np.uint64(29))) * mult >> np.uint64(64 - 15)).astype(np.int64) % FEATURES)
        owner.append(who)

    gram = np.zeros(len(buf), np.uint64)
    for n in range(1, max(*GRAMS, AFFIX) + 1):
        # gram[i]: the n bytes from i; whole when they lie in i's word
        last = np.arange(len(buf)) + n - 1
        ok = last < np.repeat(begin + size, size)
        gram[ok] = gram[ok] * np.uint64(257) + buf[last[ok]]
        if n in GRAMS:
            add(gram[ok], 101 * n, word[ok])
        if n <= AFFIX:
            has = np.flatnonzero(size >= n)
            add(gram[begin[has]], 101 * n + 7, has)
            add(gram[begin[has] + size[has] - n], 101 * n + 13, has)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x100000001B3, np.uint64))
    at = np.arange(len(buf)) - np.repeat(begin, size)
    add(np.add.reduceat(buf * power[at], begin), 5, np.arange(len(words)))
    owner_all, found_all = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner_all, kind="stable")
    return found_all[order], np.searchsorted(owner_all[order], np.arange(len(words)))


def emissions(words: list[bytes], weights: np.ndarray, most: int = 10_000) -> np.ndarray:
    out = [np.zeros((0, weights.shape[1]))]
    for a in range(0, len(words), most):
        f, begin = features(words[a : a + most])
        count = np.diff(np.r_[begin, len(f)])
        out.append(np.add.reduceat(weights[f], begin, axis=0) / np.sqrt(count)[:, None])
    return np.concatenate(out)


def steps(em: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over rows of segments, em: segments x time x languages. Marginals, pair sums, log partition."""
    n, time, k = em.shape
    top = em.max(axis=2, keepdims=True)
    e = np.exp(em - top)
    m = np.exp(moves)
    fwd, bwd, scale = np.empty_like(e), np.empty_like(e), np.empty((n, time))
    a = e[:, 0] / k
    for t in range(time):
        if t:
            a = (a @ m) * e[:, t]
        scale[:, t] = a.sum(axis=1)
        a = a / scale[:, t, None]
        fwd[:, t] = a
    b = np.ones((n, k))
    bwd[:, -1] = b
    pairs = np.zeros((k, k))
    for t in range(time - 2, -1, -1):
        x = e[:, t + 1] * b / scale[:, t + 1, None]
        pairs += fwd[:, t].T @ x
        b = x @ m.T
        bwd[:, t] = b
    return fwd * bwd, pairs * m, (np.log(scale).sum(axis=1) + top[:, :, 0].sum(axis=1))


def fit(rows: list[tuple[bytes, str]], rounds: int = 3, batch: int = 128, seed: int = 7) -> Field:
    """A field from (text, language) rows."""
    langs = sorted({lang for _, lang in rows})
    k, rng = len(langs), np.random.default_rng(seed)
    cuts = []
    for text, lang in rows:
        w = text.split()
        for a in range(0, len(w), SEGMENT // 2):
            cuts.append((w[a : a + SEGMENT // 2], langs.index(lang)))
    if not k or not cuts:
        return Field([], np.zeros((FEATURES, 1), np.float32), np.zeros((1, 1)))
    share = np.bincount([y for _, y in cuts], minlength=k)
    weights, moves = np.zeros((FEATURES, k)), np.zeros((k, k))
    g_w, g_m = np.full((FEATURES, k), 1e-3), np.full((k, k), 1e-3)
    # each language is seen as often as any other
    chance = np.array([1 / share[y] for _, y in cuts])
    chance /= chance.sum()
    for _ in range(max(LEAST_STEPS, rounds * min(len(cuts), 20_000) // (2 * batch))):
        pick = rng.choice(len(cuts), (batch, 2), p=chance)
        # mostly one language a segment, as in texts; else a switch in its middle
        stay = rng.random(batch) < 0.8
        by_lang = np.array([y for _, y in cuts])
        for r in np.flatnonzero(stay):
            same = by_lang[pick[r, 0]]
            nxt = pick[r, 0] + 1
            pick[r, 1] = nxt if nxt < len(cuts) and by_lang[nxt] == same else pick[r, 0]
        flat, y = [], np.zeros((batch, SEGMENT), np.int64)
        for r in range(batch):
            at = 0
            for half in pick[r]:
                w, lang = cuts[half]
                w = (w * (SEGMENT // 2 // len(w) + 1))[: SEGMENT // 2]
                flat += w
                y[r, at : at + len(w)] = lang
                at += len(w)
        f, begin = features(flat)
        count = np.diff(np.r_[begin, len(f)])
        norm = 1 / np.sqrt(count)
        em = (np.add.reduceat(weights[f], begin, axis=0) * norm[:, None]).reshape(batch, SEGMENT, k)
        marginal, pairs, _ = steps(em, moves)
        grad = np.eye(k)[y] - marginal
        per = np.repeat(grad.reshape(-1, k) * norm[:, None], count, axis=0)
        d_w = np.stack([np.bincount(f, per[:, c], FEATURES) for c in range(k)], axis=1) / batch - 1e-5 * weights
        d_m = -pairs
        np.add.at(d_m, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d_m = d_m / batch - 1e-3 * moves
        g_w += d_w**2
        g_m += d_m**2
        weights += 0.5 * d_w / np.sqrt(g_w)
        moves += 0.2 * d_m / np.sqrt(g_m)
    return Field(langs, weights.astype(np.float32), moves)


def document_marginals(em: np.ndarray, length: np.ndarray, moves: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Sum of word marginals of each document, em: the words of all documents in a row.

    Texts are cut into segments of SEGMENT words. The segments' transfer matrices are made for all at once; carrying a
    document's state over its segments is then a short loop, and the words inside all segments are again done at once.
    """
    k = em.shape[1]
    n_seg = -(-length // SEGMENT)
    seg_doc = np.repeat(np.arange(len(length)), n_seg)
    seg_no = np.arange(len(seg_doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    begin = np.repeat(np.cumsum(length) - length, n_seg) + seg_no * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(length, n_seg) - seg_no * SEGMENT)
    e = np.exp(em - em.max(axis=1, keepdims=True))
    at = begin[:, None] + np.arange(SEGMENT)
    inside = np.arange(SEGMENT) < size[:, None]
    x = np.where(inside[:, :, None], e[np.minimum(at, len(e) - 1)], 1.0)
    m = np.exp(moves - moves.max())
    eye = np.eye(k)
    # transfer[s]: from the state before the segment to the state at its end; steps past the end do nothing
    transfer = np.broadcast_to(eye, (len(seg_doc), k, k)).copy()
    for t in range(SEGMENT):
        go = np.flatnonzero(inside[:, t])
        if not len(go):
            break
        new = (transfer[go].reshape(-1, k) @ m).reshape(-1, k, k) * x[go, t, None, :]
        transfer[go] = new / new.max(axis=(1, 2), keepdims=True)
    before, after = np.ones((len(seg_doc), k)) / k, np.ones((len(seg_doc), k))
    first = np.cumsum(n_seg) - n_seg
    for s in range(1, int(n_seg.max(initial=0))):
        i = first[n_seg > s] + s
        v = np.einsum("nk,nkj->nj", before[i - 1], transfer[i - 1])
        before[i] = v / v.sum(axis=1, keepdims=True)
    for s in range(int(n_seg.max(initial=0)) - 2, -1, -1):
        i = first[n_seg > s + 1] + s
        v = np.einsum("nkj,nj->nk", transfer[i + 1], after[i + 1])
        after[i] = v / v.sum(axis=1, keepdims=True)
    fwd = np.empty_like(x)
    a = before
    for t in range(SEGMENT):
        new = (a @ m) * x[:, t]
        new /= new.sum(axis=1, keepdims=True)
        a = np.where(inside[:, t, None], new, a)
        fwd[:, t] = a
    out = np.zeros((len(length), k))
    b = after
    lettered = letters[np.minimum(at, len(e) - 1)] & inside
    for t in range(SEGMENT - 1, -1, -1):
        p = fwd[:, t] * b
        p /= p.sum(axis=1, keepdims=True)
        p = p * lettered[:, t, None]
        for c in range(k):
            out[:, c] += np.bincount(seg_doc, p[:, c], len(length))
        new = (x[:, t] * b) @ m.T
        new /= new.sum(axis=1, keepdims=True)
        b = np.where(inside[:, t, None], new, b)
    return out


class Scorer:
    """Scores texts; keeps the emissions of words that it has seen."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}
        self.table = np.zeros((0, len(field.langs)), np.float32)
        self.letters = np.zeros(0, bool)

    def scores(self, raw: list[bytes | None]) -> list[tuple[str, float]]:
        split = [(t or b"").split() for t in raw]
        new = list({w for ws in split for w in ws}.difference(self.known))
        if len(new) + len(self.known) > KEPT_WORDS:
            self.known, self.table, self.letters = {}, self.table[:0], self.letters[:0]
            new = list({w for ws in split for w in ws})
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        if new:
            self.table = np.concatenate([self.table, emissions(new, self.field.weights).astype(np.float32)])
            self.letters = np.r_[self.letters, [LETTER.search(w.decode("utf-8", "replace")) is not None for w in new]]
        length = np.array([len(ws) for ws in split])
        known = self.known
        at = np.array([known[w] for ws in split for w in ws], np.int64)
        sums = np.zeros((len(raw), len(self.field.langs)))
        has = np.flatnonzero(length)
        if len(has):
            sums[has] = document_marginals(self.table[at].astype(np.float64), length[has], self.field.moves, self.letters[at])
        out = []
        for row in sums:
            total = row.sum()
            best = int(np.argmax(row))
            out.append((self.field.langs[best], float(min(1.0, row[best] / total))) if total > 0 else ("und", 0.0))
        return out


def remainder(doc_id: Column, mod: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(mod))


def train(docs: DataFrame, per_lang: int = 400, held_out: tuple[int, int] = (3, 1)) -> Field:
    """Learns from rows with a text and a language whose crc32 of the id has another remainder than the one held out."""
    mod, rest = held_out
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), mod) != rest))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    # the first of each part of a language, then the first of these: no task sees more of a language than PARTS times per_lang
    ids = usable.select("doc_id", F.col("lang").cast("string").alias("lang")).withColumn("_part", F.pmod(order[0], F.lit(PARTS)))
    first = ids.withColumn("_n", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_n") <= per_lang)
    first = first.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("_n") <= per_lang)
    picked = first.select("doc_id").distinct()
    # per_lang ids of each language at most, so they are sent to the texts, not the texts to them; one text of each id
    texts = usable.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(picked), "doc_id", "left_semi")
    rows = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["lang"], r["text"]))
    return fit([(r["text"].encode(), r["lang"]) for r in rows])


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """docs with lang_pred and score; own columns of these names come as `lang_pred_in` and `score_in`."""
    docs = set_apart(docs, "lang_pred", "score")
    columns = docs.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(field)  # sent with the function; its size is fixed, FEATURES x languages
        for batch, raw in byte_batches(batches):
            if field.langs:
                found = scorer.scores(raw)
            else:
                found = [("und", 0.0)] * len(raw)
            lang, score = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), lang, score], [*columns, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(go, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    out = identify(own, train(docs))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
