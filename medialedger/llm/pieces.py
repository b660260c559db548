"""SentencePiece encoding and decoding by a Viterbi pass over batches of words.

Words of equal length advance together: for each end position all spans that end there are looked up at once (a polynomial
hash of each span probes the sorted hashes of the pieces), vectorised maxima over the spans' starts are kept, and the starts
are the backpointers. In a unigram model a path's value is the sum of its pieces' scores. In a BPE model, where the sum of
scores is not what merging gives, a step between neighbouring pieces is allowed only if merging would leave their border
alone: undoing the later merge of the two sides again and again, no piece across the border may come before the merge that
is undone. One path remains then, and it is the one that merging gives.

Texts are cut into words between characters that stand next to each other in no piece: no token crosses such a border, so each
word is encoded by itself, once, and kept for later texts.

Defined cases: null and empty texts have no ids; characters without a piece become byte pieces (or the unknown id where the
model has none); words of any length are encoded whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches, set_apart, table

MARK = "▁"
PUBLIC_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FAR = np.int64(1 << 40)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Cells of a batch's span table, and words that a task keeps.
CELLS, KEPT_WORDS = 1_000_000, 400_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


def _varint(b: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 0x80:
            return x, at


def message(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = b[at : at + n], at + n
        yield key >> 3, value


class Pieces:
    """A model's pieces: sorted span hashes with id, score, merge rank and the place of the last merge."""

    def __init__(self, entries: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.text = [e[0] for e in entries]
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.byte_ids = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(entries) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next((i for i, e in enumerate(entries) if e[2] == UNKNOWN), 0)
        usable = [i for i, e in enumerate(entries) if e[2] in (NORMAL, USER) and e[0]]
        order = {i: r for r, i in enumerate(sorted(usable, key=lambda i: (-entries[i][1], i)))}
        self.longest = max((len(self.text[i]) for i in usable), default=1)
        # characters of longer pieces by class, and the classes that stand next to each other in a piece
        pairs = {(ord(a), ord(b)) for i in usable for a, b in zip(self.text[i], self.text[i][1:], strict=False)}
        known = sorted({c for x in pairs for c in x})
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[known] = np.arange(1, len(known) + 1)
        self.joined = np.zeros((len(known) + 1, len(known) + 1), bool)
        for a, b in pairs:
            self.joined[self.class_of[a], self.class_of[b]] = True
        rank_of = {self.text[i]: order[i] for i in usable}
        split = {i: self._last_merge(self.text[i], rank_of) if kind == BPE else 0 for i in usable}
        hashes = np.array([span_hash(self.text[i]) for i in usable], np.uint64)
        at = np.argsort(hashes)
        ids = np.array(usable, np.int64)[at]
        self.keys = hashes[at]
        # a last entry stands for spans that are no piece
        self.id = np.r_[ids, -1]
        self.score = np.r_[[entries[i][1] for i in ids], -np.inf]
        self.rank = np.r_[[order[i] for i in ids], FAR].astype(np.int64)
        self.split = np.r_[[split[i] for i in ids], 0].astype(np.int64)
        self.lost = float(min((entries[i][1] for i in usable), default=0.0)) - 10.0
        self.words: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _last_merge(piece: str, rank_of: dict[str, int]) -> int:
        """Where the merge that completes a piece joins its halves; 0 for one character; -1 if merging never makes it."""
        ends, last = list(range(len(piece) + 1)), 0
        while len(ends) > 2:
            found = [(rank_of[piece[ends[k] : ends[k + 2]]], k) for k in range(len(ends) - 2) if piece[ends[k] : ends[k + 2]] in rank_of]
            if not found:
                return -1
            k = min(found)[1]
            last = ends.pop(k + 1)
        return last

    def sent(self, spark: SparkSession) -> Broadcast:
        """For the tasks, as a dictionary of plain values: the size of the vocabulary, whatever the corpus."""
        return spark.sparkContext.broadcast(self.__dict__ | {"words": {}, "flat": np.zeros(0, np.int32), "starts": np.zeros(1, np.int64)})

    @classmethod
    def received(cls, values: dict) -> Pieces:
        """In a task. Words encoded by one task are kept for the worker's next."""
        p = object.__new__(cls)
        p.__dict__ = values
        return p


def span_hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
    return h


def load(path: str = PUBLIC_MODEL) -> Pieces:
    """Reads a model file, whose normalisation must be the identity."""
    with open(path, "rb") as f:
        raw = f.read()
    entries, kind, dummy = [], UNIGRAM, True
    for field, value in message(raw):
        if field == 1:
            e = dict(message(value))
            entries.append((e[1].decode(), struct.unpack("<f", e.get(2, b"\0\0\0\0"))[0], e.get(3, NORMAL)))
        elif field == 2:
            kind = dict(message(value)).get(3, UNIGRAM)
        elif field == 3:
            norm = dict(message(value))
            dummy = bool(norm.get(3, 1))
            if norm.get(2) or norm.get(4, 1):
                raise ValueError("only models without normalisation rules are supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return Pieces(entries, kind, dummy)


def span_table(codes: np.ndarray, p: Pieces) -> np.ndarray:
    """table[w, i, n - 1]: the piece of n characters from i of word w, or the last entry."""
    n, length = codes.shape
    out = np.full((n, length, min(length, p.longest)), len(p.keys), np.int32)
    h = np.zeros((n, length), np.uint64)
    for size in range(1, out.shape[2] + 1):
        m = length - size + 1
        h = h[:, :m] * BASE + codes[:, size - 1 : size - 1 + m] + np.uint64(1)
        at = np.minimum(np.searchsorted(p.keys, h), len(p.keys) - 1)
        out[:, :m, size - 1] = np.where(p.keys[at] == h, at, len(p.keys))
    return out


def _border_stays(spans: np.ndarray, p: Pieces, row: np.ndarray, s: np.ndarray, i: int, e: int) -> np.ndarray:
    """Whether merging leaves the border at i between the pieces [s, i) and [i, e) alone."""
    ok = np.zeros(len(row), bool)
    live, s, e, limit = np.arange(len(row)), s.copy(), np.full(len(row), e), np.full(len(row), FAR + 1)
    longest = spans.shape[2]
    while len(live):
        r, a, z, lim = row[live], s[live], e[live], limit[live]
        short = z - a <= longest
        across = np.where(short, p.rank[spans[r, a, np.minimum(z - a, longest) - 1]], FAR)
        left, right = spans[r, a, i - a - 1], spans[r, i, z - i - 1]
        rank1, rank2 = np.where(i - a == 1, -1, p.rank[left]), np.where(z - i == 1, -1, p.rank[right])
        stays = ~((across < FAR) & (across < lim))
        whole = (rank1 < 0) & (rank2 < 0)
        ok[live[stays & whole]] = True
        first = rank1 > rank2
        s[live] = np.where(first, a + p.split[left], a)
        e[live] = np.where(first, z, i + p.split[right])
        limit[live] = np.where(first, rank1, rank2 + 1)
        live = live[stays & ~whole]
    return ok


def viterbi(codes: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(spans, back) for words of equal length: back[w, j] is where the best path's piece that ends at j starts."""
    n, length = codes.shape
    spans = span_table(codes, p)
    longest = spans.shape[2]
    back = np.zeros((n, length + 1), np.int32)
    value = np.full((n, length + 1), -np.inf)
    value[:, 0] = 0
    rows = np.arange(n)
    for j in range(1, length + 1):
        if p.kind == UNIGRAM:
            starts = np.arange(max(0, j - longest), j)
            step = p.score[spans[:, starts, j - starts - 1]]
            step[:, -1] = np.where(np.isinf(step[:, -1]), p.lost, step[:, -1])
            total = value[:, starts] + step
            best = np.argmax(total, axis=1)
            value[:, j], back[:, j] = total[rows, best], starts[best]
            continue
        todo = rows
        for i in range(max(0, j - longest), j):
            if not len(todo):
                break
            piece = spans[todo, i, j - i - 1]
            may = todo[(piece < len(p.keys)) & (p.split[piece] >= 0)] if j - i > 1 else todo
            if i and len(may):
                may = may[_border_stays(spans, p, may, back[may, i].astype(np.int64), i, j)]
            if len(may):
                back[may, j] = i
                left = np.ones(n, bool)
                left[may] = False
                todo = todo[left[todo]]
        back[todo, j] = j - 1
    return spans, back


def encode_words(words: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, number of ids of each word)."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    owners, starts, found = [], [], []
    for length, which in by_length.items():
        if not length:
            continue
        most = max(1, CELLS // (length * min(length, p.longest)))
        for a in range(0, len(which), most):
            part = which[a : a + most]
            codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), length).astype(np.uint64)
            spans, back = viterbi(codes, p)
            end, rows, owner = np.full(len(part), length), np.arange(len(part)), np.array(part)
            while len(rows):
                start = back[rows, end[rows]]
                owners.append(owner[rows])
                starts.append(start.astype(np.int64) << 3)  # room for a character's bytes
                found.append(p.id[spans[rows, start, end[rows] - start - 1]])
                end[rows] = start
                rows = rows[start > 0]
    if not owners:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    owner, start, ids = np.concatenate(owners), np.concatenate(starts), np.concatenate(found)
    lost = np.flatnonzero(ids < 0)
    if len(lost) and p.byte_ids:
        more = [(o, s + k, p.byte_ids[b]) for o, s in zip(owner[lost].tolist(), start[lost].tolist(), strict=True) for k, b in enumerate(words[o][s >> 3].encode("utf-8", "surrogatepass"))]
        extra = np.array(more, np.int64)
        keep = ids >= 0
        owner, start, ids = np.r_[owner[keep], extra[:, 0]], np.r_[start[keep], extra[:, 1]], np.r_[ids[keep], extra[:, 2]]
    elif len(lost):
        ids[lost] = p.unknown
    order = np.lexsort((start, owner))
    return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))


def split_words(raw: list[str | None], p: Pieces) -> tuple[list[str], np.ndarray]:
    """(words of all texts in a row, number of words of each text)."""
    marked = [((MARK if p.dummy_prefix else "") + t.replace(" ", MARK)) if t else "" for t in raw]
    size = np.array(list(map(len, marked)), np.int64)
    whole = "".join(marked)
    if not whole:
        return [], np.zeros(len(raw), np.int64)
    kind = p.class_of[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")]
    cut = np.r_[True, ~p.joined[kind[:-1], kind[1:]], True]
    ends = np.cumsum(size)
    cut[ends] = True
    at = np.flatnonzero(cut)
    places = at.tolist()
    words = [whole[a:z] for a, z in zip(places, places[1:], strict=False)]
    return words, np.diff(np.r_[0, np.searchsorted(at, ends)])


def encode_batch(raw: list[str | None], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text)."""
    split, count = split_words(raw, p)
    new = list(set(split).difference(p.words))
    if len(new) + len(p.words) > KEPT_WORDS:
        p.words, p.flat, p.starts = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        new = list(set(split))
    if new:
        ids, size = encode_words(new, p)
        p.words.update(zip(new, range(len(p.words), len(p.words) + len(new)), strict=True))
        p.flat = np.concatenate([p.flat, ids])
        p.starts = np.r_[p.starts, p.starts[-1] + np.cumsum(size)]
    at = np.fromiter(map(p.words.__getitem__, split), np.int64, len(split))
    size = p.starts[at + 1] - p.starts[at]
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    ids = p.flat[np.repeat(p.starts[at], size) + offset]
    ends = np.r_[0, np.cumsum(size)]
    words = np.r_[0, np.cumsum(count)]
    return ids, ends[words[1:]] - ends[words[:-1]]


def decode(ids: list[int], p: Pieces) -> str:
    out: list[bytes] = []
    for i in ids:
        out.append(bytes([p.byte_of[i]]) if i in p.byte_of else p.text[i].encode())
    text = b"".join(out).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if p.dummy_prefix and text[:1] == " " else text


def encoded(docs: DataFrame, p: Pieces) -> DataFrame:
    """docs with `ids` (array of int), `n_ids`, and `round_trip`: whether decoding gives the text back.

    A text with word marks of its own is the one kind that decodes otherwise: the marks become spaces. Own columns of these
    names get `_in`.
    """
    model = p.sent(docs.sparkSession)
    docs = set_apart(docs, "ids", "n_ids", "round_trip")
    columns = docs.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.received(model.value)
        raw_pieces = np.array([bytes([p.byte_of[i]]) if i in p.byte_of else t.encode() for i, t in enumerate(p.text)], object)
        mark = MARK.encode()
        for batch, raw in byte_batches(batches):
            strings = [None if t is None else t.decode("utf-8", "replace") for t in raw]
            ids, count = encode_batch(strings, p)
            ends = np.r_[0, np.cumsum(count)]
            same = []
            for t, a, z in zip(raw, ends[:-1], ends[1:], strict=True):
                got = b"".join(raw_pieces[ids[a:z]].tolist()).replace(mark, b" ")
                same.append((got[1:] if p.dummy_prefix else got) == (t or b""))
            array = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), array, pa.array(count, pa.int64()), pa.array(same)], [*columns, "ids", "n_ids", "round_trip"])

    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return docs.mapInArrow(go, T.StructType([*docs.schema.fields, *more]))


def decoded(rows: DataFrame, p: Pieces) -> DataFrame:
    """rows with `decoded`, the text of `ids`; null for null."""
    model = p.sent(rows.sparkSession)
    rows = set_apart(rows, "decoded")
    columns = rows.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces.received(model.value)
        for batch in batches:
            out = [None if x is None else decode(x, p) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], [*columns, "decoded"])

    return rows.mapInArrow(go, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").cast("string"))
    return encoded(docs, load()).select("doc_id", "n_ids", "ids", "round_trip")
