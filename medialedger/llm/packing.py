"""Token sequences of fixed length, packed with documents by bounded-space best fit.

Documents become ids of a public tokenizer and an end mark; what is longer than a sequence is cut into pieces, nothing else
is. Pieces then come to tasks in random order (by a hash of their number), and each task packs its own online: a fixed number
of bins is open, a bitset has a bit for every free space that an open bin has, and a piece goes where the least space is left.
If none has room, a new bin is opened; if all bins are in use, the fullest closes first. Pieces of bins that are open at a task's
end are packed again, together with those of other tasks, in fewer and fewer tasks, so that only the last task's bins
stay partly empty. Arrivals are taken in windows of twice as many pieces as bins, the longest of a window first. Only numbers and lengths are packed; other columns join their sequence afterwards, by number.

Ids are those of the `tokenizers` library: its splits never join what ASCII white space or a border between plain letters and
plain punctuation separates, so each distinct part is encoded once by a worker, and texts are put together from parts. The
names of special tokens in a text are ordinary text.

Defined cases: a null text is an empty one and has the end mark alone; rows that share an id, or have none, are packed each;
a null length counts as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, saved, table

CAPACITY, END_ID = 2048, 0
#: Open bins of a task, and pieces that one task packs.
OPEN_BINS, TASK_PIECES = 1024, 200_000
#: Words and parts that a worker remembers at most (the first it meets), and the longest that it does.
MEMORY, LONGEST = 1_000_000, 48
_LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
#: Letters before white space, plain punctuation or the end; punctuation or digits before a letter, white space or the end, unless
#: an apostrophe begins what follows; else all up to white space.
PART = re.compile(_LETTER + rb"++(?=[\x09-\x0d !-@\[-`{-~]|$)|[!-@\[-`{-~]++(?:(?=[\x09-\x0d ]|$)|(?<!')(?=" + _LETTER + rb"))|[^\x09-\x0d ]++")
#: Small letters that are one word of the tokenizer, whatever its tables of characters are.
PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+\Z")


def encoder(vocabulary: str):
    """A function from the bytes of a text to its ids, as little-endian 32-bit numbers. vocabulary: the tokenizer's JSON."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    whole = Tokenizer.from_str(vocabulary)
    whole.encode_special_tokens = True
    model = whole.model
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    spelt = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}

    class Parts(dict):
        def __missing__(self, part: bytes) -> bytes:
            text = part.decode("utf-8", "replace")
            if PLAIN.match(text):
                ids = [t.id for t in model.tokenize(text if text.isascii() else text.translate(spelt))]
            else:
                ids = whole.encode(text, add_special_tokens=False).ids
            out = array("I", ids).tobytes()
            if len(self) < MEMORY and len(part) <= LONGEST:
                self[part] = out
            return out

    class Words(dict):
        def __missing__(self, word: bytes) -> bytes:
            low = word.lower()
            out = parts[low] if low.isalpha() else b"".join(map(parts.__getitem__, PART.findall(low)))
            if len(self) < MEMORY and len(word) <= LONGEST:
                self[word] = out
            return out

    parts, words = Parts(), Words()
    return lambda text: b"".join(map(words.__getitem__, text.split()))


def tokenized(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) of all documents: pieces of at most `capacity` ids, in little-endian 32-bit numbers.

    vocabulary: the path of a tokenizer's file on the driver; executors get its content.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    with open(vocabulary, encoding="utf-8") as f:
        content = json.dumps(json.load(f))
    # a worker keeps its copy between tasks, and with it the parts that it has encoded
    kept = docs.sparkSession.sparkContext.broadcast({"json": content})
    mark, width = int(end).to_bytes(4, "little"), 4 * capacity

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.value
        if "encode" not in own:
            own["encode"] = encoder(own["json"])
        encode = own["encode"]
        for batch, raw in byte_batches(batches):
            row, start, ids = [], [], []
            for k, text in enumerate(raw):
                out = encode(text or b"") + mark
                for a in range(0, len(out), width):
                    row.append(k)
                    start.append(a // 4)
                    ids.append(out[a : a + width])
            begin = np.array(start, np.int64)
            length = np.array([len(x) // 4 for x in ids], np.int64)
            doc = batch.column("doc_id").take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([doc, pa.array((begin // capacity).astype(np.int32)), pa.array(begin), pa.array(length), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(go, f"doc_id {kind}, piece int, start long, length long, ids binary")


class Bins:
    """At most `most` open bins. `spaces` has bit s if one of them has s free; `at[s]` are those."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.spaces, self.open, self.made = capacity, most, 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def taken(self, space: int) -> int:
        got = self.at[space].pop()
        if not self.at[space]:
            self.spaces ^= 1 << space
        self.open -= 1
        return got

    def place(self, size: int) -> tuple[int, int]:
        """The bin that gets a piece, and where in it."""
        fits = self.spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            got = self.taken(space)
        else:
            if self.open >= self.most:
                self.taken((self.spaces & -self.spaces).bit_length() - 1)
            got, space = self.made, self.capacity
            self.made += 1
        left = space - size
        if left:
            if not self.at[left]:
                self.spaces |= 1 << left
            self.at[left].append(got)
            self.open += 1
        return got, self.capacity - space

    def still_open(self) -> set[int]:
        return {b for bins in self.at for b in bins}


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """pieces with `sequence_id` and `offset` (columns of these names are replaced): sequences of at most `capacity`, without gaps.

    A piece longer than that is an error. Numbers of rows come from a written table, so tasks that run again pack alike.
    """
    rows = saved(pieces.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()), "pieces")
    slots, left, round_ = [], rows.select("_row", F.coalesce("length", F.lit(0)).cast("long").alias("length")), 0
    n = max(1, -(-left.count() // task_pieces))
    while True:
        last = n == 1
        packed = saved(packed_once(left, n, round_, capacity, open_bins, last), "packed")
        slots.append(packed.where("sequence_id is not null").select("_row", "sequence_id", "offset"))
        if last:
            break
        left = packed.where("sequence_id is null").select("_row", "length")
        n = max(1, min(-(-left.count() // task_pieces), n // 2))
        round_ += 1
    placed = slots[0]
    for more in slots[1:]:
        placed = placed.unionByName(more)
    return rows.join(placed, "_row").drop("_row")


def packed_once(left: DataFrame, tasks: int, round_: int, capacity: int, open_bins: int, last: bool) -> DataFrame:
    """(_row, length, sequence_id, offset): one packing of rows (_row, length) by so many tasks; ids are null in bins that are open at
    the end, unless it is the last.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column("_row")), np.asarray(b.column("length"))) for b in batches if b.num_rows]
        if not got:
            return
        row, size = (np.concatenate(x) for x in zip(*got, strict=True))
        if size.max() > capacity:
            raise ValueError(f"a piece of {size.max()} is longer than a sequence")
        bins, bin_, offset = Bins(capacity, open_bins), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for a in range(0, len(row), 2 * open_bins):
            longest = a + np.argsort(-size[a : a + 2 * open_bins], kind="stable")
            placed = np.array([bins.place(s) for s in size[longest].tolist()], np.int64)
            bin_[longest], offset[longest] = placed[:, 0], placed[:, 1]
        again = np.zeros(bins.made, bool)
        if not last:
            again[list(bins.still_open())] = True
        # one number for each round, task and bin
        number = (np.int64(round_) << 56) + (np.int64(TaskContext.get().partitionId()) << 32) + bin_
        open_ = again[bin_]
        for a in range(0, len(row), 50_000):
            z = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(row[z]), pa.array(size[z]), pa.array(number[z], mask=open_[z]), pa.array(offset[z], mask=open_[z])], ["_row", "length", "sequence_id", "offset"])

    order = F.xxhash64("_row", F.lit(round_))
    dealt = left.withColumns({"_task": F.pmod(order, F.lit(tasks)), "_order": F.xxhash64(order)})
    dealt = dealt.repartition(tasks, "_task").sortWithinPartitions("_order", "_row").select("_row", "length")
    return dealt.mapInArrow(go, "_row long, length long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, documents) from packed pieces with their ids: the ids of each sequence in a row, and the
    places where its pieces begin. A sequence is never longer than the capacity, so its pieces are few.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts"))
    ids = F.aggregate("_parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    documents = F.transform("_parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return whole.select("sequence_id", "length", ids.alias("ids"), documents.alias("documents"))


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    pieces = tokenized(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = pack(pieces)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
