"""Text search over cards by posting lists of three bytes, kept in segments: what a card is searched in is never shuffled."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import search_blob
from .report import card_filter

GRAM = 3
POSTINGS = "gram int, segment long, cards binary"
#: Cards of a segment at most, so that two bytes tell them apart, and bytes of text that are sorted at once.
CARDS, BYTES = 1 << 14, 1 << 22
#: Rows of a page: a reader skips the pages of other lists.
PAGE_ROWS = 32


def searched_text() -> Column:
    """What a card is searched in: its search text, and its tags between bars."""
    tags = F.concat(F.lit("|"), F.lower(F.array_join("tags", "|")), F.lit("|"))
    return F.concat_ws("\0", search_blob(), tags)


def codes(text: bytes | np.ndarray) -> np.ndarray:
    """Every three bytes of a text as a number."""
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def posted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram, card): the distinct grams of each text, by gram, then card."""
    edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    found, start = [], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(edge, edge[start] + BYTES)) - 1)
        size = np.diff(edge[start : end + 1])
        if edge[end] - edge[start] >= GRAM:
            card = np.repeat(np.arange(start, end), size)[: 1 - GRAM]
            inside = np.arange(edge[start], edge[end] + 1 - GRAM) <= edge[card + 1] - GRAM
            grams = codes(np.frombuffer(texts.buffers()[2], np.uint8)[edge[start] : edge[end]])
            found.append(np.unique(grams[inside].astype(np.int64) << 16 | card[inside]))
        start = end
    both = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    return both >> 16, both & 0xFFFF


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posting lists of each batch of (path, text), sorted by gram; under gram -1 its paths."""
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for first in range(0, whole.num_rows, CARDS):
            batch = whole.slice(first, CARDS)
            gram, card = posted(batch.column("text").cast(pa.string()))
            start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, np.int64)
            # gaps between a list's cards, as those of frequent grams are alike
            gap = np.diff(card, prepend=0)
            gap[start] = card[start]
            edge = np.r_[start, len(gram)].astype(np.int32) * 2
            lists = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(gap.astype("<u2"))])
            names = pa.array([json.dumps(batch.column("path").to_pylist()).encode()], pa.binary())
            columns = [pa.array(np.r_[-1, gram[start]].astype(np.int32)), pa.array(np.full(len(start) + 1, number)), pa.concat_arrays([names, lists])]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "segment", "cards"])
            number += 1


def write_index(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Posting lists of segments, one for each batch of cards as they lie; pages are short, so that a reader skips other lists."""
    lists = rows.select("path", searched_text().alias("text")).mapInArrow(_segments, POSTINGS)
    pages = {"parquet.page.row.count.limit": PAGE_ROWS, "parquet.page.size.row.check.min": PAGE_ROWS}
    lists.write.options(**pages, compression="zstd").mode(mode).parquet(path)


def cover(term: bytes) -> list[int]:
    """The fewest grams that hold every byte of a term."""
    last = len(term) - GRAM
    return sorted({int(codes(term)[k]) for k in [*range(0, last, GRAM), last]})


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path of the cards that are in all lists of their segment."""
    for b in batches:
        for lists, names in zip(b.column("lists").to_pylist(), b.column("names").to_pylist(), strict=True):
            cards = None
            for x in lists:
                own = np.cumsum(np.frombuffer(x, "<u2"), dtype=np.int64)
                cards = own if cards is None else np.intersect1d(cards, own, assume_unique=True)
            paths = json.loads(names)
            yield pa.RecordBatch.from_arrays([pa.array([paths[k] for k in cards], pa.string())], ["path"])


def find(spark: SparkSession, index: str, term: str) -> DataFrame:
    """path of each card that has all grams of a term, from their posting lists alone. Few have the grams and not the term, which
    only their texts tell.

    A term of less than three letters has no list: `card_filter` finds it by reading all cards.
    """
    low = term.lower()
    if len(low) < GRAM:
        raise ValueError(f"a term of {len(low)} letters has no posting list")
    grams = cover(low.encode())
    read = spark.read.schema(POSTINGS).parquet(index)
    lists = read.where(F.col("gram").isin(grams)).groupBy("segment").agg(F.collect_list("cards").alias("lists")).where(F.size("lists") == len(grams))
    names = read.where("gram = -1").select("segment", F.col("cards").alias("names"))
    return lists.join(names, "segment").select("lists", "names").mapInArrow(_common, "path string").distinct()


def search_cards(rows: DataFrame, index: str, term: str, condition: Column) -> DataFrame:
    """rows with tags that meet the condition and have the term."""
    if not term:
        return rows.where(condition)
    out = rows.where(condition & card_filter(duplicates=True, text=term))
    return out if len(term) < GRAM else out.join(find(rows.sparkSession, index, term), "path", "left_semi")
