"""Packing by concatenation: all documents end to end, cut into windows of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import broadcast_if_few, stored
from wayline.llm.tokens import encodings, ids_of

#: Partitions whose totals one task adds up; the totals of such blocks are added up after them.
BLOCK = 4096
#: Partitions up to which the table of their offsets is broadcast: 16 bytes each.
MOST_PARTS = 1_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, doc long"


def encoded(docs: DataFrame, ranks_path: str, end_id: int) -> DataFrame:
    """(part, doc, before, n, doc_id, ids): the ids of whole texts as little-endian bytes, and how many ids of the same partition come earlier."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(ranks_path)
        before: dict[int, int] = {}
        for batch in batches:
            starts, lengths, ids = [], [], []
            parts = batch.column("part").to_pylist()
            for part, text in zip(parts, batch.column("text")):
                own = np.array([*ids_of(text.as_py() or "", ranks_path), end_id], dtype=kind)
                starts.append(before.get(part, 0))
                lengths.append(len(own))
                ids.append(own.tobytes())
                before[part] = starts[-1] + len(own)
            arrays = [batch.column("part"), batch.column("doc"), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), batch.column("doc_id"), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "doc", "before", "n", "doc_id", "ids"])

    rows = docs.select(
        F.spark_partition_id().cast("long").alias("part"),
        F.monotonically_increasing_id().alias("doc"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(encode, "part long, doc long, before long, n long, doc_id long, ids binary")


def id_type(ranks_path: str) -> str:
    """Two bytes an id where the vocabulary allows it, else four."""
    return "<u2" if encodings(ranks_path)[0].n_vocab <= 1 << 16 else "<u4"


def offsets_of(parts: DataFrame) -> DataFrame:
    """(part, offset, total): how many ids stand in the partitions before, and in all; from (part, n).

    Two levels: totals of a block of partitions, added up in one small task, and totals of partitions inside their block.
    """
    sums = parts.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.expr(f"part div {BLOCK}"))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.join(starts, "block").select("part", (F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("offset"), "total")


def cuts_of(first: int, last: int, total: int, window: int) -> np.ndarray:
    """Where ids from place `first` to place `last` of `total` are cut: at `first`, `last` and all window edges between.

    Windows have one length; what is left at the end goes in windows of powers of two, largest first, which need no padding.
    """
    whole = total - total % window
    edges = [np.arange(first - first % window + window, min(last, whole + 1), window, dtype=np.int64)]
    if last > whole:
        edge, left = whole, total - whole
        while left:
            edge += 1 << (left.bit_length() - 1)
            left -= 1 << (left.bit_length() - 1)
            if first < edge < last:
                edges.append(np.array([edge], np.int64))
    return np.unique(np.concatenate([[first, last], *edges]))


def places_of(starts: np.ndarray, total: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset in it of the places `starts`."""
    whole = total - total % window
    sequence, offset = starts // window, starts % window
    edge, left, number = whole, total - whole, whole // window
    while left:
        size = 1 << (left.bit_length() - 1)
        own = (starts >= edge) & (starts < edge + size)
        sequence, offset = np.where(own, number, sequence), np.where(own, starts - edge, offset)
        edge, left, number = edge + size, left - size, number + 1
    return sequence, offset


def concatenate_and_cut(docs: DataFrame, ranks_path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Packs all documents into sequences of at most `window` tokens (a power of two) without any padding.

    A document is the ids of its whole text by the byte-level BPE vocabulary at `ranks_path`, then `end_id`. The first
    pass encodes and adds up ids by partition; prefix sums of these totals give every document its global place. The
    second pass cuts at every multiple of `window`: a document that crosses edges has a record for each of its windows.
    No ids are shuffled. The ids after the last full window go in sequences of powers of two, one for each binary digit.

    Returns one row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (unsigned, of
    little-endian unsigned 32-bit ids), doc_tokens (with the last id), sequence_id, offset (gapless from 0), and doc
    (tells rows that repeat a doc_id apart; any number).

    Defined cases: a null text is the empty one, which is `end_id` alone; rows that repeat are packed each; a null doc_id
    stays null; extra columns, whatever their names, are ignored; an empty table gives no rows.
    """
    if window < 1 or window & (window - 1):
        raise ValueError(f"window must be a power of two, not {window}")
    rows = stored(encoded(docs, ranks_path, end_id), "ids")
    offsets = offsets_of(rows.select("part", "n"))
    placed = rows.join(broadcast_if_few(stored(offsets, "offsets"), MOST_PARTS), "part")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(ranks_path)
        types = [pa.int64()] * 8
        for batch in batches:
            found: list[list] = [[] for _ in types]
            numbers = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc", "n", "place", "total")))
            for (doc_id, doc, n, place, total), raw in zip(numbers, batch.column("ids")):
                ids = np.frombuffer(raw.as_py(), kind).astype("<u4")
                cuts = cuts_of(place, place + n, total, window)
                sequence, offset = places_of(cuts[:-1], total, window)
                starts, lengths = cuts[:-1] - place, np.diff(cuts)
                crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(starts.tolist(), lengths.tolist())]
                k = len(starts)
                for column, values in zip(found, ([doc_id] * k, starts, lengths, crc, [n] * k, sequence, offset, [doc] * k)):
                    column.extend(values)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "doc"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], names)

    return placed.select("doc_id", "doc", "n", (F.col("before") + F.col("offset")).alias("place"), "total", "ids").mapInArrow(cut, PIECES)
