"""Best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import key_bucket, running_total_before, stored
from wayline.llm.packing_plan import Run, plan
from wayline.llm.tokens import ids_of

#: Rows of a plan (40 bytes each) up to which it is broadcast.
MOST_PLACES = 1_000_000
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int, ranks_path: str, end_id: int = 0) -> DataFrame:
    """Tokenises whole texts and cuts those longer than `capacity`; the first piece is the one that may be shorter."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[int | None]] = [[] for _ in range(6)]
            for doc_id, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.array([*ids_of(text.as_py() or "", ranks_path), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    part = ids[start:end]
                    for column, value in zip(rows, (doc_id, copy, piece, start, len(part), zlib.crc32(part.tobytes()))):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(pieces, PIECES)


def places_of(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, last_rank, first_sequence, offset): where the pieces of a length go, in the order of their ranks."""
    ranks: dict[int, int] = defaultdict(int)
    places, sequence = [], 0
    for run in sorted(runs, key=lambda r: (r.lengths, r.count)):
        offset = 0
        for length in run.lengths:
            places.append((length, ranks[length], ranks[length] + run.count - 1, sequence, offset))
            ranks[length] += run.count
            offset += length
        sequence += run.count
    return places


def pack_documents(docs: DataFrame, ranks_path: str, capacity: int = 2048, groups: int = 256) -> DataFrame:
    """Packs all documents into few sequences of at most `capacity` tokens.

    A document is the ids of its whole text by the byte-level BPE vocabulary at `ranks_path`, then id 0. Only longer
    ones are cut. The driver sees the histogram of piece lengths (at most `capacity` numbers) and plans on it: linear
    grouping of large lengths, configurations of the few rounded sizes, actual lengths in their places, best fit for
    the rest (see `packing_plan`). Each piece then finds its place by its rank among the pieces of its length.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, copy (tells rows that
    repeat a doc_id apart; any number).

    Defined cases: a null text is the empty one, which is the id 0 alone; rows that repeat are packed each; a null
    doc_id stays null; extra columns are ignored; an empty table gives no rows.
    """
    pieces = stored(pieces_of(docs, capacity, ranks_path), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = places_of(plan(histogram, capacity, groups))
    places = docs.sparkSession.createDataFrame(planned, "length long, first_rank long, last_rank long, first_sequence long, offset long")
    keyed = pieces.withColumn("key", F.md5(F.concat_ws(":", "doc_id", "piece", "ids_crc32"))).withColumn("bucket", key_bucket("key", sum(histogram.values()))).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total_before(keyed, ["length"], "bucket", ["key", "copy"], "one", "rank")
    found = (ranked["length"] == places["length"]) & ranked["rank"].between(places["first_rank"], places["last_rank"])
    # The plan's size depends on the capacity and the number of groups alone; every task has it while it is small.
    return ranked.join(F.broadcast(places) if len(planned) <= MOST_PLACES else places, found).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset", "copy"
    )
