"""SimHash near-duplicates, linked with the help of pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import bound, stored, words_of
from wayline.operators.components import connected_components
from wayline.operators.skew import salted_join

#: Reference fingerprints: fixed pseudo-random ones, so that every task has the same table.
PIVOTS = np.random.default_rng(20240229).integers(0, 2**64, size=24, dtype=np.uint64)


def shingle_hashes(text: Column, n: int = 3) -> Column:
    """XXH64 (seed 42) of each run of n words, A-Z lowered, space-joined; of all words if fewer; empty if none."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def of_words(words: Column) -> Column:
        shingle = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), shingle)
        return F.when(F.size(words) == 0, F.array().cast("array<long>")).otherwise(runs)

    return bound(words_of(lowered), of_words)


def majority_bits(hashes: np.ndarray) -> np.uint64:
    """The fingerprint whose bits are those set in over half of the hashes; zero for none."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[start : start + 65_536]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(row_key, fingerprint as a signed long) of each row; row_key is the doc_id."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            marks = np.array([majority_bits(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(marks.view(np.int64))], ["row_key", "fingerprint"])

    hashed = docs.select(F.col("doc_id").cast("long").alias("row_key"), shingle_hashes(F.col("text"), shingle).alias("hashes"))
    return hashed.mapInArrow(prints, "row_key long, fingerprint long")


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (uint64) to every pivot, one row each."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int16)


def link_block(prints: np.ndarray, blocks: np.ndarray, within: int) -> np.ndarray:
    """For each fingerprint the position of the first one that it is linked to, directly or through others of its block.

    `blocks` must be sorted. Pairs of a block whose distances to some pivot differ by more than `within` are discarded
    unseen, since no two fingerprints are nearer than that difference; the others are compared bit by bit.
    """
    table, label = pivot_table(prints), np.arange(len(prints))
    links: list[np.ndarray] = []
    for lag in range(1, len(prints)):
        i = np.flatnonzero(blocks[:-lag] == blocks[lag:])
        if not len(i):
            break
        for column in range(table.shape[1]):
            i = i[np.abs(table[i, column] - table[i + lag, column]) <= within]
        i = i[np.bitwise_count(prints[i] ^ prints[i + lag]) <= within]
        if len(i):
            links.append(np.stack([i, i + lag]))
    if links:
        a, b = np.concatenate(links, axis=1)
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return label


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(chunks: int) -> list[list[int]]:
    """Bits that blocks agree on, for each level of splitting.

    Of `chunks` chunks of the 64 bits, two fingerprints within 2 bits agree on at least `chunks` - 2, so each choice of
    that many makes blocks. The bits that a block leaves free are cut into three parts, of which two such fingerprints
    agree on at least one: its blocks of the next level. Mask m has the masks 3m to 3m + 2 there.
    """
    edges = np.linspace(0, 64, chunks + 1).astype(int)
    levels = [[sum(((1 << int(edges[c + 1])) - 1) ^ ((1 << int(edges[c])) - 1) for c in kept) for kept in combinations(range(chunks), chunks - 2)]]
    for _ in range(2):
        split = []
        for mask in levels[-1]:
            free = [bit for bit in range(64) if not mask >> bit & 1]
            split += [mask | sum(1 << bit for bit in part.tolist()) for part in np.array_split(np.array(free), 3)]
        levels.append(split)
    return levels


def _link_blocks(blocks: DataFrame, within: int, rows_per_task: int) -> DataFrame:
    """Links (a, b) of blocks (choice, bits, fingerprint), by pivot tables: one for each member that has one."""
    tasks = blocks.count() // rows_per_task + 1
    dealt = blocks.select("choice", "bits", "fingerprint", F.pmod(F.xxhash64("choice", "bits"), F.lit(tasks)).cast("int").alias("task"))

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["choice", "bits", "fingerprint"], kind="stable")
        own = frame["fingerprint"].to_numpy()
        block = (np.diff(frame["choice"].to_numpy(), prepend=-1) != 0) | (np.diff(frame["bits"].to_numpy(), prepend=0) != 0)
        label = link_block(own.view(np.uint64), np.cumsum(block), within)
        linked = label != np.arange(len(label))
        return pd.DataFrame({"a": own[linked], "b": own[label[linked]]})

    return dealt.groupBy("task").applyInPandas(link, "a long, b long")


def near_links(prints: DataFrame, chunks: int = 6, most_in_block: int = 4096, rows_per_task: int = 50_000) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at 2 or fewer differing bits, and no others.

    Blocks of fingerprints that agree on 43 of the 64 bits are linked inside: pivot tables discard, bits verify. A block
    of more than `most_in_block` is split by further bits, twice if need be (see `_masks`). Then seven bits or fewer are
    free in most parts and ten in none, so no block has over 1024 distinct fingerprints: no group is unbounded.
    """
    levels = _masks(chunks)
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits")) for k, m in enumerate(levels[0])])
    blocks = prints.select("fingerprint", F.explode(keys).alias("block")).select("fingerprint", "block.*")
    links = prints.sparkSession.createDataFrame([], "a long, b long")
    for level in range(len(levels)):
        sizes = stored(blocks.groupBy("choice", "bits").agg(F.count("*").alias("members")).where("members > 1"), "blocks")
        most = most_in_block if level < len(levels) - 1 else 1 << 62
        whole = stored(blocks.join(sizes.where(F.col("members") <= most), ["choice", "bits"]).select("choice", "bits", "fingerprint"), "block-members")
        links = links.unionByName(_link_blocks(whole, 2, rows_per_task))
        large = sizes.where(F.col("members") > most)
        if large.isEmpty():
            break
        masks = F.array(*[F.lit(_signed(m)).cast("long") for m in levels[level + 1]])
        children = F.transform(F.sequence(F.col("choice") * 3, F.col("choice") * 3 + 2), lambda c: F.struct(c.alias("choice"), F.col("fingerprint").bitwiseAND(F.get(masks, c)).alias("bits")))
        split = blocks.join(large.select("choice", "bits"), ["choice", "bits"])
        blocks = stored(split.select("fingerprint", F.explode(children).alias("block")).select("fingerprint", "block.*").distinct(), "split-blocks")
    return links.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The near-duplicate component of every document by SimHash.

    Words are lower-cased in A-Z; a fingerprint bit is set if it is in over half the XXH64 hashes of the shingles of
    `shingle` words, repeats included. Documents whose fingerprints differ in 2 or fewer bits are linked; a component is
    named by its smallest doc_id. Only distinct fingerprints are compared.

    Returns one row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; a
    text of fewer words than a shingle has one shingle; rows that repeat share a fingerprint and so a component; a null
    doc_id keeps its row, never names a component that has another id, and names one as null otherwise; extra columns
    are ignored; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(marked.groupBy("fingerprint").agg(F.min("row_key").alias("first_id"), F.count("*").alias("rows")), "distinct")
    members = connected_components(near_links(distinct.select("fingerprint")))
    named = distinct.join(members, distinct["fingerprint"] == members["node"], "left").select("fingerprint", "first_id", "rows", F.coalesce("component", "fingerprint").alias("component"))
    named = stored(named, "named")
    firsts = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    classes = salted_join(named, firsts, ["component"], "members", named.count(), F.col("fingerprint")).select("fingerprint", "component_id", "rows")
    found = salted_join(marked, stored(classes, "classes"), ["fingerprint"], "rows", marked.count(), F.monotonically_increasing_id())
    return found.select(F.col("row_key").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
