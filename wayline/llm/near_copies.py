"""One row of each class of near copies: SimHash classes by pivot tables, then sketches for those further apart, all
verified by exact Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import stored
from wayline.llm.simhash import majority_bits, near_links, shingle_hashes
from wayline.operators.components import connected_components

PRINT = "node long, size int, fingerprint long, sketch array<long>"


def alike(shared: Column | np.ndarray, a: Column | np.ndarray, b: Column | np.ndarray) -> Column | np.ndarray:
    """Whether sets of `a` and `b` members with `shared` in common have a Jaccard similarity of 0.8 or more, in integers."""
    return 9 * shared >= 4 * (a + b)


def _prints(rows: DataFrame, shingle: int, sketch: int) -> DataFrame:
    """Each row's shingle set by name (node, a 64-bit digest), number, fingerprint, and `sketch` least hashes."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            node, size, marks, least = [], [], [], []
            for a, b in zip(ends[:-1], ends[1:]):
                own = np.unique(flat[a:b].view(np.uint64))
                node.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
                size.append(len(own))
                marks.append(majority_bits(own).view(np.int64))
                least.append(own[:sketch].view(np.int64))
            made = [pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(marks, pa.int64()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "digest")] + made, ["row", "doc_id", "digest", "node", "size", "fingerprint", "sketch"])

    hashed = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "digest", shingle_hashes(F.col("text"), shingle).alias("hashes"))
    return hashed.mapInArrow(prints, f"row long, doc_id long, digest string, {PRINT}")


def _candidate(a: str, b: str, within: int) -> Column:
    """Nodes a and b may be alike: fingerprints within the distance, and the smaller set has 0.8 of the larger one's members."""
    near = F.bit_count(F.col(f"{a}.fingerprint").bitwiseXOR(F.col(f"{b}.fingerprint"))) <= within
    return near & (5 * F.least(f"{a}.size", f"{b}.size") >= 4 * F.greatest(f"{a}.size", f"{b}.size"))


def candidate_pairs(frame: pd.DataFrame, within: int) -> list[tuple[int, np.ndarray]]:
    """(i, js) of one tile pair of block `key`: the later rows js that may be alike row i, are in another component, are of
    the other tile if the tiles differ, and have `key` as the least hash in common, so that each pair comes up once."""
    prints, size, component = (frame[c].to_numpy() for c in ("fingerprint", "size", "component"))
    key, tiles, tile = frame["key"].iloc[0], frame["low"].iloc[0] != frame["high"].iloc[0], frame["tile"].to_numpy()
    lower = [set(s[s < key].tolist()) for s in map(np.asarray, frame["sketch"])]
    prints, out = prints.view(np.uint64), []
    for i in range(len(frame) - 1):
        rest = slice(i + 1, None)
        ok = (np.bitwise_count(prints[rest] ^ prints[i]) <= within) & (component[rest] != component[i])
        ok &= 5 * np.minimum(size[rest], size[i]) >= 4 * np.maximum(size[rest], size[i])
        if tiles:
            ok &= tile[rest] != tile[i]
        js = np.flatnonzero(ok) + i + 1
        js = np.array([j for j in js if lower[i].isdisjoint(lower[j])], dtype=np.int64)
        if len(js):
            out.append((i, js))
    return out


def verified_links(frame: pd.DataFrame, within: int) -> list[tuple[int, int]]:
    """Links (node, node) that connect all alike candidates of one tile pair: running components, so at most one a row."""
    sets, nodes, size = list(map(np.asarray, frame["shingles"])), frame["node"].to_numpy(), frame["size"].to_numpy().astype(np.int64)
    label, out = frame["component"].to_numpy().copy(), []
    for i, js in candidate_pairs(frame, within):
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        flat, own = np.concatenate([sets[j] for j in js]), sets[i]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.r_[0, np.cumsum(size[js])[:-1]])
        for j in js[alike(shared, size[js], size[i])]:
            if label[j] != label[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return out


def _by_tile_pair(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in frame.groupby(["key", "low", "high"], sort=False):
        if len(part) > 1:
            yield part


def _dealt(rows: DataFrame, weight: str, per_task: int) -> DataFrame:
    """Tile pairs dealt to tasks of about `per_task` of the summed weight."""
    tasks = int((rows.agg(F.sum(F.expr(weight))).first()[0] or 0) // per_task) + 1
    return rows.withColumn("task", F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks)).cast("int")).groupBy("task")


def _tile_links(blocks: DataFrame, sets: DataFrame, within: int, most_in_tile: int) -> DataFrame:
    """Links of all alike candidates whose components differ.

    Blocks of several components are cut into tiles of about `most_in_tile` nodes, and each pair of tiles is compared
    alone. Only nodes with a candidate left get their shingles.
    """
    sizes = blocks.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("one"), F.max("component").alias("other"))
    tiles = sizes.where("one <> other").select("key", F.ceil(F.col("members") / most_in_tile).cast("int").alias("tiles"))
    placed = blocks.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    spread = placed.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = stored(spread.select("key", F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high"), "tile", "node", "size", "fingerprint", "sketch", "component"), "tiles")

    def left(frame: pd.DataFrame) -> pd.DataFrame:
        found = [frame.iloc[:0]]
        for part in _by_tile_pair(frame):
            pairs = candidate_pairs(part, within)
            if pairs:
                found.append(part.iloc[np.unique(np.concatenate([np.r_[i, js] for i, js in pairs]))])
        return pd.concat(found)[pairs_columns]

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        links = [link for part in _by_tile_pair(frame) for link in verified_links(part, within)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    pairs_columns = pairs.columns
    open_ = stored(_dealt(pairs, "1", 4_000).applyInPandas(left, pairs.schema), "open-tiles")
    return _dealt(open_.join(sets, "node"), "size", 1_000_000).applyInPandas(verify, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose whole shingle sets are alike."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
    return both.where(alike(F.size(F.array_intersect("_a", "_b")), F.size("_a"), F.size("_b"))).select("a", "b")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): each node b with the least node a of its SimHash class.

    Fingerprints at 2 or fewer differing bits are linked, as in `near_duplicates`: blocks, pivot tables that discard
    pairs, bits that verify.
    """
    classes = connected_components(near_links(stored(nodes.select("fingerprint").distinct(), "near-fingerprints"))).withColumnRenamed("node", "fingerprint")
    placed = nodes.join(classes, "fingerprint", "left").select("node", F.coalesce("component", "fingerprint").alias("class"))
    first = placed.groupBy("class").agg(F.min("node").alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return placed.join(first, "class").where("node > a").select("a", F.col("node").alias("b"))


def near_copy_classes(nodes: DataFrame, rows: DataFrame, shingle: int, within: int, rounds: int, most_in_tile: int) -> DataFrame:
    """(node, component) of the nodes that have another one alike: SimHash classes first, then pairs that share a sketch hash.

    Each node is held against the first of its SimHash class. At a similarity of 0.8 fingerprints differ in about 10 bits,
    beyond those that SimHash links, so nodes that share a sketch hash and are still apart go on. In each round every node is held against one node of each of its blocks, which settles blocks of two and most of a
    block of near copies at a cost linear in the block; tiles compare what is still in different components.
    """
    members = nodes.select("node", "size", "fingerprint", "sketch", F.explode("sketch").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    blocks = stored(members.join(shared, "key"), "near-blocks")
    close = stored(simhash_pairs(nodes), "near-simhash")
    named = blocks.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node")))
    needed = nodes.join(named.distinct(), "node", "left_semi").select("node", F.col("best.row").alias("row"))
    sets = stored(rows.select("row", "text").join(needed, "row").select("node", F.array_sort(F.array_distinct(shingle_hashes(F.col("text"), shingle))).alias("shingles")), "near-sets")
    links = stored(_verified(close, sets), "near-links")
    for turn in range(rounds + 1):
        classes = connected_components(links)
        placed = blocks.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn < rounds:
            first = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("_order"), "node", "size", "fingerprint", "component")).alias("l"))
            asked = placed.alias("m").join(first.select("key", "l.*").alias("f"), "key").where((F.col("m.component") != F.col("f.component")) & _candidate("m", "f", within))
            found = _verified(asked.select(F.least("m.node", "f.node").alias("a"), F.greatest("m.node", "f.node").alias("b")).distinct(), sets)
        else:
            found = _tile_links(placed, sets, within, most_in_tile)
        links = stored(links.unionByName(found), "near-links")
    return connected_components(links)


def first_of_near_copies(docs: DataFrame, shingle: int = 5, within: int = 24, sketch: int = 8, rounds: int = 2, most_in_tile: int = 1024) -> DataFrame:
    """One row of each class of near copies, with all columns of `docs`.

    Words are lower-cased in A-Z. Two texts are near copies if the sets of their shingles of `shingle` words (by 64-bit
    hashes) have a Jaccard similarity of 0.8 or more; classes are the components of these pairs. Candidates are in one
    SimHash class (fingerprints at 2 or fewer differing bits, linked by pivot tables); further ones share one of the `sketch` least shingle hashes (at 0.8, two sketches of eight have none in common once in 400,000 pairs), and
    fingerprints over the sets differ in `within` or fewer bits (at 0.8 about 10, deviation 3); every candidate is
    verified on the whole sets, unless others connect it already.

    Defined cases: the row with the smallest doc_id stays, null last, then the smallest digest of its columns; rows that
    repeat are one class; all texts without words are one class; rows count by themselves, whatever ids they share.
    """
    columns = docs.columns
    whole = F.concat(F.md5(F.coalesce("text", F.lit(""))), F.hex(F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])))
    rows = stored(docs.select("*", F.monotonically_increasing_id().alias("row"), whole.alias("digest")), "near-rows")
    marked = stored(_prints(rows, shingle, sketch), "near-prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "row")).alias("best")
    nodes = stored(marked.groupBy("node").agg(best, *[F.first(c).alias(c) for c in ("size", "fingerprint", "sketch")]), "near-nodes")
    classes = near_copy_classes(nodes, rows, shingle, within, rounds, most_in_tile)
    named = nodes.join(classes, "node", "left").select(F.coalesce("component", "node").alias("component"), "best")
    kept = named.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*columns)
