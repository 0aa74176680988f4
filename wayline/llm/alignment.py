"""Two tokenizers over the same bytes: groups between their common cuts, and counts of the id pairs that overlap."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import stored
from wayline.llm.tokens import TWO_SPACES, encodings

#: A stretch of white space and the text up to the next one; both tokenizers always cut between two of them.
STRETCH = re.compile(r"[ \t\n\f\v]*[^ \t\n\f\v]+|[ \t\n\f\v]+")
#: Other white space can join a run that STRETCH cuts, or end a piece (carriage returns do), and U+2581 stands for a space in B:
#: texts with any are encoded whole, and so are long ones.
UNCUT = re.compile(r"[\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")
LONG = 4_000_000
#: Stretches that a task remembers, in each of two generations, and characters of texts that it aligns at once.
MOST_STRETCHES, AT_ONCE = 200_000, 1_000_000
#: Documents of a chunk are numbered in 16 bits.
MOST_DOCS = 65_535

POSTINGS = "chunk long, bucket int, pair array<long>, links array<long>, entries array<int>, posts binary, ids array<long>, counts array<long>, groups array<string>"
NAMES = ["chunk", "bucket", "pair", "links", "entries", "posts", "ids", "counts", "groups"]
TYPES = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


#: What the tokens of a text, or of a part of it, have in common: their numbers (A << 40 | B), the groups, and the number of the id
#: pair of each link as bytes.
Aligned = tuple[int, str, bytes]


class Aligner:
    """Encodes by a byte-level BPE vocabulary (A) and a sentencepiece model (B), and aligns by bytes."""

    def __init__(self, ranks_path: str, model_path: str) -> None:
        self.any, self.single = encodings(ranks_path)
        with open(ranks_path, "rb") as file:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
        self.a_bytes = [ranks.get(i, b"") for i in range(self.any.n_vocab)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.named = [f"{i}{sign}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in ",|;"]
        self.width = 1 << max(1, (self.any.n_vocab - 1).bit_length())
        # Stretches may be cut apart if no piece has white space after something else.
        self.by_stretch = not any(re.search(r"[^ \t\n\f\v][ \t\n\f\v]", p.replace("▁", " ")) for p in pieces)
        self.new: dict[str, Aligned] = {}
        self.old: dict[str, Aligned] = {}

    def align(self, text: str, sizes: list[int]) -> list[Aligned] | None:
        """Alignments of the parts of a space and `text` that have `sizes` bytes; None where the tokens of a side do not
        join to those bytes, or do not all end where a part does."""
        a = (self.any if TWO_SPACES.search(text) else self.single).encode_ordinary(" " + text)
        b = self.b.encode_as_ids(text)
        raw = b" " + text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b, ends = np.cumsum(self.a_lengths[ids_a]), np.cumsum(self.b_lengths[ids_b]), np.cumsum(sizes)
        # Between two neighbours of all cuts lies one token of each side: a link. All links arise so.
        cuts = np.union1d(ends_a, ends_b)
        pairs = (ids_b[np.searchsorted(ends_b, cuts)] * self.width + ids_a[np.searchsorted(ends_a, cuts)]).tobytes()
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not np.isin(ends, common).all():
            return None
        # The text of all groups, token by token: first those of A, then those of B, each with what stands behind it.
        of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        behind = np.concatenate([3 * ids_a + (common[of_a] == ends_a), 3 * ids_b + 2 * (common[of_b] == ends_b)])
        named = [self.named[k] for k in behind[order].tolist()]
        found, x, y, z = [], 0, 0, 0
        for i, j, k in zip(*((np.searchsorted(all_, ends) + 1).tolist() for all_ in (ends_a, ends_b, cuts))):
            found.append((i - x << 40 | j - y, "".join(named[x + y : i + j])[:-1], pairs[8 * z : 8 * k]))
            x, y, z = i, j, k
        return found

    def learn(self, stretches: list[str]) -> None:
        """Aligns distinct stretches, end to end, each of which begins with white space and ends with something else."""
        for start in range(0, len(stretches), 4096):
            some = stretches[start : start + 4096]
            found = self.align("." + "".join(some), [2, *(len(s.encode()) for s in some)])
            if found:
                self.new.update(zip(some, found[1:]))

    def aligned(self, texts: list[str]) -> list[Aligned | None]:
        """Alignments of texts; None for those that have no tokens."""
        cut = [STRETCH.findall(" " + t) if t and self.by_stretch and len(t) <= LONG and not UNCUT.search(t) else None for t in texts]
        new, old = self.new, self.old
        unknown = {}
        for parts in cut:
            for s in parts or ():
                if s not in new:
                    if s in old:
                        new[s] = old[s]
                    else:
                        unknown[s] = None
        self.learn([s for s in unknown if s[-1] not in " \t\n\f\v"])
        out = []
        for text, parts in zip(texts, cut):
            if parts is not None:
                found = [new.get(s) for s in parts]
                if None not in found:
                    out.append((sum([f[0] for f in found]), ";".join([f[1] for f in found]), b"".join([f[2] for f in found])))
                    continue
            # A text that ends with white space, or is not cut: whether its bytes differ is asked of the whole.
            one = self.align(text, [len(text.encode()) + 1]) if text else None
            out.append(one and one[0])
        if len(new) > MOST_STRETCHES:  # the frequent ones come back from the old ones
            self.old, self.new = new, {}
        return out


@lru_cache(maxsize=1)
def aligner(ranks_path: str, model_path: str) -> Aligner:
    return Aligner(ranks_path, model_path)


@dataclass
class Chunk:
    """Consecutive documents of a partition, and the pairs of their links."""

    number: int
    ids: list[int | None] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    links: int = 0

    def add(self, doc_id: int | None, found: Aligned | None, groups: str) -> None:
        number, text, pairs = found or (0, "", b"")
        n_a, n_b, n_links = number >> 40, number & (1 << 40) - 1, len(pairs) // 8
        self.ids.append(doc_id)
        self.counts += (n_a, n_b, n_a + n_b - n_links, n_links)  # each link ends at a cut, a common cut ends a token of both
        self.groups.append(hashlib.sha256(text.encode()).hexdigest() if found and groups == "sha256" else text)
        self.pairs.append(np.frombuffer(pairs, np.int64))
        self.links += n_links

    def rows(self, buckets: int, width: int) -> pa.RecordBatch:
        """A row of the documents, and one for each bucket of B ids with the postings of its pairs: of how many documents, which, how often."""
        sizes = [len(p) for p in self.pairs]
        nth, pairs = pd.factorize(np.concatenate(self.pairs))
        order = np.lexsort((pairs, (pairs // width) % buckets))
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        pairs, key = pairs[order], place[nth] * (MOST_DOCS + 1) + np.repeat(np.arange(len(sizes)), sizes)
        key.sort()
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(np.append(starts, len(key)))
        key = key[starts]
        of_pair, doc = key // (MOST_DOCS + 1), (key % (MOST_DOCS + 1)).astype("<u2")
        first = np.searchsorted(of_pair, np.arange(len(pairs)))
        entries = np.diff(np.append(first, len(key))).astype(np.int32)
        links = np.add.reduceat(times, first) if len(pairs) else np.zeros(0, np.int64)
        bucket = ((pairs // width) % buckets).astype(np.int32)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(pairs)] if len(pairs) else [0]
        squeeze = zstandard.ZstdCompressor(level=1)
        rows: list[tuple] = [(self.number, -1, None, None, None, None, self.ids, self.counts, self.groups)]
        for x, y in zip(cuts, cuts[1:]):
            a, b = int(first[x]), int(first[y]) if y < len(pairs) else len(key)
            posts = doc[a:b].tobytes() + times[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            rows.append((self.number, int(bucket[x]), pairs[x:y], links[x:y], entries[x:y], squeeze.compress(posts), None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), TYPES)], NAMES)


def posts_of(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of the chunk, links) of n postings."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return raw[: 2 * n].view("<u2").astype(np.int64), np.ascontiguousarray(raw[2 * n :].reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def postings(docs: DataFrame, ranks_path: str, model_path: str, buckets: int, groups: str, links_at_once: int = 2_000_000) -> DataFrame:
    """Rows of POSTINGS: chunks of about `links_at_once` links. Those of bucket -1 hold ids, counts and groups of documents."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunk, held = aligner(ranks_path, model_path), None, []

        def take() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            for (row, doc_id, _), found in zip(held, both.aligned([h[2] for h in held])):
                chunk = chunk or Chunk(row)
                chunk.add(doc_id, found, groups)
                if chunk.links >= links_at_once or len(chunk.ids) == MOST_DOCS:
                    yield chunk.rows(buckets, both.width)
                    chunk = None

        for batch in batches:
            size = 0
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                held.append((row, doc_id, text.as_py() or ""))
                size += len(held[-1][2])
                if size >= AT_ONCE:
                    yield from take()
                    held, size = [], 0
            yield from take()
            held = []
        if chunk:
            yield chunk.rows(buckets, both.width)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, POSTINGS)


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(side, pair, count, is_best): links of each pair of ids in all documents, and whether no pair of its B id (`side`) has more.

    Counts are added up inside each task before they are shuffled, by pair; a B id then has one row for each A id at most.
    """
    each = found.where("bucket >= 0").select(F.explode(F.arrays_zip("pair", "links")).alias("p")).select("p.pair", "p.links")
    counts = each.groupBy("pair").agg(F.sum("links").alias("count")).withColumn("side", F.expr(f"pair div {width}"))
    return counts.withColumn("is_best", F.col("count") == F.max("count").over(Window.partitionBy("side")))


def contributions(posted: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """What the postings of one bucket give to the documents of their chunks."""
    counts = counts.sort_values("pair")
    known, count, best = counts["pair"].to_numpy(), counts["count"].to_numpy(), counts["is_best"].to_numpy()
    rows = []
    for chunk, pair, entries, packed in zip(posted["chunk"], posted["pair"], posted["entries"], posted["posts"]):
        at, n = np.searchsorted(known, np.asarray(pair)), np.asarray(entries, np.int64)
        doc, times = posts_of(packed, int(n.sum()))
        docs, nth = np.unique(doc, return_inverse=True)
        sums, bests = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        np.add.at(sums, nth, np.repeat(count[at], n) * times)
        np.add.at(bests, nth, np.repeat(best[at], n) * times)
        rows.append((chunk, docs, bests, sums))
    return pd.DataFrame(rows, columns=["chunk", "doc", "best", "sum"])


def summed(chunk: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    """Rows of RESULT for the documents of one chunk."""
    ids, groups = chunk["ids"].iloc[0], chunk["groups"].iloc[0]
    best, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for doc, b, s in zip(given["doc"], given["best"], given["sum"]):
        best[doc] += b
        total[doc] += s
    counts = np.asarray(chunk["counts"].iloc[0], np.int64).reshape(-1, 4)
    columns = {"doc_id": pd.array([None if i is None or i != i else int(i) for i in ids], "Int64")}
    columns |= {name: counts[:, i] for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    return pd.DataFrame(columns | {"n_best": best, "count_sum": total, "groups": list(groups)})


def align_tokenizers(docs: DataFrame, ranks_path: str, model_path: str, groups: str = "text", bytes_per_bucket: int = 16 << 20, entries_per_task: int = 2_000_000) -> DataFrame:
    """Aligns every text's tokens by two vocabularies, and weighs each document's links by how often its id pairs are linked in all.

    A encodes a space and the text by the byte-level BPE ranks at `ranks_path`, B the text by the sentencepiece model at
    `model_path`, which puts a space before it; strings of special tokens are plain text. Byte offsets where tokens of both
    end cut them into groups. A link is a pair of occurrences whose bytes overlap.

    Postings (id pair, document, links) of chunks of documents are shuffled by the B id, as the side whose maximum is
    asked, and cogrouped with the counts of the pairs; a bucket of B ids with over `entries_per_task` postings is dealt to as many
    tasks by chunk, each with the bucket's counts. Tasks sum what each document gets; contributions meet by chunk.

    Returns one row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its
    B id, ties included), count_sum (counts over links), groups (`a1,a2|b1;a3|b2,b3` in order, or with groups="sha256"
    its digest in hex, which alone goes through the shuffle then).

    Defined cases: a null or empty text, or one whose joined tokens differ from a space and the text (one that holds
    U+2581), has no tokens: zeros and an empty `groups`, and it counts for nobody; rows that repeat count each; a null
    doc_id stays null; extra columns, whatever their names, are ignored; an empty table gives no rows.
    """
    if groups not in ("text", "sha256"):
        raise ValueError(f"groups must be 'text' or 'sha256', not {groups!r}")
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    both = aligner(ranks_path, model_path)
    width, buckets = both.width, min(max(12, total // bytes_per_bucket + 1), len(both.b_bytes))
    found = stored(postings(docs, ranks_path, model_path, buckets, groups), "postings")
    # One row for each bucket, which are fewer than B ids.
    sizes = found.where("bucket >= 0").groupBy("bucket").agg(F.sum(F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e)).alias("entries"))
    slices = sizes.select("bucket", F.ceil(F.col("entries") / entries_per_task).cast("int").alias("slices"))
    slices = F.broadcast(stored(slices, "slices"))
    dealt = found.where("bucket >= 0").join(slices, "bucket").withColumn("slice", F.pmod(F.xxhash64("chunk"), F.col("slices")).cast("int"))
    counts = pair_counts(found, width).withColumn("bucket", (F.col("side") % buckets).cast("int")).join(slices, "bucket")
    counts = counts.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    left = dealt.select("bucket", "slice", "chunk", "pair", "entries", "posts").groupBy("bucket", "slice")
    right = counts.select("bucket", "slice", "pair", "count", "is_best").groupBy("bucket", "slice")
    given = left.cogroup(right).applyInPandas(contributions, "chunk long, doc array<long>, best array<long>, sum array<long>")
    documents = found.where("bucket < 0").select("chunk", "ids", "counts", "groups")
    return documents.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(summed, RESULT)
