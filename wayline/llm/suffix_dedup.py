"""Removal of byte strings that occur earlier, by sorting the suffixes at anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.anchors import MATCH, REACH, anchors_of
from wayline.llm.common import stored
from wayline.llm.deep_shallow import deep_shallow_sort

SIDE = REACH + MATCH
#: Window offsets in a range by which the contexts of a frequent gram are dealt on.
SLICE = 5
ANCHORS = "bucket int, gram array<long>, n array<long>, doc array<long>, at array<int>"
SHARED = "bucket int, doc array<long>, at array<int>, gram array<long>, frequent array<long>"
FOUND = "bucket int, doc array<long>, begin array<int>, end array<int>"
CONTEXTS = f"{FOUND}, key array<long>, low array<int>, left array<int>, right array<int>, bytes binary"
NAMES = ["bucket", "doc", "begin", "end", "key", "low", "left", "right", "bytes"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each key, by mixed bits."""
    return (_mixed(keys) % np.uint64(buckets)).astype(np.int32)


def _digest(rows: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of a byte matrix: equal rows have equal ones."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words, out = padded.view(np.uint64), np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        out = _mixed((out ^ words[:, k]).view(np.int64))
    return out.view(np.int64)


def _joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.asarray(v, dtype=kind) for v in column]) if len(column) else np.zeros(0, kind)


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """A row for each bucket, with the values of its rows in arrays."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    starts = np.concatenate([[0], cuts]).astype(np.int64) if len(by) else np.zeros(0, np.int64)
    ends = pa.array(np.append(starts, len(by)).astype(np.int32))
    arrays = [pa.ListArray.from_arrays(ends, pa.array(c[by], t)) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[by][starts], pa.int32()), *arrays], names)


def anchor_table(docs: DataFrame, buckets: int, anchors_at_once: int = 2_000_000) -> DataFrame:
    """Anchors of (doc, text) in arrays, ANCHORS, by bucket of their gram: a gram, its number n, and where it stands if
    that is one place. Of `anchors_at_once` anchors, those of a gram that comes again are known to be shared: they go by
    bucket of their document (`buckets` and on), and only the gram and its number go by gram."""

    def flushed(found: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        doc = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        at, gram = np.concatenate([f[1] for f in found]).astype(np.int32), np.concatenate([f[2] for f in found]).view(np.int64)
        order = np.argsort(gram, kind="stable")
        starts = np.flatnonzero(np.append(True, gram[order[1:]] != gram[order[:-1]]))
        n = np.diff(np.append(starts, len(order)))
        first, again = order[starts], np.repeat(n > 1, n)
        types, names = [pa.int64(), pa.int64(), pa.int64(), pa.int32()], ["bucket", "gram", "n", "doc", "at"]
        yield _by_bucket(_bucket(gram[first], buckets), [gram[first], n, doc[first], np.where(n > 1, -1, at[first])], types, names)
        own = order[again]
        if len(own):
            yield _by_bucket(buckets + _bucket(doc[own], buckets), [gram[own], np.zeros(len(own), np.int64), doc[own], at[own]], types, names)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids, texts = batch.column("doc").to_numpy(), batch.column("text")
            for i in range(len(ids)):
                own = anchors_of(texts[i].as_py().encode())
                if len(own[0]):
                    found.append((ids[i], *own))
                    held += len(own[0])
                if held >= anchors_at_once:
                    yield from flushed(found)
                    found, held = [], 0
        if found:
            yield from flushed(found)

    return docs.mapInArrow(anchors, ANCHORS)


def shared_anchors(frame: pd.DataFrame, buckets: int, most_contexts: int) -> pd.DataFrame:
    """Of one bucket of anchors those whose gram stands elsewhere too, by bucket of the document, SHARED; and the grams
    at more than `most_contexts` anchors."""
    doc, at, gram, n = _joined(frame["doc"], np.int64), _joined(frame["at"], np.int32), _joined(frame["gram"], np.int64), _joined(frame["n"], np.int64)
    frequent = np.zeros(0, np.int64)
    if int(frame["bucket"].iloc[0]) < buckets:
        order = np.argsort(gram, kind="stable")
        doc, at, gram, n = doc[order], at[order], gram[order], n[order]
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        total = np.add.reduceat(n, starts)
        frequent = gram[starts][total > most_contexts]
        own = (np.repeat(total, np.diff(np.append(starts, len(gram)))) > 1) & (at >= 0)
        doc, at, gram = doc[own], at[own], gram[own]
    bucket, rows, by = _bucket(doc, buckets), [], np.argsort(_bucket(doc, buckets), kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        if len(part):
            rows.append((int(bucket[part[0]]), doc[part], at[part], gram[part], None))
    if len(frequent):
        rows.append((0, [], [], [], frequent))
    return pd.DataFrame(rows, columns=["bucket", "doc", "at", "gram", "frequent"])


def merged_spans(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, sorted, with those that touch or overlap made one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, begin, end
    # Running maximum of the ends within a document: documents are set apart by more than any end.
    rank = np.cumsum(np.diff(doc, prepend=doc[0]) != 0)
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * far)
    starts = np.ones(len(doc), bool)
    starts[1:] = begin[1:] + rank[1:] * far > reach[:-1]
    starts[1:] |= rank[1:] != rank[:-1]
    where = np.flatnonzero(starts)
    last = np.append(where[1:], len(doc)) - 1
    return doc[where], begin[where], reach[last] - rank[last] * far


def compressed(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc, doc_id, zipped): texts compressed for the shuffle, by bucket of the document."""

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [squeeze.compress(t.as_py().encode()) for t in batch.column("text")]
            bucket = pa.array(_bucket(batch.column("doc").to_numpy(), buckets))
            yield pa.RecordBatch.from_arrays([bucket, batch.column("doc"), batch.column("doc_id"), pa.array(texts, pa.binary())], ["bucket", "doc", "doc_id", "zipped"])

    return docs.mapInArrow(zipped, "bucket int, doc long, doc_id long, zipped binary")


def _frame(bucket: np.ndarray, columns: dict[str, np.ndarray], parts: np.ndarray | None = None) -> pd.DataFrame:
    """Rows of CONTEXTS, one for each bucket; those without bytes are spans to remove."""
    rows, squeeze, by = [], zstandard.ZstdCompressor(level=1), np.argsort(bucket, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        if len(part):
            row = dict.fromkeys(NAMES) | {"bucket": int(bucket[part[0]])} | {name: values[part] for name, values in columns.items()}
            rows.append(row | {"bytes": None if parts is None else squeeze.compress(parts[part].tobytes())})
    return pd.DataFrame({name: pd.Series([r[name] for r in rows], dtype="int64" if name == "bucket" else "object") for name in NAMES})


def _spans(doc: np.ndarray, begin: np.ndarray, end: np.ndarray, buckets: int) -> pd.DataFrame:
    """Spans to remove, by bucket of the document."""
    return _frame(_bucket(doc, buckets), {"doc": doc, "begin": begin.astype(np.int32), "end": end.astype(np.int32)})


def _repeats(rows: np.ndarray, digest: np.ndarray, also: list[np.ndarray]) -> np.ndarray:
    """Which rows of a byte matrix are equal to an earlier one, in the numbers `also` too. Digests bring equal rows
    together, bytes decide."""
    order = np.lexsort((*also, digest))  # stable, so the earliest of equal rows comes first
    a, b, out = order[1:], order[:-1], np.zeros(len(rows), bool)
    same = (rows[a] == rows[b]).all(axis=1)
    for numbers in also:
        same &= numbers[a] == numbers[b]
    out[a] = same
    return out


def contexts_of(texts: pd.DataFrame, found: pd.DataFrame, hot: np.ndarray, buckets: int) -> pd.DataFrame:
    """The bytes that windows over the anchors of one bucket of documents can have, by bucket of their key.

    Of anchors with wholly equal bytes around them only the first sends its own; the others' bytes occur earlier, so
    they are spans to remove. The key is the gram, and all window offsets are asked. Contexts of a frequent gram (one of
    `hot`) are sent once for each range of SLICE offsets, with a key over the bytes that all windows of the range have.
    """
    doc, at, gram = _joined(found["doc"], np.int64), _joined(found["at"], np.int32), _joined(found["gram"], np.int64)
    order = np.lexsort((at, doc))
    once = np.append(True, (doc[order[1:]] != doc[order[:-1]]) | (at[order[1:]] != at[order[:-1]])) if len(order) else np.zeros(0, bool)
    doc, at, gram = doc[order[once]], at[order[once]], gram[order[once]]
    frequent = np.isin(gram, hot)
    left, right, parts = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32), np.zeros((len(doc), SIDE), np.uint8)
    unzip = zstandard.ZstdDecompressor()
    for own, packed in zip(texts["doc"], texts["zipped"]):
        a, b = np.searchsorted(doc, own, "left"), np.searchsorted(doc, own, "right")
        if a == b:
            continue
        raw = np.frombuffer(unzip.decompress(packed), np.uint8)
        padded = np.zeros(len(raw) + SIDE, np.uint8)
        padded[REACH : REACH + len(raw)] = raw
        parts[a:b] = np.lib.stride_tricks.sliding_window_view(padded, SIDE)[at[a:b]]
        left[a:b], right[a:b] = np.minimum(REACH, at[a:b]), np.minimum(MATCH, len(raw) - at[a:b])
    digest = _digest(parts)
    again = _repeats(parts, digest, [left, right])
    gone = [(doc[again], at[again] - left[again], at[again] + right[again])]
    keys, lows, chosen = [gram[~again & ~frequent]], [np.full(int((~again & ~frequent).sum()), -1, np.int32)], [np.flatnonzero(~again & ~frequent)]
    spread = np.flatnonzero(~again & frequent)
    for low in range(0, REACH + 1, SLICE) if len(spread) else ():
        high = min(low + SLICE - 1, REACH)
        last, first = np.minimum(left[spread], high), np.maximum(MATCH - right[spread], low)  # the offsets of its windows
        some, last, first = spread[last >= first], last[last >= first], first[last >= first]
        inner = parts[some, REACH - high : REACH + MATCH - low]
        same = _repeats(inner, _digest(inner), [last, first])
        gone.append((doc[some[same]], at[some[same]] - last[same], at[some[same]] + MATCH - first[same]))
        some = some[~same]
        keys.append(gram[some] ^ _digest(parts[some, REACH - low : REACH + MATCH - high]) ^ np.int64(low + 1))
        lows.append(np.full(len(some), low, np.int32))
        chosen.append(some)
    key, low, own = np.concatenate(keys), np.concatenate(lows), np.concatenate(chosen)
    columns = {"doc": doc[own], "begin": at[own].astype(np.int32), "end": at[own].astype(np.int32), "key": key, "low": low, "left": left[own], "right": right[own]}
    by = np.lexsort((digest[own], key))
    return pd.concat([_spans(*(np.concatenate(c) for c in zip(*gone)), buckets), _frame(_bucket(key, buckets)[by], {c: v[by] for c, v in columns.items()}, parts[own[by]])])


def repeated_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, bytes_: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """For contexts in the order of their occurrence: whether the window that begins `o` bytes before the anchor occurs
    in an earlier context of the same group, for each o from 0 to REACH, or from the slice of offsets that begins at `low`.

    Suffixes from the anchor on, and the bytes before it read backwards, are sorted by deep-shallow sorting. Two windows
    at the same offset are equal if and only if their anchors stand in one interval of at least o shared bytes
    backwards, and in one of at least MATCH - o forwards.
    """
    n = len(group)
    low = np.full(n, -1) if low is None else low
    found = np.zeros((n, REACH + 1), bool)
    on, on_lcp = deep_shallow_sort(group, bytes_[:, REACH:])
    back, back_lcp = deep_shallow_sort(group, bytes_[:, REACH - 1 :: -1][:, :REACH])
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(REACH + 1):
        ahead[on] = np.cumsum(on_lcp < MATCH - o)
        behind[back] = np.cumsum(back_lcp < o)
        has = np.flatnonzero((left >= o) & (right >= MATCH - o) & ((low < 0) | ((low <= o) & (o < low + SLICE))))
        key = ahead[has] * (n + 1) + behind[has]
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
        found[has[order[again]], o] = True
    return found


def sort_bucket(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Spans to remove among one bucket of contexts, and those that are known already."""
    known, frame = frame[frame["bytes"].isna()], frame[frame["bytes"].notna()]
    passed = known[["bucket", "doc", "begin", "end"]]
    if not len(frame):
        return passed
    unzip = zstandard.ZstdDecompressor()
    bytes_ = np.concatenate([np.frombuffer(unzip.decompress(b), np.uint8).reshape(-1, SIDE) for b in frame["bytes"]])
    doc, at, key = (_joined(frame[c], np.int64) for c in ("doc", "begin", "key"))
    low, left, right = (_joined(frame[c], np.int32) for c in ("low", "left", "right"))
    order = np.lexsort((at, doc))
    doc, at, low = doc[order], at[order], low[order]
    group = np.unique(np.stack([key[order], low]), axis=1, return_inverse=True)[1].reshape(-1)
    found = np.zeros((len(doc), REACH + 3), np.int8)
    found[:, 1:-1] = repeated_windows(group, left[order], right[order], bytes_[order], low)
    edges = np.diff(found, axis=1)
    row, near = np.nonzero(edges == 1)
    far = np.nonzero(edges == -1)[1] - 1
    spans = merged_spans(doc[row], at[row] - far, at[row] - near + MATCH)
    return pd.concat([passed, _spans(*spans, buckets)[["bucket", "doc", "begin", "end"]]])


def cut_texts(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, n_bytes, spans, kept) of the texts of one bucket."""
    doc, begin, end = merged_spans(_joined(found["doc"], np.int64), _joined(found["begin"], np.int32), _joined(found["end"], np.int32))
    unzip, rows = zstandard.ZstdDecompressor(), []
    for own, doc_id, packed in zip(texts["doc"], texts["doc_id"], texts["zipped"]):
        raw = unzip.decompress(packed)
        a, b = np.searchsorted(doc, own, "left"), np.searchsorted(doc, own, "right")
        spans, kept, last = [], [], 0
        for x, y in zip(begin[a:b].tolist(), end[a:b].tolist()):
            spans.append({"begin": x, "end": y})
            kept.append(raw[last:x])
            last = y
        rows.append((doc_id, len(raw), spans, b"".join([*kept, raw[last:]])))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])
    return out.astype({"doc_id": "Int64"})


def _with_keys(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): an integer key that rises with doc_id, null last, and tells different texts of an id apart.

    It is the id itself unless one is null or repeated; else the place of (doc_id, digest of the text) in a distributed sort.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    keys = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.md5("text").alias("digest")]
    ranks = stored(rows.select(*keys).distinct().orderBy("no_id", "id", "digest").withColumn("doc", F.monotonically_increasing_id()), "keys")
    return rows.select("*", *keys).join(ranks, ["no_id", "id", "digest"]).select("doc", "doc_id", "text")


def remove_repeats(docs: DataFrame, bytes_per_task: int = 16 << 20, most_contexts: int = 20_000) -> DataFrame:
    """Removes every byte covered by a 100-byte string that also starts earlier in the documents.

    Texts are UTF-8 bytes; earlier means a smaller doc_id, or the same document and a smaller place; overlaps count, and
    strings are judged on the input. Every 100-byte window has an anchor, a place that its bytes alone decide, so equal
    windows have anchors with equal grams. Anchors whose gram stands elsewhere too send the bytes around them, and these
    are sorted as suffixes (deep-shallow: multikey quicksort, then blind tries) to find the windows they share. Hashes
    only bring candidates together; every removal is decided on bytes.

    Tasks hold one bucket of contexts or texts of about `bytes_per_task`; a passage that many documents share is sent
    once by each bucket of documents. A gram at over `most_contexts` anchors is dealt on by the bytes beside it: windows
    are asked in ranges of five offsets, and contexts meet only where the 96 bytes agree that all windows of a range have. So a line of up to 95 bytes in very many texts makes no large group.

    Returns one row per row of `docs`: doc_id, n_bytes, spans (array of begin, end: maximal removed runs), kept (the
    other bytes; a removal may cut a character).

    Defined cases: a null text is the empty one; a text under 100 bytes loses nothing; a null doc_id comes after all
    others; rows that repeat a doc_id and its text are one document, each gets its result; of rows that repeat a doc_id
    with another text, the one with the smaller digest is earlier; extra columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    rows = _with_keys(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, total // bytes_per_task + 1)
    # An anchor in about 35 bytes, so at most a million grams are frequent: 8 MB for the driver and each task.
    most_contexts = max(most_contexts, total // 35 // 1_000_000)
    # As many partitions as buckets: tasks stay the same size when the input grows.
    dealt = lambda df, n=buckets: df.repartition(n, "bucket").groupBy("bucket")
    anchors = dealt(anchor_table(rows.select("doc", "text"), buckets), 2 * buckets)
    shared = stored(anchors.applyInPandas(lambda frame: shared_anchors(frame, buckets, most_contexts), SHARED), "anchors")
    hot = np.array(sorted(r["g"] for r in shared.select(F.explode("frequent").alias("g")).toLocalIterator()), np.int64)
    once = compressed(rows, buckets)
    look = shared.where("frequent IS NULL").drop("frequent")
    contexts = dealt(once).cogroup(dealt(look)).applyInPandas(lambda t, f: contexts_of(t, f, hot, buckets), CONTEXTS)
    spans = dealt(contexts).applyInPandas(lambda frame: sort_bucket(frame, buckets), FOUND)
    return dealt(once).cogroup(dealt(spans)).applyInPandas(cut_texts, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
