"""Concatenation and cutting on odd rows, held against one array of all ids."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, empty, odd, words  # noqa: F401
from wayline.llm.concat_packing import concatenate_and_cut, cuts_of, places_of
from wayline.llm.queries import vocabulary


def named_tokenizer():  # noqa: ANN201
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(docs: DataFrame, window: int) -> None:
    given = docs.select("doc_id", "text").collect()
    rows = concatenate_and_cut(docs, vocabulary(), window).collect()
    encode = named_tokenizer().encode
    want = collections.Counter()
    for g in given:
        ids = np.array([*encode(g["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want[(g["doc_id"], len(ids), zlib.crc32(ids.tobytes()))] += 1
    ids_of = collections.defaultdict(list)
    for g in given:
        ids = np.array([*encode(g["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        ids_of[(g["doc_id"], len(ids))].append(ids)
    # Every id in one piece: the pieces of a document are gapless, and their digests are those of some text of its id.
    documents = collections.defaultdict(list)
    for r in rows:
        documents[r["doc"]].append(r)
    got = collections.Counter()
    for pieces in documents.values():
        pieces.sort(key=lambda r: r["start"])
        ends = [r["start"] + r["length"] for r in pieces]
        assert [r["start"] for r in pieces] == [0, *ends[:-1]] and {r["doc_tokens"] for r in pieces} == {ends[-1]}
        doc_id = pieces[0]["doc_id"]
        match = [x for x in ids_of[(doc_id, ends[-1])] if all(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)]
        assert match
        got[(doc_id, ends[-1], zlib.crc32(match[0].tobytes()))] += 1
    assert got == want
    # Sequences are gapless; all but powers of two are full.
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        sizes.append(sum(n for _, n in parts))
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(n == window or (n < window and n & (n - 1) == 0) for n in sizes) and collections.Counter(sizes)[window] == sum(sizes) // window


@pytest.mark.parametrize("window", [1, 64, 1024])
def test_concatenation(odd: DataFrame, window: int) -> None:  # noqa: F811
    check(odd if window > 1 else odd.where("length(text) < 100 OR text IS NULL"), window)


def test_documents_over_many_windows_and_partitions(spark: SparkSession, empty: DataFrame) -> None:  # noqa: F811
    assert concatenate_and_cut(empty, vocabulary()).collect() == []
    r = random.Random(3)
    rows = [(i if i % 7 else None, "".join(r.choices("ab \n<|endoftext|>é日", k=r.choice((0, 1, 5, 400, 3000)))), i) for i in range(120)]
    rows += [(5, "<|endoftext|>", 1), (5, "<|endoftext|>", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long").withColumns({"n": F.lit("x"), "before": F.lit(1), "place": F.lit(2)})
    check(docs.repartition(9), 256)
    with pytest.raises(ValueError):
        concatenate_and_cut(docs, vocabulary(), window=1000)


def test_cuts_and_places_against_a_walk() -> None:
    r = random.Random(11)
    for _ in range(300):
        window, total = 1 << r.randint(0, 6), r.randint(1, 400)
        edges, left = list(range(0, total - total % window + 1, window)), total % window
        while left:
            size = 1 << (left.bit_length() - 1)
            edges.append(edges[-1] + size)
            left -= size
        first = r.randrange(total)
        last = r.randint(first + 1, total)
        cuts = cuts_of(first, last, total, window)
        assert cuts.tolist() == sorted({first, last, *(e for e in edges if first < e < last)})
        sequence, offset = places_of(cuts[:-1], total, window)
        for c, s, o in zip(cuts[:-1].tolist(), sequence.tolist(), offset.tolist()):
            assert edges[s] + o == c < edges[s + 1]
