"""Cross-tokenizer alignment against a walk over the bytes of both token sequences."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import SCHEMA, empty, odd, words  # noqa: F401
from wayline.llm.alignment import align_tokenizers, aligner
from wayline.llm.queries import pieces, vocabulary


def byte_decoder() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that are not printable come after 255, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


class Named:
    """Both tokenizers as the files name them."""

    def __init__(self) -> None:
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.decode = byte_decoder()

    def tokens(self, text: str | None) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
        if not text:
            return [], []
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.decode[c] for c in self.a.id_to_token(i))) for i in ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def spans(tokens: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def by_hand(texts: list[str | None]) -> list[tuple]:
    named, found = Named(), []
    for text in texts:
        a, b = map(spans, named.tokens(text))
        links, j = [], 0
        for i, x, y in a:
            while j and b[j - 1][2] > x:
                j -= 1
            while j < len(b) and b[j][1] < y:
                if b[j][2] > x:
                    links.append((i, b[j][0]))
                j += 1
        ends = sorted({y for *_, y in a} & {y for *_, y in b})
        groups, start = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, x, y in a if start <= x and y <= end) + "|" + ",".join(str(i) for i, x, y in b if start <= x and y <= end))
            start = end
        found.append((len(a), len(b), groups, links))
    count = collections.Counter(pair for *_, links in found for pair in links)
    top = collections.defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(n_a, n_b, len(g), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), ";".join(g)) for n_a, n_b, g, links in found]


def check(docs: DataFrame, **how: int) -> None:
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = collections.Counter((i, *w) for (i, _), w in zip(given, by_hand([t for _, t in given])))
    rows = [tuple(r) for r in align_tokenizers(docs, vocabulary(), pieces(), **how).collect()]
    assert collections.Counter(rows) == want
    digests = align_tokenizers(docs, vocabulary(), pieces(), groups="sha256", **how).collect()
    assert collections.Counter(r["groups"] for r in digests) == collections.Counter(hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in rows)


@pytest.mark.parametrize("entries", [2_000_000, 300])
def test_alignment(odd: DataFrame, empty: DataFrame, entries: int) -> None:  # noqa: F811
    """Few entries a task: hot buckets are dealt to several."""
    more = odd.withColumns({"pair": F.lit(1), "chunk": F.lit("c"), "row": F.lit(0), "links": F.lit("x"), "slice": F.lit(1)})
    check(more.where("length(text) < 9000 OR text IS NULL"), entries_per_task=entries, bytes_per_bucket=1000)
    assert align_tokenizers(empty, vocabulary(), pieces()).collect() == []
    assert align_tokenizers(odd.where("text IS NULL"), vocabulary(), pieces()).select("groups", "n_links").distinct().collect() == [("", 0)]


def test_alignment_of_random_texts(spark: SparkSession) -> None:
    """Every kind of white space, byte fallbacks, marks of both vocabularies, strings of special tokens, repeated texts."""
    r = random.Random(8)
    marks = [" ", "  ", "\n", "\n\n", "\t", "\r\n", ";\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "▁", "<0x41>", "<s>", "</s>", "<unk>", "<|endoftext|>", "\x00", "﻿"]
    plain = ["the", "an", "don't", "we'll", "naïve", "日本語", "😀", "é", "‍", "123", "45.6", "#$%", "...", "ſ", "ﬁ", "½", "Ⅷ", "𝒜", "ก็", "\U000e0001", *words(3, 30).split()]
    texts: list[str | None] = [None, "", " ", "\n", "a", " a", "a ", "  a  ", "▁", "a▁b", "\r"]
    for n in (3, 20, 200):
        texts += ["".join(r.choice(plain) + (r.choice(marks) if r.random() < 0.3 else r.choice(" \n")) for _ in range(n)) for _ in range(25)]
    texts += ["".join(r.choice(plain) + " " for _ in range(60)).strip() for _ in range(40)] * 2
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x20, 0xD800), r.randrange(0xE000, 0x1FFFF)])) for _ in range(150)) for _ in range(25)]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    check(docs, entries_per_task=5000, bytes_per_bucket=4000)
    both = aligner(vocabulary(), pieces())
    assert both.by_stretch and sum(t is not None and both.aligned([t]) != [None] for t in texts) > 100 and len(both.new) > 200


def test_postings_survive_many_chunks(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    from wayline.llm import alignment

    docs = spark.createDataFrame([(i, words(i % 7, 40) + " the end") for i in range(90)], "doc_id long, text string").repartition(2)
    small = alignment.postings(docs, vocabulary(), pieces(), 5, "text", links_at_once=300)
    assert small.select("chunk").distinct().count() > 20
    rows = small.where("bucket >= 0").collect()
    for r in rows:
        doc, times = alignment.posts_of(r["posts"], sum(r["entries"]))
        starts = [0, *[sum(r["entries"][: i + 1]) for i in range(len(r["entries"]))]]
        assert [int(times[a:b].sum()) for a, b in zip(starts, starts[1:])] == r["links"]
        assert {p // 65536 % 5 for p in r["pair"]} == {r["bucket"]} and r["pair"] == sorted(r["pair"])
