"""Every corpus operator on odd rows and against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.anchors import anchors_of
from wayline.llm.deep_shallow import deep_shallow_sort
from wayline.llm.html_text import extract_text
from wayline.llm.line_dedup import dedup_lines
from wayline.llm.mixing import mix_sources
from wayline.llm.packing import pack_documents
from wayline.llm.packing_plan import plan
from wayline.llm.page_text import parse
from wayline.llm.quality_classifier import classify_quality
from wayline.llm.quality_rules import quality_rules
from wayline.llm.queries import vocabulary
from wayline.llm.sharding import difference, shard_by_bytes
from wayline.llm.shapes import LEVELS
from wayline.llm.simhash import near_duplicates, near_links
from wayline.llm.suffix_dedup import remove_repeats
from wayline.llm.topk import exact_top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that clash with names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, key int, size string, n_words string, kept int, rank int, _doc string, run int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    shared = words(1, 60)
    texts = [
        None, "", " \n\t ", "one", words(2, 30) + "\n" + shared, shared + "\n" + words(3, 25), words(4, 3000), "the the " * 40, "x" * 5000,
        "näïve ünïcode 日本語 " * 20, shared.upper(), "A! B! C! " * 30, shared, shared,
    ]
    rows = [(i * 10, t, "en", f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]
    rows += [(40, texts[4], "en", "s1", 5), (40, "another text of the same id " * 9, None, "s1", 5), (None, shared, None, None, None), (None, None, None, None, None)]
    return [(*r, "b", 1, "s", "w", 0, 3, "d", 7) for r in rows]


@pytest.fixture(scope="module")
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(50, 1, 0), (60, 1, 0), (70, 0, None), (80, None, 1), (50, 1, 0), (None, 1, 0), (110, 0, 0)], "doc_id long, quality int, toxic int")


def test_mix(odd: DataFrame, empty: DataFrame) -> None:
    assert mix_sources(empty).count() == 0
    got = mix_sources(odd).collect()
    assert len(got) == len(odd_rows())
    size, target, taken = {}, {}, collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
        taken[r["source"]] += r["taken"]
    # Water-filling by repeated sharing.
    total, weight = 1.5 * sum(size.values()), dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1, 5)))
    full: dict = {}
    while True:
        level = (total - sum(full.values())) / max(1, sum(w for s, w in weight.items() if s not in full))
        over = [s for s in weight if s not in full and level * weight[s] >= 2 * size[s]]
        if not over:
            break
        full |= {s: 2 * size[s] for s in over}
    for s in size:
        assert target[s] == pytest.approx(full.get(s, level * weight[s]))
        assert taken[s] == int(target[s] + 1e-9)
    whole = mix_sources(odd, cut="document", carry=["text"]).collect()
    assert all(r["taken"] == r["copies"] * r["size"] for r in whole)


def test_mix_does_not_depend_on_the_order_of_rows(spark: SparkSession) -> None:
    """Texts of one size without an id, and of one id, are taken in the order of their digests."""
    rows = [(None if i % 2 else 7, words(i, 31), "s", i) for i in range(60)] + [(None, words(1, 31), "s", 99)]
    runs = []
    for n in (1, 7):
        table = spark.createDataFrame(rows, "doc_id long, text string, source string, more int").repartition(n, "more")
        runs.append(sorted((r["carried"]["text"], r["carried"]["more"], r["copies"]) for r in mix_sources(table, share=0.5, cut="document", carry=["text", "more"]).collect()))
    assert runs[0] == runs[1] and 20 < sum(c for *_, c in runs[0]) < 41


def brute_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    ws = WORD.findall(text)
    windows = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute_grams(text: str | None) -> list[int]:
    shaped = text or ""
    for pattern, to in LEVELS:
        shaped = regex.sub(pattern, to, shaped)
    ws, raw = WORD.findall(shaped), WORD.findall(text or "")
    assert len(ws) == len(raw)
    h = lambda x: xxhash.xxh64(x.encode(), seed=42).intdigest()
    pair = lambda a, b: (a << 1) % (1 << 64) ^ b
    two, shapes, own = range(len(ws) - 1), [h(w) for w in ws], [h(w) for w in raw]
    return [(pair(shapes[i], shapes[i + 1]) >> 51 << 1) + (raw[i] == raw[i + 1]) for i in two] + [16384 + (x >> 48) for x in own]


def test_quality_rules(odd: DataFrame, empty: DataFrame, labels: DataFrame) -> None:
    trusted = labels.where("quality = 1")
    assert quality_rules(empty, trusted).count() == 0
    got = quality_rules(odd, trusted).collect()
    rows = odd_rows()
    assert len(got) == len(rows) and all(r["lang"] in ("en", None) and r["bucket"] == "b" for r in got)
    raw, target = np.zeros(16384 + 65536), np.zeros(16384 + 65536)
    for r in rows:
        for g in brute_grams(r[1]):
            raw[g] += 1
            target[g] += r[0] in (50, 60)
    weight = np.zeros(len(raw))
    for kind in (slice(0, 16384), slice(16384, None)):
        r, t = raw[kind], target[kind]
        share = r / r.sum()
        weight[kind][r > 0] = np.log((t + 0.5 * len(r) * share)[r > 0] / (t.sum() + 0.5 * len(r)) / share[r > 0])
    for r in got:
        n, chars, symbols, dup, repeat = brute_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        grams = brute_grams(r["text"])
        score = sum(weight[g] for g in grams) / len(grams) if grams else None
        assert r["score"] == (score if score is None else pytest.approx(score, abs=1e-9))
        assert r["kept"] == (not r["base_failed"] and score is not None and score >= -0.05)
    assert quality_rules(odd, trusted.limit(0)).count() == len(rows)
    joined = quality_rules(odd, trusted, most_broadcast=1)  # a list of trusted ids that is not broadcast
    assert sorted((r["score"] is None, round(r["score"] or 0, 12)) for r in joined.collect()) == sorted((r["score"] is None, round(r["score"] or 0, 12)) for r in got)


def test_quality_rules_tell_texts_by_their_words_alone(spark: SparkSession) -> None:
    """Two vocabularies of words of the same shape: what is kept follows the trusted one."""
    good, bad = words(51, 40).split(), words(52, 40).split()
    r = random.Random(9)
    docs = [(i, " ".join(r.choices(good if i % 2 else bad, k=300))) for i in range(200)]
    out = quality_rules(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(1, 60, 2)], "doc_id long"))
    assert all(x["kept"] == (x["doc_id"] % 2 == 1) for x in out.collect() if not x["base_failed"])


def test_classifier(spark: SparkSession, odd: DataFrame, empty: DataFrame, labels: DataFrame) -> None:
    assert classify_quality(empty, labels).count() == 0
    got = classify_quality(odd, labels).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    assert len({r["score"] for r in classify_quality(odd, labels.limit(0)).collect()}) == 1
    good = [(i, " ".join(w.capitalize() + "," if k % 7 == 0 else w for k, w in enumerate(words(i, 40).split())), 1) for i in range(200)]
    bad = [(i, " ".join(w.upper() + "!!" for w in words(i, 40).split()), 0) for i in range(200, 260)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    out = {r["doc_id"]: r for r in classify_quality(table.drop("quality"), table.select("doc_id", "quality")).collect()}
    held = [(out[i]["predicted"], q) for i, _, q in good + bad if out[i]["held_out"]]
    assert len(held) > 20 and sum(p == q for p, q in held) / len(held) > 0.97


def test_classifier_on_words_ties_and_long_texts(spark: SparkSession) -> None:
    """Classes that differ in vocabulary alone; equal texts get equal scores; a text of 30,000 words is read whole."""
    good, bad = words(61, 200).split(), words(62, 200).split()
    r = random.Random(10)
    docs = [(i, " ".join(r.choices(good if i % 3 else bad, k=40))) for i in range(300)]
    docs += [(1000, docs[1][1]), (1001, " ".join(r.choices(bad, k=30_000))), (1002, " ".join(r.choices(good, k=30_000)))]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    out = {x["doc_id"]: x for x in classify_quality(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()}
    held = [i for i in range(300) if out[i]["held_out"]]
    assert len(held) > 30 and all(out[i]["predicted"] == (i % 3 > 0) for i in held)
    assert out[1000]["score"] == out[1]["score"] and out[1001]["predicted"] == 0 and out[1002]["predicted"] == 1
    few = classify_quality(spark.createDataFrame(docs, "doc_id long, text string"), labels, sample_rows=50, sample_grams=20_000)
    assert few.count() == len(docs)


def brute_print(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    hashes = [xxhash.xxh64(" ".join(ws[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return [top(i) for i in range(n)]


def test_simhash(odd: DataFrame, empty: DataFrame) -> None:
    assert near_duplicates(empty).count() == 0
    got = near_duplicates(odd).collect()
    rows = odd_rows()
    prints = {(r[0], brute_print(r[1])) for r in rows}
    assert {(r["doc_id"], int(r["fingerprint"], 16)) for r in got} == prints and len(got) == len(rows)
    known = sorted(p for _, p in prints)
    pairs = [(i, j) for i in range(len(known)) for j in range(i) if bin(known[i] ^ known[j]).count("1") <= 2]
    root = dict(zip(known, roots(len(known), pairs)))
    for r in got:
        mine = [d for d, p in prints if root[p] == root[int(r["fingerprint"], 16)] and d is not None]
        assert r["component_id"] == (min(mine) if mine else None)


@pytest.mark.parametrize("most", [4096, 12, 1])
def test_links_of_random_fingerprints(spark: SparkSession, most: int) -> None:
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base[:40]:
        for _ in range(6):
            x = b
            for bit in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << bit
            prints.add(x)
    dense = r.getrandbits(64)  # fingerprints that share most bits: blocks that are split
    prints |= {dense ^ sum(1 << bit for bit in r.sample(range(40, 60), r.randint(0, 8))) for _ in range(400)}
    known = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in known], "fingerprint long")
    found = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in near_links(table, most_in_block=most).collect()]
    place = {p: i for i, p in enumerate(known)}
    want = [(i, j) for i in range(len(known)) for j in range(i) if bin(known[i] ^ known[j]).count("1") <= 2]
    assert want and roots(len(known), want) == roots(len(known), [(place[a], place[b]) for a, b in found])


def test_packing(odd: DataFrame, empty: DataFrame) -> None:
    from public_tokenizers import path
    from tokenizers import Tokenizer

    assert pack_documents(empty, vocabulary()).count() == 0
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    docs = odd.unionByName(odd.sparkSession.createDataFrame([(999, " a  b <|endoftext|>\n\n\tc " + "  ".join(words(9, 900).split()), *odd_rows()[0][2:])], SCHEMA))
    got = pack_documents(docs, vocabulary()).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"], r["copy"]].append(r)
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want[r["doc_id"], tuple((a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:]))] += 1
    assert want == collections.Counter((k[0], tuple((r["start"], r["length"], r["ids_crc32"]) for r in sorted(v, key=lambda r: r["piece"]))) for k, v in by.items())
    rows = collections.defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in rows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_tokens_of_random_texts() -> None:
    """The ranks give the ids of the named tokenizer file on any Unicode, spaces and the added token included."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from wayline.llm.tokens import ids_of

    tokenizer, r = Tokenizer.from_file(path("byte_bpe_50k.json")), random.Random(17)
    pieces = [" ", "  ", "\n", "\t", "\u00a0", "'s", "'LL", "don't", "é", "日本", "🙂", "0123", "٣", "<|endoftext|>", "<|end", "\u200d", "\x00", "a\u0301", "--", "The", "ing"]
    texts = ["".join(r.choice(pieces) if r.random() < 0.6 else chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x2FF), r.randint(0x4E00, 0x4F00), r.randint(0x1F300, 0x1F5FF)])) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    assert [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)] == [ids_of(t, vocabulary()) for t in texts]


def test_plan_places_each_item_once_and_tightly() -> None:
    r = random.Random(3)
    for draw in (lambda: r.randint(1, 2048), lambda: min(2048, int(r.lognormvariate(6.3, 1)) + 1), lambda: 700):
        lengths = collections.Counter(draw() for _ in range(4000))
        runs = plan(dict(lengths), 2048)
        used = collections.Counter()
        for run in runs:
            assert sum(run.lengths) <= 2048
            for x in run.lengths:
                used[x] += run.count
        least = max(-(-sum(k * n for k, n in lengths.items()) // 2048), -(-lengths[700] // 2) if len(lengths) == 1 else 0)
        assert used == lengths and sum(run.count for run in runs) <= 1.03 * least + 2
    assert plan({}, 2048) == []


def test_line_dedup(spark: SparkSession, odd: DataFrame, empty: DataFrame) -> None:
    assert dedup_lines(empty).count() == 0
    got = dedup_lines(odd).collect()
    assert len(got) == len(odd_rows()) and all(r["bucket"] == "b" for r in got)
    assert sum(r["text"] is None for r in got) == 2
    assert {r["text"] for r in got if r["doc_id"] in (120, 130)} == {""}
    long = [words(100 + i, 12) for i in range(8)]
    # 48 words stay, 60 go; blank lines do not part a run; a short tail of a repeated run goes with it.
    docs = [(1, "\n".join(long)), (2, "\n".join(["own", *long[:4], "own too"])), (3, "\n".join(["own", *long[:3], "", *long[3:6], "end"])), (4, "\n".join(long[2:4] * 4))]
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[1]["text"] == docs[0][1] and out[2]["text"] == docs[1][1]
    assert out[3]["text"] == "own\nend" and out[3]["n_removed_lines"] == 6
    assert out[4]["text"] == "\n".join(long[2:4])


def brute_lines(docs: list[tuple[int, str]], least: int = 50) -> dict[int, list[int]]:
    """Lines to delete, from every run of lines of every document against every earlier run."""
    seen: set = set()
    out = {}
    for i, t in sorted(docs):
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if WORD.search(x)]
        gone: set[int] = set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(WORD.findall(lines[b][1]))
                run = tuple(x for _, x in lines[a : b + 1])
                if n >= least and run in seen:
                    gone.update(range(lines[a][0], lines[b][0] + 1))
                seen.add(run)
        out[i] = sorted(gone)
    return out


def test_line_dedup_against_all_runs(spark: SparkSession) -> None:
    r = random.Random(31)
    pool = [words(400 + i, r.choice([1, 2, 5, 9, 15, 30, 60])) for i in range(14)]
    docs = []
    for i in range(70):
        lines = [r.choice(pool) if r.random() < 0.8 else words(r.randint(0, 10**6), r.randint(1, 12)) for _ in range(r.randint(1, 40))]
        if i and r.random() < 0.4:
            other = r.choice(docs)[1].split("\n")
            a = r.randrange(len(other))
            lines[r.randrange(len(lines)) :] = other[a : a + r.randint(1, 30)]
        lines.insert(r.randint(0, len(lines)), r.choice(["", "  "]))
        docs.append((i, "\n".join(lines)))
    docs.append((70, "\n".join(["one"] * 300)))  # a line repeated on and on
    docs.append((71, "\n".join([pool[0], *["one"] * 120])))
    want = brute_lines(docs)
    got = {x["doc_id"]: x["text"] for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert sum(map(len, want.values())) > 200
    for i, t in docs:
        assert got[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(want[i])), i


def brute_repeats(docs: list[tuple[int, str | None]]) -> dict:
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                cover[s : s + 100] = True
            seen.add(b[s : s + 100])
        runs = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())
    return out


def test_suffix_dedup(spark: SparkSession, odd: DataFrame, empty: DataFrame) -> None:
    assert remove_repeats(empty).count() == 0
    r = random.Random(8)
    # Ids of any 64 bits, missing and repeated ones: in the order of the ids, null last, then of the texts' digests.
    given = [(x[0], x[1] or "") for x in odd_rows() if len(x[1] or "") < 9000]
    given += [(i, words(90 + k % 3, 30) + words(95, 25)) for k, i in enumerate((2**63 - 1, -(2**63), 2**63 - 1, 5 * 10**18, None, None, 5 * 10**18, 0, -1))]
    order = sorted(set(given), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    found = brute_repeats(list(enumerate(t for _, t in order)))
    expected = collections.Counter((x[0], *found[order.index(x)]) for x in given)
    rows = spark.createDataFrame(given, "doc_id long, text string").withColumns({"doc": F.lit(1), "bucket": F.lit("b"), "digest": F.lit("d"), "no_id": F.lit(2), "id": F.lit("i")})
    got = collections.Counter((x["doc_id"], x["n_bytes"], sum(s["end"] - s["begin"] for s in x["spans"]), len(x["spans"]), hashlib.sha256(x["kept"]).hexdigest()) for x in remove_repeats(rows.repartition(4)).collect())
    assert got == expected
    base = [words(200 + i, 60) for i in range(5)]
    docs: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "a" * 700), (3, base[0] + "é" * 80), (4, "é" * 120)]
    for i in range(5, 60):
        t = list(words(300 + i, 20) + r.choice(base)[r.randint(0, 90) :] + r.choice(base)[: r.randint(80, 300)] + ("ab" * r.randint(0, 150)))
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice("XYZ")
        docs.append((i, "".join(t)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute_repeats(docs)
    for x in remove_repeats(table).collect():
        removed = sum(s["end"] - s["begin"] for s in x["spans"])
        assert (x["n_bytes"], removed, len(x["spans"]), hashlib.sha256(x["kept"]).hexdigest()) == want[x["doc_id"]], x["doc_id"]


@pytest.mark.parametrize("most", [20_000, 3])
def test_suffix_dedup_decides_on_bytes(spark: SparkSession, most: int) -> None:
    """Texts that differ in 64 bits that round up to a power of two, and a line in all texts, with gram groups of any size."""
    r, docs = random.Random(12), []
    line = words(77, 14)[:95]
    for i in range(80):
        shared = words(900 + i, 25)[:100]
        docs.append((2 * i, words(1000 + i, 9) + "prefix00" + "é" * 6 + shared + line + r.choice("xyz")))
        docs.append((2 * i + 1, words(2000 + i, 9) + "prefix00" + "<V" * 6 + shared + line + r.choice("xyz")))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute_repeats(docs)
    assert any(w[1] for w in want.values())
    for x in remove_repeats(table, most_contexts=most).collect():
        removed = sum(s["end"] - s["begin"] for s in x["spans"])
        assert (x["n_bytes"], removed, len(x["spans"]), hashlib.sha256(x["kept"]).hexdigest()) == want[x["doc_id"]], x["doc_id"]


def test_common_prefixes_of_words_that_round_up() -> None:
    rows = np.array([list(t.encode()) for t in ("prefix00ééééézz", "prefix00<V<V<V<V<Vzz")], np.uint8)
    assert list(deep_shallow_sort(np.zeros(2, int), rows)[1]) == [-1, 8]


def test_anchors_of_long_texts_do_not_depend_on_parts(monkeypatch: pytest.MonkeyPatch) -> None:
    import wayline.llm.anchors as a

    text = words(5, 4000).encode()
    whole = anchors_of(text)
    monkeypatch.setattr(a, "PART", 1000)
    for x, y in zip(whole, a.anchors_of(text)):
        assert (x == y).all()


def test_deep_shallow_sort() -> None:
    r = np.random.default_rng(0)
    for trial in range(60):
        n, width = int(r.integers(1, 200)), int(r.choice([5, 68, 100]))
        base = r.integers(0, 2 + trial % 3, (max(1, n // 8), width)).astype(np.uint8)
        rows = base[r.integers(0, len(base), n)].copy()
        rows[np.arange(n), r.integers(0, width, n)] = r.integers(0, 256, n)
        group = r.integers(0, 1 + trial % 5, n)
        order, lcp = deep_shallow_sort(group, rows)
        keys = [(group[i], rows[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        for k in range(n):
            if k == 0 or keys[k][0] != keys[k - 1][0]:
                assert lcp[k] == -1
            else:
                differ = np.flatnonzero(rows[order[k]] != rows[order[k - 1]])
                assert lcp[k] == (differ[0] if len(differ) else width)


def test_top_k(spark: SparkSession) -> None:
    r = random.Random(2)
    rows = [(i, [r.randint(-9, 9) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(None, [1] * 8), (700, None), (800, [1, 2]), (800, [1, 2]), (900, [3, 4]), (1000, [])]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    asked = table.where("vec_id % 100 = 0")
    got = {}
    for x in exact_top_k(table, asked, k=5, block_rows=64, query_rows=2).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    for q in {i for i, v in rows if i is not None and v is not None and i % 100 == 0}:
        mine = min(v for i, v in rows if i == q)
        best = sorted(((-sum(a * b for a, b in zip(mine, v)), i) for i, v in rows if i not in (None, q) and v is not None and len(v) == len(mine)))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert exact_top_k(table.limit(0), asked.limit(0)).count() == 0


def test_top_k_of_clusters_and_odd_vectors(spark: SparkSession) -> None:
    """Blocks that are eliminated; components that are null, NaN or infinite; columns whose names clash."""
    from wayline.llm.topk import whole_components

    r = random.Random(13)
    centres = [[r.uniform(-5, 5) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in centres[i % 8]], i, "b") for i in range(900)]
    rows += [(900, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "b"), (1000, [float("nan")] * 6, 1, "b"), (1100, [float("inf")] * 6, 1, "b"), (1200, None, 1, "b")]
    table = spark.createDataFrame(rows, "vec_id long, e array<double>, width int, block string")
    vectors = table.select("*", whole_components("e").alias("v")).drop("width").withColumn("cell", F.lit("c"))
    sound = {x["vec_id"]: x["v"] for x in vectors.collect() if x["v"] is not None}
    assert set(sound) == set(range(900))
    got = collections.defaultdict(list)
    for x in exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, pivots=8, block_rows=50, query_rows=3, probe_rows=60).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    for q in range(0, 900, 100):
        best = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == set(range(0, 900, 100))


def test_top_k_does_not_wrap(spark: SparkSession) -> None:
    rows = [(i, [3_000_000_000 + i] * 4, "x") for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>, width string")
    with pytest.raises(Exception, match="64 bits"):
        exact_top_k(vectors, vectors.where("vec_id = 0"), k=3).collect()
    large = spark.createDataFrame([(i, [2**30 - i, -(2**30), 5], "x") for i in range(30)], "vec_id long, v array<long>, width string")
    best = exact_top_k(large, large.where("vec_id = 3"), k=2).orderBy("rank").collect()
    value = lambda i: (2**30 - 3) * (2**30 - i) + 2**60 + 25
    assert [(r["vec_id"], r["score"]) for r in best] == [(0, value(0)), (1, value(1))]


def test_sharding(odd: DataFrame, empty: DataFrame) -> None:
    assert shard_by_bytes(empty).count() == 0
    got = shard_by_bytes(odd, groups_per_task=4).collect()
    text = {zlib.crc32((r[1] or "").encode()): len((r[1] or "").encode()) + 1 for r in odd_rows()}
    assert len(got) == len(odd_rows()) and all(text[r["text_crc32"]] == r["size"] for r in got)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(len({r["shard"] for r in got if r["text_crc32"] == c}) == 1 for c in text)
    r = random.Random(1)
    sizes = [int(r.lognormvariate(7, 1)) + 1 for _ in range(5000)]
    where, sums = difference([[s] + [0] * 7 for s in sizes])
    check = collections.Counter()
    for s, w in zip(sizes, where):
        check[w[0]] += s
    assert [check[k] for k in range(8)] == sums and max(sums) - min(sums) <= 8


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p title=it's>hello</p>", "hello"),
        ("<div class='content has-sidebar'><p>the body</p></div>", "the body"),
        ("<div id='social-housing'><p>the body</p></div><article><p>some words more than all of the body</p><div id=social-housing>flats</div></article>", "some words more than all of the body\nflats"),
        ("<div class='post-comment-count'><p>the body</p></div>", "the body"),
        ("<article>teaser</article><div>a far longer body outside of it</div>", "teaser\na far longer body outside of it"),
        ("<article><p>words of the article</p><section class=comments><article>nice</article></section></article>", "words of the article"),
        ("<form><p>all of an old page</p><input></form>", "all of an old page"),
        ("<p a='open>in</p>after", "in\nafter"),
        ("a</ x>b<!doctype html>c<p hidden>d", "abc"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1\n2\n3"),
        ("<p>one <button>press</button> two</p>", "one two"),
    ],
)
def test_page_rules(source: str, want: str) -> None:
    assert parse(source).text() == want


@pytest.mark.parametrize("source", ["<div>" * 60_000 + "x", "<div>" * 60_000 + "</section>" * 60_000 + "x", "<div>x " * 40_000, "<b>" * 40_000 + "x", "<div " * 40_000, "<li><div>" * 30_000])
def test_deep_pages_take_linear_time(source: str) -> None:
    start = time.process_time()
    parse(source).text()
    assert time.process_time() - start < 8


def test_templates_of_any_size_against_a_count(spark: SparkSession) -> None:
    """Footers of 300 words and short lists, some on few pages: dropped where a count over different main texts says so."""
    legal, rare = words(70, 300), words(71, 30)
    rows = []
    for i in range(60):
        parts = [f"<div><p>{words(5000 + i, 60)}</p></div>", f"<div><p>{legal}</p></div>", f"<ul><li>home {'x' * (i % 3)}</li></ul>"]
        parts += [f"<section><div>{rare}</div></section>"] * (i < 9)
        rows.append((i, f"http://h{i % 2 if i >= 9 else 0}.org/{i}", "<body><main>" + "".join(parts) + "</main></body>"))
    rows += [(100 + k, "http://h0.org/copy", rows[3][2]) for k in range(40)]  # copies of a page count once
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(60):
        assert got[i].startswith(words(5000 + i, 60)) and legal not in got[i] and (rare in got[i]) == (i < 9)
    assert all(got[100 + k] == got[3] for k in range(40))


def test_shards_of_several_levels(spark: SparkSession) -> None:
    """Balance over many tasks and levels, equal texts together, ties, and reruns that agree."""
    r = random.Random(23)
    docs = [(i, "x" * 40 if i % 9 == 0 else words(i, r.randint(1, 60))) for i in range(1500)] + [(2000 + i, None) for i in range(5)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    runs = [shard_by_bytes(table.repartition(n), groups_per_task=16, sums_per_task=4).collect() for n in (2, 5)]
    key = lambda x: (x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"])
    assert sorted(map(key, runs[0])) == sorted(map(key, runs[1]))
    size, of_text = collections.Counter(), collections.defaultdict(set)
    for x in runs[0]:
        size[x["shard"]] += x["size"]
        of_text[x["text_crc32"]].add(x["shard"])
    assert len(size) == 8 and all(len(s) == 1 for s in of_text.values())
    assert max(size.values()) - min(size.values()) <= 400  # a text has 40 to 480 bytes; the group of 167 equal ones is indivisible


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1><nav><a>Home</a></nav></header>
<div class="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1><p>One<br>two &nbsp; three %s<p>Para <b>bold</b> x</p><div class="ad-slot">buy</div>
<div>Powered by %s</div><ul><li>a%s<li>b</ul><form>search</form><section id="comments"><p>nice!</p></section></article><aside>side</aside></main><footer>f</footer></body></html>"""


@pytest.mark.parametrize("rows", [130_000, 0])
def test_shards_fill_up_what_a_hot_text_leaves(spark: SparkSession, rows: int) -> None:
    """More groups than a task takes, and a text under a shard's share, over a bucket's: sums differ by less than a typical text."""
    ids = spark.range(rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.repeat(F.lit("y"), (F.col("id") % 170).cast("int")), F.col("id").cast("string")).alias("text"))
    docs = ids.unionByName(spark.range(500_000, 510_000).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text")))
    got = shard_by_bytes(docs.repartition(6)).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert all(r["n"] == r["slots"] == r["last"] + 1 for r in got)
    assert rows == 0 or max(r["bytes"] for r in got) - min(r["bytes"] for r in got) <= 20
    assert sum(r["n"] for r in got) == rows + 10_000


def test_html(spark: SparkSession) -> None:
    assert parse("plain <b>text</b> only < 3 <p>x").text() == "plain text only < 3\nx"
    rows = [(i, f"http://h.org/{i}", PAGE % (i, "engine", i)) for i in range(12)] + [(20, "http://other.org/1", PAGE % (1, "engine", 1)), (21, None, None), (21, None, None), (22, "odd", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in extract_text(pages).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    assert got[3] == ["Title & more\nOne two three 3\nPara bold x\na3\nb"]  # the template div recurs on every page of its host
    assert got[20] == ["Title & more\nOne two three 1\nPara bold x\nPowered by engine\na1\nb"]
    assert got[21] == ["", ""] and got[22] == [""] and len(got) == 15
    assert extract_text(pages.limit(0)).count() == 0
