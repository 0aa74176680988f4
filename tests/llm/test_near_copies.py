"""The near-dedup stage against brute-force Jaccard similarity, and rows whose ids are null or repeat."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

import corpus_pipeline
from tests.llm.test_operators import roots, words
from wayline.llm.near_copies import first_of_near_copies
from wayline.llm.simhash import near_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str) -> set[tuple[str, ...]]:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited(r: random.Random, base: list[str], edits: int) -> str:
    copy = list(base)
    for k in r.sample(range(len(copy)), edits):
        copy[k] = "zz%d" % r.randint(0, 9999)
    return " ".join(copy)


@pytest.mark.parametrize(("rounds", "most"), [(2, 1024), (0, 7), (1, 1024)])
def test_stage_is_brute_force_jaccard(spark: SparkSession, rounds: int, most: int) -> None:
    r, texts = random.Random(11), []
    for i in range(50):  # similarities from about 0.5 to 1, and chains
        base = words(5000 + i, r.choice([30, 80, 200])).split()
        texts += [edited(r, base, max(0, round(len(base) * share))) for share in (0, 0.01, 0.02, 0.025, 0.03, 0.05)]
    common = words(9, 40)
    texts += [common + " " + words(7000 + i, 15) for i in range(40)]  # a common passage, and no copies
    sets = [shingles(t) for t in texts]
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)
    got = first_of_near_copies(docs, rounds=rounds, most_in_tile=most).collect()
    first = {}
    for i, root in enumerate(want):
        first.setdefault(root, i)
    assert 90 < len(first) < len(texts) - 50
    assert sorted(x["doc_id"] for x in got) == sorted(first.values())


def test_stage_keeps_rows_apart_whose_ids_are_null_or_repeat(spark: SparkSession) -> None:
    a, b, c, d, e = (words(60 + i, 60) for i in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, c), (9, e), (None, e), (9, e)]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], SCHEMA)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(((x["doc_id"] or 0, x["text"]) for x in got)) == sorted([(0, a), (0, b), (3, c), (7, d), (9, e)])
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_stage_links_by_simhash_what_shares_no_sketch_hash(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Copies without the shingle of the least hash, so that sketches of one hash have nothing in common."""
    from pyspark.sql import functions as F

    from wayline.llm import near_copies
    from wayline.llm.simhash import shingle_hashes

    made = {i: words(300 + i, 3000).split() for i in range(6)}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "i int, text string")
    hashes = {x["i"]: [h % 2**64 for h in x["h"]] for x in table.select("i", shingle_hashes(F.col("text"), 5).alias("h")).collect()}
    rows = []
    for i, w in made.items():
        at = hashes[i].index(min(hashes[i]))
        rows += [(i, " ".join(w), "en", "s", 1), (100 + i, " ".join(w[:at] + ["changed"] + w[at + 1 :]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    asked = []
    monkeypatch.setattr(near_copies, "near_links", lambda prints: asked.append(1) or near_links(prints))
    assert sorted(x["doc_id"] for x in first_of_near_copies(docs, sketch=1).collect()) == list(range(6))
    corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert len(asked) == 2
