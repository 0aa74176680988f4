"""The filter audit against a count of every document in every order."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, empty, odd, words  # noqa: F401
from wayline.llm.filter_audit import OUTCOMES, audit_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(docs: list[tuple], labels: list[tuple]) -> dict[tuple, list[int]]:
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, text, part in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {x for x, bad in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t))) if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            fails.add("E")
        judged.append((part or "", fails, i in good, i in toxic))
    out: dict[tuple, list[int]] = {}
    for part in {j[0] for j in judged}:
        lost = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                n = [0] * 7
                for p, fails, g, x in judged:
                    if p != part:
                        continue
                    gone = bool(fails & set(order[: step - 1]))
                    n[0] += not gone and f not in fails
                    n[1] += not gone and f in fails
                    n[2] += gone and f in fails
                    n[3] += fails == {f}
                    n[4] += not gone and f in fails and g
                    n[5] += not gone and f in fails and x
                lost[f] += n[1]
                out[part, order, step] = n
        for (p, order, step), n in out.items():
            if p == part:
                n[6] = lost[order[step - 1]]
    return out


def got(docs: DataFrame, labels: DataFrame) -> dict[tuple, list[int]]:
    rows = audit_filters(docs, labels).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): [r[o] for o in OUTCOMES] for r in rows}


def test_audit_of_odd_rows(spark: SparkSession, odd: DataFrame, empty: DataFrame) -> None:  # noqa: F811
    labels = [(10, 1, 0), (10, 0, 1), (40, 1, None), (None, 1, 1), (70, None, 1), (120, 1, 0), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"good": F.lit("x"), "part": F.lit(1), "text": F.lit(2)})
    docs = odd.withColumns({"digest": F.lit(1), "mask": F.lit("m"), "part": F.lit(0), "good": F.lit(2), "salt": F.lit("s")})
    assert got(docs, table) == by_hand([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], labels)
    assert got(empty, table) == {}
    assert got(docs, table.limit(0)) == by_hand([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], [])


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_of_random_rows(spark: SparkSession, seed: int) -> None:
    """Texts at each filter's edge, copies over parts, repeated and missing ids."""
    r = random.Random(seed)
    texts = [words(k, 100) for k in range(3)] + [words(k, 99) for k in range(3)] + [" ".join(words(5, 80).split() + ["same"] * 20), " ".join(words(6, 81).split() + ["same"] * 19)]
    texts += ["A" + "b" * 9, "A" * 2 + "b" * 9, "x # y", "", None, "é" * 9 + "Z", " " * 120, " ".join(f"w{i}" for i in range(120)) + " 50%"]
    docs = [(r.choice([None, *range(25)]), r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(90)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 25, 2)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    assert got(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == by_hand(docs, labels)
