"""Places by an index of letter pairs against all pairs, and resampled rates against seeded draws."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import SparkSession

from wayline.operators.evalstats import bootstrap, interval
from wayline.operators.tenders import letter_pairs, similar_keys


@pytest.mark.parametrize(("least", "size"), [(0.9, 1200), (0.75, 250), (0.4, 60)])
def test_similar_keys_against_all_pairs(spark: SparkSession, least: float, size: int) -> None:
    """Names that differ by letters changed, lost, added and swapped, very short ones and long ones."""
    r = random.Random(size)
    syllables = ["ban", "ga", "lur", "pur", "na", "gar", "hal", "li", "kot", "e", "a", "tal", "uk"]
    towns = list({"".join(r.choices(syllables, k=r.randint(1, 6))) for _ in range(size)} | {"a", "ab", "abc", "b"})

    def changed(t: str) -> str:
        letters = list(t)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(letters) + 1)
            letters[k : k + r.randint(0, 2)] = r.choice(["", "x", "an", "l"])
        return "".join(letters) or "x"

    keys = list({changed(r.choice(towns)) for _ in range(size // 3)} | {"a", "ba", "abd", "c"})
    want = {(k, t): ratio for k in keys for t in towns if (ratio := difflib.SequenceMatcher(None, k, t).ratio()) >= least}
    found = similar_keys(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(t,) for t in towns], "town string"), least).collect()
    assert {(x["key"], x["town"]): x["ratio"] for x in found} == want and len(found) == len(want) > 50
    one = spark.createDataFrame([("banana",), ("a",), ("",)], "key string").select(letter_pairs("key").alias("p")).collect()
    assert [x["p"] for x in one] == [["ba1", "an1", "na1", "an2", "na2"], [], []]


def test_bootstrap_is_near_seeded_draws(spark: SparkSession) -> None:
    """Means are exact; bounds are within 0.02 of those of seeded draws for 60 events and more, whatever the partitions."""
    r = random.Random(2)
    groups = {("a", True): [r.random() for _ in range(200)], ("a", False): [r.choice([0.0, 0.0, 0.5, 1.0]) for _ in range(60)], ("b", True): [1.0], (None, True): [0.0, 1.0]}
    rows = [(arm, truth, f"e{i}", x) for (arm, truth), xs in groups.items() for i, x in enumerate(xs)]
    table = spark.createDataFrame(rows, "arm string, truth boolean, event string, rate double")
    got = [sorted(bootstrap(table.repartition(n)).collect(), key=str) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 4
    for x in got[0]:
        xs = groups[x["arm"], x["truth"]]
        mean, low, high = interval(xs)
        assert x["events"] == len(xs) and x["mean"] == pytest.approx(mean, abs=1e-9)
        if len(xs) >= 60:
            assert x["low"] == pytest.approx(low, abs=0.02) and x["high"] == pytest.approx(high, abs=0.02)
    assert next((x["low"], x["high"]) for x in got[0] if x["arm"] == "b") == (1.0, 1.0)
