"""Evaluation statistics, clustered by event."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.decide import binary_label


def event_rates(rows: DataFrame) -> DataFrame:
    """(arm, event, truth, calls, rate): the accept rate of each event; its truth is its first row's label by `ordinal`."""
    told = rows.where("error IS NULL").withColumn("truth", binary_label(F.col("label"))).where("truth IS NOT NULL")
    return told.groupBy("arm", "event").agg(F.min_by("truth", "ordinal").alias("truth"), F.count("*").alias("calls"), F.avg((F.col("decision") == "accept").cast("double")).alias("rate"))


def arm_rates(rows: DataFrame) -> DataFrame:
    """Events and mean accept rate of each arm and truth: recall for true events, false accepts for others."""
    return event_rates(rows).groupBy("arm", "truth").agg(F.count("*").alias("events"), F.avg("rate").alias("rate"))


def verified(rows: DataFrame) -> DataFrame:
    """Rows that the owner labelled."""
    return rows.where(F.lower(F.trim(F.coalesce("labelled_by", F.lit("")))) == "owner")


def confusion(rows: DataFrame) -> DataFrame:
    """Calls of each label of an event and damage type."""
    told = rows.where("error IS NULL").where(binary_label(F.col("label")).isNotNull())
    first = told.groupBy("arm", "event").agg(F.min_by("label", "ordinal").alias("event_label"))
    return told.join(first, ["arm", "event"]).groupBy("arm", "event_label", F.coalesce("damage_type", F.lit("none")).alias("damage_type")).agg(F.count("*").alias("calls"))


def interval(values: list[float], seed: int = 17, samples: int = 3000) -> tuple[float, float, float]:
    """Mean and the 95 % percentile bootstrap of it; zeros for no values."""
    if not values:
        return 0.0, 0.0, 0.0
    draw, n = random.Random(seed), len(values)
    means = sorted(sum(values[draw.randrange(n)] for _ in range(n)) / n for _ in range(samples))
    return sum(values) / n, means[int(0.025 * samples)], means[int(0.975 * samples)]


#: Steps of the distribution of Poisson counts of mean 1, of 16^12: a number below the k-th is a count under k.
POISSON = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k)) * 16**12) for k in range(1, 13)]
#: Rates are added up as whole numbers of this part, so that no order of adding shows.
RATE_UNIT = 10**12


def bootstrap(rates: DataFrame, samples: int = 3000, seed: int = 17) -> DataFrame:
    """(arm, truth, events, mean, low, high) of event rates: the mean, and the 95 % percentile interval of its resamples.

    Every event stands in every resample as often as a Poisson number of mean 1 says, which is drawn from a digest of seed, arm,
    truth, event and resample: the same in any order and partitioning, and no task needs an arm's events together. Against draws
    of exactly as many events the interval differs by the chance of `samples` resamples, and by the square of 1 / events. A resample without any event has the mean.
    """
    scaled = rates.select("arm", "truth", "event", F.round(F.col("rate") * RATE_UNIT).cast("long").alias("units"))
    drawn = F.concat_ws(":", F.lit(str(seed)), F.coalesce("arm", F.lit("")), F.col("truth").cast("string"), F.coalesce("event", F.lit("")), "sample")
    number = F.conv(F.substring(F.md5(drawn), 1, 12), 16, 10).cast("long")
    times = sum(((F.col("number") >= step).cast("int") for step in POISSON), F.lit(0))
    each = scaled.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("number", number).withColumn("times", times)
    sums = each.groupBy("arm", "truth", "sample").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("units")).alias("units"))
    whole = scaled.groupBy("arm", "truth").agg(F.count("*").alias("events"), (F.sum("units") / F.count("*") / RATE_UNIT).alias("mean"))
    means = sums.select("arm", "truth", F.when(F.col("n") > 0, F.col("units") / F.col("n") / RATE_UNIT).alias("m"))
    lists = means.groupBy("arm", "truth").agg(F.collect_list("m").alias("m"), F.count_if(F.col("m").isNull()).alias("none"))
    full = whole.join(lists, (whole["arm"].eqNullSafe(lists["arm"])) & (whole["truth"] == lists["truth"])).select(whole["arm"], whole["truth"], "events", "mean", F.array_sort(F.concat("m", F.array_repeat("mean", F.col("none").cast("int")))).alias("m"))
    at = lambda share: F.get("m", F.lit(int(share * samples)))
    return full.select("arm", "truth", "events", "mean", at(0.025).alias("low"), at(0.975).alias("high"))
