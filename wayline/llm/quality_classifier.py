"""Quality classifier: naive Bayes support vectors, fitted by dual coordinate descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import bound, broadcast_if_few, stored
from wayline.llm.shapes import text_grams


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * (weights . x / |x| + bias) + shift))), with x the log-count ratios of the n-grams present."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """The weights and bias of a linear classifier with hinge loss; y is 1 or -1, a constant feature carries the bias."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def logistic_scale(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities, by Newton's method; targets are drawn in from 0 and 1 by the class sizes."""
    up, down = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-12)
        hessian = np.array([[(h * margins * margins).sum() + 1e-9, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, [(d * margins).sum(), d.sum()])
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(shift)


def _sample(docs: DataFrame, known: DataFrame, grams: Column, most_rows: int, most_grams: int) -> DataFrame:
    """(turn, quality, grams) of the labelled rows with the smallest hashes of their doc_id."""
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "quality"]
    chosen = stored(docs.select("doc_id").join(known, "doc_id").distinct().orderBy(*order).limit(most_rows), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # of at most `most_rows` documents
    first = texts.select("doc_id", "quality", F.md5("text").alias("digest"), grams.alias("grams")).orderBy(*order, "digest").limit(most_rows)
    by_turn = Window.orderBy(*order, "digest")
    return first.select("quality", "grams", F.row_number().over(by_turn).alias("turn"), F.sum(F.size("grams")).over(by_turn).alias("upto")).where(F.col("upto") <= most_grams).drop("upto")


def _fitted(frame: pd.DataFrame, ratios: np.ndarray, cost: float, rounds: int, seed: int) -> pd.DataFrame:
    """The model of one sample, its weights as bytes; no row if it has one class only."""
    frame = frame.sort_values("turn")
    y, rows = np.where(frame["quality"].to_numpy() == 1, 1, -1), list(frame["grams"])
    if len(set(y.tolist())) < 2:
        return pd.DataFrame({"weights": [b""], "bias": [0.0], "slope": [0.0], "shift": [float(np.log(((y > 0).sum() + 1) / ((y < 0).sum() + 1)))]})
    values = [(ratios[r] / max(float(np.linalg.norm(ratios[r])), 1e-9)).astype(np.float32) for r in rows]
    w, bias = dual_coordinate_descent(rows, values, y, len(ratios), cost, rounds, seed)
    slope, shift = logistic_scale(np.array([w[r] @ v + bias for r, v in zip(rows, values)]), y)
    return pd.DataFrame({"weights": [w.tobytes()], "bias": [float(bias)], "slope": [slope], "shift": [shift]})


def fit(docs: DataFrame, known: DataFrame, grams: Column, buckets: int, sample_rows: int, sample_grams: int, most_broadcast: int, cost: float = 1.0, rounds: int = 20, seed: int = 7) -> Model:
    """Fits on the texts of `docs` with a label in `known` (doc_id, quality 0/1). Log-count ratios come from all of them,
    the linear model from those with the smallest hashes of their doc_id: at most `sample_rows`, with at most
    `sample_grams` n-grams (4 bytes each), which one task gets. The driver gets numbers for each bucket only."""
    # explode_outer, since explode adds a filter on the array's size, for which the n-grams would be made twice
    labelled = docs.select("doc_id", "text").join(broadcast_if_few(known, most_broadcast), "doc_id")
    counts = labelled.select("quality", F.explode_outer(grams).alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    good, bad = np.ones(buckets), np.ones(buckets)
    for r in counts.toLocalIterator():  # at most one row for each bucket
        good[r["bucket"]] += r["good"]
        bad[r["bucket"]] += r["bad"]
    ratios = np.log(good / good.sum()) - np.log(bad / bad.sum())
    sample = _sample(docs, known, grams, sample_rows, sample_grams).withColumn("sample", F.lit(0)).groupBy("sample")
    made = sample.applyInPandas(lambda frame: _fitted(frame, ratios, cost, rounds, seed), "weights binary, bias double, slope double, shift double").first()
    if made is None or not made["weights"]:
        return Model(ratios * 0, ratios * 0, 0.0, 0.0, made["shift"] if made else 0.0)
    return Model(ratios, np.frombuffer(made["weights"]), made["bias"], made["slope"], made["shift"])


def scored(docs: DataFrame, grams: Column, model: Model) -> DataFrame:
    """The columns of `docs` and `score`: the model's probability for an array of distinct n-gram buckets.

    The model's tables are scalar subqueries: tasks get them once, and plans do not print them.
    """
    numbers = [((model.ratios**2).tolist(), (model.weights * model.ratios).tolist())]
    table = stored(docs.sparkSession.createDataFrame(numbers, "squares array<double>, products array<double>"), "model")
    both = docs.select("*", grams.alias("_grams"), table.select("squares").scalar().alias("_squares"), table.select("products").scalar().alias("_products"))
    start = F.struct(F.lit(0.0).alias("square"), F.lit(0.0).alias("product"))
    add = lambda t, g: F.struct((t["square"] + F.get(F.col("_squares"), g)).alias("square"), (t["product"] + F.get(F.col("_products"), g)).alias("product"))
    margin = lambda t: t["product"] / F.greatest(F.sqrt(t["square"]), F.lit(1e-9)) + model.bias
    probability = lambda t: 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), margin(t) * model.slope + model.shift))))
    return both.withColumn("score", bound(F.aggregate("_grams", start, add), probability)).drop("_grams", "_squares", "_products")


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, shape_bits: int = 14, word_bits: int = 16, sample_rows: int = 20_000, sample_grams: int = 6_000_000, threshold: float = 0.3, most_broadcast: int = 1_000_000) -> DataFrame:
    """Scores every whole text with a naive Bayes support-vector model of `labels.quality`.

    Features are which hashed words and pairs of word shapes a text has, hashed, each scaled by its class log-count ratio, and the
    vector brought to length 1. Only labels of rows outside the held-out fold (crc32 of the doc_id as text, modulo
    `folds`, is 0 there) are learnt from: all of them for the ratios, at most `sample_rows` with `sample_grams`
    n-grams (in a fixed hash order) for the linear model, which one task fits by dual coordinate descent. Only texts enter a score.
    Labelled texts are read once more than others, and none is shuffled unless over `most_broadcast` have a label.

    Returns one row per row of `docs`: doc_id, held_out, score, predicted (1 if score >= `threshold`, else 0).

    Defined cases: a null or empty text has no n-grams and gets the score of the bias alone; a null doc_id is held out
    (the CRC of the empty text is 0) and unlabelled; labels that are null or not 0 or 1 are left out, of several labels
    of a document the highest holds; rows that repeat are scored each; without labels of both classes every score is the
    smoothed share of label 1; extra columns are ignored; an empty table gives no rows.
    """
    grams = F.array_distinct(text_grams(F.col("text"), shape_bits, word_bits))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == 0
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    model = fit(docs, known, grams, (1 << shape_bits) + (1 << word_bits), sample_rows, sample_grams, most_broadcast)
    given = docs.select("doc_id", "text", held_out.alias("held_out"))
    return scored(given, grams, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
