"""Exact top-k search by inner product, with candidates eliminated by pivot tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import stored

#: Rounding slack of a bound, relative to the squares it comes from.
SLACK = 1e-9


def whole_components(embedding: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or has a null or non-finite component."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, pivots: np.ndarray, longest: float, k: int, least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score): the k best of a block of vectors for each query, its own id left out.

    Inner products become distances once every vector has a further component that brings its length to `longest`, and
    queries have 0 there: d^2 = |q|^2 + longest^2 - 2 q.x. By the triangle inequality no distance is under the largest
    difference of the two distances to a pivot, so that gives the most that a product can be. Candidates are evaluated
    in the order of this bound, until it falls under the k-th best score, or under `least`, a score that is known to be reached.
    """
    q, x = queries.astype(np.float64), vectors.astype(np.float64)
    q2, top = (q * q).sum(1), longest * longest
    x_table, q_table = pivot_distances(x, pivots, longest, True), pivot_distances(q, pivots, longest, False)
    least = np.full(len(q), -np.inf) if least is None else least - SLACK * (np.abs(np.where(np.isfinite(least), least, 0)) + 1)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**53
    found = []
    for i in range(len(q)):
        gap = np.abs(x_table - q_table[i]).max(axis=1)
        most = (q2[i] + top - gap * gap) / 2 + SLACK * (q2[i] + top) + 1e-6
        most[ids == query_ids[i]] = -np.inf
        order = np.argsort(-most, kind="stable")
        scores, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step, start = max(64, 4 * k), 0
        while start < len(order) and most[order[start]] > -np.inf and most[order[start]] >= least[i]:
            if len(scores) >= k and most[order[start]] < scores[k - 1]:
                break
            part = order[start : start + step]
            part = part[most[part] > -np.inf]
            new = (x[part] @ q[i]).astype(np.int64) if exact else vectors[part] @ queries[i]
            if not exact and np.abs(x[part] @ q[i]).max(initial=0) >= 2.0**63 * (1 - 1e-9):
                raise OverflowError("an inner product does not fit 64 bits")
            scores, places = np.concatenate([scores, new]), np.concatenate([places, part])
            by = np.lexsort((ids[places], -scores))[:k]
            scores, places = scores[by], places[by]
            start, step = start + step, step * 2
        found += [(int(query_ids[i]), int(ids[j]), int(s)) for j, s in zip(places, scores)]
    return found


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray, longest: float, lifted: bool) -> np.ndarray:
    """Distances of vectors to pivots once pivots are brought to length `longest` by a further component, and so are the
    vectors if they are `lifted` (candidates are, queries are not)."""
    x, p, top = vectors.astype(np.float64), pivots.astype(np.float64), longest * longest
    x2, p2 = (x * x).sum(1), (p * p).sum(1)
    if not lifted:
        return np.sqrt(np.maximum(x2[:, None] + top - 2 * x @ p.T, 0))
    up = np.sqrt(np.maximum(top - x2, 0))[:, None] - np.sqrt(np.maximum(top - p2, 0))[None]
    return np.sqrt(np.maximum(x2[:, None] + p2[None] - 2 * x @ p.T + up**2, 0))


def _stack(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"].to_numpy()).astype(np.int64).reshape(len(frame), -1)


def _in_cells(rows: DataFrame, chosen: dict[int, np.ndarray], longest: float, lifted: bool) -> DataFrame:
    """rows with `cell` (their nearest pivot) and `table` (their distances to all pivots)."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, part in frame.groupby("width"):
                table = pivot_distances(_stack(part), chosen[width], longest, lifted) if width else np.zeros((len(part), 1))
                yield part.assign(cell=table.argmin(axis=1).astype(np.int32), table=list(table))

    return rows.mapInPandas(place, "vec_id long, v array<long>, width int, cell int, table array<double>")


def _blocks(rows: DataFrame, most: int, pool: bool = False) -> DataFrame:
    """rows with `block`: a number for about `most` rows of one cell; cells of under half as many share blocks if they pool."""
    sizes = rows.groupBy("width", "cell").agg(F.count("*").alias("n"))  # a row for each pivot and width
    small = (F.col("n") < most // 2) if pool else F.lit(False)
    n = F.when(small, F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("width"))).otherwise(F.col("n"))
    parts = sizes.select("width", "cell", F.ceil(n / most).alias("parts"), F.when(small, -1).otherwise(F.col("cell")).alias("home"))
    return rows.join(parts, ["width", "cell"]).withColumn("block", F.xxhash64("width", "home", F.pmod(F.xxhash64("vec_id"), F.col("parts")))).drop("parts", "home")


def _ranges(rows: DataFrame, pivots: int, *more: Column) -> DataFrame:
    """(width, block, low, high, ...): the least and the greatest distance to each pivot in a block."""
    ends = [F.array(*[f(F.get("table", F.lit(k))) for k in range(pivots)]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    return rows.groupBy("width", "block").agg(*ends, *more)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 32, block_rows: int = 4096, query_rows: int = 512, probe_rows: int = 4096) -> DataFrame:
    """The k vectors with the highest inner product for each query, exactly; ties to the smaller vec_id.

    `vectors` and `queries` have (vec_id, v), v an array of whole numbers. Pivots are `pivots` vectors with the smallest
    hashes of their ids; every vector has its distances to them, and blocks (about `block_rows` vectors, `query_rows`
    queries) are of one cell, that of the nearest pivot; cells of few queries share blocks. Each query first meets `probe_rows` vectors, which gives it a
    k-th best score that the answer reaches at least. Before any vector is shuffled, the ranges of distances of a query
    block and a vector block give the most that a product between them can be; the pair of blocks is eliminated if that
    is under the least of its queries' scores. In a block that is left, the same bound orders the candidates.

    Returns query_id, rank (from 1), vec_id, score.

    Defined cases: rows with a null vec_id or v take no part; vectors meet queries of their own length only; no vector
    with the query's own id is a candidate; rows that repeat a vec_id are candidates each, while a query that is repeated
    is asked once (its smallest v); fewer than k candidates are all returned; a product that does not fit 64 bits is an error, and components
    beyond them are cut to the ends of their range; extra columns are ignored; empty tables give no rows.
    """
    sound = "vec_id IS NOT NULL AND v IS NOT NULL"
    rows = stored(vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("width")), "vectors")
    asked = queries.where(sound).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    longest = math.sqrt((rows.agg(F.max(square)).first()[0] or 0.0) * (1 + 1e-12))
    chosen: dict[int, np.ndarray] = {}
    probes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows.select("width").distinct().collect():
        some = rows.where(F.col("width") == r["width"]).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(pivots, probe_rows)).collect()
        v = np.array([s["v"] for s in some], np.int64).reshape(len(some), r["width"])
        chosen[r["width"]], probes[r["width"]] = v[:pivots], (v, np.array([s["vec_id"] for s in some], np.int64))
    spark, n_pivots = rows.sparkSession, max([len(p) for p in chosen.values()], default=1)
    chosen = {w: np.concatenate([p, np.repeat(p[:1], n_pivots - len(p), axis=0)]) for w, p in chosen.items()}
    probe = spark.sparkContext.broadcast(probes)  # at most `probe_rows` vectors for each width

    def first_scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, part in frame.groupby("width"):
                v, ids = probe.value.get(width, (np.zeros((0, width), np.int64), np.zeros(0, np.int64)))
                scores = _stack(part).astype(np.float64) @ v.T.astype(np.float64) if width else np.zeros((len(part), len(v)))
                scores[part["vec_id"].to_numpy()[:, None] == ids[None]] = -np.inf
                least = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(part), -np.inf)
                yield part.assign(least=least)

    cells = stored(_blocks(_in_cells(rows, chosen, longest, True), block_rows), "cells")
    known = asked.join(F.broadcast(rows.select("width").distinct()), "width", "left_semi").select("vec_id", "v", "width")
    scored = _blocks(_in_cells(known, chosen, longest, False), query_rows, pool=True).mapInPandas(first_scores, "vec_id long, v array<long>, width int, cell int, table array<double>, block long, least double")
    asks = stored(scored.select("vec_id", "v", "width", F.col("block").alias("ask"), "table", "least"), "asks")
    length = F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    left = _ranges(cells, n_pivots)
    right = _ranges(asks.withColumnRenamed("ask", "block"), n_pivots, F.min("least").alias("least"), length.alias("square")).toDF("width", "ask", "ask_low", "ask_high", "least", "square")
    # Query blocks against blocks of all vectors, a row for each pair; only those that the bound leaves get vectors.
    gaps = F.transform(F.arrays_zip("low", "high", "ask_low", "ask_high"), lambda x: F.greatest(F.lit(0.0), x["low"] - x["ask_high"], x["ask_low"] - x["high"]))
    top = longest * longest
    most = (F.col("square") + top - F.pow(F.array_max(gaps), 2)) / 2 + SLACK * (F.col("square") + top) + 1e-6
    pairs = stored(left.join(right, "width").where(most >= F.col("least") - SLACK * (F.abs("least") + 1)).select("width", "block", "ask"), "block-pairs")
    keys = ["width", "block", "ask"]

    def meet(some: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(some) and len(asking):
            found = best_in_block(_stack(asking), asking["vec_id"].to_numpy(), _stack(some), some["vec_id"].to_numpy(), chosen[int(some["width"].iloc[0])], longest, k, asking["least"].to_numpy())
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    candidates = cells.join(pairs, ["width", "block"]).select(*keys, "vec_id", "v")
    askers = asks.join(pairs, ["width", "ask"]).select(*keys, "vec_id", "v", "least")
    best = candidates.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
