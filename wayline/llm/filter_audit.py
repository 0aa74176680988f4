"""What each filter of a chain removes, in every order of the filters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import bound, stored, words_of

LETTERS = "ABCDE"
OUTCOMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def incidence(letters: str) -> dict[str, np.ndarray]:
    """Integer matrices of one row for each mask of failed filters (bit i: letter i) and one column for each step of each order."""
    n = len(letters)
    orders = list(permutations(range(n)))
    masks = np.arange(1 << n)
    fails = (masks[:, None] >> np.arange(n)) & 1
    shape = (len(masks), len(orders), n)
    kept, removed, redundant, unique = (np.zeros(shape, np.int64) for _ in range(4))
    shapley = np.zeros((len(masks), n), np.int64)
    for o, order in enumerate(orders):
        passed = np.ones(len(masks), np.int64)
        for step, f in enumerate(order):
            removed[:, o, step] = passed * fails[:, f]
            redundant[:, o, step] = (1 - passed) * fails[:, f]
            unique[:, o, step] = masks == 1 << f
            passed = passed * (1 - fails[:, f])
            kept[:, o, step] = passed
            shapley[:, f] += removed[:, o, step]
    by_step = shapley[:, np.array(orders)]
    flat = lambda m: m.reshape(len(masks), -1)
    return {"kept": flat(kept), "removed": flat(removed), "redundant": flat(redundant), "unique": flat(unique), "shapley": flat(by_step)}


def audit_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): what is left of the texts, which are read once. Bits 0 to 3 of a mask are the four
    filters that a text decides alone: few words, repeated words, capitals, symbols."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def mask(words: Column) -> Column:
        n = F.size(words)
        fails = [
            n < 100,
            F.size(F.array_distinct(words)) * 100 < n * 80,
            F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 10,
            text.rlike(r"[#$%&*|]"),
        ]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        bound(words_of(text), mask).alias("mask"),
    )


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the mask of the filters that they fail, bit 4 for copies.

    Equal texts fail the same four filters, so rows are counted by text, part and label before any text's rows meet; of
    a text only the smallest id passes the fifth.
    """
    of_doc = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    label = of_doc.agg(F.max(F.col("quality").eqNullSafe(1).cast("int")).alias("good"), F.max(F.col("toxic").eqNullSafe(1).cast("int")).alias("toxic"), F.lit(0).cast("long").alias("salt"))
    # Rows without an id find no label anyway; they are dealt by their text.
    rows = audit_rows(docs).withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    known = rows.join(label, ["doc_id", "salt"], "left").fillna(0, ["good", "toxic"])
    cell = ["digest", "mask", "part", "good", "toxic"]
    by_id = known.groupBy(*cell, "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    cells = stored(by_id.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"), least), "cells")
    first = cells.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    later = F.col("with_id") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = cells.join(first, "digest").withColumn("later", later).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", (F.col("n") - F.col("later")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("later").alias("n")))).alias("half"))
    return split.groupBy("part", "half.mask").agg(F.sum("half.n").alias("n"), F.sum(F.col("half.n") * F.col("good")).alias("good"), F.sum(F.col("half.n") * F.col("toxic")).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, for every order of five filters and every step of it, of what the step's filter does to each part of `docs`.

    A document fails A with under 100 words, B if under 80 % of its words are distinct, C if over 10 % of its code points
    are A to Z, D if it holds one of `#$%&*|`, E if its text is that of a smaller doc_id anywhere in the table. Parts
    are the values of lang. Each part is a histogram of 32 masks of failed filters, for all its documents, the good and
    the toxic ones; these rows, stacked, are multiplied by integer matrices of 32 masks by 600 steps, one for each outcome.

    Returns one row for each part, filter_order and step, zeros included: part, filter_order, step, kept, removed,
    redundant (fails, but is gone already), unique_fails (fails nothing else), good_lost, toxic_lost (removed with
    quality 1, with toxic 1), shapley (removed by the filter, summed over all orders).

    Defined cases: a null text is the empty one, which has no words and fails A alone; a null lang is the part of the
    empty string; a null doc_id has no label, and passes E and makes nobody fail it; rows that repeat a doc_id count
    each, and of equal texts with the smallest doc_id all pass E; several labels of one id count as their largest; labels of
    null ids and null labels count nothing; extra columns are ignored; an empty table gives no rows.
    """

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n = incidence(LETTERS), len(LETTERS)
        orders = ["".join(o) for o in permutations(LETTERS)]
        for batch in batches:
            parts = batch.column("part").to_pylist()
            stacked = np.zeros((3, len(parts), 1 << n), np.int64)  # all, good, toxic
            for i, masks in enumerate(batch.column("masks").to_pylist()):
                for m in masks:
                    stacked[:, i, m["mask"]] = m["n"], m["good"], m["toxic"]
            every, good, toxic = stacked
            found = [every @ of["kept"], every @ of["removed"], every @ of["redundant"], every @ of["unique"], good @ of["removed"], toxic @ of["removed"], every @ of["shapley"]]
            keys = [
                pa.array(np.repeat(np.array(parts, dtype=object), len(orders) * n), pa.string()),
                pa.array(np.tile(np.repeat(np.array(orders, dtype=object), n), len(parts)), pa.string()),
                pa.array(np.tile(np.arange(1, n + 1), len(parts) * len(orders)), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(f.reshape(-1), pa.int64()) for f in found], ["part", "filter_order", "step", *OUTCOMES])

    by_part = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return by_part.mapInArrow(outcomes, "part string, filter_order string, step int, " + ", ".join(f"{o} long" for o in OUTCOMES))
