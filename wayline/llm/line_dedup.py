"""Line de-duplication: a suffix order of line ids by prefix doubling, and the runs of lines that it shows to be repeated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import WORD, stored
from wayline.operators.skew import salted_join


def row_key() -> Column:
    """A digest of doc_id and text: equal only for rows that repeat both."""
    known = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(known, F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))))


def lines_of(docs: DataFrame) -> DataFrame:
    r"""(row_key, doc_id, at, line, words, name): a row for each \n-split line with a word; `line` is its place in the
    text, `at` its place among these lines."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("content"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    worded = docs.select(row_key().alias("row_key"), "doc_id", F.posexplode_outer(F.filter(numbered, lambda x: x["words"] > 0)).alias("at", "l"))
    return worded.where("at IS NOT NULL").select("row_key", "doc_id", "at", "l.line", F.col("l.words").cast("long").alias("words"), F.unhex(F.md5("l.content")).alias("name"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, copies, rank) of the keys that more than one row has; ranks rise with the keys, by a distributed sort."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
    return counts.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id())


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose keys are repeated, with the rank of their key in place of the keys."""
    table = stored(repeated_keys(rows, keys), name)
    total = table.agg(F.sum("copies")).first()[0] or 0
    return stored(salted_join(rows, table, keys, "copies", total, F.struct("row_key", "at")).drop(*keys), name)


def suffix_ranks(lines: DataFrame, least_words: int) -> DataFrame:
    """(row_key, doc_id, at, line, words, rank0, rank1, ...): rank k is the place that the suffix from a line on takes
    in the sorted order of the first 2^k lines of all suffixes; null where no other suffix has the same ones.

    Prefix doubling: the 2^k lines of a suffix are sorted by the ranks of their two halves. A suffix that shares its
    prefix with no other is settled and leaves. So do lines between two settled ones with under `least_words` words
    altogether, which no repeated run of that many can hold. A run that must be told apart has at most `least_words`
    lines, which sets the number of levels.
    """
    levels = range(math.floor(math.log2(max(1, least_words))) + 1)
    same = _ranked(lines, ["name"], "rank0").distinct()
    island = F.col("at") - F.row_number().over(Window.partitionBy("row_key").orderBy("at"))
    whole = Window.partitionBy("row_key", "island")
    base = stored(same.withColumn("island", island).withColumn("_words", F.sum("words").over(whole)).where(F.col("_words") >= least_words).drop("_words"), "lines")
    found, out = base.select("row_key", "at", "rank"), base.withColumnRenamed("rank", "rank0")
    for k in levels[1:]:
        half = 1 << (k - 1)
        there = Window.partitionBy("row_key").orderBy("at").rangeBetween(half, half)
        pairs = found.withColumn("next", F.max("rank").over(there)).where("next IS NOT NULL").withColumnRenamed("rank", "own")
        found = _ranked(stored(pairs, f"pairs{k}"), ["own", "next"], f"rank{k}")
        out = out.join(found.withColumnRenamed("rank", f"rank{k}"), ["row_key", "at"], "left")
    return out


def runs_of(ranks: DataFrame, least_words: int) -> DataFrame:
    """(n, a, b, row_key, doc_id, first, last): for every line the shortest run of lines from it on, and the shortest up
    to it, that have at least `least_words` words, where other suffixes begin with the same run.

    Suffixes that begin with the same n lines make an interval of the suffix order whose longest common prefix is n or
    more. With 2^k the largest power in n, it is named by n, the rank k at the run's first line (a) and the rank k of
    the 2^k lines that end with the run (b).
    """
    levels = [c for c in ranks.columns if c.startswith("rank")]
    in_island = Window.partitionBy("row_key", "island").orderBy("at")
    placed = ranks.withColumns({f"end{k}": F.lag(f"rank{k}", (1 << k) - 1).over(in_island) for k in range(len(levels))})
    placed = placed.withColumn("upto", F.sum("words").over(in_island)).withColumn("before", F.col("upto") - F.col("words"))
    begin, end = F.array(*levels), F.array(*[f"end{k}" for k in range(len(levels))])
    ahead = Window.partitionBy("row_key", "island").orderBy("before").rangeBetween(0, least_words - 1)
    behind = Window.partitionBy("row_key", "island").orderBy("upto").rangeBetween(1 - least_words, 0)
    run = lambda first, last, n, words, a, b: F.struct(first.alias("first"), last.alias("last"), n.alias("n"), words.alias("words"), a.alias("begin"), b.alias("end"))
    both = F.array(
        run(F.col("line"), F.last("line").over(ahead), F.count("*").over(ahead), F.sum("words").over(ahead), begin, F.last(end).over(ahead)),
        run(F.first("line").over(behind), F.col("line"), F.count("*").over(behind), F.sum("words").over(behind), F.first(begin).over(behind), end),
    )
    ranged = placed.select("row_key", "doc_id", both.alias("runs"))
    runs = ranged.select("row_key", "doc_id", F.explode("runs").alias("r")).where(F.col("r.words") >= least_words)
    level = F.floor(F.log2("r.n") + 1e-9).cast("int")
    named = runs.select(F.col("r.n").alias("n"), F.get("r.begin", level).alias("a"), F.get("r.end", level).alias("b"), "row_key", "doc_id", "r.first", "r.last")
    return named.where("a IS NOT NULL AND b IS NOT NULL")


def later_copies(docs: DataFrame, least_words: int) -> DataFrame:
    """(row_key, spans): for each text with lines to delete, the maximal runs of them as an array of (first, last)."""
    # The text is split once, for the counts and for the ranks.
    runs = stored(runs_of(suffix_ranks(stored(lines_of(docs), "lines"), least_words), least_words).distinct(), "runs")
    place, key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "first"), ["n", "a", "b"]
    origins = stored(runs.groupBy(*key).agg(F.min(place).alias("origin"), F.count("*").alias("copies")).where("copies > 1"), "origins")
    total = origins.agg(F.sum("copies")).first()[0] or 0
    hits = salted_join(runs, origins, key, "copies", total, F.struct("row_key", "first")).where(place != F.col("origin")).select("row_key", "first", "last")
    # Runs that overlap are parts of one maximal run.
    by_first = Window.partitionBy("row_key").orderBy("first", "last")
    opens = F.coalesce(F.col("first") > F.max("last").over(by_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    counted = hits.withColumn("opens", opens).withColumn("part", F.sum(F.col("opens").cast("int")).over(by_first))
    maximal = counted.groupBy("row_key", "part").agg(F.struct(F.min("first").alias("first"), F.max("last").alias("last")).alias("span"))
    return maximal.groupBy("row_key").agg(F.collect_list("span").alias("spans"))


def dedup_lines(docs: DataFrame, least_words: int = 50) -> DataFrame:
    r"""Deletes later copies of maximal repeated runs of lines.

    Lines are split at \n; lines without a word count for nothing between others. A run of lines with at least
    `least_words` words that also occurs earlier (smaller doc_id, or earlier in the text) is deleted; the earliest
    occurrence stays. Repeated runs are intervals of the suffix order of line ids, which prefix doubling sorts. It is
    enough to ask for the shortest such runs from each line on and up to each line: a maximal repeated run is the union
    of those inside it.

    Returns one row per row of `docs`: its columns with the new text, then n_lines (lines with a word) and
    n_removed_lines. A column of `docs` with one of those names is replaced.

    Defined cases: a null text stays null and an empty one empty; a text that is all later copies becomes empty; a
    null doc_id comes after all others; rows that repeat a doc_id and its text are one document and get the same
    result; rows that repeat a doc_id with another text are ordered by a digest; extra columns are kept; an empty
    table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    keyed = docs.select(row_key().alias("row_key"), F.struct(*own).alias("_doc"))
    joined = keyed.join(later_copies(docs, least_words), "row_key", "left")
    lines = F.split("_doc.text", "\n")
    stays = F.filter(lines, lambda x, i: ~F.exists("spans", lambda s: (s["first"] <= i) & (s["last"] >= i)))
    count = lambda some: F.coalesce(F.size(F.filter(some, lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
    text = F.when(F.col("spans").isNull(), F.col("_doc.text")).otherwise(F.array_join(stays, "\n"))
    n, left = count(lines), F.when(F.col("spans").isNull(), count(lines)).otherwise(count(stays))
    n = F.when(F.col("_doc.text").isNull(), F.lit(0).cast("long")).otherwise(n)
    left = F.when(F.col("_doc.text").isNull(), F.lit(0).cast("long")).otherwise(left)
    columns = [text.alias("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in own]
    return joined.select(*columns, n.alias("n_lines"), (n - left).alias("n_removed_lines"))
