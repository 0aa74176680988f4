"""Quality rules: counts of a text, and the likelihood ratio of its hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.geo import named
from wayline.llm.common import WORD, bound, broadcast_if_few, stored, words_of
from wayline.llm.shapes import grams_of, text_grams, word_hashes

#: Words in a window that counts as repeated.
WINDOW = 8


def _marked(docs: DataFrame, trusted: DataFrame, most_broadcast: int) -> DataFrame:
    """(text, hit) of every row of `docs`; hit is 1 if its doc_id is in `trusted`, else 0.

    Up to `most_broadcast` ids (8 bytes each) go to every task, so no text is shuffled; more of them are joined by a
    shuffle of the texts, but for those without an id, which are never trusted.
    """
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    rows = docs.select("doc_id", "text")
    known = rows.where("doc_id IS NOT NULL").join(broadcast_if_few(ids, most_broadcast), "doc_id", "left").select("text", F.coalesce("hit", F.lit(0)).alias("hit"))
    return known.unionByName(rows.where("doc_id IS NULL").select("text", F.lit(0).alias("hit")))


def gram_weights(docs: DataFrame, trusted: DataFrame, shape_bits: int, word_bits: int, smoothing: float, most_broadcast: int) -> DataFrame:
    """Log ratio of each bucket's share in the trusted texts to its share in all texts, as one row with an array `w`.

    Counts cover all rows of `docs`; those whose doc_id is in `trusted` make the target. Shares are of the buckets of
    one kind (shapes, words); to the target's counts `smoothing` for each bucket is added, dealt by the shares in all
    texts, so that few trusted texts say little.
    """
    # explode_outer, since explode adds a filter on the array's size, for which the n-grams would be made twice
    grams = _marked(docs, trusted, most_broadcast).select("hit", F.explode_outer(text_grams(F.col("text"), shape_bits, word_bits)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("hit").alias("target"))
    every = docs.sparkSession.range((1 << shape_bits) + (1 << word_bits)).select(F.col("id").cast("int").alias("bucket"), (F.col("id") < 1 << shape_bits).alias("shape"))
    full = stored(every.join(counts, "bucket", "left"), "counts")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    sums = full.groupBy("shape").agg(F.sum(n("raw")).alias("raws"), F.sum(n("target")).alias("targets"), F.count("*").alias("buckets"))
    full = full.join(F.broadcast(sums), "shape")  # of two rows
    share, prior = n("raw") / F.col("raws"), smoothing * F.col("buckets")
    expected = (n("target") + prior * share) / (F.col("targets") + prior)
    ratio = F.when(n("raw") > 0, F.log(expected / share)).otherwise(F.lit(0.0))
    table = full.select("bucket", ratio.alias("ratio")).agg(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))).alias("t"))
    return stored(table.select(F.transform("t", lambda x: x["ratio"]).alias("w")), "weights")


def repeated_words(hashes: Column) -> Column:
    """How many words stand in a window of WINDOW words that the text has twice or more, the first included; by the
    words' hashes."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, n: total + n)

    def starts(ordered: Column) -> Column:  # neighbours in the order of the hashes are the repeats
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        repeats = F.filter(ordered, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
        return F.sort_array(F.transform(repeats, lambda x: x["i"]))

    def of_windows(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = bound(ordered, lambda o: bound(starts(o), covered))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(found)

    def joined(hashes: Column, far: int) -> Column:
        """For each place the hash there, shifted, and the one `far` places on: hashes of runs of twice the length."""
        mixed = lambda h, i: F.shiftleft(h, far).bitwiseXOR(F.get(hashes, i + far))
        return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - far, F.lit(0))), mixed)

    def of_halves(halves: Column) -> Column:  # most texts do not even repeat half a window
        once = F.size(F.array_distinct(halves)) == F.size(halves)
        return F.when(once, F.lit(0).cast("long")).otherwise(bound(joined(halves, WINDOW // 2), of_windows))

    return bound(joined(hashes, 1), lambda pairs: bound(joined(pairs, 2), of_halves))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    shape_bits: int = 14,
    word_bits: int = 16,
    smoothing: float = 0.5,
    least_score: float = -0.05,
    least_words: int = 20,
    most_repeated_percent: int = 30,
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """Judges every document by counts and by the length-normalised log-likelihood ratio of its hashed n-grams.

    The n-grams are words and pairs of word shapes, hashed. Their multinomials, trusted texts
    against the whole corpus, are counted over all rows; a document's score is the mean log ratio of its n-grams, and it
    is kept if that is at least `least_score` and no base rule fails. Texts are read twice and not shuffled, unless
    `trusted` names over `most_broadcast` documents.

    Returns one row per row of `docs`: its columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept. A column of `docs` with one of those names is replaced.

    Defined cases: a null or empty text has no words, all counts 0, score null, and base_failed; a null doc_id is
    never trusted; rows that repeat are judged each; a doc_id that `trusted` repeats counts once; with no trusted row
    every bucket weighs the same in the target, and rows are still judged; an empty table gives no rows.
    """
    weights = gram_weights(docs, trusted, shape_bits, word_bits, smoothing, most_broadcast)
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    own = [c for c in docs.columns if c not in results]
    text = F.coalesce(F.col("_doc.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def mean_weight(grams: Column) -> Column:
        return F.when(F.size(grams) > 0, F.aggregate(grams, F.lit(0.0), lambda total, g: total + F.get(F.col("_weights"), g)) / F.size(grams))

    def measured(words: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            score = bound(grams_of(F.col("_doc.text"), hashes, shape_bits, word_bits), mean_weight)
            return named(n_words=F.size(words).cast("long"), word_chars=F.length(F.array_join(words, "")).cast("long"), n_repeat_words=repeated_words(hashes), score=score)

        return bound(word_hashes(words), of_hashes)

    # A scalar subquery: tasks get the table once, and plans do not print it. It is used once, so the optimizer makes no column of it.
    given = docs.select(F.struct(*own).alias("_doc"), weights.scalar().alias("_weights"))
    found = F.struct(
        "_doc",
        bound(words_of(F.col("_doc.text")), measured).alias("_counts"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    # A filter on the verdict is not pushed below a generator; else it would have the counts made once more for each of its columns.
    once = given.select(found.alias("_found")).select(F.explode_outer(F.array("_found")).alias("_found"))
    df = once.select("_found._doc", "_found._counts", "_found.n_symbols", "_found.n_dup_lines").select("*", "_counts.*")
    df = df.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("score"), F.lit(float("-inf"))) >= least_score))
    return df.select("_doc.*", *results)
