"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import WORD, key_bucket, running_total_before, stored


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
    cut: str = "words",
    seed: str = "mix",
    carry: Sequence[str] = (),
) -> DataFrame:
    """What a mix takes of each document so that sources reach their target number of words.

    Sources in code-point order (null last) weigh `weights`, repeating, and share `share` times all words. A target
    stops at `max_repeats` times its source's words; the excess is shared anew by weight until none is above. Within a
    source, documents stand in the order of a hash of their id; whole epochs are taken while the target lasts, and the
    last one ends at the target: in the middle of a document (cut="words"), or at the nearer end of the document that
    it falls in (cut="document").

    Returns one row per row of `docs`: doc_id, source, size (words), source_size, target, taken (words, repeats
    counted), copies (times that the document begins in the mix), and the columns named by `carry` in a struct `carried`.

    Defined cases: a null or empty text has size 0; a null source is a source of its own, ranked last; a null doc_id
    is hashed by its text; rows that repeat a doc_id are documents of their own, in order of size, then of their text's digest and of what is carried, so reruns agree; a source
    without words has target 0 and gives nothing; columns not named by `carry` are ignored; an empty table gives no rows.
    """
    if cut not in ("words", "document"):
        raise ValueError(f"cut must be 'words' or 'document', not {cut!r}")
    sized = docs.select(
        "doc_id",
        F.col("source").isNull().cast("int").alias("no_source"),
        F.coalesce(F.col("source"), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5("text"), F.lit("")))))).alias("key"),
        F.coalesce(F.md5("text"), F.lit("")).alias("digest"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    # Words are counted once; what is carried along may be whole texts, which are not written for that.
    sized = sized if carry else stored(sized, "sizes")
    sized = sized.withColumn("bucket", key_bucket("key", sized.count() if not carry else docs.count()))

    # One row per source from here. In order of cap / weight, a source is full if its cap is within its share, by weight,
    # of what the sources before it leave; the first that is not full sets the level for all the others.
    ranked = Window.orderBy("no_source", "source_key")
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "no_source", "source_key")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    turn = ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    targets = (
        sized.groupBy("no_source", "source_key")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), turn))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("level", left / open_weight)
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
        .withColumn("budget", F.floor("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)))
        .select("no_source", "source_key", "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"))
    )
    placed = running_total_before(sized, ["no_source", "source_key"], "bucket", ["key", "size", "digest", *(["carried"] if carry else [])], "size", "earlier")
    room = F.col("rest") - F.col("earlier")
    if cut == "words":
        last, begins = F.greatest(F.lit(0), F.least(room, F.col("size"))), room > 0
    else:
        begins = 2 * room > F.col("size")
        last = F.when(begins, F.col("size")).otherwise(F.lit(0))
    return placed.join(targets, ["no_source", "source_key"]).select(
        "doc_id",
        F.when(F.col("no_source") == 0, F.col("source_key")).alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
        (F.col("epochs") + begins.cast("int")).cast("int").alias("copies"),
        *(["carried"] if carry else []),
    )
