"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import stored
from wayline.llm.line_dedup import dedup_lines
from wayline.llm.mixing import mix_sources
from wayline.llm.near_copies import first_of_near_copies
from wayline.llm.packing import pack_documents
from wayline.llm.quality_rules import quality_rules
from wayline.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; labels of quality 1 name the trusted texts.

    A null or short text goes; a null id is never trusted; rows that repeat are judged each; without labels of quality 1
    the base rules alone decide; other columns than those of documents go, whatever their names; no rows give none.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_rules(docs.select(*COLUMNS), trusted).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document that was nothing else goes.

    A text that is null or has no words stays as it is; rows of one id and text are one document, rows of one id with other texts are
    documents of their own; a null id comes last; no rows give none.
    """
    deduped = dedup_lines(docs.select(*COLUMNS)).where("n_lines = 0 OR n_removed_lines < n_lines")
    return deduped.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: five-word shingle sets of a Jaccard similarity of 0.8 or more, linked.

    SimHash links come first, by pivot tables at 2 or fewer differing bits, then texts further apart that share a sketch
    hash; the whole shingle sets of each pair decide.
    Rows count by themselves, whatever ids they share: unlike texts of one id, or of none, all stay. Of a class the
    smallest id stays, null last, ties by a digest of the row; texts without words are one class; no rows give none.
    """
    return first_of_near_copies(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of sources takes them; a document taken twice is there twice.

    A null source is one of its own; a text without words has size 0 and is there as often as the mix goes through its
    place; rows of one id are documents of their own; a source without words gives none; no rows give none.
    """
    mixed = mix_sources(docs, cut="document", carry=COLUMNS)
    return mixed.where("copies > 0").select(F.explode(F.array_repeat("carried", F.col("copies"))).alias("d")).select("d.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048.

    A null text is the empty one, which is the end token alone; rows that repeat are packed each and told apart by
    `copy`; a null id stays null; no rows give none.
    """
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Fingerprints and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each stage's result written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
