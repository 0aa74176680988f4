"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import collections

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.compare import same
from wayline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark: SparkSession, name: str) -> None:
    same(queries.QUERIES[name](spark, DATA).toPandas(), queries.ORACLE_SQL[name], DATA)


def test_pipeline_stages(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        rows[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    kept, lines, unique, mixed, packed = (rows[n] for n, _ in corpus_pipeline.STAGES)
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").df().set_index("doc_id").quality
    words = kept.text.str.split().str.len()
    assert (words >= 20).all() and (labels.reindex(kept.doc_id).dropna() == 1).mean() > 0.97
    assert set(lines.doc_id) <= set(kept.doc_id) and (lines.n_chars == lines.text.str.len()).all()
    assert unique.doc_id.is_unique and set(unique.doc_id) <= set(lines.doc_id)
    assert set(mixed.doc_id) <= set(unique.doc_id) and mixed.doc_id.value_counts().max() <= 2
    pieces = packed.groupby(["doc_id", "copy"]).ngroups
    assert pieces == len(mixed)
    whole = collections.Counter(mixed.doc_id)
    assert collections.Counter(packed[packed.piece == 0].doc_id) == whole
    again = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(zip(again.doc_id, again.piece, again.ids_crc32)) == sorted(zip(packed.doc_id, packed.piece, packed.ids_crc32))


def test_pipeline_stages_on_odd_rows(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    """Nulls in every column, repeated ids, ties, empty and very long texts, columns whose names clash, empty tables."""
    import random

    r = random.Random(41)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))
    base, long = text(80), text(25_000)
    rows = [(1, base, "en", "s", 5), (1, text(60), "en", "s", 5), (None, text(70), None, None, None), (None, text(75), "en", "s", 1), (None, None, None, None, None)]
    rows += [(2, base, "en", "s", 5), (3, "", "en", "s", 0), (4, long, "en", None, None), (4, long, "en", None, None), (5, text(50) + "\n" + base, "de", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = str(tmp_path / "sf")
    spark.createDataFrame([(1, 1, 0), (None, 1, None), (4, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{labels}/labels.parquet")
    docs = spark.createDataFrame(rows, schema).withColumns({"bucket": F.lit("b"), "row": F.lit(1), "node": F.lit("n"), "kept": F.lit(0)})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), labels).count() == 0, name
        out = stage(spark, docs, labels)
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
        got = [tuple(x) for x in out.collect()]
        if name == "quality rules":  # nulls and short ones go, trusted texts stay
            assert {x[1] for x in got} <= {t for _, t, *_ in rows if t} and sum(x[1] == long for x in got) == 2
        if name == "line dedup":  # the copy of doc 2 goes, and the one inside doc 5
            assert sorted(len(x[1] or "") for x in got) == sorted(len(t or "") if i != 5 else len(t.split("\n")[0]) for i, t, *_ in rows if i != 2)
        if name == "SimHash near-dedup":  # different texts stay whatever their ids; one of the rows without words
            assert collections.Counter(x[1] for x in got if x[1]) == collections.Counter({t for _, t, *_ in rows if t}) and len(got) == len({t for _, t, *_ in rows if t}) + 1
            assert [x[0] for x in got if x[1] == base] == [1]
        if name == "mixing":
            assert max(collections.Counter(got).values()) <= 4 and {x[1] for x in got} <= {t for _, t, *_ in rows}
        if name == "packing":
            assert out.select("copy").distinct().count() == len(rows)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_give_a_row_for_each_of_their_table(spark: SparkSession, name: str) -> None:
    got = queries.QUERIES[name](spark, DATA).toPandas()
    ids = duckdb.sql(f"SELECT {'page_id' if 'html' in name else 'doc_id'} FROM '{DATA}/{'pages' if 'html' in name else 'documents'}.parquet'").df().iloc[:, 0]
    rows = got[got.start == 0] if "start" in got else got  # a document in pieces counts by its first
    assert sorted(rows.iloc[:, 0]) == sorted(ids)
