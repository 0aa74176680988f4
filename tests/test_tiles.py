"""Tiles as a data source: only those asked for are opened, digests are checked, and new ones stream."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wayline.sources.tiles import FORMAT, SCHEMA, register_tiles, write_tile_texts


def test_tiles(spark: SparkSession, tmp_path: Path) -> None:
    rows = [(f"e07{t}n12", i, f"NH-{i}" if i % 3 else None, [t, i, t + 1, i + 1], [t, i, 5, -7]) for t in range(5) for i in range(40)]
    path = str(tmp_path / "roads")
    manifest = write_tile_texts(spark.createDataFrame(rows, SCHEMA).repartition(7), path)
    assert manifest.count() == 5 and manifest.agg(F.min("bytes")).first()[0] > 1000
    register_tiles(spark)
    roads = spark.read.format(FORMAT).load(path)
    assert sorted(map(tuple, roads.collect()), key=lambda r: r[:2]) == sorted(rows, key=lambda r: r[:2])
    # A tile that was changed is an error for those who ask for it, and for nobody else.
    bad = next((tmp_path / "roads/tiles/tile_id=e073n12").glob("*.txt"))
    bad.write_text(bad.read_text().replace("NH-1", "NH-9"))
    some = roads.where("tile_id = 'e071n12' AND ordinal < 10")
    assert some.count() == 10 and some.rdd.getNumPartitions() == 1
    assert roads.where(F.col("tile_id").isin("e070n12", "e074n12", "nowhere")).select("refs").count() == 80
    assert roads.where("tile_id = 'e070n12' AND tile_id = 'e071n12'").count() == 0
    with pytest.raises(Exception, match="differs from the manifest"):
        roads.where("tile_id = 'e073n12'").collect()


def test_tiles_stream_as_they_are_added(spark: SparkSession, tmp_path: Path) -> None:
    make = lambda t, n: spark.createDataFrame([(t, i, "NH-1", [0, 0, 1, 1], [i, 2, 3, 4]) for i in range(n)], SCHEMA)
    register_tiles(spark)
    path, out = str(tmp_path / "roads"), str(tmp_path / "out")
    for step, tile in enumerate(("e070n10", "e072n10")):
        write_tile_texts(make(tile, 10 + step), str(tmp_path / f"new{step}"))
        for kind, pattern in (("tiles", "tile_id=*/*.txt"), ("manifest", "*.json")):
            for file in sorted((tmp_path / f"new{step}" / kind).glob(pattern)):
                to = tmp_path / "roads" / kind / (file.parent.name if kind == "tiles" else "") / (file.name if kind == "tiles" else f"{step}.json")
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(file.read_bytes())
        query = spark.readStream.format(FORMAT).load(path).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(out)
        assert query.awaitTermination(100) and query.exception() is None
        assert spark.read.parquet(out).groupBy("tile_id").count().collect() != []
    assert {(r["tile_id"], r["count"]) for r in spark.read.parquet(out).groupBy("tile_id").count().collect()} == {("e070n10", 10), ("e072n10", 11)}
