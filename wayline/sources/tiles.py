"""Tiles of features as text files with a manifest, and a data source that opens only the tiles asked for."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

FORMAT = "road_tiles"
SCHEMA = "tile_id string, ordinal int, refs string, bbox array<long>, deltas array<long>"
ARROW = pa.schema([("tile_id", pa.string()), ("ordinal", pa.int32()), ("refs", pa.string()), ("bbox", pa.list_(pa.int64())), ("deltas", pa.list_(pa.int64()))])


def write_tile_texts(features: DataFrame, path: str) -> DataFrame:
    """Writes features (SCHEMA) as one JSON line each, a file for each tile, and their manifest: tile_id, file, bytes, sha256.

    `path`/tiles has the files, `path`/manifest the manifest, written last. Returns the manifest.
    """
    spark = features.sparkSession
    lines = features.select("tile_id", "ordinal", F.to_json(F.struct("ordinal", "refs", "bbox", "deltas")).alias("value"))
    dealt = lines.repartition("tile_id").sortWithinPartitions("tile_id", "ordinal").drop("ordinal")
    dealt.write.partitionBy("tile_id").mode("overwrite").text(f"{path}/tiles")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/tiles")
    told = files.select(
        F.regexp_extract("path", "/tile_id=([^/]+)/", 1).alias("tile_id"), F.regexp_extract("path", "(tile_id=[^/]+/[^/]+)$", 1).alias("file"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    told.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("tile_id string, file string, bytes long, sha256 string").json(f"{path}/manifest")


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _manifest(path: str) -> list[dict]:
    """Entries of all manifest files, in the order of the files' names, then of their lines."""
    store, root = _files(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/manifest")) if f.base_name.endswith(".json") and not f.base_name.startswith((".", "_"))]
    entries = []
    for name in sorted(found):
        with store.open_input_stream(name) as file:
            entries += [json.loads(line) for line in file.read().decode().splitlines() if line]
    return entries


@dataclass
class Tile(InputPartition):
    tile_id: str
    file: str
    bytes: int
    sha256: str


def _rows(path: str, tile: Tile) -> Iterator[pa.RecordBatch]:
    """The features of a tile, after its bytes have been held against the manifest."""
    store, root = _files(path)
    with store.open_input_stream(f"{root}/tiles/{tile.file}") as file:
        raw = file.read()
    if len(raw) != tile.bytes or hashlib.sha256(raw).hexdigest() != tile.sha256:
        raise ValueError(f"{tile.file}: content differs from the manifest")
    rows = [{"tile_id": tile.tile_id} | json.loads(line) for line in raw.decode().splitlines() if line]
    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class TileReader(DataSourceReader):
    """One task for each tile; conditions that name tiles decide which are opened at all."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.asked: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("tile_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.asked = names if self.asked is None else self.asked & names
            else:
                yield f

    def partitions(self) -> list[Tile]:
        return [Tile(e["tile_id"], e["file"], e["bytes"], e["sha256"]) for e in _manifest(self.path) if self.asked is None or e["tile_id"] in self.asked]

    def read(self, partition: Tile) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition) if partition else iter(())


class TileStreamReader(DataSourceStreamReader):
    """Tiles as they are added to the manifest; the offset is the number of entries, which are only ever appended."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entries": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"entries": len(_manifest(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Tile]:
        return [Tile(e["tile_id"], e["file"], e["bytes"], e["sha256"]) for e in _manifest(self.path)[start["entries"] : end["entries"]]]

    def read(self, partition: Tile) -> Iterator[tuple]:
        for batch in _rows(self.path, partition):
            yield from (tuple(r[c] for c in ARROW.names) for r in batch.to_pylist())

    def commit(self, end: dict) -> None:
        pass


class TileSource(DataSource):
    """spark.read.format("road_tiles").load(path): the tiles that `write_tile_texts` wrote, each held against its digest as it is read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(self.options["path"].rstrip("/"))

    def streamReader(self, schema: StructType) -> TileStreamReader:  # noqa: N802
        return TileStreamReader(self.options["path"].rstrip("/"))


def register_tiles(spark: SparkSession) -> None:
    """Makes the format known to a session, with conditions on tile_id handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)
