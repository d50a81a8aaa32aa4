"""Navigation meshes in Detour's documented binary layout, as a data source with a partition for each tile."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: marks, versions, and the fields of the little-endian records.
SET_MAGIC, TILE_MAGIC, LAST_VERSION, TILE_VERSION = 0x4D534554, 0x444E4156, 2, 7
SET = struct.Struct("<3i5f2i")  # magic, version, tiles, origin, tile's width and depth, most tiles, most polygons
SETTINGS = struct.Struct("<13f4?")
SETTING_NAMES = ("cell_size", "cell_height", "agent_height", "agent_radius", "agent_max_climb", "agent_max_slope", "region_min_size", "region_merge_size", "edge_max_len", "edge_max_error", "verts_per_poly", "detail_sample_dist", "detail_sample_max_error", "filter_low_hanging_obstacles", "filter_ledge_spans", "filter_walkable_low_height_spans", "include_static_objects")
TILE = struct.Struct("<Ii")  # reference, bytes
HEADER = struct.Struct("<5iI9i10f")
POLYGON = np.dtype([("link", "<u4"), ("verts", "<u2", 6), ("neighbours", "<u2", 6), ("flags", "<u2"), ("n", "u1"), ("area_type", "u1")])
#: Of a neighbour's number: set where the edge leads to another tile; the lower bits then say to which side.
OUTSIDE = 0x8000


@dataclass
class Tile(InputPartition):
    path: str
    number: int
    ref: int
    at: int
    size: int


def tiles_of(path: str) -> tuple[dict, list[Tile]]:
    """The settings of a file (empty before version 2) and where its tiles lie; only headers are read.  ValueError for another kind of file."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(at) as source:
        size, head = source.size(), source.read(SET.size)
        if len(head) < SET.size:
            raise ValueError(f"{path} is too short for a header")
        magic, version, count, *_ = SET.unpack(head)
        if magic != SET_MAGIC or not 1 <= version <= LAST_VERSION:
            raise ValueError(f"{path} is no navigation mesh of version 1 to {LAST_VERSION}")
        settings, place, out = {}, SET.size, []
        if version >= 2:
            settings = dict(zip(SETTING_NAMES, SETTINGS.unpack(source.read(SETTINGS.size)), strict=True))
            place += SETTINGS.size
        for n in range(count):
            source.seek(place)
            head = source.read(TILE.size)
            if len(head) < TILE.size:
                raise ValueError(f"{path} ends before its tile {n}")
            ref, length = TILE.unpack(head)
            if not ref or not length:
                break
            if place + TILE.size + length > size:
                raise ValueError(f"{path} ends within its tile {n}")
            out.append(Tile(path, n, ref, place + TILE.size, length))
            place += TILE.size + length
    return settings, out


def content_of(tile: Tile) -> bytes:
    store, at = fs.FileSystem.from_uri(tile.path) if "://" in tile.path else (fs.LocalFileSystem(), tile.path)
    with store.open_input_file(at) as source:
        source.seek(tile.at)
        return source.read(tile.size)


def decoded(data: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """Header, vertices (n, 3) and polygons of a tile."""
    magic, version, x, y, layer, _, polygons, vertices, *rest = HEADER.unpack_from(data)
    if magic != TILE_MAGIC or version != TILE_VERSION:
        raise ValueError("a tile has another mark or version")
    height, radius, climb, *box = rest[-10:-1]
    end = HEADER.size + 12 * vertices + POLYGON.itemsize * polygons
    if end > len(data):
        raise ValueError("a tile is cut short")
    verts = np.frombuffer(data, "<f4", 3 * vertices, HEADER.size).reshape(-1, 3)
    polys = np.frombuffer(data, POLYGON, polygons, HEADER.size + 12 * vertices)
    return {"x": x, "y": y, "layer": layer, "height": height, "radius": radius, "climb": climb, "low": box[:3], "high": box[3:]}, verts, polys


POLYGONS = "path string, tile int, poly int, area int, kind int, flags int, corners array<array<double>>, neighbours array<int>, sides array<int>"
TILES = "path string, tile int, ref long, x int, y int, layer int, polygons int, vertices int, height double, radius double, climb double, low array<double>, high array<double>"


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], whole: bool) -> None:
        self.paths, self.whole = paths, whole

    def partitions(self) -> list[Tile]:
        return [t for p in self.paths for t in tiles_of(p)[1]]

    def read(self, partition: Tile) -> Iterator[tuple]:
        head, verts, polys = decoded(content_of(partition))
        if self.whole:
            yield (partition.path, partition.number, partition.ref, head["x"], head["y"], head["layer"], len(polys), len(verts), head["height"], head["radius"], head["climb"], list(head["low"]), list(head["high"]))
            return
        for i, p in enumerate(polys):
            n = int(p["n"])
            near = p["neighbours"][:n].astype(int).tolist()
            inner = [None if not x or x & OUTSIDE else x - 1 for x in near]
            sides = [x & ~OUTSIDE if x & OUTSIDE else None for x in near]
            yield (partition.path, partition.number, i, int(p["area_type"]) & 0x3F, int(p["area_type"]) >> 6, int(p["flags"]), verts[p["verts"][:n]].astype(float).tolist(), inner, sides)


class NavmeshSource(DataSource):
    """spark.read.format("navmesh").load(file): a row for each polygon, or with the option rows=tiles for each tile.

    neighbours: of each edge (from a corner to the next) the polygon behind it, null at a border or another tile's; sides: the side on
    which another tile lies.  The driver reads the tiles' places, each tile is read by a task of its own."""

    @classmethod
    def name(cls) -> str:
        return "navmesh"

    def _whole(self) -> bool:
        return self.options.get("rows", "polygons") == "tiles"

    def schema(self) -> str:
        return TILES if self._whole() else POLYGONS

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"].split(","), self._whole())


def navmesh(spark: SparkSession, path: str, rows: str = "polygons") -> DataFrame:
    spark.dataSource.register(NavmeshSource)
    return spark.read.format("navmesh").option("rows", rows).load(path)


def bounds(tiles: DataFrame) -> DataFrame:
    """path, min_x .. max_z over the tiles of each file."""
    side = [f(F.get(c, F.lit(i))).alias(f"{n}_{d}") for i, d in enumerate("xyz") for n, c, f in (("min", "low", F.min), ("max", "high", F.max))]
    return tiles.groupBy("path").agg(*side)


def walkable(polygons: DataFrame, walk: int = 1) -> DataFrame:
    """Ground polygons with a walking flag."""
    return polygons.filter((F.col("kind") == 0) & (F.col("flags").bitwiseAND(walk) != 0))


def triangles(polygons: DataFrame) -> DataFrame:
    """path, tile, poly, triangle (from 0 in its polygon), ax .. cz: each polygon as a fan from its first corner."""
    fans = polygons.filter(F.size("corners") > 2).withColumn("triangle", F.explode(F.sequence(F.lit(0), F.size("corners") - 3)))
    at = {"a": F.lit(0), "b": F.col("triangle") + 1, "c": F.col("triangle") + 2}
    return fans.select("path", "tile", "poly", "triangle", *[F.get(F.get("corners", i), F.lit(j)).alias(f"{v}{d}") for v, i in at.items() for j, d in enumerate("xyz")])


def links(polygons: DataFrame) -> DataFrame:
    """path, src, dst: structs (tile, poly) of polygons that share an edge; across tiles where edges of facing sides overlap along the border."""
    name = lambda poly: F.struct("tile", F.col(poly).alias("poly"))
    inner = polygons.withColumn("_n", F.explode("neighbours")).filter("_n IS NOT NULL").select("path", name("poly").alias("src"), name("_n").alias("dst"))
    edge = polygons.select("path", "tile", "poly", "corners", F.posexplode("sides").alias("_i", "side")).filter("side IS NOT NULL")
    a, b = F.get("corners", F.col("_i")), F.get("corners", (F.col("_i") + 1) % F.size("corners"))
    # a tile's sides 0 and 4 lie across x, 2 and 6 across z; what is equal on both sides is a hundredth of a unit
    across = F.when(F.col("side").isin(0, 4), 0).otherwise(2)
    along = F.when(F.col("side").isin(0, 4), 2).otherwise(0)
    pick = lambda p, i: F.when(i == 0, F.get(p, F.lit(0))).otherwise(F.get(p, F.lit(2)))
    edge = edge.select("path", name("poly").alias("at"), "side", F.round(pick(a, across), 2).alias("line"), F.least(pick(a, along), pick(b, along)).alias("low"), F.greatest(pick(a, along), pick(b, along)).alias("high"))
    other = edge.select(*[F.col(c).alias(f"_{c}") for c in edge.columns])
    facing = (F.col("path") == F.col("_path")) & (F.col("line") == F.col("_line")) & (F.col("side") == (F.col("_side") + 4) % 8)
    met = edge.join(other, facing & (F.col("low") < F.col("_high")) & (F.col("_low") < F.col("high")) & (F.col("at") != F.col("_at")))
    return inner.unionByName(met.select("path", F.col("at").alias("src"), F.col("_at").alias("dst"))).distinct()
