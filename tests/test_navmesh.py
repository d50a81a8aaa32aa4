"""Navigation meshes written by hand in the documented layout, read tile by tile."""

import struct

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, mesh
from tessella.sources import navmesh


def tile(x, verts, polys, low, high):
    """polys: (corners, neighbours, flags, area, kind)"""
    body = b"".join(struct.pack("<3f", *v) for v in verts)
    for corners, near, flags, area, kind in polys:
        pad = lambda v: list(v) + [0] * (6 - len(v))
        body += struct.pack("<I6H6HHBB", 0xFFFFFFFF, *pad(corners), *pad(near), flags, len(corners), area | kind << 6)
    head = struct.pack("<5iI9i", navmesh.TILE_MAGIC, navmesh.TILE_VERSION, x, 0, 0, 7, len(polys), len(verts), 4, 0, 0, 0, 0, 0, 0)
    return head + struct.pack("<10f", 1.5, 0.1, 0.2, *low, *high, 20.0) + body + b"\0" * 48  # links and detail follow


def two_tiles():
    """Two squares side by side in one tile, the second beside a third in the next tile; the third's neighbour in its tile is a jump."""
    left = tile(0, [(0, 0, 0), (2, 0, 0), (2, 0, 2), (0, 0, 2), (4, 0, 0), (4, 0, 2)], [((0, 3, 2, 1), (0, 0, 2, 0), 1, 3, 0), ((1, 2, 5, 4), (1, 0, 0x8000, 0), 1, 3, 0)], (0, 0, 0), (4, 1, 2))
    right = tile(1, [(4, 0, 0), (4, 0, 2), (6, 0, 2), (6, 0, 0), (4, 0, 5), (6, 0, 5)], [((0, 1, 2, 3), (0x8004, 0, 0, 0), 1, 5, 0), ((1, 4, 5), (0x8004, 0, 0), 0, 5, 0), ((0, 5), (0, 0), 1, 0, 1)], (4, -1, 0), (6, 1, 5))
    return [left, right]


def written(path, tiles, version=2, count=None):
    head = struct.pack("<3i5f2i", navmesh.SET_MAGIC, version, len(tiles) if count is None else count, 0, 0, 0, 4, 4, 128, 4096)
    settings = struct.pack("<13f4?", *[i / 8 for i in range(13)], True, False, True, False) if version >= 2 else b""
    path.write_bytes(head + settings + b"".join(struct.pack("<Ii", i + 1, len(t)) + t for i, t in enumerate(tiles)))
    return str(path)


@pytest.mark.parametrize("version", [1, 2])
def test_read(spark, tmp_path, version):
    path = written(tmp_path / "a.navmesh", two_tiles(), version)
    settings, places = navmesh.tiles_of(path)
    assert len(places) == 2 and (settings == {} if version == 1 else settings["agent_radius"] == 3 / 8 and settings["filter_walkable_low_height_spans"])
    polygons = navmesh.navmesh(spark, path)
    assert polygons.rdd.getNumPartitions() == 2
    got = {(r.tile, r.poly): r for r in polygons.collect()}
    assert [list(c) for c in got[0, 1].corners] == [[2, 0, 0], [2, 0, 2], [4, 0, 2], [4, 0, 0]] and got[0, 1].neighbours == [0, None, None, None] and got[0, 1].sides == [None, None, 0, None]
    assert got[0, 0].neighbours == [None, None, 1, None] and got[1, 2].kind == 1 and got[1, 0].area == 5
    assert {(r.tile, r.poly) for r in navmesh.walkable(polygons).collect()} == {(0, 0), (0, 1), (1, 0)}
    tiles = navmesh.navmesh(spark, path, "tiles")
    assert [(r.ref, r.x, r.polygons, r.vertices, r.height) for r in tiles.orderBy("tile").collect()] == [(1, 0, 2, 6, 1.5), (2, 1, 3, 6, 1.5)]
    assert navmesh.bounds(tiles).first()[1:] == (0, 6, -1, 1, 0, 5)


def test_islands_and_snapping(spark, tmp_path):
    """What is read feeds the graph and the mesh search."""
    polygons = navmesh.walkable(navmesh.navmesh(spark, written(tmp_path / "b.navmesh", two_tiles())))
    links = navmesh.links(polygons)
    assert {((r.src.tile, r.src.poly), (r.dst.tile, r.dst.poly)) for r in links.collect()} == {((0, 0), (0, 1)), ((0, 1), (0, 0)), ((0, 1), (1, 0)), ((1, 0), (0, 1))}
    vertices = polygons.select(F.struct("tile", "poly").alias("vertex"))
    assert {(r.island.tile, r.island.poly) for r in graph.islands(links, vertices).collect()} == {(0, 0)}
    triangles = navmesh.triangles(polygons).withColumn("triangle", F.col("tile") * 100 + F.col("poly") * 10 + F.col("triangle"))
    assert triangles.count() == 6
    dots = spark.createDataFrame([(1, 5.0, 0.5, 1.0), (2, 3.0, 0.0, 4.0)], "id long, x double, y double, z double")
    got = {r.id: (r.snap_x, r.snap_y, r.snap_z, r.distance) for r in mesh.nearest_triangle(dots, triangles).collect()}
    assert got == {1: (5.0, 0.0, 1.0, 0.5), 2: (3.0, 0.0, 2.0, 2.0)}


def test_faults(tmp_path):
    good = written(tmp_path / "c.navmesh", two_tiles())
    data = open(good, "rb").read()
    for name, content, said in (("short", data[:20], "too short"), ("mark", b"XXXX" + data[4:], "no navigation mesh"), ("version", data[:4] + struct.pack("<i", 3) + data[8:], "no navigation mesh"), ("cut", data[:-30], "within its tile 1")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(ValueError, match=said):
            navmesh.tiles_of(str(tmp_path / name))
    with pytest.raises(ValueError, match="before its tile 2"):
        navmesh.tiles_of(written(tmp_path / "d", two_tiles(), count=3))
    (tmp_path / "e").write_bytes(data[: navmesh.SET.size + navmesh.SETTINGS.size].replace(struct.pack("<3i", navmesh.SET_MAGIC, 2, 2), struct.pack("<3i", navmesh.SET_MAGIC, 2, 2)) + struct.pack("<Ii", 0, 0))
    assert navmesh.tiles_of(str(tmp_path / "e"))[1] == []
    with pytest.raises(ValueError, match="mark"):
        navmesh.decoded(b"\0" * 200)
