"""Tables of pixels against loops over pixels."""

import math
import random

import numpy as np
import pytest

from tessella.operators import images


def picture(h, w, c, seed):
    rng = random.Random(seed)
    return [rng.randint(0, 255) for _ in range(h * w * c)]


@pytest.mark.parametrize(("shape", "size"), [((8, 8, 1), 5), ((6, 9, 3), 4), ((4, 4, 2), 7), ((5, 3, 1), 3)])
def test_shortest_edge(spark, shape, size):
    h, w, c = shape
    table = images.shortest_edge(shape, size)
    nh, nw = int(h * size / min(h, w)), int(w * size / min(h, w))
    assert table.shape == (nh, nw, c)
    pics = [picture(*shape, s) for s in range(3)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pics)] + [(9, None)], "id long, image array<int>")
    near = images.changed(images.shortest_edge(shape, size, "nearest"), "image", whole=True)
    got = {r.id: r for r in df.select("id", images.changed(table, "image").alias("area"), near.alias("near")).collect()}
    assert got[9].area is None and got[9].near is None
    for i, p in enumerate(pics):
        a = np.array(p).reshape(shape)
        for y in range(nh):
            for x in range(nw):
                block = a[y * h // nh : math.ceil((y + 1) * h / nh), x * w // nw : math.ceil((x + 1) * w / nw)]
                for k in range(c):
                    assert got[i].area[(y * nw + x) * c + k] == pytest.approx(block[:, :, k].mean())
                    assert got[i].near[(y * nw + x) * c + k] == a[y * h // nh, x * w // nw, k]


def test_centred(spark):
    pic = picture(7, 6, 2, 1)
    df = spark.createDataFrame([(pic,)], "image array<int>")
    got = df.select(images.changed(images.centred((7, 6, 2), (3, 4)), "image", whole=True).alias("v")).first().v
    assert list(got) == np.array(pic).reshape(7, 6, 2)[2:5, 1:5].reshape(-1).tolist()
    with pytest.raises(ValueError, match="isn't within"):
        images.centred((7, 6, 2), (8, 2))
    with pytest.raises(Exception, match="hasn't"):
        df.select(images.changed(images.centred((5, 5, 1), (2, 2)), "image")).collect()


def test_cube(spark):
    """Each camera sees its own part; a picture of directions comes back; there and back again loses little."""
    edge = 16
    order = list(images.FACES)
    flat = [[float(n)] * (edge * edge) for n in range(6)]
    df = spark.createDataFrame([tuple(flat), tuple([None, *flat[1:]])], ", ".join(f"{n} array<double>" for n in order))
    table = images.cube_to_sphere(edge, (12, 24))
    got = df.select(images.changed(table, *order).alias("v")).collect()
    assert got[1].v is None
    view, rays = np.array(got[0].v).reshape(12, 24), images.sphere(12, 24).reshape(12, 24, 3)
    axis, sign = np.abs(rays).argmax(2), np.sign(np.take_along_axis(rays, np.abs(rays).argmax(2)[..., None], 2))[..., 0]
    names = {(0, 1): "right", (0, -1): "left", (1, 1): "down", (1, -1): "up", (2, 1): "front", (2, -1): "back"}
    clear = np.sort(np.abs(rays), 2)[..., 2] - np.sort(np.abs(rays), 2)[..., 1] > 0.02
    for y, x in zip(*np.nonzero(clear), strict=True):
        assert view[y, x] == pytest.approx(order.index(names[axis[y, x], sign[y, x]]))
    smooth = lambda d: d[:, 0] + 2 * d[:, 1] - d[:, 2]
    faces = np.stack([smooth(images.face_rays(n, edge)) for n in order]).reshape(1, -1, 1)
    seen = images.cube_to_sphere(edge, (24, 48)).apply(faces)
    assert np.abs(seen[0, :, 0] - smooth(images.sphere(24, 48))).max() < 0.25 and np.abs(seen[0, :, 0] - smooth(images.sphere(24, 48))).mean() < 0.08
    back = images.sphere_to_cube((24, 48), "front", edge).apply(seen)
    assert np.abs(back[0, :, 0] - faces[0, 2 * edge * edge : 3 * edge * edge, 0]).mean() < 0.12


def test_virtual_keys(spark):
    got = images.with_virtual_keys(spark.range(2), {"goal": 3, "none": 0})
    assert [(list(r.goal), list(r.none)) for r in got.collect()] == [([0.0] * 3, [])] * 2 and dict(got.dtypes)["goal"] == "array<float>"
