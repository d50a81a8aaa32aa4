"""Images as arrays (rows, columns, channels, flattened): resizing, cropping and changes of projection by tables made once.

Each change is a table that says of every new pixel which old pixels it sums and with what weights.  It depends on the sizes
alone, so it is made on the driver and applied to Arrow batches of images in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shape = tuple[int, int, int]
#: Numbers that a task holds of the old pixels of images at a time.
PASS = 1 << 22


@dataclass(frozen=True)
class Table:
    """New pixel p sums weight * old pixel `source` over the entries from first[p] up to first[p + 1]; each has at least one."""

    source: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    old: int  # pixels
    shape: Shape  # of the new image

    def apply(self, images: np.ndarray) -> np.ndarray:
        """images (n, old pixels, channels) -> (n, new pixels, channels)."""
        return np.add.reduceat(images[:, self.source] * self.weight[None, :, None], self.first, axis=1)


def _table(entries: Sequence[Sequence[tuple[int, float]]], old: int, shape: Shape) -> Table:
    size = np.array([len(e) for e in entries])
    flat = [x for e in entries for x in e]
    return Table(np.array([s for s, _ in flat]), np.array([w for _, w in flat], float), np.cumsum(size) - size, old, shape)


def resized(shape: Shape, size: tuple[int, int], how: str = "area") -> Table:
    """'area': the mean of all old pixels that a new one touches; 'nearest': the old pixel at its upper left."""
    (h, w, c), (nh, nw) = shape, size
    if how not in ("area", "nearest"):
        raise ValueError(f"{how} is neither area nor nearest")

    def span(i: int, old: int, new: int) -> range:
        low = i * old // new
        return range(low, low + 1) if how == "nearest" else range(low, -(-(i + 1) * old // new))

    entries = []
    for i in range(nh):
        for j in range(nw):
            own = [y * w + x for y in span(i, h, nh) for x in span(j, w, nw)]
            entries.append([(p, 1 / len(own)) for p in own])
    return _table(entries, h * w, (nh, nw, c))


def shortest_edge(shape: Shape, size: int, how: str = "area") -> Table:
    """The shorter edge becomes `size`, the other follows in proportion, rounded down."""
    scale = size / min(shape[:2])
    return resized(shape, (int(shape[0] * scale), int(shape[1] * scale)), how)


def centred(shape: Shape, size: tuple[int, int]) -> Table:
    """The middle part of `size`; a part larger than the image is an error."""
    (h, w, c), (nh, nw) = shape, size
    top, left = h // 2 - nh // 2, w // 2 - nw // 2
    if min(top, left) < 0 or top + nh > h or left + nw > w:
        raise ValueError(f"{size} isn't within {shape}")
    return _table([[((top + i) * w + left + j, 1.0)] for i in range(nh) for j in range(nw)], h * w, (nh, nw, c))


# What is right, down and ahead for the cameras of a cube, in the order in which their images come.
FACES = {
    "back": ((-1, 0, 0), (0, 1, 0), (0, 0, -1)),
    "down": ((1, 0, 0), (0, 0, -1), (0, 1, 0)),
    "front": ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    "left": ((0, 0, 1), (0, 1, 0), (-1, 0, 0)),
    "right": ((0, 0, -1), (0, 1, 0), (1, 0, 0)),
    "up": ((1, 0, 0), (0, 0, 1), (0, -1, 0)),
}


def sphere(height: int, width: int) -> np.ndarray:
    """Directions of the pixels of an equirectangular image: right, down, ahead."""
    phi = ((np.arange(height) + 0.5) * np.pi / height - np.pi / 2)[:, None]
    theta = ((np.arange(width) + 0.5) * 2 * np.pi / width - np.pi)[None]
    return np.stack([np.cos(phi) * np.sin(theta), np.sin(phi) + 0 * theta, np.cos(phi) * np.cos(theta)], -1).reshape(-1, 3)


def face_rays(face: str, edge: int) -> np.ndarray:
    """Directions of the pixels of a camera of the cube."""
    at = np.arange(edge) + 0.5 - edge / 2
    own = np.stack([np.tile(at, edge), np.repeat(at, edge), np.full(edge * edge, edge / 2)], -1)
    return own / np.linalg.norm(own, axis=1, keepdims=True) @ np.array(FACES[face], float)


def _blended(x: np.ndarray, y: np.ndarray, height: int, width: int, base: np.ndarray) -> list[list[tuple[int, float]]]:
    """Old pixels around places (-1 to 1 across the centres of the outermost pixels) by their distance; none outside."""
    px, py = (x + 1) / 2 * (width - 1), (y + 1) / 2 * (height - 1)
    out = []
    for a, b, start in zip(px, py, base, strict=True):
        i, j = int(np.floor(b)), int(np.floor(a))
        taps = [(r, s, (1 - abs(b - r)) * (1 - abs(a - s))) for r in (i, i + 1) for s in (j, j + 1)]
        own = [(int(start) + r * width + s, wt) for r, s, wt in taps if 0 <= r < height and 0 <= s < width and wt > 0]
        out.append(own or [(0, 0.0)])
    return out


def cube_to_sphere(edge: int, size: tuple[int, int], channels: int = 1) -> Table:
    """Six images of a cube, one after the other in the order of FACES, to an equirectangular one; a direction on the seam is
    the first face's that sees it."""
    rays = sphere(*size)
    face, x, y = np.full(len(rays), -1), np.zeros(len(rays)), np.zeros(len(rays))
    for n, axes in enumerate(FACES.values()):
        local = rays @ np.array(axes, float).T
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = local[:, 0] / np.abs(local[:, 2]), local[:, 1] / np.abs(local[:, 2])
        sees = (face < 0) & (local[:, 2] > 0) & (np.maximum(np.abs(u), np.abs(v)) <= 1)
        face[sees], x[sees], y[sees] = n, u[sees], v[sees]
    entries = _blended(x, y, edge, edge, face * edge * edge)
    return _table([e if f >= 0 else [(0, 0.0)] for e, f in zip(entries, face, strict=True)], 6 * edge * edge, (*size, channels))


def sphere_to_cube(size: tuple[int, int], face: str, edge: int, channels: int = 1) -> Table:
    """An equirectangular image to that of one camera of the cube."""
    rays = face_rays(face, edge)
    x = np.arctan2(rays[:, 0], rays[:, 2]) / np.pi
    y = np.arctan2(rays[:, 1], np.hypot(rays[:, 0], rays[:, 2])) / (np.pi / 2)
    return _table(_blended(x, y, *size, np.zeros(len(rays))), size[0] * size[1], (edge, edge, channels))


def changed(table: Table, *images: str | Column, whole: bool = False) -> Column:
    """The new image (an array of doubles, or of whole numbers rounded towards 0) of one image, or of several put behind each other.

    Null if one of them is; an image of another size raises an error."""
    channels = table.shape[2]

    @F.pandas_udf("array<bigint>" if whole else "array<double>")
    def run(image: pd.Series) -> pd.Series:
        out, have = pd.Series([None] * len(image), index=image.index, dtype=object), [i for i, v in enumerate(image) if v is not None]
        step = max(1, PASS // max(1, len(table.source) * channels))
        for a in range(0, len(have), step):
            part = have[a : a + step]
            if any(len(image.iloc[i]) != table.old * channels for i in part):
                raise ValueError(f"an image hasn't {table.old} pixels of {channels} channels")
            old = np.stack([np.asarray(image.iloc[i], float) for i in part]).reshape(len(part), table.old, channels)
            new = table.apply(old).reshape(len(part), -1)
            for i, v in zip(part, np.trunc(new + 1e-9 * np.sign(new)).astype(np.int64) if whole else new, strict=True):
                out.iat[i] = v
        return out

    return run(F.concat(*images) if len(images) > 1 else F.col(images[0]) if isinstance(images[0], str) else images[0])


def with_virtual_keys(df: DataFrame, keys: dict[str, int]) -> DataFrame:
    """A column of zeros of the given length for each name; one that is there already is replaced."""
    return df.withColumns({k: F.array_repeat(F.lit(0.0).cast("float"), n) for k, n in keys.items()})
