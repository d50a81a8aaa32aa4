"""Connected patches of one colour, on grids by tiles and on meshes by edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .lineage import cut

#: Edge of a tile; a task joins the runs of one tile at a time.
TILE = 256


def joined(pairs: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 .. n - 1 that each number reaches through the pairs: labels fall to the other end's, then to their label's own."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        was = label.copy()
        for side in (0, 1):
            np.minimum.at(label, label[pairs[:, side]], low)
            np.minimum.at(label, pairs[:, side], low)
        while (label[label] != label).any():
            label = label[label]
        if (was == label).all():
            break
    return label


def tile_patches(row: np.ndarray, col: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """For each cell of a tile the position of the first cell (by row, column) of its patch; cells are given once and in that order."""
    run = np.cumsum(np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1) | (colour[1:] != colour[:-1]))) - 1
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    width = int(col.max()) + 2
    at = row * width + col  # ascending
    below = np.searchsorted(at, at + width)
    there = below < len(at)
    there[there] = at[below[there]] == at[there] + width
    there[there] = colour[below[there]] == colour[there]
    pairs = np.unique(np.stack([run[there], run[below[there]]], 1), axis=0)
    return first[joined(pairs, len(first))[run]]


def coloured(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """cells (row, col, colour) of a grid -> row, col, colour, patch_row, patch_col: cells of one colour that are joined over their edges are a
    patch, named by its first cell by row and column.

    Patches of a tile are found in numpy, run by run; only the cells at its edges meet those of the next tile, and the
    tiles' patches are joined as a graph with an edge for each two that touch.  A patch may span all tiles: no task sees
    more than one.  Cells may be missing, and no cell may come twice with different colours; a null colour joins nothing and has no rows."""
    own = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "colour").filter(F.col("colour").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()).distinct()
    own = own.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile), "_colour": F.xxhash64("colour")})
    kind = cells.schema["colour"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        if pdf.duplicated(["row", "col"]).any():
            raise ValueError("a cell has two colours")
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        at = tile_patches(row - row.min(), col - col.min(), pdf["_colour"].to_numpy())
        return pdf[["row", "col", "colour"]].assign(_r=row[at], _c=col[at])

    named = cut(own.groupBy("_tr", "_tc").applyInPandas(run, f"row long, col long, colour {kind}, _r long, _c long"))
    name = lambda r, c, as_: F.struct(F.col(r).alias("r"), F.col(c).alias("c")).alias(as_)
    edge = named.select("row", "col", "colour", name("_r", "_c", "dst"))
    last = lambda x: F.pmod(F.col(x), F.lit(tile)) == tile - 1
    first = lambda x: F.pmod(F.col(x), F.lit(tile)) == 0
    touch = []
    for down, right, line in ((1, 0, "row"), (0, 1, "col")):
        here = named.filter(last(line)).select((F.col("row") + down).alias("row"), (F.col("col") + right).alias("col"), "colour", name("_r", "_c", "src"))
        touch.append(here.join(edge.filter(first(line)), ["row", "col", "colour"]).select("src", "dst"))
    edges = cut(touch[0].unionByName(touch[1]).distinct())
    across = graph.islands(edges, edges.select(F.col("src").alias("vertex")).limit(0))
    out = named.join(across, F.struct(F.col("_r").alias("r"), F.col("_c").alias("c")) == F.col("vertex"), "left")
    return out.select("row", "col", "colour", F.coalesce("island.r", "_r").alias("patch_row"), F.coalesce("island.c", "_c").alias("patch_col"))


def measured(patches: DataFrame) -> DataFrame:
    """coloured() -> patch_row, patch_col, colour, n and the box row0, row1, col0, col1 of each patch."""
    box = [f(F.col(x)).alias(f"{x}{i}") for x in ("row", "col") for i, f in ((0, F.min), (1, F.max))]
    return patches.groupBy("patch_row", "patch_col", "colour").agg(F.count(F.lit(1)).alias("n"), *box)


def on_mesh(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices (vertex, colour, x, y, z), edges (src, dst) -> component (its smallest vertex), colour, n, and the box min_x .. max_z of each
    connected part of one colour; vertices without a like neighbour are parts of their own."""
    own = vertices.select("vertex", "colour", "x", "y", "z")
    like = graph.same_kind_edges(edges, own, "vertex", "colour")
    part = graph.islands(like, own.select("vertex"))
    sides = [f(F.col(d)).alias(f"{n}_{d}") for d in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return own.join(part, "vertex").groupBy(F.col("island").alias("component"), "colour").agg(F.count(F.lit(1)).alias("n"), *sides)
