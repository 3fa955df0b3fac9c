"""k-anonymous density heat maps over a quadtree.

The tree's cells do not depend on the order of insertion: a cell exists if all cells above it hold more locations than
the cap. So cells and counts come from one aggregation by (depth, column, row), without a tree. A point on a centre line
belongs to the left or lower cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.geo import haversine_km, mercator_x, mercator_y
from tracewarden.operators.mdav import km

_CELL = ("depth", "cx", "cy")
#: A merging subtree is searched in one task; subtrees begin at this depth or above.
SUBTREE_DEPTH = 3


def frame(locations: DataFrame, min_sector_length: float = 100) -> DataFrame:
    """One row: bounds and max_depth."""
    box = locations.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    side = F.least(haversine_km("min_lon", "min_lat", "max_lon", "min_lat"), haversine_km("min_lon", "min_lat", "min_lon", "max_lat")) * 1000
    return box.withColumn("max_depth", F.greatest(F.log2(side / min_sector_length).cast("int"), F.lit(0)))


def _at_depth(value: str, low: str, high: str, depth) -> F.Column:
    cells = F.pow(F.lit(2.0), depth)
    return F.greatest(F.least(F.ceil((F.col(value) - F.col(low)) / (F.col(high) - F.col(low)) * cells) - 1, cells - 1), F.lit(0)).cast("long")


def placed_cells(locations: DataFrame, box: DataFrame) -> DataFrame:
    """A row for each location and depth: depth, cx, cy and the bounds."""
    t = locations.crossJoin(F.broadcast(box)).withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("max_depth"))))  # one row
    return t.withColumn("cx", _at_depth("lon", "min_lon", "max_lon", F.col("depth"))).withColumn("cy", _at_depth("lat", "min_lat", "max_lat", F.col("depth")))


def _counts(locations: DataFrame, box: DataFrame) -> DataFrame:
    """depth, cx, cy, n of all depths: locations are counted in the deepest cells, whose counts are rolled up."""
    t = locations.crossJoin(F.broadcast(box))  # one row
    deep = t.select(_at_depth("lon", "min_lon", "max_lon", F.col("max_depth")).alias("x"), _at_depth("lat", "min_lat", "max_lat", F.col("max_depth")).alias("y"), "max_depth")
    deepest = deep.groupBy("x", "y", "max_depth").agg(F.count("*").alias("n"))
    rolled = deepest.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("max_depth"))))
    up = F.pow(F.lit(2.0), F.col("max_depth") - F.col("depth"))
    return rolled.groupBy("depth", F.floor(F.col("x") / up).cast("long").alias("cx"), F.floor(F.col("y") / up).cast("long").alias("cy")).agg(F.sum("n").alias("n"))


def cells(locations: DataFrame, cap: int = 5, min_sector_length: float = 100, box: DataFrame | None = None) -> DataFrame:
    """depth, cx, cy, n of the tree's non-empty cells, the bounds of the whole and max_depth."""
    box = frame(locations, min_sector_length) if box is None else box
    counts = _counts(locations, box)
    # counts fall with depth, so the cell above decides: it exists and holds more than the cap, hence do all above it
    above = counts.select((F.col("depth") + 1).alias("depth"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("n").alias("n_above"))
    t = counts.withColumn("px", F.shiftright("cx", 1)).withColumn("py", F.shiftright("cy", 1)).join(above, ["depth", "px", "py"], "left")
    return t.filter((F.col("depth") == 0) | (F.col("n_above") > cap)).select(*_CELL, "n").crossJoin(F.broadcast(box))


def _bounded(chosen: DataFrame) -> DataFrame:
    """Bounds, n_locations and density (locations a square metre of the projection) of chosen cells."""
    w, h = ((F.col(f"max_{x}") - F.col(f"min_{x}")) / F.pow(F.lit(2.0), F.col("depth")) for x in ("lon", "lat"))
    b = chosen.select((F.col("min_lon") + F.col("cx") * w).alias("w"), (F.col("min_lat") + F.col("cy") * h).alias("s"), (F.col("min_lon") + (F.col("cx") + 1) * w).alias("e"), (F.col("min_lat") + (F.col("cy") + 1) * h).alias("t"), "n")
    return with_density(b.select(F.col("w").alias("min_lon"), F.col("s").alias("min_lat"), F.col("e").alias("max_lon"), F.col("t").alias("max_lat"), F.col("n").alias("n_locations")))


def with_density(sectors: DataFrame) -> DataFrame:
    area = (mercator_x("max_lon") - mercator_x("min_lon")) * (mercator_y("max_lat") - mercator_y("min_lat"))
    return sectors.withColumn("density", F.col("n_locations") / area)


def _split_flags(tree: DataFrame, min_k: int) -> DataFrame:
    """tree with children (number of non-empty ones) and splits (each of them holds min_k)."""
    below = tree.groupBy((F.col("depth") - 1).alias("depth"), F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy")).agg(F.min("n").alias("least"))
    return tree.join(below, list(_CELL), "left").withColumn("splits", F.coalesce(F.col("least") >= min_k, F.lit(False)))


def _top(tree: DataFrame, depth: int) -> DataFrame:
    """Cells of which all cells above split and which don't themselves, or lie at `depth`: one join with the cells above."""
    ends = tree.filter((F.col("depth") <= depth) & (~F.col("splits") | (F.col("depth") == depth)))
    up = ends.withColumn("d", F.explode_outer(F.when(F.col("depth") > 0, F.sequence(F.lit(0), F.col("depth") - 1))))
    shift = F.pow(F.lit(2.0), F.col("depth") - F.col("d"))
    up = up.withColumn("x", F.floor(F.col("cx") / shift)).withColumn("y", F.floor(F.col("cy") / shift))
    inner = tree.filter("splits").select(F.col("depth").alias("d"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(1).alias("one"))
    met = up.join(inner, ["d", "x", "y"], "left").groupBy(*tree.columns).agg(F.coalesce(F.sum("one"), F.lit(0)).alias("above"))
    return met.filter(F.col("above") == F.col("depth")).drop("above")


def heatmap(locations: DataFrame, min_k: int = 5, min_sector_length: float = 100, merge_sectors: bool = True, split_n_locations: int | None = None) -> DataFrame:
    """Sectors of at least min_k locations: min_lon, min_lat, max_lon, max_lat, n_locations, density."""
    cap = min_k if split_n_locations is None else split_n_locations
    if merge_sectors:
        return _merged(locations, min_k, min_sector_length, cap)
    box = frame(locations, min_sector_length)
    depth = box.first()["max_depth"] or 0
    tree = _split_flags(cells(locations, cap, min_sector_length, box), min_k)
    return _bounded(_top(tree, depth).filter(F.col("n") >= min_k))


def _merged(locations: DataFrame, min_k: int, min_sector_length: float, cap: int) -> DataFrame:
    """Where all children hold min_k the tree splits cleanly, so subtrees are independent; each is searched in one task."""
    box = frame(locations, min_sector_length)
    depth = box.first()["max_depth"] or 0
    top = min(SUBTREE_DEPTH, depth)
    tree = _split_flags(cells(locations, cap, min_sector_length, box), min_k)
    roots = _top(tree.filter(F.col("depth") <= top + 1), top).select(*_CELL)
    points = placed_cells(locations, box).filter(F.col("depth") <= top).join(roots, list(_CELL), "left_semi")
    w, h = ((F.col(f"max_{x}") - F.col(f"min_{x}")) / F.pow(F.lit(2.0), F.col("depth")) for x in ("lon", "lat"))
    points = points.select(*_CELL, "lon", "lat", (F.col("min_lon") + F.col("cx") * w).alias("w"), (F.col("min_lat") + F.col("cy") * h).alias("s"), (F.col("min_lon") + (F.col("cx") + 1) * w).alias("e"), (F.col("min_lat") + (F.col("cy") + 1) * h).alias("t"), (F.col("max_depth") - F.col("depth")).alias("left"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        xy = np.c_[rows.column("lon").to_numpy(), rows.column("lat").to_numpy()]
        bounds = tuple(rows.column(c)[0].as_py() for c in ("w", "s", "e", "t"))
        found = sectors(xy, bounds, rows.column("left")[0].as_py(), min_k, min_sector_length, cap)
        flat = list(zip(*[(*b, n) for b, n in found])) or [()] * 5
        return pa.table([*(pa.array(c, pa.float64()) for c in flat[:4]), pa.array(flat[4], pa.int64())], names=["min_lon", "min_lat", "max_lon", "max_lat", "n_locations"])

    found = points.groupBy(*_CELL).applyInArrow(run, "min_lon double, min_lat double, max_lon double, max_lat double, n_locations long")
    return with_density(found)


def sectors(xy: np.ndarray, box: tuple, depth: int, min_k: int, min_sector_length: float, cap: int) -> list[tuple[tuple, int]]:
    """Sectors of one (sub)tree, children that are too small being merged with an edge neighbour where that suffices.

    A merged pair of at least twice min_k becomes a tree of its own; children that can't be merged leave their parent.
    """
    if len(xy) <= cap or depth <= 0:
        return [(box, len(xy))] if len(xy) >= min_k else []
    w, s, e, t = box
    cx, cy = (w + e) / 2, (s + t) / 2
    place = 2 * (xy[:, 0] > cx) + (xy[:, 1] > cy)  # lower left, upper left, lower right, upper right
    boxes = [(w, s, cx, cy), (w, cy, cx, t), (cx, s, e, cy), (cx, cy, e, t)]
    parts = [xy[place == i] for i in range(4)]
    sizes = [len(p) for p in parts]
    waiting = sorted((i for i in range(4) if sizes[i]), key=lambda i: (sizes[i], i))
    out: list[tuple[tuple, int]] = []
    while waiting:
        i = waiting.pop(0)
        if sizes[i] >= min_k:
            out += sectors(parts[i], boxes[i], depth - 1, min_k, min_sector_length, cap)
            continue
        beside = sorted((j for j in ((i ^ 1), (i ^ 2)) if j in waiting), key=lambda j: (sizes[j], j))
        j = next((j for j in beside if sizes[i] + sizes[j] >= min_k), None)
        if j is None:
            return [(box, len(xy))]
        waiting.remove(j)
        a, b = boxes[i], boxes[j]
        both = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        n = sizes[i] + sizes[j]
        if n >= 2 * min_k:
            out += sectors(np.r_[parts[i], parts[j]], both, max_depth(both, min_sector_length), min_k, min_sector_length, cap)
        else:
            out.append((both, n))
    return out


def max_depth(box: tuple, min_sector_length: float) -> int:
    w, s, e, t = box
    side = min(km(w, s, e, s), km(w, s, w, t)) * 1000
    return int(math.log2(side / min_sector_length)) if side > 0 else 0


def in_box(tree: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The sectors of a heat map that a box touches."""
    return tree.filter((F.col("min_lon") <= box[2]) & (F.col("max_lon") >= box[0]) & (F.col("min_lat") <= box[3]) & (F.col("max_lat") >= box[1]))
