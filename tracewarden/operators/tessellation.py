"""Tessellation: squares of a side in web-Mercator metres in closed form, polygons by a grid of cells, levels of time.

A square grid needs no geometry and no join: the tile is computed from the coordinates and one row of bounds. Cells are
half open and the far edge belongs to the last cell, so that no location of the data is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.geo import SPHERE_M, inverse_lat, inverse_lon, mercator_x, mercator_y


def grid(locations: DataFrame, meters: float) -> DataFrame:
    """One row: origin x0, y0 and shape n_rows, n_cols of the grid over the bounding box."""
    box = locations.agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    m = F.lit(float(meters))
    out = box.select(mercator_x("w").alias("x0"), mercator_y("s").alias("y0"), mercator_x("e").alias("x1"), mercator_y("n").alias("y1"))
    return out.select(
        "x0", "y0", F.greatest(F.ceil((F.col("y1") - F.col("y0")) / m), F.lit(1)).cast("long").alias("n_rows"),
        F.greatest(F.ceil((F.col("x1") - F.col("x0")) / m), F.lit(1)).cast("long").alias("n_cols"), m.alias("meters"),
    )


def square_tiles(locations: DataFrame, meters: float = 500, shape: DataFrame | None = None, clamp: bool = True) -> DataFrame:
    """locations with tile_col, tile_row, tile_id and the grid's columns. shape: a grid of other locations.

    With clamp, the far edge belongs to the last cell; without, locations off the grid are dropped.
    """
    g = grid(locations, meters) if shape is None else shape
    t = locations.crossJoin(F.broadcast(g))  # one row
    col = F.floor((mercator_x("lon") - F.col("x0")) / F.col("meters"))
    row = F.floor((mercator_y("lat") - F.col("y0")) / F.col("meters"))
    if not clamp:
        edge_x = (mercator_x("lon") - F.col("x0")) / F.col("meters") <= F.col("n_cols")
        edge_y = (mercator_y("lat") - F.col("y0")) / F.col("meters") <= F.col("n_rows")
        t = t.filter((col >= 0) & (row >= 0) & edge_x & edge_y)
    t = t.withColumn("tile_col", F.greatest(F.least(col, F.col("n_cols") - 1), F.lit(0)).cast("long"))
    t = t.withColumn("tile_row", F.greatest(F.least(row, F.col("n_rows") - 1), F.lit(0)).cast("long"))
    return t.withColumn("tile_id", F.col("tile_col") * F.col("n_rows") + F.col("tile_row"))


def centre_lon() -> Column:
    """Longitude of the centre of a square tile."""
    return inverse_lon(F.col("x0") + (F.col("tile_col") + 0.5) * F.col("meters"))


def centre_lat() -> Column:
    return inverse_lat(F.col("y0") + (F.col("tile_row") + 0.5) * F.col("meters"))


def time_levels(locations: DataFrame, seconds: int, bounds: DataFrame | None = None) -> DataFrame:
    """locations with time_level and level_ts: intervals open on the left from the earliest time on; that is in level 0."""
    t0 = F.broadcast((locations if bounds is None else bounds).agg(F.min("ts").alias("_t0")))  # one row
    level = F.greatest(F.ceil((F.col("ts") - F.col("_t0")) / F.lit(seconds)) - 1, F.lit(0)).cast("long")
    t = locations.crossJoin(t0).withColumn("time_level", level)
    return t.withColumn("level_ts", F.col("_t0") + F.col("time_level") * seconds).drop("_t0")


def validate_tiles(tiles: DataFrame) -> None:
    """An error at planning time if tiles aren't tile_id and polygons."""
    kinds = dict(tiles.dtypes)
    if kinds.get("polygons") != "array<array<array<array<double>>>>" or "tile_id" not in kinds:
        raise ValueError("tiles need tile_id and polygons (array of polygons of rings of lon, lat)")


def polygon_tiles(locations: DataFrame, tiles: DataFrame, keep_unmapped: bool = False, cell_deg: float = 0.01) -> DataFrame:
    """locations with the tile_id of the polygon that holds them (strictly inside; several: a row each).

    Polygons and locations meet by equal grid cells, an equi-join; what meets is tested by ray casting in Arrow batches.
    """
    validate_tiles(tiles)
    flat = F.flatten(F.flatten("polygons"))
    xs, ys = F.transform(flat, lambda p: p[0]), F.transform(flat, lambda p: p[1])
    boxed = tiles.select("tile_id", "polygons", F.array_min(xs).alias("w"), F.array_max(xs).alias("e"), F.array_min(ys).alias("s"), F.array_max(ys).alias("n"))

    def span(a: str, b: str) -> Column:
        return F.sequence(F.floor(F.col(a) / cell_deg).cast("long"), F.floor(F.col(b) / cell_deg).cast("long"))

    cells = boxed.withColumn("cx", F.explode(span("w", "e"))).withColumn("cy", F.explode(span("s", "n")))
    placed = locations.withColumn("_row", F.monotonically_increasing_id())
    at = placed.withColumn("cx", F.floor(F.col("lon") / cell_deg).cast("long")).withColumn("cy", F.floor(F.col("lat") / cell_deg).cast("long"))
    near = at.join(cells, ["cx", "cy"]).filter(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
    names = [*placed.columns, "tile_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lon, lat, shapes = (b.column(b.schema.get_field_index(k)) for k in ("lon", "lat", "polygons"))
            inside = [contains(p, x, y) for p, x, y in zip(shapes.to_pylist(), lon.to_pylist(), lat.to_pylist())]
            yield b.select(names).filter(pa.array(inside, pa.bool_()))

    kinds = {f.name: f.dataType.simpleString() for f in near.schema.fields}
    hit = near.select(*names, "polygons").mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names))
    if not keep_unmapped:
        return hit.drop("_row")
    missed = placed.join(hit.select("_row").distinct(), "_row", "left_anti").withColumn("tile_id", F.lit(None).cast(kinds["tile_id"]))
    return hit.unionByName(missed).drop("_row")


def contains(polygons: list, x: float, y: float) -> bool:
    """Ray casting: inside an outer ring and outside its holes; a point on an edge is not inside."""
    for rings in polygons:
        odd = False
        for ring in rings:
            p = np.asarray(ring, float)
            a, b = p[:-1] if (p[0] == p[-1]).all() else p, None
            b = np.roll(a, -1, axis=0)
            cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
            on = (cross == 0) & (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))
            if on.any():
                odd = False
                break
            up = (a[:, 1] > y) != (b[:, 1] > y)
            odd ^= bool((up & ((cross > 0) == (b[:, 1] > a[:, 1]))).sum() % 2)
        if odd:
            return True
    return False


def polygon_centroids(tiles: DataFrame) -> DataFrame:
    """tile_id, centre_lon, centre_lat: area-weighted centroids in web Mercator, holes taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for polygons in b.column(1).to_pylist():
                total = sx = sy = 0.0
                for rings in polygons:
                    for k, ring in enumerate(rings):
                        p = np.asarray(ring, float)
                        x, y = SPHERE_M * np.radians(p[:, 0]), SPHERE_M * np.log(np.tan(np.pi / 4 + np.radians(p[:, 1]) / 2))
                        ox, oy = x[0], y[0]
                        x, y = x - ox, y - oy
                        cross = x * np.roll(y, -1) - np.roll(x, -1) * y
                        area = cross.sum() / 2
                        sign = (1 if k == 0 else -1) * (1 if area >= 0 else -1)
                        total += sign * area
                        sx += sign * (((x + np.roll(x, -1)) * cross).sum() / 6 + ox * area)
                        sy += sign * (((y + np.roll(y, -1)) * cross).sum() / 6 + oy * area)
                cx, cy = sx / total, sy / total
                out.append((np.degrees(cx / SPHERE_M), np.degrees(2 * np.arctan(np.exp(cy / SPHERE_M)) - np.pi / 2)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64())], names=["tile_id", "centre_lon", "centre_lat"])

    return tiles.select(F.col("tile_id").cast("long").alias("tile_id"), "polygons").mapInArrow(run, "tile_id long, centre_lon double, centre_lat double")
