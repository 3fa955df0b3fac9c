"""SwapAllLocations: clusters of near locations exchange their trajectories, then rare pairs of tiles are suppressed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.geo import EARTH_KM
from tracewarden.operators.filters import at_least_two
from tracewarden.operators.graph import components
from tracewarden.operators.mdav import km
from tracewarden.operators.sequences import densify, pair_support, tile_sequences
from tracewarden.operators.tessellation import grid, square_tiles
from tracewarden.session import checkpointed


def radii(low: int, high: int, step: int | None = None) -> list[int]:
    """From low to high, both included; without a step in two steps."""
    step = step or int(abs(high - low) / 2)
    return list(range(low, high + 1, step)) if step > 0 else [low]


def swap_clusters(rows: pa.Table, k: int, r_s: list[int], r_t: list[int], seed: int, group: int) -> pa.Table:
    """The locations of one group that found a cluster, with exchanged ids.

    Seeds are taken at random; a cluster is the first radius (time outside, space inside) with k trajectories, each with
    its location nearest in time.
    """
    rng = np.random.default_rng([seed, group & 0xFFFFFFFF])
    rows = rows.sort_by([("ts", "ascending"), ("trajectory_id", "ascending"), ("seq", "ascending")])
    tid, ts = rows.column("trajectory_id").to_numpy(), rows.column("ts").to_numpy()
    lon, lat = rows.column("lon").to_numpy(), rows.column("lat").to_numpy()
    alive = np.ones(len(ts), bool)
    new = np.full(len(ts), -1)
    per_m = math.degrees(1 / (EARTH_KM * 1000)) * (1 + 1e-6)  # degrees of latitude
    for i in rng.permutation(len(ts)):
        if not alive[i]:
            continue
        found = None
        for t in r_t:  # wider only where no cluster is found
            a, b = np.searchsorted(ts, [ts[i] - t, ts[i] + t + 1])
            near = np.flatnonzero(alive[a:b]) + a
            if len(near) < k:
                continue
            north = np.abs(lat[near] - lat[i])
            for s in r_s:
                hit = near[north <= s * per_m]  # a superset: distances are walked of these alone
                hit = hit[km(lon[hit], lat[hit], lon[i], lat[i]) * 1000 <= s]
                hit = hit[np.argsort(np.abs(ts[hit] - ts[i]), kind="stable")]
                first = hit[np.sort(np.unique(tid[hit], return_index=True)[1])]
                if len(first) >= k:
                    found = first
                    break
            if found is not None:
                break
        if found is None:
            alive[i] = False
        else:
            alive[found] = False
            new[found] = found[rng.permutation(len(found))]
    done = np.flatnonzero(new >= 0)
    out = rows.take(pa.array(done))
    uid = rows.column("user_id").to_numpy()
    return out.set_column(out.schema.get_field_index("trajectory_id"), "trajectory_id", pa.array(tid[new[done]])).set_column(out.schema.get_field_index("user_id"), "user_id", pa.array(uid[new[done]]))


def apart(locations: DataFrame, meters: int, seconds: int) -> DataFrame:
    """locations with component: two locations within the radii have the same one.

    Cells are as wide as the radii, so what is near lies in neighbouring cells; components are those of occupied cells.
    """
    top = F.broadcast(locations.agg(F.least(F.max(F.abs("lat")), F.lit(89.0)).alias("top")))  # one row
    deg = meters / 1000 / (EARTH_KM * math.pi / 180)
    cell = F.struct(F.floor(F.col("ts") / max(seconds, 1)).alias("t"), F.floor(F.col("lat") / deg).alias("y"), F.floor(F.col("lon") * F.cos(F.radians(F.col("top"))) / deg).alias("x"))
    placed = checkpointed(locations.crossJoin(top).withColumn("cell", cell).drop("top"), "placed")
    key = lambda t, y, x: F.xxhash64(t, y, x)  # noqa: E731  (cells of equal hashes become one component, which is as right)
    cells = placed.select("cell.*").distinct()
    ahead = [(t, y, x) for t in (0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (t, y, x) > (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("tyx", s)]) for s in ahead])
    probe = cells.withColumn("s", F.explode(steps)).select(key("t", "y", "x").alias("a"), key(F.col("t") + F.col("s.t"), F.col("y") + F.col("s.y"), F.col("x") + F.col("s.x")).alias("b"))
    nodes = checkpointed(cells.select(key("t", "y", "x").alias("node")).distinct(), "cells")
    links = probe.join(nodes.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    of_cell = components(nodes, links).select(F.col("node").alias("key"), "component")
    return placed.withColumn("key", key("cell.t", "cell.y", "cell.x")).join(of_cell, "key").drop("key", "cell")


def swap_all(
    locations: DataFrame, k: int = 3, max_r_s: int = 500, max_r_t: int = 120, min_r_s: int = 100, min_r_t: int = 60, step_s: int | None = None, step_t: int | None = None, tile_size: int = 1000,
    seed: int = 0, suppress: bool = True,
) -> DataFrame:
    """Locations under exchanged ids. What can't meet, in space or time, is clustered apart and in parallel."""
    r_s, r_t = radii(min_r_s, max_r_s, step_s), radii(min_r_t, max_r_t, step_t)
    names = ("trajectory_id", "user_id", "ts", "seq", "lon", "lat")
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return swap_clusters(rows.select(list(names)), k, r_s, r_t, seed, key[0].as_py())

    swapped = apart(locations.select(*names), r_s[-1], r_t[-1]).groupBy("component").applyInArrow(run, "trajectory_id long, user_id long, ts long, seq long, lon double, lat double")
    swapped = checkpointed(at_least_two(swapped), "swapped")
    if swapped.isEmpty():
        raise ValueError("no cluster can be built with these parameters; relax them")
    return at_least_two(suppress_rare_pairs(swapped, tile_size)) if suppress else swapped


def suppress_rare_pairs(locations: DataFrame, tile_size: int = 1000) -> DataFrame:
    """Without the locations in tiles that a trajectory has only in pairs seen once over all trajectories."""
    dense = densify(locations, tile_size)
    shape = grid(dense, tile_size)
    sequences = tile_sequences(square_tiles(dense, tile_size, shape), repeats=False)
    support = pair_support(sequences).filter("n > 1").select("tile", "next_tile")
    pairs = sequences.select("trajectory_id", "tiles", F.explode(F.when(F.size("tiles") > 1, F.sequence(F.lit(0), F.size("tiles") - 2)).otherwise(F.array(F.lit(0)))).alias("i"))
    pairs = pairs.select("trajectory_id", F.get("tiles", F.col("i")).alias("tile"), F.get("tiles", F.col("i") + 1).alias("next_tile"))
    common = pairs.alias("p").join(support.alias("s"), (F.col("p.tile") == F.col("s.tile")) & F.col("p.next_tile").eqNullSafe(F.col("s.next_tile")), "left_semi")
    keep = common.select("trajectory_id", F.explode(F.array("tile", "next_tile")).alias("tile_id")).filter(F.col("tile_id").isNotNull()).distinct()
    return square_tiles(locations, tile_size, shape).join(keep, ["trajectory_id", "tile_id"], "left_semi").select(*locations.columns)
