"""One trajectory for each cluster. Members: cluster_id, trajectory_id, n, locs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.geo import space_time_weighted
from tracewarden.operators.mdav import arrays


def _positions(n: Column, stride: Column, exact: bool) -> Column:
    """The place of each of n steps: strides added one by one, or step times stride."""
    if not exact:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * stride + 1e-9).cast("int"))
    walk = F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit(0.0).alias("x"), F.array().cast("array<int>").alias("o")), lambda a, _: F.struct((a["x"] + stride).alias("x"), F.concat(a["o"], F.array(a["x"].cast("int"))).alias("o")))
    return walk["o"]


def mean_points(members: DataFrame, exact: bool = True) -> DataFrame:
    """cluster_id, i, ts, lon, lat: mean of the members at step i. Only one row a cluster and step leaves each task."""
    length = members.groupBy("cluster_id").agg(F.rint(F.avg("n")).cast("int").alias("steps"))
    m = members.select("cluster_id", "locs", "n").join(length, "cluster_id").withColumn("stride", F.bround(F.col("n") / F.col("steps"), 2))
    taken = F.transform(_positions(F.col("steps"), F.col("stride"), exact), lambda at: F.get(F.col("locs"), F.least(at, F.col("n") - 1)))
    picked = m.select("cluster_id", F.posexplode(taken).alias("i", "l"))
    means = picked.groupBy("cluster_id", "i").agg(F.avg("l.ts").alias("ts"), F.avg("l.lon").alias("lon"), F.avg("l.lat").alias("lat"))
    return means.select("cluster_id", "i", F.col("ts").cast("long").alias("ts"), F.bround("lon", 5).alias("lon"), F.bround("lat", 5).alias("lat"))


def _collected(points: DataFrame) -> DataFrame:
    locs = F.array_sort(F.collect_list(F.struct("ts", F.col("i").cast("long").alias("seq"), "lon", "lat")))
    return points.groupBy("cluster_id").agg(locs.alias("locs")).select("cluster_id", F.size("locs").alias("n"), "locs")


def mean_trajectories(members: DataFrame, exact: bool = True) -> DataFrame:
    """cluster_id, n, locs."""
    return _collected(mean_points(members, exact))


def closest_locations(members: DataFrame, p_lambda: float, exact: bool = True) -> DataFrame:
    """The mean trajectory with each point replaced by the members' nearest location; the first of equally near."""
    points = _collected(mean_points(members, exact)).select("cluster_id", F.col("locs").alias("points"))
    m = members.select("cluster_id", "trajectory_id", "locs").join(points, "cluster_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_nearest(p, q, p_lambda) for p, q in zip(*(arrays(b.column(c)) for c in ("points", "locs")))]
            n = [len(i) for i, _ in found]
            i, at = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, int) for k in (0, 1))
            rows = pa.array(np.repeat(np.arange(b.num_rows), n))
            offsets = np.cumsum([0, *b.column("locs").value_lengths().to_pylist()])[:-1]
            l = b.column("locs").flatten().take(pa.array(np.repeat(offsets, n) + at))
            q = b.column("points").flatten()
            first = np.cumsum([0, *b.column("points").value_lengths().to_pylist()])[:-1]
            q = q.take(pa.array(np.repeat(first, n) + i))
            yield pa.RecordBatch.from_arrays(
                [b.column("cluster_id").take(rows), b.column("trajectory_id").take(rows), pa.array(at), *(q.field(c) for c in ("seq", "ts", "lon", "lat")), l],
                names=["cluster_id", "trajectory_id", "at", "i", "ts", "lon", "lat", "l"],
            )

    kinds = "cluster_id long, trajectory_id long, at long, i long, ts long, lon double, lat double, l struct<ts: long, seq: long, lon: double, lat: double>"
    typed = m.select(F.col("cluster_id").cast("long").alias("cluster_id"), "trajectory_id", "locs", "points")
    d = space_time_weighted("lon", "lat", "ts", F.col("l.lon"), F.col("l.lat"), F.col("l.ts"), p_lambda)
    near = typed.mapInArrow(run, kinds).groupBy("cluster_id", "i").agg(F.min_by("l", F.struct(d, "trajectory_id", "at")).alias("l"))
    return _collected(near.select("cluster_id", "i", "l.ts", "l.lon", "l.lat"))


def _nearest(points: np.ndarray, locs: np.ndarray, p_lambda: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of points and of the locations that are nearest to them, but for rounding."""
    apart = points[:, None, :] - locs[None, :, :]
    d = np.sqrt(apart[:, :, 1] ** 2 + apart[:, :, 2] ** 2 + (p_lambda * apart[:, :, 0]) ** 2)
    return np.nonzero(d <= d.min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-12)


def closest_trajectories(members: DataFrame, p_lambda: float, exact: bool = True) -> DataFrame:
    """The member nearest to the mean trajectory."""
    from tracewarden.functions.trajectory import average_speeds, unnest
    from tracewarden.operators.distance import martinez, sums

    means = mean_trajectories(members, exact)
    speed = lambda df, key: average_speeds(unnest(df.select(F.col(key).alias("trajectory_id"), F.lit(0).alias("user_id"), "locs")))
    m = means.join(speed(means, "cluster_id").select(F.col("trajectory_id").alias("cluster_id"), F.col("avg_speed_kmh").alias("vm")), "cluster_id").select("cluster_id", F.col("locs").alias("lm"), "vm")
    r = members.join(speed(members, "trajectory_id"), "trajectory_id").select("cluster_id", "trajectory_id", "n", "locs", "avg_speed_kmh")
    pairs = r.join(m, "cluster_id").withColumn("s", sums("lm", "locs", exact)).select("*", "s.h", "s.dd", "s.dt", "s.tt", ((F.col("vm") + F.col("avg_speed_kmh")) / 2).alias("speed"))
    best = pairs.withColumn("d", martinez(p_lambda)).groupBy("cluster_id").agg(F.min_by(F.struct("n", "locs"), F.struct("d", "trajectory_id")).alias("b"))
    return best.select("cluster_id", "b.n", "b.locs")
