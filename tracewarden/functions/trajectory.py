"""Functions on trajectories: the nested form (an array of locations) and per-hop columns of the long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewarden.functions.geo import haversine_km, outside

def nest(locations: DataFrame) -> DataFrame:
    """trajectory_id, user_id, n, locs (array of ts, seq, lon, lat in time order). One shuffle, partly aggregated."""
    locs = F.array_sort(F.collect_list(F.struct("ts", "seq", "lon", "lat")))
    return locations.groupBy("trajectory_id", "user_id").agg(locs.alias("locs")).select("trajectory_id", "user_id", F.size("locs").alias("n"), "locs")


def unnest(trajectories: DataFrame) -> DataFrame:
    return trajectories.select("trajectory_id", "user_id", F.explode("locs").alias("l")).select("trajectory_id", "user_id", "l.ts", "l.seq", "l.lon", "l.lat")


def hops(locations: DataFrame, radius: float | None = None, by: str = "trajectory_id") -> DataFrame:
    """The long form with previous location, hop_km and hop_s (null on the first location)."""
    w = Window.partitionBy(by).orderBy("ts", "seq")
    out = locations.select("*", F.lag("lon").over(w).alias("prev_lon"), F.lag("lat").over(w).alias("prev_lat"), F.lag("ts").over(w).alias("prev_ts"))
    args = ("prev_lon", "prev_lat", "lon", "lat")
    return out.withColumn("hop_km", haversine_km(*args) if radius is None else haversine_km(*args, radius)).withColumn("hop_s", F.abs(F.col("ts") - F.col("prev_ts")))


def lengths(locations: DataFrame) -> DataFrame:
    """trajectory_id, user_id, n_locations, length_km."""
    return hops(locations).groupBy("trajectory_id", "user_id").agg(F.count("*").alias("n_locations"), F.coalesce(F.sum("hop_km"), F.lit(0.0)).alias("length_km"))


def average_speeds(locations: DataFrame) -> DataFrame:
    """trajectory_id, avg_speed_kmh: mean over all hops, in which a hop without duration counts as speed 0."""
    speed = F.when(F.col("hop_s") == 0, 0.0).otherwise(F.col("hop_km") / F.col("hop_s"))
    per = hops(locations).groupBy("trajectory_id").agg(F.sum(speed).alias("s"), F.count("*").alias("n"))
    return per.select("trajectory_id", F.when(F.col("n") < 2, 0.0).otherwise(F.col("s") / (F.col("n") - 1) * 3600).alias("avg_speed_kmh"))


def too_fast(max_kmh: float) -> Column:
    """Of a hop: faster than the limit; a hop without duration is."""
    return F.coalesce((F.col("hop_s") == 0) | (F.col("hop_km") / F.nullif(F.col("hop_s"), F.lit(0)) * 3600 > max_kmh), F.lit(False))


def first_ts(locs: str = "locs") -> Column:
    return F.get(F.col(locs), F.lit(0))["ts"]


def last_ts(locs: str = "locs") -> Column:
    return F.element_at(F.col(locs), -1)["ts"]


def timestamps(locs: str = "locs") -> Column:
    return F.transform(locs, lambda x: x["ts"])


def within(start, end, locs: str = "locs") -> Column:
    """The locations of a closed interval of time."""
    return F.filter(locs, lambda x: x["ts"].between(start, end))


def at(ts, locs: str = "locs") -> Column:
    return F.get(F.filter(locs, lambda x: x["ts"] == ts), F.lit(0))


def before(ts, locs: str = "locs") -> Column:
    return F.try_element_at(F.filter(locs, lambda x: x["ts"] < ts), F.lit(-1))


def after(ts, locs: str = "locs") -> Column:
    return F.get(F.filter(locs, lambda x: x["ts"] > ts), F.lit(0))


def leaves(box: tuple[float, float, float, float], locs: str = "locs") -> Column:
    """Some location lies outside the closed box."""
    return F.exists(locs, lambda x: outside(x["lon"], x["lat"], box))


def centroid(locs: str = "locs") -> Column:
    """Mean of an array of locations: coordinates to five decimals, time truncated."""
    n = F.size(locs)

    def mean(field: str) -> Column:
        return F.aggregate(locs, F.lit(0.0), lambda a, x: a + x[field]) / n

    return F.struct(mean("ts").cast("long").alias("ts"), F.bround(mean("lon"), 5).alias("lon"), F.bround(mean("lat"), 5).alias("lat"))


def content_key(locs: str = "locs") -> Column:
    """Identity of a trajectory by its content: a hash, to be joined with equality of the content itself."""
    return F.xxhash64(F.transform(locs, lambda x: F.struct(x["ts"], x["lon"], x["lat"])))
