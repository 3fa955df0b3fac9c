"""Measures of utility and privacy of an anonymized dataset against its original. Each gives one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewarden.functions.geo import EARTH_KM_ROUND, haversine_km
from tracewarden.functions.trajectory import content_key, hops, nest
from tracewarden.operators.distance import EXHAUSTIVE, estimate_lambda, martinez, nearest, pair_sums, reference_trajectory, to_reference, with_speeds
from tracewarden.operators.sequences import tile_sequences
from tracewarden.operators.stats import removed, sample_size, window_size
from tracewarden.operators.tessellation import grid, square_tiles, time_levels
from tracewarden.session import global_rank

trajectories_removed = removed


def _weight(original: DataFrame, p_lambda: float | None) -> float:
    return float(estimate_lambda(original).first()["p_lambda"] or 0.0) if p_lambda is None else p_lambda


def rsme(original: DataFrame, anonymized: DataFrame, p_lambda: float | None = None, exact: bool = True) -> DataFrame:
    """rsme: root of the summed squared distances of equal ids over the number of anonymized trajectories."""
    weight = _weight(original, p_lambda)
    pairs = pair_sums(with_speeds(original), with_speeds(anonymized), F.col("l.trajectory_id") == F.col("r.trajectory_id"), exact)
    total = pairs.agg(F.coalesce(F.sum(F.pow(martinez(weight), 2)), F.lit(0.0)).alias("s"))
    n = anonymized.select(F.countDistinct("trajectory_id").alias("n"))
    return total.crossJoin(F.broadcast(n)).select(F.round(F.sqrt(F.col("s") / F.col("n")), 4).alias("rsme"))


def _ranked(locations: DataFrame, reference: DataFrame, weight: float, exact: bool) -> DataFrame:
    """with_speeds and to_reference."""
    return with_speeds(locations).join(to_reference(locations, reference, weight, exact), "trajectory_id")


def nearest_originals(original: DataFrame, anonymized: DataFrame, p_lambda: float, window: int | None = None, exact: bool = True) -> DataFrame:
    """b (anonymized), a (its nearest original), d. With a window, among the originals next to it by distance to the reference.

    The window is a band of ranks: a range of the sorted originals, found by an as-of search of the rank. Blocks of originals
    and blocks of those that ask meet in a cell, where bounds of the distances leave few to be walked.
    """
    if window is None:
        return nearest(with_speeds(original), with_speeds(anonymized), p_lambda, exact)
    reference = reference_trajectory(original)
    o = _ranked(original, reference, p_lambda, exact)
    # ranks by range partition: each takes its own rank and the number of rows in the ranges before
    o = global_rank(o, "to_reference", "trajectory_id")
    n = o.count()
    a = _ranked(anonymized, reference, p_lambda, exact)
    marks = o.select(F.col("to_reference").alias("v"), F.col("rank"), F.lit(None).cast("long").alias("b"))
    asks = a.select(F.col("to_reference").alias("v"), F.lit(None).cast("long").alias("rank"), F.col("trajectory_id").alias("b"))
    bucketed = marks.unionByName(asks)
    lo, hi = o.agg(F.min("to_reference"), F.max("to_reference")).first()
    parts = max(1, min(200, n // 5000))
    width = ((hi - lo) / parts) or 1.0
    part = F.greatest(F.least(F.floor((F.col("v") - lo) / width), F.lit(parts - 1)), F.lit(0))
    bucketed = bucketed.withColumn("part", part)
    edges = o.groupBy(F.greatest(F.least(F.floor((F.col("to_reference") - lo) / width), F.lit(parts - 1)), F.lit(0)).alias("part")).agg(F.min(F.struct("to_reference", "rank")).alias("f"), F.max(F.struct("to_reference", "rank")).alias("l")).collect()  # a row a part
    first, last = {r["part"]: r["f"] for r in edges}, {r["part"]: r["l"] for r in edges}
    extra = []
    for p in range(parts):
        before = max((q for q in last if q < p), default=None)
        after = min((q for q in first if q > p), default=None)
        extra += [(p, float(x["to_reference"]), x["rank"]) for x in ((last[before] if before is not None else None), (first[after] if after is not None else None)) if x]
    if extra:
        spark = original.sparkSession
        more = spark.createDataFrame(extra, "part long, v double, rank long").select("v", "rank", F.lit(None).cast("long").alias("b"), "part")
        bucketed = bucketed.unionByName(more)
    w = Window.partitionBy("part").orderBy("v", F.col("b").isNull().cast("int"))
    known = F.when(F.col("rank").isNotNull(), F.struct("v", "rank"))
    at = bucketed.withColumn("lo", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    pos = F.when(F.col("lo").isNull(), F.col("hi.rank")).when(F.col("hi").isNull(), F.col("lo.rank") + 1).when(F.col("hi.v") - F.col("v") < F.col("v") - F.col("lo.v"), F.col("hi.rank")).otherwise(F.col("lo.rank"))
    cut = window // 2
    start, end = pos - cut + (1 if window % 2 == 0 else 0), pos + cut
    spill_low, spill_high = F.greatest(-start, F.lit(0)), F.greatest(end - (n - 1), F.lit(0))
    span = at.filter(F.col("b").isNotNull()).select("b", (F.greatest(start, F.lit(0)) - spill_high).alias("from"), (F.least(end, F.lit(n - 1)) + spill_low).alias("to"))
    span = span.select("b", F.greatest("from", F.lit(0)).alias("from"), F.least("to", F.lit(n - 1)).alias("to"))
    ranked = o.select("trajectory_id", "avg_speed_kmh", "locs", "rank")
    asked = a.select("trajectory_id", "avg_speed_kmh", "locs").join(span.withColumnRenamed("b", "trajectory_id"), "trajectory_id")
    return nearest(ranked, asked, p_lambda, exact, band=True)


def record_linkage(original: DataFrame, anonymized: DataFrame, p_lambda: float | None = None, percen_window_size: float | None = None, exhaustive: bool = False, exact: bool = True) -> DataFrame:
    """percen_record_linkage: trajectories found again by their nearest original, copies sharing the credit."""
    weight = _weight(original, p_lambda)
    n = original.select("trajectory_id").distinct().count()
    window = None if exhaustive else window_size(n) if percen_window_size is None else int(n * percen_window_size / 100)
    near = nearest_originals(original, anonymized, weight, None if window is not None and window >= n else window, exact)
    keyed = nest(original).withColumn("key", content_key()).select("trajectory_id", "key", F.transform("locs", lambda x: F.struct(x["ts"], x["lon"], x["lat"])).alias("content"))
    groups = keyed.groupBy("key", "content").agg(F.count("*").alias("copies"))
    grouped = keyed.join(groups, ["key", "content"]).select("trajectory_id", "key", "content", "copies")
    found = near.join(grouped.select(F.col("trajectory_id").alias("a"), "key", "copies", "content"), "a")
    own = grouped.select(F.col("trajectory_id").alias("b"), F.col("key").alias("own_key"), F.col("content").alias("own"))
    hit = found.join(own, "b").filter((F.col("key") == F.col("own_key")) & (F.col("content") == F.col("own")))
    return hit.agg((F.coalesce(F.sum(1 / F.col("copies")), F.lit(0.0)) / n * 100).alias("p")).select(F.round("p", 2).alias("percen_record_linkage"))


def sampled_record_linkage(original: DataFrame, anonymized: DataFrame, p_lambda: float, seed: int = 0) -> DataFrame:
    """record_linkage with all pairs, of a sample of originals and their anonymized trajectories where there are many."""
    from tracewarden.sources.locations import sample_trajectories

    n = original.select("trajectory_id").distinct().count()
    if n > EXHAUSTIVE + 1000:
        original = sample_trajectories(original, sample_size(n), seed)
        anonymized = anonymized.join(original.select("trajectory_id").distinct(), "trajectory_id", "left_semi")
    return record_linkage(original, anonymized, p_lambda, exhaustive=True)


# --- location measures


def tile_visits(tiled: DataFrame) -> DataFrame:
    """tile_id, visits, users."""
    return tiled.groupBy("tile_id").agg(F.count("*").alias("visits"), F.countDistinct("user_id").alias("users"))


def random_entropy(tiled: DataFrame) -> DataFrame:
    """tile_id, entropy in bits of who visits, all users being alike."""
    return tiled.groupBy("tile_id").agg(F.log2(F.countDistinct("user_id").cast("double")).alias("entropy"))


def uncorrelated_entropy(tiled: DataFrame) -> DataFrame:
    """tile_id, entropy in nats of the users' shares of visits. Two levels of partial sums; no distinct."""
    per = tiled.groupBy("tile_id", "user_id").agg(F.count("*").alias("n"))
    # sum of -p ln p with p = n / N is ln N - (sum of n ln n) / N
    return per.groupBy("tile_id").agg((F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")).alias("entropy"))


def straight_line(locations: DataFrame) -> DataFrame:
    """user_id, distance_km: summed hops of a user."""
    return hops(locations, EARTH_KM_ROUND, "user_id").groupBy("user_id").agg(F.coalesce(F.sum("hop_km"), F.lit(0.0)).alias("distance_km"))


def square_displacement(locations: DataFrame, seconds: int = 3600) -> DataFrame:
    """user_id, km2: squared distance of a user's first location and the last within the time after it."""
    point = F.struct("ts", "seq", "lon", "lat")
    first = Window.partitionBy("user_id")
    t = locations.withColumn("t0", F.min("ts").over(first)).filter(F.col("ts") <= F.col("t0") + seconds)
    ends = t.groupBy("user_id").agg(F.min(point).alias("a"), F.max(point).alias("b"))
    return ends.select("user_id", F.pow(haversine_km("a.lon", "a.lat", "b.lon", "b.lat", EARTH_KM_ROUND), 2).alias("km2"))


def location_measures(original: DataFrame, anonymized: DataFrame, tesselation_meters: float = 250) -> DataFrame:
    """Five pairs of numbers, to four decimals. The tiles are those of the original; what lies off them is left out."""
    shape = grid(original, tesselation_meters)
    out = None
    for name, df in (("original", original), ("anonymized", anonymized)):
        tiled = square_tiles(df, tesselation_meters, shape, clamp=False)
        parts = [
            tile_visits(tiled).agg(F.round(F.avg("visits"), 4).alias(f"visits_per_location_{name}")),
            straight_line(df).agg(F.round(F.avg("distance_km"), 4).alias(f"distance_straight_line_{name}")),
            uncorrelated_entropy(tiled).agg(F.round(F.avg("entropy"), 4).alias(f"uncorrelated_location_entropy_{name}")),
            random_entropy(tiled).agg(F.round(F.avg("entropy"), 4).alias(f"random_location_entropy_{name}")),
            square_displacement(df).agg(F.round(F.avg("km2"), 4).alias(f"mean_square_displacement_{name}")),
        ]
        for p in parts:  # one row each
            out = p if out is None else out.crossJoin(F.broadcast(p))
    return out


def report(original: DataFrame, anonymized: DataFrame, key: str, value: str) -> DataFrame:
    """Key, value of the original and of the anonymized dataset side by side, for export."""
    return original.select(key, F.col(value).alias("original")).join(anonymized.select(key, F.col(value).alias("anonymized")), key)


# --- propensity


def sequence_features(locations: DataFrame, shape: DataFrame, tiles_size: float, time_interval: int | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """trajectory_id, features: tiles at first visit, numbered and scaled to 0..1; not padded yet."""
    tiled = square_tiles(locations, tiles_size, shape, clamp=False)
    top = F.col("n_rows") * F.col("n_cols") - 1
    if time_interval:
        tiled = time_levels(tiled, time_interval, bounds)
        last = F.broadcast(bounds.agg(F.ceil((F.max("ts") - F.min("ts")) / F.lit(time_interval)).alias("levels")))  # one row
        tiled = tiled.crossJoin(last).withColumn("scaled", (F.col("tile_id") + top * F.col("time_level")) / (top * F.greatest(F.col("levels"), F.lit(1))))
    else:
        tiled = tiled.withColumn("scaled", F.col("tile_id") / F.greatest(top, F.lit(1)))
    return tile_sequences(tiled, "scaled", repeats=False).select("trajectory_id", F.col("tiles").alias("features"))


def padded(features: DataFrame, width: int) -> DataFrame:
    """Zeros in front up to the width."""
    return features.withColumn("features", F.concat(F.array_repeat(F.lit(0.0), F.lit(width) - F.size("features")), F.col("features")))


def propensity_score(original: DataFrame, anonymized: DataFrame, tiles_size: float = 200, time_interval: int | None = None, seed: int = 0) -> DataFrame:
    """propensity: how well boosted trees tell anonymized from original sequences, 0 (not at all) to 1."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    shape = grid(original, tiles_size)
    parts = [sequence_features(df, shape, tiles_size, time_interval, original).withColumn("label", F.lit(float(y))) for y, df in enumerate((original, anonymized))]
    both = parts[0].unionByName(parts[1])
    width = both.agg(F.max(F.size("features"))).first()[0]
    data = padded(both, width).select("label", array_to_vector("features").alias("features"), F.pmod(F.xxhash64("trajectory_id", "label", F.lit(seed)), F.lit(4)).alias("fold"))
    model = GBTClassifier(maxIter=30, maxDepth=5, seed=seed).fit(data.filter("fold > 0"))
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(data).select(p.alias("p")).agg(F.round(4 * F.avg(F.pow(F.col("p") - 0.5, 2)), 4).alias("propensity"))
