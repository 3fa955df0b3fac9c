"""Tile sequences of trajectories and the support of what they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewarden.functions.geo import haversine_km, interpolate


def runs(tiled: DataFrame, tile: str = "tile_id") -> DataFrame:
    """tiled with run: number of the contiguous stay in a tile, within the trajectory."""
    w = Window.partitionBy("trajectory_id").orderBy("ts", "seq")
    moved = F.when(F.col(tile).eqNullSafe(F.lag(tile).over(w)), 0).otherwise(1)
    return tiled.withColumn("_moved", moved).withColumn("run", F.sum("_moved").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_moved")


def _collapse(items: Column) -> Column:
    return F.filter(items, lambda x, i: (i == 0) | (x["tile"] != F.get(items, i - 1)["tile"]))


def tile_sequences(tiled: DataFrame, tile: str = "tile_id", repeats: bool = True) -> DataFrame:
    """trajectory_id, tiles (array): contiguous stays collapsed; without repeats each tile at its first visit only."""
    ordered = tiled.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", F.col(tile).alias("tile")))).alias("items"))
    tiles = F.transform(_collapse(F.col("items")), lambda x: x["tile"]) if repeats else F.array_distinct(F.transform("items", lambda x: x["tile"]))
    return ordered.select("trajectory_id", tiles.alias("tiles"))


def combinations(sequences: DataFrame, knowledge: int = 2) -> DataFrame:
    """trajectory_id, combo: the distinct ordered sub-sequences of min(knowledge, length) tiles; of sequences of two or more.

    A sequence of n tiles has C(n, knowledge) of them; they are unfolded position by position inside the row's task. What is
    shuffled to tell equal ones apart are the sequences, by trajectory, not the combinations.
    """
    kind = sequences.schema["tiles"].dataType.elementType.simpleString()
    size = F.least(F.size("tiles"), F.lit(knowledge))
    rows = sequences.filter(F.size("tiles") > 1).repartition("trajectory_id").select("trajectory_id", "tiles", size.alias("k"), F.array().cast(f"array<{kind}>").alias("combo"), F.lit(-1).alias("last"))
    for step in range(knowledge):
        more = rows.filter(F.col("k") > step).withColumn("at", F.explode(F.sequence(F.col("last") + 1, F.size("tiles") - F.col("k") + step)))
        grown = more.select("trajectory_id", "tiles", "k", F.concat("combo", F.array(F.get("tiles", F.col("at")))).alias("combo"), F.col("at").alias("last"))
        done = rows.filter(F.col("k") <= step)
        rows = grown if step < 2 else grown.unionByName(done)
    return rows.select("trajectory_id", "combo").distinct()


def combination_support(sequences: DataFrame, knowledge: int = 2) -> DataFrame:
    """combo, n: the number of trajectories that hold it."""
    return combinations(sequences, knowledge).groupBy("combo").agg(F.count("*").alias("n"))


def split_combinations(sequences: DataFrame, k: int = 3, knowledge: int = 2) -> DataFrame:
    """trajectory_id, bad, good: the combinations of a trajectory with support below k, and the others."""
    each = combinations(sequences, knowledge)
    support = each.groupBy("combo").agg((F.count("*") < k).alias("rare"))
    marked = each.join(support, "combo")
    return marked.groupBy("trajectory_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("rare"), F.col("combo")))).alias("bad"), F.array_sort(F.collect_list(F.when(~F.col("rare"), F.col("combo")))).alias("good")
    )


def pair_support(sequences: DataFrame) -> DataFrame:
    """tile, next_tile, n: occurrences of consecutive tiles; a sequence of one tile counts with a null next tile."""
    pairs = F.when(F.size("tiles") > 1, F.zip_with(F.slice("tiles", 1, F.size("tiles") - 1), F.slice("tiles", 2, F.size("tiles") - 1), lambda a, b: F.struct(a.alias("tile"), b.alias("next_tile"))))
    single = F.array(F.struct(F.get("tiles", F.lit(0)).alias("tile"), F.lit(None).cast("long").alias("next_tile")))
    return sequences.filter(F.size("tiles") > 0).select(F.explode(F.coalesce(pairs, single)).alias("p")).groupBy("p.tile", "p.next_tile").agg(F.count("*").alias("n"))


def densify(locations: DataFrame, meters: float = 1000) -> DataFrame:
    """locations and, on hops of at least `meters`, evenly spaced fake ones (fake = true), interpolated in time."""
    w = Window.partitionBy("trajectory_id").orderBy("ts", "seq")
    lagged = locations.select("*", *[F.lag(x).over(w).alias(f"p_{x}") for x in ("lon", "lat", "ts")])
    lagged = lagged.withColumn("m", haversine_km("p_lon", "p_lat", "lon", "lat") * 1000)
    far = lagged.filter(F.col("m") >= meters).withColumn("n", F.floor(F.col("m") / meters).cast("int"))
    steps = far.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("u", F.col("i") / (F.col("n") + 1))
    fakes = steps.select(
        "trajectory_id", "user_id", F.floor(F.col("p_ts") + F.col("u") * (F.col("ts") - F.col("p_ts"))).cast("long").alias("ts"), (F.col("i").cast("long") - 1_000_000).alias("seq"),
        interpolate("p_lon", 0, "lon", 1, "u").alias("lon"), interpolate("p_lat", 0, "lat", 1, "u").alias("lat"), F.lit(True).alias("fake"),
    )
    return locations.select("trajectory_id", "user_id", "ts", "seq", "lon", "lat", F.lit(False).alias("fake")).unionByName(fakes)
