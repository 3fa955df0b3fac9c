"""Writing results: CSV with UTC text timestamps, pandas, NumPy, GeoJSON features, measures as JSON, file conversion."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.sources.locations import spark_pattern


def csv_rows(locations: DataFrame, datetime_format: str = "%Y/%m/%d %H:%M:%S") -> DataFrame:
    """lon, lat, timestamp (text, UTC), trajectory_id, user_id in the order of the CSV files."""
    text = F.date_format(F.timestamp_seconds("ts"), spark_pattern(datetime_format))
    return locations.select("lon", "lat", text.alias("timestamp"), "trajectory_id", "user_id")


def write_csv(locations: DataFrame, path: str, **options) -> None:
    """A folder of CSV parts with headers, by trajectory; an error if there is nothing to write."""
    if locations.isEmpty():
        raise ValueError("the dataset has no locations")
    csv_rows(locations.repartition("trajectory_id").sortWithinPartitions("trajectory_id", "ts", "seq"), **options).write.option("header", True).csv(path)


def to_pandas(locations: DataFrame, single: bool = True):
    """lng, lat, datetime, uid, tid; single casts coordinates and ids to 32 bits as the classic long form does."""
    real, whole = ("float", "int") if single else ("double", "long")
    return locations.orderBy("trajectory_id", "ts", "seq").select(
        F.col("lon").cast(real).alias("lng"), F.col("lat").cast(real).alias("lat"), F.timestamp_seconds("ts").alias("datetime"), F.col("user_id").cast(whole).alias("uid"), F.col("trajectory_id").cast(whole).alias("tid")
    ).toPandas()


def to_numpy(locations: DataFrame, by_time: bool = False):
    order = ("ts", "trajectory_id", "seq") if by_time else ("trajectory_id", "ts", "seq")
    return locations.orderBy(*order).select("lon", "lat", "ts", "trajectory_id", "user_id").toPandas().to_numpy(dtype=float)


def geojson_features(heatmap: DataFrame) -> DataFrame:
    """One column `feature`: a GeoJSON feature for each row of a heat map."""
    corner = [("min_lon", "min_lat"), ("min_lon", "max_lat"), ("max_lon", "max_lat"), ("max_lon", "min_lat"), ("min_lon", "min_lat")]
    ring = F.array(*[F.array(a, b) for a, b in corner])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return heatmap.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("n_locations", "density").alias("properties"), geometry.alias("geometry"))).alias("feature"))


def write_geojson(heatmap: DataFrame, path: str) -> None:
    """A folder with one feature a line (GeoJSON text sequence without separators)."""
    geojson_features(heatmap).write.text(path)


def measures_json(measures: dict[str, float], path: str) -> None:
    with open(path, "w") as f:
        json.dump(measures, f, indent=4)


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> None:
    spark.read.option("header", True).option("inferSchema", True).csv(source).write.parquet(target)


def parquet_to_csv(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.option("header", True).csv(target)
