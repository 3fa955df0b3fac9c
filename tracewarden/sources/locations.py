"""Reading trajectories: CSV and Parquet with column mapping, pandas and NumPy, and the event view of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("trajectory_id", "user_id", "ts", "seq", "lon", "lat")
SCHEMA = "trajectory_id long, user_id long, ts long, seq long, lon double, lat double"
CRS = "epsg:4326"
_STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%z": "XX", "%f": "SSSSSS"}


def spark_pattern(strptime: str) -> str:
    """A strptime pattern as Spark's; one that is Spark's already stays."""
    for k, v in _STRPTIME.items():
        strptime = strptime.replace(k, v)
    return strptime


def _seconds(df: DataFrame, name: str, pattern: str):
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.unix_timestamp(F.col(name), spark_pattern(pattern))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_seconds(F.col(name).cast("timestamp"))
    return F.col(name).cast("long")


def from_long(
    df: DataFrame, lat: str = "lat", lon: str = "lon", timestamp: str = "timestamp", user_id: str = "user_id", trajectory_id: str = "trajectory_id",
    datetime_format: str = "%Y/%m/%d %H:%M:%S", seq: str | None = None,
) -> DataFrame:
    """Any long-form frame in the canonical columns; further columns are left behind."""
    order = F.col(seq).cast("long") if seq else F.monotonically_increasing_id()
    return df.select(
        F.col(trajectory_id).cast("long").alias("trajectory_id"), F.col(user_id).cast("long").alias("user_id"), _seconds(df, timestamp, datetime_format).alias("ts"),
        order.alias("seq"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"),
    )


def valid(locations: DataFrame) -> DataFrame:
    """Without the trajectories that hold a location out of range."""
    good = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    bad = locations.filter(~F.coalesce(good, F.lit(False))).select("trajectory_id").distinct()
    return locations.join(bad, "trajectory_id", "left_anti")


def first_trajectories(locations: DataFrame, n: int) -> DataFrame:
    """The n trajectories of the smallest ids."""
    return locations.join(locations.select("trajectory_id").distinct().orderBy("trajectory_id").limit(n), "trajectory_id", "left_semi")


def sample_trajectories(locations: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Exactly n random trajectories (all, if fewer); a seed fixes which."""
    order = F.rand() if seed is None else F.md5(F.concat_ws(":", F.col("trajectory_id").cast("string"), F.lit(str(seed))))
    return locations.join(locations.select("trajectory_id").distinct().orderBy(order, "trajectory_id").limit(n), "trajectory_id", "left_semi")


def read_dataset(
    spark: SparkSession, path: str, filetype: str | None = None, min_locations: int = 0, n_trajectories: int | None = None, sample: int | None = None, seed: int | None = None, **mapping
) -> DataFrame:
    """Locations of a CSV or Parquet file, checked and cut down as asked. mapping: see from_long."""
    kind = (filetype or path.rsplit(".", 1)[-1]).lower()
    if kind == "csv":
        raw = spark.read.option("header", True).csv(path)
    elif kind == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise TypeError(f"files of type {kind!r} can't be read; use csv or parquet")
    out = valid(from_long(raw, **mapping))
    if min_locations:
        from tracewarden.operators.filters import by_n_locations

        out = by_n_locations(out, min_locations)
    if n_trajectories is not None:
        out = first_trajectories(out, n_trajectories)
    return sample_trajectories(out, sample, seed) if sample is not None else out


def from_pandas(spark: SparkSession, frame, **mapping) -> DataFrame:
    """From a pandas long form; the default names are lng, lat, datetime, uid and tid."""
    names = {"lat": "lat", "lon": "lng", "timestamp": "datetime", "user_id": "uid", "trajectory_id": "tid"} | mapping
    return from_long(spark.createDataFrame(frame), **names)


def from_numpy(spark: SparkSession, matrix) -> DataFrame:
    """From an n x 5 matrix: longitude, latitude, timestamp, trajectory, user."""
    import pandas as pd

    frame = pd.DataFrame(matrix, columns=["lon", "lat", "ts", "trajectory_id", "user_id"]).reset_index(names="seq")
    return spark.createDataFrame(frame).selectExpr("cast(trajectory_id AS long) trajectory_id", "cast(user_id AS long) user_id", "cast(ts AS long) ts", "cast(seq AS long) seq", "lon", "lat")


_VIEW = [
    "user_id",
    "CAST(floor(unix_micros(cast(ts AS timestamp)) / 1000000) AS BIGINT) AS ts",
    "event_id AS seq",
    "1.23e0 + (user_id % 10) * 0.004e0 + (event_id % 97) * 0.0001e0 + value * 0.00001e0 AS lon",
    "41.10e0 + (user_id % 7) * 0.005e0 + (event_id % 89) * 0.0001e0 AS lat",
]


def event_locations(spark: SparkSession, sf_dir: str, by: str = "day") -> DataFrame:
    """Locations derived from the events table; a trajectory is a user's day or a user."""
    tid = "user_id * 100 + extract(DAY FROM ts) AS trajectory_id" if by == "day" else "user_id AS trajectory_id"
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(tid, *_VIEW)
