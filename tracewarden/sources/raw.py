"""Sources of raw public formats: tile files, cab logs, point logs and taxi logs.

Sessions are gaps and islands over windows. The rule "far enough from the last point kept" depends on what was kept before,
so it runs per user over Arrow batches sorted by time; a user's log is read in a stream and never held whole.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewarden.functions.geo import EARTH_KM
from tracewarden.session import global_rank

_RING = "array<array<array<double>>>"
KEPT = "trajectory_id long, user_id long, ts long, seq long, lon double, lat double"


def read_geojson_tiles(spark: SparkSession, path: str) -> DataFrame:
    """tile_id (1, 2, .. in file order), polygons (array of polygons, each an array of rings of lon, lat)."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("at", "f"))
    one = F.from_json("f.geometry.coordinates", _RING)
    many = F.from_json("f.geometry.coordinates", f"array<{_RING}>")
    return raw.select((F.col("at") + 1).cast("long").alias("tile_id"), F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).otherwise(many).alias("polygons"))


def read_shapefile_tiles(spark: SparkSession, path: str) -> DataFrame:
    """As read_geojson_tiles, from the main file (.shp) of a polygon shapefile."""
    content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    rows, at, k = [], 100, 0
    while at < len(content):
        words = struct.unpack(">2i", content[at : at + 8])[1]
        body = content[at + 8 : at + 8 + 2 * words]
        k += 1
        if struct.unpack("<i", body[:4])[0] in (5, 15, 25):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            rings = [[[flat[2 * i], flat[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:])]
            rows.append((k, [rings]))
        at += 8 + 2 * words
    return spark.createDataFrame(rows, f"tile_id long, polygons array<{_RING}>")


def in_window(ts: Column, start: int, end: int) -> Column:
    """Strictly between two moments."""
    return (ts > start) & (ts < end)


def in_time_of_day(ts: Column, start: str, end: str) -> Column:
    """Between two times of day (HH:mm:ss), both included; a window whose start is later than its end wraps midnight."""
    a, b = (sum(int(x) * f for x, f in zip(t.split(":"), (3600, 60, 1))) for t in (start, end))
    second = F.pmod(ts, F.lit(86400))
    return second.between(a, b) if a < b else (second >= a) | (second <= b) if a > b else F.lit(False)


def occupied_trips(log: DataFrame, keep: Column, normalize_day: bool = False) -> DataFrame:
    """Trajectories of cab logs (user_id, seq, lat, lon, occupied, ts): runs of occupied rows inside the window.

    Numbers run by user and place in the log. normalize_day puts every location on 2022-01-01.
    """
    w = Window.partitionBy("user_id").orderBy("seq")
    on = (F.col("occupied") == 1) & keep
    runs = log.withColumn("on", on).withColumn("start", (F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int"))
    trips = runs.withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("on")
    numbers = global_rank(trips.select("user_id", "run").distinct(), "user_id", "run")
    ts = F.pmod("ts", F.lit(86400)) + 1640995200 if normalize_day else F.col("ts")
    return trips.join(numbers, ["user_id", "run"]).select((F.col("rank") + 1).alias("trajectory_id"), "user_id", ts.cast("long").alias("ts"), "seq", "lon", "lat")


def read_cab_logs(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, seq, lat, lon, occupied, ts of files new_*.txt; users are numbered by file name."""
    raw = spark.read.text(folder).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq"))
    users = global_rank(raw.select("file").distinct(), "file").select("file", (F.col("rank") + 1).alias("user_id"))
    part = F.split(F.trim("value"), r"\s+")
    return raw.filter(F.trim("value") != "").join(users, "file").select("user_id", "seq", part[0].cast("double").alias("lat"), part[1].cast("double").alias("lon"), part[2].cast("int").alias("occupied"), part[3].cast("long").alias("ts"))


def read_point_logs(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, log, ts, seq, lon, lat of .plt files: six header lines, then lat, lon, .., date, time; user from the path."""
    raw = spark.read.option("pathGlobFilter", "*.plt").option("recursiveFileLookup", True).text(folder)
    part = F.split("value", ",")
    file = F.input_file_name()
    rows = raw.filter(F.size(part) >= 7).select(F.regexp_extract(file, r"/(\d+)/[^/]+/[^/]+\.plt$", 1).cast("long").alias("user_id"), file.alias("log"), part.alias("p"), F.monotonically_increasing_id().alias("seq"))
    return rows.select("user_id", "log", F.unix_timestamp(F.concat_ws(" ", F.col("p")[5], F.col("p")[6]), "yyyy-MM-dd HH:mm:ss").alias("ts"), "seq", F.col("p")[1].cast("double").alias("lon"), F.col("p")[0].cast("double").alias("lat"))


def read_taxi_log(spark: SparkSession, path: str) -> DataFrame:
    """user_id, ts, seq, lon, lat of lines `user;datetime+zone;POINT(lat lon)`; the zone is dropped as written."""
    part = F.split("value", ";")
    point = F.split(F.regexp_extract(F.col("p")[2], r"POINT\((.*)\)", 1), " ")
    rows = spark.read.text(path).select(part.alias("p"), F.monotonically_increasing_id().alias("seq")).filter(F.size("p") >= 3)
    when = F.regexp_extract(F.col("p")[1], r"^([0-9-]+[ T][0-9:]+)", 1)
    return rows.select(F.col("p")[0].cast("long").alias("user_id"), F.unix_timestamp(F.translate(when, "T", " "), "yyyy-MM-dd HH:mm:ss").alias("ts"), "seq", point[1].cast("double").alias("lon"), point[0].cast("double").alias("lat"))


def thin(log: DataFrame, key: list[str], min_seconds: int, max_gap: int, min_meters: float = 0.0, gap_open: bool = True) -> DataFrame:
    """Points far enough from the last point kept, with the number of the session they belong to.

    gap_open: a gap of more than max_gap starts a session and its point is held to the time rule as any other;
    otherwise a gap of max_gap or more starts a session and its point is always kept.
    """
    import math

    names = [*key, "ts", "seq", "lon", "lat"]

    def meters(a, b) -> float:
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2000 * EARTH_KM * math.asin(math.sqrt(h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, last, session = None, None, 0
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                own, (ts, seq, lon, lat) = row[: len(key)], row[len(key) :]
                if own != who:
                    who, last, session = own, None, 0
                if last is None:
                    keep = True
                elif gap_open:
                    session += ts - last[0] > max_gap
                    keep = ts - last[0] >= min_seconds
                elif ts - last[0] >= max_gap:
                    session, keep = session + 1, True
                else:
                    keep = abs(ts - last[0]) >= min_seconds and meters(last[1:], (lon, lat)) >= min_meters
                if keep:
                    last = (ts, lon, lat)
                    out.append((*row, session))
            columns = list(zip(*out)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, itertools.chain(b.schema, [pa.field("session", pa.int64())]))], names=[*names, "session"])

    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "session long"])
    return log.select(*names).repartition(*key).sortWithinPartitions(*key, "ts", "seq").mapInArrow(run, schema)


def number_sessions(thinned: DataFrame, key: list[str], min_locations: int = 0) -> DataFrame:
    """Canonical locations; sessions of enough points are numbered by user and time."""
    w = Window.partitionBy(*key, "session")
    kept = thinned.withColumn("n", F.count("*").over(w)).filter(F.col("n") >= min_locations)
    ids = global_rank(kept.groupBy(*key, "session").agg(F.min("ts").alias("t")), *key, "t", "session").withColumn("trajectory_id", F.col("rank") + 1)
    return kept.join(ids.select(*key, "session", "trajectory_id"), [*key, "session"]).select("trajectory_id", F.col("user_id").cast("long").alias("user_id"), "ts", "seq", "lon", "lat")
