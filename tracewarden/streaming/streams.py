"""Structured Streaming forms: meetings in time windows, speed of hops, thinning by the last point kept, counts of cells.

Input: a streaming frame of user_id, time (timestamp), lon, lat. State is bounded by watermarks, or by one point a user.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewarden.functions.geo import haversine_km
from tracewarden.operators.mdav import km
from tracewarden.operators.swapmob import met_by_cell


def meetings(points: DataFrame, spatial_km: float = 0.2, seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """Pairs of users within the radius in the same tumbling window: window, a, b, km.

    A join of the stream with itself on window and grid cell; the left side looks into neighbouring cells.
    """
    span = F.window("time", f"{seconds} seconds")
    cells, probe = met_by_cell(points.withWatermark("time", late).withColumn("w", span), spatial_km)
    left = probe.select("w", "band", "cx", "cy", F.col("user_id").alias("a"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    right = cells.select("w", "band", "cx", "cy", F.col("user_id").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    met = left.join(right, ["w", "band", "cx", "cy"]).filter(F.col("a") < F.col("b")).withColumn("km", haversine_km("x1", "y1", "x2", "y2"))
    return met.filter(F.col("km") < spatial_km).select(F.col("w.start").alias("window_start"), "a", "b", "km")


def crowded_cells(points: DataFrame, min_k: int = 5, cell_deg: float = 0.005, span: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """window_start, cx, cy, n of cells with at least min_k locations in a window."""
    cell = lambda x: F.floor(F.col(x) / cell_deg).cast("long")
    counts = points.withWatermark("time", late).groupBy(F.window("time", span), cell("lon").alias("cx"), cell("lat").alias("cy")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_k).select(F.col("window.start").alias("window_start"), "cx", "cy", "n")


class Thinning(StatefulProcessor):
    """Keeps a point that is far enough in time and space from the last point kept; a long gap starts a session."""

    def __init__(self, min_seconds: int = 30, min_meters: float = 100, max_gap: int = 180):
        self.rule = (min_seconds, min_meters, max_gap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long, lon double, lat double, session long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        min_seconds, min_meters, max_gap = self.rule
        last, out = self.last.get() if self.last.exists() else None, []
        for part in rows:
            for r in part.sort_values("ts").itertuples():
                if last is None:
                    keep, number = True, 1
                elif r.ts - last[0] >= max_gap:
                    keep, number = True, last[3] + 1
                else:
                    keep, number = abs(r.ts - last[0]) >= min_seconds and 1000 * km(last[1], last[2], r.lon, r.lat) >= min_meters, last[3]
                if keep:
                    last = (int(r.ts), float(r.lon), float(r.lat), int(number))
                    out.append((key[0], *last))
        if last is not None:
            self.last.update(tuple(last))
        yield pd.DataFrame(out, columns=["user_id", "ts", "lon", "lat", "session"])

    def close(self) -> None:
        pass


def thin_stream(points: DataFrame, min_seconds: int = 30, min_meters: float = 100, max_gap: int = 180) -> DataFrame:
    """user_id, ts, lon, lat, session of the points kept. Needs the RocksDB state store."""
    keyed = points.select("user_id", F.unix_seconds("time").alias("ts"), "lon", "lat").groupBy("user_id")
    return keyed.transformWithStateInPandas(Thinning(min_seconds, min_meters, max_gap), "user_id long, ts long, lon double, lat double, session long", "Append", "None")
