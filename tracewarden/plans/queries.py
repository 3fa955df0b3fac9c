"""The query set over the event view of the tables, one for each operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import geo
from tracewarden.functions import trajectory as tr
from tracewarden.operators import aggregation, distance, filters, generalization, graph, measures, microaggregation, quadtree, sequences, stats, swaplocations, swapmob, tessellation
from tracewarden.sources import locations as src
from tracewarden.sources import raw, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BOX = (1.24, 41.105, 1.262, 41.125)
#: Metres of the tiles, levels of time in seconds, and the weight of time in distances.
TILE, LEVEL, WEIGHT = 500, 21600, 0.05


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_locations(spark, sf_dir, "day")


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_locations(spark, sf_dir, "user")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals that the last bits of libraries' sines don't matter. The view's own have seven."""
    picked = [n for n, k in df.dtypes if k == "double"]
    return df.select(*[F.round(c, digits).alias(c) if c in picked else F.col(c) for c in df.columns])


# --- SQL text

_VIEW = """user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, event_id AS seq,
 1.23e0 + (user_id % 10) * 0.004e0 + (event_id % 97) * 0.0001e0 + value * 0.00001e0 AS lon,
 41.10e0 + (user_id % 7) * 0.005e0 + (event_id % 89) * 0.0001e0 AS lat FROM events"""
DAY = f"loc AS (SELECT user_id * 100 + extract(day FROM ts) AS trajectory_id, {_VIEW})"
USER = f"loc AS (SELECT user_id AS trajectory_id, {_VIEW})"


def hav(x1: str, y1: str, x2: str, y2: str, radius: float = geo.EARTH_KM) -> str:
    a, b = f"radians({y1})", f"radians({y2})"
    return f"(2 * {radius}e0 * asin(sqrt(pow(sin(({b} - {a}) / 2), 2) + cos({a}) * cos({b}) * pow(sin((radians({x2}) - radians({x1})) / 2), 2))))"


def merc_x(x: str) -> str:
    return f"({geo.SPHERE_M}e0 * radians({x}))"


def merc_y(y: str) -> str:
    return f"({geo.SPHERE_M}e0 * ln(tan(pi() / 4 + radians({y}) / 2)))"


def hops(by: str = "trajectory_id", radius: float = geo.EARTH_KM) -> str:
    return f"""lagged AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py, lag(ts) OVER w AS pt FROM loc WINDOW w AS (PARTITION BY {by} ORDER BY ts, seq)),
hops AS (SELECT *, {hav('px', 'py', 'lon', 'lat', radius)} AS km, abs(ts - pt) AS s FROM lagged)"""


def grid(meters: float = TILE, of: str = "loc", name: str = "g") -> str:
    return f"""{name}0 AS (SELECT {merc_x('min(lon)')} AS x0, {merc_y('min(lat)')} AS y0, {merc_x('max(lon)')} AS x1, {merc_y('max(lat)')} AS y1 FROM {of}),
{name} AS (SELECT x0, y0, greatest(ceil((y1 - y0) / {meters}), 1)::BIGINT AS n_rows, greatest(ceil((x1 - x0) / {meters}), 1)::BIGINT AS n_cols, {float(meters)} AS meters FROM {name}0)"""


def tiled(meters: float = TILE, of: str = "loc", name: str = "tiled", g: str = "g") -> str:
    return f"""{name}_0 AS (SELECT l.*, g.*, greatest(least(floor(({merc_x('lon')} - x0) / {meters}), n_cols - 1), 0)::BIGINT AS tile_col,
 greatest(least(floor(({merc_y('lat')} - y0) / {meters}), n_rows - 1), 0)::BIGINT AS tile_row FROM {of} l, {g} g),
{name} AS (SELECT *, tile_col * n_rows + tile_row AS tile_id FROM {name}_0)"""


CENTRE = f"degrees((x0 + (tile_col + 0.5) * {TILE}) / {geo.SPHERE_M}e0) AS lon, degrees(2 * atan(exp((y0 + (tile_row + 0.5) * {TILE}) / {geo.SPHERE_M}e0)) - pi() / 2) AS lat"
SIMPLE = f"{DAY}, {grid()}, {tiled()}, simple AS (SELECT trajectory_id, user_id, ts, seq, {CENTRE} FROM tiled)"
SEQ = """stays AS (SELECT *, lag(tile_id) OVER (PARTITION BY trajectory_id ORDER BY ts, seq) AS before FROM tiled),
seqs AS (SELECT trajectory_id, list(tile_id ORDER BY ts, seq) AS tiles FROM stays WHERE before IS DISTINCT FROM tile_id GROUP BY trajectory_id)"""
VISITS = """firsts AS (SELECT trajectory_id, tile_id, min((ts, seq)) AS spot FROM {of} GROUP BY ALL),
visits AS (SELECT trajectory_id, list(tile_id ORDER BY spot) AS tiles FROM firsts GROUP BY trajectory_id)"""


def six(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


# --- sources and sinks


@query(f"WITH {DAY} SELECT trajectory_id, user_id, ts, seq, {six('lon', 'lat', digits=8)} FROM loc")
def locations_view(spark, sf_dir):
    return rounded(day(spark, sf_dir), 8)


@query(f"WITH {DAY} SELECT round(lon, 8) AS lon, round(lat, 8) AS lat, strftime(make_timestamp(ts * 1000000), '%Y/%m/%d %H:%M:%S') AS timestamp, trajectory_id, user_id FROM loc")
def csv_rows(spark, sf_dir):
    return rounded(sinks.csv_rows(day(spark, sf_dir)), 8)


@query(f"WITH {DAY} SELECT trajectory_id, user_id, ts, seq, round(lon, 8) AS lon, round(lat, 8) AS lat FROM loc")
def read_mapped_text(spark, sf_dir):
    """Columns under foreign names and times as text, read through the mapping."""
    named = day(spark, sf_dir).select(F.col("trajectory_id").alias("tid"), F.col("user_id").alias("uid"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss").alias("when"), F.col("lon").alias("x"), F.col("lat").alias("y"), "seq", F.lit("x").alias("extra"))
    return rounded(src.from_long(named, lat="y", lon="x", timestamp="when", user_id="uid", trajectory_id="tid", datetime_format="%Y-%m-%d %H:%M:%S", seq="seq"), 8)


@query(f"WITH {DAY}, shifted AS (SELECT * REPLACE (CASE WHEN seq % 500 = 0 THEN lat + 60 ELSE lat END AS lat) FROM loc), bad AS (SELECT trajectory_id FROM shifted WHERE NOT lat BETWEEN -90 AND 90) SELECT trajectory_id, count(*) AS n FROM shifted WHERE trajectory_id NOT IN (SELECT * FROM bad) GROUP BY 1")
def valid_coordinates(spark, sf_dir):
    shifted = day(spark, sf_dir).withColumn("lat", F.when(F.col("seq") % 500 == 0, F.col("lat") + 60).otherwise(F.col("lat")))
    return src.valid(shifted).groupBy("trajectory_id").agg(F.count("*").alias("n"))


@query(f"WITH {DAY} SELECT trajectory_id, ts, seq FROM loc WHERE trajectory_id IN (SELECT DISTINCT trajectory_id FROM loc ORDER BY 1 LIMIT 25)")
def first_trajectories(spark, sf_dir):
    """The loader's limit on the number of trajectories."""
    return src.first_trajectories(day(spark, sf_dir), 25).select("trajectory_id", "ts", "seq")


@query(f"WITH {DAY} SELECT trajectory_id, ts, seq FROM loc WHERE trajectory_id IN (SELECT trajectory_id FROM (SELECT DISTINCT trajectory_id FROM loc) ORDER BY md5(trajectory_id || ':7'), trajectory_id LIMIT 50)")
def sample_trajectories(spark, sf_dir):
    return src.sample_trajectories(day(spark, sf_dir), 50, seed=7).select("trajectory_id", "ts", "seq")


@query(
    """WITH ev AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, event_id AS seq, event_id % 3 > 0 AND (epoch_us(ts) // 1000000) % 86400 BETWEEN 21600 AND 79200 AS on_ FROM events),
st AS (SELECT *, on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY seq), false) AS st FROM ev),
r AS (SELECT *, sum(st::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM st),
m AS (SELECT user_id, max(run) AS runs FROM r WHERE on_ GROUP BY 1), o AS (SELECT user_id, coalesce(sum(runs) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM m)
SELECT (base + run)::BIGINT AS trajectory_id, user_id, ts, seq FROM r JOIN o USING (user_id) WHERE on_"""
)
def occupied_trips(spark, sf_dir):
    """Cab logs: runs of occupied points inside a window of the day."""
    log = user(spark, sf_dir).withColumn("occupied", (F.col("seq") % 3 > 0).cast("int"))
    return raw.occupied_trips(log, raw.in_time_of_day(F.col("ts"), "06:00:00", "22:00:00")).select("trajectory_id", "user_id", "ts", "seq")


def _thinned(rule: str, session: str) -> str:
    """Points kept and sessions of at least five, by a walk over each user's rows; rule and session are of r (the row) and w (the last kept)."""
    return f"""WITH RECURSIVE {USER}, r AS (SELECT user_id, ts, seq, lon, lat, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS i FROM loc),
w(user_id, i, ts, lon, lat, session, keep) AS (SELECT user_id, i, ts, lon, lat, 0::BIGINT, true FROM r WHERE i = 1 UNION ALL
 SELECT user_id, i, CASE WHEN keep THEN t ELSE ts END, CASE WHEN keep THEN x ELSE lon END, CASE WHEN keep THEN y ELSE lat END, session, keep FROM
 (SELECT w.user_id, r.i, w.ts, w.lon, w.lat, r.ts AS t, r.lon AS x, r.lat AS y, {session} AS session, {rule} AS keep FROM w JOIN r ON w.user_id = r.user_id AND r.i = w.i + 1)),
k AS (SELECT r.*, w.session, count(*) OVER (PARTITION BY w.user_id, w.session) AS n FROM w JOIN r USING (user_id, i) WHERE w.keep),
ids AS (SELECT user_id, session, row_number() OVER (ORDER BY user_id, min(ts), session) AS trajectory_id FROM k WHERE n >= 5 GROUP BY 1, 2)
SELECT trajectory_id, user_id, ts, seq, round(lon, 8) AS lon, round(lat, 8) AS lat FROM k JOIN ids USING (user_id, session) WHERE n >= 5"""


@query(_thinned(f"r.ts - w.ts >= 129600 OR (abs(r.ts - w.ts) >= 30 AND {hav('w.lon', 'w.lat', 'r.lon', 'r.lat')} * 1000 >= 100)", "w.session + (r.ts - w.ts >= 129600)::BIGINT"))
def thinned_taxi_log(spark, sf_dir):
    """Taxi logs: gaps split, points near the last kept point go; five points at least."""
    thin = raw.thin(user(spark, sf_dir).select("user_id", "ts", "seq", "lon", "lat"), ["user_id"], 30, 36 * 3600, 100, gap_open=False)
    return rounded(raw.number_sessions(thin, ["user_id"], 5), 8)


@query(_thinned("r.ts - w.ts >= 3600", "w.session + (r.ts - w.ts > 129600)::BIGINT"))
def thinned_point_log(spark, sf_dir):
    """Point logs: gaps split, points too soon after the last kept go; five points at least."""
    thin = raw.thin(user(spark, sf_dir).select("user_id", "ts", "seq", "lon", "lat"), ["user_id"], 3600, 36 * 3600)
    return rounded(raw.number_sessions(thin, ["user_id"], 5), 8)


# --- scalar functions


@query(f"WITH {USER}, o AS (SELECT a.trajectory_id, a.seq, a.lon AS x1, a.lat AS y1, a.ts AS t1, b.lon AS x2, b.lat AS y2, b.ts AS t2 FROM loc a JOIN (SELECT trajectory_id, arg_min((lon, lat, ts), (ts, seq)) AS f FROM loc GROUP BY 1) q USING (trajectory_id), LATERAL (SELECT q.f[1] AS lon, q.f[2] AS lat, q.f[3] AS ts) b) SELECT trajectory_id, seq, round({hav('x1', 'y1', 'x2', 'y2')}, 6) AS km, round(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)), 6) AS degrees, abs(t1 - t2) AS seconds, round(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2) + pow((t1 - t2)::DOUBLE, 2)), 3) AS mixed, round(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2) + pow(0.001e0 * (t1 - t2), 2)), 6) AS weighted FROM o")
def location_distances(spark, sf_dir):
    """Each location against its trajectory's first."""
    loc = user(spark, sf_dir)
    first = loc.groupBy("trajectory_id").agg(F.min(F.struct("ts", "seq", "lon", "lat")).alias("f")).select("trajectory_id", F.col("f.lon").alias("x2"), F.col("f.lat").alias("y2"), F.col("f.ts").alias("t2"))
    p = ("lon", "lat", "x2", "y2")
    return loc.join(first, "trajectory_id").select(
        "trajectory_id", "seq", F.round(geo.haversine_km(*p), 6).alias("km"), F.round(geo.euclidean(*p), 6).alias("degrees"), geo.seconds_between("ts", "t2").alias("seconds"),
        F.round(geo.space_time("lon", "lat", "ts", "x2", "y2", "t2"), 3).alias("mixed"), F.round(geo.space_time_weighted("lon", "lat", "ts", "x2", "y2", "t2", 0.001), 6).alias("weighted"),
    )


@query(f"WITH {USER} SELECT trajectory_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (ts BETWEEN 1704500000 AND 1705500000) AS in_interval, max(seq) FILTER (ts = 1705000000) AS at_seq, arg_max(seq, (ts, seq)) FILTER (ts < 1705000000) AS before_seq, arg_min(seq, (ts, seq)) FILTER (ts > 1705000000) AS after_seq, bool_or(NOT (lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]})) AS leaves_box FROM loc GROUP BY 1")
def trajectory_lookups(spark, sf_dir):
    """First and last moment, an interval, and the locations at, before and after a moment."""
    t = tr.nest(user(spark, sf_dir))
    return t.select(
        "trajectory_id", tr.first_ts().alias("first_ts"), tr.last_ts().alias("last_ts"), F.size(tr.within(1704500000, 1705500000)).cast("long").alias("in_interval"), tr.at(1705000000)["seq"].alias("at_seq"),
        tr.before(1705000000)["seq"].alias("before_seq"), tr.after(1705000000)["seq"].alias("after_seq"), tr.leaves(BOX).alias("leaves_box"),
    )


@query(f"WITH {USER} SELECT trajectory_id, trunc(avg(ts))::BIGINT AS ts, round_even(avg(lon), 5) AS lon, round_even(avg(lat), 5) AS lat FROM loc GROUP BY 1")
def location_centroids(spark, sf_dir):
    return tr.nest(user(spark, sf_dir)).select("trajectory_id", tr.centroid().alias("c")).select("trajectory_id", "c.ts", "c.lon", "c.lat")


@query(f"WITH {DAY}, {hops()} SELECT trajectory_id, user_id, count(*) AS n_locations, round(coalesce(sum(km), 0), 6) AS length_km FROM hops GROUP BY 1, 2")
def traj_length(spark, sf_dir):
    return rounded(tr.lengths(day(spark, sf_dir)))


@query(f"WITH {DAY}, {hops()} SELECT trajectory_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE sum(CASE WHEN s = 0 THEN 0 ELSE km / s END) / (count(*) - 1) * 3600 END, 6) AS avg_speed_kmh FROM hops GROUP BY 1")
def traj_avg_speed(spark, sf_dir):
    return rounded(tr.average_speeds(day(spark, sf_dir)))


@query(f"WITH {DAY} SELECT trajectory_id, {', '.join(f'round({f}({c}), 8) AS {f}_{c}' for f in ('min', 'max') for c in ('lon', 'lat'))} FROM loc GROUP BY 1")
def traj_bbox(spark, sf_dir):
    return rounded(stats.bounding_boxes(day(spark, sf_dir)), 8)


@query(f"WITH {DAY}, per AS (SELECT trajectory_id, count(*) AS n FROM loc GROUP BY 1) SELECT (SELECT count(*) FROM per) AS n_trajectories, count(*) AS n_locations, (SELECT max(n) FROM per) AS longest, min(ts) AS min_ts, max(ts) AS max_ts, round(min(lon), 5) AS min_lon, round(min(lat), 5) AS min_lat, round(max(lon), 5) AS max_lon, round(max(lat), 5) AS max_lat FROM loc")
def dataset_stats(spark, sf_dir):
    return stats.dataset_stats(day(spark, sf_dir))


@query(f"WITH {DAY}, {hops()}, v AS (SELECT trajectory_id, CASE WHEN count(*) < 2 THEN 0 ELSE sum(CASE WHEN s = 0 THEN 0 ELSE km / s END) / (count(*) - 1) * 3600 END AS v FROM hops GROUP BY 1) SELECT round(avg(v) / 3.6, 6) AS avg_speed_ms FROM v")
def dataset_speed(spark, sf_dir):
    return rounded(stats.average_speed_ms(day(spark, sf_dir)))


@query("SELECT n, trunc(1843.0270222222224e0 / (1 + 1843.0270222222224e0 / n))::BIGINT AS sample, CASE WHEN n < 100 THEN n ELSE trunc(n * (100 / (pow(10, floor(log10(n))) / 100)) / 100)::BIGINT END AS window FROM (SELECT unnest([50, 1000, 15000, 400000])::BIGINT AS n)")
def sample_sizes(spark, sf_dir):
    return spark.createDataFrame([(n, stats.sample_size(n), stats.window_size(n)) for n in (50, 1000, 15000, 400000)], "n long, sample long, window long")


# --- filters

_KEPT = "SELECT l.trajectory_id, count(*) AS n FROM loc l JOIN ok USING (trajectory_id) GROUP BY 1"


def _counts(df: DataFrame) -> DataFrame:
    return df.groupBy("trajectory_id").agg(F.count("*").alias("n"))


@query(f"WITH {DAY}, ok AS (SELECT trajectory_id FROM loc GROUP BY 1 HAVING count(*) >= 3) {_KEPT}")
def filter_n_locations(spark, sf_dir):
    return _counts(filters.by_n_locations(day(spark, sf_dir), 3))


@query(f"WITH {DAY}, {hops()}, ok AS (SELECT trajectory_id FROM hops GROUP BY 1 HAVING NOT coalesce(bool_or(s = 0 OR km / s * 3600 > 1.5), false)) {_KEPT}")
def filter_speed(spark, sf_dir):
    return _counts(filters.by_speed(day(spark, sf_dir), 1.5))


@query(f"WITH {DAY}, {hops()}, ok AS (SELECT trajectory_id FROM hops GROUP BY 1 HAVING coalesce(sum(km), 0) BETWEEN 0.5 AND 3) {_KEPT}")
def filter_length(spark, sf_dir):
    return _counts(filters.by_length(day(spark, sf_dir), 0.5, 3.0))


@query(f"WITH {DAY}, ok AS (SELECT trajectory_id FROM loc GROUP BY 1 HAVING bool_and(lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]})) {_KEPT}")
def filter_bbox(spark, sf_dir):
    return _counts(filters.by_bounding_box(day(spark, sf_dir), BOX))


@query(f"WITH {DAY}, {hops()}, few AS (SELECT trajectory_id FROM loc GROUP BY 1 HAVING count(*) >= 2), ok AS (SELECT trajectory_id FROM hops JOIN few USING (trajectory_id) GROUP BY 1 HAVING NOT coalesce(bool_or(s = 0 OR km / s * 3600 > 300), false)) {_KEPT}")
def filter_pipeline(spark, sf_dir):
    return _counts(filters.pipeline(day(spark, sf_dir), [{"min_locations": 2}, {"max_speed": 300}]))


# --- tessellation and generalization


@query(f"WITH {DAY}, {grid()} SELECT n_rows, n_cols FROM g")
def grid_shape(spark, sf_dir):
    return tessellation.grid(day(spark, sf_dir), TILE).select("n_rows", "n_cols")


@query(f"WITH {DAY}, {grid()}, {tiled()} SELECT trajectory_id, ts, seq, tile_id FROM tiled")
def tessellate_square(spark, sf_dir):
    return tessellation.square_tiles(day(spark, sf_dir), TILE).select("trajectory_id", "ts", "seq", "tile_id")


@query(f"WITH {DAY}, {grid()}, {tiled()} SELECT DISTINCT tile_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT tile_id, {CENTRE} FROM tiled)")
def tile_centroids(spark, sf_dir):
    t = tessellation.square_tiles(day(spark, sf_dir), TILE)
    return rounded(t.select("tile_id", tessellation.centre_lon().alias("lon"), tessellation.centre_lat().alias("lat"))).distinct()


@query(f"WITH {DAY}, t AS (SELECT *, greatest(ceil((ts - (SELECT min(ts) FROM loc)) / {LEVEL}.0) - 1, 0)::BIGINT AS time_level FROM loc) SELECT trajectory_id, seq, time_level, (SELECT min(ts) FROM loc) + time_level * {LEVEL} AS level_ts FROM t")
def time_tessellate(spark, sf_dir):
    return tessellation.time_levels(day(spark, sf_dir), LEVEL).select("trajectory_id", "seq", "time_level", "level_ts")


POLYGONS = [(1, 1.23, 41.10, 1.25, 41.12), (2, 1.25, 41.10, 1.27, 41.12), (3, 1.235, 41.12, 1.262, 41.135)]


@query(f"WITH {DAY}, p(tile_id, w, s, e, n) AS (VALUES {', '.join(str(x) for x in POLYGONS)}) SELECT trajectory_id, seq, tile_id::BIGINT AS tile_id FROM loc JOIN p ON lon > w AND lon < e AND lat > s AND lat < n")
def polygon_tiles(spark, sf_dir):
    rows = [(i, [[[[w, s], [e, s], [e, n], [w, n], [w, s]]]]) for i, w, s, e, n in POLYGONS]
    tiles = spark.createDataFrame(rows, "tile_id long, polygons array<array<array<array<double>>>>")
    return tessellation.polygon_tiles(day(spark, sf_dir), tiles).select("trajectory_id", "seq", "tile_id")


@query(f"WITH {SIMPLE} SELECT trajectory_id, user_id, ts, seq, {six('lon', 'lat')} FROM simple")
def simple_generalization_all(spark, sf_dir):
    return rounded(generalization.simple(day(spark, sf_dir), TILE))


@query(f"WITH {DAY}, {grid()}, {tiled()}, o AS (SELECT trajectory_id, user_id, trunc(avg(ts))::BIGINT AS ts, min(seq) AS seq, x0, y0, tile_col, tile_row FROM tiled GROUP BY trajectory_id, user_id, x0, y0, tile_col, tile_row) SELECT trajectory_id, user_id, ts, seq, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT trajectory_id, user_id, ts, seq, {CENTRE} FROM o)")
def simple_generalization_one(spark, sf_dir):
    return rounded(generalization.simple(day(spark, sf_dir), TILE, "one"))


@query()
def protected_generalization(spark, sf_dir):
    return generalization.protected(day(spark, sf_dir), TILE, k=3, knowledge=2)


@query()
def protected_generalization_time(spark, sf_dir):
    return generalization.protected(day(spark, sf_dir), 1000, k=3, knowledge=2, strategy="centroid", time_interval=720, time_strategy="same")


# --- sequences


@query(f"WITH {DAY}, {grid()}, {tiled()}, {SEQ} SELECT trajectory_id, array_to_string(tiles, '_') AS tiles FROM seqs")
def tile_sequences(spark, sf_dir):
    t = tessellation.square_tiles(day(spark, sf_dir), TILE)
    return sequences.tile_sequences(t).select("trajectory_id", F.array_join(F.col("tiles").cast("array<string>"), "_").alias("tiles"))


@query(f"WITH {DAY}, {grid()}, {tiled()}, {VISITS.format(of='tiled')} SELECT trajectory_id, array_to_string(tiles, '_') AS tiles FROM visits")
def tile_first_visits(spark, sf_dir):
    t = tessellation.square_tiles(day(spark, sf_dir), TILE)
    return sequences.tile_sequences(t, repeats=False).select("trajectory_id", F.array_join(F.col("tiles").cast("array<string>"), "_").alias("tiles"))


_PAIRS = """pos AS (SELECT trajectory_id, unnest(tiles) AS tile, generate_subscripts(tiles, 1) AS i FROM seqs WHERE len(tiles) > 1),
combos AS (SELECT DISTINCT a.trajectory_id, a.tile AS t1, b.tile AS t2 FROM pos a JOIN pos b ON a.trajectory_id = b.trajectory_id AND a.i < b.i),
support AS (SELECT t1, t2, count(*) AS n FROM combos GROUP BY 1, 2)"""


@query(f"WITH {DAY}, {grid()}, {tiled()}, {SEQ}, {_PAIRS} SELECT t1 || '_' || t2 AS combo, n FROM support")
def combination_support(spark, sf_dir):
    s = sequences.tile_sequences(tessellation.square_tiles(day(spark, sf_dir), TILE))
    return sequences.combination_support(s, 2).select(F.array_join(F.col("combo").cast("array<string>"), "_").alias("combo"), "n")


@query(f"WITH {DAY}, {grid()}, {tiled()}, {SEQ}, {_PAIRS} SELECT trajectory_id, count(*) FILTER (n < 3) AS n_bad, count(*) FILTER (n >= 3) AS n_good FROM combos JOIN support USING (t1, t2) GROUP BY 1")
def bad_combinations(spark, sf_dir):
    s = sequences.tile_sequences(tessellation.square_tiles(day(spark, sf_dir), TILE))
    return sequences.split_combinations(s, 3, 2).select("trajectory_id", F.size("bad").cast("long").alias("n_bad"), F.size("good").cast("long").alias("n_good"))


@query(f"WITH {DAY}, {grid()}, {tiled()}, {VISITS.format(of='tiled')}, pos AS (SELECT trajectory_id, unnest(tiles) AS tile, generate_subscripts(tiles, 1) AS i, len(tiles) AS n FROM visits), p AS (SELECT a.tile, b.tile AS next_tile FROM pos a LEFT JOIN pos b ON a.trajectory_id = b.trajectory_id AND b.i = a.i + 1 WHERE b.tile IS NOT NULL OR a.n = 1) SELECT tile, next_tile, count(*) AS n FROM p GROUP BY 1, 2")
def pair_support(spark, sf_dir):
    return sequences.pair_support(sequences.tile_sequences(tessellation.square_tiles(day(spark, sf_dir), TILE), repeats=False))


_DENSE = f"""{hops()}, far AS (SELECT *, floor(km * 1000 / 1000)::INT AS n FROM hops WHERE km * 1000 >= 1000),
steps AS (SELECT *, unnest(range(1, n + 1)) AS i FROM far),
dense AS (SELECT trajectory_id, user_id, ts, seq, lon, lat, false AS fake FROM loc UNION ALL
 SELECT trajectory_id, user_id, floor(pt + i / (n + 1)::DOUBLE * (ts - pt))::BIGINT, i - 1000000, (1 - i / (n + 1)::DOUBLE) * px + i / (n + 1)::DOUBLE * lon, (1 - i / (n + 1)::DOUBLE) * py + i / (n + 1)::DOUBLE * lat, true FROM steps)"""


@query(f"WITH {DAY}, {_DENSE} SELECT trajectory_id, user_id, ts, seq, {six('lon', 'lat', digits=8)}, fake FROM dense")
def densify_fake_locations(spark, sf_dir):
    return rounded(sequences.densify(day(spark, sf_dir), 1000), 8)


@query(
    f"""WITH {DAY}, {_DENSE}, {grid(1000, 'dense')}, {tiled(1000, 'dense', 'td')}, {tiled(1000, 'loc', 'tl')}, {VISITS.format(of='td')},
pos AS (SELECT trajectory_id, unnest(tiles) AS tile, generate_subscripts(tiles, 1) AS i, len(tiles) AS n FROM visits),
p AS (SELECT a.trajectory_id, a.tile, b.tile AS next_tile FROM pos a LEFT JOIN pos b ON a.trajectory_id = b.trajectory_id AND b.i = a.i + 1 WHERE b.tile IS NOT NULL OR a.n = 1),
c AS (SELECT tile, next_tile FROM p GROUP BY 1, 2 HAVING count(*) > 1),
k AS (SELECT p.trajectory_id, p.tile, p.next_tile FROM p JOIN c ON p.tile = c.tile AND p.next_tile IS NOT DISTINCT FROM c.next_tile),
keep AS (SELECT trajectory_id, tile FROM k UNION SELECT trajectory_id, next_tile FROM k)
SELECT trajectory_id, ts, seq FROM tl WHERE (trajectory_id, tile_id) IN (SELECT (trajectory_id, tile) FROM keep)"""
)
def suppress_rare_pairs(spark, sf_dir):
    return swaplocations.suppress_rare_pairs(day(spark, sf_dir), 1000).select("trajectory_id", "ts", "seq")


# --- swaps


@query(
    f"""WITH {DAY}, b AS (SELECT *, greatest(ceil((ts - (SELECT min(ts) FROM loc)) / 3600.0) - 1, 0)::BIGINT AS bucket FROM loc),
p AS (SELECT a.bucket, a.trajectory_id AS a, c.trajectory_id AS b, a.seq AS a_seq, c.seq AS b_seq, {hav('a.lon', 'a.lat', 'c.lon', 'c.lat')} AS km FROM b a JOIN b c ON a.bucket = c.bucket AND a.trajectory_id < c.trajectory_id)
SELECT bucket, a, b, a_seq, b_seq, round(km, 6) AS km FROM p WHERE km < 0.5"""
)
def swap_candidates(spark, sf_dir):
    return rounded(swapmob.candidates(day(spark, sf_dir), 0.5, 3600))


@query()
def swapmob_swaps(spark, sf_dir):
    return swapmob.swapmob(user(spark, sf_dir), 0.5, 3600, 1, seed=23)


@query()
def swap_all_locations(spark, sf_dir):
    return swaplocations.swap_all(user(spark, sf_dir), k=3, max_r_s=2000, max_r_t=3600, min_r_s=500, min_r_t=900, seed=42)


# --- quadtree

_FRAME = f"""q0 AS (SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM loc),
q AS (SELECT *, greatest(trunc(log2(least({hav('w', 's', 'e', 's')}, {hav('w', 's', 'w', 'n')}) * 1000 / 100)), 0)::INT AS top FROM q0),
pts AS (SELECT lon, lat, w, s, e, n, unnest(range(0, top + 1)) AS depth FROM loc, q),
placed AS (SELECT depth::INT AS depth, greatest(least(ceil((lon - w) / (e - w) * pow(2, depth)) - 1, pow(2, depth) - 1), 0)::BIGINT AS cx, greatest(least(ceil((lat - s) / (n - s) * pow(2, depth)) - 1, pow(2, depth) - 1), 0)::BIGINT AS cy FROM pts),
counts AS (SELECT depth, cx, cy, count(*) AS n FROM placed GROUP BY ALL),
cells AS (SELECT c.* FROM counts c LEFT JOIN counts p ON p.depth = c.depth - 1 AND p.cx = c.cx // 2 AND p.cy = c.cy // 2 WHERE c.depth = 0 OR p.n > 5)"""


@query(f"WITH {DAY}, {_FRAME} SELECT depth, cx, cy, n FROM cells")
def quadtree_cells(spark, sf_dir):
    return quadtree.cells(day(spark, sf_dir), 5).select("depth", "cx", "cy", "n")


_SECTORS = f"""{DAY}, {_FRAME}, kids AS (SELECT depth - 1 AS depth, cx // 2 AS cx, cy // 2 AS cy, min(n) AS least FROM cells GROUP BY ALL),
flagged AS (SELECT c.*, coalesce(k.least >= 5, false) AS splits FROM cells c LEFT JOIN kids k USING (depth, cx, cy)),
walk AS (SELECT depth, cx, cy, n, splits FROM flagged WHERE depth = 0 UNION ALL
 SELECT f.depth, f.cx, f.cy, f.n, f.splits FROM walk k JOIN flagged f ON k.splits AND f.depth = k.depth + 1 AND f.cx // 2 = k.cx AND f.cy // 2 = k.cy),
b AS (SELECT q.w + cx * ((q.e - q.w) / pow(2, depth)) AS min_lon, q.s + cy * ((q.n - q.s) / pow(2, depth)) AS min_lat, q.w + (cx + 1) * ((q.e - q.w) / pow(2, depth)) AS max_lon, q.s + (cy + 1) * ((q.n - q.s) / pow(2, depth)) AS max_lat, k.n AS n_locations FROM walk k, q WHERE NOT splits AND k.n >= 5)"""
_DENSITY = f"n_locations / (({merc_x('max_lon')} - {merc_x('min_lon')}) * ({merc_y('max_lat')} - {merc_y('min_lat')}))"


@query(
    f"""WITH RECURSIVE {_SECTORS}
SELECT {six('min_lon', 'min_lat', 'max_lon', 'max_lat')}, n_locations, round({_DENSITY}, 6) AS density FROM b"""
)
def quadtree_heatmap_nomerge(spark, sf_dir):
    return rounded(quadtree.heatmap(day(spark, sf_dir), 5, 100, merge_sectors=False))


@query()
def quadtree_heatmap_merge(spark, sf_dir):
    return rounded(quadtree.heatmap(day(spark, sf_dir), 5, 100))


@query(f"WITH RECURSIVE {_SECTORS} SELECT 'Feature' AS kind, 'Polygon' AS shape, n_locations, round({_DENSITY}, 6) AS density, 5::BIGINT AS corners, round(min_lon, 6) AS x0, round(min_lat, 6) AS y0, round(max_lon, 6) AS x2, round(max_lat, 6) AS y2, true AS closed FROM b")
def heatmap_geojson(spark, sf_dir):
    """The features, read back from their text."""
    text = sinks.geojson_features(quadtree.heatmap(day(spark, sf_dir), 5, 100, merge_sectors=False))
    schema = "type string, properties struct<n_locations: bigint, density: double>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    f = text.select(F.from_json("feature", schema).alias("f")).select("f.*").withColumn("ring", F.col("geometry.coordinates")[0])
    return f.select(
        F.col("type").alias("kind"), F.col("geometry.type").alias("shape"), F.col("properties.n_locations").alias("n_locations"), F.round("properties.density", 6).alias("density"), F.size("ring").cast("long").alias("corners"),
        F.round(F.col("ring")[0][0], 6).alias("x0"), F.round(F.col("ring")[0][1], 6).alias("y0"), F.round(F.col("ring")[2][0], 6).alias("x2"), F.round(F.col("ring")[2][1], 6).alias("y2"), (F.col("ring")[0] == F.col("ring")[4]).alias("closed"),
    )


# --- distances and clusters

_NEST = """nested AS (SELECT trajectory_id, user_id, list({'ts': ts, 'lon': lon, 'lat': lat} ORDER BY ts, seq) AS locs, count(*) AS n FROM loc GROUP BY 1, 2),
speeds AS (SELECT trajectory_id, CASE WHEN count(*) < 2 THEN 0 ELSE sum(CASE WHEN s = 0 THEN 0 ELSE km / s END) / (count(*) - 1) * 3600 END AS v FROM hops GROUP BY 1),
tra AS (SELECT * FROM nested JOIN speeds USING (trajectory_id))"""


def _pair_sums(pairs: str, name: str = "sums") -> str:
    """name(a, b, speed, h, dd, dt, tt) of pairs(a, b, la, lb, na, nb, va, vb)."""
    return f"""{name}_h AS (SELECT *, round_even((na + nb) / 2, 0)::INT AS h FROM {pairs}),
{name}_k AS (SELECT *, unnest(range(0, h)) AS k FROM {name}_h),
{name}_p AS (SELECT a, b, (va + vb) / 2 AS speed, h, la[least(round_even(k * (na / h::DOUBLE), 0)::INT, na - 1) + 1] AS p, lb[least(round_even(k * (nb / h::DOUBLE), 0)::INT, nb - 1) + 1] AS q FROM {name}_k),
{name}_d AS (SELECT a, b, speed, h, {hav('p.lon', 'p.lat', 'q.lon', 'q.lat')} AS d, abs(p.ts - q.ts)::DOUBLE AS t FROM {name}_p),
{name} AS (SELECT a, b, speed, h, sum(d * d) AS dd, sum(d * t) AS dt, sum(t * t) AS tt FROM {name}_d GROUP BY a, b, speed, h)"""


def _exact_sums(pairs: str, name: str = "sums") -> str:
    """As _pair_sums, with strides added step by step; needs WITH RECURSIVE."""
    return f"""{name}_h AS (SELECT *, round_even((na + nb) / 2, 0)::INT AS h FROM {pairs}), {name}_c AS (SELECT DISTINCT na, nb, h FROM {name}_h),
{name}_w(na, nb, h, k, x, y) AS (SELECT na, nb, h, 0, 0::DOUBLE, 0::DOUBLE FROM {name}_c UNION ALL SELECT na, nb, h, k + 1, x + na / h::DOUBLE, y + nb / h::DOUBLE FROM {name}_w WHERE k + 1 < h),
{name}_p AS (SELECT a, b, (va + vb) / 2 AS speed, h, la[least(round_even(x, 0)::INT, na - 1) + 1] AS p, lb[least(round_even(y, 0)::INT, nb - 1) + 1] AS q FROM {name}_h JOIN {name}_w USING (na, nb, h)),
{name}_d AS (SELECT a, b, speed, h, {hav('p.lon', 'p.lat', 'q.lon', 'q.lat')} AS d, abs(p.ts - q.ts)::DOUBLE AS t FROM {name}_p),
{name} AS (SELECT a, b, speed, h, sum(d * d) AS dd, sum(d * t) AS dt, sum(t * t) AS tt FROM {name}_d GROUP BY a, b, speed, h)"""


def _martinez(weight: str = f"{WEIGHT}e0") -> str:
    s = f"({weight} * speed / 3.6)"
    return f"sqrt((1e6 * dd + 2000 * {s} * dt + {s} * {s} * tt) / h)"


_PAIRS_OF_ALL = f"{USER}, {hops()}, {_NEST}, pairs AS (SELECT l.trajectory_id AS a, r.trajectory_id AS b, l.locs AS la, r.locs AS lb, l.n AS na, r.n AS nb, l.v AS va, r.v AS vb FROM tra l JOIN tra r ON l.trajectory_id < r.trajectory_id)"
_ALL_PAIRS = f"WITH {_PAIRS_OF_ALL}, {_pair_sums('pairs')}"


@query(f"{_ALL_PAIRS} SELECT a, b, round(sqrt(dd / h), 6) AS spatial_km, round(speed * sqrt(tt / h), 2) AS temporal, round({_martinez()}, 3) AS meters FROM sums")
def martinez_distance(spark, sf_dir):
    """All pairs of users' trajectories: space, time, and both."""
    p = distance.all_pairs(user(spark, sf_dir), exact=False)
    return p.select("a", "b", F.round(distance.spatial_km(), 6).alias("spatial_km"), F.round(distance.temporal(), 2).alias("temporal"), F.round(distance.martinez(WEIGHT), 3).alias("meters"))


@query(f"WITH RECURSIVE {_PAIRS_OF_ALL}, {_exact_sums('pairs')} SELECT a, b, round(sqrt(dd / h), 6) AS spatial_km, round(speed * sqrt(tt / h), 2) AS temporal, round({_martinez()}, 3) AS meters FROM sums")
def martinez_distance_exact(spark, sf_dir):
    """As martinez_distance, with strides added step by step."""
    p = distance.all_pairs(user(spark, sf_dir))
    return p.select("a", "b", F.round(distance.spatial_km(), 6).alias("spatial_km"), F.round(distance.temporal(), 2).alias("temporal"), F.round(distance.martinez(WEIGHT), 3).alias("meters"))


@query(f"WITH RECURSIVE {_PAIRS_OF_ALL}, {_exact_sums('pairs')} SELECT round(sum(sqrt(dd / h) * 1000) / sum(speed * sqrt(tt / h)), 9) AS p_lambda, round(max(sqrt(dd / h)) * 1000 + sum(sqrt(dd / h) * 1000) / sum(speed * sqrt(tt / h)) * max(speed * sqrt(tt / h)), 3) AS max_distance FROM sums")
def martinez_lambda_exact(spark, sf_dir):
    return distance.estimate_lambda(user(spark, sf_dir)).select(F.round("p_lambda", 9).alias("p_lambda"), F.round("max_distance", 3).alias("max_distance"))


@query(f"{_ALL_PAIRS} SELECT round(sum(sqrt(dd / h) * 1000) / sum(speed * sqrt(tt / h)), 9) AS p_lambda, round(max(sqrt(dd / h)) * 1000 + sum(sqrt(dd / h) * 1000) / sum(speed * sqrt(tt / h)) * max(speed * sqrt(tt / h)), 3) AS max_distance FROM sums")
def martinez_lambda(spark, sf_dir):
    return distance.estimate_lambda(user(spark, sf_dir), exact=False).select(F.round("p_lambda", 9).alias("p_lambda"), F.round("max_distance", 3).alias("max_distance"))


_SPEED = f"{hops()}, v AS (SELECT trajectory_id, CASE WHEN count(*) < 2 THEN 0 ELSE sum(CASE WHEN s = 0 THEN 0 ELSE km / s END) / (count(*) - 1) * 3600 END AS v FROM hops GROUP BY 1), x AS (SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n, min(ts) AS t0, max(ts) AS t1, (SELECT avg(v) / 3.6 FROM v) AS v FROM loc)"


@query(f"WITH {USER}, {_SPEED} SELECT round({hav('w', 's', 'e', 'n')} * 500 + (t1 - t0) / 2 * v * {WEIGHT}e0, 3) AS max_distance FROM x")
def martinez_max_distance(spark, sf_dir):
    return distance.max_distance_of(user(spark, sf_dir), WEIGHT).select(F.round("max_distance", 3).alias("max_distance"))


@query(f"WITH {USER}, {_SPEED} SELECT round({hav('w', 's', 'e', 'n')} * 1000 / ((t1 - t0) * v), 9) AS p_lambda FROM x")
def martinez_fast_lambda(spark, sf_dir):
    return distance.fast_lambda(user(spark, sf_dir)).select(F.round("p_lambda", 9).alias("p_lambda"))


@query(
    f"""WITH {USER}, {hops()}, {_NEST}, ref AS (SELECT [{{'ts': min(ts), 'lon': min(lon), 'lat': min(lat)}}] AS la FROM loc),
pairs AS (SELECT -1 AS a, trajectory_id AS b, la, locs AS lb, 1 AS na, n AS nb, 0.0 AS va, v AS vb FROM tra, ref), {_pair_sums('pairs')} SELECT b AS trajectory_id, round({_martinez()}, 3) AS to_reference FROM sums"""
)
def distance_to_reference(spark, sf_dir):
    loc = user(spark, sf_dir)
    d = distance.to_reference(loc, distance.reference_trajectory(loc), WEIGHT, exact=False)
    return d.select("trajectory_id", F.round("to_reference", 3).alias("to_reference"))


def _anonymized_sql() -> str:
    """anon(trajectory_id, ..): users' trajectories at the centres of their tiles."""
    return f"{grid()}, {tiled()}, anon AS (SELECT trajectory_id, user_id, ts, seq, {CENTRE} FROM tiled)"


_TWO = f"""{hops()}, {_NEST}, {_anonymized_sql()},
alag AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py, lag(ts) OVER w AS pt FROM anon WINDOW w AS (PARTITION BY trajectory_id ORDER BY ts, seq)),
ahops AS (SELECT *, {hav('px', 'py', 'lon', 'lat')} AS km, abs(ts - pt) AS s FROM alag),
atra AS (SELECT * FROM (SELECT trajectory_id, list({{'ts': ts, 'lon': lon, 'lat': lat}} ORDER BY ts, seq) AS locs, count(*) AS n FROM anon GROUP BY 1) JOIN (SELECT trajectory_id, CASE WHEN count(*) < 2 THEN 0 ELSE sum(CASE WHEN s = 0 THEN 0 ELSE km / s END) / (count(*) - 1) * 3600 END AS v FROM ahops GROUP BY 1) USING (trajectory_id))"""


@query(f"WITH {USER}, {_TWO}, pairs AS (SELECT l.trajectory_id AS a, r.trajectory_id AS b, l.locs AS la, r.locs AS lb, l.n AS na, r.n AS nb, l.v AS va, r.v AS vb FROM tra l JOIN atra r ON l.trajectory_id = r.trajectory_id), {_pair_sums('pairs')} SELECT round(sqrt(sum(pow({_martinez()}, 2)) / (SELECT count(*) FROM atra)), 3) AS rsme FROM sums")
def rsme(spark, sf_dir):
    loc = user(spark, sf_dir)
    return measures.rsme(loc, generalization.simple(loc, TILE), WEIGHT, exact=False).select(F.round("rsme", 3).alias("rsme"))


@query(f"WITH RECURSIVE {USER}, {_TWO}, pairs AS (SELECT l.trajectory_id AS a, r.trajectory_id AS b, l.locs AS la, r.locs AS lb, l.n AS na, r.n AS nb, l.v AS va, r.v AS vb FROM tra l JOIN atra r ON l.trajectory_id = r.trajectory_id), {_exact_sums('pairs')} SELECT round(sqrt(sum(pow({_martinez()}, 2)) / (SELECT count(*) FROM atra)), 3) AS rsme FROM sums")
def rsme_exact(spark, sf_dir):
    loc = user(spark, sf_dir)
    return measures.rsme(loc, generalization.simple(loc, TILE), WEIGHT).select(F.round("rsme", 3).alias("rsme"))


@query(
    f"""WITH {USER}, {_TWO}, pairs AS (SELECT l.trajectory_id AS a, r.trajectory_id AS b, l.locs AS la, r.locs AS lb, l.n AS na, r.n AS nb, l.v AS va, r.v AS vb FROM tra l, atra r), {_pair_sums('pairs')},
best AS (SELECT b, arg_min(a, ({_martinez()}, a)) AS a FROM sums GROUP BY b) SELECT round(100.0 * count(*) FILTER (a = b) / (SELECT count(*) FROM tra), 2) AS percen_record_linkage FROM best"""
)
def record_linkage(spark, sf_dir):
    """All pairs; users' trajectories all differ, so each found again counts fully."""
    loc = user(spark, sf_dir)
    return measures.record_linkage(loc, generalization.simple(loc, TILE), WEIGHT, exhaustive=True, exact=False)


def _reference(tra: str, name: str) -> str:
    """name(id, locs, n, v, r): trajectories with their distance to the originals' reference."""
    return f"""{name}_q AS (SELECT -1 AS a, trajectory_id AS b, la, locs AS lb, 1::BIGINT AS na, n AS nb, 0::DOUBLE AS va, v AS vb FROM {tra}, ref), {_exact_sums(f'{name}_q', f'{name}_s')},
{name} AS (SELECT trajectory_id AS id, locs, n, v, {_martinez()} AS r FROM {tra} JOIN {name}_s ON b = trajectory_id)"""


@query(
    f"""WITH RECURSIVE {USER}, {_TWO}, ref AS (SELECT [{{'ts': min(ts), 'lon': min(lon), 'lat': min(lat)}}] AS la FROM loc), {_reference('tra', 'o')}, {_reference('atra', 'an')},
size AS (SELECT count(*) AS n, trunc(count(*) * 20 / 100)::BIGINT AS band FROM o), orank AS (SELECT *, row_number() OVER (ORDER BY r, id) - 1 AS rank FROM o),
spot AS (SELECT an.id, an.r, max(rank) FILTER (k.r < an.r) AS low, max(k.r) FILTER (k.r < an.r) AS low_r, min(rank) FILTER (k.r >= an.r) AS high, min(k.r) FILTER (k.r >= an.r) AS high_r FROM an, orank k GROUP BY an.id, an.r),
pos AS (SELECT id, CASE WHEN low IS NULL THEN high WHEN high IS NULL THEN low + 1 WHEN high_r - r < r - low_r THEN high ELSE low END AS pos FROM spot),
span AS (SELECT id, size.n, pos - band // 2 + (band % 2 = 0)::INT AS s, pos + band // 2 AS e FROM pos, size),
wide AS (SELECT id, greatest(greatest(s, 0) - greatest(e - (n - 1), 0), 0) AS s, least(least(e, n - 1) + greatest(-s, 0), n - 1) AS e FROM span),
pairs AS (SELECT k.id AS a, w.id AS b, k.locs AS la, an.locs AS lb, k.n AS na, an.n AS nb, k.v AS va, an.v AS vb FROM wide w JOIN orank k ON k.rank BETWEEN w.s AND w.e JOIN an ON an.id = w.id), {_exact_sums('pairs')},
best AS (SELECT b, arg_min(a, ({_martinez()}, a)) AS a FROM sums GROUP BY b) SELECT round(100.0 * count(*) FILTER (a = b) / (SELECT count(*) FROM tra), 2) AS percen_record_linkage FROM best"""
)
def record_linkage_window(spark, sf_dir):
    loc = user(spark, sf_dir)
    return measures.record_linkage(loc, generalization.simple(loc, TILE), WEIGHT, percen_window_size=20)


_CLUSTERS = "members AS (SELECT user_id % 10 AS cluster_id, trajectory_id, locs, n FROM tra)"
_MEAN = f"""{_CLUSTERS}, steps AS (SELECT *, round_even(avg(n) OVER (PARTITION BY cluster_id), 0)::INT AS m FROM members),
strides AS (SELECT *, round_even(n / m::DOUBLE, 2) AS stride, unnest(range(0, m)) AS i FROM steps),
picked AS (SELECT cluster_id, i, locs[least(floor(i * stride + 1e-9)::INT, n - 1) + 1] AS l FROM strides),
means AS (SELECT cluster_id, i, trunc(avg(l.ts))::BIGINT AS ts, avg(l.lon) AS lon, avg(l.lat) AS lat FROM picked GROUP BY 1, 2)"""


_MEAN_EXACT = f"""{_CLUSTERS}, steps AS (SELECT *, round_even(avg(n) OVER (PARTITION BY cluster_id), 0)::INT AS m FROM members),
strides AS (SELECT *, round_even(n / m::DOUBLE, 2) AS stride FROM steps), ways AS (SELECT DISTINCT m, stride FROM strides),
way(m, stride, i, x) AS (SELECT m, stride, 0, 0::DOUBLE FROM ways UNION ALL SELECT m, stride, i + 1, x + stride FROM way WHERE i + 1 < m),
picked AS (SELECT cluster_id, i, locs[least(floor(x)::INT, n - 1) + 1] AS l FROM strides JOIN way USING (m, stride)),
means AS (SELECT cluster_id, i, trunc(avg(l.ts))::BIGINT AS ts, round_even(avg(l.lon), 5) AS lon, round_even(avg(l.lat), 5) AS lat FROM picked GROUP BY 1, 2)"""


def _members(spark, sf_dir) -> DataFrame:
    return tr.nest(user(spark, sf_dir)).withColumn("cluster_id", F.col("user_id") % 10)


@query(f"WITH {USER}, {hops()}, {_NEST}, {_MEAN} SELECT cluster_id, i::INT AS i, ts, round_even(lon, 5) AS lon, round_even(lat, 5) AS lat FROM means")
def mean_trajectory(spark, sf_dir):
    return aggregation.mean_points(_members(spark, sf_dir), exact=False)


@query(f"WITH RECURSIVE {USER}, {hops()}, {_NEST}, {_MEAN_EXACT} SELECT cluster_id, i::INT AS i, ts, lon, lat FROM means")
def mean_trajectory_exact(spark, sf_dir):
    """As mean_trajectory, with strides added step by step."""
    return aggregation.mean_points(_members(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {USER}, {hops()}, {_NEST}, {_MEAN_EXACT}, places AS (SELECT cluster_id, trajectory_id, unnest(locs) AS l, generate_subscripts(locs, 1) AS nth FROM members),
near AS (SELECT cluster_id, i, arg_min(l, (sqrt(pow(lon - l.lon, 2) + pow(lat - l.lat, 2) + pow(0.001e0 * (ts - l.ts), 2)), trajectory_id, nth)) AS l FROM means JOIN places USING (cluster_id) GROUP BY 1, 2)
SELECT cluster_id AS trajectory_id, cluster_id AS user_id, l.ts AS ts, i::BIGINT AS seq, round(l.lon, 8) AS lon, round(l.lat, 8) AS lat FROM near"""
)
def closest_locations_to_mean(spark, sf_dir):
    return rounded(tr.unnest(aggregation.closest_locations(_members(spark, sf_dir), 0.001).select(F.col("cluster_id").alias("trajectory_id"), F.col("cluster_id").alias("user_id"), "locs")), 8)


@query(
    f"""WITH RECURSIVE {USER}, {hops()}, {_NEST}, {_MEAN_EXACT}, mlag AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py, lag(ts) OVER w AS pt FROM means WINDOW w AS (PARTITION BY cluster_id ORDER BY ts, i)),
mhops AS (SELECT *, {hav('px', 'py', 'lon', 'lat')} AS km, abs(ts - pt) AS s FROM mlag),
mtra AS (SELECT cluster_id, list({{'ts': ts, 'lon': lon, 'lat': lat}} ORDER BY ts, i) AS locs, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE sum(CASE WHEN s = 0 THEN 0 ELSE km / s END) / (count(*) - 1) * 3600 END AS v FROM mhops GROUP BY 1),
pairs AS (SELECT cluster_id AS a, trajectory_id AS b, q.locs AS la, t.locs AS lb, q.n AS na, t.n AS nb, q.v AS va, t.v AS vb FROM mtra q JOIN tra t ON t.user_id % 10 = cluster_id), {_exact_sums('pairs')},
best AS (SELECT a, arg_min(b, ({_martinez()}, b)) AS b FROM sums GROUP BY a) SELECT a AS trajectory_id, a AS user_id, ts, seq, round(lon, 8) AS lon, round(lat, 8) AS lat FROM best JOIN loc ON trajectory_id = b"""
)
def closest_trajectory_to_mean(spark, sf_dir):
    return rounded(tr.unnest(aggregation.closest_trajectories(_members(spark, sf_dir), WEIGHT).select(F.col("cluster_id").alias("trajectory_id"), F.col("cluster_id").alias("user_id"), "locs")), 8)


@query()
def mdav_clusters(spark, sf_dir):
    from tracewarden.operators.mdav import cluster_groups

    return cluster_groups(tr.nest(user(spark, sf_dir)), 3, WEIGHT).select("trajectory_id", "cluster_id")


@query(
    f"""WITH RECURSIVE {DAY}, t AS (SELECT trajectory_id, min(ts) AS ts FROM loc GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY ts, trajectory_id) AS r, count(*) OVER () AS n, count(*) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 900 FOLLOWING) AS near FROM t),
ends AS (SELECT r, n, greatest(least(near, n - 1), r + 2) AS e FROM r), walk(part, s, e, n) AS (SELECT 0::BIGINT, r, e, n FROM ends WHERE r = 1 UNION ALL SELECT part + 1, ends.r, ends.e, walk.n FROM walk JOIN ends ON ends.r = walk.e + 1 WHERE walk.n - walk.e >= 3)
SELECT trajectory_id, max(part) AS part FROM r JOIN walk ON walk.s <= r.r GROUP BY 1"""
)
def start_time_parts(spark, sf_dir):
    from tracewarden.operators.mdav import start_parts

    return start_parts(tr.nest(day(spark, sf_dir)), 3, 900)


@query()
def microaggregation_mean(spark, sf_dir):
    return microaggregation.microaggregate(user(spark, sf_dir), 3, WEIGHT)


@query()
def microaggregation_by_start(spark, sf_dir):
    return microaggregation.microaggregate_by_start(day(spark, sf_dir), 3, 3600, WEIGHT)


# --- measures


@query(f"WITH {DAY}, few AS (SELECT trajectory_id FROM loc GROUP BY 1 HAVING count(*) >= 2), kept AS (SELECT * FROM loc WHERE trajectory_id IN (SELECT * FROM few)) SELECT round(((SELECT count(DISTINCT trajectory_id) FROM loc) - count(DISTINCT trajectory_id)) * 100.0 / (SELECT count(DISTINCT trajectory_id) FROM loc), 2) AS trajectories_removed, round(((SELECT count(*) FROM loc) - count(*)) * 100.0 / (SELECT count(*) FROM loc), 2) AS locations_removed FROM kept")
def trajectories_removed(spark, sf_dir):
    loc = day(spark, sf_dir)
    return measures.trajectories_removed(loc, filters.at_least_two(loc))


@query(f"WITH {DAY}, {grid(250)}, {tiled(250)} SELECT tile_id, count(*) AS visits, count(DISTINCT user_id) AS users FROM tiled GROUP BY 1")
def tile_visits(spark, sf_dir):
    return measures.tile_visits(tessellation.square_tiles(day(spark, sf_dir), 250))


@query(f"WITH {DAY}, {grid(250)}, {tiled(250)} SELECT tile_id, round(log2(count(DISTINCT user_id)), 6) AS entropy FROM tiled GROUP BY 1")
def random_location_entropy(spark, sf_dir):
    return rounded(measures.random_entropy(tessellation.square_tiles(day(spark, sf_dir), 250)))


@query(f"WITH {DAY}, {grid(250)}, {tiled(250)}, n AS (SELECT tile_id, user_id, count(*) AS n FROM tiled GROUP BY 1, 2), p AS (SELECT tile_id, n / sum(n) OVER (PARTITION BY tile_id) AS p FROM n) SELECT tile_id, round(sum(-p * ln(p)), 6) + 0 AS entropy FROM p GROUP BY 1")
def uncorrelated_location_entropy(spark, sf_dir):
    return measures.uncorrelated_entropy(tessellation.square_tiles(day(spark, sf_dir), 250)).select("tile_id", (F.round("entropy", 6) + 0).alias("entropy"))


@query(f"WITH {DAY}, {hops('user_id', geo.EARTH_KM_ROUND)} SELECT user_id, round(coalesce(sum(km), 0), 6) AS distance_km FROM hops GROUP BY 1")
def distance_straight_line(spark, sf_dir):
    return rounded(measures.straight_line(day(spark, sf_dir)))


_MSD = f"near AS (SELECT * FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0 FROM loc) WHERE ts <= t0 + 86400), ends AS (SELECT user_id, arg_min((lon, lat), (ts, seq)) AS a, arg_max((lon, lat), (ts, seq)) AS b FROM near GROUP BY 1)"


@query(f"WITH {DAY}, {_MSD} SELECT user_id, round(pow({hav('a[1]', 'a[2]', 'b[1]', 'b[2]', geo.EARTH_KM_ROUND)}, 2), 6) AS km2 FROM ends")
def mean_square_displacement(spark, sf_dir):
    return rounded(measures.square_displacement(day(spark, sf_dir), 86400))


def _five(of: str, tiles: str, name: str) -> str:
    """The five averages of locations and their tiles, by name."""
    return f"""{name}_t AS (SELECT tile_id, count(*) AS visits, count(DISTINCT user_id) AS users FROM {tiles} GROUP BY 1), {name}_n AS (SELECT tile_id, user_id, count(*) AS n FROM {tiles} GROUP BY 1, 2),
{name}_p AS (SELECT tile_id, n / sum(n) OVER (PARTITION BY tile_id) AS p FROM {name}_n), {name}_e AS (SELECT tile_id, sum(-p * ln(p)) AS e FROM {name}_p GROUP BY 1),
{name}_l AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py, min(ts) OVER (PARTITION BY user_id) AS t0 FROM {of} WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)),
{name}_d AS (SELECT user_id, coalesce(sum({hav('px', 'py', 'lon', 'lat', geo.EARTH_KM_ROUND)}), 0) AS km FROM {name}_l GROUP BY 1),
{name}_m AS (SELECT user_id, arg_min((lon, lat), (ts, seq)) AS a, arg_max((lon, lat), (ts, seq)) AS b FROM {name}_l WHERE ts <= t0 + 3600 GROUP BY 1),
{name} AS (SELECT round((SELECT avg(visits) FROM {name}_t), 4) AS visits_per_location_{name}, round((SELECT avg(km) FROM {name}_d), 4) AS distance_straight_line_{name}, round((SELECT avg(e) FROM {name}_e), 4) AS uncorrelated_location_entropy_{name},
 round((SELECT avg(log2(users)) FROM {name}_t), 4) AS random_location_entropy_{name}, round((SELECT avg(pow({hav('a[1]', 'a[2]', 'b[1]', 'b[2]', geo.EARTH_KM_ROUND)}, 2)) FROM {name}_m), 4) AS mean_square_displacement_{name})"""


@query(
    f"""WITH {SIMPLE}, {grid(250, 'loc', 'h')}, {tiled(250, 'loc', 'lt', 'h')}, inside AS (SELECT s.* FROM simple s, h WHERE {merc_x('lon')} BETWEEN x0 AND x0 + 250 * n_cols AND {merc_y('lat')} BETWEEN y0 AND y0 + 250 * n_rows),
{tiled(250, 'inside', 'st', 'h')}, {_five('loc', 'lt', 'original')}, {_five('simple', 'st', 'anonymized')} SELECT * FROM original, anonymized"""
)
def location_measures(spark, sf_dir):
    loc = day(spark, sf_dir)
    return measures.location_measures(loc, generalization.simple(loc, TILE))


@query(f"WITH {SIMPLE}, o AS (SELECT user_id, count(*) AS original FROM loc GROUP BY 1), n AS (SELECT user_id, count(DISTINCT lon) AS anonymized FROM simple GROUP BY 1) SELECT user_id, original, anonymized FROM o JOIN n USING (user_id)")
def measure_report(spark, sf_dir):
    loc = day(spark, sf_dir)
    left = loc.groupBy("user_id").agg(F.count("*").alias("v"))
    return measures.report(left, generalization.simple(loc, TILE).groupBy("user_id").agg(F.countDistinct("lon").alias("v")), "user_id", "v")


@query(f"WITH {DAY}, {grid(1000)}, {tiled(1000)}, s AS (SELECT trajectory_id, ts, seq, tile_id / greatest(n_rows * n_cols - 1, 1) AS tile_id FROM tiled), {VISITS.format(of='s')} SELECT trajectory_id, round(list_sum(tiles), 6) AS total, len(tiles) AS n FROM visits")
def propensity_features(spark, sf_dir):
    loc = day(spark, sf_dir)
    f = measures.sequence_features(loc, tessellation.grid(loc, 1000), 1000)
    return f.select("trajectory_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("features").cast("long").alias("n"))


@query()
def propensity_score(spark, sf_dir):
    loc = day(spark, sf_dir)
    return measures.propensity_score(loc, generalization.simple(loc, TILE), 200, seed=20)


# --- graph distance

_SPANS = "spans AS (SELECT trajectory_id, min(ts) AS t0, max(ts) AS t1 FROM loc GROUP BY 1)"
_SHARES = """shares AS (SELECT l.trajectory_id AS a, r.trajectory_id AS b, greatest(l.t0, r.t0) AS start, least(l.t1, r.t1) AS end_,
 coalesce(100 * least((least(l.t1, r.t1) - greatest(l.t0, r.t0)) / nullif(l.t1 - l.t0, 0)::DOUBLE, (least(l.t1, r.t1) - greatest(l.t0, r.t0)) / nullif(r.t1 - r.t0, 0)::DOUBLE), 0) AS p
 FROM spans l JOIN spans r ON l.trajectory_id < r.trajectory_id AND l.t0 <= r.t1 AND r.t0 <= l.t1)"""


@query(f"WITH {DAY}, {_SPANS}, {_SHARES} SELECT a, b, start AS overlap_start, end_ AS overlap_end, round_even(p, 2) AS p FROM shares")
def overlap_p_contemporary(spark, sf_dir):
    return graph.contemporaries(day(spark, sf_dir)).select("a", "b", F.col("start").alias("overlap_start"), F.col("end").alias("overlap_end"), "p")


_SYNC = f"""{DAY}, {_SPANS}, once AS (SELECT trajectory_id, ts, arg_min(lon, seq) AS lon, arg_min(lat, seq) AS lat FROM loc GROUP BY 1, 2),
asked AS (SELECT trajectory_id, m.ts FROM spans JOIN (SELECT DISTINCT ts FROM loc) m ON m.ts BETWEEN t0 AND t1),
b AS (SELECT a.trajectory_id, a.ts, o.lon, o.lat, CASE WHEN o.lon IS NOT NULL THEN a.ts END AS own FROM asked a LEFT JOIN once o USING (trajectory_id, ts)),
f AS (SELECT *, last_value(own IGNORE NULLS) OVER p AS t0, last_value(lon IGNORE NULLS) OVER p AS x0, last_value(lat IGNORE NULLS) OVER p AS y0, first_value(own IGNORE NULLS) OVER n AS t1, first_value(lon IGNORE NULLS) OVER n AS x1, first_value(lat IGNORE NULLS) OVER n AS y1 FROM b
 WINDOW p AS (PARTITION BY trajectory_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY trajectory_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_AT = "coalesce({0}, round_even((1 - (ts - t0) / nullif(t1 - t0, 0)::DOUBLE) * {1}0 + (ts - t0) / nullif(t1 - t0, 0)::DOUBLE * {1}1, 6))"


@query(f"WITH {_SYNC} SELECT trajectory_id, ts, round({_AT.format('lon', 'x')}, 8) AS lon, round({_AT.format('lat', 'y')}, 8) AS lat FROM f")
def synchronize_trajectories(spark, sf_dir):
    return rounded(graph.synchronized(day(spark, sf_dir)), 8)


@query(
    f"""WITH RECURSIVE {DAY}, {_SPANS}, {_SHARES}, e AS (SELECT a, b FROM shares WHERE round(p, 2) > 0), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk(node, low) AS (SELECT trajectory_id, trajectory_id FROM spans UNION SELECT b, low FROM walk JOIN both_ ON node = a AND low < b)
SELECT node, min(low) AS component FROM walk GROUP BY 1"""
)
def connected_components(spark, sf_dir):
    return graph.overlap_components(day(spark, sf_dir), ties=True)


@query(
    f"""WITH {_SYNC}, s AS (SELECT trajectory_id, ts, {_AT.format('lon', 'x')} AS lon, {_AT.format('lat', 'y')} AS lat FROM f), {_SHARES}, e AS (SELECT a, b, start, end_, round_even(p, 2) AS p FROM shares WHERE round_even(p, 2) > 0)
SELECT a, b, round(sqrt(sum((pow(l.lon - r.lon, 2) + pow(l.lat - r.lat, 2)) / pow(end_ - start, 2))) / p, 6) AS weight FROM e JOIN s l ON l.trajectory_id = a AND l.ts BETWEEN start AND end_ JOIN s r ON r.trajectory_id = b AND r.ts = l.ts GROUP BY a, b, p"""
)
def graph_edges(spark, sf_dir):
    return rounded(graph.edges(day(spark, sf_dir)))


@query()
def swap_in_clusters(spark, sf_dir):
    return graph.swap_in_clusters(user(spark, sf_dir), 3, 3600, 2.0, WEIGHT, seed=3)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the generalized dataset with visits, users and entropy."""
    tiled_ = tessellation.square_tiles(generalization.simple(day(spark, sf_dir), TILE), TILE)
    return rounded(measures.tile_visits(tiled_).join(measures.uncorrelated_entropy(tiled_), "tile_id"))
