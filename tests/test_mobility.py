"""Invariants and hand-made cases of the operators that SQL can't check."""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.functions import trajectory as tr
from tracewarden.operators import distance, filters, generalization, graph, mdav, measures, microaggregation, quadtree, sequences, swaplocations, swapmob, tessellation
from tracewarden.plans import registry
from tracewarden.sources import locations as src
from tracewarden.sources import raw, sinks

SCHEMA = "trajectory_id long, user_id long, ts long, seq long, lon double, lat double"


def walk(spark, seed=0, n=12, steps=8):
    """Trajectories that start near one another and drift."""
    rng = np.random.default_rng(seed)
    rows, seq = [], 0
    for t in range(n):
        ts, x, y = 1_700_000_000 + int(rng.integers(600)), 1.25 + rng.normal(0, 0.004), 41.12 + rng.normal(0, 0.004)
        for _ in range(steps):
            rows.append((t, t + 100, ts, seq, float(x), float(y)))
            seq += 1
            ts += int(rng.integers(20, 90))
            x, y = x + rng.normal(0, 0.001), y + rng.normal(0, 0.001)
    return spark.createDataFrame(rows, SCHEMA)


def python_distance(a, b, weight):
    """The definition, word for word."""
    s = (mdav.average_speed(a) + mdav.average_speed(b)) / 2 / 3.6
    h = round((len(a) + len(b)) / 2)
    x = y = total = 0.0
    i = j = 0
    for _ in range(h):
        p, q = a[min(i, len(a) - 1)], b[min(j, len(b) - 1)]
        total += (mdav.km(p[1], p[2], q[1], q[2]) * 1000 + weight * abs(p[0] - q[0]) * s) ** 2
        x, y = x + len(a) / h, y + len(b) / h
        i, j = round(x), round(y)
    return (total / h) ** 0.5


def arrays(df):
    return {r["trajectory_id"]: np.array([(p["ts"], p["lon"], p["lat"]) for p in r["locs"]], float) for r in tr.nest(df).collect()}


def test_distance_matches_definition(spark):
    loc = walk(spark, steps=7).unionByName(walk(spark, 1, 4, 12).withColumn("trajectory_id", F.col("trajectory_id") + 50))
    locs = arrays(loc)
    rows = distance.all_pairs(loc).select("a", "b", distance.martinez(0.3).alias("d")).collect()
    assert len(rows) == 16 * 15 // 2
    for r in rows:
        assert r["d"] == pytest.approx(python_distance(locs[r["a"]], locs[r["b"]], 0.3), rel=1e-9)
    some = mdav.Trajectories(list(locs.values()))
    for k, x in enumerate(locs.values()):
        assert some.distances(list(locs.values())[0], 0.3)[k] == pytest.approx(python_distance(list(locs.values())[0], x, 0.3), rel=1e-9, abs=1e-6)


def test_lambda_sampled_and_whole(spark):
    r = distance.estimate_lambda(walk(spark)).first()
    assert r["p_lambda"] > 0 and r["max_distance"] > 0


def test_speed_rules(spark):
    rows = [(1, 1, 0, 0, 1.0, 41.0), (1, 1, 0, 1, 1.0, 41.0), (2, 2, 0, 2, 1.0, 41.0), (2, 2, 3600, 3, 1.01, 41.0), (3, 3, 0, 4, 1.0, 41.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0] for r in filters.by_speed(df, 300).select("trajectory_id").distinct().collect()} == {2, 3}, "a hop without duration is too fast"
    v = {r[0]: r[1] for r in tr.average_speeds(df).collect()}
    assert v[1] == 0 and v[3] == 0 and v[2] == pytest.approx(mdav.km(1.0, 41.0, 1.01, 41.0))


def test_loader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('user_id,trajectory_id,timestamp,lon,lat\n"1","1","2022/11/21 15:03:31",1.2,41.1\n1,1,2022/11/21 15:04:31,1.21,41.1\n2,2,2022/11/21 15:03:31,1.2,95\n2,2,2022/11/21 15:05:31,1.2,41\n\n\n')
    df = src.read_dataset(spark, str(tmp_path / "a.csv"))
    assert {(r["trajectory_id"], r["ts"]) for r in df.collect()} == {(1, 1669043011), (1, 1669043071)}, "a bad row takes its trajectory along"
    sinks.write_csv(df, str(tmp_path / "out"))
    again = src.read_dataset(spark, str(tmp_path / "out"), "csv")
    assert sorted(r[:3] for r in again.collect()) == sorted(r[:3] for r in df.collect())
    with pytest.raises(TypeError):
        src.read_dataset(spark, "x.xlsx")
    with pytest.raises(ValueError):
        sinks.write_csv(df.limit(0), str(tmp_path / "none"))
    assert src.from_numpy(spark, sinks.to_numpy(df, True)).count() == 2
    assert src.from_pandas(spark, sinks.to_pandas(df)).count() == 2


def test_tiles_files(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 1], [0.5, 0.5]]
    feature = lambda kind, c: {"type": "Feature", "properties": {}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "t.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [ring, hole]), feature("MultiPolygon", [[[[x + 5, y] for x, y in ring]]])]}))
    tiles = raw.read_geojson_tiles(spark, str(tmp_path / "t.geojson"))
    points = spark.createDataFrame([(1, 1, 0, 0, 1.5, 1.5), (1, 1, 1, 1, 0.7, 0.7), (1, 1, 2, 2, 6.0, 1.0), (1, 1, 3, 3, 0.0, 1.0)], SCHEMA)
    got = {(r["seq"], r["tile_id"]) for r in tessellation.polygon_tiles(points, tiles, keep_unmapped=True, cell_deg=0.5).collect()}
    assert got == {(0, 1), (1, None), (2, 2), (3, None)}
    c = {r["tile_id"]: (round(r["centre_lon"], 3), round(r["centre_lat"], 3)) for r in tessellation.polygon_centroids(tiles).collect()}
    assert c[2] == (6.0, 1.0)
    assert generalization.simple(points, tiles=tiles).count() == 2
    import struct

    flat = b"".join(struct.pack("<2d", *map(float, p)) for p in ring)
    body = struct.pack("<i4d2i1i", 5, 0, 0, 2, 2, 1, 5, 0) + flat
    (tmp_path / "t.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    assert raw.read_shapefile_tiles(spark, str(tmp_path / "t.shp")).first()["polygons"][0][0] == [[float(a), float(b)] for a, b in ring]


def test_cab_logs(spark, tmp_path):
    (tmp_path / "new_a.txt").write_text("1 2 1 100\n1 2 1 110\n1 2 0 120\n1 2 1 130\n")
    (tmp_path / "new_b.txt").write_text("1 2 1 100\n1 2 1 999\n")
    log = raw.read_cab_logs(spark, str(tmp_path))
    trips = raw.occupied_trips(log, raw.in_window(F.col("ts"), 99, 500))
    assert sorted((r["trajectory_id"], r["ts"]) for r in trips.collect()) == [(1, 100), (1, 110), (2, 130), (3, 100)]
    wrapped = log.filter(raw.in_time_of_day(F.col("ts"), "23:00:00", "00:01:45"))
    assert wrapped.count() == 2


def test_taxi_and_point_logs(spark, tmp_path):
    (tmp_path / "taxi.txt").write_text("7;2014-02-01 00:00:00.5+01;POINT(41.9 12.4)\n7;2014-02-01 00:00:10+01;POINT(41.9 12.4)\n7;2014-02-01 00:01:00+01;POINT(41.91 12.4)\n7;2014-02-01 01:00:00+01;POINT(41.91 12.4)\n")
    kept = raw.thin(raw.read_taxi_log(spark, str(tmp_path / "taxi.txt")), ["user_id"], 30, 180, 100, gap_open=False)
    assert [(r["session"], r["lat"]) for r in kept.orderBy("ts").collect()] == [(0, 41.9), (0, 41.91), (1, 41.91)]
    d = tmp_path / "003" / "Trajectory"
    d.mkdir(parents=True)
    rows = "".join(f"39.9,116.{k},0,0,0,2008-10-23,02:53:{k:02d}\n" for k in (0, 10, 40))
    (d / "x.plt").write_text("h\n" * 6 + rows)
    points = raw.read_point_logs(spark, str(tmp_path))
    assert [r["ts"] % 60 for r in raw.thin(points, ["user_id", "log"], 30, 120).orderBy("ts").collect()] == [0, 40]


def test_protected_leaves_no_rare_pair(spark):
    loc = walk(spark, n=30, steps=6)
    out = generalization.protected(loc, 500, k=3, knowledge=2)
    tiles = out.withColumn("tile", F.xxhash64("lon", "lat"))
    seqs = sequences.tile_sequences(tiles, "tile")
    assert seqs.count() > 0
    assert sequences.combination_support(seqs, 2).filter("n < 3").isEmpty()
    loops = generalization.thin_sequence(["a", "b", "a", "c"], [("a", "c"), ("b", "c")], [("a", "b"), ("b", "a"), ("a", "a")])
    assert "c" not in loops and all(x != y for x, y in zip(loops, loops[1:]))
    assert generalization.thin_sequence(["a", "b"], [("a", "b")], []) == []
    later = generalization.protected(loc, 1000, k=2, knowledge=2, strategy="centroid", time_interval=5, time_strategy="same")
    assert later.select("ts").distinct().count() <= 40


def test_combinations_of_three(spark):
    s = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, ["a", "b"]), (3, ["a"])], "trajectory_id long, tiles array<string>")
    got = {(r["trajectory_id"], tuple(r["combo"])) for r in sequences.combinations(s, 3).collect()}
    assert got == {(1, ("a", "b", "c")), (1, ("a", "b", "a")), (1, ("a", "c", "a")), (1, ("b", "c", "a")), (2, ("a", "b"))}


def test_mdav_cluster_sizes(spark):
    loc = walk(spark, n=20)
    sizes = Counter(r["cluster_id"] for r in mdav.cluster_groups(tr.nest(loc), 3, 0.1).collect())
    assert min(sizes.values()) >= 3 and max(sizes.values()) < 6 and sum(sizes.values()) == 20
    with pytest.raises(ValueError):
        mdav.cluster_groups(tr.nest(loc), 1, 0.1)


def test_start_parts(spark):
    t = spark.createDataFrame([(k, k, 1, [(s, 0, 0.0, 0.0)]) for k, s in enumerate([0, 10, 20, 1000, 2000, 2001, 2002, 2003])], "trajectory_id long, user_id long, n int, locs array<struct<ts: long, seq: long, lon: double, lat: double>>")
    parts = {r["trajectory_id"]: r["part"] for r in mdav.start_parts(t, 2, 100).collect()}
    assert parts == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2}


def test_microaggregation_makes_copies(spark):
    loc = walk(spark, n=15)
    for out in (microaggregation.microaggregate(loc, 3, 0.1), microaggregation.microaggregate_by_start(loc, 3, 300, 0.1)):
        content = tr.nest(out).select(tr.content_key().alias("k")).groupBy("k").count()
        assert content.agg(F.min("count")).first()[0] >= 3
        assert out.select("trajectory_id").distinct().count() == 15
    for how in ("Closest_locations_to_mean_trajectory", "Closest_trajectory_to_mean_trajectory"):
        out = microaggregation.microaggregate(loc, 3, 0.1, how)
        assert out.join(loc.select("lon", "lat").distinct(), ["lon", "lat"], "left_anti").isEmpty(), "only real locations"


def test_swapmob_keeps_points(spark):
    loc = walk(spark, n=20)
    out = swapmob.swapmob(loc, 0.5, 60, 0, seed=1)
    key = lambda df: sorted((r["ts"], r["lon"], r["lat"]) for r in df.collect())
    assert key(out) == key(loc)
    assert out.exceptAll(loc.select(*out.columns)).count() > 0, "somebody swapped"
    assert sorted(map(tuple, swapmob.swapmob(loc, 0.5, 60, 0, seed=1).collect())) == sorted(map(tuple, out.collect()))
    used = swapmob.swaps(loc, 0.5, 60, 1).select("bucket", F.explode(F.array("a", "b")).alias("t")).groupBy("bucket", "t").count()
    assert used.filter("count > 1").isEmpty()


def test_swapmob_is_the_fold_over_swaps(spark):
    loc = walk(spark, 5, n=10)
    chosen = sorted(map(tuple, swapmob.swaps(loc, 0.8, 60, 3).select("bucket", "a", "a_seq", "b", "b_seq").collect()))
    rows = sorted(((r["ts"], r["seq"], r["trajectory_id"]) for r in loc.collect()))
    at = {seq: ts for ts, seq, _ in rows}
    label = {seq: tid for _, seq, tid in rows}
    for _, a, i, b, j in chosen:  # the plain procedure, forwards
        before = lambda s, e: (at[s], s) <= (at[e], e)
        one = [s for s in label if label[s] == a and before(s, i)]
        two = [s for s in label if label[s] == b and before(s, j)]
        for s in one:
            label[s] = b
        for s in two:
            label[s] = a
    out = {r["seq"]: r["trajectory_id"] for r in swapmob.swapmob(loc, 0.8, 60, 0, seed=3).collect()}
    assert out == label


def test_swap_all(spark):
    loc = walk(spark, n=20)
    out = swaplocations.swap_all(loc, 3, 2000, 600, 500, 60, seed=2, suppress=False)
    assert out.select("ts", "lon", "lat").exceptAll(loc.select("ts", "lon", "lat")).isEmpty()
    with pytest.raises(ValueError):
        swaplocations.swap_all(loc, 50, 1, 1, 1, 1, seed=2)


def test_quadtree_sectors_hold_k(spark):
    loc = walk(spark, n=40, steps=10)
    for merge in (True, False):
        h = quadtree.heatmap(loc, 5, 50, merge_sectors=merge)
        rows = h.collect()
        assert min(r["n_locations"] for r in rows) >= 5
        assert all(r["density"] > 0 for r in rows)
    assert sum(r["n_locations"] for r in rows) <= 400
    assert quadtree.in_box(h, (1.2, 41.0, 1.3, 41.2)).count() == len(rows)


def test_graph(spark):
    loc = walk(spark, n=6).unionByName(walk(spark, 2, 3).withColumn("trajectory_id", F.col("trajectory_id") + 10).withColumn("ts", F.col("ts") + 10**6))
    assert {r[0] for r in graph.largest_component(loc).select("trajectory_id").distinct().collect()} == set(range(6))
    d = {(r["source"], r["node"]): r["distance"] for r in graph.graph_distances(loc).collect()}
    assert d[0, 0] == 0 and d[0, 1] == pytest.approx(d[1, 0]) and (0, 10) not in d
    assert graph.swap_in_clusters(loc, 3, 600, 5.0, 0.1, seed=1).count() > 0


def test_measures_of_the_same_data(spark):
    loc = walk(spark)
    assert measures.rsme(loc, loc, 0.1).first()[0] == 0
    assert measures.record_linkage(loc, loc, 0.1).first()[0] == 100
    assert measures.record_linkage(loc, loc, 0.1, percen_window_size=50).first()[0] == 100
    assert tuple(measures.trajectories_removed(loc, loc).first()) == (0, 0)
    m = measures.location_measures(loc, loc).first().asDict()
    assert all(m[k] == m[k.replace("original", "anonymized")] for k in m if k.endswith("original"))


def test_copies_share_linkage(spark):
    one = walk(spark, n=2, steps=5).filter("trajectory_id = 0")
    both = one.unionByName(one.withColumn("trajectory_id", F.lit(1).cast("long")))
    assert measures.record_linkage(both, both, 0.1, exhaustive=True).first()[0] == 50


def test_specs(spark, tmp_path):
    sinks.csv_rows(walk(spark)).coalesce(1).write.option("header", True).csv(str(tmp_path / "in.csv"))
    spec = {"method": "Microaggregation", "input_file": str(tmp_path / "in.csv"), "output_folder": str(tmp_path), "main_output_file": "out", "params": {"k": 3, "clustering_method": {"name": "SimpleMDAV", "params": {"trajectory_distance": {"name": "Martinez2021", "params": {"p_lambda": 0.01}}}}, "aggregation_method": {"name": "Mean_trajectory"}}}
    assert registry.anonymize(spark, json.dumps(spec)).count() > 0
    m = registry.measure(spark, json.dumps({"original_dataset": str(tmp_path / "in.csv"), "anonymized_dataset": str(tmp_path / "in.csv"), "measures": [{"name": "TrajectoriesRemoved"}, {"name": "ScikitMeasures", "params": {"sort": True, "tesselation_meters": 250}}]}))
    assert m["trajectories_removed"] == 0 and len(m) == 12
    assert registry.filter_dataset(spark, json.dumps({"input_filename": str(tmp_path / "in.csv"), "methods": [{"min_locations": 5}, {"max_speed": 300}]})).count() > 0
    for bad in ("{", "{}", json.dumps({"method": "No", "input_file": spec["input_file"]}), json.dumps({"method": "SwapMob", "input_file": spec["input_file"], "params": {"x": 1}})):
        with pytest.raises(ValueError):
            registry.anonymize(spark, bad)
    assert "SwapMob" in registry.names("anonymization")


def test_exit_codes(spark, tmp_path):
    from tracewarden.__main__ import main

    def code(command, **spec):
        (tmp_path / "s.json").write_text(json.dumps(spec))
        return main([command, "-f", str(tmp_path / "s.json")])

    sinks.csv_rows(walk(spark)).coalesce(1).write.option("header", True).csv(str(tmp_path / "in.csv"))
    there = {"method": "SimpleGeneralization", "input_file": str(tmp_path / "in.csv")}
    assert main(["paint"]) == 7 and main(["anonymize"]) == 1
    assert main(["anonymize", "-f", str(tmp_path / "none.json")]) == 1
    (tmp_path / "bad.json").write_text("{")
    assert main(["filter", "-f", str(tmp_path / "bad.json")]) == 2
    assert code("anonymize", method="SwapMob") == 3
    assert code("anonymize", method="SwapMob", input_file=str(tmp_path / "none.csv")) == 4
    assert code("anonymize", **there, output_folder=str(tmp_path / "none")) == 5
    assert code("anonymize", **there | {"method": "Nothing"}) == 6
    assert code("anonymize", **there, params={"size": 3}) == 8
    for distance_ in ({"name": "DomingoTrujillo2012"}, {"name": "Martinez2021", "params": {"normalized": True}}):
        assert code("anonymize", **there | {"method": "Microaggregation"}, params={"trajectory_distance": distance_}) == 8
    assert code("anonymize", **there) == 0


def test_plug_ins_are_called(spark):
    """A clustering and an aggregation of other makers do the work that they are named for."""
    loc = walk(spark)

    @registry.register("clustering", "ByParity")
    def parity(trajectories, k, weight, group=None):
        return trajectories.withColumn("cluster_id", F.col("trajectory_id") % 2)

    @registry.register("aggregation", "Smallest")
    def smallest(members):
        first = members.groupBy("cluster_id").agg(F.min_by(F.struct("n", "locs"), "trajectory_id").alias("m"))
        return first.select("cluster_id", "m.n", "m.locs")

    out = registry.call("anonymization", "Microaggregation", loc, params={"k": 2, "p_lambda": 0.1, "clustering_method": {"name": "ByParity"}, "aggregation_method": {"name": "Smallest"}})
    want = {r["trajectory_id"]: r["locs"] for r in tr.nest(loc).collect()}
    for r in tr.nest(out).collect():
        assert [(p["ts"], p["lon"]) for p in r["locs"]] == [(p["ts"], p["lon"]) for p in want[r["trajectory_id"] % 2]]


def test_conversions(spark, tmp_path):
    sinks.csv_rows(walk(spark)).coalesce(1).write.option("header", True).csv(str(tmp_path / "a.csv"))
    sinks.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.parquet"))
    sinks.parquet_to_csv(spark, str(tmp_path / "b.parquet"), str(tmp_path / "c.csv"))
    read = [src.read_dataset(spark, str(tmp_path / f)).drop("seq") for f in ("a.csv", "b.parquet", "c.csv")]
    assert read[0].count() == 96 and read[0].exceptAll(read[1]).isEmpty() and read[1].exceptAll(read[2]).isEmpty()
    assert filters.by_id(read[0], 3).count() == 8


def test_swap_components(spark):
    """Locations within the radii are never apart; far groups are."""
    rng = np.random.default_rng(3)
    rows = [(k, k, int(rng.integers(0, 5000)), k, float(rng.uniform(0, 0.2)), float(60 + rng.uniform(0, 0.1))) for k in range(300)]
    found = {r["seq"]: r for r in swaplocations.apart(spark.createDataFrame(rows, SCHEMA), 500, 60).collect()}
    for a in rows:
        for b in rows:
            if abs(a[2] - b[2]) <= 60 and mdav.km(a[4], a[5], b[4], b[5]) <= 0.5:
                assert found[a[3]]["component"] == found[b[3]]["component"]
    assert len({r["component"] for r in found.values()}) > 20


def test_meetings_far_north(spark):
    from tracewarden.streaming import streams

    rng = np.random.default_rng(4)
    rows = [(k, 1_700_000_000 + int(rng.integers(60)), float(25 + rng.uniform(0, 0.05)), float(69.48 + rng.uniform(0, 0.04))) for k in range(200)]
    points = spark.createDataFrame(rows, "user_id long, ts long, lon double, lat double").withColumn("time", F.timestamp_seconds("ts"))
    got = {(r["a"], r["b"]) for r in streams.meetings(points, 0.3, 60).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] // 60 == b[1] // 60 and mdav.km(a[2], a[3], b[2], b[3]) < 0.3}
    assert got == want and want


def test_streams(spark, tmp_path):
    from tracewarden.streaming import streams

    walk(spark, n=12).select("user_id", F.timestamp_seconds("ts").alias("time"), "lon", "lat").write.parquet(str(tmp_path / "in"))
    points = spark.readStream.schema("user_id long, time timestamp, lon double, lat double").parquet(str(tmp_path / "in"))
    for name, df in (("met", streams.meetings(points, 0.5, 60)), ("crowd", streams.crowded_cells(points, 2))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("met").count() > 0
    assert spark.table("crowd").count() > 0


def test_components_without_pairs(spark, monkeypatch):
    """Those of the pairs' graph, but without them; spans need overlaps of 1 to 50 seconds."""
    rng = np.random.default_rng(4)
    rows = []
    for t in range(300):
        start, length = int(rng.integers(2_000_000)), int(rng.choice([0, 1, 3, 40, 20_000, 40_000, 100_000, 1_000_000], p=[0.1, 0.2, 0.2, 0.2, 0.1, 0.1, 0.09, 0.01]))
        start -= start % 4 if t % 2 else 0
        rows += [(1000 - t, t, start, 2 * t, 1.0, 41.0), (1000 - t, t, start + length, 2 * t + 1, 1.0, 41.0)]
    loc = spark.createDataFrame(rows, SCHEMA)
    nodes = loc.select(F.col("trajectory_id").alias("node")).distinct()
    want = sorted(map(tuple, graph.components(nodes, graph.contemporaries(loc).filter("p > 0")).collect()))

    def no_pairs(*_):
        raise AssertionError("pairs grow with the square of what is there at a time")

    monkeypatch.setattr(graph, "contemporaries", no_pairs)
    assert sorted(map(tuple, graph.overlap_components(loc).collect())) == want
    assert 20 < len({c for _, c in want}) < 200
    assert graph.largest_component(loc).count() > 0


def test_mdav_by_bounds(spark, monkeypatch):
    """The clusters of walked distances, ties too, with few distances walked."""
    rng = np.random.default_rng(8)
    locs = []
    for _ in range(400):
        n = int(rng.integers(1, 9))
        locs.append(np.c_[np.sort(rng.integers(0, 86_400, n)) + 1_700_000_000.0, 1.25 + rng.integers(0, 5, n) * 0.004 + rng.normal(0, 0.001, n), 41.1 + rng.normal(0, 0.01, n)])
    locs += [x.copy() for x in locs[:60]]  # equally near and far
    want = mdav._mdav_by_walks(mdav.Trajectories(locs), 3, 0.05)
    walked = []
    monkeypatch.setattr(mdav, "FEW", 5)
    monkeypatch.setattr(mdav, "SMALL", 0)
    plain = mdav.Trajectories.distances
    monkeypatch.setattr(mdav.Trajectories, "distances", lambda self, one, weight, rows=None, own=None: walked.append(len(self.n) if rows is None else len(rows)) or plain(self, one, weight, rows, own))
    assert (mdav.mdav(locs, 3, 0.05) == want).all()
    assert sum(walked) < 6 * len(locs), "distances walked grow with the square of the group"
    assert (mdav.mdav(locs[:7], 3, 0.05) == mdav._mdav_by_walks(mdav.Trajectories(locs[:7]), 3, 0.05)).all()
    assert not len(mdav.mdav([], 3, 0.05)) and list(mdav.mdav(locs[:1], 3, 0.05)) == [0]


def test_nearest_to_means_without_the_product(spark):
    """A member gives its nearest locations of each step, not all its locations for each."""
    from tracewarden.operators import aggregation

    loc = walk(spark, 6, n=8, steps=9)
    members = tr.nest(loc).withColumn("cluster_id", F.col("trajectory_id") % 2)
    points = {(r["cluster_id"], r["i"]): r for r in aggregation.mean_points(members).collect()}
    out = {r["cluster_id"]: r["locs"] for r in aggregation.closest_locations(members, 0.001).collect()}
    everyone = [(r["cluster_id"], r["trajectory_id"], l) for r in members.collect() for l in r["locs"]]
    for c, locs in out.items():
        want = []
        for i in range(len(locs)):
            p = points[c, i]
            d = lambda l: ((p["lon"] - l["lon"]) ** 2 + (p["lat"] - l["lat"]) ** 2 + (0.001 * (p["ts"] - l["ts"])) ** 2) ** 0.5  # noqa: B023, E731
            want.append(min((d(l), t, l["ts"], l["lon"]) for k, t, l in everyone if k == c)[2:])
        assert sorted(want) == sorted((l["ts"], l["lon"]) for l in locs)
    plan = aggregation.closest_locations(members, 0.001)._jdf.queryExecution().analyzed().toString()
    assert "posexplode(locs" not in plan and "Window" not in plan


def test_search_of_nearest_without_pairs(spark, monkeypatch):
    """The nearest of all pairs and of a band, of equally near the smaller id, though pairs are never made."""
    loc = walk(spark, 3, 40, 7).unionByName(walk(spark, 4, 30, 4).withColumn("trajectory_id", F.col("trajectory_id") + 100))
    loc = loc.unionByName(walk(spark, 4, 9, 4).withColumn("trajectory_id", F.col("trajectory_id") + 200))  # copies
    other = generalization.simple(loc.filter("trajectory_id % 5 > 0"), 200)
    o, a = distance.with_speeds(loc), distance.with_speeds(other)
    pairs = distance.every_pair(o, a).select("a", "b", distance.martinez(0.3).alias("d"))
    brute = lambda p: {r["b"]: (r["m"]["a"], pytest.approx(r["m"]["d"], rel=1e-9)) for r in p.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).collect()}
    want, ranks = brute(pairs), o.withColumn("rank", F.col("trajectory_id") % 79)
    asks = a.withColumn("from", F.col("trajectory_id") % 50).withColumn("to", F.col("from") + 20)
    near = pairs.join(ranks.select(F.col("trajectory_id").alias("a"), "rank"), "a").join(asks.select(F.col("trajectory_id").alias("b"), "from", "to"), "b")
    banded = brute(near.filter(F.col("rank").between(F.col("from"), F.col("to"))))

    def no_pairs(*_):
        raise AssertionError("pairs of all would be shuffled")

    monkeypatch.setattr(distance, "every_pair", no_pairs)
    monkeypatch.setattr(measures, "every_pair", no_pairs, raising=False)
    assert {r["b"]: (r["a"], r["d"]) for r in measures.nearest_originals(loc, other, 0.3).collect()} == want
    assert {r["b"]: (r["a"], r["d"]) for r in distance.nearest(ranks, asks, 0.3, band=True).collect()} == banded


def test_moments_meet_legs(spark):
    """Every moment of a span once; a moment of the trajectory's own keeps its location, others lie on the line."""
    loc = walk(spark, 7, 10, 8)
    loc = loc.unionByName(loc.limit(5).withColumn("seq", F.col("seq") + 1000).withColumn("lon", F.col("lon") + 1))  # two at a moment
    rows = loc.collect()
    moments = sorted({r["ts"] for r in rows})
    got = {(r["trajectory_id"], r["ts"]): (r["lon"], r["lat"]) for r in graph.synchronized(loc).collect()}
    count = 0
    for t in {r["trajectory_id"] for r in rows}:
        own = {}
        for r in sorted((r for r in rows if r["trajectory_id"] == t), key=lambda r: -r["seq"]):
            own[r["ts"]] = r
        times = sorted(own)
        for m in (m for m in moments if times[0] <= m <= times[-1]):
            count += 1
            want = [np.interp(m, times, [own[x][c] for x in times]) for c in ("lon", "lat")]
            assert got[t, m] == pytest.approx(want, abs=6e-7) and (m not in own or got[t, m] == (own[m]["lon"], own[m]["lat"]))
    assert count == len(got) == graph.synchronized(loc).count()
    plan = graph.synchronized(loc)._jdf.queryExecution().analyzed().toString()
    assert "last(" not in plan and "first(" not in plan, "moments of all trajectories would be sorted"


def test_meetings_are_not_shuffled(spark, monkeypatch):
    """Swaps are those of the matching over all pairs of a bucket, though pairs are never made."""
    loc = walk(spark, 9, 30)
    assert "Aggregate" not in swapmob.candidates(loc, 0.8, 60)._jdf.queryExecution().analyzed().toString().replace("Aggregate [min(ts", "")
    pairs = [tuple(r) for r in swapmob.candidates(loc, 0.8, 60).select("bucket", "a", "a_seq", "b", "b_seq").collect()]
    assert len(pairs) == len(set(pairs)) > 100
    want = []
    for bucket in sorted({p[0] for p in pairs}):
        rng = np.random.default_rng([3, bucket])
        partners = {}
        for _, a, i, b, j in sorted(p for p in pairs if p[0] == bucket):
            partners.setdefault((a, i), []).append((b, j))
            partners.setdefault((b, j), []).append((a, i))
        used = set()
        for p in sorted(partners, key=lambda x: (len(partners[x]), x)):
            free = sorted(q for q in partners[p] if q[0] not in used)
            if p[0] not in used and free:
                q = free[int(rng.integers(len(free)))]
                want.append((bucket, *p, *q))
                used |= {p[0], q[0]}

    def no_pairs(*_):
        raise AssertionError("pairs grow with the square of what meets")

    monkeypatch.setattr(swapmob, "candidates", no_pairs)
    assert sorted(tuple(r) for r in swapmob.swaps(loc, 0.8, 60, 3).select("bucket", "a", "a_seq", "b", "b_seq").collect()) == sorted(want)


def test_edges_without_moments_of_pairs(spark, monkeypatch):
    """Weights by the definition, in blocks of few trajectories, though no row is made for a pair and a moment."""
    loc = walk(spark, 11, 14, 6).unionByName(walk(spark, 2, 5).withColumn("trajectory_id", F.col("trajectory_id") + 20).withColumn("ts", F.col("ts") + 400))
    at = {}
    for r in graph.synchronized(loc).collect():
        at.setdefault(r["trajectory_id"], {})[r["ts"]] = (r["lon"], r["lat"])
    want = {}
    for r in graph.contemporaries(loc).filter("p > 0").collect():
        common = [m for m in at[r["a"]] if m in at[r["b"]]]
        total = sum((at[r["a"]][m][0] - at[r["b"]][m][0]) ** 2 + (at[r["a"]][m][1] - at[r["b"]][m][1]) ** 2 for m in common)
        want[r["a"], r["b"]] = pytest.approx(total**0.5 / (r["end"] - r["start"]) / r["p"], rel=1e-6)

    def no_rows(*_):
        raise AssertionError("a row for each pair and moment")

    monkeypatch.setattr(graph, "synchronized", no_rows)
    for together, at_once in ((4, 7), (512, 2048)):
        monkeypatch.setattr(graph, "TOGETHER", together)
        monkeypatch.setattr(graph, "AT_ONCE", at_once)
        assert {(r["a"], r["b"]): r["weight"] for r in graph.edges(loc).collect()} == want


def test_swap_clusters_look_at_near_ones(monkeypatch):
    """The clusters of a search at all radii at once, with distances of few."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, r_s, r_t = 3000, [300, 900, 1500], [60, 300, 600]
    ts, tid = np.sort(rng.integers(0, 20_000, n)), rng.integers(0, 200, n)
    lon, lat = 1.2 + rng.random(n) * 0.05, 41.1 + rng.random(n) * 0.05
    rows = pa.table([pa.array(x) for x in (tid, tid + 1000, ts, np.arange(n), lon, lat)], names=["trajectory_id", "user_id", "ts", "seq", "lon", "lat"]).sort_by([("ts", "ascending"), ("trajectory_id", "ascending"), ("seq", "ascending")])
    tid, ts, seq, lon, lat = (rows.column(c).to_numpy() for c in ("trajectory_id", "ts", "seq", "lon", "lat"))
    draw, alive, want = np.random.default_rng([4, 7]), np.ones(n, bool), {}
    for i in draw.permutation(n):
        if not alive[i]:
            continue
        found = None
        for t, s in ((t, s) for t in r_t for s in r_s):
            hit = np.flatnonzero(alive & (np.abs(ts - ts[i]) <= t) & (mdav.km(lon, lat, lon[i], lat[i]) * 1000 <= s))
            hit = hit[np.argsort(np.abs(ts[hit] - ts[i]), kind="stable")]
            first = hit[np.sort(np.unique(tid[hit], return_index=True)[1])]
            if len(first) >= 3:
                found = first
                break
        alive[i if found is None else found] = False
        if found is not None:
            want |= dict(zip(seq[found].tolist(), tid[found[draw.permutation(len(found))]].tolist()))
    looked = []
    monkeypatch.setattr(swaplocations, "km", lambda *a: looked.append(len(a[0])) or mdav.km(*a))
    out = swaplocations.swap_clusters(rows, 3, r_s, r_t, 4, 7)
    assert dict(zip(out.column("seq").to_pylist(), out.column("trajectory_id").to_pylist())) == want and len(want) > 1000
    within = sum(int(np.searchsorted(ts, x + 601) - np.searchsorted(ts, x - 600)) for x in ts[:: n // 100]) / 101
    assert sum(looked) / len(looked) < within / 8


def test_combinations_are_not_shuffled(spark):
    s = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, ["a", "b"])], "trajectory_id long, tiles array<string>")
    plan = sequences.combinations(s)._jdf.queryExecution().toString()
    assert "hashpartitioning(trajectory_id" in plan and "hashpartitioning(combo" not in plan and plan.split("Physical Plan")[-1].count("Exchange hash") == 1
