"""The registered methods under their public names and parameters."""

from __future__ import annotations

from tracewarden.operators import aggregation, distance, filters, generalization, graph, mdav, measures, microaggregation, quadtree, swaplocations, swapmob
from tracewarden.plans.registry import register

register("anonymization", "SimpleGeneralization")(lambda locations, tiles_filename=None, tile_size=500, overlapping_strategy="all": generalization.simple(locations, tile_size, overlapping_strategy, _tiles(locations, tiles_filename)))
register("anonymization", "ProtectedGeneralization")(
    lambda locations, tiles_filename=None, tile_size=500, k=3, knowledge=2, strategy="avg", time_interval=None, time_strategy="keep": generalization.protected(
        locations, tile_size, k, knowledge, strategy, time_interval, time_strategy, _tiles(locations, tiles_filename)
    )
)
register("anonymization", "Microaggregation")(microaggregation.microaggregate)
register("anonymization", "TimePartMicroaggregation")(microaggregation.microaggregate_by_start)
register("anonymization", "SwapMob")(swapmob.swapmob)
register("anonymization", "SwapAllLocations")(swaplocations.swap_all)
register("anonymization", "SwapLocations")(graph.swap_in_clusters)
register("clustering", "SimpleMDAV")(mdav.cluster_groups)
register("aggregation", "Mean_trajectory")(aggregation.mean_trajectories)
register("aggregation", "Closest_locations_to_mean_trajectory")(aggregation.closest_locations)
register("aggregation", "Closest_trajectory_to_mean_trajectory")(aggregation.closest_trajectories)
register("distance", "Martinez2021")(distance.all_pairs)
register("distance", "DomingoTrujillo2012")(graph.graph_distances)
register("analysis", "QuadTreeHeatMap")(quadtree.heatmap)
register("measure", "ScikitMeasures")(lambda original, anonymized, sort=True, tesselation_meters=250: measures.location_measures(original, anonymized, tesselation_meters))
register("measure", "TrajectoriesRemoved")(measures.trajectories_removed)
register("measure", "Rsme")(measures.rsme)
register("measure", "PropensityScore")(measures.propensity_score)
register("measure", "RecordLinkage")(measures.record_linkage)
register("filter", "min_locations")(filters.by_n_locations)
register("filter", "max_speed")(filters.by_speed)


def _tiles(locations, filename):
    if filename is None:
        return None
    from tracewarden.sources.raw import read_geojson_tiles, read_shapefile_tiles

    return (read_shapefile_tiles if filename.lower().endswith(".shp") else read_geojson_tiles)(locations.sparkSession, filename)
