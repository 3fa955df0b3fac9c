"""Methods by name, and their JSON specs.

A spec names a method and its parameters; a parameter may itself be a spec (`{"name": .., "params": ..}`). What a method
doesn't take is an error, and defaults fill what isn't named.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

KINDS = ("anonymization", "clustering", "aggregation", "distance", "analysis", "measure", "filter")
DEFAULTS = {"anonymization": "SimpleGeneralization", "distance": "Martinez2021", "clustering": "SimpleMDAV", "aggregation": "Mean_trajectory"}
_METHODS: dict[tuple[str, str], Callable] = {}


class SpecError(ValueError):
    """What is wrong with a spec, and the exit code that says so."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


NO_SPEC_FILE, NOT_JSON, FIELD_MISSING, NO_INPUT, NO_OUTPUT_FOLDER, WRONG_METHOD, WRONG_COMMAND, WRONG_PARAMETER = range(1, 9)


class Anonymization(Protocol):
    """Locations in, locations out."""

    def __call__(self, locations: DataFrame, **params) -> DataFrame: ...


class Clustering(Protocol):
    """Nested trajectories in, the same with cluster_id out: clusters of at least k by distances with this weight of time.

    group names a column; clusters then lie within its values.
    """

    def __call__(self, trajectories: DataFrame, k: int, weight: float, group: str | None = None) -> DataFrame: ...


class Aggregation(Protocol):
    """Members (cluster_id, trajectory_id, user_id, n, locs) in, a trajectory a cluster (cluster_id, n, locs) out; may take p_lambda."""

    def __call__(self, members: DataFrame, **params) -> DataFrame: ...


class Distance(Protocol):
    """Locations in, pairs of trajectories with their distances out."""

    def __call__(self, locations: DataFrame, **params) -> DataFrame: ...


class Analysis(Protocol):
    """Locations in, a table of results out."""

    def __call__(self, locations: DataFrame, **params) -> DataFrame: ...


class Measure(Protocol):
    """Original and anonymized locations in, one row of numbers out."""

    def __call__(self, original: DataFrame, anonymized: DataFrame, **params) -> DataFrame: ...


def register(kind: str, name: str):
    """Decorator: makes a function known under a name; other packages add methods the same way."""
    if kind not in KINDS:
        raise ValueError(f"{kind!r} is none of {', '.join(KINDS)}")

    def put(f: Callable) -> Callable:
        _METHODS[kind, name] = f
        return f

    return put


def names(kind: str) -> list[str]:
    _load()
    return sorted(n for k, n in _METHODS if k == kind)


def get(kind: str, name: str | None = None) -> Callable:
    _load()
    name = name or DEFAULTS.get(kind)
    if (kind, name) not in _METHODS:
        raise SpecError(WRONG_METHOD, f"no {kind} method {name!r}; known are {', '.join(names(kind))}")
    return _METHODS[kind, name]


def resolve(params: dict | None) -> dict:
    """Parameters with nested specs turned into what the methods take: p_lambda of a distance, the names of a clustering and an aggregation.

    Methods compare trajectories by Martinez2021 in metres; another distance, or a normalized one, is refused.
    """
    out: dict = {}
    for key, value in (params or {}).items():
        if not (isinstance(value, dict) and "name" in value):
            out[key] = value
            continue
        inner = resolve(value.get("params"))
        if key == "trajectory_distance":
            get("distance", value["name"])
            if value["name"] != DEFAULTS["distance"]:
                raise SpecError(WRONG_PARAMETER, f"{value['name']} can be computed but not be used inside another method; {DEFAULTS['distance']} can")
            if inner.pop("normalized", False) or inner.pop("max_dist", None) is not None:
                raise SpecError(WRONG_PARAMETER, "distances are in metres; normalized ones are not supported")
            if set(inner) - {"p_lambda"}:
                raise SpecError(WRONG_PARAMETER, f"{value['name']} does not take {sorted(set(inner) - {'p_lambda'})}")
            out |= inner
        elif key in ("clustering_method", "aggregation_method"):
            get(key.removesuffix("_method"), value["name"])
            out[key] = value["name"]
            out |= inner
        else:
            raise SpecError(WRONG_PARAMETER, f"parameter {key!r} is not a method")
    return out


def call(kind: str, name: str | None, *frames: DataFrame, params: dict | None = None) -> DataFrame:
    method = get(kind, name)
    given = resolve(params)
    wrong = set(given) - set(inspect.signature(method).parameters)
    if wrong:
        raise SpecError(WRONG_PARAMETER, f"{name or DEFAULTS.get(kind)} does not take {', '.join(sorted(wrong))}")
    return method(*frames, **given)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _checked(spark: SparkSession, spec: dict, *inputs: str) -> dict:
    """The spec, if its input files and its output folder exist."""
    for k in inputs:
        if not _exists(spark, spec[k]):
            raise SpecError(NO_INPUT, f"{spec[k]} does not exist")
    if spec.get("output_folder") and not _exists(spark, spec["output_folder"]):
        raise SpecError(NO_OUTPUT_FOLDER, f"{spec['output_folder']} does not exist")
    return spec


def _load() -> None:
    from tracewarden.plans import methods  # noqa: F401


def load_spec(text: str, required: tuple[str, ...]) -> dict:
    """A spec from JSON text; ValueError if it is no JSON or lacks a field."""
    try:
        spec = json.loads(text)
    except json.JSONDecodeError as e:
        raise SpecError(NOT_JSON, f"the spec is not valid JSON: {e}") from e
    missing = [k for k in required if k not in spec]
    if missing:
        raise SpecError(FIELD_MISSING, f"the spec lacks {', '.join(missing)}")
    return spec


def anonymize(spark: SparkSession, text: str) -> DataFrame:
    """Runs an anonymization spec; writes CSV parts below output_folder if main_output_file is named."""
    from tracewarden.sources.locations import read_dataset
    from tracewarden.sources.sinks import write_csv

    spec = _checked(spark, load_spec(text, ("method", "input_file")), "input_file")
    out = call("anonymization", spec["method"], read_dataset(spark, spec["input_file"]), params=spec.get("params"))
    if spec.get("main_output_file"):
        write_csv(out, f"{spec.get('output_folder', '.')}/{spec['main_output_file']}")
    return out


def analyze(spark: SparkSession, text: str) -> DataFrame:
    """Runs an analysis spec; writes GeoJSON features if main_output_file is named."""
    from tracewarden.sources.locations import read_dataset
    from tracewarden.sources.sinks import write_geojson

    spec = _checked(spark, load_spec(text, ("method", "input_file")), "input_file")
    out = call("analysis", spec["method"], read_dataset(spark, spec["input_file"]), params=spec.get("params"))
    if spec.get("main_output_file"):
        write_geojson(out, f"{spec.get('output_folder', '.')}/{spec['main_output_file']}")
    return out


def measure(spark: SparkSession, text: str) -> dict[str, float]:
    """Runs all measures of a spec over an original and an anonymized dataset, which are read once."""
    from tracewarden.sources.locations import read_dataset
    from tracewarden.sources.sinks import measures_json

    spec = _checked(spark, load_spec(text, ("original_dataset", "anonymized_dataset", "measures")), "original_dataset", "anonymized_dataset")
    original, anonymized = (read_dataset(spark, spec[k]).persist() for k in ("original_dataset", "anonymized_dataset"))
    try:
        out: dict[str, float] = {}
        for m in spec["measures"]:
            out |= call("measure", m["name"], original, anonymized, params=m.get("params")).first().asDict()
    finally:
        original.unpersist()
        anonymized.unpersist()
    if spec.get("main_output_file"):
        measures_json(out, f"{spec.get('output_folder', '.')}/{spec['main_output_file']}")
    return out


def filter_dataset(spark: SparkSession, text: str) -> DataFrame:
    from tracewarden.operators.filters import pipeline
    from tracewarden.sources.locations import read_dataset
    from tracewarden.sources.sinks import write_csv

    spec = _checked(spark, load_spec(text, ("input_filename", "methods")), "input_filename")
    out = pipeline(read_dataset(spark, spec["input_filename"]), spec["methods"])
    if spec.get("output_filename"):
        write_csv(out, spec["output_filename"])
    return out
