"""Event sources as plug-ins: a function (spark, path) -> segments, by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from roadgrain.operators import rules, validation

Source = Callable[[SparkSession, str], DataFrame]
EVENT_SOURCES: dict[str, Source] = {}


def event_source(name: str) -> Callable[[Source], Source]:
    """Registers a function (spark, path) -> segments, as a rule may return them."""

    def add(f: Source) -> Source:
        EVENT_SOURCES[name] = f
        return f

    return add


def detected(spark: SparkSession, path: str, names: Sequence[str] | None = None, labels: Sequence[str] = validation.LABELS) -> DataFrame:
    """(source, video_id, label, start, end, score, track_ids) of all (or some) sources over
    path, official labels only. A source without a label column emits its own name."""
    out = None
    for name in names if names is not None else list(EVENT_SOURCES):
        found = validation.official(rules.normalised(EVENT_SOURCES[name](spark, path), name), labels).selectExpr(f"'{name}' as source", "*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "source string, video_id string, label string, start double, end double, score double, track_ids array<long>")
    return out
