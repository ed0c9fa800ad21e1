"""Findings of round 4: points tested once each, whole jobs over many cameras in less time and disk."""

from dataclasses import replace

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from roadgrain import catalog
from roadgrain.operators import kinematics, review, rules
from roadgrain.plans import views
from roadgrain.sources import staging

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "nation", "events")


def by_sql(name):
    """The rows of a query's SQL over the smallest tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall())


def test_points_are_made_distinct_before_they_are_tested(spark):
    got = catalog.QUERIES["points_in_concave_polygon"](spark, SF)
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1].split("\n", 1)[1]
    assert "1150.0" not in below  # a corner of the polygon: filters on what is grouped go below the groups
    assert sorted(map(tuple, got.collect())) == by_sql("points_in_concave_polygon")


def test_points_of_many_orders_are_dealt_to_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(views, "ACTORS", 10)
    few = views.spots(spark, SF)
    plan = few._jdf.queryExecution().executedPlan().toString()
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert f", {tasks}), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, views.tracks(spark, SF).select("gx", "gy").distinct().collect()))


def test_the_scan_stores_only_what_runs_are_made_from(spark):
    rows, kept = kinematics.with_kinematics(views.tracks(spark, SF)), {}

    def keep(df, name):
        kept[name] = staging.staged(df, name)
        return kept[name]

    review.scan(rows, views.scene(), keep)
    assert set(kept) == {"scan-runs", "scan-jams"}
    # all vehicles with all their columns were stored before
    assert kept["scan-runs"].count() < rules.vehicles(rows).count() * 2 / 3 and "x1" not in kept["scan-runs"].columns
    assert kept["scan-jams"].count() < 100


def test_numbers_of_parts_decide_most_points_as_edges_do(spark):
    table = catalog._scene_table(spark, SF)
    rng = np.random.default_rng(4)
    x, y = np.round(rng.uniform(-70, 1990, 3000) * 4) / 4, np.round(rng.uniform(200, 860, 3000) * 4) / 4
    odd = [("c0", None, 5.0), ("c1", float("nan"), 400.0), ("none", 500.0, 400.0), (None, 500.0, 400.0), ("c3", 1100.25, 290.25), ("c3", 960.0, 290.25)]
    rows = spark.createDataFrame([(f"c{i % 25}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + odd, "camera_id string, gx double, gy double")
    found = table.index(rows)
    edges = replace(table, cells=table.cells.withColumn("codes", F.transform("codes", lambda c: F.lit(-1)))).index(rows)
    got = sorted(map(str, found.select(sorted(found.columns)).collect()))
    assert got == sorted(map(str, edges.select(sorted(found.columns)).collect())) and len(got) == 3006
    assert len({r["lane_ord"] for r in found.collect()}) == 9 and found.where("in_queue and on_road").count() > 50
    open_, parts = table.cells.select(F.sum(F.size(F.filter("codes", lambda c: c < 0))), F.sum(F.size("codes"))).first()
    assert open_ < parts / 3
    # the cells' edges, long as they are, meet only points in parts on a border
    plan = found.select("lane_id", "in_queue")._jdf.queryExecution().optimizedPlan().toString()
    assert "__open" in plan
