"""Tables in the cluster's shared folder, and connected components over edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-roadgrain-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there,
    and every executor can read it again after another is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(src long, dst long); component: its smallest node.

    Each round points every node at its smallest neighbour, follows the pointers
    to their roots by doubling, and contracts the edges; the edge table at least
    loses all non-root nodes per round. Self links and repeated edges are fine,
    null ends are dropped, no edges give no rows.
    """
    spark = edges.sparkSession
    both = edges.where("src is not null and dst is not null and src <> dst").selectExpr("src", "dst")
    both = stored(both.union(both.selectExpr("dst", "src")).distinct(), "edges")
    labels = None
    for _ in range(max_rounds):
        if both.isEmpty():
            break
        parent = both.groupBy("src").agg(F.min("dst").alias("m")).selectExpr("src as node", "least(src, m) as up")
        parent = stored(parent, "parents")
        while True:
            over = parent.selectExpr("node as up", "up as over")
            two = parent.join(over, "up").selectExpr("node", "over as up")
            over = two.selectExpr("node as up", "up as over")
            # two doublings a table: pointers are seldom deeper
            jumped = stored(two.join(over, "up").selectExpr("node", "over as up", "up <> over as moved"), "parents")
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.selectExpr("node", "up as component")
        else:
            roots = parent.selectExpr("node as component", "up")
            labels = labels.join(roots, "component", "left").selectExpr("node", "coalesce(up, component) as component")
            labels = stored(labels, "labels")
        a, b = parent.selectExpr("node as src", "up as a"), parent.selectExpr("node as dst", "up as b")
        both = stored(both.join(a, "src").join(b, "dst").where("a <> b").selectExpr("a as src", "b as dst").distinct(), "edges")
    else:
        raise RuntimeError("connected components did not settle")
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels
