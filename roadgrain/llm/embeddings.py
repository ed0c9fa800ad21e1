"""Near-duplicate embeddings by PCA-ordered tiled comparison.

All valid vectors give the second moments; the rotation to their principal axes
keeps every dot product and puts most of it into the leading dimensions. Rows
are tiled by the signs of their leading coordinates; tile pairs whose boxes and
suffix norms cannot reach the threshold are dropped; in the others, products
accumulate by blocks of dimensions and stop for pairs whose bound falls below
it. What is left is decided by the full product of the unit vectors in doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.ngram_join import _merge
from roadgrain.llm.shared import connected_components, stored

THRESHOLD = 0.9
#: Leading dimensions of the tile boxes, and where the running products are bounded.
BOX, STAGES = 8, (12, 24, 40)
#: Rows of a side in one numpy product.
SUB = 1024
#: Tiles have at least so many rows; with n rows, about 16 * sqrt(n): the tiles' boxes,
#: a few hundred bytes each, are then at most sqrt(n) / 8 rows.
LEAST_TILE = 1024
#: Room for rounding in the bounds, not in the decision.
EPSILON = 1e-9
NODE = "coalesce(cast(vec_id as long), 4611686018427387904 + pmod(xxhash64(embedding), 4611686018427387904))"


def unit_rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) by length, for the vectors that can link: not null,
    not zero, all components finite."""
    flat = vectors.flatten()
    lengths = np.array([len(v) if v is not None else 0 for v in vectors.to_pylist()]) if vectors.null_count else np.diff(vectors.offsets.to_numpy())
    begins = np.concatenate([[0], np.cumsum(lengths)])
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = values[begins[rows][:, None] + np.arange(d)]
        ok = np.isfinite(x).all(1)
        x, rows = x[ok], rows[ok]
        x = x / np.maximum(np.abs(x).max(1, initial=0.0), 1e-300)[:, None]  # no overflow in the norms
        norm = np.sqrt((x * x).sum(1))
        ok = norm > 0
        yield rows[ok], x[ok] / norm[ok][:, None]


def principal_axes(vectors: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """For each vector length its rotation (columns: axes, widest first), from the second
    moments of all valid unit vectors; and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for rows, x in unit_rows(batch.column("embedding")):
                d = x.shape[1]
                sums[d] = sums.get(d, 0) + (x.T @ x)[np.triu_indices(d)]
                count[d] = count.get(d, 0) + len(rows)
        for d, s in sums.items():
            s = np.append(s, count[d])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), d, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["d", "i", "value"])

    parts = vectors.select("embedding").mapInArrow(run, "d int, i int, value double")
    rows = parts.groupBy("d", "i").agg(F.sum("value").alias("value")).collect()  # d * (d + 1) / 2 + 1 of each length
    out, total = {}, 0
    for d in sorted({r["d"] for r in rows}):
        mine = {r["i"]: r["value"] for r in rows if r["d"] == d}
        moments = np.zeros((d, d))
        moments[np.triu_indices(d)] = [mine[i] for i in range(d * (d + 1) // 2)]
        moments = moments + np.triu(moments, 1).T
        total += int(mine[d * (d + 1) // 2])
        out[d] = np.linalg.eigh(moments)[1][:, ::-1].copy()
    return out, total


def _boxed(vectors: DataFrame, axes: dict[int, np.ndarray], signs: int) -> DataFrame:
    """(node, d, cell, unit) of every valid vector; cell: signs of the leading coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for rows, x in unit_rows(batch.column("embedding")):
                d = x.shape[1]
                lead = x @ axes[d][:, : min(signs, d)]
                cell = ((lead > 0) << np.arange(lead.shape[1])).sum(1).astype(np.int64)
                unit = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(np.full(len(rows), d, np.int32)), pa.array(cell), unit], ["node", "d", "cell", "unit"])

    return vectors.select("node", "embedding").mapInArrow(run, "node long, d int, cell long, unit binary")


def _tile_blocks(rows: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """One row per tile: its nodes and unit vectors in the order of the first axis, and
    the box of its leading coordinates with the largest suffix norm."""

    def run(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        x = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(-1, d)
        lead = x @ axes[d][:, :BOX]
        order = np.lexsort((table.column("node").to_numpy(), lead[:, 0]))
        suffix = math.sqrt(max(0.0, (1 - (lead * lead).sum(1)).max())) + EPSILON
        box = np.concatenate([lead.min(0), lead.max(0), [suffix]])
        out = {
            "d": pa.array([d], pa.int32()), "tile": pa.array([table.column("tile")[0].as_py()], pa.int64()), "box": pa.array([box.tolist()], pa.list_(pa.float64())),
            "nodes": pa.array([table.column("node").to_numpy()[order].tobytes()], pa.binary()), "units": pa.array([x[order].tobytes()], pa.binary()),
        }
        return pa.table(out)

    return rows.groupBy("d", "tile").applyInArrow(run, "d int, tile long, box array<double>, nodes binary, units binary")


def _open_pairs(tiles: DataFrame, boxes: list[tuple[int, int, list[float]]], threshold: float) -> DataFrame:
    """(lo, hi) for the tile pairs whose bound reaches the threshold, each once."""
    d = np.array([b[0] for b in boxes])
    tile = np.array([b[1] for b in boxes], np.int64)
    low, high, suffix = np.zeros((len(boxes), BOX)), np.zeros((len(boxes), BOX)), np.zeros(len(boxes))
    for row, (_, _, values) in enumerate(boxes):
        k = (len(values) - 1) // 2  # short vectors have fewer leading dimensions
        low[row, :k], high[row, :k], suffix[row] = values[:k], values[k : 2 * k], values[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("tile").to_pylist():
                i = int(np.flatnonzero(tile == t)[0])
                most = np.maximum(np.maximum(low[i] * low, low[i] * high), np.maximum(high[i] * low, high[i] * high)).sum(1) + suffix[i] * suffix
                j = tile[(d == d[i]) & (tile >= t) & (most >= threshold - EPSILON)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), t)), pa.array(j)], ["lo", "hi"])

    return tiles.select("tile").mapInArrow(run, "lo long, hi long")


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a[i] . b[j] >= threshold, sub-tile by sub-tile."""
    ra, rb = a @ axes, b @ axes
    d = a.shape[1]
    stages = [s for s in STAGES if s < d]

    def suffixes(r: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt(np.maximum(0.0, (r[:, s:] * r[:, s:]).sum(1))) + EPSILON for s in stages]

    sa, sb = suffixes(ra), suffixes(rb)
    for p in range(0, len(a), SUB):
        for q in range(0, len(b), SUB):
            i = None
            if stages:
                part = ra[p : p + SUB, : stages[0]] @ rb[q : q + SUB, : stages[0]].T
                open_ = part + np.outer(sa[0][p : p + SUB], sb[0][q : q + SUB]) >= threshold - EPSILON
                if not open_.any():
                    continue
                if open_.mean() <= 0.05:
                    i, j = np.nonzero(open_)
                    run = part[i, j]
                    for s, (at, to) in enumerate(zip(stages[:-1], stages[1:], strict=True), 1):
                        run = run + np.einsum("ij,ij->i", ra[p + i, at:to], rb[q + j, at:to])
                        go = run + sa[s][p + i] * sb[s][q + j] >= threshold - EPSILON
                        i, j, run = i[go], j[go], run[go]
                    go = np.einsum("ij,ij->i", a[p + i], b[q + j]) >= threshold
                    i, j = i[go], j[go]
            if i is None:  # most of this sub-tile is still open: one dense product
                i, j = np.nonzero(a[p : p + SUB] @ b[q : q + SUB].T >= threshold)
            if len(i):
                yield p + i, q + j


def _links(blocks: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(node, n, to): the links of a node within one tile pair, and the first node of its
    component there."""
    sides = pairs.select(F.col("lo").alias("tile"), "lo", "hi").union(pairs.where("lo <> hi").select(F.col("hi").alias("tile"), "lo", "hi"))
    meet = blocks.select("d", "tile", "nodes", "units").join(sides, "tile")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["tile", "d", "nodes", "units"]).to_pylist(), key=lambda r: r["tile"])
        d = rows[0]["d"]
        nodes = [np.frombuffer(r["nodes"], np.int64) for r in rows]
        units = [np.frombuffer(r["units"]).reshape(-1, d) for r in rows]
        every = np.concatenate(nodes)
        count, label, shift = np.zeros(len(every), np.int64), np.arange(len(every)), len(nodes[0]) if len(rows) > 1 else 0
        for i, j in linked_pairs(units[0], units[-1], axes[d], threshold):
            apart = every[i] != every[j + shift]
            i, j = i[apart], j[apart] + shift
            count += np.bincount(i, minlength=len(every))
            if shift:
                count += np.bincount(j, minlength=len(every))
            label = _merge(label, i, j)
        some = np.flatnonzero(count)
        return pa.table({"node": every[some], "n": count[some], "to": every[label[some]]})

    return meet.groupBy("lo", "hi").applyInArrow(run, "node long, n long, to long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, n_links, component) for every vector that links with another.

    vectors(vec_id, embedding): node is the vec_id, or a number from 2 ** 62 on
    for a row without one. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different
    lengths. Equal rows are one vector; rows of one vec_id with different
    vectors are one node, whose links are added up. Other columns are ignored;
    an empty table gives no rows.
    """
    rows = vectors.selectExpr(f"{NODE} as node", "embedding").dropDuplicates()
    axes, n = principal_axes(rows)
    size = max(LEAST_TILE, int(16 * math.sqrt(n)))
    boxed = stored(_boxed(rows, axes, max(0, int(math.log2(max(1, n // size))))), "vectors")
    cells = boxed.groupBy("d", "cell").agg(F.count("*").alias("rows"))
    parts = F.ceil(F.col("rows") / size).cast("int")
    tiled = boxed.join(cells, ["d", "cell"]).withColumn("tile", F.xxhash64("d", "cell", F.pmod(F.xxhash64("node"), parts)))
    blocks = stored(_tile_blocks(tiled, axes), "vector-tiles")
    boxes = [(r["d"], r["tile"], r["box"]) for r in blocks.select("d", "tile", "box").collect()]
    links = stored(_links(blocks, _open_pairs(blocks, boxes, threshold), axes, threshold), "vector-links")
    roots = connected_components(links.selectExpr("node as src", "to as dst").distinct())
    return links.groupBy("node").agg(F.sum("n").alias("n_links")).join(roots, "node", "left").select("node", "n_links", F.coalesce("component", "node").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    got = near_duplicate_vectors(vectors)
    out = vectors.select("vec_id", F.expr(NODE).alias("node")).join(got, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def oracle() -> str:
    """DuckDB SQL for the rows of ``query``: every pair by its full cosine."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    whole AS MATERIALIZED (SELECT vec_id, v FROM e WHERE len(v) > 0 AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in v if x <> 0]) > 0),
    p AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM whole a JOIN whole b ON a.vec_id <> b.vec_id AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= {THRESHOLD}e0 ELSE FALSE END),
    reach(i, j) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.i, p.j FROM reach r JOIN p ON p.i = r.j),
    c AS (SELECT i AS vec_id, min(j) AS component_id FROM reach GROUP BY i), n AS (SELECT i AS vec_id, count(*) AS n_links FROM p GROUP BY i)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
