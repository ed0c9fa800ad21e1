"""Sharding by a k-d tree over document metadata. DataFrame functions only.

Every level splits each node at the weighted median of its widest dimension.
The medians are found for all nodes of a level together, by histograms that
zoom in on the bucket holding the half: only (node, bucket) sums are shuffled
or collected, at most CELLS of them, never rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import stored

#: Histogram cells per pass over all nodes of a level (two a node where there are more nodes
#: than half of this), and the most shards: they bound what the driver sees.
CELLS, MAX_SHARDS = 16384, 1 << 20
#: Rows per slot-numbering group.
SLOT_GROUP = 65536
#: Bits of a row's tie breaker: first those of its content's hash, then those of its number,
#: which only tells equal rows apart.
_TIE_BITS, _CONTENT_BITS = 52, 32


def ordered_number(column: Column) -> Column:
    """A string as a number that keeps the order of its first six bytes (null: -1)."""
    digits = F.rpad(F.substring(F.hex(column.cast("string").cast("binary")), 1, 12), 12, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("double"), F.lit(-1.0))


def _pick(rows: list, half: dict[int, float], base: dict[int, float]) -> dict[int, tuple]:
    """Per node, the histogram cell in which the running weight first reaches the half:
    (low, high, weight before it)."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["node"], r["cell"])):
        if r["node"] in out:
            continue
        before = base[r["node"]]
        base[r["node"]] = before + r["w"]
        if before + r["w"] >= half[r["node"]]:
            out[r["node"]] = (r["lo"], r["hi"], before)
    return out


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """df with the columns of a small per-node table (at most CELLS rows) joined on node."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), "node", "left")


def _zoom(rows: DataFrame, coordinate: str, bounds: dict[int, tuple[float, float]], half: dict[int, float], base: dict[int, float], slack: float, last: bool) -> dict[int, tuple[float, float]]:
    """Per node (value, weight below it): the coordinate's value at which the running
    weight reaches the half, or (cut, nan) within ``slack`` of the half or, for the
    last coordinate, at the row nearest to it."""
    found: dict[int, tuple[float, float]] = {}
    open_nodes = dict(bounds)
    while open_nodes:
        cells = max(2, CELLS // len(open_nodes))
        live = _table(rows, [(n, float(lo), float(hi)) for n, (lo, hi) in open_nodes.items()], "node int, lo double, hi double").where(f"lo is not null and {coordinate} between lo and hi")
        width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))
        cell = F.least(F.floor((F.col(coordinate) - F.col("lo")) / width * cells), F.lit(cells - 1)).alias("cell")
        sums = live.groupBy("node", cell).agg(F.sum("weight").alias("w"), F.min(coordinate).alias("lo"), F.max(coordinate).alias("hi")).collect()
        picked = _pick(sums, half, dict(base))
        weights = {(r["node"], r["lo"]): r["w"] for r in sums}
        for n, (lo, hi, before) in picked.items():
            w = weights[n, lo]
            if lo == hi and not last:
                found[n] = (hi, before)
                open_nodes.pop(n)
            elif lo == hi or w <= slack * half[n]:  # the cell goes to the side that it leaves closer to the half
                found[n] = (hi if 2 * (half[n] - before) >= w else math.nextafter(lo, -math.inf), math.nan)
                open_nodes.pop(n)
            else:
                open_nodes[n], base[n] = (lo, hi), before
        for n in set(open_nodes) - set(picked):  # rounding: the half lies at the very end
            found[n] = (open_nodes.pop(n)[1], math.nan)
    return found


def kd_shards(docs: DataFrame, dims: dict[str, Column], weight: Column, carry: dict[str, Column], shards: int | None = None, target: float | None = None, slack: float = 0.001) -> DataFrame:
    """carry's columns, weight, shard (0, 1, ...) and slot for every row of docs.

    Give the number of shards (a power of two) or a target weight per leaf, from
    which the depth follows. dims: numeric expressions (null: below all others);
    spread is measured against the range of all rows, ties go to the first
    dimension. Equal values are told apart by a hash of the row's content, and
    equal rows by their number, so no value is too frequent to split, and where
    the table's files begin does not matter; each split is within ``slack`` of
    the half, plus one row. slot is gapless from 0 in each shard, in no
    particular order. Every level is written out, so none is computed twice.
    Repeated rows are rows of their own; an empty table gives no rows.
    """
    spark, names = docs.sparkSession, list(dims)
    plain = [F.coalesce(e.cast("double"), F.lit(-1.0)).alias(f"d{i}") for i, e in enumerate(dims.values())]
    rows = docs.select(*[e.alias(k) for k, e in carry.items()], weight.cast("double").alias("weight"), *plain)
    # the node is read back from storage: as a constant it would turn joins into nested loops
    rows = stored(rows.withColumns({"__row": F.monotonically_increasing_id(), "node": F.lit(0)}), "shard-rows")
    content = F.shiftrightunsigned(F.xxhash64(*carry, "weight", *[f"d{i}" for i in range(len(names))]), 64 - _CONTENT_BITS)
    copy = F.shiftrightunsigned(F.xxhash64("__row"), 64 - _TIE_BITS + _CONTENT_BITS)
    rows = rows.withColumn("tie", (F.shiftleft(content, _TIE_BITS - _CONTENT_BITS) + copy).cast("double"))
    ranges = [x for i in range(len(names)) for x in (F.min(f"d{i}").alias(f"lo{i}"), F.max(f"d{i}").alias(f"hi{i}"))]
    whole = rows.agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *ranges).first()
    if shards is None:
        shards = 1 << max(0, math.ceil(math.log2(max(1.0, (whole["w"] or 0) / target))))
    if shards & (shards - 1) or shards > MAX_SHARDS:
        raise ValueError(f"shards must be a power of two up to {MAX_SHARDS}")
    span = [max((whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0), 1e-300) for i in range(len(names))]
    placed = rows
    for _ in range(shards.bit_length() - 1 if whole["n"] else 0):
        stats = placed.groupBy("node").agg(F.sum("weight").alias("w"), *ranges).collect()
        half = {r["node"]: r["w"] / 2 for r in stats}
        dim = {r["node"]: max(range(len(names)), key=lambda i, r=r: ((r[f"hi{i}"] - r[f"lo{i}"]) / span[i], -i)) for r in stats}
        bounds = {r["node"]: (r[f"lo{dim[r['node']]}"], r[f"hi{dim[r['node']]}"]) for r in stats}
        chosen = _table(placed, list(dim.items()), "node int, dim int")
        chosen = chosen.withColumn("at", F.element_at(F.array(*[f"d{i}" for i in range(len(names))]), F.col("dim") + 1)).drop("dim")
        cut = _zoom(chosen.select("node", "weight", "at"), "at", bounds, half, dict.fromkeys(half, 0.0), slack, last=False)
        tied = {n: before for n, (_, before) in cut.items() if not math.isnan(before)}
        ties: dict[int, tuple[float, float]] = {}
        if tied:
            equal = _table(chosen, [(n, cut[n][0]) for n in tied], "node int, value double").where("at = value").select("node", "weight", "tie")
            ties = _zoom(equal, "tie", {n: (0.0, 2.0**_TIE_BITS) for n in tied}, half, dict(tied), slack, last=True)
        splits = [(n, v, ties[n][0] if n in ties else 2.0**_TIE_BITS) for n, (v, _) in cut.items()]
        placed = _table(chosen, splits, "node int, value double, upto double")
        right = (F.col("at") > F.col("value")) | ((F.col("at") == F.col("value")) & (F.col("tie") > F.col("upto")))
        placed = placed.withColumn("node", (F.col("node") * 2 + right.cast("int")).cast("int")).drop("value", "upto", "at")
        placed = stored(placed, "shard-level")
    groups = max(1, -(-int(whole["n"]) // SLOT_GROUP))
    return numbered(placed.withColumnRenamed("node", "shard"), "shard", groups).select(*carry, "weight", "shard", "slot")


def numbered(rows: DataFrame, part: str, groups: int) -> DataFrame:
    """rows with slot, gapless from 0 in each part. Rows are numbered inside (part, group)
    by a hash of __row, and each group starts where the groups before it end."""
    rows = rows.withColumn("__group", F.pmod(F.xxhash64(F.lit(7), "__row"), F.lit(groups)).cast("int"))
    sizes = rows.groupBy(part, "__group").agg(F.count("*").alias("__n"))
    before = F.expr(f"sum(__n) over (partition by {part} order by __group rows between unbounded preceding and 1 preceding)")
    starts = sizes.select(part, "__group", F.coalesce(before, F.lit(0)).alias("__start"))
    slot = F.expr(f"row_number() over (partition by {part}, __group order by __row) - 1")
    inner = rows.withColumn("__slot", slot)
    return inner.join(starts, [part, "__group"]).withColumn("slot", (F.col("__start") + F.col("__slot")).cast("long"))


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: float | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) with near-equal bytes per shard.

    size: UTF-8 bytes of the text (null: none) plus one. Dimensions: n_chars,
    source and lang where docs has them, and the id's value.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    dims = {c: F.col(c) if c == "n_chars" else ordered_number(F.col(c)) for c in ("n_chars", "source", "lang") if c in docs.columns}
    dims[id_col] = F.col(id_col)
    carry = {"doc_id": F.col(id_col), "text_crc32": F.crc32(body)}
    out = kd_shards(docs, dims, F.length(body) + 1, carry, shards, target_bytes)
    return out.select("doc_id", F.col("weight").cast("long").alias("size"), "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write docs (with unique ids) as one folder per shard, rows in slot order."""
    spot = placed.select(F.col("doc_id").alias("__id"), "shard", "slot")
    joined = docs.join(spot, F.col(id_col) == F.col("__id")).drop("__id")
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
