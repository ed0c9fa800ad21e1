"""A Merkle manifest of a dataset: a tree of SHA-256 digests whose parents keep hash states.

Every row is a leaf. The leaves of a group (a language) stand in order of their ids;
every FANOUT consecutive nodes become the digest of their hex digests, level by level,
until one is left, the group's subroot; the subroots in order of the groups form one more
tree, whose root stands for the dataset.

A subtree of CHUNK leaves is built in one task. Its parents retain a copy of the hash
state before each child's slot, so that a replaced leaf is folded by resuming the state
of its slot with the new digest and the siblings to its right only. What lies above a
chunk is the same for all its leaves: one row of siblings a chunk, whose states are
prepared once and resumed for each leaf.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgrain.llm.shared import stored

FANOUT = 8
#: Levels of a subtree that one task builds, and the leaves below it.
LEVELS = 4
CHUNK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At every level: a node's place in its run and the digests of the run's other nodes.
PATH = "array<struct<slot: int, left: string, right: string>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself, or - if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(group, id, leaf, tampered) for every row of docs: group is its lang; tampered is the
    leaf of the row with A-Z in its text in lower case, where 3 divides the CRC-32 of its
    decimal doc_id, else null (rows without an id too)."""
    columns = {c: F.col(c) for c in FIELDS}
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    other = leaf_digest([*(columns[c] for c in FIELDS[:-1]), tampered_text(F.col("text"))])
    return docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("id"), leaf_digest(list(columns.values())).alias("leaf"), F.when(chosen, other).alias("tampered"))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds pos (from 0) and size: a row's place among its group's rows by ``order`` (nulls
    first) and their number. Rows are spread by ranges of (group, order), so that a group of
    any size is numbered by many tasks; a table of the ranges' counts gives each its start.
    Rows that agree in all of this are told apart by their number in the input."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "tie"]
    spread = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).drop("tie")
    spread = stored(spread, "merkle-ranges")
    # a range holds few groups or a group few ranges: together no more than groups and ranges
    counts = spread.groupBy("part", group).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy(group).orderBy("part")
    starts = counts.select(
        F.col("part").alias("p"), F.col(group).alias("g"), "first", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(group)).alias("size")
    )
    met = spread.join(starts, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return met.withColumn("pos", F.col("row") - F.col("first") + F.col("start")).drop("part", "row", "p", "g", "first", "start")


class Subtree:
    """Up to CHUNK consecutive nodes and the ``levels`` levels above them."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.levels = [nodes]
        self.states: list[list] = []
        for _ in range(levels):
            below, above, states = self.levels[-1], [], []
            for at in range(0, len(below), FANOUT):
                state = hashlib.sha256()
                for child in below[at : at + FANOUT]:
                    states.append(state.copy())
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.levels.append(above)
            self.states.append(states)

    def siblings(self, at: int) -> list[tuple[int, bytes, bytes]]:
        """For node ``at``, at every level: its slot, and the other digests of its run."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % FANOUT
            out.append((at - first, b"".join(nodes[first:at]), b"".join(nodes[at + 1 : first + FANOUT])))
            at //= FANOUT
        return out

    def fold(self, at: int, digest: bytes) -> bytes:
        """The top digest with node ``at`` replaced: at every level the state before its slot
        goes on with the new digest and the siblings to its right."""
        for nodes, states in zip(self.levels[:-1], self.states, strict=True):
            state = states[at].copy()
            state.update(digest)
            state.update(b"".join(nodes[at + 1 : at - at % FANOUT + FANOUT]))
            digest, at = state.hexdigest().encode(), at // FANOUT
        return digest


class UpperPath:
    """The levels above a chunk, as its siblings; the states before its slots are kept."""

    def __init__(self, path: list[dict]):
        self.steps = [(hashlib.sha256(step["left"].encode()), step["right"].encode()) for step in path]
        self.proof = b"".join((step["left"] + step["right"]).encode() for step in path)

    def fold(self, digest: bytes) -> bytes:
        for left, right in self.steps:
            state = left.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def depth(size: int) -> int:
    """Levels above ``size`` nodes until one is left."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FANOUT), levels + 1
    return levels


def _subtree(table: pa.Table, done: int, levels: int) -> Subtree:
    return Subtree([d.encode() for d in table.column("digest").to_pylist()], max(0, min(levels, depth(table.column("size")[0].as_py()) - done)))


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [("pos", "ascending")]))


def _chunk(levels: int) -> Column:
    return F.expr(f"pos div {FANOUT**levels}")


def tops(nodes: DataFrame, done: int = 0) -> DataFrame:
    """(group, pos, size, digest) one row for each CHUNK of nodes(group, pos, size, digest):
    the digest LEVELS higher, or the group's single one. size stays that of the leaves."""
    levels = LEVELS

    def build(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        top = _subtree(table, done, levels).levels[-1]
        return pa.table({"group": table.column("group")[:1], "pos": table.column("chunk")[:1], "size": table.column("size")[:1], "digest": [top[0].decode()]})

    return nodes.select("group", "pos", "size", "digest", _chunk(levels).alias("chunk")).groupBy("group", "chunk").applyInArrow(build, "group string, pos long, size long, digest string")


def paths(nodes: DataFrame, above: DataFrame, done: int) -> DataFrame:
    """(group, pos, path, top): for nodes(group, pos, size, digest), the siblings at the levels
    of their chunk's subtree and then those of ``above`` (group, pos, path, top) for the chunk."""
    levels = LEVELS

    def climb(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = _in_order(table)
        tree = _subtree(table, done, levels)
        rest, top = upper.column("path")[0].as_py(), upper.column("top")[0].as_py()
        rows = [[{"slot": s, "left": a.decode(), "right": b.decode()} for s, a, b in tree.siblings(at)] + rest for at in range(table.num_rows)]
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("left", pa.string()), ("right", pa.string())]))
        return pa.table({"group": table.column("group"), "pos": table.column("pos"), "path": pa.array(rows, kind), "top": pa.array([top] * table.num_rows, pa.string())})

    low = nodes.withColumn("chunk", _chunk(levels)).groupBy("group", "chunk")
    return low.cogroup(above.groupBy("group", "pos")).applyInArrow(climb, f"group string, pos long, path {PATH}, top string")


def climbed(nodes: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(subroots, chunk paths) of nodes(group, pos, size, digest), the leaves: subroots(group,
    digest), and for every chunk of leaves (group, pos, path up to the subroot, top: it)."""
    levels, done, most = [], 0, longest
    at = nodes
    while True:
        at = stored(tops(at, done), "merkle-tops")
        levels.append(at)
        done, most = done + LEVELS, -(-most // CHUNK)
        if most <= 1:
            break
    subroots = at.select("group", "digest")
    up = at.select("group", "pos", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("digest").alias("top"))
    for k in range(len(levels) - 2, -1, -1):
        up = stored(paths(levels[k], up, (k + 1) * LEVELS), "merkle-paths")
    return subroots, up


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, chunks) of the tree over leaves(group, id, leaf, ...).

    leaves gets pos and size, its place in its group by id (rows without one
    first; equal ids by leaf) and the group's size. chunks(group, pos, subroot,
    path, root) has one row for each CHUNK of a group's leaves, path being the
    siblings at all levels above the chunk, through the subroot to the root.
    Groups are ordered null first, then by bytes. An empty table gives no rows.
    """
    placed = stored(ranked(leaves, "group", ["id", "leaf"]), "merkle-leaves")
    longest = placed.agg(F.max("size")).first()[0] or 0
    subroots, low = climbed(placed.select("group", "pos", "size", F.col("leaf").alias("digest")), longest)
    named = ranked(subroots.withColumns({"name": F.col("group"), "group": F.lit("")}), "group", ["name"])
    named = stored(named, "merkle-subroots")
    count = named.count()
    roots, high = climbed(named.select("group", "pos", "size", "digest"), count)
    trees = stored(paths(named.select("group", "pos", "size", "digest"), high, 0), "merkle-roots").select(F.col("pos").alias("at"), F.col("path").alias("rest"), F.col("top").alias("root"))
    last = named.select(F.col("name").alias("g"), "pos", F.col("digest").alias("subroot")).withColumnRenamed("pos", "at").join(trees, "at").drop("at")
    chunks = low.join(last, F.col("group").eqNullSafe(F.col("g"))).select("group", "pos", "subroot", F.concat("path", "rest").alias("path"), "root")
    return placed, stored(chunks, "merkle-chunks")


FOLDED = "group string, id long, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def folded(leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of FOLDED for leaves(group, id, pos, size, leaf, tampered): the digest of each
    leaf's siblings up to the root, and the root with tampered, where it is not null, in the
    leaf's place."""
    levels = LEVELS

    def fold(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = _in_order(table)
        leaf = [x.encode() for x in table.column("leaf").to_pylist()]
        tree, above = Subtree(leaf, min(levels, depth(table.column("size")[0].as_py()))), UpperPath(upper.column("path")[0].as_py())
        proofs, roots = [], []
        for at, other in enumerate(table.column("tampered").to_pylist()):
            proof = hashlib.sha256()
            for _, left, right in tree.siblings(at):
                proof.update(left)
                proof.update(right)
            proof.update(above.proof)
            proofs.append(proof.hexdigest())
            roots.append(above.fold(tree.fold(at, other.encode() if other else leaf[at])).decode())
        same = {c: pa.array([upper.column(c)[0].as_py()] * table.num_rows, pa.string()) for c in ("subroot", "root")}
        return pa.table({**{c: table.column(c) for c in ("group", "id", "pos", "leaf")}, **same, "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string())})

    low = leaves.select("group", "id", "pos", "size", "leaf", "tampered", _chunk(levels).alias("chunk")).groupBy("group", "chunk")
    return low.cogroup(chunks.groupBy("group", "pos")).applyInArrow(fold, FOLDED)


def check_documents(docs: DataFrame) -> DataFrame:
    """The manifest of docs with every row's proof, and its root after some are tampered with.

    One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified. Repeated rows are leaves of their own, next to
    each other; rows without an id stand first in their language and are not
    tampered with; null texts stay. Texts are hashed whole. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    placed, chunks = manifest(stored(leaves_of(docs), "merkle-hashes"))
    return folded(placed, chunks).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def is_tampered(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL for the rows of ``query``: every level as a recursive query, every proof by joins."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    crc = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"

    def levels(name: str, start: str) -> str:
        return f"""{name}(g, level, pos, m, h) AS (SELECT g, 0, pos, m, h FROM {start} UNION ALL
      SELECT g, level + 1, pos // {FANOUT}, (max(m) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE m > 1 GROUP BY g, level, pos // {FANOUT}),
    {name}_run AS MATERIALIZED (SELECT g, level, pos // {FANOUT} AS r, list(h ORDER BY pos) AS hs FROM {name} WHERE m > 1 GROUP BY ALL)"""

    def climb(name: str, start: str, tree: str) -> str:
        left, right = (f"array_to_string(hs[{a}:{b}], '')" for a, b in (("1", f"t.pos % {FANOUT}"), (f"t.pos % {FANOUT} + 2", "len(hs)")))
        return f"""{name}(k, g, level, pos, cur, proof, top) AS (SELECT k, g, 0, pos, cur, proof, m = 1 FROM {start} UNION ALL
      SELECT k, t.g, t.level + 1, t.pos // {FANOUT}, sha256({left} || cur || {right}), proof || {left} || {right}, NOT EXISTS (SELECT 1 FROM {tree}_run n WHERE n.g IS NOT DISTINCT FROM t.g AND n.level = t.level + 1)
      FROM {name} t JOIN {tree}_run r ON r.g IS NOT DISTINCT FROM t.g AND r.level = t.level AND r.r = t.pos // {FANOUT})"""

    return f"""WITH RECURSIVE e AS (SELECT doc_id, lang, text, {head} AS head, {crc} % 3 = 0 AS chosen FROM documents),
    d AS (SELECT doc_id, lang AS g, sha256(head || {field("text")}) AS h, CASE WHEN chosen THEN sha256(head || {field(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS other FROM e),
    p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m, row_number() OVER () AS k FROM d),
    {levels("low", "p")},
    s AS MATERIALIZED (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM low WHERE m = 1),
    {levels("high", "s")},
    begun AS (SELECT k, g, pos, coalesce(other, h) AS cur, '' AS proof, m FROM p),
    {climb("up", "begun", "low")},
    middle AS (SELECT k, s.g, s.pos, cur, proof, m FROM up JOIN s ON s.name IS NOT DISTINCT FROM up.g WHERE top),
    {climb("over", "middle", "high")}
    SELECT doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.h AS verified
    FROM p JOIN s ON s.name IS NOT DISTINCT FROM p.g JOIN over ON over.k = p.k AND top JOIN high r ON r.m = 1"""
