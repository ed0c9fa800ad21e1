"""N-gram Jaccard self-join of documents with signature trees.

A document is the set of hashes of its 5-word shingles; two link when their
Jaccard similarity is at least 0.8, in integers 9 * shared >= 4 * (a + b).

1. Every text gives its set's size, digest, a token bitmap (its length by classes
   of size, so that none is ever full) and its 16 smallest hashes. Equal sets are one node from here on.
2. Nodes that share one of those hashes meet in a task. Linked sets of up to 75
   shingles always share one (their 16 hold the exact prefix of the prefix
   filter); larger ones miss with a chance under 0.2 ** 16 a link. A signature
   tree over the task's nodes (OR-combined bitmaps, size ranges) is traversed
   against itself; pairs that the bounds cannot exclude join one cluster.
3. Each cluster's texts are read again, once, and the same traversal, now with
   the exact sets, verifies pairs until every bound-passing pair is decided or
   already connected. Verified links give the components.

Groups and clusters over BLOCK nodes are cut into blocks, every two of which
meet in a task of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import connected_components, stored
from roadgrain.llm.words import chunks, shingle_sets

KEYS, WIDTH = 16, 5
#: Sets of up to LEAST shingles have bitmaps of 2 * LEAST bits; every quadrupling of the
#: size is a class of its own, with bitmaps of four times the bits.
LEAST = 1024
BLOCK = 8192
FANOUT = 16
#: Node pairs tried in one numpy step.
STEP = 256
#: Stands for a row without an id: ids from 2 ** 62 on are not used.
NODE = "coalesce(cast(doc_id as long), 4611686018427387904 + pmod(xxhash64(coalesce(text, '')), 4611686018427387904))"


def size_classes(n: int) -> list[int]:
    """The classes in which a set of n shingles is compared: its own, and the one below if a
    set of that class could be similar enough."""
    own = 0
    while n > LEAST << 2 * own:
        own += 1
    return [own - 1, own] if own and 4 * n <= 5 * (LEAST << 2 * (own - 1)) else [own]


def bitmap(tokens: np.ndarray) -> bytes:
    """The bits of a set's tokens, as many as its class asks for."""
    width = 2 * LEAST << 2 * size_classes(len(tokens))[-1]
    bits = np.zeros(width, np.uint8)
    bits[(tokens >> np.uint64(20)) % np.uint64(width)] = 1
    return np.packbits(bits).tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of uint64 words, all folded to the shortest one's length."""
    words = min(map(len, bitmaps)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), 0) for x in bitmaps])


class SignatureTree:
    """Nodes over sets sorted by size: OR of the bitmaps, least and largest size, and the
    most tokens by which a set exceeds its own bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        extra = sizes - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, extra)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, e = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(e, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether some pair of sets below nodes i and j can reach the threshold."""
        bits, low, high, extra = self.levels[level]
        a, b = low[i], low[j]
        out = (5 * high[i] >= 4 * b) & (5 * high[j] >= 4 * a)
        k = np.flatnonzero(out)
        shared = np.bitwise_count(bits[i[k]] & bits[j[k]]).sum(1).astype(np.int64) + np.minimum(extra[i[k]], extra[j[k]])
        out[k] = 9 * shared >= 4 * (a[k] + b[k])
        return out

    def children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unordered pairs of children of node pairs (i <= j)."""
        n = len(self.levels[level - 1][1])
        x = (i[:, None, None] * FANOUT + np.arange(FANOUT)[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
        y = (j[:, None, None] * FANOUT + np.arange(FANOUT)[None, None, :] + np.zeros((1, FANOUT, 1), np.int64)).ravel()
        fits = (x < n) & (y < n) & ((x < y) | ((level > 1) & (x == y)))
        return x[fits], y[fits]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a[k] and b[k] for each k."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    return label


def components(sizes: np.ndarray, bits: np.ndarray, verify: Callable[[int, int], bool] | None) -> np.ndarray:
    """A label per set: the index of its component's first set. Links are the pairs that
    pass the bounds and, if given, verify. Pairs already connected are skipped."""
    order = np.argsort(sizes, kind="stable")
    tree = SignatureTree(sizes[order], bits[order])
    label = np.arange(len(sizes))
    top = len(tree.levels) - 1
    pending = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))] if top else []
    while pending:  # depth first, nearest pairs first, so that labels soon prune
        level, i, j = pending.pop()
        if level:
            spread = FANOUT**level
            at = np.arange(0, len(label), spread)
            low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            i, j = i[open_], j[open_]
            ok = tree.may_link(level, i, j)
            i, j = i[ok], j[ok]
            steps = []
            for k in range(0, len(i), STEP):
                x, y = tree.children(level, i[k : k + STEP], j[k : k + STEP])
                near = np.argsort(y - x, kind="stable")
                steps.append((level - 1, x[near], y[near]))
            pending.extend(reversed(steps))
            continue
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        ok = tree.may_link(0, i, j)
        i, j = i[ok], j[ok]
        if verify is None:
            label = _merge(label, i, j)
            continue
        while len(i):  # one pair for each component that could join a smaller label
            x, y = label[i], label[j]
            apart = x != y
            i, j, high = i[apart], j[apart], np.maximum(x, y)[apart]
            _, pick = np.unique(high, return_index=True)
            good = np.array([verify(int(order[a]), int(order[b])) for a, b in zip(i[pick], j[pick], strict=True)], bool)
            if len(pick):
                label = _merge(label, i[pick][good], j[pick][good])
            rest = np.ones(len(i), bool)
            rest[pick] = False
            i, j = i[rest], j[rest]
    out = np.empty(len(sizes), np.int64)
    out[order] = order[label]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole tasks: rows sorted by task, and where each task begins (and the end)."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        task = table.column("task").to_numpy()
        last = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
        if last or (held and held[-1].column("task")[-1].as_py() != task[0]):
            done = pa.concat_tables([*held, table.slice(0, last)]).combine_chunks()
            if done.num_rows:
                t = done.column("task").to_numpy()
                yield done, np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
            held = [table.slice(last)]
        else:
            held.append(table)
    if held:
        done = pa.concat_tables(held).combine_chunks()
        t = done.column("task").to_numpy()
        yield done, np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))


def tree_links(tasks: DataFrame, exact: bool) -> DataFrame:
    """Edges (src, dst) that span each task's components: tasks(task, node, n, bits[, tokens]),
    partitioned and sorted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _groups(batches):
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
            bits = table.column("bits").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()] if exact else None
            label = np.arange(len(n))
            size = np.diff(begins)
            two = begins[:-1][size == 2]
            least = np.array([min(len(bits[k]), len(bits[k + 1])) for k in two.tolist()])
            for width in [] if exact else np.unique(least).tolist():  # all tasks of two nodes at once
                k = two[least == width]
                rows = np.arange(len(k))
                pair = SignatureTree(np.concatenate([n[k], n[k + 1]]), folded([bits[x] for x in k.tolist()] + [bits[x + 1] for x in k.tolist()]))
                label[k + 1] = np.where(pair.may_link(0, rows, rows + len(k)), k, k + 1)
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                if b - a > 2 or (exact and b - a > 1):
                    part = sets[a:b] if exact else None

                    def verify(x: int, y: int, part: list | None = part) -> bool:
                        shared = len(part[x]) + len(part[y]) - len(np.union1d(part[x], part[y]))
                        return 9 * shared >= 4 * (len(part[x]) + len(part[y]))

                    label[a:b] = a + components(n[a:b], folded(bits[a:b]), verify if exact else None)
            joined = np.flatnonzero(label != np.arange(len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[label[joined]])], ["src", "dst"])

    return tasks.mapInArrow(run, "src long, dst long")


def _tasks(members: DataFrame, key: str, count: str) -> DataFrame:
    """members with the task(s) in which each meets the others of its key and size class: one,
    or one for every two blocks where the key has more than BLOCK members."""
    blocks = F.ceil(F.col(count) / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("__other")
    out = members.select("*", mine.alias("__mine"), other).withColumn("__class", F.explode("classes"))
    task = F.xxhash64(key, "__class", F.least("__mine", "__other"), F.greatest("__mine", "__other"))
    return out.withColumn("task", task).drop("__mine", "__other", "__class", "classes", key, count)


def _dealt(tasks: DataFrame) -> DataFrame:
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(n, "task").sortWithinPartitions("task")


def sketch(docs: DataFrame) -> DataFrame:
    """(node, doc_id, n, digest, keys, bits, classes) of every row's whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                sets = shingle_sets(chunk, WIDTH)
                part = batch.slice(chunk.first, len(chunk))
                columns = [
                    part.column("node"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:KEYS].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([size_classes(len(s)) for s in sets], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "doc_id", "n", "digest", "keys", "bits", "classes"])

    schema = "node long, doc_id long, n long, digest binary, keys array<long>, bits binary, classes array<int>"
    return docs.selectExpr(f"{NODE} as node", "cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def _token_sets(texts: DataFrame) -> DataFrame:
    """(node, cluster, size, n, bits, classes, tokens) of texts(node, cluster, size, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                sets = shingle_sets(chunk, WIDTH)
                part = batch.slice(chunk.first, len(chunk))
                columns = [part.column(c) for c in ("node", "cluster", "size")] + [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([bitmap(s) for s in sets], pa.binary()),
                    pa.array([size_classes(len(s)) for s in sets], pa.list_(pa.int32())),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "cluster", "size", "n", "bits", "classes", "tokens"])

    return texts.select("node", "cluster", "size", "text").mapInArrow(run, "node long, cluster long, size long, n long, bits binary, classes array<int>, tokens binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(node, doc_id, n_shingles, component) for every row of docs.

    node is the row's doc_id, or a number from 2 ** 62 on for a row without one;
    component is the smallest node reachable by links. Rows with one doc_id are
    one document: what any of its texts links with, it links with. Texts without
    words (null, empty, blank) have no shingles and link with nothing. Repeated
    rows give repeated results; other columns are ignored; an empty table gives
    no rows.
    """
    rows = stored(sketch(docs), "ngram-sketch")
    sets = rows.where("n > 0").groupBy("digest").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("classes").alias("classes"))
    sets = stored(sets, "ngram-sets")
    held = sets.select("node", F.explode("keys").alias("key"))
    shared = held.groupBy("key").agg(F.count("*").alias("count")).where("count > 1")
    members = held.join(shared, "key")
    groups = _tasks(members.join(sets.select("node", "n", "bits", "classes"), "node"), "key", "count")
    candidates = tree_links(_dealt(groups), exact=False).distinct()
    clusters = stored(connected_components(candidates), "ngram-clusters").withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    texts = docs.selectExpr(f"{NODE} as node", "text").join(clusters.join(sizes, "cluster"), "node")
    exact = tree_links(_dealt(_tasks(_token_sets(texts), "cluster", "size")), exact=True)
    linked = connected_components(exact)
    named = sets.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("node"))
    return rows.select("node", "doc_id", "n", "digest").join(named, "digest", "left").select("node", "doc_id", F.col("n").alias("n_shingles"), own.alias("component"))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of docs, columns unchanged, that stand for their group: one row of the
    smallest doc_id of each component."""
    stay = near_duplicates(docs).where("node = component").select("node").distinct()
    # the row in a struct: its columns may have any name
    rows = docs.select(F.expr(NODE).alias("node"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(stay, "node").dropDuplicates(["node"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    none = F.col("component") >= F.lit(1 << 62)
    return got.select("doc_id", "n_shingles", F.when(~none, F.col("component")).alias("component_id"))


def oracle() -> str:
    """DuckDB SQL for the rows of ``query``: the sets as joined words, every pair that shares one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
      FROM (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
    g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM w),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM g WHERE i + 4 <= n OR i = 1), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    met AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    p AS MATERIALIZED (SELECT i, j FROM met JOIN size x ON x.doc_id = i JOIN size y ON y.doc_id = j WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
    reach(i, j) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.i, p.j FROM reach r JOIN p ON p.i = r.j),
    c AS (SELECT i AS doc_id, min(j) AS component_id FROM reach GROUP BY i)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN size USING (doc_id)"""
