"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 17
#: A larger rate is cut into equal parts that are drawn by themselves: a sum of Poisson numbers
#: is one. This bounds the tables of probabilities, and so what is broadcast.
MAX_RATE = 64.0
#: Copy numbers of one part; no table has as many entries.
STRIDE = 256
#: Production weights: twenty sources, each twice as heavy as the one four steps on.
WEIGHTS = {f"src{i}": 2.0 ** -(i // 4) for i in range(20)}


def uniform(key: Column, seed: int) -> Column:
    """A hash-seeded uniform number in (0, 1) for a key: 32 bits of an MD5."""
    return (_md5_number(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}"), digits=8).cast("double") + 0.5) / 4294967296.0


def _md5_number(*parts: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, digits), 16, 10).cast("long")


def target_rates(docs: DataFrame, weights: dict[str, float], source: str = "source", total: float | None = None) -> dict[str, float]:
    """The mean repetition of the documents of each weighted source that has any.

    rate = weight share * total / documents of the source, with total = the
    number of documents unless given; the weights are normalised over these
    sources. All documents are counted; at most len(weights) counts and the
    total come to the driver.
    """
    if any(not w >= 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    name = F.col(source).cast("string")
    listed = F.when(name.isin(list(weights)), name) if weights else F.lit(None).cast("string")
    counts = {r[0]: r[1] for r in docs.groupBy(listed.alias("source")).agg(F.count("*")).collect()}
    rows = float(total) if total is not None else float(sum(counts.values()))
    mass = sum(w for s, w in weights.items() if s in counts)
    return {s: w / mass * rows / counts[s] for s, w in weights.items() if s in counts and w > 0}


def poisson_cdf(rate: float) -> list[float]:
    """Cumulative Poisson probabilities of 0, 1, ... far into the tail; the terms come
    from their logarithms."""
    last = math.ceil(rate + 12 * math.sqrt(rate) + 20)
    return list(accumulate(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(last + 1)))


def mix_sources(docs: DataFrame, weights: dict[str, float], seed: int = SEED, total: float | None = None, id_col: str = "doc_id", source: str = "source", keep_unweighted: bool = False) -> DataFrame:
    """docs with each row repeated a Poisson number of times and the whole shuffled.

    The count of a row inverts the Poisson distribution whose mean is its
    source's rate at a number hashed from its id and the seed; a row with
    count 0 goes. A rate over MAX_RATE is cut into parts, each with a number of
    its own. Adds copy (0, 1, ..., and from STRIDE * p on for part p) and
    shuffle_key, by which the rows are spread and sorted: a seeded random global
    order. Columns of those names are
    replaced. Repeated rows have equal ids, so equal counts. A null id hashes
    as an empty string. Rows of sources without a weight (null sources among
    them) go, or stay once with ``keep_unweighted``. Empty tables stay empty.
    """
    plain = docs.drop("copy", "shuffle_key")
    spark, rates = docs.sparkSession, target_rates(docs, weights, source, total)
    # one row per weighted source with at most STRIDE numbers: len(weights) bounds the broadcast side
    parts = {s: max(1, math.ceil(r / MAX_RATE)) for s, r in rates.items()}
    small = spark.createDataFrame([(s, parts[s], poisson_cdf(r / parts[s])) for s, r in rates.items()], "name string, parts int, cdf array<double>")
    # the row in a struct: its columns may have any name
    row = F.struct(*[F.col(f"`{c}`") for c in plain.columns])
    keyed = plain.select(row.alias("row"), F.col(source).cast("string").alias("name"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    joined = keyed.join(F.broadcast(small), "name", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    key = F.when(F.col("part") == 0, F.col("id")).otherwise(F.concat("id", F.lit("|part"), F.col("part").cast("string")))
    drawn = joined.withColumn("u", uniform(key, seed))
    unlisted = F.col("name").isNull() | ~F.col("name").isin(list(weights)) if weights else F.lit(True)
    count = F.when(F.col("cdf").isNotNull(), F.size(F.filter("cdf", lambda p: p < F.col("u")))).when(F.lit(keep_unweighted) & unlisted, 1).otherwise(0)
    counted = drawn.withColumn("n", count).where("n > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    out = counted.withColumn("copy", F.col("part").cast("long") * STRIDE + F.col("at"))
    key = _md5_number(F.col("id"), F.lit("|"), F.col("copy").cast("string"), F.lit(f"|{seed}"), digits=15)
    out = out.select("row.*", "copy", key.alias("shuffle_key"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key", id_col, "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS)


def oracle(weights: dict[str, float] = WEIGHTS, seed: int = SEED, docs: str = "documents") -> str:
    """DuckDB SQL with the rows of mix_sources(docs, weights, seed)."""
    listed = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in weights.items())
    return f"""
    WITH weights(source, w) AS (VALUES {listed}),
    counts AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
    live AS (SELECT source, w, n FROM weights JOIN counts USING (source) WHERE w > 0),
    rates AS (SELECT source, w / (SELECT sum(w) FROM live) * (SELECT count(*) FROM {docs}) / n AS rate FROM live),
    terms AS (SELECT source, parts, k, exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) AS p
              FROM (SELECT *, greatest(1, CAST(ceil(rate / {MAX_RATE}) AS BIGINT)) AS parts FROM rates), LATERAL (SELECT unnest(range(0, CAST(ceil(rate / parts + 12 * sqrt(rate / parts) + 20) AS BIGINT) + 1)) AS k)),
    cdf AS (SELECT source, parts, list(c ORDER BY k) AS c
            FROM (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source, parts),
    dealt AS (SELECT d.*, c, unnest(range(0, parts)) AS part FROM {docs} d JOIN cdf USING (source)),
    drawn AS (SELECT *, len(list_filter(c, lambda x: x < (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN part > 0 THEN '|part' || part ELSE '' END || '|{seed}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) AS n
              FROM dealt),
    copies AS (SELECT * EXCLUDE (n, c, part), part * {STRIDE} + unnest(range(0, n))::BIGINT AS copy FROM drawn WHERE n > 0)
    SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy || '|{seed}'), 1, 15))::BIGINT AS shuffle_key FROM copies"""
