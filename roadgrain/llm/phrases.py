"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation and line breaks, and a piece's words into
chunks that content triggers: a window of OVERLAP words whose hash divides by
TRIGGER ends a chunk, and the next begins with that window. Equal passages are thus cut
alike wherever they stand, and the corpus becomes a dictionary of chunks with
frequencies. Phrases are counted in each chunk of the dictionary once, weighted by its
frequency; one that begins inside the closing window is counted by the next chunk, so
every occurrence counts once.

Longer phrases are counted only where both shorter ones they hold are frequent (a
phrase is never more frequent than its parts). A filter of fixed size, sent to all
tasks, tells which are; it may let rarer ones pass, whose exact counts drop them then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgrain.llm.shared import stored
from roadgrain.llm.words import chunks, mix, span_hashes

# fixed values of the contract
LONGEST, LEAST, TOP = 4, 30, 2000
SEPARATORS = r"[.,;:!?\x0A-\x0D]"
#: Words that two neighbouring chunks share; a phrase of one more still lies in one of them.
OVERLAP = LONGEST - 1
#: One window in so many ends a chunk.
TRIGGER = 16
#: Bits of the filter of frequent phrases (the size of what is broadcast: 16 MB), and how many a phrase sets.
FILTER_BITS, PROBES = 1 << 27, 2
#: Bytes of dictionary that are counted at once.
COUNT_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_SPLIT = np.zeros(256, bool)
_SPLIT[[*b".,;:!?", 10, 11, 12, 13]] = True


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        out = out * _BASE + words[j : len(out) + j]
    return mix(out)


def parse(texts: pa.Array, trigger_of: int = TRIGGER) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """The chunks of whole texts, in groups of texts: (text number, words joined by spaces,
    whether its piece ends with it)."""
    for part in chunks(texts):
        data = part.lowered()
        split = _SPLIT[data]
        inside = ~(split | (data == 32) | (data == 9))
        edge = np.zeros(len(data) + 1, bool)
        edge[part.offsets] = True
        starts = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~edge[:-1]))
        ends = np.flatnonzero(inside & ~(np.concatenate([inside[1:], [False]]) & ~edge[1:])) + 1
        if not len(starts):
            continue
        # a piece begins with a word of another text, or after a separator
        owner = np.searchsorted(part.offsets, starts, "right") - 1
        marks = np.concatenate([[0], np.cumsum(split)])
        fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (marks[starts[1:]] != marks[ends[:-1]])])
        piece = np.cumsum(fresh)
        n = len(starts)
        # windows that trigger: a chunk ends with them and the next begins there
        window = _windows(span_hashes(data, starts, ends), OVERLAP)
        trigger = np.zeros(n, bool)
        trigger[: len(window)] = (window % np.uint64(trigger_of) == 0) & (piece[: len(window)] == piece[OVERLAP - 1 :])
        first = np.flatnonzero(fresh | trigger)
        final = np.concatenate([fresh[first[1:]], [True]])
        last = np.concatenate([first[1:], [n]]) + np.where(final, 0, OVERLAP)
        # every word with one space behind it, then the chunks as spans of that
        lengths = ends - starts + 1
        at = np.concatenate([[0], np.cumsum(lengths)])
        compact = np.full(at[-1], 32, np.uint8)
        compact[np.arange(at[-1]) - np.repeat(at[:-1], lengths) < np.repeat(lengths - 1, lengths)] = data[inside]
        a, b = at[first], at[last] - 1
        offsets = np.concatenate([[0], np.cumsum(b - a)])
        joined = compact[np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], b - a)]
        yield part.first + owner[first], pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined)), final


def parsed(docs: DataFrame) -> DataFrame:
    """(lang, chunk, final, count): the dictionary of all texts' chunks (null text: none; null
    lang: und), with how often each stands in them."""
    trigger_of = TRIGGER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            for owner, chunk, final in parse(batch.column("text"), trigger_of):
                columns = [pc.take(lang, pa.array(owner)), chunk.cast(pa.string()), pa.array(final)]
                counted = pa.table(columns, names=["lang", "chunk", "final"]).group_by(["lang", "chunk", "final"]).aggregate([([], "count_all")])
                yield from counted.select(["lang", "chunk", "final", "count_all"]).rename_columns(["lang", "chunk", "final", "count"]).combine_chunks().to_batches()

    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, chunk string, final boolean, count long")
    return each.groupBy("lang", "chunk", "final").agg(F.sum("count").alias("count"))


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(hashes + np.uint64(k)) % np.uint64(bits) for k in range(PROBES)]


class Phrases:
    """The words of dictionary rows and the hashes of their phrases."""

    def __init__(self, table: pa.Table):
        chunk = table.column("chunk").combine_chunks().cast(pa.large_string())
        _, offsets, data = chunk.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        base = self.offsets[0]
        self.data, self.offsets = np.frombuffer(data, np.uint8)[base : self.offsets[-1]], self.offsets - base
        space = np.flatnonzero(self.data == 32)
        self.starts = np.sort(np.concatenate([self.offsets[:-1], space + 1]))
        self.ends = np.sort(np.concatenate([self.offsets[1:], space]))
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1
        names = table.column("lang").combine_chunks().dictionary_encode()
        seed = np.array([hash_of(x) for x in names.dictionary.to_pylist()], np.uint64)
        self.seed = seed[names.indices.to_numpy()][self.row]
        self.words = span_hashes(self.data, self.starts, self.ends)

    def hashes(self, width: int) -> np.ndarray:
        """A hash of the language and the ``width`` words from every word on."""
        window = _windows(self.words, width)
        return mix(window + self.seed[: len(window)])

    def whole(self, width: int) -> np.ndarray:
        """Whether the ``width`` words from a word on lie in one row."""
        n = max(0, len(self.words) - width + 1)
        return self.row[:n] == self.row[width - 1 : width - 1 + n]


def hash_of(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(data, np.zeros(1, np.int64), np.array([len(data)], np.int64))[0])


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches joined to about ``least`` bytes each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def counted(dictionary: DataFrame, width: int, frequent=None) -> DataFrame:
    """(lang, phrase, count) of the phrases of ``width`` words of dictionary(lang, chunk, final,
    count), all occurrences, LEAST or more. frequent: a broadcast filter of the shorter ones;
    a phrase goes unless both that it holds pass. Within a task phrases are told apart by 64
    bits of hash, between tasks by their words."""
    least = COUNT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, least):
            if not table.num_rows:
                continue
            p = Phrases(table)
            keep = p.whole(width)
            n = len(keep)
            # a row's last words are the closing window of its chunk, unless its piece ends there
            final = table.column("final").combine_chunks().to_numpy(zero_copy_only=False)
            left = np.searchsorted(p.row, p.row[:n], "right") - np.arange(n)
            keep &= final[p.row[:n]] | (left > OVERLAP)
            if frequent is not None and n:
                bits = np.frombuffer(frequent.value, np.uint8)
                short = p.hashes(width - 1)
                known = np.ones(len(short), bool)
                for probe in _probes(short, 8 * len(bits)):
                    known &= (bits[probe >> np.uint64(3)] >> (probe & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
                keep &= known[:n] & known[1 : n + 1]
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            _, one, group = np.unique(p.hashes(width)[at], return_index=True, return_inverse=True)
            weights = table.column("count").combine_chunks().to_numpy()[p.row[at]]
            sums = np.zeros(len(one), np.int64)
            np.add.at(sums, group, weights)
            at = at[one]
            a, b = p.starts[at], p.ends[at + width - 1]
            offsets = np.concatenate([[0], np.cumsum(b - a)])
            text = p.data[np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], b - a)]
            phrase = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
            lang = pc.take(table.column("lang").combine_chunks(), pa.array(p.row[at]))
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(sums)], ["lang", "phrase", "count"])

    each = dictionary.mapInArrow(run, "lang string, phrase string, count long")
    return each.groupBy("lang", "phrase").agg(F.sum("count").alias("count")).where(F.col("count") >= LEAST)


def frequent_filter(phrases: DataFrame, width: int):
    """A broadcast filter of FILTER_BITS bits that holds all of phrases(lang, phrase); its size
    does not depend on their number. Tasks make the words of 64 bits that are not zero."""
    size = FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = Phrases(pa.table({"chunk": batch.column("phrase"), "lang": batch.column("lang")}))
                for probe in _probes(p.hashes(width)[np.searchsorted(p.starts, p.offsets[:-1])], size):
                    yield pa.RecordBatch.from_arrays([pa.array(probe.astype(np.int64))], ["bit"])

    words = phrases.mapInArrow(run, "bit long").groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    bits = np.zeros(size // 64, np.int64)
    for batch in words.toArrow().to_batches():
        bits[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): counts(lang, k, phrase, count) of all phrases of 1 to LONGEST words
    that occur LEAST times or more; totals(lang, n), all words."""
    dictionary = stored(parsed(docs), "phrase-dictionary")
    spaces = F.length("chunk") - F.length(F.replace(F.col("chunk"), F.lit(" "), F.lit(""))) + 1
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("count") * (spaces - F.when(F.col("final"), 0).otherwise(OVERLAP))).alias("n"))
    levels, frequent = [], None
    for k in range(1, LONGEST + 1):
        level = stored(counted(dictionary, k, frequent), f"phrases-{k}")
        levels.append(level.select("lang", F.lit(k).alias("k"), "phrase", "count"))
        if k < LONGEST:
            frequent = frequent_filter(level, k)
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.union(level)
    return counts, totals


def _words(a: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("words", a, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, score) of the phrases of two words or more: of the cuts in
    two that with the lowest score floor(2000000 a / (l + r)), the first of equal ones."""
    phrases = counts.where("k > 1").withColumn("words", F.split("phrase", " "))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "k", "phrase", F.col("count").alias("a"), "cut", _words(1, F.col("cut")).alias("first"), _words(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("count").alias(count))
    met = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    best = met.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "k", "phrase", "a", "best.l", "best.r", "best.score")


def without_parts(phrases: DataFrame) -> DataFrame:
    """phrases but those that a longer one contains which is 80 % as frequent or more."""
    longer = phrases.where("k > 2").withColumn("words", F.split("phrase", " ")).withColumn("n", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1))).select("lang", _words(F.col("at"), F.col("n")).alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    covered = F.expr("longest is not null and cast(longest as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * 80")
    return phrases.join(most, ["lang", "phrase"], "left").where(~covered).drop("longest")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations.

    A-Z are lowered; pieces end at .,;:!? and line breaks; words are what spaces
    and tabs part. a, l and r are all occurrences of the phrase and its two
    parts, n all words of the language. Null texts have no words, a null lang is
    und; equal scores go by a, then by the phrase's bytes. Repeated rows count
    each time; other columns are ignored; an empty table gives no rows. The
    first ranking runs in buckets of a language, so that no task orders all
    of a large one; only their first ``top`` meet. With c candidates neither
    ranking gives a task many more than sqrt(c * top).
    """
    counts, totals = phrase_counts(docs)
    kept = stored(without_parts(stored(scored(counts), "phrase-scores")), "phrase-candidates")
    buckets = max(1, math.ceil(math.sqrt(kept.count() / top)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = kept.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranks = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranks.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL for the rows of ``query``, with every phrase of every piece."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '{SEPARATORS}')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
    g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) AS phrase FROM w, range(1, {LONGEST + 1}) t(k)),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
    n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
    cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS head, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS tail FROM f, range(1, {LONGEST}) t(cut) WHERE cut < k),
    s AS (SELECT c.*, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail),
    b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    q AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(a) AS longest FROM b, range(2, {LONGEST}) t(m), range(1, {LONGEST}) u(i) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
    c AS (SELECT b.* FROM b LEFT JOIN q USING (lang, phrase) WHERE NOT coalesce(100 * longest >= 80 * a, false)),
    z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= {TOP}"""
