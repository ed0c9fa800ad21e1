"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from roadgrain.llm.words import Chunk, chunks, mix, repeated, span_hashes

#: Largest share of a document's word characters inside n-grams (of so many words)
#: that the document holds twice or more. They act below the base rule's share of words
#: in repeated 3-grams, and above what documents labelled good reach (0.28, 0.28 and 0.16).
COVERAGE = {5: 0.32, 8: 0.30, 13: 0.20}
#: Largest share of its lines, and of its characters in lines, that repeat an earlier line.
DUP_LINES, DUP_LINE_CHARS = 0.50, 0.30
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50

FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "n_lines": pa.int64(), "line_chars": pa.int64(), "dup_line_chars": pa.int64(),
} | {f"dup_{n}_gram_chars": pa.int64() for n in COVERAGE}


def _per(owner_first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values within each document, given each document's first index."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[owner_first])


def covered_words(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its document holds twice or more."""
    if len(words) < n:
        return np.zeros(len(words), bool)
    rolled = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C55) + words[j : len(rolled) + j]
    at = np.flatnonzero(doc[: len(rolled)] == doc[n - 1 :])
    twice = at[repeated(mix(mix(rolled[at]) + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) > 0]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(chunk: Chunk) -> dict[str, np.ndarray]:
    """FIELDS of every document of the chunk."""
    d, (starts, ends, first) = chunk.data, chunk.words()
    doc = np.repeat(np.arange(len(chunk)), np.diff(first))
    points = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    words = span_hashes(d, starts, ends)
    a, b, first_line = chunk.lines()
    line_doc = np.repeat(np.arange(len(chunk)), np.diff(first_line))
    has_word = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    again = has_word & (repeated(mix(span_hashes(d, a, b) + line_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) == 2)
    line_chars = points[b] - points[a]
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    out = {
        "n_words": np.diff(first), "word_chars": _per(first, chars), "n_symbols": _per(chunk.offsets, is_symbol[d]),
        "n_dup_lines": _per(first_line, again), "n_repeat_words": _per(first, covered_words(words, doc, 3)),
        "n_lines": _per(first_line, has_word), "line_chars": _per(first_line, line_chars), "dup_line_chars": _per(first_line, line_chars * again),
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    bad = out["base_failed"] | (out["n_dup_lines"] > DUP_LINES * out["n_lines"]) | (out["dup_line_chars"] > DUP_LINE_CHARS * out["line_chars"])
    for n, most in COVERAGE.items():
        inside = out[f"dup_{n}_gram_chars"] = _per(first, chars * covered_words(words, doc, n))
        bad = bad | (inside > most * out["word_chars"])
    return out | {"kept": ~bad}


def measure_texts(texts: pa.Array) -> list[pa.Array]:
    """FIELDS as Arrow columns, one value for each text."""
    parts = [measure(c) for c in chunks(texts)]
    return [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0), kind) for k, kind in FIELDS.items()]


def quality_metrics(docs: DataFrame) -> DataFrame:
    """doc_id and FIELDS of every row, measured over its whole text.

    Null and empty texts have no words, so base_failed. Repeated rows give
    repeated results; other columns are ignored; no shuffle takes place.
    """
    names = {"int64": "long", "bool": "boolean"}
    schema = "doc_id long, " + ", ".join(f"{k} {names[str(v)]}" for k, v in FIELDS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *measure_texts(batch.column("text"))], ["doc_id", *FIELDS])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(FIELDS).index("kept")
        for batch in batches:
            yield batch.filter(measure_texts(batch.column("text"))[kept])

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_metrics(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL for the rows of ``query``: n-grams as joined words, without hashes."""
    grams, marks, sums = [], [], []
    for n in (3, *COVERAGE):
        grams.append(f"CASE WHEN i + {n - 1} <= max(i) OVER (PARTITION BY r) THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g{n}")
        marks.append(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 AS t{n}")
        sums.append(f"bool_or(t{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}")
    word = r"[^\x20\x09-\x0D]"
    covered = ", ".join(f"coalesce(sum(length(word)) FILTER (c{n}), 0) AS dup_{n}_gram_chars" for n in COVERAGE)
    names = ["n_words", "word_chars", "n_repeat_words", *(f"dup_{n}_gram_chars" for n in COVERAGE)]
    whole = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in names)
    limits = " OR ".join(f"dup_{n}_gram_chars > {most}e0 * word_chars" for n, most in COVERAGE.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{word}+') AS ws FROM d)),
    g AS (SELECT r, i, word, {", ".join(grams)} FROM w), t AS (SELECT r, i, word, {", ".join(marks)} FROM g), c AS (SELECT r, word, {", ".join(sums)} FROM t),
    by_words AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {covered} FROM c GROUP BY r),
    l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)),
    again AS (SELECT *, regexp_matches(line, '{word}') AS has_word, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS seen FROM l),
    by_lines AS (SELECT r, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (has_word AND seen) AS n_dup_lines, CAST(sum(length(line)) AS BIGINT) AS line_chars, CAST(coalesce(sum(length(line)) FILTER (has_word AND seen), 0) AS BIGINT) AS dup_line_chars FROM again GROUP BY r),
    m AS (SELECT doc_id, {whole}, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_lines, n_dup_lines, line_chars, dup_line_chars FROM d LEFT JOIN by_words USING (r) LEFT JOIN by_lines USING (r)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT *, NOT (base_failed OR n_dup_lines > {DUP_LINES}e0 * n_lines OR dup_line_chars > {DUP_LINE_CHARS}e0 * line_chars OR {limits}) AS kept FROM b"""
