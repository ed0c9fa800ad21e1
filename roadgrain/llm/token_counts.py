"""Token counts per section by offset-mapped attribution.

Each whole document is encoded once. The byte lengths of its tokens give their
spans, which are joined to the section spans by binary search; a token that
crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: first / last: the whole token goes to the section of its first / last byte;
#: share: each section gets the share of the token's bytes that lies in it.
RULES = ("first", "last", "share")
SECTION = "struct<name:string,start:long,end:long>"


def line_bounds(raw: bytes) -> np.ndarray:
    """Byte bounds of the lines of a text; a line's newline belongs to it."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1, [len(raw)]])


def field_sections(*columns: str, separator: str = "\n") -> tuple[Column, Column]:
    """(text, sections) that join several columns (null: empty) into one document."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    at, out = F.lit(0).cast("long"), []
    for c, v in zip(columns, values, strict=True):
        out.append(F.struct(F.lit(c).alias("name"), at.alias("start"), (at + F.length(v)).alias("end")))
        at = at + F.length(v) + len(separator)
    return F.concat_ws(separator, *values), F.array(*out)


def attribute(bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each span [start, end) in bytes; bounds: the tokens'
    byte bounds, one more than there are tokens. Spans may overlap."""
    if rule == "first":
        tokens = np.searchsorted(bounds[:-1], ends) - np.searchsorted(bounds[:-1], starts)
    elif rule == "last":
        tokens = np.searchsorted(bounds[1:] - 1, ends) - np.searchsorted(bounds[1:] - 1, starts)
    else:
        place = np.arange(len(bounds), dtype=float)
        tokens = np.interp(ends, bounds, place) - np.interp(starts, bounds, place)
    touching = np.where(ends > starts, np.searchsorted(bounds[:-1], ends) - np.searchsorted(bounds[1:], starts, "right"), 0)
    inside = np.maximum(0, np.searchsorted(bounds[1:], ends, "right") - np.searchsorted(bounds[:-1], starts))
    return np.maximum(tokens, 0), np.maximum(touching - inside, 0)


def count_tokens(docs: DataFrame, sections: Column | None = None, tokenizer_path: str | None = None, rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens) per section of a row.

    sections: array of (name, start, end) in code points, end exclusive; spans
    are cut to the text. Default: the text's lines. With the rules first and
    last, sections that divide the text get whole numbers that add up to
    doc_tokens. n_crossing counts tokens that lie only partly in the section.
    A null text has no sections; an empty one has an empty first line. Repeated
    rows are counted alike; other columns are ignored; an empty table gives no
    rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer_path or public_tokenizers.path(TOKENIZER_FILE)
    pattern, given = public_tokenizers.PATTERN, sections is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc", "start", "end", "n", "crossing", "total")}
            texts, names = batch.column("text").to_pylist(), []
            if given:
                spans = batch.column("sections")
                flat = spans.flatten()
                name, start, end = flat.field(0).to_pylist(), flat.field(1).fill_null(0).to_numpy(), flat.field(2).fill_null(0).to_numpy()
                sizes = [v or 0 for v in pa.compute.list_value_length(spans).to_pylist()]
            at = 0
            for doc, text in enumerate(texts):
                raw = (text or "").encode()
                points = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) if len(raw) > len(text or "") else np.arange(len(raw))
                points = np.append(points, len(raw))
                if given:
                    k = sizes[doc]
                    a, b = (np.clip(x[at : at + k], 0, len(points) - 1) for x in (start, end))
                    names += name[at : at + k]
                    at += k
                elif text is not None:
                    bounds = np.searchsorted(points, line_bounds(raw))
                    a, b, k = bounds[:-1], bounds[1:], len(bounds) - 1
                    names += map(str, range(k))
                else:
                    k = 0
                if not k:
                    continue
                bounds = np.concatenate([[0], np.cumsum(lengths[np.array(encoding.encode_ordinary(text or ""), np.int64)])])
                n, crossing = attribute(bounds, points[a], points[b], rule)
                for key, v in (("doc", np.full(k, doc)), ("start", a), ("end", b), ("n", n), ("crossing", crossing), ("total", np.full(k, len(bounds) - 1))):
                    out[key].append(v)
            if names:
                many = {k: np.concatenate(v) for k, v in out.items()}
                columns = [batch.column("doc_id").take(pa.array(many["doc"])), pa.array(names, pa.string()), *[pa.array(many[k].astype(np.int64)) for k in ("start", "end")]]
                columns += [pa.array(many["n"].astype(float if rule == "share" else np.int64)), pa.array(many["crossing"]), pa.array(many["total"])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    chosen = F.lit(None) if sections is None else sections
    schema = f"doc_id long, section string, start long, end long, n_tokens {'double' if rule == 'share' else 'long'}, n_crossing long, doc_tokens long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text", chosen.cast(f"array<{SECTION}>").alias("sections")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
