"""Packing documents into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import stored

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4096
#: Pieces per packing block: the unit that one task balances.
BLOCK_DOCS = 2048
#: Entries of a worker's word memo before it is emptied.
MEMO_WORDS = 400_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _byte_alphabet() -> dict[str, int]:
    """The public byte-level BPE alphabet: printable bytes stand for themselves, the
    others for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordEncoder(dict):
    """A memo from a white-space-separated chunk of UTF-8 to its little-endian uint32 ids.

    The tokenizer's pre-tokenization never joins characters across ASCII white
    space and its normalizer works within such a chunk, so ids(text) is the
    chunks' ids in order. Chunks of ASCII and Latin-1 letters are cut here and
    merged by a byte-pair core that takes the vocabulary as ranks, with byte FF
    (never found in UTF-8) for the word end; the tests show that every entry of
    the vocabulary is reached by its own merge, which makes the two agree. All
    other chunks go to the tokenizer itself.
    """

    _SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    _CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    _ADDED = ("<|startoftext|>", "<|endoftext|>")

    def __init__(self, path: str):
        from tiktoken._tiktoken import CoreBPE
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, alphabet = Tokenizer.from_file(path), _byte_alphabet()
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if token not in self._ADDED:
                body, end = (token[:-4], b"\xff") if token.endswith("</w>") else (token, b"")
                ranks[bytes(alphabet[c] for c in body) + end] = i
        self.merge, self.pieces = CoreBPE(ranks, {}, "x").encode_single_piece, {}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self._SIMPLE.fullmatch(text) and "<|" not in text:
            out = b""
            for piece in self._CUT.findall(text.lower()):
                ids = self.pieces.get(piece)
                if ids is None:
                    ids = self.pieces[piece] = array("I", self.merge(piece.encode() + b"\xff")).tobytes()
                out += ids
        else:
            out = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[chunk] = out
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian uint32 ids of each UTF-8 text."""
        if len(self) > MEMO_WORDS:
            self.clear()
            self.pieces.clear()
        find = self.__getitem__
        return [b"".join(map(find, t.split())) for t in texts]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) for pieces of at most ``capacity`` ids.

    A document's ids are its whole text's (null: empty) plus ``end_id``, so an
    empty document has one id. Long documents are cut into full windows and a
    rest. ids: little-endian uint32. Repeated rows are encoded again; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(tokenizer_path), np.uint32(end_id).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "ids")}
                texts = part.column("text").fill_null("").cast(pa.binary()).to_pylist()
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    for cut in range(0, len(ids), 4 * capacity):
                        piece = ids[cut : cut + 4 * capacity]
                        for k, v in (("doc_id", doc), ("start", cut // 4), ("length", len(piece) // 4), ("doc_tokens", len(ids) // 4), ("ids", piece)):
                            rows[k].append(v)
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, PIECES)


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: (part of each item, sum of each part) for k parts.

    Every item starts as a partition with one filled part. The two partitions
    with the widest spread are merged, the fullest part of one with the emptiest
    of the other, until one partition is left.
    """
    n, steps = len(sizes), []
    sums = [None] * n
    for i, s in enumerate(sizes.tolist()):
        sums[i] = np.zeros(k, np.int64)
        sums[i][k - 1] = s  # ascending
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(total, kind="stable")
        sums[a] = sums[b] = None
        sums.append(total[order])
        steps.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    root = heap[0][1]
    places: dict[int, np.ndarray] = {root: np.arange(k)}
    for at in range(len(steps) - 1, -1, -1):
        a, b, order = steps[at]
        mine = places.pop(n + at)
        slots = np.empty(k, np.int64)
        slots[order] = mine
        places[a], places[b] = slots, slots[::-1]
    return np.array([places[i][k - 1] for i in range(n)], np.int64), sums[root]


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window (0, 1, ...) of each piece: as few near-equal windows as differencing
    fits under the capacity; the count rises while the fullest window exceeds it."""
    windows = np.full(len(sizes), -1, np.int64)
    full = np.flatnonzero(sizes == capacity)
    windows[full] = np.arange(len(full))
    rest = np.flatnonzero(sizes < capacity)
    if len(rest):
        k = max(1, -(-int(sizes[rest].sum()) // capacity))
        while True:
            part, sums = differencing(sizes[rest], k)
            if sums.max() <= capacity:
                break
            k += max(1, int((sums.max() - capacity) * k // (4 * capacity)))
        windows[rest] = len(full) + part
    return windows


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, start, length, ...).

    The pieces are numbered and stored, and blocks of about ``block_docs`` pieces
    chosen by a hash of the number, so that no block or task grows with the
    corpus, however often a doc_id (null too) repeats; each block is balanced by
    itself and its windows are numbered within its own range of ids. Within a
    block the pieces are ordered by length, document, start and number, so a
    lost task gives the same windows again.
    """
    kinds = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        block = table.column("__block")[0].as_py()
        table = table.drop_columns(["__block"])
        table = table.take(pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("__row", "ascending")])).drop_columns(["__row"])
        sizes = table.column("length").to_numpy()
        window = pack_block(sizes, capacity)
        order = np.lexsort((np.arange(len(sizes)), window))
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], np.diff(window[order]) != 0])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return table.append_column("sequence_id", pa.array((block << 24) + window)).append_column("offset", pa.array(offset))

    numbered = stored(pieces.select(*[f.name for f in kinds], F.monotonically_increasing_id().alias("__row")), "pieces")
    blocks = max(1, -(-numbered.count() // block_docs))
    keyed = numbered.withColumn("__block", F.expr(f"pmod(xxhash64(__row), {blocks}L)"))
    return keyed.groupBy("__block").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids (null text: empty) laid out in windows of at most ``capacity``.

    Returns one row per piece: doc_id, start, length, doc_tokens, ids (binary,
    little-endian uint32), sequence_id and offset.
    """
    pieces = encode_documents(docs, tokenizer_path or public_tokenizers.path(TOKENIZER_FILE), end_id, capacity)
    return pack_pieces(pieces, capacity)


def packed_digest(docs: DataFrame) -> DataFrame:
    """pack_documents with a CRC-32 (unsigned, of the little-endian ids) in place of the ids."""
    pieces = encode_documents(docs, public_tokenizers.path(TOKENIZER_FILE))
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(digest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
