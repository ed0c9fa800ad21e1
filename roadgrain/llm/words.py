"""Words, lines and rolling hashes of whole texts, in numpy, over Arrow batches.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r.
Nothing here cuts a text: ``chunks`` only groups whole documents so that the
working arrays stay near ``CHUNK_BYTES`` (or one document, if that is longer).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
LONG = 512
_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    """The first n powers (mod 2^64) of the base, or of its inverse."""
    have = _POWERS[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POWERS[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of one running polynomial. Modulo a
    power of two, long spans that swap two bytes in Thue-Morse order would be equal: spans
    of LONG bytes and more are hashed one by one."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data)), out=total[1:])
    out = mix((total[ends] - total[starts]) * _powers("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts >= LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Chunk:
    """Whole documents as one byte array; document i is data[offsets[i]:offsets[i+1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each document (n + 1 values)."""
        d = self.data
        inside = ~((d == 32) | ((d >= 9) & (d <= 13)))
        edge = np.zeros(len(d) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines (split at \\n), and the first line of each document."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([self.offsets[1:], breaks])
        owner = np.concatenate([np.arange(len(self)), np.searchsorted(self.offsets, breaks, "right") - 1])
        order = np.lexsort((starts, owner))
        ends_order = np.lexsort((ends, owner))
        return starts[order], ends[ends_order], np.searchsorted(owner[order], np.arange(len(self) + 1))

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z in lower case."""
        d = self.data
        return d + np.where((d >= 65) & (d <= 90), np.uint8(32), np.uint8(0))


def chunks(texts: pa.Array) -> Iterator[Chunk]:
    """Whole texts (null: empty) in groups of about CHUNK_BYTES."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, len(texts))
        part = offsets[first : last + 1]
        yield Chunk(first, data[part[0] : part[-1]], part - part[0])
        first = last


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, 0: it occurs once; 1: the first of several; 2: a later one."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), np.int8)
    out[order] = np.where(same, 2, np.where(np.concatenate([same[1:], [False]]), 1, 0)) if len(keys) else 0
    return out


def shingle_sets(chunk: Chunk, width: int = 5) -> list[np.ndarray]:
    """Per document, the sorted distinct hashes of its word shingles (A-Z lowered).

    With fewer words than the width, the whole sequence is one shingle; without words, none.
    """
    starts, ends, first = chunk.words()
    w = span_hashes(chunk.lowered(), starts, ends)
    full = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for j in range(width):
        full = full * np.uint64(_BASE) + w[j : len(full) + j]
    full, out = mix(full), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            h = b - a
            for x in w[a:b].tolist():
                h = (h * 0xD6E8FEB86659FD93 + x) & _MASK
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
