"""Prediction documents as a data source: ``spark.read.format("predictions").load(path)``.

A partition reads some documents, by their bytes; filters on video_id are pushed to it, so that other
videos' entries are not turned into rows. What is wrong with a document is a row too, with
a problem in place of an event (and no video_id, where it is the whole document's), and
never stops the others.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from roadgrain.sources.sinks import located

ROWS = "file string, team string, video_id string, pos int, start double, `end` double, label string, problem string"
#: Rows of one Arrow batch.
BATCH_ROWS = 8192
#: Bytes, and documents, that one partition reads (a larger document by itself).
SPLIT_BYTES, SPLIT_FILES = 16 << 20, 1000


class _Refused(ValueError):
    pass


def _object(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise _Refused("a key stands twice in one object")
    return dict(pairs)


def _no_number(text: str) -> float:
    raise _Refused(f"{text} is no JSON number")


def parsed(text: bytes) -> object:
    """Strict JSON: repeated keys and numbers that JSON lacks are refused."""
    return json.loads(text, object_pairs_hook=_object, parse_constant=_no_number)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def rows_of(file: str, text: bytes, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    """The rows of one document, of the wanted videos or all."""
    bad = lambda problem, team=None, video=None, pos=None: (file, team, video, pos, None, None, None, problem)
    try:
        doc = parsed(text)
    except (ValueError, UnicodeDecodeError, RecursionError) as e:
        yield bad(f"no strict JSON: {e}")
        return
    team = doc.get("team") if isinstance(doc, dict) else None
    team = team if isinstance(team, str) else None
    videos = doc.get("videos") if isinstance(doc, dict) else None
    if not isinstance(videos, dict):
        yield bad("videos must be an object", team)
        return
    for video, entry in videos.items():
        if wanted is not None and video not in wanted:
            continue
        events = entry.get("events") if isinstance(entry, dict) else None
        if not isinstance(events, list):
            yield bad("events must be a list", team, video)
            continue
        for pos, e in enumerate(events):
            if not isinstance(e, list) or len(e) != 3:
                yield bad("an event needs a start, an end and a label", team, video, pos)
            elif not (_number(e[0]) and _number(e[1])):
                yield bad("times must be numbers", team, video, pos)
            elif not isinstance(e[2], str):
                yield bad("a label must be a text", team, video, pos)
            else:
                yield file, team, video, pos, float(e[0]), float(e[1]), e[2], None


@dataclass
class Documents(InputPartition):
    paths: list[str]


class PredictionReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.wanted = uri, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership of video_id; all else stays Spark's."""
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is None or f.attribute != ("video_id",) or not all(isinstance(n, str) for n in names):
                yield f
            else:
                self.wanted = frozenset(names if self.wanted is None else self.wanted & names)

    def partitions(self) -> list[Documents]:
        store, root = located(self.uri)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [], 0
        for path, n in sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", "."))):
            if not out or size + n > SPLIT_BYTES or len(out[-1].paths) == SPLIT_FILES:
                out.append(Documents([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Documents | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        store, _ = located(self.uri)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string()]
        names = [c.split()[0].strip("`") for c in ROWS.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows = []
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as f:
                text = f.read()
            for row in rows_of(path, text, self.wanted):
                # a problem of the whole document belongs to no video, so a filter on videos drops it
                if self.wanted is None or row[2] in self.wanted:
                    rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class PredictionSource(DataSource):
    """Format "predictions"; path: a document or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "predictions"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> PredictionReader:
        return PredictionReader(self.options["path"])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all documents under a path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PredictionSource)
    return spark.read.format("predictions").load(path)
