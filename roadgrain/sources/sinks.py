"""Sinks of streams whose batches may come twice: nothing is written double, and readers see
whole batches only.

A batch is written to a folder of its own; then its line is added to a manifest, which is
a new file swapped in last. Readers take the folders that the newest manifest names. A
batch whose id the manifest holds is passed over; one that failed half way left a folder
that no manifest names, and is written again beside it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

LEDGER = "_ledger"
#: Manifests that stay besides the newest, for readers that began with one of them.
KEPT = 3


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI: local, or one that pyarrow reaches."""
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:", uri) else (fs.LocalFileSystem(), uri)


class Ledger:
    """The manifest of a table: batch id -> its folder. Each version is a file of its own, whole
    before it gets its name; the highest number counts."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.store, root = located(self.path)
        self.folder = f"{root}/{LEDGER}"

    def _versions(self) -> list[int]:
        if self.store.get_file_info(self.folder).type != fs.FileType.Directory:
            return []
        names = (f.base_name for f in self.store.get_file_info(fs.FileSelector(self.folder)))
        return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n))

    def read(self) -> tuple[int, dict[str, str]]:
        versions = self._versions()
        if not versions:
            return 0, {}
        with self.store.open_input_stream(f"{self.folder}/{versions[-1]:010d}.json", compression=None) as f:
            return versions[-1], json.loads(f.read())

    def add(self, batch: str, folder: str) -> None:
        version, held = self.read()
        self.store.create_dir(self.folder, recursive=True)
        draft = f"{self.folder}/draft-{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps(held | {batch: folder}).encode())
        self.store.move(draft, f"{self.folder}/{version + 1:010d}.json")
        for old in self._versions()[: -KEPT - 1]:
            self.store.delete_file(f"{self.folder}/{old:010d}.json")


def once(path: str, query: str, write: Callable[[DataFrame, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes every batch of ``query`` once, whatever is run
    again. write(df, folder): how a batch is written, Parquet by default."""
    put = write or (lambda df, folder: df.write.parquet(folder))

    def batch(df: DataFrame, batch_id: int) -> None:
        ledger, name = Ledger(path), f"{query}/{batch_id}"
        if name in ledger.read()[1]:
            return
        folder = f"batch-{query}-{batch_id}-{uuid.uuid4().hex}"
        put(df, f"{ledger.path}/{folder}")
        ledger.add(name, folder)

    return batch


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that the newest manifest names."""
    ledger = Ledger(path)
    folders = sorted(ledger.read()[1].values())
    return spark.read.schema(schema).parquet(*[f"{ledger.path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)
