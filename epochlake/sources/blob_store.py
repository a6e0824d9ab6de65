"""Large objects on a mounted folder: where they lie, pools of new ones, copies."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import BLOB_DIRECTORIES, blob_path


class BadBlob(Exception):
    """An object that isn't there or can't be stored."""


@dataclass(frozen=True)
class Blob:
    """An object's file; true if the file is there."""

    path: Path

    def __bool__(self) -> bool:
        return self.path.is_file()


@dataclass
class BlobPool:
    """New objects of one transaction: each has its id at once, and goes with the pool unless an entry has made it persistent."""

    root: str
    next_id: Callable[[], int]
    ids: list[int] = field(default_factory=list)
    released: bool = False

    def find(self, blob_id: int) -> Blob:
        return Blob(Path(self.root, f"dir_{blob_id % BLOB_DIRECTORIES:02d}", f"{blob_id:016x}.blob"))

    def _new(self, store: Callable[[Path], None]) -> int:
        if self.released:
            raise BadBlob("the pool is released")
        blob_id = self.next_id()
        path = self.find(blob_id).path
        path.parent.mkdir(parents=True, exist_ok=True)
        try:
            store(path)
        except OSError as e:
            path.unlink(missing_ok=True)
            raise BadBlob(f"{path}: {e}") from e
        self.ids.append(blob_id)
        return blob_id

    def register_file(self, file: str, temporary: bool = False) -> int:
        """A file's content as a new object; a temporary file is moved, any other copied."""
        if not os.path.isfile(file):
            raise BadBlob(f"not found: {file}")
        return self._new(lambda to: shutil.move(file, to) if temporary else shutil.copyfile(file, to))

    def register_data(self, data: bytes) -> int:
        """Bytes as a new object, on disk when this returns."""

        def store(to: Path) -> None:
            with open(to, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())

        return self._new(store)

    def duplicate(self, blob_id: int) -> int:
        """A new object of the same content, which is not copied."""
        old = self.find(blob_id)
        if not old:
            raise BadBlob(f"no object {blob_id}: {old.path}")
        return self._new(lambda to: os.link(old.path, to))

    def release(self, persistent: set[int]) -> list[int]:
        """Ends the pool; deletes the objects that aren't among the persistent ones, which lose those of this pool. The ids deleted."""
        self.released = True
        gone = [i for i in self.ids if i not in persistent]
        persistent.difference_update(self.ids)
        for i in gone:
            self.find(i).path.unlink(missing_ok=True)
        self.ids = []
        return gone


#: Paths of a batch that a listing hands on.
LISTED_ROWS = 10_000


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files in the folders of objects below a mounted folder, empty ones too; no rows if there are no folders.

    Each folder is listed by one task when the result is read, so the driver holds no path, and there are no more tasks for more
    objects, as there are where Spark plans to read each file.
    """
    folders = sorted(n for n in os.listdir(root) if n.startswith("dir_")) if os.path.isdir(root) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                with os.scandir(os.path.join(root, folders[i])) as found:
                    paths = []
                    for f in found:
                        paths.append(f.path)
                        if len(paths) == LISTED_ROWS:
                            yield pa.RecordBatch.from_pydict({"path": paths})
                            paths = []
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    tasks = max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(folders), 1, tasks).mapInArrow(run, "path string")


def copy_blobs(ids: DataFrame, root: str, to: str) -> DataFrame:
    """(blob_id, copied): copies the files of ids(blob_id) from one mounted folder to another, each by the task that has it.

    A file is copied under another name and then renamed, so that a copy is whole or not there; an object without a file is
    false. Nothing is copied before the result is read; read again, it copies again.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            done = []
            for path in batch["path"]:
                source, target = Path(root, path), Path(to, path)
                if source.is_file():
                    target.parent.mkdir(parents=True, exist_ok=True)
                    part = target.with_name(f".{target.name}.{os.getpid()}")
                    shutil.copyfile(source, part)
                    os.replace(part, target)
                done.append(source.is_file())
            yield pd.DataFrame({"blob_id": batch["blob_id"], "copied": done})

    return ids.select("blob_id", blob_path("blob_id").alias("path")).mapInPandas(run, "blob_id long, copied boolean").where(F.col("blob_id").isNotNull())
