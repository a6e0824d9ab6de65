"""The small text files of a log directory: the manifest and the compaction catalog."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import CATALOG, MANIFEST_SUFFIX
from .wal import log_files

# Lines of a compaction catalog, and format versions of a manifest.
HEADER, FOOTER = "COMPACTION_CATALOG_HEADER", "COMPACTION_CATALOG_FOOTER"
FILE_KEY, DETACHED_KEY, EPOCH_KEY, BLOB_KEY = "COMPACTED_FILE", "DETACHED_PWAL", "MAX_EPOCH_ID", "MAX_BLOB_ID"
FORMAT_VERSION, PERSISTENT_VERSION, ROTATES_BELOW = "1.1", 7, 6


class BadDirectory(Exception):
    """A manifest or catalog that can't be used."""


@dataclass(frozen=True)
class Manifest:
    persistent_format_version: int = PERSISTENT_VERSION
    format_version: str = FORMAT_VERSION
    instance_uuid: str = ""

    @classmethod
    def new(cls) -> Manifest:
        return cls(instance_uuid=str(uuid.uuid4()))

    @classmethod
    def loads(cls, text: str) -> Manifest:
        """From JSON; BadDirectory if it isn't a manifest."""
        try:
            found = json.loads(text)
            form, version = found["format_version"], found["persistent_format_version"]
            instance = "" if form == "1.0" else found["instance_uuid"]
        except (ValueError, KeyError, TypeError) as e:
            raise BadDirectory(f"no manifest: {e!r}") from e
        if not isinstance(form, str) or not isinstance(version, int) or not isinstance(instance, str):
            raise BadDirectory("no manifest: a field has another type")
        return cls(version, form, instance)

    def dumps(self) -> str:
        fields = {"format_version": self.format_version, "persistent_format_version": self.persistent_format_version}
        if self.format_version != "1.0":
            fields["instance_uuid"] = self.instance_uuid
        return json.dumps(fields)

    def check(self) -> None:
        """BadDirectory unless the persistent format is one of those that can be read."""
        if not 1 <= self.persistent_format_version <= PERSISTENT_VERSION:
            raise BadDirectory(f"version mismatch: version {self.persistent_format_version}, 1 to {PERSISTENT_VERSION} can be read")

    def migrated(self) -> tuple[Manifest, bool]:
        """The manifest in the newest format, and whether the logs written before must be rotated."""
        self.check()
        fresh = Manifest(PERSISTENT_VERSION, FORMAT_VERSION, self.instance_uuid or str(uuid.uuid4()))
        return fresh, self.persistent_format_version < ROTATES_BELOW


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(name, format_version, persistent_format_version, instance_uuid, supported) of the manifests of directories."""
    text = log_files(spark, path, f"*{MANIFEST_SUFFIX}").select("name", F.from_json(F.decode("content", "UTF-8"), "format_version string, persistent_format_version int, instance_uuid string").alias("m"))
    return text.select("name", "m.*", F.coalesce(F.col("m.persistent_format_version").between(1, PERSISTENT_VERSION), F.lit(False)).alias("supported"))


@dataclass
class Catalog:
    """What has been compacted: files with their version, logs that went into them, and the largest epoch and object id."""

    max_epoch: int = 0
    max_blob: int = 0
    files: dict[str, int] = field(default_factory=dict)
    detached: set[str] = field(default_factory=set)

    @classmethod
    def loads(cls, text: str) -> Catalog:
        """From its text; BadDirectory if the header, the footer or the epoch is missing, or a line means nothing."""
        lines = text.split("\n")
        if lines[0] != HEADER:
            raise BadDirectory(f"no catalog header: {lines[0]!r}")
        if FOOTER not in lines:
            raise BadDirectory("no catalog footer")
        out, epoch = cls(), None
        for line in lines[1 : lines.index(FOOTER)]:
            key, *rest = line.split() or [""]
            try:
                if key == FILE_KEY:
                    out.files[rest[0]] = int(rest[1])
                elif key == DETACHED_KEY:
                    out.detached.add(rest[0])
                elif key == EPOCH_KEY:
                    epoch = out.max_epoch = int(rest[0])
                elif key == BLOB_KEY:
                    out.max_blob = int(rest[0])
                elif key:
                    raise BadDirectory(f"unknown catalog entry: {key}")
            except (IndexError, ValueError) as e:
                raise BadDirectory(f"bad catalog line: {line!r}") from e
        if epoch is None:
            raise BadDirectory(f"no {EPOCH_KEY} in the catalog")
        return out

    def dumps(self) -> str:
        entries = [f"{FILE_KEY} {n} {v}" for n, v in sorted(self.files.items())] + [f"{DETACHED_KEY} {n}" for n in sorted(self.detached)]
        return "\n".join([HEADER, *entries, f"{EPOCH_KEY} {self.max_epoch}", f"{BLOB_KEY} {self.max_blob}", FOOTER, ""])

    @classmethod
    def read(cls, path: str) -> Catalog:
        """Of a mounted directory; from the backup, which then takes the catalog's place, if the catalog can't be read."""
        name = os.path.join(path, CATALOG)
        try:
            with open(name, encoding="utf-8") as f:
                return cls.loads(f.read())
        except (OSError, BadDirectory):
            with open(f"{name}.back", encoding="utf-8") as f:
                found = cls.loads(f.read())
            os.replace(f"{name}.back", name)
            return found

    def write(self, path: str) -> None:
        """To a mounted directory; the catalog before it stays as backup until the new one is whole."""
        name = os.path.join(path, CATALOG)
        if os.path.exists(name):
            os.replace(name, f"{name}.back")
        with open(f"{name}.tmp", "w", encoding="utf-8") as f:
            f.write(self.dumps())
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{name}.tmp", name)


def catalog_rows(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, number) of a catalog's entries, from any store."""
    fields = F.split("value", " ")
    kind = fields[0]
    return spark.read.text(f"{path}/{CATALOG}").filter(kind.isin(FILE_KEY, DETACHED_KEY, EPOCH_KEY, BLOB_KEY)).select(
        kind.alias("kind"),
        F.when(kind.isin(FILE_KEY, DETACHED_KEY), fields[1]).alias("name"),
        F.when(kind == FILE_KEY, F.try_element_at(fields, F.lit(3))).when(kind.isin(EPOCH_KEY, BLOB_KEY), fields[1]).cast("long").alias("number"),
    )


def set_up(path: str, manifest_name: str) -> Manifest:
    """Makes a mounted directory a log directory: a manifest by this name, an empty epoch file and an empty catalog, each only
    where it is missing."""
    if not manifest_name.endswith(MANIFEST_SUFFIX):
        raise ValueError(f"a manifest's name ends with {MANIFEST_SUFFIX}")
    os.makedirs(path, exist_ok=True)
    name = os.path.join(path, manifest_name)
    if not os.path.exists(name):
        with open(f"{name}.tmp", "w", encoding="utf-8") as f:
            f.write(Manifest.new().dumps())
        os.replace(f"{name}.tmp", name)
    with open(os.path.join(path, "epoch"), "ab"):
        pass
    if not os.path.exists(os.path.join(path, CATALOG)):
        Catalog().write(path)
    with open(name, encoding="utf-8") as f:
        return Manifest.loads(f.read())

