"""Log directories as DataFrames: a reader for any store, and a data source that reads and writes mounted paths."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.names import ACTIVE_WAL_LENGTH, EPOCH, WAL_PREFIX, base_name, is_epoch_file, is_wal
from ..functions.text import ascii_preview
from ..functions.versions import display, signed
from ..schema import CHANGE_LOG, PARSE_CODES, POINTS, PUTS, SCAN_REPORT, VALID
from .wal_format import DamagedLog, Scan, durable_of, entry, judge, marker, records, settled, sound_entries, strict_records

#: Rows of a batch that the decoder hands on.
BATCH_ROWS = 4096


def decode(name: str, data: bytes, durable: int, most_epoch: int | None = None, on_damage: str = "fail", on_nondurable: str = "keep", columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """A file's entries as batches of change_log rows.

    Snippets above `most_epoch` are skipped while reading. on_nondurable is keep (as rows with that state) or skip. on_damage is
    skip, to end with what could be read, or fail: raise at damage that would make the file unfit to start from.

    Sound records are read by one loop without an object for each; from the first other one on, Scan reads.
    """
    names = columns or CHANGE_LOG.names
    schema = pa.schema([to_arrow_schema(CHANGE_LOG).field(c) for c in names])
    skip = on_nondurable == "skip"

    def batch(found: list) -> pa.RecordBatch:
        held = dict(zip(CHANGE_LOG.names[1:], found, strict=True))
        n = len(found[0])
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, t), n) if c == "file" else pa.array(held[c], t) for c, t in zip(names, schema.types, strict=True)], schema=schema)

    odd = None
    for found in sound_entries(data, durable, BATCH_ROWS, most_epoch, skip):
        if isinstance(found, int):
            odd = found
        elif found[0]:
            yield batch(found)
    if odd is None:  # then nothing was found that a log would be refused for
        return
    scan = Scan(data, durable)
    rows: list[tuple] = []
    for r, number, epoch, state in scan.entries():
        if r.offset < odd or most_epoch is not None and epoch > most_epoch or skip and state != VALID:
            continue
        kind = r.kind
        rows.append((r.offset, number, signed(epoch), state, kind, signed(r.storage_id), r.key if kind in POINTS else None, signed(r.major), signed(r.minor), r.value if kind in PUTS else None, [signed(b) for b in r.blob_ids]))
        if len(rows) == BATCH_ROWS:
            yield batch(list(zip(*rows, strict=True)))
            rows.clear()
    if rows:
        yield batch(list(zip(*rows, strict=True)))
    if on_damage == "fail":
        code = judge(scan.findings)[0]
        detached = len(name) > ACTIVE_WAL_LENGTH
        if settled(code, False, detached) in {PARSE_CODES[c] for c in ("broken_after_marked", "corrupted_durable_entries", "unexpected")} or code == PARSE_CODES["broken_after"] and not detached:
            raise DamagedLog(f"{name}: code {code:#x}")


def log_files(spark: SparkSession, path: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """(name, path, length, content) of the files of a directory in any store that Spark reads; no rows if none match.

    Spark leaves out files of no bytes, and holds a file's content as one value, below 2 GB; a larger file is an error, so
    rotate before.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    columns = [base_name("path").alias("name"), "path", "length", *(["content"] if content else [])]
    return found.select(*columns)


def durable_epoch(spark: SparkSession, path: str) -> int:
    """The directory's durable epoch. Epoch files are rewritten after a hundred epochs, so they are small."""
    files = log_files(spark, path, f"{EPOCH}*").filter(is_epoch_file("name")).collect()
    main = next((bytes(f.content) for f in files if f.name == EPOCH), None)
    return durable_of(main, [bytes(f.content) for f in files if f.name != EPOCH])


def read_log(spark: SparkSession, path: str, durable: int | None = None, files: list[str] | None = None, **options) -> DataFrame:
    """change_log of a directory's log files, one task for each file: the format has no place to split one, so rotate by size.

    durable is the directory's own if not given; files restricts to these names; see decode for the other options.
    """
    durable = durable_epoch(spark, path) if durable is None else durable
    wals = log_files(spark, path, f"{WAL_PREFIX}*").filter(~F.col("name").endswith(".prev"))
    if files is not None:
        wals = wals.filter(F.col("name").isin(files))
    columns = options.get("columns") or CHANGE_LOG.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from decode(b.column("name")[i].as_py(), b.column("content")[i].as_buffer(), durable, **options)

    return wals.select("name", "content").mapInArrow(run, StructType([CHANGE_LOG[c] for c in columns]))


def scan_reports(spark: SparkSession, path: str, durable: int | None = None, policy: str = "report", assume_detached: bool = False) -> DataFrame:
    """scan_report of every log file of a directory under a policy, with the repairs that it asks for. Nothing is written.

    A repair sets all logs aside first; assume_detached judges them so.
    """
    durable = durable_epoch(spark, path) if durable is None else durable
    action = StructType([StructField("offset", LongType()), StructField("action", StringType())])
    schema = StructType([*SCAN_REPORT.fields, StructField("repairs", ArrayType(action))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                name = b.column("name")[i].as_py()
                out.append(report(name, b.column("content")[i].as_buffer(), durable, policy, assume_detached))
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(schema))

    return log_files(spark, path, f"{WAL_PREFIX}*").filter(is_wal("name")).select("name", "content").mapInArrow(run, schema)


def dump(spark: SparkSession, path: str, pattern: str = f"{WAL_PREFIX}*") -> DataFrame:
    """(file, offset, entry_type, epoch_id, epoch, storage_id, key, value) of every record of the files, markers included.

    epoch_id is a marker's own epoch, epoch that of the last begin marker before or at the record, but for begin markers. A file
    that ends with a record that can't be read has a last row of type torn or unknown.
    """
    schema = "file string, offset long, entry_type string, epoch_id long, epoch long, storage_id long, key binary, value binary"
    heads = ("marker_begin", "marker_invalidated_begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, epoch, rows = b.column("name")[i].as_py(), None, []
                for r in records(b.column("content")[i].as_buffer()):
                    marks, point = r.kind.startswith("marker"), r.kind in POINTS
                    if r.kind in heads and not r.torn:
                        epoch = r.epoch
                    kind = "torn" if r.torn else r.kind
                    sound = not r.torn and r.kind != "unknown"
                    rows.append((name, r.offset, kind, signed(r.epoch) if marks and sound else None, None if r.kind == "marker_begin" or epoch is None else signed(epoch), signed(r.storage_id) if sound and not marks else None, r.key if point and sound else None, r.value if r.kind in PUTS and sound else None))
                    if len(rows) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["file", "offset", "entry_type", "epoch_id", "epoch", "storage_id", "key", "value"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return log_files(spark, path, pattern).select("name", "content").mapInArrow(run, schema)


def strict_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, entries, markers) of each log file, by a reading that refuses any record it can't make out (DamagedLog)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                kinds = [r.kind.startswith("marker") for r in strict_records(b.column("content")[i].as_buffer())]
                yield pa.RecordBatch.from_pydict({"file": [b.column("name")[i].as_py()], "entries": [len(kinds) - sum(kinds)], "markers": [sum(kinds)]})

    return log_files(spark, path, f"{WAL_PREFIX}*").select("name", "content").mapInArrow(run, "file string, entries long, markers long")


def dump_lines(dumped: DataFrame) -> DataFrame:
    """(file, offset, line) of a dump: type, epochs, storage, and the first bytes of key and value as ASCII."""
    shown = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f" {label}="), c.cast("string"))).otherwise(F.lit(""))
    parts = [F.col("entry_type"), shown("epoch_id", display("epoch_id")), shown("epoch", display("epoch")), shown("storage_id", display("storage_id")), shown("key", ascii_preview("key")), shown("value", ascii_preview("value"))]
    return dumped.select("file", "offset", F.concat(*parts).alias("line"))


def report(name: str, data: bytes, durable: int, policy: str = "report", assume_detached: bool = False) -> dict:
    """One file's scan_report as a dictionary, with `repairs`."""
    scan = Scan(data, durable)
    for _ in scan.entries():
        pass
    code, at, repairs = judge(scan.findings, policy)
    changed = bool(repairs)
    return {
        "file": name,
        "parse_code": settled(code, changed, assume_detached or len(name) > ACTIVE_WAL_LENGTH),
        "parse_offset": at,
        "max_epoch": signed(scan.max_epoch),
        "entries": scan.entries_in,
        "counted": scan.counted,
        "modified": changed,
        "repairs": [{"offset": o, "action": a} for o, a in repairs],
    }


# ---- a data source for paths that every node mounts


class _LogFile(InputPartition):
    def __init__(self, path: str, durable: int) -> None:
        self.path, self.durable = path, durable


class LogReader(DataSourceReader):
    """One partition for each file. A filter on snippet_epoch from above is applied while a file is read."""

    def __init__(self, options: dict, schema) -> None:
        self.options, self.columns = options, schema.names
        self.path = options["path"]
        self.most: int | None = None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, LessThanOrEqual | LessThan) and f.attribute == ("snippet_epoch",) and f.value is not None:
                bound = f.value - isinstance(f, LessThan)
                self.most = bound if self.most is None else min(self.most, bound)
            else:
                yield f

    def _durable(self) -> int:
        if "durable" in self.options:
            return int(self.options["durable"])
        names = [n for n in os.listdir(self.path) if n.startswith(EPOCH)]
        held = {}
        for n in names:
            with open(os.path.join(self.path, n), "rb") as f:
                held[n] = f.read()
        return durable_of(held.pop(EPOCH, None), list(held.values()))

    def partitions(self):
        durable, wanted = self._durable(), self.options.get("files")
        names = sorted(n for n in os.listdir(self.path) if n.startswith(WAL_PREFIX) and (not wanted or n in wanted.split(",")))
        return [_LogFile(os.path.join(self.path, n), durable) for n in names] or [_LogFile("", durable)]

    def read(self, partition):
        if partition.path:
            with open(partition.path, "rb") as f:
                data = f.read()
            yield from decode(os.path.basename(partition.path), data, partition.durable, self.most, self.options.get("ondamage", "fail"), self.options.get("onnondurable", "keep"), self.columns)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str], epoch: int) -> None:
        self.files, self.epoch = files, epoch


class LogWriter(DataSourceArrowWriter):
    """A new log file for each task: one snippet for each run of rows of an epoch. Data first, then the epoch marker.

    Files are written under a name that no reader takes; the commit renames them and appends the durable epoch, an abort
    deletes them. So readers see all of a write or, until its epoch is durable, none. The option suffix is added to the names.
    """

    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.token = options["path"], uuid.uuid4().hex[:12]
        self.suffix, self.places = options.get("suffix", ""), {c: i for i, c in enumerate(names)}

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        name = f".writing-{self.token}-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        open_epoch, most, any_row, mask = None, 0, False, (1 << 64) - 1
        columns = ("snippet_epoch", "entry_type", "storage_id", "key", "major", "minor", "value", "blob_ids")
        with open(os.path.join(self.path, name), "wb") as f:
            for b in batches:
                out = []
                for epoch, kind, storage, key, major, minor, value, blob_ids in zip(*[b.column(self.places[c]).to_pylist() for c in columns], strict=True):
                    any_row, epoch = True, (epoch or 0) & mask
                    if epoch != open_epoch:
                        if open_epoch is not None:
                            out.append(marker("marker_end", open_epoch))
                        out.append(marker("marker_begin", epoch))
                        open_epoch, most = epoch, max(most, epoch)
                    out.append(entry(kind, (storage or 0) & mask, key or b"", (major or 0) & mask, (minor or 0) & mask, value or b"", [(x or 0) & mask for x in blob_ids] if blob_ids else ()))
                f.write(b"".join(out))
            if open_epoch is not None:
                f.write(marker("marker_end", open_epoch))
            f.flush()
            os.fsync(f.fileno())
        if not any_row:
            os.unlink(os.path.join(self.path, name))
            return _Written([], 0)
        return _Written([name], most)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        taken = {int(n[len(WAL_PREFIX) : ACTIVE_WAL_LENGTH]) for n in os.listdir(self.path) if n.startswith(WAL_PREFIX) and n[len(WAL_PREFIX) : ACTIVE_WAL_LENGTH].isdigit()}
        number = max(taken, default=-1)
        files = sum(len(m.files) for m in done)
        if number + files >= 10 ** (ACTIVE_WAL_LENGTH - len(WAL_PREFIX)) and not self.suffix:
            self.abort(messages)
            raise ValueError(f"{files} logs more than {number + 1}: a longer number would read as that of a log set aside; rotate first")
        for name in (f for m in done for f in m.files):
            number += 1
            os.rename(os.path.join(self.path, name), os.path.join(self.path, f"{WAL_PREFIX}{number:04d}{self.suffix}"))
        epoch = max((m.epoch for m in done), default=0)
        if epoch:
            append_durable(self.path, epoch)

    def abort(self, messages) -> None:
        for n in os.listdir(self.path):
            if n.startswith(f".writing-{self.token}-"):
                os.unlink(os.path.join(self.path, n))


def append_durable(path: str, epoch: int, most_records: int = 100) -> None:
    """Appends an epoch to the epoch file, which is written anew with its largest epoch alone after `most_records`."""
    name = os.path.join(path, EPOCH)
    size = len(marker("marker_durable", 0))
    held = b""
    if os.path.exists(name):
        with open(name, "rb") as f:
            held = f.read()
    if len(held) // size >= most_records:
        epoch = max(epoch, durable_of(held, []))
        with open(f"{name}.tmp", "wb") as f:
            f.write(marker("marker_durable", epoch))
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{name}.tmp", name)
        return
    with open(name, "ab") as f:
        f.write(marker("marker_durable", epoch))
        f.flush()
        os.fsync(f.fileno())


class LogSource(DataSource):
    """spark.read.format("epochlog").load(path), and the same for df.write; options durable, files, onDamage, onNondurable."""

    @classmethod
    def name(cls) -> str:
        return "epochlog"

    def schema(self):
        return CHANGE_LOG

    def reader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()}, schema)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogWriter({k.lower(): v for k, v in self.options.items()}, schema.names)


def register(spark: SparkSession) -> None:
    """Makes the format "epochlog" known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)

