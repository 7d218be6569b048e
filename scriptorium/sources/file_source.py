"""Files as a Spark data source: batches and streams, packed into tasks by bytes, filtered before anything is opened.

``spark.read.format("files").load(folder)`` gives (path, extension, modificationTime, length,
content, error). Options on extension, length, modification time and path are applied to the
listing, so a file outside them is never opened; for any other condition list without content, filter,
and open what is left with open_files(). Spark's own push-down to Python sources isn't used: in Spark 4.1
the filters of one scan stay with the next scan of the same DataFrame. Folders are those that
pyarrow.fs opens from the driver and every executor; for other stores there is
readers.binary_files().
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = "path string, extension string, modificationTime timestamp, length long, content binary, error string"
_ARROW = pa.schema([("path", pa.string()), ("extension", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Bytes of files in a task, what opening one counts as, and bytes in a batch of rows (or one file, if that is larger).
TASK_BYTES, OPEN_BYTES, BATCH_BYTES = 128_000_000, 1_000_000, 8_000_000


@dataclass(frozen=True)
class Entry:
    path: str
    time: datetime
    length: int

    @property
    def extension(self) -> str:
        name = self.path.rpartition("/")[2]
        return name.rpartition(".")[2].lower() if "." in name else ""

    @property
    def micros(self) -> int:
        return (self.time - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)

    def order(self) -> tuple[int, str]:
        return self.micros, self.path


def list_files(folder: str, recursive: bool = True, exclude: tuple[str, ...] = ("node_modules", ".git"), glob: str | None = None) -> list[Entry]:
    """Files under a folder but for hidden ones (``.x``, ``_x``), and those in folders of excluded names."""
    store, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    scheme = folder.split(":", 1)[0] + "://" if ":" in folder and not folder.startswith("file:") else "file:"
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=recursive)):
        inner = info.path.removeprefix(root.rstrip("/")).strip("/").split("/")
        hidden = any(p[:1] in "._" and "=" not in p for p in inner)
        if info.type == fs.FileType.File and not hidden and not set(inner[:-1]) & set(exclude) and (glob is None or fnmatch.fnmatchcase(inner[-1], glob)):
            found.append(Entry(scheme + quote(info.path, safe="/:=+ ,@"), info.mtime or datetime(1970, 1, 1, tzinfo=timezone.utc), info.size))
    return sorted(found, key=lambda e: e.path)


def open_file(path: str) -> bytes:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        store, at = fs.LocalFileSystem(), unquote(rest)
    else:
        store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


class Packed(ds.InputPartition):
    """The files of one task."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries


def pack(entries: list[Entry], most: int = TASK_BYTES, opening: int = OPEN_BYTES) -> list[Packed]:
    """Files in tasks of about ``most`` bytes, the largest first into the emptiest of as many as are needed."""
    import heapq

    weight = lambda e: e.length + opening
    tasks = max(1, -(-sum(map(weight, entries)) // most))
    heap = [(0, k, []) for k in range(min(tasks, len(entries)))]
    for entry in sorted(entries, key=lambda e: (-e.length, e.path)):
        held, k, own = heapq.heappop(heap)
        own.append(entry)
        heapq.heappush(heap, (held + weight(entry), k, own))
    return [Packed(sorted(own, key=lambda e: e.path)) for _, _, own in sorted(heap, key=lambda x: x[1])]


def read_packed(entries: list[Entry], content: bool, errors: bool) -> Iterator[pa.RecordBatch]:
    """Rows of files in batches of bounded bytes; a file that can't be read is an error, or a row that tells it."""
    rows: list[tuple] = []
    held = 0
    for e in entries:
        raw = error = None
        if content:
            try:
                raw = open_file(e.path)
            except OSError as why:
                if not errors:
                    raise
                error = f"{type(why).__name__}: {why}"
        if rows and held + e.length > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows, held = [], 0
        rows.append((e.path, e.extension, e.time, e.length, raw, error))
        held += e.length
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _instant(text: str) -> datetime:
    """An ISO time; in UTC if it names no zone."""
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def _tests(o: dict[str, str]) -> list[Callable[[Entry], bool]]:
    """What the options ask of a file."""
    out: list[Callable[[Entry], bool]] = []
    if "extensions" in o:
        wanted = {x.strip().lower().removeprefix(".") for x in o["extensions"].split(",")}
        out.append(lambda e: e.extension in wanted)
    if "minlength" in o:
        out.append(lambda e, n=int(o["minlength"]): e.length >= n)
    if "maxlength" in o:
        out.append(lambda e, n=int(o["maxlength"]): e.length <= n)
    if "modifiedafter" in o:
        out.append(lambda e, t=_instant(o["modifiedafter"]): e.time > t)
    if "modifiedbefore" in o:
        out.append(lambda e, t=_instant(o["modifiedbefore"]): e.time < t)
    if "pathglob" in o:
        out.append(lambda e: fnmatch.fnmatchcase(unquote(e.path), o["pathglob"]))
    return out


class FileReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.tests = options, _tests(options)
        self.content = options.get("content", "true").lower() == "true"
        self.errors = options.get("errors", "raise").lower() == "rows"

    def listed(self) -> list[Entry]:
        o = self.options
        found = list_files(o["path"], o.get("recursive", "true").lower() == "true", tuple(x for x in o.get("exclude", "node_modules,.git").split(",") if x), o.get("glob"))
        return [e for e in found if all(t(e) for t in self.tests)]

    def partitions(self) -> list[Packed]:
        return pack(self.listed(), int(self.options.get("taskbytes", TASK_BYTES)), int(self.options.get("openbytes", OPEN_BYTES)))

    def read(self, partition: Packed) -> Iterator[pa.RecordBatch]:
        return read_packed(partition.entries if partition else [], self.content, self.errors)


class FileStreamReader(ds.DataSourceStreamReader):
    """New files in order of (modification time, path); the offset is the last of them.

    Files younger than ``settle`` seconds wait, so that of files which end up with earlier times than others seen none is
    passed over. A file that is moved in later with an old time is not new.
    """

    def __init__(self, options: dict[str, str]):
        self.reader = FileReader(options)
        self.settle = timedelta(seconds=float(options.get("settle", "2")))
        self.most = int(options.get("filesperbatch", "0"))
        self.at = None

    def initialOffset(self) -> dict:
        return {"micros": -1, "path": ""}

    def _after(self, start: dict) -> list[Entry]:
        ripe = datetime.now(timezone.utc) - self.settle
        return sorted((e for e in self.reader.listed() if e.time <= ripe and e.order() > (start["micros"], start["path"])), key=Entry.order)

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()
        new = self._after(self.at)
        new = new[: self.most] if self.most else new
        if new:
            self.at = {"micros": new[-1].micros, "path": new[-1].path}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Packed]:
        self.at = max(self.at or end, end, key=lambda o: (o["micros"], o["path"]))
        own = [e for e in self.reader.listed() if (start["micros"], start["path"]) < e.order() <= (end["micros"], end["path"])]
        o = self.reader.options
        return pack(own, int(o.get("taskbytes", TASK_BYTES)), int(o.get("openbytes", OPEN_BYTES)))

    def read(self, partition: Packed) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FileSource(ds.DataSource):
    """Options: path; recursive (true), exclude (folder names), glob (of the file name), pathGlob (of the whole path), extensions, minLength, maxLength, modifiedAfter, modifiedBefore; taskBytes, openBytes; content (true; false only lists); errors (``raise`` or ``rows``); for streams settle and filesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> FileStreamReader:
        return FileStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session."""
    spark.dataSource.register(FileSource)
    return spark


def files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(path, extension, modificationTime, length, content, error) of the files under ``folder``, for the readers of readers.py."""
    return register(spark).read.format("files").options(**options).load(folder)


def open_files(listed: DataFrame, errors: str = "raise", task_bytes: int = TASK_BYTES) -> DataFrame:
    """The files of a listing (``content=false``), filtered in any way, with their contents; packed into tasks by bytes anew."""
    upto = F.sum(F.col("length") + OPEN_BYTES).over(W.orderBy("path"))
    total = listed.agg(F.coalesce(F.sum(F.col("length") + OPEN_BYTES), F.lit(0)).alias("n")).first().n
    names = [f.name for f in _ARROW]
    packed = listed.select(*names, upto.alias("upto")).repartitionByRange(max(1, -(-total // task_bytes)), "upto").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = [Entry(r["path"], r["modificationTime"], r["length"]) for r in batch.select(["path", "modificationTime", "length"]).to_pylist()]
            yield from read_packed(entries, True, errors == "rows")

    return packed.mapInArrow(run, SCHEMA)


def file_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    return register(spark).readStream.format("files").options(**options).load(folder)
