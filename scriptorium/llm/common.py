"""What several corpus operators share: work tables, folds, word and shingle hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.portions import PORTION, cut, per_text, release_memory  # noqa: F401: the operators take them from here

#: ASCII white space, the only separators of words and the only characters stripped from lines.
WHITE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without it and then gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="scriptorium-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_scope: ContextVar[str] = ContextVar("scope", default="scriptorium")


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Work tables written in this block are removed at its end; results that read them must be written before."""
    token = _scope.set(f"scriptorium-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_scope.get()}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _scope.reset(token)


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A lost executor then costs a reread instead of the whole lineage.
    """
    path = f"{shared_dir(df.sparkSession)}/{_scope.get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a table may have to be sent to all executors, some tens of MB in memory if its rows are a few numbers wide.
BROADCAST_ROWS = 300_000


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """A written table of few narrow columns, marked for broadcast if its rows are counted to be few; else as it is, for a shuffled join."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def utf8(column: str) -> Column:
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it until no column of the tables is called so."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def add_fields(df: DataFrame, struct: Column, fields: list[str]) -> DataFrame:
    """``df`` with the fields of ``struct`` as columns, in place of any columns of those names."""
    name = unused("made", df)
    drop = {name, *(f.lower() for f in fields)}
    made = df.withColumn(name, struct)
    kept = [F.col(f"`{c}`") for c in made.columns if c.lower() not in drop]
    return made.select(*kept, *[F.col(name)[f].alias(f) for f in fields])


def rows_from_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], portion: int = PORTION) -> DataFrame:
    """Rows of ``schema`` made from portions of ``df``, whose last column is the text; memory is bounded as in per_text()."""
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for lo, n in cut(batch.column(batch.num_columns - 1), portion):
                yield pa.RecordBatch.from_arrays(compute(batch.slice(lo, n)), names=names)
        del compute
        release_memory()

    return df.mapInArrow(run, schema)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# Hashes -----------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 65536 else 65536
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text, A-Z lower-cased, in order.

    Prefix sums of a polynomial give each word's hash without a loop over words.
    """
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([True], _IS_WHITE[raw], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_table(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words; of the whole sequence if it is shorter; none without words."""
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _STEP + words[k : len(words) - n + 1 + k]
    return mix64(out)


# Segments ---------------------------------------------------------------

#: The UTF-8 bytes of white space beyond ASCII, of the space mark of SentencePiece too, as numbers.
_WIDE = np.array([0xC285, 0xC2A0, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080, 0xE29681])
_NARROW = np.zeros(256, dtype=bool)
_NARROW[[*WHITE, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def space_segments(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts (strings) behind a space each, cut before every space that follows something else than white space or a space mark.

    Returns the distinct segments, for every segment which of them it is, and where each text's
    segments start and end; null and empty texts have none.
    """
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pc.fill_null(texts, "")), "")
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[: lengths.sum()]
    filled = lengths > 0
    raw = np.insert(raw, (np.cumsum(lengths) - lengths)[filled], 32)
    bounds = np.concatenate(([0], np.cumsum(lengths + filled)))
    at = np.flatnonzero(raw == 32)
    before = raw[at - 1].astype(np.int64)
    white = _NARROW[before]
    wide = np.flatnonzero(before >= 128)
    two = (raw[at[wide] - 2].astype(np.int64) << 8) | before[wide]
    white[wide] = np.isin(two, _WIDE) | np.isin((raw[at[wide] - 3].astype(np.int64) << 16) | two, _WIDE)
    white[np.searchsorted(at, bounds[:-1][filled])] = False
    starts = at[~white]
    offsets = np.append(starts, len(raw)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.searchsorted(starts, bounds)


def gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``values``, one after the other; run k is values[starts[k]:starts[k + 1]]."""
    sizes = np.diff(starts)[which]
    return values[np.arange(sizes.sum()) + np.repeat(starts[which] - (np.cumsum(sizes) - sizes), sizes)]


def valid_strings(texts: pa.Array) -> pa.Array:
    """Bytes as strings; what isn't UTF-8 is replaced."""
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") if t is not None else None for t in texts.to_pylist()], pa.string())


def worker_threads(count: int) -> None:
    """Threads that the tokenizers library may use in this Python worker."""
    os.environ["RAYON_NUM_THREADS"] = str(count)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if count > 1 else "false"
