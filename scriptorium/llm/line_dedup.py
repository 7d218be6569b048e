"""Line deduplication with a sharded minimal perfect hash.

Lines seen in several documents are indexed by a minimal perfect hash over their
distinct 128-bit hashes. It is cut into shards of bounded size; a shard is one row that
holds the bit levels of the hash and, by slot, a fingerprint, a document count and the
document that keeps the line. Line hashes are routed to their shard (a hot line over many
slices, each with its own copy of the shard) and probe these arrays batch by batch, so
no line is joined with another and no group of lines has to fit in memory.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import WHITE, add_fields, mix64, parallelism, per_text, release_memory, rows_from_texts, unused, utf8, work_table

#: Keys of a shard, about: its row stays under 2 MB.
SHARD_KEYS = 65_536
#: Line hashes of a slice of a shard, about.
SLICE_ROWS = 500_000
_LEVELS = 40


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A line's key, or None if it is too short to count."""
    key = line.strip(WHITE).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _line_hashes(min_chars: int):
    """Rows (doc_id, h1, h2) of the distinct keys of every document."""

    def make():
        def rows(part: pa.RecordBatch) -> list[pa.Array]:
            ids, counts, packed = part.column(0), [], []
            for text in part.column(1).to_pylist():
                keys = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                counts.append(len(keys))
                packed += map(xxhash.xxh3_128_digest, keys)
            pairs = np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2)
            return [ids.take(pa.array(np.repeat(np.arange(len(ids)), counts))), *(pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1))]

        return rows

    return make


class PerfectHash:
    """A minimal perfect hash over distinct (h1, h2) pairs with arrays by slot.

    Every level is a bit array twice as long as the keys left; a key that alone falls on
    a bit owns it, the others go on to the next level. A key's slot is the rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray, arrays: dict[str, np.ndarray]):
        self.levels, self.rest, self.arrays = levels, rest, arrays
        flat = np.concatenate([*levels, np.zeros(0, bool)])
        self.rank = np.cumsum(flat, dtype=np.int64) - 1
        self.starts = np.cumsum([0, *map(len, levels)])

    @staticmethod
    def _code(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return mix64(h1.view(np.uint64)) + h2.view(np.uint64)

    @staticmethod
    def _place(code: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(code + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> PerfectHash:
        code = left = cls._code(h1, h2)
        levels: list[np.ndarray] = []
        while len(left) and len(levels) < _LEVELS:
            at = cls._place(left, len(levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            levels.append(alone)
            left = left[~alone[at]]
        out = cls(levels, np.sort(left), {})
        slot = out.slots(code)
        for name, values in (("fingerprint", h2), ("count", np.minimum(count, 2**32 - 1).astype(np.uint32)), ("keeper", keeper)):
            out.arrays[name] = np.empty(len(values), values.dtype)
            out.arrays[name][slot] = values
        return out

    def slots(self, code: np.ndarray) -> np.ndarray:
        """The slot of each code, -1 where it certainly is not a key."""
        out = np.full(len(code), -1, np.int64)
        open_ = np.arange(len(code))
        for level, bits in enumerate(self.levels):
            at = self._place(code[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.rank[self.starts[level] + at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, code[open_]), len(self.rest) - 1)
            hit = self.rest[at] == code[open_]
            out[open_[hit]] = (self.rank[-1] + 1 if len(self.rank) else 0) + at[hit]
        return out

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pairs are keys, with the count and the keeping document of each that is."""
        slot = self.slots(self._code(h1, h2))
        found = slot >= 0
        found[found] = self.arrays["fingerprint"][slot[found]] == h2[found]
        return found, self.arrays["count"][slot[found]], self.arrays["keeper"][slot[found]]

    def dump(self) -> bytes:
        buffer = io.BytesIO()
        sizes = np.array([len(x) for x in self.levels], np.int64)
        np.savez(buffer, sizes=sizes, bits=np.packbits(np.concatenate([*self.levels, np.zeros(0, bool)])), rest=self.rest, **self.arrays)
        return buffer.getvalue()

    @classmethod
    def load(cls, payload: bytes) -> PerfectHash:
        held = np.load(io.BytesIO(payload))
        sizes = held["sizes"]
        bits = np.unpackbits(held["bits"], count=int(sizes.sum())).astype(bool)
        levels = np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else []
        return cls(levels, held["rest"], {k: held[k] for k in ("fingerprint", "count", "keeper")})


def _build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    index = PerfectHash.build(*(keys[c].to_numpy() for c in ("h1", "h2", "n_docs", "keeper")))
    return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "payload": [index.dump()]})


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard and slice, a slice's copy of the shard before its lines."""
    at, index = None, None
    for batch in batches:
        shard, slice_ = batch["shard"].to_numpy(), batch["slice"].to_numpy()
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(slice_) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if lo == hi:
                continue
            if at != (shard[lo], slice_[lo]):
                at, index = (shard[lo], slice_[lo]), None
            payload = batch["payload"].iloc[lo]
            if payload is not None:
                index, lo = PerfectHash.load(payload), lo + 1
            if index is None or lo == hi:
                continue
            rows = batch.iloc[lo:hi]
            ids, h1, h2 = (rows[c].to_numpy().astype(np.int64) for c in ("doc_id", "h1", "h2"))
            found, _, keeper = index.probe(h1, h2)
            ids, h1, h2 = (x[found][keeper != ids[found]] for x in (ids, h1, h2))
            if len(ids):
                yield pd.DataFrame({"doc_id": ids, "h1": h1, "h2": h2})
    del index
    release_memory()


def repeated_lines(docs: DataFrame, min_chars: int = 10) -> tuple[DataFrame, DataFrame]:
    """The line hashes of every document, and of them those in two documents or more.

    Returns work tables (doc_id, h1, h2) and (h1, h2, keeper, n_docs).
    """
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    keys = work_table(rows_from_texts(texts, "doc_id long, h1 long, h2 long", _line_hashes(min_chars)), "line-keys")
    held = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_docs"))
    return keys, work_table(held.filter("keeper < last").drop("last"), "repeated-lines")


def lines_to_drop(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, h1, h2): the lines that each document loses.

    Every shard gets slices by the rows that were counted for it, so that a line with many
    copies fills more slices and not a larger one; a document's hash picks the slice.
    """
    keys, repeated = repeated_lines(docs, min_chars)
    shards = max(1, -(-repeated.count() // SHARD_KEYS))
    tasks = parallelism(docs.sparkSession)
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")
    slices = slice_counts(keys.select(shard), max(1, -(-tasks // shards)))
    total = slices.agg(F.sum("slices")).first()[0] or 1
    index = repeated.select("*", shard).groupBy("shard").applyInPandas(_build_shard, "shard int, payload binary")
    index = work_table(index, "line-index").join(slices, "shard")
    index = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *(F.lit(0).cast("long").alias(c) for c in ("doc_id", "h1", "h2")), "payload")
    slice_ = F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int").alias("slice")
    lines = keys.select("*", shard).join(slices, "shard").select("shard", slice_, "doc_id", "h1", "h2", F.lit(None).cast("binary").alias("payload"))
    routed = index.unionByName(lines).repartition(max(tasks, total), "shard", "slice")
    routed = routed.sortWithinPartitions("shard", "slice", F.col("payload").isNull())
    return routed.mapInPandas(_probe, "doc_id long, h1 long, h2 long")


def slice_counts(shards: DataFrame, least: int, rows: int = SLICE_ROWS) -> DataFrame:
    """(shard, slices): so many that a slice has about ``rows`` of the shard's rows, and ``least`` at least."""
    counts = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return work_table(counts.select("shard", F.greatest(F.lit(least), F.ceil(F.col("n") / rows)).cast("int").alias("slices")), "line-slices")


def _drop_lines(min_chars: int):
    """From (text, its dropped hashes) to the new text and what became of it."""

    def make():
        def drop(part: pa.Array) -> list[pa.Array]:
            held = part.field(1)
            counts = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
            flat = held.flatten()
            pairs = np.stack([flat.field(k).to_numpy() for k in (0, 1)], axis=1).astype("<i8").tobytes()
            out, totals, dropped, digests, at = [], [], [], [], 0
            for text, n in zip(part.field(0).to_pylist(), counts.tolist(), strict=True):
                lines = text.split(b"\n")
                totals.append(len(lines))
                if n:
                    gone = {pairs[i : i + 16] for i in range(at, at + 16 * n, 16)}
                    at += 16 * n
                    lines = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                kept = b"\n".join(lines)
                out.append(kept.decode("utf-8", "replace"))
                dropped.append(totals[-1] - len(lines))
                digests.append(hashlib.sha256(kept).hexdigest())
            return [pa.array(out, pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]

        return drop

    return make


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Drop lines that an earlier document holds too.

    ``docs`` needs doc_id (integer, unique) and text. A line's key is the line stripped
    of ASCII white space with A-Z lower-cased. A key of at least ``min_chars`` code points
    that two documents hold loses all its lines except in the smallest doc_id. The result
    has the columns of ``docs`` with the new text, then n_lines, n_dropped, kept_sha256;
    columns of those names in ``docs`` are replaced. Defined cases: null or empty text is
    one empty line; a row without doc_id holds no line for others and keeps all its own;
    rows repeated under one doc_id count as one document; an empty table stays empty; a
    document whose lines all go has an empty text.
    """
    at, gone = unused("line_doc", docs), unused("line_hashes", docs)
    hits = lines_to_drop(docs, min_chars).groupBy(F.col("doc_id").alias(at)).agg(F.collect_list(F.struct("h1", "h2")).alias(gone))
    joined = docs.join(hits, docs["doc_id"].cast("long") == F.col(at), "left")
    new = per_text("text string, n_lines long, n_dropped long, kept_sha256 string", _drop_lines(min_chars))(F.struct(utf8("text").alias("text"), F.col(gone)))
    added = ["n_lines", "n_dropped", "kept_sha256"]
    order = [f"`{c}`" for c in docs.columns if c.lower() not in added]
    return add_fields(joined, new, ["text", *added]).select(*order, *added)
