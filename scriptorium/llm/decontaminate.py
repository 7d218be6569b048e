"""Benchmark items found inside documents by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. For every partition a document is cut
into windows about as long as the partition's items, each overlapping the next by half, so
an item inside a long document meets a window with which its Jaccard similarity is high
however long the document is. An item and a window that agree in a MinHash value are
candidates; a candidate counts if the document holds enough of the item's shingles, word
for word. An item shorter than a shingle is one run of words, whose hash is looked up among
those of the document's runs of that length. Executors index the items in blocks of bounded
size, which then search the documents one after the other.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import mix64, rows_from_texts, shingle_hashes, unused, utf8, word_hashes, work_table

#: MinHash values of a window, each a band of its own. At the threshold of 80 % an item has a
#: similarity of at least 0.25 with some window and is missed with a probability under 2e-6; a full copy under 1e-8.
HASHES = 48
#: Items and bytes of text of a block, about; its index is a few tens of MB.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16_000_000
#: Bytes of the indexes that are sent out for one scan of the documents, about; at least one block.
SCAN_BYTES = 128_000_000
_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64))
#: Shingles that are hashed together, so that they stay in a core's cache.
_STEP = 32_768
_FILTER_LOG2 = 20


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_places(w: list[bytes], size: int) -> np.ndarray:
    """Where each distinct run of ``size`` words stands first; that of all words if they are fewer."""
    n = min(size, len(w))
    first: dict[tuple[bytes, ...], int] = {}
    for i in range(len(w) - n + 1 if n else 0):
        first.setdefault(tuple(w[i : i + n]), i)
    return np.fromiter(first.values(), np.int32, len(first))


def min_hashes(shingles: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The least value of every hash in each stretch that begins at a cut: HASHES x cuts."""
    out = np.empty((HASHES, len(cuts)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        x = (shingles ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        np.minimum.reduceat(x ^ (x >> np.uint64(32)), cuts, out=out[k])
    return out


def block_starts(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of ``size`` start in stretches of these lengths laid end to end, and each stretch's number of blocks."""
    counts = -(-lengths // size)
    first = np.cumsum(counts) - counts
    within = np.arange(counts.sum()) - np.repeat(first, counts)
    return np.repeat(np.cumsum(lengths) - lengths, counts) + within * size, counts


class ItemIndex:
    """A block of items by size partition: sorted MinHash values, and whose they are."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, percent: int):
        self.size, self.percent = size, percent
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        #: Of every item: its number of words, and the places and hashes of its distinct shingles.
        self.lengths: list[int] = []
        self.places: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        by_scale: dict[int, list[tuple[int, np.ndarray]]] = {}
        by_length: dict[int, list[tuple[int, int]]] = {}
        for k, text in enumerate(self.texts):
            w, hashed = words(text), shingle_hashes(word_hashes(text), size)
            self.lengths.append(len(w))
            self.places.append(shingle_places(w, size))
            self.hashes.append(hashed[self.places[k]])
            if len(w) >= size:
                by_scale.setdefault(max(1, int(len(hashed) - 1).bit_length()), []).append((k, hashed))
            elif w:
                by_length.setdefault(len(w), []).append((int(hashed[0]), k))
        self._finish_short({n: ([h for h, _ in x], [k for _, k in x]) for n, x in by_length.items()})
        self.partitions = {}
        for scale, members in sorted(by_scale.items()):
            ends = np.cumsum([len(hashed) for _, hashed in members])
            values = self._keys(min_hashes(np.concatenate([hashed for _, hashed in members]), np.concatenate(([0], ends[:-1]))))
            self._finish_partition(scale, values.ravel(), np.tile(np.array([k for k, _ in members], np.int32), HASHES))

    def _finish_short(self, by_length: dict[int, tuple[list[int], list[int]]]) -> None:
        """Items shorter than a shingle: by length, their sorted hashes and whose they are."""
        self.short = {}
        for n, (hashes, owner) in by_length.items():
            order = np.argsort(np.array(hashes, np.uint64), kind="stable")
            self.short[n] = np.array(hashes, np.uint64)[order], np.array(owner)[order].tolist()

    def _finish_partition(self, scale: int, values: np.ndarray, owner: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        seen = np.zeros(1 << _FILTER_LOG2, bool)
        seen[values >> np.uint64(64 - _FILTER_LOG2)] = True
        self.partitions[scale] = values[order], owner[order], seen

    @classmethod
    def merged(cls, blocks: list[ItemIndex]) -> ItemIndex:
        """One index of the items of several."""
        if len(blocks) == 1:
            return blocks[0]
        out = cls([], blocks[0].size, blocks[0].percent)
        shift = np.cumsum([0, *(len(b.ids) for b in blocks)]).tolist()
        for name in ("ids", "texts", "lengths", "places", "hashes"):
            setattr(out, name, [x for b in blocks for x in getattr(b, name)])
        parts = [(b, at) for b, at in zip(blocks, shift, strict=False)]
        lengths = {n for b in blocks for n in b.short}
        out._finish_short({n: ([int(h) for b, _ in parts if n in b.short for h in b.short[n][0]], [k + at for b, at in parts if n in b.short for k in b.short[n][1]]) for n in lengths})
        for scale in sorted({scale for b in blocks for scale in b.partitions}):
            held = [(b.partitions[scale], at) for b, at in parts if scale in b.partitions]
            out._finish_partition(scale, np.concatenate([p[0] for p, _ in held]), np.concatenate([p[1] + np.int32(at) for p, at in held]))
        return out

    @staticmethod
    def _keys(values: np.ndarray) -> np.ndarray:
        return mix64(values + _SEEDS[:, None])  # a value of one hash must not meet that of another

    def candidates(self, hashed: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) pairs, by position, for texts given by their shingles' hashes."""
        found: set[tuple[int, int]] = set()
        lengths = np.array([len(x) for x in hashed], np.int64)
        if not lengths.sum() or not self.partitions:
            return found
        blocks, size = np.concatenate(hashed), 0
        for scale, (values, owner, seen) in self.partitions.items():
            half = 1 << scale - 1
            if not size:
                cuts, counts = block_starts(lengths, half)
                blocks = min_hashes(blocks, cuts)
            else:  # blocks of a larger size are made from the smaller ones
                cuts, counts = block_starts(counts, half // size)
                blocks = np.minimum.reduceat(blocks, cuts, axis=1)
            size = half
            text = np.repeat(np.arange(len(counts)), counts)
            # A window is three blocks: the largest item of a partition is two and may begin anywhere.
            window = blocks.copy()
            for k in (1, 2):
                same = text[k:] == text[:-k]
                np.minimum(window[:, :-k], blocks[:, k:], out=window[:, :-k], where=same)
            keys = self._keys(window)
            which, at = np.nonzero(seen[keys >> np.uint64(64 - _FILTER_LOG2)])
            hits = keys[which, at]
            lo, hi = np.searchsorted(values, hits, "left"), np.searchsorted(values, hits, "right")
            for i in np.flatnonzero(hi > lo):
                found.update((int(text[at[i]]), int(k)) for k in owner[lo[i] : hi[i]])
        return found

    def short_candidates(self, hashed: np.ndarray) -> list[int]:
        """Items shorter than a shingle whose run of words is among those of a text, given by its words' hashes."""
        found = []
        for n, (hashes, items) in self.short.items():
            runs = np.unique(shingle_hashes(hashed, n)) if len(hashed) >= n else hashed[:0]
            lo, hi = np.searchsorted(hashes, runs, "left"), np.searchsorted(hashes, runs, "right")
            for k in np.flatnonzero(hi > lo):
                found += items[lo[k] : hi[k]]
        return found

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item id, shingles of it that the text holds, its shingles) of the items contained."""
        out, start, part, short, size = [], 0, [], [], 0
        for k, text in enumerate(texts):
            hashed = word_hashes(text)
            part.append(shingle_hashes(hashed, self.size))
            short += [(k - start, item) for item in self.short_candidates(hashed)]
            size += len(part[-1])
            if size >= _STEP or k + 1 == len(texts):
                near: dict[int, list[int]] = {}
                for i, item in sorted({*self.candidates(part), *short}):
                    near.setdefault(i, []).append(item)
                for i, items in near.items():
                    out += self._verified(start + i, texts[start + i], part[i], items)
                start, part, short, size = k + 1, [], [], 0
        return out

    def _verified(self, at: int, text: bytes, hashed: np.ndarray, items: list[int]) -> list[tuple[int, int, int, int]]:
        """The candidates that the text holds: by hash first, then word for word at the places that the hashes name.

        Takes time in proportion to the text and to each candidate.
        """
        out, flat = [], None
        runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: order of the text's runs, and their sorted hashes
        for item in items:
            n = min(self.size, self.lengths[item])
            if n not in runs:
                of_text = hashed if n == self.size else shingle_hashes(word_hashes(text), n)
                order = np.argsort(of_text, kind="stable")
                runs[n] = order, of_text[order]
            order, known = runs[n]
            lo, hi = (np.searchsorted(known, self.hashes[item], side) for side in ("left", "right"))
            met, total = np.flatnonzero(hi > lo), len(self.hashes[item])
            if 100 * len(met) < self.percent * total:
                continue
            flat, wanted = flat or words(text), words(self.texts[item])
            held = 0
            for place, first, last in zip(self.places[item][met].tolist(), lo[met].tolist(), hi[met].tolist(), strict=True):
                run = wanted[place : place + n]
                held += any(flat[p : p + n] == run for p in order[first:last])
            if held and 100 * held >= self.percent * total:
                out.append((at, self.ids[item], held, total))
        return out


def scans(sizes: dict[int, int], limit: int) -> list[list[int]]:
    """Blocks, given with their bytes, in runs of at most ``limit`` bytes, or of one block."""
    out: list[list[int]] = []
    room = 0
    for block, size in sorted(sizes.items()):
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append(block)
        room -= size
    return out


OVERLAPS = "doc_id long, item_id long, n_held long, n_shingles long"


def benchmark_overlaps(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, block_items: int = BLOCK_ITEMS, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(doc_id, item_id, n_held, n_shingles, containment) of the items that documents contain.

    ``docs`` needs doc_id (integer) and text, ``items`` item_id (integer) and text. An item
    is contained if the document holds at least ``percent`` % of its distinct runs of
    ``shingle`` words (A-Z lower-cased, words between ASCII white space). Executors index the
    items in blocks; as many blocks as ``scan_bytes`` hold are sent out, scan the documents
    once, without a shuffle, write what they found and are dropped before the next ones. Defined cases: an item of fewer
    words is one run of them all; an item without words or id, and a null or empty text,
    match nothing; rows of one doc_id and items of one id give one row per pair, the
    fullest; no items or documents give an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("i"), utf8("text").alias("t")).filter("i is not null")
    count, size = known.agg(F.count(F.lit(1)), F.sum(F.length("t"))).first()
    blocks = max(1, -(-count // block_items), -(-(size or 0) // BLOCK_BYTES))

    def build(block: pd.DataFrame) -> pd.DataFrame:
        index = ItemIndex(sorted(zip(block["i"].tolist(), block["t"].tolist(), strict=True)), shingle, percent)
        return pd.DataFrame({"block": block["block"].iloc[:1], "payload": [pickle.dumps(index)]})

    by_block = known.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("long"))
    index = work_table(by_block.groupBy("block").applyInPandas(build, "block long, payload binary"), "item-index")
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    found = [spark.sql("select 0L as doc_id, 0L as item_id, 0L as n_held, 0L as n_shingles where false")]
    sizes = {r.block: r.n for r in index.select("block", F.length("payload").alias("n")).collect()}  # one small row a block
    for scan in scans(sizes, scan_bytes):
        shared = spark.sparkContext.broadcast([bytes(r.payload) for r in index.filter(F.col("block").isin(scan)).collect()])

        def make(shared=shared):
            held = ItemIndex.merged([pickle.loads(payload) for payload in shared.value])

            def search(part: pa.RecordBatch) -> list[pa.Array]:
                hits = held.search(part.column(1).to_pylist())
                return [part.column(0).take(pa.array([h[0] for h in hits], pa.int64())), *(pa.array([h[k] for h in hits], pa.int64()) for k in (1, 2, 3))]

            return search

        found.append(work_table(rows_from_texts(texts, OVERLAPS, make), "item-hits"))
        shared.unpersist()
    ratio = F.col("n_held") / F.col("n_shingles")
    best = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max(F.struct(ratio.alias("containment"), "n_held", "n_shingles")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_held", "m.n_shingles", "m.containment")


def decontaminate(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that contain an item; rows without doc_id, and those with a null or empty text, stay.

    Repeated rows go or stay together; an empty table stays empty, and without items all stay.
    """
    at = unused("bad_doc", docs)
    bad = benchmark_overlaps(docs, items, shingle, percent).select(F.col("doc_id").alias(at)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad[at], "left_anti")
