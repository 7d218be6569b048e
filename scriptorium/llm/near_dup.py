"""Near-duplicate documents by circulant MinHash.

A document is its set of word shingles. One permutation scatters the shingles over a
circle of places, a second one gives the places their ranks; coordinate k of the signature
is the least rank after turning the second permutation by k places, so two permutations
make all coordinates. The circle has four places at least for each shingle, so that large
sets don't fill it; a set near the border of two sizes is signed on both circles.
Documents with equal sets form a class with one representative.
Representatives that share a band of the signature are candidates; a candidate becomes a
link only if the Jaccard similarity of the full sets reaches the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, mix64, per_text, release_memory, rows_from_texts, shingle_hashes, utf8, word_hashes, work_table
from scriptorium.llm.components import connected_components

#: Places on the smallest circle, as a power of two.
PLACES_LOG2 = 18
#: Bands and coordinates of a band. A pair at 0.85 is missed with a probability under 1e-8, at 0.8 under 1e-5.
BANDS, ROWS = 32, 5
_CHUNK = 4096
#: Cells of the frequency sketch, as a power of two, and cells of one of its rows.
CELLS_LOG2, _STRETCH = 20, 8192
#: Candidate pairs of two components that are confirmed in the first round; the next ones take eight times as many.
FIRST_ROUND = 4096


def permuted(x: np.ndarray, log2: int, seed: int) -> np.ndarray:
    """A permutation of the numbers below a power of two: odd factors and shifts can be undone."""
    mask, half = np.uint64((1 << log2) - 1), np.uint64((log2 + 1) // 2)
    for k in range(3):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * (3 * seed + k) + 1) >> 7 | 1) & (1 << 63) - 1)
        x = (x * factor + factor) & mask
        x = x ^ (x >> half)
    return x


class CirculantMinHash:
    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        places = np.arange(1 << PLACES_LOG2, dtype=np.uint64)
        ranks = permuted(places, PLACES_LOG2, 2).astype(np.int64)
        circle = np.concatenate([ranks, ranks[: bands * rows]]).astype(np.int32)
        #: Row p holds the ranks that place p of the smallest circle gets by each turn.
        self.turned = np.lib.stride_tricks.sliding_window_view(circle, bands * rows)

    @staticmethod
    def circle_log2(size: int) -> int:
        return max(PLACES_LOG2, (4 * size - 1).bit_length())

    def signature(self, shingles: np.ndarray, log2: int) -> np.ndarray:
        at = permuted(shingles >> np.uint64(64 - log2), log2, 1)
        least = np.full(self.bands * self.rows, 1 << log2, np.int64)
        for k in range(0, len(at), _CHUNK):
            some = at[k : k + _CHUNK]
            if log2 == PLACES_LOG2:
                np.minimum(least, self.turned[some.astype(np.int64)].min(axis=0), out=least)
            else:  # the ranks of a large circle are worked out, not held
                mask = np.uint64((1 << log2) - 1)
                least = np.minimum(least, [permuted((some + np.uint64(t)) & mask, log2, 2).min() for t in range(len(least))]).astype(np.int64)
        return least

    def band_keys(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """A 64-bit key for every band and circle, different from band to band and circle to circle.

        A set that can be linked with this one and is larger lies on this circle or on that of the largest such set.
        """
        size = len(shingles)
        out = []
        for log2 in sorted({self.circle_log2(size), self.circle_log2(size * 100 // percent)}):
            values = self.signature(shingles, log2).reshape(self.bands, self.rows).astype(np.uint64)
            keys = np.arange(1, self.bands + 1, dtype=np.uint64) + np.uint64(self.bands * (log2 - PLACES_LOG2))
            for k in range(self.rows):
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
            out.append(keys)
        return np.concatenate(out).view(np.int64)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), size))


def _sign(size: int, percent: int):
    def make():
        hasher = CirculantMinHash()

        def signed(part: pa.Array) -> list[pa.Array]:
            sizes, digests, bands = [], [], []
            for text in part.to_pylist():
                shingles = shingle_set(text, size)
                sizes.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(hasher.band_keys(shingles, percent) if len(shingles) else np.zeros(0, np.int64))
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            return [pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)), pa.ListArray.from_arrays(ends, np.concatenate(bands))]

        return signed

    return per_text("n_shingles long, d1 long, d2 long, bands array<long>", make)


def _confirm(size: int, percent: int):
    """Keep the pairs whose full sets are similar enough; a few sets are kept, as pairs come sorted by one side."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a not in held:
                    held[a] = shingle_set(batch.column(2)[i].as_py(), size)
                    if len(held) > 16:
                        held.popitem(last=False)
                sa, sb = held[a], shingle_set(batch.column(3)[i].as_py(), size)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(sa) + len(sb) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))
        held.clear()
        release_memory()

    return confirm


def _sketch(size: int):
    """How many documents hold the shingles of each sketch cell, in rows of one stretch of cells."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS_LOG2, np.int64)
        for batch in batches:
            for lo, n in cut(batch.column(0)):
                for text in batch.column(0).slice(lo, n).to_pylist():
                    np.add.at(cells, (shingle_set(text, size) >> np.uint64(64 - CELLS_LOG2)).astype(np.int64), 1)
        parts = [(k, x.tobytes()) for k, x in enumerate(cells.reshape(-1, _STRETCH)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["k", "cells"])
        release_memory()

    return sketch


def _add_cells(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_STRETCH, np.int64)
    for x in rows["cells"]:
        total += np.frombuffer(x, np.int64)
    return pd.DataFrame({"k": [rows["k"].iloc[0]], "cells": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def rare_prefix_pairs(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b, part_a, part_b) of different parts, with every pair that is similar enough among them.

    ``texts`` has id, part and text. Each document's shingles are put in one global order,
    rare ones first by a sketch of fixed size; two sets that overlap enough share a shingle
    within short prefixes, and the places of the first one shared bound their overlap.
    Pairs of parts are found for each shingle first, so that members of one part never meet,
    and only between neighbouring classes of set sizes, which split a shingle of many texts.
    """
    spark = texts.sparkSession
    counts = texts.select("text").mapInArrow(_sketch(size), "k int, cells binary").groupBy("k").applyInPandas(_add_cells, "k int, cells binary")
    cells = np.zeros(1 << CELLS_LOG2, np.int32)
    for k, part in counts.collect():  # 4 MB in all, whatever the corpus
        cells[k * _STRETCH : (k + 1) * _STRETCH] = np.frombuffer(part, np.int32)
    order = spark.sparkContext.broadcast(cells)

    def prefixes() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def rows(part: pa.RecordBatch) -> list[pa.Array]:
            tokens, lengths, sizes, places, short = [], [], [], [], []
            for text in part.column(2).to_pylist():
                found = shingle_set(text, size)
                n = len(found)
                rarest = np.lexsort((found, order.value[(found >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)]))
                length = n - -(-percent * n // 100) + 1
                tokens.append(found[rarest[:length]].view(np.int64))
                lengths.append(length)
                sizes.append(np.full(length, n, np.int64))
                places.append(np.arange(length))
                short.append(np.arange(length) < n - -(-2 * percent * n // (100 + percent)) + 1)
            own = [part.column(k).take(pa.array(np.repeat(np.arange(part.num_rows), lengths))) for k in (0, 1)]
            return [pa.array(np.concatenate(tokens)), *own, *(pa.array(np.concatenate(x)) for x in (sizes, places, short))]

        return rows

    made = rows_from_texts(texts.select("id", "part", "text"), "token long, id long, part long, n long, place long, short boolean", prefixes, 250_000)
    rows = work_table(made, "prefixes")
    # Two sets that can be linked lie in one class of sizes, or the larger one in the next: a class is a little wider than the ratio of a link.
    width = 1.001 * max(math.log(100 / percent), 0.001)
    rows = rows.withColumn("class", F.floor(F.log("n") / width))
    bounds = [F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("rest")]
    held = rows.groupBy("token", "part", "short", "class").agg(*bounds)
    shared = held.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("token")
    held = work_table(held.join(shared, "token", "left_semi"), "prefix-parts")
    # What fits below, said of parts: so a shingle of many sets that can't be alike makes no rows.
    may = f"""part_x <> part_y and least_x <= most_y and 100 * most_x >= {percent} * least_y
        and (100 + {percent}) * least(rest_x, rest_y) >= {percent} * (least_x + least_y)"""
    side = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("part", "class", "least", "most", "rest")]
    smaller = held.filter("short").select("token", *side("x")).withColumn("class_y", F.explode(F.array("class_x", F.col("class_x") + 1)))
    meet = smaller.join(held.select("token", *side("y")), ["token", "class_y"]).filter(may).select("token", "part_x", "class_x", "part_y", "class_y").distinct()
    x = rows.filter("short").select("token", *(F.col(c).alias(f"{c}_x") for c in ("id", "part", "class", "n", "place")))
    y = rows.select("token", *(F.col(c).alias(f"{c}_y") for c in ("id", "part", "class", "n", "place")))
    fits = f"""(n_x < n_y or n_x = n_y and id_x < id_y) and 100 * n_x >= {percent} * n_y
        and (100 + {percent}) * least(n_x - place_x, n_y - place_y) >= {percent} * (n_x + n_y)"""
    pairs = x.hint("merge").join(meet, ["token", "part_x", "class_x"]).join(y.hint("merge"), ["token", "part_y", "class_y"]).filter(fits)
    swap = F.col("id_x") > F.col("id_y")
    side = [F.when(swap, F.col(q)).otherwise(F.col(p)).alias(name) for p, q, name in (("id_x", "id_y", "a"), ("id_y", "id_x", "b"), ("part_x", "part_y", "part_a"), ("part_y", "part_x", "part_b"))]
    return pairs.select(*side).distinct()


def cross_links(pairs: DataFrame, confirmed: Callable[[DataFrame], DataFrame], first: int = FIRST_ROUND) -> DataFrame | None:
    """The links among candidate pairs (a, b, part_a, part_b), but for those within parts that others have joined by then.

    Every round confirms a bounded number of pairs for each two parts, joins the parts that
    turn out to be linked and drops the pairs that are then within one part, until no pair
    is left: all pairs are looked at unless their texts are known to be connected.
    """
    found, step = None, first
    while True:
        counts = pairs.groupBy(F.least("part_a", "part_b").alias("lo"), F.greatest("part_a", "part_b").alias("hi")).agg(F.count(F.lit(1)).alias("n"))
        marked = pairs.withColumns({"lo": F.least("part_a", "part_b"), "hi": F.greatest("part_a", "part_b")}).join(counts, ["lo", "hi"])
        share = F.pmod(F.xxhash64("a", "b", F.lit(step)), F.lit(1 << 31)) / (1 << 31)
        marked = work_table(marked.select("a", "b", "part_a", "part_b", (share * F.col("n") < step).alias("now")), "cross-candidates")
        links = confirmed(marked.filter("now").select("a", "b"))
        found = links if found is None else found.unionByName(links)
        left = marked.filter("not now")
        if left.isEmpty():
            return found
        joined = connected_components(links.join(marked.filter("now"), ["a", "b"]).select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
        for side in ("part_a", "part_b"):
            now = joined.select(F.col("node").alias(side), F.col("component").alias("joined"))
            left = left.join(now, side, "left").withColumn(side, F.coalesce("joined", side)).drop("joined")
        pairs, step = left.filter("part_a <> part_b").select("a", "b", "part_a", "part_b"), 8 * step


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id (integer, unique) and text; other columns are not read. Two
    documents are linked if ``100 * |A and B| >= percent * |A or B|`` for their sets of
    ``shingle``-word runs (A-Z lower-cased, words between ASCII white space; a shorter text
    is one run). component_id is the smallest doc_id reachable over links and kept tells
    whether the document is that one. Defined cases: null, empty or blank texts have no
    runs, are linked with nothing and are kept; rows repeated under one doc_id get the same
    row each; a null doc_id is kept with a null component; an empty table stays empty.

    Members of a bucket are first compared with its most central document only. Documents
    of buckets that then still hold several components go through rare_prefix_pairs(), an
    exact search for links between different components, and its pairs through
    cross_links(), so that none is lost while a group of copies never makes all its pairs.
    """
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _sign(shingle, percent)(utf8("text")).alias("s"))
    signed = work_table(signed.select("doc_id", "s.*"), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = work_table(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    members = classes.select(F.explode("bands").alias("key"), "rep", "n")
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    crowded = work_table(members.join(buckets, "key"), "crowded-buckets")
    central = crowded.groupBy("rep").agg(F.sum("size").alias("company"))
    heads = crowded.join(central, "rep").groupBy("key").agg(F.max(F.struct("company", F.col("rep").alias("a"), F.col("n").alias("na"))).alias("head"))
    first = crowded.join(heads.select("key", "head.a", "head.na"), "key").filter("rep <> a")
    first = first.filter(f"100 * least(na, n) >= {percent} * greatest(na, n)").select("a", F.col("rep").alias("b")).distinct()
    first = work_table(first, "candidates")

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), utf8("text").alias("text"))
    texts = work_table(texts.join(crowded.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "candidate-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        whole = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        return work_table(whole.mapInArrow(_confirm(shingle, percent), "a long, b long"), "links")

    links = confirmed(first)
    found = connected_components(links)

    labelled = crowded.join(found, crowded["rep"] == found["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("key")
    mixed = labelled.join(mixed, "key").select(F.col("rep").alias("id"), "part").distinct()
    mixed = work_table(texts.join(mixed, "id"), "mixed-texts")
    across = rare_prefix_pairs(mixed, shingle, percent).join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = cross_links(work_table(across, "cross-pairs"), confirmed)
    found = connected_components(links.unionByName(more))

    classes = classes.join(found, classes["rep"] == found["node"], "left").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("component", "rep").alias("component"))
    out = signed.join(classes, (F.col("n_shingles") > 0) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
