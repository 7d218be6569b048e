"""Ranked lexical search of whole texts for many items at once, as a threshold-seeded join.

Every term keeps the documents of its k largest impacts. What those few give an item, summed
over its terms, bounds the item's kth score from below before any long posting list is
read. Terms whose largest impacts together stay under that bound can't bring a document in
by themselves and are pruned; the postings of the others make candidates with partial sums,
which raise the bound once more; what may still reach it is scored exactly. Nothing is cut
off but what provably scores less than the kth.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if_small, rows_from_texts, utf8, work_table

#: ASCII digits and letters, A-Z lower-cased, and everything beyond ASCII make terms; all other bytes separate them.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Hits of an item.
HITS = 50


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_FOLDED).split()


def count_terms(rows: DataFrame, id_column: str) -> DataFrame:
    """(row, id, n, terms, tfs) as a written table: terms with repeats of each text, the distinct ones and their numbers.

    ``row`` numbers the rows, whatever their ids.
    """

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def counted(part: pa.RecordBatch) -> list[pa.Array]:
            counts = [Counter(terms(t)) for t in part.column(1).to_pylist()]
            ends = pa.array([0, *_running(len(c) for c in counts)], pa.int32())
            words = pa.array([w for c in counts for w in c], pa.binary()).view(pa.string())
            tfs = pa.array([n for c in counts for n in c.values()], pa.int32())
            total = pa.array([c.total() for c in counts], pa.int64())
            return [part.column(0), total, pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, tfs)]

        return counted

    made = rows_from_texts(rows.select(F.col(id_column).cast("long").alias("id"), utf8("text").alias("text")), "id long, n long, terms array<string>, tfs array<int>", make)
    return work_table(made.withColumn("row", F.monotonically_increasing_id()), "terms")


def _running(sizes):
    total = 0
    for n in sizes:
        total += n
        yield total


def impact(weight: str, tf: str, n: str, documents: int, length: int) -> Column:
    """What a term adds to a document's score, in whole numbers; ``length`` is that of all documents together."""
    m = f"(50 + (50 * {n} * {documents}L) div {max(1, length)}L)"
    return F.expr(f"{weight} * ((1000000000L * {tf}) div (1000L * {tf} + 20 * {m}))")


def _kth(scores: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """(by, value) of the kth largest value of each group that has so many; tasks first keep their own k of a group."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(value)))
    return scores.withColumn("place", place).filter(f"place <= {k}").filter(f"place = {k}").select(by, F.col(value).alias("bound"))


def search(docs: DataFrame, items: DataFrame, k: int = HITS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text).

    Terms are runs of ASCII letters and digits, A-Z lower-cased, and of anything beyond
    ASCII. A document's score sums, over the item's distinct terms, the weight
    floor(1000 ln((2N+2)/(2df+1))) times a saturating share of tf that falls with the
    document's length, all but the weight in whole numbers; see impact(). Only scores over 0
    count; equal scores go by ascending doc_id. Defined cases: null and empty texts have no
    terms, so such items have no hits and such documents are none; terms that no document
    holds add nothing; repeated documents are ranked each, repeated items are answered each;
    a row without doc_id comes last among equals and keeps its null; either table may be empty.
    """
    found = count_terms(docs, "doc_id")
    totals = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    asked = count_terms(items, "item_id")
    words = asked.select("row", F.explode("terms").alias("term"))
    numbered = work_table(words.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    item_terms = work_table(words.join(broadcast_if_small(numbered), "term").select(F.col("row").alias("item"), "term_id"), "item-terms")
    each = found.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    postings = work_table(each.join(broadcast_if_small(numbered), "term").select("term_id", "row", "n", "tf"), "postings")

    df = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * totals.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = work_table(df.select("term_id", weight.alias("weight")).filter("weight > 0"), "weights")
    impacts = postings.join(broadcast_if_small(weights), "term_id").select("term_id", "row", impact("weight", "tf", "n", totals.documents, totals.length).alias("impact"))

    # The k largest impacts of a term: each task keeps its own k of a term before any row is sent.
    place = F.row_number().over(W.partitionBy("term_id").orderBy(F.desc("impact"), "row"))
    champions = work_table(impacts.withColumn("place", place).filter(f"place <= {k}"), "champions")
    seeded = item_terms.join(champions, "term_id").groupBy("item", "row").agg(F.sum("impact").alias("sum"))
    first = _kth(seeded, "item", "sum", k)

    # Terms by rising largest impact: those that together stay under the bound bring in nothing by themselves.
    most = champions.filter("place = 1").select("term_id", F.col("impact").alias("most"))
    rising = W.partitionBy("item").orderBy("most", "term_id").rowsBetween(W.unboundedPreceding, 0)
    ranked = item_terms.join(most, "term_id").withColumn("upto", F.sum("most").over(rising))
    ranked = work_table(ranked.join(first, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0))), "ranked-terms")
    rest = ranked.filter("upto < bound").groupBy("item").agg(F.max("upto").alias("rest"))
    bounds = ranked.select("item", "bound").distinct().join(rest, "item", "left").select("item", "bound", F.coalesce("rest", F.lit(0)).alias("rest"))
    bounds = work_table(bounds, "bounds")

    telling = work_table(ranked.filter("upto >= bound").select("item", "term_id"), "telling-terms")
    partial = impacts.join(broadcast_if_small(telling), "term_id").groupBy("item", "row").agg(F.sum("impact").alias("sum"))
    candidates = work_table(partial.join(broadcast_if_small(bounds), "item").filter("sum + rest >= bound").select("item", "row", "sum", "rest"), "candidates")
    second = work_table(_kth(candidates, "item", "sum", k), "second-bounds")
    left = candidates.join(broadcast_if_small(second), "item", "left").filter("bound is null or sum + rest >= bound")
    left = work_table(left.select("item", "row"), "survivors")

    scored = impacts.join(broadcast_if_small(left), "row").join(broadcast_if_small(item_terms), ["item", "term_id"]).groupBy("item", "row").agg(F.sum("impact").alias("score"))
    scored = scored.join(found.select("row", F.col("id").alias("doc_id")), "row").select("item", "doc_id", "row", "score")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    hits = scored.withColumn("rank", rank).filter(f"rank <= {k}")
    return hits.join(asked.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item").select("item_id", "rank", "doc_id", "score")
