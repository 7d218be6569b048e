"""The document row: content, inherited metadata and explicit order.

(doc_id, page_content, metadata MAP<STRING,STRING>), plus chunk_index after a split. What
an operator computes is a typed column; free keys that come with a document stay in the map.
Rows have no order in Spark, so every operator whose result depends on one carries ordinals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTENT, METADATA = "page_content", "metadata"


def metadata(**values: Column | str) -> Column:
    """A metadata map of the values that are not null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _no_entries() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def merged(*maps: Column) -> Column:
    """Maps merged key by key, later ones winning whatever the session's policy for equal keys."""

    def over(first: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(later, k)), later)

    return reduce(over, [F.coalesce(m, _no_entries()) for m in maps])


def documents(df: DataFrame, doc_id: Column | str, content: Column | str, meta: Column | None = None) -> DataFrame:
    """A document table from any DataFrame; missing content is an empty text."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    held = _no_entries() if meta is None else F.coalesce(meta, _no_entries())
    return df.select(col(doc_id).alias("doc_id"), F.coalesce(col(content).cast("string"), F.lit("")).alias(CONTENT), held.alias(METADATA))


def chunk_id(*parts: str) -> Column:
    """A stable id for a derived row, in place of a random one."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it until no column of the tables is called so."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
