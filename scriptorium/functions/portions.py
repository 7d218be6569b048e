"""Python steps over texts in portions, so that a worker's memory doesn't depend on the size of Arrow's batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def release_memory() -> None:
    """Give freed memory back to the system: Spark keeps a Python worker for later stages.

    No search for cycles, which would write to, and so copy, what workers share with their daemon.
    """
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of text that a Python worker looks at in one go.
PORTION = 1_000_000


def cut(texts: pa.Array, portion: int = PORTION) -> Iterator[tuple[int, int]]:
    """(first row, rows) of portions of about so many bytes of text, or of one text if that is longer."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(sizes) // portion
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
    return ((lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo)


def per_text(fields: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], portion: int = PORTION):
    """A UDF from texts, or from structs whose first field is the text, to a struct of ``fields``.

    ``make()`` runs once in a task and gives a function from a portion of the column to one
    Arrow array for each field. Portions go by bytes, so that a worker's memory depends
    neither on the size of Arrow's batches nor on that of a partition; it is given back at
    the end. Other columns never leave the JVM. The UDF counts as not deterministic, so that
    a filter on its result is not pushed below it, where it would run a second time.
    """
    made = T.StructType.fromDDL(fields)

    @F.arrow_udf(made)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compute = make()
        for batch in batches:
            for lo, n in cut(batch.field(0) if pa.types.is_struct(batch.type) else batch, portion):
                yield pa.StructArray.from_arrays(compute(batch.slice(lo, n)), names=made.names)
        del compute
        release_memory()

    return run.asNondeterministic()
