"""Quality rules judged by document and by host.

Every document is measured and held against rules; failures are summed by host, each
host's rate is shrunk towards the mean of all hosts by a beta prior fitted to the hosts
themselves, and a host whose shrunk rate is too high takes its documents with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import add_fields, per_text, unused, utf8, work_table

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, at, times = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    start = np.flatnonzero(times[at] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[start + k] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # bytes.split() cuts at ASCII white space only
    lines, earlier = 0, set()
    for line in text.split(b"\n"):
        if line in earlier:
            lines += not (not line or line.isspace())
        earlier.add(line)
    # Continuation bytes aside, each byte of UTF-8 that isn't white space is a character of a word.
    return len(words), len(text.translate(None, _NOT_CHARS)), len(text) - len(text.translate(None, _SYMBOLS)), lines, repeated_words(words)


def _measure():
    return lambda part: [pa.array(x, pa.int64()) for x in zip(*map(measure, part.to_pylist()), strict=True)]


def rules() -> dict[str, Column]:
    """The rules by name, true for a document that fails. All count against its host; the first two also reject it."""
    return {
        "too_short": F.col("n_words") < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
    }


def measure_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures as columns."""
    return add_fields(docs, per_text(", ".join(f"{m} long" for m in MEASURES), _measure)(utf8("text")), MEASURES)


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate) from rows (host, failed): failures by host, shrunk.

    The prior is the beta distribution whose mean and variance are those of the hosts'
    raw rates, by the method of moments with hosts weighted alike; one row of three sums
    reaches the driver. Without variance the prior is worth a million documents.
    """
    by_host = failures.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    by_host = work_table(by_host, "host-failures")
    raw = F.col("n_failed") / F.col("n_docs")
    hosts, mean, square = by_host.agg(F.count(F.lit(1)), F.avg(raw), F.avg(raw * raw)).first()
    mean = mean or 0.0
    spread = (square or 0.0) - mean * mean
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if hosts and spread > 1e-12 else 1e6
    return by_host.withColumn("rate", (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight)))


def judge(measured: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Keep the documents that neither fail a base rule nor sit on a bad host.

    ``measured`` has the host column and what measure_documents() adds; it is read twice,
    so pass a work table without the texts where only verdicts are wanted. A host is bad
    if its shrunk failure rate is above ``max_rate``. Adds base_failed, host_rate and kept
    (columns of those names are replaced). Defined cases: null text is an empty one, which
    fails; a null host has no verdict and a null rate; repeated rows count each time; an
    empty table stays empty. Rows meet verdicts in a join on the host, which Spark splits
    if one host holds much of the corpus.
    """
    failed = rules()
    base = failed["too_short"] | failed["repetitive"]
    rates = host_rates(measured.select(F.col(host).cast("string").alias("host"), (base | failed["symbols"]).alias("failed")))
    at = unused("host", measured)
    rates = rates.select(F.col("host").alias(at), F.col("rate").alias("host_rate"))
    measured = measured.drop("base_failed", "host_rate", "kept").withColumn("base_failed", base)
    joined = measured.join(rates, measured[host].cast("string") == rates[at], "left").drop(at)
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_rate") <= max_rate, F.lit(True)))
