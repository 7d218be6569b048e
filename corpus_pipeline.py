"""A corpus pipeline: each stage keeps documents, or their lines, for the next one.

Every stage reads what its predecessor kept as a written table, so that a lost executor
costs no more than a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, line_dedup, near_dup, sentencepiece_codec, toxicity
from scriptorium.llm.common import fold, table, work_table
from scriptorium.llm.queries import tokenizer_path


def _aside(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no operator's columns can meet them."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(1).alias("__1"), *[f"`{c}`" for c in other]).alias("__other"))


def _together(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__other")[c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; learned as op5 does, from two thirds of the labels.

    Null and empty texts have the score of a text without a match.
    """
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scored = toxicity.score_toxicity(_aside(docs), model, with_hits=False)
    return _together(scored.filter("predicted = 0"), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; those that so lose their last word go.

    Documents that lose nothing stay, empty ones too; a null text becomes an empty one. n_chars follows the text.
    """
    kept = line_dedup.dedup_lines(_aside(docs))
    kept = kept.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_dropped") == 0))
    out = _together(kept, docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; rows without an id or a word stay."""
    gone = near_dup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id or a text stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids; a null text has none."""
    return sentencepiece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: Learned scores can't be said in SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work_table(docs, f"stage-{name}")
    return docs
