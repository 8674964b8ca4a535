"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept. All but the last return the columns of ``documents``. Between stages the
rows are written as Parquet to the shared folder and read again.

Null, empty and very long texts, repeated rows and empty tables pass through as
the operators define it; rows without an id take part.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortbeam.llm import decontaminate, line_dedup as lines, packing, simhash, toxicity as tox
from cohortbeam.llm.common import stored, table
from cohortbeam.llm.queries import encoder_path


def _shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but id and text under names that no operator uses,
    and those names by column."""
    names = {c: c if c in ("doc_id", "text") else f"_kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _unshielded(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = tox.train(docs, table(spark, sf_dir, "labels"))
    rows, names = _shielded(docs)
    return _unshielded(tox.score(rows, model).where("toxicity < 0.5"), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines are cut out; a document that
    consisted of nothing else goes, and n_chars follows the text."""
    rows, names = _shielded(docs)
    out = lines.line_dedup(rows, min_lines=2).where("n_deleted = 0 OR n_deleted < n_lines")
    if "n_chars" in names:
        n_chars = F.col(names["n_chars"])
        out = out.withColumn(names["n_chars"], F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(n_chars))
    return _unshielded(out, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id."""
    return simhash.one_of_each_group(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), window=13)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    pieces = packing.pack(docs, encoder_path(), seq_len=1024)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packed)]

#: Byte-pair encoding and a fitted classifier are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
