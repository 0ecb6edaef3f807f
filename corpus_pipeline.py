"""Documents to training data: filter, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's `docs`. All but the last return the columns of
`documents`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import linechunks, pieces, plans, rules, sketches, tiling
from waymark.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    judged = rules.apply(docs, plans.table(spark, sf_dir, "labels"))
    return judged.where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that occurred before; `n_chars` follows the text."""
    out = linechunks.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.select(*(n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return sketches.keep_first(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return tiling.clean(docs, plans.table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with merge-dropout, and the text that they decode to."""
    out = pieces.encode(docs.select("doc_id", "text"), plans.piece_model(), drop=0.1, seed=20)
    return out.select("doc_id", "n_pieces", "piece_ids", "decoded")


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: SQL has no learned decision list and no merge-dropout; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plans.table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
