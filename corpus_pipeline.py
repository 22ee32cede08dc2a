"""The corpus pipeline: raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``, whatever they are called (but for names
with a dot, which PySpark's Arrow maps can't take). Null texts count as empty, null ids and sources are values
like others, repeated rows stay repeated unless a stage's own rule removes them, texts of any length are
taken whole, and an empty table passes as an empty table. Ids are whole numbers and need not be unique:
stages decide by row. Of rows that tie in id and text any one may stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, table
from factorloom.llm.mixing import mix_sources, numbered
from factorloom.llm.near_dedup import without_near_duplicates
from factorloom.llm.packing import pack_documents
from factorloom.llm.quality_model import fit_quality, score_quality
from factorloom.llm.registry import QUALITY_CUT
from factorloom.llm.secret_scan import mask_secrets
from factorloom.llm.tokens import default_vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    out = "__score" + "_" * max(map(len, docs.columns))  # longer than any other name
    return score_quality(docs, model, out=out).where(F.col(out) >= QUALITY_CUT).select(*[F.col(f"`{name}`") for name in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return without_near_duplicates(docs, percent=75)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times.

    Equal rows are one key, so any number of them comes together where it is read: the mix tells how many
    of them it takes, and the row, kept whole whatever its columns are called, is repeated as often. A key is
    128 bits of hash of the row, in which any two of 10^10 different rows agree with a chance below 10^-18.
    """
    columns = [F.col(f"`{name}`") for name in docs.columns]
    parts = [*columns, *map(F.isnull, columns)]
    key = F.concat(F.hex(F.xxhash64(*parts)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *parts)))
    rows = docs.select(key.alias("key"), F.struct(*columns).alias("row"))
    mixed = mix_sources(docs.select(key.alias("doc_id"), "source", "text"), weights=(3, 1, 2), share=1.5, cap=2.0)
    taken = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("n"))
    kept = rows.groupBy("key").agg(F.first("row").alias("row")).join(taken, "key").select("row", "n")
    return numbered(kept).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, default_vocabulary(), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", hide_secrets),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: SQL cannot express the classifier, the sampling or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
