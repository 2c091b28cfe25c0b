"""A training corpus from `documents` in five stages; run() applies them in order, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuelake.llm import mixing, near_dedup, packing, quality_rules, substring_dedup
from tissuelake.llm.common import scratch_dir


# Each stage takes a table with the columns of documents and any others, of whatever names, in any order of rows; all but the last return the same
# columns. Rows given twice are two documents until the near-duplicate stage; an empty table gives an empty one.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy v1 of the quality rules keeps. Null and empty texts have too few words and go; doc_id is not looked at."""
    return quality_rules.keep_good(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a resemblance of 0.8 or more: that of the smallest doc_id.

    Of rows alike in all columns one stays; rows without doc_id stay only if their group has no other. Texts without words are all kept.
    """
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that an earlier document has; documents that nothing is left of go, and so do those without words.

    Earlier means a smaller doc_id, none being the smallest; n_chars is counted anew.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    cut = substring_dedup.remove_repeats(rows, window=20, keep=["row"]).where("n_words > n_removed")
    columns = {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return cut.select(*(columns.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix of sources takes; a null source is a source, texts without words go, ties are drawn by a seeded hash."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2,048 tokens. A null text is an empty document; other columns are left out."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixing", mixed), ("packing", packed)]

#: Tokenizing cannot be expressed in SQL. The tests run the stages on awkward and empty tables and hold each against plain Python at sf0.001.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
