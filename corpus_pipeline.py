"""A corpus pipeline: quality, line rules, near copies, repeated passages, packing.

Each stage takes all that its predecessor kept; the stages' results are written
to the shared folder as Parquet and read again.

Null and empty texts are judged like others: the classifier scores them, the line
rules reject them, and none is a near copy of anything.  Very long texts are read
whole; equal ids with different texts stay apart; repeated rows of equal id and text
become one in the third stage; rows without an id stay unless they are near copies
of one that has an id.  Other columns pass through unchanged, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_rules, packing, parity_join, quality_vote, substring
from quern.llm.queries import fold
from quern.llm.scratch import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that their neighbours vote good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_vote.keep_good(docs, quality_vote.fit(docs, labels, fold(3) != 1))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines and the documents that lose too much or fail the base rules."""
    return line_rules.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five words, 0.8)."""
    return parity_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 20 or more words that occur earlier in the corpus."""
    return substring.cut(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's bucket and batch."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("packing", packed),
]

#: The stages train a classifier and compare whole texts: stages 2 to 5 are tested row by row
#: against plain versions (tests/llm/test_pipeline.py), the first by its accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
