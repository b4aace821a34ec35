"""From raw documents to a training mix, in five stages.

Every stage judges a row by its own text: rows without an id, or rows that repeat an id with
another text, neither save nor doom each other.  A null or blank text has no words, so the
first stage drops it.  No rows give no rows, and columns beyond documents' own are passed on.

Each stage takes (spark, docs, sf_dir) and works on everything that the one before kept; its
result is written and read again before the next.  All but the last return the columns of
documents; the last returns them too, each row as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenta.llm import decontaminate, line_dedup, ngram_jaccard, quality_rules, source_mixing
from lumenta.llm.common import durable, table


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the learned rules reject go; so do null and blank texts, which have no words.
    Rows without an id, or that repeat one, are judged one by one."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go; so does a document of which nothing is left.  A null or
    empty text had nothing to lose and stays.  Rows that repeat an id and text keep their
    lines; rows without an id, or with an id's other text, are documents of their own."""
    cut = line_dedup.line_dedup(docs)
    left = (F.col("_lm_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.filter(left).select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, in one row; rows
    without an id come last.  Null and blank texts link with nothing and stay."""
    return ngram_jaccard.distinct_documents(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps with a benchmark item go; null and blank texts overlap with none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's target asks for, 0 to 3 times; null is a source too.
    Rows that repeat an id come equally often; rows without one draw by their text."""
    return source_mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mix),
]

#: Learned rules and connected components have no SQL twin; the tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
