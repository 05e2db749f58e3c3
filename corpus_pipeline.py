"""The corpus pipeline: documents -> quality rules -> near-duplicate removal -> source mixing -> packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and gives what it reads back to the next.  All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitspark.llm import mixing, packing, quality, sigtree
from bitspark.llm.scratch import Stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules and the robust outlier test keep.

    Null and blank texts fail the plain rules and go.  Each row has its own verdict: repeated rows stay repeated, a null
    id, language or source is no reason to go, and a text of any length is read whole.  An empty table gives an empty one.
    """
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by n-gram Jaccard similarity that with the smallest id; rows without words stay.

    Of equal ids that with the smallest hash of its columns stays, and null ids come last; repeated rows are copies, so that one
    of them stays.  An empty table gives an empty one.
    """
    return sigtree.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for each epoch in which words of a document are drawn, with the drawn words as its text.

    A document none of whose words are taken is left out, as is one without words; one that is taken beyond its size is there
    twice.  A null source is a source of its own and a null id an id like others; repeated rows are documents of their own.  An empty
    table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's bucket, batch and place.

    A null or blank text has one token, its end; null ids and repeated rows are packed like others, and rows of one id and
    length follow each other.  Nothing is cut or left out.  An empty table gives an empty one.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_lengths),
]

#: The robust outlier estimates of the first stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Stored(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return docs
