"""The corpus pipeline: five stages from the raw documents to packed sequences.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and gives what it keeps, in the columns
of documents but for the last.  ``run`` writes each stage's rows to the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.cluster import ship
from tokenloom.llm import decontaminate, toxicity
from tokenloom.llm.near_dedup import near_duplicates
from tokenloom.llm.packing import pack
from tokenloom.llm.passages import without_repeats
from tokenloom.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is below the cut of their language; null and empty texts have a score like others, rows without doc_id too."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones, one row of each doc_id and text, the least by its other columns, and every row without doc_id.

    Null and empty texts resemble nothing and stay.
    """
    ship(spark)
    found = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("kept").alias("kept"))
    found = Scratch(spark, "kept-documents").save(found, "found")
    rest = docs.join(found.where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    if found.where("rows > 1").limit(1).count():
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        least = rest.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_least"))
        rest = least.select("doc_id", "text", *[F.col("_least")[c].alias(c) for c in others]).select(*docs.columns).union(rest.where("doc_id IS NULL"))
    return rest


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, without the paragraphs and passages that an earlier place has."""
    ship(spark)
    return without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 ids; a null text is its end id, a null doc_id is carried through."""
    ship(spark)
    return pack(docs, capacity=4096, end=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated-passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained scores, MinHash and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = _table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
