"""From raw documents to packed sequences: five operators in a row, each on what the one before has kept."""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import drop, noting, read, shared_dir, tuned
from lattica.llm.linedup import drop_recurring_lines
from lattica.llm.neardup import near_duplicates
from lattica.llm.packing import default_tokenizer, pack_documents
from lattica.llm.repeats import cleaned
from lattica.llm.toxicity import scored, train

#: Tables that this thread's last stage has written beside its result.
_last = threading.local()


def _stage(f: Callable) -> Callable:
    """A stage; the stage before it has been written by then, so its intermediate tables go. No other tables do."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(getattr(_last, "tables", []))
        with noting() as _last.tables:
            return f(tuned(spark), docs, sf_dir)

    return run_stage


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels of those not held out, rejects are dropped.

    Null and empty texts have the score of no words, and stay; repeated rows stay or go together. No row, no result.
    """
    net = train(docs, read(spark, sf_dir, "labels"))
    return scored(docs, net, "_toxicity_score", "_toxicity_predicted").where("_toxicity_predicted = 0").select(*docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first, so that copies do not lose their only text.

    All rows stay: null texts are null, empty ones empty; repeated rows count as one text. n_chars is counted anew.
    """
    return _counted(drop_recurring_lines(docs, keep_first=True, counts=None).select(*docs.columns))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays.

    Texts that are null or without words, and rows without an id, stay. Rows that share an id stay or go together.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand twice in the corpus are cut out everywhere.

    All rows stay; null texts are null. Of rows with equal texts of that length nothing is left. n_chars is counted anew.
    """
    return _counted(cleaned(docs))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 ids; a null or empty text is one piece of one id."""
    return pack_documents(docs, default_tokenizer())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", packing)]
#: A trained network, similarity joins and a bin packing have no SQL; tests hold the stages against their operators and those
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is a Parquet table in the shared folder, and the next stage's input."""
    docs = read(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{top}/{name}")
        drop([(spark, f"{top}/{before}")] if before else [])
        docs, before = spark.read.schema(out.schema).parquet(f"{top}/{name}"), name
    drop(getattr(_last, "tables", []))
    return docs
