"""A corpus from raw documents to packed sequences, stage by stage.

Each stage reads what the one before it has written as Parquet into the shared folder. All but the
last return the columns of ``documents``. From the first to the last stage of a chain, each stage first deletes what
the stages before it had stored on their way, because they have been written by then. SQL expresses neither the classifier nor the packing, so
the pipeline is tested against brute-force versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.jaccard import jaccard_join
from tallywright.llm.mixing import in_mixed_order
from tallywright.llm.packing import in_file_order, pack_in_order, tokenizer_path
from tallywright.llm.privacy import sanitised
from tallywright.llm.shared import begin_chain, columns_of, end_chain, forget, private, stored
from tallywright.llm.toxicity import THRESHOLD, score, toxic_labels, train

#: Words of a shingle and similarity (per cent) of near copies.
SHINGLE, SHARE = 5, (80, 100)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the rows of ``docs`` that have labels.

    A null or empty text has the model's prior and stays. A caller's own ``score`` column is kept as it is.
    """
    begin_chain()
    model = train(docs, toxic_labels(spark, sf_dir))
    column = private("toxicity")
    return score(docs, model, column=column).where(F.col(column) < THRESHOLD).drop(column)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of linked ones.

    Rows that share an id are one document: they go or stay together, repeated ones as one row. Rows without an
    id, and texts without words, are linked with nothing and stay.
    """
    forget(docs)
    found = jaccard_join(docs, SHINGLE, SHARE)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull())
    return known.join(gone, "doc_id", "left_anti").select(columns_of(docs)).dropDuplicates().unionByName(docs.where(F.col("doc_id").isNull()))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced; null and empty texts stay as they are."""
    forget(docs)
    return sanitised(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix; a null source is a source of its own, repeated rows stay."""
    forget(docs)
    return in_mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; sequences follow the files read, hence the mix.

    A null or empty text is one piece with the closing id alone; an empty table gives no pieces.
    """
    forget(docs)
    out = pack_in_order(in_file_order(docs, "place"), tokenizer_path(), "place")
    end_chain()
    return out


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("privacy", privacy),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = stored(out, name) if k < len(STAGES) - 1 else out
    return docs
