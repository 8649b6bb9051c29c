"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import bucket_of


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, folds: int, fold: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most per_class rows of each class outside the fold, drawn by a hash of the id.

    Only ids and labels are ordered; at most 2 * per_class of them are broadcast to the scan of texts.
    Where an id has both labels the larger one counts, and where it has several texts the first in
    byte order, so the sample depends neither on partitions nor on repeats; null ids and labels are left out.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where((bucket_of(F.col(id_col), folds) != fold) & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    drawn = [rows.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
