"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text leaves no remainder by five; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, longest: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, columns) of at most `most` labelled documents that are not held out, drawn by a hash of the doc_id.

    Texts of over `longest` bytes are left out of the sample, so that its bytes are bounded too. Labels with a null are left out; of
    several labels of one document the largest of each column counts. Only the drawn ids travel to the documents.
    """
    rows = labels.select(F.col(doc_id).alias("_id"), *columns).dropna().filter(~held_out(F.col("_id")))
    rows = rows.groupBy("_id").agg(*[F.max(c).alias(f"_{c}") for c in columns])
    drawn = rows.orderBy(F.xxhash64("_id"), "_id").limit(most)
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    # at most `most` rows of ids and labels
    out = body.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    return out.select("doc_id", "text", *[F.col(f"_{c}").alias(c) for c in columns])
