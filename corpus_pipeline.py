"""Documents to training shards: toxicity, near duplicates, benchmark passages, mixture, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyratory.llm import decontaminate, kd_shards, near_copies, queries, raking, severity
from gyratory.llm.carried import carried, restored
from gyratory.session import scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxicity stays under the threshold; the model learns from `labels` and the documents themselves.

    Null and empty texts are judged like any other; repeated rows share their fate; an empty table stays empty. Extra columns, whatever their names, are kept.
    """
    rows, own = carried(docs, "doc_id", "text")
    model = severity.fit_severity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = severity.severity(model, spark)
    return restored(rows.filter(score("text")["toxicity"] < severity.REJECT), own, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id.

    Texts without words, null ones too, are one group; a null doc_id is smaller than any other; of rows that repeat doc_id and text one stays. An empty
    table stays empty. Extra columns, whatever their names, are kept.
    """
    rows, own = carried(docs, "doc_id", "text")
    return restored(near_copies.first_of_each(rows), own, docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of test items; what is nothing else goes. n_chars is counted again.

    Null and empty texts stay as they are; so do texts without a hit, their n_chars too. Repeated rows give repeated results; an empty table stays empty.
    Extra columns, whatever their names, are kept.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # whole texts go to Python and back, so they go once
    rows, own = carried(docs, "doc_id", "text", once=["text"])
    clean = decontaminate.find_phrases(rows, items, size=10, clean=True)
    left = F.size("spans") == 0
    clean = clean.filter(left | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    n_chars = F.when(left, F.col(own).getField("n_chars")).otherwise(F.char_length("text"))
    return restored(clean, own, docs.columns, text=F.col("text"), n_chars=n_chars)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of nine tenths of the tokens, raked towards the shares of sources, languages and topics.

    Null names count as empty names, which keep their natural share; documents without tokens stay with a chance of nine tenths. Repeated rows are drawn
    together; an empty table stays empty. Extra columns, whatever their names, are kept.
    """
    rows, own = carried(docs, "doc_id", "text", "lang", "source")
    drawn = raking.draw_documents(rows, queries.MIX, fraction=0.9, topic=raking.topic_of(F.col("text"), queries.TOPICS))
    return restored(drawn, own, docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the number of their shard, of 24 with near-equal bytes.

    Null texts and names count as empty; rows equal in doc_id and text share a shard; an empty table stays empty. `shard` replaces a column of that name; other
    extra columns, whatever their names, are kept.
    """
    rows, own = carried(docs, "doc_id", "text", "lang", "source")
    placed = kd_shards.with_shard(rows, shards=24)
    return restored(placed, own, [c for c in docs.columns if c != "shard"], shard=F.col("shard"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("sharding", sharding)]

#: A trained model, fingerprints and connected components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
