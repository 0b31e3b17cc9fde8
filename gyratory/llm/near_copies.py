"""Near copies: SimHash fingerprints meet by Golay keys, the Jaccard join finds what they miss, and pairs are verified by the sets of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyratory.llm.bitmaps import with_bit
from gyratory.llm.blocks import as_bytes
from gyratory.llm.components import components
from gyratory.llm.golay_simhash import close_links, simhash
from gyratory.llm.jaccard_join import Similarity, jaccard_links, name_of, shingle_sets
from gyratory.session import materialise

#: Levels of sizes of the join reach to this times their first size; at 0.8 and 8/5 a tenth of the slices of the smaller sets would be empty, and all of those keys.
STEP = Fraction(5, 4)


def _hash_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _prints(docs: DataFrame, shingle: int, rule: Similarity, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row_hash, node, n, k, fingerprint): name and size of the set of shingles, how many slices it has, SimHash of the distinct words."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            sets = [(name_of(s), len(s)) for s in shingle_sets(texts, shingle)]
            nodes, sizes = (pa.array([s[i] for s in sets], pa.int64()) for i in range(2))
            slices = pa.array([rule.slices(n) for _, n in sets], pa.int64())
            prints = pa.array(np.array([simhash(t.lower().split(), 1, distinct=True) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), nodes, sizes, slices, prints], names=["doc_id", "row_hash", "node", "n", "k", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), _hash_of(text).alias("row_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row_hash long, node long, n long, k long, fingerprint long")


def _near(classes: DataFrame, crowd: int) -> DataFrame:
    """(x, y): each class with one whose fingerprint is equal or within two bits, if there is any. The join needs no more, since it finds all links itself."""
    prints = materialise(classes.groupBy("fingerprint").agg(F.min("node").alias("least")))
    meet = close_links(prints, crowd).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a").agg(F.min("b").alias("b"))
    near = meet.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select("x", "y")
    same = classes.join(prints, "fingerprint").filter("node <> least").select(F.col("node").alias("x"), F.col("least").alias("y"))
    return near.union(same)


def near_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, crowd: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_hash, keep_id, keep_hash) of each document: the first (smallest doc_id) of its group.

    Two texts are linked when the sets of their `shingle`-word shingles (words end at ASCII white space, A-Z lower-cased; fewer words are one
    shingle) have a Jaccard similarity of `least` or more; chains of links make a group. Equal sets, those without
    words too, are one class from the start. Null texts are empty. A null doc_id is smaller than any other. Rows that repeat doc_id and text
    are one document. An empty table gives no rows.

    Fingerprints are SimHashes of distinct words; those within two bits of each other meet by their Golay keys (`crowd` as in `close_links`).
    All classes then go through the exact Jaccard join, so that no pair depends on bits, keys or sizes of buckets: fingerprints only
    join early what would be compared later. Texts themselves travel nowhere, sets only where a pair is verified.
    """
    rule = Similarity(Fraction(str(least)), STEP)
    rows = materialise(_prints(docs, shingle, rule, doc_id, text))
    first = F.min(F.struct("doc_id", "row_hash")).alias("first")
    classes = materialise(rows.groupBy("node").agg(first, F.max("n").alias("n"), F.max("k").alias("k"), F.min("fingerprint").alias("fingerprint")))
    worded = classes.filter("n > 0")
    links = jaccard_links(docs, worded.select("node", "k"), shingle, rule, text=text, near=_near(worded, crowd))
    named = materialise(classes.join(components(links), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    named = named.join(heads, "root").select("node", F.col("head.doc_id").alias("keep_id"), F.col("head.row_hash").alias("keep_hash"))
    return rows.join(named, "node").select("doc_id", "row_hash", "keep_id", "keep_hash")


def first_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8, crowd: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `near_groups` keeps, with their own columns; of rows that repeat doc_id and text one, by a hash of all columns.

    Only rows that may have to go meet the list of those that do, and of those that repeat.
    """
    groups = near_groups(docs, shingle, least, crowd, doc_id, text)
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))
    named = groups.groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).agg(F.bool_and(first).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    named = materialise(named.filter("NOT _first OR _rows > 1").select("_id", "_hash", "_first"))
    rows = docs.withColumn("_g_hash", _hash_of(text)).withColumn("_h", F.xxhash64(F.col(doc_id), F.col("_g_hash")))
    rows = with_bit(rows, "_h", named.withColumn("h", F.xxhash64("_id", "_hash")), "h")
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_g_hash") == F.col("_hash"))
    columns = [F.col(c) for c in docs.columns]
    stay = rows.filter("NOT _bit").union(rows.filter("_bit").join(named.drop("_first"), same, "left_anti")).select(*docs.columns)
    repeated = rows.filter("_bit").join(named.filter("_first").drop("_first"), same, "left_semi")
    one = repeated.groupBy(F.col(doc_id), F.col("_g_hash")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")
    return stay.union(one)
