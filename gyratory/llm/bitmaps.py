"""A bitmap of fixed size over hashes, to leave out rows before a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, whatever the table holds: at most BITS / 64 words travel. A full one lets every row pass to the exact join.
BITS = 1 << 22


def _word(column: str):
    return F.floor(F.pmod(F.col(column), F.lit(BITS)) / 64).cast("int")


def with_bit(rows: DataFrame, column: str, hashes: DataFrame, of: str) -> DataFrame:
    """`rows` with `_bit`: false where column `of` of `hashes` does not hold the row's value; true has to be confirmed by a join.

    The words are partial sums of bits, at most BITS / 64 rows of them.
    """
    bit = F.expr(f"shiftleft(1L, CAST(pmod({of}, 64) AS INT))")
    words = hashes.select(_word(of).alias("_word"), bit.alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_bits"))
    out = rows.withColumn("_at", _word(column)).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    set_here = F.getbit(F.col("_bits"), F.pmod(F.col(column), F.lit(64)).cast("int")) == 1
    return out.withColumn("_bit", F.coalesce(set_here, F.lit(False))).drop("_at", "_word", "_bits")
