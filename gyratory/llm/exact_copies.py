"""Exact copies by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyratory.llm.blocks import as_bytes
from gyratory.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (modulus, base) of the two fingerprints. Moduli stay under 2**31, so that products fit 64 bits.
FIELDS = ((2147483647, 1_000_003), (2147483629, 998_244_353))
CHUNK = 1 << 16

_PART = "part int, size long, f1 long, s1 long, f2 long, s2 long"


def chunk_hash(data: bytes, modulus: int, powers: np.ndarray) -> int:
    """Sum of byte * base**(distance to the end) modulo a prime."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return int((values * powers[len(powers) - len(values):]).sum(dtype=np.uint64) % np.uint64(modulus))


def powers_of(modulus: int, base: int, n: int = CHUNK) -> np.ndarray:
    """base**(n-1) .. base**0; n products of a byte and a power stay under 2**64."""
    out, x = np.empty(n, np.uint64), 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


def joined(left: int, right: int, shift: int, modulus: int) -> int:
    """Fingerprint of two neighbouring pieces; shift is base**length of the right one."""
    return (left * shift + right) % modulus


def fingerprint(data: bytes, tables: list[np.ndarray], fields=FIELDS) -> list[int]:
    """f1, s1, f2, s2 of a piece: chunk hashes joined by length-shifted arithmetic, and base**length."""
    out = []
    for (modulus, base), powers in zip(fields, tables, strict=True):
        total = 0
        for i in range(0, len(data), CHUNK):
            chunk = data[i : i + CHUNK]
            total = joined(total, chunk_hash(chunk, modulus, powers), pow(base, len(chunk), modulus), modulus)
        out += [total, pow(base, len(data), modulus)]
    return out


def fingerprint_pieces(pieces: DataFrame, fields=FIELDS) -> DataFrame:
    """Fingerprint of each row of `pieces` (any key columns, `part` int, `piece` binary already normalised); the bytes are left out.

    With `whole` set, the row is a whole document, and its SHA-256 is added as `sha`.
    """
    keep = [c for c in pieces.columns if c not in ("piece", "whole", "sha")]
    schema = pa.schema([("size", pa.int64()), *[(c, pa.int64()) for c in ("f1", "s1", "f2", "s2")], ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [powers_of(m, b) for m, b in fields]
        for batch in batches:
            whole, given, rows = batch.column("whole").to_pylist(), batch.column("sha").to_pylist(), []
            for data, one, sha in zip(as_bytes(batch.column("piece")), whole, given, strict=True):
                data = data.lower()  # of bytes: changes A-Z only
                rows.append([len(data), *fingerprint(data, tables, fields), hashlib.sha256(data).hexdigest() if one else sha])
            made = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            arrays = [batch.column(c) for c in keep] + [pa.array(x, f.type) for x, f in zip(made, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *schema.names])

    kinds = dict(pieces.dtypes)
    return pieces.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "size long, f1 long, s1 long, f2 long, s2 long, sha string"]))


def _fold(name: str, shift: str, modulus: int) -> Column:
    return F.aggregate("_parts", F.lit(0).cast("long"), lambda acc, x: (acc * x[shift] + x[name]) % F.lit(modulus))


def join_pieces(parts: DataFrame, keys: list[str], fields=FIELDS) -> DataFrame:
    """One row per document: keys, size, f1, f2, sha, copies. Pieces of a document are joined in order of `part`.

    Rows that repeat a document whole (same keys) are told by repeats of part 0 and counted in `copies`.
    """
    whole = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("part", "size", "f1", "s1", "f2", "s2"))).alias("_parts"),
        F.max("sha").alias("sha"),
        F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).alias("copies"),
    )
    size = F.aggregate("_parts", F.lit(0).cast("long"), lambda acc, x: acc + x["size"])
    return whole.select(*keys, size.alias("size"), _fold("f1", "s1", fields[0][0]).alias("f1"), _fold("f2", "s2", fields[1][0]).alias("f2"), "sha", "copies")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fields=FIELDS, spread: int = 32 << 20) -> DataFrame:
    """(doc_id, row_hash, size, f1, f2, sha, copies) of each document, A-Z lower-cased; null texts are empty.

    Texts of more than `spread` bytes are cut into pieces of that size which are dealt to all tasks and joined again.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("row_hash"), body.alias("body"))
    short = rows.filter(F.octet_length("body") <= spread).select(
        "doc_id", "row_hash", F.lit(0).alias("part"), F.col("body").cast("binary").alias("piece"), F.lit(True).alias("whole"), F.lit(None).cast("string").alias("sha")
    )
    long = rows.filter(F.octet_length("body") > spread).withColumn("body", F.translate("body", _UPPER, _LOWER))
    long = long.withColumn("sha", F.sha2("body", 256)).withColumn("body", F.col("body").cast("binary"))
    count = F.ceil(F.octet_length("body") / F.lit(spread)).cast("int")
    long = long.select("doc_id", "row_hash", "body", "sha", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    piece = F.expr(f"substring(body, part * {spread} + 1, {spread})")
    long = long.select("doc_id", "row_hash", "part", piece.alias("piece"), F.lit(False).alias("whole"), "sha").repartition("row_hash", "part")
    return join_pieces(fingerprint_pieces(short.union(long), fields), ["doc_id", "row_hash"], fields)


def _differing(texts: DataFrame, pairs: DataFrame, chunk: int) -> DataFrame:
    """Of `pairs` (doc_id, row_hash, rep_id, rep_hash), those whose texts differ, compared chunk by chunk.

    `texts` has doc_id, row_hash and body of all documents named in `pairs`.
    """
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(chunk)).cast("int"))
    chunks = texts.select("doc_id", "row_hash", "body", F.explode(F.sequence(F.lit(0), count - 1)).alias("no"))
    chunks = chunks.select("doc_id", "row_hash", "no", F.expr(f"substring(body, no * {chunk} + 1, {chunk})").alias("chunk"))
    mine = chunks.join(pairs, (chunks["doc_id"].eqNullSafe(pairs["doc_id"])) & (chunks["row_hash"] == pairs["row_hash"])).select(
        chunks["doc_id"], chunks["row_hash"], "rep_id", "rep_hash", "no", "chunk"
    )
    heads = pairs.select("rep_id", "rep_hash").distinct()
    first = chunks.join(heads, (F.col("doc_id").eqNullSafe(F.col("rep_id"))) & (F.col("row_hash") == F.col("rep_hash"))).select(
        F.col("rep_id").alias("r_id"), F.col("rep_hash").alias("r_hash"), F.col("no").alias("r_no"), F.col("chunk").alias("r_chunk")
    )
    both = mine.join(first, (mine["rep_id"].eqNullSafe(first["r_id"])) & (mine["rep_hash"] == first["r_hash"]) & (mine["no"] == first["r_no"]), "left")
    return both.filter(~F.coalesce(F.col("chunk") == F.col("r_chunk"), F.lit(False))).select("doc_id", "row_hash").distinct()


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fields=FIELDS, chunk: int = 1 << 20, spread: int = 32 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each document; of equal texts the one with the largest doc_id stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. A null doc_id is smaller than any other. Rows that
    repeat both doc_id and text are one document: one row, each counted in group_size. An empty table gives no rows.

    Documents meet by size and two polynomial fingerprints. Every document is then compared, chunk by chunk, with the one that
    stays; what differs (a collision) forms groups of its own, until all agree. Only fingerprints are grouped; texts
    of documents that share theirs with another are read a second time and moved once, and a hot group is joined, not gathered.
    """
    keys = ["size", "f1", "f2"]
    prints = materialise(fingerprints(docs, doc_id, text, fields, spread))
    order = F.struct("doc_id", "row_hash")
    groups = prints.groupBy(*keys).agg(F.max(order).alias("rep"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    shared = materialise(prints.join(groups, keys).select("doc_id", "row_hash", *keys, F.col("rep.doc_id").alias("rep_id"), F.col("rep.row_hash").alias("rep_hash")))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(body).alias("_hash"), body.alias("body"))
    names = shared.select("doc_id", "row_hash")
    texts = rows.join(names, rows["_id"].eqNullSafe(names["doc_id"]) & (rows["_hash"] == names["row_hash"]), "left_semi")
    texts = texts.select(F.col("_id").alias("doc_id"), F.col("_hash").alias("row_hash"), F.translate("body", _UPPER, _LOWER).cast("binary").alias("body"))
    texts = materialise(texts)
    while True:
        pairs = shared.filter(~(F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("row_hash") == F.col("rep_hash"))))
        bad = materialise(_differing(texts, pairs.select("doc_id", "row_hash", "rep_id", "rep_hash"), chunk))
        if bad.isEmpty():
            break
        bad = bad.select(F.col("doc_id").alias("b_id"), F.col("row_hash").alias("b_hash"), F.lit(True).alias("apart"))
        marked = shared.join(bad, shared["doc_id"].eqNullSafe(bad["b_id"]) & (shared["row_hash"] == bad["b_hash"]), "left")
        marked = marked.select(*shared.columns, F.coalesce("apart", F.lit(False)).alias("apart"))
        # those that differ from the same document are a group of their own from now on
        fresh = marked.filter("apart").groupBy("rep_id", "rep_hash").agg(F.max(order).alias("n"))
        fresh = fresh.select(F.col("rep_id").alias("o_id"), F.col("rep_hash").alias("o_hash"), "n")
        moved = marked.join(fresh, marked["apart"] & marked["rep_id"].eqNullSafe(fresh["o_id"]) & (marked["rep_hash"] == fresh["o_hash"]), "left")
        shared = materialise(
            moved.select("doc_id", "row_hash", *keys, F.when(F.col("apart"), F.col("n.doc_id")).otherwise(F.col("rep_id")).alias("rep_id"), F.when(F.col("apart"), F.col("n.row_hash")).otherwise(F.col("rep_hash")).alias("rep_hash"))
        )
    reps = shared.select(F.col("doc_id").alias("m_id"), F.col("row_hash").alias("m_hash"), "rep_id", "rep_hash", F.lit(True).alias("found"))
    out = prints.join(reps, prints["doc_id"].eqNullSafe(reps["m_id"]) & (prints["row_hash"] == reps["m_hash"]), "left")
    own = F.col("found").isNull()
    out = materialise(
        out.select("doc_id", "row_hash", "sha", "copies", F.when(own, F.col("doc_id")).otherwise(F.col("rep_id")).alias("keep_id"), F.when(own, F.col("row_hash")).otherwise(F.col("rep_hash")).alias("keep_hash"), own.alias("own"))
    )
    sizes = out.filter("NOT own").groupBy("keep_id", "keep_hash").agg(F.sum("copies").alias("n"))
    sizes = sizes.select(F.col("keep_id").alias("k_id"), F.col("keep_hash").alias("k_hash"), "n")
    out = out.join(sizes, out["keep_id"].eqNullSafe(sizes["k_id"]) & (out["keep_hash"] == sizes["k_hash"]), "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))
    return out.select("doc_id", "keep_id", F.coalesce("n", "copies").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
