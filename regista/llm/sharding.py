"""Shards along a Hilbert curve through metadata dimensions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialise, text_of, whole, with_rank

SHARDS = 8
#: Bits of each dimension.
BITS = 8
#: Up to so many distinct values, a dimension's levels are broadcast (a value and a number each).
BROADCAST_VALUES = 10_000


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each column of levels (one row for each dimension, numbers of so many bits)."""
    x = [np.asarray(row, dtype=np.int64).copy() for row in levels]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = (out << 1) | (((row ^ turn) >> b) & 1)
    return out


def _with_level(rows: DataFrame, column: str, name: str, bits: int) -> DataFrame:
    """Adds the level of a string column: its values in order, null last, in 2 ** bits equal steps."""
    values = with_rank(rows.select(column).distinct(), F.col(column).asc_nulls_last(), name="_at")
    n = values.count()
    values = values.select(F.col(column).alias("_value"), F.floor(F.col("_at") * F.lit(1 << bits) / F.lit(max(1, n))).cast("int").alias(name))
    if n <= BROADCAST_VALUES:
        values = F.broadcast(values)
    return rows.join(values, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def _size_level(size: Column, bits: int) -> Column:
    """Levels of equal ratio, eight to a doubling."""
    return F.least(F.floor(F.log2(size.cast("double")) * 8), F.lit((1 << bits) - 1)).cast("int")


def shard_rows(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Shard and slot of each row of docs (doc_id, text, lang, source).

    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard, lang,
    source, hilbert. Language, source and size (UTF-8 bytes of the text plus 1,
    null text: 1) are quantised to bits bits each; strings by their place among
    the distinct values, sizes by ratio. Rows are numbered in order of their
    place on the Hilbert curve through the three levels, then of text_crc32
    and doc_id, and cut into runs: law 'rows', row counts differ by one at
    most, so a group of equal rows may span a cut. grown_shard is null, as a
    cut depends on all rows. Null values sort last and are levels of their
    own; rows equal in all columns are interchangeable. Texts of any length are
    read whole; an empty table stays empty; other columns are ignored.
    """
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), "lang", "source")
    rows = materialise(rows)
    rows = _with_level(_with_level(rows, "lang", "_lang", bits), "source", "_source", bits)
    rows = rows.withColumn("_size", _size_level(F.col("size"), bits))

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c]), bits))

    rows = rows.withColumn("hilbert", curve("_lang", "_source", "_size")).drop("_lang", "_source", "_size")
    placed = with_rank(rows, F.col("hilbert"), F.col("text_crc32"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("source").asc_nulls_last(), F.col("lang").asc_nulls_last())
    n = placed.count()
    shard = F.floor(F.col("rank") * shards / F.lit(max(1, n))).cast("int") if n * shards < 1 << 52 else F.expr(f"int(rank * {shards} div {n})")
    start = F.ceil(F.col("shard") * F.lit(n) / F.lit(shards)).cast("long")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "lang", "source", "hilbert"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = 100_000) -> None:
    """Write docs as Parquet under path/shard=N, in curve order, so that files cover small boxes of language, source and size.

    All columns are written as they are; one named shard, in any case, is
    written as shard_ instead, with as many '_' as it takes, since shard is the
    folder's. Rows that repeat doc_id, text, lang and source get the place of
    the first of them; no row is lost. Texts of any length are written whole; an empty
    table writes nothing but its schema.
    """
    keys = ["doc_id", "text_crc32", "source", "lang"]
    placed = shard_rows(docs, shards).groupBy(*keys).agg(F.min(F.struct("shard", "slot")).alias("place"))
    placed = placed.select(*[F.col(k).alias(f"key_{k}") for k in keys], "place.shard", "place.slot")
    own = docs.select(whole(docs).alias("doc"), "doc_id", F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"), "source", "lang")
    same = [F.col(k).eqNullSafe(F.col(f"key_{k}")) for k in keys]
    out = own.join(placed, reduce(lambda a, b: a & b, same)).select("doc", "shard", "slot")
    n = max(shards, -(-docs.count() // rows_per_file))
    out = out.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    names, taken = {}, {c.lower() for c in docs.columns}
    for c in docs.columns:
        names[c] = c
        while names[c].lower() == "shard" or (names[c] != c and names[c].lower() in taken):
            names[c] += "_"
    out.select(*[F.col("doc").getField(c).alias(name) for c, name in names.items()], "shard").write.partitionBy("shard").parquet(path)
