"""Near-duplicate documents by MinHash with tensored banding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialise, text_of, unpacked, whole, with_rank
from regista.llm.hashing import column_bytes, mix, pieces, seeds, word_hashes
from regista.llm.linking import BROADCAST_IDS, LANES, WORDS, among, confirmed, linked_sets, star_pairs

#: Words of a shingle.
WIDTH = 5
#: Least similarity of a link, in percent.
PERCENT = 85
#: The two collections hold SIDE small hashes each, of GROUP minimums each; every pair of a small hash of one and of the other is a table key.
SIDE, GROUP = 8, 3
#: Minimums that the small hashes of both collections take.
MINIMUMS = 2 * SIDE * GROUP
#: Items of a set that are hashed at a time, to stay in the cache.
ITEMS = 128


def shingle_sets(batch_text: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its word shingles."""
    hashes, starts = word_hashes(*column_bytes(batch_text))
    factors = seeds(width, 11)
    joined = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        joined += hashes[k : len(hashes) - width + 1 + k] * factors[k] if len(joined) else 0
    joined = mix(joined)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:  # fewer words than a shingle has: the whole sequence
            whole = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(hashes[:0])
    return out


def set_id(items: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def minimums(items: np.ndarray) -> np.ndarray:
    """MINIMUMS MinHash values of a set: the least 32-bit hash of its items by each of as many salts.

    Each salted item goes through a finaliser of its own (that of MurmurHash3).
    The least of item XOR salt alone follows the common leading bits of the
    items, so that on small sets one item would win under many of the salts.
    """
    salts = (seeds(MINIMUMS, 23) >> np.uint64(32)).astype(np.uint32)
    items = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMUMS, np.iinfo(np.uint32).max, dtype=np.uint32)
    hashed, shifted = np.empty((2, ITEMS, MINIMUMS), dtype=np.uint32)
    for k in range(0, len(items), ITEMS):
        part = items[k : k + ITEMS]
        x, y = hashed[: len(part)], shifted[: len(part)]
        np.bitwise_xor(part[:, None], salts[None, :], out=x)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            if factor > 1:
                np.multiply(x, np.uint32(factor), out=x)
        np.minimum(low, x.min(axis=0), out=low)
    return low.astype(np.uint64)


def small_hashes(low: np.ndarray) -> np.ndarray:
    """2 * SIDE hashes of GROUP minimums each, of the first and of the second collection."""
    small = (low.reshape(2 * SIDE, GROUP) * seeds(GROUP, 37)).sum(axis=1, dtype=np.uint64)
    return mix(small + seeds(2 * SIDE, 41)).view(np.int64)


def sketch(items: np.ndarray) -> np.ndarray:
    """WORDS longs with the last bit of the least item of each of LANES ranges, from a sorted set, and the number of ranges that have items: MinHash with one permutation."""
    lanes = items >> np.uint64(65 - LANES.bit_length())
    first = np.flatnonzero(np.concatenate([[True], lanes[1:] != lanes[:-1]]))
    bits = np.zeros(LANES, dtype=np.uint64)
    bits[lanes[first].astype(np.int64)] = items[first] & np.uint64(1)
    words = (bits.reshape(WORDS, 64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.append(words.view(np.int64), len(first))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in pieces(batches):
        sets = shingle_sets(batch.column(1))
        yield pa.record_batch(
            {
                "doc_id": batch.column(0),
                "key": batch.column(2),
                "id": pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "small": pa.array([small_hashes(minimums(s)) if len(s) else None for s in sets], longs),
            }
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = shingle_sets(batch.column(0))
        yield pa.record_batch({"hash": pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), "items": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})


def alike(x: Column, y: Column, percent: int) -> Column:
    """100 * |x and y| >= percent * |x or y| for two arrays without repeats."""
    both = F.size(F.array_intersect(x, y)).cast("long")
    return both * 100 >= (F.size(x) + F.size(y) - both) * percent


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate components of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct 5-word shingles, of words lower-cased
    in A-Z; a text of fewer words is one shingle, a text without words (or a
    null one) has an empty set and is linked with nothing. Documents are linked
    if 100 * intersection >= percent * union, tested on the whole sets for all
    pairs that share a table key. Equal sets are one node from the start, so
    copies never meet as pairs. component_id is the smallest doc_id that links
    lead to; kept is doc_id = component_id. Rows that repeat a doc_id are
    documents of their own: each has its row in the result, and equal ones
    have equal rows. A null doc_id is carried, is never the smallest unless
    its whole component has none, and is kept then. Other columns are ignored.
    """
    return _placed(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _placed(docs: DataFrame, percent: int) -> DataFrame:
    """A row for each of docs: doc_id, key (a hash of the text), n_shingles, component (a key of its own, null for an empty set), component_id."""
    told = docs.select("doc_id", "text", F.xxhash64(text_of()).alias("key")).mapInArrow(_describe, "doc_id long, key long, id long, n long, small array<long>")
    told = materialise(told)
    rows = told.where("id is not null")
    nodes = materialise(rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "small")]))

    # small hashes that a node has alone lead nowhere: only the others are combined to keys
    small = nodes.select("id", F.posexplode("small").alias("slot", "hash"))
    shared = small.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    side = [F.collect_list(F.when(F.col("slot") < SIDE, F.col("hash"))).alias("first"), F.collect_list(F.when(F.col("slot") >= SIDE, F.col("hash"))).alias("second")]
    live = small.join(shared, "hash").groupBy("id").agg(F.sum("m").alias("score"), *side)
    # central nodes, which share most, come first and so become the hubs of their buckets
    ranked = with_rank(live.where("size(first) > 0 and size(second) > 0").withColumnRenamed("id", "hash"), F.col("score").desc(), F.col("hash").asc(), name="id")
    keys = F.flatten(F.transform("first", lambda x: F.transform("second", lambda y: F.xxhash64(x, y))))
    known = nodes.select(F.col("id").alias("hash"), "doc_id", F.slice("small", 1, SIDE).alias("blocks"))
    ranked = materialise(ranked.select("id", "hash", keys.alias("keys")).join(known, "hash"))
    stars = materialise(star_pairs(ranked.select(F.col("id").alias("node"), F.explode("keys").alias("key"))))

    # the sets of nodes that share a table key, read once
    some = materialise(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    wanted = materialise(ranked.join(some, "id", "left_semi").select("id", "hash", "doc_id", "blocks"))
    texts = among(docs.select("doc_id", "text"), "doc_id", wanted.select("doc_id").distinct()).select("text")
    found = texts.mapInArrow(_sets, "hash long, items array<long>").dropDuplicates(["hash"])
    sets = materialise(found.join(wanted.select("id", "hash"), "hash").select("id", "items"))

    def test(pairs: DataFrame) -> DataFrame:
        return confirmed(pairs, sets, lambda x, y: alike(x, y, percent))

    def items(ids: DataFrame) -> DataFrame:
        return sets.withColumnRenamed("id", "node").join(ids, "node", "left_semi").select("node", F.explode("items").alias("h"))

    blocks = materialise(wanted.select(F.col("id").alias("node"), F.explode("blocks").alias("key")))
    part = linked_sets(stars, blocks, items, test, percent).withColumnRenamed("node", "id")
    joined = ranked.select("id", "hash", "doc_id").join(part, "id")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = nodes.select(F.col("id").alias("hash"), F.col("doc_id").alias("own"))
    found = alone.join(joined.join(least, "component").select("hash", "component_id", F.col("component").alias("place")), "hash", "left")
    found = found.select(
        F.col("hash").alias("id"),
        F.when(F.col("place").isNotNull(), F.struct("place", F.lit(0).cast("long").alias("hash"))).otherwise(F.struct(F.lit(-1).cast("long").alias("place"), "hash")).alias("component"),
        F.when(F.col("place").isNotNull(), F.col("component_id")).otherwise(F.col("own")).alias("component_id"),
    )
    return (
        told.select("doc_id", "key", "id", F.col("n").alias("n_shingles"))
        .join(found, "id", "left")
        .select("doc_id", "key", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the near-duplicates; of each component the row with the smallest doc_id stays.

    Of rows of a component that share that doc_id (or have none, where no row
    of it has one) the first in (text, source) order stays, and of rows equal
    in these too one. Rows are told apart by doc_id and a 64-bit hash of the
    text, so unlike rows under one doc_id are judged each by itself. Rows with
    an empty set all stay. All columns come back as they are, whatever their
    names; an empty table stays empty.
    """
    rows = materialise(_placed(docs, percent))
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    linked_rows = rows.where("component is not null")
    several = materialise(linked_rows.where(least).groupBy("component").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("component"))
    judged = linked_rows.where(~least).select("doc_id", "key", F.lit(None).cast("struct<place:bigint,hash:bigint>").alias("rivals"))
    again = linked_rows.where(least).join(several, "component").select("doc_id", "key", F.col("component").alias("rivals"))
    judged = materialise(judged.union(again).distinct())
    if judged.count() <= BROADCAST_IDS:
        judged = F.broadcast(judged)
    keyed = docs.select(whole(docs).alias("doc"), F.xxhash64(text_of()).alias("text_key"))
    same = F.col("doc.doc_id").eqNullSafe(judged["doc_id"]) & (F.col("text_key") == F.col("key"))
    kept = keyed.join(judged, same, "left_anti").select("doc")
    if several.take(1):
        order = F.struct(*[F.col("doc").getField(c) for c in ("text", "source") if c in docs.columns])
        first = keyed.join(judged.where("rivals is not null"), same).groupBy("rivals").agg(F.min_by("doc", order).alias("doc"))
        kept = kept.union(first.select("doc"))
    return unpacked(kept, docs.columns, "doc")
