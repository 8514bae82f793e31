"""Prefix trie of conversations: double arrays over shards of the ordered turn sequences, merged where shards share nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regista.llm.common import materialise
from regista.llm.hashing import mix

#: Turns that a conversation takes from the first of its group: less than HEADS, by a hash of its id; conversations to a group.
HEADS, GROUP = 9, 5
#: Turns of a shard, about; sequences are dealt to shards in order, so that only the ends of a shard share nodes with others.
SHARD = 1 << 17
#: Free slots that are tried for the children of a node before they are put behind all others.
TRIES = 16
#: Ids of a piece of a node's list, so that a list of any length is hashed piece by piece.
PIECE = 512
NO_ENDS = hashlib.sha256(b"").hexdigest()

SHARED = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, spent long, once long, ends string"


def _ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, own): the turns of each conversation in order, each as k1, k2 (two 64-bit hashes of role and text) and size, the UTF-8 bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    row = F.struct("turn", role.alias("role"), F.xxhash64(role, text).alias("k1"), F.xxhash64(text, F.lit("role"), role).alias("k2"), F.octet_length(text).cast("long").alias("size"))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("own"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes) for turns (conv_id, turn, role, text): each conversation with its first turns replaced by those of the first conversation of its group of GROUP; seq has k1 and k2 of its turns one after the other."""
    own = materialise(_ordered(turns))
    heads = own.select(F.col("conv_id").alias("first"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    both = own.withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "first", "left")
    nothing = F.slice("own", 1, 0)
    seq = F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    both = both.select("conv_id", seq.alias("seq"))
    return both.select("conv_id", F.flatten(F.transform("seq", lambda x: F.array(x["k1"], x["k2"]))).alias("seq"), F.col("seq.size").alias("sizes"))


def _sequence_key() -> list[Column]:
    return [F.xxhash64("seq").alias("s1"), F.xxhash64(F.lit(7), "seq").alias("s2")]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s1, s2, conv_id) in order as (s1, s2, first, ids), up to PIECE ids of a sequence in a row."""
    for batch in batches:
        s1, s2, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(ids):
            continue
        new = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        run = np.flatnonzero(new)
        since = np.arange(len(ids)) - np.repeat(run, np.diff(np.append(run, len(ids))))
        cuts = np.flatnonzero(since % PIECE == 0)
        ends = np.append(cuts[1:], len(ids))
        joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, ends, strict=True)]
        yield pa.record_batch({"s1": s1[cuts], "s2": s2[cuts], "first": ids[cuts], "ids": pa.array(joined, pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as (s1, s2, ends), one row for a sequence; one piece is held at a time."""
    key, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for s1, s2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if key == (s1, s2):
                state.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, state.hexdigest()))
            key, state = (s1, s2), hashlib.sha256(ids.encode())
        yield _digest_rows(done)
    yield _digest_rows([(*key, state.hexdigest())] if key else [])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.record_batch({"s1": pa.array(columns[0], pa.int64()), "s2": pa.array(columns[1], pa.int64()), "ends": pa.array(columns[2], pa.string())})


def ends_digests(keyed: DataFrame) -> DataFrame:
    """(s1, s2, ends): the hash of the ascending ids of the conversations with one sequence, for keyed (s1, s2, conv_id). Ids are put in order in ranges, so a sequence of very many conversations is dealt to many tasks; the task that hashes its list reads one row for PIECE ids and holds one of them."""
    order = ["s1", "s2", "conv_id"]
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = sorted_.mapInArrow(_pieces, "s1 long, s2 long, first long, ids string")
    return parts.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "first").mapInArrow(_digests, "s1 long, s2 long, ends string")


class DoubleArray:
    """A trie in two arrays: the child of slot s by code c is slot base[s] + c, if check of that slot is s. Slot 0 is the root. Codes are dense: turns get theirs in the order in which nodes need them, so that siblings have near ones and their slots lie close together."""

    def __init__(self, turns: int):
        self.base, self.check = np.zeros(1024, dtype=np.int64), np.full(1024, -1, dtype=np.int64)
        self.check[0] = 0
        self.low = self.top = 1
        self.code = np.full(turns, -1, dtype=np.int64)
        self.codes = 0

    def _room(self, slots: int) -> None:
        if slots > len(self.check):
            more = max(slots, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, dtype=np.int64)), np.append(self.check, np.full(more, -1, dtype=np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        span = n
        while True:
            self._room(self.low + span)
            found = np.flatnonzero(self.check[self.low : self.low + span] < 0)
            if len(found) >= n:
                return found[:n] + self.low
            span *= 2

    def add(self, parents: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Slots of new nodes, the children by turns of parents, which are in ascending order and have no children yet."""
        fresh, at = np.unique(turns[self.code[turns] < 0], return_index=True)
        self.code[fresh[np.argsort(at)]] = self.codes + np.arange(len(fresh))
        self.codes += len(fresh)
        codes, slots = self.code[turns], np.empty(len(turns), dtype=np.int64)
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if len(parents) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(parents)))
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            steps = codes[a : a + n] - codes[a : a + n].min()
            for f in [*self._free(TRIES).tolist(), self.top]:
                self._room(f + int(steps.max()) + 1)
                if (self.check[f + steps] < 0).all():
                    break
            slots[a : a + n] = f + steps
            self.check[f + steps] = parents[a]
            self.top = max(self.top, f + int(steps.max()) + 1)
        alone = starts[sizes == 1]
        if len(alone):
            slots[alone] = self._free(len(alone))
            self.check[slots[alone]] = parents[alone]
            self.low = int(slots[alone][-1]) + 1
            self.top = max(self.top, self.low)
        self.base[parents] = slots - codes
        return slots

    def step(self, slots: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of slots by turns, -1 where there is none."""
        to = self.base[slots] + self.code[turns]
        inside = (self.code[turns] >= 0) & (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == slots), to, -1)

    def walk(self, turns: np.ndarray) -> list[int]:
        """The slots from the root along turns, as far as the trie goes."""
        path = [0]
        for t in turns:
            to = int(self.step(np.array(path[-1:]), np.array([t]))[0])
            if to < 0:
                break
            path.append(to)
        return path


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists and where each row's begin; a null has none."""
    rows = pa.concat_arrays([c.cast(pa.large_list(pa.int64())) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_list(pa.int64()))
    lengths = np.array(rows.value_lengths().fill_null(0), dtype=np.int64)
    return rows.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _shard(rows: pa.Table, bound: pa.Table) -> pa.Table:
    """Nodes of one shard's distinct sequences, with what this shard adds to each (see SHARED). bound has the last sequence of the shard before and the first of the one behind."""
    values, starts = _lists(pa.chunked_array([*rows["seq"].chunks, *bound["before"].chunks, *bound["behind"].chunks]))
    pairs, starts = values.reshape(-1, 2), starts // 2
    distinct, turn = np.unique(pairs, axis=0, return_inverse=True)
    turn = turn.reshape(-1)
    n = rows.num_rows
    lengths = np.diff(starts)[:n]
    order = np.argsort(-lengths, kind="stable")
    begin, length = starts[:-1][:n][order], lengths[order]
    count, least = rows["n"].to_numpy()[order], rows["conv_id"].to_numpy()[order]
    sizes, size_at = _lists(rows["sizes"])
    size_at = size_at[:-1][order]

    trie = DoubleArray(len(distinct))
    at, levels, told = np.zeros(n, dtype=np.int64), [], []
    for d in range(int(length.max(initial=0))):
        k = int(np.searchsorted(-length, -d, side="left"))  # sequences longer than d come first
        key, some, back = np.unique(at[:k] * len(distinct) + turn[begin[:k] + d], return_index=True, return_inverse=True)
        new = trie.add(key // len(distinct), key % len(distinct))
        levels.append(new)
        told.append((key % len(distinct), sizes[size_at[some] + d]))
        at[:k] = new[back.reshape(-1)]

    slots = len(trie.check)
    depth, size, own = (np.zeros(slots, dtype=np.int64) for _ in range(3))
    k1, k2 = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint64)
    k1[0], k2[0] = 1, 2
    for d, (new, (ids, bytes_)) in enumerate(zip(levels, told, strict=True), 1):
        depth[new], size[new] = d, bytes_
        up, own_keys = trie.check[new], distinct[ids].view(np.uint64)
        k1[new] = mix(k1[up] * np.uint64(0x9E3779B97F4A7C15) + own_keys[:, 0])
        k2[new] = mix(k2[up] * np.uint64(0xC2B2AE3D27D4EB4F) + own_keys[:, 1])

    # every sequence goes down the arrays to its last node
    end = np.zeros(n, dtype=np.int64)
    for d in range(len(levels)):
        k = int(np.searchsorted(-length, -d, side="left"))
        end[:k] = trie.step(end[:k], turn[begin[:k] + d])
    convs, first = np.zeros(slots, dtype=np.int64), np.full(slots, np.iinfo(np.int64).max)
    convs[end], first[end] = count, least
    ends = np.full(slots, NO_ENDS, dtype=object)
    ends[end] = np.array(rows["ends"].to_pylist(), dtype=object)[order]

    own[0], own[np.concatenate([[0], *levels]).astype(np.int64)] = 1, 1
    children = np.zeros(slots, dtype=np.int64)
    if bound["before"].null_count == 0:  # nodes that a shard before has as well are counted there
        own[trie.walk(turn[starts[n] : starts[n + 1]])] = 0
    inner = np.zeros(slots, dtype=bool)
    for new in levels:
        inner[trie.check[new]] = True
        np.add.at(children, trie.check[new], own[new])
    leaves = np.where(inner, 0, 1)
    if bound["behind"].null_count == 0:
        path = trie.walk(turn[starts[n + 1] : starts[n + 2]])
        if starts[n + 2] - starts[n + 1] >= len(path) and not inner[path[-1]]:
            leaves[path[-1]] = 0  # its children are in the shard behind
    spent, once = np.zeros(slots, dtype=np.int64), own * size
    for new in reversed(levels):
        up = trie.check[new]
        spent[new] += convs[new] * size[new]
        np.minimum.at(first, up, first[new])
        for sums in (convs, leaves, spent, once):
            np.add.at(sums, up, sums[new])
    nodes = np.concatenate([[0], *levels]).astype(np.int64)
    up = trie.check[nodes]
    top = nodes == 0
    columns = {"k1": k1[nodes].view(np.int64), "k2": k2[nodes].view(np.int64), "p1": pa.array(k1[up].view(np.int64), mask=top), "p2": pa.array(k2[up].view(np.int64), mask=top)}
    columns |= {"depth": depth[nodes], "conv_id": first[nodes], "n_convs": convs[nodes], "n_children": children[nodes], "n_leaves": leaves[nodes], "spent": spent[nodes], "once": once[nodes], "ends": pa.array(ends[nodes], pa.string())}
    return pa.table(columns)


def trie_nodes(sequences: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of sequences (conv_id, seq, sizes), as rebuilt() gives them: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal sequences are one row with a count from the start, so a conversation
    that many have costs no more than one. Distinct sequences are put in order
    and cut into shards of about SHARD turns, also in the middle of a common
    beginning. A shard packs its nodes into a double array, walks it, and sums
    up its subtrees. A node that several shards have is counted by the first of
    them alone where it counts once, so all that shards tell of it can be added.
    """
    keyed = sequences.select(*_sequence_key(), "conv_id", "seq", "sizes")
    distinct = keyed.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("seq").alias("seq"), F.first("sizes").alias("sizes"))
    distinct = materialise(distinct.join(ends_digests(keyed.select("s1", "s2", "conv_id")), ["s1", "s2"]))
    turns = distinct.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    dealt = distinct.repartitionByRange(int(turns // SHARD) + 1, "seq").select(F.spark_partition_id().alias("part"), "conv_id", "n", "seq", "sizes", "ends")
    dealt = materialise(dealt)
    along = Window.orderBy("part")  # one row for each shard
    bounds = dealt.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).select("part", F.lag("high").over(along).alias("before"), F.lead("low").over(along).alias("behind"))
    told = dealt.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(_shard, SHARED)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "spent", "once")]
    ends = F.coalesce(F.max(F.when(F.col("ends") != NO_ENDS, F.col("ends"))), F.lit(NO_ENDS))
    nodes = materialise(told.groupBy("k1", "k2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, ends.alias("ends_sha256")))
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    saved = F.col("spent") - F.col("once")
    return nodes.join(parents, ["p1", "p2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), "ends_sha256")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of turns (conv_id, turn, role, text), a row for each node; see trie_nodes().

    conv_id and depth name a node: it is the beginning of depth turns of that
    conversation, the smallest of its members. Turns are in order of their
    number, null first, then of role and a hash of the text, so that ties and
    repeated rows have a fixed order; repeated rows are turns of their own. A
    null role or text is empty, rows without a conv_id are left out, a
    conversation may be rebuilt without turns and ends at the root then. An
    empty table has no nodes, not even a root. Other columns are ignored. The
    ids of one conversation's turns (16 bytes each) are one row.
    """
    return trie_nodes(materialise(rebuilt(turns)))
