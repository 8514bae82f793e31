"""Packing documents into training sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialise, with_rank
from regista.llm.hashing import column_bytes

#: Tokens of a sequence.
CAPACITY = 4096
#: The id that ends each document.
END = 2
#: Sequences that one block of pieces should fill; a block is packed in one task.
WINDOWS = 128
#: Bytes of text that a task encodes at a time.
BATCH = 16 << 20
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces at of data in a row, piece k being data[starts[k]:starts[k + 1]], and where each begins, with the end of the last."""
    sizes = np.diff(starts)[at]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(starts[at] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Ids:
    """The ids of whole texts.

    The tokenizer splits at white space and between letters and other signs
    before it merges, and folds case, so a text's ids are its words' ids in
    turn, and a plain word's are those of its letters and of the stops after
    them. Arrow splits the texts of a batch and numbers their distinct words,
    and of these the distinct runs of letters and of stops; each of them is
    encoded once, the runs many in a call, and NumPy puts the ids in a row.
    """

    plain = r"^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<stop>[.,;:!?]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def of_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of letters in a row, and where each begins, with the end of the last."""
        ids, starts, n = [np.zeros(0, dtype="<u4")], [np.zeros(1, dtype=np.int64)], 0
        for k in range(0, len(runs), 2048):
            part = runs[k : k + 2048]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)  # each run a word of its own
            ids.append(np.array(e.ids, dtype="<u4"))
            starts.append(n + np.searchsorted(np.array(e.word_ids), np.arange(1, len(part) + 1)))
            n += len(ids[-1])
        return np.concatenate(ids), np.concatenate(starts)

    def of_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As of_runs(), for words of any kind."""
        found = [np.array(e.ids, dtype="<u4") for k in range(0, len(words), 4096) for e in self.tokenizer.encode_batch(words[k : k + 4096], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As of_runs(), for distinct words."""
        parts = pc.extract_regex(words, self.plain)
        runs = pc.utf8_lower(pc.struct_field(parts, "run")).dictionary_encode()
        stops = pc.struct_field(parts, "stop").dictionary_encode()
        other = np.asarray(pc.is_null(runs)).astype(bool)
        pools = [self.of_runs(runs.dictionary.to_pylist()), self.of_any(stops.dictionary.to_pylist()), self.of_any(words.filter(pa.array(other)).to_pylist())]
        data = np.concatenate([ids for ids, _ in pools])
        shift = np.cumsum([0, *[len(ids) for ids, _ in pools]])
        starts = np.concatenate([begins[:-1] + n for (_, begins), n in zip(pools, shift, strict=False)] + [shift[-1:]])
        first = np.cumsum([0, *[len(begins) - 1 for _, begins in pools]])
        # a plain word is a run and its stops, another one piece and nothing: the last piece, which is empty
        starts = np.append(starts, starts[-1])
        at = np.empty((len(words), 2), dtype=np.int64)
        at[:, 0] = np.asarray(pc.fill_null(runs.indices, 0))
        at[:, 1] = first[1] + np.asarray(pc.fill_null(stops.indices, 0))
        at[other, 0] = first[2] + np.arange(other.sum())
        at[other, 1] = len(starts) - 2
        ids, ends = gathered(data, starts, at.ravel())
        return ids, ends[::2]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end of the last; a null text has none."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        ids, ends = gathered(*self.of_words(coded.dictionary), coded.indices.to_numpy())
        offsets = np.asarray(split.offsets)
        return ids, ends[offsets - offsets[0]]


def bounded(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Smaller batches (doc_id, text), of about size bytes of text, or of one text where it is longer."""
    for batch in batches:
        _, offsets = column_bytes(batch.column(1))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def cut_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens.

    Documents longer than a sequence are cut at its multiples, others are whole.
    """
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
        ids_of = Ids(path)
        last = np.array([end], dtype="<u4")
        for batch in bounded(batches):
            ids, starts = ids_of(batch.column(1))
            rows = []
            for doc_id, low, high in zip(batch.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                data = np.append(ids[low:high], last).tobytes()
                total = high - low + 1
                for start in range(0, total, capacity):
                    part = data[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp: the window (0 to k-1) of each length, and the largest window's sum.

    Each length starts as a partial partition with one filled window. The two
    partial partitions with the largest imbalance are merged, the fullest
    windows of one with the emptiest of the other, until one is left.
    """
    n = len(lengths)
    heap = [(-int(x), i, [int(x)], [i]) for i, x in enumerate(lengths)]  # sums descending, and for each a node; windows not listed are empty
    heapq.heapify(heap)
    parents: list[tuple[int, int]] = []  # node n + j joins two nodes
    serial = n
    while len(heap) > 1:
        _, _, s, a = heapq.heappop(heap)
        _, _, t, b = heapq.heappop(heap)
        over = max(0, len(s) + len(t) - k)  # so many windows meet one of the other
        sums, nodes = s[: len(s) - over], a[: len(a) - over]
        for i in range(over):
            parents.append((a[len(a) - 1 - i], b[k - len(s) + i]))
            sums.append(s[len(s) - 1 - i] + t[k - len(s) + i])
            nodes.append(n + len(parents) - 1)
        sums += t[: len(t) - over]
        nodes += b[: len(b) - over]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, nodes = [sums[i] for i in order], [nodes[i] for i in order]
        low = sums[-1] if len(sums) == k else 0  # what all windows hold makes no imbalance
        heapq.heappush(heap, (-(sums[0] - low), serial, sums, nodes))
        serial += 1
    _, _, sums, nodes = heap[0]
    window = np.zeros(n, dtype=np.int64)
    todo = list(zip(nodes, range(len(nodes)), strict=True))
    while todo:
        node, w = todo.pop()
        if node < n:
            window[node] = w
        else:
            a, b = parents[node - n]
            todo += [(a, w), (b, w)]
    return window, sums[0]


def fill(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each length, none above capacity: the window count rises until all fit. Lengths of capacity have windows of their own."""
    full = lengths >= capacity
    window = np.empty(len(lengths), dtype=np.int64)
    rest = lengths[~full]
    k = 0
    if len(rest):
        k = -(-int(rest.sum()) // capacity)
        while True:
            part, most = differencing(rest, k)
            if most <= capacity:
                break
            k += 1
        window[~full] = part
    window[full] = k + np.arange(int(full.sum()))
    return window


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, windows: int = WINDOWS) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most capacity tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A document's ids are the tokenizer's, without special tokens, then end; a
    null text has that id alone. Pieces are dealt evenly, in order of a hash, into blocks of about
    windows sequences; a block's pieces shorter than capacity go into near-equal
    windows by differencing(). Full pieces are in no block and are sequences of
    their own, so a very long document makes no block larger. A window
    holds its pieces in (doc_id, start) order, gapless from offset 0. Padding
    is what differencing leaves, and one window in a block at most. Rows that
    repeat a doc_id, and null ids, are documents of their own; however many rows
    are equal, no block gets more than its share of them. Texts of any length
    are read whole. Other columns are ignored; an empty table gives an empty
    table.
    """
    cut = materialise(cut_documents(docs, path, capacity, end))
    short = cut.where(F.col("length") < capacity)
    total = short.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, -(-total // (capacity * windows)))
    width = 1 << 24  # sequences that a block can number

    def place(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "start", "length", "ids_crc32", "doc_tokens"], kind="stable", na_position="last", ignore_index=True)
        window = fill(block["length"].to_numpy(), capacity)
        block["sequence_id"] = key[0] * width + window
        block["offset"] = block.groupby("sequence_id")["length"].cumsum() - block["length"]
        return block.drop(columns="block")

    # numbered along a hash of the row, so that equal rows are dealt to many blocks as well
    row = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")
    placed = short.withColumns({"row": row, "nth": F.monotonically_increasing_id()})
    dealt = with_rank(placed, F.col("row"), F.col("nth"), name="rank").withColumn("block", F.pmod("rank", F.lit(blocks))).drop("row", "nth", "rank")
    packed = dealt.groupBy("block").applyInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    # full pieces need no window: they are numbered in order, behind the numbers of all blocks
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = with_rank(cut.where(F.col("length") >= capacity), *[F.col(c) for c in columns], name="rank")
    return packed.union(full.select(*columns, (F.col("rank") + F.lit(blocks * width)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
