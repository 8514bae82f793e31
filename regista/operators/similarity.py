"""An index over vectors: lists around centroids, of which a search reads the nearest and ranks their rows by the exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.operators.family import nearest

#: Rows that centroids are fitted to, on average: a bounded draw by a hash of the id. All rows are put into lists.
SAMPLE = 20_000
TURNS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def centroids(rows: DataFrame, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors around which so many lists are made, by k-means over the directions of a drawn sample of rows (id, embedding); fewer if the sample has fewer rows. What the driver holds is bounded by sample."""
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(71), "id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n)))
    drawn = rows.where("embedding is not null").where(draw).select("id", "embedding").orderBy("id").collect()
    x = _unit(np.array([r["embedding"] for r in drawn], dtype=np.float64)) if drawn else np.zeros((0, 1))
    if not len(x):
        return x
    # far apart starts: each the row that is least like those before it
    start, like = [0], x @ x[0]
    while len(start) < min(lists, len(x)):
        start.append(int(like.argmin()))
        like = np.maximum(like, x @ x[start[-1]])
    c = x[start]
    for _ in range(TURNS):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where((np.bincount(at, minlength=len(c)) > 0)[:, None], _unit(sums), c)
    return c


def placed(rows: DataFrame, c: np.ndarray, probes: int = 1) -> DataFrame:
    """rows with list, the number of each of the nearest lists, the nearest first in place (from 0). A null vector, one of another length or one without a direction has no list."""
    if not len(c):
        return rows.select("*", F.lit(0).alias("list"), F.lit(0).alias("place")).where("false")

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = np.array([v is not None and len(v) == c.shape[1] and np.isfinite(v).all() and np.any(v) for v in batch], dtype=bool)
            out = pd.Series([None] * len(batch), dtype=object)
            if known.any():
                x = np.stack([np.asarray(v, dtype=np.float64) for v in batch[known]])
                order = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                for k, lists in zip(np.flatnonzero(known), order, strict=True):
                    out[k] = lists.tolist()
            yield out

    return rows.select("*", F.posexplode(nearest("embedding")).alias("place", "list"))


def search(queries: DataFrame, index: DataFrame, c: np.ndarray, k: int = 5, probes: int = 8) -> DataFrame:
    """(id, other, similarity, rank): the k rows of an index (id, embedding, list), as placed() makes it, most like each of the queries (id, embedding), without itself, among the lists that are nearest to the query.

    A query meets the rows of its lists block by block, as nearest() does it.
    """
    asked = placed(queries.select("id", "embedding"), c, probes)
    return nearest(asked.select("id", "embedding", "list"), index.select("id", "embedding", "list"), "list", k)


def similar(queries: DataFrame, rows: DataFrame, k: int = 5, lists: int = 64, probes: int = 16) -> DataFrame:
    """(id, other, similarity, rank) for queries and rows (id, embedding), whatever their labels: fit, index all rows, and search."""
    c = centroids(rows, lists)
    return search(queries, placed(rows, c).drop("place"), c, k, probes)
