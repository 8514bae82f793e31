"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialise, text_of, uniform
from regista.llm.hashing import LOWER, column_bytes, mix, pieces, seeds, word_hashes

#: Weights; a word n-gram has one of them by its hash.
SLOTS = 1 << 20
#: Labelled documents to learn from, about so many at most, drawn by a hash of the id.
SAMPLE = 24_000
#: Documents that one task learns from; the models of several tasks are averaged.
PART = 6_000
EPOCHS = 6
#: Drawn labels are broadcast up to so many (an id, a label and a number each), so that only the drawn texts move.
BROADCAST_DRAWN = 200_000
#: Per-coordinate rate alpha / (beta + sqrt(sum of squared gradients)), and the two penalties.
ALPHA, BETA, L1, L2 = 4.0, 1.0, 6.0, 0.1
SEED = 77

#: Words are runs of ASCII letters and of bytes above ASCII.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False


def features(text: pa.Array) -> list[np.ndarray]:
    """For each row the sorted distinct slots of its words, word pairs, and pairs with one or two words between."""
    hashes, starts = word_hashes(*column_bytes(text), space=NO_LETTER, lower=LOWER)
    salts = seeds(8, 5)
    grams = [mix(hashes + salts[0])]
    for gap in (1, 2, 3):
        grams.append(mix(hashes[:-gap] * salts[2 * gap - 1] + hashes[gap:] * salts[2 * gap]) if len(hashes) > gap else hashes[:0])
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    slots = [(g >> shift).astype(np.int64) for g in grams]
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        parts = [slots[gap][a : max(a, b - gap)] for gap in range(4)]
        out.append(np.unique(np.concatenate(parts)).astype(np.int32))
    return out


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; the last slot is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, SLOTS)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["draw", "doc_id"], ignore_index=True)
    slots = features(pa.array(rows["text"], pa.large_string()))
    model = Ftrl()
    for _ in range(EPOCHS):
        for s, y in zip(slots, rows["toxic"], strict=True):
            model.learn(s, int(y))
    w = model.weights(slice(None))
    used = np.flatnonzero(w)
    return pd.DataFrame({"slot": used, "weight": w[used]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(slot, weight), the weights that aren't 0, learnt from docs (doc_id, text) and labels (doc_id, toxic).

    Learns from about sample labelled documents, drawn by a hash of the id from
    all of them; a document with several labels is toxic if one says so, null
    labels don't count.
    """
    labels = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    parts = -(-min(n, sample) // PART) or 1
    drawn = labels.withColumn("draw", uniform(F.lit(SEED), F.col("doc_id"))).where(F.col("draw") < F.lit(min(1.0, sample / max(1, n))))
    drawn = materialise(drawn)
    if drawn.count() <= BROADCAST_DRAWN:
        drawn = F.broadcast(drawn)
    rows = docs.select("doc_id", text_of().alias("text")).join(drawn, "doc_id").withColumn("part", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(parts)))
    learnt = rows.groupBy("part").applyInPandas(_learn, "slot long, weight double")
    return learnt.groupBy("slot").agg((F.sum("weight") / F.lit(float(parts))).alias("weight"))


def scored(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, score) for docs (doc_id, text): the odds of the toxic label. The weights, SLOTS at most, go to every executor."""
    table = weights.toPandas()
    dense = np.zeros(SLOTS + 1, dtype=np.float32)
    dense[table["slot"].to_numpy(dtype=np.int64)] = table["weight"]
    sent = docs.sparkSession.sparkContext.broadcast(dense)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in pieces(batches):
            sums = np.array([w[s].sum(dtype=np.float64) + w[SLOTS] for s in features(batch.column(1))])
            yield pa.record_batch({"doc_id": batch.column(0), "score": 1.0 / (1.0 + np.exp(-np.clip(sums, -30, 30)))})

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every whole text of docs (doc_id, text): doc_id, held_out, score, predicted.

    Labels are learnt from documents whose crc32 of the id is not divisible by
    5; held_out marks the others. The score, from 0 to 1, is higher where the
    label toxic is likelier; predicted is 1 from 0.5. It depends on the text
    alone: an empty or null text has the score of no features, equal texts have
    equal scores. Texts of any length are read whole. Rows that repeat a doc_id each have a row; a
    null doc_id has no label. An empty table stays empty. Without labels all
    scores are 0.5 and predicted 1. Other columns are ignored.
    """
    weights = materialise(train(docs.where(~held_out()), labels.where(~held_out())))
    return scored(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
