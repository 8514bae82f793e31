"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialise, text_of, uniform
from regista.llm.hashing import pieces

#: The fixed public vocabulary.
VOCABULARY = "piece_bpe_32k.model"
#: Documents of a language to learn from, about so many at most, drawn by a hash of the id.
SAMPLE = 1_500
#: Languages that one piece table holds, with a column for each, which bounds it. More languages make more tables, which are used one after the other.
LANGUAGES = 200
ROUNDS = 2
SMOOTHING = 0.1
#: Probability of a letter that no piece covers.
UNKNOWN = 1e-7
#: Longer words are learnt from in parts of so many letters; they are scored whole, like all others.
LEARNT = 64
#: Numbers that a task's tables of forward sums and of recent words may hold.
NUMBERS = 1 << 23
#: Words whose scores a task keeps at hand, at most.
CACHE = 200_000
SEED = 31
NONE = "und"
#: A run of letters.
LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> list[str]:
    """The text pieces of a sentencepiece model, in order of their ids; '▁' marks the start of a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def runs(text: str) -> list[str]:
    """The lower-case runs of letters, each with the mark of a word start."""
    return ["▁" + w for w in LETTERS.findall(text.lower())]


class Prefixes:
    """All beginnings of pieces, numbered from 0, the empty one, so that many words are read on by a letter at once."""

    def __init__(self, at: dict[str, int]):
        alphabet = sorted({c for p in at for c in p})
        self.alphabet = np.array([ord(c) for c in alphabet], dtype=np.uint32)
        self.width, code = len(alphabet) + 1, {c: k for k, c in enumerate(alphabet)}
        number, steps, piece = {"": 0}, {}, [-1]
        for p, row in at.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in number:
                    number[p[:k]] = len(piece)
                    steps[number[p[: k - 1]] * self.width + code[p[k - 1]]] = len(piece)
                    piece.append(-1)
            piece[number[p]] = row
        self.piece = np.array(piece)
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], dtype=np.int64)

    def letters(self, words: list[str]) -> np.ndarray:
        """Numbers of the letters of words of one length (word, place); letters of no piece have a number of their own."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), self.width - 2)
        return np.where(self.alphabet[at] == points, at, self.width - 1)

    def longer(self, word: np.ndarray, prefix: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words whose prefix followed by letter begins a piece, with that beginning."""
        key = prefix * self.width + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return word[found], self.next[at[found]]


class Lattice:
    """All segmentations of words of one length into pieces, for a table of piece probabilities (piece, language); its last row is the unknown letter."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.at, self.table = {p: k for k, p in enumerate(names)}, table
        self.longest = max(map(len, names), default=1)

    @cached_property
    def prefixes(self) -> Prefixes:
        return Prefixes(self.at)

    def rows(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For each cut i, j the table row of words' [i:j], -1 where it is no piece."""
        m, get, last = len(words[0]), self.at.get, len(self.at)
        cuts = [(i, j) for j in range(1, m + 1) for i in range(max(0, j - self.longest), j)]
        return {(i, j): np.array([get(w[i:j], last if j - i == 1 else -1) for w in words]) for i, j in cuts}

    def forward(self, rows: dict[tuple[int, int], np.ndarray], m: int, n: int) -> np.ndarray:
        """alpha[j]: the probability of the first j letters, over all segmentations, for (word, language)."""
        alpha = np.zeros((m + 1, n, self.table.shape[1]))
        alpha[0] = 1.0
        for (i, j), k in rows.items():
            used = np.flatnonzero(k >= 0)
            if len(used):
                alpha[j, used] += alpha[i, used] * self.table[k[used]]
        return alpha

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations.

        Only the sums for the last cuts are held, as many as the longest piece
        has letters. They are scaled as they fall, so words of any length have one.
        """
        width = self.table.shape[1]
        out = np.empty((len(words), width))
        last, keep = len(self.at), self.longest
        for m in set(map(len, words)):
            own = [k for k, w in enumerate(words) if len(w) == m]
            size = max(1, NUMBERS // ((keep + 1) * width))
            for b in range(0, len(own), size):
                letters = self.prefixes.letters([words[k] for k in own[b : b + size]])
                n = len(letters)
                alpha = np.zeros((keep + 1, n, width))  # alpha[j % (keep + 1)] for cut j
                alpha[0] = 1.0
                scale = np.zeros((n, width))
                begun: list[tuple[int, np.ndarray, np.ndarray]] = []  # cut i, and the words whose letters since i begin a piece, with that beginning
                for j in range(1, m + 1):
                    total, alive = np.zeros((n, width)), []
                    begun.append((j - 1, np.arange(n), np.zeros(n, dtype=np.int64)))
                    for i, word, prefix in begun:
                        word, prefix = self.prefixes.longer(word, prefix, letters[word, j - 1])
                        row = self.prefixes.piece[prefix]
                        whole = row >= 0
                        if i == j - 1:
                            alone = np.full(n, last)
                            alone[word[whole]] = row[whole]
                            total += alpha[i % (keep + 1)] * self.table[alone]
                        elif whole.any():
                            total[word[whole]] += alpha[i % (keep + 1), word[whole]] * self.table[row[whole]]
                        if len(word):
                            alive.append((i, word, prefix))
                    begun = alive
                    alpha[j % (keep + 1)] = total
                    if j % 16 == 0:
                        scale += np.log(total)
                        alpha /= total
                out[own[b : b + size]] = scale + np.log(alpha[m % (keep + 1)])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts (piece, language) of words with counts (word, language)."""
        out = np.zeros_like(self.table)
        for m in set(map(len, words)):
            own = [k for k, w in enumerate(words) if len(w) == m]
            size = max(1, NUMBERS // (2 * (m + 1) * self.table.shape[1]))
            for b in range(0, len(own), size):
                part = own[b : b + size]
                rows = self.rows([words[x] for x in part])
                alpha = self.forward(rows, m, len(part))
                beta = np.zeros_like(alpha)
                beta[m] = 1.0
                weight = counts[part] / alpha[m]
                for (i, j), k in reversed(rows.items()):
                    used = np.flatnonzero(k >= 0)
                    if len(used):
                        p = self.table[k[used]]
                        np.add.at(out, k[used], alpha[i, used] * p * beta[j, used] * weight[used])
                        beta[i, used] += p * beta[j, used]
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def languages(docs: DataFrame) -> list[dict[str, float]]:
    """All languages of docs in order, LANGUAGES in a group, each with the share of its documents that is learnt from. The list of languages goes through the driver, never one of documents."""
    counts = docs.where("lang is not null").groupBy("lang").count()
    rates = sorted((r["lang"], min(1.0, SAMPLE / r["count"])) for r in counts.collect())  # a row for each language
    return [dict(rates[k : k + LANGUAGES]) for k in range(0, len(rates), LANGUAGES)]


def parts(word: str) -> list[str]:
    """A word in the parts that are learnt from."""
    return [word[k : k + LEARNT] for k in range(0, len(word), LEARNT)]


def _sample(docs: DataFrame, rates: dict[str, float]) -> DataFrame:
    """A drawn sample (lang, word, n) of the words of the documents in the languages of rates."""
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    drawn = docs.where(F.col("lang").isin(*rates)).where(uniform(F.lit(SEED), F.col("doc_id")) < rate).select("lang", text_of().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in pieces(batches, 512):
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for run in runs(text) for w in parts(run))
            yield pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    words = drawn.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return materialise(words)


def train(docs: DataFrame, rates: dict[str, float], names: list[str]) -> np.ndarray:
    """Probabilities (piece and unknown letter, language) of the pieces in the languages of rates, by EM over all segmentations of a bounded sample's words."""
    langs, words = list(rates), _sample(docs, rates)
    table = np.full((len(names) + 1, len(langs)), 1.0 / len(names))
    table[-1] = UNKNOWN
    spark, place = docs.sparkSession, {x: k for k, x in enumerate(langs)}
    for _ in range(ROUNDS):
        model = spark.sparkContext.broadcast((names, table))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*model.value), None
            for batch in batches:
                for lang in batch.column(0).unique().to_pylist():
                    own = batch.filter(pa.compute.equal(batch.column(0), lang))
                    one = Lattice.__new__(Lattice)
                    one.at, one.longest, one.table = lattice.at, lattice.longest, lattice.table[:, [place[lang]]]
                    got = one.expected(own.column(1).to_pylist(), own.column(2).to_numpy().astype(float)[:, None])
                    total = np.zeros_like(lattice.table) if total is None else total
                    total[:, [place[lang]]] += got
            if total is not None:
                piece, at = np.nonzero(total[:-1])
                yield pa.record_batch({"piece": pa.array(piece, pa.int64()), "at": pa.array(at, pa.int64()), "n": total[piece, at]})

        sums = words.mapInArrow(expect, "piece long, at long, n double").groupBy("piece", "at").agg(F.sum("n").alias("n")).toPandas()  # pieces times languages at most
        counts = np.zeros_like(table)
        counts[sums["piece"].to_numpy(dtype=np.int64), sums["at"].to_numpy(dtype=np.int64)] = sums["n"]
        counts[:-1] += SMOOTHING
        table = counts / counts.sum(axis=0)
        table[-1] = UNKNOWN
    return table


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The language of every whole text of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns piece probabilities from documents with a language whose crc32 of
    the id is not divisible by 5 (held_out marks the others). A text's
    probability in a language is the product over its words of the sum over all
    segmentations of the product of the pieces' probabilities; lang_pred is the
    likeliest language, score its share (0 to 1) of the mean probability of a
    word, so that long texts do not all score 1. Ties go to the first language
    in order. A text that is null or has no letter is 'und' with score 0, as
    are all texts where no language could be learnt. lang, source and doc_id
    play no part in a prediction. Words of any length are summed over all their
    segmentations, texts are read whole. Languages of any number are learnt:
    one table holds LANGUAGES of them, and the likelihoods under several tables
    are put together for each different text. Rows that repeat each have a row,
    equal texts equal predictions; an empty table stays empty; other columns
    are ignored.
    """
    learnt = docs.where(~held_out())
    groups = languages(learnt)
    if not groups:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = vocabulary(path or vocabulary_path())
    score = (1 / F.col("total")).alias("score")
    if len(groups) == 1:
        told = _likeliest(docs.select("doc_id", "text"), names, list(groups[0]), train(learnt, groups[0], names))
        return told.select("doc_id", held_out().alias("held_out"), "lang_pred", score)
    texts = docs.select("doc_id", "text", F.sha2(text_of(), 256).alias("of"))
    by_group = None
    for k, group in enumerate(groups):
        told = _likeliest(texts.select("of", "text"), names, list(group), train(learnt, group, names))
        told = told.groupBy("of").agg(*[F.first(c).alias(c) for c in ("lang_pred", "mean", "total")]).withColumn("group", F.lit(k))
        by_group = told if by_group is None else by_group.union(told)
    all_of = F.collect_list(F.struct("mean", (-F.col("group")).alias("group"), "lang_pred", "total"))  # one for each table
    best = by_group.groupBy("of").agg(all_of.alias("told")).withColumn("best", F.array_max(F.transform("told", lambda z: F.struct(z["mean"], z["group"], z["lang_pred"]))))
    total = F.aggregate("told", F.lit(0.0), lambda s, z: s + z["total"] * F.exp(z["mean"] - F.col("best.mean")))
    best = best.select("of", F.col("best.lang_pred").alias("lang_pred"), total.alias("total"))
    return texts.select("doc_id", "of").join(best, "of").select("doc_id", held_out().alias("held_out"), "lang_pred", score)


def _likeliest(texts: DataFrame, names: list[str], langs: list[str], table: np.ndarray) -> DataFrame:
    """For each row of texts (a key, text) the key, lang_pred, the likeliest of langs, mean, the mean log probability of a word in it, and total, the probabilities in all langs by that in the likeliest. A text without a letter has 'und', 0 and an infinite total."""
    model = texts.sparkSession.sparkContext.broadcast((names, table.astype(np.float32)))
    key = texts.schema[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model.value[0], model.value[1].astype(np.float64))
        known: dict[str, int] = {}
        rows = np.zeros((0, len(langs)))
        for batch in pieces(batches, 512):
            words = [runs(x) if x else [] for x in batch.column(1).to_pylist()]
            new = [w for w in dict.fromkeys(w for t in words for w in t) if w not in known]
            if len(known) + len(new) > min(CACHE, NUMBERS // len(langs)):
                known, rows = {}, rows[:0]
                new = list(dict.fromkeys(w for t in words for w in t))
            if new:
                rows = np.concatenate([rows, lattice.scores(new)])
                for w in new:
                    known[w] = len(known)
            best: list[tuple[str, float, float]] = []
            for t in words:
                if not t:
                    best.append((NONE, 0.0, math.inf))
                    continue
                mean = rows[[known[w] for w in t]].mean(axis=0)
                k = int(mean.argmax())
                best.append((langs[k], float(mean[k]), float(np.exp(mean - mean[k]).sum())))
            lang, mean, total = zip(*best, strict=True) if best else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(mean, pa.float64()), pa.array(total, pa.float64())], names=[key.name, "lang_pred", "mean", "total"])

    return texts.mapInArrow(score, f"{key.name} {key.dataType.simpleString()}, lang_pred string, mean double, total double")
