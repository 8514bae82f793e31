"""Spelling variants of the corpus's words, found by an index of variable-length grams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialise
from regista.llm.hashing import pieces

#: A run of letters of a word's least length; runs are maximal, as the pattern is greedy and takes all that follows.
LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: One run in so many of a document's loses a letter.
DAMAGE = 199
#: A form occurs at least so many times as often as the word.
FACTOR = 5
#: Code points of a text that are split at a time, and distinct words that a task counts before it sends them on.
STRETCH, HELD = 1 << 20, 200_000
#: Lengths of grams. Longer ones than the shortest are in the dictionary if they make at least SHARE of all places, so it has at most (LONGEST - SHORTEST) / SHARE grams, whatever the corpus.
SHORTEST, LONGEST, SHARE = 2, 5, 0.0005
#: A word's first and last sign, which no edit touches.
BEGIN, END = "^", "$"
#: Words that a list of the index holds at most; a longer one is told apart by the letters around the edit.
LIST = 64


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about STRETCH code points that cut no run of letters."""
    at, rest = 0, re.compile(f"[{LETTERS}]*")
    while at < len(text):
        end = min(at + STRETCH, len(text))
        end = rest.match(text, end).end()
        yield at, end
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, seen = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), Counter()

    def told() -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    for batch in pieces(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            text = (text or "").encode().lower().decode()  # bytes: only A-Z become lower case
            for low, high in stretches(text):
                for word, n in Counter(runs.findall(text, low, high)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DAMAGE == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    seen[word] += n
                if len(seen) > HELD:
                    yield told()
                    seen.clear()
    yield told()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text): the letter runs of whole texts, in lower case in A-Z, of which one in DAMAGE distinct ones of a document has lost a letter; those of LEAST_LETTERS and LEAST_COUNT or more. A null id counts as an empty one, a null text has no words, rows that repeat count each."""
    told = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counted, "word string, n long")
    return told.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Grams:
    """The dictionary: grams longer than SHORTEST that are frequent, and so worth a list of their own; a prefix of one is one too. Grams of SHORTEST need no entry."""

    def __init__(self, frequent: set[str]):
        self.frequent = frequent
        #: What a look-up may still be reading when it comes to the edit, and how far a gram that begins before the edit may reach behind it.
        self.open = {g[:k] for g in frequent for k in range(SHORTEST, len(g))}
        self.reach = {g[k:] for g in frequent for k in range(1, len(g) - 1)}

    def split(self, marked: str) -> list[tuple[int, int]]:
        """Variable grams of a word as (start, end): at each place the longest of the dictionary, without those that lie in an earlier one."""
        out, last = [], 0
        for p in range(len(marked) - SHORTEST + 1):
            q = SHORTEST
            while q < LONGEST and p + q < len(marked) and marked[p : p + q + 1] in self.frequent:
                q += 1
            if p + q > last:
                last = p + q
                out.append((p, last))
        return out

    def unaffected(self, marked: str, grams: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        """For an edit before each place i: how many of the first grams it can't affect, whatever is put in; and for a rest that begins at i, from which gram on none is affected.

        A gram before the edit stays if it and all before it were chosen
        without reading up to the edit. One behind it stays if no gram that
        begins before the rest can reach its end.
        """
        n = len(marked)
        first, rest = [0] * n, [len(grams)] * n
        a = 0
        for i in range(1, n):
            start = next((p for p in range(max(0, i - LONGEST + 1), i - 1) if marked[p:i] in self.open), i - 1)
            a = 0
            while a < len(grams) and grams[a][0] < start:
                a += 1
            first[i] = a
            far = i + next((k for k in range(LONGEST - 1, 1, -1) if marked[i : i + k] in self.reach), 1)
            b = len(grams)
            while b and grams[b - 1][0] >= i and grams[b - 1][1] > far:
                b -= 1
            rest[i] = b
        return first, rest

    def keys(self, word: str) -> dict[str, set[str]]:
        """Lists of the index that the word is in, and what tells its words apart there.

        Two near words have equal letters before and behind the edit. The grams
        that the edit can't affect depend on these letters alone, so both words
        have them, and both are in the list of all these grams together. So one
        look-up merges the lists of the single grams.
        """
        marked = BEGIN + word + END
        n, grams = len(marked), self.split(marked)
        first, rest = self.unaffected(marked, grams)
        found: dict[tuple[int, int, int], set[str]] = {}
        for i in range(1, n):
            found.setdefault((n, first[i], rest[i]), set()).add(f"{marked[:i]} {marked[i:]}")  # the other has a letter more here
            if i < n - 1:
                found.setdefault((n - 1, first[i], rest[i + 1]), set()).add(f"{marked[:i]} {marked[i + 1 :]}")
        before, behind = [""], [""]
        for p, e in grams:
            before.append(f"{before[-1]}{p}{marked[p:e]} ")
        for p, e in reversed(grams):
            behind.append(f"{n - p}{marked[p:e]} {behind[-1]}")
        return {f"{size}|{before[a]}|{behind[len(grams) - b]}": exact for (size, a, b), exact in found.items()}


def dictionary(words: DataFrame) -> Grams:
    """Frequent grams of words (word)."""
    marked = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("w"))

    def pieces_of(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("w") - (q - 1)), lambda p: F.substring("w", p, F.lit(q)))

    every = [pieces_of(q) for q in range(SHORTEST + 1, LONGEST + 1)]
    counts = marked.select(F.explode(F.concat(*every)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    places = marked.agg(F.coalesce(F.sum(F.length("w")), F.lit(0))).first()[0]
    return Grams({r["gram"] for r in counts.where(F.col("n") >= max(1.0, SHARE * places)).collect()})


def near_pairs(words: DataFrame) -> DataFrame:
    """words (word, n) with each near word: word, n, other, m. Near is exactly one code point inserted, deleted or replaced.

    Both words of a pair are in one list at least (see Grams.keys), so none is
    lost. A list of more than LIST words is replaced by those of the letters
    before and behind the edit, which all differ in one letter: its pairs are
    results. So the pairs that are tried grow with the words and the results.
    """
    grams = dictionary(words)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            names, exact, word, n = [], [], [], []
            for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, told in grams.keys(w).items():
                    names.append(name)
                    exact.append(list(told))
                    word.append(w)
                    n.append(k)
            yield pa.record_batch({"list": pa.array(names, pa.string()), "exact": pa.array(exact, pa.list_(pa.string())), "word": pa.array(word, pa.string()), "n": pa.array(n, pa.int64())})

    each = words.select("word", "n").mapInArrow(listed, "list string, exact array<string>, word string, n long")
    each = materialise(each.select(F.xxhash64("list").alias("list"), F.transform("exact", lambda x: F.xxhash64(x, F.lit(1))).alias("exact"), "word", "n"))
    shared = each.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = each.join(shared, "list").select(F.explode(F.when(F.col("size") <= LIST, F.array("list")).otherwise(F.col("exact"))).alias("list"), "word", "n")
    placed = materialise(placed)
    a, b = placed, placed.select("list", F.col("word").alias("other"), F.col("n").alias("m"))
    # all words of pairs are distinct, so a distance of at most one is one
    near = (F.col("word") < F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) >= 0)
    pairs = materialise(a.join(b, "list").where(near).groupBy("word", "other").agg(F.first("n").alias("n"), F.first("m").alias("m")))
    return pairs.select("word", "n", "other", "m").union(pairs.select("other", "m", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): the last word to which forms lead. Each step FACTOR-folds the count, so a chain has less than 28 steps, and each turn doubles the steps that are taken."""
    at = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while at.where("open").take(1):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialise(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
    return at.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of docs (doc_id, text) with the forms that they are variants of: word, form, root, n, n_near, form_n.

    A word's form is its near word with the largest n, of equal ones the first
    in code-point order, if it has at least FACTOR times the word's n; null
    otherwise, with a null form_n. root is the word that forms lead to in the
    end, or the word itself. Null and empty texts have no words, an empty table
    gives an empty result, a null doc_id counts as an empty one, rows that
    repeat count each, and other columns are ignored.
    """
    words = materialise(vocabulary(docs))
    best = F.min_by(F.struct(F.col("other").alias("form"), F.col("m").alias("form_n")), F.struct(-F.col("m"), F.col("other")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("best", F.when(F.col("best.form_n") >= FACTOR * F.col("n"), F.col("best")))
    found = materialise(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best.form", "best.form_n"))
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
