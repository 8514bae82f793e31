import random
import re
import zlib
from collections import Counter

from regista.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string"


def counts(rows):
    told = Counter()
    for doc, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            told[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in told.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n, out = counts(rows), {}
    for w in n:
        near = [o for o in n if is_near(w, o)]
        best = min(near, key=lambda o: (-n[o], o), default=None)
        out[w] = (best if best and n[best] >= 5 * n[w] else None, len(near))
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return sorted((w, f or "", root(w), n[w], k, n[f] if f else -1) for w, (f, k) in out.items())


def found(spark, rows):
    told = spelling.spelling_variants(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in told.collect())


def words(seed, letters, size, number):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(*size))) for _ in range(number)]


def test_variants_equal_brute_force(spark):
    draw = random.Random(2)
    known = words(1, "abé", (6, 9), 250)
    rows = [(d, " ".join(draw.choices(known, weights=[1 + 300 // (k + 1) for k in range(250)], k=300)).title()) for d in range(40)]
    assert len(brute(rows)) > 100 and any(f for _, f, *_ in brute(rows))
    assert found(spark, rows) == brute(rows)


def test_chains_of_forms_lead_to_their_root(spark):
    steps = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"]
    rows = [(0, " ".join(w for k, w in enumerate(steps) for _ in range(5 * 5**k)))]
    assert {r[0]: r[2] for r in found(spark, rows)} == {r[0]: r[2] for r in brute(rows)}
    assert dict((r[0], r[2]) for r in found(spark, rows))["abcdef"] == "abjihg"


def test_nulls_ties_repeats_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 50)
    monkeypatch.setattr(spelling, "HELD", 10)
    rows = [(None, None), (1, ""), (2, "..,,"), (None, "Straße " * 5 + "straßen " * 30 + "strasße " * 30), (3, "ÄÖÜabc×÷ " * 6), (3, "ÄÖÜabc×÷ " * 6), (4, "x" * 300 + " " + "longer, " * 900)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] == found(spark, [(1, None)])


def test_crowded_lists_are_told_apart_without_loss(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LIST", 2)
    known = sorted({a + "tion" + b for a in words(3, "abc", (1, 4), 40) for b in words(4, "st", (1, 4), 12)})
    rows = [(0, " ".join(w for w in known for _ in range(5 + len(w))))]
    assert found(spark, rows) == brute(rows)


def test_unaffected_grams_are_those_of_near_words():
    draw = random.Random(7)
    known = [w for w in words(5, "abcd", (6, 12), 400)]
    every = Counter(("^" + w + "$")[p : p + q] for w in known for q in (3, 4, 5) for p in range(len(w) + 3 - q))
    grams = spelling.Grams({g for g, n in every.items() if n > 12})
    assert any(len(g) > 3 for g in grams.frequent)
    for w in known:
        k = draw.randrange(len(w))
        for other in (w[:k] + w[k + 1 :], w[:k] + "d" + w[k + 1 :], w[:k] + "a" + w[k:]):
            assert other == w or set(grams.keys(w)) & set(grams.keys(other))


def test_dictionary_holds_the_frequent_grams(spark):
    known = [a + "tion" + b for a in words(3, "abc", (2, 4), 30) for b in words(4, "st", (2, 4), 8)]
    frequent = spelling.dictionary(spark.createDataFrame([(w,) for w in known], "word string")).frequent
    every = Counter(("^" + w + "$")[p : p + q] for w in known for q in (3, 4, 5) for p in range(len(w) + 3 - q))
    assert frequent == {g for g, n in every.items() if n >= spelling.SHARE * sum(len(w) + 2 for w in known)} and "tion" in frequent
