import math

import numpy as np
import pyarrow as pa

import regista.llm.langid as langid
import regista.llm.toxicity as toxicity


def probability(word, names, table):
    """All segmentations, one by one."""
    if not word:
        return 1.0
    out = 0.0
    for k in range(1, len(word) + 1):
        if word[:k] in names:
            out += table[names.index(word[:k]), 0] * probability(word[k:], names, table)
        elif k == 1:
            out += table[-1, 0] * probability(word[1:], names, table)
    return out


def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    table = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.1], [0.1], [1e-7]])
    words = ["▁abab", "▁bcab", "▁ab", "▁a"]
    lattice = langid.Lattice(names, table)
    assert np.allclose(np.exp(lattice.scores(words))[:, 0], [probability(w, names, table) for w in words])
    long = "▁" + "ab" * 30_000
    two = lattice.scores([long, "▁" + "abab" * 2, "▁" + "ab" * 12])[:, 0]
    assert np.isfinite(two).all() and np.allclose(np.exp(two[1:]), [probability(w, names, table) for w in ("▁" + "ab" * 4, "▁" + "ab" * 12)], rtol=1e-9)
    step = lattice.scores(["▁" + "ab" * 200, "▁" + "ab" * 201])[:, 0]
    assert abs((step[1] - step[0]) * 29_800 + step[0] - two[0]) < 1e-3 * abs(two[0])  # as many letters, as many times the step
    counts = lattice.expected(["▁ab"], np.array([[2.0]]))
    assert np.isclose((counts[:-1, 0] * [len(n) for n in names]).sum() + counts[-1, 0], 2 * 3)  # every letter is counted once a word


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, "en"), (-2, "12 !!", None), (-3, "the of and " * 5000, None), (-4, "x" * 5000, "en"), (-5, "der und die" * 3000, None)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [k for k, r in got.items() if r["held_out"] and k >= 0]
    assert sum(got[k]["lang_pred"] == lang[k] for k in held) >= 0.97 * len(held)
    assert got[-1]["lang_pred"] == got[-2]["lang_pred"] == "und" and got[-3]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", docs.lang.substr(1, 0)).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_languages_of_several_tables(spark, monkeypatch):
    rng = np.random.default_rng(8)
    stems = {f"l{k}": [c + v + c for c in "bcdfghjklm"[k : k + 2] for v in "aeiou"] for k in range(0, 10, 2)}
    stems = {lang: [a + b for a in some for b in some] for lang, some in stems.items()}
    rows = [(k, " ".join(rng.choice(stems[lang], 30)), lang) for k, lang in enumerate(list(stems) * 20)]
    rows += [(1000, None, "l0"), (1001, "12 !!", None), (1002, rows[0][1], None), (1002, rows[0][1], None), (None, "babbab", "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def told():
        found = langid.identify(docs.selectExpr("*", "1 as of", "2 as total", "3 as mean")).collect()
        return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in found))

    one = told()
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert [len(g) for g in langid.languages(docs)] == [2, 2, 1]
    assert told() == one and len(one) == len(rows)
    assert all(r[3] == f"l{2 * (r[1] % 5)}" for r in one if r[1] < 1000 and not r[0])
    assert {r[3:] for r in one if r[1] in (1000, 1001)} == {("und", 0.0)}


def test_words_of_any_length_are_learnt_from(spark):
    words = {"x": "kazo" * 500, "y": "milu" * 500}  # no word of these texts is short
    rows = [(k, w, lang) for k, (lang, w) in enumerate(list(words.items()) * 10)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == [r[2] for r in rows]
    assert "".join(langid.parts("▁" + words["x"])) == "▁" + words["x"]


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(200)]

    def text(toxic):
        t = list(rng.choice(words, 60))
        if toxic:
            t[rng.integers(60)], t[rng.integers(60)] = "vile", "nasty"
        return " ".join(t)

    marks = [int(k % 4 == 0) for k in range(1500)]
    docs = spark.createDataFrame([(k, text(m)) for k, m in enumerate(marks)] + [(-1, None), (-2, ""), (7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks)] + [(2, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 1503
    held = [r for r in got if r["held_out"] and 0 <= r["doc_id"] and r["doc_id"] != 7]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.95
    empty = {r["score"] for r in got if r["doc_id"] < 0}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.5
    weights = toxicity.train(docs, labels).count()
    assert 0 < weights < 2000  # the L1 penalty leaves few
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.5}


def test_ftrl_matches_its_formulas():
    """The update of each weight, one by one, on fifty small texts."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{chr(97 + k)}" for k in rng.integers(0, 12, 8)) for _ in range(50)]
    labels = [int("wa" in t.split()) for t in texts]
    slots, model = toxicity.features(pa.array(texts)), toxicity.Ftrl()
    z, n = {}, {}

    def weight(k):
        s = z.get(k, 0.0)
        return 0.0 if abs(s) <= toxicity.L1 else -(s - math.copysign(toxicity.L1, s)) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(4):
        for s, y in zip(slots, labels, strict=True):
            model.learn(s, y)
            keys = [*s.tolist(), toxicity.SLOTS]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k in keys:
                rate = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA
                z[k], n[k] = z.get(k, 0.0) + g - rate * w[k], n.get(k, 0.0) + g * g
    assert all(abs(model.z[k] - z[k]) < 1e-9 and abs(model.weights(np.array([k]))[0] - weight(k)) < 1e-9 for k in z)
    assert any(weight(k) for k in z) and [len(s) for s in slots] == [len(set(s.tolist())) for s in slots]
