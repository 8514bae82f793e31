import collections
import math
import re
import unicodedata

import regex
from pyspark.sql import functions as F

from regista.llm import quality
from regista.llm.common import placed_within, uniform
from regista.llm.mixing import MOST, SEED, mix, mixed, rounded, targets
from regista.llm.quality import judge
from tests.llm.brute import WORD


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if twice[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, "en"), (-2, "", None), (-3, "a b c d e a b c d e a b c d e f", "xx"), (-4, "x\n \nx\ny\r\ny", "en"), (-5, "{a, b} " * 30, "en")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    got = {r["doc_id"]: r for r in judge(docs).collect()}
    for doc_id, r in got.items():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == counts(r["text"]), doc_id
        assert not (r["base_failed"] and r["kept"])
    narrow = {r["doc_id"]: r["kept"] for r in judge(docs, ["doc_id"]).collect()}
    assert narrow == {k: r["kept"] for k, r in got.items()}
    assert judge(docs.limit(0)).count() == 0


def test_verdict(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    junk = spark.createDataFrame([(-1, " ".join(f"TE{i}%%%" for i in range(200)), "en", "s")], docs.schema)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = judge(docs.union(junk)).join(labels, "doc_id", "left").collect()
    assert [r["kept"] for r in got if r["doc_id"] == -1] == [False]
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)


def shares(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 400, "é": 90, "Z": 3000}
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    expected = shares(sizes)
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in sizes)


def test_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(10**6, None, None, None, 0), (10**6, None, None, None, 0), (10**6 + 1, "a b c", None, None, 5)], docs.schema)
    docs = docs.union(more)
    got = mix(docs).collect()
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in mix(docs.repartition(5)).collect()}
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == 0 or r["taken"] <= MOST * r["size"]
        by[r["source"]].append(r)
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 2 * max(r["size"] for r in rows) + 1
        if rows[0]["source_size"]:
            assert abs(sum(r["copies"] for r in rows) - len(rows) * rows[0]["target"] / rows[0]["source_size"]) < 1 + 1e-6
    assert mixed(docs).count() == sum(r["copies"] for r in got)
    assert mix(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).columns == docs.columns


def test_copies_keep_all_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 9), (2, "a b", "t", 8)], "doc_id long, text string, source string, rank int").withColumn("copies", F.lit("x")).withColumn("_copies", F.lit("y")).withColumn("doc", F.lit(1)).withColumn("row", F.lit(2))
    assert mixed(df).columns == df.columns and mixed(df).count() > 0


def test_unlike_rows_never_stand_for_each_other(spark):
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "fr"), (1, "a b", "s", "fr"), (None, None, "s", None), (2, "c d e", "t", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    taken = collections.Counter()
    for r in mix(df).collect():
        taken[r["doc_id"], r["source"]] += r["copies"]
    got = collections.Counter((r["doc_id"], r["source"]) for r in mixed(df).collect())
    assert got == +taken
    assert {r["lang"] for r in mixed(df).where("doc_id = 1").collect()} == {"en", "fr"}


def test_rounding_keeps_sums_and_expectations(spark):
    """Each block's sum stays but for the last draw, and each fraction is 0 or 1."""
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'a' else 'b' end as source", "id as rank", "case when id % 3 = 0 then 0.25D else 0.7D end as p")
    got = {r["rank"]: r["extra"] for r in rounded(df).collect()}
    assert sorted(got) == list(range(3000)) and set(got.values()) == {0, 1}
    assert abs(sum(v for k, v in got.items() if k % 3 == 0) - 250) < 1 + 1e-9 and abs(sum(v for k, v in got.items() if k % 3) - 1400) < 1 + 1e-9


def steps(items):
    """Pivotal rounding of (p, draw, key) in order, one at a time."""
    held, out = items[0], {}
    for item in items[1:]:
        (a, _, x), (b, u, y) = held, item
        if a < 1e-12 or a > 1 - 1e-12:
            out[x], held = round(a), item
        elif a + b < 1:
            out[x if u * (a + b) < b else y] = 0
            held = (a + b, u, y if u * (a + b) < b else x)
        else:
            first = u * (2 - a - b) < 1 - a
            out[y if first else x] = 1
            held = (a + b - 1, u, x if first else y)
    return out, held


def test_one_block_is_rounded_step_by_step(spark):
    df = spark.range(200).selectExpr("'a' as source", "id as rank", "0.1D + (id % 8) / 10D as p")
    draws = df.select("rank", "p", uniform(F.lit(SEED), F.lit(0), F.col("rank")).alias("u")).orderBy("rank").collect()
    expected, held = steps([(r["p"], r["u"], r["rank"]) for r in draws])
    got = {r["rank"]: r["extra"] for r in rounded(df).collect()}
    assert {k: got[k] for k in expected} == expected and set(got) - set(expected) == {held[2]}


def plain_distance(p, q):
    h = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / m) for x, m in zip(a, h, strict=True) if x > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_distances_and_verdict_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 120")
    docs = docs.union(spark.createDataFrame([(-1, "%%% TE1 " * 100, None), (-2, None, "en")], docs.schema)).withColumn("_w", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("KEPT", F.lit(3))
    rows = docs.collect()

    def chars(t):
        classes = [" \t\n\v\f\r", None, None, None, ".,;:!?'\"()-", "#*$%&|<>"]
        out = [0] * 8
        for c in t:
            kind = unicodedata.category(c)
            k = 0 if c in classes[0] else 1 if kind == "Lu" else 2 if kind in ("Lo", "Lt", "Lm") or kind[0] == "M" else 3 if kind == "Nd" else 4 if c in classes[4] else 5 if c in classes[5] else 7 if kind == "Ll" else 6
            out[k] += 1
        return out

    def terms(t):
        w = [x for x in regex.split(r"[^\p{L}]+", t.lower()) if x]
        return [w.count(x) for x in quality.COMMON] + [sum(x not in quality.COMMON for x in w)] if len(w) >= quality.MIN_TERMS else None

    share = lambda x: [v / sum(x) for v in x]
    mean = lambda xs: [sum(c) / len(xs) for c in zip(*xs, strict=True)] if xs else None
    held = {r["doc_id"]: (share(chars(r["text"])) if len(r["text"] or "") >= quality.MIN_CHARS else None, (lambda c: share(c) if c else None)(terms(r["text"] or ""))) for r in rows}
    long = [(r["lang"], *held[r["doc_id"]]) for r in rows if held[r["doc_id"]][0]]
    refs = {k: tuple(mean([x[i] for x in long if (k == "all" or x[0] == k) and x[i]]) for i in (1, 2)) for k in {x[0] for x in long if x[0]} | {"all"}}
    got = {r["doc_id"]: r for r in judge(docs).collect()}
    assert len(got) == len(rows) and set(judge(docs).columns) >= {"_w", "doc", "kept"} and "KEPT" not in judge(docs).columns
    for r in rows:
        own, g = refs.get(r["lang"], refs["all"]), got[r["doc_id"]]
        far = [plain_distance(h, ref or refs["all"][i]) if h else None for i, (h, ref) in enumerate(zip(held[r["doc_id"]], own, strict=True))]
        for name, d in zip(("char_distance", "word_distance"), far, strict=True):
            assert (g[name] is None) == (d is None) and (d is None or abs(g[name] - d) < 1e-9), (r["doc_id"], name)
        assert g["kept"] == (not g["base_failed"] and (far[0] or 0) <= quality.MAX_CHAR_DISTANCE and (far[1] or 0) <= quality.MAX_WORD_DISTANCE)


def test_accepted_keeps_columns_of_any_name(spark):
    good = " ".join(f"word{k}" for k in range(30))
    df = spark.createDataFrame([(1, good, "en"), (2, "short", "en"), (3, None, None), (1, good, "en")], "doc_id long, text string, lang string").selectExpr("*", "1 as _row", "2 as row", "3 as doc", "4 as _w", "5 as n_words")
    got = quality.accepted(df)
    assert got.columns == df.columns and [r["doc_id"] for r in got.collect()] == [1, 1] and {r["_row"] for r in got.collect()} == {1}
    assert quality.accepted(df.limit(0)).count() == 0


def test_places_within_a_hot_key(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) as key", "cast(id as string) as text").repartition(7)
    got = placed_within(rows, "key", "nth").groupBy("key").agg(F.count("*").alias("n"), F.min("nth").alias("low"), F.max("nth").alias("high"), F.countDistinct("nth").alias("unlike"), F.countDistinct("text").alias("texts"))
    found = {r["key"]: tuple(r)[1:] for r in got.collect()}
    assert len(found) == 20_000 and found[7] == (10_001, 1, 10_001, 10_001, 10_001)
    assert all(v == (1, 1, 1, 1, 1) for k, v in found.items() if k != 7)
    assert placed_within(rows.limit(0), "key", "nth").count() == 0


def test_rows_that_repeat_are_taken_as_often_as_the_mix_says(spark):
    rows = [(k, f"word{k} " * (k % 9 + 1), "ab"[k % 2]) for k in range(60)] + [(99, "one two three", "a")] * 500 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as nth", "2 as row", "3 as _at")
    taken = mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    got = mixed(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["n"] for r in taken if r["doc_id"] is not None} == {r["doc_id"]: r["count"] for r in got if r["doc_id"] is not None}
    assert mixed(docs.limit(0)).count() == 0
