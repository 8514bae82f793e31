import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import regista.llm.components as rounds
from regista.llm import common, linking
from regista.llm.components import components
from regista.llm.hashing import column_bytes, word_hashes
from regista.llm.linking import SPREAD, WORDS
from regista.llm.near_dedup import alike, drop_near_duplicates, near_duplicates, shingle_sets, sketch
from tests.llm.brute import near_components, word_shingles


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def varied(seed, n, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(500)}" for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(edits):
        copy = list(base)
        for k in rng.integers(0, n, rng.integers(1, 4)):
            copy[k] = f"x{rng.integers(10_000)}"
        out.append(" ".join(copy))
    return out


def test_matches_brute_force(spark):
    texts = [t for s in range(4) for t in varied(s, 150, 12)] + ["", None, "one", "ONE", "a b c d", "a  B\tc\nd", "   ", " ".join(["rep"] * 3000)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = near_components(rows, 85)
    assert {k: r["component_id"] for k, r in got.items()} == expected
    assert all(r["n_shingles"] == len(word_shingles(dict(rows)[k])) for k, r in got.items())
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert got == near_components(rows, 85)


def test_repeats_nulls_and_clashing_names(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "quite other words stand here", "x"), (None, "a b c d e f", "y"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("kept", F.lit(1)).withColumn("items", F.lit(2))
    got = near_duplicates(df).collect()
    assert len(got) == 5 and {r["component_id"] for r in got} == {1, 5}
    assert drop_near_duplicates(df).count() == 3  # the copies' first row, the unlike text under the same id, and the text without words
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabABé \u0085", max_size=40)), max_size=6))
def test_words_and_sets(texts):
    hashes, starts = word_hashes(*column_bytes(pa.array(texts, pa.string())))
    words = [[w for w in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if w] for t in texts]
    flat = [w for t in words for w in t]
    assert list(np.diff(starts)) == [len(t) for t in words]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    assert [len(s) for s in shingle_sets(pa.array(texts, pa.string()))] == [len(word_shingles(t)) for t in texts]


def test_components_of_a_chain(spark):
    n = 60
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.sql("SELECT 100L, 101L")).union(spark.sql("SELECT 7L, 7L"))
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(n)} | {100: 100, 101: 100}
    assert components(links.where("false")).count() == 0


def test_sketches_of_short_texts_agree_at_the_threshold():
    rng = np.random.default_rng(3)
    for percent, n in ((p, n) for p in (80, 85) for n in (20, 40, 100, 400, 2000)):
        both, over = n * percent // 100, []
        for _ in range(300):
            items = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            half = both + (n - both) // 2
            x, y = (sketch(np.unique(s)).view(np.uint64) for s in (items[:half], np.concatenate([items[:both], items[half:]])))
            used, q = max(int(x[-1]), int(y[-1])), (1 - percent / 100) / 2
            over.append(sum(bin(int(a ^ b)).count("1") for a, b in zip(x[:-1], y[:-1], strict=True)) > int(used * q + SPREAD * (used * q * (1 - q)) ** 0.5))
        assert sum(over) <= 1


def test_planted_pairs_are_found(spark):
    rng = np.random.default_rng(8)
    rows, pairs = [], 0
    for percent, least in ((85, 85), (80, 80)):
        for k in range(250):
            n = int(rng.choice([30, 80, 300]))
            base = [f"p{percent}k{k}w{i}" for i in range(n + 4)]
            cut = n - -(-2 * n * least // (100 + least))  # shingles that either text has alone, by other words at its end
            other = base[: n + 4 - cut] + [f"q{percent}k{k}w{i}" for i in range(cut)]
            rows += [(1000 * percent + 2 * k, " ".join(base)), (1000 * percent + 2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 80):
        got = near_duplicates(df.where(f"doc_id >= {1000 * percent} and doc_id < {1000 * percent + 1000}"), percent).where("kept").count()
        assert got <= 500 - 0.97 * 250


def test_drop_keeps_one_row_of_each_component(spark):
    schema = "doc_id long, text string, source string"
    rows = [
        (1, "a b c d e f", "x"), (1, "A b c d e f", "x"), (2, "a b c d e f", "x"), (1, "quite other words stand here", "x"),
        (None, "nobody has named this one", "y"), (None, "nor this one, unlike the first", "y"), (None, "nobody has named  this one", "y"),
        (5, None, None), (5, None, None), (None, " ", None), (None, "a b c d e f", "y"),
    ]
    df = spark.createDataFrame(rows, schema)
    assert drop_near_duplicates(df.selectExpr("*", "1 as doc", "2 as _doc", "3 as key", "4 as rivals", "5 as text_key")).columns[3:] == ["doc", "_doc", "key", "rivals", "text_key"]
    got = drop_near_duplicates(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[1], rows[3], rows[6], rows[5], rows[7], rows[8], rows[9]]))


def test_no_unlikely_pair_of_a_block_is_lost(spark, monkeypatch):
    monkeypatch.setattr(linking, "REST", 10)
    nodes = spark.range(12).select(F.col("id").alias("node"))
    members = nodes.select(F.lit(1).cast("long").alias("key"), "node")
    true = [(4, 5), (5, 9), (7, 8)]

    def sketches(ids):  # all sketches are unlike: no pair is likely
        words = F.struct(*[F.xxhash64("node", F.lit(k)).alias(f"w{k}") for k in range(WORDS)])
        return ids.select("node", F.lit(64 * WORDS).cast("long").alias("used"), words.alias("words"))

    def test(pairs):
        return pairs.join(spark.createDataFrame(true, "a long, b long"), ["a", "b"], "left_semi")

    found = linking.linked(linking.star_pairs(members), members, sketches, test, 85)
    assert {tuple(r) for r in found.select("node", "component").collect()} == {(4, 4), (5, 4), (9, 4), (7, 7), (8, 7)}


def test_blocks_of_unlike_sets_need_few_tests(spark, monkeypatch):
    monkeypatch.setattr(linking, "MEET", 40)  # a block is dealt in parts
    rng = np.random.default_rng(4)
    sets = {}
    for k in range(100):  # two of five items are common to all sets; every tenth set has a near one
        own = rng.integers(-(1 << 63), (1 << 63) - 1, 60)
        sets[2 * k] = np.concatenate([np.arange(40) * 7919 << 44, own])
        sets[2 * k + 1] = np.concatenate([sets[2 * k][:95], own[:0]]) if k % 10 == 0 else np.concatenate([sets[2 * k][:70], rng.integers(-(1 << 63), (1 << 63) - 1, 30)])
    rows = [(k, [int(h) for h in v]) for k, v in sets.items()]
    items = spark.createDataFrame(rows, "id long, items array<long>").cache()
    members = items.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("key"), F.col("id").alias("node"))
    tested = []

    def test(pairs):
        tested.extend(tuple(r) for r in pairs.collect())
        return linking.confirmed(pairs, items, lambda x, y: alike(x, y, 85))

    found = linking.linked_sets(linking.star_pairs(members), members, lambda ids: items.select(F.col("id").alias("node"), F.explode("items").alias("h")).join(ids, "node"), test, 85)
    assert {tuple(r) for r in found.select("node", "component").collect()} == {(2 * k + x, 2 * k) for k in range(0, 100, 10) for x in (0, 1)}
    assert len(tested) == len(set(tested)) <= 199 + 400  # the star and few others of 19,900 pairs


def test_few_links_need_no_shuffle(spark, monkeypatch):
    make, plans = rounds.materialise, []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return make(df)

    monkeypatch.setattr(rounds, "materialise", noted)
    links = spark.range(200).select((F.col("id") * 7 % 150).alias("a"), (F.col("id") * 11 % 130).alias("b"))
    few = {r["id"]: r["component"] for r in components(links).collect()}
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in p for p in plans[1:])
    monkeypatch.setattr(common, "FEW", 0)
    assert {r["id"]: r["component"] for r in components(links).collect()} == few
    known = make(components(links.where("a % 2 = 0")).withColumnRenamed("id", "node"))
    for bound in (0, 20_000):
        monkeypatch.setattr(common, "FEW", bound)
        assert {r["node"]: r["component"] for r in linking._merged(known, links).collect()} == few
