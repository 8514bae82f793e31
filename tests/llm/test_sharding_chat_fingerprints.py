import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import regista.llm.fingerprints as fingerprints
from regista.llm.chat import contrasted, format_preferences
from regista.llm.common import with_rank
from regista.llm.queries import ORACLE_SQL, op4_preference_format
from regista.llm.sharding import hilbert_index, shard_rows, write_shards
from tests.oracle import connect, rows


def test_hilbert_steps_are_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1)
        place = hilbert_index(grid, bits)
        assert sorted(place) == list(range(1 << (dims * bits)))
        assert (np.abs(np.diff(grid[:, np.argsort(place)])).sum(axis=0) == 1).all()


def test_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(-1, None, None, None, None), (-1, None, None, None, None), (-2, "é", "en", None, 1)], docs.schema))
    got = shard_rows(docs).collect()
    n = docs.count()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == n and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in got)
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in got)
    again = shard_rows(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert shard_rows(docs.limit(0)).count() == 0 and shard_rows(docs.limit(3)).count() == 3
    write_shards(docs.where("doc_id >= 0"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == n - 3 and back.select("shard").distinct().count() == 8


def test_rank(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(6)
    got = sorted((r["rank"], r["k"], r["id"]) for r in with_rank(df, F.col("k"), F.col("id").desc()).collect())
    assert [g[1:] for g in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (x[0], -x[1]))
    assert [g[0] for g in got] == list(range(1000))


def test_fingerprints(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 30)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-5, None), (-4, ""), (-3, "é"), (-3, "abc")], docs.schema))
    ordered = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))
    got = fingerprints.compared(docs).collect()
    seen = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got}
    for (k, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert (k, len(a), hashlib.sha256(edited.encode()).hexdigest()) in seen
    texts = dict(ordered)
    by_text = {}
    for r in got:
        if r["doc_id"] != -3:
            by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())
    long = [r for r in got if r["n_chars"] >= 100]
    assert np.mean([r["near_edited"] > 0 for r in long]) > 0.8 and np.mean([r["near_edited"] for r in got]) > 5 * np.mean([r["near_next"] for r in got if r["near_next"] < 1])
    alone = fingerprints.fingerprint(docs).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] >= 0}
    assert all(r["fingerprint"] == prints[r["doc_id"]] for r in alone if r["doc_id"] >= 0)
    assert fingerprints.compared(docs.limit(0)).count() == 0
    assert fingerprints.compared(docs.where("doc_id = 0")).first()["near_next"] == 1.0


def test_preferences(spark):
    schema = "pair_id long, turn int, role string, text string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "ok"), (2, 0, "user", "a"), (3, 0, "user", "x"), (4, 0, None, None), (4, 1, "assistant", "t"), (None, 0, "user", "z")]
    rejected = [(1, 5, "user", "hi"), (1, 7, "assistant", "no"), (2, 0, "user", "a"), (9, 0, "user", "x"), (4, 0, None, None), (4, 1, "assistant", None), (4, 1, "assistant", None)]
    df = format_preferences(spark.createDataFrame(chosen, schema).withColumn("prompt", F.lit(1)), spark.createDataFrame(rejected, schema))
    got = {r["pair_id"]: r for r in df.collect()}
    assert set(got) == {1, 2, 4}
    one = got[1]
    assert one["n_common"] == 1 and one["prompt"] == "<|user|>\nhi<|end|>\n"
    assert one["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\nok<|end|>\n" and one["rejected"] == "<|assistant|>\nno<|end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_spans"]] == ["yes<|end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["no<|end|>\n"]
    assert (got[2]["chosen"], got[2]["rejected"], got[2]["n_common"]) == ("", "", 1)
    assert got[4]["n_common"] == 1 and got[4]["rejected"] == "<|assistant|>\n<|end|>\n" * 2
    assert format_preferences(df.sparkSession.createDataFrame([], schema), df.sparkSession.createDataFrame([], schema)).count() == 0


def test_preference_query_gives_the_rows_of_its_sql(spark, sf_dir):
    ours = op4_preference_format(spark, sf_dir).toPandas()
    sql = connect(sf_dir).sql(ORACLE_SQL["op4_preference_format"]).df()
    assert rows(ours) == rows(sql)


def test_every_conversation_has_a_row(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 2, "user", "c"), (5, 3, "assistant", "d"), (5, 4, "user", "thanks"), (9, 0, "user", "no answer"), (-4, 0, "assistant", "e"), (70, 3, "assistant", None), (70, 3, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.lit(1)).withColumn("rank", F.lit(2))
    got = {r["pair_id"]: r for r in format_preferences(*contrasted(df)).collect()}
    assert set(got) == {5, 9, -4, 70}
    assert got[5]["n_common"] == 3 and got[5]["chosen"].endswith("thanks<|end|>\n") and got[5]["rejected"].endswith("thanks<|end|>\n")
    assert got[5]["chosen"].startswith("<|assistant|>\nd<|end|>") and got[5]["rejected"].startswith("<|assistant|>\n<|end|>")
    assert got[9]["n_common"] == 1 and got[9]["chosen"] == got[9]["rejected"] == ""
    assert (got[-4]["n_common"], got[-4]["rejected"]) == (0, "<|assistant|>\nd<|end|>\n")
    alone = format_preferences(*contrasted(df.where("conv_id = 5"))).first()
    assert alone["n_common"] == 5 and alone["rejected"] == ""
    assert format_preferences(*contrasted(df.limit(0))).count() == 0


def test_fingerprints_match_brute_force(spark):
    """Terms, band, subsets and likeness, one text at a time; only the 64-bit hashes are Spark's."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{w}" for w in rng.integers(0, 60, 30)) for _ in range(40)] + ["solitary words here", "other lone ones", "", None, "... !"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("Fingerprint", F.lit("old"))
    found = [set(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    df = collections.Counter(w for s in found for w in s)
    band = {w for w, n in df.items() if 0.5 <= math.log(len(texts) / n) <= 1.5}
    hashed = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in df], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = spark.createDataFrame([(h, k) for h in hashed.values() for k in range(fingerprints.SUBSETS)], "h long, k int")
    salted = {(r["h"], r["k"]): r["x"] for r in pairs.select("h", "k", F.xxhash64("h", "k").alias("x")).collect()}
    members = []
    for s in found:
        terms = sorted(hashed[w] for w in s & band)
        if terms:
            first = max(int(math.floor(math.log2(len(terms)))) - 1, 0)
            sizes = [first + (k // fingerprints.EACH - first) % fingerprints.SCALES for k in range(fingerprints.SUBSETS)]
            members.append([(j, inside) if (inside := tuple(t for t in terms if salted[t, k] & ((1 << j) - 1) == 0)) else None for k, j in enumerate(sizes)])
        else:
            members.append([("every", tuple(sorted(s))) if s else None] + [None] * (fingerprints.SUBSETS - 1))
    out = fingerprints.fingerprint(docs, (0.5, 1.5))
    assert out.columns == ["doc_id", "text", "key", "fingerprint"]
    got = {r["doc_id"]: [r["fingerprint"][16 * k : 16 * k + 16] for k in range(fingerprints.SUBSETS)] for r in out.collect()}
    for a in range(len(texts)):
        assert [x == fingerprints.NOTHING for x in got[a]] == [m is None for m in members[a]]
        for b in range(a):
            assert [x == y for x, y in zip(got[a], got[b], strict=True)] == [m == n for m, n in zip(members[a], members[b], strict=True)]


def test_files_prune_and_names_may_clash(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as shard", "2 as slot", "3 as SHARD_", "4 as doc")
    docs = docs.union(docs.where("doc_id < 3"))
    write_shards(docs, str(tmp_path / "out"), rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(back.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard__", "slot", "SHARD_", "doc", "shard"}
    files = list((tmp_path / "out").rglob("*.parquet"))
    pairs = [(m.row_group(0).column(m.schema.names.index("lang")).statistics, m.num_rows) for m in (pq.read_metadata(f) for f in files) if m.num_rows]
    langs = sorted({r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"]})
    read = sum(n for lang in langs for s, n in pairs if s.has_min_max and s.min <= lang <= s.max)
    assert read < 0.6 * len(langs) * docs.count()  # a filter on a language skips most files by their statistics
    write_shards(docs.limit(0), str(tmp_path / "none"))


def test_shard_order_is_the_curve_then_crc_and_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    got = sorted(shard_rows(docs).collect(), key=lambda r: (r["shard"], r["slot"]))
    rows = docs.collect()
    level = {}
    for c in ("lang", "source"):
        values = sorted({r[c] for r in rows}, key=lambda v: (v is None, v or ""))
        level[c] = {v: k * 256 // len(values) for k, v in enumerate(values)}
    size = lambda r: len((r["text"] or "").encode()) + 1
    cell = np.array([[level["lang"][r["lang"]], level["source"][r["source"]], min(255, int(math.floor(math.log2(size(r)) * 8)))] for r in rows]).T
    place = {r["doc_id"]: int(h) for r, h in zip(rows, hilbert_index(cell, 8), strict=True)}
    expected = sorted(rows, key=lambda r: (place[r["doc_id"]], zlib.crc32((r["text"] or "").encode()), r["doc_id"]))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in expected] and all(r["hilbert"] == place[r["doc_id"]] for r in got)
