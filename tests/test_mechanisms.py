import datetime
import json
import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from regista.functions import ranks, reading, text
from regista.operators import family, ingest, similarity
from regista.plans import lookups
from regista.plans.registry import ORACLE_SQL
from regista.sources import export, pages
from regista.streaming import jobs as stream


def test_linkage_of_one_key_is_linear(spark):
    rows = spark.range(200_000).select(F.col("id"), (1700 + F.col("id") % 150).cast("int").alias("year"), F.lit("k").alias("name"))
    began = time.time()
    found = family.linked_in_time(rows, rows.withColumn("id", -F.col("id")), "name", 1)
    assert found.groupBy().agg(F.count("first_id"), F.min("later_id"), F.max("later_id")).first()[0] == 200_000 - 1333 - (200_000 % 150 > 149)
    assert time.time() - began < 60


def test_linkage_equals_brute_force(spark):
    draw = random.Random(1)
    a = [(k, draw.choice([0, None, *range(1800, 1820)]), draw.choice("abc") if k % 9 else None) for k in range(120)]
    b = [(500 + k, draw.choice([0, None, *range(1800, 1820)]), draw.choice("abc") if k % 7 else None) for k in range(60)]
    expected = set()
    for i, y, n in a:
        later = [(v, j) for j, v, m in b if n and n == m and y and v and v >= y + 1]
        expected |= {(i, min(later)[1])} if later else set()
    schema = "id long, year int, name string"
    found = family.linked_in_time(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "name", 1)
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 20


def nearest(people, others, k):
    out = set()
    for i, y, *g in people:
        by = defaultdict(list)
        for j, z, *h in others:
            if i != j and g == h and None not in (y, z, *g):
                d = z - y
                for name, fits in (("child", d >= 15), ("parent", d <= -15), ("sibling", abs(d) <= 5)):
                    if fits:
                        by[name].append((abs(d), j, d))
        out |= {(i, j, name, d, rank) for name, found in by.items() for rank, (_, j, d) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("groups", ["a", "abcd"])
def test_nearest_relations_equal_brute_force(spark, groups):
    draw = random.Random(groups)
    rows = [(k, draw.choice([None, *range(1800, 1860)]) if groups != "a" else draw.choice([1800, 1803, 1803, 1820]), draw.choice(groups), draw.choice(["x", None]) if groups != "a" else "x") for k in range(150)]
    df = spark.createDataFrame(rows, "id long, year int, surname string, place string")
    found = family.nearest_relations(df, df, ["surname", "place"], 2)
    assert {tuple(r) for r in found.collect()} == nearest(rows, rows, 2) and found.count() > 50
    assert family.nearest_relations(df.where("false"), df, ["surname"]).count() == 0


def test_ancestors_end_in_circles_and_take_the_shortest_way(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (4, 4), (5, 1)], "child long, parent long")
    found = family.ancestors(spark.createDataFrame([(1,), (5,), (9,), (1,)], "id long"), links, 9)
    assert {tuple(r) for r in found.collect()} == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (5, 1, 1), (5, 2, 2), (5, 3, 2), (5, 4, 3)}


def test_family_tree(spark):
    people = spark.createDataFrame([(1,)], "id long")
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (7, 1), (8, 1), (4, 9)], "child long, parent long")
    couples = spark.createDataFrame([(10, 1), (2, 3)], "a long, b long")
    found = {tuple(r)[1:] for r in family.family_tree(people, links, couples).collect()}
    assert found == {(2, 1, "parent"), (3, 1, "parent"), (4, 2, "grandparent"), (5, 2, "grandparent"), (6, 3, "grandparent"), (1, 10, "spouse"), (1, 7, "child"), (1, 8, "child")}


def test_tables_inside_tables(spark):
    html = '<!DOCTYPE html><title>Prados</title><table id="out"><tr><th>A<!-- <td> --></th><td>x <a href=\'/1\'>one</a> <A class=c href="/2">two</A><table><caption>Inner</caption><tr><td>deep</td><td></td></tr></table> y</td></tr><tr><td>1 < 2</td></tr></table><table><tr><td>last'
    cells = pages.html_cells(spark.createDataFrame([(1, html), (2, None), (3, "no table")], "page_id long, html string"))
    assert sorted(tuple(r)[1:] for r in cells.collect()) == [
        (1, 1, 1, 1, "A", []), (1, 1, 1, 2, "x one two y", ["/1", "/2"]), (1, 1, 2, 1, "1 < 2", []), (1, 2, 1, 1, "last", []), (2, 1, 1, 1, "deep", []), (2, 1, 1, 2, "", []),
    ]
    books = pages.html_books(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert sorted((r.parish, r.kind or "", r.title, r.href or "") for r in books) == [("Prados", "", "last", ""), ("Prados", "Inner", "deep", ""), ("Prados", "out", "1 < 2", ""), ("Prados", "out", "A", "/1"), ("Prados", "out", "A", "/2")]


def test_torn_and_damaged_snapshots_are_left_out(spark, tmp_path):
    path, metrics = str(tmp_path / "h"), lambda n: spark.createDataFrame([(n,)], "n long")
    read = lambda: [(r.number, r.n) for r in export.read_snapshots(spark, path, "n long").orderBy("number").collect()]
    assert read() == [] and export.append_snapshot(metrics(10), path) == 0
    metrics(99).write.parquet(f"{path}/snapshot-1-torn")  # stopped before its manifest
    assert export.append_snapshot(metrics(11), path) == 1 and export.append_snapshot(metrics(12), path) == 2
    assert read() == [(0, 10), (1, 11), (2, 12)]
    manifest = json.loads(next((tmp_path / "h/_manifests/1").glob("*.json")).read_text())
    for f in (tmp_path / "h" / manifest["folder"]).iterdir():  # its rows are damaged later
        f.write_bytes(b"no rows")
    for f in (tmp_path / "h/_manifests/2").iterdir():  # its manifest too
        f.write_text("{torn") if not f.name.startswith(".") else f.unlink()
    assert read() == [(0, 10)]
    export.append_snapshot(metrics(13), path)
    assert read()[0] == (0, 10) and read()[-1][1] == 13


def test_alerts_are_given_once_whatever_is_run_again(spark, tmp_path):
    q, pos = str(tmp_path / "q"), str(tmp_path / "p")
    put = lambda batch, rows: spark.createDataFrame(rows, "user_id long, event_id long").write.mode("overwrite").parquet(f"{q}/batch={batch}")
    get = lambda n, users=None: sorted((r.user_id, r.event_id) for r in stream.drained(spark, q, pos, n, users).collect())
    put(0, [(1, 10), (2, 20)])
    one = spark.createDataFrame([(1,)], "user_id long")
    assert get(0, one) == [(1, 10)] == get(0, one)  # a drain that is run again
    put(1, [(1, 11), (3, 30)])
    assert get(1) == [(1, 11), (2, 20), (3, 30)] == get(1)
    assert get(2) == []
    put(1, [(1, 11), (3, 30)])  # a batch that is run again
    put(2, [(3, 31)])
    assert get(3) == [(3, 31)]


def test_ingest_opens_few_files_however_many_there_are(spark, tmp_path):
    opened = []
    for n in range(12):
        rows = spark.range(n * 100, n * 100 + 100).select(F.col("id").alias("event_id"))
        rows.union(rows.limit(5)).coalesce(1).write.json(str(tmp_path / f"in{n}"))
        new = rows.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int"))
        opened.append(len(stream.files_with(spark, str(tmp_path / "out"), new, ["event_id"])))
        stream.ingest(stream.page_stream(spark, str(tmp_path / f"in{n}"), "event_id long"), str(tmp_path / "out"), str(tmp_path / f"c{n}"), ["event_id"], 4).awaitTermination()
    assert opened == [0] * 12
    old = spark.range(250, 260).select(F.col("id").alias("event_id"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("part"))
    assert 0 < len(stream.files_with(spark, str(tmp_path / "out"), old, ["event_id"])) <= 4
    stream.ingest(stream.page_stream(spark, str(tmp_path / "in3"), "event_id long"), str(tmp_path / "out"), str(tmp_path / "again"), ["event_id"], 4).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1200


def test_late_pages_within_and_beyond_the_watermark(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(hours=h)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    run = lambda: stream.completed(
        spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "r/*")), spark.readStream.schema("k long, page_ts timestamp, v string").parquet(str(tmp_path / "p/*")), "k", "ts", "page_ts", "30 MINUTES", "2 hours"
    ).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    put("r/0", [(1, at(0)), (2, at(4)), (3, at(5)), (9, at(6))], "k long, ts timestamp")
    put("p/0", [(9, at(6), "own")], "k long, page_ts timestamp, v string")  # the watermark is at four o'clock after this
    run()
    put("p/1", [(1, at(0.2), "beyond"), (2, at(4.3), "within"), (9, at(9), "far")], "k long, page_ts timestamp, v string")
    put("r/1", [(10, at(9))], "k long, ts timestamp")
    run()
    put("p/2", [(11, at(12), "none")], "k long, page_ts timestamp, v string")
    put("r/2", [(12, at(12))], "k long, ts timestamp")
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.k < 9) == [(1, None), (2, "within"), (3, None)]


def test_no_private_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(lambda: {})  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ranks.shared_folder(Session)


def exact(rows, k):
    ids = [i for i, v in rows if v and any(v)]
    x = np.array([v for _, v in rows if v and any(v)], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    like = x @ x.T
    np.fill_diagonal(like, -9)
    return {i: {ids[j] for j in np.argsort(-like[n], kind="stable")[:k]} for n, i in enumerate(ids) if i % 20 == 0}


def recall(found, expected):
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add(r.other)
    return np.mean([len(got.get(i, set()) & e) / len(e) for i, e in expected.items()])


def test_index_finds_nine_of_ten(spark, sf_dir):
    rows = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    expected = exact([tuple(r) for r in rows.collect()], 5)
    assert recall(similarity.similar(rows.where("id % 20 = 0"), rows, 5, lists=64, probes=40), expected) >= 0.9


def test_index_of_clusters_reads_few_lists(spark):
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(30, 16))
    data = [(n, (middle[n % 30] + 0.1 * draw.normal(size=16)).tolist()) for n in range(1500)]
    odd = [(5001, None), (5002, [0.0] * 16), (5003, [1.0, 2.0]), (5020, None)]
    rows = spark.createDataFrame(data + odd, "id long, embedding array<float>")
    c = similarity.centroids(rows.where("size(embedding) = 16"), 30)
    index = similarity.placed(rows, c)
    assert c.shape == (30, 16) and index.count() == 1500  # every row with a direction is in a list
    assert recall(similarity.search(rows.where("id % 20 = 0"), index, c, 5, probes=2), exact(data, 5)) >= 0.97
    assert similarity.similar(rows, rows.where("false")).count() == 0


def test_nearest_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(family, "BLOCK", 40)
    monkeypatch.setattr(family, "ASKED", 7)
    draw = np.random.default_rng(9)
    data = [(n, draw.integers(-2, 3, size=3).astype(float).tolist(), n % 2) for n in range(400)]  # many are equal or have one direction
    data = [r for r in data if any(r[1])] + [(1000, None, 0), (1020, [1.0, None, 2.0], 0), (1040, [1.0, 2.0], 1), (1060, [0.0] * 3, 1), (2000, [1.0, 0.0], 7), (2020, [1.0, 1.0], 7), (2040, None, 7)]
    rows = spark.createDataFrame(data, "id long, embedding array<double>, label int")
    found = {}
    for r in family.most_similar(rows.where("id % 20 = 0"), rows, 5).collect():
        found.setdefault(r.id, []).append((r["rank"], r.other, r.similarity))

    def like(x, y):
        if x is None or y is None or len(x) != len(y) or None in x + y or not (any(x) and any(y)):
            return None
        dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    for i, x, label in data:
        if i % 20 == 0:
            told = [(like(x, y), j) for j, y, m in data if m == label and j != i]
            told = sorted(told, key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))[:5]
            assert [(n + 1, j, s) for n, (s, j) in enumerate(told)] == sorted(found.get(i, []))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_among_equal_vectors_and_repeated_ids(spark, monkeypatch, kind):
    """Parts of one unit each: equal vectors beyond the first ones, ids that stand twice, and rows without a similarity."""
    monkeypatch.setattr(family, "BLOCK", 120)
    monkeypatch.setattr(family, "ASKED", 5)
    inf, nan = float("inf"), float("nan")
    data = [(n, [1.0, 2.0, -1.0] if n % 4 else [float(n % 7), 1.0, float(n % 5)], 0) for n in range(300)]
    data += [(7, [1.0, 2.0, -1.0], 0), (7, [0.0, 1.0, 1.0], 0), (8, None, 0), (400, [inf, 1.0, 0.0], 0), (401, [nan, 1.0, 0.0], 0), (402, [1.0, 2.0], 0), (403, [], 0), (404, [0.0] * 3, 0)]
    data += [(500, [1.0, 1.0], 1), (501, None, 1), (502, [2.0, 2.0], 1), (503, [1.0], 1), (600, [1.0], 2), (None, [1.0], 1), (601, [1.0], None), (602, [1.0], None)]
    data = [(None if i is None else i if kind == "long" else f"v{i}", x, label) for i, x, label in data]
    schema = f"id {kind}, embedding array<double>, label int"
    rows, asked = spark.createDataFrame(data, schema), {i: (x, label) for i, x, label in reversed(data)}

    def like(x, y):
        known = lambda v: v and all(math.isfinite(p) for p in v) and any(v)
        if not (known(x) and known(y) and len(x) == len(y)):
            return None
        dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    got = {}
    for r in family.most_similar(spark.createDataFrame([(i, *told) for i, told in asked.items()], schema), rows, 6).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.similarity))
    for i, (x, label) in asked.items():
        told = [(like(x, y), j) for j, y, m in data if None not in (i, j, label) and m == label and j != i]
        told = sorted(told, key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))[:6]
        assert [(n + 1, j, s) for n, (s, j) in enumerate(told)] == sorted(got.get(i, [])), i


def test_every_vector_is_asked_for_its_relatives(spark, sf_dir):
    """Not only those of some ids: each vector with another one of its label has its rows, 50 where there are so many."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    labels = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    expected = {r["vec_id"]: min(50, labels[r["label"]] - 1) for r in rows.collect() if labels[r["label"]] > 1}
    assert {r["id"]: r["count"] for r in lookups.potential_relatives(spark, sf_dir).groupBy("id").count().collect()} == expected
    assert "%" not in ORACLE_SQL["potential_relatives"].split("p AS")[0]


def test_no_row_for_a_pair_of_vectors(spark):
    rows = spark.range(20).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), F.lit(1).alias("label"))
    plan = family.most_similar(rows, rows, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan.lower()


def test_lowest_texts_of_ids_with_several_needles(spark):
    texts = spark.createDataFrame([(n, f"Ana {n}") for n in range(60, 0, -1)] + [(n, "Rui Ana") for n in range(100, 110)] + [(None, "Ana")], "text_id long, text string")
    needles = spark.createDataFrame([(1, "Ana"), (2, "Ana"), (2, "Rui"), (101, "Rui"), (7, "no"), (8, "Eva")], "needle_id long, needle string")
    got = {}
    for r in family.containing(needles, texts, 3).collect():
        got.setdefault(r.needle_id, []).append(r.text_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: [2, 3, 4], 2: [1, 3, 4], 101: [100, 102, 103]}


def test_siblings_of_a_common_father_make_no_pairs(spark):
    people = spark.range(100_000).select("id", F.lit("Ana Ring").alias("nome"), F.lit("BIRT").alias("tipo_registo"), F.when(F.col("id") == 5, "Eva").otherwise("Rui").alias("pai"))
    began = time.time()
    got = {r["role"]: r["n"] for r in family.connections(people, "ring").groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"birth": 100_000, "sibling": 99_999}  # ten thousand million pairs
    assert time.time() - began < 60


def test_whole_texts_are_read_by_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.txt").write_text("x")
    assert sorted(tuple(r) for r in pages.read_texts(spark, str(tmp_path)).collect()) == [("a", "one\n\ntwo"), ("b", "x")]


def test_damaged_pages_are_put_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"file_id": "x",\n "raw_text": "t"}')
    (tmp_path / "b.json").write_text('{"file_id": "y", "raw_')
    assert [r.file_id for r in pages.read_pages(spark, str(tmp_path)).collect()] == ["x"]
    assert [(r.file, r.text) for r in pages.damaged_pages(spark, str(tmp_path)).collect()] == [("b.json", '{"file_id": "y", "raw_')]


PAGE_ROWS = [
    {"file_id": "b", "record_type": "BIRT", "baptized": [{"name": "Ana Maria da Silva", "birth_date": "1/2/1800", "father": "Rui"}]},
    {"file_id": "m", "persons": [{"name": "Luis Vaz", "spouse": "Eva Sá", "marriage_date": "1801-02-03"}]},
    {"file_id": "d", "deceased": [{"name": "Rui Pinto", "death_date": "3 de Maio de 1901"}, {"name": ""}], "transcription": "com 30 annos"},
    {"file_id": "t", "raw_text": "Registo de obito desta terra. Faleceu Manuel de Sousa Freguesia em sua casa e foi sepultado aqui."},
    {"file_id": "s", "raw_text": "curto"},
]


def test_pages_become_persons_once_and_text_is_the_fallback(spark, tmp_path):
    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))

    def run(checkpoint):
        return stream.ingest_pages(stream.page_stream(spark, str(tmp_path / "in"), pages.PAGE, 1), str(tmp_path / "out"), str(tmp_path / checkpoint), ("freguesia",)).awaitTermination()

    put("one", PAGE_ROWS[:3] + PAGE_ROWS[:1])
    run("c")
    put("two", PAGE_ROWS)  # the first three again
    run("c")
    run("other")  # everything again
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert sorted((r.file_id, r.tipo_registo, r.nome, r.sobrenome) for r in read("persons").collect()) == [
        ("b", "BIRT", "Ana Maria da", "Silva"), ("d", "DEAT", "Rui", "Pinto"), ("m", "MARR", "Eva", "Sá"), ("m", "MARR", "Luis", "Vaz"), ("t", "DEAT", "Manuel", "Sousa"),
    ]
    assert sorted((r.file_id, r.status, r.n) for r in read("done").collect()) == [("b", "synced", 1), ("d", "synced", 1), ("m", "synced", 2), ("s", "too_short", 0), ("t", "synced", 1)]


def test_a_batch_that_stopped_before_its_index_is_replaced(spark, tmp_path, monkeypatch):
    spark.range(20).select(F.col("id").alias("event_id")).coalesce(1).write.json(str(tmp_path / "in"))
    run = lambda: stream.ingest(stream.page_stream(spark, str(tmp_path / "in"), "event_id long"), str(tmp_path / "out"), str(tmp_path / "c"), ["event_id"], 2).awaitTermination()
    with monkeypatch.context() as m:
        m.setattr(stream, "key_ranges", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_relations_of_large_classes(spark):
    """Classes of one year are joined, not people; ids of every class meet in full, and rows without an id, a year or a group are left out."""
    rows = [(i, 1800 + i % 3 * 16, "a" if i % 2 else "b") for i in range(700)] + [(None, 1800, "a"), (901, None, "a"), (902, 1800, None)]
    people = spark.createDataFrame(rows, "id long, year int, place string")
    classes = family._classes(people, ["place"])
    assert classes.count() <= 6 * 4 and classes.agg(F.sum(F.size("ids"))).first()[0] == 700
    got = {(r["id"], r["other"], r["relation"]) for r in family.relations_by_years(people, people, ["place"]).collect()}
    known = [r for r in rows if None not in r]
    named = lambda d: "child" if d >= 15 else "parent" if d <= -15 else "sibling" if abs(d) <= 5 else None
    assert got == {(a[0], b[0], named(b[1] - a[1])) for a in known for b in known if a[2] == b[2] and a[0] != b[0] and named(b[1] - a[1])}


def test_pairs_of_few_large_groups_are_dealt_to_many_tasks(spark, monkeypatch):
    """Tasks go by the pairs, which small rows of classes stand for, and every pair is made in one of the units of its group."""
    monkeypatch.setattr(family, "UNIT_PAIRS", 1 << 14, raising=False)
    monkeypatch.setattr(family, "TASK_PAIRS", 1 << 10, raising=False)
    people = spark.range(600).select("id", (1800 + F.col("id") % 40).cast("int").alias("year"), F.when(F.col("id") < 570, "a").otherwise("b").alias("place"))
    others = people.where("id % 3 > 0")
    for right in (people, others):
        made = family.relations_by_years(people, right, ["place"])
        assert made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() >= 8
        got = sorted((r["id"], r["other"], r["relation"]) for r in made.collect())
        rows = [(r["id"], r["year"], r["place"]) for r in people.collect()]
        met = [r for r in rows if right is people or r[0] % 3]
        named = lambda d: "child" if d >= 15 else "parent" if d <= -15 else "sibling" if abs(d) <= 5 else None
        assert got == sorted((a[0], b[0], named(b[1] - a[1])) for a in rows for b in met if a[2] == b[2] and a[0] != b[0] and named(b[1] - a[1]))


def test_raw_pages_are_dealt_by_size(spark, monkeypatch):
    """The partitions of raw pages grow with their text, and the cells stay the same."""
    html = "<table id='t'><tr><td>a <a href='x'>b</a></td><td>c</td></tr></table>"
    raw = spark.createDataFrame([(k, html) for k in range(40)] + [(40, None)], "page_id long, html string")
    whole = sorted(map(str, pages.html_cells(raw).collect()))
    monkeypatch.setattr(pages, "TASK_CHARS", 4 * len(html))
    assert pages.html_parts(raw).rdd.getNumPartitions() == 11
    assert len(whole) == 80 and sorted(map(str, pages.html_cells(raw).collect())) == whole
    assert pages.html_parts(raw.limit(0)).count() == 0


def test_marked_words(spark):
    """Words keep their places when signs are taken off in the whole text, and only places of the given words are looked at."""
    df = spark.createDataFrame([(" Com,\t«vinte» —\n.a.b. ANNOS", 1), ("", 2), (None, 3), ("com", 4)], "t string, k int")
    got = {r["k"]: r["w"].asDict() for r in df.select("k", reading.spoken(F.col("t"), ("com", "annos")).alias("w")).collect()}
    assert got[1] == {"raw": ["Com,", "«vinte»", "—", ".a.b.", "ANNOS"], "word": ["com", "vinte", "", "a.b", "annos"], "marks": [0, 4]}
    assert got[2] == got[3] == {"raw": [], "word": [], "marks": []} and got[4]["marks"] == [0]


def test_texts_of_persons_are_read_once(spark):
    """The filter for texts with a person reads the column of the row, not the text again."""
    none = F.array().cast("array<struct<name:string>>")
    rows = spark.createDataFrame([("a", "x" * 60), ("b", None)], "file_id string, raw_text string").select("*", F.lit(None).cast("string").alias("record_type"), *[none.alias(c) for c in ("deceased", "baptized", "persons")])
    mentions = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Arcipreste")
    assert mentions(ingest.text_persons(rows)) == mentions(rows.select(text.person_in_text(F.col("raw_text")).alias("p")))


def test_first_of_equal_line_items_counts(spark, tmp_path):
    import duckdb

    from regista.plans.lookups import book_list_update
    from regista.plans.registry import ORACLE_SQL

    c = duckdb.connect()
    c.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey, 1.0::DOUBLE AS s_acctbal FROM range(40) t(i)")
    c.execute("CREATE TABLE lineitem AS SELECT (i % 40) AS l_suppkey, 7 AS l_orderkey, 1::INTEGER AS l_linenumber, CASE (i // 40 + (i % 40) // 30) % 4 WHEN 0 THEN 'R' WHEN 3 THEN 'N' ELSE 'A' END AS l_returnflag FROM range(400) t(i)")
    for t in ("supplier", "lineitem"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    expected = c.sql(ORACLE_SQL["book_list_update"]).fetchall()
    assert expected == [(40, 40, 30)]
    assert [tuple(r) for r in book_list_update(spark, str(tmp_path)).collect()] == expected
