import datetime
import json
import re

from pyspark.sql import functions as F

from regista.functions import text
from regista.operators import family, ingest, repair, review, search, statistics
from regista.sources import export, pages
from regista.streaming import jobs as stream


def write_pages(path):
    death = {"name": "Dom João da Silva", "death_date": "1890-02-00", "age": "72", "pai": "José", "father": ""}
    marriage = {"name": "José Pinto", "spouse": "Ana Sousa", "marriage_date": "05/12/1899", "testemunhas": [" A B ", "", "C"], "idade": "x"}
    docs = {
        "a": {"file_id": "a", "record_type": "DEAT", "deceased": [death], "transcription": "Assento n.º 4, lavrador"},
        "b": {"file_id": "b", "record_type": "MARR", "persons": [marriage, {"name": "Só Noivo"}]},
        "c": {"record_type": "BIRT", "baptized": [{"nome": "Rita Alves", "baptism_date": "1/2/1800", "father": "Rui Alves"}]},
        "d": {"file_id": "d", "raw_text": "Faleceu nesta freguesia, livro de obitos, o defunto D. Manuel Sousa Pinto em 3 de maio de 1850, António de Sousa", "parsed_ok": False},
    }
    for k, v in docs.items():
        (path / f"{k}.json").write_text(json.dumps(v, ensure_ascii=False))
    (path / "bad.json").write_text("{not valid")


def test_ingest(spark, tmp_path):
    write_pages(tmp_path)
    read = pages.read_pages(spark, str(tmp_path))
    assert read.count() == 4
    assert {r["file_id"] for r in read.select("file_id").collect()} == {"a", "b", "c", "d"}
    people = {(r["file_id"], r["nome"]): r for r in ingest.persons(read).collect()}
    a = people["a", "João da"]
    assert (a["sobrenome"], a["data_obito"], a["idade"], a["pai"], a["numero_assento"], a["profissao"]) == ("Silva", datetime.date(1890, 2, 1), 72, "José", "4", "lavrador")
    groom, bride = people["b", "José"], people["b", "Ana"]
    assert (groom["conjuge"], bride["conjuge"], groom["testemunhas"], groom["papel"], bride["papel"], groom["idade"]) == ("Ana Sousa", "José Pinto", "A B; C", "groom", "bride", None)
    assert ("b", "Só") in people and len([k for k in people if k[0] == "b"]) == 3
    assert people["c", "Rita"]["data_nascimento"] == datetime.date(1800, 2, 1)
    assert people["d", "Manuel Sousa"]["data_obito"] == datetime.date(1850, 5, 3)
    c = {r["type"]: r for r in statistics.coverage(read).collect()}
    assert (c[None]["total"], c[None]["with_entries"], c[None]["with_entries_rate"], c["DEAT"]["total"]) == (4, 3, 75.0, 2)


def test_json_recovery(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```', False), ('{"a": 2}', None), ("prose", False), ("", False), ("{not valid}", False), ('{"a": 3}', True)], "raw_text string, parsed_ok boolean")
    got = [(r["status"], r["parsed"] and r["parsed"]["a"]) for r in pages.reparsed(df, "a int").collect()]
    assert [g[0] for g in got][:4] == ["reparsed", "reparsed", "unparseable", "unparseable"] and got[5][0] == "already_ok" and got[0][1] == 1


def test_listing_and_books(spark):
    df = spark.createDataFrame([('{"D1": [{"id": "f1", "name": "n"}, {"id": ""}], "D2": "text", "D3": null}',)], "listing string")
    assert [tuple(r) for r in pages.listing_rows(df).collect()] == [("D1", "f1")]
    html = '<html><title>Prados</title><table id="t"><caption>Óbitos</caption><tr><td>Livro 1</td><td>1654-1790</td><td><a href="https://x/documentDetails/77?p=1">v</a></td></tr></table></html>'
    row = pages.html_books(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert (row["parish"], row["kind"], row["title"], row["doc_id"], tuple(row["years"])) == ("Prados", "Óbitos", "Livro 1", "77", (1654, 1790))
    md = spark.createDataFrame([("| 12 | BIRT |",), ("| 13 | DEAT |",), ("x",)], "value string")
    assert [r["id"] for r in pages.retry_ids(md).collect()] == [12]
    ext = spark.createDataFrame([('{"entries": [{"id": "1", "content": {"name": "Ana", "birth": ""}}, {"id": "2", "content": {}}]}',)], "json string")
    assert [(r["id"], r["name"], r["birth"]) for r in pages.external_people(ext).collect()] == [("1", "Ana", None)]


def test_export(spark, tmp_path):
    people = spark.createDataFrame([(1, 'D. Ana "A" Sousa', datetime.date(1864, 1, 15), "Prados", "s", 3, None)], "number long, name string, death date, place string, source string, page int, book string")
    lines = [r["line"] for r in export.gedcom_blocks(people).orderBy("line_no").collect()]
    assert lines == ["0 @I1@ INDI", '1 NAME Ana /"A" Sousa/', "1 DEAT", "2 DATE 15 JAN 1864", "2 PLAC Prados", "1 SOUR s", "1 NOTE Pág. 3"]
    export.write_gedcom(people, str(tmp_path / "g"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert "0 TRLR" in text and "0 HEAD" in text
    export.write_csv(people.select("number", "name"), str(tmp_path / "c"), ["number"])
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first()["name"] == 'D. Ana "A" Sousa'
    masks = spark.createDataFrame([("abcdefghij",), ("short",), (None,), ("abcd**ghij",)], "v string").select(export.masked(F.col("v"))).collect()
    assert [r[0] for r in masks] == ["abcd**ghij", "*****", "", "abcd**ghij"]
    new = export.append_new(people, people.where("number > 1"), ["number"])
    assert new.count() == 1 and export.fitted(people, ["number"]).columns == ["number"]


def test_family(spark):
    people = spark.createDataFrame([(1, "João da", "José", "Maria", None), (2, "José", None, None, "Maria"), (3, "Maria", None, None, None), (4, "Mariana", "João Silva", None, None)], "id long, nome string, pai string, mae string, conjuge string")
    got = {(r["id"], r["role"], r["other"]) for r in family.relatives(people).collect()}
    assert {(1, "father", 2), (1, "mother", 3), (2, "spouse", 3), (2, "child", 1), (4, "father", 1), (1, "child", 4), (3, "child", 1)} <= got
    assert family.family_document(people).count() == 4
    silva = spark.createDataFrame([(i, "Ana Maria Silva", y) for i, y in enumerate((1860, 1862, 1865, 1880))] + [(9, "Rui Pedro Costa", 1860)], "id long, nome string, year int")
    assert {(r["surname"], r["size"]) for r in family.surname_groups(silva).collect()} >= {("Silva", 4)} and not [r for r in family.surname_groups(silva).collect() if r["surname"] == "Costa"]
    nodes, links = family.edges(people.select("id", "nome", "pai", "mae"))
    assert {r["name"]: r["stub"] for r in nodes.collect()}["João Silva"] and links.count() == 3


def test_repair(spark):
    rows = spark.createDataFrame([(1, "f", "Rita", "Alves", "", None)], "id long, file_id string, nome string, sobrenome string, pai string, texto_original string")
    page = spark.createDataFrame([("f", [("RITA  Álves", None, "Rui")])], "file_id string, baptized array<struct<name:string,nome:string,father:string>>")
    out = repair.baptism_backfill(rows, page, {"pai": ("father",)}).first()
    assert (out["pai"], out["filled"]) == ("Rui", 1)
    marr = repair.marriage_backfill(spark.createDataFrame([(1, "f", "Rui", "Ana"), (2, "f", "Rui", "Eva")], "id long, file_id string, nome string, conjuge string"), spark.createDataFrame([("f", "Rui", "ana", "x"), ("g", "Rui", "", "y")], "file_id string, name string, spouse string, v string"))
    assert [(r["id"], r["v"]) for r in marr.collect()] == [(1, "x")]
    url = repair.url_backfill(spark.createDataFrame([(1, "a", "p/a"), (2, "b", ""), (3, None, None), (4, "c", None)], "id long, file_id string, imagem_url string"), "p/")
    assert sorted(r["id"] for r in url.collect()) == [2, 4]


def test_review_and_search(spark):
    rec = spark.createDataFrame([(1, "a", False, None), (2, "b", False, 0.5)], "id long, nome string, validado boolean, qualidade double")
    log = spark.createDataFrame([(1, 1, "reject", None), (1, 2, "approve", "A")], "id long, at int, action string, nome string")
    got = {r["id"]: tuple(r) for r in review.decided(rec, log).select("id", "nome", "validado", "qualidade").collect()}
    assert got == {1: (1, "A", True, 1.0), 2: (2, "b", False, 0.5)}
    q = spark.createDataFrame([(1.0,), (0.0,), (None,)], "q double")
    assert q.where(search.public(F.col("q"))).count() == 2


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(200).select("event_id", "event_type")
    events.repartition(3).write.json(str(tmp_path / "in"))
    for run in (1, 2):
        stream.ingest(stream.page_stream(spark, str(tmp_path / "in"), "event_id long, event_type string", 1), str(tmp_path / "out"), str(tmp_path / f"c{run}"), ["event_id"]).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).select("event_id", "event_type")
    assert out.count() == 200 and out.exceptAll(events).count() == 0


def test_names_of_lines_match_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").selectExpr("doc_id as id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "Ana da Silva e João  Pinto\n\n assento 12, 3/4/1801\nnada"), (-2, None), (-3, "Rui Sá Rui Sá, Rui Sá")], "id long, text string"))
    capital = "[A-ZÀ-Ú][a-zà-ú]+"
    name = re.compile(rf"{capital}(?:\s+(?:de\s+|da\s+|do\s+)?{capital})+", re.ASCII)
    expected = {(r["id"], k, n) for r in docs.collect() for k, line in enumerate((r["text"] or "").split("\n"), 1) for n in name.findall(line) if 4 <= len(n) <= 99}
    rows = text.generic_lines(docs, "id").collect()
    assert {(r["id"], r["line_no"], r["name"]) for r in rows if r["name"]} == expected
    assert [(r["line_no"], str(r["date"]), r["number"]) for r in rows if not r["name"] and r["id"] == -1] == [(3, "1801-04-03", "12")]


def test_kinship_names(spark):
    df = spark.createDataFrame([("Ana, mulher de Rui da Silva. filho de José",), (None,)], "t string").select(text.relation_names(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [["José", "Rui da Silva"], []]


def test_hits_of_many_texts_equal_those_of_few(spark, monkeypatch):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(["small ring", "ring", "blue bolt", "xy", None, "a small xy ring"])], "k int, name string")
    texts = spark.createDataFrame([("ring",), ("xy",), ("small ring",), ("bolt",), ("none",)], "text string")
    few = {tuple(r) for r in search.hits(rows, "name", texts).select("k", "name", "text").collect()}
    monkeypatch.setattr(search, "BROADCAST_TEXTS", 1)
    assert {tuple(r) for r in search.hits(rows, "name", texts).select("k", "name", "text").collect()} == few and len(few) == 7


def test_a_batch_that_runs_again_overwrites_its_own_folder(spark, tmp_path):
    events = spark.createDataFrame([(k, "a") for k in range(50)], "event_id long, event_type string")
    events.write.json(str(tmp_path / "in"))
    for run in (1, 2, 3):
        stream.ingest(stream.page_stream(spark, str(tmp_path / "in"), "event_id long, event_type string", 1), str(tmp_path / "out"), str(tmp_path / f"c{run}"), ["event_id"], 4).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == 50


def test_searches_keep_their_order(spark):
    rows = spark.createDataFrame([(1, "Ana", "DEAT", "p", "1900-01-01"), (2, "Ana B", "DEAT", "p", None), (3, "Joana", "DEAT", "p", "1800-01-01"), (4, "Eva", "BIRT", "p", "1700-01-01"), (5, "Ana", "DEAT", "q", "1800-01-01")], "id long, nome string, tipo_registo string, freguesia string, data string")
    assert [r.id for r in search.by_date(rows, "ANA", kind="DEAT").collect()] == [2, 3, 5, 1]
    assert [r.id for r in search.of_place(rows, "p").collect()] == [2, 4, 3, 1]
    lines = spark.createDataFrame([(2, 1, 0.9), (1, 2, 0.9), (1, 1, 0.9), (3, 1, 1.0), (4, 1, 0.2)], "id long, line_no int, quality double")
    assert [(r.id, r.line_no) for r in search.best_lines(lines).collect()] == [(3, 1), (1, 1), (1, 2), (2, 1)]
