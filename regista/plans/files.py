"""Queries that write files of the given tables and read them back, and that read lists line by line."""

from __future__ import annotations

from pyspark.sql import functions as F

from regista.functions import text
from regista.operators import ingest, review, similarity
from regista.plans.jobs import _scratch
from regista.plans.reading import _chosen, _sql
from regista.plans.registry import Tables, query
from regista.sources import export, pages
from regista.streaming import jobs as stream

#: Lines of lists and what is to be read of each: number, name, date, father, mother; nothing of the last.
BAPTISMS = (
    ("{k}. Ana da Silva, 3/4/1801, filha de José da Silva e de Maria Sousa", "{k}", "Ana da Silva", "1801-04-03", "José da Silva", "Maria Sousa"),
    ("{k}) Rui Pinto, 12 de maio de 1790", "{k}", "Rui Pinto", "1790-05-12", None, None),
    ("Eva Vaz nasceu a 1/2/1700, filha de Luis do Carmo Vaz", None, "Eva Vaz", "1700-02-01", "Luis do Carmo Vaz", None),
    ("João do Carmo - 1790", None, "João do Carmo", "1790-01-01", None, None),
    ("nada que se leia", None, None, None, None, None),
)
#: Number, name and date of a death, of lines with letters in the place of digits.
DEATHS = (
    ("{k}. Ana da Silva faleceu a 3/4/18O1", "{k}", "Ana da Silva", "1801-04-03"),
    ("{k}) morreu Rui Pinto em 1l de maio de 179O2", None, None, None),
    ("Eva Vaz, 1/2/1700", None, "Eva Vaz", "1700-02-01"),
    ("- Luis Sá aos dez de maio de mil setecentos e trinta", None, "Luis Sá", "1730-05-10"),
    ("sem nome, 1/2/1700", None, None, None),
)
NOISE = ("freguesia", "lugar")
#: Beginnings of pages without entries and the person of each; the words of NOISE are no names.
PERSONS = (
    ("Registo de obito desta terra. Faleceu o que se diz D. Ana Freguesia Vaz, e foi enterrada em Vila de Lemos.", "Ana", "Vaz"),
    ("Registo de obito desta terra. D. Lugar Freguesia e o Padre Rui Pires, que morreu em Vila de Lemos.", "Rui", "Pires"),
    ("Registo de obito desta terra. Faleceu Manuel de Sousa em sua casa e foi sepultado.", "Manuel", "Sousa"),
    ("Registo de compra desta terra, em que nada se diz de quem viveu ou partiu.", None, None),
)


@query("""
SELECT CASE WHEN doc_id % 7 = 3 THEN NULL ELSE 'f' || doc_id END AS file_id, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE length(text) END AS n, count(*) AS pages FROM documents WHERE text IS NOT NULL GROUP BY ALL
""")
def damaged_pages(spark, sf_dir):
    """Page documents written as lines, of which every seventh is cut off, and read back: the whole ones, and how many are put aside."""
    path, docs = _scratch(spark, "pages"), Tables(spark, sf_dir).documents.where("text is not null")
    line = F.to_json(F.struct(F.concat(F.lit("f"), "doc_id").alias("file_id"), F.col("text").alias("raw_text")))
    docs.select(F.when(F.col("doc_id") % 7 == 3, F.left(line, F.length(line) - 1)).otherwise(line).alias("value")).write.text(path)
    good = pages.read_pages(spark, path, multi_line=False).select("file_id", F.length("raw_text").alias("n"))
    bad = pages.damaged_pages(spark, path, multi_line=False).select(F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("int").alias("n"))
    return good.union(bad).groupBy("file_id", "n").agg(F.count(F.lit(1)).alias("pages"))


@query("""
SELECT p_name AS titulo, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey::VARCHAR END AS doc_id, 1600 + p_size::INTEGER AS year_from, CASE WHEN p_partkey % 2 = 0 THEN 1700 + p_size::INTEGER END AS year_to FROM part
""")
def inventory_books(spark, sf_dir):
    """Parts written as the books of an inventory and read back with document id and period."""
    path, size = _scratch(spark, "inventory"), F.col("p_size").cast("int")
    url = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://x.org/viewer?/documentDetails/"), "p_partkey", F.lit("?p=1")))
    info = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("https://x.org/fileViewer/"), "p_partkey"))
    years = F.concat((size + 1600).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" / "), (size + 1700).cast("string"))).otherwise(""))
    Tables(spark, sf_dir).part.select(F.col("p_name").alias("titulo"), years.alias("datas"), url.alias("url_viewer"), info.alias("url_info")).write.json(path)
    return pages.read_inventory(spark, path, multi_line=False).select("titulo", "doc_id", "year_from", "year_to")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' \"x\", y' AS name, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    """Customers, with quotes and commas in their names, written as CSV in order and read back."""
    path = _scratch(spark, "csv")
    rows = Tables(spark, sf_dir).customer.select("c_custkey", F.concat("c_name", F.lit(' "x", y')).alias("name"), "c_mktsegment")
    export.write_csv(rows, path, ["c_custkey"])
    return spark.read.csv(path, header=True, escape='"')


@query("SELECT p_partkey, p_name FROM part")
def schema_fitted(spark, sf_dir):
    """Columns that the target lacks are left out."""
    return export.fitted(Tables(spark, sf_dir).part.withColumn("unknown", F.lit(1)), ["p_partkey", "p_name", "never"])


@query(f"""
SELECT doc_id, {_sql(BAPTISMS, 1)} AS number, {_sql(BAPTISMS, 2)} AS name, CAST({_sql(BAPTISMS, 3)} AS DATE) AS date, {_sql(BAPTISMS, 4)} AS father, {_sql(BAPTISMS, 5)} AS mother FROM documents WHERE {_sql(BAPTISMS, 2)} IS NOT NULL
""")
def baptism_lines(spark, sf_dir):
    """The first line of each document is one of a list of baptisms; its whole text follows in small letters."""
    rows = Tables(spark, sf_dir).documents.select("doc_id", F.concat_ws("\n", _chosen(BAPTISMS, 0, F.col("doc_id")), F.lower("text")).alias("text"))
    return text.baptism_lines(rows, "doc_id").select("doc_id", "number", "name", "date", "father", "mother")


@query(f"SELECT doc_id, {_sql(DEATHS, 1)} AS number, {_sql(DEATHS, 2)} AS name, CAST({_sql(DEATHS, 3)} AS DATE) AS date FROM documents WHERE {_sql(DEATHS, 2)} IS NOT NULL")
def death_lines(spark, sf_dir):
    """The same of a list of deaths, in which letters stand for digits."""
    rows = Tables(spark, sf_dir).documents.select("doc_id", F.concat_ws("\n", _chosen(DEATHS, 0, F.col("doc_id")), F.lower("text")).alias("text"))
    return text.death_lines(rows, "doc_id").select("doc_id", "number", "name", "date")


@query("SELECT o_orderkey, '9' || o_orderkey % 10 || '9 \"lO\" - ' || o_orderpriority AS line FROM orders")
def unmistaken_lines(spark, sf_dir):
    """Letters in numbers are read as digits again, and letters elsewhere stay."""
    wrong = F.translate((F.col("o_orderkey") % 10).cast("string"), "01", "Ol")
    line = F.concat(F.lit("9"), wrong, F.lit("9 “lO” – "), "o_orderpriority")
    return Tables(spark, sf_dir).orders.select("o_orderkey", text.unmistaken(line).alias("line"))


@query("SELECT event_id, CASE WHEN regexp_full_match(trim(t), '-?[0-9]{1,9}') THEN CAST(trim(t) AS INTEGER) END AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN '-' || user_id WHEN 2 THEN value::VARCHAR ELSE event_type END AS t FROM events)")
def whole_numbers(spark, sf_dir):
    k = F.col("event_id") % 4
    told = F.when(k == 0, F.concat(F.lit(" "), "event_id", F.lit(" "))).when(k == 1, F.concat(F.lit("-"), "user_id")).when(k == 2, F.col("value").cast("string")).otherwise(F.col("event_type"))
    return Tables(spark, sf_dir).events.select("event_id", ingest.whole_number(told).alias("n"))


@query(f"SELECT doc_id::VARCHAR AS file_id, {_sql(PERSONS, 1)} AS nome, {_sql(PERSONS, 2)} AS sobrenome FROM documents WHERE {_sql(PERSONS, 1)} IS NOT NULL")
def persons_of_texts(spark, sf_dir):
    """The persons of pages without entries; every text is followed by that of a document as far as it is plain."""
    none = F.array().cast("array<struct<name:string>>")
    plain = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\s]", ""))
    raw = F.concat_ws(" ", _chosen(PERSONS, 0, F.col("doc_id")), F.regexp_replace(plain, "[^a-zà-ú ]", " "))
    rows = Tables(spark, sf_dir).documents.select(F.col("doc_id").cast("string").alias("file_id"), raw.alias("raw_text"), F.lit(None).cast("string").alias("record_type"), *[none.alias(c) for c in ("deceased", "baptized", "persons")])
    return ingest.text_persons(rows, NOISE).select("file_id", "nome", "sobrenome")


@query("""
WITH l AS (SELECT o_custkey AS id, o_orderkey AS place, CASE o_orderkey % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'approve' WHEN 2 THEN 'edit' ELSE 'skip' END AS action, CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_orderpriority END AS nome FROM orders),
d AS (SELECT id, arg_max(struct_pack(action := action, nome := nome), place) AS d FROM l GROUP BY id)
SELECT c_custkey AS id, CASE WHEN d.action IN ('approve', 'edit') THEN coalesce(d.nome, c_name) ELSE c_name END AS nome, d IS NOT NULL AS validado, CASE WHEN d.action IN ('approve', 'edit') THEN 1.0 WHEN d IS NOT NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS qualidade
FROM customer LEFT JOIN d ON id = c_custkey
""")
def decisions_with_edits(spark, sf_dir):
    """The latest decision on each customer, with corrected names where it has one."""
    t, k = Tables(spark, sf_dir), F.col("o_orderkey") % 4
    log = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.when(k == 0, "reject").when(k == 1, "approve").when(k == 2, "edit").otherwise("skip").alias("action"), F.when(k.isin(0, 2), F.col("o_orderpriority")).alias("nome"))
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"), F.lit(False).alias("validado"), F.lit(0.5).alias("qualidade"))
    return review.decided(rows, log)


@query()
def similar_by_index(spark, sf_dir):
    """The five most similar of all labels for every vector whose id is divisible by 20, by an index of all vectors; the tests hold its recall against all pairs. The table's vectors have no clusters, so more than half of the lists are read."""
    rows = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return similarity.similar(rows.where("id % 20 = 0"), rows, 5, lists=64, probes=40).withColumn("similarity", F.round("similarity", 4))


@query(f"""
WITH p AS (SELECT 'f' || doc_id AS file_id, doc_id % 3 AS k, {_sql(PERSONS, 1)} AS nome, {_sql(PERSONS, 2)} AS sobrenome FROM documents)
SELECT file_id, CASE k WHEN 0 THEN 'BIRT' ELSE 'DEAT' END AS tipo_registo, CASE k WHEN 0 THEN 'Ana de' ELSE nome END AS nome, CASE k WHEN 0 THEN 'Lemos' ELSE sobrenome END AS sobrenome FROM p WHERE k = 0 OR nome IS NOT NULL
""")
def stream_pages_to_persons(spark, sf_dir):
    """Page documents of two deliveries, which share half of their pages, as a stream: every third page has an entry, the others a text."""
    base, k = _scratch(spark, "ingest-pages"), F.col("doc_id")
    entry = F.array(F.struct(F.lit("Ana de Lemos").alias("name"), F.lit("1/2/1800").alias("birth_date")))
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-zà-ú ]", " ")
    page = F.to_json(F.struct(F.concat(F.lit("f"), "doc_id").alias("file_id"), F.when(k % 3 > 0, F.concat_ws(" ", _chosen(PERSONS, 0, k), plain)).alias("raw_text"), F.when(k % 3 == 0, entry).alias("baptized")))
    docs = Tables(spark, sf_dir).documents
    for n, some in enumerate((docs.where("doc_id % 4 < 3"), docs.where("doc_id % 4 > 0"))):
        some.select(page.alias("value")).write.text(f"{base}/in/{n}")
        rows = spark.readStream.schema(pages.PAGE).json(f"{base}/in/*")
        stream.ingest_pages(rows, f"{base}/out", f"{base}/checkpoint", NOISE).awaitTermination()
    return spark.read.parquet(f"{base}/out/persons").select("file_id", "tipo_registo", "nome", "sobrenome")
