"""Backfills, older forms, small readers and refreshed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from regista.functions import dates, names, text
from regista.operators import ingest, repair
from regista.plans.jobs import _events_stream, _scratch
from regista.plans.records import no_text, page, struct_of
from regista.plans.registry import Tables, query
from regista.sources import export, pages
from regista.streaming import jobs as stream


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Rui ' || o_orderstatus ELSE 'José' END AS pai, CASE WHEN o_orderkey % 3 = 0 THEN 'Ana' END AS mae,
       (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::INTEGER AS filled FROM orders
""")
def relation_backfill(spark, sf_dir):
    """Fathers and mothers of the records that lack them, from the first death entry of their page."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("file_id"), "o_orderstatus")
    rows = o.select("id", "file_id", F.when(F.col("id") % 2 == 1, "José").alias("pai"), no_text().alias("mae"), no_text().alias("conjuge"))
    entry = struct_of(pages.DEATH, father=F.concat(F.lit("Rui "), F.col("o_orderstatus")), mae=F.when(F.col("id") % 3 == 0, "Ana"), mother=F.lit(" "))
    docs = o.select("file_id", *page(deceased=F.array(entry)))
    return repair.relation_backfill(rows, docs).select("id", "pai", "mae", "filled")


@query("SELECT o_orderkey AS id, o_orderstatus AS patched FROM orders WHERE o_orderkey % 3 <> 2")
def marriage_backfill(spark, sf_dir):
    """Marriages matched by file, name and spouse; every third patch names no spouse, every third another one."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("file_id"), "o_orderstatus")
    rows = o.select("id", "file_id", F.lit("José da Silva").alias("nome"), F.lit("Ana Sousa").alias("conjuge"))
    spouse = F.when(F.col("id") % 3 == 0, "ANA  SOUSA").when(F.col("id") % 3 == 1, "").otherwise("Rita")
    patches = o.select("file_id", F.lit("jose da silva").alias("name"), spouse.alias("spouse"), F.col("o_orderstatus").alias("patched"))
    return repair.marriage_backfill(rows, patches).select("id", "patched")


@query("SELECT o_orderkey::VARCHAR AS file_id, 'Rita' AS nome, 'Alves' AS sobrenome, 'Rui ' || o_orderstatus AS pai, o_orderdate::DATE AS data_nascimento, 'BIRT' AS tipo_registo FROM orders")
def ingest_baptisms(spark, sf_dir):
    """One baptism for each order; the day of birth before the day of baptism, where there is one."""
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    entry = struct_of(pages.BAPTISM, name=F.lit("Rita Alves"), father=F.concat(F.lit("Rui "), F.col("o_orderstatus")), birth_date=F.when(F.col("o_orderkey") % 2 == 0, day), baptism_date=F.when(F.col("o_orderkey") % 2 == 1, day).otherwise("1/1/1700"))
    docs = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").cast("string").alias("file_id"), *page(baptized=F.array(entry)))
    return ingest.persons(docs).select("file_id", "nome", "sobrenome", "pai", "data_nascimento", "tipo_registo")


@query("SELECT c_custkey AS id, o.d AS data, year(o.d)::INTEGER AS ano, CASE WHEN c_custkey % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS qualidade, 'pendente' AS status FROM customer JOIN (SELECT o_custkey, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0")
def simple_rows(spark, sf_dir):
    """Customers in the older form of records; every fifth has too short a name."""
    t = Tables(spark, sf_dir)
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_format(F.min("o_orderdate"), "dd/MM/yyyy").alias("data"))
    rows = t.customer.join(first, "c_custkey").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, " ab ").otherwise(F.col("c_name")).alias("nome"), "data", F.when(F.col("c_custkey") % 2 == 0, 0.9).alias("qualidade"))
    return ingest.simple_rows(rows).select("id", "data", "ano", "qualidade", "status")


@query("SELECT c_custkey, (0.4 + CASE WHEN len(string_split(c_mktsegment || ' ' || c_name, ' ')) >= 2 THEN 0.1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 0.1 ELSE 0 END)::DOUBLE AS quality FROM customer")
def record_quality_scores(spark, sf_dir):
    """Points of made records: two tokens always, a common surname, a date in range and a number for some."""
    name = F.concat_ws(" ", "c_mktsegment", "c_name", F.when(F.col("c_custkey") % 2 == 0, "Silva"))
    date = F.when(F.col("c_custkey") % 3 == 0, F.lit("1850-01-01").cast("date"))
    return Tables(spark, sf_dir).customer.select("c_custkey", text.record_quality(name, date, F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string"))).alias("quality"))


@query("SELECT s_suppkey, unnest(range(s_nationkey, s_nationkey + 3) || [s_suppkey + 100]) AS page FROM supplier")
def page_number_lists(spark, sf_dir):
    """Lists such as '4-6, 117,x' as page numbers."""
    low = F.col("s_nationkey")
    listed = F.concat(low.cast("string"), F.lit("-"), (low + 2).cast("string"), F.lit(", "), (F.col("s_suppkey") + 100).cast("string"), F.lit(",x"))
    return Tables(spark, sf_dir).supplier.select("s_suppkey", F.explode(dates.page_numbers(listed)).alias("page")).withColumn("page", F.col("page").cast("long"))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year_from, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::INTEGER + 5 END AS year_to FROM orders")
def period_years(spark, sf_dir):
    y = F.year("o_orderdate")
    written = F.when(F.col("o_orderkey") % 4 == 0, F.concat(y.cast("string"), F.lit("/"), (y + 5).cast("string"))).when(F.col("o_orderkey") % 2 == 0, F.concat(y.cast("string"), F.lit(" - "), (y + 5).cast("string"))).otherwise(F.concat(F.lit("c. "), y.cast("string")))
    return Tables(spark, sf_dir).orders.select("o_orderkey", dates.period(written).alias("p")).select("o_orderkey", "p.year_from", "p.year_to")


#: Phrases with words of kinship, of which one stands before each document's text.
KINSHIP = ("Ana, mulher de Rui da Silva. ", "filho de José e neta  de Rosa Maria do Carmo Sá Pinto, ", "viúva de Luis de Sá, viuva de Luis de Sá, marido da Eva, ", "neto de ninguem. ")


@query(f"""
WITH t AS (SELECT doc_id, [{", ".join(f"'{k}'" for k in KINSHIP)}][doc_id % {len(KINSHIP)} + 1] || coalesce(text, '') AS t FROM documents)
SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '(?:filho|filha|mulher|marido|viuva|viúva|neto|neta)\\s+de\\s+([A-ZÀ-Ú][a-zà-ú]+(?:\\s+(?:de\\s+|da\\s+|do\\s+)?[A-ZÀ-Ú][a-zà-ú]+){{0,3}})', 1)) AS name FROM t
""")
def kinship_names(spark, sf_dir):
    """Names after words of kinship in all documents, before whose texts phrases of kinship stand."""
    phrase = F.get(F.array(*[F.lit(k) for k in KINSHIP]), (F.col("doc_id") % len(KINSHIP)).cast("int"))
    rows = Tables(spark, sf_dir).documents.select("doc_id", F.concat(phrase, F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select("doc_id", F.explode(text.relation_names(F.col("text"))).alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'd' || page_id END AS document FROM pages")
def document_ids(spark, sf_dir):
    key = F.concat(F.lit("d"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://x.example/documentDetails/"), key, F.lit("?p=1"))).when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://x.example/fileViewer/"), key, F.lit("/2"))).otherwise(F.col("url"))
    return Tables(spark, sf_dir).pages.select("page_id", pages.document_id(url).alias("document"))


@query("SELECT p_partkey, lower(strip_accents(p_name)) || ' avila' AS \"key\" FROM part")
def match_keys(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", names.match_key(F.concat(F.lit("  "), F.upper("p_name"), F.lit("   Ávila "))).alias("key"))


@query("SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_regionkey > 1")
def retry_list(spark, sf_dir):
    """Ids of the lines of a table in Markdown that name a record type."""
    kind = F.when(F.col("n_regionkey") > 1, "BIRT").otherwise("DEAT")
    return pages.retry_ids(Tables(spark, sf_dir).nation.select(F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), kind, F.lit(" |")).alias("value")))


@query("SELECT c_custkey AS number, unnest(['0 @I' || c_custkey || '@ INDI', '1 NAME Ana /Silva/', '1 SEX F', '1 BIRT' || chr(10) || '2 DATE 5 MAR 1801']) AS line FROM customer WHERE c_custkey = 17")
def person_gedcom_block(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("number"), F.lit("Ana Silva").alias("name"), F.lit("bride").alias("role"), F.lit("1801-03-05").cast("date").alias("baptism"), F.lit("1801-03-01").cast("date").alias("birth"), F.lit(None).cast("date").alias("death"), no_text().alias("place"), no_text().alias("source"), no_text().alias("page"), no_text().alias("book"))
    return export.person_gedcom(rows, 17).select("number", "line")


def _latest_batches(spark, rows, keys, name):
    """Runs a stream in update mode; of each key the row of the last batch that told of it."""
    target = _scratch(spark, name)
    rows.writeStream.outputMode("update").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{target}/rows/batch={k}")).start().awaitTermination()
    found = spark.read.parquet(f"{target}/rows")
    values = [c for c in rows.columns if c not in keys]
    return found.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_refreshed_counts(spark, sf_dir):
    """Counts in update mode: each batch tells of the types that it changes."""
    return _latest_batches(spark, stream.counts(_events_stream(spark, sf_dir), "event_type"), ["event_type"], "refreshed")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def stream_progress(spark, sf_dir):
    """The latest state of each job, in update mode."""
    return _latest_batches(spark, stream.progress(_events_stream(spark, sf_dir), "user_id", "ts", "event_type"), ["user_id"], "progress")
