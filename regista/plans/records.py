"""Ingest, linkage and repair queries on records made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from regista.functions import text
from regista.operators import family, ingest, repair, search, statistics
from regista.plans.registry import Tables, query
from regista.sources import export, pages


def no_text():
    return F.lit(None).cast("string")


def struct_of(schema: str, **values):
    """A struct of the schema's string fields with some of them set."""
    kinds = dict(f.strip().split(" ", 1) for f in schema.removeprefix("struct<").removesuffix(">").split(","))
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def page(**arrays):
    """Columns of a page document with the given entries."""
    cols = {"record_type": no_text(), "raw_text": no_text(), "transcription": no_text(), "parsed_ok": F.lit(True)}
    for name, schema in (("deceased", pages.DEATH), ("baptized", pages.BAPTISM), ("persons", pages.MARRIAGE)):
        cols[name] = F.lit(None).cast(f"array<{schema}>")
    return [c.alias(k) for k, c in (cols | arrays).items()]


@query("""
WITH o AS (SELECT o_orderkey::VARCHAR AS file_id, o_orderdate::DATE AS d, 'Sousa' || o_orderstatus AS s, right(o_orderpriority, 3) AS p FROM orders)
SELECT file_id, 'Ana' AS nome, s AS sobrenome, 'Rui ' || p AS conjuge, d AS data_casamento, 'bride' AS papel FROM o
UNION ALL SELECT file_id, 'Rui', p, 'Ana ' || s, d, 'groom' FROM o
""")
def ingest_marriages(spark, sf_dir):
    """One marriage for each order: two persons, each the other's spouse."""
    entry = struct_of(
        pages.MARRIAGE, name=F.concat(F.lit("Sr. Rui "), F.right("o_orderpriority", F.lit(3))), spouse=F.concat(F.lit("Ana Sousa"), F.col("o_orderstatus")), marriage_date=F.date_format("o_orderdate", "dd/MM/yyyy")
    )
    docs = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").cast("string").alias("file_id"), *page(persons=F.array(entry)))
    rows = ingest.persons(docs).select("file_id", "nome", "sobrenome", "conjuge", "data_casamento", "papel")
    return rows.withColumn("conjuge", F.regexp_replace("conjuge", r"^Sr\. ", ""))


@query("""
SELECT o_orderkey::VARCHAR AS file_id, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS at, 'Ana da' AS nome, 'Silva' AS sobrenome,
       CASE WHEN o_orderkey % 2 = 0 THEN l_shipdate::DATE END AS data_obito, l_quantity::INTEGER AS idade, 'Rui' AS pai
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def ingest_deaths(spark, sf_dir):
    """One page for each order, one death entry for each line; keys in Portuguese on odd orders, impossible dates there."""
    t = Tables(spark, sf_dir)
    odd = F.col("o_orderkey") % 2 == 1
    entry = struct_of(
        pages.DEATH, name=F.when(~odd, "Dona Ana da Silva"), nome=F.when(odd, "Ana da Silva"), death_date=F.when(odd, "31/02/1890").otherwise(F.date_format("l_shipdate", "yyyy-M-d")),
        age=F.col("l_quantity").cast("int").cast("string"), pai=F.lit("Rui"), father=F.lit(" "),
    )
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("k"), entry.alias("e"))
    docs = lines.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]).alias("deceased"))
    docs = docs.select(F.col("o_orderkey").cast("string").alias("file_id"), *page(deceased=F.col("deceased")))
    return ingest.persons(docs).select("file_id", "at", "nome", "sobrenome", "data_obito", "idade", "pai")


@query("""
WITH p AS (SELECT p_partkey AS id, p_name AS nome, string_split(p_name, ' ')[-1] AS w FROM part)
SELECT a.id, min(b.id) AS other FROM p a JOIN p b ON contains(b.nome, a.w) AND a.id <> b.id WHERE length(a.w) >= 3 GROUP BY a.id
""")
def parent_links(spark, sf_dir):
    """The lowest id whose given name contains the first name of the father."""
    people = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("nome"), F.concat(F.element_at(F.split("p_name", " "), -1), F.lit(" Velho")).alias("pai"), no_text().alias("mae"))
    return family.relatives(people).where("role = 'father'").select("id", "other")


@query("""
WITH y AS (SELECT c_mktsegment AS surname, min(year(o_orderdate)) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment),
c AS (SELECT surname, y, CASE WHEN y - lag(y) OVER w > 1 THEN 1 ELSE 0 END AS cut FROM y WINDOW w AS (PARTITION BY surname ORDER BY y)),
r AS (SELECT surname, y, sum(cut) OVER (PARTITION BY surname ORDER BY y) AS run FROM c)
SELECT surname, CAST(run AS BIGINT) AS run, count(*) AS size, min(y)::INTEGER AS "first", max(y)::INTEGER AS "last" FROM r GROUP BY surname, run HAVING count(*) >= 2
""")
def surname_family_groups(spark, sf_dir):
    t = Tables(spark, sf_dir)
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate")).alias("year"))
    people = t.customer.join(first, "c_custkey").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Ana "), F.col("c_mktsegment")).alias("nome"), "year")
    return family.surname_groups(people, gap=1)


@query("""
SELECT coalesce(n_name, 'region ' || r_name) AS place, count(s_suppkey) AS n, n_nationkey IS NOT NULL AS mapped
FROM (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n FULL OUTER JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN (SELECT n_nationkey AS k, r_name FROM nation JOIN region ON r_regionkey = n_regionkey) r ON r.k = s_nationkey
GROUP BY 1, 3
""")
def counts_with_coordinates(spark, sf_dir):
    """Counts of places with and without coordinates, both kept."""
    t = Tables(spark, sf_dir)
    known = t.nation.where("n_nationkey % 3 <> 0").select("n_nationkey", "n_name")
    regions = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    rows = known.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("n_nationkey") == F.col("s_nationkey"), "full_outer").join(regions, "s_nationkey", "left")
    place = F.coalesce("n_name", F.concat(F.lit("region "), F.col("r_name")))
    return rows.groupBy(place.alias("place"), F.col("n_nationkey").isNotNull().alias("mapped")).agg(F.count("s_suppkey").alias("n"))


@query("""
SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE (contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7')) AND contains(lower(n_name), 'nation_1') AND c_mktsegment = 'MACHINERY' ORDER BY c_custkey DESC LIMIT 100
""")
def baptism_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).where(search.contains_any(["c_name", "c_mktsegment"], "7") & search.contains_any(["n_name"], "NATION_1") & (F.col("c_mktsegment") == "MACHINERY"))
    return search.page(rows, F.col("c_custkey").desc(), limit=100).select("c_custkey", "c_name", "n_name")


@query("""
SELECT n_name, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 GROUP BY 1 HAVING count(*) FILTER (o_orderstatus IN ('F', 'O')) > 0 ORDER BY p DESC, n_name
""")
def coverage_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = rows.groupBy("n_name").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    wide = wide.select("n_name", *[F.coalesce(k, F.lit(0)).alias(k.lower()) for k in "FOP"])
    return wide.where("f > 0 or o > 0").orderBy(F.col("p").desc(), "n_name")


@query("SELECT page_id AS id, 'https://x.example/' || page_id AS link FROM pages WHERE page_id % 4 <> 1")
def url_backfill(spark, sf_dir):
    """Links to set where the stored one is missing, empty or another; every fourth page has the right one."""
    right = F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string"))
    stored = F.when(F.col("page_id") % 4 == 1, right).when(F.col("page_id") % 4 == 2, "").when(F.col("page_id") % 4 == 3, F.col("url"))
    return repair.url_backfill(Tables(spark, sf_dir).pages.select(F.col("page_id").alias("id"), F.col("page_id").cast("string").alias("file_id"), stored.alias("imagem_url")), "https://x.example/")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE END AS found, CASE o_orderkey % 3 WHEN 0 THEN 'no_file' WHEN 1 THEN 'updated' ELSE 'no_date' END AS status FROM orders WHERE o_orderkey % 2 = 0
""")
def date_backfill(spark, sf_dir):
    """Dates read from the pages of the records that lack one."""
    orders = Tables(spark, sf_dir).orders
    key = F.col("o_orderkey").cast("string").alias("file_id")
    date = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" de "), F.element_at(F.array(*[F.lit(m) for m in ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")]), F.month("o_orderdate")), F.lit(" de "), F.year("o_orderdate").cast("string"))
    body = F.concat(F.lit("Registo de obito desta freguesia, faleceu Manuel de Sousa e foi sepultado "), F.when(F.col("o_orderkey") % 3 == 1, date).otherwise("sem data"))
    docs = orders.where("o_orderkey % 3 <> 0").select(key, body.alias("text"))
    rows = orders.select(F.col("o_orderkey").alias("id"), key, F.when(F.col("o_orderkey") % 2 == 1, F.to_date("o_orderdate")).alias("data"))
    return repair.date_backfill(rows, docs).select("id", "found", "status")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Manuel ' || 'Sousa' ELSE 'Desconhecido' END AS nome, CASE WHEN c_custkey % 2 = 0 THEN 'updated' ELSE 'no_name' END AS status FROM customer WHERE c_custkey % 3 = 0")
def unknown_name_repair(spark, sf_dir):
    """Placeholder names replaced by the name that the page's text tells."""
    customers = Tables(spark, sf_dir).customer
    key = F.col("c_custkey").cast("string").alias("file_id")
    body = F.when(F.col("c_custkey") % 2 == 0, "nesta casa e logar foi visto o corpo de D. Manuel Sousa desta terra").otherwise("nesta casa e logar nada foi visto nem achado por quem escreve")
    rows = customers.select(F.col("c_custkey").alias("id"), key, F.when(F.col("c_custkey") % 3 == 0, "Desconhecido").otherwise("Ana").alias("nome"))
    p = text.person_in_text(F.col("text"))
    return repair.unknown_names(rows, customers.select(key, body.alias("text")), F.when(p.isNotNull(), F.concat_ws(" ", p["nome"], p["sobrenome"])))


@query("SELECT doc_id::VARCHAR AS doc_id, source AS file_id FROM documents UNION ALL SELECT doc_id::VARCHAR, lang FROM documents WHERE doc_id % 2 = 0")
def listing_explode(spark, sf_dir):
    """Listings, a JSON map from document to files; a value that is no list and an empty id are skipped."""
    files = F.concat(F.lit('[{"id": "'), F.col("source"), F.lit('"}, {"id": "'), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.lit('"}]'))
    listing = F.concat(F.lit('{"'), F.col("doc_id").cast("string"), F.lit('": '), files, F.lit(', "x": "no list"}'))
    return pages.listing_rows(Tables(spark, sf_dir).documents.select(listing.alias("listing")))


@query("SELECT 'f' || (doc_id % 50) AS file_id, CAST(max(doc_id) AS VARCHAR) AS doc_id FROM documents GROUP BY 1")
def file_references(spark, sf_dir):
    """Which document a file belongs to; the last one counts."""
    image = F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string"))
    books = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("at"), F.array(F.struct(F.col("doc_id").cast("string").alias("id"), F.array(image).alias("imagens"))).alias("documentos"))
    return pages.image_references(books)


@query("SELECT event_id::VARCHAR AS id, event_type AS name, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR END AS birth FROM events")
def external_people(spark, sf_dir):
    """Search results flattened; empty values are null and empty entries left out."""
    one = F.concat(F.lit('{"entries": [{"id": "'), F.col("event_id").cast("string"), F.lit('", "content": {"name": "'), F.col("event_type"), F.lit('", "birth": "'), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(" "), F.lit('"}}, {"id": "0", "content": {}}]}'))
    return pages.external_people(Tables(spark, sf_dir).events.select(one.alias("json"))).select("id", "name", "birth")


@query("""
SELECT 'union' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL
SELECT 'difference', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL
SELECT 'intersection', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL
SELECT 'new', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def id_sets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    sets = {"union": a.union(b).distinct(), "difference": a.subtract(b), "intersection": a.intersect(b), "new": export.append_new(a, b, ["doc_id"])}
    out = None
    for kind, rows in sets.items():
        n = rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.union(n)
    return out


@query("""
WITH c AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) SELECT k, n, round(n::DOUBLE / (SELECT max(n) FROM c), 6) AS share FROM c
""")
def share_of_maximum(spark, sf_dir):
    counts = Tables(spark, sf_dir).orders.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return statistics.scaled(counts, "n").select("k", "n", F.round("share", 6).alias("share"))
