"""Readers of page documents, inventories, listings, raw HTML and text lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regista.functions.dates import period

#: Entries of a page, every scalar as text, keys in English or Portuguese.
DEATH = "struct<name string, nome string, death_date string, age string, father string, pai string, mother string, mae string, spouse string, conjuge string, testamento string, legados array<string>>"
BAPTISM = "struct<name string, nome string, birth_date string, baptism_date string, father string, pai string, mother string, mae string, father_naturalidade string, mother_naturalidade string, legitimidade string, avo_paterno string, avo_paterna string, avo_materno string, avo_materna string, godfather string, godmother string, place string, assinatura string>"
MARRIAGE = "struct<name string, spouse string, marriage_date string, father string, mother string, spouse_father string, spouse_mother string, naturalidade string, spouse_naturalidade string, estado_civil string, spouse_estado_civil string, idade string, spouse_idade string, ocupacao string, spouse_ocupacao string, numero_assento string, dispensa string, assinatura string, testemunhas array<string>, legitimacao array<string>>"
PAGE = f"file_id string, record_type string, raw_text string, transcription string, parsed_ok boolean, deceased array<{DEATH}>, baptized array<{BAPTISM}>, persons array<{MARRIAGE}>"
BOOK = "freguesia string, freguesia_codigo string, tipo string, tipo_cod string, titulo string, datas string, url_viewer string, url_info string, concelho_codigo string"


def read_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Page documents of a directory, one JSON object to a file (or to a line); what is no object, or tells nothing, is left out, see damaged_pages(). file_id is the file's stem where the page names none."""
    pages = spark.read.schema(PAGE).option("multiLine", multi_line).json(path)
    told = "file_id is not null or record_type is not null or raw_text is not null or transcription is not null or parsed_ok is not null or deceased is not null or baptized is not null or persons is not null"
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.json)?$", 1)
    return pages.where(told).withColumn("file_id", F.coalesce("file_id", stem))


def damaged_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(file, text) of the page documents of a directory that are no JSON object, so that they can be put aside and mended."""
    rows = spark.read.text(path, wholetext=multi_line).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    parsed = F.from_json("text", f"{PAGE}, _damaged string", {"columnNameOfCorruptRecord": "_damaged"})
    return rows.where((F.trim("text") == "") | parsed["_damaged"].isNotNull())


def recovered_json(text: Column) -> Column:
    """The object in chatty text: from the first brace to the last; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def reparsed(pages: DataFrame, schema: str) -> DataFrame:
    """Adds parsed and status (already_ok, reparsed, unparseable) to pages (raw_text, parsed_ok): only pages not parsed before, with text, are tried."""
    tried = ~F.coalesce("parsed_ok", F.lit(False)) & (F.length(F.trim(F.coalesce("raw_text", F.lit("")))) > 0)
    parsed = F.when(tried, F.from_json(recovered_json(F.col("raw_text")), schema))
    pages = pages.withColumn("parsed", parsed)
    return pages.withColumn("status", F.when(F.coalesce("parsed_ok", F.lit(False)), "already_ok").when(F.col("parsed").isNotNull(), "reparsed").otherwise("unparseable"))


def document_id(url: Column) -> Column:
    """What follows documentDetails/ or fileViewer/ in an address, up to its query."""
    return F.nullif(F.regexp_extract(url, r"(?:documentDetails|fileViewer)/([^?/]+)", 1), F.lit(""))


def read_inventory(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Books of an inventory, lists in files (or an object to a line), with document id and period."""
    books = spark.read.schema(BOOK).option("multiLine", multi_line).json(path)
    return books.withColumn("doc_id", document_id(F.coalesce("url_viewer", "url_info"))).withColumn("_p", period(F.col("datas"))).select("*", "_p.*").drop("_p")


def listing_rows(listings: DataFrame, column: str = "listing") -> DataFrame:
    """(doc_id, file_id) of listings, a JSON map from document to a list of {id, name}; other values and empty ids are skipped."""
    each = listings.select(F.explode(F.from_json(column, "map<string,string>")).alias("doc_id", "files"))
    rows = each.select("doc_id", F.explode(F.from_json("files", "array<struct<id:string,name:string>>")).alias("f"))
    return rows.select("doc_id", F.col("f.id").alias("file_id")).where("file_id is not null and file_id <> ''")


def image_references(books: DataFrame) -> DataFrame:
    """(file_id, doc_id) of books (at, documentos[].imagens[]); of a repeated file the later book counts."""
    rows = books.select("at", F.posexplode("documentos").alias("d_at", "d")).select("at", "d_at", F.col("d.id").alias("doc_id"), F.posexplode("d.imagens").alias("i_at", "file_id"))
    last = Window.partitionBy("file_id").orderBy(F.col("at").desc(), F.col("d_at").desc(), F.col("i_at").desc())
    return rows.where("file_id is not null").withColumn("n", F.row_number().over(last)).where("n = 1").select("file_id", "doc_id")


def _tagless(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, title, at, href) for every link of raw pages (page_id, html)."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    links = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href="([^"]*)\""""), F.lit(1))
    return pages.select("page_id", title.alias("title"), F.posexplode(links).alias("at", "href"))


#: Characters of raw pages that one task works on.
TASK_CHARS = 8 << 20


def _dealt(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) by page in as many partitions as their size asks for, so that a task's share stays the same however many pages there are."""
    chars = pages.agg(F.sum(F.length("html").cast("long"))).first()[0] or 0
    return pages.select("page_id", "html").repartition(1 + chars // TASK_CHARS, "page_id")


def html_parts(pages: DataFrame) -> DataFrame:
    """Tags and texts of raw pages (page_id, html) in order: page_id, at, part, tag (its name in lower case, with / if it ends; ! for a declaration, '' for a text), depth (tables open there), table_no (which of that depth, from 1), row_no and cell_no (from 1 in the table and row; 0 before the first).

    Pages are dealt out by their size before they are cut, so a task sorts the
    parts of about TASK_CHARS characters, and the counts need no further
    shuffle. Depth is a running sum of tags that open and close tables. What follows an
    inner table belongs to the outer one again, as counts run in each depth by
    themselves. Comments are no parts.
    """
    parts = _dealt(pages).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<!--.*?-->|<[a-zA-Z/!?][^>]*>|[^<]+|<"), F.lit(0))).alias("at", "part")).where("not startswith(part, '<!--')")
    name = F.lower(F.regexp_extract("part", r"^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1))
    told = parts.withColumn("tag", F.when((name == "") & F.col("part").rlike("^<[a-zA-Z/!?]"), "!").otherwise(name))
    opened = lambda *names: F.col("tag").isin(*names).cast("int")

    def running(*by: str) -> Window:
        return Window.partitionBy("page_id", *by).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    told = told.withColumn("depth", F.sum(opened("table") - opened("/table")).over(running()))
    told = told.withColumn("table_no", F.sum(opened("table")).over(running("depth")))
    told = told.withColumn("row_no", F.sum(opened("tr")).over(running("depth", "table_no")))
    return told.withColumn("cell_no", F.sum(opened("td", "th")).over(running("depth", "table_no", "row_no")))


def _joined_parts(of: Column) -> Column:
    """The texts of a group in order, with single blanks."""
    return F.trim(F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(of, F.struct("at", "part")))), lambda x: x["part"]), " "), r"\s+", " "))


def html_cells(pages: DataFrame) -> DataFrame:
    """Cells of the tables of raw pages (page_id, html): page_id, depth, table_no, row_no, cell_no, text, hrefs (all links of the cell, in order). Tables inside a cell have their own cells, and none of their text is in the outer one."""
    inside = html_parts(pages).where("depth > 0 and row_no > 0 and cell_no > 0")
    href = F.nullif(F.regexp_extract("part", r"""(?is)\shref=["']([^"']*)["']""", 1), F.lit(""))
    links = F.transform(F.sort_array(F.collect_list(F.when((F.col("tag") == "a") & href.isNotNull(), F.struct("at", href.alias("href"))))), lambda x: x["href"])
    return inside.groupBy("page_id", "depth", "table_no", "row_no", "cell_no").agg(_joined_parts(F.col("tag") == "").alias("text"), links.alias("hrefs"))


def html_books(pages: DataFrame) -> DataFrame:
    """Rows of the tables of parish pages, one for each link of a row, or one without: page_id, parish (the title), kind (caption or id of the table), depth, table_no, row_no, title (the first cell), href, doc_id, years."""
    heads = pages.select("page_id", _tagless(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("parish"))
    table = ["page_id", "depth", "table_no"]
    before = html_parts(pages).where("depth > 0 and row_no = 0")
    id_ = F.max(F.when(F.col("tag") == "table", F.nullif(F.regexp_extract("part", r"""(?is)\sid=["']([^"']*)["']""", 1), F.lit(""))))
    kinds = before.groupBy(*table).agg(F.coalesce(F.nullif(_joined_parts(F.col("tag") == ""), F.lit("")), id_).alias("kind"))
    cells = F.sort_array(F.collect_list(F.struct("cell_no", "text", "hrefs")))
    rows = html_cells(pages).groupBy(*table, "row_no").agg(cells.alias("cells"))
    each = rows.select(*table, "row_no", F.col("cells.text").alias("texts"), F.explode_outer(F.flatten("cells.hrefs")).alias("href"))
    told = each.join(kinds, table, "left").join(heads, "page_id")
    return told.select("page_id", "parish", "kind", "depth", "table_no", "row_no", F.get("texts", F.lit(0)).alias("title"), "href", document_id(F.col("href")).alias("doc_id"), period(F.array_join("texts", " ")).alias("years"))


def retry_ids(lines: DataFrame, kind: str = "BIRT") -> DataFrame:
    """Numeric ids of the lines (value) of a Markdown table that name a record type."""
    return lines.where(F.col("value").rlike(rf"^\s*\|.*\b{kind}\b")).select(F.nullif(F.regexp_extract("value", r"\|\s*(\d+)\s*\|", 1), F.lit("")).cast("long").alias("id")).where("id is not null")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files of a directory as (file_id, text)."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.txt)?$", 1).alias("file_id"), F.col("value").alias("text"))


def external_people(results: DataFrame, column: str = "json") -> DataFrame:
    """(id, name, birth, death, place) of search results, JSON {entries: [{id, content: {...}}]}; empty values are null, entries without any are left out."""
    rows = results.select(F.explode(F.from_json(column, "entries array<struct<id string, content struct<name string, birth string, death string, place string>>>")["entries"]).alias("e"))
    fields = [F.nullif(F.trim(F.col(f"e.content.{c}")), F.lit("")).alias(c) for c in ("name", "birth", "death", "place")]
    return rows.select(F.col("e.id").alias("id"), *fields).where("coalesce(name, birth, death, place) is not null")
