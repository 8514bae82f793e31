"""Sinks: CSV, GEDCOM lines, snapshots, idempotent and schema-tolerant appends, redaction."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from regista.functions.names import gedcom_date, gedcom_name
from regista.functions.ranks import with_rank
from regista.sources.paths import exists


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order as CSV with a header; quotes are doubled."""
    rows.orderBy(*order).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds number, 1..n in order, by as many sorted ranges as the shuffle has partitions, so no task sorts all rows."""
    return with_rank(rows, *order, name="number").withColumn("number", F.col("number") + 1)


def gedcom_blocks(people: DataFrame) -> DataFrame:
    """(number, line_no, line) of an INDI block for each of people (number, name, death, place, source, page, book); empty fields have no line."""
    note = F.concat_ws(" | ", F.concat(F.lit("Pág. "), F.col("page").cast("string")), F.concat(F.lit("Livro: "), F.col("book").cast("string")))
    lines = F.array(
        F.concat(F.lit("0 @I"), F.col("number").cast("string"), F.lit("@ INDI")),
        F.concat(F.lit("1 NAME "), gedcom_name(F.col("name"))),
        F.when(F.col("death").isNotNull() | F.col("place").isNotNull(), F.lit("1 DEAT")),
        F.concat(F.lit("2 DATE "), gedcom_date(F.col("death"))),
        F.concat(F.lit("2 PLAC "), F.col("place")),
        F.concat(F.lit("1 SOUR "), F.col("source")),
        F.when(note != "", F.concat(F.lit("1 NOTE "), note)),
    )
    return people.select("number", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_no", "line"))


def person_gedcom(people: DataFrame, person_id: int) -> DataFrame:
    """The block of one person (id, number, role, birth, baptism, ...): SEX from the role in a marriage, BIRT from the baptism before the birth date."""
    one = people.where(F.col("id") == person_id)
    sex = F.when(F.col("role") == "groom", "M").when(F.col("role") == "bride", "F")
    lines = F.array(F.concat(F.lit("1 SEX "), sex), F.concat(F.lit("1 BIRT\n2 DATE "), gedcom_date(F.coalesce("baptism", "birth"))))
    return gedcom_blocks(one).unionByName(one.select("number", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("at", "line")).select("number", (F.col("at") + 100).alias("line_no"), "line"))


def write_gedcom(people: DataFrame, path: str) -> None:
    """Header, blocks in order of number, trailer, as text."""
    spark = people.sparkSession
    blocks = gedcom_blocks(people).select("number", "line_no", "line")
    ends = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("number"), F.lit(0).alias("line_no"), F.lit("0 HEAD\n1 GEDC\n2 VERS 5.5.1\n1 CHAR UTF-8").alias("line")), F.struct(F.lit((1 << 62)).alias("number"), F.lit(0).alias("line_no"), F.lit("0 TRLR").alias("line")))).alias("e")).select("e.*")
    blocks.unionByName(ends).orderBy("number", "line_no").select("line").write.text(path)


def append_snapshot(metrics: DataFrame, path: str) -> int:
    """Append rows of metrics with the time to a history, and give the number of the snapshot.

    The rows are written to a folder of their own first, then a manifest that
    names the folder and counts its rows. So a snapshot that was torn off is
    not in the history, and neither is one whose folder doesn't have the rows
    that were counted; see read_snapshots().
    """
    spark = metrics.sparkSession
    number = max((r["number"] for r in _manifests(spark, path)), default=-1) + 1
    folder = f"snapshot-{number}-{uuid.uuid4().hex}"
    metrics.withColumn("taken_at", F.current_timestamp()).write.parquet(f"{path}/{folder}")
    n = spark.read.parquet(f"{path}/{folder}").count()
    spark.createDataFrame([(number, folder, n)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/_manifests/{number}")
    return number


#: What a manifest tells of its snapshot.
MANIFEST = "number int, folder string, rows long"


def _manifests(spark: SparkSession, path: str) -> list[Row]:
    """The manifests that can be read, one for each snapshot."""
    if not exists(spark, f"{path}/_manifests/*/*.json"):
        return []
    rows = spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").json(f"{path}/_manifests/*")
    return [r for r in rows.collect() if r["number"] is not None and r["folder"] is not None]


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The history at path: number, the metrics of the schema and taken_at; snapshots that are torn or damaged are left out, and a history in which nothing can be read is empty, so that it is started over."""
    kind = f"{schema}, taken_at timestamp"
    out = spark.createDataFrame([], f"number int, {kind}")
    for m in sorted(_manifests(spark, path), key=lambda m: m["number"]):
        try:
            rows = spark.read.schema(kind).parquet(f"{path}/{m['folder']}")
            whole = rows.count() == m["rows"]
        except (PySparkException, Py4JJavaError):  # files that are gone or no Parquet
            continue
        if whole:
            out = out.unionByName(rows.select(F.lit(m["number"]).alias("number"), "*"))
    return out


def append_new(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in existing, each once: what an idempotent append writes."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def fitted(rows: DataFrame, target: list[str]) -> DataFrame:
    """Rows with the columns that the target has; unknown ones are left out."""
    return rows.select(*[c for c in rows.columns if c in target])


def masked(value: Column) -> Column:
    """First and last four characters, the middle starred; short values all starred, masked ones as they are, null as ''."""
    n = F.length(value)
    stars = F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), F.greatest(n - 8, F.lit(0))), F.right(value, F.lit(4)))
    return F.when(value.isNull(), "").when(F.contains(value, F.lit("**")), value).when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(stars)
