"""Incremental forms of the batch jobs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regista.functions.ranks import materialise
from regista.functions.text import page_reason
from regista.operators.ingest import persons
from regista.sources.paths import exists


def page_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New files of a directory, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


#: Parts of an ingest target, by a hash of the keys; a batch reads the parts that it has rows for.
PARTS = 64
#: Folder of an ingest target that tells which keys its files hold; names with an underscore are no rows for readers.
INDEX = "_index"


def key_ranges(rows: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """The least and largest key of each of by: low, high."""
    key = F.struct(*keys)
    return rows.groupBy(*by).agg(F.min(key).alias("low"), F.max(key).alias("high"))


def files_with(spark: SparkSession, target: str, rows: DataFrame, keys: list[str], own: str = "") -> list[str]:
    """The files of an ingest target that may hold keys of rows (part, keys): those of their parts whose ranges of keys meet. Files under the folder own are left out. The driver gets names of files, as it does to plan any scan."""
    if not exists(spark, f"{target}/{INDEX}/*/*/*.parquet"):
        return []
    index = spark.read.parquet(f"{target}/{INDEX}/*/*")
    mine = key_ranges(rows, keys, "part").select("part", F.col("low").alias("first"), F.col("high").alias("last"))
    met = index.join(mine, "part").where((F.col("low") <= F.col("last")) & (F.col("high") >= F.col("first")))
    return [r["file"] for r in met.select("file").distinct().collect() if not own or own not in r["file"]]


def _run(checkpoint: str) -> str:
    """The name of a run's folders: the same whenever the run is started again."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def _unseen(rows: DataFrame, target: str, own: str, keys: list[str], parts: int) -> DataFrame:
    """rows with distinct keys and their part, without those that the target has outside of the folder own."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(keys).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    files = files_with(spark, target, rows, keys, own)
    if not files:
        return rows
    there = spark.read.option("basePath", target).schema(rows.select("part", *keys).schema).parquet(*files)
    return rows.join(there.select("part", *keys), ["part", *keys], "left_anti")


def _written(rows: DataFrame, target: str, own: str, keys: list[str]) -> None:
    """Write rows (part, ...) to the folder own of the target, and then its index."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{target}/{own}")
    if exists(spark, f"{target}/{own}/part=*"):
        new = spark.read.option("basePath", f"{target}/{own}").schema(rows.schema).parquet(f"{target}/{own}")
        key_ranges(new, keys, "part", "_metadata.file_path").withColumnRenamed("file_path", "file").coalesce(1).write.mode("overwrite").parquet(f"{target}/{INDEX}/{own}")


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], parts: int = PARTS) -> StreamingQuery:
    """Add each batch's rows whose key the target lacks; a batch that runs again adds nothing. A key with a null in it is never there yet.

    The target is partitioned by a hash of the keys, and an index holds the
    range of keys of each of its files. A batch reads the keys of those files
    alone whose part and range meet its own rows, so ids that grow with time
    open few of them, however many there are. Each batch of a checkpoint has a
    folder of its own, which it overwrites if it runs again, and its part of
    the index is written last: a batch that failed half-way leaves nothing
    behind that counts twice once its checkpoint goes on.
    """
    run = _run(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        own = f"run={run}/batch={number}"
        _written(_unseen(batch, target, own, keys, parts), target, own, keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_pages(stream: DataFrame, target: str, checkpoint: str, noise: tuple[str, ...] = (), parts: int = PARTS) -> StreamingQuery:
    """From page documents (as sources.pages reads them) to persons, page by page, once for each file_id.

    The target has two tables: persons, see operators.ingest.persons(), whose
    text is the fallback where a page has no entries; and done (file_id,
    status, n), a row for each page, be it synced or left out, with the reason
    and how many persons it gave. A page in done is not looked at again,
    whatever run it comes with. A batch writes its persons first and done last,
    each to a folder that it overwrites if it runs again. Pages without a
    file_id have no place in done and are left out.
    """
    run = _run(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        own, done = f"run={run}/batch={number}", f"{target}/done"
        new = materialise(_unseen(batch.where("file_id is not null"), done, own, ["file_id"], parts))
        persons(new.drop("part"), noise).write.mode("overwrite").parquet(f"{target}/persons/{own}")
        people = batch.sparkSession.read.parquet(f"{target}/persons/{own}").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
        told = new.join(people, "file_id", "left").select("part", "file_id", F.when(F.col("n") > 0, "synced").otherwise(page_reason(F.coalesce("raw_text", "transcription"))).alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
        _written(told, done, own, ["file_id"])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completed(records: DataFrame, pages: DataFrame, key: str, time: str, page_time: str, within: str, late: str) -> DataFrame:
    """Records with the columns of the page of the same key that comes up to so long after them, or with nulls if none comes in time.

    Both are streams (or tables) and keep their rows until no partner can come
    any more: a record until its time and within lie behind the watermark,
    which is late behind the slower stream. A page that is behind the watermark
    when it arrives is left out.
    """
    a = records.withWatermark(time, late)
    b = pages.withWatermark(page_time, late).withColumnRenamed(key, "_key")
    near = (F.col(page_time) >= F.col(time)) & (F.col(page_time) <= F.col(time) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col("_key")) & near, "left_outer").drop("_key")


def queued(stream: DataFrame, queue: str, checkpoint: str) -> StreamingQuery:
    """Put each batch of alerts (user_id, ...) into a queue, a folder for a batch; a batch that runs again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{queue}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(spark: SparkSession, queue: str, positions: str, number: int, users: DataFrame | None = None) -> DataFrame:
    """The alerts that the users (user_id; all if None) have not got yet, as drain of that number, counted from 0; positions has how far each user has read.

    A user's position is the last batch that was read for it. A drain takes
    the positions that the drains before it left and leaves new ones in a
    folder of its own, so one that is run again starts where it did the first
    time and gives each alert once, and a user who is left out gets all alerts
    later.
    """
    alerts = spark.read.option("basePath", queue).parquet(f"{queue}/batch=*")
    done = spark.createDataFrame([], "user_id long, position int, drain int")
    if exists(spark, f"{positions}/drain=*"):
        done = spark.read.option("basePath", positions).parquet(f"{positions}/drain=*").where(F.col("drain") < number)
    read = done.groupBy("user_id").agg(F.max("position").alias("position"))
    new = alerts.join(read, "user_id", "left").where(F.col("position").isNull() | (F.col("batch") > F.col("position"))).drop("position")
    if users is not None:
        new = new.join(users.select("user_id").distinct(), "user_id", "left_semi")
    new = materialise(new)
    new.groupBy("user_id").agg(F.max("batch").alias("position")).write.mode("overwrite").parquet(f"{positions}/drain={number}")
    return new


def counts(stream: DataFrame, *keys: str) -> DataFrame:
    """Refreshed counts, for update or complete mode."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def bucketed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "45 minutes", late: str = "1 hour") -> DataFrame:
    """Spans of a key without a gap longer than so much."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def progress(stream: DataFrame, job: str, order: str, state: str) -> DataFrame:
    """The latest state of each job."""
    return stream.groupBy(job).agg(F.max_by(state, order).alias(state), F.max(order).alias(order))


#: Rules up to so many are broadcast.
BROADCAST_RULES = 10_000


def alerts(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, event_id) where a rule (rule_id, kind, least, day_from, day_to; null for any) fits a row (event_id, event_type, value, ts).

    Rules of a kind meet the rows of that kind in an equi join; those for any
    kind are held against all rows. Rules are broadcast if there are few, as
    a count of them tells. Works on streams and tables.
    """
    day = F.to_date("ts")
    fits = (F.col("least").isNull() | (F.col("value") >= F.col("least"))) & (F.col("day_from").isNull() | (day >= F.col("day_from"))) & (F.col("day_to").isNull() | (day <= F.col("day_to")))
    sent = F.broadcast if rules.count() <= BROADCAST_RULES else lambda x: x
    own = rows.join(sent(rules.where("kind is not null")), (F.col("event_type") == F.col("kind")) & fits)
    every = rows.join(sent(rules.where("kind is null")), fits)
    return own.select("rule_id", "event_id").union(every.select("rule_id", "event_id"))
