"""Statistics over dated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def century(year: Column) -> Column:
    return F.floor((year - 1) / 100) + 1


def decade(year: Column) -> Column:
    return F.floor(year / 10) * 10


def percent(n: Column, d: Column) -> Column:
    """n of d in percent, one decimal, halves to even; 0.0 of nothing."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.bround(n.cast("double") * 100 / d, 1))


def count_map(key: Column) -> Column:
    """Aggregate: how often each key occurs, keys ascending, as a map."""
    return F.map_from_entries(F.array_sort(F.collect_list(key)))


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value) with the most frequent value, ties by name."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("k")).select(group, F.col("k.v").alias(value))


def top(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by name, and the number of distinct ones."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), column).limit(k).join(F.broadcast(counts.agg(F.count(F.lit(1)).alias("distinct_total"))))  # one row


def grouping_sets(rows: DataFrame, dims: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """Counts over several groupings at once, with their grouping id."""
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(F.grouping_id().cast("int").alias("gid"), F.count(F.lit(1)).alias("n"))


def coverage(pages: DataFrame) -> DataFrame:
    """Per type and in all (type null): pages, parsed, transcribed, with entries and their rates, for pages (record_type, parsed_ok, transcription, deceased, baptized, persons); an unknown type is DEAT."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    marks = ("", "n/a", "none", "null")
    text = ~F.lower(F.trim(F.coalesce("transcription", F.lit("")))).isin(*marks)
    entries = F.greatest(n("deceased"), F.lit(0)) + F.greatest(n("baptized"), F.lit(0)) + F.greatest(n("persons"), F.lit(0))
    kind = F.when(F.upper("record_type").isin("DEAT", "BIRT", "MARR"), F.upper("record_type")).otherwise("DEAT")
    rows = pages.select(kind.alias("type"), F.coalesce("parsed_ok", F.lit(False)).alias("parsed"), text.alias("text"), entries.alias("entries"))
    out = rows.rollup("type").agg(F.count(F.lit(1)).alias("total"), F.count_if("parsed").alias("parsed"), F.count_if("text").alias("transcribed"), F.count_if(F.col("entries") > 0).alias("with_entries"), F.sum("entries").alias("persons"))
    return out.withColumns({f"{c}_rate": percent(F.col(c), F.col("total")) for c in ("parsed", "transcribed", "with_entries")})


def scaled(rows: DataFrame, n: str) -> DataFrame:
    """Adds t (place between the least above 0 and the most), radius, share of the most and band to rows with a count."""
    s = rows.agg(F.min(F.when(F.col(n) > 0, F.col(n))).alias("_low"), F.max(n).alias("_high"), F.sum(n).alias("total"))
    out = rows.join(F.broadcast(s))  # one row
    out = out.withColumn("t", (F.col(n) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1)))
    share = F.col(n) / F.greatest(F.col("_high"), F.lit(1))
    band = F.when(share > 0.6, "high").when(share > 0.3, "middle").when(share > 0.12, "low").otherwise("rare")
    return out.withColumns({"radius": F.greatest(F.lit(8.0), F.sqrt(n) * 2.5), "share": share, "band": band}).drop("_low", "_high")


def fill_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, filled, total, rate) for each column."""
    sums = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in columns])
    long = sums.unpivot("total", columns, "column_name", "filled")
    return long.select("column_name", "filled", "total", percent(F.col("filled"), F.col("total")).alias("rate"))


def capped(rows: DataFrame, group: list[str], order: list[Column], per_group: int, overall: int) -> DataFrame:
    """Rows in order, at most per_group of a group and overall in all; adds place. Groups are cut first, so that the overall order sorts per_group rows of each at most, and of those only the first overall."""
    w = Window.partitionBy(*group).orderBy(*order)
    cut = rows.withColumn("group_place", F.row_number().over(w)).where(F.col("group_place") <= per_group)
    return cut.orderBy(*order).limit(overall)


def error_runs(rows: DataFrame, key: list[str], order: list[str], failed: Column, least: int = 2) -> DataFrame:
    """Runs of at least so many consecutive failures of a key: key, first, last, length."""
    w, wf = Window.partitionBy(*key).orderBy(*order), Window.partitionBy(*key, "_f").orderBy(*order)
    marked = rows.withColumn("_f", failed).withColumn("_run", F.row_number().over(w)).withColumn("_run", F.col("_run") - F.row_number().over(wf))
    return marked.where("_f").groupBy(*key, "_run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("_run")


def change_per_metric(history: DataFrame, time: str, metrics: list[str]) -> DataFrame:
    """(metric, time, value, change) of an append-only snapshot table."""
    long = history.unpivot(time, metrics, "metric", "value")
    return long.withColumn("change", F.col("value") - F.lag("value").over(Window.partitionBy("metric").orderBy(time)))


def hidden_counts(rows: DataFrame, group: list[str], newest: list[str], per_group: int, overall: int) -> DataFrame:
    """(group, shown, hidden) of capped(), newest first by the columns newest, which tell rows apart: rows beyond per_group of a group are hidden, and counted if they come before the overall cap is filled."""
    w = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in newest])
    placed = rows.withColumn("group_place", F.row_number().over(w))
    place = F.struct(*newest)
    survivors = placed.where(F.col("group_place") <= per_group).orderBy(*[F.col(c).desc() for c in newest]).limit(overall)
    last = survivors.agg(F.min(place).alias("last"), F.count(F.lit(1)).alias("taken"))  # one row
    met = placed.join(F.broadcast(last)).where((F.col("taken") < overall) | (place >= F.col("last")))
    return met.groupBy(*group).agg(F.count_if(F.col("group_place") <= per_group).alias("shown"), F.count_if(F.col("group_place") > per_group).alias("hidden"))


def completion(events: DataFrame, job: str, state: str, order: list[str], done: str) -> DataFrame:
    """One row: jobs, those whose latest state is done, percent, and eta_s, the seconds that the others take at the rate of all events so far if each takes the mean number of steps. order begins with the time."""
    jobs = events.groupBy(job).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("steps"))
    second = lambda f: F.unix_timestamp(F.date_trunc("second", f(order[0])))
    rate = events.agg((F.count(F.lit(1)) / F.nullif(second(F.max) - second(F.min), F.lit(0))).alias("rate"))
    sums = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("state") == done).alias("done"), F.avg("steps").alias("mean_steps"))
    both = sums.join(F.broadcast(rate))  # one row each
    return both.select("jobs", "done", F.round(100 * F.col("done") / F.col("jobs"), 4).alias("percent"), F.round((F.col("jobs") - F.col("done")) * F.col("mean_steps") / F.col("rate"), 4).alias("eta_s"))


def exhausted(calls: DataFrame, key: list[str], order: list[str], failed: Column, quota: int, share: float = 0.8, least: int = 2) -> DataFrame:
    """(key, calls, worst, exhausted): the calls of a key (a user and a day), its longest run of failures, and whether a run reached least failures when so much of the quota was used."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = calls.withColumn("_f", failed).withColumn("_k", F.row_number().over(w)).withColumn("_good", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    run = Window.partitionBy(*key, "_good").orderBy(*order)
    # the failures after the same number of good calls are one run
    marked = marked.withColumn("_len", F.when(F.col("_f"), F.sum(F.col("_f").cast("int")).over(run)).otherwise(0))
    hit = F.col("_f") & (F.col("_len") >= least) & (F.col("_k") >= share * quota)
    return marked.groupBy(*key).agg(F.count(F.lit(1)).alias("calls"), F.max("_len").alias("worst"), F.max(hit).alias("exhausted"))
