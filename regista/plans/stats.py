"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regista.operators import statistics as s
from regista.plans.registry import Tables, query


@query("""
SELECT o_orderstatus AS status, year(o_orderdate) AS yr, n_name AS nation,
       CAST(grouping(o_orderstatus) * 4 + grouping(year(o_orderdate)) * 2 + grouping(n_name) AS INTEGER) AS gid, count(*) AS n
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
GROUP BY GROUPING SETS ((), (o_orderstatus), (year(o_orderdate)), (n_name), (o_orderstatus, n_name))
""")
def stats_grouping_sets(spark, sf_dir):
    """Counts of dated events in all, by type, by year, by place, by type and place."""
    t = Tables(spark, sf_dir)
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("yr"), F.col("n_name").alias("nation"))
    return s.grouping_sets(rows, ["status", "yr", "nation"], [(), ("status",), ("yr",), ("nation",), ("status", "nation")])


@query("SELECT CAST((year(o_orderdate) - 1) // 100 + 1 AS BIGINT) AS century, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1000 GROUP BY 1")
def rows_per_century(spark, sf_dir):
    y = F.year("o_orderdate")
    return Tables(spark, sf_dir).orders.where(y >= 1000).groupBy(s.century(y).cast("long").alias("century")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1000 AND 2100 GROUP BY 1")
def rows_per_decade(spark, sf_dir):
    y = F.year("o_orderdate")
    return Tables(spark, sf_dir).orders.where(y.between(1000, 2100)).groupBy(s.decade(y).cast("long").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH seg AS (
  SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k
  FROM customer GROUP BY c_nationkey, c_mktsegment
), ev AS (
  SELECT c_nationkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
         count(*) FILTER (o_orderstatus = 'P') AS p, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey
), cent AS (
  SELECT c_nationkey, string_agg(c || ':' || n, ',' ORDER BY c) AS years FROM (
    SELECT c_nationkey, year(o_orderdate) AS c, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) GROUP BY 1
)
SELECT n_name AS nation, coalesce(total, 0) AS total, coalesce(f, 0) AS f, coalesce(o, 0) AS o, coalesce(p, 0) AS p,
       c_mktsegment AS majority, CAST(first_year AS INTEGER) AS first_year, CAST(last_year AS INTEGER) AS last_year, coalesce(years, '') AS years
FROM nation LEFT JOIN ev ON ev.c_nationkey = n_nationkey LEFT JOIN seg ON seg.c_nationkey = n_nationkey AND k = 1 LEFT JOIN cent ON cent.c_nationkey = n_nationkey
""")
def map_statistics(spark, sf_dir):
    """Per place: events in all and by type, the majority value, years; places without events have 0."""
    t = Tables(spark, sf_dir)
    ev = t.orders.select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    kinds = [F.count_if(F.col("o_orderstatus") == k).alias(k.lower()) for k in "FOP"]
    totals = ev.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"), *kinds, F.min("y").alias("first_year"), F.max("y").alias("last_year"))
    years = ev.groupBy("c_nationkey", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("c_nationkey").agg(s.count_map(F.struct("y", "n")).alias("m"))
    years = years.select("c_nationkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("years"))
    major = s.majority(t.customer, "c_nationkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "majority")
    place = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    out = place.join(totals, "c_nationkey", "left").join(major, "c_nationkey", "left").join(years, "c_nationkey", "left")
    return out.select("nation", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "f", "o", "p")], "majority", "first_year", "last_year", F.coalesce("years", F.lit("")).alias("years"))


@query("""
SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC, nation LIMIT 20
""")
def approved_top_places(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "nation").limit(20)


@query("""
SELECT year(o_orderdate)::INTEGER AS yr, count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'O') AS rejected
FROM orders GROUP BY 1
""")
def review_stats(spark, sf_dir):
    kinds = {"pending": "P", "approved": "F", "rejected": "O"}
    return Tables(spark, sf_dir).orders.groupBy(F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("o_orderstatus") == v).alias(k) for k, v in kinds.items()])


@query("""
SELECT count(*) AS total, round(avg(1 - 8 * l_discount), 6) AS mean_quality, count(*) FILTER (1 - 8 * l_discount >= 0.8) AS high,
       count(*) FILTER (1 - 8 * l_discount >= 0.5 AND 1 - 8 * l_discount < 0.8) AS middle, count(*) FILTER (1 - 8 * l_discount < 0.5) AS low,
       count(*) FILTER (l_returnflag = 'R') AS validated, count(*) FILTER (l_shipdate IS NULL) AS no_date
FROM lineitem
""")
def quality_metrics(spark, sf_dir):
    q = 1 - 8 * F.col("l_discount")
    return Tables(spark, sf_dir).lineitem.agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg(q), 6).alias("mean_quality"), F.count_if(q >= 0.8).alias("high"), F.count_if((q >= 0.5) & (q < 0.8)).alias("middle"),
        F.count_if(q < 0.5).alias("low"), F.count_if(F.col("l_returnflag") == "R").alias("validated"), F.count_if(F.col("l_shipdate").isNull()).alias("no_date"),
    )


@query("SELECT CAST(p_size // 10 * 10 AS VARCHAR) || '-' || CAST(p_size // 10 * 10 + 9 AS VARCHAR) AS bucket, count(*) AS n FROM part WHERE p_size BETWEEN 1 AND 109 GROUP BY 1")
def age_histogram(spark, sf_dir):
    low = (F.floor(F.col("p_size") / 10) * 10).cast("int")
    return Tables(spark, sf_dir).part.where("p_size between 1 and 109").groupBy(F.concat_ws("-", low.cast("string"), (low + 9).cast("string")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_brand, count(*) AS n, (SELECT count(DISTINCT p_brand) FROM part) AS distinct_total FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10
""")
def top_names(spark, sf_dir):
    return s.top(Tables(spark, sf_dir).part, "p_brand", 10)


@query("""
SELECT p_type, CAST(p_size // 10 * 10 AS BIGINT) AS decade, count(*) AS n FROM part WHERE p_brand LIKE '%Brand#1%'
GROUP BY GROUPING SETS ((p_type), (p_size // 10 * 10), ())
""")
def name_profile(spark, sf_dir):
    rows = Tables(spark, sf_dir).part.where(F.contains("p_brand", F.lit("Brand#1"))).select("p_type", (F.floor(F.col("p_size") / 10) * 10).alias("decade"))
    return rows.groupingSets([["p_type"], ["decade"], []], "p_type", "decade").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT source, count(*) AS total, count(l.doc_id) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic,
       round_even(100.0::DOUBLE * count(l.doc_id) / count(*), 1) AS labelled_rate
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (source)
""")
def coverage_rates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.documents.select("doc_id", "source").join(t.labels.withColumn("l", F.lit(1)), "doc_id", "left")
    out = rows.rollup("source").agg(F.count(F.lit(1)).alias("total"), F.count("l").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return out.withColumn("labelled_rate", s.percent(F.col("labelled"), F.col("total")))


@query("""
WITH r AS (SELECT d.source, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT count(*) AS total, count(source) AS source, count(lang) AS lang, count(quality) AS quality, count(toxic) AS toxic FROM r)
SELECT column_name, filled, total, round_even(100.0::DOUBLE * filled / total, 1) AS rate FROM (
  SELECT 'source' AS column_name, source AS filled, total FROM c UNION ALL SELECT 'lang', lang, total FROM c
  UNION ALL SELECT 'quality', quality, total FROM c UNION ALL SELECT 'toxic', toxic, total FROM c)
""")
def fill_rates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return s.fill_rates(t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left"), ["source", "lang", "quality", "toxic"])


@query("""
WITH c AS (SELECT n_name AS nation, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
m AS (SELECT min(n) FILTER (n > 0) AS low, max(n) AS high, sum(n)::BIGINT AS total FROM c)
SELECT nation, n, total, round((n - low)::DOUBLE / greatest(high - low, 1), 6) AS t, round(greatest(8.0, sqrt(n) * 2.5), 6) AS radius, round(n::DOUBLE / greatest(high, 1), 6) AS share,
       CASE WHEN n::DOUBLE / greatest(high, 1) > 0.6 THEN 'high' WHEN n::DOUBLE / greatest(high, 1) > 0.3 THEN 'middle' WHEN n::DOUBLE / greatest(high, 1) > 0.12 THEN 'low' ELSE 'rare' END AS band
FROM c, m
""")
def density_scale(spark, sf_dir):
    t = Tables(spark, sf_dir)
    counts = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("nation")).agg(F.count("c_custkey").alias("n"))
    out = s.scaled(counts, "n")
    return out.withColumns({c: F.round(c, 6) for c in ("t", "radius", "share")})


@query("""
WITH b AS (SELECT n_name AS nation, count(*) AS books, round(min(s_acctbal), 2) AS least, round(max(s_acctbal), 2) AS most FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT *, (SELECT count(*) FROM supplier) AS all_books, (SELECT count(*) FROM b) AS places FROM b
""")
def inventory_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    by = rows.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("books"), F.round(F.min("s_acctbal"), 2).alias("least"), F.round(F.max("s_acctbal"), 2).alias("most"))
    return by.join(F.broadcast(by.agg(F.sum("books").alias("all_books"), F.count(F.lit(1)).alias("places"))))  # one row


@query("""
SELECT user_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS errors,
       round(count(*) FILTER (event_type <> 'error')::DOUBLE / (count(*) + 1), 6) AS health, round(avg(value), 4) AS mean_time
FROM events GROUP BY user_id
""")
def run_health(spark, sf_dir):
    ok = F.col("event_type") != "error"
    out = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), F.round(F.avg("value"), 4).alias("mean_time"))
    return out.withColumn("health", F.round(F.col("ok") / (F.col("ok") + F.col("errors") + 1), 6))


@query("""
WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, ts, event_type = 'error' AS f,
             row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type = 'error' ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, day, min(ts) AS "first", max(ts) AS "last", count(*) AS length FROM m WHERE f GROUP BY user_id, day, run HAVING count(*) >= 2
""")
def error_runs(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.withColumn("day", F.to_date("ts"))
    return s.error_runs(rows, ["user_id", "day"], ["ts", "event_id"], F.col("event_type") == "error")


@query("""
WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, before AS stalled_at, ts AS resumed_at, CAST(date_diff('second', before, ts) AS BIGINT) AS gap_s FROM g WHERE ts > before + INTERVAL 45 MINUTE
""")
def stall_gaps(spark, sf_dir):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = Tables(spark, sf_dir).events.select("user_id", before.alias("stalled_at"), F.col("ts").alias("resumed_at"))
    gap = F.unix_timestamp(F.date_trunc("second", "resumed_at")) - F.unix_timestamp(F.date_trunc("second", "stalled_at"))
    return rows.where(F.col("resumed_at") > F.col("stalled_at") + F.expr("INTERVAL 45 MINUTES")).withColumn("gap_s", gap)


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n, sum(value) AS v FROM events GROUP BY user_id),
t AS (SELECT date_diff('second', min(ts), max(ts)) AS s, count(*) AS n FROM events)
SELECT state, count(*) AS jobs, CAST(sum(l.n) AS BIGINT) AS steps, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM l), 4) AS percent,
       round(any_value(t.n)::DOUBLE / any_value(t.s), 6) AS rate FROM l, t GROUP BY state
""")
def progress_eta(spark, sf_dir):
    """Latest state of each job, jobs and steps per state, steps a second over the whole span."""
    ev = Tables(spark, sf_dir).events
    jobs = ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n"))
    second = lambda f: F.unix_timestamp(F.date_trunc("second", f("ts")))
    span = ev.agg((F.count(F.lit(1)) / (second(F.max) - second(F.min))).alias("rate"))
    states = jobs.groupBy("state").agg(F.count(F.lit(1)).alias("jobs"), F.sum("n").alias("steps")).join(F.broadcast(jobs.agg(F.count(F.lit(1)).alias("all")))).join(F.broadcast(span))  # one row each
    return states.select("state", "jobs", "steps", F.round(100 * F.col("jobs") / F.col("all"), 4).alias("percent"), F.round("rate", 6).alias("rate"))


@query("SELECT lower(trim(text)) AS query, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def popular_queries(spark, sf_dir):
    rows = Tables(spark, sf_dir).conversations.where("role = 'user'").groupBy(F.lower(F.trim("text")).alias("query")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.col("n").desc(), "query").limit(10)


@query("""
WITH h AS (SELECT CAST(l.doc_id // 100 AS BIGINT) AS snapshot, CAST(count(*) AS DOUBLE) AS labelled, CAST(sum(toxic) AS DOUBLE) AS toxic FROM labels l GROUP BY 1),
u AS (SELECT 'labelled' AS metric, snapshot, labelled AS value FROM h UNION ALL SELECT 'toxic', snapshot, toxic FROM h)
SELECT metric, snapshot, value, value - lag(value) OVER (PARTITION BY metric ORDER BY snapshot) AS change FROM u
""")
def snapshot_changes(spark, sf_dir):
    h = Tables(spark, sf_dir).labels.groupBy(F.floor(F.col("doc_id") / 100).alias("snapshot")).agg(F.count(F.lit(1)).cast("double").alias("labelled"), F.sum("toxic").cast("double").alias("toxic"))
    return s.change_per_metric(h, "snapshot", ["labelled", "toxic"])


@query("""
WITH g AS (SELECT o_orderkey, o_orderstatus, year(o_orderdate)::INTEGER AS yr, o_orderdate, row_number() OVER (PARTITION BY o_orderstatus, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS group_place FROM orders)
SELECT o_orderkey, o_orderstatus, yr, group_place FROM g WHERE group_place <= 30 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 120
""")
def capped_groups(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.withColumn("yr", F.year("o_orderdate"))
    out = s.capped(rows, ["o_orderstatus", "yr"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 30, 120)
    return out.select("o_orderkey", "o_orderstatus", "yr", "group_place")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def filter_box(spark, sf_dir):
    return Tables(spark, sf_dir).documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
