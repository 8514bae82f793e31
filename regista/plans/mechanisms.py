"""Queries of relations in time, family trees, tables in raw pages, snapshots, and streams that meet late rows or are read once."""

from __future__ import annotations

from pyspark.sql import functions as F

from regista.operators import family
from regista.plans.jobs import _scratch
from regista.plans.registry import Tables, query
from regista.sources import export, pages
from regista.streaming import jobs as stream


@query("""
WITH f AS (SELECT o_custkey, min(year(o_orderdate) * 12 + month(o_orderdate)) AS year FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS id, c_nationkey AS n, year FROM customer JOIN f ON o_custkey = c_custkey),
r AS (SELECT a.id, b.id AS other, b.year - a.year AS diff, CASE WHEN b.year - a.year >= 15 THEN 'child' WHEN b.year - a.year <= -15 THEN 'parent' WHEN abs(b.year - a.year) <= 5 THEN 'sibling' END AS relation
      FROM p a JOIN p b ON a.n = b.n AND a.id <> b.id)
SELECT id, other, relation, diff, row_number() OVER (PARTITION BY id, relation ORDER BY abs(diff), other) AS rank FROM r WHERE relation IS NOT NULL QUALIFY rank <= 3
""")
def relation_nearest(spark, sf_dir):
    """The three nearest of each relation among the customers of a nation, by the months between first orders."""
    t = Tables(spark, sf_dir)
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("year"))
    people = t.customer.join(first, "c_custkey").select(F.col("c_custkey").alias("id"), "c_nationkey", "year")
    return family.nearest_relations(people, people, ["c_nationkey"], 3)


#: Customers as a family: who is c_custkey // 3 is a parent, and so is c_custkey // 5 + 1; every 50th closes a circle.
_LINKS = """
l AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey >= 3 UNION SELECT c_custkey, c_custkey // 5 + 1 FROM customer UNION SELECT c_custkey // 3, c_custkey FROM customer WHERE c_custkey >= 3 AND c_custkey % 50 = 0),
k AS (SELECT child, parent FROM l WHERE child <> parent)"""


def _family(spark, sf_dir):
    own = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("id"))
    third, fifth = F.floor(F.col("id") / 3), F.floor(F.col("id") / 5) + 1
    links = own.where("id >= 3").select(F.col("id").alias("child"), third.alias("parent")).union(own.select("id", fifth))
    return own, links.union(own.where("id >= 3 and id % 50 = 0").select(third, "id")).distinct()


@query(f"""
WITH RECURSIVE {_LINKS},
up AS (SELECT c_custkey AS id, c_custkey AS other, 0 AS generation FROM customer UNION SELECT up.id, k.parent, generation + 1 FROM up JOIN k ON k.child = up.other WHERE generation < 4)
SELECT id, other, min(generation) AS generation FROM up GROUP BY id, other HAVING min(generation) > 0
""")
def ancestor_generations(spark, sf_dir):
    """Four generations above every customer, in a family with circles."""
    return family.ancestors(*_family(spark, sf_dir), 4)


@query(f"""
WITH RECURSIVE {_LINKS},
up AS (SELECT c_custkey AS id, c_custkey AS other, 0 AS generation FROM customer UNION SELECT up.id, k.parent, generation + 1 FROM up JOIN k ON k.child = up.other WHERE generation < 2),
g AS (SELECT id, other, min(generation) AS generation FROM up GROUP BY id, other)
SELECT id, other AS "from", id AS "to", 'parent' AS role FROM g WHERE generation = 1
UNION SELECT a.id, b.other, a.other, 'grandparent' FROM g a JOIN g b ON a.id = b.id AND a.generation = 1 AND b.generation = 2 JOIN k ON k.child = a.other AND k.parent = b.other
UNION SELECT c_custkey, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END, 'spouse' FROM customer WHERE c_custkey % 4 < 2 AND c_custkey > 1
UNION SELECT c_custkey, c_custkey, k.child, 'child' FROM customer JOIN k ON k.parent = c_custkey
""")
def family_tree_edges(spark, sf_dir):
    """Grandparents, parents, spouse and children of every customer as edges; customers whose number divided by four leaves 0 or 1 are couples."""
    own, links = _family(spark, sf_dir)
    couples = own.where("id % 4 < 2 and id > 1").select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id") - 1).alias("b"))
    return family.family_tree(own, links, couples)


@query("""
WITH p AS (SELECT p_partkey AS id, p_name AS nome, CASE WHEN p_size % 2 = 0 THEN 'BIRT' ELSE 'DEAT' END AS t, string_split(p_name, ' ')[-1] AS pai FROM part),
own AS (SELECT * FROM p WHERE contains(lower(nome), 'ring'))
SELECT 'birth' AS role, id FROM own WHERE t = 'BIRT' UNION ALL SELECT 'death', id FROM own WHERE t = 'DEAT'
UNION ALL SELECT 'sibling', id FROM p s WHERE t = 'BIRT' AND EXISTS (SELECT 1 FROM own o WHERE o.t = 'BIRT' AND length(o.pai) >= 3 AND contains(s.pai, o.pai) AND o.id <> s.id)
""")
def name_connections(spark, sf_dir):
    """Births, deaths and siblings around a name; a part's last word is its father."""
    people = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("nome"), F.when(F.col("p_size") % 2 == 0, "BIRT").otherwise("DEAT").alias("tipo_registo"), F.element_at(F.split("p_name", " "), -1).alias("pai"))
    return family.connections(people, "Ring")


_OUTER = "'<TABLE id=\"o\"><caption>Óbitos</caption><tr><th>Livro <b>' || page_id || '</b></th><td><table id=\"i\"><tr><td>dentro</td></tr></table> depois</td><td>'"


@query(r"""
SELECT page_id, 1 AS depth, 1 AS table_no, 1 AS row_no, c AS cell_no,
  CASE c WHEN 1 THEN 'Livro ' || page_id WHEN 2 THEN 'depois' ELSE trim(regexp_replace(regexp_replace(html, '<!--.*?-->|<[a-zA-Z/!?][^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) END AS text,
  CASE WHEN c = 3 THEN array_to_string(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), ' ') ELSE '' END AS hrefs
FROM pages, unnest([1, 2, 3]) u(c)
UNION ALL SELECT page_id, 2, 1, 1, 1, 'dentro', '' FROM pages
""")
def html_cells(spark, sf_dir):
    """The cells of a table with a table in its second cell and a whole raw page in its third."""
    raw = Tables(spark, sf_dir).pages.select("page_id", F.concat(F.expr(_OUTER), "html", F.lit("</td></tr></TABLE>")).alias("html"))
    return pages.html_cells(raw).withColumn("hrefs", F.array_join("hrefs", " "))


@query("SELECT page_id, 'Óbitos' AS kind, l AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS l FROM pages) UNION ALL SELECT page_id, 'i', NULL FROM pages UNION ALL SELECT page_id, 'Óbitos', NULL FROM pages WHERE NOT regexp_matches(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"')")
def html_books(spark, sf_dir):
    """The books of the same tables: a row for each link, and one for a row without any."""
    raw = Tables(spark, sf_dir).pages.select("page_id", F.concat(F.expr(_OUTER), "html", F.lit("</td></tr></TABLE>")).alias("html"))
    return pages.html_books(raw).select("page_id", "kind", "href")


@query("SELECT k AS number, count(*) AS n, round(avg(value), 4) AS mean FROM events, unnest([0, 2, 3]) u(k) WHERE event_id % 4 <= k GROUP BY 1")
def snapshot_history(spark, sf_dir):
    """Four snapshots of the events' metrics, of which the second lost its rows after it was taken."""
    path = _scratch(spark, "history")
    events = Tables(spark, sf_dir).events
    for k in range(4):
        export.append_snapshot(events.where(F.col("event_id") % 4 <= k).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")), path)
    torn = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot-1-*")
    fs = torn.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(torn):
        fs.delete(found.getPath(), True)
    return export.read_snapshots(spark, path, "n long, mean double").drop("taken_at")


_WATERMARK = "least((SELECT date_trunc('milliseconds', max(ts)) FROM r), (SELECT date_trunc('milliseconds', max(page_ts)) FROM p WHERE {0})) - INTERVAL 2 DAY"


@query(f"""
WITH r AS (SELECT event_id, ts FROM events),
p AS (SELECT event_id, ts + event_id % 7 * INTERVAL 10 MINUTE AS page_ts, value, event_id % 3 AS turn FROM events WHERE event_id % 3 < 2),
kept AS (SELECT * FROM p WHERE turn = 0 OR page_ts > {_WATERMARK.format("turn = 0")}),
near AS (SELECT r.event_id, value FROM r JOIN kept USING (event_id) WHERE page_ts <= ts + INTERVAL 30 MINUTE)
SELECT event_id, value FROM near
UNION ALL SELECT event_id, NULL FROM r WHERE event_id NOT IN (SELECT event_id FROM near) AND ts + INTERVAL 30 MINUTE < {_WATERMARK.format("true")}
""")
def stream_late_pages(spark, sf_dir):
    """Records with the pages that follow them within half an hour, in two batches: in the second one the pages that came late, of which those more than two days behind are left out; records whose page can no longer come have nulls."""
    base, events = _scratch(spark, "late"), Tables(spark, sf_dir).events.withColumn("ts", F.col("ts").cast("timestamp"))
    page_ts = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 7 * 10).cast("int"))
    rows = {"records": events.select("event_id", "ts"), "pages": events.where("event_id % 3 < 2").select("event_id", page_ts.alias("page_ts"), "value", (F.col("event_id") % 3).alias("turn"))}
    out = f"{base}/out"
    for turn in (0, 1):  # each turn goes on where the one before it stopped
        if turn == 0:
            rows["records"].coalesce(1).write.parquet(f"{base}/records/0")
        rows["pages"].where(F.col("turn") == turn).drop("turn").coalesce(1).write.parquet(f"{base}/pages/{turn}")
        streams = [spark.readStream.schema(rows[k].drop("turn").schema).parquet(f"{base}/{k}/*") for k in ("records", "pages")]
        met = stream.completed(*streams, "event_id", "ts", "page_ts", "30 MINUTES", "2 days").select("event_id", "value")
        met.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema("event_id long, value double").parquet(out)


@query("""
SELECT 0 AS drain, user_id, event_id FROM events WHERE value >= 50 AND event_id % 2 = 0 AND user_id % 2 = 0
UNION ALL SELECT 1, user_id, event_id FROM events WHERE value >= 50 AND (event_id % 2 = 1 OR user_id % 2 = 1)
""")
def alerts_drained_once(spark, sf_dir):
    """Alerts put into a queue in two batches and drained after each: first for users of even numbers, then for all. The second drain is run twice."""
    base, events = _scratch(spark, "queue"), Tables(spark, sf_dir).events.select("event_id", "user_id", "value")
    given = []
    for n, users in enumerate((events.where("user_id % 2 = 0").select("user_id"), None)):
        events.where(F.col("event_id") % 2 == n).coalesce(1).write.parquet(f"{base}/in/{n}")
        rows = spark.readStream.schema(events.schema).parquet(f"{base}/in/*").where("value >= 50").select("user_id", "event_id")
        stream.queued(rows, f"{base}/alerts", f"{base}/checkpoint").awaitTermination()
        for _ in range(1 + n):
            new = stream.drained(spark, f"{base}/alerts", f"{base}/positions", n, users)
        given.append(new.select(F.lit(n).alias("drain"), "user_id", "event_id"))
    return given[0].union(given[1])
