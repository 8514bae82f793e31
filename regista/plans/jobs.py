"""Search, join, repair, review, name, date, text and family queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regista.functions import dates, names, text
from regista.functions.ranks import shared_folder
from regista.operators import family, ingest, repair, review, search
from regista.plans.registry import Tables, query
from regista.sources import export, pages
from regista.streaming import jobs as stream

#: Spelling clusters for the queries on part names.
CLUSTERS = (("red", "rubro"), ("small", "petty"), ("ring", "annel"), ("ring", "anel"), ("bolt", "screw"), ("widget", "gadget"))


def values(spark, rows, *cols):
    """A small table of constants."""
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)} AS t({', '.join(cols)})")


# Searches


@query("""
SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer
WHERE (lower(c_name) LIKE '%00%' OR lower(c_mktsegment) LIKE '%00%') AND c_acctbal BETWEEN 0 AND 9000 ORDER BY c_custkey DESC LIMIT 50 OFFSET 10
""")
def person_search(spark, sf_dir):
    rows = Tables(spark, sf_dir).customer.where(search.contains_any(["c_name", "c_mktsegment"], "00") & search.typed([("c_acctbal", "between", 0, 9000)]))
    return search.page(rows, F.col("c_custkey").desc(), limit=50, offset=10).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 50000 AND 90000 AND lower(o_orderpriority) LIKE '%high%' AND year(o_orderdate) BETWEEN 1996 AND 1998
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def typed_filters(spark, sf_dir):
    filters = [("o_orderstatus", "in", ["F", "P"]), ("o_totalprice", "between", 50000, 90000), ("o_orderpriority", "like", "HIGH")]
    rows = Tables(spark, sf_dir).orders.where(search.typed(filters) & search.in_years(F.col("o_orderdate"), 1996, 1998))
    return search.page(rows, F.col("o_totalprice").desc(), F.col("o_orderkey"), limit=500).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P'
ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 20 OFFSET 40
""")
def review_page(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.where("o_orderstatus = 'P'")
    return search.page_with_total(rows, F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderkey"), number=3, size=20).select("o_orderkey", "o_custkey", "total")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality > 0 OR quality IS NULL")
def quality_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(search.public(F.col("quality"))).select("doc_id", "quality")


@query("""
WITH v AS (SELECT * FROM (VALUES ('rubro', 'red'), ('rubro', 'rubro'), ('anel', 'ring'), ('anel', 'anel'), ('anel', 'annel'), ('green', 'green')) t(query, variant))
SELECT DISTINCT v.query, p_partkey FROM part JOIN v ON contains(lower(p_name), v.variant) OR contains(lower(p_type), v.variant)
""")
def variant_search(spark, sf_dir):
    clusters = values(spark, [(k, n) for k, pair in enumerate(CLUSTERS[:3] + CLUSTERS[4:]) for n in pair] + [(2, "anel")], "cluster", "name")
    queries = values(spark, [("rubro",), ("anel",), ("green",)], "query")
    return search.variant_search(Tables(spark, sf_dir).part, "p_partkey", ["p_name", "p_type"], queries, names.variant_table(clusters))


@query("""
WITH q AS (SELECT * FROM (VALUES ('widget'), ('phing'), ('rynG'), ('zzz')) t(query)),
d AS (SELECT query, p_name AS "match", 'direct' AS how FROM part JOIN q ON contains(lower(p_name), lower(query))),
f AS (SELECT query, replace(replace(replace(replace(replace(lower(query), 'ph', 'f'), 'y', 'i'), 'w', 'v'), 'ck', 'k'), 'th', 't') AS fold FROM q WHERE query NOT IN (SELECT query FROM d))
SELECT * FROM d UNION ALL
SELECT query, p_name, 'folded' FROM part JOIN f ON contains(replace(replace(replace(replace(replace(lower(p_name), 'ph', 'f'), 'y', 'i'), 'w', 'v'), 'ck', 'k'), 'th', 't'), fold)
""")
def zero_hit_fallback(spark, sf_dir):
    queries = values(spark, [("widget",), ("phing",), ("rynG",), ("zzz",)], "query")
    return search.with_fallback(Tables(spark, sf_dir).part, "p_name", queries)


@query("SELECT c_custkey, min(year(o_orderdate))::INTEGER AS y1, max(year(o_orderdate))::INTEGER AS y2 FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING min(year(o_orderdate)) <= 1997 AND max(year(o_orderdate)) >= 1996")
def books_overlapping_years(spark, sf_dir):
    t = Tables(spark, sf_dir)
    years = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate")).alias("y1"), F.max(F.year("o_orderdate")).alias("y2"))
    span = F.coalesce("y1", F.lit(1500)) <= 1997
    return years.join(t.customer.select("c_custkey"), "c_custkey", "left_semi").where(span & (F.coalesce("y2", F.lit(2025)) >= 1996))


@query("""
WITH q AS (SELECT lower(trim(text)) AS query, max(conv_id * 100 + turn) AS ts FROM conversations WHERE role = 'user' GROUP BY 1),
r AS (SELECT * FROM q ORDER BY ts DESC, query LIMIT 1000),
u AS (SELECT query, 0 AS rank, -ts AS age FROM r WHERE starts_with(query, 'th') UNION ALL SELECT * FROM (VALUES ('Thomas', 1, 0), ('theresa', 1, 0)) f(query, rank, age))
SELECT query FROM (SELECT query, min((rank, age)) AS k FROM u GROUP BY query) ORDER BY k, query LIMIT 10
""")
def prefix_suggestions(spark, sf_dir):
    log = Tables(spark, sf_dir).conversations.where("role = 'user'").select(F.col("text").alias("query"), (F.col("conv_id") * 100 + F.col("turn")).alias("ts"))
    return search.suggestions(log, "Th", ["Thomas", "theresa", "Manuel"])


# Joins


@query("""
WITH a AS (SELECT s_suppkey, n_name AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0),
b AS (SELECT s_suppkey, r_name AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a))
SELECT coalesce(place, 'Outras') AS place, count(*) AS n FROM lineitem LEFT JOIN m ON s_suppkey = l_suppkey AND s_suppkey % 7 <> 0 GROUP BY 1
""")
def map_with_precedence(spark, sf_dir):
    """File to place: the finer map first, the coarser fills its gaps, a default for the rest."""
    t = Tables(spark, sf_dir)
    own = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    fine = own.where("s_acctbal > 0").select("s_suppkey", F.col("n_name").alias("place"))
    coarse = own.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("place"))
    places = repair.by_precedence(fine, coarse, "s_suppkey", "place").where("s_suppkey % 7 <> 0")
    rows = t.lineitem.join(places, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.groupBy(F.coalesce("place", F.lit("Outras")).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(p_type, 'DEAT') AS kind, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 25 GROUP BY 1")
def type_default_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.lineitem.select("l_partkey").join(t.part.where("p_size < 25").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.groupBy(F.coalesce("p_type", F.lit("DEAT")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_yet_done(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) = count(*) FILTER (o_orderstatus = 'F')")
def complete_groups(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return rows.where("n = done").drop("done")


@query("""
WITH c AS (SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0 GROUP BY 1, 2),
one AS (SELECT n_name, any_value(n) AS n FROM c GROUP BY 1 HAVING count(DISTINCT n_regionkey) = 1)
SELECT s_suppkey, coalesce(c.n, one.n, 0) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN c ON c.n_name = nation.n_name AND c.n_regionkey = CASE WHEN s_suppkey % 2 = 0 THEN nation.n_regionkey END LEFT JOIN one ON one.n_name = nation.n_name
""")
def lookup_with_fallback_key(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.customer.where("c_custkey % 3 = 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))
    one = c.groupBy("n_name").agg(F.first("n").alias("n1"), F.count_distinct("n_regionkey").alias("k")).where("k = 1").drop("k")
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("n_regionkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("n_regionkey"))).select("s_suppkey", "n_name", "n_regionkey")
    return rows.join(c, ["n_regionkey", "n_name"], "left").join(one, "n_name", "left").select("s_suppkey", F.coalesce("n", "n1", F.lit(0)).alias("n"))


@query("""
SELECT f.o_orderkey AS first_id, min((year(p.o_orderdate), p.o_orderkey))[2] AS later_id
FROM orders f JOIN orders p ON f.o_custkey = p.o_custkey AND f.o_orderstatus = 'F' AND p.o_orderstatus = 'P' AND year(p.o_orderdate) >= year(f.o_orderdate) + 1 GROUP BY 1
""".replace("min((year(p.o_orderdate), p.o_orderkey))[2]", "arg_min(p.o_orderkey, (year(p.o_orderdate), p.o_orderkey))"))
def linkage_year_range(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), "o_custkey", "o_orderstatus")
    return family.linked_in_time(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'"), "o_custkey")


@query("""
WITH p AS (SELECT p_partkey AS id, p_name AS name FROM part), n AS (SELECT DISTINCT p_partkey AS id, string_split(p_name, ' ')[-1] AS w FROM part),
j AS (SELECT n.id AS needle_id, p.id AS text_id, row_number() OVER (PARTITION BY n.id ORDER BY p.id) AS k FROM n JOIN p ON contains(p.name, n.w) AND p.id <> n.id WHERE length(n.w) >= 3)
SELECT needle_id, text_id FROM j WHERE k <= 20
""")
def substring_children(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    needles = part.select(F.col("p_partkey").alias("needle_id"), F.element_at(F.split("p_name", " "), -1).alias("needle"))
    return family.containing(needles, part.select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("text")), 20)


@query("""
WITH y AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment, min(year(o_orderdate) * 12 + month(o_orderdate)) AS m FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
j AS (SELECT a.id, b.id AS other, b.m - a.m AS d FROM y a JOIN y b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.id <> b.id)
SELECT id, other, CASE WHEN d >= 15 THEN 'child' WHEN d <= -15 THEN 'parent' ELSE 'sibling' END AS relation FROM j WHERE d >= 15 OR d <= -15 OR abs(d) <= 5
""")
def relation_by_years(spark, sf_dir):
    """Relations among the customers of a nation and segment by the months between first orders."""
    t = Tables(spark, sf_dir)
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("year"))
    people = t.customer.join(first, "c_custkey").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment", "year")
    return family.relations_by_years(people, people, ["c_nationkey", "c_mktsegment"])


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber), '') AS sources FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def sources_list(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("s"))
    return t.orders.select("o_orderkey").join(lists, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.array_join("s", ","), F.lit("")).alias("sources"))


@query("""
SELECT event_id, rule_id FROM events JOIN (VALUES (1, 'purchase', 20.0, NULL, NULL), (2, NULL, 90.0, NULL, NULL), (3, 'error', NULL, DATE '2024-01-01', DATE '2024-01-03')) r(rule_id, kind, least, day_from, day_to)
ON (kind IS NULL OR event_type = kind) AND (least IS NULL OR value >= least) AND (day_from IS NULL OR CAST(ts AS DATE) >= day_from) AND (day_to IS NULL OR CAST(ts AS DATE) <= day_to)
""")
def alert_match(spark, sf_dir):
    return stream.alerts(Tables(spark, sf_dir).events, _rules(spark))


def _rules(spark):
    rows = [(1, "purchase", 20.0, None, None), (2, None, 90.0, None, None), (3, "error", None, "2024-01-01", "2024-01-03")]
    return values(spark, rows, "rule_id", "kind", "least", "a", "b").select("rule_id", "kind", "least", F.to_date("a").alias("day_from"), F.to_date("b").alias("day_to"))


# Repair and review


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_keep_first(spark, sf_dir):
    return repair.first_of_each(Tables(spark, sf_dir).documents.select("doc_id", F.sha2("text", 256).alias("digest")), ["digest"], "doc_id").select("doc_id")


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)")
def duplicate_groups(spark, sf_dir):
    return repair.duplicate_report(Tables(spark, sf_dir).documents, ["text", "lang"])


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE)::VARCHAR ELSE '' END AS before,
       CAST(l_shipdate AS DATE)::VARCHAR AS after FROM lineitem
""")
def gap_fill(spark, sf_dir):
    """Blanked dates filled from the matching line of a second copy."""
    rows = Tables(spark, sf_dir).lineitem.withColumn("full", F.to_date("l_shipdate").cast("string"))
    blank = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("full")).otherwise("").alias("d"))
    patch = rows.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("full").alias("d"))
    out = repair.filled(blank.withColumn("before", F.col("d")), patch, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["d"])
    return out.select("l_orderkey", "l_linenumber", "before", F.col("d").alias("after"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS own, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) OVER w AS f, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, f AS wrong, own AS repaired FROM l WHERE n > 1 AND own <> f AND l_linenumber % 3 = 0
""".replace("arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) OVER w", "first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"))
def misfill_repair(spark, sf_dir):
    """Every third line carries line 1's flag; those whose own flag is another are found and mended."""
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("own")).withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    first = F.min_by("own", "at").over(Window.partitionBy("l_orderkey"))
    spoilt = rows.withColumn("value", F.when(F.col("l_linenumber") % 3 == 0, first).otherwise(F.col("own")))
    return repair.contaminated(spoilt, "l_orderkey", "at", "value", "own").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("value").alias("wrong"), "repaired")


@query("""
WITH g AS (SELECT o_custkey, o_orderdate::DATE AS d, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS x FROM orders),
c AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY o_custkey ORDER BY x) > 200 THEN 1 ELSE 0 END AS cut FROM g),
r AS (SELECT *, sum(cut) OVER (PARTITION BY o_custkey ORDER BY x) AS run FROM c)
SELECT o_custkey, CAST(run AS BIGINT) AS run, count(*) AS size, CAST(min(x) AS INTEGER) AS "first", CAST(max(x) AS INTEGER) AS "last" FROM r GROUP BY o_custkey, run HAVING count(*) >= 2
""")
def gap_groups(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select("o_custkey", F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("x"))
    return family.gap_groups(rows, "o_custkey", "x", 200)


@query("""
WITH d AS (SELECT conv_id, arg_max(role, turn) AS action, max(turn) AS turns FROM conversations GROUP BY conv_id)
SELECT o_orderkey, action IS NOT NULL AS validado, CASE WHEN action = 'assistant' THEN 1.0::DOUBLE WHEN action IS NOT NULL THEN 0.0::DOUBLE END AS qualidade
FROM orders LEFT JOIN d ON conv_id = o_orderkey
""")
def latest_decision(spark, sf_dir):
    """The last turn of conversation N decides order N: an assistant's approves, others reject."""
    t = Tables(spark, sf_dir)
    log = t.conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("at"), F.when(F.col("role") == "assistant", "approve").otherwise("reject").alias("action"))
    records = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("boolean").alias("validado"), F.lit(None).cast("double").alias("qualidade"))
    return review.decided(records, log).select(F.col("id").alias("o_orderkey"), "validado", "qualidade")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1 - 8 * l_discount, 6) AS qualidade FROM lineitem WHERE 1 - 8 * l_discount < 0.4 ORDER BY round(1 - 8 * l_discount, 6), l_orderkey, l_linenumber, l_partkey LIMIT 50")
def suspicious_rows(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(1 - 8 * F.col("l_discount"), 6).alias("qualidade"))
    return review.suspicious(rows.withColumn("id", F.struct("l_orderkey", "l_linenumber", "l_partkey"))).drop("id")


@query("SELECT conv_id, text AS nome FROM conversations WHERE turn = 0 AND trim(text) <> '' ORDER BY regexp_matches(lower(text), 'ileg|\\?\\?|desconhecid'), conv_id DESC LIMIT 1")
def validation_queue(spark, sf_dir):
    rows = Tables(spark, sf_dir).conversations.where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("nome"), F.lit(None).cast("boolean").alias("validado"))
    return review.next_to_validate(rows).select(F.col("id").alias("conv_id"), "nome")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'aprovado' ELSE o_orderstatus END AS status, o_orderstatus = 'P' AS changed FROM orders")
def bulk_approval(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pendente").otherwise(F.col("o_orderstatus")).alias("status"))
    return review.bulk_approved(rows)


@query("""
SELECT c_custkey, left(c_name, 4) || repeat('*', greatest(length(c_name) - 8, 0)) || right(c_name, 4) AS masked FROM customer
""")
def mask_values(spark, sf_dir):
    return Tables(spark, sf_dir).customer.select("c_custkey", export.masked(F.col("c_name")).alias("masked"))


# Names, dates, text


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS word FROM documents UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part)
SELECT word, regexp_replace(lower(strip_accents(word)), '[^a-z0-9]', '', 'g') AS "key" FROM w
""")
def name_keys(spark, sf_dir):
    return _words(Tables(spark, sf_dir)).select("word", names.token_key(F.col("word")).alias("key"))


def _words(t):
    heads = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))
    return heads.union(t.part.select(F.explode(F.split("p_name", " ")).alias("word"))).distinct()


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS word FROM documents UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part),
u AS (SELECT word, regexp_replace(upper(strip_accents(replace(word, 'ß', 'ss'))), '[^A-Z]', '', 'g') AS t FROM w),
f AS (SELECT word, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, 'PH', 'F'), 'TH', 'T'), 'RH', 'R'), 'Y', 'I'), 'W', 'V'), 'LH', 'L'), 'NH', 'N'), 'CH', 'X'), 'SC', 'S'), 'XC', 'S') AS t FROM u),
d AS (SELECT word, t, translate(t, 'BFPVCGJKQSXZDTLMNRAEIOUH', '111122222222334556000000') AS s FROM f),
c AS (SELECT word, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS s FROM d)
SELECT code, count(*) AS words, min(word) AS "first" FROM (SELECT word, CASE WHEN t = '' THEN '0000' ELSE left(t[1] || replace(s[2:], '0', '') || '000', 4) END AS code FROM c) GROUP BY code
""")
def phonetic_blocks(spark, sf_dir):
    words = _words(Tables(spark, sf_dir)).select("word", names.phonetic_code(F.col("word")).alias("code"))
    return words.groupBy("code").agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("first"))


@query("""
SELECT p_partkey, array_to_string(list_slice(string_split(p_name, ' '), 1, -2), ' ') AS nome, string_split(p_name, ' ')[-1] AS sobrenome FROM part
""")
def name_split(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", names.given_name(F.concat(F.lit("Dom "), F.col("p_name"))).alias("nome"), names.surname(F.col("p_name")).alias("sobrenome"))


MONTH_NAMES = tuple(list(dates.MONTHS)[:12])


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d1, CAST(o_orderdate AS DATE) AS d2, CAST(o_orderdate AS DATE) AS d3, CAST(o_orderdate AS DATE) AS d4 FROM orders")
def date_text_roundtrip(spark, sf_dir):
    """Order dates written in four ways and read back."""
    d = F.to_date("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(d))
    by_value = lambda table: F.create_map(*[F.lit(x) for v, w in {v: w for w, v in reversed(table.items())}.items() for x in (v, w)])
    days, years = by_value(dates.DAYS), by_value(dates.YEARS)
    n = F.dayofmonth(d)
    tens = F.when(n > 30, "trinta e um").when((n > 20) & (n < 30), F.concat(F.lit("vinte e "), days[n - 20])).otherwise(days[n])
    y = F.year(d)
    low = y % 100
    small = F.when(low == 0, "").when(low <= 20, F.concat(F.lit(" e "), F.coalesce(years[low], F.lit("")))).otherwise(F.concat(F.lit(" e "), years[low - low % 10], F.when(low % 10 == 0, "").otherwise(F.concat(F.lit(" e "), years[low % 10]))))
    big = F.when(y < 2000, F.concat(F.lit("mil novecentos"), small)).otherwise(F.concat(F.lit("mil mil"), small))
    texts = {
        "d1": F.date_format(d, "yyyy-M-d"),
        "d2": F.date_format(d, "dd/MM/yyyy"),
        "d3": F.concat(F.lit("Assento de "), n.cast("string"), F.lit(" de "), month, F.lit(" de "), y.cast("string"), F.lit(", nesta vila")),
        "d4": F.concat(F.lit("Aos "), tens, F.lit(" dias do mes de "), month, F.lit(" de "), big, F.lit(" annos faleceu")),
    }
    return Tables(spark, sf_dir).orders.select("o_orderkey", *[dates.strict_date(t).alias(k) for k, t in texts.items()])


@query("""
SELECT p_partkey, p_size::INTEGER AS idade, p_name AS naturalidade, p_partkey::VARCHAR AS numero_assento, CASE WHEN p_size % 2 = 0 THEN 'fez testamento' ELSE 'não fez testamento' END AS testamento,
       CASE WHEN p_size % 3 = 0 THEN 'lavrador' END AS profissao FROM part
""")
def details_from_phrase(spark, sf_dir):
    """Details of a death written into a phrase and read back."""
    c = F.col
    phrase = F.concat(
        F.lit("Assento n.º "), c("p_partkey").cast("string"), F.lit(". Faleceu com "), c("p_size").cast("string"), F.lit(" annos, natural da "), c("p_name"),
        F.when(c("p_size") % 3 == 0, ", Lavrador").otherwise(""), F.when(c("p_size") % 2 == 0, ", fez testamento.").otherwise(", não fez testamento."),
    )
    return Tables(spark, sf_dir).part.select("p_partkey", text.death_details(phrase).alias("d")).select("p_partkey", "d.idade", "d.naturalidade", "d.numero_assento", "d.testamento", "d.profissao")


_HITS = " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in text.DEATH_WORDS)


@query(f"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(text) < 50 THEN 'too_short' WHEN {_HITS} < 2 THEN 'no_death_keywords'
  WHEN NOT regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_])[A-ZÀ-Ú][a-zà-ú]+(?:\\s+de\\s+[A-ZÀ-Ú][a-zà-ú]+)+') THEN 'no_valid_name'
  WHEN length(regexp_replace(text, '[a-zA-ZÀ-Úà-ú\\s.,;:-]', '', 'g'))::DOUBLE / length(text) > 0.15 THEN 'garbled_text' ELSE 'valid' END AS reason FROM documents) GROUP BY 1
""")
def page_validity(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select(text.page_reason(F.col("text")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(floor(length(regexp_replace(text, '[a-zA-ZÀ-Úà-ú\\s.,;:-]', '', 'g'))::DOUBLE / greatest(length(text), 1) * 20) AS BIGINT) AS bucket, count(*) AS n FROM documents GROUP BY 1")
def special_char_ratio(spark, sf_dir):
    return Tables(spark, sf_dir).documents.groupBy(F.floor(text.special_share(F.col("text")) * 20).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-ZÀ-Ú][a-zà-ú]+ [A-ZÀ-Ú][a-zà-ú]+'))), ';') AS names, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ';') AS numbers FROM documents
""")
def text_entities(spark, sf_dir):
    rows = Tables(spark, sf_dir).documents.select("doc_id", text.entities(F.col("text")).alias("e"))
    return rows.select("doc_id", F.array_join("e.names", ";").alias("names"), F.array_join("e.numbers", ";").alias("numbers"))


_MONTH = "MAP {" + ", ".join(f"'{m}': {n}" for m, n in dates.MONTHS.items()) + "}"
_NAME = "[A-ZÀ-Ú][a-zà-ú]+"


def _day(pattern: str, y: int, m: int, d: int, month: str = "CAST(@ AS INTEGER)") -> str:
    """SQL for the date that the groups of a pattern tell of l.low, null if it is none."""
    part = lambda k: f"nullif(regexp_extract(low, '{pattern}', {k}), '')"
    return f"CASE WHEN CAST({part(y)} AS INTEGER) BETWEEN 1500 AND 2025 THEN try_cast({part(y)} || '-' || {month.replace('@', part(m))} || '-' || {part(d)} AS DATE) END"


@query(f"""
WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
k AS (SELECT id, CAST(line_no AS INTEGER) AS line_no, trim(line) AS line, lower(trim(line)) AS low FROM l WHERE trim(line) <> ''),
r AS (SELECT id, line_no, list_filter(list_distinct(regexp_extract_all(line, '{_NAME}(?:\\s+(?:de\\s+|da\\s+|do\\s+)?{_NAME})+')), lambda x: length(x) BETWEEN 4 AND 99) AS names,
  coalesce({_day("([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", 1, 2, 3)}, {_day("([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", 3, 2, 1)},
    {_day("([0-9]{1,2})[[:space:]]+de[[:space:]]+([0-9_[:alpha:]à-ÿ]+)[[:space:]]+de[[:space:]]+([0-9]{4})", 3, 2, 1, "coalesce(" + _MONTH + "[@], 1)")}) AS date,
  nullif(regexp_extract(line, '(?i)(?:n[.º°]*|assento|registo)\\s*([0-9]+)', 1), '') AS number FROM k)
SELECT id, line_no, unnest(names) AS name, date, number FROM r UNION ALL SELECT id, line_no, NULL, date, number FROM r WHERE len(names) = 0 AND date IS NOT NULL AND number IS NOT NULL
""")
def line_records(spark, sf_dir):
    """The names, dates and numbers of every line of every document."""
    rows = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), "text")
    return text.generic_lines(rows, "id")


@query("""
WITH h AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, title, CAST(i - 1 AS INTEGER) AS at, l[i] AS href FROM (SELECT page_id, title, l, unnest(range(1, len(l) + 1)) AS i FROM h)
""")
def html_links(spark, sf_dir):
    return pages.html_links(Tables(spark, sf_dir).pages)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 5 = 0 THEN 'already_ok' WHEN event_id % 5 = 1 THEN 'unparseable' ELSE 'reparsed' END AS status FROM events".replace("CAST(json_extract(props, '$.k') AS BIGINT) AS k", "CASE WHEN event_id % 5 > 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k"))
def json_recovery(spark, sf_dir):
    """Objects wrapped in chatter; every fifth was parsed before, every fifth is spoilt."""
    props = F.when(F.col("event_id") % 5 == 1, F.translate("props", "}", "")).otherwise(F.col("props"))
    rows = Tables(spark, sf_dir).events.select("event_id", F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nDone.")).alias("raw_text"), (F.col("event_id") % 5 == 0).alias("parsed_ok"))
    return pages.reparsed(rows, "k bigint").select("event_id", "parsed.k", "status")


# Exports, families, similarity


@query("""
WITH f AS (SELECT c_custkey, c_name, min(o_orderdate)::DATE AS d FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY d, c_name) AS number, c_custkey, d FROM f
""")
def numbered_export(spark, sf_dir):
    return export.numbered(_first_orders(spark, sf_dir).select("c_custkey", "c_name", "d"), F.col("d"), F.col("c_name")).select(F.col("number").cast("long").alias("number"), "c_custkey", "d")


def _first_orders(spark, sf_dir):
    t = Tables(spark, sf_dir)
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.to_date("o_orderdate")).alias("d"))
    return t.customer.join(first, "c_custkey")


@query("""
WITH f AS (SELECT c_custkey, c_mktsegment, min(o_orderdate)::DATE AS d FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
l AS (SELECT c_custkey AS number, unnest(['0 @I' || c_custkey || '@ INDI', '1 NAME Ana /da ' || c_mktsegment || '/', '1 DEAT', '2 DATE ' || day(d) || ' ' || upper(strftime(d, '%b')) || ' ' || year(d), '1 NOTE Pág. ' || c_custkey || ' | Livro: ' || c_mktsegment]) AS line FROM f)
SELECT * FROM l
""")
def gedcom_lines(spark, sf_dir):
    people = _first_orders(spark, sf_dir).select(
        F.col("c_custkey").alias("number"), F.concat(F.lit("D. Ana da "), F.col("c_mktsegment")).alias("name"), F.col("d").alias("death"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("string").alias("source"),
        F.col("c_custkey").alias("page"), F.col("c_mktsegment").alias("book"),
    )
    return export.gedcom_blocks(people).select("number", "line")


@query("""
WITH u AS (SELECT n_name AS name, 'place' AS role FROM nation UNION ALL SELECT c_name, 'person' FROM customer UNION ALL SELECT s_name, 'book' FROM supplier) SELECT role, count(*) AS n, min(name) AS "first" FROM u GROUP BY role
""")
def tri_union_roles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    parts = [t.nation.select(F.col("n_name").alias("name"), F.lit("place").alias("role")), t.customer.select(F.col("c_name").alias("name"), F.lit("person").alias("role")), t.supplier.select(F.col("s_name").alias("name"), F.lit("book").alias("role"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


@query("""
WITH e AS (SELECT n_name AS parent, c_name AS child, 'father' AS type FROM customer JOIN nation ON n_nationkey = c_nationkey),
n AS (SELECT c_name AS name, c_custkey AS id, FALSE AS stub FROM customer UNION ALL SELECT DISTINCT parent, NULL, TRUE FROM e)
SELECT 'node' AS kind, name AS a, id::VARCHAR AS b, stub::VARCHAR AS c FROM n UNION ALL SELECT 'edge', parent, child, type FROM e
""")
def family_edges(spark, sf_dir):
    t = Tables(spark, sf_dir)
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"), F.col("n_name").alias("pai"), F.lit(None).cast("string").alias("mae"))
    nodes, links = family.edges(people)
    return nodes.select(F.lit("node").alias("kind"), F.col("name").alias("a"), F.col("id").cast("string").alias("b"), F.col("stub").cast("string").alias("c")).union(links.select(F.lit("edge"), "parent", "child", "type"))


@query("""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS id, e.vec_id AS other, q.label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM s)
SELECT id, other, round(sim, 4) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 5
""")
def similar_top_k(spark, sf_dir):
    """The five most similar of the same label, for every vector whose id is divisible by 20, against all."""
    rows = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    return family.most_similar(rows.where("id % 20 = 0"), rows, 5).withColumn("similarity", F.round("similarity", 4))


# Incremental jobs: a streaming run over the given tables, read back


def _scratch(spark, name):
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _events_stream(spark, sf_dir):
    schema = Tables(spark, sf_dir).events.schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_ingest_counts(spark, sf_dir):
    """Events ingested twice through the idempotent sink, then counted: the second run adds nothing."""
    target = _scratch(spark, "ingest")
    for run in (1, 2):
        stream.ingest(_events_stream(spark, sf_dir), f"{target}/rows", f"{target}/checkpoint{run}", ["event_id"]).awaitTermination()
    return stream.counts(spark.read.parquet(f"{target}/rows"), "event_type")


def _collected(spark, rows, name, mode="append"):
    target = _scratch(spark, name)
    rows.writeStream.outputMode(mode).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{target}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{target}/rows")


@query("""
SELECT event_id, rule_id FROM events JOIN (VALUES (1, 'purchase', 20.0, NULL, NULL), (2, NULL, 90.0, NULL, NULL), (3, 'error', NULL, DATE '2024-01-01', DATE '2024-01-03')) r(rule_id, kind, least, day_from, day_to)
ON (kind IS NULL OR event_type = kind) AND (least IS NULL OR value >= least) AND (day_from IS NULL OR CAST(ts AS DATE) >= day_from) AND (day_to IS NULL OR CAST(ts AS DATE) <= day_to)
""")
def stream_alerts(spark, sf_dir):
    return _collected(spark, stream.alerts(_events_stream(spark, sf_dir), _rules(spark)), "alerts")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 45 MINUTE THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 45 MINUTE AS "end", count(*) AS n FROM r GROUP BY user_id, run)
SELECT user_id, start, "end", n FROM s WHERE "end" <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)
""")
def stream_sessions(spark, sf_dir):
    """Sessions that closed an hour before the last event; later ones stay in the stream's state."""
    return _collected(spark, stream.sessions(_events_stream(spark, sf_dir), "user_id", "ts"), "sessions")


@query("""
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events
GROUP BY 1, 2 HAVING time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)
""")
def stream_bucketed_counts(spark, sf_dir):
    """Buckets that closed ten minutes before the last event."""
    return _collected(spark, stream.bucketed_counts(_events_stream(spark, sf_dir), "ts", "10 minutes", "10 minutes", "event_type"), "buckets")
