"""Lookups, lists and pages of the registers, the review of books, and quotas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regista.functions import names, text
from regista.operators import family, review, search, statistics
from regista.plans.registry import Tables, query


def _people(t):
    """Customers as people: their first order is the birth, the last the death; every fourth has no death, every tenth no date."""
    first = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("z"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"), F.col("n_name").alias("freguesia"), F.col("c_mktsegment").alias("tipo_registo"))
    return rows.join(first, "id", "left").select("*", F.when(F.col("id") % 4 != 0, F.col("z")).alias("data_obito"), F.when(F.col("id") % 10 != 0, F.col("a")).alias("data_nascimento"), F.lit(None).cast("date").alias("data_casamento"))


_PEOPLE = """
WITH f AS (SELECT o_custkey AS id, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS id, c_name AS nome, n_name AS freguesia, c_mktsegment AS tipo_registo, CASE WHEN c_custkey % 4 <> 0 THEN z END AS data_obito, CASE WHEN c_custkey % 10 <> 0 THEN a END AS data_nascimento
      FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN f ON f.id = c_custkey)
"""


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE contains(lower(n_name), 'nation_1') AND contains(lower(s_name), '00')")
def place_and_surname_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.where(search.all_contain({"n_name": "ilike.%NATION_1%", "s_name": "00", "s_acctbal": None})).select("s_suppkey", "s_name", "n_name")


@query("""
SELECT c_custkey AS id, c_name AS nome, s_name AS conjuge, n_name AS freguesia, o_orderdate::DATE AS data, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier)
WHERE (contains(lower(c_name), '11') OR contains(lower(s_name), '11') OR contains(lower(o_orderpriority), '11')) AND contains(lower(n_name), 'nation_2') AND year(o_orderdate) BETWEEN 1995 AND 1998
ORDER BY o_orderkey DESC LIMIT 100
""")
def marriage_search(spark, sf_dir):
    """Orders as marriages: the customer, a supplier as spouse, the priority as witnesses."""
    t = Tables(spark, sf_dir)
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    spouse = t.supplier.select("s_suppkey", "s_name")
    rows = rows.withColumn("s_suppkey", F.col("o_orderkey") % F.lit(spouse.count())).join(spouse, "s_suppkey")
    rows = rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("nome"), F.col("s_name").alias("conjuge"), F.col("o_orderpriority").alias("testemunhas"), F.col("n_name").alias("freguesia"), F.to_date("o_orderdate").alias("data"), "c_custkey")
    found = search.marriages(rows, "11", "Nation_2", 1995, 1998)
    return found.select(F.col("c_custkey").alias("id"), "nome", "conjuge", "freguesia", "data", F.col("id").alias("o_orderkey"))


@query(_PEOPLE + "SELECT id, nome, tipo_registo, data_obito FROM p WHERE contains(lower(nome), '#0000000') AND tipo_registo = 'BUILDING'")
def names_by_date(spark, sf_dir):
    return search.by_date(_people(Tables(spark, sf_dir)), "#0000000", "data_obito", "BUILDING").select("id", "nome", "tipo_registo", "data_obito")


@query(_PEOPLE + "SELECT id, nome, data_obito AS data FROM p WHERE freguesia = 'NATION_7'")
def place_page(spark, sf_dir):
    rows = _people(Tables(spark, sf_dir)).withColumn("data", F.col("data_obito"))
    return search.of_place(rows, "NATION_7").select("id", "nome", "data")


@query("SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 17")
def person_by_id(spark, sf_dir):
    return search.by_id(Tables(spark, sf_dir).customer.withColumnRenamed("c_custkey", "id"), 17)


@query(_PEOPLE + "SELECT id, nome, coalesce(data_obito, data_nascimento) AS quando FROM p WHERE freguesia = 'NATION_3' AND contains(lower(nome), '1') AND year(coalesce(data_obito, data_nascimento)) BETWEEN 1996 AND 1999")
def tree_node_filter(spark, sf_dir):
    return search.tree_nodes(_people(Tables(spark, sf_dir)), "NATION_3", "1", 1996, 1999).select("id", "nome", "quando")


@query("SELECT page_id, url, nullif(regexp_extract(url, '([0-9]+)(?:[/?#]|$)', 1), '') AS document FROM pages WHERE contains(lower(regexp_extract(url, '//([^/]+)', 1)), 'th')")
def inventory_filter(spark, sf_dir):
    """The host of a page stands for the place."""
    rows = Tables(spark, sf_dir).pages.select("page_id", "url", F.regexp_extract("url", "//([^/]+)", 1).alias("place"))
    return search.inventory_of(rows, "TH").select("page_id", "url", "document")


@query("SELECT DISTINCT p_name AS name FROM part WHERE contains(p_name, 'ri') ORDER BY name LIMIT 50")
def name_list(spark, sf_dir):
    return search.listed(Tables(spark, sf_dir).part.select(F.col("p_name").alias("name")).distinct(), "ri")


@query("""
WITH s AS (SELECT q.vec_id AS id, e.vec_id AS other, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS k FROM s),
p AS (SELECT vec_id AS id, vec_id % 7 AS surname, CASE WHEN vec_id % 3 > 0 THEN vec_id % 3 END AS place, 1800 + vec_id % 40 AS year FROM embeddings)
SELECT r.id, r.other, a.surname = b.surname AS same_surname, coalesce(a.place = b.place, FALSE) AS same_place, abs(a.year - b.year) <= 10 AS near_in_time
FROM r JOIN p a ON a.id = r.id JOIN p b ON b.id = r.other WHERE k <= 50
""")
def potential_relatives(spark, sf_dir):
    """Flags on the 50 most similar vectors of every vector; surname, place and year follow from the ids."""
    rows = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    similar = family.most_similar(rows, rows, 50).select("id", "other")
    people = rows.select("id", (F.col("id") % 7).alias("surname"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("place"), (1800 + F.col("id") % 40).alias("year"))
    return family.potential_relatives(similar, people)


@query("SELECT s_suppkey AS book_id, n_nationkey AS place_id, n_name AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def books_with_place(spark, sf_dir):
    t = Tables(spark, sf_dir)
    books = t.supplier.select(F.col("s_suppkey").alias("book_id"), F.col("s_nationkey").alias("place_id"))
    return family.books_with_place(books, t.nation.select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("place")))


@query("SELECT l_orderkey AS id, l_linenumber AS line_no, l_partkey, l_quantity / 50 AS quality FROM lineitem WHERE l_quantity / 50 >= 0.9")
def best_lines(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line_no"), "l_partkey", (F.col("l_quantity") / 50).alias("quality"))
    return search.best_lines(rows, 0.9)


@query("SELECT n_name AS name, count(s_suppkey) AS n, row_number() OVER (ORDER BY count(s_suppkey), n_name) AS up, row_number() OVER (ORDER BY count(s_suppkey) DESC, n_name) AS down FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def order_by_count(spark, sf_dir):
    """Nations by the number of their rich suppliers, in both directions; the place in each order stands beside them. One row for each nation."""
    t = Tables(spark, sf_dir)
    counts = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = t.nation.join(counts, "n_nationkey", "left").select(F.col("n_name").alias("name"), "n")
    place = lambda up: search.by_count(rows, "n", up).withColumn("k", F.row_number().over(Window.orderBy(F.col("n").asc() if up else F.col("n").desc(), "name")).cast("long"))  # noqa: E731  n_nations rows
    return place(True).withColumnRenamed("k", "up").join(place(False).select("name", F.col("k").alias("down")), "name")


@query("""
WITH b AS (SELECT s_suppkey AS id, s_acctbal > 0 AS marcado, FALSE AS processado FROM supplier),
c AS (SELECT l_suppkey AS id, arg_max(l_returnflag = 'R', l_orderkey * 10 + l_linenumber) FILTER (l_returnflag <> 'N') AS processado FROM lineitem GROUP BY 1)
SELECT count(*) AS books, count(*) FILTER (marcado) AS marked, count(*) FILTER (coalesce(c.processado, b.processado)) AS processed FROM b LEFT JOIN c USING (id)
""")
def book_list_update(spark, sf_dir):
    """Suppliers as books: their last line item that is not 'N' says whether they are processed, of several with one order and line number the first in the table; then the counts."""
    t = Tables(spark, sf_dir)
    books = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("marcado"), F.lit(False).alias("processado"))
    at = F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), -F.col("_metadata.row_index"))
    changes = t.lineitem.select(F.col("l_suppkey").alias("id"), at.alias("at"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("processado"), F.lit("x").alias("s_name"))
    return review.book_counts(review.patched(books, changes))


@query("""
WITH r AS (SELECT o_orderstatus, year(o_orderdate) AS yr, row_number() OVER (PARTITION BY o_orderstatus, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS k, o_orderdate, o_orderkey FROM orders),
s AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM r WHERE k <= 30), last AS (SELECT o_orderdate AS d, o_orderkey AS o FROM s WHERE n = 120)
SELECT o_orderstatus, yr, count(*) FILTER (k <= 30) AS shown, count(*) FILTER (k > 30) AS hidden FROM r, last WHERE (o_orderdate, o_orderkey) >= (d, o) GROUP BY 1, 2
""")
def capped_groups_hidden(spark, sf_dir):
    """Shown and hidden rows of each group, of those met before the overall cap was filled."""
    rows = Tables(spark, sf_dir).orders.withColumn("yr", F.year("o_orderdate"))
    return statistics.hidden_counts(rows, ["o_orderstatus", "yr"], ["o_orderdate", "o_orderkey"], 30, 120)


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}]+')) FROM conversations WHERE role = 'system'),
u AS (SELECT word, regexp_replace(upper(strip_accents(replace(word, 'ß', 'ss'))), '[^A-Z]', '', 'g') AS t FROM w),
f AS (SELECT word, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, 'PH', 'F'), 'TH', 'T'), 'RH', 'R'), 'Y', 'I'), 'W', 'V'), 'LH', 'L'), 'NH', 'N'), 'CH', 'X'), 'SC', 'S'), 'XC', 'S') AS t FROM u),
d AS (SELECT word, t, translate(t, 'BFPVCGJKQSXZDTLMNRAEIOUH', '111122222222334556000000') AS s FROM f),
c AS (SELECT word, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS s FROM d),
k AS (SELECT word, left(t[1] || replace(s[2:], '0', '') || '000', 4) AS code FROM c WHERE t <> '')
SELECT a.word AS "first", b.word AS second, a.code FROM k a JOIN k b ON a.code = b.code AND a.word < b.word
""")
def phonetic_pairs(spark, sf_dir):
    """Pairs of different words, of part names and of the system turns of conversations, with one phonetic code. Pairs are the result, and grow with the square of a code's words: phonetic_blocks has the words of whole texts by their codes."""
    t = Tables(spark, sf_dir)
    turns = t.conversations.where("role = 'system'").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("word")).union(turns).distinct()
    return names.phonetic_pairs(words)


@query("""
WITH j AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY 1), t AS (SELECT date_diff('second', min(ts), max(ts)) AS s, count(*) AS n FROM events),
x AS (SELECT count(*) AS jobs, count(*) FILTER (state = 'purchase') AS done, sum(n) FILTER (state = 'purchase') AS steps, sum(n) AS all_steps FROM j)
SELECT jobs, done, round(100.0::DOUBLE * done / jobs, 4) AS percent, round((jobs - done) * (all_steps::DOUBLE / jobs) / (t.n::DOUBLE / t.s), 4) AS eta_s FROM x, t
""")
def completion_estimate(spark, sf_dir):
    """Jobs are done if their last event is a purchase; the rest takes the mean number of steps at the rate so far."""
    return statistics.completion(Tables(spark, sf_dir).events, "user_id", "event_type", ["ts", "event_id"], "purchase")


@query("""
WITH c AS (SELECT user_id, ts::DATE AS day, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k, event_id, ts FROM events),
r AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, day, bad ORDER BY ts, event_id) AS run FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, bad, run ORDER BY ts, event_id) AS len FROM r),
d AS (SELECT user_id, day, count(*) AS calls, coalesce(max(len) FILTER (bad), 0) AS worst, coalesce(bool_or(bad AND len >= 2 AND k >= 0.8 * 5), FALSE) AS exhausted FROM s GROUP BY 1, 2)
SELECT user_id, day, calls, worst, exhausted FROM d
""")
def quota_exhaustion(spark, sf_dir):
    """Calls of a user and day, the longest run of errors, and whether a second error in a row came at 80 % of a quota of 5 calls or beyond."""
    rows = Tables(spark, sf_dir).events.withColumn("day", F.to_date("ts"))
    return statistics.exhausted(rows, ["user_id", "day"], ["ts", "event_id"], F.col("event_type") == "error", 5)


@query("""
SELECT count(*) FILTER (text <> '' AND length(trim(text)) >= 50 AND regexp_matches(lower(text), 'obito|faleceu|morreu|sepult|enterro') AND regexp_matches(text, '(?:^|[^\\p{L}\\p{N}_])[A-ZÀ-Ú][a-zà-ú]+(?:\\s+de\\s+[A-ZÀ-Ú][a-zà-ú]+)+')
  AND length(regexp_replace(text, '[a-zA-ZÀ-Úà-ú\\s.,;:-]', '', 'g'))::DOUBLE / length(text) <= 0.15) AS good, count(*) AS pages FROM documents
""")
def good_pages(spark, sf_dir):
    rows = Tables(spark, sf_dir).documents
    return rows.agg(F.count_if(text.good_page(F.col("text"))).alias("good"), F.count(F.lit(1)).alias("pages"))


_FOLD = "replace(replace(replace(replace(replace(lower({}), 'ph', 'f'), 'y', 'i'), 'w', 'v'), 'ck', 'k'), 'th', 't')"


@query(f"""
WITH q AS (SELECT * FROM (VALUES ('ring'), ('Vidget'), ('rynG'), ('zzz'), ('e')) t(query)),
p AS (SELECT p_partkey AS id, p_name AS nome FROM part WHERE (p_partkey % 7 = 0 OR p_size % 4 > 0) AND p_size % 10 BETWEEN 2 AND 7 AND p_partkey % 3 = 1 AND contains(lower(p_type), 'e')),
d AS (SELECT query, id, nome, 'direct' AS how FROM p JOIN q ON contains(lower(nome), lower(query))),
f AS (SELECT query, id, nome, 'folded' AS how FROM p JOIN q ON contains({_FOLD.format("nome")}, {_FOLD.format("query")}) WHERE length(query) >= 3 AND query NOT IN (SELECT query FROM d))
SELECT query, id, nome AS "match", how, row_number() OVER (PARTITION BY query ORDER BY id DESC) AS rank FROM (FROM d UNION ALL FROM f) QUALIFY rank <= 20
""")
def people_search(spark, sf_dir):
    """Quality, place, kind, years and the fallback together: the newest twenty parts for each query."""
    c = F.col
    rows = Tables(spark, sf_dir).part.select(
        c("p_partkey").alias("id"), c("p_name").alias("nome"), c("p_type").alias("freguesia"), F.when(c("p_partkey") % 3 == 1, "BIRT").otherwise("DEAT").alias("tipo_registo"),
        F.make_date((c("p_size") % 10 + 1800).cast("int"), F.lit(6), F.lit(1)).alias("data"), F.when(c("p_partkey") % 7 > 0, (c("p_size") % 4).cast("double")).alias("qualidade"),
    )
    queries = spark.sql("SELECT * FROM VALUES ('ring'), ('Vidget'), ('rynG'), ('zzz'), ('e') AS t(query)")
    return search.people(rows, queries, "%E%", "BIRT", 1802, 1807, 20)
