"""Searches over person, book and record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regista.functions.names import folded, token_key
from regista.operators.family import containing


def contains_any(columns: list[str], text: str) -> Column:
    """Any of the columns contains the text, in any case; accents count."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in columns])


def page(rows: DataFrame, *order: Column, limit: int = 50, offset: int = 0, most: int = 100) -> DataFrame:
    """One page of rows in order; the limit is held to 1..most, the offset to 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(most, max(1, limit)))


def page_with_total(rows: DataFrame, *order: Column, number: int = 1, size: int = 50) -> DataFrame:
    """A page of rows and, in each row, how many there are in all."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return page(rows, *order, limit=size, offset=(number - 1) * size, most=size).join(F.broadcast(total))  # one row


def public(quality: Column) -> Column:
    """Rows that may be shown: quality above 0 or unknown."""
    return (quality > 0) | quality.isNull()


def in_years(date: Column, first: int | None, last: int | None) -> Column:
    """The date lies in the years; years that have not four digits (1000 to 2999) are ignored."""
    test = F.lit(True)
    if first and 1000 <= first <= 2999:
        test = test & (date >= F.make_date(F.lit(first), F.lit(1), F.lit(1)))
    if last and 1000 <= last <= 2999:
        test = test & (date < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1)))
    return test


def typed(filters: list[tuple]) -> Column:
    """All of (field, op, value...) hold; ops eq, gt, lt, gte, lte, like, in, between."""

    def one(field: str, op: str, *v) -> Column:
        c = F.col(field)
        return {
            "eq": lambda: c == v[0], "gt": lambda: c > v[0], "lt": lambda: c < v[0], "gte": lambda: c >= v[0], "lte": lambda: c <= v[0],
            "like": lambda: F.contains(F.lower(c), F.lit(str(v[0]).lower())), "in": lambda: c.isin(*v[0]), "between": lambda: c.between(v[0], v[1]),
        }[op]()

    return reduce(lambda a, b: a & b, [one(*f) for f in filters], F.lit(True))


#: Texts up to so many are broadcast and looked for in every row; more of them meet the rows by trigrams.
BROADCAST_TEXTS = 1000


def hits(rows: DataFrame, name: str, texts: DataFrame) -> DataFrame:
    """rows with each of texts (text) that their name contains; a row has one row for each hit. Few texts are broadcast after they have been counted; for more, texts of three letters or more meet the names by a trigram, and only the shorter ones are held against every row."""

    def broadcast_join(some: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(some), F.contains(name, F.col("text")))

    if texts.count() <= BROADCAST_TEXTS:
        return broadcast_join(texts)
    each = rows.select(F.col(name).alias("text")).distinct()
    pairs = containing(texts.select(F.col("text").alias("needle_id"), F.col("text").alias("needle")), each.select(F.col("text").alias("text_id"), "text"))
    long = pairs.select(F.col("needle_id").alias("text"), F.col("text_id").alias(name))
    same = texts.where(F.length("text") >= 3).select("text", F.col("text").alias(name))  # containing() leaves equal ids out
    return rows.join(long.union(same), name).unionByName(broadcast_join(texts.where(F.length("text") < 3)))


def variant_search(rows: DataFrame, key: str, columns: list[str], queries: DataFrame, variants: DataFrame, most: int = 8) -> DataFrame:
    """(query, key) of rows one of whose columns contains a variant of the query; variants (norm, variant), a query without any stands for itself, at most so many variants each."""
    own = queries.select("query", token_key(F.col("query")).alias("norm"))
    w = Window.partitionBy("query").orderBy("text")
    spread = own.join(variants, "norm", "left").select("query", F.lower(F.coalesce("variant", "query")).alias("text")).distinct()
    spread = spread.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("query", "text")
    names = rows.select(key, F.explode(F.array_distinct(F.array(*[F.lower(F.col(c)) for c in columns]))).alias("name")).where("name is not null")
    return hits(names, "name", spread.select("text").distinct()).join(spread, "text").select("query", key).distinct()


def with_fallback(rows: DataFrame, name: str, queries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query, match, how, keep) of rows whose name contains the query; queries without any hit, of three letters or more, are tried in modern spelling, under the same filters. keep are further columns of rows."""

    def tried(form, some: DataFrame, how: str) -> DataFrame:
        texts = some.select("query", form(F.col("query")).alias("text"))
        found = hits(rows.select(*keep, F.col(name).alias("match"), form(F.col(name)).alias("name")), "name", texts.select("text").distinct())
        return found.join(texts, "text").select("query", "match", F.lit(how).alias("how"), *keep)

    direct = tried(F.lower, queries, "direct")
    missed = queries.where(F.length("query") >= 3).join(direct.select("query").distinct(), "query", "left_anti")
    return direct.union(tried(folded, missed, "folded"))


def people(rows: DataFrame, queries: DataFrame, place: str = "", kind: str | None = None, first: int | None = None, last: int | None = None, limit: int = 50) -> DataFrame:
    """The newest people (id, nome, freguesia, tipo_registo, data, qualidade) for each of queries (query): query, id, match, how, rank. A row counts if it may be shown, its place contains place, it is of the kind and its date lies in the years; a query that finds nothing among those is tried in modern spelling under the same filters."""
    some = public(F.col("qualidade")) & all_contain({"freguesia": place}) & in_years(F.col("data"), first, last)
    shown = rows.where(some & (F.col("tipo_registo") == kind) if kind else some)
    newest = Window.partitionBy("query").orderBy(F.col("id").desc())
    found = with_fallback(shown, "nome", queries, ("id",)).withColumn("rank", F.row_number().over(newest))
    return found.where(F.col("rank") <= limit).select("query", "id", "match", "how", "rank")


def suggestions(log: DataFrame, prefix: str, fixed: list[str], recent: int = 1000, most: int = 10) -> DataFrame:
    """Completions of a prefix of two letters or more: recent distinct queries (query, ts), newest first, then the fixed list."""
    p = prefix.lower()
    latest = log.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.max("ts").alias("ts")).orderBy(F.col("ts").desc(), "query").limit(recent)
    own = latest.where(F.startswith("query", F.lit(p))).select("query", F.lit(0).alias("rank"), F.col("ts").cast("double").alias("ts"))
    spare = log.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, fixed))).alias("query")).where(F.startswith(F.lower("query"), F.lit(p)))
    both = own.union(spare.select("query", F.lit(1).alias("rank"), F.lit(0.0).alias("ts")))
    both = both.groupBy("query").agg(F.min(F.struct("rank", (-F.col("ts")).alias("age"))).alias("k"))
    return both.where(F.lit(len(prefix) >= 2)).orderBy("k", "query").limit(most).select("query")


def all_contain(filters: dict[str, str | None]) -> Column:
    """Every column contains its text, in any case; a leading 'ilike.' and the signs % around a text are stripped, empty texts are no filter."""

    def bare(value: str | None) -> str:
        return (value or "").removeprefix("ilike.").strip("%").lower()

    tests = [F.contains(F.lower(F.col(c)), F.lit(bare(v))) for c, v in filters.items() if bare(v)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def marriages(rows: DataFrame, text: str = "", place: str = "", first: int | None = None, last: int | None = None, limit: int = 100) -> DataFrame:
    """The newest marriages (id, nome, conjuge, testemunhas, freguesia, data) where bride, groom or witnesses contain text and the place contains place, in the years."""
    hit = contains_any(["nome", "conjuge", "testemunhas"], text) if text else F.lit(True)
    found = rows.where(hit & all_contain({"freguesia": place}) & in_years(F.col("data"), first, last))
    return page(found, F.col("id").desc(), limit=limit)


def by_date(rows: DataFrame, name: str, date: str = "data", kind: str | None = None) -> DataFrame:
    """Rows (id, nome, tipo_registo, date) whose name contains name, of a type or of all, in order of date, nulls first, as a sort without an index gives them."""
    found = rows.where(F.contains(F.lower("nome"), F.lit(name.lower())))
    if kind:
        found = found.where(F.col("tipo_registo") == kind)
    return found.orderBy(F.col(date).asc_nulls_first(), "id")


def of_place(rows: DataFrame, place: str) -> DataFrame:
    """Rows of exactly this place, in order of date."""
    return rows.where(F.col("freguesia") == place).orderBy(F.col("data").asc_nulls_first(), "id")


def by_id(rows: DataFrame, value: int) -> DataFrame:
    """The row with this id, all columns; no row if there is none."""
    return rows.where(F.col("id") == value)


def tree_nodes(people: DataFrame, place: str | None = None, name: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """People of a place whose name contains name and whose first known date, of death, birth and marriage in this order, lies in the years; adds that date as quando. With years given, people without any date are left out."""
    when = F.coalesce("data_obito", "data_nascimento", "data_casamento")
    found = people.withColumn("quando", when)
    if place:
        found = found.where(F.col("freguesia") == place)
    if name:
        found = found.where(F.contains(F.lower("nome"), F.lit(name.lower())))
    if first or last:
        found = found.where(F.year("quando").between(first or 0, last or 9999))
    return found


def inventory_of(inventory: DataFrame, text: str) -> DataFrame:
    """Inventory rows (place, url) whose place contains text, in any case, with the document number that the viewer's address names."""
    number = F.nullif(F.regexp_extract("url", r"(\d+)(?:[/?#]|$)", 1), F.lit(""))
    return inventory.where(F.contains(F.lower("place"), F.lit(text.lower()))).withColumn("document", number)


def listed(names: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """The first names or places that contain text, case counting."""
    return names.where(F.contains("name", F.lit(text))).orderBy("name").limit(limit)


def best_lines(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines (id, line_no, quality) of at least this quality, the best first, ties in the order of the text."""
    return lines.where(F.col("quality") >= least).orderBy(F.col("quality").desc(), "id", "line_no")


def by_count(rows: DataFrame, count: str, ascending: bool) -> DataFrame:
    """Rows in order of a count in either direction, a missing count as 0."""
    n = F.coalesce(count, F.lit(0))
    return rows.withColumn(count, n).orderBy(F.col(count).asc() if ascending else F.col(count).desc(), "name")
