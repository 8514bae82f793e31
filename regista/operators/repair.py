"""Maintenance jobs: mappings, gap filling, contaminated rows, duplicates, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regista.functions.dates import strict_date
from regista.functions.names import match_key
from regista.functions.text import page_reason


def by_precedence(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of first, and of second for keys that first lacks."""
    return first.select(key, value).union(second.select(key, value).join(first.select(key), key, "left_anti"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def filled(target: DataFrame, patch: DataFrame, on: list[str], columns: list[str], lengths: dict[str, int] | None = None) -> DataFrame:
    """target with its empty columns filled from patch rows of the same key; others stay. Adds filled, how many columns changed."""
    p = patch.select(*on, *[F.substring(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), 1, (lengths or {}).get(c, 100)).alias(f"_{c}") for c in columns])
    out = target.join(p, on, "left")
    empty = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNull() & F.col(f"_{c}").isNotNull() for c in columns}
    changed = sum((e.cast("int") for e in empty.values()), F.lit(0))
    out = out.withColumn("filled", changed)
    return out.withColumns({c: F.when(empty[c], F.col(f"_{c}")).otherwise(F.col(c).cast("string")) for c in columns}).drop(*[f"_{c}" for c in columns])


def date_backfill(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (id, file_id, data) whose date is null, with the date of their page (file_id, text) where it is a death record: id, file_id, found, status."""
    texts = pages.select("file_id", F.when(page_reason(F.col("text")) == "valid", strict_date(F.col("text"))).alias("found"), F.lit(True).alias("here"))
    out = rows.where("data is null").join(texts, "file_id", "left")
    return out.select("id", "file_id", "found", F.when(F.col("here").isNull(), "no_file").when(F.col("found").isNull(), "no_date").otherwise("updated").alias("status"))


def relation_backfill(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (id, file_id, pai, mae, conjuge) with empty relations filled from the first death entry of their page (file_id, deceased)."""
    one = pages.select("file_id", F.get("deceased", F.lit(0)).alias("e")).where("e is not null")
    either = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.col(f"e.{k}")), F.lit("")) for k in keys])
    patch = one.select("file_id", either("father", "pai").alias("pai"), either("mother", "mae").alias("mae"), either("spouse", "conjuge").alias("conjuge")).where("coalesce(pai, mae, conjuge) is not null")
    return filled(rows, patch, ["file_id"], ["pai", "mae", "conjuge"])


def baptism_backfill(rows: DataFrame, pages: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows (id, file_id, nome, sobrenome, columns) with empty columns filled from the baptism entry of the same file and name; columns gives each column's source keys, the first that is not empty counts."""
    entries = pages.select("file_id", F.posexplode("baptized").alias("at", "e"))
    values = [F.coalesce(*[F.nullif(F.trim(F.col(f"e.{k}")), F.lit("")) for k in keys]).alias(c) for c, keys in columns.items()]
    patch = entries.select("file_id", "at", match_key(F.coalesce("e.name", "e.nome")).alias("key"), *values)
    patch = latest(patch, ["file_id", "key"], F.col("at").asc())
    keyed = rows.withColumn("key", match_key(F.concat_ws(" ", "nome", "sobrenome")))
    return filled(keyed, patch, ["file_id", "key"], list(columns), {"texto_original": 4000}).drop("key")


def contaminated(entries: DataFrame, group: str, at: str, value: str, own: str) -> DataFrame:
    """Rows of groups of several that carry the first entry's value though their own is another: group, at, value, own, repaired (own, or null where it is the first's)."""
    w = Window.partitionBy(group)
    first = F.min_by(own, at).over(w)
    marked = entries.withColumns({"_first": first, "_n": F.count(F.lit(1)).over(w)})
    wrong = (F.col("_n") > 1) & (F.col(value) == F.col("_first")) & ~F.col(own).eqNullSafe(F.col("_first"))
    return marked.where(wrong).withColumn("repaired", F.col(own)).drop("_first", "_n")


def marriage_backfill(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, patch columns) of rows (id, file_id, nome, conjuge) and patches (file_id, name, spouse, ...): same file and name, and same spouse where the patch names one."""
    key = lambda c: match_key(F.col(c))
    r = rows.select("id", "file_id", key("nome").alias("n"), key("conjuge").alias("s"))
    p = patches.withColumns({"n": key("name"), "s": key("spouse")}).drop("name", "spouse")
    exact = r.join(p.where("s <> ''"), ["file_id", "n", "s"])
    any_ = r.drop("s").join(p.where("s = ''"), ["file_id", "n"])
    return exact.unionByName(any_.select(*exact.columns))


def unknown_names(rows: DataFrame, pages: DataFrame, found: Column, placeholder: str = "Desconhecido") -> DataFrame:
    """rows (id, file_id, nome) with the placeholder, with the name that found reads from the page text: id, nome, status."""
    texts = pages.select("file_id", found.alias("found"), F.lit(True).alias("here"))
    out = rows.where(F.col("nome") == placeholder).join(texts, "file_id", "left")
    return out.select("id", F.coalesce("found", "nome").alias("nome"), F.when(F.col("here").isNull(), "no_file").when(F.col("found").isNull(), "no_name").otherwise("updated").alias("status"))


def url_backfill(rows: DataFrame, prefix: str) -> DataFrame:
    """(id, link) of rows (id, file_id, imagem_url) whose link is not the one that their file id gives."""
    want = F.concat(F.lit(prefix), F.col("file_id"))
    return rows.where(F.col("file_id").isNotNull() & ~F.col("imagem_url").eqNullSafe(want)).select("id", want.alias("link"))


def first_of_each(rows: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Rows without those that repeat the keys of a smaller id; null keys are equal, an id that stands in several groups counts in each."""
    least = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(id_column).alias("_least"))
    same = F.col(id_column) == F.col("_least")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(least, same, "left_semi")


def duplicate_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, groups of equal keys, and surplus rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("surplus"))
