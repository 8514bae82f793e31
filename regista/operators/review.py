"""Review decisions: a log laid over the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a reviewer may change.
EDITABLE = ("nome", "data_obito", "numero_registo", "freguesia", "concelho", "pagina")
ILLEGIBLE = "ileg|\\?\\?|desconhecid"


def decided(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """records (id, ...) as the latest decision on each (id, at, action, and corrected columns) leaves them: reject, illegible and skip give quality 0, approve and edit give quality 1 and the corrected values; all mark the record validated."""
    fields = [c for c in EDITABLE if c in decisions.columns and c in records.columns]
    last = decisions.groupBy("id").agg(F.max_by(F.struct("action", *fields), F.struct("at", "action")).alias("d"))
    out = records.join(last, "id", "left")
    good = F.col("d.action").isin("approve", "edit")
    cols = {c: F.when(good, F.coalesce(F.col(f"d.{c}"), F.col(c))).otherwise(F.col(c)) for c in fields}
    cols["validado"] = F.col("d.action").isNotNull() | F.coalesce("validado", F.lit(False))
    cols["qualidade"] = F.when(good, F.lit(1.0)).when(F.col("d.action").isNotNull(), F.lit(0.0)).otherwise(F.col("qualidade"))
    return out.withColumns(cols).drop("d")


def bulk_approved(records: DataFrame, book: Column | None = None) -> DataFrame:
    """records with every pending one (of the books) approved; changed marks them."""
    hit = (F.col("status") == "pendente") & (book if book is not None else F.lit(True))
    return records.withColumn("changed", hit).withColumn("status", F.when(hit, "aprovado").otherwise(F.col("status")))


def next_to_validate(records: DataFrame, newest: int = 5) -> DataFrame:
    """One record: of the newest not validated ones with a name, the first that is legible, else the first."""
    open_ = records.where(~F.coalesce("validado", F.lit(False)) & (F.trim("nome") != "")).orderBy(F.col("id").desc()).limit(newest)
    return open_.orderBy(F.lower("nome").rlike(ILLEGIBLE), F.col("id").desc()).limit(1)


def suspicious(records: DataFrame, least: float = 0.4, most: int = 50) -> DataFrame:
    return records.where(F.col("qualidade") < least).orderBy("qualidade", "id").limit(most)


#: Columns of a book that may be changed.
BOOK_FIELDS = ("marcado", "processado", "notas")


def patched(books: DataFrame, changes: DataFrame) -> DataFrame:
    """books (id, ...) with the columns of BOOK_FIELDS that the latest change (id, at, ...) of each names; a null changes nothing, other columns can't be changed."""
    fields = [c for c in BOOK_FIELDS if c in books.columns and c in changes.columns]
    last = changes.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"new_{c}") for c in fields])
    out = books.join(last, "id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in fields})
    return out.drop(*[f"new_{c}" for c in fields])


def book_counts(books: DataFrame) -> DataFrame:
    """How many books there are, are marked and are processed."""
    return books.agg(F.count(F.lit(1)).alias("books"), F.count_if("marcado").alias("marked"), F.count_if("processado").alias("processed"))
