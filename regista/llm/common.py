"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regista.functions.ranks import materialise, with_rank  # noqa: F401  the operators take them from here

#: Runs of the white space that separates words.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows of a table that is kept in one partition, where its joins and groups need no shuffle. Larger ones stay dealt out.
FEW = 20_000


def gathered(rows: DataFrame) -> DataFrame:
    """Materialised rows in one partition if they are FEW at most, or else as they are."""
    return rows.coalesce(1) if rows.count() <= FEW else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name among them can clash with those that an operator adds."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns])


def unpacked(rows: DataFrame, columns: list[str], name: str, **new: Column) -> DataFrame:
    """The columns that whole() has put into the column name, in their order, but new ones in place of those of the same name."""
    return rows.select(*[new.get(c, F.col(name).getField(c)).alias(c) for c in columns])


def text_of(column: str = "text") -> Column:
    """The text, '' where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def placed_within(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with their place, from 1, among those of equal key. No task sees all rows of a key: narrow rows are ranked over all keys, and the first rank of each key is taken off."""
    fixed = materialise(rows.withColumn("_at", F.monotonically_increasing_id()))
    ranked = materialise(with_rank(fixed.select(key, "_at"), F.col(key), F.col("_at"), name="_rank"))
    firsts = ranked.groupBy(key).agg(F.min("_rank").alias("_first"))
    places = ranked.join(firsts, key).select("_at", (F.col("_rank") - F.col("_first") + 1).alias(name))
    return fixed.join(places, "_at").drop("_at")


def words(text: Column) -> Column:
    """The runs of characters other than the six white space characters."""
    return F.array_remove(F.split(text, SPACES), "")


def uniform(*parts: Column | int) -> Column:
    """A repeatable draw from [0, 1) that depends on the parts alone."""
    h = F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
