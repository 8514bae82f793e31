"""Distributed union-find over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regista.llm import common
from regista.llm.common import materialise


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of the links (a, b): rows (id, component).

    Alternating star contraction: a large step joins every larger neighbour of
    a node to the smallest id around it, a small step does so for the smaller
    neighbours. Each step is one partial aggregate and one join, so a node
    with a great many neighbours is combined before the shuffle and its join
    can be split by adaptive execution. Links of common.FEW rows at most are
    kept in one partition, so that their rounds need no shuffle. Self links and null ids are ignored,
    links may repeat; ids without a link have no row. component is the
    smallest id of the component. An empty table gives an empty table.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )
    few = edges.count() <= common.FEW

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if few else rows

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    if few:
        edges = materialise(dealt(edges))
    seen = None
    for _ in range(rounds):
        edges = dealt(edges)
        both = dealt(edges.union(edges.select("u", "v")))  # as (v, u), the neighbour last
        low = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))
        large = both.where("u > v").join(sent(low), "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(sent(low), "v")
            .select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        edges = materialise(small)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    member = edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return dealt(member.union(dealt(edges).select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()))
