"""Mixing sources to target weights by pivotal dependent rounding, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import SPACES, materialise, placed_within, text_of, uniform, unpacked, whole, with_rank

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times the source's size, and a document at so many copies.
MOST = 3
#: Fractions that one step of the reduction tree pairs in a task.
FAN = 256
SEED = 20240501
#: Fractions this near to 0 or 1 count as whole.
WHOLE = 1e-12


def word_count(text: Column) -> Column:
    """The number of runs of characters other than the six white space characters."""
    parts = F.split(text, SPACES)
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, target for sizes (source, source_size), one row for each source.

    Sources in code point order, null last, weigh weights, repeating. Together
    they get share of all sizes, by weight; a target stops at most times its
    source's size, and what it leaves is shared again by weight among the
    others, until none is above. Sources without words get 0.
    """
    place = with_rank(sizes, F.col("source").asc_nulls_last(), name="_at")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    open_ = materialise(place.select("source", "source_size", F.get(cycle, (F.col("_at") % len(weights)).cast("int")).alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    total = float(open_.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1  # words for each unit of weight; sources at their cap
    while True:
        at_cap = F.col("weight") * F.lit(level) >= F.col("cap")
        n, caps, free = open_.agg(F.count_if(at_cap), F.sum(F.when(at_cap, F.col("cap"))), F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = max(0.0, total - (caps or 0.0)) / free, n
    return open_.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _whole(p: Column) -> Column:
    return (p < WHOLE) | (p > 1 - WHOLE)


def _pair(held: Column, item: Column) -> Column:
    """One pivotal step: what is held and the next fraction give one settled row and one that is held.

    A fraction is (p, draw, rank). The sum of the two stays: either one takes
    all of it, or one is filled to 1 and the other keeps the rest, with the
    odds that leave each row's expectation as it was.
    """
    a, b, u = held["p"], item["p"], item["draw"]
    both = a + b
    low = both < 1
    first_goes = F.when(low, u * both < b).otherwise(u * (F.lit(2.0) - both) < (F.lit(1.0) - a))
    # low: the loser gets 0, the other holds the sum; else: the winner gets 1, the other holds the sum less 1
    settled = F.when(low, F.when(first_goes, held["rank"]).otherwise(item["rank"])).otherwise(F.when(first_goes, item["rank"]).otherwise(held["rank"]))
    stays = F.when(low, F.when(first_goes, item["rank"]).otherwise(held["rank"])).otherwise(F.when(first_goes, held["rank"]).otherwise(item["rank"]))
    value = F.when(low, F.lit(0)).otherwise(F.lit(1))
    rest = F.when(low, both).otherwise(both - 1)
    return F.struct(
        F.struct(rest.alias("p"), item["draw"].alias("draw"), stays.alias("rank")).alias("held"),
        F.struct(settled.alias("rank"), value.alias("extra")).alias("done"),
    )


def rounded(fractions: DataFrame) -> DataFrame:
    """Pivotal dependent rounding of fractions (source, rank, p): (rank, extra 0 or 1).

    Neighbours in rank order are paired, FAN rows to a task's array, until one
    fraction of each block is left; the blocks' rests go to the next level of
    the tree, and so on until each source has one, which is settled by a draw.
    Each level leaves one row in FAN, so no step sees more than FAN rows at
    once, and the sum over any block changes by less than 1. Draws depend on
    the rank and the level alone.
    """
    done = None
    left = fractions.select("source", "rank", "p", F.col("rank").alias("at"))
    level = 0
    while True:
        item = F.struct(F.col("p"), uniform(F.lit(SEED), F.lit(level), F.col("rank")).alias("draw"), F.col("rank"))
        blocks = left.groupBy("source", F.floor(F.col("at") / FAN).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", item.alias("item")))).alias("items"))
        blocks = blocks.withColumn("items", F.transform("items", lambda x: x["item"]))
        start = F.struct(F.get("items", F.lit(0)).alias("held"), F.array().cast("array<struct<rank:bigint,extra:int>>").alias("done"))

        def step(acc: Column, x: Column) -> Column:
            one, whole = acc["held"], _whole(acc["held"]["p"])
            as_is = F.struct(one["rank"].alias("rank"), F.round(one["p"]).cast("int").alias("extra"))
            put = F.when(whole, as_is).otherwise(_pair(one, x)["done"])
            held = F.when(whole, x).otherwise(_pair(one, x)["held"])
            return F.struct(held.alias("held"), F.concat(acc["done"], F.array(put)).alias("done"))

        folded = materialise(blocks.select("source", "block", F.aggregate(F.slice("items", 2, F.size("items")), start, step).alias("r")).select("source", "block", "r.held", "r.done"))
        settled = folded.select(F.explode("done").alias("d")).select("d.rank", "d.extra")
        done = settled if done is None else done.union(settled)
        left = folded.select("source", F.col("held.rank").alias("rank"), F.col("held.p").alias("p"), F.col("block").alias("at"))
        level += 1
        if not left.groupBy("source").count().where("count > 1").take(1):
            break
    last = left.select("rank", (uniform(F.lit(SEED), F.lit(-1), F.col("rank")) < F.col("p")).cast("int").alias("extra"))
    return done.union(last)


#: Up to so many sources their table is broadcast (a name, two numbers each); more of them are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def _decided(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, row) with source_size, target and copies."""
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    shares = materialise(targets(sizes).withColumnRenamed("source", "_source"))
    if shares.count() <= BROADCAST_SOURCES:
        shares = F.broadcast(shares)
    placed = with_rank(rows, F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc())
    placed = placed.join(shares, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    placed = placed.withColumn("_rate", F.when(_whole(rate - F.floor(rate)), F.round(rate).cast("double")).otherwise(rate))
    part = F.col("_rate") - F.floor("_rate")
    extra = rounded(placed.where(part > 0).select("source", "rank", part.alias("p")))
    copies = F.floor("_rate").cast("int") + F.coalesce("extra", F.lit(0))
    return placed.join(extra, "rank", "left").withColumn("copies", copies).drop("extra", "_rate", "rank")


def _rows(docs: DataFrame) -> DataFrame:
    """A narrow row for each of docs; the words of a text are counted once. row is a hash of all columns but the kind that can't be hashed."""
    hashed = [F.col("`" + name.replace("`", "``") + "`") for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return materialise(docs.select("doc_id", "source", word_count(text_of()).alias("size"), F.xxhash64(*hashed).alias("row")))


def mix(docs: DataFrame) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, source, copies.

    size is the number of words (null text: 0), target the words that the
    document's source should give (see targets()). Every document of a source
    has the same fractional number of copies, target / source_size. Its whole
    part is taken; the fractions are rounded by rounded(), in order of size, so
    that what neighbours take differs by little from what they should. taken =
    size * copies. The result depends on the rows alone, not on their
    partitions. A null source is a source; sources without words take nothing;
    rows that repeat another are rounded as rows of their own. Texts of any
    length are counted whole. An empty table stays empty; other columns only
    break ties.
    """
    return _decided(_rows(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as mix() takes it, all columns as they were, whatever their names.

    Rows equal in all columns are taken together as often as mix() takes them
    all; unlike rows never stand for each other. An empty table stays empty.
    """
    rows = _rows(docs)
    found = materialise(_decided(rows).groupBy("row").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0"))
    hashed = [F.col("`" + name.replace("`", "``") + "`") for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    out = docs.select(whole(docs).alias("doc"), F.xxhash64(*hashed).alias("row")).join(found, "row")
    if found.where("n > 1").take(1):  # rows that repeat: the first ones take what does not divide
        several = placed_within(out.where("n > 1"), "row", "nth")
        share = F.floor(F.col("copies") / F.col("n")) + (F.col("nth") <= F.pmod("copies", "n")).cast("long")
        out = out.where("n = 1").select("doc", "copies").union(several.select("doc", share.alias("copies")).where("copies > 0"))
    repeated = out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    return unpacked(repeated, docs.columns, "doc")
