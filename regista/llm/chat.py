"""Preference formatting of conversations, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regista.llm.common import materialise, with_rank

#: How a turn is rendered: OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _ordered(turns: Column) -> Column:
    return F.transform(F.array_sort(turns), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(CLOSE))


def _body(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit(END))


def rendered(turns: Column) -> Column:
    """The turns as one string; '' for no turns."""
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x["role"]), _body(x["text"]))), "")


def trained_spans(turns: Column) -> Column:
    """The code points [start, end) of rendered(turns) that count for the loss: text and end mark of assistant turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        low = acc["at"] + F.length(_head(x["role"]))
        high = low + F.length(_body(x["text"]))
        span = F.array(F.struct(low.alias("start"), high.alias("end")))
        spans = F.when(x["role"] == TRAINED, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(high.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each pair of conversations: what they share, once, and two masked completions.

    chosen and rejected have rows (pair_id, turn, role, text). Columns of the
    result: pair_id, n_common (turns of the longest common prefix), prompt
    (those turns, rendered), chosen, rejected (the turns after it, rendered),
    chosen_spans, rejected_spans (the code points of a completion that are
    trained on: text and end mark of assistant turns; all else is masked).
    Turns are equal if role and text are, nulls included; turn numbers only
    order them, and turns that repeat a number are ordered by role and text.
    A null role or text is rendered as ''. A pair with one side only has no
    row, as there is nothing to prefer; two equal conversations give empty
    completions. A null pair_id makes no pair. A conversation is one row of
    the result, so its turns meet in one task; pairs never do. Other columns
    are ignored.
    """
    turn = F.struct("turn", "role", "text")
    both = chosen.select("pair_id", F.lit(0).alias("side"), turn.alias("t")).union(rejected.select("pair_id", F.lit(1).alias("side"), turn.alias("t")))
    sides = [F.collect_list(F.when(F.col("side") == s, F.col("t"))).alias(name) for s, name in ((0, "c"), (1, "r"))]
    pairs = both.where("pair_id is not null").groupBy("pair_id").agg(*sides).where("size(c) > 0 and size(r) > 0")
    pairs = pairs.select("pair_id", _ordered(F.col("c")).alias("c"), _ordered(F.col("r")).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, F.lit(False)).cast("int")
    pairs = pairs.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(least))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    pairs = pairs.select("pair_id", "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return pairs.select(
        "pair_id", "n_common", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"),
        trained_spans(F.col("c")).alias("chosen_spans"), trained_spans(F.col("r")).alias("rejected_spans"),
    )


def contrasted(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns made from conversations (conv_id, turn, role, text), for tables without preferences.

    Chosen is a conversation as it is. Rejected is the same with the text of
    one of its assistant turns replaced by an answer of the next conversation
    that has one, an answer to something else; after the last comes the first.
    Of k answers that with number conv_id modulo k is replaced or lent, so the
    two sides part at early turns as well as late ones, and what follows stays
    in both. A conversation without an answer, or one whose neighbour's answer
    is the same (as when there is one conversation only), is equal on both
    sides. Every conv_id but null has its two sides; turns are numbered anew
    from 0, in order of number, role and text.
    """
    turns = conversations.where("conv_id is not null").groupBy(F.col("conv_id").alias("pair_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    answers = F.filter(F.transform("ts", lambda x, i: F.struct(i.alias("at"), x["role"].alias("role"), x["text"].alias("text"))), lambda x: x["role"] == TRAINED)
    own = turns.select("pair_id", answers.alias("a")).where(F.size("a") > 0)
    own = materialise(own.select("pair_id", F.get("a", F.pmod("pair_id", F.size("a")).cast("int")).alias("a")).select("pair_id", "a.at", "a.text"))
    ranked = with_rank(own.select("pair_id"), F.col("pair_id"))
    n = own.count()
    lent = ranked.join(own, "pair_id").select(F.pmod(F.col("rank") - 1, F.lit(max(1, n))).alias("rank"), F.col("text").alias("other"))
    swap = ranked.join(own.select("pair_id", "at"), "pair_id").join(lent, "rank").select("pair_id", "at", "other")

    each = turns.select("pair_id", F.posexplode("ts").alias("turn", "x")).select("pair_id", "turn", "x.role", "x.text")
    here = F.col("at").isNotNull() & (F.col("turn") == F.col("at"))
    rejected = each.join(swap, "pair_id", "left").withColumn("text", F.when(here, F.col("other")).otherwise(F.col("text"))).select("pair_id", "turn", "role", "text")
    return each, rejected
